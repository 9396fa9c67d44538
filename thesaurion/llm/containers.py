"""Problem 8: texts packed into containers of fixed capacity.

Bounded-space online best fit: a task keeps a fixed number of open containers in a bitset keyed by free space. An item
goes where it leaves the least space; if none has room, a new container opens, and when too many are open, the fullest
closes. What is still open when a task ends is packed again by fewer tasks, round by round, until one closes all.
No shuffle of texts: they are measured where they are read, and only (id, piece, size) goes on.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thesaurion.runtime import Scratch

OPEN = 64  #: containers open at once in a task
ITEMS = 100_000  #: items of a container at most; only blank texts come near it
FAN_IN = 32  #: tasks whose open containers one task of the next round takes over
#: Fixed value: the published splitting pattern of the 50k byte-level vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def sizes(docs: DataFrame, doc_id: str, text: str, tokenizer: str) -> DataFrame:
    """(doc_id as string, size): tokens of each text; 0 for null and empty texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = encoding(tokenizer)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "size": [len(own.encode_ordinary(t)) if t else 0 for t in b["text"]]})

    return docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).alias("text")).mapInPandas(run, "doc_id string, size int")


class BestFit:
    """The open containers: bit f of `bits` is set while one with free space f is open."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.bits, self.open = 0, 0
        self.by_free: dict[int, list[list]] = {}

    def _take(self, free: int) -> list:
        bins = self.by_free[free]
        one = bins.pop()
        if not bins:
            self.bits ^= 1 << free
        self.open -= 1
        return one

    def _keep(self, free: int, one: list) -> None:
        self.by_free.setdefault(free, []).append(one)
        self.bits |= 1 << free
        self.open += 1

    def add(self, item, size: int) -> list[list]:
        """Place one item; the containers that close by it."""
        room = self.bits >> size
        free = size + (room & -room).bit_length() - 1 if room else self.capacity
        one = self._take(free) if room else []
        one.append(item)
        closed = []
        if (free == size and size) or len(one) >= ITEMS:
            closed.append(one)
        else:
            if self.open == self.most:
                closed.append(self._take((self.bits & -self.bits).bit_length() - 1))
            self._keep(free - size, one)
        return closed

    def rest(self) -> list[list]:
        return [one for free in sorted(self.by_free) for one in self.by_free[free]]


def pack(items: DataFrame, capacity: int, scratch: Scratch, most: int = OPEN) -> DataFrame:
    """doc_id, piece, start, n_tokens, container_id from (doc_id string, size int).

    An item longer than the capacity is cut into pieces of the capacity, each a container of its own, and a last piece
    that is packed like any other item. Items of size 0 (blank or null texts) get a place too; a negative or null size
    counts as 0; so that a run of them fills no container without end, one closes at ITEMS items. Repeated rows and null ids are items in their own right. No items give no rows."""
    schema = "doc_id string, piece int, start int, n_tokens int, container_id string"

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for b in batches:
            for doc, size in zip(b["doc_id"].tolist(), b["size"].fillna(0).astype(int).tolist()):
                size = max(size, 0)
                for piece in range(max(1, -(-size // capacity))):
                    yield doc, piece, piece * capacity, min(capacity, size - piece * capacity)

    def again(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for b in batches:
            yield from zip(b["doc_id"].tolist(), b["piece"].tolist(), b["start"].tolist(), b["n_tokens"].tolist())

    def runner(source, level: int, last: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            bins, made, name = BestFit(capacity, most), 0, f"{level}-{TaskContext.get().partitionId()}"
            done: list[tuple] = []
            for item in source(batches):
                for one in bins.add(item, item[3]):
                    done += [(*x, f"{name}-{made}") for x in one]
                    made += 1
                if len(done) >= 20_000:
                    yield _frame(done)
                    done = []
            for one in bins.rest():
                done += [(*x, f"{name}-{made}" if last else None) for x in one]
                made += last
            yield _frame(done)

        return run

    now = scratch.cut(items.mapInPandas(runner(cut, 0, False), schema))
    out, level = now.where("container_id is not null"), 0
    tasks = max(1, items.rdd.getNumPartitions())
    while True:
        level += 1
        tasks = -(-tasks // FAN_IN)
        left = now.where("container_id is null").drop("container_id").coalesce(tasks)
        now = scratch.cut(left.mapInPandas(runner(again, level, tasks == 1), schema))
        out = out.union(now.where("container_id is not null"))
        if tasks == 1:
            return out


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["doc_id", "piece", "start", "n_tokens", "container_id"])
