"""Problem 10: subject areas of documents by latent Dirichlet topics.

1. Words are hashed once, sentence by sentence; later steps see numbers only. Words that a five-hundredth of a language's
   documents hold have a column of their own, all rarer ones share BUCKETS columns by their hash, so that no word is left
   out and the memory of a model is bounded.
2. The languages are those that the documents' tags name, told by the words their documents hold; tags with like words
   are one language.
3. One topic model per language is fitted by distributed variational Bayes: each round every partition infers its
   documents' topic weights and adds up expected word counts, which are summed topic by topic, until the topics stay
   as they are. Some topics start near the words of a subject's labelled examples, the others free.
4. A topic stands for a subject if its top terms do, judged by the labelled examples in which these terms occur.
5. A sentence treats of a subject if the topics of its words do; a document has the subjects of a fifth of its
   sentences, sentences taken from test items left aside.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thesaurion.llm.tokens import Tokens, Triples, batches, tokens, triples
from thesaurion.runtime import Scratch

FREE = 10  #: topics besides one per subject
ROUNDS = 12  #: rounds of fitting at most
STILL = 0.02  #: the share of the topics' weight that may still move when fitting ends
INNER = 6  #: inner rounds per document
OWN_COLUMN = 0.002  #: share of a language's documents that hold a word with a column of its own
COMMON = 0.01  #: share of those that hold a word with one of the first columns, and of a tag's that hold a telling word
BUCKETS = 1 << 12  #: columns that the rarer words share
FLAT = 0.25  #: beyond this share a word counts only if the labelled examples that hold it speak for one subject
LEAST_DOCS = 3
TAG_SHARE, TAG_DOCS, ALIKE = 0.001, 5, 0.6  #: documents of a tag that names a language; likeness of tags of one language
TOP = 20  #: terms by which a topic is judged
SURE = 0.5  #: share of a topic's top-term weight that must speak for one subject
SHARE = 0.2  #: share of a document's sentences
WEIGHT = 0.5  #: of the topical words of a sentence that must belong to the subject
ETA, PRIOR = 0.02, 0.1
DRAW = 20  #: counts a column is given besides its own, parted like all words among the topics
TEST_TRIPLES = 4_000_000  #: word triples of test items that a task holds at once
PILE = 16_384  #: words of documents inferred together, about


@dataclass
class Model:
    """Topics of one language: lam (topic x column) are the variational word counts, owner the subject of each topic or
    -1, used the columns that count."""

    lam: np.ndarray
    owner: np.ndarray
    used: np.ndarray

    def weights(self) -> np.ndarray:
        """(column x topic)"""
        return np.ascontiguousarray(np.exp(_digamma(self.lam) - _digamma(self.lam.sum(1, keepdims=True))).astype(np.float32).T)


def _digamma(x: np.ndarray) -> np.ndarray:
    """Six steps of the recurrence, then the asymptotic series."""
    x = np.asarray(x)
    y = 1 / (x + 6)
    inv = y * y
    z = x * (x + 5)  # the steps two by two, from both ends: 1 / x + 1 / (x + 5) and so on
    shift = 1 / z + 1 / (z + 4) + 1 / (z + 6)
    return -np.log(y) - 0.5 * y - inv * (1 / 12 - inv * (1 / 120 - inv / 252)) - (2 * x + 5) * shift


def _piles(per: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of per[i] entries each, laid end to end, in piles of rows about as long: (rows, the places of their entries,
    which of these are real). Shorter rows are filled up; rows without entries are left out."""
    begin = np.cumsum(per) - per
    order = np.argsort(per, kind="stable")
    hi, least = len(per), int(np.count_nonzero(per == 0))
    while hi > least:
        width = per[order[hi - 1]]
        lo = max(hi - max(PILE // width, 1), least)
        rows = order[lo:hi]
        step = np.arange(width)
        real = step < per[rows, None]
        yield rows, np.where(real, begin[rows, None] + step, begin[rows, None]), real
        hi = lo


def _stacks(lang: np.ndarray, text: np.ndarray, col: np.ndarray, n: np.ndarray, languages: int) -> Iterator[tuple[int, np.ndarray, list[tuple]]]:
    """(language, its entries, and of these in piles of documents: documents, places among the entries, which are real,
    columns, counts) of a batch; entries whose column is -1 are left out."""
    of = lang[text] if languages > 1 else np.zeros(len(text), np.int64)
    for k in range(languages):
        some = np.flatnonzero((of == k) & (col >= 0))
        c, count = col[some], n[some].astype(np.float32)
        piles = _piles(np.bincount(text[some], minlength=len(lang)))
        yield k, some, [(docs, at, real, c[at], count[at] * real) for docs, at, real in piles]


def _ratio(rare: np.ndarray, count: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """Counts over their expectation. rare: the weights of each document's columns, above 0, as is theta."""
    return count / np.matmul(rare, theta[:, :, None])[:, :, 0]


def infer(rare: np.ndarray, count: np.ndarray, inner: int = INNER) -> np.ndarray:
    """Variational topic weights of each document of a pile."""
    topics = rare.shape[2]
    gamma = np.ones((len(count), topics), np.float32) + count.sum(1, keepdims=True) / np.float32(topics)
    for _ in range(inner):
        theta = _mean(gamma)
        gamma = PRIOR + theta * np.matmul(_ratio(rare, count, theta)[:, None], rare)[:, 0]
    return _mean(gamma)


def _column_sums(col: np.ndarray, row: np.ndarray, value: np.ndarray, theta: np.ndarray, out: np.ndarray) -> None:
    """Adds to each column's sums (column x topic) its values times the weights of the documents they stand in."""
    order = np.argsort(col.astype(np.min_scalar_type(len(out))), kind="stable")  # small integers are sorted by their digits
    row, value = row[order], value[order]
    for cols, at, real in _piles(np.bincount(col, minlength=len(out))):
        out[cols] += np.matmul((value[at] * real)[:, None], theta.take(row[at], 0))[:, 0]


def _mean(gamma: np.ndarray) -> np.ndarray:
    """The exponential of the digamma function, without its logarithm: topic weights up to a factor for each document,
    which leaves what is made of them as it is."""
    y = 1 / (gamma + 6)
    inv = y * y
    z = gamma * (gamma + 5)
    less = 1 / z
    less += 1 / (z + 4)
    less += 1 / (z + 6)
    less *= 2 * gamma + 5
    less += 0.5 * y + inv * (1 / 12 - inv * (1 / 120 - inv / 252))
    return np.exp(-less) / y


def _packs(values: np.ndarray, row: np.ndarray, rows: int, kind: type = np.int32) -> pa.Array:
    """A column of packed integers (their bytes, which cost the JVM nothing) from values and the row of each; rows only grow."""
    ends = np.r_[0, np.cumsum(np.bincount(row, minlength=rows))].astype(np.int32) * np.int32(np.dtype(kind).itemsize)
    return pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(np.ascontiguousarray(ends)), pa.py_buffer(np.ascontiguousarray(values, kind))])


def _flat(column: pa.Array, kind: type = np.int32) -> tuple[np.ndarray, np.ndarray]:
    """(row of each element, elements) of a column of packed integers or of lists."""
    if pa.types.is_binary(column.type):
        _, ends, data = column.buffers()
        ends = np.frombuffer(ends, np.int32)[column.offset : column.offset + len(column) + 1] // np.dtype(kind).itemsize
        values = np.frombuffer(data, kind)[ends[0] : ends[-1]] if data is not None and len(column) else np.array([], kind)
        return np.repeat(np.arange(len(column)), np.diff(ends)), values
    size = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(size)), size), column.flatten().to_numpy(zero_copy_only=False)


def _places(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(row, place among its distinct words) of each word of a batch of `cleaned`; `high` holds the upper halves of the
    places in texts with more than 65,536 distinct words."""
    row, low = _flat(b.column("at"), np.uint16)
    at = low.astype(np.int64)
    of, high = _flat(b.column("high"), np.uint16)
    if len(of):
        at[np.isin(row, np.unique(of))] += high.astype(np.int64) << 16
    return row, at


def _ends(sentence: np.ndarray, text: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """(places after the last word of each sentence, counted within its text; the text) for words in order."""
    end = np.flatnonzero(np.r_[sentence[1:] != sentence[:-1], True]) + 1 if len(sentence) else np.array([], int)
    begin = np.r_[0, np.cumsum(np.bincount(text, minlength=texts))]
    return end - begin[text[end - 1]], text[end - 1]


def tagged(docs: DataFrame) -> DataFrame:
    """(doc_id, tag, text): the tag is the leading letters of lang in lower case, '' if there are none."""
    tag = F.lower(F.regexp_extract("lang", r"^\s*(\p{L}+)", 1)) if "lang" in docs.columns else F.lit("")
    return docs.where("doc_id is not null and text is not null").select("doc_id", F.coalesce(tag, F.lit("")).alias("tag"), "text")


_CLEAN = "doc_id long, tag string, word binary, n binary, at binary, high binary, cut binary"


def cleaned(docs: DataFrame, tests: Triples | None) -> DataFrame:
    """(doc_id, tag, word, n, at, cut): the distinct hashed words of each document with their counts, for each of its words
    in order the place among them, and where its sentences end; sentences half of whose triples are in `tests` are left out."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            texts = b.column(2).to_pylist()
            for lo, hi in batches(texts):
                t = tokens(texts[lo:hi])
                if tests is not None:
                    t = t.where(~_taken(t.sentence, tests.hits(t))[t.sentence])
                some = b.slice(lo, hi - lo)
                yield _packed(some.column(0), some.column(1), t)

    return docs.mapInArrow(run, _CLEAN)


def _packed(doc_id: pa.Array, tag: pa.Array, t: Tokens) -> pa.RecordBatch:
    docs = len(doc_id)
    pair, at, n = np.unique(t.text.astype(np.uint64) << np.uint64(32) | t.word, return_inverse=True, return_counts=True)
    row = (pair >> np.uint64(32)).astype(np.int64)
    begin = np.r_[0, np.cumsum(np.bincount(row, minlength=docs))]
    place = at - begin[t.text]
    wide = (np.bincount(row, minlength=docs) > 0x10000)[t.text]
    cut, of = _ends(t.sentence, t.text, docs)
    lists = [_packs((pair & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32), row, docs), _packs(n, row, docs), _packs(place & 0xFFFF, t.text, docs, np.uint16), _packs(place[wide] >> 16, t.text[wide], docs, np.uint16), _packs(cut, of, docs)]
    return pa.RecordBatch.from_arrays([doc_id, tag, *lists], names=["doc_id", "tag", "word", "n", "at", "high", "cut"])


def _taken(sentence: np.ndarray, hits: np.ndarray) -> np.ndarray:
    """Whether at least half of each sentence's triples were hit."""
    size = np.bincount(sentence, minlength=len(hits))
    return (size > 2) & (2 * hits >= size - 2)


def _again(b: pa.RecordBatch) -> Tokens:
    """The words of a batch of `cleaned`, sentences numbered again."""
    row, word = _flat(b.column("word"))
    text, at = _places(b)
    of, cut = _flat(b.column("cut"))
    held, begin = (np.r_[0, np.cumsum(np.bincount(x, minlength=b.num_rows))] for x in (row, text))
    sentence = np.repeat(np.arange(len(cut)), np.diff(np.r_[0, cut + begin[of]]))
    return Tokens(word.astype(np.int32).view(np.uint32)[at + held[text]], text, sentence)


def test_triples(items: DataFrame | None, scratch: Scratch) -> DataFrame | None:
    """(code): the distinct word triples of the test items."""
    if items is None:
        return None

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            texts = b.column(0).to_pylist()
            for lo, hi in batches(texts):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(triples(tokens(texts[lo:hi]))[0]).view(np.int64))], names=["code"])

    return scratch.cut(items.where("text is not null").select("text").mapInArrow(run, "code long").distinct())


def without_tests(docs: DataFrame, codes: DataFrame | None, scratch: Scratch, most: int = TEST_TRIPLES) -> DataFrame:
    """`cleaned` without the sentences of test items. Up to `most` triples are held by a task at once; more are taken in
    blocks, one pass over the hashed words for each, hits of a sentence added up over the blocks."""
    n = codes.count() if codes is not None else 0
    load = lambda part: Triples.of(np.array([r[0] for r in part.toLocalIterator()], np.int64).view(np.uint64))
    if n <= most:
        return scratch.cut(cleaned(docs, load(codes) if n else None))
    blocks = -(-n // most)
    now = scratch.cut(cleaned(docs, None).withColumn("hit", F.lit(None).cast("binary")))
    for k in range(blocks):
        some = load(codes.where(F.pmod("code", F.lit(blocks)) == k))

        def add(parts: Iterator[pa.RecordBatch], some=some) -> Iterator[pa.RecordBatch]:
            for b in parts:
                of, _ = _flat(b.column("cut"))
                hit = np.zeros(len(of), np.int64)
                if not b.column("hit").null_count:
                    hit += _flat(b.column("hit"))[1]
                found = some.hits(_again(b))
                hit[: len(found)] += found
                yield b.set_column(b.schema.get_field_index("hit"), "hit", _packs(hit, of, b.num_rows))

        now, old = scratch.cut(now.mapInArrow(add, _CLEAN + ", hit binary")), now
        scratch.drop(old)

    def drop(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            t = _again(b)
            t = t.where(~_taken(t.sentence, _flat(b.column("hit"))[1])[t.sentence])
            yield _packed(b.column("doc_id"), b.column("tag"), t)

    return scratch.cut(now.mapInArrow(drop, _CLEAN))


def count_words(clean: DataFrame) -> DataFrame:
    """(tag, word, n): documents with a tag that hold a word, counted within each task first; word 0 counts them all."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            tag = pc.dictionary_encode(b.column("tag"))
            code = tag.indices.to_numpy(zero_copy_only=False).astype(np.uint64)
            text, word = _flat(b.column("word"))
            word = word.astype(np.int32).view(np.uint32)
            real = (word & 1) == 1
            pairs = (code[text[real]] << np.uint64(32)) | word[real]
            pair, n = np.unique(np.r_[pairs, code << np.uint64(32)], return_counts=True)
            names = tag.dictionary.take(pa.array((pair >> np.uint64(32)).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([names, pa.array((pair & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)), pa.array(n.astype(np.int64))], names=["tag", "word", "n"])

    return clean.select("tag", "word").mapInArrow(run, "tag string, word int, n long").groupBy("tag", "word").agg(F.sum("n").alias("n"))


@dataclass
class Languages:
    """The languages of a corpus: words by which they are told, sorted hashes, and for each word and language how much
    it speaks for the language. own: for each the sorted hashes of words with a column, and their columns, common ones first."""

    words: np.ndarray
    speaks: np.ndarray
    prior: np.ndarray
    own: list[tuple[np.ndarray, np.ndarray]]

    def widths(self) -> list[int]:
        return [len(own) + BUCKETS for own, _ in self.own]


class Vocabulary:
    """The words of all languages, looked up at once. The last place is for words that are not there. used: for each
    language the columns that count, all if it is not given."""

    def __init__(self, langs: Languages, used: list[np.ndarray] | None = None):
        self.used = None if used is None else np.concatenate(used)
        self.begin = np.cumsum(langs.widths()) - langs.widths()
        self.prior, self.own = langs.prior, np.array([len(own) for own, _ in langs.own])
        words = np.unique(np.concatenate([langs.words, *(own for own, _ in langs.own)]).astype(np.uint32))
        self.last = len(words)
        self.words = np.r_[words, np.uint32(0xFFFFFFFF)]
        bits = len(words).bit_length() + 3
        self.shift = np.uint32(32 - bits)
        size = np.bincount(words >> self.shift, minlength=1 << bits)
        self.first, self.most = np.cumsum(size) - size, int(size.max())
        self.speaks = np.zeros((len(self.prior), len(words) + 1))
        self.speaks[:, np.searchsorted(words, langs.words)] = langs.speaks.T
        self.column = np.full((len(langs.own), len(words) + 1), -1)
        for k, (own, place) in enumerate(langs.own):
            self.column[k, np.searchsorted(words, own)] = place

    def places(self, word: np.ndarray) -> np.ndarray:
        """Words with the same leading bits stand side by side, `most` at most."""
        at = self.first[word >> self.shift]
        for _ in range(self.most):
            at += self.words[at] < word
        at[self.words[at] != word] = self.last
        return at

    def columns(self, text: np.ndarray, word: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
        """(the language of each text, told from its distinct words, the column of each of these in it; -1 for numbers and
        columns that don't count)."""
        at, lang = self.places(word), np.zeros(texts, np.int64)
        if len(self.prior) > 1:
            lang = np.argmax([p + np.bincount(text, weights=s[at], minlength=texts) for p, s in zip(self.prior, self.speaks)], 0)
        of = lang[text]
        out = self.column[of, at]
        rare = np.flatnonzero(out < 0)
        out[rare] = self.own[of[rare]] + ((word[rare] * np.uint32(0x9E3779B1)) >> np.uint32(15)).astype(np.int64) % BUCKETS
        if self.used is not None:
            out[~self.used[self.begin[of] + out]] = -1
        out[(word & 1) == 0] = -1
        return lang, out


def _hashes(rows: list) -> np.ndarray:
    return np.array([r["word"] for r in rows], np.int32).view(np.uint32)


def languages(counted: DataFrame) -> Languages:
    """From the words counted per tag. What reaches the driver: tags that a thousandth of the documents bear; for each the
    words that a hundredth of its documents hold, at most a hundred times the mean number of a document's words; for each
    language the words with a column, at most five hundred times that number."""
    spark = counted.sparkSession
    total = [(r["tag"], r["n"]) for r in counted.where("word = 0").orderBy(F.desc("n"), "tag").limit(int(1 / TAG_SHARE) + 1).collect()]
    every = sum(n for _, n in total)
    total = [(t, n) for t, n in total if n >= max(TAG_DOCS, TAG_SHARE * every)] or total[:1]
    if not total:
        return Languages(np.array([], np.uint32), np.zeros((0, 1)), np.zeros(1), [(np.array([], np.uint32), np.array([], np.int64))])
    least = spark.createDataFrame([(t, i, float(max(LEAST_DOCS, COMMON * n))) for i, (t, n) in enumerate(total)], "tag string, i int, least double")
    rows = counted.where("word <> 0").join(F.broadcast(least), "tag").where("n >= least").select("i", "word", "n").collect()
    words = np.unique(_hashes(rows))
    n = np.zeros((len(words), len(total)))
    n[np.searchsorted(words, _hashes(rows)), [r["i"] for r in rows]] = [r["n"] for r in rows]
    # tags with like words are one language; the larger tag leads
    root = np.sqrt(n / np.maximum(n.sum(0), 1))
    lead: list[int] = []
    of = []
    for i in range(len(total)):
        to = next((k for k, j in enumerate(lead) if root[:, i] @ root[:, j] >= ALIKE), None)
        if to is None:
            to = len(lead)
            lead.append(i)
        else:
            n[:, lead[to]] += n[:, i]
        of.append(to)
    docs = np.bincount(of, weights=[x for _, x in total])
    n = n[:, lead]
    share = (n + 0.5 * n.sum(1, keepdims=True) / max(n.sum(), 1)) / np.maximum(n.sum(0) + 0.5, 1)
    member = spark.createDataFrame([(t, k, float(max(LEAST_DOCS, OWN_COLUMN * docs[k]))) for (t, _), k in zip(total, of)], "tag string, k int, least double")
    held = counted.where("word <> 0").join(F.broadcast(member), "tag").groupBy("k", "word").agg(F.sum("n").alias("n"), F.first("least").alias("least"))
    by: list[list] = [[] for _ in lead]
    for r in held.where("n >= least").collect():
        by[r["k"]].append(r)
    own = []
    for k, some in enumerate(by):
        some.sort(key=lambda r: r["word"] & 0xFFFFFFFF)
        wide = np.array([r["n"] >= COMMON * docs[k] for r in some], bool)
        place = np.where(wide, np.cumsum(wide) - 1, wide.sum() + np.cumsum(~wide) - 1)
        own.append((_hashes(some), place))
    return Languages(words, np.log(share + 1e-12), np.log(docs / docs.sum()), own)


def _columns(b: pa.RecordBatch, known: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language of each document, document and column of each of its distinct words) of a batch of `cleaned`."""
    text, word = _flat(b.column("word"))
    lang, col = known.columns(text, word.astype(np.int32).view(np.uint32), b.num_rows)
    return lang, text, col


def bags(clean: DataFrame, langs: Languages, models: list[Model]) -> DataFrame:
    """(lang, col, n): those columns of each document's words that count, and the words' counts; numbers are left out."""
    used = [m.used for m in models]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Vocabulary(langs, used)
        for b in parts:
            lang, text, col = _columns(b, known)
            n = _flat(b.column("n"))[1]
            real = col >= 0
            yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), _packs(col[real], text[real], b.num_rows), _packs(n[real], text[real], b.num_rows)], names=["lang", "col", "n"])

    return clean.select("word", "n").mapInArrow(run, "lang int, col binary, n binary")


_ROWS = "lang int, topic int, row binary"


def _rows(sums: list[np.ndarray]) -> pa.RecordBatch:
    """Rows of some matrices, one per language, that hold anything: (lang, topic, row)."""
    held = [(k, i, m[i].astype(np.float32).tobytes()) for k, m in enumerate(sums) for i in np.flatnonzero(m.any(1))]
    return pa.RecordBatch.from_arrays([pa.array([x[j] for x in held], kind) for j, kind in enumerate((pa.int32(), pa.int32(), pa.binary()))], names=["lang", "topic", "row"])


def _summed(parts: DataFrame, shapes: list[tuple[int, int]]) -> list[np.ndarray]:
    """Rows of (lang, topic, row) added up per language and topic: one task per row of a matrix, which holds its sum only."""

    def add(key: tuple, some: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: np.ndarray | float = 0.0
        for b in some:
            for row in b.column("row"):
                total = total + np.frombuffer(row.as_buffer(), np.float32).astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()), pa.array([total.astype(np.float32).tobytes()], pa.binary())], names=["lang", "topic", "row"])

    out = [np.zeros(s) for s in shapes]
    for r in parts.groupBy("lang", "topic").applyInArrow(add, _ROWS).collect():
        out[r["lang"]][r["topic"]] = np.frombuffer(r["row"], np.float32)
    return out


def examples(clean: DataFrame, known: DataFrame, langs: Languages, subjects: int) -> list[np.ndarray]:
    """Per language, (subject, and last all documents) x (1 + columns): documents, and those of them that hold each column."""
    widths = langs.widths()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, words = [np.zeros((subjects + 1, w + 1)) for w in widths], Vocabulary(langs)
        for b in parts:
            lang, text, col = _columns(b, words)
            real = np.flatnonzero(col >= 0)
            text, col = text[real], col[real]
            who, own = _flat(b.column("own"))
            shown = np.zeros(len(lang), bool)
            shown[who] = True
            shown = np.flatnonzero(shown[text])
            text_shown, col_shown, of = text[shown], col[shown], lang[text]
            for k, t in enumerate(total):
                mine = lang == k
                t[subjects, 0] += mine.sum()
                t[subjects, 1:] += np.bincount(col[of == k], minlength=t.shape[1] - 1)
                for i in np.unique(own[mine[who]]):
                    some = np.zeros(len(lang), bool)
                    some[who[own == i]] = True
                    some &= mine
                    t[i, 0] += some.sum()
                    t[i, 1:] += np.bincount(col_shown[some[text_shown]], minlength=t.shape[1] - 1)
        yield _rows(total)

    joined = clean.select("doc_id", "word").join(known, "doc_id", "left").select("word", F.coalesce("own", F.array().cast("array<int>")).alias("own"))
    return _summed(joined.mapInArrow(run, _ROWS), [(subjects + 1, w + 1) for w in widths])


def fit(bagged: DataFrame, models: list[Model], rounds: int = ROUNDS, still: float = STILL) -> list[Model]:
    """Rounds of variational Bayes over all documents until less than `still` of the topics' weight moves. What a round
    sends to the driver is topics times columns."""
    sc = bagged.sparkSession.sparkContext
    for _ in range(rounds):
        shared = sc.broadcast([m.weights() for m in models])

        def run(parts: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            weights = shared.value
            total = [np.zeros(w.shape) for w in weights]
            for b in parts:
                text, col = _flat(b.column("col"))
                n = _flat(b.column("n"))[1]
                theta = np.zeros((b.num_rows, weights[0].shape[1]), np.float32)
                for k, some, piles in _stacks(b.column("lang").to_numpy(zero_copy_only=False), text, col, n, len(weights)):
                    value = np.zeros(len(some), np.float32)
                    for docs, at, real, c, count in piles:
                        rare = weights[k].take(c, 0)
                        theta[docs] = own = infer(rare, count)
                        value[at[real]] = _ratio(rare, count, own)[real]
                    _column_sums(col[some], text[some], value, theta, total[k])
            yield _rows([(t * w).T for t, w in zip(total, weights)])

        sums = _summed(bagged.mapInArrow(run, _ROWS), [m.lam.shape for m in models])
        shared.unpersist()
        moved, weight = 0.0, 0.0
        for m, s in zip(models, sums):
            # a column is drawn towards the topics' shares of the corpus, so that few counts say little
            new = s + ETA + DRAW * (s.sum(1, keepdims=True) / max(s.sum(), 1)) * m.used
            moved += (np.abs(new / new.sum(1, keepdims=True) - m.lam / m.lam.sum(1, keepdims=True)).sum(1) / 2 * s.sum(1)).sum()
            weight += s.sum()
            m.lam = new
        if moved <= still * weight:
            break
    return models


def judged(model: Model, speak: np.ndarray, subjects: int) -> np.ndarray:
    """The subject of each topic: the one for which its top terms speak; -1 if none has SURE of their weight.

    A term's rank in a topic is its lift: how much more often it stands in the topic than in all of them."""
    phi = model.lam / model.lam.sum(1, keepdims=True)
    lift = phi * np.log(phi / (model.lam.sum(0) / model.lam.sum()) + 1e-12)
    owner = np.full(len(phi), -1)
    for k in range(len(phi)):
        top = np.argsort(-lift[k])[:TOP]
        score = (lift[k, top].clip(0)[:, None] * speak[top]).sum(0)
        weight = lift[k, top].clip(0).sum()
        best = int(score.argmax()) if subjects else -1
        if weight > 0 and score[best] >= SURE * weight:
            owner[k] = best
    return owner


def start(seen: np.ndarray, seed: int = 3) -> tuple[Model, np.ndarray]:
    """First topics of a language from its word counts and labelled examples, and how much each column speaks for each
    subject: it speaks for the subjects in whose examples it is over-represented; columns that few examples hold are
    drawn towards their share of all documents and speak for nobody."""
    base, per = seen[:-1, 0], seen[:-1, 1:].T
    docs, df = seen[-1, 0], seen[-1, 1:]
    subjects = len(base)
    expected = (df / max(docs, 1))[:, None]
    draw = max(base.mean(), 1)
    rate = (per + draw * expected + 1e-9) / (base + draw)
    speak = rate**2 / (rate**2).sum(1, keepdims=True) * (per.sum(1, keepdims=True) > 0)
    rng = np.random.default_rng(seed)
    lam = rng.gamma(100, 0.01, (subjects + FREE, len(df))) * df / max(df.sum(), 1) * len(df)
    for i in np.flatnonzero(base):
        lam[i] *= 0.05 + 4 * speak[:, i] ** 2
    used = (df > 0) & ((df <= FLAT * docs) | (speak.max(1) >= 0.5))
    return Model(lam + ETA, np.full(subjects + FREE, -1), used), speak


def assign(clean: DataFrame, langs: Languages, models: list[Model], subjects: int) -> DataFrame:
    """(doc_id, subject number, share): the share of a document's sentences that treat of each subject, if any does."""
    shared = clean.sparkSession.sparkContext.broadcast([(m.used, m.weights(), m.owner) for m in models])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used, weights, owners = zip(*shared.value)
        known, of = Vocabulary(langs, used), []
        for owner in owners:
            of.append(np.zeros((len(owner), subjects), np.float32))
            of[-1][np.flatnonzero(owner >= 0), owner[owner >= 0]] = 1
        for b in parts:
            lang, text, col = _columns(b, known)
            n = _flat(b.column("n"))[1]
            mass = np.zeros((subjects, len(col)), np.float32)  # what the topics of a document say of each of its words
            counts = np.zeros(len(col), bool)
            for k, some, piles in _stacks(lang, text, col, n, len(weights)):
                counts[some] = True
                for _, at, real, c, count in piles:
                    rare = weights[k].take(c, 0)
                    theta = infer(rare, count)
                    said = np.matmul(rare, theta[:, :, None] * of[k]) / np.matmul(rare, theta[:, :, None])
                    mass[:, some[at[real]]] = said[real].T
            own, at = _places(b)
            who, cut = _flat(b.column("cut"))
            held_by, begin = (np.r_[0, np.cumsum(np.bincount(x, minlength=b.num_rows))] for x in (text, own))
            word = at + held_by[own]
            share = np.zeros((b.num_rows, subjects))
            # each sentence begins where the one before ends, also across documents; words that don't count are passed over
            kept = counts[word]
            word, end = word[kept], np.r_[0, np.cumsum(kept)][cut + begin[who]]
            size = np.diff(end, prepend=0)
            full = np.flatnonzero(size)
            for i in range(subjects if len(full) else 0):
                part = np.add.reduceat(mass[i][word], (end - size)[full])
                hit = (part >= WEIGHT * size[full] - 1e-6) & (part >= WEIGHT - 1e-6)
                share[:, i] = np.bincount(who[full[hit]], minlength=b.num_rows)
            share /= np.maximum(np.bincount(who, minlength=b.num_rows), 1)[:, None]
            r, c = np.nonzero(share)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(r)), pa.array(c.astype(np.int32)), pa.array(share[r, c])], names=["doc_id", "subject", "share"])

    return clean.drop("tag").mapInArrow(run, "doc_id long, subject int, share double")


def subject_shares(docs: DataFrame, labels: DataFrame, areas: list[str], scratch: Scratch, items: DataFrame | None = None, most: int = TEST_TRIPLES) -> DataFrame:
    """doc_id, subject, share (of the document's sentences, above 0).

    docs: doc_id long, text, and lang if the texts are tagged with their language (null, variant and wrong tags do no
    harm); labels: doc_id, subject as spelled by hand (trimmed and case-folded, unknown ones ignored); areas: the subject
    names; items: test items whose sentences are left aside. Null, blank and wordless texts have no subject; rows with a
    null doc_id are left out; a text of any length is read whole. Rows that repeat a doc_id are documents in their own
    right. Other columns are not read. Without labels no topic has a subject, hence no rows."""
    if not areas:
        return docs.sparkSession.createDataFrame([], "doc_id long, subject string, share double")
    number = {a.casefold(): i for i, a in enumerate(areas)}
    known = labels.where("doc_id is not null").select("doc_id", F.lower(F.trim("subject")).alias("s")).where(F.col("s").isin(*number))
    known = known.groupBy("doc_id").agg(F.collect_set(F.element_at(F.create_map(*[F.lit(x) for kv in number.items() for x in kv]), F.col("s"))).alias("own"))
    clean = without_tests(tagged(docs), test_triples(items, scratch), scratch, most)
    langs = languages(scratch.cut(count_words(clean)))
    begun = [start(s) for s in examples(clean, known, langs, len(areas))]
    models = [m for m, _ in begun]
    fit(scratch.cut(bags(clean, langs, models)), models)
    for m, (_, speak) in zip(models, begun):
        m.owner = judged(m, speak, len(areas))
    names = F.element_at(F.array(*[F.lit(a) for a in areas]), F.col("subject") + 1)
    return assign(clean, langs, models, len(areas)).select("doc_id", names.alias("subject"), "share")
