import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "2").config("spark.sql.codegen.wholeStage", "false").config("spark.driver.memory", "6g").config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture()
def scratch(spark):
    from thesaurion.runtime import Scratch

    return Scratch(spark, "test")


@pytest.fixture(scope="session")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in Path(DATA).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def agrees(spark, duck, queries, oracles, name):
    df = queries[name](spark, DATA)
    cols = sorted(df.columns)
    rel = duck.sql(oracles[name])
    assert sorted(rel.columns) == cols
    got = sorted(repr(tuple(r)) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    want = sorted(repr(r) for r in rel.project(", ".join(f'"{c}"' for c in cols)).fetchall())
    assert got == want
