"""Each query that SQL can express, beside DuckDB on the same tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from lectern.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(tiny):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{tiny}/{t}.parquet'")
    return c


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple("%.9g" % x if isinstance(x, float) else str(x) for x in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_same_as_sql(spark, con, tiny, name):
    ours, theirs = catalogue.QUERIES[name](spark, tiny).toPandas(), con.execute(catalogue.ORACLE_SQL[name]).fetchdf()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_runs(spark, tiny, name):
    assert catalogue.QUERIES[name](spark, tiny).count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "text" in df.columns


def test_stays_whole_without_llm():
    """Nothing outside imports lectern.llm but the entry, which guards it."""
    import re
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    for f in [*(root / "lectern").rglob("*.py"), root / "bench.py", *(root / "tests").glob("*.py")]:
        if "llm" not in f.relative_to(root).parts and f.name != "test_oracle.py":
            assert not re.search(r"^\s*(from|import) .*(lectern\.llm|corpus_pipeline)", f.read_text(), re.M), f
