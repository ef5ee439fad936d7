"""Every registered query of the library against its SQL in DuckDB, on the smallest data."""

import hashlib
import math
import os

import duckdb
import pytest

from lorestack.plans import registry

DATA = os.environ.get("LORESTACK_TESTDATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    return v.isoformat() if hasattr(v, "isoformat") else repr(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rows = sorted(tuple(_cell(r[c]) for c in columns) for r in df.collect())
    if name not in registry.ORACLE_SQL:
        assert rows
        return
    found = duck.sql(registry.ORACLE_SQL[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    assert rows == sorted(tuple(_cell(r[i]) for i in at) for r in found.fetchall())


def test_every_oracle_has_its_query():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)


def test_flagship(spark):
    assert registry.flagship(spark, DATA).count() > 0


def test_streamed_texts_are_whole(spark, duck):
    got = registry.QUERIES["st5_stream_whole_texts"](spark, DATA)
    texts = duck.sql("SELECT conv_id * 1000 + turn, text FROM conversations").fetchall()
    assert max(len(t.split(" ")) for _, t in texts) > 40
    want = {}
    for i, text in texts:
        kept = [w + " " for n, w in enumerate(text.split(" ")) if n % 11 != 5 and n % 13 != 7]
        want[i] = hashlib.md5("".join(kept).encode()).hexdigest()
    assert {r.message_id: r.text_md5 for r in got.collect()} == want and got.filter("done").count() == len(texts)


def test_vectors_have_unit_length_where_signs_cancel(spark, tmp_path):
    docs = [(1, "cr"), (2, "acq cr word"), (3, "acq"), (4, ""), (5, None)]  # "cr" and "acq" cancel the prefix of a passage
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, registry.QUERIES["r01_embed"](spark, str(tmp_path)).collect()))
    assert got == [(i, 64, 1.0) for i in range(1, 6)]
