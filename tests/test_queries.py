"""Every query against its SQL on the small tables."""

import math
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def canon(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19]
    return v if v is None or isinstance(v, (Decimal, int, str, bool)) else str(v)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    df = entry.queries()[name](spark, str(DATA))
    columns = sorted(df.columns)
    got = sorted((tuple(canon(r[c]) for c in columns) for r in df.collect()), key=str)
    result = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    want = sorted((tuple(canon(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=str)
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", [n for n in sorted(entry.queries()) if n not in entry.oracle_sql() and not n.startswith("op") and n != "pipeline"])
def test_queries_without_sql_run(spark, name):
    assert entry.queries()[name](spark, str(DATA)).count() > 0


def test_similarities_of_any_script(spark, tmp_path):
    texts = ["naïve café", "naive cafe", "Größe über alles", "Grosse uber alles", "¿Qué pasó?", "", None, "日本語 😀", "日本 😀x"]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    want = {}
    for k, (a, b) in enumerate(zip(texts, texts[1:])):
        a, b = a or "", b or ""
        want[k] = round(1 - distance(a, b) / max(len(a), len(b)), 6) if a or b else 1.0
    got = {r["a"]: r["similarity"] for r in entry.queries()["similarity_pairs"](spark, str(tmp_path)).collect()}
    assert got == want
    assert entry.queries()["similarity_pairs"](spark, str(DATA)).count() == spark.read.parquet(f"{DATA}/benchmark.parquet").count() - 1
