"""Every registered query against its DuckDB counterpart over the smallest tables."""

import math
import os

import duckdb
import pytest

from corpusloom.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(x):
    return ("f", round(float(x), 5) + 0.0) if isinstance(x, float) and math.isfinite(x) else x


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    spark.catalog.clearCache()
    if name not in registry.ORACLES:
        assert got
        return
    found = duck.execute(registry.ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == cols
    assert sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in found.fetchall()), key=repr) == got


def test_observation_summary_cut_before_a_line_end(spark, tmp_path):
    """A cut result that ends in a line end, and texts with line ends around them, as the SQL has them."""
    texts = ["a" * 254 + "\n" + "b" * 20, "a" * 253 + " \n" + "b" * 20, "a" * 250 + "     " + "b" * 20, "\n two \r\n", " \t", "m" * 156 + "\n" + "b" * 20]
    rows = [(c, turn, "tool", t) for c, t in enumerate(texts) for turn in range(4)]
    path = str(tmp_path)
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}/conversations.parquet/*.parquet'")
    want = sorted(con.execute(registry.ORACLES["observation_summary"]).fetchall())
    assert sorted(map(tuple, registry.QUERIES["observation_summary"](spark, path).collect())) == want


def equal_to_sql(spark, path, name, **tables):
    """A query over tables of (rows, schema) gives its SQL's rows."""
    con = duckdb.connect()
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet/*.parquet'")
    df = registry.QUERIES[name](spark, str(path))
    cols = sorted(df.columns)
    found = con.execute(registry.ORACLES[name])
    names = [c[0] for c in found.description]
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in found.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr) == want
    return want


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("name", ["fulltext_match", "fulltext_topk"])
def test_full_text_takes_or_as_a_word_and_finds_all(spark, tmp_path, name):
    """A word ``or`` between two others, and more than a thousand chunks with all words."""
    docs = [(i, "red pie" if i % 7 == 0 else f"more red {i} or pie", "en", "src1", 300) for i in range(1500)]
    found = equal_to_sql(spark, tmp_path, name, documents=(docs, DOCUMENTS), benchmark=([(1, "red or.\nPie more")], "item_id long, text string"))
    assert len(found) > 1000 or name != "fulltext_match"


@pytest.mark.parametrize("n", [0, 40])
def test_ingest_stream_over_a_folder_of_files(spark, tmp_path, n):
    docs = [(i, "\n".join(f"line {k} of {i} with some words" for k in range(i)), "en", "src1", 300) for i in range(n)]
    assert len(equal_to_sql(spark, tmp_path, "ingest_stream", documents=(docs, DOCUMENTS))) >= n
