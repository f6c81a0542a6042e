"""The registered queries on the given tables: against DuckDB, and held-out accuracy."""

import zlib

import duckdb
import pytest

from mediatally.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf, name):
    got = QUERIES[name](spark, sf)
    con = duckdb.connect()
    for table in ("documents", "benchmark", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    rel = con.execute(ORACLES[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(got.columns)
    tidy = lambda rows: sorted(str([round(x, 6) if isinstance(x, float) else x for x in r]) for r in rows)
    assert tidy(got.select(*names).collect()) == tidy(rel.fetchall())


def test_language_and_toxicity_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rest = lambda i, n: zlib.crc32(str(i).encode()) % n
    langs = QUERIES["op2_language_id"](spark, sf).collect()
    assert sorted(r.doc_id for r in langs) == sorted(docs) and all(r.held_out == (rest(r.doc_id, 3) == 1) for r in langs)
    held = [r for r in langs if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.98 * len(held)
    scored = QUERIES["op9_toxicity"](spark, sf).collect()
    assert sorted(r.doc_id for r in scored) == sorted(docs) and all(r.held_out == (rest(r.doc_id, 5) == 0) for r in scored)
    held = [r for r in scored if r.held_out and r.doc_id in toxic]
    assert sum(r.predicted == toxic[r.doc_id] for r in held) >= 0.9 * len(held)
