"""The pipeline, and queries with SQL equivalents, on the smallest tables."""

import duckdb
import pytest
from brute import brute_components

import corpus_pipeline
from emberframe.llm.common import read_table, stash
from emberframe.llm.oracle import ORACLES
from emberframe.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    df = QUERIES[name](spark, sf_dir)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)


def test_stages(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    columns, kept = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(stash(stage(spark, kept[-1], sf_dir), name))
    assert all(d.columns == columns for d in kept[:-1])
    clean, good, single, mixed, packed = kept[1:]
    assert 0.8 * docs.count() <= clean.count() <= docs.count() and good.count() <= clean.count()
    rows = [(r.doc_id, r.text) for r in good.collect()]
    assert {r.doc_id for r in single.collect()} == {k for k, _, root in brute_components(rows) if k == root}
    assert {r.doc_id for r in mixed.collect()} == {r.doc_id for r in single.collect()}
    assert packed.where("piece = 0").count() == mixed.count()
    fill = {r[0]: r[1] for r in packed.groupBy("sequence_id").sum("length").collect()}
    assert max(fill.values()) <= 2048 and len(fill) <= -(-sum(fill.values()) // 2048) + 1


def test_stages_on_odd_rows(spark, sf_dir, make_docs, odd_texts):
    """Nulls, empty and long texts, ties, repeated rows and further columns pass every stage; so does an empty table."""
    docs = make_docs([*odd_texts, *["the same words of a text that is long enough for the rules " * 6] * 3])
    for name, stage in corpus_pipeline.STAGES:
        kept = stash(stage(spark, docs, sf_dir), name)
        if name == "packing":
            assert kept.where("piece = 0").count() == docs.count()
        else:
            assert kept.columns == docs.columns
            assert kept.count() >= docs.count() if name == "mixing" else kept.count() <= docs.count()
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
