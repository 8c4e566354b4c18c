"""The registered queries and the pipeline on the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from salesledger.llm import mixing
from salesledger.llm.common import read
from salesledger.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


def canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(r[i]) for i in order) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql_twin(spark, name):
    db = duckdb.connect()
    for table in ("documents", "pages", "embeddings", "conversations"):
        db.execute(f"create view {table} as select * from read_parquet('{SF}/{table}.parquet')")
    found = QUERIES[name](spark, SF)
    twin = db.execute(ORACLE[name])
    assert canon(found.columns, [tuple(r) for r in found.collect()]) == canon([c[0] for c in twin.description], twin.fetchall())


def test_pipeline_stages(spark):
    docs = read(spark, SF, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "source_mix", "best_fit_packing"]
    toxic = corpus_pipeline.drop_toxic(spark, docs, SF)
    assert toxic.columns == docs.columns and toxic.count() <= docs.count()
    once = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert once.columns == docs.columns and once.select("doc_id").distinct().count() == once.count()
    mixed = corpus_pipeline.mix_sources(spark, once, SF)
    assert mixed.columns == docs.columns
    assert max(r["count"] for r in mixed.groupBy("doc_id").count().collect()) <= 2
    packed = corpus_pipeline.run(spark, SF)
    assert packed.groupBy("sequence_id").agg({"length": "sum"}).where("`sum(length)` > 4096").count() == 0 and packed.count() > 0


def test_pipeline_mix_is_off_by_half_a_document_at_most(spark):
    rows = [(0, "a " * 900, "a"), (1, "b " * 700, "b")] + [(2 + k, "c " * (5 + k % 7), "c") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = {r["source"]: (r["n"], r["most"]) for r in mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("n"), F.max("size").alias("most")).collect()}
    got = Counter()
    for r in corpus_pipeline.mix_sources(spark, docs, "").collect():
        got[r["source"]] += len(r["text"].split())
    assert all(abs(got[k] - n) <= most / 2 for k, (n, most) in want.items())
    assert got["a"] % 900 == 0 and got["b"] % 700 == 0
