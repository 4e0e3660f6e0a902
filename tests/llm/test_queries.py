"""Every query over the small tables, those with SQL against it, and the pipeline's stages on odd tables."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import queries
from tests.llm.helpers import SCHEMA, corpus, empty

DATA = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "labels")
COLUMNS = {
    "op1_quality": {"doc_id", "held_out", "score", "predicted"}, "op2_fingerprint": {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"},
    "op3_near_dedup": {"doc_id", "n_shingles", "component_id", "kept"}, "op4_pii": {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"}, "op5_bpe": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    "op6_token_files": {"doc_id", "start", "n_tokens", "ids_crc32"}, "op7_lm_score": {"doc_id", "n_words", "lm_score"}, "op8_shard": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
    "op9_mix_sources": {"doc_id", "size", "source_size", "target", "taken"}, "op10_topk": {"query_id", "rank", "vec_id", "score"}, "op11_periodic_runs": {"doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"},
    "op12_near_vectors": {"vec_id", "n_links", "component_id", "kept"}, "op13_hard_negatives": {"anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"}, "pipeline": {"doc_id", "n_tokens", "ids"},
}
OF_ALL = {n for n in COLUMNS if n not in ("op10_topk", "op12_near_vectors", "op13_hard_negatives", "pipeline")}


def test_all_are_listed():
    assert set(queries.QUERIES) == set(COLUMNS) and set(queries.ORACLES) <= set(COLUMNS)
    assert all(f.__doc__ for n, f in queries.QUERIES.items())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", COLUMNS)
def test_query(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    got = df.collect()
    assert COLUMNS[name] <= set(df.columns)
    ids = {r["doc_id"] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id").collect()}
    if name in OF_ALL:
        assert len(got) == len(ids) and {r["doc_id"] for r in got} == ids
    elif name == "pipeline":
        assert got and {r["doc_id"] for r in got} <= ids
    if name in queries.ORACLES:
        con = duckdb.connect()
        for t in TABLES:
            con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
        want = con.sql(queries.ORACLES[name])
        assert set(want.columns) == set(df.columns)
        assert sorted(tuple(r[c] for c in want.columns) for r in got) == sorted(want.fetchall())


STAGES = corpus_pipeline.STAGES


def tables(spark, folder, docs):
    """The folder with labels for stages that learn."""
    docs.where("doc_id is not null").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), F.lit(0).alias("toxic")).distinct().write.parquet(f"{folder}/labels.parquet")
    return str(folder)


@pytest.mark.parametrize(("name", "stage"), STAGES)
def test_stage_on_an_empty_table(spark, tmp_path, name, stage):
    docs = empty(spark)
    got = stage(spark, docs, tables(spark, tmp_path, docs))
    assert got.count() == 0
    if name != STAGES[-1][0]:
        assert got.schema.fieldNames() == docs.schema.fieldNames()


@pytest.mark.parametrize(("name", "stage"), STAGES)
def test_stage_on_odd_rows(spark, tmp_path, name, stage):
    """Null ids, texts and sources, blank texts, repeated rows and columns with names that operators use."""
    rows, docs = corpus(spark, n=60, seed=3)
    crowd = docs.withColumns({"score": F.lit("x"), "kept": F.lit(1), "spans": F.lit("y"), "copies": F.lit(2), "group": F.lit("z")})
    got = stage(spark, crowd, tables(spark, tmp_path, docs))
    found = got.collect()
    given = {(r[0], r[1]) for r in rows}
    if name == "tokens":
        assert len(found) == len(rows) and all(r["n_tokens"] == len(r["ids"]) for r in found)
        return
    assert got.columns == crowd.columns and all(r["score"] == "x" and r["group"] == "z" for r in found)
    if name == "personal_data":
        assert len(found) == len(rows) and {r["doc_id"] for r in found} == {i for i, _ in given}
        return
    assert {(r["doc_id"], r["text"]) for r in found} <= given
    if name == "near_duplicates":
        assert len(found) == len({(r["doc_id"], r["text"]) for r in found if r["doc_id"] is not None}) + sum(r["doc_id"] is None for r in found)
        assert sum(r["doc_id"] is None for r in found) == 2  # rows without an id stay
    if name == "mixing":
        assert max(found.count(r) for r in found) <= 2 * max(rows.count(r) for r in rows)


def test_schema_is_kept_for_the_next_stage(spark):
    assert empty(spark).schema.simpleString() == spark.createDataFrame([], SCHEMA).schema.simpleString()
