"""Queries over the synthetic tables, one for each operator of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import common


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mix of all sources by weight. Null texts have no words and are not taken; a null source is a source."""
    from quarry.llm.mixing import pareto_mix

    docs = common.read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return pareto_mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies", "inclusion")


def op8_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty shards of near equal bytes. Equal texts go together as far as sizes allow; null texts have a size of 16."""
    from quarry.llm.sharding import shard_documents

    docs = common.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return shard_documents(docs)


def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and its edited text. Null texts are empty; the next document is the one with the next smaller doc_id."""
    from quarry.llm.fingerprint import fingerprints

    return fingerprints(common.read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document. Null texts are empty and have no ids."""
    import public_tokenizers

    from quarry.llm.bpe import digests

    return digests(common.read_table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents in the order of doc_id, written and read back. Null texts have the end id alone."""
    import public_tokenizers

    from quarry.llm import tokenfiles

    docs = common.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokenfiles.read(*tokenfiles.write(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all rows for each vec_id divisible by 20. Vectors with null or non-finite components take no part."""
    from quarry.llm.topk import topk

    return topk(common.read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every text. Held out of learning are rows whose id's CRC-32 has the remainder 1; a null doc_id is not held out. Null and empty texts have the model's prior."""
    from quarry.llm import quality

    docs = common.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, common.read_table(spark, sf_dir, "labels"), ~quality.held_out())
    return quality.score(docs, model).select("doc_id", F.coalesce(quality.held_out(), F.lit(False)).alias("held_out"), "score", "predicted")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of 0.8 over shingles of two words. Texts without words link with nothing; rows of one doc_id and text are one document."""
    from quarry.llm.neardup import near_duplicates

    return near_duplicates(common.read_table(spark, sf_dir, "documents").select("doc_id", "text"), width=2).select("doc_id", "n_shingles", "component_id", "kept")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text: base spans by pattern, and the spans that the tagger, trained on a sample of these texts, adds."""
    from quarry.llm import pii

    docs = common.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.find(docs, pii.fit(docs))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target is what is labelled of good quality and not toxic."""
    from quarry.llm import lmscore

    docs = common.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    good = common.read_table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select(F.col("doc_id").alias("good")).distinct()
    marked = docs.join(common.small_side(common.cut(good), rows=2_000_000), F.col("doc_id") == F.col("good"), "left")
    target = F.col("good").isNotNull()
    return lmscore.scores(marked, target).drop("good")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of words, of 6 words and 4 periods at least, of each document as `edited_words` changes it. Null texts have no runs
    and an empty collapsed text; a null doc_id leaves its text as it is."""
    from quarry.llm.periodic import find_runs

    docs = common.read_table(spark, sf_dir, "documents").select("doc_id", edited_words(F.col("doc_id"), F.col("text")).alias("text"))
    first = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    found = find_runs(docs, least=6, exponent=4).withColumn("first", first)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("first.start")).alias("start"), F.col("first.length").alias("length"), (-F.col("first.period")).alias("period"),
        F.expr("1000 * first.length div -first.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )


def edited_words(doc_id: Column, text: Column) -> Column:
    """The text; if its id's CRC-32 ends in 0 and it has words, these joined by spaces and repeating from one on."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)

    def repeating(w: Column) -> Column:
        n = F.size(w)
        a = (g % n).cast("int")
        p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
        times = F.ceil((n - a) / p).cast("int")
        again = F.slice(F.flatten(F.array_repeat(F.slice(w, a + 1, p), times)), F.lit(1), n - a)
        return F.when(n > 0, F.array_join(F.concat(F.slice(w, F.lit(1), a), again), " "))

    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    return F.when(h % 10 == 0, F.coalesce(F.transform(F.array(words), repeating)[0], text)).otherwise(text)


def op12_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between all embeddings of a label at a cosine of 0.98. What takes no part has no links and is kept."""
    from quarry.llm.vecdedup import near_vectors

    return near_vectors(common.read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"), cosine=0.98).select("vec_id", "n_links", "component_id", "kept")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of the embeddings whose vec_id is divisible by 100, where labels of ids divisible by 7 are one higher."""
    from quarry.llm.negatives import hard_negatives

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(common.read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label")), F.col("vec_id") % 100 == 0)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline over documents: token ids of what they keep."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


_ALL = (op1_quality, op2_fingerprint, op3_near_dedup, op4_pii, op5_bpe, op6_token_files, op7_lm_score, op8_shard, op9_mix_sources, op10_topk, op11_periodic_runs, op12_near_vectors, op13_hard_negatives, pipeline)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

ORACLES: dict[str, str] = {
    "op13_hard_negatives": """
        WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
                   FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
                     AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_dot_product(a.e, b.e)::BIGINT AS score
                   FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
             p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
                   QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
             n AS (SELECT anchor_id, positive_id, positive_score, other_id AS negative_id, score AS negative_score,
                          row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)::INT AS rank
                   FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
    """,
    "op12_near_vectors": """
        WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
                             WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
                               AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
             n AS (SELECT *, sqrt(list_dot_product(e, e)) AS size FROM v),
             l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
                   WHERE list_dot_product(a.e, b.e) / (a.size * b.size) >= 0.98),
             c AS (SELECT x, count(*) AS n_links FROM l GROUP BY x),
             r AS (SELECT vec_id, vec_id AS near FROM embeddings UNION SELECT r.vec_id, l.y FROM r JOIN l ON r.near = l.x),
             m AS (SELECT vec_id, min(near) AS component_id FROM r GROUP BY vec_id)
        SELECT e.vec_id, coalesce(c.n_links, 0) AS n_links, m.component_id, coalesce(e.vec_id = m.component_id, FALSE) AS kept
        FROM embeddings e LEFT JOIN c ON c.x = e.vec_id LEFT JOIN m ON m.vec_id = e.vec_id
    """,
    "op3_near_dedup": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
        e AS (SELECT x, y FROM p JOIN n i ON i.doc_id = x JOIN n j ON j.doc_id = y WHERE 100 * c >= 80 * (i.n + j.n - c)),
        r AS (SELECT doc_id, doc_id AS near FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.near = e.x),
        c AS (SELECT doc_id, min(near) AS component_id FROM r GROUP BY doc_id)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
    """,
    "op10_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                     AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
                   FROM v q, v c WHERE q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
             r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
    """,
}
