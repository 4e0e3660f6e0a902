"""The engine's queries over the driver's tables and the DuckDB SQL that each is held against.

The tables hold no source code, so documents stand for records, embeddings for their vectors (doc_id = vec_id), source for the
repository and lang for the branch; paths, identifiers and secrets are put together from keys in both engines.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import classify, text, tokens
from quarry.functions.redact import redact
from quarry.operators import bloom, changes, embed, search
from quarry.operators.store import Store
from quarry.operators.terms import term_tallies, with_term_hits
from quarry.operators.vector_index import VectorIndex
from quarry.shared import once, shared_folder, spread
from quarry.sources import config_files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if there is any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _question(e: DataFrame) -> list[float]:
    return [float(x) for x in e.where("vec_id = 0").select("embedding").first()["embedding"]]


def _records(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """documents and embeddings with the columns of code_record and code_embedding that search reads."""
    d = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("source").alias("repository_name"), F.col("lang").alias("branch"), F.lit("0000000").alias("commit_sha"),
        F.concat(F.lit("src/"), F.col("doc_id").cast("string"), F.lit(".cs")).alias("file_path"), F.lit(1).alias("line_start"), F.lit(1).alias("line_end"), F.lit(None).cast("string").alias("symbol_name"),
        F.when(F.col("doc_id") % 3 == 0, "file_summary").otherwise("method_summary").alias("record_type"), F.lit("").alias("summary"), F.lit("").alias("code_snippet"), (F.col("doc_id") % 5 == 0).alias("is_stale"),
    )
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("code_record_id"), F.when(F.col("label") < 5, "m1").otherwise("m2").alias("embedding_model"), F.col("embedding").alias("embedding_vector"))
    return d, e


_HITS = """
    WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0),
    r AS (SELECT doc_id AS id, source AS repository_name, lang AS branch, 'src/' || doc_id || '.cs' AS file_path,
                 CASE WHEN doc_id % 3 = 0 THEN 'file_summary' ELSE 'method_summary' END AS record_type, doc_id % 5 = 0 AS is_stale FROM documents),
    e AS (SELECT vec_id, CASE WHEN label < 5 THEN 'm1' ELSE 'm2' END AS model, list_cosine_similarity(embedding::DOUBLE[], q.v) AS s FROM embeddings, q)
"""


@query(
    """
    WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0)
    SELECT vec_id, label, round(list_cosine_similarity(e.embedding::DOUBLE[], q.v), 6) AS score
    FROM embeddings e, q ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], q.v) DESC, vec_id LIMIT 10
    """
)
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    found = search.nearest(e.select("vec_id", "label", "embedding"), search.cosine(F.col("embedding"), _question(e)), "vec_id")
    return found.select("vec_id", "label", F.round("score", 6).alias("score"))


@query(
    _HITS
    + """
    SELECT repository_name, branch, file_path, record_type, round(s, 6) AS score FROM r JOIN e ON id = vec_id
    WHERE NOT is_stale AND model = 'm1' AND repository_name IN ('src0', 'src1', 'src2', 'src3', 'src4', 'src5') AND branch = 'en' AND record_type IN ('method_summary')
    ORDER BY s DESC, id LIMIT 10
    """
)
def vector_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, e = _records(spark, sf_dir)
    q = search.SearchQuery(_question(table(spark, sf_dir, "embeddings")), "m1", [f"src{i}" for i in range(6)], "en", ["method_summary"], k=0)
    return search.search(r, e, q).select("repository_name", "branch", "file_path", "record_type", F.round("score", 6).alias("score"))


@query(_HITS + "SELECT file_path, round(s, 6) AS score FROM (SELECT file_path, s FROM r JOIN e ON id = vec_id WHERE NOT is_stale AND model = 'm1' ORDER BY s DESC, id LIMIT 25) WHERE s >= 0.3")
def vector_min_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, e = _records(spark, sf_dir)
    q = search.SearchQuery(_question(table(spark, sf_dir, "embeddings")), "m1", k=25, min_score=0.3)
    return search.search(r, e, q).select("file_path", F.round("score", 6).alias("score"))


@query(_HITS + "SELECT file_path, round(s, 6) AS score FROM r JOIN (SELECT * FROM e UNION ALL SELECT vec_id, 'm3', s FROM e) ON id = vec_id ORDER BY s DESC, id LIMIT 30")
def search_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, e = _records(spark, sf_dir)
    twice = e.unionByName(e.withColumn("embedding_model", F.lit("m3")))
    q = search.SearchQuery(_question(table(spark, sf_dir, "embeddings")), "m1", k=30, include_stale=True, include_other_models=True)
    return search.search(r, twice, q).select("file_path", F.round("score", 6).alias("score"))


def _index(spark: SparkSession, sf_dir: str) -> tuple[VectorIndex, DataFrame]:
    """An index of all embeddings, and the queries asked of it: the rows whose vec_id is divisible by 20."""
    e = table(spark, sf_dir, "embeddings")
    return VectorIndex.build(e, "vec_id", "embedding"), e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


@query()
def vector_topk_approximate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten rows nearest to row 0 by a kept index."""
    index, asks = _index(spark, sf_dir)
    return index.search(asks.where("query_id = 0")).select(F.col("key").alias("vec_id"), F.round("score", 6).alias("score"))


@query()
def vector_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every row whose vec_id is divisible by 20, by a kept index."""
    index, asks = _index(spark, sf_dir)
    return index.search(asks).select("query_id", "rank", F.col("key").alias("vec_id"), F.round("score", 6).alias("score"))


@query("SELECT count(*) FILTER (len(list_filter(embedding, lambda x: x <> 0)) > 0) AS indexed, count(*) FILTER (vec_id % 20 = 0) AS queries, true AS recall_reached FROM embeddings")
def vector_index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every row is in the lists, and searches of a reopened index find 0.9 or more of the ten nearest by all vectors."""
    index, asks = _index(spark, sf_dir)
    index = VectorIndex.open(spark, index.folder)
    reached = index.recall(asks) >= 0.9
    counts = asks.agg(F.count(F.lit(1)).alias("queries"))
    return index.lists().agg(F.count(F.lit(1)).alias("indexed")).join(F.broadcast(counts)).select("indexed", "queries", F.lit(reached).alias("recall_reached"))


@query(
    _HITS
    + """
    SELECT repository_name, branch, file_path, record_type, round(s, 6) AS score FROM r JOIN e ON id = vec_id
    WHERE NOT is_stale AND model = 'm1' AND branch = 'de' AND record_type = 'file_summary' ORDER BY s DESC, id LIMIT 25
    """
)
def indexed_search_of_few(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search by the index that asks for so few records that the exact search has to give the hits."""
    r, e = _records(spark, sf_dir)
    e = e.withColumn("id", F.col("code_record_id").cast("string"))
    index = VectorIndex.build(e.where("embedding_model = 'm1'").select(search.index_key(F.col("id")).alias("key"), "embedding_vector"), "key", "embedding_vector")
    q = search.SearchQuery(_question(table(spark, sf_dir, "embeddings")), "m1", branch="de", record_types=["file_summary"], k=25)
    return search.indexed_search(r, e, index, q, over=2).select("repository_name", "branch", "file_path", "record_type", F.round("score", 6).alias("score"))


class _Lengths:
    """An embedding service that answers with each text's length and lines, and fails the first time that it is asked."""

    asked = 0

    def __call__(self, request) -> bytes:
        self.asked += 1
        if self.asked == 1:
            raise OSError("busy")
        texts = json.loads(request.data)["input"]
        return json.dumps({"data": [{"index": i, "embedding": [float(len(t)), float(t.count(chr(10)) + 1)]} for i, t in reversed(list(enumerate(texts)))]}).encode()


@query(
    """
    WITH d AS (SELECT doc_id, text, 'Repository: r' || chr(10) || 'Branch: main' || chr(10) || 'Commit: abc1234' || chr(10) || 'File: ' || doc_id || '.cs:1-9' || chr(10) || 'Language: csharp' || chr(10)
        || 'Record Type: class_summary' || chr(10) || 'Symbol: Plain' || chr(10) || 'Summary: x' || chr(10) || 'Tokens: Plain ' || doc_id || chr(10) || 'Code Snippet:' || chr(10) || 'class Plain ' || lang AS t FROM documents)
    SELECT doc_id, length(t)::DOUBLE AS chars, (len(string_split(t, chr(10))))::DOUBLE AS rows, 'm' AS model, 2 AS dimension FROM d
    """
)
def embedded_over_http(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of records from a service over HTTP, in batches, with a retry, each beside its record."""
    none = F.lit(None).cast("string")
    values = {
        "id": F.col("doc_id").cast("string"), "repository_name": F.lit("r"), "branch": F.lit("main"), "commit_sha": F.lit("abc1234"), "file_path": F.concat(F.col("doc_id").cast("string"), F.lit(".cs")), "line_start": F.lit(1), "line_end": F.lit(9),
        "record_type": F.lit("class_summary"), "namespace": none, "class_name": none, "method_name": none, "symbol_name": F.lit("Plain"), "summary": F.lit("x"), "code_snippet": F.concat(F.lit("class Plain "), F.col("lang")),
    }
    records = table(spark, sf_dir, "documents").select(*[c.alias(n) for n, c in values.items()])
    service = embed.HttpEmbedder("http://service", "m", 2, "key", send=_Lengths())
    rows = embed.embedding_rows(embed.embed_records(records, service, batch_size=64, retries=1, wait=0.0), service)
    v = F.col("embedding_vector")
    return rows.select(F.col("code_record_id").cast("long").alias("doc_id"), v[0].cast("double").alias("chars"), v[1].cast("double").alias("rows"), F.col("embedding_model").alias("model"), F.col("embedding_dimension").alias("dimension"))


@query(
    """
    WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)
    SELECT q.vec_id AS query_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.e, v.e) DESC, v.vec_id)::INT AS rank, v.vec_id
    FROM v q JOIN v ON q.vec_id % 100 = 0 QUALIFY rank <= 5
    """
)
def vector_index_exhaustive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of each hundredth row where every list is probed and every row reranked, which is exact."""
    index, asks = _index(spark, sf_dir)
    n = len(index.quantisers.centres)
    return index.search(asks.where("query_id % 100 = 0"), 5, probes=n, rerank=1_000_000_000).select("query_id", "rank", F.col("key").alias("vec_id"))


def _secret(key: Column) -> Column:
    k, m = key.cast("string"), key % 7
    pad = lambda n: F.lpad(k, n, "0")
    return (
        F.when(m == 0, F.concat(F.lit("password="), k, F.lit("; host=db")))
        .when(m == 1, F.concat(F.lit('Secret = "abc'), k, F.lit('"')))
        .when(m == 2, F.concat(F.lit("id AKIA"), pad(16), F.lit(" end")))
        .when(m == 3, F.concat(F.lit("pat ghp_"), pad(36)))
        .when(m == 4, F.concat(F.lit("ApiKey: 'k"), k, F.lit("', next")))
        .when(m == 5, F.concat(F.lit('var x = $"the token is {token'), k, F.lit('}"')))
        .otherwise(F.concat(F.lit("plain text "), k))
    )


_SECRETS = """
    WITH s AS (SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 'password=' || o_orderkey || '; host=db' WHEN 1 THEN 'Secret = "abc' || o_orderkey || '"'
        WHEN 2 THEN 'id AKIA' || lpad(o_orderkey::VARCHAR, 16, '0') || ' end' WHEN 3 THEN 'pat ghp_' || lpad(o_orderkey::VARCHAR, 36, '0')
        WHEN 4 THEN 'ApiKey: ''k' || o_orderkey || ''', next' WHEN 5 THEN 'var x = $"the token is {token' || o_orderkey || '}"' ELSE 'plain text ' || o_orderkey END AS t FROM orders),
    m AS (SELECT o_orderkey, t, regexp_matches(t, '(?i)\\$"[^"]*\\{[^}]*(password|secret|token|api[_-]?key)[^}]*\\}[^"]*"') AS bad,
        regexp_replace(regexp_replace(t, '\\bghp_[A-Za-z0-9]{36,}\\b', '«REDACTED»', 'g'), '\\bAKIA[0-9A-Z]{16}\\b', '«REDACTED»', 'g') AS a FROM s),
    f AS (SELECT o_orderkey, bad, CASE WHEN bad THEN t ELSE regexp_replace(a,
        '(?i)(password|secret|token|api[_-]?key|connection[_-]?string|client[_-]?secret|private[_-]?key)\\s*[:=]\\s*(?:(")[^"''\\r\\n,;]+"|('')[^"''\\r\\n,;]+''|[^"''\\r\\n,;]+)',
        '\\1=\\2\\3«REDACTED»\\2\\3', 'g') END AS safe, CASE WHEN bad THEN 'failed' WHEN o_orderkey % 7 = 6 THEN 'no_match' ELSE 'redacted' END AS status FROM m)
"""


@query(_SECRETS + "SELECT o_orderkey, safe, status FROM f")
def redact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "orders").select("o_orderkey", redact(_secret(F.col("o_orderkey"))).alias("r"))
    return r.select("o_orderkey", F.col("r.text").alias("safe"), F.col("r.status").alias("status"))


@query(
    """
    SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 'key_value:password' WHEN 1 THEN 'key_value:secret' WHEN 2 THEN 'aws_access_key' WHEN 3 THEN 'github_pat'
        WHEN 4 THEN 'key_value:api_key' WHEN 5 THEN 'interpolated_secret' ELSE '' END AS hits FROM orders
    """
)
def redact_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(redact(_secret(F.col("o_orderkey")))["hits"], ",").alias("hits"))


@query("SELECT count(*) FILTER (o_orderkey % 7 <> 5) AS records_created, count(*) FILTER (o_orderkey % 7 = 5) AS redaction_failed FROM orders")
def redact_drop_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = redact(_secret(F.col("o_orderkey")))["status"]
    return table(spark, sf_dir, "orders").select(status.alias("s")).agg(F.count_if(F.col("s") != "failed").alias("records_created"), F.count_if(F.col("s") == "failed").alias("redaction_failed"))


TERMS = ("the", "und", "de", "Thth")
_LINES = r"l AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10))) AS line FROM documents)"


@query(
    f"WITH {_LINES}, h AS ("
    + " UNION ALL ".join(  # a pattern of its own for each term, so that each is compiled once
        rf"""
        SELECT doc_id, '{t}' AS term, regexp_matches(line, '(?i)(^|[^\p{{L}}\p{{N}}_]){t}([^\p{{L}}\p{{N}}_]|$)') AS w, ltrim(line) LIKE '///%' AS doc,
               contains(line, '{t}') AND regexp_matches(line, '(^|[^\p{{L}}\p{{Nd}}_]){t}([^\p{{L}}\p{{Nd}}_]|$)') AS i FROM l WHERE contains(lower(line), '{t.lower()}')"""
        for t in TERMS
    )
    + """),
    k AS (SELECT doc_id, term, 'string_literal' AS match_kind FROM h WHERE w UNION ALL SELECT doc_id, term, 'comment' FROM h WHERE w AND NOT doc
          UNION ALL SELECT doc_id, term, 'xml_doc' FROM h WHERE w AND doc UNION ALL SELECT doc_id, term, 'identifier' FROM h WHERE i)
    SELECT doc_id, term, match_kind, count(*)::INT AS hit_count FROM k GROUP BY ALL
    """
)
def term_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    return term_tallies(files, TERMS).select(F.col("path").alias("doc_id"), "term", "match_kind", "hit_count")


#: Parts whose pairs are 1,024 terms.
PARTS = tuple("the and ing tion ed er on re st en at nd ti es or th an ble is it by in of nt ha sh wh ea ou ly le to".split())


@query(
    f"WITH {_LINES}, p AS (SELECT unnest({list(PARTS)}) AS p), t AS (SELECT a.p || b.p AS term FROM p a, p b),"
    + r"""
    w AS (SELECT doc_id, row_number() OVER () AS line, regexp_extract_all(line, '[\p{L}\p{Nd}_]+') AS names FROM l),
    u AS (SELECT DISTINCT doc_id, line, unnest(names) AS name FROM w), v AS (SELECT DISTINCT doc_id, line, lower(name) AS name FROM u)
    SELECT doc_id, term, coalesce(words, 0)::INT AS words, coalesce(names, 0)::INT AS names
    FROM (SELECT doc_id, name AS term, count(*) AS words FROM v WHERE name IN (SELECT term FROM t) GROUP BY ALL)
    FULL JOIN (SELECT doc_id, name AS term, count(*) AS names FROM u WHERE name IN (SELECT term FROM t) GROUP BY ALL) USING (doc_id, term)
    """
)
def many_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by word and by name of 1,024 terms in every document, in one pass."""
    files = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    return with_term_hits(files, [a + b for a in PARTS for b in PARTS]).select("doc_id", F.inline("hits")).select("doc_id", "term", "words", "names")


@query(
    """
    WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS rows FROM documents)
    SELECT doc_id, greatest(coalesce(list_position(list_transform(rows, lambda r: contains(r, 'the')), true), 0), 1)::INT AS first_line FROM l
    WHERE len(list_filter(rows, lambda r: regexp_matches(r, '(^|[^\\p{L}\\p{Nd}_])the([^\\p{L}\\p{Nd}_]|$)'))) > 0
    """
)
def term_first_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    return term_tallies(files, ["the"]).where("match_kind = 'identifier'").select(F.col("path").alias("doc_id"), "first_line")


_SPLIT = """
    list_sort(list_distinct(list_concat([x], flatten(list_transform(list_filter(regexp_split_to_array(x, '[-_./\\\\ \\t]'), lambda p: p <> ''),
        lambda p: list_concat([p], list_filter(string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(p, '(\\p{Ll})(\\p{Lu})', '\\1|\\2', 'g'), '(\\p{Lu})(\\p{Lu}\\p{Ll})', '\\1|\\2', 'g'),
            '(\\p{L})(\\p{Nd})', '\\1|\\2', 'g'), '([^\\p{L}|])(\\p{L})', '\\1|\\2', 'g'), '|'), lambda w: w <> '')))))))
"""



@query("SELECT p_partkey, array_to_string(" + _SPLIT + ", ',') AS tokens FROM (SELECT p_partkey, 'XMLParserV2processIO.' || replace(p_brand, '#', '-') || '_is' || p_size AS x FROM part)")
def tokenize_identifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("XMLParserV2processIO."), F.replace(F.col("p_brand"), F.lit("#"), F.lit("-")), F.lit("_is"), F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.sort_array(tokens.split_identifier(name)), ",").alias("tokens"))


@query("SELECT s_suppkey, 'Acme.Core Acme Core SupplierService Supplier Service Load' || s_suppkey || ' Load ' || s_suppkey || ' Plain.g Plain g' AS line FROM supplier")
def token_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    method = F.concat(F.lit("Load"), F.col("s_suppkey").cast("string"))
    line = tokens.token_line(F.lit("Acme.Core"), F.lit("SupplierService"), method, F.lit(None).cast("string"), F.lit("lib/Plain.g.cs"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", line.alias("line"))


@query(
    """
    SELECT s_suppkey, 'Repository: ' || s_name || chr(10) || 'Branch: main' || chr(10) || 'Commit: abc1234' || chr(10) || 'File: src/' || s_suppkey || '.cs:1-9' || chr(10) || 'Language: csharp' || chr(10)
        || 'Record Type: class_summary' || chr(10) || 'Symbol: Plain' || chr(10) || 'Summary: Class Plain' || chr(10) || 'Tokens: Plain ' || s_suppkey
        || chr(10) || 'Code Snippet:' || chr(10) || 'class Plain' AS text FROM supplier
    """
)
def embedding_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    r = {
        "repository_name": F.col("s_name"), "branch": F.lit("main"), "commit_sha": F.lit("abc1234"), "file_path": F.concat(F.lit("src/"), F.col("s_suppkey").cast("string"), F.lit(".cs")), "line_start": F.lit(1),
        "line_end": F.lit(9), "record_type": F.lit("class_summary"), "namespace": none, "class_name": F.lit(" "), "method_name": none, "symbol_name": F.lit("Plain"), "summary": F.lit("Class Plain"),
        "code_snippet": F.lit("class Plain\n\n"),
    }
    return table(spark, sf_dir, "supplier").select("s_suppkey", tokens.embedding_text(r).alias("text"))


_CUT = """CASE WHEN octet_length(encode(s)) > {n} THEN decode(unhex(regexp_extract(substr(hex(encode(s)), 1, 2 * {n}), '^((?:[0-9A-F][0-9A-F])*?)(?:[CDEF][0-9A-F])?(?:[89AB][0-9A-F])*$', 1))) ELSE s END"""


@query(f"SELECT doc_id, {_CUT.format(n=100)} AS head FROM (SELECT doc_id, text AS s FROM documents)")
def truncate_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.truncate_bytes(F.col("text"), 100).alias("head"))


@query(
    f"""
    WITH l AS (SELECT doc_id, string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)) AS rows FROM documents),
    j AS (SELECT doc_id, array_to_string(rows[greatest(1, least(5, len(rows)) - 20) : least(len(rows), least(5, len(rows)) + 20)], chr(10)) AS s FROM l)
    SELECT doc_id, {_CUT.format(n=4096)} AS snippet FROM j
    """
)
def snippet_around_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.around_line(F.col("text"), F.lit(5)).alias("snippet"))


@query(
    f"""
    WITH l AS (SELECT doc_id, string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)) AS rows FROM documents),
    j AS (SELECT doc_id, coalesce(array_to_string(rows[2 : least(8, len(rows))], chr(10)), '') AS s FROM l), c AS (SELECT doc_id, {_CUT.format(n=4096)} AS s FROM j)
    SELECT doc_id, CASE WHEN regexp_matches(s, '[;}}]') THEN regexp_extract(s, '(?s)^(.*[;}}])', 1) WHEN contains(s, chr(10)) THEN regexp_extract(s, '(?s)^(.*\\n)', 1) ELSE s END AS snippet FROM c
    """
)
def snippet_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.method_snippet(F.col("text"), F.lit(2), F.lit(8)).alias("snippet"))


@query(
    """
    SELECT doc_id, 'File: src/' || doc_id || '.cs' || chr(10) || 'Namespaces: Acme, ' || lang || chr(10) || CASE WHEN doc_id % 2 = 0 THEN 'Top-level types: A, A' || chr(10) ELSE '' END
        || CASE WHEN contains(text, 'the') THEN 'Search-term hits: the' || chr(10) ELSE '' END AS snippet FROM documents
    """
)
def file_summary_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("src/"), F.col("doc_id").cast("string"), F.lit(".cs"))
    types = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("A"), F.lit("A"))).otherwise(F.array().cast("array<string>"))
    hits = F.filter(F.array(F.lit("the"), F.lit("the")), lambda t: F.col("text").contains(t))
    return table(spark, sf_dir, "documents").select("doc_id", text.file_summary(path, F.array(F.lit("Acme"), F.col("lang"), F.lit("Acme")), types, hits).alias("snippet"))


_PATHS = ("src/Form.Designer.cs", "project/generated/Out.cs", "src/appsettings.test.json", "conf/Web.xml", "tests/Foo.cs", "latest/Foo.cs", "src/Acme.Tests/Bar.cs", "src\\test\\Foo.cs", "src/Domain/Customer.cs", "bin/x.cs")


def _path(key: Column) -> Column:
    return F.element_at(F.array(*[F.lit(p) for p in _PATHS]), (key % len(_PATHS) + 1).cast("int"))


@query(
    """
    SELECT page_id, CASE WHEN page_id % 11 = 0 THEN 'generated' ELSE ['generated', 'generated', 'configuration', 'configuration', 'test', 'test', 'test', 'test', 'production', 'production'][page_id % 10 + 1] END AS kind FROM pages
    """
)
def classify_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.when(F.col("page_id") % 11 == 0, "// <Auto-Generated />").otherwise("class A { }")
    return table(spark, sf_dir, "pages").select("page_id", classify.file_kind(_path(F.col("page_id")), content).alias("kind"))


@query(
    """
    SELECT page_id, contains('/' || lower(url) || '/', '/page/') OR contains('/' || lower(url) || '/', '/bin/') OR page_id % 10 = 9 AS ignored FROM pages
    """
)
def ignore_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = F.concat(F.col("url"), F.lit("/"), _path(F.col("page_id")))
    return table(spark, sf_dir, "pages").select("page_id", classify.is_ignored(joined, [" Page/", "bin", " "]).alias("ignored"))


@query("SELECT doc_id, octet_length(encode(text))::BIGINT AS length FROM documents WHERE octet_length(encode(text)) <= 2 * 1024")
def size_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("length")).where(F.col("length") <= 2 * 1024)


@query("SELECT o_orderkey, ['xunit', 'nunit', 'mstest', 'unknown', 'xunit'][o_orderkey % 5 + 1] AS framework FROM orders")
def test_framework(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = F.array(*[F.lit(t) for t in ("[Fact] [Test]", "using NUnit;", "[TestMethod]", "[fact]", "using Xunit; [TestMethod]")])
    return table(spark, sf_dir, "orders").select("o_orderkey", classify.test_framework(F.element_at(texts, (F.col("o_orderkey") % 5 + 1).cast("int"))).alias("framework"))


@query("SELECT s_suppkey || '.env' AS path, u.k AS key, '$.' || u.k AS json_path, u.l::INT AS line_start FROM supplier, (VALUES ('A_KEY', 2), ('TOKEN', 5)) u(k, l)")
def config_env(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey").cast("string")
    body = F.concat(F.lit("# c\r\n A_KEY = "), key, F.lit("\n\n=x\nTOKEN=a=b\nnothing"))
    files = table(spark, sf_dir, "supplier").select(F.concat(key, F.lit(".env")).alias("path"), body.alias("content"))
    return config_files.env_rows(files, []).select("path", "key", "json_path", "line_start")


@query(
    """
    SELECT event_id || '/appsettings.json' AS path, u.k AS key, CASE u.k WHEN 'k' THEN props->>'$.k' WHEN 'on' THEN 'true' ELSE '1.50' END AS value,
           CASE u.k WHEN 'k' THEN '$.p.k' WHEN 'on' THEN '$.FeatureFlags.on' ELSE '$.list[1].n' END AS json_path FROM events, (VALUES ('k'), ('on'), ('n')) u(k)
    """
)
def config_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id").cast("string")
    body = F.concat(F.lit('{"p": '), F.col("props"), F.lit(', "FeatureFlags": {"on": true}, "list": [1, {"n": 1.50}]}'))
    files = table(spark, sf_dir, "events").select(F.concat(key, F.lit("/appsettings.json")).alias("path"), body.alias("content"))
    return config_files.json_rows(files, []).select("path", "key", "value", "json_path")


@query("SELECT s_suppkey, 'A/A.csproj,B/' || s_suppkey || '.csproj' AS projects FROM supplier")
def sln_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(
        F.lit('x\n  Project("{1}") = "A", "A\\A.csproj", "{2}"\r\nProject("{1}") = "F", "Folder", "{3}"\nProject("{1}") = "B", "B\\'), F.col("s_suppkey").cast("string"), F.lit('.csproj", "{4}"\nProject("{1}") = "C"\n')
    )
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(config_files.solution_projects(body), ",").alias("projects"))


@query("SELECT s_suppkey, 'Demo' || s_suppkey AS assembly_name, 'net8.0,net9.0' AS frameworks, 'Npgsql 8.0.0' AS packages, true AS nullable FROM supplier")
def csproj_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey").cast("string")
    body = F.concat(
        F.lit('<Project Sdk="S"><PropertyGroup><TargetFrameworks>net8.0; net9.0</TargetFrameworks><Nullable>Enable</Nullable></PropertyGroup><PropertyGroup><AssemblyName>Demo'), key,
        F.lit('</AssemblyName></PropertyGroup><ItemGroup><PackageReference Include="Npgsql"><Version>8.0.0</Version></PackageReference></ItemGroup></Project>'),
    )
    files = table(spark, sf_dir, "supplier").select(F.concat(key, F.lit(".csproj")).alias("path"), body.alias("content"))
    p = F.transform("package_references", lambda x: F.concat_ws(" ", x["name"], x["version"]))
    rows = config_files.project_rows(files)
    return rows.select(F.split("path", r"\.")[0].cast("long").alias("s_suppkey"), "assembly_name", F.array_join("target_frameworks", ",").alias("frameworks"), F.array_join(p, ",").alias("packages"), "nullable")


@query(
    """
    SELECT c_custkey, 'Acme.C' || c_custkey || '.Run' AS symbol_name, 3 AS complexity, 'Log,Save' AS calls, 'Logger' AS instantiates, 4 AS line_start FROM customer
    """
)
def csharp_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.plans.scan import csharp_rows

    body = F.concat(
        F.lit("namespace Acme;\nclass C"), F.col("c_custkey").cast("string"),
        F.lit('\n{\n  public void Run(int x)\n  {\n    if (x > 0 && x < 9) Log($"a {x} // not a comment");\n    new Logger(x).Save(); /* if */\n  }\n}\n'),
    )
    files = spread(table(spark, sf_dir, "customer").select("c_custkey")).select(F.concat(F.lit("src/"), F.col("c_custkey").cast("string"), F.lit(".cs")).alias("path"), body.alias("content"), F.lit("production").alias("kind"))
    rows = csharp_rows(files, []).where("record_type = 'method_summary'")
    data = F.from_json("metadata_json", "cyclomatic_complexity int, calls array<string>, instantiates array<string>")
    return rows.select(
        F.regexp_extract("path", "([0-9]+)", 1).cast("long").alias("c_custkey"), "symbol_name", data["cyclomatic_complexity"].alias("complexity"), F.array_join(F.array_sort(data["calls"]), ",").alias("calls"),
        F.array_join(data["instantiates"], ",").alias("instantiates"), "line_start",
    )


@query(
    """
    WITH k AS (SELECT DISTINCT l_orderkey AS a, CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE l_suppkey END AS b FROM lineitem WHERE l_orderkey % 2 = 0),
    n AS (SELECT l_orderkey AS a, CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE l_suppkey END AS b, l_linenumber AS c FROM lineitem)
    SELECT a, b, c FROM n WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.a = n.a AND k.b = n.b)
    """
)
def insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.when(F.col("l_suppkey") % 4 != 0, F.col("l_suppkey"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("a"), b.alias("b"), F.col("l_linenumber").alias("c"))
    return changes.insert_if_absent(rows.where("a % 2 = 0"), rows, ("a", "b"))


@query("SELECT l_suppkey, l_partkey, min(l_orderkey * 10 + l_linenumber) AS first FROM lineitem GROUP BY ALL")
def first_of_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.plans.scan import first_of_key as first

    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("first"))
    return first(rows, ("l_suppkey", "l_partkey"), ("first",))


@query(
    """
    SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN upper(s_name) ELSE s_name END AS s_name, CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal + 1 ELSE s_acctbal END AS s_acctbal FROM supplier
    UNION ALL SELECT s_suppkey + 1000000, upper(s_name), s_acctbal + 1 FROM supplier WHERE s_suppkey % 5 = 0
    """
)
def repo_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    changed = old.withColumn("s_name", F.upper("s_name")).withColumn("s_acctbal", F.col("s_acctbal") + 1)
    new = changed.where("s_suppkey % 2 = 0").unionByName(changed.where("s_suppkey % 5 = 0").withColumn("s_suppkey", F.col("s_suppkey") + 1000000))
    return changes.upsert(old, new, ["s_suppkey"], ["s_name", "s_acctbal"])


@query("SELECT o_orderkey, (o_orderstatus = 'F' OR o_orderpriority LIKE '1%') AND o_orderkey % 10 <> 0 AS is_stale FROM orders")
def mark_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.col("o_orderpriority").startswith("1").alias("is_stale"))
    marked = changes.mark_stale(rows, F.col("o_orderstatus") == "F", but=rows.where("o_orderkey % 10 = 0"), keys=["o_orderkey"])
    return marked.select("o_orderkey", "is_stale")


@query(
    """
    WITH e AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R'), f AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_linestatus = 'O' AND l_quantity > 45)
    SELECT o_orderkey, CASE WHEN f.l_orderkey IS NOT NULL THEN 'failed' WHEN e.l_orderkey IS NOT NULL THEN 'embedded' ELSE 'pending' END AS state
    FROM orders LEFT JOIN e ON o_orderkey = e.l_orderkey LEFT JOIN f ON o_orderkey = f.l_orderkey
    """
)
def status_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.lit("pending").alias("state"))
    done = items.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("done_id"))
    lost = items.where("l_linestatus = 'O' and l_quantity > 45").select(F.col("l_orderkey").alias("done_id"))
    return changes.with_status(changes.with_status(rows, done, "embedded", "o_orderkey", "state"), lost, "failed", "o_orderkey", "state")


@query("SELECT EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = 'F' AND o_custkey = 7) AS done, false AS other")
def has_completed(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "orders").select("o_custkey", F.when(F.col("o_orderstatus") == "F", "completed").otherwise("running").alias("status"))
    found = changes.exists_completed(jobs, o_custkey=7), changes.exists_completed(jobs, o_custkey=-1)
    return spark.range(1).select(F.lit(found[0]).alias("done"), F.lit(found[1]).alias("other"))


@query("SELECT doc_id, ((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 16)::BIGINT AS batch FROM documents")
def batch_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.batched(table(spark, sf_dir, "documents").select("doc_id", "source"), 16, ["doc_id"], ["source"]).select("doc_id", "batch")


@query(
    """
    WITH k AS (SELECT DISTINCT l_orderkey AS a, CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE l_suppkey END AS b FROM lineitem WHERE l_orderkey % 7 = 0),
    n AS (SELECT l_orderkey AS a, CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE l_suppkey END AS b, l_linenumber AS c FROM lineitem)
    SELECT a, b, c FROM n WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.a = n.a AND k.b = n.b)
    """
)
def insert_by_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose key is absent, where a kept Bloom filter says which rows have to be looked for."""
    b = F.when(F.col("l_suppkey") % 4 != 0, F.col("l_suppkey"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("a"), b.alias("b"), F.col("l_linenumber").alias("c"))
    there = rows.where("a % 7 = 0")
    folder = shared_folder(spark, "filter")
    bloom.bloom_filter(there, ("a", "b"), 1 << 22).write.parquet(folder)
    return bloom.insert_if_absent(there, rows, ("a", "b"), spark.read.parquet(folder))


@query(
    _HITS
    + """
    SELECT repository_name, branch, '0000000' AS commit_sha, file_path, 1 AS line_start, 1 AS line_end, NULL::VARCHAR AS symbol_name, record_type, '' AS summary, '' AS code_snippet, round(s, 6) AS score
    FROM r JOIN e ON id = vec_id WHERE NOT is_stale AND model = 'm2' ORDER BY s DESC, id LIMIT 15
    """
)
def hit_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that a hit shows; a record without a symbol is a hit like others."""
    r, e = _records(spark, sf_dir)
    return search.search(r, e, search.SearchQuery(_question(table(spark, sf_dir, "embeddings")), "m2", k=15)).withColumn("score", F.round("score", 6))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'no_match' WHEN doc_id % 3 = 1 THEN 'no_match' ELSE 'redacted' END AS status, CASE WHEN doc_id % 3 = 2 THEN 'token=«REDACTED»' ELSE '' END AS safe FROM documents")
def redact_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty snippets have nothing to redact."""
    m = F.col("doc_id") % 3
    r = redact(F.when(m == 1, F.lit("")).when(m == 2, F.concat(F.lit("token="), F.col("doc_id").cast("string"))))
    return table(spark, sf_dir, "documents").select("doc_id", r.alias("r")).select("doc_id", F.col("r.status").alias("status"), F.col("r.text").alias("safe"))


@query("SELECT doc_id, (length(text) - length(replace(text, chr(10), '')) + 1)::INT AS rows FROM documents WHERE text IS NOT NULL")
def line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", text.line_count(F.col("text")).cast("int").alias("rows"))


@query(
    """
    SELECT count(*) FILTER (doc_id % 2 = 0) AS first, count(*) FILTER (doc_id % 3 = 0 AND (doc_id % 2 = 1 OR doc_id % 4 = 0)) AS second, count(*) FILTER (doc_id % 2 = 0 AND NOT (doc_id % 3 = 0 AND doc_id % 4 <> 0)) AS stale,
           count(*) FILTER (doc_id % 3 = 0) AS fresh, 2::BIGINT AS jobs, 1::BIGINT AS repositories, true AS completed, 0::BIGINT AS migrations FROM documents
    """
)
def stored_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scans into a store: what each inserts, what the second leaves stale, and the jobs. A record without a symbol equals none, so
    it is new each time."""
    store = Store(spark, shared_folder(spark, "store"))
    store.migrate()
    d, none = table(spark, sf_dir, "documents"), F.lit(None).cast("string")
    key = F.col("doc_id").cast("string")

    def scanned(job: str, repository: str, only: str) -> DataFrame:
        values = {
            "id": F.concat(F.lit(job), key), "repository_id": F.lit(repository), "scan_job_id": F.lit(job), "repository_name": F.lit("docs"), "branch": F.lit("main"), "commit_sha": F.lit("c"), "file_path": F.concat(F.lit("src/"), key), "line_start": F.lit(1),
            "line_end": F.lit(1), "record_type": F.lit("file_summary"), "symbol_name": F.when(F.col("doc_id") % 4 != 0, F.concat(F.lit("S"), key)), "symbol_kind": F.lit("File"), "namespace": none, "class_name": none, "method_name": none, "summary": F.lit(""),
            "code_snippet": F.lit(""), "metadata_json": F.lit("{}"), "is_test_code": F.lit(False), "is_generated_code": F.lit(False), "is_stale": F.lit(False), "embedding_status": F.lit("pending"), "created_at": F.current_timestamp(), "updated_at": F.current_timestamp(),
        }
        return d.where(only).select(*[c.alias(n) for n, c in values.items()])

    inserted = []
    for only in ("doc_id % 2 = 0", "doc_id % 3 = 0"):
        repository = store.upsert_repository("docs", "main", "c")
        job = store.start_job(repository, "main", "c")
        inserted.append(store.add_records("docs", "main", scanned(job, repository, only)))
        store.finish_job(job, "completed", inserted[-1])
    done, again = store.has_completed(repository, "main", "c") and store.repository("docs")["id"] == repository, len(store.migrate())
    jobs = store.table("scan_job").where("status = 'completed' and completed_at is not null").count()
    counts = store.table("code_record").agg(F.count_if("is_stale").alias("stale"), F.count_if(~F.col("is_stale")).alias("fresh"))
    known = {"jobs": jobs, "repositories": store.table("repository").count(), "completed": done, "migrations": again, "first": inserted[0], "second": inserted[1]}
    return counts.select("stale", "fresh", *[F.lit(v).cast("boolean" if n == "completed" else "long").alias(n) for n, v in known.items()])


@query("SELECT CASE WHEN doc_id % 3 = 0 THEN 'file_summary' ELSE 'method_summary' END AS record_type, count(*) AS n, count(*) FILTER (doc_id % 5 = 0) AS stale FROM documents GROUP BY ALL")
def records_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, _ = _records(spark, sf_dir)
    return r.groupBy("record_type").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_stale").alias("stale"))


@query(
    """
    SELECT o_orderkey, left(md5(o_orderkey::VARCHAR), 7) AS sha, CASE WHEN s >= 60 THEN (s // 60)::INT || 'm ' || lpad(((s % 60)::INT)::VARCHAR, 2, '0') || 's' ELSE s::INT || '.0s' END AS took,
           printf('%.2f', o_orderkey % 100 / 100.0) AS score FROM (SELECT o_orderkey, o_orderkey % 200 AS s FROM orders)
    """
)
def formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", text.short_sha(F.md5(key.cast("string"))).alias("sha"), text.duration(key % 200).alias("took"), text.score_text(key % 100 / F.lit(100.0)).alias("score"))


@query("SELECT c_custkey, 'svc-' || c_custkey AS a, 'repo' AS b, 'repository' AS c FROM customer")
def repository_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = classify.repository_name
    url = F.concat(F.lit("git@host:org/svc-"), F.col("c_custkey").cast("string"), F.lit(".git"))
    return table(spark, sf_dir, "customer").select("c_custkey", name(url).alias("a"), name(F.lit("https://host/org/repo/")).alias("b"), name(F.lit("")).alias("c"))


@query(
    r"""
    SELECT u.record_type, count(*) AS n FROM documents, (VALUES ('file_summary'), ('class_summary'), ('method_summary'), ('search_term_match')) u(record_type)
    WHERE text IS NOT NULL AND (u.record_type <> 'search_term_match' OR regexp_matches(text, '(?i)(^|[^\p{L}\p{N}_])the([^\p{L}\p{N}_]|$)')) GROUP BY ALL
    """
)
def scan_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole scan over files made from the documents: records by type, after redaction and the first of each key."""
    from quarry.plans.scan import ScanContext, extracted, records

    d = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), 500)  # to read and redact a text is long beside its size
    name = F.concat(F.lit("M"), F.md5("text"))
    whole = F.regexp_replace("text", '"', '""')  # of a verbatim literal, which keeps the text's lines
    code = F.concat(F.lit("namespace Docs { public class C"), F.col("doc_id").cast("string"), F.lit(" { public string "), name, F.lit('() { return Make(@"'), whole, F.lit('"); } } }'))
    files = d.select(F.concat(F.lit("src/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".cs")).alias("path"), F.length(code).cast("long").alias("length"), once(code).alias("content"))
    rows = records(extracted(files, ["the"]), ScanContext("r", "j", "docs", "main", "0000000"))
    return rows.groupBy("record_type").agg(F.count(F.lit(1)).alias("n"))
