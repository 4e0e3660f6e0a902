"""Plans and data structures that keep work bounded: one read, late fetches, kept filters, batches without a window over all."""

import json
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry import cli, shared
from quarry.operators import bloom, changes
from quarry.operators.embed import EmbeddingError, HashEmbedder, embed_cached
from quarry.operators.search import SearchQuery, search
from quarry.operators.store import Store
from quarry.plans import services
from quarry.plans.scan import Counters, extracted
from quarry.sources import files as F_


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# -- a scan ---------------------------------------------------------------------------------------------------------


def test_a_scan_reads_its_files_once(spark, tmp_path):
    rows = [("a.cs", 9, "class A { void M() { Flag(); } }"), ("b/appsettings.json", 9, '{"FeatureX": {"on": true}}'), ("c.csproj", 9, "<Project/>"), ("d.sln", 9, 'Project("{A}") = "A", "A.csproj", "{B}"'), (".env", 9, "Flag=v\nK=v"), ("e.cs", 9, None)]
    spark.createDataFrame(rows, "path string, length long, content string").coalesce(1).write.parquet(f"{tmp_path}/files")
    files = spark.read.parquet(f"{tmp_path}/files")
    counting = Counters()
    made = counting.counted(files, ["Flag"])
    for df in (made, extracted(files, ["Flag"])):
        assert plan(df).count("FileScan parquet") == 1 and plan(df).count("MapInArrow") == 1 and "Join" not in plan(df)
    made.write.parquet(f"{tmp_path}/rows")  # the pass that writes is the one that counts
    got = counting.result()
    written = spark.read.parquet(f"{tmp_path}/rows")
    assert got == {"files_scanned": 6, "records_created": written.count(), "records_failed": 1, "redaction_failed": 0}
    kinds = {r["record_type"]: r["n"] for r in written.groupBy("record_type").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert kinds["file_summary"] == 3 and kinds["configuration_reference"] == 2 and kinds["search_term_match"] >= 1 and kinds["method_summary"] == 1


# -- search ---------------------------------------------------------------------------------------------------------


def test_search_fetches_snippets_of_the_best_alone(spark, tmp_path):
    records = spark.range(40).select(
        F.col("id").cast("string").alias("id"), F.lit("r").alias("repository_name"), F.lit("main").alias("branch"), F.lit("c").alias("commit_sha"), F.lit("f").alias("file_path"), F.lit(1).alias("line_start"), F.lit(1).alias("line_end"),
        F.lit("s").alias("symbol_name"), F.lit("file_summary").alias("record_type"), F.lit("x").alias("summary"), F.repeat(F.lit("x"), 100).alias("code_snippet"), (F.col("id") % 7 == 0).alias("is_stale"),
    )
    vectors = spark.range(40).select(F.col("id").cast("string").alias("code_record_id"), F.lit("m").alias("embedding_model"), F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("embedding_vector"))
    records.write.parquet(f"{tmp_path}/r")
    vectors.write.parquet(f"{tmp_path}/v")
    found = search(spark.read.parquet(f"{tmp_path}/r"), spark.read.parquet(f"{tmp_path}/v"), SearchQuery([1.0, 0.0], "m", k=3))
    assert [r["score"] > 0.99 for r in found.collect()] == [True] * 3
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = plan(search(spark.read.parquet(f"{tmp_path}/r"), spark.read.parquet(f"{tmp_path}/v"), SearchQuery([1.0, 0.0], "m", k=3)))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    below = text[text.index("TakeOrderedAndProject") :]
    assert "code_snippet" not in below and text[: text.index("TakeOrderedAndProject")].count("BroadcastHashJoin") == 1


def test_ask_reads_the_parts_it_needs(spark, tmp_path):
    e, stores = HashEmbedder(), Store(spark, str(tmp_path / "store"))
    for name, branch in (("one", "main"), ("one", "dev"), ("two", "main")):
        root = tmp_path / name
        root.mkdir(exist_ok=True)
        (root / "A.cs").write_text(f"namespace {name.title()}{branch.title()}; class A {{ void M() {{ }} }}")
        services.scan(stores, F_.load_path(str(root), branch), e)
    folders = lambda df: {re.search(r"/(v-\w+)/", f)[1] for f in df.inputFiles()}
    every = folders(stores.table("code_record"))
    one, dev, both = folders(stores.table("code_record", repositories=["one"])), folders(stores.table("code_record", branch="dev")), folders(stores.table("code_record", repositories=["one"], branch="dev"))
    assert len(every) == 3 and len(one) == 2 and dev == both and len(dev) == 1 and dev < one
    found = services.ask(stores, "class A", e, SearchQuery((), repositories=["two"], branch="main"))
    assert {r["repository_name"] for r in found.collect()} == {"two"}
    read = {f for f in found.inputFiles() if "/code_" in f}
    assert {re.search(r"/(v-\w+)/", f)[1] for f in read if "/code_record/" in f} == folders(stores.table("code_record", repositories=["two"]))
    assert services.ask(stores, "x", e, SearchQuery((), repositories=["none"])).count() == 0


def test_partitions_are_pruned_by_repository_and_branch(spark, tmp_path):
    hit = ("commit_sha", "file_path", "symbol_name", "record_type", "summary", "code_snippet")
    records = spark.range(60).select(
        F.col("id").cast("string").alias("id"), (F.col("id") % 3).cast("string").alias("repository_name"), F.when(F.col("id") % 2 == 0, "main").otherwise("dev").alias("branch"), *[F.lit("x").alias(c) for c in hit], F.lit(1).alias("line_start"), F.lit(1).alias("line_end"), F.lit(False).alias("is_stale")
    )
    records.write.partitionBy("repository_name", "branch").parquet(f"{tmp_path}/r")
    vectors = spark.range(60).select(F.col("id").cast("string").alias("code_record_id"), F.lit("m").alias("embedding_model"), F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("embedding_vector"))
    found = search(spark.read.option("recursiveFileLookup", "false").parquet(f"{tmp_path}/r"), vectors, SearchQuery([1.0, 0.0], "m", ["1"], "dev", k=3))
    filters = re.findall(r"PartitionFilters: \[(.*?)\], PushedFilters", plan(found))
    assert filters and all("repository_name" in f and "branch" in f for f in filters)
    assert {(r["repository_name"], r["branch"]) for r in found.collect()} == {(1, "dev")}  # partition values are typed by Spark


def test_several_values_an_option():
    args = cli.parser().parse_args(["ask", "why", "--repo", "a", "b", "--record-type", "file_summary", "class_summary", "--repo", "c"])
    assert args.repo == ["a", "b", "c"] and args.record_type == ["file_summary", "class_summary"]
    assert cli.parser().parse_args(["scan", "--path", "p", "--search", "x", "y"]).search == ["x", "y"]


# -- batches --------------------------------------------------------------------------------------------------------


def test_batches_of_a_source_with_most_rows(spark):
    rng = random.Random(2)
    rows = [(i % 1500, "hot" if i % 10 else rng.choice(["a", "b", None]), rng.choice([None, *range(900)])) for i in range(3000)]
    df = spark.createDataFrame(rows, "id int, source string, at int")
    got = changes.batched(df, 16, ["at", "id"], ["source"])
    for text in (plan(got), got._jdf.queryExecution().optimizedPlan().toString()):
        for window in re.findall(r"Window \[.*?\]\s*,\s*\[(.*?)\]", text):
            assert "__range" in window or "__n" in text  # rows meet those of their range alone; sums of ranges those of their key
    parts = {}
    for r in got.collect():
        parts.setdefault(r["source"], []).append(r)
    assert sum(map(len, parts.values())) == 3000
    for mine in parts.values():
        key = lambda r: (r["at"] is not None, r["at"] or 0, r["id"])
        want = [i // 16 for i in range(len(mine))]
        mine.sort(key=lambda r: (key(r), r["batch"]))
        assert [r["batch"] for r in mine] == want
    assert changes.batched(df.where("false"), 16, ["at"]).count() == 0
    ranges = shared.with_positions(df, ["at"], [], "p").agg(F.max("p").alias("m"), F.countDistinct("p").alias("n")).first()
    assert (ranges["m"], ranges["n"]) == (2999, 3000)
    with pytest.raises(ValueError, match="at least one"):
        changes.batched(df, 0, ["id"])


def test_a_hot_source_is_many_tasks_work(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        df = spark.range(4000).select("id", F.when(F.col("id") % 10 == 0, "cold").otherwise("hot").alias("source"))
        folder_rows = df.withColumn("t", F.xxhash64("id")).repartitionByRange(16, "source", "id", "t").groupBy(F.spark_partition_id().alias("p")).agg(F.count_if(F.col("source") == "hot").alias("n"))
        sizes = [r["n"] for r in folder_rows.collect()]
        assert max(sizes) < 600 and sum(n > 0 for n in sizes) >= 12  # as with_positions deals them
        assert shared.with_positions(df, ["id"], ["source"]).where("source = 'hot'").agg(F.max("position")).first()[0] == 3599
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


# -- the filter of keys ---------------------------------------------------------------------------------------------


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(-5, 40)), st.one_of(st.none(), st.text("ab", max_size=2))), max_size=60), st.lists(st.tuples(st.integers(-5, 40), st.one_of(st.none(), st.text("ab", max_size=2))), max_size=60))
def test_a_key_that_was_added_is_found(spark, old, new):
    schema = "a int, b string"
    have, more = spark.createDataFrame(old, schema), spark.createDataFrame(new, schema)
    kept = bloom.bloom_filter(have, ["a", "b"], 256)
    marked = more.crossJoin(F.broadcast(kept)).select("a", "b", bloom.possible(F.col("words"), [F.col("a"), F.col("b")]).alias("may")).collect()
    keys = {k for k in old if None not in k}
    assert all(r["may"] for r in marked if (r["a"], r["b"]) in keys)
    assert not any(r["may"] for r in marked if r["b"] is None)  # equals none
    order = lambda rows: sorted(rows, key=str)
    assert order(tuple(r) for r in bloom.insert_if_absent(have, more, ["a", "b"], kept).collect()) == order(tuple(r) for r in changes.insert_if_absent(have, more, ["a", "b"]).collect())


def test_false_positives_are_as_few_as_said(spark):
    old, new = spark.range(20_000).select(F.col("id").alias("k")), spark.range(20_000, 80_000).select(F.col("id").alias("k"))
    kept = bloom.bloom_filter(old, ["k"], 1 << 17)
    some = bloom.joined(bloom.bloom_filter(old.where("k < 9000"), ["k"], 1 << 17), bloom.bloom_filter(old.where("k >= 9000"), ["k"], 1 << 17))
    assert some.first()["words"] == kept.first()["words"] and len(kept.first()["words"]) == 2048
    found = new.crossJoin(F.broadcast(kept)).where(bloom.possible(F.col("words"), [F.col("k")])).count() / 60_000
    assert found == pytest.approx(bloom.false_positive_rate(20_000, 1 << 17), rel=0.15)
    with pytest.raises(ValueError, match="64"):
        bloom.bloom_filter(old, ["k"], 100)


# -- the cache of vectors -------------------------------------------------------------------------------------------


class Noted(HashEmbedder):
    """Writes each text that it is asked for to a file of its own."""

    def __init__(self, folder, fails=False):
        super().__init__()
        self.folder, self.fails = str(folder), fails

    def embed(self, texts):
        import uuid

        with open(f"{self.folder}/{uuid.uuid4().hex}", "w") as f:
            json.dump(list(texts), f)
        if self.fails:
            raise EmbeddingError("no")
        return super().embed(texts)


def asked(folder):
    return [t for p in folder.iterdir() for t in json.loads(p.read_text())]


def test_no_text_is_sent_twice(spark, tmp_path):
    log, tree = tmp_path / "log", tmp_path / "tree"
    log.mkdir()
    tree.mkdir()
    (tree / "A.cs").write_text("namespace N; class A { void M() { } void P() { } }")
    store, e = Store(spark, str(tmp_path / "store")), Noted(log)
    first = services.scan(store, F_.load_path(str(tree), "main"), e)
    sent = asked(log)
    assert len(sent) == len(set(sent)) == first.embeddings_created > 2
    job = store.start_job("x", "main", "y")
    part = store.part("tree", "main")
    store.write("code_embedding", store.table("code_embedding", part).where("false"), part)  # as if a run were lost before its vectors were stored
    records = store.table("code_record", part)
    again = embed_cached(records, e, f"{store.root}/_embedded")
    assert again.where("embedding_vector is not null").count() == records.count() and len(asked(log)) == len(sent)
    store.finish_job(job, "completed")
    other = Noted(log)
    object.__setattr__(other, "version", "2")  # another model's vectors are others
    embed_cached(records, other, f"{store.root}/_embedded")
    assert len(asked(log)) == 2 * len(sent)


def test_failed_texts_are_asked_for_again(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    schema = "id string, repository_name string, branch string, commit_sha string, file_path string, line_start int, line_end int, record_type string, namespace string, class_name string, method_name string, symbol_name string, summary string, code_snippet string"
    row = ("r", "main", "c", "f.cs", 1, 1, "file_summary", None, None, None, "s", "x", "code")
    records = spark.createDataFrame([("1", *row), ("2", *row)], schema)
    lost = embed_cached(records, Noted(log, fails=True), f"{tmp_path}/cache", retries=0)
    assert [r["embedding_vector"] for r in lost.collect()] == [None, None]
    made = embed_cached(records, Noted(log), f"{tmp_path}/cache", retries=0)
    assert made.where("embedding_vector is not null").count() == 2 and len(asked(log)) == 2  # one text, failed once and sent once
    assert embed_cached(records.where("false"), Noted(log), f"{tmp_path}/cache").count() == 0
