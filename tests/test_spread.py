"""Narrow tables whose rows are long work are dealt to tasks that grow in number with them."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quarry.functions.classify import is_generated, is_test
from quarry.functions.redact import _redacted, redact
from quarry.plans import catalogue, catalogue_sources
from quarry.plans.scan import extracted
from quarry.sources.readers import read


def narrow(spark, tmp_path, name, key, n):
    spark.range(n).select(F.col("id").alias(key)).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_csharp_files_of_one_split_are_many_tasks(spark, tmp_path):
    files = catalogue_sources._files(spark, narrow(spark, tmp_path, "customer", "c_custkey", 9_000))
    sizes = [r["count"] for r in files.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(sizes) == 5 and max(sizes) <= 2_200 and sum(sizes) == 9_000


@pytest.mark.parametrize("n", [0, 7])
def test_few_files_are_one_task(spark, tmp_path, n):
    assert catalogue_sources._files(spark, narrow(spark, tmp_path, "customer", "c_custkey", n)).count() == n


def test_texts_that_no_pattern_can_match_are_told_by_fixed_words(spark):
    """The words say the same as the patterns, for letters that match ASCII's in any case too."""
    texts = [
        None, "", "plain", "PASSWORD = x", "paſſword: y", "toKen=z", "apıkey = q", "APİ_KEY=v", "api-key: 'k'", "CONNECTION-STRING=a", "connectionstring : b", "Private_Key=c", "client_secret=d",
        "a eyJhbGci.eyJzdWI.SflKxw b", "ghp_" + "a" * 36, "github_pat_" + "b" * 20, "AKIA" + "A" * 16, "-----BEGIN RSA PRIVATE KEY-----\nMII\n-----END RSA PRIVATE KEY-----", '$"{token}"', '$"{apıkey}"', '$"{plain}"', "rapid keys",
    ]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("t", redact(F.col("t")).alias("a"), _redacted(F.coalesce("t", F.lit(""))).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in rows) and sum(r["b"]["status"] != "no_match" for r in rows) >= 16


def test_a_tree_is_written_by_many_tasks(spark, tmp_path):
    """Each task names its files by its number."""
    found = catalogue_sources.scanned_tree(spark, narrow(spark, tmp_path, "supplier", "s_suppkey", 300))
    assert found.count() == 300 - sum(k % 8 >= 5 and len(f"bom{k}") + k % 8 * 200 >= 1024 for k in range(300)) + 30
    base = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    written = [p.name.split("-")[1] for p in max(Path(base).glob("tree-*"), key=lambda p: p.stat().st_mtime).glob("text/key=*/part-*")]
    assert len(written) == 300 and len(set(written)) == 3


def test_filters_on_made_files_stay_behind_the_dealing(spark, tmp_path):
    """Below the repartition only keys are read: the files are neither made nor filtered there."""
    found = catalogue_sources.csharp_types(spark, narrow(spark, tmp_path, "customer", "c_custkey", 9_000))
    above, below = found._jdf.queryExecution().optimizedPlan().toString().split("Repartition ")
    assert "Filter" in above and "replace(" in above and "Filter" not in below and "replace(" not in below


def test_wanted_kinds_reach_the_reader(spark, tmp_path):
    rows = catalogue_sources._rows(catalogue_sources._files(spark, narrow(spark, tmp_path, "customer", "c_custkey", 7)), kinds=("constructor",)).select("key", "record_type", "method_name").collect()
    own, tests = [(k, "method_summary", ".ctor") for k in range(7)], [(k, "test_reference", ".ctor") for k in range(0, 7, 3)]
    assert sorted(tuple(r) for r in rows) == sorted(own + tests)


def test_made_texts_and_their_kind_are_made_once(spark, tmp_path):
    """Filters and columns that ask for a file's text or kind take it as it was made."""
    plan = catalogue_sources.csharp_properties(spark, narrow(spark, tmp_path, "customer", "c_custkey", 7))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("public sealed class C@") == 1 and plan.count("<auto-generated") == 1


@pytest.mark.parametrize("terms", [(), ("M",)])
def test_texts_come_back_from_the_reader_where_they_are_asked_for(spark, terms):
    files = spark.createDataFrame([("a.cs", "class A { void M() { } }", "production", "csharp"), ("a.env", "K=v", "configuration", None)], "path string, content string, kind string, reader string")
    found = {r["path"]: r for r in read(files, terms).collect()}
    assert found["a.env"]["content"] == "K=v" and (found["a.cs"]["content"] is None) == (not terms) and [s["symbol_name"] for s in found["a.cs"]["symbols"]] == ["a.cs", "A", "A.M"]


def test_marks_are_found_in_any_case(spark):
    texts = ["// <Auto-Generated/>", "// <AUTO-generated", "<auto generated", "[fAcT] x", "[TESTmethod]", "[Fac t]", "[Test", "\u0130[test]", None, "", "list<a>"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", is_generated(F.lit("a.cs"), F.col("t")).alias("g"), is_test(F.lit("a.cs"), F.col("t")).alias("x")).collect()
    assert {r["i"] for r in rows if r["g"]} == {0, 1} and {r["i"] for r in rows if r["x"]} == {3, 4, 7}


def test_who_asks_for_declarations_gets_no_other_files_planned(spark, tmp_path):
    """Projects, solutions, configuration and search terms aren't in the plan, and none of their records are made."""
    plan = catalogue_sources.csharp_delegates(spark, narrow(spark, tmp_path, "customer", "c_custkey", 7))._jdf.queryExecution().optimizedPlan().toString()
    assert not any(x in plan for x in ("config key", "package ref(s)", "Solution: ", "search_term_match"))
    files = spark.createDataFrame([("a.cs", "delegate void D();"), ("appsettings.json", '{"k": 1}'), ("a.sln", 'Project("{A}") = "App", "App.csproj", "{B}"')], "path string, content string")
    files = files.withColumn("length", F.octet_length("content").cast("long"))
    assert [r["symbol_name"] for r in extracted(files, kinds=("delegate",)).collect()] == ["D"] and extracted(files).count() == 4
    assert sorted((r["path"], r["record_type"]) for r in extracted(files, ("void",), ()).collect()) == [("a.cs", "search_term_match")] * 3


def test_documents_of_one_split_are_scanned_by_many_tasks(spark, tmp_path):
    """Texts are dealt before files are made of them, and each is made once."""
    spark.range(1_200).selectExpr("id as doc_id", "'web' as source", "concat('the ', id) as text").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    above, below = catalogue.scan_documents(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString().split("Repartition ")
    assert below.startswith("3, ") and "namespace Docs" not in below and above.count("namespace Docs") == 1
