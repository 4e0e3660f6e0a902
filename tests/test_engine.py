"""Scanning, storing, searching and the commands, end to end on a small tree."""

import json
import urllib.error

import pytest
from pyspark.sql import functions as F

from quarry import cli
from quarry.functions.redact import MARK
from quarry.operators import changes
from quarry.operators.embed import EmbeddingError, HashEmbedder, HttpEmbedder, batches, with_retries
from quarry.operators.search import SearchQuery, nearest, search
from quarry.operators.store import Store
from quarry.operators.terms import term_tallies
from quarry.plans import services
from quarry.plans.scan import Counters, ScanContext, extracted, records
from quarry.sources import files as F_
from quarry.sources.config_files import env_rows, json_keys, parse_project, solution_projects
from quarry.sources.settings import Settings, SettingsError, load_settings

CTX = ScanContext("r1", "j1", "test-repo", "main", "abc1234")
TREE = {
    "Demo.csproj": '<Project Sdk="Microsoft.NET.Sdk"><PropertyGroup><TargetFramework>net8.0</TargetFramework><RootNamespace>Demo</RootNamespace></PropertyGroup><ItemGroup><PackageReference Include="Npgsql" Version="8.0.0" /></ItemGroup></Project>',
    "demo.sln": 'Project("{A}") = "Demo", "Demo\\Demo.csproj", "{B}"\nEndProject\n',
    "src/Foo.cs": "using System;\nusing Acme.Workflow;\nnamespace Acme;\npublic class Foo { public int M() => 1; }\n",
    "src/A.g.cs": "class Gen {}",
    "bin/Garbage.cs": "class Garbage {}",
    "Big.cs": "// " + "x" * 600 * 1024,
    "README.md": "# hello",
    "tests/FooTests.cs": "using Xunit;\npublic class FooTests { [Fact] public void Works() { } }\n",
    "appsettings.json": '{"FeatureFlags":{"EnableNewWorkflow":true}}',
    ".env": "API_KEY=ghp_" + "a" * 40 + "\n# c\n",
    "src/Secret.cs": 'class S { string ConnectionString = "Host=db;Password=hunter2"; }',
    "src/Unsafe.cs": 'class U { void M() { var msg = $"password is {password}"; } }',
    "src/Terms.cs": '\nvar x = "MyFlag"; // MyFlag\nMyFlag();\n',
}


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "test-repo"
    for name, content in TREE.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(content.encode())
    (root / "bad.cs").write_bytes(b"class \xff\xfe {}")
    return root


def test_scan_rows(spark, tree):
    files = F_.scan_files(spark, str(tree)).cache()
    assert {r["path"] for r in files.select("path").collect()} == {*TREE, "bad.cs"} - {"bin/Garbage.cs", "Big.cs"}
    rows = extracted(files, ["MyFlag", "API_KEY"]).cache()
    by = {}
    for r in rows.collect():
        by.setdefault((r["path"], r["record_type"]), []).append(r)
    assert not [k for k in by if k[0] in ("src/A.g.cs", "README.md", "bad.cs")]
    project = by["Demo.csproj", "file_summary"][0]
    assert project["symbol_name"] == "Demo" and json.loads(project["metadata_json"])["package_references"] == [{"name": "Npgsql", "version": "8.0.0"}]
    assert project["code_snippet"].startswith("Project: Demo\nSDK: Microsoft.NET.Sdk\nTargetFrameworks: net8.0\nRootNamespace: Demo\nNullable: disable\n")
    assert project["summary"] == "Project Demo (net8.0) — 1 package ref(s), 0 project ref(s)"
    solution = by["demo.sln", "file_summary"][0]
    assert solution["code_snippet"] == "Solution: demo\nProjects:\n  - Demo/Demo.csproj" and solution["summary"] == "Solution demo with 1 project(s)"
    foo = by["src/Foo.cs", "file_summary"][0]
    assert json.loads(foo["metadata_json"])["using_directives"] == ["System", "Acme.Workflow"] and foo["code_snippet"] == "File: src/Foo.cs\nNamespaces: Acme\nTop-level types: Foo\n"
    assert [r["symbol_name"] for r in by["src/Foo.cs", "method_summary"]] == ["Acme.Foo.M"]
    test = by["tests/FooTests.cs", "test_reference"][0]
    assert test["is_test_code"] and json.loads(test["metadata_json"])["test_framework"] == "xunit" and test["summary"] == "test FooTests.Works"
    flag = by["appsettings.json", "configuration_reference"][0]
    assert (flag["symbol_name"], flag["code_snippet"]) == ("EnableNewWorkflow", "EnableNewWorkflow=true")
    assert by[".env", "configuration_reference"][0]["code_snippet"] == f"API_KEY={MARK}"
    assert any(MARK in r["code_snippet"] for r in by["src/Secret.cs", "method_summary"])
    terms = {json.loads(r["metadata_json"])["match_kind"]: r for r in by["src/Terms.cs", "search_term_match"]}
    assert set(terms) == {"string_literal", "comment", "identifier"} and {json.loads(r["metadata_json"])["hit_count"] for r in terms.values()} == {2}
    assert {r["line_start"] for r in terms.values()} == {2}
    counting = Counters()
    assert counting.counted(files, ["MyFlag", "API_KEY"]).count() == rows.count()
    c = counting.result()
    assert c["redaction_failed"] == 1 and c["records_failed"] == 1 and c["files_scanned"] == len(TREE) - 2 + 1
    made = records(rows, CTX).cache()
    assert made.where("record_type = 'search_term_match'").count() == 1  # one key, the first by order
    assert made.count() == made.select("id").distinct().count() and made.where("embedding_status <> 'pending' or is_stale").count() == 0
    assert F_.scan_files(spark, str(tree / "none")).count() == 0


def test_store_and_services(spark, tree, tmp_path, capsys):
    store = Store(spark, str(tmp_path / "store"))
    repo = F_.load_path(str(tree))
    assert (repo.name, repo.branch, repo.commit_sha) == ("test-repo", "main", "0000000")
    e = HashEmbedder()
    first = services.scan(store, repo, e, terms=["MyFlag"])
    assert first.records_inserted == first.embeddings_created > 10 and first.embeddings_failed == 0 and first.redaction_failed == 1
    assert services.scan(store, repo, e).already_indexed
    assert store.migrate() == [] and store.repository("test-repo")["commit_sha"] == "0000000" and store.repository("none") is None
    again = services.scan(store, repo, e, terms=["MyFlag"], force=True)
    assert again.records_inserted == 0 and store.table("code_record").where("is_stale").count() == 0
    (tree / "src/Foo.cs").write_text("namespace Acme; class Bar { }")
    services.scan(store, repo, e, force=True)
    stale = {r["symbol_name"] for r in store.table("code_record").where("is_stale").select("symbol_name").collect()}
    assert {"Acme.Foo", "Acme.Foo.M", "MyFlag"} <= stale and "src/Foo.cs" not in stale
    hits = services.ask(store, "method Works of FooTests", e, SearchQuery((), k=3)).collect()
    assert len(hits) == 3 and hits[0]["score"] >= hits[1]["score"] and not {h["symbol_name"] for h in hits} & stale
    assert services.ask(store, "x", e, SearchQuery((), branch="other")).count() == 0
    with pytest.raises(ValueError, match="question"):
        services.ask(store, " ", e)
    assert "Question: q" in cli.hits_text("q", hits) and list(json.loads(cli.hits_json(hits))[0]) == list(cli.JSON_KEYS)
    assert "0000000" in cli.scan_summary(first) and "already indexed" in cli.scan_summary(services.ScanResult(repo, already_indexed=True))
    assert cli.main(["ask", "Foo", "--record-type", "nope", "--store", "s"]) == cli.USAGE and cli.main(["scan", "--store", "s"]) == cli.USAGE


class Failing(HashEmbedder):
    def embed(self, texts):
        raise EmbeddingError("no")


def test_failed_embeddings(spark, tree, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    settings = Settings()
    settings.embedding.max_retries = 0
    got = services.scan(store, F_.load_path(str(tree), "dev"), Failing(), settings)
    assert got.embeddings_created == 0 and got.embeddings_failed == got.records_inserted
    assert {r[0] for r in store.table("code_record").select("embedding_status").distinct().collect()} == {"failed"}
    assert services.ask(store, "x", Failing()) is None


def test_streaming_ingest(spark, tmp_path):
    from quarry.streaming.ingest import stream_files

    store = Store(spark, str(tmp_path / "store"))
    rows = [("a.cs", 10, "class A { }"), ("b.cs", 10, "class B { void M() { } }")]
    spark.createDataFrame(rows, "path string, length long, content string").write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        stream_files(store, str(tmp_path / "in"), CTX, str(tmp_path / "check")).awaitTermination(120)
        assert {r[0] for r in store.table("code_record").select("symbol_name").collect()} == {"a.cs", "b.cs", "A", "B", "B.M"}
    (tmp_path / "more").mkdir()


def test_search(spark):
    rec = spark.createDataFrame(
        [(i, "r" + str(i % 2), "main", "c", "p", 1, 1, None, "file_summary", "", "", i == 3) for i in range(6)],
        "id int, repository_name string, branch string, commit_sha string, file_path string, line_start int, line_end int, symbol_name string, record_type string, summary string, code_snippet string, is_stale boolean",
    )
    vectors = {0: [1.0, 0.0], 1: [0.6, 0.8], 2: [0.0, 1.0], 3: [1.0, 0.0], 4: [0.0, 0.0], 5: [1.0, 0.1]}
    emb = spark.createDataFrame([(i, "m", v) for i, v in vectors.items()] + [(5, "n", [1.0, 0.0])], "code_record_id int, embedding_model string, embedding_vector array<float>")
    def ids(q):
        return [round(r["score"], 3) for r in search(rec, emb, q).collect()]
    assert ids(SearchQuery([1.0, 0.0], "m")) == [1.0, 0.995, 0.6, 0.0]  # stale, zero and other models are out
    assert ids(SearchQuery([1.0, 0.0], "m", include_stale=True, k=2)) == [1.0, 1.0]
    assert ids(SearchQuery([1.0, 0.0], "m", include_other_models=True, k=0)) == [1.0, 1.0, 0.995, 0.6, 0.0]
    assert ids(SearchQuery([1.0, 0.0], "m", repositories=["r1"])) == [0.995, 0.6]
    assert ids(SearchQuery([1.0, 0.0], "m", k=2, min_score=0.996)) == [1.0]
    assert ids(SearchQuery([1.0, 0.0], "m", record_types=["test_reference"])) == []
    with pytest.raises(ValueError, match="record type"):
        SearchQuery([1.0], record_types=["x"])
    plan = nearest(rec, F.lit(1.0), "id")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_changes(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, None, "y")], "k int, n string, v string")
    new = spark.createDataFrame([(1, "a", "z"), (2, None, "w"), (3, "c", "q")], "k int, n string, v string")
    assert sorted((r.k, r.v) for r in changes.insert_if_absent(old, new, ("k", "n")).collect()) == [(2, "w"), (3, "q")]
    assert sorted((r.k, r.n, r.v) for r in changes.upsert(old, new.where("k <> 2").withColumn("n", F.lit("N")), ["k"], ["v"]).collect()) == [(1, "a", "z"), (2, None, "y"), (3, "N", "q")]
    with pytest.raises(ValueError, match="batch"):
        changes.batch_numbers(F.lit(1), 0)


def test_terms(spark):
    files = spark.createDataFrame([("p", "/// MyFlag doc\nx myflag\nMyFlagX = MyFlag;"), ("q", "")], "path string, content string")
    got = {(r.match_kind, r.hit_count, r.first_line) for r in term_tallies(files, ["MyFlag"]).collect()}
    assert got == {("string_literal", 3, 1), ("comment", 2, 1), ("xml_doc", 1, 1), ("identifier", 2, 1)}
    assert term_tallies(files, []).count() == 0


def test_config(spark):
    keys = json_keys('{"a":{"feature_x":{"on":false,"n":1.50,"deep":[{"k":1e3},5]}},"plain":1,"T":"v","T":null}', False, ["T"])
    assert keys == [("on", "false", "$.a.feature_x.on"), ("n", "1.50", "$.a.feature_x.n"), ("k", "1e3", "$.a.feature_x.deep[0].k"), ("T", "v", "$.T"), ("T", "null", "$.T")]
    assert json_keys("{", True, []) == json_keys('{"a":1} x', True, []) == json_keys("NaN", True, []) == json_keys("", True, []) == []
    assert json_keys("[" * 100000, True, []) == []
    files = spark.createDataFrame([(".env", "A=1\n\n#x\n B = 2\r\n=3\nC")], "path string, content string")
    assert [(r.key, r.line_start, r.value) for r in env_rows(files, []).orderBy("ordinal").collect()] == [("A", 1, None), ("B", 4, None)]
    assert [r.key for r in env_rows(files, ["B"]).collect()] == ["B"]
    assert parse_project("<x/>") is None and parse_project("<Project") is None and parse_project(None) is None
    p = parse_project('<Project><PropertyGroup><TargetFramework> </TargetFramework><TargetFrameworks>a; b;</TargetFrameworks></PropertyGroup><ItemGroup><PackageReference Update="U"/><ProjectReference Include="x.csproj"/></ItemGroup></Project>')
    assert p[1] == ["a", "b"] and p[7] == [("U", None)] and p[8] == ["x.csproj"]
    sln = spark.createDataFrame([('Project("{1}") = "A", "A\\A.csproj", "{2}"\nProject("{1}") = "F", "F", "{3}"',), ("  \n",)], "c string")
    assert [r[0] for r in sln.select(solution_projects(F.col("c"))).collect()] == [["A/A.csproj"], None]


def test_settings(tmp_path):
    path = tmp_path / "c.yml"
    path.write_text("embedding:\n  batchSize: 7\n  unknown: 1\nscanner:\n  maxFileSizeKb: 9\n  ignorePaths: [x]\n")
    s = load_settings(str(path), {"EMBEDDING_MODEL": "m", "EMBEDDING_MODEL_DIMENSION": "8", "EMBEDDING_ENDPOINT": " "})
    assert (s.embedding.batch_size, s.scanner.max_file_size_kb, s.scanner.ignore_paths, s.embedding.model, s.embedding.dimension, s.embedding.endpoint) == (7, 9, ["x"], "m", 8, None)
    assert load_settings(str(tmp_path / "none.yml"), {}) == Settings()
    for bad in ("git:\n  token: abc\n", "embedding: [", "embedding:\n  dimension: 0\n", "embedding: 3\n"):
        path.write_text(bad)
        with pytest.raises(SettingsError):
            load_settings(str(path), {})


def test_embedding_service():
    def reply(data):
        return HttpEmbedder("http://h", "m", 2, "k", send=lambda r: json.dumps(data).encode())

    assert reply({}).embed([]) == []
    assert reply({"data": [{"index": 1, "embedding": [3, 4]}, {"index": 0, "embedding": [1, 2]}]}).embed(["a", "b"]) == [[1, 2], [3, 4]]
    for bad in ({"data": []}, {"data": [{"index": 0, "embedding": [1]}]}, {}):
        with pytest.raises(EmbeddingError):
            reply(bad).embed(["a"])

    def fails(_):
        raise urllib.error.URLError("down")

    with pytest.raises(EmbeddingError):
        HttpEmbedder("http://h", "m", 2, send=fails).embed(["a"])


def test_retries_and_batches():
    waits, calls = [], []

    def call():
        calls.append(1)
        if len(calls) < 4:
            raise EmbeddingError("x")
        return ["ok"]

    assert with_retries(call, 5, 2.0, waits.append) == ["ok"] and waits == [2.0, 4.0, 8.0]
    with pytest.raises(EmbeddingError):
        with_retries(lambda: Failing().embed(["a"]), 1, 0, waits.append)
    with pytest.raises(KeyError):
        with_retries(lambda: {}["x"], 3, 0, waits.append)
    assert [list(b) for b in batches([1, 2, 3], 2)] == [[1, 2], [3]] and list(batches([], 2)) == []
    with pytest.raises(ValueError, match="batch"):
        list(batches([1], 0))


def test_git_head(tmp_path):
    (tmp_path / ".git/refs/heads").mkdir(parents=True)
    (tmp_path / ".git/HEAD").write_text("ref: refs/heads/dev\n")
    (tmp_path / ".git/refs/heads/dev").write_text("a" * 40 + "\n")
    r = F_.load(path=str(tmp_path))
    assert (r.branch, r.commit_sha) == ("dev", "a" * 40)
    assert F_.load(url="https://h/o/x.git", clone=lambda u, b: str(tmp_path)).name == "x"
    with pytest.raises(FileNotFoundError):
        F_.load_path(str(tmp_path / "no"))
    with pytest.raises(ValueError, match="path or a url"):
        F_.load()


def test_scan_of_documents_reads_whole_texts(spark, tmp_path):
    import re

    from quarry.plans.catalogue import scan_documents

    far = "lorem ipsum dolor \n" * 400
    texts = ["short", far + "at last The end", far, 'He said "no" \\ the way\r\nhome', far + "path C:\\x\\ \"quoted\nand the rest\"", far + "theory and bathe", "", None, "}} /* the", far + "} class X { public void Y() { } } // the"]
    spark.createDataFrame([(i, t, "en", "ab"[i % 2], 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.record_type: r.n for r in scan_documents(spark, str(tmp_path)).collect()}
    known = [t for t in texts if t is not None]
    holding = sum(bool(re.search(r"\bthe\b", t, re.IGNORECASE)) for t in known)
    assert holding == 5
    assert got == {"file_summary": len(known), "class_summary": len(known), "method_summary": len(known), "search_term_match": holding}
