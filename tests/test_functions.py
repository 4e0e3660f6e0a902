"""Column functions on the cases of FIXTURES.md."""

import pytest
from pyspark.sql import functions as F

from quarry.functions import classify, text, tokens
from quarry.functions.redact import MARK, redact


def values(spark, rows, *columns):
    """Columns over rows (a list of tuples named a, b, ...), as a list of tuples, in order."""
    names = [chr(97 + i) for i in range(len(rows[0]))]
    schema = ", ".join(f"{n} {'int' if any(isinstance(r[i], int) for r in rows) else 'string'}" for i, n in enumerate(names))
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], f"k int, {schema}")
    out = df.select("k", *[c.alias(f"c{i}") for i, c in enumerate(columns)]).orderBy("k").collect()
    return [tuple(r)[1:] if len(columns) > 1 else r[1] for r in out]


def one(spark, value, column):
    return values(spark, [(value,)], column)[0]


def test_redaction(spark):
    cases = [
        ("var x = 42;", "var x = 42;", "no_match", []),
        ("", "", "no_match", []),
        (None, "", "no_match", []),
        ("password=hunter2", f"password={MARK}", "redacted", ["key_value:password"]),
        ('Secret = "abc123"', f'Secret="{MARK}"', "redacted", ["key_value:secret"]),
        ('api_key: "deadbeef"', f'api_key="{MARK}"', "redacted", ["key_value:api_key"]),
        ("ConnectionString=Host=db;Pwd=p", f"ConnectionString={MARK};Pwd=p", "redacted", ["key_value:connection_string"]),
        ("client_secret = 'mysecret'", f"client_secret='{MARK}'", "redacted", ["key_value:client_secret"]),
        ("id AKIA" + "A" * 16, f"id {MARK}", "redacted", ["aws_access_key"]),
        ("ghp_" + "a" * 40, MARK, "redacted", ["github_pat"]),
        ("eyJhbGciOi.eyJzdWIiOi.SflKxw", MARK, "redacted", ["jwt"]),
        ("-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----", MARK, "redacted", ["pem_private_key"]),
        ('$"the password is {password}"', '$"the password is {password}"', "failed", ["interpolated_secret"]),
        ("password=foo\ntoken=bar", f"password={MARK}\ntoken={MARK}", "redacted", ["key_value:password", "key_value:token"]),
    ]
    r = redact(F.col("a"))
    assert values(spark, [(c[0],) for c in cases], r["text"], r["status"], r["hits"]) == [c[1:] for c in cases]


@pytest.mark.parametrize(
    ("kind", "paths"),
    [
        ("generated", ["src/MyService.g.cs", "src/Form.Designer.cs", "obj/Debug/Thing.generated.cs", "project/generated/Out.cs", "appsettings.g.cs"]),
        ("configuration", ["appsettings.json", "config.yml", "settings.config", "Web.xml", ".env", "src/appsettings.test.json"]),
        ("test", ["tests/Foo.cs", "src/Acme.Tests/Bar.cs", "test/Foo.cs", "src/Service.Test/Foo.cs", "src\\test\\Foo.cs", "latest/Foo.cs"]),
        ("production", ["src/Domain/Customer.cs"]),
    ],
)
def test_kinds_by_path(spark, kind, paths):
    assert set(values(spark, [(p,) for p in paths], classify.file_kind(F.col("a"), F.lit("class A {}")))) == {kind}


def test_kinds_by_content(spark):
    kind = classify.file_kind(F.lit("src/Foo.cs"), F.col("a"))
    assert values(spark, [("[Fact]",), ("[Theory]",), ("[Test]",), ("[TestMethod]",), ("// <auto-generated />",)], kind) == ["test"] * 4 + ["generated"]
    with pytest.raises(Exception, match="path"):
        one(spark, "x", classify.file_kind(F.lit(""), F.col("a")))


def test_ignored(spark):
    paths = ["bin/Debug/foo.dll", "obj/temp.cs", ".git/HEAD", "src/bin/x.cs", "src\\obj\\thing.cs", "bin", "src/Service.cs", "README.md", "binx/file.cs"]
    assert values(spark, [(p,) for p in paths], classify.is_ignored(F.col("a"))) == [True] * 6 + [False] * 3


def test_repository_names(spark):
    urls = ["https://h/org/repo", "https://h/org/repo.git", "git@h:org/svc-a.git", ""]
    assert values(spark, [(u,) for u in urls], classify.repository_name(F.col("a"))) == ["repo", "repo", "svc-a", "repository"]


def test_tokens(spark):
    cases = {
        "PrePaidAccount": ["PrePaidAccount", "Pre", "Paid", "Account"],
        "XMLParser": ["XMLParser", "XML", "Parser"],
        "process-payment": ["process-payment", "process", "payment"],
        "Acme.Workflow.WorkflowService": ["Acme.Workflow.WorkflowService", "Acme", "Workflow", "WorkflowService", "Service"],
        "HttpV2Client": ["HttpV2Client", "Http", "V", "2", "Client"],
        "ABC": ["ABC"],
        "AccountAccount": ["AccountAccount", "Account"],
        " ": [],
    }
    assert values(spark, [(k,) for k in cases], tokens.split_identifier(F.col("a"))) == list(cases.values())
    stems = ["src/Service.cs", "a\\b.g.cs", ".env", "x/.env", "plain", "a/b."]
    assert values(spark, [(s,) for s in stems], tokens.file_stem(F.col("a"))) == ["Service", "b.g", ".env", ".env", "plain", "b"]


def test_lines_and_snippets(spark):
    assert one(spark, "a\r\nb\rc\nd", text.lines(F.col("a"))) == ["a", "b", "c", "d"]
    body = "\n".join(f"line {i};" for i in range(1, 501))
    got = values(spark, [(body, 2, 4), (body, 1, 500), ("a\nint c = 1;\nint d = 3 +", 1, 3), ("a;\nb;", -5, 999), ("a", 5, 9)], text.method_snippet(F.col("a"), F.col("b"), F.col("c")))
    assert got[0] == "line 2;\nline 3;\nline 4;"
    assert len(got[1].split("\n")) == 200
    assert got[2] == "a\nint c = 1;" and got[3] == "a;\nb;" and got[4] == ""
    assert len(one(spark, "\n".join(["x" * 200] * 30), text.method_snippet(F.col("a"), F.lit(1), F.lit(30))).encode()) <= 4096
    rows = "\n".join(map(str, range(1, 101)))
    at = values(spark, [(rows, 50), (rows, 1000), (rows, -3), ("", 1)], text.around_line(F.col("a"), F.col("b"), 2))
    assert at == ["48\n49\n50\n51\n52", "98\n99\n100", "1\n2\n3", ""]
    held = text.around_line(F.col("a"), F.lit(50), 100, (F.lit(45), F.lit(55)))
    assert one(spark, rows, held) == "\n".join(map(str, range(45, 56)))


def test_byte_limit(spark):
    def brute(s, n):
        raw = s.encode()
        if len(raw) <= n:
            return s
        while n and raw[n - 1] & 0xC0 == 0x80:
            n -= 1
        if n and raw[n - 1] & 0xC0 == 0xC0:
            n -= 1
        return raw[:n].decode()

    texts = ["abcñé", "abñzz", "日本語", "a😀b", "xxxxx", "é" * 5, "ab\x0c\x9f日"]
    for n in (1, 2, 3, 4, 5):
        assert values(spark, [(t,) for t in texts], text.truncate_bytes(F.col("a"), n)) == [brute(t, n) for t in texts]


def test_statement_end_and_formats(spark):
    assert values(spark, [("",), ("abc def",), ("a\nb",), ("a; b",), ("{ } x",)], text.statement_end(F.col("a"))) == ["", "abc def", "a\n", "a;", "{ }"]
    assert values(spark, [(0,), (45,), (75,)], text.duration(F.col("a"))) == ["0.0s", "45.0s", "1m 15s"]


def test_matches(spark):
    pairs = [("Foo bar", "Foo"), ("FooBar", "Foo"), ("_Foo", "Foo"), ("a.b", "a.b"), ("axb", "a.b"), ("x foo", "Foo")]
    assert values(spark, pairs, classify.identifier_match(F.col("a"), F.col("b"))) == [True, False, False, True, False, False]
    assert values(spark, pairs, classify.word_match(F.col("a"), F.col("b"))) == [True, False, False, True, False, True]
    assert values(spark, [("[Fact]",), ("[Test]",), ("[TestMethod]",), ("none",)], classify.test_framework(F.col("a"))) == ["xunit", "nunit", "mstest", "unknown"]
