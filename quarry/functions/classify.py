"""Paths and contents of files: what to ignore, what kind a file is, and matches of search terms. Column functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.text import slashes

#: Fixed values of the classification.
GENERATED_ENDS = (".g.cs", ".designer.cs", ".generated.cs")
CONFIG_EXTENSIONS = ("json", "yaml", "yml", "config", "xml", "env")
TEST_PATHS = ("/test/", "/tests/", ".tests", ".test", "test/", "tests/")
TEST_MARKS = ("[fact]", "[theory]", "[test]", "[testmethod]")
IGNORED = ("bin", "obj", ".git", "node_modules", "packages")


def _any(tests: Sequence[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def _holds(content: Column, marks: Sequence[str]) -> Column:
    """Whether the content holds one of the marks, in any case. To put whole texts into lower case is long, so only those are that hold
    how a mark begins; beyond ASCII no letter's lower case is one of these."""
    text = F.coalesce(content, F.lit(""))
    begins = sorted({x for m in marks for x in (m[:2], m[:2].upper())})
    return _any([text.contains(b) for b in begins]) & _any([F.lower(text).contains(m) for m in marks])


def is_ignored(path: Column, ignore: Sequence[str] = IGNORED) -> Column:
    """Whether the path holds one of the given paths as whole segments, in any case."""
    wanted = [p.replace("\\", "/").strip(" /").lower() for p in ignore]
    padded = F.concat(F.lit("/"), F.lower(slashes(path)), F.lit("/"))
    return _any([padded.contains(f"/{p}/") for p in wanted if p])


def extension(path: Column) -> Column:
    """The lower-case extension of the last segment, without the dot."""
    return F.lower(F.regexp_extract(slashes(path), r"\.([^./]*)$", 1))


def is_generated(path: Column, content: Column) -> Column:
    p = F.lower(slashes(path))
    return _any([p.endswith(e) for e in GENERATED_ENDS]) | p.contains("/generated/") | _holds(content, ("<auto-generated",))


def is_config(path: Column) -> Column:
    return extension(path).isin(*CONFIG_EXTENSIONS) | is_app_settings(path)


def is_test(path: Column, content: Column) -> Column:
    p = F.lower(slashes(path))
    named = p.endswith(".cs") & p.rlike(r"tests[^/]*(?:/|$)")
    return _any([p.contains(x) for x in TEST_PATHS]) | named | _holds(content, TEST_MARKS)


def file_kind(path: Column, content: Column) -> Column:
    """generated, configuration, test or production, the first that fits; an empty path is an error."""
    kind = F.when(is_generated(path, content), "generated").when(is_config(path), "configuration").when(is_test(path, content), "test").otherwise("production")
    return F.when(F.coalesce(F.trim(path), F.lit("")) == "", F.raise_error(F.lit("a path is required")).cast("string")).otherwise(kind)


def is_app_settings(path: Column) -> Column:
    return F.lower(path).contains("appsettings")


def is_feature_section(key: Column) -> Column:
    return key.rlike("(?i)feature|flag|toggle")


def test_framework(content: Column) -> Column:
    has = content.contains
    return (
        F.when(has("[Fact]") | has("[Theory]") | has("Xunit"), "xunit")
        .when(has("[Test]") | has("NUnit"), "nunit")
        .when(has("[TestMethod]") | has("VisualStudio.TestTools"), "mstest")
        .otherwise("unknown")
    )


def quoted(term: Column) -> Column:
    """The term as a literal in a pattern."""
    return F.regexp_replace(term, r"([\\\[\](){}.*+?^$|\-])", r"\\$1")


def word_match(text: Column, term: Column) -> Column:
    """Whether the term occurs between word boundaries, in any case."""
    return F.regexp_like(text, F.concat(F.lit(r"(?iuU)\b"), quoted(term), F.lit(r"\b")))


def identifier_match(text: Column, term: Column) -> Column:
    """Whether the term occurs as an identifier of its own, in the same case."""
    return F.regexp_like(text, F.concat(F.lit(r"(?<![\p{L}\p{Nd}_])"), quoted(term), F.lit(r"(?![\p{L}\p{Nd}_])")))


def repository_name(url: Column) -> Column:
    """The last part of a clone URL, less .git; `repository` if nothing is left."""
    name = F.regexp_replace(F.regexp_extract(F.rtrim(F.regexp_replace(url, r"/+$", "")), r"([^/:]*)$", 1), r"\.git$", "")
    return F.when(F.coalesce(name, F.lit("")) == "", "repository").otherwise(name)
