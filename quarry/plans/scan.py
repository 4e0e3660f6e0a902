"""Scanning: files of a source tree to records, as one lazy plan."""

from __future__ import annotations

from collections.abc import Collection, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions.classify import extension, test_framework
from quarry.functions.redact import MARK, redact
from quarry.functions.text import around_line, file_summary, line_count
from quarry.functions.tokens import file_stem
from quarry.schemas import CODE_RECORD, RECORD_KEY
from quarry.shared import once
from quarry.sources.config_files import env_keys, project_snippet, solution_projects
from quarry.sources.files import classified
from quarry.sources.readers import FOUND, read

COLUMNS = ("record_type", "symbol_name", "symbol_kind", "namespace", "class_name", "method_name", "line_start", "line_end", "summary", "code_snippet", "metadata_json", "is_test_code")


@dataclass(frozen=True)
class ScanContext:
    repository_id: str
    scan_job_id: str
    repository_name: str
    branch: str
    commit_sha: str


def _json(**parts: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(n) for n, c in parts.items()]), {"ignoreNullFields": "false"})


def _none(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


#: Sections of a scan, by what reads them, and what an item of each holds.
PROJECT_FILE, SOLUTION, CONFIGURATION, CSHARP, TERM = SECTIONS = range(5)
_HOLDS = {PROJECT_FILE: ("project",), SOLUTION: ("solution",), CONFIGURATION: ("config",), CSHARP: ("symbol", "is_test"), TERM: ("hit", "match_kind", "hit_count")}
_ITEM = {
    "project": FOUND["project"], "solution": "array<string>", "config": FOUND["keys"][6:-1], "symbol": FOUND["symbols"][6:-1], "is_test": "boolean",
    "hit": "struct<ordinal:int,term:string,first_line:int,words:int,docs:int,names:int,snippet:string>", "match_kind": "string", "hit_count": "int",
}


def _sections(terms: Sequence[str], kinds: Collection[str] | None) -> Sequence[int]:
    """The sections that are asked for: with kinds only C# declarations, and terms where there are any."""
    return SECTIONS if kinds is None else (CSHARP, TERM) if terms else (CSHARP,)


def _items(files: DataFrame, terms: Sequence[str], kinds: Collection[str] | None = None) -> DataFrame:
    """(path, loc, in_test, framework, term_hits, section, ordinal, and of _ITEM what the sections hold): what each file (path, content, kind) holds, read once."""
    sections = _sections(terms, kinds)
    types = {n: _ITEM[n] for section in sections for n in _HOLDS[section]}
    end, path, text = extension(F.col("path")), F.col("path"), F.col("content")
    plain = ~end.isin("csproj", "sln")
    configuration = plain & (F.col("kind") == "configuration")
    reader = F.when(end == "csproj", "project").when(configuration & (end == "json"), "json").when(plain & ~configuration & (end == "cs"), "csharp")
    in_test = F.col("kind") == "test"
    files = files.select("path", "content", "kind", reader.alias("reader")).select("*", F.when((F.col("reader") == "csharp") & in_test, test_framework(text)).alias("framework"))
    held = read(files, terms, kinds)
    held = held.select(
        "path", F.when(end.isin("csproj", "sln"), line_count(text)).alias("loc"), in_test.alias("in_test"), "framework", "term_hits", "project", "keys", "symbols",
        F.when(F.lower("path").endswith(".sln"), solution_projects(text)).alias("solution"), F.when(configuration & (end == "env"), env_keys(text, terms)).alias("env"),
        F.transform("hits", lambda h: F.struct(*[h[n] for n in ("ordinal", "term", "first_line", "words", "docs", "names")], around_line(text, h["first_line"]).alias("snippet"))).alias("hits"),
    )

    def item(section: int, ordinal: Column, **has: Column) -> Column:
        return F.struct(F.lit(section).alias("section"), ordinal.cast("int").alias("ordinal"), *[has.get(n, F.lit(None)).cast(t).alias(n) for n, t in types.items()])

    def symbols(s: Column) -> Column:
        own = item(CSHARP, s["ordinal"] * 2, symbol=s, is_test=F.lit(False))
        test = item(CSHARP, s["ordinal"] * 2 + 1, symbol=s, is_test=F.lit(True))
        return F.when(F.col("in_test") & (s["record_type"] == "method_summary"), F.array(own, test)).otherwise(F.array(own))

    def tallies(h: Column) -> Column:
        counts = (("string_literal", h["words"]), ("comment", h["words"] - h["docs"]), ("xml_doc", h["docs"]), ("identifier", h["names"]))
        return F.filter(F.array(*[item(TERM, h["ordinal"] * 4 + i, hit=h, match_kind=F.lit(kind), hit_count=n) for i, (kind, n) in enumerate(counts)]), lambda x: x["hit_count"] > 0)

    none = F.array().cast(f"array<struct<section int, ordinal int, {', '.join(f'{n} {t}' for n, t in types.items())}>>")
    parts = {
        PROJECT_FILE: lambda: [F.when(F.col("project").isNotNull(), F.array(item(PROJECT_FILE, F.lit(0), project=F.col("project"))))],
        SOLUTION: lambda: [F.when(F.col("solution").isNotNull(), F.array(item(SOLUTION, F.lit(0), solution=F.col("solution"))))],
        CONFIGURATION: lambda: [F.transform(c, lambda k: item(CONFIGURATION, k["ordinal"], config=k)) for c in ("env", "keys")],
        CSHARP: lambda: [F.flatten(F.transform("symbols", symbols))], TERM: lambda: [F.flatten(F.transform("hits", tallies))],
    }
    every = [F.coalesce(p, none) for section in sections for p in parts[section]()]
    return held.select("path", "loc", "in_test", "framework", "term_hits", F.inline(F.concat(*every) if len(every) > 1 else every[0]))


def _shown() -> dict[int, dict[str, Column]]:
    """The columns of each section's rows, from what an item holds."""
    path, p, name = F.col("path"), "project.", F.coalesce("project.assembly_name", file_stem(F.col("path")))
    about = ("sdk", "target_frameworks", "root_namespace", "assembly_name", "lang_version", "nullable", "implicit_usings", "package_references", "project_references")
    file = {"record_type": F.lit("file_summary"), "symbol_kind": F.lit("File"), "line_start": F.lit(1), "line_end": F.col("loc"), "is_test_code": F.lit(False)}
    summary = F.format_string("Project %s (%s) — %d package ref(s), %d project ref(s)", name, F.array_join("project.target_frameworks", ", "), F.size("project.package_references"), F.size("project.project_references"))
    project = file | {"symbol_name": name, "namespace": F.col("project.root_namespace"), "summary": summary, "code_snippet": project_snippet(name, p), "metadata_json": _json(kind=F.lit("project"), **{k: F.col(p + k) for k in about})}
    stem = file_stem(path)
    listed = F.concat(F.lit("Solution: "), stem, F.lit("\nProjects:\n"), F.array_join(F.transform("solution", lambda x: F.concat(F.lit("  - "), x)), "\n"))
    solution = file | {"symbol_name": stem, "summary": F.format_string("Solution %s with %d project(s)", stem, F.size("solution")), "code_snippet": listed, "metadata_json": _json(kind=F.lit("solution"), projects=F.col("solution"))}
    key = F.concat(F.col("config.key"), F.lit("="), F.when(F.col("config.value_redacted"), MARK).otherwise(F.col("config.value")))
    hidden = F.col("config.value_redacted") | (redact(key)["status"] == "redacted")
    config = {
        "record_type": F.lit("configuration_reference"), "symbol_name": F.col("config.key"), "symbol_kind": F.lit("None"), "line_start": F.col("config.line_start"), "line_end": F.col("config.line_end"),
        "summary": F.format_string("config key '%s' in %s", "config.key", "path"), "code_snippet": key, "metadata_json": _json(file_format=F.col("config.file_format"), json_path=F.col("config.json_path"), value_redacted=hidden), "is_test_code": F.lit(False),
    }
    test, symbol = F.col("is_test"), F.col("symbol.symbol_name")
    whole = F.when(F.col("symbol.record_type") == "file_summary", file_summary(path, F.col("symbol.namespaces"), F.col("symbol.types"), F.col("term_hits"))).otherwise(F.col("symbol.code_snippet"))
    tested = _json(test_framework=F.col("framework"), test_attributes=F.array().cast("array<string>"), subjects=F.array().cast("array<string>"))
    csharp = {c: F.col(f"symbol.{c}") for c in COLUMNS if c not in ("is_test_code", "code_snippet")} | {
        "record_type": F.when(test, "test_reference").otherwise(F.col("symbol.record_type")), "symbol_kind": F.when(test, "Method").otherwise(F.col("symbol.symbol_kind")), "code_snippet": whole,
        "summary": F.when(test, F.concat(F.lit("test "), symbol)).otherwise(F.col("symbol.summary")), "metadata_json": F.when(test, tested).otherwise(F.col("symbol.metadata_json")), "is_test_code": F.col("in_test"),
    }
    term = {
        "record_type": F.lit("search_term_match"), "symbol_name": F.col("hit.term"), "symbol_kind": F.lit("None"), "line_start": F.col("hit.first_line"), "line_end": F.col("hit.first_line"), "code_snippet": F.col("hit.snippet"),
        "summary": F.format_string("search term '%s' matched as %s (%dx)", "hit.term", "match_kind", "hit_count"), "metadata_json": _json(term=F.col("hit.term"), match_kind=F.col("match_kind"), hit_count=F.col("hit_count")), "is_test_code": F.col("in_test"),
    }
    return {PROJECT_FILE: project, SOLUTION: solution, CONFIGURATION: config, CSHARP: csharp, TERM: term}


def found_rows(files: DataFrame, terms: Sequence[str] = (), kinds: Collection[str] | None = None) -> DataFrame:
    """(path, section, ordinal, *COLUMNS, unread) of files (path, content, kind): all records as they stand in the files, before redaction.

    The files are read once for all kinds. A file is read by the first that fits: project, solution, configuration, C#; search terms
    are met in C# files. For each method-like symbol of a test file there is a reference more. unread says of a C# file's first
    row that its text was beyond the reader. With kinds (of `csharp.EVERY`) records of other declarations, and of other files than C#, aren't made.
    """
    sections = _sections(terms, kinds)
    shown = {section: columns for section, columns in _shown().items() if section in sections}

    def column(name: str) -> Column:
        out = F.lit(None)
        for section, columns in shown.items():
            if name in columns:
                out = F.when(F.col("section") == section, columns[name]).otherwise(out)
        return out.alias(name)

    return _items(files, terms, kinds).select("path", "section", "ordinal", *[column(c) for c in COLUMNS], F.coalesce("symbol.unread", F.lit(False)).alias("unread"))


def csharp_rows(files: DataFrame, terms: Sequence[str]) -> DataFrame:
    """(path, ordinal, *COLUMNS, unread) of C# files (path, content, kind)."""
    return found_rows(files, terms).where(F.col("section") == CSHARP).select("path", "ordinal", *COLUMNS, "unread")


def term_rows(files: DataFrame, terms: Sequence[str]) -> DataFrame:
    """(path, ordinal, *COLUMNS) of search terms found in C# files (path, content, kind)."""
    return found_rows(files, terms).where(F.col("section") == TERM).select("path", "ordinal", *COLUMNS)


def extracted(files: DataFrame, terms: Sequence[str] = (), kinds: Collection[str] | None = None) -> DataFrame:
    """(path, section, ordinal, *COLUMNS, unread, redaction) of files (path, length, content): every record, its snippet redacted.

    redaction is no_match, redacted or failed; records that failed must not be kept. unread marks the row of a file whose
    text was beyond its reader, so that it counts as failed. Generated files and unreadable ones give none. For who asks for some kinds
    of declarations alone (of `csharp.EVERY`), records of others, and of other files than C#, aren't made.
    """
    named = classified(files.where("content is not null and trim(path) <> ''")).withColumn("kind", once(F.col("kind"))).where("kind <> 'generated'")
    safe = found_rows(named, terms, kinds).withColumn("r", redact(F.col("code_snippet")))
    return safe.withColumn("code_snippet", F.col("r.text")).withColumn("redaction", F.col("r.status")).drop("r")


class Counters:
    """What one scan counts, in the pass that writes its rows: `counted` sees the files and their rows go by, and `result` has the numbers
    once an action has run over what it gave."""

    def __init__(self) -> None:
        self._files, self._rows = Observation(), Observation()

    def counted(self, files: DataFrame, terms: Sequence[str] = ()) -> DataFrame:
        """`extracted`, observed."""
        seen = files.observe(self._files, F.count(F.lit(1)).alias("files_scanned"), F.count_if(F.col("content").isNull()).alias("records_failed"))
        made = F.count_if(F.col("redaction") != "failed").alias("records_created"), F.count_if(F.col("redaction") == "failed").alias("redaction_failed"), F.count_if("unread").alias("unread")
        return extracted(seen, terms).observe(self._rows, *made)

    def result(self) -> dict[str, int]:
        """files_scanned, records_created, records_failed (files that couldn't be read) and redaction_failed."""
        files, rows = self._files.get, self._rows.get
        return {"files_scanned": files["files_scanned"], "records_created": rows["records_created"], "records_failed": files["records_failed"] + rows["unread"], "redaction_failed": rows["redaction_failed"]}


def first_of_key(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key. A key with a null names nothing, so such rows all stay."""
    null = F.lit(False)
    for k in keys:
        null = null | F.col(k).isNull()
    w = Window.partitionBy(*keys, F.when(null, F.concat_ws("-", *order))).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def records(rows: DataFrame, ctx: ScanContext) -> DataFrame:
    """Rows of `extracted` as code_record rows, each key once; what couldn't be redacted is dropped. Ids are hashes of the
    key and place, so a scan that is run again makes the same."""
    kept = rows.where("redaction <> 'failed'").withColumnRenamed("path", "file_path")
    for name in ("repository_id", "scan_job_id", "repository_name", "branch", "commit_sha"):
        kept = kept.withColumn(name, F.lit(getattr(ctx, name)))
    first = first_of_key(kept, RECORD_KEY, ("section", "ordinal"))
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("\u0000")) for k in RECORD_KEY]
    tie = F.when(F.col("symbol_name").isNull(), F.concat_ws("-", "section", "ordinal")).otherwise("")
    made = first.withColumn("id", F.sha2(F.concat_ws("\u001f", *parts, tie), 256))
    made = made.withColumn("is_generated_code", F.lit(False)).withColumn("is_stale", F.lit(False)).withColumn("embedding_status", F.lit("pending"))
    made = made.withColumn("created_at", F.current_timestamp()).withColumn("updated_at", F.current_timestamp())
    return made.select(*[F.col(f.name).cast(f.dataType) for f in CODE_RECORD.fields])
