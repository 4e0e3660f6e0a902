"""One pass of Python over files: C# symbols, JSON keys, project fields and search terms, each for the files of its kind."""

from __future__ import annotations

import json
from collections.abc import Collection, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from quarry.operators.terms import HITS, TermMatcher
from quarry.schemas import EXTRACTED
from quarry.sources.config_files import CONFIG, PROJECT, json_keys, parse_project

SYMBOLS = f"array<struct<{EXTRACTED}, namespaces array<string>, types array<string>, unread boolean>>"
KEYS = f"array<struct<ordinal int, {CONFIG}>>"
FOUND = {"symbols": SYMBOLS, "keys": KEYS, "project": f"struct<{PROJECT}>", "hits": HITS, "term_hits": "array<string>"}


def _names(kind: str) -> list[str]:
    parsed = T.DataType.fromDDL(kind)
    return [f.name for f in (parsed.elementType if isinstance(parsed, T.ArrayType) else parsed).fields]


def _lists(lists: list[list[tuple] | None], kind: pa.ListType) -> pa.ListArray:
    """Lists of tuples as lists of structs, made column by column."""
    at, ends = 0, [0]
    for rows in lists:
        at += len(rows or ())
        ends.append(at)
    fields = list(kind.value_type)
    columns = zip(*(row for rows in lists if rows for row in rows), strict=True) if at else [()] * len(fields)
    held = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], fields=fields)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), held, type=kind, mask=pa.array([rows is None for rows in lists], pa.bool_()))


def csharp_symbols(path: str, content: str, kinds: Collection[str] | None = None) -> list[tuple]:
    """The file's own row and those of its symbols; with kinds (of `csharp.EVERY`) only theirs."""
    from quarry.sources.csharp import EVERY, extract, metadata_json

    if kinds is not None and not kinds:
        return []
    found, rows = extract(content, EVERY if kinds is None else kinds), []
    if kinds is None or "file" in kinds:
        about = {
            "loc": found.line_count, "top_level_types": found.top_level_types, "uses_unsafe": "unsafe" in content, "using_directives": found.usings, "external_types": found.external_types,
        }
        n = len(found.top_level_types)
        rows.append((0, "file_summary", path, "File", None, None, None, 1, max(1, found.line_count), f"File {path} with {n} top-level type(s)", "", json.dumps(about, ensure_ascii=False), found.namespaces, found.top_level_types, found.failed))
    for i, s in enumerate(found.symbols, 1):
        rows.append((i, s.record_type, s.symbol_name, s.symbol_kind, s.namespace, s.class_name, s.method_name, s.line_start, s.line_end, s.summary, s.code_snippet, metadata_json(s), None, None, False))
    return rows


def read(files: DataFrame, terms: Sequence[str] = (), wanted: Collection[str] | None = None) -> DataFrame:
    """files (path, content, reader, more columns) with symbols, keys, project, hits and term_hits (the terms that stand in the text as they are); reader is
    csharp, json or project, for others all are null; symbols are of the wanted kinds alone (of `csharp.EVERY`; else of all). Each text reaches Python once, in Arrow batches, and the plan is the same for any terms.
    A C# file's content is null afterwards where there are no terms, whose snippets alone are cut from it."""
    spark = files.sparkSession
    shared = spark.sparkContext.broadcast(list(terms))
    at = [files.columns.index(c) for c in ("path", "content", "reader")]
    names, kinds = {k: _names(v) for k, v in FOUND.items() if "struct" in v}, {k: to_arrow_type(T.DataType.fromDDL(v)) for k, v in FOUND.items()}

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms_, matcher = tuple(shared.value), TermMatcher(shared.value)
        for batch in batches:
            made: dict[str, list] = {k: [] for k in FOUND}
            for path, content, reader in zip(*(batch.column(i).to_pylist() for i in at), strict=True):
                text, got = content or "", dict.fromkeys(FOUND)
                if reader == "csharp":
                    got["symbols"] = csharp_symbols(path, text, wanted)
                    got["hits"], got["term_hits"] = matcher.hits(text), [t for t in terms_ if t in text]
                elif reader == "json":
                    keys = json_keys(text, "appsettings" in (path or "").lower(), terms_)
                    got["keys"] = [dict(zip(names["keys"], (i, "json", key, value, False, place, 1, 1), strict=True)) for i, (key, value, place) in enumerate(keys)]
                elif reader == "project" and (project := parse_project(text)):
                    got["project"] = dict(zip(names["project"], project, strict=True))
                    got["project"]["package_references"] = [{"name": n, "version": v} for n, v in project[7]]
                for k, v in got.items():
                    made[k].append(v)
            columns = [_lists(made[k], kinds[k]) if k == "symbols" else pa.array(made[k], kinds[k]) for k in FOUND]
            own = batch.columns
            if not terms_:
                own[at[1]] = pc.if_else(pc.fill_null(pc.equal(own[at[2]], "csharp"), False), pa.scalar(None, own[at[1]].type), own[at[1]])
            yield pa.RecordBatch.from_arrays([*own, *columns], names=[*batch.schema.names, *FOUND])

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields)
    return files.mapInArrow(found, f"{own}, " + ", ".join(f"{k} {v}" for k, v in FOUND.items()))
