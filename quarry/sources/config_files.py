"""Keys of configuration files, projects and solutions.

Environment files and solutions are read with column functions. JSON and project files need a parser that keeps
numbers as they are written and repeated keys, and that turns a broken file into no rows; `readers` runs it over Arrow batches.
"""

from __future__ import annotations

import json
import xml.etree.ElementTree as ET
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.classify import extension

CONFIG = "file_format string, key string, value string, value_redacted boolean, json_path string, line_start int, line_end int"
_FEATURE = ("feature", "flag", "toggle")


class Raw(str):
    """A JSON number or word, as it is written."""


class Pairs(list):
    """An object's members, in order, repeated keys included."""


def _refuse(word: str):
    raise ValueError(word)


_decoder = json.JSONDecoder(object_pairs_hook=Pairs, parse_int=Raw, parse_float=Raw, parse_constant=_refuse)


def json_keys(content: str | None, app_settings: bool, terms: Sequence[str]) -> list[tuple[str, str, str]]:
    """(key, value, path) of the leaves below a feature, flag or toggle section, of all leaves of an appsettings file, and of
    those named by a term. Objects in arrays are walked, plain items of arrays give nothing. A broken text gives none."""
    text = content or ""
    if text.startswith("﻿"):
        text = text[1:]
    try:
        root, end = _decoder.raw_decode(text, len(text) - len(text.lstrip(" \t\r\n")))
        if text[end:].strip(" \t\r\n"):
            return []
    except (ValueError, RecursionError):
        return []
    out = []
    stack: list[tuple[object, str, bool]] = [(root, "$", False)]
    while stack:
        node, path, inside = stack.pop()
        below: list[tuple[object, str, bool]] = []
        if isinstance(node, tuple):  # a leaf whose turn it is
            out.append(node)
        elif isinstance(node, Pairs):
            for key, value in node:
                own = f"{path}.{key}"
                if isinstance(value, list):
                    below.append((value, own, inside or any(w in key.lower() for w in _FEATURE)))
                elif inside or app_settings or key in terms:
                    shown = {True: "true", False: "false", None: "null"}[value] if value is None or isinstance(value, bool) else str(value)
                    below.append(((key, shown, own), own, inside))
        elif isinstance(node, list):
            below = [(item, f"{path}[{i}]", inside) for i, item in enumerate(node) if isinstance(item, list)]
        stack += reversed(below)
    return out


def env_keys(content: Column, terms: Sequence[str]) -> Column:
    """The KEY=VALUE lines of an environment file as (ordinal, *CONFIG); values are never shown. With terms only the keys among them."""
    trimmed = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    lines = F.transform(F.split(F.regexp_replace(content, "\r\n", "\n"), "\n"), lambda raw, at: F.struct(at.alias("at"), F.trim(trimmed(raw)).alias("line")))
    kept = F.filter(lines, lambda x: (x["line"] != "") & ~x["line"].startswith("#") & (F.instr(x["line"], "=") > 1))
    keys = F.transform(kept, lambda x: F.struct(x["at"].alias("at"), trimmed(F.substring(x["line"], F.lit(1), F.instr(x["line"], "=") - 1)).alias("key")))
    if terms:
        keys = F.filter(keys, lambda x: x["key"].isin(*terms))

    def row(x: Column) -> Column:
        number = (x["at"] + 1).cast("int")
        return F.struct(
            x["at"].alias("ordinal"), F.lit("env").alias("file_format"), x["key"].alias("key"), F.lit(None).cast("string").alias("value"), F.lit(True).alias("value_redacted"),
            F.concat(F.lit("$."), x["key"]).alias("json_path"), number.alias("line_start"), number.alias("line_end"),
        )

    return F.transform(keys, row)


def env_rows(files: DataFrame, terms: Sequence[str]) -> DataFrame:
    """(path, ordinal, *CONFIG) of environment files."""
    return files.where(extension(F.col("path")) == "env").select("path", F.inline(env_keys(F.col("content"), terms)))


def json_rows(files: DataFrame, terms: Sequence[str]) -> DataFrame:
    """(path, ordinal, *CONFIG) of JSON files."""
    from quarry.sources.readers import read

    rows = files.where(extension(F.col("path")) == "json").select("path", "content", F.lit("json").alias("reader"))
    return read(rows, terms).select("path", F.inline("keys"))


def solution_projects(content: Column) -> Column:
    """Paths of C# projects in a solution's Project( lines, with forward slashes; null for a blank text."""
    lines = F.transform(F.split(content, "\n"), lambda x: F.regexp_replace(x, r"^\s+", ""))
    parts = F.transform(F.filter(lines, lambda x: x.startswith("Project(")), lambda x: F.split(x, '"'))
    paths = F.transform(F.filter(parts, lambda p: F.size(p) >= 6), lambda p: F.translate(p[5], "\\", "/"))
    return F.when(F.trim(F.regexp_replace(content, r"\s+", " ")) != "", F.filter(paths, lambda p: F.lower(p).endswith(".csproj")))


PROJECT = (
    "sdk string, target_frameworks array<string>, root_namespace string, assembly_name string, lang_version string, nullable boolean, implicit_usings boolean, "
    "package_references array<struct<name:string,version:string>>, project_references array<string>"
)


def parse_project(content: str | None) -> tuple | None:
    """The fields of PROJECT, or None if this is no project file."""
    try:
        root = ET.fromstring((content or "").lstrip("﻿"))
    except (ET.ParseError, ValueError):
        return None
    if root.tag.rpartition("}")[2] != "Project":
        return None
    groups = root.findall("PropertyGroup")

    def first(name: str) -> str | None:
        found = ("".join(e.itertext()) for g in groups if (e := g.find(name)) is not None)
        return next((v for v in found if v.strip()), None)

    on = lambda name: (first(name) or "").lower() == "enable"
    frameworks = [f for f in [first("TargetFramework")] if f] + [f.strip() for f in (first("TargetFrameworks") or "").split(";") if f.strip()]
    packages = []
    for e in root.iter("PackageReference"):
        inner = e.find("Version")
        name = e.get("Include") if e.get("Include") is not None else e.get("Update")
        version = e.get("Version") if e.get("Version") is not None else (None if inner is None else "".join(inner.itertext()))
        if name:
            packages.append((name, version))
    references = [p for e in root.iter("ProjectReference") if (p := e.get("Include"))]
    return root.get("Sdk"), frameworks, first("RootNamespace"), first("AssemblyName"), first("LangVersion"), on("Nullable"), on("ImplicitUsings"), packages, references


def project_rows(files: DataFrame) -> DataFrame:
    """(path, content, *PROJECT) of the files that are projects."""
    from quarry.sources.readers import read

    rows = files.where(F.lower("path").endswith(".csproj")).select("path", "content", F.lit("project").alias("reader"))
    return read(rows).where("project is not null").select("path", "content", "project.*")


def project_snippet(name: Column, of: str = "") -> Column:
    """The labelled lines of a project row, whose columns are those of the struct `of` if it is named."""

    def line(label: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.concat(F.lit(label), value, F.lit("\n"))).otherwise(F.lit(""))

    def block(label: str, items: Column) -> Column:
        return F.when(F.size(items) > 0, F.concat(F.lit(label), F.array_join(F.transform(items, lambda x: F.concat(F.lit("  - "), x, F.lit("\n"))), ""))).otherwise(F.lit(""))

    packages = F.transform(of + "package_references", lambda p: F.concat(p["name"], F.when(p["version"].isNotNull(), F.concat(F.lit(" ("), p["version"], F.lit(")"))).otherwise(F.lit(""))))
    frameworks = F.when(F.size(of + "target_frameworks") > 0, F.array_join(of + "target_frameworks", ", "))
    switch = lambda c: F.when(F.col(of + c), "enable").otherwise("disable")
    return F.concat(
        line("Project: ", name), line("SDK: ", F.col(of + "sdk")), line("TargetFrameworks: ", frameworks), line("RootNamespace: ", F.col(of + "root_namespace")), line("AssemblyName: ", F.col(of + "assembly_name")),
        line("LangVersion: ", F.col(of + "lang_version")), line("Nullable: ", switch("nullable")), line("ImplicitUsings: ", switch("implicit_usings")),
        block("PackageReferences:\n", packages), block("ProjectReferences:\n", F.col(of + "project_references")),
    )
