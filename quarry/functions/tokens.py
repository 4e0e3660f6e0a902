"""Identifier tokens and the text that is embedded for a record, as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATORS = r"[-_./\\ \t]"
#: Places between lower and upper case, before the last capital of a run, and between letters and others.
CASE = r"(?<=\p{Ll})(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})|(?<=\p{L})(?=\p{Nd})|(?<=[^\p{L}])(?=\p{L})"


def split_case(part: Column) -> Column:
    return F.filter(F.split(part, CASE), lambda x: x != "")


def split_identifier(text: Column) -> Column:
    """The text, then each of its parts and the parts' words by case, each once, in order of appearance; blank gives none."""
    parts = F.filter(F.split(text, SEPARATORS), lambda p: p != "")
    words = F.flatten(F.transform(parts, lambda p: F.concat(F.array(p), split_case(p))))
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(F.array(text), words)))


def joined(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


def file_stem(path: Column) -> Column:
    """The name after the last slash of either kind, less its last extension, unless that is all of the name."""
    name = F.regexp_extract(path, r"([^/\\]*)$", 1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def token_line(namespace: Column, class_name: Column, method_name: Column, symbol_name: Column, path: Column) -> Column:
    parts = [namespace, class_name, method_name, symbol_name, file_stem(path)]
    return joined(F.array_distinct(F.concat(*[split_identifier(p) for p in parts])))


def _line(label: str, value: Column) -> Column:
    return F.when(F.trim(F.coalesce(value, F.lit(""))) != "", F.concat(F.lit(f"{label}: "), value))


def embedding_text(r: dict[str, Column]) -> Column:
    """Labelled lines of a record's fields in a fixed order; blank fields give none; the snippet is last."""
    at = F.concat(r["file_path"], F.lit(":"), r["line_start"].cast("string"), F.lit("-"), r["line_end"].cast("string"))
    snippet = F.when(F.trim(F.coalesce(r["code_snippet"], F.lit(""))) != "", F.concat(F.lit("Code Snippet:\n"), r["code_snippet"]))
    text = F.concat_ws(
        "\n", _line("Repository", r["repository_name"]), _line("Branch", r["branch"]), _line("Commit", r["commit_sha"]), _line("File", at), F.lit("Language: csharp"),
        _line("Record Type", r["record_type"]), _line("Namespace", r["namespace"]), _line("Class", r["class_name"]), _line("Method", r["method_name"]), _line("Symbol", r["symbol_name"]),
        _line("Summary", r["summary"]), _line("Tokens", token_line(r["namespace"], r["class_name"], r["method_name"], r["symbol_name"], r["file_path"])), snippet,
    )
    return F.regexp_replace(text, r"[\r\n]+$", "")
