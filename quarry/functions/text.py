"""Column functions over source text: lines, snippets, byte limits, small formats. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Limits of snippets, in lines and UTF-8 bytes.
MAX_LINES, MAX_BYTES, CONTEXT = 200, 4096, 20


def lines(text: Column) -> Column:
    """Lines of the text; CR LF, CR and LF all end one. An empty text has one empty line."""
    return F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n", -1)


def line_count(text: Column) -> Column:
    """Line feeds and one."""
    return F.regexp_count(text, F.lit("\n")) + 1


def truncate_bytes(text: Column, limit: int = MAX_BYTES) -> Column:
    """At most `limit` UTF-8 bytes. Where the text is cut, trailing continuation bytes go and then a lead byte, so the last
    character beyond ASCII is lost even if it was whole."""
    head = F.hex(F.substring(F.encode(text, "UTF-8"), 1, limit))
    # digits of neighbouring bytes must not be read as one: an odd place is never a byte's start
    aligned = F.regexp_extract(head, r"^((?:[0-9A-F]{2})*?)(?:[CDEF][0-9A-F])?(?:[89AB][0-9A-F])*$", 1)
    cut = F.decode(F.unhex(aligned), "UTF-8")
    return F.when(F.octet_length(text) > limit, cut).otherwise(text)


def statement_end(text: Column) -> Column:
    """Up to the last ; or }; without one, up to the last line feed; without either, as it is."""
    through = F.regexp_extract(text, r"(?s)^(.*[;}])", 1)
    line = F.regexp_extract(text, r"(?s)^(.*\n)", 1)
    return F.when(text.rlike(r"[;}]"), through).when(text.contains("\n"), line).otherwise(text)


def _joined(rows: Column, first: Column, last: Column) -> Column:
    """Lines first to last, counted from 1, held to what there is."""
    low = F.greatest(first, F.lit(1))
    high = F.least(last, F.size(rows))
    return F.when(low > high, F.lit("")).otherwise(F.array_join(F.slice(rows, low, F.greatest(high - low + 1, F.lit(0))), "\n"))


def method_snippet(text: Column, first: Column, last: Column) -> Column:
    """Lines first to last, at most MAX_LINES and MAX_BYTES, ended at a statement where that cut something off."""
    rows = lines(text)
    low = F.greatest(first, F.lit(1))
    taken = _joined(rows, low, F.least(last, low + MAX_LINES - 1))
    return statement_end(truncate_bytes(taken))


def around_line(text: Column, line: Column, context: int = CONTEXT, enclosing: tuple[Column, Column] | None = None) -> Column:
    """Lines around one, held to the text and to the enclosing range if there is one."""
    rows = lines(text)
    at = F.greatest(F.lit(1), F.least(line, F.size(rows)))
    low, high = at - context, at + context
    if enclosing:
        low, high = F.greatest(low, enclosing[0]), F.least(high, enclosing[1])
    return F.when(F.length(text) == 0, F.lit("")).otherwise(truncate_bytes(_joined(rows, low, high)))


def _listed(label: str, names: Column) -> Column:
    return F.when(F.size(names) > 0, F.concat(F.lit(label), F.array_join(names, ", "), F.lit("\n"))).otherwise(F.lit(""))


def file_summary(path: Column, namespaces: Column, types: Column, hits: Column) -> Column:
    """The labelled lines that describe a file; lists without entries give no line."""
    parts = [_listed("Namespaces: ", F.array_distinct(namespaces)), _listed("Top-level types: ", types), _listed("Search-term hits: ", F.array_distinct(hits))]
    return truncate_bytes(F.concat(F.lit("File: "), path, F.lit("\n"), *parts))


def short_sha(sha: Column) -> Column:
    return F.substring(sha, 1, 7)


def duration(seconds: Column) -> Column:
    """1m 15s from a minute on, else 45.0s."""
    whole = F.floor(seconds).cast("int")
    long = F.format_string("%dm %02ds", (whole / 60).cast("int"), (whole % 60).cast("int"))
    return F.when(seconds >= 60, long).otherwise(F.format_string("%.1fs", seconds.cast("double")))


def score_text(score: Column) -> Column:
    return F.format_string("%.2f", score)


def slashes(path: Column) -> Column:
    return F.translate(path, "\\", "/")
