"""Search terms in files: tallies of matching lines and the first line of each term, for any number of terms in one pass."""

from __future__ import annotations

import unicodedata
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HITS = "array<struct<ordinal:int,term:string,first_line:int,words:int,docs:int,names:int>>"
_KIND = pa.list_(pa.struct([("ordinal", pa.int32()), ("term", pa.string()), ("first_line", pa.int32()), ("words", pa.int32()), ("docs", pa.int32()), ("names", pa.int32())]))


@lru_cache(maxsize=1 << 16)
def in_word(c: str) -> bool:
    """Whether a character goes on a word: letters, marks, decimal digits, connectors and joiners."""
    kind = unicodedata.category(c)
    return kind[0] in "LM" or kind in ("Nd", "Nl", "Pc") or c in "‌‍" or "Ⓐ" <= c <= "ⓩ"


@lru_cache(maxsize=1 << 16)
def in_name(c: str) -> bool:
    """Whether a character goes on an identifier: letters, decimal digits and the underscore."""
    kind = unicodedata.category(c)
    return kind[0] == "L" or kind == "Nd" or c == "_"


def folded(text: str) -> str:
    """The text in lower case, character by character, so that places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def _edge(kind, text: str, at: int) -> bool:
    """Whether a word boundary is before text[at]."""
    return (at > 0 and kind(text[at - 1])) != (at < len(text) and kind(text[at]))


class TermMatcher:
    """All terms as one automaton, which meets every occurrence of every term in one pass over a text."""

    def __init__(self, terms: Sequence[str]):
        import ahocorasick

        self.terms = list(dict.fromkeys(terms))
        same: dict[str, list[int]] = {}
        for i, term in enumerate(self.terms):
            if term and "\n" not in term and "\r" not in term:  # others stand in no line
                same.setdefault(folded(term), []).append(i)
        self.automaton = ahocorasick.Automaton()
        for key, numbers in same.items():
            self.automaton.add_word(key, (len(key), numbers))
        if same:
            self.automaton.make_automaton()
        self.any = bool(same)

    def hits(self, text: str) -> list[dict]:
        """For each term with a matching line its counts of lines, and its first line, in the order of the terms."""
        if not self.any or not text:
            return []
        text = text.replace("\r\n", "\n").replace("\r", "\n")
        low = folded(text)
        starts: list[int] | None = None
        found: dict[int, list[int]] = {}  # term -> first line, lines by word, by doc, by name, and the last line counted as word and as name
        for end, (size, numbers) in self.automaton.iter(low):
            first, after = end + 1 - size, end + 1
            word = _edge(in_word, text, first) and _edge(in_word, text, after)
            name = not (first > 0 and in_name(text[first - 1])) and not (after < len(text) and in_name(text[after]))
            exact = None
            for i in numbers:
                held = found.get(i)
                if not word and not name and held is not None and held[0]:
                    continue
                exact = text[first:after] if exact is None else exact
                written = exact == self.terms[i]
                if not word and not (written and (name or held is None or not held[0])):
                    continue
                if starts is None:
                    starts = [0]
                    at = text.find("\n")
                    while at >= 0:
                        starts.append(at + 1)
                        at = text.find("\n", at + 1)
                line = bisect_right(starts, first)
                if held is None:
                    held = found[i] = [0, 0, 0, 0, 0, 0]
                if written and not held[0]:
                    held[0] = line
                if word and held[4] != line:
                    held[4] = line
                    held[1] += 1
                    begin = starts[line - 1]
                    while text.startswith(" ", begin):
                        begin += 1
                    held[2] += text.startswith("///", begin)
                if written and name and held[5] != line:
                    held[5] = line
                    held[3] += 1
        made = [(i, x) for i, x in sorted(found.items()) if x[1] or x[3]]
        return [{"ordinal": i, "term": self.terms[i], "first_line": x[0] or 1, "words": x[1], "docs": x[2], "names": x[3]} for i, x in made]


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in slices of so many rows at most: what Python holds of them at once doesn't grow with a batch, which has 10,000 rows in a large table."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def hit_batches(batches: Iterator[pa.RecordBatch], terms: Sequence[str], at: int) -> Iterator[pa.RecordBatch]:
    """The batches with the hits of the texts in column `at`."""
    matcher = TermMatcher(terms)
    for batch in sliced(batches):
        hits = pa.array([matcher.hits(t or "") for t in batch.column(at).to_pylist()], _KIND)
        yield pa.RecordBatch.from_arrays([*batch.columns, hits], names=[*batch.schema.names, "hits"])


def with_term_hits(files: DataFrame, terms: Sequence[str]) -> DataFrame:
    """files (content, more columns) with `hits`: ordinal, term, first_line, and lines by words, docs and names of each term
    found. The plan is the same for any terms; they reach the tasks as one broadcast list, and each text is read once for all."""
    shared = files.sparkSession.sparkContext.broadcast(list(terms))
    at = files.columns.index("content")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return hit_batches(batches, shared.value, at)

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields)
    return files.mapInArrow(found, f"{names}, hits {HITS}")


def term_tallies(files: DataFrame, terms: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(path, term, match_kind, hit_count, first_line, ordinal) from files (path, content); columns in `keep` pass through. ordinal is
    the term's place.

    A line counts as string_literal and as comment (xml_doc, if it starts with ///) where the term stands between word
    boundaries in any case, and as identifier where it stands as an identifier in the same case. first_line is the first
    line that holds the term as it is written, else 1. Counts are taken within each file's own lines, so nothing is shuffled.
    Null and empty files, and empty terms and those with a line break, have no rows; a term given twice counts once.
    """
    wanted = list(dict.fromkeys(["path", "content", *keep]))
    held = with_term_hits(files.select(*wanted), terms).where("size(hits) > 0")
    found = held.select("path", *keep, F.inline("hits"))
    tally = lambda kind, n: F.struct(F.lit(kind).alias("match_kind"), n.alias("hit_count"))
    kinds = F.array(tally("string_literal", F.col("words")), tally("comment", F.col("words") - F.col("docs")), tally("xml_doc", F.col("docs")), tally("identifier", F.col("names")))
    return found.select("path", *keep, "term", "first_line", "ordinal", F.inline(kinds)).where("hit_count > 0").select("path", "term", "match_kind", "hit_count", "first_line", "ordinal", *keep)
