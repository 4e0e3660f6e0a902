"""A tolerant reader of C# declarations: tokens, then declarations by matching brackets. Nothing here imports Spark.

Text that isn't C# gives few or no symbols and never an error. Names, types and signatures are the source's own text.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Collection
from dataclasses import dataclass, field
from functools import cached_property
from itertools import accumulate, compress
from operator import itemgetter, sub

MAX_LINES, MAX_BYTES = 200, 4096
MODIFIERS = frozenset("public private protected internal static abstract sealed partial readonly const virtual override async extern unsafe new volatile required file fixed".split())
TYPE_WORDS = frozenset(["class", "struct", "interface", "enum", "record"])
#: Words that no call or local function is named.
RESERVED = frozenset(
    "if else while for foreach do switch case default catch try finally lock using fixed return throw yield await new typeof sizeof checked unchecked stackalloc is as in out ref when goto break continue "
    "true false null var delegate operator namespace class struct interface enum event params public private protected internal static const readonly".split()
)
#: Modifiers of local functions, and what stands before a statement.
LOCAL, BEFORE = frozenset(("static", "async", "unsafe", "extern")), frozenset("{};")
PRIMARY_WORDS = frozenset("this base int string bool object double float decimal long short byte char uint ulong ushort sbyte".split())
OPERATORS = ("??=", "<<=", ">>=", "...", "=>", "==", "!=", "<=", ">=", "&&", "||", "??", "?.", "++", "--", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "->", "::", "..")
#: A run of white space, a word, the start of a number, or a mark that starts no comment, string, character or preprocessor line.
PLAIN = re.compile(r"[ \t]*(?:([A-Za-z_]\w*)|([,;(){}\[\]]|(?!//|/\*)(?:" + "|".join(map(re.escape, OPERATORS)) + r"|[!%&*+\-./:<=>?\\^`|~]))|([\s\ufeff]+)|([0-9]\w*))")
DIGITS = re.compile(r"\w*")
#: Where a string can end, or an interpolated one be broken; and the same where no character escapes.
STOPS, HOLES = {'"': re.compile(r'["\\\n]'), "'": re.compile(r"['\\\n]"), "${": re.compile(r'["\\\n{]')}, re.compile(r'["{]')
BREAKS = re.compile(r"\n|\r(?!\n)")
#: Any text as pieces: white space, and behind it a comment, a word, a number, a string or character on a line, or a mark, each told by its first character;
#: marks that begin no longer one come first. What begins otherwise (interpolated, verbatim and raw strings, preprocessor lines, letters beyond ASCII) is for `_lex`.
PIECES = re.compile(
    r"""[\s\ufeff]*(?:[A-Za-z_]\w*|[,;(){}\[\]]|//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|\?(?=\.[0-9])|"""
    + "|".join(map(re.escape, OPERATORS))
    + r"""|[0-9]\w*(?:\.[0-9]\w*)*|"[^"\\\n]*(?:\\[\s\S][^"\\\n]*)*(?:"|\\\Z)?|'[^'\\\n]*(?:\\[\s\S][^'\\\n]*)*(?:'|\\\Z)?|[\s\S])"""
)
MARK, WORD, NUMBER, STRING = range(4)
BEGINS = (
    dict.fromkeys(",;(){}[]!%&*+-./:<=>?\\^`|~", MARK) | dict.fromkeys("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_", WORD)
    | dict.fromkeys("0123456789", NUMBER) | dict.fromkeys("\"'", STRING)
)
KINDS = {"mark": MARK, "word": WORD, "number": NUMBER, "string": STRING}
OPEN, CLOSE = {"(": ")", "[": "]", "{": "}", "${": "$}"}, {")", "]", "}", "$}"}
BRACKETS = frozenset((*OPEN, *CLOSE))
_FIRST = itemgetter(0)


@dataclass(slots=True)
class Token:
    kind: str  # word, string, number, mark
    text: str
    start: int
    end: int


def tokens(source: str) -> list[Token]:
    """Tokens without white space, comments and preprocessor lines. Code inside an interpolated string stands between ${ and $}."""
    out: list[Token] = []
    _lex(source, 0, len(source), out)
    return out


def _string_end(s: str, i: int, end: int, quote: str, escape: bool) -> int:
    stops = STOPS[quote] if escape else None
    while i < end:
        if escape:
            m = stops.search(s, i, end)
            if m is None:
                return end
            i = m.start()
            if s[i] == quote:
                return i + 1
            if s[i] == "\n":
                return i
            i += 2
        else:
            i = s.find(quote, i, end)
            if i < 0:
                return end
            if s[i + 1 : i + 2] != quote:
                return i + 1
            i += 2
    return end


def _interpolated(s: str, start: int, i: int, end: int, out: list[Token], verbatim: bool, raw: int, dollars: int) -> int:
    """From behind the opening quotes to behind the closing ones."""
    piece = start
    need = dollars if raw else 1
    stops = HOLES if raw or verbatim else STOPS["${"]
    while i < end:
        m = stops.search(s, i, end)
        if m is None:
            i = end
            break
        i = m.start()
        c = s[i]
        if raw and s.startswith('"' * raw, i):
            i += raw
            break
        if not raw and c == '"':
            if verbatim and s[i + 1 : i + 2] == '"':
                i += 2
                continue
            i += 1
            break
        if not raw and not verbatim and c == "\\":
            i += 2
            continue
        if not raw and not verbatim and c == "\n":
            break
        if c == "{":
            run = 1
            while s[i + run : i + run + 1] == "{":
                run += 1
            if (not raw and run % 2 == 0) or (raw and run < need):
                i += run
                continue
            i += run
            out.append(Token("string", s[piece:i], piece, i))
            out.append(Token("mark", "${", i - 1, i))
            i = _lex(s, i, end, out, hole=True)
            out.append(Token("mark", "$}", min(i, end - 1), min(i + 1, end)))
            piece = i
            i += need if s.startswith("}" * need, i) else 0
        else:
            i += 1
    out.append(Token("string", s[piece:i], piece, i))
    return i


def _lex(s: str, i: int, end: int, out: list[Token], hole: bool = False) -> int:
    depth, fresh = 0, True  # fresh: only white space so far on this line
    match, add = PLAIN.match, out.append
    while i < end:
        m = match(s, i)
        if m is not None:  # most of a text: white space, and words, numbers and marks in ASCII
            group = m.lastindex
            start, i = m.span(group)
            if group == 1:
                add(Token("word", m[1], start, i))
            elif group == 2:
                text = m[2]
                if text in "([{":
                    depth += 1
                elif text in ")]}":
                    if hole and depth == 0 and text == "}":
                        return start
                    depth -= 1
                elif text == "?." and s[i : i + 1].isdigit():
                    text, i = "?", start + 1
                add(Token("mark", text, start, i))
            elif group == 3:
                fresh = fresh or "\n" in m[3]
                continue
            else:
                while i < end and s[i] == "." and s[i + 1 : i + 2].isdigit():
                    i = DIGITS.match(s, i + 1).end()
                add(Token("number", s[start:i], start, i))
            fresh = False
            continue
        c = s[i]
        if c == "#" and fresh and not hole:
            stop = s.find("\n", i)
            i = end if stop < 0 else stop
            continue
        fresh = False
        if s.startswith("//", i):
            stop = s.find("\n", i)
            i = end if stop < 0 else stop
            continue
        if s.startswith("/*", i):
            stop = s.find("*/", i + 2)
            i = end if stop < 0 else stop + 2
            continue
        start = i
        if c in '"$@':
            j, dollars, verbatim = i, 0, False
            while j < end and s[j] in "$@":
                dollars += s[j] == "$"
                verbatim |= s[j] == "@"
                j += 1
            if s[j : j + 1] == '"':
                quotes = 1
                while s[j + quotes : j + quotes + 1] == '"':
                    quotes += 1
                raw = quotes if quotes >= 3 and not verbatim else 0
                if dollars:
                    i = _interpolated(s, start, j + (raw or 1), end, out, verbatim, raw, dollars)
                    continue
                if raw:
                    stop = s.find('"' * raw, j + raw)
                    i = end if stop < 0 else stop + raw
                else:
                    i = _string_end(s, j + 1, end, '"', not verbatim)
                out.append(Token("string", s[start:i], start, i))
                continue
        if c == "'":
            i = _string_end(s, i + 1, end, "'", True)
            out.append(Token("string", s[start:i], start, i))
        elif c.isalpha() or c in "_@":
            i += 1
            while i < end and (s[i].isalnum() or s[i] == "_"):
                i += 1
            out.append(Token("word", s[start:i], start, i))
        elif c.isdigit():
            i += 1
            while i < end and (s[i].isalnum() or s[i] == "_" or (s[i] == "." and s[i + 1 : i + 2].isdigit())):
                i += 1
            out.append(Token("number", s[start:i], start, i))
        else:
            if hole and depth == 0 and c == "}":
                return i
            text = next((o for o in OPERATORS if s.startswith(o, i)), c)
            if text == "?." and s[i + 2 : i + 3].isdigit():
                text = "?"
            depth += (text in "([{") - (text in ")]}") if len(text) == 1 else 0
            i += len(text)
            out.append(Token("mark", text, start, i))
    return i


@dataclass
class Symbol:
    record_type: str
    symbol_name: str
    symbol_kind: str
    namespace: str | None
    class_name: str | None
    method_name: str | None
    line_start: int
    line_end: int
    summary: str
    code_snippet: str
    metadata: dict


@dataclass
class Extraction:
    line_count: int
    namespaces: list[str] = field(default_factory=list)
    top_level_types: list[str] = field(default_factory=list)
    symbols: list[Symbol] = field(default_factory=list)
    usings: list[str] = field(default_factory=list)
    external_types: list[str] = field(default_factory=list)
    failed: bool = False


@dataclass
class Member:
    """A declaration: what it is, where it starts and ends (token numbers), and the parts that records name."""

    kind: str
    first: int
    last: int
    name: str = ""
    modifiers: list[int] = field(default_factory=list)
    attributes: list[str] = field(default_factory=list)
    type: tuple[int, int] | None = None
    parameters: tuple[int, int] | None = None
    body: tuple[int, int] | None = None
    names: list[tuple[str, int, int]] = field(default_factory=list)
    members: list[Member] = field(default_factory=list)
    bases: list[tuple[int, int]] = field(default_factory=list)
    base_list: tuple[int, int] | None = None
    values: list[tuple[str, int, int, int]] = field(default_factory=list)


def truncated(text: str, limit: int = MAX_BYTES) -> str:
    if len(text) * 4 <= limit:
        return text
    raw = text.encode("utf-8", "surrogatepass")
    if len(raw) <= limit:
        return text
    n = limit
    while n and raw[n - 1] & 0xC0 == 0x80:
        n -= 1
    if n and raw[n - 1] & 0xC0 == 0xC0:
        n -= 1
    return raw[:n].decode("utf-8", "surrogatepass")


def distinct(values: list[str], most: int | None = None) -> list[str]:
    return list(dict.fromkeys(v for v in values if v))[:most]


def columns(source: str) -> tuple[list[int], list[str], list[int], list[int]]:
    """Kinds, texts (of strings: empty), starts and ends of `tokens`."""
    if '"""' not in source:
        pieces = PIECES.findall(source)
        texts = list(map(str.lstrip, pieces))
        if texts and not texts[-1]:  # white space at the end
            del pieces[-1], texts[-1]
        kinds = list(map(BEGINS.get, map(_FIRST, texts)))
        if None not in kinds:
            ends = list(accumulate(map(len, pieces)))
            starts = list(map(sub, ends, map(len, texts)))
            if "//" in source or "/*" in source:
                code = [x[0] != "/" or x[1:2] not in ("/", "*") for x in texts]
                kinds, texts, starts, ends = (list(compress(c, code)) for c in (kinds, texts, starts, ends))
            if STRING in kinds:
                texts = ["" if k == STRING else x for k, x in zip(kinds, texts, strict=True)]
            return kinds, texts, starts, ends
    t = tokens(source)
    return [KINDS[x.kind] for x in t], ["" if x.kind == "string" else x.text for x in t], [x.start for x in t], [x.end for x in t]


class Reader:
    """Reads one source file."""

    def __init__(self, source: str):
        self.s = source
        self.kinds, self.texts, self.starts, self.ends = columns(source)
        self.n = len(self.kinds)
        self.partner = self._match()
        if "\r" in source:
            self.lines = source.replace("\r\n", "\n").replace("\r", "\n").split("\n")
            self.breaks = [m.start() for m in BREAKS.finditer(source)]
        else:
            self.lines = source.split("\n")
            self.breaks = [e - 1 for e in accumulate(len(x) + 1 for x in self.lines[:-1])]
        past = [""] * 64  # behind the last token there is none, and before the first
        self.words = [k == WORD for k in self.kinds] + [False] * 64
        self.texts += past

    @cached_property
    def makes(self) -> list[int]:
        return [i for i, x in enumerate(self.texts) if x == "new"]

    @cached_property
    def opens(self) -> list[int]:
        return [i for i, x in enumerate(self.texts) if x == "("]

    @cached_property
    def begins(self) -> list[int]:
        """Where a statement can begin with a type or an attribute."""
        return [i for i in range(self.n) if self.texts[i - 1] in BEFORE and (self.words[i] or self.texts[i] in ("(", "["))]

    def _match(self) -> dict[int, int]:
        """Where each opening bracket closes; brackets that don't are closed by the next outer one, or at the end."""
        out, stack, texts = {}, [], self.texts
        for i in [i for i, x in enumerate(texts) if x in BRACKETS]:  # only marks have these texts
            x = texts[i]
            if x in OPEN:
                stack.append(i)
            else:
                while stack:
                    j = stack.pop()
                    out[j] = i
                    if OPEN[texts[j]] == x:
                        break
        out.update((j, self.n) for j in stack)
        return out

    @staticmethod
    def within(places: list[int], a: int, b: int) -> list[int]:
        """Those of the sorted places that are in a to b, b not included."""
        return places[bisect_left(places, a) : bisect_left(places, b)]

    def source(self, a: int, b: int) -> str:
        """Text of the tokens a to b, b not included."""
        b = min(b, self.n)
        return self.s[self.starts[a] : self.ends[b - 1]] if a < b else ""

    def line(self, offset: int) -> int:
        return bisect_right(self.breaks, offset - 1) + 1

    def span(self, first: int, last: int) -> tuple[int, int]:
        """Lines of the tokens first to last, both included."""
        last = max(first, min(last, self.n - 1))
        return self.line(self.starts[first]), self.line(self.ends[last] - 1)

    def after(self, i: int) -> int:
        """The place behind the bracket that opens at i."""
        return min(self.partner.get(i, i) + 1, self.n)

    def angle(self, i: int, end: int) -> int | None:
        """Behind the type arguments that open at i, or None if these aren't any."""
        text, word = self.texts, self.words
        depth = 0
        while i < end:
            x = text[i]
            if x == "<":
                depth += 1
            elif x == ">":
                depth -= 1
                if depth == 0:
                    return i + 1
            elif x in ("(", "["):
                i = self.after(i)
                continue
            elif not (word[i] or x in (",", ".", "?", "*", "::")):
                return None
            i += 1
        return None

    def type_end(self, i: int, end: int) -> int | None:
        """Behind the type that starts at i, or None."""
        text, word = self.texts, self.words
        while text[i] in ("ref", "readonly", "scoped", "in", "out"):
            i += 1
        if text[i] == "(":
            i = self.after(i)
        elif text[i] == "delegate" and text[i + 1] == "*":
            stop = self.angle(i + 2, end)
            return stop
        else:
            while True:
                if not word[i] or i >= end:
                    return None
                i += 1
                if text[i] == "<":
                    stop = self.angle(i, end)
                    if stop is None:
                        return None
                    i = stop
                if text[i] not in (".", "::"):
                    break
                if not word[i + 1]:
                    return i
                i += 1
        while i < end and text[i] in ("?", "*", "["):
            if text[i] == "[" and not all(text[k] in (",", "") for k in range(i + 1, self.partner.get(i, i))):
                break
            i = self.after(i) if text[i] == "[" else i + 1
        return i

    def attributes(self, i: int, end: int) -> tuple[int, list[str]]:
        text, word = self.texts, self.words
        names = []
        while i < end and text[i] == "[":
            stop, k = self.after(i), i + 1
            if word[k] and text[k + 1] == ":":
                k += 2
            while k < stop - 1:
                e = self.type_end(k, stop)
                if e is None:
                    break
                names.append(self.source(k, e))
                k = self.after(e) if text[e] == "(" else e
                k += text[k] == ","
            i = stop
        return i, names

    def statement_end(self, i: int, end: int) -> int:
        """Behind the next semicolon outside brackets."""
        text = self.texts
        while i < end:
            x = text[i]
            if x in OPEN:
                i = self.after(i)
                continue
            if x in CLOSE:
                return i
            i += 1
            if x == ";":
                return i
        return end

    def member(self, i: int, end: int, owner: str | None) -> tuple[Member | None, int]:
        """The declaration that starts at i (owner: the type that holds it), and the place behind it."""
        text, word = self.texts, self.words
        first = i
        i, attributes = self.attributes(i, end)
        modifiers = []
        while i < end and (text[i] in MODIFIERS or (text[i] == "ref" and text[i + 1] in ("struct", "partial"))):
            modifiers.append(i)
            i += 1
        m = Member("", first, i, modifiers=modifiers, attributes=attributes)
        x = text[i]
        if x in TYPE_WORDS and (x != "record" or word[i + 1]):
            return self.type_member(m, i, end)
        if x == "delegate" and text[i + 1] != "*":
            e = self.type_end(i + 1, end)
            if e is not None and word[e]:
                m.kind, m.name, m.type = "delegate", text[e], (i + 1, e)
                k = e + 1
                if text[k] == "<":
                    k = self.angle(k, end) or k + 1
                if text[k] == "(":
                    m.parameters = (k, self.after(k))
                stop = self.statement_end(k, end)
                m.last = stop - 1
                return m, stop
        if owner is None:
            return None, max(i + 1, self._skip(i, end))
        if x == "~" and word[i + 1]:
            m.kind, m.name = "destructor", text[i + 1]
            return self.with_body(m, i + 2, end)
        if x == "event":
            e = self.type_end(i + 1, end)
            if e is not None and word[e]:
                m.type = (i + 1, e)
                k = e
                while text[k + 1] == "." and word[k + 2]:
                    k += 2
                if text[k + 1] == "{":
                    m.kind, m.name = "event", text[k]
                    stop = self.after(k + 1)
                    m.last = stop - 1
                    return m, stop
                return self.declarators(m, e, end, "event_field")
        if x in ("implicit", "explicit") and text[i + 1] == "operator":
            k = i + 2 + (text[i + 2] == "checked")
            e = self.type_end(k, end)
            if e is not None:
                m.kind, m.name, m.type = "conversion", x, (k, e)
                return self.with_body(m, e, end)
        if word[i] and text[i + 1] == "(" and x == owner:
            m.kind, m.name = "constructor", x
            return self.with_body(m, i + 1, end)
        e = self.type_end(i, end)
        if e is None or e >= end:
            return None, max(i + 1, self._skip(i, end))
        m.type = (i, e)
        if text[e] == "operator":
            k = e + 1
            mark = ""
            while k < end and text[k] != "(":
                mark += text[k]
                k += 1
            m.kind, m.name = "operator", mark
            return self.with_body(m, k, end)
        k = e
        while word[k]:  # an explicit interface's name ends before the member's
            stop = self.angle(k + 1, end) if text[k + 1] == "<" else k + 1
            if stop and text[stop] == "." and word[stop + 1]:
                k = stop + 1
            else:
                break
        if text[k] == "this" and text[k + 1] == "[":
            m.kind, m.name, m.parameters = "indexer", "this[]", (k + 1, self.after(k + 1))
            return self.with_body(m, self.after(k + 1), end)
        if not word[k] or text[k] in RESERVED:
            return None, max(i + 1, self._skip(i, end))
        name = text[k]
        after = k + 1
        if text[after] == "<":
            after = self.angle(after, end) or after
        if text[after] == "(":
            m.kind, m.name = "method", name
            return self.with_body(m, after, end)
        if text[after] in ("{", "=>"):
            m.kind, m.name = "property", name
            m, stop = self.with_body(m, after, end)
            if text[stop] == "=":
                stop = self.statement_end(stop, end)
                m.last = stop - 1
            return m, stop
        return self.declarators(m, k, end, "field")

    def _skip(self, i: int, end: int) -> int:
        """Behind what can't be read: up to a semicolon or a block."""
        text = self.texts
        while i < end:
            x = text[i]
            if x == "{":
                return self.after(i)
            if x in CLOSE or x == ";":
                return i + 1
            i = self.after(i) if x in OPEN else i + 1
        return end

    def with_body(self, m: Member, i: int, end: int) -> tuple[Member, int]:
        """Parameters, initializer and constraints, then a block, an expression or a semicolon."""
        text = self.texts
        if text[i] == "(":
            m.parameters = (i, self.after(i))
            i = self.after(i)
        while i < end and text[i] not in ("{", "=>", ";"):
            if text[i] in CLOSE:
                break
            i = self.after(i) if text[i] in OPEN else i + 1
        if text[i] == "{":
            stop = self.after(i)
            m.body = (i, stop)
        elif text[i] == "=>":
            stop = self.statement_end(i, end)
            m.body = (i, stop)
        else:
            stop = min(i + 1, end)
        m.last = stop - 1
        return m, stop

    def declarators(self, m: Member, i: int, end: int, kind: str) -> tuple[Member, int]:
        text, word = self.texts, self.words
        m.kind = kind
        stop = self.statement_end(i, end)
        while i < stop and word[i]:
            name, start = text[i], i
            i += 1
            while i < stop and text[i] not in (",", ";"):
                if text[i] == "<" and (e := self.angle(i, stop)):
                    i = e
                else:
                    i = self.after(i) if text[i] in OPEN else i + 1
            m.names.append((name, start, i - 1))
            i += 1
        m.last = stop - 1
        return m, stop

    def type_member(self, m: Member, i: int, end: int) -> tuple[Member, int]:
        text, word = self.texts, self.words
        m.kind = text[i]
        i += 1 + (m.kind == "record" and text[i + 1] in ("class", "struct"))
        if not word[i]:
            return None, i + 1
        m.name = text[i]
        i += 1
        if text[i] == "<":
            i = self.angle(i, end) or i + 1
        if text[i] == "(":
            m.parameters = (i, self.after(i))
            i = self.after(i)
        if text[i] == ":":
            start = i
            i += 1
            while i < end and text[i] not in ("{", ";", "where"):
                e = self.type_end(i, end)
                if e is None:
                    i += 1
                    continue
                m.bases.append((i, e))
                i = self.after(e) if text[e] == "(" else e
                i += text[i] == ","
            m.base_list = (start, i)
        while i < end and text[i] not in ("{", ";"):
            i = self.after(i) if text[i] in OPEN else i + 1
        if text[i] != "{":
            m.last = min(i, end - 1)
            return m, min(i + 1, end)
        stop = self.after(i)
        inner = stop - 1
        m.body = (i, stop)
        if m.kind == "enum":
            k = i + 1
            while k < inner:
                k, _ = self.attributes(k, inner)
                if not word[k]:
                    k += 1
                    continue
                e = k
                while e < inner and text[e] != ",":
                    e = self.after(e) if text[e] in OPEN else e + 1
                value = k + 2 if text[k + 1] == "=" else e
                m.values.append((text[k], k, e - 1, value))
                k = e + 1
        else:
            m.members = self.members(i + 1, inner, m.name)
        m.last = stop - 1
        if text[stop] == ";":
            m.last, stop = stop, stop + 1
        return m, stop

    def members(self, i: int, end: int, owner: str) -> list[Member]:
        text = self.texts
        out = []
        while i < end:
            if text[i] in (";", "}", ")", "]"):
                i += 1
                continue
            m, stop = self.member(i, end, owner)
            if m is not None and m.kind:
                out.append(m)
            i = max(stop, i + 1)
        return out

    def unit(self, i: int, end: int, namespace: str | None, out: list[tuple[str | None, Member]], names: list[str], usings: list[str]) -> None:
        """Declarations of a file or namespace."""
        text, word = self.texts, self.words
        while i < end:
            x = text[i]
            if x == "global" and text[i + 1] == "using":
                i += 1
                continue
            if x == "using" and text[i + 1] != "(":
                stop = self.statement_end(i, end)
                k = i + 1
                while text[k] in ("static", "unsafe"):
                    k += 1
                if word[k] and text[k + 1] == "=":
                    k += 2
                if self.source(k, stop - 1):
                    usings.append(self.source(k, stop - 1))
                i = max(stop, i + 1)
                continue
            if x == "namespace" and word[i + 1]:
                e = self.type_end(i + 1, end) or i + 2
                name = self.source(i + 1, e)
                names.append(name)
                if text[e] == "{":
                    self.unit(e + 1, self.partner.get(e, end), name, out, names, usings)
                    i = self.after(e)
                else:
                    namespace, i = name, e + 1
                continue
            m, stop = self.member(i, end, None)
            if m is not None and m.kind:
                out.append((namespace, m))
            i = max(stop, i + 1)

    def parameters(self, m: Member) -> list[dict]:
        text, word = self.texts, self.words
        if not m.parameters:
            return []
        a, b = m.parameters
        out, i = [], a + 1
        while i < b - 1:
            i, _ = self.attributes(i, b)
            start = i
            while text[i] in ("this", "params", "ref", "out", "in", "scoped", "readonly"):
                i += 1
            e = self.type_end(i, b)
            stop = start
            while stop < b - 1 and text[stop] != ",":
                if text[stop] == "<" and (k := self.angle(stop, b)):
                    stop = k
                else:
                    stop = self.after(stop) if text[stop] in OPEN else stop + 1
            if e is not None and word[e]:
                out.append({"name": text[e], "type": self.source(i, e)})
            elif word[i]:
                out.append({"name": text[i], "type": "object"})
            i = stop + 1
        return out

    def complexity(self, m: Member) -> int:
        """One and the branches of the body."""
        text = self.texts
        if not m.body:
            return 1
        a, b = m.body
        total, i, trailing = 1, a, set()
        while i < b:
            x = text[i]
            if x == "do":
                k = self.after(i + 1) if text[i + 1] == "{" else self.statement_end(i + 1, b)
                trailing.add(k)
            if x in ("if", "for", "foreach", "catch", "&&", "||") or (x == "while" and i not in trailing):
                total += 1
            elif x == "case":
                total += self.plain_case(i + 1, b)
            elif x == "?":
                total += self.conditional(i + 1, b)
            i += 1
        return total

    def plain_case(self, i: int, end: int) -> bool:
        """Whether a case label has a constant and no pattern."""
        text, word = self.texts, self.words
        start = i
        while i < end and text[i] != ":":
            x = text[i]
            if x in ("when", "not", "and", "or", "{", "<", ">", "<=", ">=", "var", "=>") or (i > start and word[i] and word[i - 1]):
                return False
            i = self.after(i) if x in OPEN else i + 1
        return True

    def conditional(self, i: int, end: int) -> bool:
        """Whether the question mark before i has its colon."""
        text = self.texts
        depth = 0
        while i < end:
            x = text[i]
            if x == ":":
                if depth == 0:
                    return True
                depth -= 1
            elif x == "?":
                depth += 1
            elif x in CLOSE or x in (";", ",") or (x == "=" and depth == 0):
                return False
            i = self.after(i) if x in OPEN else i + 1
        return False

    def calls(self, a: int, b: int) -> tuple[list[str], list[str]]:
        """Names that are called and types that are made by `new`, in the order of the expressions, outer ones first."""
        called: list[str] = []
        made: list[str] = []
        if not self.within(self.makes, a, b) and not self.within(self.opens, a, b):
            return called, made
        self._walk(a, b, called, made, self._local_names(a, b))
        return distinct(called, 50), distinct(made, 50)

    def made(self, a: int, b: int) -> list[str]:
        """The second of `calls`."""
        return self.calls(a, b)[1] if self.within(self.makes, a, b) else []

    def _local_names(self, a: int, b: int) -> set[int]:
        return {k for *_, k in self.local_functions(a, b)}

    def _walk(self, i: int, end: int, called: list[str], made: list[str], declared: set[int]) -> None:
        text, word = self.texts, self.words
        while i < end:
            x = text[i]
            primary = x == "new" or x == "(" or (word[i] and (x not in RESERVED or x in PRIMARY_WORDS)) or self.kinds[i] == STRING
            if not primary or i in declared:
                i += 1
                continue
            i = self._chain(i, end, called, made, declared)

    def _chain(self, i: int, end: int, called: list[str], made: list[str], declared: set[int]) -> int:
        """One primary expression with what follows it; the place behind it."""
        text, word = self.texts, self.words
        start, name = i, None
        inner: list[tuple[int, int]] = []
        names: list[str] = []
        made_here = None
        x = text[i]
        if x == "new":
            e = self.type_end(i + 1, end) if word[i + 1] else None
            if e is not None and text[e] in ("(", "{"):
                made_here = self.source(i + 1, e)
                i = e
                if text[i] == "(":
                    inner.append((i + 1, self.partner.get(i, end)))
                    i = self.after(i)
                if text[i] == "{":
                    inner.append((i + 1, self.partner.get(i, end)))
                    i = self.after(i)
            else:
                i += 1
                if text[i] in ("(", "["):
                    inner.append((i + 1, self.partner.get(i, end)))
                    i = self.after(i)
        elif x == "(":
            inner.append((i + 1, self.partner.get(i, end)))
            i = self.after(i)
        else:
            name = x if word[i] else None
            i += 1
        while i < end:
            x = text[i]
            if x == "<" and name and (e := self.angle(i, end)) and text[e] in ("(", ".", ")", ",", ";", "?."):
                i = e
            elif x in (".", "?.", "::", "->") and word[i + 1]:
                name, i = text[i + 1], i + 2
            elif x == "!" and text[i + 1] in (".", "(", "["):
                i += 1
            elif x == "?" and text[i + 1] == "[":
                i += 1
            elif x == "[":
                inner.append((i + 1, self.partner.get(i, end)))
                name, i = None, self.after(i)
            elif x == "(" and (name or i > start) and not (self.kinds[start] == STRING and i == start + 1):
                names.append(name or self.source(start, i))
                inner.append((i + 1, self.partner.get(i, end)))
                name, i = None, self.after(i)
            else:
                break
        called += [n for n in reversed(names) if n not in ("base", "this")]  # a constructor's initializer is no call
        if made_here:
            made.append(made_here)
        for a, b in inner:
            self._walk(a, min(b, end), called, made, declared)
        return max(i, start + 1)

    def local_functions(self, a: int, b: int) -> list[tuple[Member, int, int]]:
        """(function, its first token, its name's token) of functions declared in a body, outer before inner."""
        text, word = self.texts, self.words
        out = []
        for i in self.within(self.begins, a, b):
            if text[i] in RESERVED and text[i] != "ref" and text[i] not in LOCAL:
                continue
            k, attributes = self.attributes(i, b)
            modifiers = []
            while text[k] in LOCAL:
                modifiers.append(k)
                k += 1
            if text[k] in RESERVED and text[k] not in ("ref",):
                continue
            e = self.type_end(k, b)
            if e is None or not word[e] or text[e] in RESERVED:
                continue
            p = e + 1
            if text[p] == "<":
                p = self.angle(p, b) or p
            if text[p] != "(":
                continue
            q = self.after(p)
            while q < b and text[q] == "where":
                while q < b and text[q] not in ("{", "=>", ";"):
                    q = self.after(q) if text[q] in OPEN else q + 1
            if text[q] not in ("{", "=>"):
                continue
            m = Member("local_function", i, i, text[e], modifiers, attributes, (k, e))
            m, _ = self.with_body(m, p, b)
            out.append((m, i, e))
        return out

    def snippet(self, first: int, last: int) -> str:
        taken = truncated("\n".join(self.lines[first - 1 : min(last, first + MAX_LINES - 1)]))
        cut = max(taken.rfind(";"), taken.rfind("}"))
        if cut < 0:
            cut = taken.rfind("\n")
        return taken[: cut + 1] if cut >= 0 else taken

    def modifiers(self, m: Member) -> str:
        return self.source(m.modifiers[0], m.modifiers[-1] + 1) if m.modifiers else ""

    def has(self, m: Member, word: str) -> bool:
        text = self.texts
        return word in [text[i] for i in m.modifiers]

    def typed(self, m: Member) -> str:
        return self.source(*m.type) if m.type else ""

    def listed(self, m: Member) -> str:
        return self.source(*m.parameters) if m.parameters else "()"


KIND_NAMES = {"class": "Class", "interface": "Interface", "record": "Record", "enum": "Enum", "struct": "Struct"}
#: Members of a type are recorded kind by kind, in this order.
ORDER = ("method", "property", "constructor", "indexer", "operator", "conversion", "destructor", "field", "event", "event_field")
#: What has rows of method_summary, and all that records are made of.
MEMBERS = (*ORDER, "enum_member", "local_function")
EVERY = frozenset(("file", "type", "delegate", *MEMBERS))


class Extractor:
    """Turns declarations of the given kinds (of `EVERY`) into records."""

    def __init__(self, source: str, kinds: Collection[str] = EVERY):
        self.r = Reader(source)
        self.kinds = kinds
        self.symbols: list[Symbol] = []

    def run(self) -> Extraction:
        r = self.r
        found: list[tuple[str | None, Member]] = []
        names: list[str] = []
        usings: list[str] = []
        r.unit(0, r.n, None, found, names, usings)
        out = Extraction(len(r.lines), distinct(names) or [""], usings=distinct(usings), symbols=self.symbols)
        types: list[tuple[str | None, Member, str | None]] = []
        delegates: list[tuple[str | None, Member]] = []

        def gather(ns: str | None, m: Member) -> None:
            if m.kind == "delegate":
                delegates.append((ns, m))
            elif m.kind in KIND_NAMES:
                types.append((ns, m, None))
                for inner in m.members:
                    gather(ns, inner)

        for ns, m in found:
            gather(ns, m)
        out.top_level_types = [m.name for _, m in found if m.kind in KIND_NAMES] + [m.name for _, m in found if m.kind == "delegate"]
        for ns, m, _ in types:
            if "type" in self.kinds:
                self.type_record(ns, m)
            for kind in ORDER:
                for inner in m.members if kind in self.kinds else ():
                    if inner.kind == kind:
                        self.member_records(ns, m.name, inner)
            for value in m.values if "enum_member" in self.kinds else ():
                self.enum_record(ns, m.name, value)
        for ns, m in delegates if "delegate" in self.kinds else ():
            self.delegate_record(ns, m)
        for ns, m, _ in types if "local_function" in self.kinds else ():
            for inner in m.members:
                if inner.body and inner.kind not in KIND_NAMES:
                    for local, _, _ in r.local_functions(inner.body[0], inner.body[1]):
                        self.local_record(ns, m.name, inner, local)
        if "file" in self.kinds:
            out.external_types = self.external([m for _, m, _ in types], [m for _, m in delegates])
        return out

    def external(self, types: list[Member], delegates: list[Member]) -> list[str]:
        r = self.r
        members = [x for m in types for x in m.members]
        names = [r.source(*b) for m in types for b in m.bases]
        names += [p["type"] for m in sorted([*types, *delegates, *members], key=lambda m: m.first) if m.kind != "property" for p in r.parameters(m) if p["type"] != "object"]
        for kind in ("method", "property", "field"):
            names += [r.typed(m) for m in members if m.kind == kind]
        names += [n for m in members if m.body and m.kind not in KIND_NAMES for n in r.made(*m.body)]
        names += [n for m in members if m.kind == "field" for n in r.made(m.type[1], m.last + 1)]
        return distinct(names, 200)

    def add(self, ns: str | None, type_name: str, method: str | None, symbol: str, kind: str, lines: tuple[int, int], summary: str, snippet: str, metadata: dict, record_type: str = "method_summary") -> None:
        self.symbols.append(Symbol(record_type, f"{ns}.{symbol}" if ns is not None else symbol, kind, ns, type_name, method, *lines, summary, snippet, metadata))

    def type_record(self, ns: str | None, m: Member) -> None:
        r = self.r
        kind = KIND_NAMES[m.kind]
        bases = [r.source(*b) for b in m.bases]
        header = " ".join(filter(None, [r.modifiers(m), kind.lower(), m.name, r.source(*m.base_list) if m.base_list else ""]))
        text = header + "\n{\n"
        size = len(text.encode("utf-8", "surrogatepass"))
        for inner in m.members[:50]:
            line = f"    {self.signature(inner)}\n"
            text += line
            size += len(line.encode("utf-8", "surrogatepass"))
            if size > MAX_BYTES:
                break
        flags = {f"is_{w}": r.has(m, w) for w in ("abstract", "sealed", "partial")}
        self.add(ns, m.name, None, m.name, kind, r.span(m.first, m.last), f"{kind} {m.name}", truncated(text + "}"), {"base_types": bases, "implements": bases, "attributes": m.attributes, **flags}, "class_summary")

    def delegate_record(self, ns: str | None, m: Member) -> None:
        r = self.r
        header = f"{r.modifiers(m)} delegate {r.typed(m)} {m.name}{r.listed(m)}".strip()
        data = {"base_types": [], "implements": [], "attributes": m.attributes, "is_abstract": False, "is_sealed": False, "is_partial": False, "kind": "delegate", "returns": r.typed(m)}
        self.add(ns, m.name, None, m.name, "Class", r.span(m.first, m.last), f"delegate {m.name}", truncated(header + "\n{\n}"), data, "class_summary")

    def signature(self, m: Member) -> str:
        """A member's line in its type's snippet."""
        r = self.r
        mods = r.modifiers(m)
        if m.kind == "method":
            return f"{mods} {r.typed(m)} {m.name}{r.listed(m)};".strip()
        if m.kind == "property":
            return f"{mods} {r.typed(m)} {m.name} {{ get; set; }}".strip()
        if m.kind == "field":
            return f"{mods} {r.source(m.type[0], m.last)};".strip()
        if m.kind == "constructor":
            return f"{mods} {m.name}{r.listed(m)};".strip()
        return r.source(m.first, m.last + 1).split("\n")[0].strip()

    def member_records(self, ns: str | None, owner: str, m: Member) -> None:
        r = self.r
        mods, typed = r.modifiers(m), r.typed(m)
        data: dict = {"parameters": r.parameters(m) if m.kind not in ("property", "event") else [], "attributes": m.attributes, "is_async": r.has(m, "async"), "is_static": r.has(m, "static"), "cyclomatic_complexity": 1}
        lines = r.span(m.first, m.last)
        if m.kind in ("field", "event_field"):
            for name, a, b in m.names:
                lines = r.span(a, b)
                is_event = m.kind == "event_field"
                own = {**data, "is_async": False, "returns": typed, "signature": f"{mods} {'event ' if is_event else ''}{typed} {name}".strip(), "kind": m.kind}
                if not is_event:
                    own |= {"is_const": r.has(m, "const"), "is_readonly": r.has(m, "readonly")}
                word = "event" if is_event else "field"
                self.add(ns, owner, name, f"{owner}.{name}", "Property" if is_event else "Field", lines, f"{word} {owner}.{name}", r.snippet(*lines), own)
            return
        name, kind, summary, returns, shown = m.name, "Method", "", typed, m.name
        if m.kind == "method":
            summary, signature = f"method {owner}.{name}", f"{mods} {typed} {name}{r.listed(m)}"
            data["cyclomatic_complexity"] = r.complexity(m)
        elif m.kind == "property":
            kind, summary, signature = "Property", f"property {owner}.{name}", f"{mods} {typed} {name}"
        elif m.kind == "constructor":
            name, shown, returns, summary, signature = ".ctor", "ctor", owner, f"constructor {owner}", f"{mods} {owner}{r.listed(m)}"
        elif m.kind == "indexer":
            kind, summary, signature = "Property", f"indexer {owner}.this[]", f"{mods} {typed} this{r.listed(m)}"
        elif m.kind == "operator":
            name = shown = f"operator {m.name}"
            summary, signature = f"{name} on {owner}", f"{mods} {typed} {name}{r.listed(m)}"
            data["is_static"] = True
        elif m.kind == "conversion":
            name = shown = f"{m.name} operator {typed}"
            summary, signature = f"{name} on {owner}", f"{mods} {name}{r.listed(m)}"
            data["is_static"] = True
        elif m.kind == "destructor":
            name = shown = f"~{m.name}"
            returns, summary, signature = "void", f"finalizer {owner}", f"~{owner}()"
        else:
            kind, summary, signature = "Property", f"event {owner}.{name}", f"{mods} event {typed} {name}"
        data |= {"signature": signature.strip(), "returns": returns}
        if m.kind not in ("method", "constructor"):
            data["is_async"] = False
        if m.kind not in ("method", "property"):
            data["kind"] = m.kind
        if m.kind in ("method", "constructor"):
            data["calls"], data["instantiates"] = r.calls(m.parameters[1] if m.parameters else m.first, m.last + 1)
        self.add(ns, owner, name, f"{owner}.{shown}", kind, lines, summary, r.snippet(*lines), data)

    def enum_record(self, ns: str | None, owner: str, value: tuple[str, int, int, int]) -> None:
        r = self.r
        name, a, b, at = value
        text = r.source(at, b + 1) or None
        lines = r.span(a, b)
        data = {"signature": f"{name} = {text}" if text else name, "returns": owner, "parameters": [], "attributes": [], "is_async": False, "is_static": True, "cyclomatic_complexity": 1, "kind": "enum_member", "value": text}
        self.add(ns, owner, name, f"{owner}.{name}", "Field", lines, f"enum member {owner}.{name}", r.snippet(*lines), data)

    def local_record(self, ns: str | None, owner: str, holder: Member, m: Member) -> None:
        r = self.r
        method = holder.name if holder.kind == "method" else None
        qualifier = f"{owner}.{method}" if method else owner
        calls, made = r.calls(m.parameters[1] if m.parameters else m.first, m.last + 1)
        lines = r.span(m.first, m.last)
        data = {
            "signature": f"{r.modifiers(m)} {r.typed(m)} {m.name}{r.listed(m)}".strip(), "returns": r.typed(m), "parameters": r.parameters(m), "attributes": m.attributes, "is_async": r.has(m, "async"),
            "is_static": r.has(m, "static"), "cyclomatic_complexity": 1, "kind": "local_function", "enclosing_method": method, "calls": calls, "instantiates": made,
        }
        self.add(ns, owner, m.name, f"{qualifier}.{m.name}", "Method", lines, f"local function {qualifier}.{m.name}", r.snippet(*lines), data)


def extract(source: str, kinds: Collection[str] = EVERY) -> Extraction:
    """Records of a C# source text, of the given kinds of declarations; never raises for any text. One that is beyond the reader has no symbols and is marked failed."""
    try:
        return Extractor(source, kinds).run()
    except (IndexError, RecursionError, ValueError):
        return Extraction(len(source.replace("\r\n", "\n").replace("\r", "\n").split("\n")), [""], failed=True)


_JSON = json.JSONEncoder(ensure_ascii=False)


def metadata_json(symbol: Symbol) -> str:
    return _JSON.encode(symbol.metadata)
