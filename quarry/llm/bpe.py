"""BPE encoding and decoding with the tokenizers library's results; merges are found with a segment tree.

A word's symbols stand in the leaves' gaps: leaf i of the tree holds the rank of the pair (symbol i, its right
neighbour) times the tree's size, plus i, so that the root is the leftmost lowest-rank pair. A merge changes three
leaves at most, each in logarithmic time, and the word is done when the root holds no pair.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import partial
from hashlib import sha256
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quarry.llm import textscan
from quarry.llm.common import Recent, others, uncollected

NEVER = 1 << 62
#: Words whose ids a Python worker remembers, in each of two generations.
MEMORY = 200_000
#: Text with none of these characters needs no Unicode normal form, and its classes are as old as every Unicode table.
UNUSUAL = regex.compile(r"[^\x00-\x1b\x20-ɏ]")
#: The split patterns of byte-level vocabularies (as the vocabulary files' pre-tokenizers use them).
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def usual(pattern: str):
    """findall of a split pattern for texts without UNUSUAL characters: \\p{L}, \\p{N} and \\s are spelled out up to
    U+024F, so that the standard library's engine can be used, which is more than twice as fast here."""
    spelled = {}
    for kind in (r"\p{L}", r"\p{N}", r"\s"):
        points = [c for c in range(0x250) if regex.match(kind, chr(c))]
        starts = [c for c in points if c - 1 not in points]
        ends = [c for c in points if c + 1 not in points]
        spelled[kind] = "".join(f"\\u{a:04x}" + (f"-\\u{b:04x}" if b > a else "") for a, b in zip(starts, ends, strict=True))
    kinds = regex.compile(r"\\p\{[LN]\}|\\s")
    inside = regex.compile(r"\[(\^?)((?:\\p\{[LN]\}|\\s)+)\]")
    pattern = inside.sub(lambda m: f"[{m[1]}" + kinds.sub(lambda k: spelled[k[0]], m[2]) + "]", pattern)
    return re.compile(regex.sub(r"\\p\{[LN]\}", lambda k: f"[{spelled[k[0]]}]", pattern)).findall


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, others from U+0100 on."""
    own = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def merge(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """The symbols after all merges, lowest rank first and leftmost among equals."""
    n = len(symbols)
    if n < 2:
        return symbols
    size = 1 << (n - 1).bit_length()
    tree = [NEVER] * (2 * size)
    get = ranks.get
    for i in range(n - 1):
        r = get((symbols[i], symbols[i + 1]))
        if r is not None:
            tree[size + i] = r * size + i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(i: int, value: int) -> None:
        k = size + i
        tree[k] = value
        while k > 1:
            other = tree[k ^ 1]
            low = value if value < other else other
            k >>= 1
            if tree[k] == low:
                return
            tree[k] = value = low

    while (root := tree[1]) < NEVER:
        i = root % size
        j = after[i]
        symbols[i] += symbols[j]
        symbols[j] = ""
        after[i] = k = after[j]
        put(j, NEVER)
        if k < n:
            before[k] = i
            r = get((symbols[i], symbols[k]))
            put(i, NEVER if r is None else r * size + i)
        else:
            put(i, NEVER)
        if (h := before[i]) >= 0:
            r = get((symbols[h], symbols[i]))
            put(h, NEVER if r is None else r * size + h)
    return [s for s in symbols if s]


class Bpe:
    """A vocabulary file's BPE. Known are: byte-level letters, an end-of-word suffix, the normalizer sequence of
    NFC, white space and lower case, and decoders none and byte-level; others raise ValueError."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("byte_fallback") or model.get("dropout"):
            raise ValueError("not a plain BPE model")
        self.vocab: dict[str, int] = model["vocab"]
        self.tokens = {i: t for t, i in self.vocab.items()}
        pairs = (m if isinstance(m, list) else m.split(" ", 1) for m in model["merges"])
        self.ranks = {(a, b): k for k, (a, b) in enumerate(pairs)}
        self.suffix = model.get("end_of_word_suffix") or ""
        self.unknown = self.vocab.get(model.get("unk_token") or "")
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        if any(a["single_word"] or a["lstrip"] or a["rstrip"] or a["normalized"] for a in spec["added_tokens"]):
            raise ValueError("added tokens with conditions are not known")
        self.tokens |= {i: t for t, i in self.added.items()}
        self.apart = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        kind = lambda x: x and (x["type"], *(kind(y) for y in x.get("normalizers", x.get("pretokenizers", ()))))
        norm, pre, dec = kind(spec["normalizer"]), kind(spec["pre_tokenizer"]), kind(spec["decoder"])
        if norm not in (None, ("Sequence", ("NFC",), ("Replace",), ("Lowercase",))) or dec not in (None, ("ByteLevel",)):
            raise ValueError("an unknown normalizer or decoder")
        self.lower, self.bytes_out = bool(norm), bool(dec)
        if pre == ("Sequence", ("Split",), ("ByteLevel",)):
            pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        elif pre == ("ByteLevel",) and not spec["pre_tokenizer"]["add_prefix_space"]:
            pattern = BYTE_LEVEL
        else:
            raise ValueError("an unknown pre-tokenizer")
        self.words = usual(pattern)
        self.letters = byte_letters()
        self.bytes_of = {c: b for b, c in enumerate(self.letters)}
        self.path, self._library = path, None
        self.ids = Recent(self._ids, MEMORY)  # word -> its ids as bytes
        self.spelled = Recent(self._spelled, MEMORY)  # word -> its tokens, joined by spaces

    def _tokens(self, word: str) -> list[str]:
        letters = self.letters
        symbols = [letters[b] for b in word.encode("utf-8", "surrogatepass")]
        symbols[-1] += self.suffix
        return merge(symbols, self.ranks)

    def _ids(self, word: str) -> bytes:
        vocab, out = self.vocab, array("I")
        for t in self._tokens(word):
            i = vocab.get(t, self.unknown)
            if i is not None:
                out.append(i)
        return out.tobytes()

    def _spelled(self, word: str) -> str:
        return " ".join(self.tokens[i] for i in memoryview(self.ids[word]).cast("I"))

    def split(self, text: str) -> list[str]:
        """The words of a text without added tokens. Unusual characters go through the library's Unicode tables."""
        if UNUSUAL.search(text):
            if self._library is None:
                from tokenizers import Tokenizer

                self._library = Tokenizer.from_file(self.path)
            lib = self._library
            norm = lib.normalizer.normalize_str(text) if lib.normalizer else text
            value = self.bytes_of
            return [bytes(map(value.__getitem__, p)).decode("utf-8") for p, _ in lib.pre_tokenizer.pre_tokenize_str(norm)]
        if self.lower:
            text = text.lower()
        return self.words(text)

    def pieces(self, text: str) -> Iterator[tuple[str | None, list[str]]]:
        """(added token or None, words) along the text."""
        if any(t in text for t in self.added):
            for k, part in enumerate(self.apart.split(text)):
                if k % 2:
                    yield part, []
                elif part:
                    yield None, self.split(part)
        elif text:
            yield None, self.split(text)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        out = []
        for special, words in self.pieces(text):
            if special is None:
                out.extend(map(self.ids.__getitem__, words))
            else:
                out.append(array("I", [self.added[special]]).tobytes())
        return b"".join(out)

    def decode(self, ids: Iterable[int]) -> str:
        """The text that the library's decode(ids, skip_special_tokens=False) gives."""
        tokens = [self.tokens[i] for i in ids if i in self.tokens]
        if not self.bytes_out:
            return " ".join(tokens)
        value = self.bytes_of
        out = b""
        for t in tokens:
            out += t.encode() if t in self.added else bytes(value.get(c, 0) for c in t)
        return out.decode("utf-8", "replace")

    def round_trip(self, text: str) -> tuple[bytes, str]:
        """encode(text) and decode of that. Words' spellings are remembered where no decoder joins tokens."""
        if self.bytes_out:
            ids = self.encode(text)
            return ids, self.decode(memoryview(ids).cast("I"))
        ids, spelled = [], []
        for special, words in self.pieces(text):
            if special is None:
                ids.extend(map(self.ids.__getitem__, words))
                spelled.extend(map(self.spelled.__getitem__, words))
            else:
                ids.append(array("I", [self.added[special]]).tobytes())
                spelled.append(special)
        return b"".join(ids), " ".join(filter(None, spelled))


_loaded: dict[str, Bpe] = {}


def loaded(path: str) -> Bpe:
    """The vocabulary, read once in each Python process."""
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


DIGEST = ("n_tokens", "ids_sha256", "decoded_sha256")
FULL = ("ids", "decoded")
CHECKED = ("ids", "decoded_sha256")


def _ids_and_text(bpe: Bpe, text: str, kind: str) -> tuple[int, bytes | str, str]:
    """The number of ids, the ids or their digest, and the decoded text or its digest."""
    ids, decoded = (bpe.encode(text), "") if kind == "ids" else bpe.round_trip(text)
    return len(ids) // 4, sha256(ids).hexdigest() if kind == "digests" else ids, decoded if kind == "both" else sha256(decoded.encode("utf-8")).hexdigest()


def _batches(batches: Iterator[pa.RecordBatch], path: str, at: int, kind: str) -> Iterator[pa.RecordBatch]:
    """kind: digests (in place of text), ids (in place of text), checked (ids and a digest of the decoded text, in place of text), or both (ids and decoded, beside it)."""
    bpe = loaded(path)
    for whole in batches:
        for batch in textscan.pieces(whole, at):
            with uncollected():
                rows = [_ids_and_text(bpe, value.as_py() or "", kind) for value in batch.column(at)]
            n, ids_out, text_out = ([row[k] for row in rows] for k in range(3))
            keep = [i for i in range(batch.num_columns) if kind == "both" or i != at]
            rest, names = [batch.column(i) for i in keep], [batch.schema.names[i] for i in keep]
            if kind == "digests":
                added = dict(zip(DIGEST, [pa.array(n, pa.int64()), pa.array(ids_out, pa.string()), pa.array(text_out, pa.string())], strict=True))
            else:
                flat = pa.Array.from_buffers(pa.int32(), sum(n), [None, pa.py_buffer(b"".join(ids_out))])
                added = {"ids": pa.ListArray.from_arrays(pa.array([0, *accumulate(n)], pa.int32()), flat)}
                if kind != "ids":
                    added["decoded" if kind == "both" else "decoded_sha256"] = pa.array(text_out, pa.string())
            yield pa.RecordBatch.from_arrays([*rest, *added.values()], names=[*names, *added])


def _mapped(docs: DataFrame, path: str, own: tuple[str, ...], kind: str, added: str) -> DataFrame:
    rows = docs.select(*others(docs, own))
    at = rows.columns.index("text")
    names = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if kind == "both" or f.name != "text"]
    return rows.mapInArrow(partial(_batches, path=path, at=at, kind=kind), ", ".join([*names, added]))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """docs (text, ...) with ids (array<int>) and decoded (string). Null texts count as empty: no ids, empty text.
    Rows stay where they are; nothing is shuffled. Other columns pass through."""
    return _mapped(docs, path, FULL, "both", "ids array<int>, decoded string")


def encode_only(docs: DataFrame, path: str) -> DataFrame:
    """docs without text, with ids (array<int>)."""
    return _mapped(docs, path, FULL, "ids", "ids array<int>")


def encode_checked(docs: DataFrame, path: str) -> DataFrame:
    """docs without text, with ids (array<int>) and the SHA-256 of the text that they decode to."""
    return _mapped(docs, path, CHECKED, "checked", "ids array<int>, decoded_sha256 string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """docs without text, with n_tokens and the SHA-256 of the ids (unsigned 32-bit, little-endian) and of the decoded text."""
    return _mapped(docs, path, DIGEST, "digests", "n_tokens bigint, ids_sha256 string, decoded_sha256 string")
