"""Token ids as flat binary files: unsigned integers, 64-bit document offsets, read back memory-mapped.

A part holds three files: `.bin` (ids, little-endian, 16 bits if every id fits and else 32), `.idx` (64-bit offsets,
in ids, of each document's start and of the end) and `.doc` (64-bit doc_ids, and for each a byte that is 1 where the
id is null). Parts follow each other in ascending doc_id.
"""

from __future__ import annotations

import os
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.bpe import BYTE_LEVEL, UNUSUAL, byte_letters, usual
from quarry.llm.common import Recent, cut, shared_dir, uncollected

#: Ids of documents that are read at once, words in a generation of a process's memory, and texts that it gets at once.
PART_IDS, KNOWN, TEXTS = 1 << 22, 250_000, 500


def store(folder: str) -> tuple[pafs.FileSystem, str]:
    if "://" in folder or folder.startswith("file:"):
        return pafs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder[5:])
    return pafs.LocalFileSystem(), folder


class Encoder:
    """The library's encode(text, add_special_tokens=False), a word at a time: words met lately are not encoded again.

    A word goes to the library's model, in the letters that stand for its bytes. Texts with added tokens or unusual
    characters, and vocabularies with a normalizer or another pre-tokenizer than byte-level without a prefix space, go
    through the library whole.
    """

    def __init__(self, path: str, dtype: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.code = {"uint16": "H", "uint32": "I"}[dtype]
        pre = self.library.pre_tokenizer
        plain = self.library.normalizer is None and type(pre).__name__ == "ByteLevel" and not pre.add_prefix_space
        self.words = usual(BYTE_LEVEL) if plain else None
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.letters = dict(enumerate(byte_letters()))
        self.tokenize = self.library.model.tokenize
        self.known = Recent(self.word, KNOWN)

    def whole(self, text: str) -> bytes:
        return array(self.code, self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def word(self, word: str) -> bytes:
        if word.isascii() and word.isprintable():  # these letters stand for themselves, but for the space
            spelled = word.replace(" ", self.letters[32])
        else:
            spelled = word.encode().decode("latin-1").translate(self.letters)
        return array(self.code, [t.id for t in self.tokenize(spelled)]).tobytes()

    def encode(self, text: str) -> bytes:
        if self.words is None or UNUSUAL.search(text) or any(t in text for t in self.added):
            return self.whole(text)
        return b"".join(map(self.known.__getitem__, self.words(text)))


_loaded: dict[tuple[str, str], Encoder] = {}


def loaded(path: str, dtype: str) -> Encoder:
    """The encoder and what it remembers, once in each Python process."""
    if (path, dtype) not in _loaded:
        _loaded[path, dtype] = Encoder(path, dtype)
    return _loaded[path, dtype]


def id_type(path: str, end_id: int) -> str:
    from tokenizers import Tokenizer

    most = max(end_id, *Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values())
    return "uint16" if most < 1 << 16 else "uint32"


def _write(batches: Iterator[pa.RecordBatch], path: str, folder: str, dtype: str, end_id: int) -> Iterator[pa.RecordBatch]:
    """Writes this partition's part. A second attempt writes the same bytes; files appear whole, by a rename."""
    fs, base = store(folder)
    encoder = loaded(path, dtype)
    end = np.array([end_id], dtype).tobytes()
    width = np.dtype(dtype).itemsize
    task = TaskContext.get()
    part = task.partitionId()
    temp = f"{base}/.{part}-{task.taskAttemptId()}"
    offsets, ids, nulls = array("q", [0]), array("q"), bytearray()
    with fs.open_output_stream(temp + ".bin") as out, uncollected():
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                data = encoder.encode(text.as_py() or "") + end
                out.write(data)
                offsets.append(offsets[-1] + len(data) // width)
                key = key.as_py()
                ids.append(0 if key is None else key)
                nulls.append(key is None)
    for kind, data in ((".idx", offsets.tobytes()), (".doc", ids.tobytes() + bytes(nulls))):
        with fs.open_output_stream(temp + kind) as out:
            out.write(data)
    for kind in (".bin", ".idx", ".doc"):
        fs.move(temp + kind, f"{base}/part-{part:06d}{kind}")
    yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "n_docs": pa.array([len(ids)], pa.int64()), "n_ids": pa.array([offsets[-1]], pa.int64())})


def write(docs: DataFrame, path: str, end_id: int, folder: str | None = None) -> tuple[str, str, DataFrame]:
    """Writes the ids of all docs (doc_id, text), each with end_id appended, in ascending doc_id (nulls last; rows of
    one id by a hash of their text). Null texts count as empty. Gives the folder, the type of the ids and the parts:
    (part, n_docs, n_ids, base), base being the ids of all parts before, a prefix sum over the parts.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    fs, base = store(folder)
    fs.create_dir(base)
    dtype = id_type(path, end_id)
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(*order).sortWithinPartitions(*order)
    parts = cut(dealt.mapInArrow(partial(_write, path=path, folder=folder, dtype=dtype, end_id=end_id), "part int, n_docs bigint, n_ids bigint"), batch=TEXTS)
    for left in fs.get_file_info(pafs.FileSelector(base)):  # of attempts that failed; a part has three files
        if left.base_name.startswith("."):
            fs.delete_file(left.path)
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    return folder, dtype, parts.where("n_docs > 0").withColumn("base", F.coalesce(F.sum("n_ids").over(w), F.lit(0)))


class Flat:
    """A flat file of integers: memory-mapped where it is local; elsewhere only the ranges that are asked for are read."""

    def __init__(self, fs: pafs.FileSystem, path: str, dtype: str):
        self.fs, self.path, self.dtype = fs, path, np.dtype(dtype)
        self.size = fs.get_file_info(path).size // self.dtype.itemsize
        local = isinstance(fs, pafs.LocalFileSystem) and self.size > 0
        self.map = np.memmap(path, self.dtype, "r", shape=(self.size,)) if local else None

    def __getitem__(self, at: slice) -> np.ndarray:
        first, last, _ = at.indices(self.size)
        if self.map is not None or last <= first:
            return self.map[first:last] if self.map is not None else np.zeros(0, self.dtype)
        with self.fs.open_input_file(self.path) as f:
            width = self.dtype.itemsize
            return np.frombuffer(f.read_at((last - first) * width, first * width), self.dtype)


def _read(batches: Iterator[pa.RecordBatch], folder: str, dtype: str) -> Iterator[pa.RecordBatch]:
    fs, top = store(folder)
    for batch in batches:
        for part, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            name = f"{top}/part-{part:06d}"
            tokens, offsets, docs = Flat(fs, name + ".bin", dtype), Flat(fs, name + ".idx", "<i8")[:], Flat(fs, name + ".doc", "u1")[:]
            n = len(offsets) - 1
            ids, nulls = np.frombuffer(docs[: 8 * n].tobytes(), "<i8"), docs[8 * n :].astype(bool)
            first = 0
            while first < n:  # as many documents at once as hold some millions of ids, one at least
                last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + PART_IDS, "right")) - 1)
                at = offsets[first : last + 1]
                held = tokens[int(at[0]) : int(at[-1])]
                crc = [zlib.crc32(held[a:b].astype("<u4").tobytes()) for a, b in zip((at[:-1] - at[0]).tolist(), (at[1:] - at[0]).tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(ids[first:last], mask=np.asarray(nulls[first:last])), "start": pa.array(at[:-1] + base),
                    "n_tokens": pa.array(np.diff(at)), "ids_crc32": pa.array(crc, pa.int64()),
                })
                first = last


def read(folder: str, dtype: str, parts: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files. start counts from the first part's first id."""
    spread = parts.select("part", "base")
    spread = spread.repartition(max(1, spread.count()), "part")
    return spread.mapInArrow(partial(_read, folder=folder, dtype=dtype), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def slice_ids(folder: str, dtype: str, part: int, document: int) -> np.ndarray:
    """The ids of one document of a part; only its two offsets and its ids are read."""
    fs, top = store(os.fspath(folder))
    name = f"{top}/part-{part:06d}"
    a, b = Flat(fs, name + ".idx", "<i8")[document : document + 2].tolist()
    return np.asarray(Flat(fs, name + ".bin", dtype)[a:b])
