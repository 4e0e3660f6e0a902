"""A source tree as a Spark data source: `spark.read.format("quarry_tree").option("path", root).load()`.

Planning lists a bounded number of folders, breadth first; what they hold, and all below the others, is listed by the tasks that
read it. Names that start with . or _ are files like others. Ignored folders are not listed, and neither ignored nor larger
files are opened.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FILES = "path string, length bigint, content string"
#: Folders that planning lists at most; tasks for those that it hasn't listed at most; files and bytes of a batch, and files of a task of listed folders.
PLANNED, TASKS, BATCH_FILES, BATCH_BYTES, TASK_FILES = 256, 1024, 512, 16 << 20, 64
#: Schemes that every Python worker can open. Others are left to Spark's own readers.
SCHEMES = ("file", "hdfs", "s3", "s3a", "gs", "gcs", "abfs", "abfss")


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI, and the path in it. Only local paths may hold characters that a URI has to escape."""
    scheme, found, rest = uri.partition(":")
    if not found or scheme == "file":
        path = (rest if found else uri).rstrip("/")
        return pafs.LocalFileSystem(), "/" + path.lstrip("/")
    return pafs.FileSystem.from_uri(uri.replace("s3a:", "s3:", 1))


class Folders(InputPartition):
    def __init__(self, parts: list[tuple[str, bool]]):
        self.parts = parts  # (folder, whether all below it is meant, or its own files alone)


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.most = options["path"], int(options.get("maxbytes", 512 * 1024))
        self.ignore = [p for p in (x.replace("\\", "/").strip(" /").lower() for x in json.loads(options.get("ignore", "[]"))) if p]

    def _ignored(self, path: str) -> bool:
        padded = f"/{path.lower()}/"
        return any(f"/{p}/" in padded for p in self.ignore)

    def _listed(self, fs: pafs.FileSystem, base: str, folder: str) -> tuple[list[pafs.FileInfo], list[str]]:
        """Files and folders right below one, without ignored ones; none if it has gone."""
        files, folders = [], []
        for info in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)):
            if self._ignored(info.path[len(base) :].lstrip("/")):
                continue
            if info.type == pafs.FileType.Directory:
                folders.append(info.path)
            elif info.type == pafs.FileType.File and (info.size or 0) <= self.most:
                files.append(info)
        return files, sorted(folders)

    def partitions(self) -> Sequence[InputPartition]:
        fs, base = opened(self.root)
        if fs.get_file_info(base).type != pafs.FileType.Directory:
            return [Folders([])]
        tasks, waiting, listed, files_, bytes_ = [[]], [base], 0, 0, 0
        while waiting and listed < PLANNED:
            folder = waiting.pop(0)
            files, folders = self._listed(fs, base, folder)
            listed += 1
            if files:  # small folders share a task
                tasks[-1].append((folder, False))
                files_, bytes_ = files_ + len(files), bytes_ + sum(f.size or 0 for f in files)
                if files_ >= TASK_FILES or bytes_ >= BATCH_BYTES:
                    tasks.append([])
                    files_ = bytes_ = 0
            waiting += folders
        below = [(folder, True) for folder in waiting]
        n = min(TASKS, len(below))
        return [Folders(t) for t in [*tasks, *(below[i::n] for i in range(n))] if t] or [Folders([])]

    def read(self, partition: Folders) -> Iterator[pa.RecordBatch]:
        fs, base = opened(self.root)
        rows: list[tuple[str, int, str | None]] = []
        size = 0
        for folder, below in partition.parts:
            stack = [folder]
            while stack:
                files, folders = self._listed(fs, base, stack.pop())
                stack += folders if below else []
                for info in files:
                    try:
                        with fs.open_input_stream(info.path) as f:
                            data = f.read()
                    except FileNotFoundError:  # it went after it was listed
                        continue
                    rows.append((info.path[len(base) :].lstrip("/").replace("\\", "/"), len(data), text(data)))
                    size += len(data)
                    if len(rows) >= BATCH_FILES or size >= BATCH_BYTES:
                        yield batch(rows)
                        rows, size = [], 0
        if rows:
            yield batch(rows)


def text(data: bytes) -> str | None:
    """UTF-8 without a byte order mark; null for what isn't UTF-8."""
    try:
        return data.removeprefix(b"\xef\xbb\xbf").decode("utf-8")
    except UnicodeDecodeError:
        return None


def batch(rows: list[tuple[str, int, str | None]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], names=["path", "length", "content"])


class TreeSource(DataSource):
    """Options: path (the root), ignore (a JSON list of paths, met as whole segments in any case) and maxBytes."""

    @classmethod
    def name(cls) -> str:
        return "quarry_tree"

    def schema(self) -> str:
        return FILES

    def reader(self, schema) -> TreeReader:
        return TreeReader({k.lower(): v for k, v in self.options.items()})
