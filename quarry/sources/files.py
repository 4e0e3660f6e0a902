"""Files of a source tree as a DataFrame, and what is known of the repository they come from."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.classify import IGNORED, file_kind, is_ignored
from quarry.functions.text import slashes
from quarry.shared import shared_folder
from quarry.sources.tree import FILES, SCHEMES, TreeSource

def _hidden(fs, base: str, hadoop_path, ignore: Sequence[str], max_bytes: int) -> list[tuple[str, int]]:
    """(path, length) of files that Spark's readers leave out: those whose name, or a folder's on the way, starts with . or _."""
    wanted, found, depth = {p.strip(" /").lower() for p in ignore}, [], 1
    safe = re.sub(r"([\[\]{}*?\\])", r"\\\1", base)
    while len(fs.globStatus(hadoop_path(safe + "/*" * depth)) or ()):
        for up in range(depth):
            pattern = safe + "/*" * up + "/[._]*" + "/[!._]*" * (depth - 1 - up)
            for status in fs.globStatus(hadoop_path(pattern)) or ():
                path = status.getPath().toString()
                parts = {x.lower() for x in path[len(base) :].split("/")}
                if status.isFile() and status.getLen() <= max_bytes and not parts & wanted:
                    found.append((path, status.getLen()))
        depth += 1
    return sorted(set(found))


def _read_hidden(frames):
    import pyarrow.fs as pafs

    for frame in frames:
        data = []
        for path in frame["path"]:
            fs, at = pafs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
            with fs.open_input_stream(at) as f:
                data.append(f.read())
        yield frame.assign(content=data)


def scan_files(spark: SparkSession, root: str, ignore: Sequence[str] = IGNORED, max_kb: int = 512) -> DataFrame:
    """(path, length, content) of the files below root that aren't ignored and have max_kb * 1024 bytes at most.

    Paths are relative with forward slashes. Sizes are compared while files are listed, and ignored paths are left out before
    any content is read. Text is UTF-8, a byte order mark is dropped, and a file that isn't UTF-8 has null content.
    A missing root gives no rows. Names that start with . or _ are files like others. Trees are read by the source of `tree`;
    those on stores that only Spark can open by Spark's binary reader, and hidden names there by their file system.
    """
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = hadoop_path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    base = fs.makeQualified(hadoop_path(root)).toString().rstrip("/")
    if base.partition(":")[0] in SCHEMES:
        spark.dataSource.register(TreeSource)
        return spark.read.format(TreeSource.name()).option("path", base).option("ignore", json.dumps(list(ignore))).option("maxBytes", str(max_kb * 1024)).load()
    if not fs.exists(hadoop_path(root)):
        return spark.createDataFrame([], FILES)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").load(root)
    found = raw.where(F.col("length") <= max_kb * 1024).select("path", "length", "content")
    hidden = _hidden(fs, base, hadoop_path, ignore, max_kb * 1024)
    if hidden:
        found = found.unionByName(spark.createDataFrame(hidden, "path string, length bigint").mapInPandas(_read_hidden, "path string, length bigint, content binary"))
    at = F.regexp_replace(slashes(F.col("path")), "^" + re.sub("/+", "/+", re.escape(base)) + "/+", "")
    bytes_ = F.when(F.hex(F.substring("content", 1, 3)) == "EFBBBF", F.expr("substring(content, 4)")).otherwise(F.col("content"))
    kept = found.withColumn("path", at).where(~is_ignored(F.col("path"), ignore))
    return kept.withColumn("content", F.try_validate_utf8(bytes_.cast("string")))


def classified(files: DataFrame) -> DataFrame:
    """files with kind: generated, configuration, test or production."""
    return files.withColumn("kind", file_kind(F.col("path"), F.col("content")))


@dataclass(frozen=True)
class Repository:
    path: str
    name: str
    branch: str
    commit_sha: str
    url: str | None = None


def _head(git: Path) -> tuple[str | None, str | None]:
    """Branch and commit of a git folder, read from its files."""
    try:
        head = (git / "HEAD").read_text().strip()
    except OSError:
        return None, None
    if not head.startswith("ref: "):
        return None, head or None
    ref = head[5:]
    branch = ref.removeprefix("refs/heads/")
    try:
        return branch, (git / ref).read_text().strip()
    except OSError:
        pass
    try:
        packed = (git / "packed-refs").read_text()
    except OSError:
        return branch, None
    found = re.search(rf"^([0-9a-f]{{40}}) {re.escape(ref)}$", packed, re.M)
    return branch, found[1] if found else None


def repository_name(url: str) -> str:
    """The last part of a clone URL, less .git; `repository` if nothing is left."""
    name = re.split(r"[/:]", url.rstrip("/"))[-1].removesuffix(".git")
    return name or "repository"


def load_path(path: str, branch: str | None = None) -> Repository:
    """A local tree. Its branch is the one given, else git's, else main; its commit git's, else 0000000."""
    root = Path(path)
    if not root.is_dir():
        raise FileNotFoundError(path)
    found, sha = _head(root / ".git")
    return Repository(str(root), root.resolve().name, branch or found or "main", sha or "0000000")


Clone = Callable[[str, str | None], str]


def load_url(url: str, clone: Clone, branch: str | None = None) -> Repository:
    """A tree that `clone(url, branch)` puts into a folder; a missing branch is called main."""
    here = load_path(clone(url, branch), branch or "main")
    return Repository(here.path, repository_name(url), here.branch, here.commit_sha, url)


def git_clone(url: str, branch: str | None, folder: str | None = None) -> str:
    """Clones with the git command into a new folder, below `folder` if it is given; on a cluster that must be one that all executors
    mount (`clone_folder`). A token in GIT_TOKEN answers git's question for one, so it stands in no command line and no file."""
    import subprocess
    import tempfile

    to = tempfile.mkdtemp(prefix="clone-", dir=folder)
    helper = []
    if os.environ.get("GIT_TOKEN") and not url.startswith("git@"):
        helper = ["-c", "credential.helper=", "-c", 'credential.helper=!f() { test "$1" = get && printf "username=%s\\npassword=%s\\n" "${GIT_USERNAME:-git}" "$GIT_TOKEN"; }; f']
    env = {**os.environ, "GIT_TERMINAL_PROMPT": "0"}
    subprocess.run(["git", *helper, "clone", "--quiet", *(["--branch", branch] if branch else []), "--", url, to], check=True, env=env)
    return to


def clone_folder(spark: SparkSession) -> str:
    """A new local folder for clones that the executors see too: one below spark.checkpoint.dir, which must be mounted. In local
    mode any will do."""
    at = shared_folder(spark, "clones")
    scheme, _, path = at.partition(":")
    if scheme != "file":
        raise ValueError("clones need a spark.checkpoint.dir that is mounted on the driver and all executors (file:)")
    path = "/" + path.lstrip("/")
    os.makedirs(path, exist_ok=True)
    return path


def load(path: str | None = None, url: str | None = None, branch: str | None = None, clone: Clone = git_clone) -> Repository:
    if path:
        return load_path(path, branch)
    if url:
        return load_url(url, clone, branch)
    raise ValueError("a path or a url is needed")
