"""The store: Parquet tables with versions, changed by whole-partition rewrites.

A table is a folder of versions and a ledger of one small file that names the current one. A change is written as a new version and
becomes visible when the ledger is replaced, so a reader sees all of it or nothing. code_record is kept by repository and
branch; a change of one branch links the others' files into the new version by listing them, and rewrites only its own.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.changes import exists_completed, insert_if_absent, mark_stale, upsert, with_status
from quarry.schemas import MIGRATIONS, TABLES


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _ledger(self, table: str) -> dict[str, str]:
        """Part name -> folder of its current rows."""
        path = self._path(f"{self.root}/{table}/_current.json")
        if not self._fs.exists(path):
            return {}
        stream = self._fs.open(path)
        try:
            return json.loads(bytes(b & 255 for b in stream.readAllBytes()))
        finally:
            stream.close()

    def _publish(self, table: str, ledger: dict[str, str]) -> None:
        temp, path = self._path(f"{self.root}/{table}/_next-{uuid.uuid4().hex}"), self._path(f"{self.root}/{table}/_current.json")
        out = self._fs.create(temp, True)
        out.write(bytearray(json.dumps(ledger).encode()))
        out.close()
        sc = self.spark.sparkContext
        hadoop = sc._jvm.org.apache.hadoop.fs
        how = sc._gateway.new_array(hadoop.Options.Rename, 1)
        how[0] = hadoop.Options.Rename.OVERWRITE
        hadoop.FileContext.getFileContext(self._fs.getUri(), sc._jsc.hadoopConfiguration()).rename(temp, path, how)  # in one step

    def table(self, name: str, part: str | None = None, repositories: Sequence[str] = (), branch: str | None = None) -> DataFrame:
        """A table's rows, or those of one part of it, or of some repositories or one branch; files of other parts are not read."""
        ledger = self._ledger(name)

        def wanted(key: str) -> bool:
            if part is not None:
                return key == part
            repository, _, own = key.partition("\u001f")
            return (not repositories or repository in repositories) and (not branch or own == branch)

        folders = [f"{self.root}/{name}/{v}" for k, v in ledger.items() if wanted(k)]
        if not folders:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(*folders)

    def write(self, name: str, rows: DataFrame, part: str = "all") -> None:
        """Replaces the rows of one part."""
        folder = f"v-{uuid.uuid4().hex}"
        rows.select(*[F.col(f.name).cast(f.dataType) for f in TABLES[name].fields]).write.parquet(f"{self.root}/{name}/{folder}")
        self._publish(name, {**self._ledger(name), part: folder})

    def staged(self, job: str, name: str, rows: DataFrame) -> DataFrame:
        """Rows as they are once written to the job's own folder, so that what made them runs once, whatever is lost later."""
        folder = f"{self.root}/_staged/{job}/{name}"
        rows.write.mode("overwrite").parquet(folder)
        return self.spark.read.schema(rows.schema).parquet(folder)

    def unstage(self, job: str) -> None:
        self._fs.delete(self._path(f"{self.root}/_staged/{job}"), True)

    def name_index(self, model: str, folder: str) -> None:
        """Notes the folder of a model's vector index."""
        row = self.spark.createDataFrame([(model, folder)], "model string, folder string")
        row.write.mode("overwrite").parquet(f"{self.root}/_index/named/{quote(model, safe='')}")

    def named_index(self, model: str) -> str | None:
        path = f"{self.root}/_index/named/{quote(model, safe='')}"
        return self.spark.read.schema("model string, folder string").parquet(path).first()["folder"] if self._fs.exists(self._path(path)) else None

    @staticmethod
    def part(repository: str, branch: str) -> str:
        return f"{repository}\u001f{branch}"

    def migrate(self) -> list[str]:
        """Notes each schema version once, in order; gives those that were new."""
        have = {r["name"] for r in self.table("_migrations").select("name").collect()}  # as many as versions of the schema
        new = [m for m in sorted(MIGRATIONS) if m not in have]
        for name in new:
            row = self.spark.createDataFrame([(name,)], "name string").withColumn("applied_at", F.current_timestamp())
            self.write("_migrations", self.table("_migrations").unionByName(row))
        return new

    def upsert_repository(self, name: str, branch: str, commit_sha: str, url: str | None = None, local_path: str | None = None) -> str:
        """Adds or renews the repository of this name and branch; gives the id it has kept."""
        columns = TABLES["repository"]
        row = self.spark.createDataFrame([(str(uuid.uuid4()), name, url, local_path, branch, commit_sha)], "id string, name string, url string, local_path string, branch string, commit_sha string")
        for c in ("last_scanned_at", "created_at", "updated_at"):
            row = row.withColumn(c, F.current_timestamp())
        merged = upsert(self.table("repository"), row.select(*columns.names), ("name", "branch"), ("url", "local_path", "commit_sha", "last_scanned_at", "updated_at"))
        self.write("repository", merged)
        return self.table("repository").where((F.col("name") == name) & (F.col("branch") == branch)).first()["id"]

    def repository(self, name: str):
        """One repository of this name, the first by branch, or None."""
        return next(iter(self.table("repository").where(F.col("name") == name).orderBy("branch").limit(1).collect()), None)

    def start_job(self, repository_id: str, branch: str, commit_sha: str) -> str:
        job = str(uuid.uuid4())
        row = self.spark.createDataFrame([(job, repository_id, branch, commit_sha, "running")], "id string, repository_id string, branch string, commit_sha string, status string")
        row = row.withColumn("started_at", F.current_timestamp()).withColumn("completed_at", F.lit(None).cast("timestamp")).withColumn("error_message", F.lit(None).cast("string"))
        self.write("scan_job", row.withColumn("records_created", F.lit(0)).withColumn("records_failed", F.lit(0)), part=job)
        return job

    def finish_job(self, job: str, status: str, created: int = 0, failed: int = 0, error: str | None = None) -> None:
        done = {"status": F.lit(status), "completed_at": F.current_timestamp(), "records_created": F.lit(created), "records_failed": F.lit(failed), "error_message": F.lit(error).cast("string")}
        self.write("scan_job", self.table("scan_job", job).withColumns(done), part=job)

    def has_completed(self, repository_id: str, branch: str, commit_sha: str) -> bool:
        return exists_completed(self.table("scan_job"), repository_id=repository_id, branch=branch, commit_sha=commit_sha)

    def add_records(self, repository: str, branch: str, new: DataFrame) -> int:
        """Marks what the branch has as stale, except what `new` has too, and inserts what is absent; gives how many were. `new` is
        read twice and should be kept."""
        part = self.part(repository, branch)
        old = self.table("code_record", part)
        inserted = insert_if_absent(old, new)
        added = inserted.count()
        self.write("code_record", mark_stale(old, F.lit(True), but=new).unionByName(inserted), part)
        return added

    def add_embeddings(self, repository: str, branch: str, rows: DataFrame, failed: DataFrame) -> None:
        """Stores embeddings and sets the states of their records (rows: code_embedding; failed: done_id)."""
        part = self.part(repository, branch)
        self.write("code_embedding", self.table("code_embedding", part).unionByName(rows).dropDuplicates(["id"]), part)
        records = with_status(self.table("code_record", part), rows.select(F.col("code_record_id").alias("done_id")), "embedded")
        self.write("code_record", with_status(records, failed, "failed"), part)
