"""The store: Parquet tables partitioned by repository, with keyed upserts.

A write replaces whole partitions (dynamic overwrite) from a merge of old and new rows by key, so it is atomic per
repository and can be repeated. Reading moves nothing: a table whose columns don't match the schema is an error, and
`prepare`, which every write calls, sets it aside and begins it anew.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.runtime import cut
from .git import MAX_DEPTH, SUFFIXES

SCHEMAS = {
    "repositories": "repo_id string, repo_root string",
    "commits": "repo_id string, hash string, scan_order bigint, author_name string, author_email string, message string, commit_ts bigint, tree_id string",
    "frames": "repo_id string, commit_hash string, scan_order bigint, frame_ts bigint, node_count bigint, edge_count bigint, analysis_version int, config_fingerprint string, total int",
    "checkpoints": "repo_id string, commit_hash string, scan_order bigint, path string, package_name string, module_name string, weight bigint",
    "scan_state": "repo_id string, commit_hash string, path string, package_name string, module_name string, weight bigint",
    "subtrees": "repo_id string, tree_id string, path string, blob_oid string, version int, walk string",
}
KEYS = {
    "repositories": ["repo_id"],
    "commits": ["repo_id", "hash"],
    "frames": ["repo_id", "commit_hash"],
    "checkpoints": ["repo_id", "commit_hash", "path", "module_name"],
    "scan_state": ["repo_id", "path", "module_name"],
    "subtrees": ["repo_id", "tree_id", "path"],
}


#: Version of the kept trees, raised when their meaning changes.
SUBTREE_VERSION = 1
_OID = "^[0-9a-f]{6,64}$"


def walk_key() -> str:
    """What decides which files a walk lists: kept trees of other rules are stale."""
    return f"depth<{MAX_DEPTH} " + " ".join(SUFFIXES)


class Store:
    """The tables under a folder of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _fs(self, folder: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(folder)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _exists(self, folder: str) -> bool:
        fs, path = self._fs(folder)
        return fs.exists(path)

    def read(self, name: str) -> DataFrame:
        """The table, empty if it was never written; ValueError if its columns differ from the schema."""
        schema = self.spark.createDataFrame([], SCHEMAS[name]).schema
        if not self._exists(self.path(name)):
            return self.spark.createDataFrame([], schema)
        have = self.spark.read.parquet(self.path(name))
        if set(have.columns) != set(schema.names):
            raise ValueError(f"columns of {self.path(name)} differ from the schema: {sorted(have.columns)}")
        return have.select(schema.names)

    def prepare(self, name: str) -> str | None:
        """Set a table aside whose columns differ from the schema; returns its new place, or None if there was nothing to do."""
        try:
            self.read(name)
        except ValueError:
            fs, path = self._fs(self.path(name))
            aside = f"{self.path(name)}.old-{uuid.uuid4().hex[:8]}"
            fs.rename(path, self._fs(aside)[1])
            return aside
        return None

    def save_subtrees(self, rows: DataFrame) -> None:
        """Keep the listed files (repo_id, tree_id, path, blob_oid) of whole trees, under the version and the rules of the walk."""
        self.upsert("subtrees", rows.select("*", F.lit(SUBTREE_VERSION).alias("version"), F.lit(walk_key()).alias("walk")))

    def load_subtrees(self) -> DataFrame:
        """(repo_id, tree_id, path, blob_oid) of the kept trees; those of another version or walk, or with an id that is none, are as
        if they weren't there, so that they are walked again."""
        t = self.read("subtrees")
        w = Window.partitionBy("repo_id", "tree_id")
        valid = (F.col("version") == SUBTREE_VERSION) & (F.col("walk") == walk_key()) & F.col("tree_id").rlike(_OID) & F.coalesce(F.col("blob_oid").rlike(_OID), F.lit(False))
        return t.withColumn("_ok", F.min(valid.cast("int")).over(w)).where("_ok = 1").select("repo_id", "tree_id", "path", "blob_oid")

    def upsert(self, name: str, rows: DataFrame, version: str | None = None) -> None:
        """Insert or replace by key; of several new rows with one key that with the greatest `version` column, else values."""
        self.prepare(name)
        cols = self.read(name).columns
        order = [F.col(version).desc()] if version else []
        w = Window.partitionBy(*KEYS[name]).orderBy(*order, *[F.col(c).desc() for c in cols])
        new = rows.select(cols).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
        touched = new.select("repo_id").distinct()
        old = self.read(name).join(touched, "repo_id", "left_semi").join(new, KEYS[name], "left_anti")
        self._replace(name, old.select(cols).unionByName(new))

    def insert_absent(self, name: str, rows: DataFrame) -> None:
        """Insert rows whose key isn't there yet."""
        self.prepare(name)
        have = self.read(name)
        new = rows.select(have.columns).dropDuplicates(KEYS[name]).join(have, KEYS[name], "left_anti")
        self._replace(name, have.join(new.select("repo_id").distinct(), "repo_id", "left_semi").unionByName(new))

    def replace_repository(self, name: str, rows: DataFrame) -> None:
        """All rows of the repositories in `rows` become these."""
        self.prepare(name)
        self._replace(name, rows.select(self.read(name).columns))

    def clear(self, repo_id: str, names: tuple[str, ...] = ("commits", "frames", "checkpoints", "scan_state", "subtrees")) -> None:
        """Drop one repository's rows."""
        escaped = self.spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(repo_id)
        for name in names:
            fs, path = self._fs(f"{self.path(name)}/repo_id={escaped}")
            if fs.exists(path):
                fs.delete(path, True)

    def _replace(self, name: str, rows: DataFrame) -> None:
        whole = cut(rows)  # the rows come from the folder that is written
        whole.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo_id").parquet(self.path(name))
