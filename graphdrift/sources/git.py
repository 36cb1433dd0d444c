"""Python data sources over git repositories on a shared file system: lineage, trees, changes and blobs.

    spark.dataSource.register(GitLog)
    spark.read.format("gitlog").option("path", "/repos/a,/repos/b").load()

A partition is a range of RANGE commits of one repository; the driver only counts a repository's commits, each partition lists
its own. Rows stream from the git command. The number of commits is cut with the option `max`, the newest ones of the
first-parent lineage remain; 0 or no option means all.
"""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Commits of a partition, blobs asked for at a time, and bytes read at a time.
RANGE, BLOBS, CHUNK = 200, 64, 1 << 16
#: Deeper files are not listed.
MAX_DEPTH = 30
SUFFIXES = (".rs", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".py", ".go")


def git(root: str, *args: str) -> str:
    done = subprocess.run(["git", "-c", "safe.directory=*", "-C", root, *args], capture_output=True, check=True)
    return done.stdout.decode("utf-8", "replace")


def repo_root(path: str) -> str:
    """Top folder of the repository that a path lies in, as its id: with '/' as separator."""
    return git(path, "rev-parse", "--show-toplevel").strip().replace(os.sep, "/")


def stream(root: str, end: bytes, *args: str) -> Iterator[str]:
    """The output of a git command in pieces that end with `end`, as they come."""
    with subprocess.Popen(["git", "-c", "safe.directory=*", "-C", root, *args], stdout=subprocess.PIPE) as run:
        rest = b""
        while chunk := run.stdout.read(CHUNK):
            *done, rest = (rest + chunk).split(end)
            for piece in done:
                yield piece.decode("utf-8", "replace")
        if rest.strip():
            yield rest.decode("utf-8", "replace")
    if run.returncode:
        raise RuntimeError(f"git {args[0]} ended with {run.returncode} in {root}")


def commits(root: str, most: int = 0) -> int:
    """Number of commits of the first-parent lineage of HEAD, at most `most` of them unless it is 0."""
    n = int(git(root, "rev-list", "--first-parent", "--count", "HEAD"))
    return min(n, most) if most > 0 else n


def tracked(path: str) -> bool:
    return path.endswith(SUFFIXES) and path.count("/") < MAX_DEPTH


@dataclass
class Part(InputPartition):
    """`size` commits of a lineage of `total`, after the `skip` newest ones."""

    root: str
    skip: int
    size: int
    total: int

    def hashes(self) -> list[tuple[int, str, str]]:
        """(place in the lineage from 1, hash, hash of the one before it or ''), oldest first."""
        n = self.size + (self.skip + self.size < self.total)
        found = git(self.root, "rev-list", "--first-parent", f"--skip={self.skip}", f"--max-count={n}", "HEAD").split()
        return [(self.total - self.skip - i, found[i], found[i + 1] if i + 1 < len(found) else "") for i in range(self.size)][::-1]


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.roots = [repo_root(p.strip()) for p in options["path"].split(",")]
        self.most = int(options.get("max", 0))


    def partitions(self):
        out = []
        for r in self.roots:
            total = commits(r, self.most)
            out += [Part(r, skip, min(RANGE, total - skip), total) for skip in range(0, total, RANGE)]
        return out


class LogReader(_Reader):
    def read(self, part: Part) -> Iterator[tuple]:
        place = part.total - part.skip
        window = (f"--skip={part.skip}", f"--max-count={part.size}")
        for row in stream(part.root, b"\x01", "log", "--first-parent", *window, "--format=%H%x00%T%x00%an%x00%ae%x00%at%x00%B%x01"):
            if row.strip():
                h, tree, name, mail, at, message = row.lstrip("\n").split("\x00", 5)
                yield part.root, h, place, name or "unknown", mail or "unknown", int(at or 0), message.rstrip("\n"), tree
                place -= 1


def tree_files(root: str, commit: str) -> Iterator[tuple[str, str]]:
    """(path, blob id) of the tracked files of a commit."""
    for row in stream(root, b"\x00", "ls-tree", "-r", "-z", commit):
        meta, path = row.split("\t", 1)
        _, kind, oid = meta.split(" ")
        if kind == "blob" and tracked(path):
            yield path, oid


class TreeReader(_Reader):
    def read(self, part: Part) -> Iterator[tuple]:
        for place, h, _ in part.hashes():
            for path, oid in tree_files(part.root, h):
                yield part.root, h, place, path, oid


class ChangeReader(_Reader):
    def read(self, part: Part) -> Iterator[tuple]:
        for place, h, before in part.hashes():
            head = (part.root, h, place)
            if not before:
                for path, oid in tree_files(part.root, h):
                    yield *head, path, "upsert", oid
                continue
            fields = stream(part.root, b"\x00", "diff-tree", "-r", "-z", "-M", "--no-commit-id", before, h)
            for meta in fields:
                if not meta:
                    continue
                *_, oid, status = meta.lstrip(":").split(" ")
                path = next(fields)
                if status[0] in "RC":
                    old, path = path, next(fields)
                    if status[0] == "R" and tracked(old):
                        yield *head, old, "delete", None
                if tracked(path):
                    yield *head, path, "delete" if status[0] == "D" else "upsert", None if status[0] == "D" else oid


class GitLog(DataSource):
    @classmethod
    def name(cls):
        return "gitlog"

    def schema(self):
        return "repo_id string, hash string, scan_order bigint, author_name string, author_email string, commit_ts bigint, message string, tree_id string"

    def reader(self, schema):
        return LogReader(self.options)


class GitTree(DataSource):
    @classmethod
    def name(cls):
        return "gittree"

    def schema(self):
        return "repo_id string, hash string, scan_order bigint, path string, blob_oid string"

    def reader(self, schema):
        return TreeReader(self.options)


class GitChanges(DataSource):
    """Upserts and deletes of each commit against its first parent; a rename is a delete and an upsert, a copy an upsert."""

    @classmethod
    def name(cls):
        return "gitchanges"

    def schema(self):
        return "repo_id string, hash string, scan_order bigint, path string, op string, blob_oid string"

    def reader(self, schema):
        return ChangeReader(self.options)


def register(spark) -> None:
    for source in (GitLog, GitTree, GitChanges):
        spark.dataSource.register(source)


def blob_texts(root: str, ids: list[str]) -> Iterator[tuple[str, str | None]]:
    """(id, text) of blobs, BLOBS at a time from one git process; null where a blob is missing or isn't UTF-8."""
    with subprocess.Popen(["git", "-c", "safe.directory=*", "-C", root, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE) as run:
        for begin in range(0, len(ids), BLOBS):
            asked = ids[begin : begin + BLOBS]
            run.stdin.write("\n".join(asked).encode() + b"\n")
            run.stdin.flush()
            for oid in asked:
                head = run.stdout.readline().split(b" ")
                if head[-1].strip() == b"missing":
                    yield oid, None
                    continue
                raw = run.stdout.read(int(head[2]) + 1)[:-1]
                try:
                    yield oid, raw.decode("utf-8")
                except UnicodeDecodeError:
                    yield oid, None
        run.stdin.close()


def read_blobs(changes):
    """(repo_id, blob_oid, content): the text of each distinct blob; null where it is missing or isn't UTF-8."""
    import pandas as pd

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for root, part in pdf.groupby("repo_id"):
                rows = []
                for oid, text in blob_texts(root, part["blob_oid"].tolist()):
                    rows.append((root, oid, text))
                    if len(rows) == BLOBS:
                        yield pd.DataFrame(rows, columns=["repo_id", "blob_oid", "content"])
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=["repo_id", "blob_oid", "content"])

    once = changes.where("blob_oid IS NOT NULL").select("repo_id", "blob_oid").distinct()
    return once.mapInPandas(load, "repo_id string, blob_oid string, content string")
