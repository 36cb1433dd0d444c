import subprocess

import pytest
from pyspark.sql import functions as F

from graphdrift.functions.imports import register_table_function
from graphdrift.sources.git import read_blobs, register, repo_root
from graphdrift.sources.store import Store
from graphdrift.streaming import incremental as I


def _git(root, *args):
    subprocess.run(["git", "-c", "user.name=Ann", "-c", "user.email=a@x", "-C", root, *args], check=True, capture_output=True)


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    _git(root, "init", "-q")
    (root / "src").mkdir()
    (root / "src/a.py").write_text("import os\n" * 20)
    (root / "notes.txt").write_text("x")
    _git(root, "add", "-A")
    _git(root, "commit", "-qm", "one\n\nbody")
    _git(root, "mv", "src/a.py", "src/b.py")
    (root / "c.go").write_text('import "fmt"\n')
    _git(root, "add", "-A")
    _git(root, "commit", "-qm", "two")
    _git(root, "rm", "-q", "c.go")
    _git(root, "commit", "-qm", "three")
    return str(root)


def test_git_sources(spark, repo):
    register(spark)
    log = spark.read.format("gitlog").option("path", f"{repo}/src").load().orderBy("scan_order").collect()
    assert [r["message"] for r in log] == ["one\n\nbody", "two", "three"] and {r["repo_id"] for r in log} == {repo_root(repo)}
    tree = spark.read.format("gittree").option("path", repo).load()
    assert {(r["scan_order"], r["path"]) for r in tree.collect()} == {(1, "src/a.py"), (2, "src/b.py"), (2, "c.go"), (3, "src/b.py")}
    ch = spark.read.format("gitchanges").option("path", repo).load()
    assert {(r["scan_order"], r["path"], r["op"]) for r in ch.collect()} == {
        (1, "src/a.py", "upsert"), (2, "src/a.py", "delete"), (2, "src/b.py", "upsert"), (2, "c.go", "upsert"), (3, "c.go", "delete"),
    }
    assert {r["content"] for r in read_blobs(ch).collect()} == {"import os\n" * 20, 'import "fmt"\n'}
    assert spark.read.format("gitlog").option("path", repo).option("max", 2).load().count() == 2


def test_ranges_of_commits_and_missing_blobs(spark, repo, monkeypatch):
    from graphdrift.sources import git as G

    monkeypatch.setattr(G, "RANGE", 2)
    parts = G.LogReader({"path": repo}).partitions()
    assert [(p.skip, p.size, p.total) for p in parts] == [(0, 2, 3), (2, 1, 3)]
    rows = [r for p in parts for r in G.LogReader({"path": repo}).read(p)]
    assert sorted((r[2], r[6]) for r in rows) == [(1, "one\n\nbody"), (2, "two"), (3, "three")]
    changes = [r for p in parts for r in G.ChangeReader({"path": repo}).read(p)]
    assert sorted((r[2], r[3], r[4]) for r in changes) == [(1, "src/a.py", "upsert"), (2, "c.go", "upsert"), (2, "src/a.py", "delete"), (2, "src/b.py", "upsert"), (3, "c.go", "delete")]
    oid = next(r[5] for r in changes if r[3] == "c.go" and r[5])
    assert list(G.blob_texts(repo, ["0" * 40, oid])) == [("0" * 40, None), (oid, 'import "fmt"\n')]


def test_files_without_a_blob_id_are_parsed_apart(spark):
    from graphdrift.functions.imports import extract

    files = spark.createDataFrame([(1, "python", "import os", None), (2, "python", "import json", None), (3, "python", "import os", None), (4, "python", None, None), (5, None, "import os", "b")], "k int, la string, t string, b string")
    assert {r["k"]: r["imports"] for r in extract(files, ["k"], "la", "t", "b").collect()} == {1: ["os"], 2: ["json"], 3: ["os"], 4: [], 5: []}


def test_store_sets_other_schemas_aside_only_on_writing(spark, tmp_path):
    st = Store(spark, str(tmp_path / "store"))
    spark.range(3).withColumn("repo_id", F.lit("/r")).write.partitionBy("repo_id").parquet(st.path("repositories"))
    with pytest.raises(ValueError):
        st.read("repositories")
    assert spark.read.parquet(st.path("repositories")).count() == 3
    st.upsert("repositories", spark.createDataFrame([("/r", "root")], "repo_id string, repo_root string"))
    assert [tuple(r) for r in st.read("repositories").select("repo_id", "repo_root").collect()] == [("/r", "root")]


def test_store(spark, tmp_path):
    st = Store(spark, str(tmp_path / "store"))
    cols = "repo_id string, hash string, scan_order bigint, author_name string, author_email string, message string, commit_ts bigint, tree_id string"
    row = lambda h, n, repo="/r:1": (repo, h, n, "a", "e", "m", 1, "t")
    st.upsert("commits", spark.createDataFrame([row("x", 1), row("x", 2), row("y", 1)], cols), "scan_order")
    st.upsert("commits", spark.createDataFrame([row("x", 5), row("z", 1, "/other")], cols), "scan_order")
    got = {(r["repo_id"], r["hash"], r["scan_order"]) for r in st.read("commits").collect()}
    assert got == {("/r:1", "x", 5), ("/r:1", "y", 1), ("/other", "z", 1)}
    st.insert_absent("commits", spark.createDataFrame([row("y", 9), row("w", 3)], cols))
    assert {(r["hash"], r["scan_order"]) for r in st.read("commits").where("repo_id = '/r:1'").collect()} == {("x", 5), ("y", 1), ("w", 3)}
    st.clear("/r:1")
    assert {r["repo_id"] for r in st.read("commits").collect()} == {"/other"}
    assert st.read("frames").count() == 0
    spark.range(1).withColumn("repo_id", F.lit("old")).write.parquet(st.path("frames"))
    aside = st.prepare("frames")
    assert spark.read.parquet(aside).count() == 1 and st.prepare("frames") is None
    assert st.read("frames").count() == 0 and st.read("frames").columns[0] == "repo_id"


def test_table_function(spark):
    register_table_function(spark)
    rows = spark.sql("""SELECT import_name FROM module_imports('import a\nimport b.c', 'python')""").collect()
    assert [r[0] for r in rows] == ["a", "b"]


CHANGE = "repo_id string, path string, seq bigint, op string, package_name string, targets array<string>"


def test_stream_equals_batch(spark, tmp_path):
    rows = [
        ("r", "a", 1, "upsert", "p", ["x", "y", "x"]), ("r", "a", 2, "upsert", "p", ["y"]), ("r", "b", 1, "upsert", "p", ["y", "p"]),
        ("r", "b", 3, "delete", None, None), ("r", "c", 1, "upsert", "q", None), ("r", "a", 2, "upsert", "p", ["y"]),
    ]
    df = spark.createDataFrame(rows, CHANGE)
    batch = {tuple(r) for r in I.edge_weights(I.signed_changes_batch(df)).collect()}
    assert batch == {("r", "p", "y", 1)}
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    I.run_available(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "log"))
    assert {tuple(r) for r in I.edge_weights(spark.read.parquet(str(tmp_path / "out")).drop("batch")).collect()} == batch
