"""Session helpers shared by all plans: table access, lineage cuts, checked broadcasts."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a lookup side may be broadcast; beyond it a shuffle join is planned.
BROADCAST_ROWS = 200_000
#: Bytes of a checkpoint, which is compressed, up to which the estimate of a frame's size stands.
SMALL_FILES = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named by spark.checkpoint.dir; a temporary one only on a local master without that setting."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local[") or sc.master == "local":
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="graphdrift-"))
    else:
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")


def _files(df: DataFrame):
    """(file system, path) of the checkpoint that df reads, or None."""
    jvm, at = df.sparkSession._jvm, df._jdf.logicalPlan().rdd().getCheckpointFile()
    if not at.isDefined():
        return None
    path = jvm.org.apache.hadoop.fs.Path(at.get())
    return path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()), path


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder and forget its lineage.

    Spark keeps the size that it estimated from Parquet files, which may be a small part of what their rows take, and would
    broadcast whole tables through the driver. So only small frames keep it; joins with others go by the sizes measured when they
    are shuffled.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    out = df.checkpoint(eager=True)
    plan, files = out._jdf.logicalPlan(), _files(out)
    if files is None or files[0].getContentSummary(files[1]).getLength() <= SMALL_FILES:
        return out
    none = spark._jvm.scala.Option.empty()
    unsized = plan.copy(plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(), False, none, spark._jsparkSession, none, none)
    return DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, unsized), spark)


def unsized(df: DataFrame) -> DataFrame:
    """df without the size that Spark estimates from its files; joins with it go by the sizes measured when they are shuffled."""
    spark = df.sparkSession
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(df._jdf.queryExecution().toRdd(), df._jdf.schema(), False), spark)


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether df has at most `rows` rows; reads no further than that."""
    return df.limit(rows + 1).count() <= rows


def lookup(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if a count proves that it holds at most `rows` rows."""
    return F.broadcast(df) if at_most(df, rows) else df


class Scratch:
    """Frames kept under a name as Parquet in the shared checkpoint folder, for loops of many rounds.

    Columns of numbers take a small part there of what a checkpoint of their rows takes. Keeping a frame under a name that is
    taken replaces that one, whose files are deleted; nothing else may still read it. Shuffle files of earlier rounds go when
    the JVM collects its garbage, so each round asks it to.
    """

    def __init__(self, spark: SparkSession):
        ensure_checkpoint_dir(spark)
        self.spark, self.at = spark, {}
        self.root = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/scratch-{uuid.uuid4().hex}"

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.drop(name)
        self.at[name] = path
        self.free()
        return self.spark.read.schema(df.schema).parquet(path)

    def free(self) -> None:
        """Ask for the shuffle files of frames that nothing refers to; keep() still refers to its own frame when it asks."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, name: str) -> None:
        if old := self.at.pop(name, None):
            at = self.spark._jvm.org.apache.hadoop.fs.Path(old)
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)




_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package: adds it to the session as an archive, once, unless they find it anyway by
    PYTHONPATH or their working folder."""
    root = Path(__file__).resolve().parents[2]
    found = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root in found or Path.cwd() == root or spark.sparkContext.applicationId in _SHIPPED:
        return
    archive = Path(tempfile.mkdtemp(prefix="graphdrift-")) / "graphdrift.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted((root / "graphdrift").rglob("*.py")):
            z.write(f, f.relative_to(root))
    spark.sparkContext.addPyFile(str(archive))
    _SHIPPED.add(spark.sparkContext.applicationId)
