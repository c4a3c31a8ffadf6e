"""Sessions, and scratch tables that cut lineage in storage shared by all executors."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "lexigraph", cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benches on one machine; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.  Where none is set, a local session gets one of our own; a cluster, whose
    executors would each write to a disk of their own, gets an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = found.get() if found.isDefined() else None
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="lexigraph-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def rename_path(spark: SparkSession, path: str, to: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    if not p(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).rename(p(path), p(to)):
        raise OSError(f"cannot rename {path}")


class Scratch:
    """Intermediate tables of one operator run, as Parquet in the shared folder.

    A written table survives the loss of executors and ends the lineage.  ``put`` under a name that is in use drops
    the older table once the new one is complete; ``drop`` removes one by name.  As results are read after the operator
    is done, the rest goes when the driver ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.paths = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}", {}

    def put(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        schema = df.schema
        df.write.parquet(path)
        if not self.paths:
            root = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
            root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(root)
        old = self.paths.get(name)
        self.paths[name] = path
        if old:
            drop_path(self.spark, old)
        return self.spark.read.schema(schema).parquet(path)

    def put_all(self, name: str, frames: Iterable[DataFrame]) -> DataFrame:
        """One table of all frames, made one after the other, so that only one of them has its shuffles on disk."""
        whole = None
        for df in frames:
            if whole is None:
                whole = self.put(name, df)
            else:
                df.write.mode("append").parquet(self.paths[name])
            self.free()
        return self.spark.read.schema(whole.schema).parquet(self.paths[name])

    def free(self) -> None:
        """Has shuffles that nothing refers to any more removed; else they stay until the driver happens to collect its garbage."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def fresh(self) -> Scratch:
        """Another set of tables: for an operator whose result is read later, whatever its caller puts next."""
        return Scratch(self.spark)

    def drop(self, *names: str) -> None:
        for n in names:
            if n in self.paths:
                drop_path(self.spark, self.paths.pop(n))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
