"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(name: str = "articleflow", cores: str = "8", memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; on a cluster pass your own session instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


_LOCAL_FOLDERS: dict[str, str] = {}


def work_dir(spark: SparkSession) -> str:
    """The folder all executors share, as named by ``spark.checkpoint.dir``.

    Only a local session without the setting gets a temporary folder of its own.
    """
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        app = context.applicationId
        if app not in _LOCAL_FOLDERS:
            _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="articleflow-")
        shared = _LOCAL_FOLDERS[app]
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(f"{shared.rstrip('/')}/checkpoints")
    return shared


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder; every run gets its own."""
    return f"{work_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


BYTES_PER_TASK = 8 << 20


def source_bytes(df: DataFrame) -> int | None:
    """Bytes of the files that a plan reads, each relation once; None when it reads none.

    Only files have a size that is known before a run: estimates of joins multiply their sides, and local rows
    count as endless.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = {}
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.nodeName().startswith("LogicalRelation"):
            sizes[leaf.relation().hashCode()] = int(str(leaf.stats().sizeInBytes()))
    return sum(sizes.values()) if sizes else None


def by_key(df: DataFrame, *key: str) -> DataFrame:
    """Place rows by key while they are still compact, so that all later work by key stays local.

    The number is given where files tell it, so adaptive execution does not merge CPU-heavy partitions for being
    small: all cores for little data, as many as the files ask for with more. Otherwise the session's number holds.
    """
    size = source_bytes(df)
    if size is None:
        return df.repartition(*key)
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, size // BYTES_PER_TASK), *key)


def staged(df: DataFrame, label: str) -> DataFrame:
    """The rows written once to the folder all executors share, and read back: cuts lineage, and files have a known size."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(scan: DataFrame, key: str) -> DataFrame:
    """Use all cores on a scan that has fewer splits than cores; a large scan stays as it is."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores, key) if scan.rdd.getNumPartitions() < cores else scan


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives lost executors, and keeps iterative plans short."""
    work_dir(df.sparkSession)
    return df.checkpoint()
