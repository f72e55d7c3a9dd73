"""Session helpers: a local session for tests, and durable scratch storage for iterative plans.

Iterative operators cut their lineage by writing to the shared folder named in
``spark.checkpoint.dir``, so that a lost executor never forces a replay of earlier rounds.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

#: Folders of the open :func:`run_scratch` blocks, innermost last.
_SCOPES: list[str] = []
#: Root folder of each application that names none itself.
_ROOTS: dict[str, str] = {}


def local_session(cores: str | int = "*", app: str = "splitwright", memory: str = "8g") -> SparkSession:
    """Small single-machine session used by the tests and the benchmark."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints; a temporary folder is accepted in local mode only."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or _ROOTS.get(context.applicationId)
    if root is None:
        root = context.getCheckpointDir()
        if root is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
            root = tempfile.mkdtemp(prefix="splitwright-")
            atexit.register(shutil.rmtree, root, ignore_errors=True)
        _ROOTS[context.applicationId] = root
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
    return root


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint that keeps the partitions and the row order inside them."""
    scratch_root(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, label: str) -> str:
    root = _SCOPES[-1] if _SCOPES else scratch_root(spark)
    return f"{root}/{label}-{uuid.uuid4().hex}"


@contextmanager
def run_scratch(spark: SparkSession) -> Iterator[str]:
    """A scratch folder for one run: all tables and checkpoints written inside go when the block ends.

    DataFrames that read them end with it, so results are written or collected inside. Works on every
    file system that Hadoop knows.
    """
    root = scratch_root(spark)
    folder = f"{root}/run-{uuid.uuid4().hex}"
    _SCOPES.append(folder)
    spark.sparkContext.setCheckpointDir(f"{folder}/checkpoints")
    try:
        yield folder
    finally:
        _SCOPES.remove(folder)
        spark.sparkContext.setCheckpointDir(f"{_SCOPES[-1]}/checkpoints" if _SCOPES else root)
        _delete(spark, folder)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back; ``by`` names a column whose values get files of their own.

    Compared with a checkpoint the result keeps column pruning, filter pushdown and the size
    statistics from which Spark chooses its join strategies.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path, partitionBy=by)
    return spark.read.schema(df.schema).parquet(path)


def single_rows(spark: SparkSession, size: int = 8_000_000) -> None:
    """Limit Arrow batches of the session to ``size`` bytes, unless its limit is lower: a larger row is a batch of its own."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    limit = int(spark.conf.get(name).rstrip("b"))
    if not 0 < limit <= size:
        spark.conf.set(name, str(size))


@dataclass
class Settled:
    """A written result that owns its table. DataFrames over ``table`` end when it is released."""

    table: DataFrame
    path: str

    def release(self) -> None:
        _delete(self.table.sparkSession, self.path)


def settled(spark: SparkSession, build: Callable[[], DataFrame], label: str) -> Settled:
    """Write the result of ``build`` once and drop every table and checkpoint that was written on its way.

    A run that settles each of its steps needs scratch space for one step at a time. What ``build`` returns must
    be the only thing that outlives it; tables written before the call stay.
    """
    path = scratch_path(spark, label)
    with run_scratch(spark):
        df = build()
        schema = df.schema
        df.write.parquet(path)
    return Settled(spark.read.schema(schema).parquet(path), path)


def lookup_side(df: DataFrame) -> DataFrame:
    """Materialise the unique side of a join.

    Adaptive execution splits a hot key of the other side only when this side is read on its own. An
    aggregate that already is partitioned by the join key is not, and would leave a key that holds a
    third of all rows to one task. The written table also has a size, so small ones are broadcast.
    """
    return stored(df, "lookup")


def spread_small(df: DataFrame) -> DataFrame:
    """Give a scan of few files to all cores when every row means much work; larger scans stay."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
