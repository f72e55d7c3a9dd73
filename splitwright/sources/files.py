"""File manifests and reusable derived tables."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PIECE = 1 << 22


def file_manifest(spark: SparkSession, paths: str | Sequence[str], pattern: str | None = None) -> DataFrame:
    """``path, sha256, n_bytes`` per file, of any size: a task reads a file in pieces and keeps none.

    Files are listed by Spark; their bytes come through Arrow's file systems, which must know the scheme.
    """
    reader = spark.read.format("binaryFile")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    files = reader.load(paths if isinstance(paths, str) else list(paths))

    def hashed(batches):
        for batch in batches:
            digests = [_sha256(p) for p in batch["path"].to_pylist()]
            yield pa.record_batch([batch["path"], pa.array(digests, pa.string()), batch["n_bytes"]], ["path", "sha256", "n_bytes"])

    listed = files.select("path", F.col("length").alias("n_bytes"))
    return listed.mapInArrow(hashed, "path string, sha256 string, n_bytes long")


def _sha256(path: str) -> str:
    local = re.match(r"file:/*(/.*)", path)
    files, name = (fs.LocalFileSystem(), local[1]) if local else fs.FileSystem.from_uri(path)
    digest = hashlib.sha256()
    with files.open_input_stream(name) as stream:
        while piece := stream.read(_PIECE):
            digest.update(piece)
    return digest.hexdigest()


def cached_table(spark: SparkSession, path: str, build: Callable[[], DataFrame], rebuild: bool = False) -> DataFrame:
    """Read the table at ``path``; build and write it first when it is missing or ``rebuild``."""
    if not rebuild:
        try:
            return spark.read.parquet(path)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_diagnostics(metrics: DataFrame, path: str) -> str:
    """Tidy ``section, metric, value`` rows as JSON lines (one small file)."""
    metrics.coalesce(1).write.mode("overwrite").json(path)
    return path
