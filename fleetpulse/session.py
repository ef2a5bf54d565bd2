"""Session helpers: the settings the library relies on and the shared folder for cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

REMOVE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app_name: str = "fleetpulse", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, adaptive execution, skew-join splitting and Arrow transfer."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Rows get ten times wider in the feature stage, so keep its tasks when the input looks small.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared scratch folder, read from `spark.checkpoint.dir`.

    Only a session of one machine (master `local`) without that setting gets a fresh local folder, remembered as the
    checkpoint folder of its context. On a cluster a local folder would lose what other machines write, so that is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if context.getCheckpointDir() is None:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="fleetpulse-"))
    return context.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that no other run uses."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


_SCOPES: list[list[str]] = []  # of each open `short_lived`, the folders of the tables stored in it


@contextmanager
def short_lived(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Remove the tables that `pinned` stores inside, when the block ends, but for those given to the function it yields.

    Only for steps whose results no longer read the tables that go: results kept must themselves be stored.
    """
    own: list[str] = []
    _SCOPES.append(own)

    def keep(df: DataFrame) -> DataFrame:
        own.remove(df.stored_at)
        if len(_SCOPES) > 1:
            _SCOPES[-2].append(df.stored_at)
        return df

    try:
        yield keep
    finally:
        _SCOPES.remove(own)
        for path in own:
            _remove(spark, path)


def unpinned(df: DataFrame) -> None:
    """Remove a table that `pinned` has stored and nothing reads any more."""
    for scope in _SCOPES:
        if df.stored_at in scope:
            scope.remove(df.stored_at)
    _remove(df.sparkSession, df.stored_at)


def _remove(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def pinned(df: DataFrame) -> DataFrame:
    """Compute `df` once, write it to the shared folder and read it back in every later use.

    Used before several passes over something costly (forest scores). It cuts the lineage, and since the
    files are not on executors, losing one loses nothing. Shuffle files of the write are of no use afterwards and
    are removed when it ends; otherwise a job of many such steps keeps them all until the driver's next collection.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "pinned")
    before = spark.conf.get(REMOVE_SHUFFLES, None)
    spark.conf.set(REMOVE_SHUFFLES, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(REMOVE_SHUFFLES)
        else:
            spark.conf.set(REMOVE_SHUFFLES, before)
    stored = spark.read.schema(df.schema).parquet(path)
    stored.stored_at = path
    if _SCOPES:
        _SCOPES[-1].append(path)
    return stored
