"""Where intermediate results live."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    A local session that names none (a unit test) gets a folder of its own; on a cluster each
    executor would write to its own disk, so there the setting is required.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        named = context.getCheckpointDir()
    if named is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="songloom-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path under the shared folder, in a subfolder of the running application.

    Whoever owns the shared folder can drop that subfolder once the application has ended.
    """
    application = spark.sparkContext.applicationId
    return f"{shared_dir(spark)}/songloom/{application}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Store ``df`` once in the shared folder, so losing an executor costs no recomputation.

    A Parquet table rather than a checkpoint, because readers prune its columns and know its
    size. The schema is passed along, so reading it back needs no job.
    """
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
