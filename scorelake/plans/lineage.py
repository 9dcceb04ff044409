"""Cutting lineage through the reliable checkpoint folder of the session."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder.

    It is the one the cluster names in ``spark.checkpoint.dir``. Only a session
    whose executors are threads of its own process (``local[n]``: tests, the bench)
    may set a temporary folder where none is named: on a cluster, a machine-local
    folder would be lost together with its machine.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
                raise RuntimeError("set spark.checkpoint.dir to a shared folder")
            folder = tempfile.mkdtemp(prefix="scorelake-checkpoint-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and read it back."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Like :func:`cut`, for tables of the size of the input: packed columns, of which a later step reads only its own.

    They take a small part of the disk that checkpointed rows do, and stay in the checkpoint folder until its owner clears it.
    A join with such a table is a :func:`merged` one.
    """
    folder = f"{checkpoint_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    return merged(df.sparkSession.read.schema(df.schema).parquet(folder))


def merged(df: DataFrame) -> DataFrame:
    """``df``, whose joins sort and merge both sides unless the other side is to be broadcast.

    Spark takes the size of packed files for the size of a table, so it would broadcast rows of fifty times its limit from the driver.
    """
    return df.hint("merge")


def stacked(top: DataFrame, bottom: DataFrame) -> DataFrame:
    """The rows of both tables, as dealt out by no key.

    Spark 4.1 takes a union of tables dealt out alike for dealt out by their keys, but may run it in the partitions of all, one after the
    other, where a join by the keys meets too many. An empty table beside them, which is dealt out by nothing, keeps it from that.
    """
    spark = top.sparkSession
    return top.unionByName(bottom).union(spark.createDataFrame(spark.sparkContext.emptyRDD(), top.schema))
