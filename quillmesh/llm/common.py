"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folder of the public vocabulary files; a parameter of every operator that needs one.
TOKENIZERS = "/opt/tokenizers"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table of the data directory.

    An input of fewer partitions than cores (one small file) is dealt out evenly;
    tables of many files, as on a cluster, pass unchanged.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def checkpoint(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage in the shared folder of ``spark.checkpoint.dir``.

    The folder is the one the cluster names. Only a local session without that
    setting (a test) gets a temporary folder of its own; on a cluster its absence is
    an error, for executors couldn't read a folder of the driver's machine.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir", None)
        if named is None and not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="quillmesh-checkpoint-"))
    return df.checkpoint(eager)


def is_email(file_name: Column) -> Column:
    """True where the file name, blanks at its ends dropped, ends in .eml or .msg in any letter case."""
    return F.coalesce(F.lower(F.regexp_replace(file_name, r"(?U)^\s+|\s+$", "")).rlike(r"\.(eml|msg)$"), F.lit(False))


def vocabulary_file(name: str, folder: str = TOKENIZERS) -> str:
    return os.path.join(folder, name)


def sent_file(spark: SparkSession, path: str) -> str:
    """Send a file of the driver's machine to every executor, once; returns what ``received`` takes.

    A second file of the same name, which Spark would take for the first, is read
    by its path on each machine.
    """
    context, name = spark.sparkContext, os.path.basename(path)
    sent = context.__dict__.setdefault("_quillmesh_files", {})
    if name not in sent:
        context.addFile(path)
        sent[name] = path
    return name if sent[name] == path else path


def received(name: str) -> str:
    """Where an executor has a file that was sent."""
    return name if os.path.isabs(name) else SparkFiles.get(name)
