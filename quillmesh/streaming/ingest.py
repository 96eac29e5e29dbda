"""Incremental ingestion: new files of a folder become chunks as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from quillmesh.operators.chunking import split_documents


def file_stream(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The Parquet files of a folder, or one file, as a stream."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())


def document_stream(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """Documents of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def ingest(stream: DataFrame, target: str, checkpoint: str, size: int = 700, overlap: int = 250, available_now: bool = True):
    """Append the chunks of new documents to ``target``, each once (the file sink commits per batch)."""
    chunks = split_documents(stream, size=size, overlap=overlap)
    writer = chunks.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="5 seconds")).start()
