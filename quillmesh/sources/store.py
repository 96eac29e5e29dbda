"""A vector database as a folder of Parquet tables: vectors, document_metadata, hash_chunk_ids, and its description."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, MapType, NumericType, StringType, StructType

from quillmesh.functions.vectors import norm

MAX_ROWS_PER_FILE = 100_000
TABLES = ["vectors", "document_metadata", "hash_chunk_ids"]


def chunk_id(doc_hash: Column, chunk_idx: Column, file_path: Column) -> Column:
    """A reproducible id of a chunk, as an unsigned decimal number."""
    return F.conv(F.hex(F.xxhash64(file_path, doc_hash, chunk_idx)), 16, 10)


def metadata_json(*columns: str) -> Column:
    """Metadata as JSON, nulls kept."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def sanitized(df: DataFrame, *columns: str) -> list[Column]:
    """Metadata columns as scalars: numbers, strings and truth values as they are, anything else as its text."""
    scalar = (StringType, NumericType, BooleanType)
    of = {f.name: f.dataType for f in df.schema.fields}
    return [(F.col(c) if isinstance(of[c], scalar) else F.to_json(c) if isinstance(of[c], (ArrayType, MapType, StructType)) else F.col(c).cast("string")).alias(c) for c in columns]


def chunk_metadata(df: DataFrame, *columns: str) -> Column:
    """A chunk's metadata as JSON: scalars, nulls left out."""
    return F.to_json(F.struct(*sanitized(df, *columns)))


def parsed_metadata(text: Column, schema: str) -> Column:
    """JSON back to a struct; null for a broken row, which callers drop."""
    return F.from_json(text, schema, {"mode": "PERMISSIVE"})


class VectorStore:
    """One database under ``root/name``. Builds are all-or-nothing and never overwrite."""

    def __init__(self, spark: SparkSession, root: str, name: str):
        self.spark, self.root, self.name = spark, root.rstrip("/"), name
        self.path = f"{self.root}/{name}"
        jvm = spark._jvm
        self._fs = jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._at = jvm.org.apache.hadoop.fs.Path

    def exists(self) -> bool:
        return self._fs.exists(self._at(self.path))

    def build(self, vectors: DataFrame, metadata: DataFrame, chunk_ids: DataFrame, dimensions: int) -> dict:
        """Write all tables to a temporary folder and rename it; on failure nothing remains.

        ``vectors``: id, vector, text, metadata. A database of that name is an error.
        """
        if self.exists():
            raise FileExistsError(self.path)
        part = f"{self.root}/_building_{self.name}"
        self._fs.delete(self._at(part), True)  # what a failed attempt left
        try:
            vectors.withColumn("norm", norm(F.col("vector"))).write.option("maxRecordsPerFile", MAX_ROWS_PER_FILE).parquet(f"{part}/vectors")
            metadata.write.parquet(f"{part}/document_metadata")
            chunk_ids.write.parquet(f"{part}/hash_chunk_ids")
            described = {"distance_metric": "cosine", "dimensions": dimensions, "vector_type": "float32", "index_type": "FLAT", "num_vectors": self.spark.read.parquet(f"{part}/vectors").count()}
            self.spark.createDataFrame([(json.dumps(described),)], "value string").coalesce(1).write.text(f"{part}/index_metadata")
            if not self._fs.rename(self._at(part), self._at(self.path)):
                raise OSError(f"could not rename {part}")
        except BaseException:
            self._fs.delete(self._at(part), True)
            raise
        return described

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def describe(self) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/index_metadata").first()[0])

    def files(self) -> DataFrame:
        """(file_name, file_path) of the stored documents."""
        return self.table("document_metadata").select("file_name", "file_path")

    def point_read(self, ids: DataFrame, columns: list[str]) -> DataFrame:
        """Rows by id; the ids are few, Spark broadcasts them by their size."""
        return self.table("vectors").select("id", *columns).join(ids.select("id"), "id")

    def delete_documents(self, hashes: DataFrame) -> VectorStore:
        """A new database ``name_next`` without the documents of these hashes and their chunks."""
        gone = hashes.select("hash").distinct()
        chunk_ids, vectors = self.table("hash_chunk_ids"), self.table("vectors").drop("norm")
        kept_ids = chunk_ids.join(gone, "hash", "left_anti")
        other = VectorStore(self.spark, self.root, f"{self.name}_next")
        kept = vectors.join(kept_ids.select(F.col("tiledb_id").alias("id")), "id", "left_semi")
        other.build(kept, self.table("document_metadata").join(gone, "hash", "left_anti"), kept_ids, self.describe()["dimensions"])
        return other

    def _copy(self, source: str, target: str) -> None:
        """Copy a database by reading and writing its tables, which every executor takes part in; it appears under its name once complete."""
        part = f"{target.rpartition('/')[0]}/_copying_{self.name}"
        self._fs.delete(self._at(part), True)
        for name in TABLES:
            self.spark.read.parquet(f"{source}/{name}").write.option("maxRecordsPerFile", MAX_ROWS_PER_FILE).parquet(f"{part}/{name}")
        self.spark.read.text(f"{source}/index_metadata", wholetext=True).coalesce(1).write.text(f"{part}/index_metadata")
        self._fs.delete(self._at(target), True)
        if not self._fs.rename(self._at(part), self._at(target)):
            raise OSError(f"could not rename {part}")

    def backup(self, folder: str) -> None:
        """Copy the database; an older backup of that name is replaced once the copy is complete."""
        self._fs.mkdirs(self._at(folder))
        self._copy(self.path, f"{folder}/{self.name}")

    def restore(self, folder: str) -> None:
        """Copy a backup here; an existing database is an error."""
        if self.exists():
            raise FileExistsError(self.path)
        self._copy(f"{folder}/{self.name}", self.path)

    def export(self, target: str) -> str:
        """The database as one zip file on the driver's side of the file system, for handing it on; files are copied as they are, one at a time."""
        hadoop = self.spark._jvm.org.apache.hadoop
        out = self.spark._jvm.java.util.zip.ZipOutputStream(self._fs.create(self._at(target), True))
        root = self._fs.resolvePath(self._at(self.path)).toString()
        found = self._fs.listFiles(self._at(self.path), True)
        while found.hasNext():
            file = found.next().getPath()
            out.putNextEntry(self.spark._jvm.java.util.zip.ZipEntry(file.toString()[len(root) + 1 :]))
            source = self._fs.open(file)
            hadoop.io.IOUtils.copyBytes(source, out, 65536, False)
            source.close()
            out.closeEntry()
        out.close()
        return target

    def delete(self) -> None:
        self._fs.delete(self._at(self.path), True)


def user_databases(registry: DataFrame, name_col: str = "db_name") -> DataFrame:
    """The registry without the built-in manual."""
    return registry.where(F.col(name_col) != "user_manual")
