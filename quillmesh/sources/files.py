"""Reading files: directory scans, loaders by extension, transcripts."""

from __future__ import annotations

import csv
import datetime
import email
import email.policy
import io
import os
import re
from collections.abc import Callable, Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quillmesh.functions import paths
from quillmesh.functions.html import whole_text
from quillmesh.sources.compound import load_msg, load_xls
from quillmesh.sources.formats import load_docx, load_rtf, load_xlsx
from quillmesh.sources.pdf import load_pdf

Loader = Callable[[bytes], "str | None"]

#: Encodings tried in order for plain text.
ENCODINGS = ["utf-8", "cp1252", "latin-1"]

DOCUMENT_SCHEMA = StructType([StructField(n, StringType()) for n in ("page_content", "file_path", "file_type", "file_name", "creation_date", "modification_date", "hash", "document_type")])
TRANSCRIPT_SCHEMA = StructType([StructField("page_content", StringType()), StructField("metadata", StructType(DOCUMENT_SCHEMA.fields[1:]))])


def decode(content: bytes) -> str:
    """Text in the first encoding that fits; a byte-order mark survives and is dropped by the normaliser."""
    for encoding in ENCODINGS:
        try:
            return content.decode(encoding)
        except UnicodeDecodeError:
            continue
    return content.decode("latin-1")


def load_text(content: bytes) -> str | None:
    text = decode(content)
    return text if text.strip() else None


def load_csv(content: bytes) -> str | None:
    """Fields joined by blanks, records by line ends; the header is a record like others."""
    rows = csv.reader(io.StringIO(decode(content), newline=""))
    text = "\n".join(" ".join(row) for row in rows)
    return text if text.strip() else None


def load_html(content: bytes) -> str | None:
    """All text of a page, its navigation and footers too; only scripts, styles and templates have none."""
    text = whole_text(decode(content))
    return text if text.strip() else None


def load_email(content: bytes) -> str | None:
    """Subject, every plain part, and the text of HTML parts, one below the other; a message of one part as it stands."""
    message = email.message_from_bytes(content, policy=email.policy.default)
    parts = [f"Subject: {message['subject']}"] if message["subject"] else []
    for part in message.walk():
        kind = part.get_content_type()
        if part.is_multipart() or kind not in ("text/plain", "text/html") and message.is_multipart():
            continue
        body = part.get_content()
        if isinstance(body, str):
            parts.append(whole_text(body) if kind == "text/html" and message.is_multipart() else body)
    return "\n".join(p for p in parts if p.strip()) or None


class LoaderRegistry:
    """Loaders by extension. Formats that need a library that isn't installed are added with ``register``."""

    def __init__(self) -> None:
        self._loaders: dict[str, Loader] = {
            ".txt": load_text, ".md": load_text, ".csv": load_csv, ".html": load_html, ".htm": load_html, ".eml": load_email,
            ".docx": load_docx, ".xlsx": load_xlsx, ".xlsm": load_xlsx, ".rtf": load_rtf, ".msg": load_msg, ".xls": load_xls, ".pdf": load_pdf,
        }

    def register(self, extension: str, loader: Loader) -> None:
        self._loaders[extension.lower()] = loader

    def extensions(self) -> list[str]:
        return sorted(self._loaders)

    def load(self, extension: str, content: bytes) -> tuple[str | None, str | None]:
        """(text, error): a loader's failure never ends the job."""
        loader = self._loaders.get(extension)
        if loader is None:
            return None, f"no loader for {extension or 'files without extension'}"
        try:
            text = loader(content)
        except Exception as problem:  # noqa: BLE001 - the row carries it
            return None, f"{type(problem).__name__}: {problem}"
        return text, None if text else "no text"


def scan(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """(path, modificationTime, length, content) of the files of known document types."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return compatible(files)


def compatible(files: DataFrame) -> DataFrame:
    """Files (path) of known document types."""
    return files.where(paths.extension(F.col("path")).isin(paths.DOCUMENT_EXTENSIONS))


def incompatible(files: DataFrame) -> DataFrame:
    """Files of unknown types."""
    return files.where(~paths.extension(F.col("path")).isin(paths.DOCUMENT_EXTENSIONS))


@F.pandas_udf(StringType())
def creation_time(found: pd.Series) -> pd.Series:
    """ISO creation (status change) time in UTC of files that the executor's file system has; null for others, as object stores keep none."""

    def one(path: str | None) -> str | None:
        try:
            at = os.stat(unquote(re.sub("^file:/*", "/", path or ""))).st_ctime
        except OSError:
            return None
        return datetime.datetime.fromtimestamp(at, datetime.timezone.utc).replace(tzinfo=None).isoformat(timespec="microseconds")

    return found.map(one)


def iso_time(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def extract(files: DataFrame, registry: LoaderRegistry | None = None) -> DataFrame:
    """One row per file: the document columns and ``error`` (null if it was read). Order of rows isn't defined.

    Keep ``error IS NULL`` as documents; the rest is the log of rejected files.
    """
    loaders = registry or LoaderRegistry()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            loaded = [loaders.load(kind, bytes(content)) for kind, content in zip(batch["file_type"], batch["content"])]
            batch["page_content"] = [t for t, _ in loaded]
            batch["error"] = [e for _, e in loaded]
            yield batch.drop(columns="content")

    meta = files.select(
        F.col("path").alias("file_path"),
        paths.extension(F.col("path")).alias("file_type"),
        paths.base_name(F.col("path")).alias("file_name"),
        iso_time(F.col("modificationTime")).alias("modification_date"),
        "content",
    )
    out = meta.mapInPandas(run, "file_path string, file_type string, file_name string, modification_date string, page_content string, error string")
    return out.select("page_content", "file_path", "file_type", "file_name", creation_time(F.col("file_path")).alias("creation_date"), "modification_date", paths.content_hash(F.col("page_content")).alias("hash"), F.lit("document").alias("document_type"), "error")


def ingest_counts(extracted: DataFrame, by: str = "file_type") -> DataFrame:
    """(file_type, files, read, empty, failed, characters): what became of the files of each type; combined before the shuffle."""
    empty = F.col("error") == "no text"
    return extracted.groupBy(by).agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if(F.col("error").isNull()).alias("read"),
        F.count_if(empty).alias("empty"),
        F.count_if(F.col("error").isNotNull() & ~empty).alias("failed"),
        F.coalesce(F.sum(F.length("page_content")), F.lit(0)).alias("characters"),
    )


def extract_media(files: DataFrame, describe, document_type: str) -> DataFrame:
    """Images or audio through ``describe``, a pandas UDF from content to text. The hash is of the file's bytes, the type keeps its case."""
    return files.select(
        describe(F.col("content")).alias("page_content"),
        F.col("path").alias("file_path"),
        paths.extension(F.col("path"), keep_case=True).alias("file_type"),
        paths.base_name(F.col("path")).alias("file_name"),
        creation_time(F.col("path")).alias("creation_date"),
        iso_time(F.col("modificationTime")).alias("modification_date"),
        paths.content_hash(F.col("content")).alias("hash"),
        F.lit(document_type).alias("document_type"),
    )


def transcripts(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of {page_content, metadata} JSON files; missing fields null or empty, broken files with ``error``."""
    raw = spark.read.schema(StructType([*TRANSCRIPT_SCHEMA.fields, StructField("_corrupt", StringType())])).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(folder)
    return raw.select(F.coalesce("page_content", F.lit("")).alias("page_content"), "metadata.*", F.col("_corrupt").alias("error"))


def write_transcripts(docs: DataFrame, folder: str) -> None:
    """The same shape back: one JSON object per file, as ``transcripts`` reads it."""
    fields = [f.name for f in DOCUMENT_SCHEMA.fields[1:]]
    docs.select("page_content", F.struct(*fields).alias("metadata")).write.option("maxRecordsPerFile", 1).mode("errorifexists").json(folder)


def staging(files: DataFrame) -> DataFrame:
    """(path, staged_name): names in one folder; where names clash all but the first path get part of their hash.

    The first path of each name comes from one aggregation, so a name that a large
    share of all files bears is no hot window.
    """
    found = files.select("path").distinct().withColumn("_name", F.lower(paths.base_name(F.col("path"))))
    first = found.groupBy("_name").agg(F.min("path").alias("_first"))
    return found.join(first, "_name").select("path", paths.staged_name(F.col("path"), F.col("path") != F.col("_first")).alias("staged_name"))
