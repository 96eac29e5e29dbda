"""Functions on file paths, names and hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The file types that are read.
DOCUMENT_EXTENSIONS = [".pdf", ".docx", ".txt", ".eml", ".msg", ".csv", ".xls", ".xlsx", ".xlsm", ".rtf", ".md", ".html", ".htm"]
IMAGE_EXTENSIONS = [".png", ".jpg", ".jpeg", ".bmp", ".gif", ".tif", ".tiff", ".webp"]
AUDIO_EXTENSIONS = [".mp3", ".m4a", ".ogg", ".wav", ".webm", ".mp4", ".avi", ".mkv", ".wma", ".flac", ".aac"]


def forward_slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def base_name(path: Column) -> Column:
    """What follows the last slash of either kind."""
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def extension(path: Column, keep_case: bool = False) -> Column:
    """The last dot and what follows it, '' without one or for a name that only starts with a dot."""
    found = F.regexp_extract(base_name(path), r"[^.].*?(\.[^.]*)$", 1)
    return found if keep_case else F.lower(found)


def stem(path: Column) -> Column:
    name = base_name(path)
    return F.substring(name, F.lit(1), F.length(name) - F.length(extension(path, keep_case=True)))


def document_type(path: Column) -> Column:
    """document, image or audio by extension; null for others."""
    kind = extension(path)
    return F.when(kind.isin(DOCUMENT_EXTENSIONS), "document").when(kind.isin(IMAGE_EXTENSIONS), "image").when(kind.isin(AUDIO_EXTENSIONS), "audio")


def content_hash(text: Column) -> Column:
    """SHA-256 in hex of the text's UTF-8 bytes, or of binary content."""
    return F.sha2(text, 256)


def staged_name(path: Column, taken: Column) -> Column:
    """Name in the staging folder: its own, or with part of the path's MD5 where another file has it."""
    return F.when(taken, F.concat(stem(path), F.lit("_"), F.substring(F.md5(path), 1, 8), extension(path, keep_case=True))).otherwise(base_name(path))
