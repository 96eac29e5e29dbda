"""Functions on URLs and links."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def host(url: Column) -> Column:
    """Host of a URL, null for none; a port stays part of it."""
    return F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Without query and fragment."""
    return F.regexp_replace(url, r"[?#].*$", "")


def bare_host(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def path_within(child: Column, base: Column) -> Column:
    """Whether a path is the base or lies below it; a sibling with the base as a prefix doesn't."""
    base = F.regexp_replace(base, "/+$", "")
    return (child == base) | F.startswith(child, F.concat(base, F.lit("/")))


def without_version(p: Column) -> Column:
    """Without a trailing -1.2 or -v1.2.3; other suffixes stay."""
    return F.regexp_replace(p, r"-v?\d+(\.\d+)*$", "")


def is_valid(url: Column, base: Column, base_path: Column) -> Column:
    """Same host ignoring www., and within the base path, versions at the ends ignored."""
    p = path(url)
    inside = (F.coalesce(base_path, F.lit("")) == "") | path_within(p, base_path) | path_within(without_version(p), without_version(base_path))
    return F.coalesce((bare_host(url) == F.regexp_replace(base, r"^www\.", "")) & inside, F.lit(False))


def repaired_href(href: Column) -> Column:
    """Links with a lost scheme or an escaped number sign."""
    h = F.replace(href, F.lit("&amp;num;"), F.lit("#"))
    return F.when(F.startswith(h, F.lit("www.")), F.concat(F.lit("https://"), h)).otherwise(F.regexp_replace(h, r"^(https?)/(?!/)", "$1://"))


@F.pandas_udf(StringType())
def _join(base: pd.Series, href: pd.Series) -> pd.Series:
    return pd.Series([None if b is None or h is None else _safe_join(b, h) for b, h in zip(base, href)])


def _safe_join(base: str, href: str) -> str | None:
    try:
        return urljoin(base, href)
    except ValueError:
        return None


def absolute(page_url: Column, href: Column) -> Column:
    """A link as an absolute URL; rooted and absolute links need no Python."""
    h = repaired_href(href)
    rooted = F.startswith(h, F.lit("/")) & ~F.startswith(h, F.lit("//"))
    full = h.rlike(r"^https?://")
    other = ~rooted & ~full
    return F.when(rooted, F.concat(F.lit("https://"), host(page_url), h)).when(full, h).otherwise(_join(F.when(other, page_url), F.when(other, h)))


# Names a file system keeps for itself.
RESERVED = ["con", "prn", "aux", "nul", *(f"com{k}" for k in range(1, 10)), *(f"lpt{k}" for k in range(1, 10))]


def file_name(url: Column, folder_length: int = 0, longest: int = 250) -> Column:
    """A page's file name, without extension: scheme and brackets dropped, separators to underscores.

    A URL with a query or fragment, or a path beyond ``longest``, gets part of the
    URL's MD5, so that different pages keep different names.
    """
    base = canonical(url)
    for _ in range(4):  # nested or repeated brackets
        base = F.regexp_replace(base, r"\[[^\]]*\]", "")
    for _ in range(4):
        base = F.regexp_replace(base, r"\([^)]*\)", "")
    name = F.translate(F.replace(F.replace(base, F.lit("https://"), F.lit("")), F.lit("http://"), F.lit("")), '/\\<>:"|?*', "_________")
    name = F.regexp_replace(name, r"(?i)\.html$", "")
    bare = F.lower(F.regexp_replace(name, r"^[ .]+|[ .]+$", ""))
    name = F.when(bare.isin(RESERVED), F.concat(F.lit("file_"), name)).otherwise(name)
    allowed = max(1, longest - folder_length - 1 - len(".html") - 9)
    hashed = url.rlike(r"[?#]") | (F.length(name) + folder_length + 1 + len(".html") > longest)
    name = F.when(hashed, F.concat(F.substring(name, 1, allowed), F.lit("_"), F.substring(F.md5(url), 1, 8))).otherwise(name)
    return F.regexp_replace(name, r"[. ]+$", "")
