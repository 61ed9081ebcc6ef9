"""Column builders for media paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that count as white space (fixed values).
BLANKS = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def trim_ws(c: Column) -> Column:
    """Strip every kind of outer white space, not only spaces."""
    return F.btrim(c, F.lit(BLANKS))


def path_parts(c: Column) -> Column:
    """Parts of a slash-separated path without empty and dot parts."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), "/"), lambda p: ~p.isin("", ".", ".."))


def safe_stem(c: Column, default: str = "sample") -> Column:
    """Letters, digits, ``-`` and ``_``; all else becomes ``_``; outer ``_`` go; a default where nothing is left."""
    kept = F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\p{L}\p{N}_-]", "_")
    return F.coalesce(F.nullif(F.btrim(kept, F.lit("_")), F.lit("")), F.lit(default))


def drop_suffix(c: Column) -> Column:
    """The path without the last suffix of its file name."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?<=[^/])\.[^./]+$", "")


def frame_key(c: Column) -> Column:
    """Safe stems of the path's parts, without suffix, joined by ``__``."""
    return F.coalesce(F.nullif(F.array_join(F.transform(path_parts(drop_suffix(c)), lambda p: safe_stem(p)), "__"), F.lit("")), F.lit("sample"))


def repo_path(c: Column) -> Column:
    """Strip outer white space, then every leading dot and slash (a set of characters, not a prefix)."""
    return F.ltrim(trim_ws(F.coalesce(c, F.lit(""))), F.lit("./"))


def first_part(c: Column) -> Column:
    return F.get(path_parts(repo_path(c)), F.lit(0))


def base_name(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def suffix(c: Column) -> Column:
    """Last suffix of the file name in lower case with its dot, or the empty string."""
    return F.lower(F.regexp_extract(base_name(c), r"[^.](\.[^.]+)$", 1))


def url_path(c: Column) -> Column:
    return F.regexp_extract(F.coalesce(c, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def video_path(path: Column, url: Column, marker: str = "/resolve/main/") -> Column:
    """The path if there is one, else the tail of the URL after the marker, else the URL's path."""
    p, u = trim_ws(F.coalesce(path, F.lit(""))), trim_ws(F.coalesce(url, F.lit("")))
    tail = F.substr(u, F.instr(u, F.lit(marker)) + len(marker))
    plain = F.when(F.contains(u, F.lit("://")), url_path(u)).otherwise(F.regexp_replace(u, r"[?#].*$", ""))
    return F.when(p != "", F.ltrim(p, F.lit("./"))).when(F.contains(u, F.lit(marker)), F.ltrim(tail, F.lit("/"))).otherwise(F.ltrim(plain, F.lit("/")))


def stable_url_name(url: Column, prefix: str = "video") -> Column:
    """File stem of the URL made safe, and twelve hex digits of the URL's SHA-1."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    stem = drop_suffix(F.regexp_replace(base_name(F.rtrim(url_path(url), F.lit("/"))), r"/+$", ""))
    tail = F.coalesce(F.nullif(stem, F.lit("")), F.nullif(host, F.lit("")), F.lit(prefix))
    return F.concat(safe_stem(tail, prefix), F.lit("_"), F.substring(F.sha1(url), 1, 12))


def relative_path(path: Column, start: Column) -> Column:
    """``path`` as seen from directory ``start``; both absolute or both relative to one root."""
    a, b = path_parts(path), path_parts(start)
    shared = F.size(F.filter(F.transform(F.sequence(F.lit(0), F.greatest(F.least(F.size(a), F.size(b)) - 1, F.lit(0))), lambda i: F.slice(a, 1, i + 1) == F.slice(b, 1, i + 1)), lambda x: x))
    steps = F.concat(F.array_repeat(F.lit(".."), F.size(b) - shared), F.slice(a, shared + 1, F.greatest(F.size(a) - shared, F.lit(0))))
    return F.coalesce(F.nullif(F.array_join(steps, "/"), F.lit("")), F.lit("."))


def joined_path(path: Column, base: Column) -> Column:
    """``path`` below ``base`` unless it is absolute, without empty and dot parts; ``..`` takes the part before it back."""
    whole = F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(base, F.lit("/"), path))
    real = F.filter(F.split(whole, "/"), lambda p: ~p.isin("", "."))
    up = lambda acc, p: F.when((p == "..") & (F.size(acc) > 0) & (F.element_at(acc, -1) != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))
    # element_at of an empty array is an error, so a mark stands before the first part
    folded = F.aggregate(real, F.array(F.lit("..")).cast("array<string>"), up)
    return F.concat(F.when(F.startswith(whole, F.lit("/")), F.lit("/")).otherwise(F.lit("")), F.array_join(F.slice(folded, 2, F.greatest(F.size(folded) - 1, F.lit(0))), "/"))


def image_subset(data_source: Column, path: Column) -> Column:
    """First part of the source; else the second path part under one of the known domains, else the first."""
    s, parts = trim_ws(F.coalesce(data_source, F.lit(""))), path_parts(repo_path(path))
    domain = F.get(parts, F.lit(0)).isin(*IMAGE_DOMAINS) & (F.size(parts) >= 2)
    return F.when(s != "", F.substring_index(s, "/", 1)).when(domain, F.get(parts, F.lit(1))).otherwise(F.coalesce(F.get(parts, F.lit(0)), F.lit("unknown_image")))


# Domains of image sets, and three suffix lists for still images and clips.
IMAGE_DOMAINS = ["Knowledge", "Spatial", "Temporal", "Math", "Chart", "OCR"]
IMAGE_SUFFIXES = [".png", ".jpg", ".jpeg", ".webp", ".gif"]
STILL_SUFFIXES = [".png", ".jpg", ".jpeg", ".webp", ".gif", ".bmp", ".tif", ".tiff"]


def has_suffix(c: Column, suffixes: list[str]) -> Column:
    """Whether a path ends in one of the suffixes, in any letter case; NULL counts as no."""
    p = F.lower(trim_ws(F.coalesce(c, F.lit(""))))
    out = F.lit(False)
    for s in suffixes:
        out = out | F.endswith(p, F.lit(s))
    return out
