"""One spelling for a clip and for an id, however they are written."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from framewright.functions.paths import trim_ws
from framewright.plans import dialect as D

# Values written in an id field to say that there is none (fixed values).
MISSING_IDS = ["", "-", "--", "0", "?", "n/a", "na", "nan", "nil", "none", "null", "tbd", "undefined", "unknown"]


def real_id(c: Column) -> Column:
    """The id without outer blanks, or NULL if it is null, blank or a stand-in for a missing id."""
    t = trim_ws(c)
    return F.when(~F.lower(t).isin(MISSING_IDS), t)


def clip_key(c: Column) -> Column:
    """One spelling for a clip: ``dataset/directory/file.suffix`` in lower case.

    Undoes back slashes, percent codes, scheme and host, download prefix, query string, empty and dot
    parts and letter case; the last three parts name the clip. NULL for null, blank and stand-in values.
    """
    t = F.translate(trim_ws(c), "\\", "/")
    t = F.replace(F.substring_index(F.substring_index(t, "?", 1), "#", 1), F.lit("+"), F.lit("%2B"))
    t = F.lower(F.coalesce(F.try_url_decode(t), t))
    # every step uses the one before it once: a repeated use would repeat the work per row
    t = F.regexp_replace(t, r"^[a-z][^/]*://[^/]*/", "")
    t = F.regexp_replace(t, r"(?:^|/)\s*(?:\.{0,2}\s*/)+", "/")
    key = F.regexp_extract(t, r"(?:[^/]+/){0,2}[^/]+$", 0)
    return F.when(~F.lower(trim_ws(c)).isin(MISSING_IDS), F.nullif(key, F.lit("")))


def real_id_sql(column: str) -> str:
    """``real_id`` as SQL."""
    listed = ", ".join(f"'{x}'" for x in MISSING_IDS)
    return f"CASE WHEN lower({D.trim_ws(column)}) NOT IN ({listed}) THEN {D.trim_ws(column)} END"


def clip_key_sql(column: str) -> str:
    """``clip_key`` as SQL."""
    listed = ", ".join(f"'{x}'" for x in MISSING_IDS)
    plain = f"replace(split_part(split_part(replace({D.trim_ws(column)}, chr(92), '/'), '?', 1), '#', 1), '+', '%2B')"
    below = f"regexp_replace(lower(url_decode({plain})), '^[a-z][^/]*://[^/]*/', '')"
    key = f"regexp_extract(regexp_replace({below}, '(^|/)\\s*([.]{{0,2}}\\s*/)+', '/', 'g'), '([^/]+/){{0,2}}[^/]+$')"
    return f"CASE WHEN lower({D.trim_ws(column)}) NOT IN ({listed}) THEN nullif({key}, '') END"
