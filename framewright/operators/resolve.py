"""Lookups by priority, memo joins and media cascades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.functions.paths import base_name, drop_suffix, joined_path, relative_path, safe_stem
from framewright.sources.files import frame_lists


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row of each key in the given order; partial aggregation, no window over a key."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__f")).select(*keys, "__f.*")


def catalogue(files: DataFrame, suffixes: list[str] | None = None) -> DataFrame:
    """(name, path) of the first path of every file name in path order."""
    kept = files.filter(F.col("path").isNotNull() & F.col("name").isNotNull())
    if suffixes:
        kept = kept.filter(F.lower(F.coalesce("suffix", F.lit(""))).isin(suffixes))
    return kept.groupBy("name").agg(F.min("path").alias("path"))


def priority_lookup(rows: DataFrame, id_col: str, candidates: list[tuple[str, Column]], files: DataFrame, roots: list[str] | None = None) -> DataFrame:
    """(id, path, matched_by) of every row: the first candidate that names a known path, else a known file name.

    Candidates are tried in order; for each, its literal path, the path under each root, then its base
    name. Rows without a hit have NULLs. Rows are joined to the catalogue once per way of naming, on equal
    keys; the candidates of a row never meet in a window.
    """
    steps = []
    for k, (label, c) in enumerate(candidates):
        base = F.element_at(F.split(c, "/"), -1)
        ways = [(c, "path"), *[(F.concat(F.lit(r.rstrip("/") + "/"), F.ltrim(c, F.lit("/"))), "root") for r in roots or []], (base, "name")]
        steps += [F.struct(F.lit(k * 100 + j).alias("prio"), F.lit("path" if how != "name" else "name").alias("how"), v.alias("key"), F.lit(label).alias("matched_by")) for j, (v, how) in enumerate(ways)]
    tried = rows.select(F.col(id_col), F.explode(F.array(*steps)).alias("t")).select(id_col, "t.*").filter("key IS NOT NULL AND key <> ''")
    known = files.select(F.lit("path").alias("how"), F.col("path").alias("key"), "path").distinct().unionByName(catalogue(files).select(F.lit("name").alias("how"), F.col("name").alias("key"), "path"))
    hit = tried.join(known, ["how", "key"]).groupBy(id_col).agg(F.min_by(F.struct("path", "matched_by"), F.struct("prio", "path")).alias("m"))
    return rows.select(id_col).join(hit, id_col, "left").select(id_col, F.col("m.path").alias("path"), F.col("m.matched_by").alias("matched_by"))


def memo_join(rows: DataFrame, key: str, order: list[str], made: str, value: Column) -> DataFrame:
    """Compute ``value`` once per key, on its first row, and attach it to all rows of the key."""
    first = first_by(rows.filter(F.col(key).isNotNull()), [key], order).select(key, value.alias(made))
    return rows.join(first, key, "left")


def existing_lists(rows: DataFrame, id_col: str, lists: list[Column], bases: list[str], files: DataFrame) -> DataFrame:
    """(id, frames) of rows with a known path in one of their lists: the first such list, in its order, without unknown paths.

    An item is looked up below each base in turn and then as it stands. Items are joined to the paths by
    equality and gathered per row, so a row's items are all that ever meet in one place.
    """
    below = [F.struct(F.lit(i).alias("b"), joined_path(F.trim("item"), F.lit(b)).alias("path")) for i, b in enumerate(bases)]
    literal = F.struct(F.lit(len(bases)).alias("b"), F.trim("item").alias("path"))
    tagged = F.array(*[F.struct(F.lit(n).alias("n"), c.alias("items")) for n, c in enumerate(lists)])
    items = rows.select(F.col(id_col), F.inline(tagged)).select(id_col, "n", F.posexplode("items").alias("pos", "item")).filter("item IS NOT NULL AND trim(item) <> ''")
    tried = items.select(id_col, "n", "pos", F.inline(F.array(*below, literal)))
    hit = tried.join(files.select("path").distinct(), "path").groupBy(id_col, "n", "pos").agg(F.min_by("path", "b").alias("path"))
    per_list = hit.groupBy(id_col, "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "path"))), lambda x: x["path"]).alias("frames"))
    return per_list.groupBy(id_col).agg(F.min_by("frames", "n").alias("frames"))


def listed_directories(rows: DataFrame, id_col: str, directories: list[Column], lists: DataFrame) -> DataFrame:
    """(id, frames) of the first directory of each row that ``lists`` (directory, frames) knows."""
    tried = F.array(*[F.struct(F.lit(i).alias("prio"), d.alias("directory")) for i, d in enumerate(directories)])
    hit = rows.select(F.col(id_col), F.inline(tried)).filter("directory IS NOT NULL").join(lists, "directory")
    return hit.groupBy(id_col).agg(F.min_by("frames", "prio").alias("frames"))


def frame_cascade(rows: DataFrame, id_col: str, files: DataFrame, *, lists: list[Column], frame_dir: Column, split: Column, subdir: Column, video_id: Column, root: str, base: str) -> DataFrame:
    """(id, frames) of every row, in path order: known paths of its frame lists, else the frames of its
    directory, else those of ``root/split/subdir``, else of ``root/split/stem of the clip``; empty without any.

    A directory that is known ends the search, also if it holds no frame.
    """
    explicit = existing_lists(rows, id_col, lists, [base, root], files).withColumn("frames", F.array_sort("frames"))
    named = lambda c: F.nullif(F.trim(c), F.lit(""))
    below = lambda c: F.concat(F.lit(root + "/"), split, F.lit("/"), c)
    own = named(frame_dir)
    directories = [joined_path(own, F.lit(base)), joined_path(own, F.lit(root)), own, below(named(subdir)), below(safe_stem(drop_suffix(base_name(named(video_id)))))]
    listed = listed_directories(rows, id_col, directories, frame_lists(files)).withColumnRenamed("frames", "__listed")
    out = rows.select(id_col).join(explicit, id_col, "left").join(listed, id_col, "left")
    return out.select(id_col, F.coalesce("frames", "__listed", F.array().cast("array<string>")).alias("frames"))


def sft_media_cascade(rows: DataFrame, id_col: str, files: DataFrame, *, frames: Column, subdir: Column, singles: list[Column], root: str, base: str, out_dir: str, most: int) -> DataFrame:
    """(id, frames, image) of every row, as seen from ``out_dir``: frames or one image, never both, or neither.

    Frames are the known paths of the row's list in its order, else those of the directory ``root/subdir``,
    ``root/train/subdir`` or ``root/test/subdir`` that first holds any; an image is the first known single.
    """
    explicit = existing_lists(rows, id_col, [frames], [base], files)
    sub = F.nullif(F.trim(subdir), F.lit(""))
    full = frame_lists(files).filter(F.size("frames") > 0)
    listed = listed_directories(rows, id_col, [F.concat(F.lit(f"{root}/{s}"), sub) for s in ("", "train/", "test/")], full).withColumnRenamed("frames", "__listed")
    single = existing_lists(rows, id_col, [F.array(c) for c in singles], [base], files).select(id_col, F.get("frames", F.lit(0)).alias("__single"))
    j = rows.select(id_col).join(explicit, id_col, "left").join(listed, id_col, "left").join(single, id_col, "left")
    seen = F.coalesce("frames", "__listed")
    away = lambda p: relative_path(p, F.lit(out_dir))
    return j.select(id_col, F.transform(F.slice(seen, 1, most), away).alias("frames"), F.when(seen.isNull() & F.col("__single").isNotNull(), away(F.col("__single"))).alias("image"))


def weight_keys(keys: DataFrame, file: str) -> DataFrame:
    """The keys of all weight shards; shards of adapters are left out by their file name, in any letter case."""
    return keys.filter(~F.contains(F.lower(F.element_at(F.split(F.col(file), "/"), -1)), F.lit("adapter")))


def pending(rows: DataFrame, done: DataFrame, on: str) -> DataFrame:
    """Rows whose key is not among those done."""
    return rows.join(done.select(on).distinct(), on, "left_anti")


def with_group_stats(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Add mean and deviation of each group. For groups of generations of one prompt; a group is held in one task."""
    w = Window.partitionBy(*group)
    return df.withColumn("group_mean", F.avg(value).over(w)).withColumn("group_std", F.stddev_samp(value).over(w))
