"""Mixing sources to target weights.

Each mix draws its rows from a pool. Every source gets its target share of the mix, capped at
``max_repeats`` uses of each of its rows. Output shards draw their source counts from a multinomial,
corrected so that the totals per source are exact; slots map through a keyed pseudorandom permutation
of the source's rows, and rows are joined by index. As shares are asked for in rows, a mix joins rows; with
the blocks of ``token_blocks`` as rows it mixes packed tokens, and shares are of blocks of one length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.functions.paths import trim_ws
from framewright.operators.indexing import dense_index
from framewright.session import small_rows

MAX_TARGET_ROWS = 100_000
#: Groups of shards a mix is cut into before each is cut into its shards.
GROUPS = 1024
SLOT_CHUNK = 65_536


def source_key(c):
    """Names of sources are equal up to letter case and outer blanks."""
    return F.lower(trim_ws(c))


def permute(i: np.ndarray, n: int, key: int) -> np.ndarray:
    """Image of ``i`` under a keyed permutation of range(n): a Feistel network with cycle walking."""
    if n <= 1:
        return np.zeros_like(i)
    half = max(1, (int(n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    x = i.astype(np.uint64)
    todo = np.ones(len(x), dtype=bool)
    while todo.any():
        left, right = x[todo] >> np.uint64(half), x[todo] & mask
        for r in range(4):
            f = (right + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((key * 4 + r) % (1 << 63))
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((f >> np.uint64(32)) & mask)
        x[todo] = (left << np.uint64(half)) | right
        todo = x >= np.uint64(n)
    return x.astype(np.int64)


def exact_totals(shares: np.ndarray, total: int) -> np.ndarray:
    """Whole numbers nearest to shares x total, by largest remainder."""
    raw = shares * total
    out = np.floor(raw + 1e-9).astype(np.int64)
    missing = int(round(raw.sum())) - int(out.sum())
    order = np.argsort(-(raw - out), kind="stable")
    out[order[: max(0, missing)]] += 1
    return out


def shard_counts(totals: np.ndarray, shards: int, seed: int, sizes: np.ndarray | None = None) -> np.ndarray:
    """shards x sources: multinomial draws per shard, moved within shards until columns add to ``totals``; shards of ``sizes``, or alike."""
    rng = np.random.default_rng(seed)
    total = int(totals.sum())
    if sizes is None:
        sizes = np.full(shards, total // shards, dtype=np.int64)
        sizes[: total % shards] += 1
    if total == 0:
        return np.zeros((shards, len(totals)), dtype=np.int64)
    counts = rng.multinomial(sizes, totals / total)
    diff = counts.sum(axis=0) - totals
    while (diff > 0).any():
        a, b = int(np.argmax(diff)), int(np.argmin(diff))
        need = int(min(diff[a], -diff[b]))
        order = rng.permutation(shards)
        room = counts[order, a]
        before = np.cumsum(room) - room
        move = np.clip(need - before, 0, room)
        counts[order, a] -= move
        counts[order, b] += move
        diff[a] -= need
        diff[b] += need
    return counts


def mix_report(rows: DataFrame, targets: DataFrame, *, mode: str = "sft_mode", depth: str = "reasoning_depth", source: str = "source_subset") -> DataFrame:
    """One row per target: pool size, rows of the source, rows wanted, rows reachable, shares, and whether it is out of reach.

    Rows with a null source or mode count in no source; a null source still counts in its pool. An empty
    pool gives targets of 0 rows, which are in reach.
    """
    sizes = rows.groupBy(F.col(mode).alias("__m"), F.col(depth).alias("__d"), source_key(F.col(source)).alias("__s")).agg(F.count(F.lit(1)).alias("__n"))
    t = targets.select("mix_name", F.col(mode).alias("__tm"), F.col(depth).alias("__td"), F.col("source_subset").alias("__name"), source_key(F.col("source_subset")).alias("__ts"), "target_share", "max_repeats", "size_ratio")
    pools = t.select("mix_name", "__tm", "__td").distinct()
    fits = (F.col("__m") == F.col("__tm")) & (F.col("__td").isNull() | (F.col("__d") == F.col("__td")))
    per_mix = pools.join(sizes, fits, "left").groupBy("mix_name", "__s").agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("__n"))
    per_mix = per_mix.withColumn("pool_rows", F.sum("__n").over(Window.partitionBy("mix_name")))
    totals = per_mix.select("mix_name", "pool_rows").distinct()
    counts = per_mix.select(F.col("mix_name").alias("__mn"), "__s", F.col("__n").alias("source_rows"))
    j = t.join(totals, "mix_name", "left").join(counts, (F.col("mix_name") == F.col("__mn")) & (F.col("__ts") == F.col("__s")), "left")
    src, pool = F.coalesce("source_rows", F.lit(0)), F.coalesce("pool_rows", F.lit(0))
    wanted = F.col("target_share") * F.col("size_ratio") * pool
    cap = F.col("max_repeats").cast("bigint") * src
    return j.select(
        "mix_name", F.col("__name").alias("source_subset"), F.col("__ts").alias("source_key"), F.col("__tm").alias(mode), F.col("__td").alias(depth), "target_share", F.col("max_repeats").cast("bigint").alias("max_repeats"), "size_ratio",
        pool.cast("bigint").alias("pool_rows"), src.cast("bigint").alias("source_rows"), wanted.alias("wanted"), cap.alias("cap"), (cap < wanted).alias("out_of_reach"),
    )


def mix_totals(report: list, seed: int) -> list[tuple]:
    """(mix, sources, rows of each to draw, rows of each there are, permutation keys): one row per mix."""
    out = []
    for m, mix in enumerate(sorted({r.mix_name for r in report})):
        own = sorted((r for r in report if r.mix_name == mix), key=lambda r: r.source_key or "")
        total = int(round(own[0].size_ratio * own[0].pool_rows))
        totals = np.minimum(exact_totals(np.array([r.target_share for r in own]), total), np.array([r.cap for r in own]))
        keys = [(seed * 1_000_003 + m * 4099 + k) & 0x7FFFFFFF for k in range(len(own))]
        out.append((mix, [r.source_key or "" for r in own], totals.tolist(), [int(r.source_rows) for r in own], keys, seed * 1000 + m))
    return out


def plan_cells(spark, totals: list[tuple], slots_per_shard: int) -> DataFrame:
    """Cells of (mix, source, shard, first ordinal of the source, count, first slot, source rows, key), planned by executors.

    A mix is cut into at most GROUPS groups of shards by one task, and each group into its shards by another,
    so neither the driver nor a task holds the counts of all shards of a mix.
    """
    base = "mix_name string, source_key array<string>, totals array<bigint>, n array<bigint>, key array<bigint>, seed bigint"
    group = "mix_name string, source_key array<string>, totals array<bigint>, n array<bigint>, key array<bigint>, seed bigint, first array<bigint>, place bigint, shard bigint, shards bigint"

    def sized(total: int) -> np.ndarray:
        shards = max(1, -(-total // slots_per_shard))
        return np.full(shards, total // shards, dtype=np.int64) + (np.arange(shards) < total % shards)

    def cut_groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                totals = np.array(r.totals, dtype=np.int64)
                size = sized(int(totals.sum()))
                edges = np.linspace(0, len(size), min(GROUPS, len(size)) + 1).astype(np.int64)
                per = np.add.reduceat(size, edges[:-1])
                counts = shard_counts(totals, len(per), r.seed, per)
                first, place = np.cumsum(counts, axis=0) - counts, np.cumsum(per) - per
                yield pd.DataFrame(
                    {
                        "mix_name": r.mix_name, "source_key": [r.source_key] * len(per), "totals": list(counts), "n": [r.n] * len(per), "key": [r.key] * len(per),
                        "seed": r.seed * 8191 + 1 + np.arange(len(per)), "first": list(first), "place": place, "shard": edges[:-1], "shards": np.diff(edges),
                    }
                )

    def cut_shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                totals = np.array(r.totals, dtype=np.int64)
                total = int(totals.sum())
                size = np.full(r.shards, total // r.shards, dtype=np.int64) + (np.arange(r.shards) < total % r.shards)
                counts = shard_counts(totals, r.shards, r.seed, size)
                first = np.array(r.first)[None, :] + np.cumsum(counts, axis=0) - counts
                place = r.place + (np.cumsum(size) - size)[:, None] + np.cumsum(counts, axis=1) - counts
                s, k = np.nonzero(counts)
                yield pd.DataFrame(
                    {
                        "mix_name": r.mix_name, "source_key": np.array(r.source_key, dtype=object)[k], "shard": r.shard + s, "first": first[s, k], "cnt": counts[s, k],
                        "place": place[s, k], "n": np.array(r.n, dtype=np.int64)[k], "key": np.array(r.key, dtype=np.int64)[k],
                    }
                )

    groups = spark.createDataFrame(totals, base).repartition("mix_name").mapInPandas(cut_groups, group)
    return groups.repartition("mix_name", "shard").mapInPandas(cut_shards, "mix_name string, source_key string, shard bigint, first bigint, cnt bigint, place bigint, n bigint, key bigint")


def slots(cells: DataFrame) -> DataFrame:
    """Every slot of every shard with the block index and use it takes from its source."""

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for c in batch.itertuples(index=False):
                for at in range(0, c.cnt, SLOT_CHUNK):
                    k = np.arange(c.first + at, c.first + min(c.cnt, at + SLOT_CHUNK), dtype=np.int64)
                    yield pd.DataFrame({"mix_name": c.mix_name, "source_key": c.source_key, "shard": c.shard, "slot": c.place + at + np.arange(len(k)), "idx": permute(k % c.n, c.n, c.key), "use_no": k // c.n + 1})

    return cells.mapInPandas(draw, "mix_name string, source_key string, shard bigint, slot bigint, idx bigint, use_no bigint")


def mix_sources(rows: DataFrame, targets: DataFrame, id_col: str, *, mode: str = "sft_mode", depth: str = "reasoning_depth", source: str = "source_subset", seed: int = 42, slots_per_shard: int = 4096) -> tuple[DataFrame, DataFrame]:
    """The mix (mix_name, shard, slot, source_key, use_no, id) and its report with the shares reached.

    Shares are counted from the mix itself. A source short of rows is used ``max_repeats`` times and the mix
    is that much smaller; the report says so. Targets must be a parameter table (at most MAX_TARGET_ROWS rows, else an error). An empty table
    gives an empty mix and a report of zeros.
    """
    spark = rows.sparkSession
    report = mix_report(rows, targets, mode=mode, depth=depth, source=source)
    planned = small_rows(report, MAX_TARGET_ROWS, "the table of mix targets")
    chosen = slots(plan_cells(spark, mix_totals(planned, seed), slots_per_shard).repartition("mix_name", "shard", "source_key"))
    uses = spark.createDataFrame(sorted({(r.mix_name, r[mode], r[depth], r.source_key) for r in planned}, key=str), "mix_name string, __tm string, __td string, __ts string")
    fits = (F.col(mode) == F.col("__tm")) & (F.col("__td").isNull() | (F.col(depth) == F.col("__td"))) & (source_key(F.col(source)) == F.col("__ts"))
    # `uses` is bounded by MAX_TARGET_ROWS
    pool = rows.select(F.col(id_col), mode, depth, source).join(F.broadcast(uses), fits).select("mix_name", F.col("__ts").alias("source_key"), id_col)
    # slots grow with the data while their plan looks small, so the planner must not broadcast them
    mix = chosen.hint("merge").join(dense_index(pool, ["mix_name", "source_key"], [id_col], seed), ["mix_name", "source_key", "idx"]).drop("idx")
    got = mix.groupBy(F.col("mix_name").alias("__gm"), F.col("source_key").alias("__gs")).agg(F.count(F.lit(1)).alias("__g"))
    full = report.join(got, (F.col("mix_name") == F.col("__gm")) & (F.col("source_key") == F.col("__gs")), "left")
    full = full.withColumn("rows_given", F.coalesce(F.col("__g"), F.lit(0))).drop("__gm", "__gs", "__g")
    reached = F.sum("rows_given").over(Window.partitionBy("mix_name"))
    return mix, full.withColumn("share_reached", F.coalesce(F.try_divide(F.col("rows_given"), reached), F.lit(0.0)))


def token_blocks(pieces: DataFrame, keys: list[str], block_words: int) -> DataFrame:
    """(keys, block_no, block_id) of the full blocks of ``pack_blocks``: the pool of a mix whose rows are blocks; a group's last, shorter block is left out."""
    full = pieces.groupBy(*keys, "block_no").agg(F.sum("n_words").alias("__n")).filter(F.col("__n") == block_words).drop("__n")
    return full.withColumn("block_id", F.xxhash64(*keys, "block_no"))


def pack_blocks(rows: DataFrame, text_col: str, id_col: str, keys: list[str], block_words: int = 2048, seed: int = 42, size: Column | None = None) -> DataFrame:
    """Pack the words of each group's texts, in random order, into blocks of ``block_words``; or tokens, whose number ``size`` gives.

    Returns (keys, id, block_no, from_word, n_words): the pieces of each block. Word offsets are prefix
    sums within hash ranges, shifted by the ranges before them; null and empty texts have no words and no piece.
    Null keys form a group of their own.
    """
    from framewright.operators.indexing import hash_order

    words = F.size(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"\S+"), F.lit(0)))
    w = rows.select(*keys, id_col, (words if size is None else F.coalesce(size, F.lit(0))).cast("bigint").alias("__w")).filter("__w > 0")
    w = w.withColumn("__h", hash_order(seed, [id_col])).withColumn("__b", F.shiftright("__h", 53))
    sums = w.groupBy(*keys, "__b").agg(F.sum("__w").alias("__t"))
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "__b", F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__o"))
    inside = Window.partitionBy(*keys, "__b").orderBy("__h", id_col).rowsBetween(Window.unboundedPreceding, -1)
    placed = w.withColumn("__p", F.coalesce(F.sum("__w").over(inside), F.lit(0)))
    renamed = sums.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__b").alias("__sb"), "__o")
    same = F.col("__b") == F.col("__sb")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    placed = placed.join(renamed, same)
    start = F.col("__o") + F.col("__p")
    blocks = F.sequence((start / block_words).cast("bigint"), ((start + F.col("__w") - 1) / block_words).cast("bigint"))
    pieces = placed.select(*keys, id_col, "__w", start.alias("__start"), F.explode(blocks).alias("block_no"))
    lo = F.greatest(F.col("block_no") * block_words, F.col("__start"))
    hi = F.least((F.col("block_no") + 1) * block_words, F.col("__start") + F.col("__w"))
    return pieces.select(*keys, id_col, "block_no", (lo - F.col("__start")).alias("from_word"), (hi - lo).alias("n_words"))
