"""Splits that keep related records together.

Rows are related through a clip or through a question id within a data set, also over further rows.
Only question ids that occur on two or more clips join clips, so the graph of clips is far smaller than
the rows. Its components come from hooking and shortcutting on parent arrays kept in joined tables.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.clips import clip_key, real_id
from framewright.operators.indexing import dense_index
from framewright.session import cut, small_rows

MAX_ROUNDS = 60
MAX_SIZES = 2_000_000
#: Totals that the first bit set covers, and larger sizes tried for an exchange where it misses.
BITSET_BITS = 1 << 22
EXCHANGES = 200
_TURNED = bytes(int(f"{k:08b}"[::-1], 2) for k in range(256))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); the root is the smallest node of its component.

    Each round hooks a node, and its parent, onto the smallest grandparent among its neighbours and
    halves its path to the root. Rounds end when no parent changes: about log2 of the longest shortest path. Null ends, loops
    and double edges do no harm; no edges give no rows.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).filter("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    both = cut(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    p = cut(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("node")).alias("parent")))
    for _ in range(MAX_ROUNDS):
        up = p.select(F.col("node").alias("__n"), F.col("parent").alias("grand"))
        g = p.join(up, F.col("parent") == F.col("__n")).select("node", "parent", "grand")
        near = both.join(g.select(F.col("node").alias("v"), F.col("grand").alias("g")), "v").groupBy("u").agg(F.min("g").alias("g"))
        hooked = near.join(g.select(F.col("node").alias("u"), "parent"), "u")
        offers = hooked.select(F.col("u").alias("node"), "g").unionByName(hooked.select(F.col("parent").alias("node"), "g")).unionByName(g.select("node", F.col("grand").alias("g")))
        best = offers.groupBy("node").agg(F.min("g").alias("g"))
        new = cut(p.join(best, "node", "left").select("node", F.least("parent", F.coalesce("g", "parent")).alias("parent"), (F.coalesce("g", "parent") < F.col("parent")).alias("moved")))
        moved = new.filter("moved").limit(1).count()
        p = new.drop("moved")
        if not moved:
            return p.withColumnRenamed("parent", "root")
    raise RuntimeError(f"components did not settle within {MAX_ROUNDS} rounds")


def related_groups(rows: DataFrame, id_col: str = "row_id", video: str = "video_id", question: str = "question_id", dataset: str = "dataset_name") -> DataFrame:
    """(id, comp, group_rows, group_key) of every row.

    ``comp`` names the component; ``group_key`` is the smallest stored real ``video`` of the group in byte
    order, NULL where no row of it names a clip. A row that names neither clip nor question is a group of
    its own with a NULL ``comp``. Double rows count as rows.
    """
    r = rows.select(F.col(id_col), F.col(video).alias("__raw"), clip_key(F.col(video)).alias("clip"), F.concat(F.col(dataset), F.lit("\x1f"), real_id(F.col(question))).alias("ask"))
    # ids are spelt out once; all that follows reads these narrow rows
    r = cut(r)
    named = r.filter("clip IS NOT NULL AND ask IS NOT NULL").groupBy("ask", "clip").agg(F.count(F.lit(1)).alias("__n"))
    hubs = r.filter("clip IS NOT NULL AND ask IS NOT NULL").groupBy("ask").agg(F.min("clip").alias("hub"), F.max("clip").alias("other"))
    multi = hubs.filter("hub <> other").select(F.col("ask"), "hub")
    edges = named.join(multi, "ask").filter("clip <> hub").select(F.col("hub").alias("a"), F.col("clip").alias("b")).distinct()
    roots = components(edges)
    # one row per clip, question and their combination, before any row is touched
    via = r.filter("clip IS NULL AND ask IS NOT NULL").select(id_col, "__raw", "ask").join(hubs.select("ask", "hub"), "ask", "left").select(id_col, "__raw", F.col("hub").alias("clip"), F.when(F.col("hub").isNull(), F.concat(F.lit("\x1e"), "ask")).alias("lone"))
    own = r.filter("clip IS NOT NULL").select(id_col, "__raw", "clip", F.lit(None).cast("string").alias("lone"))
    placed = own.withColumn("real", F.lit(True)).unionByName(via.withColumn("real", F.lit(False)))
    keyed = placed.join(roots.withColumnRenamed("node", "clip"), "clip", "left").select(id_col, "__raw", "real", F.coalesce("root", "clip", "lone").alias("comp"))
    alone = r.filter("clip IS NULL AND ask IS NULL").select(id_col, F.lit(None).cast("string").alias("comp"), F.lit(1).cast("bigint").alias("group_rows"), F.lit(None).cast("string").alias("group_key"))
    stats = keyed.groupBy("comp").agg(F.count(F.lit(1)).cast("bigint").alias("group_rows"), F.min(F.when(F.col("real"), F.col("__raw"))).alias("group_key"))
    return keyed.select(id_col, "comp").join(stats, "comp").select(id_col, "comp", "group_rows", "group_key").unionByName(alone)


def _reach(bundles: list[tuple[int, int]], bits: int, goal: int | None = None) -> tuple[int, int]:
    """Totals under ``bits`` that bundles (size, groups) reach, as a bit set, and the bundles used; done once ``goal`` is reached."""
    mask, reach = (1 << bits) - 1, 1
    for i, (size, n) in enumerate(bundles):
        if goal is not None and reach >> goal & 1:
            return reach, i
        if size * n < bits:
            reach |= (reach << size * n) & mask
    return reach, len(bundles)


def _pick(bundles: list[tuple[int, int]], total: int) -> dict[int, int]:
    """Groups of each size that make ``total``, which the bundles reach: what each half brings, from bit sets of both."""
    if not total:
        return {}
    if len(bundles) == 1:
        return dict(bundles)
    halves = bundles[: len(bundles) // 2], bundles[len(bundles) // 2 :]
    low, high = (_reach(h, total + 1)[0] for h in halves)
    size = total // 8 + 1
    # bit k of the turned set says that the other half makes total - k
    turned = int.from_bytes(high.to_bytes(size, "little").translate(_TURNED)[::-1], "little") >> (8 * size - 1 - total)
    both = low & turned
    del low, high, turned
    at = (both & -both).bit_length() - 1
    taken = _pick(halves[0], at)
    for s, n in _pick(halves[1], total - at).items():
        taken[s] = taken.get(s, 0) + n
    return taken


def _bundled(sizes: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(size, groups) with multiplicities cut into powers of two and a rest, so that every number of groups can be made."""
    out = []
    for size, many in sizes:
        k = 1
        while many > 0:
            out.append((size, min(k, many)))
            many -= min(k, many)
            k *= 2
    return out


def _from_top(sizes: list[tuple[int, int]], rest: int) -> tuple[dict[int, int], int]:
    """Groups taken from the largest size down while they fit in ``rest``, and what is left of it."""
    taken = {}
    for size, many in reversed(sizes):
        taken[size] = min(many, max(0, rest) // size)
        rest -= taken[size] * size
    return taken, rest


def _varied(sizes: list[int], unit: int) -> list[int]:
    """EXCHANGES sizes, those of rests not met yet before others, as the small groups close gaps of whole units; small ones first."""
    met: dict[int, int] = {}
    ranked = []
    for s in sorted(sizes):
        met[s % unit] = met.get(s % unit, 0) + 1
        ranked.append((met[s % unit], s))
    return [s for _, s in sorted(ranked)[:EXCHANGES]]


def _meet(sizes: list[tuple[int, int]], goal: int, room: int) -> dict[int, int] | None:
    """Groups of exactly ``goal`` rows, or None if none are found by choosing freely among the smallest ones, of ``room`` rows together."""
    small, large = [], []
    for size, many in sizes:
        n = min(many, room // size)
        room = room - n * size if n == many else 0
        small += [(size, n)] * (n > 0)
        large += [(size, many - n)] * (many > n)
    most = sum(s * n for s, n in small)
    # half of the small groups' rows is where their totals lie closest
    taken, rest = _from_top(large, goal - most // 2)
    rest += most // 2
    bundles = _bundled(small)
    reach, used = _reach(bundles, most + 1, min(rest, most + 1))
    held = reach.to_bytes(most // 8 + 1, "little")
    # as it is, or with one large group more, one less, or two exchanged
    unit = math.gcd(*(s for s, _ in small)) or 1
    out = [0, *_varied([s for s, n in taken.items() if n], unit)]
    into = [0, *_varied([s for s, n in large if n > taken[s]], unit)]
    for a, b in ((a, b) for a in out for b in into):
        at = rest + a - b
        if 0 <= at <= most and held[at >> 3] >> (at & 7) & 1:
            found = _pick(bundles[:used], at)
            for s, n in ((*taken.items(), (a, -1), (b, 1)) if a != b else taken.items()):
                found[s] = found.get(s, 0) + n
            return {s: n for s, n in found.items() if s and n}
    return None


def closest_fill(sizes: list[tuple[int, int]], target: int, bits: int = BITSET_BITS) -> dict[int, int]:
    """How many groups of each size to take so that the rows come closest to ``target``; of two totals as close, the smaller.

    ``sizes`` holds (size, groups of that size). All sizes are counted in their greatest common divisor.
    Groups taken from the top leave a gap below the largest size D; some closest choice differs from them in
    fewer than 2 D groups, as of more steps some would cancel out, so only so many of a size are open.
    Totals that can't be beaten are looked for first: large groups from the top, a bit set of the smallest
    ones, of ``bits`` rows together, then of eight times as many. If there is none, a bit set of all totals up
    to the target tells the closest. ``bits`` only decides how much work is tried first, never the total.
    Memory is about a byte for each unit of the target that is open, at most.
    """
    sizes = sorted((s, m) for s, m in sizes if s > 0 and m > 0)
    if target <= 0 or not sizes:
        return {}
    # a group that is larger than this is further off by itself
    gap = _from_top(sizes, target)[1]
    sizes = [(s, m) for s, m in sizes if s <= target + gap]
    if target >= sum(s * m for s, m in sizes):
        return dict(sizes)
    unit = math.gcd(*(s for s, _ in sizes))
    units = [(s // unit, m) for s, m in sizes]
    top, _ = _from_top(units, target // unit)
    largest = units[-1][0]
    # what is taken or left at any rate, and what is open
    span = largest * largest + largest
    least = lambda n, s: min(n, span // s, 2 * largest)
    fixed = {s: n - least(n, s) for s, n in top.items()}
    open_ = [(s, least(top[s], s) + least(m - top[s], s)) for s, m in units]
    target -= unit * sum(s * n for s, n in fixed.items())
    goal, over = divmod(target, unit)
    best = goal + (2 * over > unit)
    # totals further off than what the top leaves don't matter
    width = (target + gap) // unit + 1
    open_ = [(s, min(m, (width - 1) // s)) for s, m in open_ if 0 < s < width and m]
    taken = None
    while taken is None and bits < width:
        taken = _meet(open_, best, bits)
        bits *= 8
    if taken is None:
        bundles = _bundled(open_)
        reach, used = _reach(bundles, width, best)
        below, above = (reach & ((1 << (goal + 1)) - 1)).bit_length() - 1, reach >> (goal + 1)
        up = goal + (above & -above).bit_length()
        taken = _pick(bundles[:used], up if above and up * unit - target < target - below * unit else below)
    for s, n in fixed.items():
        taken[s] = taken.get(s, 0) + n
    return {s * unit: n for s, n in taken.items() if n}


def assign_splits(spark: SparkSession, groups: DataFrame, id_col: str, shares: Sequence[tuple[str, float]] = (("train", 0.8), ("validation", 0.1), ("test", 0.1)), seed: int = 42) -> DataFrame:
    """(id, comp, new_split): all rows of a group in one split, split totals as close to ``shares`` as whole groups allow.

    Groups of one size are interchangeable, so only counts per size reach the driver (at most about the
    square root of twice the rows); which group goes where is decided by a random index within its size.
    """
    loose = groups.filter("comp IS NULL").select(F.concat(F.lit("\x1d"), F.col(id_col).cast("string")).alias("comp"), F.lit(1).cast("bigint").alias("group_rows"))
    per_group = groups.filter("comp IS NOT NULL").select("comp", "group_rows").distinct().unionByName(loose)
    counted = small_rows(per_group.groupBy("group_rows").agg(F.count(F.lit(1)).alias("many")), MAX_SIZES, "the table of group sizes")
    left = {int(r.group_rows): int(r.many) for r in counted}
    total = sum(s * m for s, m in left.items())
    ranges, used = [], dict.fromkeys(left, 0)
    for name, share in sorted(shares, key=lambda x: x[1])[:-1]:
        for size, take in closest_fill(list(left.items()), math.floor(total * share + 0.5)).items():
            ranges.append((size, used[size], used[size] + take, name))
            used[size] += take
            left[size] -= take
    last = max(shares, key=lambda x: x[1])[0]
    ranges += [(s, used[s], used[s] + m, last) for s, m in left.items() if m]
    table = spark.createDataFrame(ranges, "size bigint, lo bigint, hi bigint, new_split string")
    indexed = dense_index(per_group, ["group_rows"], ["comp"], seed)
    chosen = indexed.join(table, (F.col("group_rows") == F.col("size")) & (F.col("idx") >= F.col("lo")) & (F.col("idx") < F.col("hi"))).select("comp", "new_split")
    keyed = groups.select(id_col, F.coalesce(F.col("comp"), F.concat(F.lit("\x1d"), F.col(id_col).cast("string"))).alias("comp"))
    return keyed.join(chosen, "comp").select(id_col, "comp", "new_split")
