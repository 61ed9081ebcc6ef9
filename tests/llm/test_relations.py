import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.llm import chunking, overlap, related

SCHEMA = "row_id bigint, video_id string, question_id string, dataset_name string, clip string, comp string"


def brute(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a and b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("kind", ["random", "path", "star"])
def test_components_against_brute_force(spark, kind):
    rng = random.Random(3)
    name = lambda i: f"n{i:03d}"
    if kind == "random":
        edges = [(name(rng.randint(0, 150)), name(rng.randint(0, 150))) for _ in range(90)]
    elif kind == "path":
        order = list(range(40))
        rng.shuffle(order)
        edges = [(name(a), name(b)) for a, b in zip(order, order[1:])]
    else:
        edges = [(name(0), name(i)) for i in range(1, 60)] + [(None, name(1)), (name(5), name(5))]
    got = {r.node: r.root for r in related.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    want = {k: v for k, v in brute([e for e in edges if e[0] != e[1]]).items()}
    assert got == want


def test_no_edges(spark):
    assert related.components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_groups_with_nulls_and_stand_ins(spark):
    rows = [
        (1, "S/r/a.mp4", "q1", "S"), (2, "./S/r/A.MP4", None, "S"), (3, None, " q1 ", "S"), (4, "S/r/b.mp4", "q1", "T"), (5, "S/r/b.mp4", "q2", "T"),
        (6, "S/r/c.mp4", "q2", "T"), (7, None, None, None), (8, "unknown", "0", "S"), (9, None, "q9", "S"), (10, " ", "q9", "S"), (11, "S/r/z.mp4", None, None), (1, "S/r/a.mp4", "q1", "S"),
    ]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    got = {}
    for r in related.related_groups(df).collect():
        got.setdefault(r.row_id, []).append((r.group_rows, r.group_key))
    assert got[1] == [(4, "./S/r/A.MP4")] * 2 and got[3] == got[2] == [(4, "./S/r/A.MP4")]
    assert got[4] == got[5] == got[6] == [(3, "S/r/b.mp4")]
    assert got[7] == got[8] == [(1, None)] and got[9] == got[10] == [(2, None)] and got[11] == [(1, "S/r/z.mp4")]
    assert related.related_groups(df.filter("row_id < 0")).count() == 0


def test_closest_fill():
    assert sum(s * n for s, n in related.closest_fill([(3, 10), (5, 4), (50, 1)], 44).items()) == 44
    assert related.closest_fill([(10, 1)], 0) == {}
    taken = related.closest_fill([(7, 3)], 20)
    assert taken == {7: 3}


def test_splits_keep_groups(spark):
    rows = [(i, f"S/r/{i % 37}.mp4" if i % 11 else None, None, "S", "x", "y") for i in range(500)]
    groups = related.related_groups(spark.createDataFrame(rows, SCHEMA))
    got = related.assign_splits(spark, groups, "row_id", (("train", 0.7), ("validation", 0.2), ("test", 0.1)))
    n = {r.new_split: r["count"] for r in got.groupBy("new_split").count().collect()}
    assert n == {"train": 350, "validation": 100, "test": 50}
    assert got.groupBy("comp").agg(F.countDistinct("new_split").alias("k")).filter("k > 1").count() == 0


def test_chunks_are_local():
    a = b"the quick brown fox jumps over the lazy dog near the river bank at dawn"
    b = a.replace(b"lazy", b"lzy")
    owner, digest, length = chunking.chunk_texts([a, b"", b], 3)
    assert length[owner == 0].sum() == len(a) and length[owner == 2].sum() == len(b) and not (owner == 1).any()
    shared = np.isin(digest[owner == 0], digest[owner == 2])
    assert length[owner == 0][shared].sum() > 0.5 * len(a)
    bits, words = chunking.word_bits([b"a b", b"c"])
    assert words.tolist() == [2, 1] and bits[0] != bits[1]


QUESTION = "What does the potter in the olive vest do right after the farmer in the white jacket unpacks the steel funnel near the loading bay"


@pytest.mark.parametrize(
    "other,same",
    [
        (f"QUESTION: {QUESTION.upper()}?\nChoices: A) x; B) y", True),
        (f"Watch closely. {QUESTION.replace('olive', 'ollive').replace('steel', 'stel')}?", True),
        (f"Q. {QUESTION}?\n(A) x\n(B) z", True),
        (QUESTION.replace("olive", "teal"), False),
        (QUESTION.replace("steel funnel", "torn map") + "?\nOptions:\nA. x", False),
        ("What is seen?", False),
    ],
)
def test_same_question(other, same):
    assert overlap.same_question(overlap.asked(f"Question: {QUESTION}?\nOptions:\nA. x\nB. y"), overlap.asked(other)) is same


def test_numbers_must_agree():
    assert not overlap.same_question("where is it at 12 31 in the hall now", "where is it at 12 39 in the hall now")


def test_pairs(spark):
    rows = [
        (1, "S/r/a.mp4", f"Question: {QUESTION}?\nOptions:\nA. x", "train"), (2, "S\\r\\A.mp4", f"Q. {QUESTION.replace('vest', 'veest')}?", "val"), (3, "S/r/b.mp4", f"{QUESTION}?", "test"),
        (4, "S/r/a.mp4", f"{QUESTION}?", "test"), (1, "S/r/a.mp4", f"Question: {QUESTION}?\nOptions:\nA. x", "train"), (5, None, f"{QUESTION}?", "val"), (6, "S/r/a.mp4", None, "val"),
        (7, "S/r/a.mp4", "", "val"), (8, "S/r/a.mp4", "x" * 60000, "val"), (9, "S/r/a.mp4", f"{QUESTION}?", None), (10, "N/A", f"{QUESTION}?", "train"),
    ]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "row_id bigint, video_id string, problem string, split_name string, t string, id int")
    got = sorted(tuple(r) for r in overlap.cross_split_pairs(df).select("train_id", "eval_id").collect())
    assert got == [(1, 2), (1, 2), (1, 4), (1, 4)]
    assert overlap.cross_split_pairs(df.filter("row_id < 0")).count() == 0


def test_pairs_against_brute_force(spark):
    rng = random.Random(5)
    who, what, where = ["potter", "farmer", "usher", "diver", "weaver"], ["steel funnel", "torn map", "round tray", "soft hose"], ["near the stall", "on the jetty", "in the aisle"]
    texts = [f"Which object does the {rng.choice(who)} in the {rng.choice(['red', 'teal', 'navy'])} vest pick up once the {rng.choice(what)} has been moved {rng.choice(where)}?" for _ in range(160)]

    def slip(t):
        k = rng.randint(20, len(t) - 5)
        return t[:k] + t[k + 1 :] if rng.random() < 0.5 else t

    rows = [(i, f"S/r/{i % 3}.mp4", slip(t), "train" if i % 3 else "val") for i, t in enumerate(texts + [slip(x) for x in texts])]
    rows = [(i, v, t, "train" if rng.random() < 0.6 else "val") for i, v, t, _ in rows]
    got = {tuple(r)[:2] for r in overlap.cross_split_pairs(spark.createDataFrame(rows, "row_id bigint, video_id string, problem string, split_name string")).collect()}
    want = {(a, b) for a, va, ta, sa in rows if sa == "train" for b, vb, tb, sb in rows if sb == "val" and va == vb and overlap.same_question(overlap.asked(ta), overlap.asked(tb))}
    assert len(want) > 30 and len(got & want) >= 0.98 * len(want) and not got - want


def test_pairs_of_short_questions_with_lead_ins(spark):
    short = ["what does the cook lift", "who is it", "why does the potter turn the drum", "where is the red hat", "which pan falls"]
    before = ["meanwhile behind curtains seven", "observing yesterday's peculiar broadcast attentively", "kindly", "throughout unedited surveillance material supplied"]
    rows = [(i, "S/r/a.mp4", q, "train" if i % 2 else "val") for i, q in enumerate(short * 8)]
    leads = [(lead, q) for lead in before for q in short]
    rows += [(100 + i, "S/r/a.mp4", f"{lead} {q}", "val" if i % 2 else "train") for i, (lead, q) in enumerate(leads)]
    rows += [(200 + i, "S/r/a.mp4", f"{lead} {q} considering everything visible onscreen afterwards", "train" if i % 2 else "val") for i, (lead, q) in enumerate(leads)]
    got = {tuple(r)[:2] for r in overlap.cross_split_pairs(spark.createDataFrame(rows, "row_id bigint, video_id string, problem string, split_name string")).collect()}
    want = {(a, b) for a, _, p, s in rows if s == "train" for b, _, q, u in rows if u == "val" and overlap.same_question(overlap.asked(p), overlap.asked(q))}
    assert got == want and any(a >= 100 > b for a, b in want) and any(b >= 100 > a for a, b in want)


def test_overlap_is_the_shared_length_of_the_shorter_text():
    a = "what does the potter in the olive vest do right after the farmer unpacks the steel funnel"
    got = overlap.shared_shares([a, a, a, "who is it", ""], [a, f"meanwhile behind the curtain {a}", "nothing of this is alike", "kindly who is it", ""], 0.4)
    assert got[0] == 1 and 0.7 < got[1] <= 1 and got[2] < 0.2 and got[3] > 0.8 and got[4] == 0
    owner, digest, length = chunking.chunk_texts([a.encode(), a.replace("olive", "teal").encode()], overlap.MASK_BITS)
    shared = sum(n for d, n in zip(digest[owner == 0], length[owner == 0]) if d in set(digest[owner == 1]))
    assert overlap.shared_shares([a], [a.replace("olive", "teal")], 0.0)[0] == pytest.approx(shared / (len(a) - 1), abs=0.02)


def test_report_of_overlaps(spark):
    rows = [(1, "S/r/a.mp4", f"{QUESTION}?", "train"), (2, "S/r/a.mp4", f"{QUESTION}!", "val"), (3, "S/r/a.mp4", f"Q. {QUESTION.replace('vest', 'veest')}?", "test"), (4, "S/r/a.mp4", f"{QUESTION}?", "train")]
    df = spark.createDataFrame(rows, "row_id bigint, video_id string, problem string, split_name string")
    got = {r.eval_id: (r.overlap, r.partners) for r in overlap.record_overlaps(overlap.cross_split_pairs(df)).collect()}
    assert got[2] == (1.0, 2) and 0.4 <= got[3][0] < 1 and got[3][1] == 2


def test_hot_chunks_are_spread_and_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(overlap, "HOT_SHARE", 0.0)
    rng = random.Random(8)
    who, what = ["potter", "farmer", "usher", "diver"], ["steel funnel", "torn map", "round tray", "soft hose"]
    texts = [f"Which object does the {rng.choice(who)} in the {rng.choice(['red', 'teal', 'navy'])} vest pick up once the {rng.choice(what)} has been moved?" for _ in range(300)]
    rows = [(i, "S/r/0.mp4", t if i % 4 else t.replace("vest", "veest"), "train" if rng.random() < 0.6 else "val") for i, t in enumerate(texts)]
    got = {tuple(r)[:2] for r in overlap.cross_split_pairs(spark.createDataFrame(rows, "row_id bigint, video_id string, problem string, split_name string")).collect()}
    want = {(a, b) for a, _, ta, sa in rows if sa == "train" for b, _, tb, sb in rows if sb == "val" and overlap.same_question(overlap.asked(ta), overlap.asked(tb))}
    assert got == want


def gap_of(sizes, target, **kw):
    taken = related.closest_fill(sizes, target, **kw)
    assert all(0 < n <= dict(sizes)[s] for s, n in taken.items())
    return abs(target - sum(s * n for s, n in taken.items()))


def test_fill_against_brute_force():
    rng = random.Random(4)
    for _ in range(150):
        sizes = [(s, rng.randint(1, 4)) for s in rng.sample(range(1, 60), rng.randint(1, 5))]
        totals = {0}
        for s, m in sizes:
            totals = {t + s * k for t in totals for k in range(m + 1)}
        target = rng.randint(0, max(totals) + 20)
        assert gap_of(sizes, target) == min(abs(target - t) for t in totals)
        if 1 in dict(sizes):
            # with a small bit set the gap stays as small wherever single rows can close it
            assert gap_of(sizes, target, bits=64) <= max(0, max(s for s, _ in sizes) - dict(sizes)[1])


def test_fill_is_exact_beyond_the_bit_set():
    sizes = [(1, 20_000_000), (2, 3_000_000), (7_000_003, 1), (411, 900), (5_000, 77)]
    for target in (3_260_000, 4_322_088, 5_000_001, 17_777_777, 33_000_001):
        assert gap_of(sizes, target) == 0
    even = [(2, 10_000_000), (1_000_000, 30)]
    assert gap_of(even, 20_000_001) == 1 and gap_of(even, 44_000_000) == 0


def test_fill_of_many_sizes_is_bounded():
    import tracemalloc

    rng = random.Random(6)
    sizes = [(s, rng.randint(1, 3)) for s in range(1, 50_001)]
    tracemalloc.start()
    for target in (100_000, 250_000_000):
        assert gap_of(sizes, target) == 0
    assert tracemalloc.get_traced_memory()[1] < 500e6
    tracemalloc.stop()


def test_fill_of_a_single_large_group():
    assert related.closest_fill([(100, 1)], 80) == {100: 1} and related.closest_fill([(100, 1)], 40) == {} and related.closest_fill([(1000, 1)], 600) == {1000: 1}


def test_fill_is_closest_at_any_size():
    # no single rows: the closest total must not depend on whether one bit set covers the target
    rng = random.Random(11)
    for scale in (1, 100_003):
        for _ in range(60):
            sizes = [(s * scale + (scale > 1) * rng.randint(0, 9), rng.randint(1, 6)) for s in rng.sample(range(20, 70), rng.randint(2, 4))]
            totals = {0}
            for s, m in sizes:
                totals = {t + s * k for t in totals for k in range(m + 1)}
            target = rng.randint(max(totals) // 3, max(totals))
            closest = min(totals, key=lambda t: (abs(target - t), t))
            for bits in (64, 1 << 22) if scale == 1 else (1 << 22,):
                taken = related.closest_fill(sizes, target, bits)
                assert all(0 < n <= dict(sizes)[s] for s, n in taken.items())
                assert sum(s * n for s, n in taken.items()) == closest


def test_fill_of_many_groups_of_few_sizes():
    # few of many groups are open, so the reach is counted in sizes and not in rows
    for sizes in ([(6, 500), (10, 400), (15, 3)], [(35, 90), (36, 80)], [(12, 300), (18, 200), (31, 1)]):
        totals = 1
        for s, m in sizes:
            for _ in range(m):
                totals |= totals << s
        for target in range(2_000, 2_100):
            want = next(g for g in range(99) if totals >> (target - g) & 1 or totals >> (target + g) & 1)
            assert gap_of(sizes, target) == gap_of(sizes, target, bits=64) == want
    assert gap_of([(1_000, 10**9), (1_001, 10**9)], 10**11 + 499) == 0
    # one odd group among even ones, and one that is too large for any split
    even = [(s, 2) for s in range(2, 8_001, 2)]
    for target in (16_000_000, 16_000_001):
        assert gap_of([*even, (99_999, 1)], target) == 0
    assert gap_of([*even, (99_999_999, 1)], 16_000_001) == 1
