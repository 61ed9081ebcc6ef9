import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from framewright.llm import answers, endings, leaks, quality, tokenizer, truncation

needs_vocabulary = pytest.mark.skipif(not Path(tokenizer.VOCABULARY).exists(), reason="no vocabulary here")


@needs_vocabulary
def test_encoding_equals_the_public_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    texts = ["", None, "Hello world's  end\n\n x", "<|endoftext|> I'LL it's", "é 漢字かな交じり文 ١٢٣ ½ 🎬👩‍🍳 \u0085 　x", "a" * 3000, "ab" * 900 + "漢字" * 500, "== " * 300, " ", "\r\n\t x", "word " * 5000, "Hello world's  end\n\n x"]
    ref = tokenizers.Tokenizer.from_file(str(Path(tokenizer.VOCABULARY).with_suffix(".json")))
    ref.encode_special_tokens = True
    want = [e.ids for e in ref.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("ids", F.lit(1)).repartition(3)
    got = {r.doc_id: r.ids for r in tokenizer.encode_column(df, "doc_id", "text").collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert tokenizer.encode_column(df.filter("doc_id < 0"), "doc_id", "text").count() == 0


@needs_vocabulary
def test_round_trip():
    import base64

    back = {int(r): base64.b64decode(t) for t, r in (x.split() for x in Path(tokenizer.VOCABULARY).read_bytes().splitlines())}
    text = json.dumps({"k": ["ü", "한국어 텍스트", "  two"]}, ensure_ascii=False) * 40
    ids, sizes = tokenizer.Encoder(tokenizer.load_vocabulary()).encode([text])
    assert b"".join(back[i] for i in ids.tolist()).decode() == text and sizes.tolist() == [len(ids)]


ITEM = "The roofer in the checked tunic rotates the narrow thermos once more while the rower in the red tunic sorts the folded pump under the hanging lamps"
NOTE = "Read the passage below with care and then pick exactly one letter and write nothing else after it in the form."


@pytest.fixture
def items(spark):
    rows = [(i, f"{NOTE}\nThe unique scene number {i} shows a {w} and a cat that walks over the wide bridge at noon in summer.") for i, w in enumerate(["boat", "drum", "kite", "lamp", "sled", "vase", "wand"])]
    return spark.createDataFrame([*rows, (50, f"{NOTE}\n{ITEM}."), (51, f"{NOTE}  {ITEM.upper()}!"), (52, None), (53, ""), (54, "short")], "item_id bigint, text string")


@pytest.mark.parametrize(
    "text,found",
    [
        (f"Before. {ITEM} after.", True),
        (ITEM.replace(" ", "\n").upper(), True),
        ("x <b>" + ITEM.replace("narrow", "narow").replace("sorts", "sortss") + "</b>", True),
        (ITEM.replace("rotates", "ro\xadta\xadtes").replace("the ", "the\xa0"), True),
        (ITEM.replace("once more while", "once more (see note four) while"), True),
        (" ".join(ITEM.split()[3:20]), True),
        (" ".join(ITEM.split()[3:14]) + " and so on", False),
        (NOTE, False),
        ("", False),
        (None, False),
        ("lorem ipsum " * 20000, False),
    ],
)
def test_leaks(spark, items, text, found):
    df = spark.createDataFrame([(1, text, "x")], "doc_id bigint, text string, item_id string")
    got = sorted(r.item_id for r in leaks.find_leaks(df, items).collect())
    assert got == ([50, 51] if found else [])


def test_leaks_of_nothing(spark, items):
    df = spark.createDataFrame([(1, ITEM)], "doc_id bigint, text string")
    assert leaks.find_leaks(df.filter("doc_id < 0"), items).count() == 0
    assert leaks.find_leaks(df, items.filter("item_id < 0")).count() == 0


def test_near_word():
    assert leaks.near_word("thermos", "thremos") and leaks.near_word("pump", "pumps") and not leaks.near_word("red", "teal") and not leaks.near_word("a", "i")


PROSE = "The diver in the red coat opens the door and looks at the lamp. Then she walks to the table, and the cook waits near the stairs. "
DOCS = {
    "list": "Objects seen:\n" + "\n".join(f"- {w} box, near the stairs" for w in ["red", "old", "tall", "soft", "wet", "dry", "new", "odd"]),
    "list2": "\n".join(f"{w} pan" for w in ["red", "old", "tall", "soft", "wet", "dry", "new", "odd", "big"]),
    "table": "clip;frames;half\n" + "\n".join(f"river_{i};{i};train" for i in range(20)),
    "table2": "a       b      c\n" + "\n".join(f"row{i}    {i}     yes" for i in range(12)),
    "junk": "Home  Next  Share  Login  Next  Home  Menu  Share  " * 8,
    "junk2": "#pan!!! @box_hd tray4k #cup_hd lid!!! @jar77 #pot4k bowl_hd " * 4,
    "junk3": "the the the the " * 40,
    "junk4": (PROSE.split(".")[0] + ".\n") * 15,
    "prose": PROSE * 2 + "At noon they leave, but the guard says that it is not late. A man with a hat sits on the bench while it rains.",
    "prose2": "\n".join((PROSE + "At noon they leave because it is late and the sun is gone. ").split(", ")),
    "prose3": "mod: " + PROSE.replace(". ", ".\nA: ") + "It is late.\nB: So we go to the old house by the sea.",
    "prose4": PROSE * 2 + "\n- red box\n- old pan\n" + "After that the baker comes in and asks who has taken the key from the shelf in the hall.",
}


def test_document_kinds(spark):
    rows = [(k, v) for k, v in enumerate(DOCS.values())]
    more = [(100 + i, PROSE + f"On day {i} the {w} is seen by the man who sits in the garden with a book and a cup of tea.") for i, w in enumerate(["dog", "cat", "fox", "owl", "hen", "cow", "pig", "bee", "ant", "elk"] * 5)]
    blank = [(200, None), (201, ""), (202, " \n\t"), (203, "🎬"), (204, PROSE * 800)]
    df = spark.createDataFrame([(*r, 1.0) for r in rows + more + blank], "doc_id bigint, text string, stats double")
    got = {r.doc_id: r for r in quality.document_kinds(df).collect()}
    kinds = {name: got[k].doc_kind for k, name in enumerate(DOCS)}
    assert kinds == {n: None if n.startswith("prose") else n.rstrip("0123456789") for n in DOCS}
    assert not {200, 201, 202} & set(got) and 203 in got
    assert all(got[100 + i].doc_kind is None for i in range(50))
    r = got[2]
    assert sum(r[f"part_{s}"] for s in quality.STATS) == pytest.approx(r.distance2)
    assert quality.document_kinds(df.filter("doc_id < 0")).count() == 0


OPTIONS = ["A. a steel funnel that is filled on the jetty", "B. the potter hides the torn map near the stall", "moving the tray", "D"]


def raw_rows(spark, n=240):
    who, what, verb = ["potter", "farmer", "usher", "diver"], ["pan", "box", "map", "hose", "drum"], ["lifts", "hides", "turns", "fills", "drops"]
    rows = []
    for i in range(n):
        body = " ".join(f"At {i % 60}:{j:02d} the {who[(i + j) % 4]} {verb[(i * j) % 5]} the {what[(i + 2 * j) % 5]} near the stall." for j in range(4 + i % 3))
        end = ["So the answer is A.", "Answer: B", "That leaves (A)", "namely B: the potter hides the torn map near the stall", "The correct option is A!"][i % 5]
        rows.append((i, f"Why does the {who[i % 4]} move the {what[i % 5]} number {i} in the hall?", OPTIONS, "A", "A", f"{body} {end}", f"{body} {end}", "en", "s" if i % 3 else " S"))
    return rows


RAW = "raw_id bigint, question string, options array<string>, gold_answer string, answer_raw string, cot_raw string, long_cot_raw string, question_lang string, source_subset string"


def test_truncation_held_out_accuracy(spark):
    df = spark.createDataFrame(raw_rows(spark), RAW)
    model = truncation.truncation_model(df)
    cores = endings.option_cores(OPTIONS)
    whole = [r[6] for r in raw_rows(spark, 300)[240:]]
    assert sum(truncation.trace_cut(model, t, cores) for t in whole) <= 0.02 * len(whole)
    short = [t[: 40 + (7 * k) % (len(t) - 70)].rstrip() for k, t in enumerate(whole)]
    short = [t for t in short if t[-1] not in ".!?)" and not t.endswith("stall")]
    assert sum(truncation.trace_cut(model, t, cores) for t in short) >= 0.97 * len(short)


def test_truncated_records(spark):
    rows = raw_rows(spark)
    rows += [(900, None, None, None, None, None, None, None, None), (901, "q", None, None, None, None, "", None, "s"), (902, "q", OPTIONS, "A", "A", None, rows[7][6][:90], "en", None), (902, "q", OPTIONS, "A", "A", None, rows[7][6][:90], "en", None), (903, "q", OPTIONS, "A", "A", None, rows[7][6] * 300, "en", "s")]
    raw = spark.createDataFrame(rows, RAW).withColumn("text", F.lit("x")).withColumn("is_cut", F.lit(1))
    text, prompt = rows[3][6], "q\n\nOptions:\n" + "\n".join(OPTIONS[:2])
    outs = [
        (1, f"<COT>\n{text}\n</COT>\n<ANSWER>\nA\n</ANSWER>", False), (2, f"<COT>\n{text[:100]}\n</COT>\n<ANSWER>\nA\n</ANSWER>", True), (3, f"<COT>\n{text}", True), (4, f"<COT>\n{text}\n</COT>\n<ANSW", True),
        (5, "<ANSWER>\nA. a steel fun\n</ANSWER>", True), (6, "<ANSWER>\nA. a steel funnel that is filled on the jetty\n</ANSWER>", False), (7, None, False), (8, " ", False), (9, f"{text[:77]}\n\nA", True), (10, f"{text}\n\nA", False), (11, "<ANSWER><ANSWER>B</ANSWER></ANSWER>", False),
    ]
    export = spark.createDataFrame([(i, o, prompt, "COT", "s") for i, o, _ in outs], "export_id bigint, output string, instruction string, reasoning_depth string, source_subset string")
    got = {}
    for r in truncation.truncated_records(raw, export).collect():
        got.setdefault((r.table_name, r.rec_id), []).append(r.is_cut)
    assert {i: got["sft_export", i][0] for i, _, _ in outs} == {i: c for i, _, c in outs}
    assert got["sft_raw", 900] == [False] and got["sft_raw", 901] == [False] and got["sft_raw", 902] == [True, True] and got["sft_raw", 903] == [False]
    assert truncation.truncated_records(raw.filter("raw_id < 0"), export.filter("export_id < 0")).count() == 0


REFUSAL = "Sorry, this request goes against the guidelines that I have to follow in this case."


def test_answer_defects(spark):
    rows = raw_rows(spark)
    spanish = "Después, el hombre del abrigo gris levanta el reloj de pared frente al garaje y la mujer cierra la puerta. Respuesta: A"
    rows += [(300 + i, f"¿Por qué la mujer del abrigo gris levanta el reloj número {i} en el patio y cierra la puerta?", OPTIONS, "A", "A", spanish, spanish, "es", "s") for i in range(60)]
    q = rows[0][1]
    bad = {
        500: (None, "empty"), 501: ("<ANSWER></ANSWER>", "empty"), 502: ("​", "empty"), 503: ("N/A", "empty"), 504: (q.upper(), "copies_question"), 505: (f"You want to know: {q}", "copies_question"),
        506: ("A. a steel fun", "truncated"), 507: (spanish, "other_language"), 508: ("B", None), 509: ("the potter hides the torn map near the stall", None), 510: (REFUSAL, "refusal"),
    }
    rows += [(i, q, OPTIONS, "A", a, "A", "A", "en", "s") for i, (a, _) in bad.items()]
    rows += [(600 + i, f"Another prompt about thing {i} in the yard?", OPTIONS, "A", REFUSAL, "A", "A", None, None) for i in range(4)]
    rows += [(700, None, None, None, "The potter says sorry to the usher and steps back. Answer: A", None, None, None, None), (508, q, OPTIONS, "A", "B", "A", "A", "en", "s")]
    df = spark.createDataFrame(rows, RAW).withColumn("id", F.lit(1)).withColumn("keys", F.lit("x"))
    got = {}
    for r in answers.answer_defects(df).collect():
        got.setdefault((r.raw_id, r.answer_field), []).append(r.defect)
    assert {i: got[i, "answer_raw"][0] for i in bad} == {i: d for i, (_, d) in bad.items()}
    assert {d for i in range(4) for d in got[600 + i, "answer_raw"]} == {"refusal"}
    assert got[700, "answer_raw"] == [None] and got[700, "cot_raw"] == ["empty"] and got[508, "answer_raw"] == [None, None]
    assert sum(d is not None for i in range(240) for d in got[i, "long_cot_raw"]) == 0
    assert answers.answer_defects(df.filter("raw_id < 0")).count() == 0


def test_similar_openings_of_a_crowded_band_share_a_cluster(spark):
    rng = random.Random(7)
    common = " ".join(f"w{i}" for i in range(20))
    groups = [[f"{rng.randint(100, 999)} p{g} q{g} {common} e{k}" for k in range(g % 4 + 1)] for g in range(80)]
    for g in groups:
        g[:] = [f"{g[0].split()[0]} {o.split(' ', 1)[1]}" for o in g]
    alike = lambda a, b: len(a & b) >= answers.SIMILARITY * len(a | b)
    sets = [[answers.shingles(o) for o in g] for g in groups]
    assert all(alike(a, b) == (i == j) for i, g in enumerate(sets) for j, h in enumerate(sets) for a in g for b in h)
    rows = [(False, 10 * i + k, [o]) for i, g in enumerate(groups) for k, o in enumerate(g)]
    got = {r.opening for r in answers.refusal_openings(spark.createDataFrame(rows, "answered boolean, prompt bigint, keys array<string>")).collect()}
    assert got == {o for g in groups if len(g) >= answers.PROMPTS for o in g}


def test_distinct_share_of_the_whole_text():
    at = quality.STATS.index("distinct_share")
    rng = random.Random(2)
    varied = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(200)]
    for words in ([], varied[:150] + varied[:20], varied, varied + ["pan", "box"] * 300, [rng.choice(varied) for _ in range(901)], [rng.choice(varied) for _ in range(201)]):
        parts = [words[i : i + 200] for i in range(max(1, len(words) - 199))]
        want = sum(len(set(p)) / max(1, len(p)) for p in parts) / len(parts)
        assert quality.distinct_share(words) == pytest.approx(want)
        assert not words or quality.describe(" ".join(words))[2][at] == pytest.approx(want)


def test_copies_of_long_questions(spark):
    rows = raw_rows(spark)
    for k, q in enumerate(["Why does it move?", "Why does the potter in the grey coat move the pan near the stall after the farmer has turned the old drum by the gate " * 2 + "?", "What is seen while " + "the usher waits and " * 60 + "the rain falls?"]):
        rows += [(800 + 10 * k + n, q, OPTIONS, "A", " ".join([q] * (n + 1)), "A", "A", "en", "s") for n in range(3)]
    got = {r.raw_id: r.defect for r in answers.answer_defects(spark.createDataFrame(rows, RAW)).filter("answer_field = 'answer_raw' AND raw_id >= 800").collect()}
    assert set(got.values()) == {"copies_question"} and len(got) == 9


def test_limits_of_short_fields_and_scores(spark):
    rows = raw_rows(spark, 400)
    short = [(1000 + i, r[1], OPTIONS, "A", "A", "A", r[6][:96], "en", "s") for i, r in enumerate(rows[:40])]
    df = spark.createDataFrame(rows + short, RAW)
    assert 96 in endings.field_limits(df, [F.col("long_cot_raw")])
    export = spark.createDataFrame([(1, "<COT>x", "q", "COT", "s"), (2, "<ANSWER>A</ANSWER>", "q", "ANSWER", "s")], "export_id bigint, output string, instruction string, reasoning_depth string, source_subset string")
    got = {(r.table_name, r.rec_id): r for r in truncation.truncated_records(df, export).collect()}
    assert all(0.0 <= r.score <= 1.0 and r.is_cut == (r.score > 0.5) for r in got.values()) and got["sft_export", 1].score == 1.0 and got["sft_export", 2].score == 0.0
    assert sum(got["sft_raw", 1000 + i].is_cut for i in range(40)) >= 36


def test_words_met_one_at_a_time_cost_no_copies(monkeypatch):
    known = answers.Languages([("en", "the cat sat on the mat"), ("de", "die katze sass auf der matte")])
    words = [f"w{k}" for k in range(20_000)]
    tables = {id(known.rows): known.rows}
    for w in words:
        assert known.guess([w, "the", "the", "7"]) == known.guess(["the", w, "the"])
        tables[id(known.rows)] = known.rows
    assert len(tables) < 8 and len(known.place) == 20_002
    # a full cache starts anew and changes no result
    monkeypatch.setattr(answers, "WORD_CACHE", 3)
    want = [("en", "the cat"), ("de", "die matte"), ("ko", "고양이 매트 cat"), (None, "12 7"), (None, ""), ("de", "auf der zaun die wand ist kalt")]
    fresh = answers.Languages([("en", "the cat sat on the mat"), ("de", "die katze sass auf der matte")])
    for lang, text in want * 2:
        got = fresh.guess(answers.words_of(text))
        assert got[0] == lang and got == known.guess(answers.words_of(text))
