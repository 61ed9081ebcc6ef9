import numpy as np
import pytest

from framewright.llm import quality, textstats
from framewright.llm.textstats import STATS

PARTS = [
    "The {0} in the grey coat looks at the {1}, and nobody on the stairs says a word.",
    "Near the garden a {0} has left the {1} where it was found in the morning.",
    "It is late when the {0} comes home with a {1} that was bought for the children.",
    "Because of the rain they moved every {1} into the house before the {0} could ask why.",
    "After lunch we saw how a {0} carried one old {1} to the end of the road.",
    "Nobody knows whether this {0} will sell the {1} or keep it for another year.",
    "You can hear the {0} laugh as soon as the {1} falls from the table.",
    "At first glance the {1} seems broken, but the {0} repairs it with a bit of wire.",
]
WHO = ["cook", "baker", "guard", "diver", "nurse", "pilot", "clerk", "miner"]
WHAT = ["lamp", "door", "coat", "chair", "basket", "window", "kettle", "ladder"]


def prose(i):
    return " ".join(PARTS[(i + 3 * k) % 8].format(WHO[(i * 5 + k) % 8], WHAT[(i * 3 + k * k) % 8]) for k in range(6))


FOREIGN = {
    "it": "Quando il vecchio pescatore torna verso il porto con la barca piena di reti bagnate, la moglie lo aspetta davanti alla porta mentre i figli preparano il tavolo, accendono il fuoco e mettono il pane vicino alla finestra.",
    "sv": "När den gamle fiskaren kommer tillbaka till hamnen med båten full av våta nät står hustrun och väntar vid dörren medan barnen dukar bordet, tänder elden i spisen och lägger brödet bredvid fönstret så att alla kan äta.",
    "fi": "Kun vanha kalastaja palaa satamaan vene täynnä märkiä verkkoja, hänen vaimonsa odottaa oven edessä ja lapset kattavat pöydän, sytyttävät tulen uuniin ja asettavat leivän ikkunan viereen, jotta kaikki voivat syödä yhdessä.",
    "ko": "늙은 어부가 젖은 그물을 가득 실은 배를 타고 항구로 돌아오면 아내는 문 앞에서 기다리고 아이들은 식탁을 차리고 불을 피우고 창가에 빵을 놓는다. 모두가 함께 저녁을 먹고 나서 어부는 내일의 날씨에 대해 이야기한다.",
    "ja": "年老いた漁師が濡れた網を積んだ船で港に戻ると、妻は戸口で待っていて、子供たちは食卓を整え、火をおこし、窓のそばにパンを置く。みんなで夕食を食べたあと、漁師は明日の天気について話す。",
}


def frame(spark, extra, n=120, lang="en"):
    rows = [(1000 + i, prose(i), lang) for i in range(n)] + [(k, t, None) for k, t in enumerate(extra)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string")


def test_plain_prose_of_other_languages_is_no_junk(spark):
    got = {r.doc_id: r for r in quality.document_kinds(frame(spark, FOREIGN.values())).collect()}
    assert {k: got[k].doc_kind for k in range(len(FOREIGN))} == dict.fromkeys(range(len(FOREIGN)))
    # they are far from the prose of the corpus all the same
    assert got[0].distance2 > quality.CUTOFF and got[1].distance2 > quality.CUTOFF


def test_junk_of_several_kinds(spark):
    rng = np.random.default_rng(3)
    mash = " ".join("".join(rng.choice(list("qwhjklzxfdsrtyp"), size=rng.integers(3, 11))) for _ in range(60))
    coded = "\n".join("".join(rng.choice(list("ABCDEFabcdefghij0123456789+/"), size=76)) for _ in range(9))
    menu = " » ".join(rng.choice(["Home", "Login", "Sign up", "Help", "Terms", "Next", "Share"], size=40))
    texts = [mash, coded, menu, menu.replace(" » ", "  "), "ha " * 90, (prose(1).split(",")[0] + ". ") * 12, "#lid!!! @pot42 cup_hd tray4k #jar99 @lid_hd " * 6]
    # spelling is learnt from words, so it takes some hundred of them
    syllables = ["ba", "ne", "ri", "to", "lu", "me", "sa", "co", "di", "pe", "vo", "ga", "nu", "fi", "ro", "ta", "le"]
    words = [a + b + c for a in syllables for b in syllables for c in syllables[:4]]
    named = [(3000 + i, prose(i) + " They named it " + ", ".join(rng.choice(words, size=30)) + ".", "en") for i in range(150)]
    df = frame(spark, texts).unionByName(spark.createDataFrame(named, "doc_id bigint, text string, lang string"))
    got = {r.doc_id: r.doc_kind for r in quality.document_kinds(df).collect()}
    assert [got[k] for k in range(len(texts))] == ["junk"] * len(texts)


def test_the_distance_decides(spark):
    entries = [f"- {a} {b}" for a in ("red", "old", "tall", "wet", "new", "odd") for b in ("box", "pan", "map", "cup")]
    mixes = [prose(i) + "\n\n" + "\n".join(entries[:n]) for i, n in enumerate((0, 4, 8, 40))]
    mixes += [prose(9)[:90] + ".\n" + "\n".join(entries), "\n".join(entries)]
    got = {r.doc_id: r for r in quality.document_kinds(frame(spark, mixes)).collect()}
    rows = [got[k] for k in range(len(mixes))]
    assert rows[2].list_share > 0.1 and rows[2].doc_kind is None and rows[2].part_list_share < quality.CUTOFF
    assert [r.doc_kind for r in rows[4:]] == ["list", "list"] and all(r.part_list_share > quality.CUTOFF for r in rows[4:])
    for r in got.values():
        groups = {g: sum(max(0.0, r[f"part_{s}"]) for s in names) for g, names in quality.GROUPS.items()}
        best = max(groups, key=groups.get)
        assert r.doc_kind == (best if groups[best] > quality.CUTOFF else None)
        assert sum(r[f"part_{s}"] for s in STATS) == pytest.approx(r.distance2)


def test_length_changes_no_rule(spark):
    long_prose = " ".join(prose(i) for i in range(400))
    said = (prose(2) + " ") * 30
    rng = np.random.default_rng(5)
    babble = " ".join(rng.choice(["lol", "ha", "so", "yes", "what"], size=3000))
    got = {r.doc_id: r.doc_kind for r in quality.document_kinds(frame(spark, [long_prose, said, babble, "- " + "very " * 200 + "long entry\n- " + "short " * 150 + "entry"])).collect()}
    assert (got[1], got[2]) == ("junk", "junk") and got[3] in ("list", "junk")


def test_batches_do_not_matter():
    texts = [prose(1), None, "", "- a b\n- c d\n- e f", "a|b\nc|d\ne|f", "x\r\ny", "​", "🎬 🎬", prose(7) * 50, " \n", "#a!!! @b4k"]
    wording = textstats.Wording({"en": ["the", "and", "in"]}, np.array([[97, 98, 50], [98, 99, 20], [98, 97, 400]]))
    at, _, words, stats = textstats.describe_all(texts, wording)
    assert at.tolist() == [0, 3, 4, 5, 6, 7, 8, 10]
    for k, n, row in zip(at.tolist(), words.tolist(), stats.tolist(), strict=True):
        alone = quality.describe(texts[k], wording)
        assert alone[1] == n and alone[2] == pytest.approx(row)


def test_labels_of_any_spelling_and_none(spark):
    df = frame(spark, [], 60, "EN-us").unionByName(frame(spark, [], 3, "xx"))  # too few texts for a language
    assert {r.language for r in quality.document_kinds(df).collect()} == {"en"}
    assert {r.language for r in quality.document_kinds(df.drop("lang")).collect()} == {"any"}


def test_wording_is_learnt_from_all_texts(spark):
    # of 40 words each, one half is held by a few texts more than a quarter of 20,000, the other by a few less
    texts = [(i, " ".join(f"{a}{b}{c}" for k in range(40) for a, b, c in [("xy"[k % 2], "abcdefghij"[k // 4], "mn"[k // 2 % 2])] if (i + 37 * k) % 2000 < 501 - 2 * (k % 2)), "en") for i in range(20_000)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string, lang string").repartition(6)
    got = quality.learn_wording(df, "text", "lang")
    assert sorted(got.place) == sorted(f"x{b}{c}" for b in "abcdefghij" for c in "mn")
    # a word of one text in 10,000 teaches no spelling, however many texts that is
    rare = df.unionByName(spark.createDataFrame([(k, "zq", "en") for k in range(30_000, 30_004)], df.schema))
    got = quality.learn_wording(rare, "text", "lang")
    assert ord("q") not in got.letters.tolist() and ord("x") in got.letters.tolist()
