import random

from framewright.llm import leaks

WHO = ["roofer", "rower", "baker", "potter", "usher", "diver", "weaver", "farmer", "drummer", "plumber", "waiter", "tailor"]
WHAT = ["thermos", "pump", "kettle", "ladder", "funnel", "basket", "lantern", "mirror", "hammer", "cushion", "bottle", "carpet"]
VERB = ["rotates", "folds", "sorts", "lifts", "paints", "hides", "drops", "weighs", "opens", "cleans"]
MORE = [a + b for a in ("bra", "cor", "dun", "fel", "gri", "hol", "mar", "pel", "sto", "wen") for b in ("ner", "vil", "dow", "kin", "ster", "lock", "mer", "ton")]
WHERE = ["under the hanging lamps", "near the old gate", "behind the wooden stage", "at the edge of the pool", "beside the parked van"]


def scene(rng):
    one = lambda: f"the {rng.choice(WHO)} in the {rng.choice(['checked', 'red', 'olive', 'navy', 'grey'])} {rng.choice(['tunic', 'coat', 'scarf'])} {rng.choice(VERB)} the {rng.choice(['narrow', 'folded', 'heavy', 'broken', 'shiny'])} {rng.choice(WHAT)} {rng.choice(MORE)} {rng.choice(WHERE)} with {rng.choice(MORE)}"
    return f"{one()} while {one()} and {one()}"


def slip(word, rng):
    if len(word) < 4:
        return word + word[-1]
    k = rng.randrange(1, len(word) - 1)
    return word[:k] + word[k + 1 :] if rng.random() < 0.5 else word[:k] + word[k + 1] + word[k] + word[k + 2 :] if word[k] != word[k + 1] else word[:k] + word[k:] + "e"


FILLER = "on most days people talk about weather and food before they go home to rest since nothing else seems worth saying".split()


def planted(rng, words, n, every):
    at = rng.randrange(0, len(words) - n + 1)
    cut = [slip(w, rng) if (i + 1) % every == 0 else w for i, w in enumerate(words[at : at + n])]
    return [*rng.choices(FILLER, k=30), *cut, *rng.choices(FILLER, k=30)]


def test_recall_of_planted_passages():
    rng = random.Random(1)
    items = [scene(rng) for _ in range(300)]
    index = leaks.ItemIndex(list(enumerate(items)))
    rates = {}
    for n, every in ((15, 99), (15, 5), (20, 5), (16, 4), (20, 4)):
        docs = [planted(rng, leaks.words_of(t), n, every) for t in items]
        found = {(d, i) for d, t, _, _ in index.scan(docs) for i in index.ids[t]}
        rates[n, every] = sum((k, k) in found for k in range(len(items))) / len(items)
    # some runs of eight words are shared by more than six of these items by chance
    assert rates[15, 99] >= 0.97 and min(rates[15, 5], rates[20, 5]) >= 0.95 and min(rates[16, 4], rates[20, 4]) >= 0.9, rates
    assert not index.scan([rng.choices(FILLER, k=400)])


def test_siblings_on_one_scene_are_all_found():
    rng = random.Random(2)
    line = "Read the passage below with care and then pick exactly one letter and write nothing else after it in the form"
    base = scene(rng)
    siblings = [f"{line}. {base}. {q}" for q in ("What is lifted first?", "Who stands near the gate?", "Which colour is the coat?", "When does the rain begin?", "Why do they stop?", "Where does the van go?", "How many people are seen?", "What falls down at last?")]
    others = [f"{line}. {scene(rng)}." for _ in range(12)]
    index = leaks.ItemIndex(list(enumerate([*siblings, *others])))
    found = {i for _, t, _, _ in index.scan([leaks.words_of(f"x y {base} z")]) for i in index.ids[t]}
    assert found == set(range(len(siblings)))
    assert index.scan([leaks.words_of(line)]) == []


def test_spans_are_cut_out(spark):
    rng = random.Random(3)
    item = scene(rng)
    other = scene(rng)
    leaked = f"Before <b>it</b> all.\n{item.upper()}!\nIn between. {other} After&nbsp;all."
    df = spark.createDataFrame([(1, leaked), (2, "nothing of it"), (3, None), (4, "")], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, item), (8, other), (9, None)], "item_id bigint, text string")
    got = {r.doc_id: (r.text, r.n_cuts) for r in leaks.without_spans(df, items).collect()}
    assert got[1] == ("Before <b>it</b> all.\n\nIn between.  After&nbsp;all.", 2) and got[2] == ("nothing of it", 0) and got[3] == (None, 0) and got[4] == ("", 0)


def test_too_many_items_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(leaks, "MAX_ITEM_CHARS", 40)
    items = spark.createDataFrame([(1, "word " * 20)], "item_id bigint, text string")
    try:
        leaks.find_leaks(items.withColumnRenamed("item_id", "doc_id"), items)
    except ValueError as e:
        assert "characters" in str(e)
    else:
        raise AssertionError
