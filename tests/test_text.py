from pyspark.sql import functions as F

from framewright.functions import text as T

C = F.col("x")


def one(values, fn, *texts):
    return values([(t,) for t in texts], "x string", fn)


def test_wrap_answer(values):
    got = one(values, T.wrap_answer(C), "x < answers > B </answer>y", "B", None)
    assert got == ["<ANSWER>B</ANSWER>", "<ANSWER>B</ANSWER>", "<ANSWER></ANSWER>"]


def test_plain_answer(values):
    got = one(values, T.plain_answer(C), "</answer><answer>", "<answers>B</answers>", "a <Answer> B </ANSWER> c", None, "<answer></answer>")
    assert got == [None, "<answers>B</answers>", "B", "", ""]


def test_choice_letter(values):
    assert one(values, T.choice_letter(C), "(B)", "a car, option C", "None", "xyz  Q", "<ANSWER> d </answer>", None) == ["b", "a", "e", "xyz q", "d", ""]
    assert one(values, T.choice_letter(C, "A-E"), "G") == ["g"]
    assert one(values, T.choice_letter(C), "éaé") == ["a"]


def test_format_is_strict(values):
    texts = ["<answer>B</answer>", "<ANSWER>x</ANSWER> j <ANSWER>y</ANSWER>", "<COT>r</COT>", "<COT>r</COT>\n<ANSWER>B</ANSWER>\n", "<ANSWER>B</ANSWER> x"]
    assert one(values, T.format_ok(C), *texts) == [0, 1, 0, 1, 0]


def test_format_class(values):
    texts = ["B.", " b ", "<ANSWER>B", "<ANSWER>b</ANSWER>", "<ANSWER>B. x</ANSWER>", "hello", None]
    assert one(values, T.format_class(C), *texts) == ["plain_option_sentence", "plain_letter", "broken_or_partial_tag", "strict_tag_letter", "broken_or_partial_tag", "other", "other"]


def test_options(values):
    assert values([(["A. x", " ", "3", None],), (None,)], "x array<string>", T.option_list(C)) == [["A. x", "3"], []]
    assert one(values, T.option_lines(C), "A\n\nB", None) == [["A", "B"], []]
    m = F.create_map(F.lit("B"), F.lit("y"), F.lit("A"), F.lit("x"), F.lit("C"), F.lit(""))
    assert one(values, T.option_map(m), "-") == [["A. x", "B. y"]]


def test_problem_text(values):
    rows = [("QUESTION: q", None, ["A. a"]), (None, "q A. a", ["A. a"]), ("", "", ["A. a"]), ("", "", []), ("  ", "q", []), ("q", None, None)]
    got = values(rows, "p string, q string, o array<string>", T.problem_text(F.col("p"), F.col("q"), F.col("o")))
    assert got == ["QUESTION: q\nOptions:\nA. a", "Question: q A. a", "Question:\nOptions:\nA. a", "", "", "Question: q"]


def test_tags_and_reasoning(values):
    t = "<LONG_COT> a </LONG_COT><ANSWER>B</ANSWER>"
    assert one(values, T.reasoning_type(C), t, "<COT>x</COT>" + t, "<cot>x</cot>", None) == ["long_cot_tag", "cot_tag", "none", "none"]
    assert one(values, T.reasoning_text(C), t, "x") == ["a", ""]
    assert one(values, T.tag_block(C, "ANSWER"), t, "x") == ["<ANSWER>B</ANSWER>", None]
    assert one(values, T.has_code_block(C), "<CODE>1</CODE>", "x") == [True, False]


def test_small_builders(values):
    assert one(values, T.strip_image_marks(C), "<image 1> a <image>", None) == ["a", ""]
    assert one(values, T.normalize_space(C), "  A  b\n\tC ") == ["a b c"]
    assert one(values, T.n_words(C), " a  b ", "", None) == [2, 0, 0]
    assert one(values, T.user_text(C, F.lit(" "), F.lit("f")), "i") == ["i\n\nf"]
