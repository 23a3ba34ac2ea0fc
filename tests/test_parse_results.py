from pyspark.sql import functions as F

from examlake.operators import answer_keys, lines
from examlake.operators import parse_results as P

SCHEMA = "doc long, number int, stem string, options array<string>, answer int, context string, trailing string, issues array<string>"
FOUR = ["red", "green", "blue", "black"]


def test_types(spark):
    asked = [
        (("Which colour is meant?", FOUR, 1, None), "mcq"), (("Which colour is meant?", FOUR, 2, None), "multi_select"), (("It is so.", ["True", "False"], 1, None), "true_false"), (("It is so.", ["True", "Never"], 1, None), "mcq"),
        (("What follows?", FOUR, 1, "A passage"), "comprehension"), (("Assertion: a. Reason: b.", FOUR, 0, None), "assertion_reason"), (("Match the items of both columns", FOUR, 0, None), "match_columns"),
        (("He ____ home", [], 0, None), "fill_blank"), (("Explain", ["one"], 0, "x"), "descriptive"),
    ]
    rows = spark.createDataFrame([(i, *a) for i, (a, _) in enumerate(asked)], "i int, stem string, options array<string>, r int, context string")
    got = [r[0] for r in rows.orderBy("i").select(P.kind(F.col("stem"), F.col("options"), F.col("r"), F.col("context"))).collect()]
    assert got == [w for _, w in asked]


def test_findings_confidence_and_summaries(spark):
    long = "Which of these colours is meant here?"
    rows = [
        (1, 1, long, FOUR, 1, "", "", []), (1, 2, long, FOUR[:2], None, "", "", []), (1, 3, "Why", [], None, "", "", ["no_options"]), (1, 4, f"{long} �", FOUR, 0, "", "left", []), (1, 5, "", [], None, "", "", []),
        (2, 1, long, FOUR, None, None, None, None), (3, 1, long, FOUR, 2, "", "over", ["option_overrun", "options_replaced"]),
    ]
    usual = spark.createDataFrame([(1, 4), (3, 4)], "doc long, options int")
    done = P.finished(spark.createDataFrame(rows, SCHEMA), usual, "doc")
    got = {(r["doc"], r["number"]): (sorted(r["issues"]), round(r["confidence"], 2)) for r in done.collect()}
    assert got == {
        (1, 1): ([], 1.0), (1, 2): (["incomplete_options"], 0.8), (1, 3): (["no_options", "stem_too_short"], 0.25), (1, 4): (["trailing_text", "unreadable_source"], 0.4), (2, 1): ([], 1.0), (3, 1): (["option_overrun", "options_replaced"], 0.4),
    }
    docs = spark.createDataFrame([(1,), (2,), (3,), (4,)], "doc long")
    said = {r["doc"]: (r["questions"], r["answered"], r["flagged"], round(r["confidence"], 4), r["warnings"]) for r in P.summaries(done, docs, "doc", expected=5).collect()}
    assert said[1] == (4, 2, 3, 0.6125, ["unanswered", "few_options", "below_expected", "flagged"])
    assert said[2] == (1, 0, 0, 1.0, ["no_answer_key", "unanswered", "below_expected"]) and said[4] == (0, 0, 0, 0.0, ["no_questions"])
    assert P.finished(spark.createDataFrame([], SCHEMA), usual, "doc").count() == 0


def test_better_reading(spark):
    frame = lambda rows: spark.createDataFrame(rows, "doc long, questions long, confidence double")
    a = frame([(1, 0, 1.0), (2, 5, 0.5), (3, 20, 0.2), (4, 10, 0.9), (5, 10, 0.96), (6, 10, 0.9)])
    b = frame([(1, 9, 0.1), (2, 0, 0.0), (3, 10, 0.9), (4, 20, 0.1), (5, 10, 0.9), (6, 10, 0.9)])
    got = {r["doc"]: r["chosen"] for r in P.better(a, b, "doc").collect()}
    assert got == {1: "incumbent", 2: "candidate", 3: "candidate", 4: "incumbent", 5: "candidate", 6: "incumbent"}


def test_regions(spark):
    front = "\n".join(f"{n}. Which of these is item {n}?" for n in range(1, 11))
    pairs = "1. (a)\n2. (b) 3. (c)"
    texts = [f"{front}\n## Answer Key\n{pairs}", f"{front}\n## Answers\nfew words", f"## Answer Key\n{pairs}\n{front}", f"{front}\n## Answers\nnothing\n## Answer Key\n{pairs}\n## Solutions\n1. because", f"{front}\n## Explanations\n1. because", f"{front}\nThe answers are given below in full for you.\n{pairs}", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc long, text string")
    got = {r["doc"]: (r["key_start"], r["solution_start"], r["question_end"]) for r in answer_keys.regions(lines.prepared(docs, "doc", "text"), "doc").collect()}
    assert got[0] == (10, None, 10) and got[1] == (None, None, None) and got[2] == (None, None, None)
    assert got[3] == (10, 15, 10), "pairs within reach of the first heading back it"
    assert got[4] == (None, 10, 10) and got[5] == (None, None, None)
