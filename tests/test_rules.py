"""Rule drivers: whole questions and whole papers, with one defect at a time."""

import pytest
from pyspark.sql import functions as F

from examlake.functions import text
from examlake.operators import layout, paper_rules, question_rules

OPTION = "array<struct<text:string,is_correct:boolean>>"
QUESTION = f"case_id string, type string, stem string, options {OPTION}, answer string, explanation string, passage string, trailing string, subject string, confidence double, parser_issues array<string>, model_reviewed boolean"
FOUR = [("Delhi", False), ("Mumbai", True), ("Chennai", False), ("Kolkata", False)]


def question(case, **changes):
    base = {"type": "mcq", "stem": "Which city is the financial capital of India?", "options": FOUR, "answer": None, "explanation": "Option 2 is correct.", "passage": None, "trailing": None, "subject": "gk", "confidence": 0.9, "parser_issues": [], "model_reviewed": True}
    return (case, *(base | changes).values())


CASES = {
    "sound": ({}, set()),
    "none marked": ({"options": [(t, False) for t, _ in FOUR], "explanation": None}, {("no_answer", "critical")}),
    "descriptive": ({"type": "descriptive", "options": None, "answer": "An essay", "explanation": None}, set()),
    "multi": ({"type": "multi_select", "options": [(t, True) for t, _ in FOUR], "explanation": None}, set()),
    "two marked": ({"options": [(t, True) for t, _ in FOUR], "explanation": None}, {("multiple_answers", "critical")}),
    "mismatch": ({"explanation": "Option 3 is correct."}, {("explanation_mismatch", "critical")}),
    "trailing": ({"trailing": "left over"}, {("trailing_text", "major")}),
    "unsorted": ({"subject": "UNSORTED"}, {("unclassified_subject", "major")}),
    "doubtful": ({"confidence": 0.4}, {("low_extraction_confidence", "major")}),
    "parser": ({"parser_issues": ["unreadable_source", "context_capped", "option_overrun"]}, {("unreadable_source", "critical"), ("context_capped", "minor"), ("option_overrun", "major")}),
    "no passage": ({"type": "comprehension"}, {("passage_missing", "critical")}),
    "short passage": ({"type": "comprehension", "passage": "a few words"}, {("passage_too_short", "major")}),
    "not reviewed": ({"model_reviewed": None}, {("model_review_not_run", "minor")}),
    "nulls": ({k: None for k in ("type", "stem", "options", "explanation", "subject", "confidence", "parser_issues")}, {("stem_empty", "critical"), ("no_options", "critical"), ("no_answer", "critical")}),
}


def test_questions_with_one_defect(spark):
    df = spark.createDataFrame([question(k, **c) for k, (c, _) in CASES.items()], QUESTION)
    got = {r["case_id"]: {(x["code"], x["severity"]) for x in r["issues"]} for r in question_rules.validated(df, expected=4, model_expected=True).collect()}
    assert got == {k: want for k, (_, want) in CASES.items()}


ITEM = f"paper string, sequence int, section string, subject string, question_id long, stem string, options {OPTION}, answer string, explanation string, passage_id long, passage string, type string, difficulty string, quality string, has_answer boolean, marks double, negative double"
PAPER = "paper string, questions int, tolerance int, expected_marks double, header_marks double, expected_negative double, header_negative double, minutes int, expected_minutes int, want struct<easy:int,medium:int,hard:int>, rated boolean, model_expected boolean, model_ran boolean"


def items(paper, change=None):
    out = []
    for i in range(40):
        row = {"paper": paper, "sequence": i + 1, "section": f"S{i // 10}", "subject": f"T{i // 10}", "question_id": 100 + i, "stem": f"Which value belongs to item {'abcdefghij'[i % 10]}{i}?", "options": [(t, j == i % 4) for j, (t, _) in enumerate(FOUR)], "answer": None, "explanation": None, "passage_id": None, "passage": None, "type": "mcq", "difficulty": ("easy", "medium", "medium", "hard")[i % 4], "quality": "pass", "has_answer": True, "marks": 2.0, "negative": 0.5}
        out.append(row)
    if change:
        change(out)
    return [tuple(r.values()) for r in out]


def paper(name, **changes):
    base = {"questions": 40, "tolerance": 0, "expected_marks": 80.0, "header_marks": 80.0, "expected_negative": 0.5, "header_negative": 0.5, "minutes": 60, "expected_minutes": 60, "want": (25, 50, 25), "rated": True, "model_expected": False, "model_ran": None}
    return (name, *(base | changes).values())


def put(i, **values):
    return lambda rows: rows[i].update(values)


PAPERS = {
    "sound": ({}, None, set()),
    "short": ({"tolerance": 1, "expected_marks": 78.0, "header_marks": 78.0}, lambda r: r.pop(), {"paper_question_count_mismatch", "paper_section_count_mismatch"}),
    "marks": ({"header_marks": 100.0}, None, {"paper_marks_mismatch"}),
    "penalty": ({"header_negative": 0.0}, None, {"paper_negative_marks_wrong"}),
    "penalties": ({}, put(3, negative=0.25), {"paper_negative_marks_wrong"}),
    "untimed": ({"minutes": None}, None, {"paper_duration_missing"}),
    "section": ({}, lambda r: [x.update(section="S9", subject="T3") for x in r[30:]], {"paper_section_missing"}),
    "mixed": ({}, put(5, subject="T3"), {"paper_subject_distribution_off"}),
    "unrated": ({"rated": False}, None, {"paper_difficulty_unrated"}),
    "hard": ({}, lambda r: [x.update(difficulty="hard") for x in r], {"paper_difficulty_distribution_off"}),
    "twice": ({}, put(8, question_id=103), {"paper_duplicate_question"}),
    "reworded": ({}, put(8, stem="which value, belongs to item d3"), {"paper_repeated_stem"}),
    "failed": ({}, put(1, quality="failed"), {"paper_failed_question"}),
    "unvetted": ({}, put(1, quality=None), {"paper_unvetted_question"}),
    "unanswered": ({}, put(1, has_answer=False, options=None), {"paper_missing_answer"}),
    "placeholder": ({}, put(1, stem="Which TODO belongs here?"), {"paper_placeholder"}),
    "corrupt": ({}, put(1, options=[("bad � one", False), ("b", True)]), {"paper_corrupt_question"}),
    "argues": ({}, put(0, explanation="Option 3 is correct."), {"paper_answer_explanation_mismatch"}),
    "passage": ({}, put(1, passage_id=7), {"paper_broken_passage"}),
    "skewed": ({}, lambda r: [x.update(options=FOUR) for x in r], {"paper_answer_key_skewed"}),
    "jump": ({}, put(39, sequence=44), {"paper_sequence_gap"}),
    "no model": ({"model_expected": True}, None, {"model_review_not_run"}),
    "empty": ({}, lambda r: r.clear(), {"paper_empty"}),
}


def test_papers_with_one_defect(spark):
    papers = spark.createDataFrame([paper(k, **p) for k, (p, _, _) in PAPERS.items()], PAPER)
    rows = spark.createDataFrame([r for k, (_, change, _) in PAPERS.items() for r in items(k, change)], ITEM)
    sections = spark.createDataFrame([(k, f"S{i}", 10) for k in PAPERS for i in range(4)], "paper string, section string, want int")
    found = paper_rules.validated(papers, rows, sections).collect()
    got = {k: {r["code"] for r in found if r["paper"] == k} for k in PAPERS}
    assert got == {k: want for k, (_, _, want) in PAPERS.items()}
    assert {r["severity"] for r in found if r["paper"] == "short" and r["code"] == "paper_question_count_mismatch"} == {"major"}


GROUND = "the quick brown fox jumps over the lazy dog near the old river bank"


@pytest.mark.parametrize("said,want", [("", True), ("fox", True), ("wolf", False), ("Quick, brown FOX", True), ("quick fox jumps over lazy", True), ("fox quick brown", False), ("the quick river bank jumps", False), ("dog fox", True), ("brown jumps dog old bank", False)])
def test_grounded(spark, said, want):
    words = lambda s: text.tokens(F.lit(s))
    assert spark.range(1).select(text.grounded(words(GROUND), words(said))).first()[0] is want


def test_layout_confidence(spark):
    asked = [((10, 0, 0, 0, 1000, 0, 0), 1.0), ((10, 5, 0, 0, 1000, 0, 0), 0.55), ((10, 0, 10, 0, 1000, 0, 0), 0.5), ((10, 0, 0, 10, 1000, 0, 0), 0.7), ((10, 0, 0, 0, 1000, 1, 0), 1.0), ((10, 0, 0, 0, 1000, 100, 0), 0.6), ((10, 0, 0, 0, 1000, 0, 400), 0.9), ((0, 0, 0, 0, 0, 0, 0), 0.0), ((10, 10, 0, 0, 0, 0, 0), 0.1)]
    for counts, want in asked:
        assert abs(spark.range(1).select(layout.confidence(*map(F.lit, counts))).first()[0] - want) < 1e-9


def test_gutters_and_columns(spark):
    rows = [(1, r, float(x), x + 8.0) for r in range(30) for x in (10, 12, 14, 60, 62, 64)] + [(1, 99, 40.0, 41.0)]
    glyphs = spark.createDataFrame(rows, "page int, row int, x0 double, x1 double")
    found = layout.gutters(glyphs, "page", "row", "x0", "x1", F.lit(100.0)).collect()
    # One row of 31 inks the gap, which is below 6 percent; the band reaches from behind the left column to the right one.
    assert [(r["from_bin"], r["to_bin"]) for r in found] == [(53, 143)]
    got = sorted((r["column"], round(r["left"], 2), round(r["right"], 2), r["glyphs"]) for r in layout.columns(glyphs, "page", "row", "x0", "x1", F.lit(100.0)).collect())
    assert got == [(0, 10.0, 22.08, 91), (1, 60.0, 72.0, 90)]
