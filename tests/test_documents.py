"""Conventions, answer keys, aliases, rules and the marking scheme on small documents."""

import pytest
from pyspark.sql import functions as F

from examlake.functions import rules, text
from examlake.operators import aliases, answer_keys, conventions, lines, parsing, patterns, question_rules

QUIZ = "\n".join(f"{n}. Which of these is item {n}?\n(a) red {n}\n(b) green\n(c) blue\n(d) black" for n in range(1, 5))
NUMBERED = "\n".join(f"Q{n}. Pick one\n1) a{n}\n2) b\n3) c\n4) d" for n in range(1, 4))
ROWS_OF_TWO = "\n".join(f"{n}. Choose\n(a) one (b) two\n(c) three (d) four" for n in range(1, 4))


def test_option_styles(spark):
    docs = spark.createDataFrame([(1, QUIZ), (2, NUMBERED), (3, ROWS_OF_TWO), (4, "plain prose only"), (5, None), (6, "1. a\n2. b\n(a) x (b) y (c) z")], "doc long, text string")
    got = {r["doc"]: (r["kind"], r["wrap"], r["options"]) for r in conventions.option_styles(docs, "doc", "text").collect()}
    assert got[1] == ("lower_alpha", "paren", 4)
    assert got[2] == ("numeric", "trail", 4)
    assert got[3] == ("lower_alpha", "paren", 4), "rows of two are one cycle of four"
    assert 4 not in got and 5 not in got
    assert got[6] == ("lower_alpha", "paren", 3)


def test_answer_keys(spark):
    docs = [
        (1, "Answer Key\n1. (a) 2. (c) 3. (d)\n2. (b)"),
        (2, "| Q | Ans | Q | Ans |\n|---|---|---|---|\n| 1 | A | 2 | B |\n| 3. | (4) | 4 | ii |"),
        (3, "1-a, 2-b\n3: D\nq4 = c"),
        (4, "1. a 2. b 3. c"),
        (5, None),
        (6, "5. i\n6. (vi)\n7. (z)"),
    ]
    got = {}
    for r in answer_keys.answer_key(spark.createDataFrame(docs, "doc long, text string"), "doc", "text").collect():
        got.setdefault(r["doc"], {})[r["number"]] = r["option"]
    assert got[1] == {1: 0, 2: 2, 3: 3}, "the first value of a question wins"
    assert got[2] == {1: 0, 2: 1, 3: 3, 4: 1}
    assert got[3] == {1: 0, 2: 1, 3: 3, 4: 2}
    assert got[4] == {1: 0, 3: 2}, "a pair takes the space behind it, so the next pair of a tight list is not seen"
    assert got.get(6, {}).get(6) == 5 and 5 not in got


def test_verdicts(spark):
    said = [("Hence option (3) is correct", 2), ("Ans. b", 1), ("(c) is the correct one", 2), ("no verdict here", None), ("the answer is 9", None)]
    rows = spark.createDataFrame([(t,) for t, _ in said], "t string").select("t", answer_keys.verdict(F.col("t")).alias("v")).collect()
    assert [r["v"] for r in rows] == [v for _, v in said]


def test_aliases(spark):
    subjects = spark.createDataFrame([("quant", "Quantitative Aptitude", 0), ("quant", "Mathematics", 0), ("reason", "General Intelligence and Reasoning", 1), ("gk", "General Awareness", 2), ("late", "Mathematics", 3)], "entry string, alias string, ordinal int")
    rows = [(1, "PART B - General Awareness (25 Questions)"), (2, "**mathematics**"), (3, "Reasoning & General Intelligence"), (4, "the cat"), (5, None), (6, "Advanced Mathematics Test Paper Two")]
    got = {r["id"]: (r["entry"], round(r["score"], 3)) for r in aliases.matched(spark.createDataFrame(rows, "id long, line string"), ["id"], "line", aliases.index(subjects, "entry", "alias", "ordinal")).collect()}
    assert got[1] == ("gk", 1.0) and got[2] == ("quant", 1.0)
    assert got[3][0] == "reason" and got[6][0] == "quant"
    assert 4 not in got and 5 not in got


@pytest.mark.parametrize(
    ("field", "codes"),
    [
        ("fine text", []), ("", []), (None, []), ("bad � here", ["unreadable_chars"]), ("see [TODO] later", ["placeholder"]), (r"name \\\\ here", ["backslash_run"]), ("a &amp; b", ["html_entity"]),
        ("cafÃ© au", ["mojibake"]), ("bell\x07", ["control_chars"]), ("aaaaaaa", ["character_run"]), ("_______", []), ("| a |---| b", ["markdown_residue"]), ("naïve Ñandú", []), ("<!-- x --> &nbsp;", ["placeholder", "html_entity"]),
    ],
)
def test_corruption(spark, field, codes):
    assert spark.createDataFrame([(field,)], "t string").select(rules.inspected(F.col("t"))).first()[0] == codes


def _codes(spark, stem, options, answer=None, explanation=None, passage=None):
    o = F.array(*(F.struct(F.lit(t).alias("text"), F.lit(c).alias("is_correct")) for t, c in options)) if options else F.array().cast("array<struct<text:string,is_correct:boolean>>")
    lit = lambda v: F.lit(v).cast("string")
    found = F.concat(question_rules.stem_issues(lit(stem)), question_rules.option_issues(o), question_rules.answer_issues(o, lit(answer), lit(explanation)), question_rules.option_text_issues(o), question_rules.reference_issues(lit(stem), o, lit(passage)))
    r = spark.range(1).select(question_rules.deduped(found).alias("i")).select("i", question_rules.verdict(F.col("i")).alias("v"), question_rules.score(F.col("i"), F.lit(0.0)).alias("s")).first()
    return [x["code"] for x in r["i"]], r["v"], round(r["s"], 2)


FOUR = [("red", False), ("green", True), ("blue", False), ("black", False)]


def test_question_rules(spark):
    good = "Which of these colours is the colour of grass?"
    assert _codes(spark, good, FOUR) == ([], "pass", 1.0)
    assert _codes(spark, "", FOUR)[0] == ["stem_empty"]
    assert _codes(spark, "Which?", FOUR)[0] == ["stem_too_short"]
    assert _codes(spark, "Which is the colour of the", FOUR)[0] == ["stem_truncated"]
    assert _codes(spark, "Grass has a colour of its own.", FOUR) == (["stem_not_a_question"], "review", 0.88)
    assert _codes(spark, good, []) == (["no_options", "no_answer"], "failed", 0.32)
    assert _codes(spark, good, FOUR[:1])[0] == ["too_few_options", "no_answer"]
    assert _codes(spark, good, [*FOUR[:3], ("RED ", False)])[0] == ["option_duplicate"]
    assert _codes(spark, good, [*FOUR[:3], ("(3)", False)])[0] == ["option_label_only"]
    assert _codes(spark, good, [("(1)", True), ("(2)", False), ("(3)", False)])[0] == []
    assert _codes(spark, good, [("x", False), ("", False), ("y", True)])[0] == ["option_empty"]
    assert "option_length_outlier" in _codes(spark, good, [*FOUR[:3], ("word " * 30, False)])[0]
    assert _codes(spark, good, [(t, True) for t, _ in FOUR])[0] == ["multiple_answers"]
    assert _codes(spark, good, [(t, False) for t, _ in FOUR], answer="pink")[0] == ["answer_not_an_option"]
    assert _codes(spark, good, [(t, False) for t, _ in FOUR], answer="C")[0] == []
    assert _codes(spark, good, FOUR, explanation="Option (3) is right")[0] == ["explanation_mismatch"]
    assert _codes(spark, good, FOUR, explanation="Answer: 2")[0] == []
    assert _codes(spark, good, [("1. foo bar 2. baz x", True), *FOUR[2:]])[0] == ["foreign_content"]
    assert _codes(spark, good, [("Yes? Then which one", True), *FOUR[2:]])[0] == ["embedded_question"]
    pointing = [("Only 1 and 3", True), ("1 and 2", False), ("All of the above", False)]
    assert _codes(spark, good, pointing)[0] == ["missing_enumeration"]
    assert _codes(spark, "Consider statement 1 and statement 2 and choose", pointing)[0] == []
    assert _codes(spark, "Choose the word for blank number 5 please", FOUR)[0] == ["missing_reference"]
    assert _codes(spark, "Choose the word for blank number 5 please", FOUR, passage="A passage.")[0] == []


def test_marking_scheme(spark):
    cases = [
        ("Time Allowed: 2 hours 30 minutes\nMaximum Marks: 200\nEach question carries 2 marks\n0.50 marks will be deducted for each wrong answer", 150, 200.0, 2.0, 0.5),
        ("Duration: 60\nTotal marks - 100\n1/4 mark penalty", 60, 100.0, None, 0.25),
        ("There is no negative marking\nTime: 90 mins", 90, None, None, 0.0),
        ("nothing", None, None, None, None),
        (None, None, None, None, None),
    ]
    header = patterns.header_lines(F.col("t"))
    got = spark.createDataFrame([(c[0],) for c in cases], "t string").select(patterns.duration(header), patterns.total_marks(header), patterns.marks_per_question(header), patterns.negative_marks(header)).collect()
    assert [tuple(r) for r in got] == [c[1:] for c in cases]


def test_text(spark):
    r = spark.range(1).select(
        text.slug(F.lit("  Tier-II / Paper_1 (2023).pdf ")), text.title_of_file(F.lit("mock_test-paper.one.pdf")), text.heading(F.lit("## PART A - Reasoning and Logic [25 Questions]")),
        text.content_hash(F.lit("What?"), F.array(F.lit("B!"), F.lit("a"), F.lit(" "))) == text.content_hash(F.lit("what"), F.array(F.lit("A"), F.lit("b"))),
        F.size(F.array_intersect(text.trigrams(F.lit("word")), text.trigrams(F.lit("two words")))), F.size(F.array_union(text.trigrams(F.lit("word")), text.trigrams(F.lit("two words")))),
        text.shortened(F.lit("a  long   text"), 6), text.word_count(F.lit(" a b\tc ")),
    ).first()
    assert tuple(r) == ("tier-ii-paper-1-2023-pdf", "Mock Test Paper One", "reasoning logic", True, 4, 11, "a lon…", 3)


def test_prepared_lines(spark):
    doc = "one\ncompre-\nhen-\nsion ends\n\nPage 4\nfour\n---\nfive\n[page] 9 of 12\nnine\nwell-\nKnown\r\nlast-\n"
    got = lines.prepared(spark.createDataFrame([(1, doc), (2, None)], "doc long, text string"), "doc", "text").orderBy("doc", "line_no").collect()
    assert [(r["line_no"], r["page"], r["line"]) for r in got if r["doc"] == 1] == [
        (0, 1, "one"), (1, 1, "comprehension ends"), (2, 1, ""), (3, 4, "four"), (4, 5, "five"), (5, 9, "nine"), (6, 9, "well-"), (7, 9, "Known"), (8, 9, "last-"), (9, 9, ""),
    ]
    assert [(r["raw_no"], r["line"]) for r in got if r["doc"] == 2] == [(0, "")]


def test_contexts(spark):
    questions = spark.createDataFrame([(1, n) for n in range(88, 120)], "doc long, number int")
    ranges = [(1, 0, 90, 92, True, "printed"), (1, 1, 91, 95, True, "later"), (1, 2, 100, None, False, "open"), (1, 3, 118, None, True, "to the end")]
    contexts = spark.createDataFrame(ranges, "doc long, ordinal int, first int, last int, explicit boolean, context string")
    got = {r["number"]: (r["context"], r["capped"]) for r in lines.with_contexts(questions, contexts, "doc", "number").collect()}
    assert [got[n][0] for n in (89, 90, 92, 93, 95, 96)] == [None, "printed", "printed", "later", "later", None]
    assert got[100] == ("open", True) and got[111] == ("open", True) and got[112] == (None, False) and got[119] == ("to the end", False)


def test_question_styles(spark):
    docs = [(1, QUIZ), (2, NUMBERED), (3, ROWS_OF_TWO), (4, "prose"), (5, None), (7, "\n".join(f"{n}) item\n1) a\n2) b\n3) c\n4) d" for n in range(51, 54))), (8, "88. first\n(a) x\n(b) y\n89. next\n(a) x\n(b) y")]
    df = spark.createDataFrame(docs, "doc long, text string")
    got = {r["doc"]: (r["lead"], r["question_wrap"], r["first_number"]) for r in conventions.question_styles(df, conventions.option_styles(df, "doc", "text"), "doc", "text").collect()}
    assert got[1] == ("", "dot", 1) and got[2] == ("Q", "dot", 1) and got[3] == ("", "dot", 1)
    assert got[7] == ("", "trail", 51), "numbers within a question fill its options"
    assert got[8] == ("", "dot", 88) and 4 not in got and 5 not in got


def parse(spark, *docs):
    out = {}
    for r in parsing.questions(spark.createDataFrame(list(enumerate(docs)), "doc long, text string"), "doc", "text").orderBy("doc", "seq").collect():
        out.setdefault(r["doc"], {})[r["number"]] = r
    return out


def test_parsed_questions(spark):
    keyed = QUIZ + "\n\nAnswer Key\n1. (a) 2. (c) 3. (b) 4. (d)"
    inline = "Q1. First of all? (a) one (b) two (c) three (d) four\nAns. (c)\nSol. Because three.\nQ2. Second\n(a) x (b) y\n(c) z (d) w\nAns. b"
    shared = "Directions (1-2): Read this.\nThe passage text.\n1. One?\n(a) p\n(b) q\n2. Two?\n(a) p\n(b) q\n3. Three?\n(a) p\n(b) q"
    furniture = "1. One of which?\n(a) aa\n(b) bb\n(c) cc\n(d) dd\n\nRunning header 2019\n2. Two of which?\n(a) aa\n(b) bb\n(c) cc\n(d) dd"
    statements = "1. Which are right?\n(a) first (b) second (c) third (d) fourth\n(a) only a (b) only b (c) both (d) none\n2. Next one?\n(a) k (b) l (c) m (d) n"
    got = parse(spark, keyed, NUMBERED, inline, shared, furniture, statements, "no questions here", None, "\n".join(f"{n}. item\n(a) x\n(b) y" for n in (88, 89, 90, 93)))
    assert [(q["stem"], q["options"], q["answer"]) for q in got[0].values()] == [(f"Which of these is item {n}?", [f"red {n}", "green", "blue", "black"], a) for n, a in zip(range(1, 5), (0, 2, 1, 3), strict=True)]
    assert [(q["stem"], q["options"]) for q in got[1].values()] == [("Pick one", [f"a{n}", "b", "c", "d"]) for n in range(1, 4)]
    assert (got[2][1]["options"], got[2][1]["answer"], got[2][1]["explanation"]) == (["one", "two", "three", "four"], 2, "Because three.")
    assert (got[2][2]["options"], got[2][2]["answer"]) == (["x", "y", "z", "w"], 1)
    assert [got[3][n]["context"] for n in (1, 2, 3)] == ["Directions (1-2): Read this. The passage text."] * 2 + [None]
    assert got[4][1]["trailing"] == "Running header 2019" and got[4][1]["options"][3] == "dd" and not got[4][2]["trailing"]
    assert got[5][1]["options"] == ["only a", "only b", "both", "none"] and got[5][1]["issues"] == ["options_replaced"] and got[5][2]["issues"] == []
    assert 6 not in got and 7 not in got and list(got[8]) == [88, 89, 90, 93]


def test_open_contexts_and_sections(spark):
    body = lambda a, b: "\n".join(f"{n}. item {n}?\n(a) x\n(b) y" for n in range(a, b + 1))
    got = parse(spark, f"Directions: choose well.\n{body(1, 30)}", f"Part A - Verbal\n{body(1, 2)}\nIn the following questions pick one.\n{body(3, 4)}")
    held = [n for n, q in got[0].items() if q["context"]]
    assert held == list(range(1, 13)) and all("context_capped" in got[0][n]["issues"] for n in held)
    assert got[1][1]["section"] == "Part A - Verbal"
    assert got[1][3]["context"] == "In the following questions pick one." and got[1][2]["context"] is None


LETTERED = ["A train leaves at noon. When does it arrive?", "Which is next?", "Which is odd?", "B is the brother of C. Who is older?", "Which comes last?", "Which is least?"]


def lettered(*behind):
    body = "\n\n".join(f"{n}. {s}\n(a) one\n(b) two\n(c) three\n(d) four" for n, s in enumerate(LETTERED, 1))
    return "\n\n".join([body, *behind])


def test_keys_are_read_where_their_region_is(spark):
    bare = "## Answer Key\n\n1. C\n2. C\n3. A\n4. D\n5. B\n6. B"
    solved = "## Solutions\n\n1. Since 3 is odd, (c) is correct.\n2. Half of 48 = 24.\n1. 5 times nothing\nHence option (b).\n90. a far number\n5. Correct answer: (d)"
    got = parse(
        spark, lettered(bare), lettered(), lettered(solved), lettered(bare, solved), "Answers: 1. (b) 2. (a) 3. (d)\n\n" + lettered(), "1. Q\n(a) x (b) y\nAns. (a)\n2. R\n(a) x (b) y\nAns. (a)\n3. S\n(a) x (b) y\n\nAnswer Key\n1. (b) 2. (z) 3. (b) 4. (a)"
    )
    answers = lambda i: [got[i][n]["answer"] for n in sorted(got[i])]
    assert answers(0) == [2, 2, 0, 3, 1, 1]
    assert answers(1) == [None] * 6, "two stems that begin with a letter are no key"
    assert answers(2) == [2, 1, None, None, 3, None], "a number opens a solution only if it rises, by at most 60"
    assert got[2][2]["explanation"] == "Half of 48 = 24. 1. 5 times nothing Hence option (b). 90. a far number" and not got[2][3]["explanation"]
    assert answers(3) == [2, 2, 0, 3, 1, 1] and got[3][5]["explanation"] == "Correct answer: (d)"
    assert answers(4)[:4] == [1, 0, 3, 1], "a key in front counts once it covers half of the questions"
    assert answers(5) == [1, 0, 1], "a key overrides what stands with the question, if it names one of its options"


def test_key_documents(spark):
    docs = [(1, "1. (a)\n2. (c)\n3-d"), (2, "Solutions\n1. Option (b) is correct as shown.\nMore of it.\n3. No verdict"), (3, None), (4, "nothing here")]
    got = {(r["doc"], r["number"]): (r["option"], r["explanation"]) for r in answer_keys.key_documents(spark.createDataFrame(docs, "doc long, text string"), "doc", "text").collect()}
    assert {k: v[0] for k, v in got.items() if k[0] == 1} == {(1, 1): 0, (1, 2): 2, (1, 3): 3}
    assert got[2, 1] == (1, "Option (b) is correct as shown. More of it.") and got[2, 3] == (None, "No verdict") and not any(k[0] > 2 for k in got)
