"""Quality rules and line deduplication against plain Python, and plans without Python."""

import collections
import re

from examlake.llm import line_dedup, quality_rules

TEXTS = [
    None, "", " ", "\n\n", "one", "a b c", "a b c a b c a b c", "a a a a a", "x\ny\nx\n\nx\n \ny", "# * $ % & | < > ok", "é日本 ñ \U0001f600 b c", "the of and to " * 30,
    "tab\tand\x0bvt\x0cff\rcr", "w" * 5000, "p q r s " * 2000, "the cat sat on the mat " * 3 + "\nthe cat sat on the mat", "a​b c d",
]


def counts(text):
    t = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = collections.Counter(zip(ws, ws[1:], ws[2:], strict=False))
    covered = {p for i in range(len(ws) - 2) if grams[tuple(ws[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_counts(spark, sf):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(100 + r["doc_id"], r["text"], "y") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    df = quality_rules.assess(spark.createDataFrame(rows, "doc_id long, text string, n_words string"))
    got = {r["doc_id"]: r for r in df.collect()}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        r, want = got[i], counts(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, repr(t)[:60]
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r["kept"] == (not r["failed"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert quality_rules.assess(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_rule_is_a_row_of_the_table(spark):
    df = spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")
    rules = (quality_rules.Rule("short", "n_words", low=5), quality_rules.Rule("long", "n_words", high=4), quality_rules.Rule("stops", "stop_ratio", low=0.5))
    assert quality_rules.assess(df, base=(), rules=rules).first()["failed"] == ["short", "stops"]


def test_lines(spark):
    menu, foot = "Home | About", "All rights reserved"
    rows = [(i, f"{menu}\nbody {i}\n\n{foot if i % 2 else 'bye'}\n", "big", i, "q") for i in range(20)]
    rows += [(100, f"{menu}\n{foot}", "big", 0, "q"), (101, None, "big", 0, "q"), (102, "", None, 0, "q"), (103, menu, "small", 0, "q"), (104, "same\nsame", None, 0, "q")]
    rows += [(200 + i, f"copied line\n{i % 2}", "copies", 0, "q") for i in range(30)] + [(5, f"{menu}\nbody 5\n\n{foot}\n", "big", 5, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_dropped long, page string")
    out = line_dedup.dedup_lines(df, ratio=0.3, least_pages=3)
    assert out.columns == ["doc_id", "text", "source", "page", "n_lines", "n_dropped"]
    assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().executedPlan().toString())
    got = collections.defaultdict(set)
    for r in out.collect():
        got[r["doc_id"]].add((r["text"], r["n_lines"], r["n_dropped"]))
    assert got[5] == {("body 5\n\n", 3, 2)} and got[4] == {("body 4\n\n", 3, 2)}
    assert got[100] == {("", 2, 2)} and got[101] == {(None, 0, 0)} and got[102] == {("", 0, 0)} and got[103] == {(menu, 1, 0)}
    assert got[104] == {("same\nsame", 2, 0)}
    assert got[200] == {("copied line\n0", 2, 0)}, "copies of a page count once"
    assert out.count() == len(rows)
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0
