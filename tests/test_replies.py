"""Objects in replies, and the text that a reviewer is shown."""

from pyspark.sql import functions as F

from examlake.operators import replies


def test_objects_in_replies(spark):
    good = {
        '{"ok":true}': '{"ok":true}', '```json\n{"ok":true}\n```': '{"ok":true}', '```\n{"ok":true}\n```': '{"ok":true}', 'Here is the result: {"ok":true}': '{"ok":true}',
        '{"a":{"b":1},"c":2}': '{"a":{"b":1},"c":2}', 'x {"msg":"a } brace","ok":true} y {"b":1}': '{"msg":"a } brace","ok":true}', 'x {"q":"\\"}","n":{}} tail': '{"q":"\\"}","n":{}}',
        "so {" + '"long": "' + "z" * 200_000 + '"} end': '{"long": "' + "z" * 200_000 + '"}',
    }
    rows = [*good.items(), *((b, None) for b in ("", "no json here", '{"unterminated": ', 'a {"open string: }', None))]
    got = spark.createDataFrame(rows, "reply string, want string").select("want", replies.json_object(F.col("reply")).alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def test_replies_that_say_nothing_usable(spark):
    rows = [(1, '{"answerable": true, "defects": [], "clarity": 9, "subject_fits": true}', "x"), (2, "{}", "x"), (3, None, "x"), (4, '{"defects": null, "answerable": false}', ""), (5, '{"answerable": true, "subject_fits": true, "defects": [{"code": "ambiguous", "evidence": "not in there at all"}]}', "some words")]
    found = replies.reply_issues(spark.createDataFrame(rows, "i int, reply string, shown string").withColumns({"options": F.lit(4), "subject": F.col("shown")}), "reply", "shown", "options", "subject")
    got = {r["i"]: (r["grounded"], None if r["issues"] is None else [(x["code"], x["severity"]) for x in r["issues"]]) for r in found.collect()}
    assert got == {1: (True, []), 2: (None, None), 3: (None, None), 4: (True, [("not_answerable", "critical")]), 5: (False, [("model_reply_ungrounded", "major")])}


def test_prompts_stay_within_their_budget(spark):
    item = lambda p, n, size: (p, n, "s", "t", "hard", False, None, "word " * size, ["an option " * 30] * 4)
    rows = [item(1, n, 900) for n in range(1, 61)] + [item(2, 1, 3)]
    found = {r["paper"]: r for r in replies.paper_prompts(spark.createDataFrame(rows, "paper int, number int, section string, subject string, difficulty string, has_passage boolean, answer string, stem string, options array<string>"), "paper").collect()}
    assert max(len(x) for x in found[1]["prompt"].split("\n") if x.startswith("   word")) == 3 + replies.LIMIT * 3 // 4 // 60 * 2 // 3 and all(f"\n{n}. [s / t / hard] answer=\n" in "\n" + found[1]["prompt"] for n in range(1, 61)), "every question is shown"
    assert found[2]["questions"] == 1 and "options: an option" in found[2]["prompt"]
