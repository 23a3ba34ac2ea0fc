"""Replies of a language model as data: the object in a reply, its findings as issues, and the text that a reviewer is asked about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from examlake.functions.text import collapse, grounded, shortened, tokens

# Codes that a reply may use, those that are critical whatever it says, and fields it may name.
CODES = (
    "not_answerable", "ambiguous", "multiple_plausible_answers", "answer_looks_wrong", "explanation_contradicts_answer", "semantic_contamination", "incomplete_content",
    "options_not_parallel", "subject_mismatch", "passage_does_not_support", "language_broken",
)
CRITICAL = ("not_answerable", "answer_looks_wrong", "explanation_contradicts_answer", "semantic_contamination", "multiple_plausible_answers", "incomplete_content")
FIELDS = ("stem", "answer", "explanation", "passage", "subject", "")
UNGROUNDED = "model_reply_ungrounded"
REPLY = "answerable boolean, defects array<struct<code:string,severity:string,field:string,message:string,evidence:string>>, clarity int, subject_fits boolean, notes string"
ISSUE = "array<struct<code:string,severity:string,field:string,evidence:string>>"
MESSAGE, EVIDENCE = 300, 200
#: Characters of a prompt, the share of them left to the questions, and what a question is given at least.
LIMIT, LEAST_STEM, OPTION_TEXT, ROOM_FOR_OPTIONS = 24000, 120, 60, 200

#: A string literal, which may run to the end unclosed, a brace, or anything between.
_TOKEN = r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"?|[{}]|[^"{}]+'


def json_object(reply: Column) -> Column:
    """The first balanced object in a reply, or null: bare, behind prose or in a fenced block; braces within strings do not count.

    The text is cut into strings, braces and the rest; a fold over these holds
    the depth and where it first comes back to nothing.
    """
    whole = F.regexp_replace(F.coalesce(reply, F.lit("")), r"^\s+|\s+\z", "")
    fenced = F.regexp_extract(whole, r"(?s)```(.*)", 1)
    inner = F.when(F.contains(fenced, F.lit("\n")), F.regexp_extract(fenced, r"(?s)\n(.*)", 1)).otherwise(fenced)
    body = F.when(F.contains(whole, F.lit("```")), F.regexp_extract(inner, r"(?s)^(.*?)(?:```|\z)", 1)).otherwise(whole)
    found = F.regexp_extract_all(F.regexp_extract(body, r"(?s)\{.*", 0), F.lit(_TOKEN), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("read"), F.lit(0).alias("end"))

    def step(a: Column, t: Column) -> Column:
        depth = a["depth"] + F.when(t == "{", 1).when(t == "}", -1).otherwise(0)
        closed = (a["end"] == 0) & (t == "}") & (depth == 0)
        return F.struct(depth.alias("depth"), (a["read"] + 1).alias("read"), F.when(closed, a["read"] + 1).otherwise(a["end"]).alias("end"))

    end = F.aggregate(found, start, step, lambda a: a["end"])
    return F.when((F.startswith(whole, F.lit("{"))) & F.endswith(whole, F.lit("}")), whole).when(end > 0, F.array_join(F.slice(found, F.lit(1), end), ""))


def _severity(said: Column, code: Column) -> Column:
    """The reply's severity, major if it names none; codes that make a question wrong are critical."""
    said = F.lower(F.trim(said))
    return F.when(code.isin(*CRITICAL), "critical").when(said.isin("critical", "minor"), said).otherwise("major")


def _field(said: Column, options: Column) -> Column:
    """A field that the question has: a known name or one of its options; else none."""
    said = F.lower(F.trim(F.coalesce(said, F.lit(""))))
    number = F.nullif(F.regexp_extract(said, r"^option:(\d+)", 1), F.lit("")).try_cast("int")
    return F.when(said.isin(*FIELDS) | number.between(1, options), said).otherwise("")


def reply_issues(replies: DataFrame, reply: str, source: str, options: str, subject: str) -> DataFrame:
    """``replies`` with ``clarity``, ``grounded`` and ``issues``: what a reply may report about its question.

    ``source`` is all text that the reply was shown and ``options`` the number of
    the question's options.  If a quoted fragment does not stand in the source,
    all findings give way to one that asks for a person.  Unknown codes are left
    out; a question called unanswerable, or out of its subject, is an issue even
    without a finding.  A reply without a readable object gives nulls.
    """
    met = replies.withColumn("said", F.from_json(json_object(F.col(reply)), REPLY, {"mode": "PERMISSIVE"}))
    readable = F.col("said").isNotNull() & (F.col("said.defects").isNotNull() | F.col("said.answerable").isNotNull() | F.col("said.clarity").isNotNull())
    met = met.withColumn("shown", tokens(F.coalesce(F.col(source), F.lit("")))).withColumn("defects", F.coalesce("said.defects", F.array().cast("array<struct<code:string,severity:string,field:string,message:string,evidence:string>>")))
    quotes = F.filter(F.transform("defects", lambda d: F.coalesce(d["evidence"], F.lit(""))), lambda q: F.trim(q) != "")
    stray = F.filter(quotes, lambda q: ~grounded(F.col("shown"), tokens(q)))
    met = met.withColumn("stray", stray)
    code = lambda d: F.lower(F.trim(F.coalesce(d["code"], F.lit(""))))
    issue = lambda c, s, f, e: F.struct(c.alias("code"), s.alias("severity"), f.alias("field"), e.alias("evidence"))
    known = F.transform(F.filter("defects", lambda d: code(d).isin(*CODES)), lambda d: issue(code(d), _severity(d["severity"], code(d)), _field(d["field"], F.col(options)), shortened(F.coalesce(d["evidence"], F.lit("")), EVIDENCE)))
    lacks = lambda c: ~F.exists("defects", lambda d: code(d) == c)
    none = F.array().cast(ISSUE)
    unanswerable = F.when(~F.coalesce("said.answerable", F.lit(False)) & lacks("not_answerable"), F.array(issue(F.lit("not_answerable"), F.lit("critical"), F.lit(""), F.lit("")))).otherwise(none)
    elsewhere = F.when(~F.coalesce("said.subject_fits", F.lit(False)) & (F.coalesce(F.col(subject), F.lit("")) != "") & lacks("subject_mismatch"), F.array(issue(F.lit("subject_mismatch"), F.lit("major"), F.lit("subject"), F.lit("")))).otherwise(none)
    refused = F.array(issue(F.lit(UNGROUNDED), F.lit("major"), F.lit(""), shortened(F.array_join("stray", " | "), EVIDENCE)))
    issues = F.when(F.size("stray") > 0, refused).otherwise(F.concat(known, unanswerable, elsewhere))
    return met.select(*replies.columns, F.col("said.clarity").alias("clarity"), F.when(readable, F.size("stray") == 0).alias("grounded"), F.when(readable, issues).alias("issues"))


def paper_prompts(items: DataFrame, paper: str, limit: int = LIMIT) -> DataFrame:
    """``paper, prompt, questions`` from items (paper, number, section, subject, difficulty, has_passage, answer, stem, options).

    Three quarters of ``limit`` are shared evenly: each question gets its stem
    within two thirds of its share, and its options only where the share allows,
    so a long paper is shown in less detail and never cut off behind some number.
    """
    sizes = items.groupBy(paper).agg(F.count("*").alias("questions"))
    share = F.floor(F.lit(limit * 3 // 4) / F.col("questions")).cast("int")
    met = items.join(sizes, paper).withColumn("share", share)
    room = F.greatest(F.lit(LEAST_STEM), F.floor(F.col("share") * 2 / 3).cast("int"))
    stem = collapse(F.col("stem"))
    stem = F.when(F.char_length(stem) > room, F.concat(stem.substr(F.lit(1), room - 1), F.lit("…"))).otherwise(stem)
    head = F.format_string("%d. [%s / %s / %s]%s answer=%s\n", "number", "section", "subject", "difficulty", F.when(F.col("has_passage"), " [has passage]").otherwise(""), F.coalesce("answer", F.lit("")))
    options = F.when((F.size("options") > 0) & (F.col("share") > ROOM_FOR_OPTIONS), F.concat(F.lit("   options: "), F.array_join(F.transform("options", lambda o: shortened(o, OPTION_TEXT)), " | "), F.lit("\n"))).otherwise("")
    shown = met.select(paper, "questions", F.struct("number", F.concat(head, F.lit("   "), stem, F.lit("\n"), options).alias("text")).alias("x"))
    return shown.groupBy(paper, "questions").agg(F.array_join(F.sort_array(F.collect_list("x"))["text"], "").alias("body")).select(paper, F.concat(F.lit("Questions: "), F.col("questions").cast("string"), F.lit("\n\n"), "body").alias("prompt"), "questions")
