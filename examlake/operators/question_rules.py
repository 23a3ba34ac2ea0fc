"""Question-level rules over nested options: every rule is an array of issues, so a question is judged in one projection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from examlake.functions import rules
from examlake.functions.text import collapse, compact, word_count

ISSUE = "array<struct<code:string,severity:string,field:string>>"
#: Severities from worst, and what an issue of each takes off a question's and a paper's score.
SEVERITIES = ("critical", "major", "minor")
QUESTION_COST, PAPER_COST = {"critical": 0.34, "major": 0.12, "minor": 0.03}, {"critical": 0.2, "major": 0.06, "minor": 0.015}

# Patterns of the stem, option and explanation rules.
CUT_OFF = r"(?i)\b(?:and|or|but|the|a|an|of|in|to|for|with|that|which|is|are|was|were|from|by|as|at|on)$"
ASKS = (
    r"(?i)\?|\b(?:select|choose|find|identify|which|what|who|whom|whose|when|where|why|how|arrange|rearrange|match|complete|fill|read|consider|calculate|evaluate|simplify|solve|"
    r"convert|change|spot|pick|state|name|give|compute|determine|examine|compare|correct|incorrect|true|false|appropriate|suitable|meaning|synonym|antonym|value of|following|directions?)\b|_{3,}|:\s*\z"
)
VERDICT = r"(?i)\b(?:option|ans(?:wer)?|choice)\b[^0-9a-h]{0,12}\(?([1-9]|[a-h])\)?\b"
POINTS_AT = (
    r"(?i)^(?:only\s+)?(?:\d(?:\s*[,&]\s*|\s+and\s+|\s*[-–]\s*)\d(?:(?:\s*[,&]\s*|\s+and\s+|\s*[-–]\s*)\d)*|[a-e](?:\s*[-–,]\s*[a-e]){1,4}|"
    r"(?:all|none|neither|both)\s+(?:of\s+)?(?:the\s+)?(?:above|these|them|statements?))(?:\s+(?:are|is)\s+correct)?\.?\z"
)
LISTS = r"(?i)statements?\s+(?:1|i|a)\b|\b(?:1|i|a)[.)]\s+\S+.*\b(?:2|ii|b)[.)]\s+\S+"
OUTSIDE = r"(?i)\b(?:blank|sentence|statement|part|paragraph|line|item|word)\s+(?:number\s+|no\.?\s*)?\d{1,2}\b"


def issue(code: str, severity: str, field: Column | str) -> Column:
    return F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), (F.lit(field) if isinstance(field, str) else field).alias("field"))


def when(condition: Column, code: str, severity: str, field: Column | str = "") -> Column:
    """An array of one issue where the condition holds."""
    return F.when(F.coalesce(condition, F.lit(False)), F.array(issue(code, severity, field))).otherwise(F.array().cast(ISSUE))


def at(index: Column) -> Column:
    """The field name of the option at a 0-based place."""
    return F.concat(F.lit("option:"), (index + 1).cast("string"))


def _texts(options: Column) -> Column:
    return F.transform(options, lambda o: F.trim(F.coalesce(o["text"], F.lit(""))))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, also where a lambda of ``body`` uses it for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def filled(options: Column) -> Column:
    """How many options have a text."""
    return F.size(F.filter(_texts(options), lambda t: t != ""))


def correct(options: Column) -> Column:
    """0-based places of the options marked correct that have a text."""
    marked = F.transform(options, lambda o, i: F.when(o["is_correct"] & (F.trim(F.coalesce(o["text"], F.lit(""))) != ""), i))
    return F.filter(marked, lambda i: i.isNotNull())


def label_only(text: Column) -> Column:
    """Whether an option is a mark in brackets or dots and nothing else."""
    bare = F.regexp_replace(text, r"^[().\[\]{} \t]+|[().\[\]{} \t]+$", "")
    return (bare == "") | (bare.rlike(r"^[0-9a-zA-Z]{1,2}\z") & (F.char_length(text) != F.char_length(bare)))


def per_option(options: Column, rule: Callable[[Column, Column], Column]) -> Column:
    """The issues of a rule of (text, place) over all options with a text."""
    found = F.transform(_texts(options), lambda t, i: F.when(t != "", rule(t, i)))
    return F.flatten(F.filter(found, lambda x: x.isNotNull()))


def stem_issues(stem: Column, least: int = 12) -> Column:
    """Empty, too short, cut off, asks nothing."""
    s = F.trim(F.coalesce(stem, F.lit("")))
    size = F.char_length(s)
    on_purpose = s.rlike(r"(?::|\?|…|\.\.\.|_|-|,|=)\z")
    whole = size >= least
    return F.concat(
        when(s == "", "stem_empty", "critical", "stem"),
        when((s != "") & ~whole, "stem_too_short", "critical", "stem"),
        when(whole & ~on_purpose & F.regexp_replace(s, r"[ .;]+$", "").rlike(CUT_OFF), "stem_truncated", "major", "stem"),
        when(whole & ~s.rlike(ASKS), "stem_not_a_question", "major", "stem"),
    )


def option_issues(options: Column, expected: Column | None = None, least: int = 2) -> Column:
    """Too few, empty, label-only, repeated and far too long options of an objective question."""
    return let(_texts(options), lambda texts: let(F.transform(texts, lambda t: F.lower(collapse(t))), lambda keys: _text_issues(texts, keys, expected, least)))


def _text_issues(texts: Column, keys: Column, expected: Column | None, least: int) -> Column:
    """The issues of options from their trimmed texts and their comparable forms."""
    n = F.size(F.filter(texts, lambda t: t != ""))
    each = lambda rule: F.flatten(F.filter(F.transform(texts, lambda t, i: F.when(t != "", rule(t, i))), lambda x: x.isNotNull()))
    labels = F.size(F.filter(texts, lambda t: (t != "") & label_only(t)))
    lengths = F.array_sort(F.filter(F.transform(texts, F.char_length), lambda x: x > 0))
    median = F.greatest(F.coalesce(F.get(lengths, F.floor(F.size(lengths) / 2).cast("int")), F.lit(0)), F.lit(8))
    far = let(median, lambda m: F.filter(F.transform(texts, lambda t, i: F.when((F.char_length(t) > 4 * m) & (F.char_length(t) - m > 60), i)), lambda i: i.isNotNull()))
    out = [
        when(n == 0, "no_options", "critical", "options"),
        when((n > 0) & (n < least), "too_few_options", "critical", "options"),
        let(n, lambda n: F.flatten(F.transform(texts, lambda t, i: when((t == "") & (i < n), "option_empty", "critical", at(i))))),
        F.when((n >= 2) & (labels == n), F.array().cast(ISSUE)).otherwise(each(lambda t, i: when(label_only(t), "option_label_only", "critical", at(i)))),
        each(lambda t, i: when(F.array_position(keys, F.get(keys, i)) <= i, "option_duplicate", "critical", at(i))),
        when((F.size(lengths) >= 3) & (F.size(far) > 0), "option_length_outlier", "major", F.coalesce(at(F.get(far, F.lit(0))), F.lit(""))),
    ]
    if expected is not None:
        out.insert(2, when((n >= least) & (expected > 0) & (n != expected), "option_count_mismatch", "major", "options"))
    return F.concat(*out)


def claimed(explanation: Column, options: Column) -> Column:
    """The 0-based option that an explanation names, or null."""
    token = F.lower(F.regexp_extract(explanation, VERDICT, 1))
    place = F.when(token.rlike("^[1-9]$"), F.ascii(token) - 49).when(token != "", F.ascii(token) - 97)
    return F.when(place < F.size(options), place)


def names_an_option(answer: Column, options: Column) -> Column:
    """Whether an answer repeats an option's text or gives its place."""
    want = compact(answer)
    place = F.when(want.rlike("^[1-9]$"), F.ascii(want) - 49).when(want.rlike("^[a-h]$"), F.ascii(want) - 97)
    return (want == "") | F.exists(options, lambda o: compact(F.coalesce(o["text"], F.lit(""))) == want) | F.coalesce(place < F.size(options), F.lit(False))


def answer_issues(options: Column, answer: Column, explanation: Column, multiple: Column | None = None) -> Column:
    """No, several or foreign answers, and an explanation that argues for another option."""
    right, text = F.size(correct(options)), F.trim(F.coalesce(answer, F.lit("")))
    said = claimed(F.coalesce(explanation, F.lit("")), options)
    return F.concat(
        when((right == 0) & (text == ""), "no_answer", "critical", "answer"),
        when((right > 1) & ~(multiple if multiple is not None else F.lit(False)), "multiple_answers", "critical", "answer"),
        when((text != "") & (filled(options) > 0) & (right == 0) & ~names_an_option(text, options), "answer_not_an_option", "critical", "answer"),
        when((right == 1) & (said != F.get(correct(options), F.lit(0))), "explanation_mismatch", "critical", "explanation"),
    )


def corruption_issues(text: Column, field: Column | str, severity: str) -> Column:
    """The corruption rules of one field at the field's severity."""
    name = F.lit(field) if isinstance(field, str) else field
    return F.transform(rules.inspected(text), lambda c: F.struct(c.alias("code"), F.lit(severity).alias("severity"), name.alias("field")))


def option_text_issues(options: Column) -> Column:
    """Corruption, absorbed neighbours and absorbed questions in options."""
    return F.concat(
        per_option(options, lambda t, i: corruption_issues(t, at(i), "critical")),
        per_option(options, lambda t, i: when(rules.foreign_content(t).isNotNull(), "foreign_content", "critical", at(i))),
        per_option(options, lambda t, i: when(rules.second_question(t).isNotNull(), "embedded_question", "critical", at(i))),
    )


def reference_issues(stem: Column, options: Column, passage: Column) -> Column:
    """Options that point into a list, or a stem into material, that is not there."""
    s, p, texts = F.coalesce(stem, F.lit("")), F.trim(F.coalesce(passage, F.lit(""))), F.filter(_texts(options), lambda t: t != "")
    points = F.size(F.filter(texts, lambda t: t.rlike(POINTS_AT)))
    return F.concat(
        when((F.size(texts) >= 3) & (2 * points > F.size(texts)) & ~s.rlike(LISTS) & (p == ""), "missing_enumeration", "critical", "stem"),
        when((p == "") & s.rlike(OUTSIDE) & ~F.contains(s, F.lit("___")) & ~s.rlike(LISTS), "missing_reference", "critical", "stem"),
    )


#: What a parser's own findings weigh; all others are major.
LIFTED = {"unreadable_source": "critical", "no_options": "critical", "context_capped": "minor"}


def lifted(found: Column) -> Column:
    """The parser's codes as issues of the whole question."""
    weight = lambda c: F.coalesce(*(F.when(c == k, F.lit(v)) for k, v in LIFTED.items()), F.lit("major"))
    return F.transform(found, lambda c: F.struct(c.alias("code"), weight(c).alias("severity"), F.lit("").alias("field")))


def validated(q: DataFrame, expected: int = 0, least_confidence: float = 0.7, unsorted: str = "unsorted", model_expected: bool = False) -> DataFrame:
    """Add ``issues``, those of all question rules, deduplicated.

    Columns read: ``type, stem, options, answer, explanation, passage, trailing,
    subject, confidence, parser_issues, model_reviewed``; any may be null.
    Without a type a question is objective; 0 options expected means any number.
    """
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    options = F.coalesce("options", F.array().cast(q.schema["options"].dataType))
    objective = ~F.coalesce(F.col("type"), F.lit("")).isin("descriptive", "numeric")
    structure = lambda x: x["code"].isin("no_options", "too_few_options", "option_count_mismatch")
    choices = F.filter(option_issues(options, F.lit(expected)), lambda x: objective | ~structure(x))
    read = F.col("type") == "comprehension"
    found = F.concat(
        stem_issues(F.col("stem")),
        choices,
        answer_issues(options, F.col("answer"), F.col("explanation"), ~objective | F.coalesce(F.col("type") == "multi_select", F.lit(False))),
        corruption_issues(text("stem"), "stem", "critical"),
        corruption_issues(text("explanation"), "explanation", "major"),
        corruption_issues(text("passage"), "passage", "critical"),
        option_text_issues(options),
        when(text("trailing") != "", "trailing_text", "major"),
        reference_issues(F.col("stem"), options, F.col("passage")),
        when(F.lower("subject") == unsorted, "unclassified_subject", "major", "subject"),
        when((F.col("confidence") > 0) & (F.col("confidence") < least_confidence), "low_extraction_confidence", "major"),
        F.coalesce(lifted(F.col("parser_issues")), F.array().cast(ISSUE)),
        when(read & (text("passage") == ""), "passage_missing", "critical", "passage"),
        when(read & (text("passage") != "") & (word_count(text("passage")) < 30), "passage_too_short", "major", "passage"),
        when(F.lit(model_expected) & ~F.coalesce(F.col("model_reviewed"), F.lit(False)), "model_review_not_run", "minor"),
    )
    return q.withColumn("found", found).withColumn("issues", deduped(F.col("found"))).drop("found")


def deduped(issues: Column) -> Column:
    """One issue for each code and field, the worst, at the place of the first."""
    rank = lambda x: F.array_position(F.array(*map(F.lit, SEVERITIES)), x["severity"])
    same = lambda x, y: (x["code"] == y["code"]) & (x["field"] == y["field"])
    first = F.filter(issues, lambda x, i: ~F.exists(F.slice(issues, F.lit(1), i), lambda y: same(x, y)))
    return F.transform(first, lambda x: F.array_min(F.transform(F.filter(issues, lambda y: same(x, y)), lambda y: F.struct(rank(y).alias("r"), y.alias("x"))))["x"])


def verdict(issues: Column) -> Column:
    """Failed with a critical issue, review with a major one, else pass."""
    has = lambda s: F.exists(issues, lambda x: x["severity"] == s)
    return F.when(has("critical"), "failed").when(has("major"), "review").otherwise("pass")


def clamped(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def score(issues: Column, confidence: Column) -> Column:
    """A rank for the review queue that never decides the verdict; confidence 0 means unknown."""
    start = F.when(confidence > 0, 0.8 + 0.2 * clamped(confidence)).otherwise(F.lit(1.0))
    cost = lambda x: F.coalesce(*(F.when(x["severity"] == s, F.lit(c)) for s, c in QUESTION_COST.items()), F.lit(0.0))
    return clamped(F.aggregate(issues, start, lambda a, x: a - cost(x)))
