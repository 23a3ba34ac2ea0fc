"""Quality rules: a threshold table compiled into one Spark projection.

Measures are Column expressions of the text alone; a rule bounds one of them.
``compiled`` turns a table of rules into the verdict and the list of rules that
failed, so changing a threshold never touches code.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPACE = r"[\x20\x09-\x0D]+"
_SPACES = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that for it was on are with as be this have from at by or not but an a "
    "der die das und ist nicht von mit ein eine den dem des auf für sich auch im zu aus bei "
    "le la les des et est une un dans que pour qui sur pas par en du au avec ce "
    "el los las de y que un una por con para del se al lo su como es no"
).split()


@dataclass(frozen=True)
class Rule:
    """``low`` <= measure <= ``high``; a missing bound does not bind, and neither does a measure that is null."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: The base rules and, after them, the method's own.
BASE = (Rule("words", "n_words", low=50), Rule("repeated_words", "repeat_percent", high=50))
RULES = (
    Rule("longest_text", "n_words", high=1_000_000),
    Rule("word_length", "mean_word", low=2, high=20),
    Rule("symbols", "symbol_ratio", high=0.05),
    Rule("stop_words", "stop_ratio", low=0.02),
    Rule("repeated_lines", "dup_line_ratio", high=0.5),
)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _long(value: Column | int) -> Column:
    return (F.lit(value) if isinstance(value, int) else value).cast("long")


def measures(text: str = "text") -> Column:
    """A struct of the base counts and the ratios that rules bound; null reads as an empty text."""
    t = F.coalesce(F.col(text), F.lit(""))

    def repeated(words: Column) -> Column:
        # Hashes of 3-word windows in order, those with an equal neighbour, and the words that their windows cover.
        windows = F.slice(F.transform(words, lambda w, i: F.struct(F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i"))), 1, F.greatest(F.size(words) - 2, F.lit(0)))
        same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
        twice = _let(F.sort_array(windows), lambda s: F.filter(s, lambda x, k: same(x, F.get(s, k - 1)) | same(x, F.get(s, k + 1))))
        starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
        covered = lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)
        return _long(_let(starts, covered))

    def lines_of(s: Column) -> Column:
        return F.filter(F.split(s, "\n", -1), lambda line: F.translate(line, _SPACES, "") != "")

    stop = [*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)]
    counts = lambda words, lines: F.struct(
        _long(F.size(words)).alias("n_words"),
        _long(F.char_length(F.translate(t, _SPACES, ""))).alias("word_chars"),
        _long(F.char_length(t) - F.char_length(F.translate(t, _SYMBOLS, ""))).alias("n_symbols"),
        _long(F.size(lines)).alias("n_lines"),
        _long(F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"),
        repeated(words).alias("n_repeat_words"),
        _long(F.size(F.filter(words, lambda w: w.isin(stop)))).alias("n_stop_words"),
    )
    whole = lambda words: _let(lines_of(t), lambda lines: counts(words, lines))
    return _let(F.filter(F.split(t, _SPACE, -1), lambda w: w != ""), whole)


def ratios(m: Column) -> dict[str, Column]:
    """The measures that a rule may name; a ratio over nothing is null and binds no rule."""
    over = lambda a, b: F.try_divide(m[a].cast("double"), m[b].cast("double"))
    return {
        "n_words": m["n_words"],
        "repeat_percent": F.try_divide(100 * m["n_repeat_words"], m["n_words"]),
        "mean_word": over("word_chars", "n_words"),
        "symbol_ratio": over("n_symbols", "word_chars"),
        "stop_ratio": over("n_stop_words", "n_words"),
        "dup_line_ratio": over("n_dup_lines", "n_lines"),
    }


def compiled(rules: tuple[Rule, ...], m: Column) -> Column:
    """The names of the rules that fail, in the table's order."""
    of = ratios(m)

    def failed(rule: Rule) -> Column:
        value = of[rule.measure]
        out = F.lit(False)
        if rule.low is not None:
            out = out | F.coalesce(value < rule.low, F.lit(False))
        if rule.high is not None:
            out = out | F.coalesce(value > rule.high, F.lit(False))
        return F.when(out, F.lit(rule.name))

    return F.filter(F.array(*map(failed, rules)), lambda x: x.isNotNull())


def assess(docs: DataFrame, key: str = "doc_id", text: str = "text", base: tuple[Rule, ...] = BASE, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``key``, the counts, ``base_failed``, ``failed`` (names of failed rules of both tables) and ``kept`` for every row.

    Keys may repeat or be null and other columns are ignored.  Null and empty
    texts have zero counts and fail the base rules.  Texts are read whole, in
    time that grows with their length times its logarithm.
    """
    m = docs.select(F.col(key), measures(text).alias("m"))
    judged = m.select(key, "m", compiled(base, F.col("m")).alias("at_base"), compiled(rules, F.col("m")).alias("at_rules"))
    return judged.select(key, "m.*", (F.size("at_base") > 0).alias("base_failed"), F.concat("at_base", "at_rules").alias("failed"), ((F.size("at_base") == 0) & (F.size("at_rules") == 0)).alias("kept"))
