"""Text normalisation as Column functions: no Python in the plan, one projection each."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANK = r"[\t\n\f\r ]+"


def collapse(s: Column) -> Column:
    """Runs of ASCII white space become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(s, _BLANK, " "))


def strip_markdown(s: Column) -> Column:
    """A line without heading hashes, bullet and every emphasis mark; ``_`` and ``*`` are emphasis wherever they stand."""
    s = F.regexp_replace(s, r"^[\t\n\f\r ]{0,3}#{1,6}[\t\n\f\r ]*", "")
    s = F.regexp_replace(s, r"^[\t\n\f\r ]{0,3}[-*+][\t\n\f\r ]+", "")
    return F.trim(F.regexp_replace(s, r"[*_`]", ""))


def slug(s: Column) -> Column:
    """Lower-case letters and digits; separators become single dashes, anything else goes."""
    s = F.regexp_replace(F.lower(F.trim(s)), r"[-_ ./]+", "-")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"[^a-z0-9-]", ""), r"-+", "-"), r"^-+|-+$", "")


def title_of_file(name: Column) -> Column:
    """A title from a file name: no extension, separators as spaces, words with a capital first letter."""
    words = F.split(collapse(F.translate(F.regexp_replace(name, r"\.[^./]*$", ""), "_-.", "   ")), " ")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w)))), " ")


def compact(s: Column) -> Column:
    """Lower-case letters and digits only: the comparison key of stems and options."""
    return F.regexp_replace(F.lower(s), r"[^\p{L}\p{Nd}]", "")


def heading(s: Column) -> Column:
    """A heading in comparable form: without markdown, structural prefix, trailing count, punctuation and "and"."""
    s = strip_markdown(s)
    s = F.regexp_replace(s, r"(?i)[\(\[]\s*\d+\s*(?:questions?|marks?|qs?)\s*[\)\]]\s*$", "")
    s = F.regexp_replace(s, r"(?i)^\s*(?:part|section|paper|subject|unit|module|tier)\s*[-–—:.]?\s*(?:[ivxlcdm]+|[0-9]+|[a-z])?\s*[-–—:.)]*\s*", "")
    s = F.regexp_replace(F.regexp_replace(F.lower(s), r"[\s&-]", " "), r"[^\p{L}\p{Nd} ]", "")
    return collapse(F.replace(collapse(s), F.lit(" and "), F.lit(" ")))


def looks_like_heading(raw: Column) -> Column:
    """Whether a line is plausibly a heading: short, explicit or mostly upper case or of few words, and no sentence or question."""
    line = strip_markdown(raw)
    letters, upper = F.regexp_count(line, F.lit(r"\p{L}")), F.regexp_count(line, F.lit(r"\p{Lu}"))
    bold = F.trim(raw).startswith("**") & F.trim(raw).endswith("**")
    sentence = line.endswith(".") & ~line.endswith("...") & (F.char_length(line) > 40)
    return (
        F.when((line == "") | (F.char_length(line) > 90), False)
        .when(raw.rlike(r"^[\t\n\f\r ]{0,3}#{1,6}") | bold, True)
        .when(sentence | F.contains(line, F.lit("?")) | (letters == 0), False)
        .when(upper > 0.7 * letters, True)
        .otherwise(F.size(F.split(collapse(line), " ")) <= 10)
    )


def content_hash(stem: Column, options: Column) -> Column:
    """SHA-256 of the stem and its options in sorted comparable form, so the order of options does not matter."""
    keys = F.array_sort(F.filter(F.transform(options, compact), lambda x: x != ""))
    return F.sha2(F.array_join(F.concat(F.array(compact(stem)), keys), "|"), 256)


def tokens(s: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(s), r"[^\p{L}\p{Nd}]+"), lambda x: x != "")


def shortened(s: Column, most: int) -> Column:
    """Words re-joined by single spaces, at most ``most`` characters, with an ellipsis where cut."""
    s = collapse(s)
    return F.when(F.char_length(s) > most, F.concat(F.substring(s, 1, most - 1), F.lit("…"))).otherwise(s)


def word_count(s: Column) -> Column:
    return F.size(F.filter(F.split(s, r"\s+"), lambda x: x != ""))


def trigrams(s: Column) -> Column:
    """The distinct 3-grams of a text's words, each word with two blanks before and one behind."""
    padded = F.transform(tokens(s), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.char_length(w) - 2), lambda i: w.substr(i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def table_cells(line: Column) -> Column:
    """The trimmed cells of a markdown table row."""
    return F.transform(F.split(F.regexp_replace(F.trim(line), r"^\|+|\|+$", ""), r"\|", -1), lambda x: F.trim(x))


def grounded(source: Column, words: Column) -> Column:
    """Whether the words stand in the source: one or two anywhere, more in one run or in order with few words of the source between them."""
    known = F.forall(words, lambda w: F.array_contains(source, w))
    run = F.contains(F.concat(F.lit(" "), F.array_join(source, " "), F.lit(" ")), F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")))
    gaps = F.floor(F.size(words) / 3).cast("int") + 2

    def follows(a: Column, w: Column) -> Column:
        found = F.array_position(F.slice(source, F.greatest(a["at"], F.lit(0)) + 1, a["gaps"] + 1), w).cast("int")
        return F.when((a["at"] > 0) & (found > 0), F.struct((a["at"] + found).alias("at"), (a["gaps"] - found + 1).alias("gaps"))).otherwise(F.struct(F.lit(0).alias("at"), a["gaps"].alias("gaps")))

    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(source), F.lit(1))), lambda p: F.get(source, p - 1) == F.get(words, F.lit(0)))
    in_order = F.exists(starts, lambda p: F.aggregate(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), F.struct(p.alias("at"), gaps.alias("gaps")), follows)["at"] > 0)
    return F.when(F.size(words) == 0, True).when(F.size(source) == 0, False).when(F.size(words) <= 2, known).otherwise(run | in_order)


def coverage(source: Column, words: Column) -> Column:
    """The share of the words that stand anywhere in the source; 1 without words."""
    return F.when(F.size(words) == 0, 1.0).otherwise(F.size(F.filter(words, lambda w: F.array_contains(source, w))) / F.size(words))


def excerpt(text: Column, at: Column, around: int = 30, most: int = 70) -> Column:
    """The characters within ``around`` of a 0-based place, re-joined and shortened; empty where the place is negative."""
    begin, end = F.greatest(at - around, F.lit(0)), F.least(at + around, F.char_length(text))
    return F.when(at < 0, "").otherwise(shortened(text.substr((begin + 1).cast("int"), F.greatest(end - begin, F.lit(0)).cast("int")), most))


def aliases_of(stored: Column) -> Column:
    """The trimmed names of a stored JSON list; anything else gives none."""
    found = F.from_json(stored, "array<string>", {"mode": "PERMISSIVE"})
    return F.coalesce(F.filter(F.transform(found, lambda a: F.trim(a)), lambda a: F.coalesce(a != "", F.lit(False))), F.array().cast("array<string>"))


def stored_aliases(names: Column) -> Column:
    """Names as a JSON list, trimmed, without blanks, the first of those that differ in case only."""
    cleaned = F.filter(F.transform(names, lambda a: F.trim(a)), lambda a: F.coalesce(a != "", F.lit(False)))
    held = lambda out, a: F.exists(out, lambda o: F.lower(o) == F.lower(a))
    return F.to_json(F.aggregate(cleaned, F.array().cast("array<string>"), lambda out, a: F.when(held(out, a), out).otherwise(F.array_append(out, a))))


def printable(s: Column) -> Column:
    """Line ends as one line feed, without control characters and what no font prints."""
    s = F.regexp_replace(s, r"\r\n?", "\n")
    return F.regexp_replace(F.regexp_replace(s, r"[\x00-\x08\x0B-\x1F\x7F\x{FFFD}\x{FFFE}\x{FFFF}]", ""), r"^\s+|\s+\z", "")


def cut_at_word(s: Column, most: int) -> Column:
    """At most ``most`` characters with an ellipsis where cut, at a space among the last 20 if there is one and never behind half a syllable."""
    head = s.substr(F.lit(1), F.lit(most - 1))
    last_space = F.char_length(head) - F.char_length(F.regexp_extract(head, r"([^ \t\n]*)\z", 1)) - 1
    cut = F.when((last_space > F.char_length(head) - 20) & (last_space > 0), head.substr(F.lit(1), last_space.cast("int"))).otherwise(head)
    return F.when(F.char_length(s) <= most, s).otherwise(F.concat(F.regexp_replace(F.regexp_replace(cut, r"[\p{Mn}\p{Mc}]+\z", ""), r"^\s+|\s+\z", ""), F.lit("…")))


def limited_bytes(s: Column, most: int) -> Column:
    """``text, truncated``: what fits in ``most`` bytes of UTF-8, without half a character at its end."""
    data = s.cast("binary")
    # A byte 10xxxxxx behind the cut says that a character is split: step back to where it begins, three bytes at most.
    splits = lambda i: F.hex(F.substring(data, most + 1 - i, 1)).between("80", "BF")
    back = F.when(~splits(0), 0).when(~splits(1), 1).when(~splits(2), 2).otherwise(3)
    kept = F.when(F.octet_length(s) > most, F.decode(data.substr(F.lit(1), F.lit(most) - back), "UTF-8")).otherwise(s)
    return F.struct(kept.alias("text"), (F.octet_length(s) > most).alias("truncated"))
