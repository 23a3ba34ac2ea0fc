"""Corruption rules over one text field: each is a Column that is null or the evidence, and ``inspected`` gathers their codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and tokens of the rules.
PLACEHOLDER = r"(?i)<!--[^>]*-->|\{\{[^}]*\}\}|\$\{[^}]*\}|\[(?:tbd|todo|fixme|xxx|placeholder|image|figure|diagram)\]|\b(?:lorem ipsum|todo|fixme)\b"
BACKSLASHES = r"\\{3,}"
ENTITY = r"&(?:amp|lt|gt|quot|apos|nbsp|#\d{2,5}|#x[0-9a-fA-F]{2,4});"
MOJIBAKE = "[ÃÂâÎÐÑΓ─-▟][\u0080-ÿ -⁯₠-₿─-▟Œœšž]+|ï¿½"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]"
RUN = r"([^ \t\n\r_.\-*=~0-9])\1{5,}"
RESIDUE = ("|---", "<td", "<tr", "</table", "```", "![", "](http")
FOREIGN = r"(?:^|[\t\n\f\r ])\(?[1-9a-hA-H]\)?[.)][\t\n\f\r ]+[^\t\n\f\r ]+.*?[\t\n\f\r ]\(?[1-9a-hA-H]\)?[.)][\t\n\f\r ]+[^\t\n\f\r ]+"
SECOND_QUESTION = r"\?[\t\n\f\r ]+[A-Z][a-z]+[\t\n\f\r ]+[^\t\n\f\r ]+"


def _found(text: Column, pattern: str) -> Column:
    return F.regexp_substr(text, F.lit(pattern))


def _residue(text: Column) -> Column:
    return F.coalesce(*(F.when(F.contains(text, F.lit(t)), F.lit(t)) for t in RESIDUE))


RULES = {
    "unreadable_chars": lambda t: F.when(F.contains(t, F.lit("�")), F.lit("�")),
    "placeholder": lambda t: _found(t, PLACEHOLDER),
    "backslash_run": lambda t: _found(t, BACKSLASHES),
    "html_entity": lambda t: _found(t, ENTITY),
    "mojibake": lambda t: _found(t, MOJIBAKE),
    "control_chars": lambda t: _found(t, CONTROL),
    "character_run": lambda t: _found(t, RUN),
    "markdown_residue": _residue,
}


def inspected(text: Column) -> Column:
    """The codes of the corruption rules that a field breaks, in the rules' order; blank and null fields break none."""
    codes = F.filter(F.array(*(F.when(rule(text).isNotNull(), F.lit(code)) for code, rule in RULES.items())), lambda x: x.isNotNull())
    return F.when(F.coalesce(F.trim(text), F.lit("")) == "", F.array().cast("array<string>")).otherwise(codes)


def foreign_content(text: Column) -> Column:
    """Two label-like marks inside one field, or null."""
    return _found(text, FOREIGN)


def second_question(text: Column) -> Column:
    """A question mark followed by another sentence, or null."""
    return _found(text, SECOND_QUESTION)
