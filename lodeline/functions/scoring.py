"""Name scorers.

Each scorer is one ``when`` chain over a literal query, so the text of the
query is analysed once on the driver and the rows see plain expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Score of each match tier.
EXACT, PREFIX, INITIALS, WORD, TOKENS, SUBSTRING = 1000.0, 500.0, 300.0, 200.0, 150.0, 100.0
DENSE = 50.0
SIMPLE_EXACT, SIMPLE_SUBSTRING, SIMPLE_INITIALS, SIMPLE_ATTRIBUTE = 1.0, 0.8, 0.7, 0.9


def _fold(name: Column, query: str, case_sensitive: bool) -> tuple[Column, str]:
    return (name, query) if case_sensitive else (F.lower(name), query.lower())


def initials(name: Column) -> Column:
    return F.regexp_replace(name, r"[^\p{Lu}]", "")


def initials_prefix(name: Column, query: str, case_sensitive: bool = False) -> Column:
    column, text = _fold(initials(name), query, case_sensitive)
    return F.startswith(column, F.lit(text))


def word_prefix(name: Column, query: str, case_sensitive: bool = False) -> Column:
    """Some word of the name, cut before each ASCII capital, starts with the query.

    A word holds an ASCII capital only as its first character, so the test is one
    pattern: the first character at the start of the name or as a capital, the
    others as anything but capitals.
    """
    if not query:
        return F.lit(True)
    text = query if case_sensitive else query.lower()
    first, rest = text[0], text[1:]
    capital = lambda c: "A" <= c <= "Z"
    if any(capital(c) for c in rest):
        return F.lit(False)

    def any_case(c: str) -> str:
        return re.escape(c) if c.isascii() else f"(?iu:{re.escape(c)})"

    if case_sensitive:
        head = first if capital(first) else f"^{re.escape(first)}"
        tail = re.escape(rest)
    elif "a" <= first <= "z":
        head, tail = f"(?:^{first}|{first.upper()})", "".join(any_case(c) for c in rest)
    else:
        head, tail = f"^{any_case(first)}", "".join(any_case(c) for c in rest)
    return F.rlike(name, F.lit(head + tail))


def all_tokens(name: Column, query: str, case_sensitive: bool = False) -> Column:
    """The query has a space and each of its tokens occurs in the name."""
    if " " not in query:
        return F.lit(False)
    out = F.lit(True)
    for token in [t for t in query.split(" ") if t]:
        column, text = _fold(name, token, case_sensitive)
        out = out & F.contains(column, F.lit(text))
    return out


def substring_score(name: Column, query: str, case_sensitive: bool = False) -> Column:
    column, text = _fold(name, query, case_sensitive)
    return F.when(F.contains(column, F.lit(text)), F.lit(SUBSTRING)).otherwise(F.lit(0.0))


def subsequence_score(name: Column, query: str, case_sensitive: bool = False) -> Column:
    """Score by how densely the characters of the query occur, in order, in the name.

    Taking the first possible position of every character makes the gaps
    telescope, so one regular expression that captures from the first to the
    last matched character gives their sum.
    """
    column, text = _fold(name, query, case_sensitive)
    if not text:
        return F.lit(0.0)
    chars = [re.escape(c) for c in text]
    body = chars[0] + "".join(f"[^{c}]*{c}" for c in chars[1:])
    span = F.length(F.regexp_extract(column, f"(?s)^[^{chars[0]}]*({body})", 1))
    if len(text) == 1:
        found = F.lit(DENSE)
    else:
        gap = (span - len(text)) / F.lit(float(len(text) - 1))
        found = F.greatest(F.lit(1.0), F.lit(DENSE) - F.floor(gap * 5).cast("double"))
    return F.when(span > 0, found).otherwise(F.lit(0.0))


def tier_score(name: Column, query: str, case_sensitive: bool = False) -> Column:
    """Best tier of the name: exact, prefix, initials, word, tokens, substring, subsequence."""
    if not query:
        return F.lit(0.0)
    column, text = _fold(name, query, case_sensitive)
    return (
        F.when(name.isNull() | (name == ""), F.lit(0.0))
        .when(column == text, F.lit(EXACT))
        .when(F.startswith(column, F.lit(text)), F.lit(PREFIX))
        .when(initials_prefix(name, query, case_sensitive), F.lit(INITIALS))
        .when(word_prefix(name, query, case_sensitive), F.lit(WORD))
        .when(all_tokens(name, query, case_sensitive), F.lit(TOKENS))
        .when(F.contains(column, F.lit(text)), F.lit(SUBSTRING))
        .otherwise(subsequence_score(name, query, case_sensitive))
    )


def simple_score(name: Column, query: str, case_sensitive: bool = False) -> Column:
    """Three-step scorer: equal, contained, or initials equal (never case-sensitive)."""
    column, text = _fold(name, query, case_sensitive)
    return (
        F.when(column == text, F.lit(SIMPLE_EXACT))
        .when(F.contains(column, F.lit(text)), F.lit(SIMPLE_SUBSTRING))
        .when(F.lower(initials(name)) == query.lower(), F.lit(SIMPLE_INITIALS))
        .otherwise(F.lit(0.0))
    )


def attribute_name(name: Column, scorer: str) -> Column:
    """``tiered`` drops one trailing ``Attribute``; ``simple`` drops each occurrence."""
    if scorer == "tiered":
        return F.regexp_replace(name, "Attribute$", "")
    return F.trim(F.replace(name, F.lit("Attribute"), F.lit("")))


def attribute_score(name: Column, query: str, case_sensitive: bool = False, scorer: str = "simple") -> Column:
    short = attribute_name(name, scorer)
    if scorer == "tiered":
        return tier_score(short, query, case_sensitive)
    column, text = _fold(short, query, case_sensitive)
    return F.when(F.contains(column, F.lit(text)), F.lit(SIMPLE_ATTRIBUTE)).otherwise(F.lit(0.0))


def name_score(name: Column, query: str, case_sensitive: bool = False, scorer: str = "simple") -> Column:
    if scorer not in ("simple", "tiered"):
        raise ValueError("scorer must be 'simple' or 'tiered'")
    chosen = tier_score if scorer == "tiered" else simple_score
    return chosen(name, query, case_sensitive)
