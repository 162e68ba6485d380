"""Column helpers with the text semantics of Python's ``re`` and ``str``."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions import rules

#: What Python's str.isspace and \s accept, inside a Java character class.
SPACE = r"\t-\r\x1c-\x20\x85\xa0  -     　"
#: The same characters, one by one.
SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def java(pattern: str) -> str:
    """A Python pattern in Java's dialect: Unicode spaces and digits, and only line feeds end lines."""
    flags = "(?d)"
    if pattern.startswith("(?i)"):
        flags, pattern = "(?diu)", pattern[4:]
    out, inside, i = [], False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            n = pattern[i + 1]
            out.append({"s": SPACE if inside else f"[{SPACE}]", "S": f"[^{SPACE}]", "d": r"\p{Nd}", "D": r"\P{Nd}", "w": r"\p{L}\p{N}_" if inside else r"[\p{L}\p{N}_]"}.get(n, c + n))
            i += 2
            continue
        if c == "[" and not inside:
            inside = True
        elif c == "]" and inside:
            inside = False
        out.append(c)
        i += 1
    return flags + "".join(out)


def fence(value: Column) -> Column:
    """The same value, behind a condition that always holds and is not deterministic.

    The optimizer inlines a column that is named once, even where that is inside
    a lambda, which then computes it again for every element.  It leaves
    expressions alone that are not deterministic.
    """
    return F.when(F.monotonically_increasing_id() >= 0, value)


def strip(text: Column) -> Column:
    """str.strip: all Unicode white space at both ends."""
    return F.btrim(text, F.lit(SPACES))


def line_feeds(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n|\r", "\n")


def basic(text: Column) -> Column:
    """Line ends, six typographic characters, runs of newlines and blanks, strip."""
    text = F.translate(line_feeds(text), rules.BASIC_FROM, rules.BASIC_TO)
    text = F.regexp_replace(text, "\n{3,}", "\n\n")
    return strip(F.regexp_replace(text, "[ \t]{2,}", " "))


def replace_chars(text: Column, chars: str, to: str) -> Column:
    return F.translate(text, chars, to)


def count_chars(text: Column, chars: str) -> Column:
    """How many characters of the text are among chars."""
    if not chars:
        return F.lit(0)
    return F.length(text) - F.length(F.translate(text, chars, ""))


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def matches_any(line: Column, patterns: list) -> Column:
    """Whether any pattern matches from the start of the line, as re.match does."""
    found = None
    for p in patterns:
        hit = line.rlike(r"\A(?:" + java(p) + ")")
        found = hit if found is None else found | hit
    return found if found is not None else F.lit(False)


def alternation(patterns: list) -> str:
    """One Java pattern for a whole group, anchored at the start."""
    return r"\A(?:" + "|".join(f"(?:{java(p)})" for p in patterns) + ")"


def estimate_tokens(text: Column) -> Column:
    """Words and single signs, at least 1."""
    signs = F.regexp_replace(F.regexp_replace(text, r"[\p{L}\p{N}_]+", "x"), rf"[{SPACE}]+", "")  # one for each; regexp_count keeps every match
    return F.greatest(F.lit(1), F.length(signs))


def paragraphs(text: Column) -> Column:
    """Split at blank lines, strip, drop empties; never empty."""
    parts = F.filter(F.transform(F.split(text, rf"\n[{SPACE}]*\n", -1), strip), lambda p: p != "")
    return F.when(F.size(parts) == 0, F.array(strip(text))).otherwise(parts)


def sentences(text: Column) -> Column:
    """C4: split after . ! ? where white space and a capital A-Z follow; blank texts give none."""
    parts = F.filter(F.transform(F.split(strip(text), rf"(?<=[.!?])[{SPACE}]+(?=[A-Z])", -1), strip), lambda p: p != "")
    return F.when(strip(text) == "", F.array().cast("array<string>")).otherwise(parts)


def words(text: Column) -> Column:
    """str.split()."""
    parts = F.split(strip(text), rf"[{SPACE}]+", -1)
    return F.when(strip(text) == "", F.array().cast("array<string>")).otherwise(parts)


def page_marker(text: Column) -> Column:
    """Number of the first [PAGE:n] line."""
    return F.when(F.contains(text, F.lit("[PAGE:")), F.nullif(F.regexp_extract(text, r"(?dm)^\[PAGE:(\p{Nd}+)\]$", 1), F.lit("")).cast("int"))


def section(text: Column) -> Column:
    """The last Markdown header, stripped; white space after the signs may cross lines."""
    found = F.regexp_extract_all(text, F.lit(rf"(?dm)^(#{{1,6}})[{SPACE}]+(.+)$"), F.lit(2))
    return F.when(F.contains(text, F.lit("#")), strip(F.try_element_at(found, F.lit(-1))))


def strip_markers(text: Column) -> Column:
    """Marker lines out, newlines collapsed, strip."""
    bare = strip(F.when(F.contains(text, F.lit("[PAGE:")), F.regexp_replace(text, r"(?dm)^\[PAGE:\p{Nd}+\]$", "")).otherwise(text))
    return strip(F.regexp_replace(bare, "\n{3,}", "\n\n"))


def slug(text: Column) -> Column:
    """Lower case, runs of other characters to one dash, no dash at the ends, never empty."""
    dashed = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(dashed, "^-+|-+$", ""), F.lit("")), F.lit("document"))


def pdf_date(text: Column) -> Column:
    """D:YYYYMMDDHHmmSS to ISO text by position, without validation; 8 to 13 characters give a date."""
    bare = F.regexp_replace(text, r"\AD:", "")
    part = lambda a, n: F.substring(bare, a, n)
    day = F.concat_ws("-", part(1, 4), part(5, 2), part(7, 2))
    return F.when(F.length(bare) >= 14, F.concat(day, F.lit("T"), F.concat_ws(":", part(9, 2), part(11, 2), part(13, 2)))).when(F.length(bare) >= 8, day)


def python_pattern(pattern: str) -> str:
    """Raises re.error for patterns that are no patterns."""
    re.compile(pattern)
    return pattern
