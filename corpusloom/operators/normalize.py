"""Normaliser: configurable, countable cleaning rules as one narrow plan of column expressions.

Every rule is a step that adds the new text and its count; no rule shuffles.
Repeated lines are found inside the row by sorting its lines, so even they need
no exchange.  The order of the rules is fixed and observable.
"""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import rules
from corpusloom.functions import text as T

FENCE = r"(?s)```.*?```"


@dataclass(frozen=True)
class NormalizationConfig:
    remove_page_numbers: bool = True
    remove_headers_footers: bool = True
    remove_boilerplate: bool = True
    normalize_whitespace: bool = True
    normalize_special_chars: bool = True
    normalize_bullets: bool = True
    remove_zero_width: bool = True
    preserve_code_blocks: bool = True
    min_line_length: int = 0
    header_footer_threshold: int = 2
    header_footer_max_length: int = 100
    custom_patterns: list = field(default_factory=list)
    custom_replacements: dict = field(default_factory=dict)

    @classmethod
    def preset(cls, name: str) -> NormalizationConfig | None:
        """default, minimal, aggressive; none gives None."""
        if name == "none":
            return None
        changes = {
            "default": {},
            "minimal": {"remove_page_numbers": False, "remove_headers_footers": False, "remove_boilerplate": False, "normalize_bullets": False},
            "aggressive": {"min_line_length": 3},
        }
        if name not in changes:
            raise ValueError(f"unknown preset: {name}")
        return cls(**changes[name])

    @classmethod
    def from_yaml(cls, path: str | Path) -> NormalizationConfig:
        """Keys not given keep their defaults; unknown keys are ignored."""
        import yaml

        path = Path(path)
        if not path.exists():
            raise FileNotFoundError(f"no such configuration: {path}")
        given = yaml.safe_load(path.read_text(encoding="utf-8")) or {}
        if not isinstance(given, dict):
            raise ValueError(f"{path} does not hold a mapping")
        config = cls(**{f.name: given[f.name] for f in fields(cls) if f.name in given})
        for p in config.custom_patterns:
            T.python_pattern(p)
        return config


# ------------------------------------------------------------ single rules
# Each adds the cleaned text and its count to a DataFrame.  Arrays that are used more than once are columns of
# their own, so that the optimizer computes them once instead of inlining them.
def map_chars(df: DataFrame, src: str, dst: str, n: str, chars: str, to: str) -> DataFrame:
    return df.withColumn(dst, F.translate(src, chars, to)).withColumn(n, T.count_chars(F.col(src), chars).cast("int"))


def zero_width(df: DataFrame, src: str, dst: str, n: str) -> DataFrame:
    return map_chars(df, src, dst, n, rules.ZERO_WIDTH, "")


def special_chars(df: DataFrame, src: str, dst: str, n: str, skip: dict | None = None) -> DataFrame:
    """Characters that custom replacements name are left to them."""
    pairs = [(a, b) for a, b in zip(rules.SPECIAL_FROM, rules.SPECIAL_TO) if a not in (skip or {})]
    return map_chars(df, src, dst, n, "".join(a for a, _ in pairs), "".join(b for _, b in pairs))


def bullets(df: DataFrame, src: str, dst: str, n: str) -> DataFrame:
    return map_chars(df, src, dst, n, rules.BULLETS, "-" * len(rules.BULLETS))


def drop_lines(df: DataFrame, src: str, dst: str, n: str, patterns: list) -> DataFrame:
    """Whole lines that match any pattern go; counted per line."""
    pattern = T.alternation(patterns)
    out = df.withColumn("_d_lines", T.lines(F.col(src)))
    out = out.withColumn("_d_kept", F.filter("_d_lines", lambda line: ~line.rlike(pattern)))
    out = out.withColumn(dst, F.array_join("_d_kept", "\n")).withColumn(n, (F.size("_d_lines") - F.size("_d_kept")).cast("int"))
    return out.drop("_d_lines", "_d_kept")


def page_numbers(df: DataFrame, src: str, dst: str, n: str) -> DataFrame:
    return drop_lines(df, src, dst, n, rules.PAGE_NUMBERS)


def boilerplate(df: DataFrame, src: str, dst: str, n: str) -> DataFrame:
    return drop_lines(df, src, dst, n, rules.BOILERPLATE)


def custom_lines(df: DataFrame, src: str, dst: str, n: str, patterns: list) -> DataFrame:
    return drop_lines(df, src, dst, n, patterns)


def repeated_lines(df: DataFrame, src: str, dst: str, n: str, threshold: int = 2, max_length: int = 100, min_length: int = 0) -> DataFrame:
    """Lines that occur ``threshold`` times or more go everywhere, in texts of three lines or more.

    The lines are sorted; a line equals the one threshold - 1 places before it
    exactly if it occurs that often.  So no line is compared with all others,
    and nothing is shuffled.
    """
    back = max(1, threshold) - 1
    out = df.withColumn("_h_lines", T.lines(F.col(src))).withColumn("_h_bare", F.transform("_h_lines", T.strip))
    countable = F.filter("_h_bare", lambda x: (F.length(x) >= max(1, min_length)) & (F.length(x) < max_length))
    out = out.withColumn("_h_sorted", F.when(F.size("_h_lines") >= 3, F.array_sort(countable)).otherwise(F.array().cast("array<string>")))
    often = F.col("_h_sorted")
    if back:
        later = F.slice("_h_sorted", back + 1, F.greatest(F.size("_h_sorted") - back, F.lit(0)))
        often = F.filter(F.zip_with("_h_sorted", later, lambda a, b: F.when(a == b, a)), lambda x: x.isNotNull())
    out = out.withColumn("_h_often", F.array_distinct(often))
    pairs = F.zip_with("_h_lines", "_h_bare", lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    kept = F.transform(F.filter(pairs, lambda x: ~F.array_contains(F.col("_h_often"), x["b"])), lambda x: x["a"])
    out = out.withColumn("_h_kept", F.when(F.size("_h_often") > 0, kept).otherwise(F.col("_h_lines")))
    out = out.withColumn(dst, F.array_join("_h_kept", "\n")).withColumn(n, (F.size("_h_lines") - F.size("_h_kept")).cast("int"))
    return out.drop("_h_lines", "_h_bare", "_h_sorted", "_h_often", "_h_kept")


def replacements(df: DataFrame, src: str, dst: str, n: str, pairs: dict) -> DataFrame:
    """Literal replacements, one after the other; counted by occurrences."""
    out = df.withColumn(dst, F.col(src)).withColumn(n, F.lit(0))
    for old, new in pairs.items():
        hits = ((F.length(dst) - F.length(F.replace(F.col(dst), F.lit(old), F.lit("")))) / len(old)).cast("int")
        out = out.withColumn(n, F.col(n) + hits).withColumn(dst, F.replace(F.col(dst), F.lit(old), F.lit(new)))
    return out


def whitespace(text: Column) -> Column:
    text = F.regexp_replace(T.line_feeds(text), r"(?dm)[ \t]+$", "")
    return F.regexp_replace(F.regexp_replace(text, r"[ \t]{2,}", " "), "\n{3,}", "\n\n")


def protect_code(text: Column) -> tuple:
    """(text with numbered placeholders, array of the fenced blocks)."""
    blocks = F.regexp_extract_all(text, F.lit(FENCE), F.lit(0))
    parts = F.split(text, FENCE, -1)
    named = F.transform(parts, lambda p, i: F.when(i < F.size(parts) - 1, F.concat(p, F.lit("__CODE_BLOCK_"), i.cast("string"), F.lit("__"))).otherwise(p))
    return F.array_join(named, ""), blocks


def restore_code(text: Column, blocks: Column) -> Column:
    numbered = F.transform(blocks, lambda b, i: F.struct(F.concat(F.lit("__CODE_BLOCK_"), i.cast("string"), F.lit("__")).alias("name"), b.alias("block")))
    return F.aggregate(numbered, text, lambda t, x: F.replace(t, x["name"], x["block"]))


# ------------------------------------------------------------ the whole pipeline
#: Names of the rules and of their counts, in order of application.
COUNTS = [
    ("remove_zero_width", "zero_width_chars"),
    ("normalize_special_chars", "special_chars"),
    ("normalize_bullets", "bullet_chars"),
    ("remove_page_numbers", "page_numbers"),
    ("remove_boilerplate", "boilerplate"),
    ("remove_headers_footers", "headers_footers"),
    ("custom_patterns", "custom_patterns"),
    ("custom_replacements", "custom_replacements"),
]


def normalize(df: DataFrame, config: NormalizationConfig | None = None, column: str = "text") -> DataFrame:
    """Adds ``normalized``: struct of text, original_length, normalized_length, rules_applied, removed_patterns.

    A null text gives a null text and zero lengths.
    """
    c = config or NormalizationConfig()
    steps = [
        (c.remove_zero_width, zero_width, ()),
        (c.normalize_special_chars, special_chars, (c.custom_replacements,)),
        (c.normalize_bullets, bullets, ()),
        (c.remove_page_numbers, page_numbers, ()),
        (c.remove_boilerplate, boilerplate, ()),
        (c.remove_headers_footers, repeated_lines, (c.header_footer_threshold, c.header_footer_max_length, c.min_line_length)),
        (bool(c.custom_patterns), custom_lines, (c.custom_patterns,)),
        (bool(c.custom_replacements), replacements, (c.custom_replacements,)),
    ]
    blocks, work = "_n_blocks", "_n_t"
    if c.preserve_code_blocks:
        text, found = protect_code(F.col(column))
        out = df.withColumn(blocks, found).withColumn(work, F.when(F.size(blocks) > 0, text).otherwise(F.col(column)))
    else:
        out = df.withColumn(blocks, F.array().cast("array<string>")).withColumn(work, F.col(column))
    done = []
    for number, (active, step, arguments) in enumerate(steps):
        if active:
            out = step(out, work, f"_n_t{number}", f"_n_c{number}", *arguments)
            work = f"_n_t{number}"
            done.append((number, F.col(f"_n_c{number}")))
    if c.normalize_whitespace:
        out = out.withColumn("_n_w", whitespace(F.col(work)))
        work = "_n_w"
    final = F.when(F.size(blocks) > 0, restore_code(F.col(work), F.col(blocks))).otherwise(F.col(work)) if c.preserve_code_blocks else F.col(work)
    out = out.withColumn("_n_final", T.strip(final))
    applied = [F.when(F.size(blocks) > 0, F.lit("preserve_code_blocks"))] if c.preserve_code_blocks else []
    applied += [F.when(count > 0, F.lit(COUNTS[number][0])) for number, count in done]
    applied += [F.lit("normalize_whitespace")] if c.normalize_whitespace else []
    counts = F.map_from_arrays(F.array(*(F.lit(COUNTS[n][1]) for n, _ in done)), F.array(*(count for _, count in done))) if done else F.expr("cast(map() AS map<string,int>)")
    result = F.struct(
        F.col("_n_final").alias("text"),
        F.coalesce(F.length(column), F.lit(0)).alias("original_length"),
        F.coalesce(F.length("_n_final"), F.lit(0)).alias("normalized_length"),
        (F.filter(F.array(*applied), lambda x: x.isNotNull()) if applied else F.array().cast("array<string>")).alias("rules_applied"),
        F.map_filter(counts, lambda _, n: n > 0).alias("removed_patterns"),
    )
    return out.withColumn("normalized", result).select(*df.columns, "normalized")
