"""Markdown structure and front matter as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T

ENTRY = "array<struct<key:string,value:string,items:array<string>>>"
LIST_ITEM = r"^\s*(?:[-*+]|\d+\.)\s+"
LINK = r"\[([^\]]+)\]\(([^)]+)\)"


def _unquote(value: Column) -> Column:
    """One layer of equal quotes off."""
    wrapped = ((F.substring(value, 1, 1) == '"') & (F.substring(value, -1, 1) == '"')) | ((F.substring(value, 1, 1) == "'") & (F.substring(value, -1, 1) == "'"))
    return F.when(wrapped, F.substring(value, F.lit(2), F.greatest(F.length(value) - 2, F.lit(0)))).otherwise(value)


def front_matter(text: Column) -> Column:
    """Entries of a leading --- block, in order; later keys win on lookup; empty values are left out.

    A [a, b] value gives items and no value.
    """
    end = F.locate("\n---", text, 4)
    block = F.when(text.startswith("---") & (end > 0), T.strip(F.substring(text, F.lit(5), F.greatest(end - 5, F.lit(0)))))
    lines = F.filter(F.transform(F.split(block, "\n", -1), T.strip), lambda x: (x != "") & ~x.startswith("#") & x.contains(":"))

    def entry(line: Column) -> Column:
        key = F.lower(T.strip(F.substring_index(line, ":", 1)))
        return F.struct(key.alias("key"), _unquote(T.strip(F.substring(line, F.locate(":", line) + 1, F.length(line)))).alias("value"))

    def lists(e: Column) -> Column:
        value = e["value"]
        inner = F.split(F.substring(value, F.lit(2), F.greatest(F.length(value) - 2, F.lit(0))), ",", -1)
        items = F.transform(F.filter(inner, lambda x: T.strip(x) != ""), lambda x: F.regexp_replace(T.strip(x), "\\A[\"']+|[\"']+\\z", ""))
        is_list = value.startswith("[") & value.endswith("]") & (F.length(value) >= 2)
        return F.struct(e["key"].alias("key"), F.when(~is_list, value).alias("value"), F.when(is_list, items).alias("items"))

    found = F.transform(F.transform(lines, entry), lists)
    kept = F.filter(found, lambda e: (F.coalesce(e["value"], F.lit("")) != "") | (F.size(F.coalesce(e["items"], F.array().cast("array<string>"))) > 0))
    return F.coalesce(kept, F.array().cast(ENTRY))


def look_up(entries: Column, key: str) -> Column:
    """Value of a key as text: lists become JSON text."""
    e = F.try_element_at(F.filter(entries, lambda x: x["key"] == key), F.lit(-1))
    return F.coalesce(e["value"], F.to_json(e["items"]))


def _header(sign: str):
    return lambda x: x.startswith(sign + " ") | (x == sign)


def structure(df: DataFrame, column: str = "text", stem: Column | None = None) -> DataFrame:
    """Adds S8 to S14: has_frontmatter, title, author, creation_date, tags, description, categories, h1 to h6, first_h1,
    code_blocks, list_items, link_count, line_count.  Counts cover front matter and code as well; missing is null or zero."""
    out = df.withColumn("_m_fm", T.fence(front_matter(F.col(column)))).withColumn("_m_lines", F.split(F.col(column), "\n", -1))
    out = out.withColumn("_m_bare", F.transform("_m_lines", T.strip))
    for n in range(1, 7):
        sign = "#" * n
        out = out.withColumn(f"h{n}", F.size(F.filter("_m_bare", _header(sign))))
    first = F.try_element_at(F.filter("_m_bare", lambda x: x.startswith("# ")), F.lit(1))
    out = out.withColumn("first_h1", T.strip(F.substring(first, 3, 1 << 30)))
    # A first header without text is no title.
    title = F.coalesce(look_up(F.col("_m_fm"), "title"), F.nullif(F.col("first_h1"), F.lit("")), stem if stem is not None else F.lit(None).cast("string"))
    return out.select(
        *df.columns,
        (F.size("_m_fm") > 0).alias("has_frontmatter"),
        title.alias("title"),
        *(look_up(F.col("_m_fm"), key).alias(name) for key, name in (("author", "author"), ("date", "creation_date"), ("tags", "tags"), ("description", "description"), ("categories", "categories"))),
        *(F.col(f"h{n}") for n in range(1, 7)),
        "first_h1",
        F.floor(F.regexp_count(F.col(column), F.lit("```")) / 2).cast("int").alias("code_blocks"),
        F.size(F.filter("_m_lines", lambda x: x.rlike(r"\A(?:" + T.java(LIST_ITEM) + ")"))).alias("list_items"),
        F.regexp_count(F.col(column), F.lit(LINK)).alias("link_count"),
        F.size("_m_lines").alias("line_count"),
    )
