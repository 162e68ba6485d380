"""Free metadata: VARIANT values of any shape, merged by precedence, flattened and made plain.

Documents and chunks may carry metadata whose names and types differ from format
to format.  They are kept as VARIANT (parsed once, typed value by value), merged in
the fixed order core, document, place, chunk (later ones win, with a null too), and
then listed as one row for each name or packed as one JSON object.

Cases: text that is no JSON object, or null, counts as no metadata; a value that is
null drops out; of a name given twice in one object the last counts; an object or
array becomes compact JSON text; repeated rows give repeated results.  A
``paragraph_span`` of two whole numbers becomes paragraph_start and paragraph_end,
any other shape stays as text under its own name; page is a whole number, or left out.
Nothing here shuffles but ``profile``, which is one aggregate.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of chunk metadata with a meaning of their own.
PLACE = ("paragraph_span", "page", "section")
MAP = "map<string,variant>"


def parse(text: Column) -> Column:
    """map<string,variant> of a JSON object in a text; an empty map for anything else."""
    return F.coalesce(F.try_variant_get(F.try_parse_json(text), "$", MAP), F.expr(f"cast(map() AS {MAP})"))


def merged(*maps: Column) -> Column:
    """Later maps win."""
    def over(early: Column, later: Column) -> Column:
        return F.map_concat(F.map_filter(early, lambda k, _: ~F.map_contains_key(later, k)), later)

    return reduce(over, maps)


def entry(name: str, value: Column) -> Column:
    """A map of one name; empty where the value is null."""
    return F.when(value.isNotNull(), F.create_map(F.lit(name), value.cast("variant"))).otherwise(F.expr(f"cast(map() AS {MAP})"))


def place(chunk: Column) -> Column:
    """paragraph_start and paragraph_end, or paragraph_span as text; page; section."""
    of = lambda name: F.try_element_at(chunk, F.lit(name))
    span = of("paragraph_span")
    pair = F.try_variant_get(span, "$", "array<variant>")
    number = lambda i: F.try_variant_get(F.try_element_at(pair, F.lit(i)), "$", "bigint")
    whole = F.coalesce((F.size(pair) == 2) & number(1).isNotNull() & number(2).isNotNull(), F.lit(False))
    return merged(
        entry("paragraph_start", F.when(whole, number(1))),
        entry("paragraph_end", F.when(whole, number(2))),
        entry("paragraph_span", F.when(~whole & ~F.coalesce(F.is_variant_null(span), F.lit(True)), span.cast("string"))),
        entry("page", F.try_variant_get(of("page"), "$", "bigint")),
        entry("section", of("section").cast("string")),
    )


def flattened(core: dict, document: Column, chunk: Column) -> Column:
    """I2 to I6 for free metadata: map<string,variant>, without nulls; core: name to column; document, chunk: as parse() gives them."""
    first = [entry(name, value) for name, value in core.items()]
    rest = F.map_filter(chunk, lambda k, _: ~k.isin(*PLACE))
    return F.map_filter(merged(*first, document, place(chunk), rest), lambda _, v: v.isNotNull() & ~F.is_variant_null(v))


def kind(value: Column) -> Column:
    """text, number, boolean or json."""
    name = F.schema_of_variant(value)
    return F.when(name == "STRING", "text").when(name == "BOOLEAN", "boolean").when(name.startswith("ARRAY") | name.startswith("OBJECT"), "json").otherwise("number")


def listed(df: DataFrame, keys: list, metadata: Column) -> DataFrame:
    """One row for each name of a metadata map: keys, name, kind, value as text."""
    rows = df.select(*keys, F.explode(metadata).alias("name", "_value"))
    return rows.select(*keys, "name", kind(F.col("_value")).alias("kind"), F.col("_value").cast("string").alias("value"))


def profile(df: DataFrame, by: list, metadata: Column) -> DataFrame:
    """Per group and name: rows that have it, and the one type that holds all its values."""
    rows = df.select(*by, F.explode(metadata).alias("name", "_value"))
    return rows.groupBy(*by, "name").agg(F.count(F.lit(1)).alias("n"), F.schema_of_variant_agg("_value").alias("type"))
