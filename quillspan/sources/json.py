"""JSON of unknown shape: strings under given keys at any depth, and the object that prose holds."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillspan.workspace import materialize

# Keys whose strings are visible text, and keys whose strings are addresses.
COLLECTED = {"text": ("text", "answer", "content", "title", "snippet"), "url": ("url", "source_url", "link")}


def collect_strings(rows: DataFrame, key: str, body: str, wanted: dict[str, tuple[str, ...]] = COLLECTED) -> DataFrame:
    """(key, kind, at, value) of every string under a wanted key, at any depth of the JSON text in ``body``.

    ``at`` are the positions on the way to it, so that ordering by it is document
    order up to the order of keys.  Bodies are parsed once, into variants, and
    taken apart a level at a time until no object or list is left: rows go
    through as many rounds as the deepest of them has levels, and nothing
    shuffles.  A value counts only if it is a string itself; strings that stand
    in a list have no key.  What does not parse, and null, has none.
    """
    kinds = F.create_map(*(F.lit(x) for kind, names in wanted.items() for name in names for x in (name, kind)))
    level = rows.select(F.col(key).alias("id"), F.expr("cast(array() as array<int>)").alias("at"), F.try_parse_json(F.col(body).cast("string")).alias("v"))
    found = None
    while True:
        parts = rows.sparkSession.sql("SELECT id, concat(at, array(pos)) AS at, key, value, schema_of_variant(value) AS shape FROM {level}, LATERAL variant_explode(v)", level=level)
        parts = materialize(parts.withColumn("value", F.col("value").cast("variant")), "json-level")
        strings = parts.filter("shape = 'STRING'").select("id", kinds[F.col("key")].alias("kind"), "at", F.col("value").cast("string").alias("value")).filter("kind IS NOT NULL")
        found = strings if found is None else found.unionByName(strings)
        level = parts.filter("shape LIKE 'OBJECT%' OR shape LIKE 'ARRAY%'").select("id", "at", F.col("value").alias("v"))
        if level.isEmpty():
            return found.withColumnRenamed("id", key)


def first_object(text: str | None) -> str | None:
    """The first part of a text that is a JSON object: every opening brace is tried, braces inside strings and stray ones do no harm."""
    decoder = json.JSONDecoder()
    at = text.find("{") if text else -1
    while at >= 0:
        try:
            return text[at : decoder.raw_decode(text, at)[1]]
        except (ValueError, RecursionError):
            at = text.find("{", at + 1)
    return None


@F.pandas_udf(StringType())
def _first_objects(texts: pd.Series) -> pd.Series:
    return texts.map(first_object, na_action="ignore")


def json_in_prose(text: Column, schema: str) -> Column:
    """The object in a fenced block if one parses, else the first balanced object anywhere; null when there is none."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    body = F.when(F.get_json_object(fenced, "$").isNotNull() & (fenced != ""), fenced).otherwise(_first_objects(text))
    return F.from_json(body, schema)
