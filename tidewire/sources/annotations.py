"""Annotation responses: JSON text, sometimes fenced, cut off or broken, as typed columns."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.functions.text import fence_strip


def _last_json(text: str) -> str | None:
    """The last object or array in a text that parses, as JSON; of a truncated array its complete items."""
    decoder, best = json.JSONDecoder(), None
    at = 0
    while at < len(text):
        nexts = [p for p in (text.find("{", at), text.find("[", at)) if p >= 0]
        if not nexts:
            break
        at = min(nexts)
        try:
            best, at = decoder.raw_decode(text, at)
        except ValueError:
            if text[at] == "[" and best is None:
                items, k = [], at + 1
                while True:
                    while k < len(text) and text[k] in ", \n\r\t":
                        k += 1
                    try:
                        item, k = decoder.raw_decode(text, k)
                    except ValueError:
                        break
                    items.append(item)
                if items:
                    return json.dumps(items)
            at += 1
    return None if best is None else json.dumps(best)


@F.pandas_udf(T.StringType())
def recover_json(values: pd.Series) -> pd.Series:
    """Repair of responses that do not parse; applied to those rows only."""
    return values.map(lambda t: None if t is None else _last_json(t), na_action="ignore")


def partial_field(text: Column, name: str) -> Column:
    """A string field of broken JSON."""
    return F.nullif(F.regexp_extract(text, rf'"{name}"\s*:\s*"((?:[^"\\]|\\.)*)"', 1), F.lit(""))


def parse_annotations(df: DataFrame, column: str, kind: str) -> DataFrame:
    """Add ``parsed`` (of ``kind``) and ``parse_error``; text that parses never leaves the JVM."""
    text = fence_strip(column)
    ok = F.try_parse_json(text).isNotNull()
    good = df.where(ok).withColumn("parsed", F.from_json(text, kind))
    rest = df.where(~F.coalesce(ok, F.lit(False))).withColumn("parsed", F.from_json(recover_json(F.coalesce(text, F.lit(""))), kind))
    return good.unionByName(rest).withColumn("parse_error", F.col("parsed").isNull())


def split_batches(df: DataFrame, column: str) -> DataFrame:
    """One response keyed article_0, article_1, ... as a row (batch, place, scores) per article; a bad one has none."""
    parsed = F.from_json(column, "map<string,map<string,double>>")
    rows = df.select("batch", F.explode(parsed).alias("k", "scores"))
    return rows.select("batch", F.regexp_extract("k", r"^article_(\d+)$", 1).try_cast("int").alias("place"), "scores").where("place IS NOT NULL")
