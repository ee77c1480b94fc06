"""Provenance tags: lists in one string, separated by commas. All splitting happens here."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "unknown"


def tag_list(column: str | Column) -> Column:
    """Trimmed items that aren't empty, in order and with repeats; null stays null."""
    c = F.col(column) if isinstance(column, str) else column
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")


def exploded(df: DataFrame, *columns: str, repeats: bool = False) -> DataFrame:
    """A row for each combination of items of the columns, each item once, or as often as it stands there with repeats.
    Rows whose tag is null or empty keep one row, with null."""
    for c in columns:
        df = df.withColumn(c, F.explode_outer(tag_list(c) if repeats else F.array_distinct(tag_list(c))))
    return df


def joined(items: Column) -> Column:
    return F.array_join(items, ", ")


def label_filter(df: DataFrame, labels: Iterable[str] | None, column: str = "cite_label", literal: bool = False) -> DataFrame:
    """Rows whose whole label string has a match of any of the patterns, whatever the case; literal: of the plain words."""
    if not labels:
        return df
    return df.where(F.col(column).rlike("(?i)" + "|".join(re.escape(x) if literal else x for x in labels)))


def row_filter(df: DataFrame, **wanted: Iterable[str]) -> DataFrame:
    """Rows that have one of the wanted items in each tag column given; an empty choice is no restriction."""
    for column, items in wanted.items():
        items = list(items)
        if items:
            df = df.where(F.arrays_overlap(tag_list(column), F.array(*map(F.lit, items))))
    return df


def item_filter(df: DataFrame, drop_emptied: bool = False, **wanted: Iterable[str]) -> DataFrame:
    """Each tag column given with only its wanted items, each once. drop_emptied: leaves out rows without any item then."""
    chosen = {c: list(x) for c, x in wanted.items() if list(x)}
    for column, items in chosen.items():
        df = df.withColumn(column, joined(F.array_intersect(tag_list(column), F.array(*map(F.lit, items)))))
    if drop_emptied and chosen:
        some = F.lit(False)
        for column in chosen:
            some = some | (F.coalesce(F.col(column), F.lit("")) != "")
        df = df.where(some)
    return df


def choices(df: DataFrame, columns: Iterable[str], without_unknown: bool = False) -> DataFrame:
    """tag and value: the distinct items of each tag column."""
    out = None
    for c in columns:
        one = df.select(F.lit(c).alias("tag"), F.explode(tag_list(c)).alias("value")).distinct()
        out = one if out is None else out.unionByName(one)
    return out.where(F.col("value") != UNKNOWN) if without_unknown else out
