"""Edits of provenance tags after the import."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import TAGS


def edit_tags(citations: DataFrame, edits: Mapping[str, Mapping[str, str]], key: str = "cite_source") -> DataFrame:
    """citations with new tags where key has one of the values of edits ({value: {tag: new}}); "" becomes null.

    Edits come from a person's hand, so they are written into the plan. All see the old values of key."""
    out = {}
    for tag in TAGS:
        new = {value: e[tag] for value, e in edits.items() if tag in e}
        if any("," in x for x in new.values()):
            raise ValueError(f"{tag}: no commas, which part the items of a list")
        if new:
            column = F.col(tag)
            for value, x in new.items():
                column = F.when(F.col(key) == value, F.nullif(F.lit(x), F.lit(""))).otherwise(column)
            out[tag] = column
    if unknown := {t for e in edits.values() for t in e} - set(TAGS):
        raise ValueError(f"not a tag: {', '.join(sorted(unknown))}")
    return citations.withColumns(out)


def pair_view(pairs: DataFrame) -> DataFrame:
    """Doubtful pairs for a reader: both values of each field side by side, then the similarities."""
    sides = [c for c in pairs.columns if c[-1] in "12"]
    fields = list(dict.fromkeys(c[:-1] for c in sides))
    both = [f"{f}{i}" for f in fields for i in (1, 2) if f"{f}{i}" in sides]
    return pairs.select(*both, *(c for c in pairs.columns if c not in sides))
