"""Exports of unique citations: CSV, RIS and BibTeX."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tags import tag_list
from ..operators.analyze import tag_values
from ..schema import RIS_FIELDS

_SEPARATE = {"cite_source": "source_", "cite_label": "label_", "cite_string": "string_"}


def separated(unique: DataFrame, columns: Sequence[str], values: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """unique with a boolean column for each item of the tag columns, in place of these."""
    out = unique
    for c in columns:
        for v in (values or {}).get(c) or tag_values(unique, c):
            out = out.withColumn(f"{_SEPARATE[c]}{v}", F.coalesce(F.array_contains(tag_list(c), v), F.lit(False)))
        out = out.drop(c)
    return out


def csv_frame(unique: DataFrame, separate: Sequence[str] = (), trim_abstracts: int | None = 32000, values: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    out = separated(unique, separate, values)
    if trim_abstracts is not None and "abstract" in out.columns:
        out = out.withColumn("abstract", F.substring("abstract", 1, trim_abstracts))
    return out


def export_csv(unique: DataFrame, path: str, separate: Sequence[str] = (), trim_abstracts: int | None = 32000) -> None:
    """A folder of CSV parts with headers. Only what is exported without separate can be read again."""
    csv_frame(unique, separate, trim_abstracts).write.csv(path, header=True, quote='"', escape='"', mode="error", emptyValue="")


def bib_note(unique: DataFrame, include: Sequence[str] = ("sources", "labels", "strings")) -> DataFrame:
    """unique with a note of its tags, in place of these and of identifiers."""
    parts = [F.concat(F.lit(f"cite_{k[:-1]}: "), F.coalesce(F.col(f"cite_{k[:-1]}"), F.lit(""))) for k in include]
    out = unique.withColumn("note", F.concat_ws("; ", *parts)) if parts else unique
    return out.drop("cite_source", "cite_label", "cite_string", "duplicate_id", "record_ids", "record_id")


def bib_entries(df: DataFrame) -> DataFrame:
    """value: the BibTeX text of each row, an article with the number of the row for a key."""
    from ..operators.numbering import numbered

    own = [c for c in df.columns if c not in ("type", "ID")]
    lines = F.filter(F.array(*(F.concat(F.lit(f"  {c}={{"), F.nullif(F.col(f"`{c}`").cast("string"), F.lit("")), F.lit("}")) for c in own)), lambda x: x.isNotNull())
    return numbered(df, "__n").select(F.concat(F.lit("@ARTICLE{"), F.col("__n"), F.lit(",\n"), F.array_join(lines, ",\n"), F.lit("\n}\n")).alias("value"))


def export_bib(unique: DataFrame, path: str, include: Sequence[str] = ("sources", "labels", "strings")) -> None:
    bib_entries(bib_note(unique, include)).write.text(path)


def ris_codes(source_field: str = "DB", label_field: str = "C7", string_field: str = "C8") -> dict[str, str]:
    """Field to code, in the order in which they are written; the first code of a field counts."""
    own = {"type": "TY", "cite_source": source_field, "cite_string": string_field, "cite_label": label_field, "duplicate_id": "C1", "record_ids": "C2"}
    taken = set(own.values())
    for code, field in RIS_FIELDS.items():
        if field not in own and code not in taken and code not in ("SP", "EP", "ER"):
            own[field] = code
    return own


def _coded(code: str, values: Column) -> Column:
    return F.transform(values, lambda x: F.concat(F.lit(f"{code}  - "), x))


def ris_lines(df: DataFrame, codes: Mapping[str, str] | None = None) -> Column:
    """array of lines of a row's record. Authors and keywords have a line each; pages a-b are two; other lines are one."""
    codes = codes or ris_codes()
    parts = [F.array(F.concat(F.lit("TY  - "), F.coalesce(F.nullif(F.col("type"), F.lit("")), F.lit("JOUR")) if "type" in df.columns else F.lit("JOUR")))]
    for field, code in codes.items():
        if field in df.columns and field != "type":
            value = F.nullif(F.regexp_replace(F.col(f"`{field}`").cast("string"), r"[\r\n]+", " "), F.lit(""))
            each = F.split(value, " and ") if field in ("author", "keywords") else F.array(value)
            parts.append(_coded(code, F.filter(each, lambda x: x.isNotNull())))
    if "pages" in df.columns:
        ends = F.split(F.nullif(F.col("pages"), F.lit("")), "-")
        parts.append(F.transform(F.slice(ends, 1, 2), lambda x, i: F.concat(F.when(i == 0, "SP  - ").otherwise("EP  - "), F.trim(x))))
    parts.append(F.array(F.lit("ER  - "), F.lit("")))
    return F.concat(*(F.coalesce(p, F.array().cast("array<string>")) for p in parts))


def export_ris(unique: DataFrame, path: str, source_field: str = "DB", label_field: str = "C7", string_field: str = "C8") -> None:
    """A folder of RIS parts. The default label code C7 is one that some databases use themselves."""
    unique.select(F.array_join(ris_lines(unique, ris_codes(source_field, label_field, string_field)), "\n").alias("value")).write.text(path)


def as_text(unique: DataFrame, kind: str = "ris") -> DataFrame:
    """value: the text of each record, without a file."""
    if kind == "ris":
        return unique.select(F.array_join(ris_lines(unique), "\n").alias("value"))
    if kind == "bib":
        return bib_entries(unique)
    raise ValueError("kind: ris, bib")
