"""BibTeX files, an entry a row."""

from __future__ import annotations

from collections.abc import Iterable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def entries(text: Column) -> Column:
    """The entries of a file's text; lines that begin with % are comments."""
    plain = F.regexp_replace(F.regexp_replace(text, "^﻿", ""), r"(?m)^%[^\r\n]*", "")
    return F.filter(F.split(plain, r"(?m)^\s*@(?=\w+\s*\{)"), lambda x: x.rlike(r"^\w+\s*\{[\s\S]*="))


def fields(entry: Column) -> Column:
    """array of (field, text): type, key and each tag = {value}, "value" or number, in lower case; values may go over lines."""
    tags = F.regexp_extract_all(entry, F.lit(r"(?m)^\s*([A-Za-z][\w-]*)\s*=\s*[\s\S]*?(?=,?\s*(?:[\r\n]+\s*[A-Za-z][\w-]*\s*=|\}?\s*$(?![\s\S])))"), F.lit(1))
    bodies = F.regexp_extract_all(entry, F.lit(r"(?m)^\s*[A-Za-z][\w-]*\s*=\s*([\s\S]*?)(?=,?\s*(?:[\r\n]+\s*[A-Za-z][\w-]*\s*=|\}?\s*$(?![\s\S])))"), F.lit(1))
    clean = lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.trim(x), r'^[{"]+|[}"]+,?$|,$', ""), r"\s+", " "))
    body = F.zip_with(tags, bodies, lambda t, b: F.struct(F.lower(t).alias("field"), clean(b).alias("text")))
    head = F.array(
        F.struct(F.lit("type").alias("field"), F.lower(F.regexp_extract(entry, r"^(\w+)", 1)).alias("text")),
        F.struct(F.lit("ID").alias("field"), F.trim(F.regexp_extract(entry, r"^\w+\s*\{\s*([^,\s]*)", 1)).alias("text")),
    )
    return F.filter(F.concat(head, body), lambda x: x.text != "")


def records_of(spark: SparkSession, files: Iterable[str]) -> DataFrame:
    """file and fields of each entry with more than type and key.

    Spark cuts files where a line begins with @, so a large file is read by many tasks and no row is larger than an entry.
    A file with such a line, or a beginning, that no entry starts with is read whole."""
    files, path = list(files), F.col("_metadata.file_path").alias("file")
    cut = spark.read.text(files, lineSep="\n@").select("value", path)
    head = r"^\x{FEFF}?\s*@?\w+\s*\{"
    odd = [r.file for r in cut.where(~F.col("value").rlike(head) & (F.trim("value") != "")).select("file").distinct().collect()]  # a row a file at most
    start = F.when(F.col("value").rlike(r"^\w"), F.concat(F.lit("@"), F.col("value"))).otherwise(F.col("value"))
    rows = cut.join(F.broadcast(spark.createDataFrame([(f,) for f in odd], "file string")), "file", "left_anti").select("file", F.explode(entries(start)).alias("entry"))
    if odd:
        rows = rows.union(spark.read.text([unquote(f) for f in odd], wholetext=True).select(path, F.explode(entries(F.col("value"))).alias("entry")))
    return rows.select("file", fields(F.col("entry")).alias("fields")).where(F.size("fields") > 2)
