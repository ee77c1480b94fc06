"""Citations from files as they arrive in a folder: the RIS scan as a stream, and counts that are kept up to date."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import KEY_FIELDS, RIS_FIELDS
from ..sources import ris


def stream_ris(spark: SparkSession, folder: str, cite_label: str | None = None, cite_string: str | None = None, fields: Sequence[str] = KEY_FIELDS, files_per_batch: int = 100) -> DataFrame:
    """A stream of the records of RIS files with ER lines; a file's stem is its source.

    What needs a look at the whole file (which of several author or year tags it uses) isn't known to a stream: the first
    tag of the dictionary that a record has counts."""
    lines = spark.readStream.option("lineSep", "\nER").option("maxFilesPerTrigger", files_per_batch).text(folder)
    path = F.col("_metadata.file_path").alias("file")
    records = lines.select(path, F.regexp_replace("value", r"^\s*-\s*(?=\r|\n|$)", "").alias("record")).select("file", ris.entries(F.col("record")).alias("e")).where(F.size("e") > 1)
    names = F.create_map(*(F.lit(x) for kv in RIS_FIELDS.items() for x in kv))
    named = records.select("file", F.transform("e", lambda x: F.struct(F.coalesce(F.try_element_at(names, x.tag), x.tag).alias("field"), x.text.alias("text"))).alias("fields"))
    source = F.regexp_replace(F.regexp_extract("file", r"([^/]*)$", 1), r"\.[^.]*$", "")
    return named.select(*(ris.column_of(f).alias(f) for f in fields), source.alias("cite_source"), F.lit(cite_label).cast("string").alias("cite_label"), F.lit(cite_string).cast("string").alias("cite_string"))


def source_counts(records: DataFrame) -> DataFrame:
    """Records of each source and label so far; for output modes complete and update."""
    return records.groupBy("cite_source", "cite_label").agg(F.count("*").alias("records"))
