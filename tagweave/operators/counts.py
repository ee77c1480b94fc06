"""Record counts, summaries, precision and recall by source, each with a row for the total."""

from __future__ import annotations

import warnings
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.tags import UNKNOWN, exploded, label_filter, row_filter, tag_list
from ..schema import require

TOTAL = "Total"


def percent(share: Column) -> Column:
    """"12.3%"; null without a denominator. Rounded half up before it is written."""
    return F.when(share.isNotNull(), F.concat(F.format_string("%.1f", F.round(share * 100, 1)), F.lit("%")))


def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def count_sources(df: DataFrame, column: str) -> DataFrame:
    """source and the number of rows that have it; a row that has it twice counts once."""
    return df.select(F.explode(F.array_distinct(tag_list(column))).alias("Source")).groupBy("Source").agg(F.count("*").alias("n"))


def _sum(c: str) -> Column:
    return F.sum(c).cast("long").alias(c)


def _with_total(rows: DataFrame, total: DataFrame) -> DataFrame:
    return rows.unionByName(total.withColumn("Source", F.lit(TOTAL)), allowMissingColumns=True)


def record_counts(unique: DataFrame, citations: DataFrame, column: str = "cite_source") -> DataFrame:
    """Source, Records_Imported (of the raw citations), Distinct_Records, and their sums."""
    raw = count_sources(citations, column).withColumnRenamed("n", "Records_Imported")
    own = count_sources(unique, column).withColumnRenamed("n", "Distinct_Records")
    rows = raw.join(own, "Source", "left")
    return _with_total(rows, rows.agg(_sum("Records_Imported"), _sum("Distinct_Records")))


def _summary(rows: DataFrame, n_distinct: DataFrame) -> DataFrame:
    """Shares of Distinct_Records and Unique_Records; the total has the number of records where sources would overlap."""
    every = Window.partitionBy()
    rows = rows.withColumn("Nonunique_Records", F.col("Distinct_Records") - F.col("Unique_Records"))
    rows = rows.withColumns(
        {
            "Source_Contribution": percent(ratio(F.col("Distinct_Records"), F.sum("Distinct_Records").over(every))),
            "Source_Unique_Contribution": percent(ratio(F.col("Unique_Records"), F.sum("Unique_Records").over(every))),
            "Source_Unique": percent(ratio(F.col("Unique_Records"), F.col("Distinct_Records"))),
        }
    )
    sums = rows.agg(_sum("Records_Imported"), _sum("Unique_Records"), _sum("Nonunique_Records")).crossJoin(n_distinct)
    return _with_total(rows, sums)


def record_summary(unique: DataFrame, citations: DataFrame, n_unique: DataFrame, column: str = "cite_source", compat: bool = False) -> DataFrame:
    """record_counts, and how many records of label "search" only one source has. compat: counts rows of n_unique, so that a
    record with two strings counts twice; else records."""
    one = F.sum(F.col("unique").cast("long")) if compat else F.countDistinct(F.when(F.col("unique"), F.col("duplicate_id")))
    alone = n_unique.where("cite_label = 'search'").groupBy(F.col("cite_source").alias("Source")).agg(one.alias("Unique_Records"))
    rows = count_sources(citations, column).withColumnRenamed("n", "Records_Imported")
    rows = rows.join(count_sources(unique, column).withColumnRenamed("n", "Distinct_Records"), "Source", "left").join(alone, "Source", "left")
    rows = rows.na.fill(0, ["Distinct_Records", "Unique_Records"])
    return _summary(rows, unique.agg(F.count("*").alias("Distinct_Records")))


def initial_records(unique: DataFrame, labels: Iterable[str] | None = None) -> DataFrame:
    """Source, Records_Imported and Distinct_Records, from the merged tags alone; only of records with one of the labels."""
    require(unique, ["duplicate_id", "cite_source", "cite_label"])
    rows = _by_source(label_filter(unique, labels))
    return _with_total(rows, rows.agg(_sum("Records_Imported"), _sum("Distinct_Records")).where("Records_Imported is not null"))


def _by_source(unique: DataFrame) -> DataFrame:
    each = exploded(unique.select("duplicate_id", "cite_source"), "cite_source", repeats=True).where("cite_source is not null")
    return each.groupBy(F.col("cite_source").alias("Source")).agg(F.count("*").alias("Records_Imported"), F.countDistinct("duplicate_id").alias("Distinct_Records"))


def detailed_records(unique: DataFrame, n_unique: DataFrame, labels: Iterable[str] | None = None, compat: bool = False) -> DataFrame:
    """initial_records with the columns of record_summary; the total's Distinct_Records are all records, whatever their label."""
    require(unique, ["duplicate_id", "cite_source", "cite_label"])
    rows = _by_source(label_filter(unique, labels))
    one = F.sum(F.col("unique").cast("long")) if compat else F.countDistinct(F.when(F.col("unique"), F.col("duplicate_id")))
    alone = label_filter(n_unique, labels).groupBy(F.col("cite_source").alias("Source")).agg(one.alias("Unique_Records"))
    rows = rows.join(alone, "Source", "left").na.fill(0, ["Unique_Records"])
    return _summary(rows, unique.agg(F.count("*").alias("Distinct_Records"))).where("Records_Imported is not null")


def filtered_detailed_records(unique: DataFrame, sources: Iterable[str] = (), labels: Iterable[str] = (), strings: Iterable[str] = ()) -> DataFrame:
    """detailed_records of a choice of sources, labels and strings: unique is what only one of the chosen sources has."""
    chosen = list(sources)
    rows = row_filter(unique, cite_label=labels, cite_string=strings)
    each = exploded(rows.select("duplicate_id", "cite_source"), "cite_source", repeats=True).where("cite_source is not null")
    if chosen:
        each = each.where(F.col("cite_source").isin(chosen))
    each = each.withColumn("alone", F.size(F.collect_set("cite_source").over(Window.partitionBy("duplicate_id"))) == 1)
    own = each.groupBy(F.col("cite_source").alias("Source")).agg(
        F.count("*").alias("Records_Imported"), F.countDistinct("duplicate_id").alias("Distinct_Records"), F.countDistinct(F.when(F.col("alone"), F.col("duplicate_id"))).alias("Unique_Records")
    )
    return _summary(own, each.agg(F.countDistinct("duplicate_id").alias("Distinct_Records"))).where("Records_Imported is not null")


def _rates(rows: DataFrame, total_final: Column) -> DataFrame:
    rate = lambda a, b: F.when(b > 0, F.round(a / b * 100, 2)).otherwise(F.lit(0.0))
    return rows.withColumn("Precision", rate(F.col("final"), F.col("Distinct_Records"))).withColumn("Recall", rate(F.col("final"), total_final))


def absent_phases(unique: DataFrame, phases: Iterable[str] = ("screened", "final")) -> list[str]:
    """The phases that no record is labelled with, whatever the case of letters; a warning names them."""
    own, wanted = F.transform(tag_list("cite_label"), F.lower), list(phases)
    found = unique.agg(*(F.max(F.coalesce(F.array_contains(own, p), F.lit(False))).alias(f"p{i}") for i, p in enumerate(wanted))).first()
    absent = [p for p, there in zip(wanted, found, strict=True) if not there]
    if absent:
        warnings.warn(f"no record has the label {' or '.join(absent)}", stacklevel=2)
    return absent


def phase_count(unique: DataFrame, citations: DataFrame, column: str = "cite_source") -> DataFrame:
    """Source, Distinct_Records, screened, final, Precision and Recall, against the raw citations labelled final."""
    each = exploded(unique.select("duplicate_id", column, F.lower("cite_label").alias("cite_label")), column, "cite_label").where(f"{column} is not null and {column} <> '{UNKNOWN}'").distinct()
    phase = lambda p: F.countDistinct(F.when(F.col("cite_label") == p, F.col("duplicate_id"))).alias(p)
    rows = each.groupBy(F.col(column).alias("Source")).agg(F.countDistinct("duplicate_id").alias("Distinct_Records"), phase("screened"), phase("final"))
    raw = citations.agg(*(F.coalesce(F.sum((F.lower("cite_label") == p).cast("long")), F.lit(0)).alias(f"raw_{p}") for p in ("screened", "final")))
    rows = _rates(rows.crossJoin(raw), F.col("raw_final")).drop("raw_screened", "raw_final")
    total = rows.agg(_sum("Distinct_Records")).crossJoin(raw).select("Distinct_Records", F.col("raw_screened").alias("screened"), F.col("raw_final").alias("final"))
    total = total.where("Distinct_Records is not null").withColumn("Precision", F.when(F.col("Distinct_Records") > 0, F.round(F.col("final") / F.col("Distinct_Records") * 100, 2)))
    return _with_total(rows, total)


def phase_records(unique: DataFrame, n_unique: DataFrame | None = None, column: str = "cite_source") -> DataFrame:
    """As phase_count, but all from the merged records; the total counts records, also those that no source has.
    n_unique isn't used."""
    labels = F.transform(tag_list("cite_label"), F.lower)
    flags = unique.select("duplicate_id", column, *(F.coalesce(F.array_contains(labels, p), F.lit(False)).alias(p) for p in ("screened", "final")))
    count = lambda p: F.countDistinct(F.when(F.col(p), F.col("duplicate_id"))).alias(p)
    total = flags.agg(F.countDistinct("duplicate_id").alias("Distinct_Records"), count("screened"), count("final"))
    each = exploded(flags, column).where(f"{column} is not null and {column} <> '{UNKNOWN}'")
    rows = each.groupBy(F.col(column).alias("Source")).agg(F.countDistinct("duplicate_id").alias("Distinct_Records"), count("screened"), count("final"))
    rows = _rates(rows.crossJoin(total.select(F.col("final").alias("all_final"))), F.col("all_final")).drop("all_final")
    total = total.withColumn("Precision", F.when(F.col("Distinct_Records") > 0, F.round(F.col("final") / F.col("Distinct_Records") * 100, 2)).otherwise(F.lit(0.0)))
    return _with_total(rows, total)


def citation_summary(unique: DataFrame, comparison_type: str = "sources", search_label: str | Iterable[str] = "search", screening_label: str | Iterable[str] = "final", top_n: int | None = None) -> DataFrame:
    """stage, item, Records_total, Records_unique, Contribution_unique, Sensitivity and Precision for the search and each
    screening stage, with a total a stage. top_n: only the items with the most records found in the search, and the totals;
    figures are of all items."""
    if comparison_type not in ("sources", "strings"):
        raise ValueError("comparison_type: sources, strings")
    column = {"sources": "cite_source", "strings": "cite_string"}[comparison_type]
    as_list = lambda x: [x] if isinstance(x, str) else list(x)
    search, screening = as_list(search_label), as_list(screening_label)
    rows = exploded(unique.select("duplicate_id", column, "cite_label"), "cite_label", column)
    rows = rows.withColumn("stage", F.when(F.col("cite_label").isin(search), "search").otherwise(F.col("cite_label")))
    rows = rows.where(F.col("stage").isin("search", *screening)).select("duplicate_id", "stage", F.col(column).alias("item")).distinct()
    rows = rows.withColumn("alone", (F.size(F.collect_set("item").over(Window.partitionBy("duplicate_id", "stage"))) == 1) & F.col("item").isNotNull())
    items = rows.where("item is not null").groupBy("stage", "item").agg(F.count("*").alias("Records_total"), F.sum(F.col("alone").cast("long")).alias("Records_unique"))
    totals = rows.groupBy("stage").agg(F.countDistinct("duplicate_id").alias("Records_total"), F.sum(F.col("alone").cast("long")).alias("Records_unique")).withColumn("item", F.lit(TOTAL))
    out = items.unionByName(totals)
    stage_total = F.max(F.when(F.col("item") == TOTAL, F.col("Records_total"))).over(Window.partitionBy("stage"))
    found = F.max(F.when(F.col("stage") == "search", F.col("Records_total"))).over(Window.partitionBy("item"))
    out = out.select(
        "stage",
        "item",
        "Records_total",
        "Records_unique",
        (F.col("Records_unique") / stage_total).alias("Contribution_unique"),
        F.when(F.col("item") != TOTAL, F.col("Records_total") / stage_total).alias("Sensitivity"),
        F.when(F.col("stage") != "search", F.col("Records_total") / found).alias("Precision"),
    )
    if top_n is None:
        return out
    best = items.where("stage = 'search'").orderBy(F.desc("Records_total"), "item").limit(top_n).select("item")
    return out.join(best.unionByName(out.where(F.col("item") == TOTAL).select("item").distinct()), "item", "left_semi")


def import_summary(citations: DataFrame) -> DataFrame:
    """Records of each source of an upload."""
    return citations.groupBy("cite_source").agg(F.count("*").alias("records"))


def share_within(df: DataFrame, key: str, value: str) -> DataFrame:
    """n of each key and value, and its share of the key's rows."""
    n = df.groupBy(key, value).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(key)))


def top_values(df: DataFrame, value: str, n: int = 10) -> DataFrame:
    """The n most frequent values; ties by value."""
    return df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n")).orderBy(F.desc("n"), value).limit(n)
