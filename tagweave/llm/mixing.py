"""Mixing sources to target weights by hash-random order, prefix sums and an exact cut; DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, written

WEIGHTS = (5, 2, 1)
#: No source gives more than so many times its size.
EPOCHS = 3
#: Ranges of the random key in each source. A range is what one task sorts: a third of 3e10 rows is 2.4 million in each.
RANGES = 4096
SEED = "mix-1"
_KEYS = ["__null", "__source"]


def size_of(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """sizes (__null, __source, __total) with __target: sources by code point, null last, weigh weights in turn and share
    the sum of all totals; a target stops at epochs times its total, and the others share what is over by weight.

    By cap for each unit of weight, a source is capped if its cap is below its share of what the ones before it leave; the
    rest share what is left. Sums are whole numbers, so only the last division rounds. One row a source, in one task."""
    by_name, by_ratio = Window.orderBy(*_KEYS), Window.orderBy("__ratio", *_KEYS)
    before, whole = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    turn = F.element_at(F.array(*(F.lit(w).cast("long") for w in weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    big = "decimal(38,0)"
    d = sizes.withColumn("__weight", turn).withColumn("__cap", (F.col("__total") * epochs).cast("long")).withColumn("__ratio", F.col("__cap") / F.col("__weight"))
    d = d.select(
        "*",
        (F.sum("__total").over(whole) - F.coalesce(F.sum("__cap").over(before), F.lit(0))).cast(big).alias("__left"),
        (F.sum("__weight").over(whole) - F.coalesce(F.sum("__weight").over(before), F.lit(0))).cast("long").alias("__weights"),
    )
    capped = (F.col("__cap").cast("decimal(20,0)") * F.col("__weights").cast("decimal(18,0)")) < (F.col("__left").cast("decimal(20,0)") * F.col("__weight").cast("decimal(18,0)"))
    d = d.withColumn("__capped", capped)
    rest = F.sum("__total").over(whole) - F.sum(F.when(F.col("__capped"), F.col("__cap")).otherwise(0)).over(whole)
    share = F.sum(F.when(F.col("__capped"), 0).otherwise(F.col("__weight"))).over(whole)
    target = F.when(F.col("__capped"), F.col("__cap").cast("double")).otherwise((rest * F.col("__weight")).cast("double") / share.cast("double"))
    return d.select(*_KEYS, "__total", F.when(F.col("__total") == 0, 0.0).otherwise(target).alias("__target"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, epochs: int = EPOCHS, ranges: int = RANGES, seed: str = SEED, row: Sequence[str] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, copies and part of each row, and the columns named in row: the mix
    has copies whole copies of the text and then its first part words (taken = copies * size + part).

    Rows of a source stand in the order of a random key, a hash of seed and doc_id (ties: doc_id, size). The mix repeats the
    source in this order, and the word at which the whole part of its target is reached is the last. Null ids hash as empty;
    null and empty texts have size 0 and are never taken; rows that are equal in doc_id, source and size may swap their
    places. No rows give no rows. Other columns are left out.

    A source is cut into ranges of the key: sums by range, a prefix sum over the ranges of a source and one in each range
    give each row's place, so no task holds more than a range or one row for each range of a source."""
    key = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")
    slim = written(
        docs.select("doc_id", "source", *row, F.col("source").isNull().alias("__null"), F.coalesce("source", F.lit("")).alias("__source"), size_of(F.col("text")).alias("size"), key.alias("__key")).withColumn(
            "__range", F.expr(f"cast(__key div {2**60 // ranges} as int)")
        ),
        "mix",
    )
    cells = slim.groupBy(*_KEYS, "__range").agg(F.sum("size").alias("__words"))
    targets = source_targets(cells.groupBy(*_KEYS).agg(F.sum("__words").alias("__total")), weights, epochs)
    upto = Window.partitionBy(*_KEYS).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("__before", F.coalesce(F.sum("__words").over(upto), F.lit(0))).drop("__words").join(targets, _KEYS)
    inside = Window.partitionBy(*_KEYS, "__range").orderBy("__key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = slim.withColumn("__in", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(cells, [*_KEYS, "__range"])
    budget = F.floor("__target").cast("long")
    whole = F.when(F.col("__total") > 0, F.expr("cast(floor(__target) as bigint) div __total")).otherwise(F.lit(0))
    left = budget - F.col("__copies") * F.col("__total") - F.col("__before") - F.col("__in")
    cut = F.greatest(F.lit(0), F.least(F.col("size"), left))
    placed = placed.withColumn("__copies", whole).withColumn("__cut", cut)
    return placed.select(
        *row,
        "doc_id",
        "source",
        "size",
        F.col("__total").alias("source_size"),
        F.col("__target").alias("target"),
        (F.col("__copies") * F.col("size") + F.col("__cut")).cast("long").alias("taken"),
        F.when(F.col("size") == 0, 0).otherwise(F.col("__copies") + (F.col("__cut") == F.col("size")).cast("long")).cast("long").alias("copies"),
        F.when(F.col("__cut") == F.col("size"), 0).otherwise(F.col("__cut")).cast("long").alias("part"),
    )


def mixture(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: rows of docs with all their columns, as often as they are taken. The row in which a source's target is
    reached comes last with the first words of its text alone, joined by spaces, and n_chars, if there, tells their length.

    docs must be a stored table, which gives the same row numbers in both scans; rows with the same doc_id stay apart. Null and
    empty texts are never taken; no rows give no rows; further columns keep their values, whatever their names (but __row)."""
    names = docs.columns
    inner = {c: f"__c{i}" for i, c in enumerate(names)}  # no name of docs can clash with those of the mix
    numbered = docs.withColumn("__row", F.monotonically_increasing_id())
    wanted = mix(numbered, row=["__row"], **options).where("copies > 0 or part > 0").select("__row", "copies", "part")
    rows = numbered.select("__row", *(F.col(f"`{c}`").alias(inner[c]) for c in names))
    each = rows.join(wanted, "__row").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.expr("cast(copies + if(part > 0, 1, 0) as int)"))))
    cut, text = F.col("__copy") > F.col("copies"), F.col(inner["text"])
    some = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)), 1, F.col("part").cast("int")), " ")
    each = each.withColumn(inner["text"], F.when(cut, some).otherwise(text))
    if "n_chars" in names:
        own = F.col(inner["n_chars"])
        each = each.withColumn(inner["n_chars"], F.when(cut, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(own))
    return each.select(*(F.col(inner[c]).alias(c) for c in names))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


def mix_sql(documents: str = "documents", weights: Sequence[int] = WEIGHTS, epochs: int = EPOCHS, seed: str = SEED) -> str:
    """The same rows in DuckDB's SQL, by one running sum over each source."""
    turns = " ".join(f"WHEN {k} THEN {w}" for k, w in enumerate(weights))
    return f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
         substr(md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS k
  FROM {documents}),
s AS (SELECT source, sum(size)::HUGEINT AS total FROM d GROUP BY source),
w AS (SELECT *, total * {epochs} AS cap,
             CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % {len(weights)} {turns} END::HUGEINT AS weight FROM s),
r AS (SELECT *, row_number() OVER (ORDER BY cap::DOUBLE / weight, source IS NULL, source) AS n FROM w),
l AS (SELECT *, sum(total) OVER () - coalesce(sum(cap) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining,
             sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weights FROM r),
c AS (SELECT *, cap * weights < remaining * weight AS capped FROM l),
t AS (SELECT source, total, CASE WHEN total = 0 THEN 0.0 WHEN capped THEN cap::DOUBLE ELSE
        ((sum(total) OVER () - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ()) * weight)::DOUBLE
        / (sum(CASE WHEN capped THEN 0 ELSE weight END) OVER ())::DOUBLE END AS target FROM c),
p AS (SELECT d.*, total, target, CASE WHEN total > 0 THEN floor(target)::BIGINT // total::BIGINT ELSE 0 END AS copies,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, total::BIGINT AS source_size, target::DOUBLE AS target,
       (copies * size + greatest(0, least(size, floor(target)::BIGINT - copies * total - before)))::BIGINT AS taken
FROM p"""
