"""Who found what: uniqueness, comparison matrices, overlaps, set intersections, contributions."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.tags import UNKNOWN, exploded, tag_list
from ..schema import require

_COMPARE = {"sources": ("cite_source", "source__"), "strings": ("cite_string", "string__"), "labels": ("cite_label", "label__")}


def distinct_over(column: str, *keys: str) -> Column:
    """The number of distinct values of column among the rows with the same keys."""
    return F.size(F.collect_set(column).over(Window.partitionBy(*keys)))


def count_unique(unique: DataFrame, include_references: bool = False) -> DataFrame:
    """A row for each record and combination of its source, label and string. unique: the record has just one source."""
    require(unique, ["duplicate_id", "cite_source", "cite_label", "cite_string"])
    own = [c for c in ("duplicate_id", "cite_source", "cite_label", "cite_string", "record_ids") if c in unique.columns]
    rows = unique.where("cite_source <> ''").select(*own, F.size(F.array_distinct(tag_list("cite_source"))).alias("n"))
    rows = exploded(rows, "cite_source", "cite_label", "cite_string")
    alone = (F.max("n").over(Window.partitionBy("duplicate_id")) == 1) & (distinct_over("cite_source", "duplicate_id") == 1)
    out = rows.withColumn("unique", alone).drop("n").withColumn("type", F.when(F.col("unique"), "unique").otherwise("duplicated")).distinct()
    if include_references:
        out = out.join(unique.drop(*(c for c in unique.columns if c in out.columns and c != "duplicate_id")), "duplicate_id", "left")
    return out


def phase_types(unique: DataFrame) -> DataFrame:
    """As count_unique, but unique within the records of the same label."""
    rows = exploded(unique.where("cite_source <> ''").select("duplicate_id", "cite_source", "cite_label", "cite_string"), "cite_source", "cite_label", "cite_string")
    out = rows.withColumn("type", F.when(distinct_over("cite_source", "duplicate_id", "cite_label") == 1, "unique").otherwise("duplicated"))
    return out.select("duplicate_id", "cite_source", "cite_label", "type").distinct()


def tag_values(unique: DataFrame, column: str, limit: int = 10_000) -> list[str]:
    """Sorted items of a tag column, for a matrix with a column for each; more than limit are an error."""
    rows = unique.select(F.explode(tag_list(column)).alias("v")).distinct().orderBy("v").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{column} has more than {limit} values")
    return [r.v for r in rows]


def compare_sources(unique: DataFrame, comp_type: Sequence[str] | str = ("sources", "strings", "labels"), include_references: bool = False, values: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """duplicate_id and a boolean column for each source, string and label, named source__X, string__X and label__X.

    One pass over the lists: no row is exploded and no pivot is shuffled but for one line a record. values: the items of each
    comp_type, where they are known; else they are gathered first."""
    kinds = [comp_type] if isinstance(comp_type, str) else list(comp_type)
    if not kinds or any(k not in _COMPARE for k in kinds):
        raise ValueError(f"comp_type: {', '.join(_COMPARE)}")
    own = []
    for k in kinds:
        column, prefix = _COMPARE[k]
        require(unique, [column])
        for v in (values or {}).get(k) or tag_values(unique, column):
            own.append(F.max(F.coalesce(F.array_contains(tag_list(column), v), F.lit(False))).alias(f"{prefix}{v}"))
    out = unique.groupBy("duplicate_id").agg(*own) if own else unique.select("duplicate_id").distinct()
    if include_references:
        out = out.join(unique.drop(*(c for c in out.columns if c != "duplicate_id")), "duplicate_id", "left")
    return out


def outside_search(compared: DataFrame) -> int:
    """Records of compare_sources that aren't in the one label column whose name has "search" or "Search"; a warning tells of
    them, since a search stage should have all records. 0 without such a label, or with several."""
    stages = [c for c in compared.columns if c.startswith("label__") and ("search" in c or "Search" in c)]
    n = compared.where(~F.col(f"`{stages[0]}`")).count() if len(stages) == 1 else 0
    if n:
        label = stages[0].removeprefix("label__")
        warnings.warn(f"{n} records lack the label {label}, which others have; if it is that of all searches, a source or a merge may be missing", stacklevel=2)
    return n


def pairs_of(unique: DataFrame, column: str = "cite_source", facet: str | None = None) -> DataFrame:
    """duplicate_id and each of its items once."""
    rows = exploded(unique.select("duplicate_id", column, *([facet] if facet else [])), column, *([facet] if facet else []))
    return rows.where(F.col(column).isNotNull()).distinct()


def overlap(unique: DataFrame, column: str = "cite_source", facet: str | None = None, order: bool = False) -> DataFrame:
    """a, b, records (of both) and share (of those of a), for all pairs of items that meet; with a facet column, in each facet.

    A record's items are paired inside its own list, so rows are never joined with each other and no item gathers its
    records; the pairs are summed before the shuffle."""
    f = [facet] if facet else []
    per = pairs_of(unique, column, facet).groupBy("duplicate_id", *f).agg(F.array_sort(F.collect_set(column)).alias("items"))
    each = per.select(*f, F.explode("items").alias("a"), "items").select(*f, "a", F.explode("items").alias("b"))
    n = each.groupBy(*f, "a", "b").agg(F.count("*").alias("records"))
    own = F.max(F.when(F.col("a") == F.col("b"), F.col("records"))).over(Window.partitionBy(*f, "a"))
    out = n.withColumn("share", F.col("records") / own)
    return out.orderBy(*f, "a", "b") if order else out


def share_label(share: Column, diagonal: Column, records: Column) -> Column:
    """How a cell of the percentage matrix reads: counts on the diagonal, "< 1%" for what rounds to nothing."""
    percent = F.concat(F.round(share * 100, 0).cast("long").cast("string"), F.lit("%"))
    return F.when(diagonal, records.cast("string")).when((share > 0) & (share < 0.01), "< 1%").otherwise(percent)


def heatmap_data(unique: DataFrame, cells: str = "sources", facets: str | None = None, plot_type: str = "counts", sort_sources: bool = True) -> DataFrame:
    """The cells of an overlap heatmap: a, b, records, share, label; counts only for one triangle, by size of the items."""
    if plot_type not in ("counts", "percentages"):
        raise ValueError("plot_type: counts, percentages")
    facet = _COMPARE[facets][0] if facets else None
    f = [facet] if facet else []
    out = overlap(unique, _COMPARE[cells][0], facet)
    size = lambda c: F.max(F.when(F.col("a") == F.col("b"), F.col("records"))).over(Window.partitionBy(*f, c))
    out = out.withColumn("size_a", size("a")).withColumn("size_b", size("b"))
    key = lambda c: F.struct(F.col(f"size_{c}"), F.col(c)) if sort_sources else F.struct(F.col(c))
    if plot_type == "counts":
        return out.where(key("a") >= key("b")).select(*f, "a", "b", "records", F.col("records").cast("string").alias("label"))
    return out.select(*f, "a", "b", "records", "share", share_label(F.col("share"), F.col("a") == F.col("b"), F.col("records")).alias("label"))


def set_sizes(unique: DataFrame, column: str = "cite_source") -> DataFrame:
    return pairs_of(unique, column).groupBy(F.col(column).alias("item")).agg(F.count("*").alias("records"))


def set_intersections(unique: DataFrame, column: str = "cite_source", nsets: int | None = None, order_by: str = "freq", limit: int | None = None) -> DataFrame:
    """items (sorted, joined by &), degree and records found in just these. nsets: only the largest sets count."""
    rows = pairs_of(unique, column)
    if nsets is not None:
        largest = set_sizes(unique, column).orderBy(F.desc("records"), "item").limit(nsets)
        rows = rows.join(largest.select(F.col("item").alias(column)), column, "left_semi")
    per = rows.groupBy("duplicate_id").agg(F.array_sort(F.collect_set(column)).alias("items"))
    out = per.groupBy(F.array_join("items", "&").alias("items"), F.size("items").alias("degree")).agg(F.count("*").alias("records"))
    if limit is None:
        return out
    return out.orderBy(*([F.desc("records"), "degree"] if order_by == "freq" else ["degree", F.desc("records")]), "items").limit(limit)


def place(column: str, order: Sequence[str]) -> Column:
    """Where a value stands in order, from 1; what isn't listed comes after, all in one place."""
    at = F.lit(len(order) + 1)
    for k, value in reversed(list(enumerate(order, 1))):
        at = F.when(F.col(column) == value, k).otherwise(at)
    return at


def contributions(
    rows: DataFrame,
    facets: str | None = "cite_source",
    bars: str = "cite_label",
    color: str = "type",
    center: bool = False,
    first: str | None = None,
    bar_order: Sequence[str] = (),
    facet_order: Sequence[str] = (),
    color_order: Sequence[str] = (),
) -> DataFrame:
    """n for each facet, bar and colour; with center also signed_n, negative for the colour that isn't first, and the place
    of its label. Only two colours can be centered; the first one, unless named, leads color_order or is "unique".

    facets None is one facet. An order gives a column facet_place, bar_place or color_place: values listed come first, as
    listed, others follow by name; the result is sorted by them."""
    keys = [c for c in (facets, bars, color) if c]
    require(rows, keys)
    if center and rows.select(color).distinct().limit(3).count() > 2:
        raise ValueError("center needs two colours")
    first = first or next(iter(color_order), "unique")
    out, by = rows.groupBy(*keys).agg(F.count("*").alias("n")), []
    for name, column, order in (("facet_place", facets, facet_order), ("bar_place", bars, bar_order), ("color_place", color, color_order)):
        if column and order:
            out = out.withColumn(name, place(column, order))
            by += [name, column]
    out = _centered(out, color, first) if center else out
    return out.orderBy(*by) if by else out


def _centered(out: DataFrame, color: str, first: str) -> DataFrame:
    sign = F.when(F.col(color) == first, 1).otherwise(-1)
    most = F.max("n").over(Window.partitionBy())
    signed = out.withColumn("signed_n", sign * F.col("n"))
    return signed.withColumn("label_pos", F.when(F.abs("signed_n") * 10 < most, sign * most / 10).otherwise(F.col("signed_n") / 2))


def legend_totals(rows: DataFrame, color: str = "type") -> DataFrame:
    n = rows.groupBy(color).agg(F.count("*").alias("n"))
    return n.select(color, F.concat(F.col(color), F.lit("\n(N = "), F.format_number("n", 0), F.lit(")")).alias("legend"))


def without_unknown(df: DataFrame, column: str) -> DataFrame:
    """Rows whose item is neither null, empty nor "unknown"."""
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin("", UNKNOWN))
