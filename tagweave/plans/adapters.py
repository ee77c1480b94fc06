"""The driver's tables as citations.

DOC: documents are the records of a search; those with a label were screened, those of good quality are final. Texts are
what duplicates share. PART: line items are records, parts are entities, suppliers' nations are sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PHASE = {"F": "final", "O": "search", "P": "screened"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_id, duplicate_id, cite_source, cite_label, cite_string: a row a record and file; only the search has sources."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("key"), "source", "lang")
    first = docs.groupBy("key").agg(F.min("doc_id").alias("duplicate_id"))
    docs = docs.join(first, "key")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").join(docs, "doc_id")
    row = lambda df, label, source: df.select(
        F.concat(F.lit(f"{label}-"), F.col("doc_id").cast("string")).alias("record_id"), "duplicate_id", source.alias("cite_source"), F.lit(label).alias("cite_label"), F.col("lang").alias("cite_string")
    )
    none = F.lit(None).cast("string")
    return row(docs, "search", F.col("source")).union(row(labels, "screened", none)).union(row(labels.where("quality = 1"), "final", none))


def merged(rows: DataFrame) -> DataFrame:
    """Unique citations: record_ids and tags as lists in the order of record_id."""
    listed = lambda c: F.array_join(F.transform(F.filter(F.array_sort(F.collect_list(F.struct("record_id", F.col(c).alias("v")))), lambda x: x.v.isNotNull()), lambda x: x.v), ", ").alias(c)
    return rows.groupBy("duplicate_id").agg(F.array_join(F.array_sort(F.collect_list("record_id")), ", ").alias("record_ids"), *(listed(c) for c in ("cite_source", "cite_label", "cite_string")))


def doc_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged(doc_citations(spark, sf_dir))


def part_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey").join(F.broadcast(nations), F.col("s_nationkey") == F.col("n_nationkey"))  # 25 nations
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    rows = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    phase = F.create_map(*(F.lit(x) for kv in _PHASE.items() for x in kv))
    return rows.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("record_id"),
        F.col("l_partkey").alias("duplicate_id"),
        F.col("n_name").alias("cite_source"),
        phase[F.col("o_orderstatus")].alias("cite_label"),
        F.col("l_returnflag").alias("cite_string"),
    )


def part_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged(part_citations(spark, sf_dir))


def bibliography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations with bibliographic fields made of all orders: nations and market segments are authors, part names are titles,
    brands are journals, with gaps and alternative columns."""
    orders = table(spark, sf_dir, "orders")
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_partkey").alias("partkey"), F.count("*").alias("n"))
    part = table(spark, sf_dir, "part")
    cust = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).join(part, F.col("partkey") == F.col("p_partkey")).join(cust, F.col("o_custkey") == F.col("c_custkey"))
    family = F.initcap(F.regexp_replace("n_name", "_", ""))
    second = F.concat(F.initcap("c_mktsegment"), F.lit(", X. Y."))
    return rows.select(
        F.col("o_orderkey").cast("string").alias("record_id"),
        F.concat(family, F.lit(", "), F.substring("p_type", 1, 1), F.lit("."), F.when(F.col("n") > 1, F.concat(F.lit(" and "), second)).otherwise(F.lit("")), F.when(F.col("n") > 4, F.lit(" and Third, Anna")).otherwise(F.lit(""))).alias("author"),
        F.date_format("o_orderdate", "yyyy").alias("year"),
        F.col("p_name").alias("title"),
        F.when(F.col("p_size") % 3 != 0, F.col("p_brand")).alias("journal"),
        F.col("p_type").alias("source"),
        F.col("p_size").cast("string").alias("volume"),
        F.when(F.col("p_size") % 2 == 0, F.col("n").cast("string")).alias("issue"),
        F.lit(None).cast("string").alias("number"),
        F.concat(F.col("p_size").cast("string"), F.lit("-"), (F.col("p_size") + F.col("n")).cast("string")).alias("pages"),
        F.when(F.col("n") % 3 == 0, F.concat(F.lit("10.1000/"), F.col("partkey").cast("string"))).alias("doi"),
        F.when(F.col("n") % 3 == 1, F.concat(F.lit("https://example.org/"), F.col("o_orderkey").cast("string"))).alias("url"),
    )


def match_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders as records with titles of their own, and further records of some of them as other sources have them: of
    every fifth with other words and without DOI, of every seventh with a slip in the title and another form of the author."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("record_id"), "o_custkey")
    segments = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.lower("c_mktsegment").alias("segment"))
    code = F.translate("record_id", "0123456789", "abcdefghij")
    b = bibliography(spark, sf_dir).join(orders.join(segments, "o_custkey").drop("o_custkey"), "record_id")
    title = F.concat(code, F.lit(" "), "title", F.lit(" in the "), "segment", F.lit(" market of "), code)
    b = b.withColumn("title", title).withColumn("doi", F.when(F.col("doi").isNotNull(), F.concat(F.lit("10.1000/"), "record_id")))
    b = b.select("record_id", "author", "year", "title", "journal", "volume", "issue", "pages", "doi", F.lit("A").alias("cite_source"), F.lit("search").alias("cite_label"), F.lit(None).cast("string").alias("cite_string"))
    n = F.col("record_id").cast("long")
    second = b.where(n % 5 == 0).withColumns({"record_id": F.concat(F.lit("b"), "record_id"), "title": F.regexp_replace("title", "market", "Markets"), "doi": F.lit(None).cast("string"), "cite_source": F.lit("B")})
    third = b.where(n % 7 == 0).withColumns({"record_id": F.concat(F.lit("c"), "record_id"), "title": F.regexp_replace("title", " in the ", " in teh "), "author": F.regexp_replace("author", " and .*", ""), "journal": F.lit(None).cast("string"), "cite_source": F.lit("C")})
    return b.unionByName(second).unionByName(third)
