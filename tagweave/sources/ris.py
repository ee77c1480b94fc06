"""RIS and MEDLINE files: lines to tagged entries, entries to citation columns, all in column expressions.

A file whose records end in ER lines is split by Spark at these, so a large file is read by many tasks; other files are
read whole, one row each."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import bounded, written
from ..schema import DIALECTS, PUBMED_FIELDS, RIS_FIELDS

NEWLINE = r"\r\n|\r|\n"
#: A tag at the beginning of a line, and what stands between it and its text.
_TAG, _PUBMED_TAG = r"[A-Z][A-Z0-9](?=\s|\z)", r"[A-Z]{2,4}(?=[ \t]*-[ \t])"
_MARK, _PUBMED_MARK = r"^[A-Z][A-Z0-9](?:[ \t]{1,2}[-:=][ \t]?|[ \t]+|(?=[\r\n]|\z))", r"^[A-Z]{2,4}[ \t]*-[ \t]"
#: The dictionaries that a caller can name; "none" keeps the tags, "best_guess" takes the one that fits a file's tags best.
NAMINGS: dict[str, dict[str, str]] = {"generic": RIS_FIELDS, "none": {}} | DIALECTS
#: A dictionary with this share of a file's tags is taken alone; below the other share the general one may be better.
ALONE, ENOUGH = 0.99, 0.75
#: Files, up to which a table with a row for each is broadcast; beyond, the join shuffles.
FILES = 100_000
#: Columns that a frame may have; more field names are an error.
MOST_FIELDS = 5_000


def entries(record: Column, pubmed: bool = False) -> Column:
    """array of (tag, text) of a record's lines. Lines without a tag go with the one above; a byte order mark is dropped.

    The record is cut where a line begins with a tag, so a piece is a tag and its lines, and each line is looked at once."""
    tag, mark = (_PUBMED_TAG, _PUBMED_MARK) if pubmed else (_TAG, _MARK)
    pieces = F.split(F.regexp_replace(record, "^﻿", ""), rf"(?:{NEWLINE})(?={tag})")

    def lines(piece: Column) -> Column:
        own = F.regexp_extract(piece, f"^{tag}", 0)
        texts = F.filter(F.split(F.regexp_replace(piece, mark, ""), NEWLINE), lambda x: F.trim(x) != "")
        return F.transform(texts, lambda x: F.struct(F.coalesce(F.nullif(own, F.lit("")), F.lit("ZZ")).alias("tag"), F.trim(x).alias("text")))

    return F.filter(F.flatten(F.transform(pieces, lines)), lambda x: x.tag != "ER")


def records_of(spark: SparkSession, files: Iterable[str], delimiter: str = "endrow", pubmed: bool = False) -> DataFrame:
    """file and entries of each record with two entries or more, from files that all have this delimiter: endrow (ER lines),
    space (blank lines) or character (lines of one repeated character)."""
    files = list(files)
    path = F.col("_metadata.file_path").alias("file")
    if delimiter == "endrow":
        # a bare CR before ER is rare; such files hold several records in a row, which the second split parts
        rows = spark.read.text(files, lineSep="\nER").select(path, F.explode(F.split("value", r"(?:\r\n|\r|\n|^)ER\s*(?:-\s*)?(?=\r|\n|$)")).alias("record"))
        rows = rows.withColumn("record", F.regexp_replace("record", r"^\s*-\s*(?=\r|\n|$)", ""))
    else:
        between = r"(?:\r\n|\r|\n)(?:[ \t]*(?:\r\n|\r|\n))+" if delimiter == "space" else r"(?:\r\n|\r|\n|^)([^\w\s])\1+\s*(?:\r\n|\r|\n|$)"
        rows = spark.read.text(files, wholetext=True).select(path, F.explode(F.split("value", between)).alias("record"))
    return rows.select("file", entries(F.col("record"), pubmed).alias("entries")).where(F.size("entries") > 1)


def best_naming(records: DataFrame) -> DataFrame:
    """file and naming: the dictionary with the most of the file's different tags; the general one if it has more and no
    other has ENOUGH of them; "x+generic" unless x has nearly all."""
    tags = records.select("file", F.explode(F.array_distinct(F.transform("entries", lambda e: e.tag))).alias("tag")).distinct()
    known = lambda names: F.avg(F.col("tag").isin(*names).cast("int"))
    shares = tags.groupBy("file").agg(known(RIS_FIELDS).alias("general"), *(known(x).alias(n) for n, x in DIALECTS.items()))
    best = F.array_max(F.array(*(F.struct(F.col(n).alias("share"), F.lit(-i).alias("order"), F.lit(n).alias("name")) for i, n in enumerate(DIALECTS))))
    name = F.when((best["share"] < ENOUGH) & (F.col("general") > best["share"]), "generic").when(best["share"] > ALONE, best["name"])
    return shares.select("file", name.otherwise(F.concat(best["name"], F.lit("+generic"))).alias("naming"))


def with_fields(records: DataFrame, tag_naming: Mapping[str, str] | str | None = None, pubmed: bool = False) -> DataFrame:
    """file and fields (array of field, text), with the tags' names for fields; unknown tags keep theirs.

    tag_naming: one of NAMINGS, "best_guess" for each file's own, or further names for tags. Of several tags that mean the
    author, a file's most frequent one does; of several that mean the year, the one whose values are most like four
    characters; if none does, the one whose values are years in nine of ten records. The others keep their own names."""
    records = written(records, "ris-records")  # a file's tags are looked at before its records
    named = isinstance(tag_naming, str) and tag_naming != "best_guess"
    if named and tag_naming not in NAMINGS:
        raise ValueError(f"tag_naming: best_guess, {', '.join(NAMINGS)} or a mapping")
    own = {} if tag_naming is None or isinstance(tag_naming, str) else dict(tag_naming)
    if pubmed or named or own:
        names = {"": (PUBMED_FIELDS if pubmed else NAMINGS[tag_naming] if named else RIS_FIELDS) | own}
        files = records.select("file").distinct().withColumn("naming", F.lit(""))
    else:
        names = {"generic": RIS_FIELDS} | DIALECTS | {f"{n}+generic": RIS_FIELDS | x for n, x in DIALECTS.items()}
        files = best_naming(records)
    files = bounded(written(files, "ris-files"), FILES)
    literal = lambda d: F.create_map(*(F.lit(x) for kv in d.items() for x in kv)) if d else F.create_map().cast("map<string,string>")
    lookup = F.element_at(F.create_map(*(x for n, d in names.items() for x in (F.lit(n), literal(d)))), F.col("naming"))
    field = lambda e: F.coalesce(F.try_element_at(lookup, e.tag), e.tag)
    rows = records.join(files, "file").select("file", F.transform("entries", lambda e: F.struct(e.tag.alias("tag"), field(e).alias("field"), e.text.alias("text"))).alias("e"))
    seen = rows.select("file", F.monotonically_increasing_id().alias("record"), F.explode("e").alias("x"))
    year = F.col("x.text").rlike(r"^(1[5-9]|20)\d\d$") & (F.col("x.text").try_cast("int") <= F.year(F.current_date()) + 1)
    by_tag = seen.groupBy("file", "x.tag", "x.field").agg(F.count("*").alias("n"), F.abs(F.avg(F.length("x.text")) - 4).alias("off"), F.sum(year.cast("long")).alias("years"))
    most = lambda field, by, f: f(F.when(F.col("field") == field, F.col("tag")), F.when(F.col("field") == field, F.struct(by, "tag")))
    best = by_tag.groupBy("file").agg(
        most("author", "n", F.max_by).alias("author_tag"),
        most("year", "off", F.min_by).alias("year_tag"),
        F.max_by("tag", F.when((F.col("field") != "year") & (F.col("years") > 0.9 * F.col("n")), F.struct("years", "tag"))).alias("adopted"),
        F.max(F.when((F.col("field") != "year") & (F.col("years") > 0.9 * F.col("n")), F.col("years"))).alias("years"),
    )
    # a tag that stands for years must do so in nine of ten of the file's records
    sizes = records.groupBy("file").agg(F.count("*").alias("size"))
    best = best.join(sizes, "file").withColumn("adopted", F.when(F.col("year_tag").isNull() & (F.col("years") > 0.9 * F.col("size")), F.col("adopted"))).drop("years", "size")
    out = rows.join(bounded(written(best, "ris-tags"), FILES), "file", "left")
    chosen = (
        lambda x: F.when((x.field == "author") & (x.tag != F.col("author_tag")), x.tag)
        .when((x.field == "year") & (x.tag != F.col("year_tag")), F.lit("year_additional"))
        .when(x.tag == F.col("adopted"), F.lit("year"))
        .otherwise(x.field)
    )
    return out.select("file", F.transform("e", lambda x: F.struct(chosen(x).alias("field"), x.text.alias("text"))).alias("fields"))


def values(field: str) -> Column:
    return F.transform(F.filter("fields", lambda x: x.field == field), lambda x: x.text)


def _squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def _ends(c: Column) -> Column:
    return F.regexp_replace(c, r"\.$", "")


def column_of(field: str) -> Column:
    """A field's values as one string; null without any.

    title: repeated titles once, else joined, without a last point; journal: the shortest of several names; abstract:
    joined; pages: sorted and joined by -; year: the first four digits; all others: joined by " and "."""
    v = values(field)
    if field == "year":
        out = F.regexp_extract(F.element_at(v, 1), r"\d{4}", 0)
    elif field == "title":
        out = _ends(_squeezed(F.array_join(F.array_distinct(v), " ")))
    elif field == "abstract":
        out = _squeezed(F.array_join(v, " "))
    elif field == "journal":
        out = _ends(F.element_at(F.array_sort(F.transform(F.array_distinct(v), lambda x: F.struct(F.length(x).alias("n"), x.alias("x")))), 1).x)
    elif field == "pages":
        out = F.array_join(F.sort_array(F.transform(v, lambda x: x)), "-")
    else:
        out = F.array_join(v, " and ")
    return F.when(F.size(v) > 0, out)


def other_journals() -> Column:
    """The longer ones of several journal names."""
    s = F.array_sort(F.transform(F.array_distinct(values("journal")), lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))
    return F.when(F.size(s) > 1, F.array_join(F.transform(F.slice(s, F.lit(2), F.size(s)), lambda y: y.x), "; "))


def clean_authors(df: DataFrame, by: str = "file") -> DataFrame:
    """author with " and " between names: from and, AND or & where any row of a file has them; else a comma before a word
    of two letters or more parts names."""
    if "author" not in df.columns:
        return df
    some = df.groupBy(by).agg(F.max(F.col("author").rlike(r"(?i)\sand\s|\s&\s")).alias("__and"))
    out = df.join(some, by, "left")
    return out.withColumn("author", F.when(F.col("__and"), F.regexp_replace("author", r"\s+(?i:and)\s+|\s*&\s*", " and ")).otherwise(F.regexp_replace("author", r",(?=\s*[A-Za-z]{2,})", " and "))).drop("__and")


def citations(fields: DataFrame, columns: Iterable[str]) -> DataFrame:
    """file and the columns; journal_secondary holds the longer ones of several journal names."""
    return fields.select("file", *((other_journals() if c == "journal_secondary" else column_of(c)).alias(c) for c in columns))


def present(fields: DataFrame, limit: int = MOST_FIELDS) -> list[str]:
    """The field names that occur, in the order of the dictionary, then by name; more than limit are an error."""
    found = [r.f for r in fields.select(F.explode("fields.field").alias("f")).distinct().limit(limit + 1).collect()]
    if len(found) > limit:
        raise ValueError(f"more than {limit} field names")
    order = {f: i for i, f in enumerate(dict.fromkeys([*RIS_FIELDS.values(), *PUBMED_FIELDS.values()]))}
    return sorted(found, key=lambda f: (order.get(f, len(order)), f))


def pubmed_columns(df: DataFrame) -> DataFrame:
    """Year from the date, DOI from the article's identifiers."""
    out = df
    if "date_published" in df.columns:
        out = out.withColumn("year", F.substring("date_published", 1, 4))
    if "article_id" in df.columns:
        out = out.withColumn("doi", F.nullif(F.regexp_extract("article_id", r"(10\.\S+)\s*\[doi\]", 1), F.lit("")))
    return out
