"""Duplicate citations: blocks, comparisons, rules, components, and a merge that keeps every tag."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.pairwise import CHUNK, Texts
from ..functions.similarity import jaro_winkler
from ..functions.tags import UNKNOWN
from ..plans.storage import written
from ..schema import TAGS, with_missing
from .blocks import Rows, Sift, in_blocks
from .components import components, forest

#: The fields that a pair is compared in, in the order of the table of doubtful pairs.
FIELDS = ("title", "author", "doi", "volume", "pages", "number", "year", "abstract", "journal", "isbn")
#: Keys of the blocks in which records are compared. Titles that are equal at the beginning or at the end (12 letters and
#: digits) meet whatever else is known; so do equal ones, and those of 24 or more that differ in one place.
BLOCKS: tuple[tuple[str, ...], ...] = (
    ("doi",), ("title_key",), ("title_end",), ("author_key", "year"), ("journal", "volume", "pages"), ("isbn", "volume", "pages"), ("year", "pages", "volume"),
)
#: Titles of less similarity are neither merged nor shown, whatever else is known but a DOI.
LEAST_TITLE = 0.85
#: Without the same DOI, titles of less similarity aren't merged.
LEAST_MERGED = 0.9
#: Without the same DOI or like abstracts, authors of less similarity than the first aren't merged, and of less than the second
#: (or missing) only if titles have more.
LEAST_AUTHOR, LEAST_EQUAL = (0.8, 0.85), 0.99
#: Records of a block that meet in one group of rows; larger blocks are dealt into parts, and every two parts meet.
PART = 4096


def normalised(raw: DataFrame) -> DataFrame:
    """Canonical fields from their alternatives; absent columns are null."""
    df = with_missing(raw, [*FIELDS, *TAGS, "source", "issue", "start_page", "issn", "record_id", "ID"])
    first = lambda a, b: F.coalesce(F.col(a), F.col(b))
    return df.withColumns({"journal": first("journal", "source"), "number": first("number", "issue"), "pages": first("pages", "start_page"), "isbn": first("isbn", "issn"), "record_id": first("record_id", "ID")})


def with_record_ids(raw: DataFrame, start: int = 1000) -> DataFrame:
    """record_id: a number for each row, from start + 1 on, in an order of the rows' values; numbers are dealt by ranges, so
    no task sorts all rows."""
    from .numbering import numbered

    return numbered(raw, "record_id", start)


def keys(df: DataFrame) -> DataFrame:
    """record_id and what is compared: upper case letters and digits, DOIs without resolver."""
    plain = lambda c: F.nullif(F.regexp_replace(F.upper(F.col(c)), r"[^\p{L}\p{N}]+", " "), F.lit(""))
    squeezed = lambda c: F.nullif(F.trim(plain(c)), F.lit(""))
    doi = F.nullif(F.regexp_replace(F.lower(F.trim("doi")), r"^(https?://(dx\.)?doi\.org/|doi:\s*)", ""), F.lit(""))
    letters = F.regexp_replace(F.upper("title"), r"[^\p{L}\p{N}]+", "")
    return df.select(
        F.col("record_id").cast("string").alias("record_id"),
        squeezed("title").alias("title"),
        squeezed("author").alias("author"),
        doi.alias("doi"),
        *(squeezed(c).alias(c) for c in ("volume", "pages", "number", "year", "abstract", "journal", "isbn")),
        F.nullif(F.regexp_extract(F.upper("author"), r"^\s*([\p{L}\p{N}'-]+)", 1), F.lit("")).alias("author_key"),
        F.nullif(F.substring(letters, 1, 12), F.lit("")).alias("title_key"),
        F.nullif(F.right(letters, F.lit(12)), F.lit("")).alias("title_end"),
    )


def _known(k: DataFrame, key: Sequence[str]) -> DataFrame:
    return k.where(" and ".join(f"{c} is not null" for c in ("record_id", *key)))


def _met(rows: Rows, before: Sequence[Sequence[str]], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Pairs that a block before has too."""
    out = np.zeros(len(i), bool)
    for key in before:
        out |= np.logical_and.reduce([rows.equal(c, i, j) for c in key])
    return out


def scored_pairs(k: DataFrame, key: Sequence[str], column: str, score: Callable[[Texts, np.ndarray, np.ndarray], np.ndarray], kind: T.DataType) -> DataFrame:
    """id1 < id2 and score of all records that share a block: score takes the texts of column and both places of each pair."""
    fields = [T.StructField("id1", T.StringType()), T.StructField("id2", T.StringType()), T.StructField("score", kind)]
    schema = to_arrow_schema(T.StructType(fields))

    def compare(rows: Rows, i: np.ndarray, j: np.ndarray) -> Iterator[pa.RecordBatch]:
        yield rows.batch(i, j, (), {"score": rows.scores(column, i, j, score)}, schema)

    return in_blocks(_known(k, key).select("record_id", *dict.fromkeys([*key, column])), key, PART, compare, fields)


def candidate_pairs(k: DataFrame, blocks: Sequence[Sequence[str]] = BLOCKS) -> DataFrame:
    """id1 < id2 of all records that share a block. Rows grow with the square of a block."""
    fields = [T.StructField("id1", T.StringType()), T.StructField("id2", T.StringType())]
    schema, used = to_arrow_schema(T.StructType(fields)), list(dict.fromkeys(c for key in blocks for c in key))

    def pairs(n: int) -> DataFrame:
        def compare(rows: Rows, i: np.ndarray, j: np.ndarray) -> Iterator[pa.RecordBatch]:
            new = ~_met(rows, blocks[:n], i, j)
            yield rows.batch(i[new], j[new], (), {}, schema)

        return in_blocks(_known(k, blocks[n]).select("record_id", *used), blocks[n], PART, compare, fields)

    return reduce(DataFrame.union, [pairs(n) for n in range(len(blocks))])


def compared(k: DataFrame, blocks: Sequence[Sequence[str]], merging: bool, carried: Sequence[str] = (), abstracts: bool = True) -> DataFrame:
    """The pairs of all blocks that automatic() (merging) or else doubtful() may hold for, each once: both values (merging:
    both titles) and the Jaro-Winkler similarity of each field but the abstract, null where a value is missing, and both
    values of carried.

    Pairs are made and compared where their block's rows are. No rule holds without a like title or the same DOI; none
    merges across different DOIs, volumes or numbers without the same DOI; without abstracts none across different years,
    either, and what authors have less similarity needs more of the title. Of doubtful ones those with the same value of
    duplicate_id, if it is carried, are left out."""
    fields, least = [f for f in FIELDS if f != "abstract"], LEAST_MERGED if merging else LEAST_TITLE
    both, used = (["title"] if merging else [*fields, *carried]), list(dict.fromkeys(c for key in blocks for c in key))
    kinds = {f.name: f.dataType for f in k.schema.fields}
    columns = [T.StructField(f"id{i}", T.StringType()) for i in (1, 2)] + [T.StructField(f"{c}{i}", kinds[c]) for c in both for i in (1, 2)] + [T.StructField(f, T.DoubleType()) for f in fields]
    schema, apart = to_arrow_schema(T.StructType(columns)), "duplicate_id" in carried
    gaps = bool(merging and k.where("volume is null").limit(1).count())
    sift = lambda rows: Sift(rows, "title", "doi", least)

    def pairs(n: int, key: Sequence[str], known: DataFrame, volumes: str) -> DataFrame:
        """volumes: all pairs, those with a gap in one volume, or those whose volumes differ."""

        def compare(rows: Rows, i: np.ndarray, j: np.ndarray) -> Iterator[pa.RecordBatch]:
            if volumes == "gap":
                gap = rows.codes("volume") < 0
                some = gap[i] | gap[j]
                i, j = i[some], j[some]
            elif volumes == "differ":
                some = rows.differ("volume", i, j)
                i, j = i[some], j[some]
            if merging:
                for c in ("volume", "number", "doi", *(() if abstracts else ("year",))):
                    some = rows.equal("doi", i, j) | ~rows.differ(c, i, j)
                    i, j = i[some], j[some]
            elif apart:
                some = rows.differ("duplicate_id", i, j)
                i, j = i[some], j[some]
            new = ~_met(rows, blocks[:n], i, j)
            i, j = i[new], j[new]
            same, title, texts = rows.equal("doi", i, j), rows.codes("title"), rows.texts("title")
            like, more = same | ((title[i] >= 0) & (title[j] >= 0)), np.zeros(len(i), bool)
            table = rows.table_of("author", Texts.jaro_winkler, len(i)) if merging and not abstracts else None
            if table is not None:
                x, y = rows.codes("author")[i], rows.codes("author")[j]
                author, missing = table[x, y], (x < 0) | (y < 0)
                like &= same | missing | (author >= LEAST_AUTHOR[0])
                more = ~same & (missing | (author < LEAST_AUTHOR[1]))
            for high, which in ((LEAST_EQUAL, more), (least, ~more)):
                some = np.flatnonzero(like & which & ~same)
                if high > least:
                    some = some[texts.may_reach(title[i[some]], title[j[some]], high)]
                    like &= ~more
                found = texts.jaro_winkler(title[i[some]], title[j[some]], high) >= high
                like[some] = found
            i, j = i[like], j[like]
            for a in range(0, len(i), CHUNK):
                x, y = i[a : a + CHUNK], j[a : a + CHUNK]
                yield rows.batch(x, y, both, {f: rows.scores(f, x, y, Texts.jaro_winkler) for f in fields}, schema)

        return in_blocks(known.select("record_id", *dict.fromkeys([*used, *fields, *both])), key, PART, compare, columns, sift)

    def of_block(n: int) -> list[DataFrame]:
        """What merges has the same volume, or a gap there, or the same DOI; each of these is a smaller block."""
        key, known = blocks[n], _known(k, blocks[n])
        if not merging or "volume" in key or "doi" in key:
            return [pairs(n, key, known, "all")]
        out = [pairs(n, [*key, "volume"], known.where("volume is not null"), "all"), pairs(n, [*key, "doi"], known.where("doi is not null"), "differ")]
        if gaps:
            out.append(pairs(n, key, known.join(known.where("volume is null").select(*key).distinct(), list(key), "left_semi"), "gap"))
        return out

    return reduce(DataFrame.union, [x for n in range(len(blocks)) for x in of_block(n)])


def judged(k: DataFrame, blocks: Sequence[Sequence[str]], merging: bool, carried: Sequence[str] = ()) -> DataFrame:
    """The pairs that automatic() (merging) or doubtful() holds for, with all fields. Abstracts are long and go only with
    pairs that they may count for; where no record has one, they cost nothing."""
    rule = automatic() if merging else doubtful()
    abstracts = bool(k.where("abstract is not null").limit(1).count())
    pairs = compared(k.drop("abstract"), blocks, merging, carried, abstracts)
    none = F.lit(None).cast("string")
    guess = F.lit(1.0) if merging and abstracts else F.lit(None).cast("double")
    pairs = pairs.withColumns({"abstract1": none, "abstract2": none, "abstract": guess}).where(rule)
    if not abstracts:
        return pairs
    side = lambda i: k.where("abstract is not null").select(F.col("record_id").alias(f"id{i}"), F.col("abstract").alias(f"abstract{i}"))
    pairs = written(pairs.drop("abstract1", "abstract2", "abstract"), "citation-likely").join(side(1), "id1", "left").join(side(2), "id2", "left")
    return written(pairs.withColumn("abstract", jaro_winkler("abstract1", "abstract2")), "citation-compared").where(rule)


def alike(k: DataFrame) -> DataFrame:
    """record_id and node: the least record with the same values in all compared fields. These have the same pairs."""
    return k.groupBy(*FIELDS, "author_key", "title_key", "title_end").agg(F.min("record_id").alias("node"), F.collect_list("record_id").alias("ids")).select("node", F.explode("ids").alias("record_id"))


def _at_least(field: str, x: float, missing: bool = False) -> Column:
    return F.coalesce(F.col(field) >= x, F.lit(missing))


def _same_numbers() -> Column:
    """Volumes, issues and the numbers in the titles agree, as far as both records have them; similar ones don't count."""
    digits = lambda i: F.trim(F.regexp_replace(f"title{i}", r"\P{N}+", " "))
    return _at_least("volume", 1.0, True) & _at_least("number", 1.0, True) & F.coalesce(digits(1) == digits(2), F.lit(True))


def automatic() -> Column:
    """Pairs that are merged without a look at them. Without one DOI nothing is merged across different DOIs, years, volumes,
    issues or numbers in titles."""
    same_place = _at_least("journal", 0.8, True) & _at_least("year", 1.0, True) & _same_numbers()
    numbers = _at_least("volume", 0.95) | _at_least("pages", 0.95) | _at_least("number", 1.0)
    return (
        (_at_least("doi", 1.0) & _at_least("title", 0.85, True))
        | (_at_least("title", LEAST_EQUAL) & _at_least("author", LEAST_AUTHOR[0], True) & same_place & _at_least("doi", 1.0, True) & _at_least("pages", 0.6, True))
        | (_at_least("title", LEAST_MERGED) & _at_least("author", LEAST_AUTHOR[1]) & same_place & numbers & _at_least("doi", 1.0, True))
        | (_at_least("title", 0.9) & _at_least("abstract", 0.9) & _at_least("author", 0.8, True) & _same_numbers() & _at_least("doi", 1.0, True))
    )


def doubtful() -> Column:
    """Pairs that aren't merged but shown."""
    return ~automatic() & ((_at_least("title", LEAST_TITLE) & _at_least("author", 0.7, True)) | _at_least("doi", 1.0) | (_at_least("title", 0.95) & _at_least("year", 0.75, True)))


def merged(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """A row for each entity: rows (with record_id) that share a component of groups (node, component), or stand alone.

    duplicate_id is the smallest record_id; record_ids and tags are lists in the order of record_id, with repeats; any other
    field is that of the most complete record that has it, those with a DOI and an abstract first."""
    others = [c for c in rows.columns if c not in ("record_id", "duplicate_id", "record_ids", *TAGS)]
    r = rows.join(groups.select(F.col("node").alias("record_id"), "component"), "record_id", "left").withColumn("duplicate_id", F.coalesce("component", "record_id"))
    full = sum((F.col(f"`{c}`").isNotNull().cast("int") for c in others), F.lit(0))
    prefer = lambda c: F.col(c).isNotNull().cast("int") if c in others else F.lit(0)
    r = r.withColumn("__rank", F.struct(prefer("doi").alias("d"), prefer("abstract").alias("a"), full.alias("n"), F.col("record_id").alias("i")))
    listed = lambda c, kept: F.array_join(F.transform(F.filter(F.array_sort(F.collect_list(F.struct("record_id", F.col(c).alias("v")))), kept), lambda x: x.v), ", ")
    return r.groupBy("duplicate_id").agg(
        F.array_join(F.array_sort(F.collect_list("record_id")), ", ").alias("record_ids"),
        *(listed(c, lambda x: x.v != "").alias(c) for c in TAGS),
        *(F.max_by(f"`{c}`", F.when(F.col(f"`{c}`").isNotNull(), F.col("__rank"))).alias(c) for c in others),
    )


def dedup_citations(raw: DataFrame, manual: bool = False, show_unknown_tags: bool = False, blocks: Sequence[Sequence[str]] = BLOCKS) -> DataFrame | tuple[DataFrame, DataFrame]:
    """The unique citations of raw; with manual also the doubtful pairs, with both values and the similarity of each field.

    show_unknown_tags: a record's missing tags read "unknown"; else they have no place in the lists."""
    rows = normalised(raw)
    if show_unknown_tags:
        rows = rows.withColumns({c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(UNKNOWN)) for c in TAGS})
    rows = written(rows.withColumn("record_id", F.col("record_id").cast("string")), "citations")
    k = keys(rows)
    same = written(alike(k), "citation-alike")
    nodes = k.join(same.where("node = record_id").select("record_id"), "record_id", "left_semi")
    nodes = written(nodes, "citation-nodes")
    pairs = judged(nodes, blocks, True).select(F.col("id1").alias("a"), F.col("id2").alias("b"))
    # equal records are a pair to merge if they have a title or a DOI, as automatic() has it; they are never doubtful
    equal = same.where("node <> record_id").join(nodes.where("title is not null or doi is not null").select(F.col("record_id").alias("node")), "node", "left_semi")
    links = forest(pairs).union(equal.select("node", "record_id"))
    groups = components(links, "citation-groups")
    unique = merged(rows, groups)
    if not manual:
        return unique
    # what is shown of a record goes into its blocks with it, so that pairs are only written, never joined or shuffled
    own = ["source", "label", "string"]
    tags = rows.select("record_id", *(F.col(f"cite_{c}").alias(c) for c in own))
    many = same.groupBy("node").agg((F.count("*") > 1).alias("many"))
    left = nodes.join(groups.select(F.col("node").alias("record_id"), "component"), "record_id", "left").withColumn("duplicate_id", F.coalesce("component", "record_id")).drop("component")
    left = written(left.join(tags, "record_id").join(many.withColumnRenamed("node", "record_id"), "record_id"), "citation-left")
    doubt = judged(left, blocks, False, ["duplicate_id", *own, "many"])
    tagged = [f"{c}{i}" for i in (1, 2) for c in own]
    shown = doubt.select("id1", "id2", *(f"{f}{i}" for f in FIELDS for i in (1, 2)), *FIELDS, "duplicate_id1", "duplicate_id2", *tagged, "many1", "many2")
    if not left.where("many").limit(1).count():
        return unique, shown.drop("many1", "many2")
    # records with equal values have the same pairs; they share an entity, but each has tags of its own
    member = lambda i: same.join(tags, "record_id").select(F.col("node").alias(f"id{i}"), F.col("record_id").alias(f"r{i}"), *(F.col(c).alias(f"{c}{i}") for c in own))
    shown = written(shown, "citation-doubtful")
    each = shown.where("many1 or many2").drop(*tagged).join(member(1), "id1").join(member(2), "id2")
    # id1 is the smaller of both ids, and each value stays with its own record
    sided = [*FIELDS, "duplicate_id", *own]
    turned = {f"{c}{i}": F.when(F.col("r1") < F.col("r2"), F.col(f"{c}{i}")).otherwise(F.col(f"{c}{3 - i}")) for c in sided for i in (1, 2)}
    each = each.select(F.least("r1", "r2").alias("id1"), F.greatest("r1", "r2").alias("id2"), *(c.alias(n) for n, c in turned.items()), *FIELDS)
    return unique, shown.where("not many1 and not many2").drop("many1", "many2").unionByName(each)


def add_manual_pairs(unique: DataFrame, pairs: DataFrame) -> DataFrame:
    """unique with the entities of the pairs (duplicate_id1, duplicate_id2) merged, and what these are linked with."""
    groups = components(pairs.select(F.col("duplicate_id1").alias("a"), F.col("duplicate_id2").alias("b")), "manual-groups")
    rows = unique.join(groups.select(F.col("node").alias("duplicate_id"), "component"), "duplicate_id", "left").withColumn("__to", F.coalesce("component", "duplicate_id")).drop("component")
    lists = ["record_ids", *TAGS]
    others = [c for c in unique.columns if c not in ("duplicate_id", *lists)]
    order = F.struct((F.col("duplicate_id") == F.col("__to")).cast("int").alias("own"), F.col("duplicate_id").alias("i"))
    listed = lambda c: F.array_join(F.transform(F.filter(F.array_sort(F.collect_list(F.struct("duplicate_id", F.col(c).alias("v")))), lambda x: x.v != ""), lambda x: x.v), ", ")
    return rows.groupBy(F.col("__to").alias("duplicate_id")).agg(
        *(listed(c).alias(c) for c in lists if c in unique.columns), *(F.max_by(f"`{c}`", F.when(F.col(f"`{c}`").isNotNull(), order)).alias(c) for c in others)
    )
