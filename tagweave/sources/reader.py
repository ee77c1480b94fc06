"""Import of citation files of any kind, with provenance tags."""

from __future__ import annotations

import io
import re
import warnings
from collections.abc import Iterable, Iterator, Mapping, Sequence
from functools import reduce
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import filesystem
from ..schema import KEY_FIELDS, RIS_FIELDS, TAGS, require
from . import bibtex, ris

SNIFF_LINES = 200


def stem(path: str) -> str:
    return re.sub(r"\.[^.]*$", "", path.rstrip("/").rpartition("/")[2])


def make_unique(names: Iterable[str]) -> list[str]:
    """Names with _1, _2 and so on added to those that stood there before."""
    out: list[str] = []
    for n in names:
        new, k = n, 0
        while new in out:
            k += 1
            new = f"{n}_{k}"
        out.append(new)
    return out


def detect_parser(lines: Sequence[str]) -> str | None:
    """csv, tsv, bibtex, pubmed or ris: what most lines look like, if more than a fifth do."""
    lines = [x for x in lines if x.strip()]
    if not lines:
        return None
    if any(re.match(r"PMID\s*-", x) for x in lines):
        return "pubmed"
    share = lambda p: sum(bool(re.search(p, x)) for x in lines) / len(lines)
    found = {"csv": share(r',(?="|[A-Za-z0-9])'), "tsv": share(r"\t"), "bibtex": share(r"[{}]"), "ris": share(r"^(﻿)?([A-Z]{2}|[A-Z][0-9])\s{1,4}(-|\S)|^ER\s*$")}
    best = max(found, key=lambda k: (found[k], k == "ris"))
    return best if found[best] > 0.2 else None


def detect_delimiter(lines: Sequence[str]) -> str:
    """How records end: endrow (ER lines), character (a line of one repeated character) or space (blank lines)."""
    if any(re.match(r"ER\s*(-|$)", x) for x in lines):
        return "endrow"
    if any(len(x.strip()) > 1 and len(set(x.strip())) == 1 and not x.strip()[0].isalnum() for x in lines):
        return "character"
    if any(not x.strip() for x in lines[1:]):
        return "space"
    raise ValueError("records have no delimiter")


def qualified(spark: SparkSession, path: str) -> str:
    """path as Spark names it in a row's metadata, but for the number of slashes after file:."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toUri().toString()


def first_lines(uri: str, n: int = SNIFF_LINES) -> list[str]:
    """The first lines of a file, or of the first files of a folder; compressed ones by their suffix."""
    from pyarrow import fs

    system, path = filesystem(uri)
    if system.get_file_info(path).type == fs.FileType.Directory:
        files = sorted(f.path for f in system.get_file_info(fs.FileSelector(path)) if f.is_file and f.base_name[0] not in "._")
    else:
        files = [path]
    lines: list[str] = []
    for f in files:
        with io.TextIOWrapper(system.open_input_stream(f, compression="detect"), encoding="utf-8", errors="replace") as text:
            lines += [x.rstrip("\n").lstrip("\ufeff") for x in islice(text, n - len(lines))]
        if len(lines) >= n:
            break
    return lines


def delimiter_of(uri: str, lines: list[str]) -> str | None:
    """How a file's records end, by its first lines, or by as many as its first record has; None if nothing ends them."""
    n = len(lines)
    while True:
        try:
            return detect_delimiter(lines)
        except ValueError:
            lines = first_lines(uri, 8 * max(n, SNIFF_LINES))
            if len(lines) <= n:
                return None
            n = len(lines)


def sniff(spark: SparkSession, files: Sequence[str]) -> list[tuple[str | None, str]]:
    """Kind and delimiter of each file, from its first lines; one job for all files, and no more is read than that takes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds, delimiters = [], []
            for uri in b.column("uri").to_pylist():
                lines = first_lines(uri)
                kinds.append(detect_parser(lines))
                delimiters.append(delimiter_of(uri, lines) if kinds[-1] in ("ris", "pubmed") else "")
            yield pa.RecordBatch.from_arrays([b.column("at"), pa.array(kinds, pa.string()), pa.array(delimiters, pa.string())], names=["at", "kind", "delimiter"])

    rows = spark.createDataFrame([(i, f) for i, f in enumerate(files)], "at long, uri string").repartition(max(1, min(len(files), spark.sparkContext.defaultParallelism)))
    found = {r.at: r for r in rows.mapInArrow(run, "at long, kind string, delimiter string").collect()}  # a row a file named in the call
    for i, f in enumerate(files):
        if found[i].delimiter is None:
            raise ValueError(f"{f}: records have no delimiter")
    return [(found[i].kind, found[i].delimiter) for i in range(len(files))]


def match_columns(df: DataFrame) -> DataFrame:
    """Columns that are tags get their fields' names; these come first."""
    known = [(c, RIS_FIELDS[c]) for c in df.columns if c in RIS_FIELDS]
    names = make_unique([*(n for _, n in known), *(c for c in df.columns if c not in RIS_FIELDS)])
    order = [*(c for c, _ in known), *(c for c in df.columns if c not in RIS_FIELDS)]
    return df.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(order, names, strict=True)))


def clean_colnames(names: Sequence[str]) -> list[str]:
    """X., Y. and Z. at the front go, and punctuation; points become _, longer names lower case, authors author."""
    out = []
    for n in names:
        n = re.sub(r"[^\w.\s]", "", re.sub(r"^[XYZ]\.+", "", n)).strip(".")
        n = re.sub(r"[.\s]+", "_", n).strip("_")
        n = n.lower() if len(n) > 2 else n
        out.append({"authors": "author"}.get(n, n) or "V")
    return make_unique(out)


def read_delimited(spark: SparkSession, files: Sequence[str], sep: str) -> DataFrame:
    """file and the columns of tables with a header; fields in quotes may hold line breaks."""
    df = spark.read.csv(list(files), header=True, sep=sep, quote='"', escape='"', multiLine=True)
    path = df.select("*", F.col("_metadata.file_path").alias("__file"))
    own = path.toDF(*clean_colnames(df.columns), "file")
    return match_columns(own)


def read_refs(spark: SparkSession, files: Sequence[str], tag_naming: Mapping[str, str] | str | None = "best_guess", fields: Sequence[str] | None = None) -> DataFrame:
    """file and the columns of citation files, union by name; fields: only these, where they occur. A file of no known kind
    is left out with a warning."""
    groups: dict[tuple[str, str], list[str]] = {}
    files = [qualified(spark, f) for f in files]
    for f, (kind, delimiter) in zip(files, sniff(spark, files), strict=True):
        if kind is None:
            warnings.warn(f"{f}: no known kind of citation file", stacklevel=2)
        else:
            groups.setdefault((kind, delimiter), []).append(f)
    parts = []
    for (kind, delimiter), some in groups.items():
        if kind in ("csv", "tsv"):
            df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [read_delimited(spark, [f], "," if kind == "csv" else "\t") for f in some])
            own = [c for c in df.columns if c != "file"]
            df = df.select("file", *(c for c in own if fields is None or c in fields))
        else:
            rows = bibtex.records_of(spark, some) if kind == "bibtex" else ris.with_fields(ris.records_of(spark, some, delimiter, kind == "pubmed"), tag_naming, kind == "pubmed")
            own = ris.present(rows)
            if kind == "pubmed":
                df = ris.pubmed_columns(ris.citations(rows, own))
                df = df.select("file", *(c for c in df.columns if c != "file" and (fields is None or c in fields)))
            else:
                own = [*own, "journal_secondary"] if "journal" in own and kind == "ris" else own
                df = ris.citations(rows, [c for c in own if fields is None or c in fields])
        parts.append(ris.clean_authors(df))
    if not parts:
        raise ValueError("no citation files")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def drop_near_empty(df: DataFrame, ignore: Sequence[str] = ("file", *TAGS)) -> DataFrame:
    """Rows with two fields or more that aren't null."""
    full = sum((F.col(f"`{c}`").isNotNull().cast("int") for c in df.columns if c not in ignore), F.lit(0))
    return df.where(full > 1)


def tagged(df: DataFrame, tags: DataFrame, by: str = "file") -> DataFrame:
    """df with the provenance tags of each file, or of the folder that it lies in; tags has a row a file or folder."""
    own = [c for c in tags.columns if c != by]
    folder = tags.select(F.col(by).alias("__folder"), *(F.col(c).alias(f"__{c}") for c in own), F.lit(True).alias("__in"))
    out = df.withColumn(by, F.regexp_replace(by, "^file:/+", "file:/")).withColumn("__folder", F.regexp_replace(by, "/[^/]*$", "")).join(tags, by, "left").join(folder, "__folder", "left")
    out = out.withColumns({c: F.when(F.col("__in"), F.col(f"__{c}")).otherwise(F.col(c)) for c in own})
    return out.drop(by, "__folder", "__in", *(f"__{c}" for c in own))


def read_citations(
    spark: SparkSession,
    files: Sequence[str] | None = None,
    cite_sources: Sequence[str] | None = None,
    cite_strings: Sequence[str | None] | None = None,
    cite_labels: Sequence[str | None] | None = None,
    metadata: Mapping[str, Sequence] | None = None,
    tag_naming: Mapping[str, str] | str | None = "best_guess",
    only_key_fields: bool | Sequence[str] = True,
) -> DataFrame:
    """Citations of files with the tags cite_source, cite_label and cite_string, one of each a file.

    Sources are by default the files' stems, made unique. only_key_fields: False for all fields, or further fields to keep.
    metadata: files, cite_sources, cite_strings and cite_labels in one mapping. A file may be a folder of files.
    tag_naming: as ris.with_fields has it."""
    if (files is None) == (metadata is None):
        raise ValueError("either files or metadata")
    if metadata is not None:
        files, cite_sources, cite_strings, cite_labels = (metadata.get(k) for k in ("files", "cite_sources", "cite_strings", "cite_labels"))
    files = list(files)
    sources = list(cite_sources) if cite_sources is not None else make_unique(stem(f) for f in files)
    strings, labels = (list(x) if x is not None else [None] * len(files) for x in (cite_strings, cite_labels))
    for what, x in (("cite_sources", sources), ("cite_strings", strings), ("cite_labels", labels)):
        if len(x) != len(files):
            raise ValueError(f"{what}: one a file")
        if any("," in v for v in x if v):
            raise ValueError(f"{what}: no commas, which part the items of a list")
    fields = None if only_key_fields is False else [*KEY_FIELDS, *(only_key_fields if not isinstance(only_key_fields, bool) else ())]
    rows = [(re.sub("^file:/+", "file:/", qualified(spark, f)).rstrip("/"), *t) for f, t in zip(files, zip(sources, labels, strings, strict=True), strict=True)]
    tags = spark.createDataFrame(rows, "file string, cite_source string, cite_label string, cite_string string").dropDuplicates(["file"])
    return tagged(drop_near_empty(read_refs(spark, files, tag_naming, fields)), F.broadcast(tags))  # a row a file named in this call


def reimport_csv(spark: SparkSession, path: str) -> DataFrame:
    """Unique citations that export_csv wrote without separate columns."""
    df = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)
    require(df, [*TAGS, "duplicate_id", "record_ids"])
    return df


def reimport_ris(spark: SparkSession, path: str, source_field: str = "DB", label_field: str = "C7", string_field: str = "C8", duplicate_id_field: str = "C1", record_id_field: str = "C2", tag_naming: Mapping[str, str] | str | None = None) -> DataFrame:
    """Unique citations that export_ris wrote; identifiers that a file lacks are numbers of its rows. tag_naming: one of
    ris.NAMINGS or further names for tags."""
    from ..operators.numbering import numbered

    own = {source_field: "cite_source", label_field: "cite_label", string_field: "cite_string", duplicate_id_field: "duplicate_id", record_id_field: "record_ids"}
    names = dict(ris.NAMINGS[tag_naming] if isinstance(tag_naming, str) else tag_naming or {})
    df = read_refs(spark, [path], names | {k: v for k, v in own.items() if k}).drop("file")
    df = df.withColumns({c: F.lit(None).cast("string") for c in TAGS if c not in df.columns})
    for c in ("duplicate_id", "record_ids"):
        if c not in df.columns:
            df = numbered(df, c)
    return df


def guess_year(df: DataFrame, column: str = "year") -> DataFrame:
    """Null years from columns named like a date, but for those of access: the most frequent run of four characters."""
    dates = [c for c in df.columns if "date" in c.lower() and "access" not in c.lower()]
    runs = F.flatten(F.array(*(F.regexp_extract_all(F.coalesce(F.col(f"`{c}`"), F.lit("")), F.lit(r"\b(\w{4})\b"), F.lit(1)) for c in dates))) if dates else F.array().cast("array<string>")
    counted = F.transform(F.array_distinct(runs), lambda x: F.struct(F.size(F.filter(runs, lambda y: y == x)).alias("n"), F.array_position(runs, x).cast("int").alias("at"), x.alias("x")))
    best = F.try_element_at(F.array_sort(counted, lambda a, b: F.when(a.n != b.n, b.n - a.n).otherwise(a["at"] - b["at"])), F.lit(1)).x
    return df.withColumn(column, F.coalesce(F.col(column) if column in df.columns else F.lit(None), best))
