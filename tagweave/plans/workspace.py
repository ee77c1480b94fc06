"""A session over one collection of citations: imports, edits, duplicates, choices, tables and exports."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from ..functions import cite, tags
from ..operators import analyze, counts, dedup, edits
from ..sources import reader, writers
from ..schema import with_missing
from . import render


class Workspace:
    """citations are what was imported; unique and pairs are there once duplicates were looked for or a merged file was read.
    Frames are lazy; every method that changes one sets it anew."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.citations: DataFrame | None = None
        self.unique: DataFrame | None = None
        self.pairs: DataFrame | None = None
        self.merged_file = False

    def upload(self, files: Sequence[str], **options) -> DataFrame:
        """Adds files, with the label "search" unless labels are given, and returns the records of each source so far."""
        options.setdefault("cite_labels", ["search"] * len(files))
        new = with_missing(reader.read_citations(self.spark, files, only_key_fields=False, **options), ["doi", "abstract", "isbn", "issn"])
        self.citations = new if self.citations is None else self.citations.unionByName(new, allowMissingColumns=True)
        return counts.import_summary(self.citations)

    def reimport(self, path: str) -> DataFrame:
        """Reads an export of unique citations, by the kind in its name; duplicates aren't looked for again."""
        self.unique = reader.reimport_csv(self.spark, path) if "csv" in path.rstrip("/").rpartition("/")[2].lower() else reader.reimport_ris(self.spark, path)
        self.merged_file = True
        return self.unique

    def edit(self, changes: Mapping[str, Mapping[str, str]]) -> None:
        self.citations = edits.edit_tags(self.citations, changes)

    def find_duplicates(self) -> DataFrame:
        if self.merged_file:
            raise ValueError("a re-imported file has no duplicates left")
        self.unique, self.pairs = dedup.dedup_citations(dedup.with_record_ids(self.citations), manual=True, show_unknown_tags=True)
        return self.unique

    def merge(self, chosen: DataFrame) -> DataFrame:
        """Merges doubtful pairs (duplicate_id1, duplicate_id2) that a person chose, and takes them off the list."""
        self.unique = dedup.add_manual_pairs(self.unique, chosen)
        keys = ["duplicate_id1", "duplicate_id2"]
        self.pairs = self.pairs.join(chosen.select(*keys), keys, "left_anti")
        return self.unique

    def shown_pairs(self) -> DataFrame:
        return edits.pair_view(self.pairs)

    def chosen(self, sources: Iterable[str] = (), labels: Iterable[str] = (), strings: Iterable[str] = (), drop_emptied: bool = True) -> DataFrame:
        """Records with one of the items of each choice, and of their lists only these items."""
        want = {"cite_source": list(sources), "cite_label": list(labels), "cite_string": list(strings)}
        return tags.item_filter(tags.row_filter(self.unique, **want), drop_emptied, **want)

    def tables(self, **choice) -> dict[str, render.Table]:
        u = self.chosen(**choice)
        return {
            "initial": render.initial_record_table(counts.initial_records(u)),
            "detailed": render.detailed_record_table(counts.filtered_detailed_records(u)),
            "phases": render.precision_sensitivity_table(counts.phase_records(u)),
        }

    def plots(self, **choice) -> dict[str, DataFrame]:
        u = self.chosen(**choice)
        return {"heatmap": analyze.heatmap_data(u), "upset": analyze.set_intersections(u), "phases": analyze.contributions(analyze.phase_types(u), center=True)}

    def record_table(self, **options) -> DataFrame:
        return cite.record_level_table(self.unique, **options)

    def export(self, path: str, kind: str = "csv", **options) -> None:
        {"csv": writers.export_csv, "ris": writers.export_ris, "bib": writers.export_bib}[kind](self.unique, path, **options)
