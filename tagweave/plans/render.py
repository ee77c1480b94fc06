"""Small result frames as Markdown or HTML tables with footnotes."""

from __future__ import annotations

import html as escape
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..operators.counts import TOTAL

#: Rows that a rendered table may have; more are an error, not cut off.
MOST_ROWS = 5_000


@dataclass
class Table:
    """A table with a title, headings, cells as text, and footnotes by column."""

    title: str
    columns: list[str]
    headings: list[str]
    rows: list[list[str]]
    notes: dict[str, str] = field(default_factory=dict)

    def _marks(self) -> dict[str, str]:
        return {c: str(i + 1) for i, c in enumerate(c for c in self.columns if c in self.notes)}

    def markdown(self) -> str:
        marks = self._marks()
        head = [h + (f"[^{marks[c]}]" if c in marks else "") for c, h in zip(self.columns, self.headings, strict=True)]
        lines = [f"**{self.title}**", "", "| " + " | ".join(head) + " |", "|" + "|".join("---" for _ in head) + "|"]
        lines += ["| " + " | ".join(x.replace("|", "\\|") for x in r) + " |" for r in self.rows]
        return "\n".join([*lines, "", *(f"[^{k}]: {self.notes[c]}" for c, k in marks.items())])

    def html(self) -> str:
        marks, e = self._marks(), escape.escape
        head = "".join(f"<th>{e(h)}{f'<sup>{marks[c]}</sup>' if c in marks else ''}</th>" for c, h in zip(self.columns, self.headings, strict=True))
        body = "".join("<tr>" + "".join(f"<td>{e(x)}</td>" for x in r) + "</tr>" for r in self.rows)
        notes = "".join(f"<p><sup>{k}</sup> {e(self.notes[c])}</p>" for c, k in marks.items())
        return f"<table><caption>{e(self.title)}</caption><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>{notes}"


_NOTES = {
    "Records_Imported": "Records as they came from the source.",
    "Distinct_Records": "Records that are left when a source's own duplicates are merged; the total counts each record once where it says so.",
    "Unique_Records": "Records that no other source has.",
    "Nonunique_Records": "Records that another source has as well.",
    "Source_Contribution": "Share of all distinct records, summed over sources.",
    "Source_Unique_Contribution": "Share of all unique records.",
    "Source_Unique": "Share of the source's records that are unique.",
    "screened": "Records kept after titles and abstracts were screened.",
    "final": "Records kept after full texts were screened.",
    "Precision": "Final records as a share of the source's distinct records.",
    "Recall": "Final records as a share of all final records.",
}


def cell(x: object) -> str:
    return "" if x is None else f"{x:,}" if isinstance(x, int) and not isinstance(x, bool) else f"{x:.2f}".rstrip("0").rstrip(".") if isinstance(x, float) else str(x)


def render(df: DataFrame, title: str, headings: Mapping[str, str], first: str = "Source", drop_zero: Sequence[str] = ()) -> Table:
    """df, sorted by its first column with the total last. drop_zero: columns left out if they have no other value than 0."""
    rows = df.select(*headings).limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} rows")
    rows.sort(key=lambda r: (r[first] == TOTAL, r[first] or ""))
    own = [c for c in headings if c not in drop_zero or any(r[c] for r in rows)]
    return Table(title, own, [headings[c] for c in own], [[cell(r[c]) for c in own] for r in rows], {c: _NOTES[c] for c in own if c in _NOTES})


_COUNTS = {"Source": "Source", "Records_Imported": "Records Imported", "Distinct_Records": "Distinct Records"}
_SUMMARY = _COUNTS | {
    "Unique_Records": "Unique Records",
    "Nonunique_Records": "Non-unique Records",
    "Source_Contribution": "Source Contribution %",
    "Source_Unique_Contribution": "Source Unique Contribution %",
    "Source_Unique": "Source Unique %",
}
_PHASES = {"Source": "Source", "Distinct_Records": "Distinct Records", "screened": "Screened Included", "final": "Final Included", "Precision": "Precision", "Recall": "Sensitivity/Recall"}


def initial_record_table(df: DataFrame) -> Table:
    return render(df, "Record Counts", _COUNTS)


def detailed_record_table(df: DataFrame) -> Table:
    return render(df, "Record Summary", _SUMMARY)


def precision_sensitivity_table(df: DataFrame) -> Table:
    return render(df, "Precision & Sensitivity", _PHASES, drop_zero=["screened"])


#: The same tables of frames that come from raw citations.
record_counts_table, record_summary_table = initial_record_table, detailed_record_table


def citation_summary_rendered(df: DataFrame) -> Table:
    share = lambda x: None if x is None else f"{100 * x:.2f}%"
    rows = df.limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} rows")
    rows.sort(key=lambda r: (r.stage != "search", r.stage, r.item == TOTAL, -r.Records_total, r.item))
    cells = [[r.stage, r.item, cell(r.Records_total), cell(r.Records_unique), *(cell(share(x)) for x in (r.Contribution_unique, r.Sensitivity, r.Precision))] for r in rows]
    names = ["stage", "item", "Records_total", "Records_unique", "Contribution_unique", "Sensitivity", "Precision"]
    notes = {"Records_unique": "Records of this stage that no other item has.", "Sensitivity": "Share of all records of the stage.", "Precision": "Share of the item's records of the search that reached the stage."}
    return Table("Citation Summary", names, ["Stage", "Item", "Total", "Unique", "Unique contribution", "Sensitivity", "Precision"], cells, notes)
