"""Columns of citation frames and the dictionary of RIS tags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The fields that an import keeps by default.
KEY_FIELDS = (
    "author", "title", "year", "journal", "abstract", "doi", "number", "pages", "volume", "isbn", "record_id", "label", "source", "issue", "url", "issn", "start_page", "ID",
)
TAGS = ("cite_source", "cite_label", "cite_string")

#: Public RIS tags and the fields that they go to, in the order in which a record is written.
RIS_FIELDS: dict[str, str] = {
    "TY": "type", "DB": "database", "C1": "custom1", "C2": "custom2", "C3": "custom3", "C4": "custom4", "C5": "custom5", "C6": "custom6", "C7": "custom7", "C8": "custom8",
    "AU": "author", "A1": "author", "A2": "editor", "ED": "editor", "TI": "title", "T1": "title", "ST": "short_title", "PY": "year", "Y1": "year", "DA": "date",
    "T2": "journal", "JO": "journal", "JF": "journal", "JA": "journal_abbreviation", "J2": "journal_abbreviation", "AB": "abstract", "N2": "abstract", "DO": "doi",
    "VL": "volume", "IS": "issue", "M1": "number", "SP": "pages", "EP": "pages", "SN": "issn", "BN": "isbn", "UR": "url", "L1": "file", "KW": "keywords", "ID": "ID",
    "AN": "accession", "LA": "language", "DP": "database_provider", "PB": "publisher", "CY": "place", "AD": "address", "N1": "notes", "CP": "conference", "ET": "edition", "ER": "end",
}
#: Fields of MEDLINE's tags.
PUBMED_FIELDS: dict[str, str] = {
    "PMID": "pubmed_id", "AU": "author", "FAU": "author_full", "TI": "title", "AB": "abstract", "AD": "address", "DP": "date_published", "JT": "journal", "TA": "journal_abbreviation",
    "VI": "volume", "IP": "issue", "PG": "pages", "AID": "article_id", "LID": "article_id", "IS": "issn", "LA": "language", "MH": "keywords", "OT": "term_other", "PT": "type",
}

#: Tags of several databases' exports that mean something else than RIS_FIELDS says, or that it lacks; the public formats.
DIALECTS: dict[str, dict[str, str]] = {
    "wos": {
        "PT": "type", "AU": "author", "AF": "author_full", "TI": "title", "SO": "journal", "LA": "language", "DT": "document_type", "DE": "keywords", "ID": "keywords_plus", "AB": "abstract", "C1": "address",
        "RP": "reprint_address", "EM": "email", "CR": "references", "NR": "n_references", "TC": "times_cited", "PU": "publisher", "PI": "place", "PA": "publisher_address", "SN": "issn", "EI": "eissn",
        "BN": "isbn", "J9": "journal_abbreviation", "JI": "journal_iso", "PD": "date", "PY": "year", "VL": "volume", "IS": "issue", "BP": "pages", "EP": "pages", "AR": "article_number", "DI": "doi", "PG": "n_pages",
        "WC": "category", "SC": "research_area", "GA": "document_delivery", "UT": "accession", "PM": "pubmed_id",
    },
    "scopus": {
        "TY": "type", "TI": "title", "T2": "journal", "J2": "journal_abbreviation", "VL": "volume", "IS": "issue", "SP": "pages", "EP": "pages", "PY": "year", "DO": "doi", "SN": "issn", "AU": "author", "AD": "address",
        "AB": "abstract", "KW": "keywords", "PB": "publisher", "N1": "notes", "M3": "document_type", "DB": "database", "C2": "pubmed_id", "C7": "article_number", "LA": "language", "UR": "url", "A2": "editor",
    },
    "ovid": {
        "TY": "type", "ID": "ID", "T1": "title", "A1": "author", "Y1": "year", "N2": "abstract", "KW": "keywords", "JF": "journal", "JA": "journal_abbreviation", "LA": "language", "VL": "volume", "IS": "issue",
        "SP": "pages", "EP": "pages", "CY": "place", "PB": "publisher", "SN": "issn", "AD": "address", "M1": "accession", "M2": "notes", "UR": "url", "DO": "doi", "XT": "document_type",
    },
    "asp": {
        "TY": "type", "ID": "accession", "T1": "title", "AU": "author", "A1": "author", "Y1": "year", "N2": "abstract", "KW": "keywords", "JF": "journal", "JO": "journal", "VL": "volume", "IS": "issue", "SP": "pages",
        "EP": "pages", "PB": "publisher", "SN": "issn", "AD": "address", "M3": "document_type", "N1": "notes", "UR": "url", "DP": "database_provider", "DB": "database",
    },
}


def with_missing(df: DataFrame, columns: list[str] | tuple[str, ...]) -> DataFrame:
    """df with the columns that it lacks, as null strings."""
    return df.withColumns({c: F.lit(None).cast("string") for c in columns if c not in df.columns})


def require(df: DataFrame, columns: list[str] | tuple[str, ...]) -> None:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
