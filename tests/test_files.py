import pytest

from tagweave.operators import dedup
from tagweave.plans import render
from tagweave.operators import counts
from tagweave.sources import reader, writers

BIB = """@article{shiny,
  title = {A title that
    goes on},
  author = {One, A. and Two, B. and Three, C. and Four, D.},
  year = {2019},
  journal = {Journal}
}
"""
RIS = "﻿TY  - JOUR\r\nAU  - Smith, J.\r\nAU  - Lee, K.\r\nTI  - First title.\r\nPY  - 2001/05\r\nSP  - 10\r\nEP  - 19\r\nT2  - A Journal of Things\r\nJO  - Journal\r\nAB  - Some\r\n  more text\r\nZZ  - odd\r\nER  - \r\n\r\nTY  - JOUR\r\nAU  - Solo, H.\r\nTI  - Second\r\nTI  - Second\r\nPY  - 1999\r\nER  - \r\n"


def put(path, text):
    path.write_text(text, newline="")
    return str(path)


def test_bibtex(spark, tmp_path):
    got = reader.read_citations(spark, [put(tmp_path / "mine", BIB)], cite_labels=["C"]).collect()
    assert len(got) == 1 and got[0].cite_label == "C" and got[0].cite_source == "mine"
    assert got[0].title == "A title that goes on" and got[0].author == "One, A. and Two, B. and Three, C. and Four, D."


def test_ris(spark, tmp_path):
    got = {r.title: r for r in reader.read_citations(spark, [put(tmp_path / "1_WoS.ris", RIS)], only_key_fields=False).collect()}
    first = got["First title"]
    assert (first.author, first.year, first.pages, first.journal, first.abstract, first.ZZ, first.cite_source) == ("Smith, J. and Lee, K.", "2001", "10-19", "Journal", "Some more text", "odd", "1_WoS")
    assert got["Second"].author == "Solo, H." and first.journal_secondary == "A Journal of Things" and got["Second"].journal_secondary is None


def test_blank_line_records_and_other_dialect(spark, tmp_path):
    text = "TY - JOUR\nA1 - Smith, J.\nT1 - One\nY1 - 2001\n\nTY - JOUR\nA1 - Lee, K.\nT1 - Two\nY1 - 2002\n"
    got = reader.read_citations(spark, [put(tmp_path / "a.ris", text)]).collect()
    assert sorted((r.title, r.author, r.year) for r in got) == [("One", "Smith, J.", "2001"), ("Two", "Lee, K.", "2002")]


def test_pubmed(spark, tmp_path):
    text = "PMID- 123\nTI  - A title\n      goes on\nAU  - Smith J\nDP  - 2003 May\nAID - 10.1/x [doi]\n\nPMID- 124\nTI  - B\nAU  - Lee K\nDP  - 2004\n"
    got = {r.title: r for r in reader.read_refs(spark, [put(tmp_path / "p.nbib", text)]).collect()}
    assert got["A title goes on"].year == "2003" and got["A title goes on"].doi == "10.1/x"


def test_csv_and_union(spark, tmp_path):
    a = put(tmp_path / "a.csv", 'title,authors,year\n"One, two","Smith, J. and Lee, K.",2001\nThree,"Solo, H.",2002\n')
    b = put(tmp_path / "b.tsv", "TI\tPY\tX.note\nFour\t2003\tn\n")
    got = reader.read_citations(spark, [a, b], cite_sources=["A", "B"], cite_strings=["s", None]).collect()
    assert sorted((r.title, r.year, r.cite_source, r.cite_string) for r in got) == [("Four", "2003", "B", None), ("One, two", "2001", "A", "s"), ("Three", "2002", "A", "s")]


def test_checks_of_tags(spark, tmp_path):
    f = put(tmp_path / "a.bib", BIB)
    for bad in ({"cite_sources": ["a", "b"]}, {"cite_labels": ["a,b"]}, {"metadata": {"files": [f]}}):
        with pytest.raises(ValueError):
            reader.read_citations(spark, [f], **bad)
    assert reader.make_unique(["a", "a", "b", "a"]) == ["a", "a_1", "b", "a_2"]


def unique(spark):
    return spark.createDataFrame(
        [("1", "1, 2", "A, B", "search, final", "s", "Smith, J. and Lee, K.", "On things", "2001", "10-19", "x" * 10), ("2", "3", "A", "search", None, "Solo, H.", "Others", "1999", None, None)],
        "duplicate_id string, record_ids string, cite_source string, cite_label string, cite_string string, author string, title string, year string, pages string, abstract string",
    )


def test_ris_round_trip(spark, tmp_path):
    writers.export_ris(unique(spark).coalesce(1), str(tmp_path / "out"))
    got = {r.duplicate_id: r for r in reader.reimport_ris(spark, str(tmp_path / "out")).collect()}
    assert (got["1"].record_ids, got["1"].cite_source, got["1"].cite_label, got["1"].author, got["1"].pages) == ("1, 2", "A, B", "search, final", "Smith, J. and Lee, K.", "10-19")
    assert got["2"].title == "Others"


def test_csv_round_trip(spark, tmp_path):
    writers.export_csv(unique(spark), str(tmp_path / "out"), trim_abstracts=4)
    got = {r.duplicate_id: r for r in reader.reimport_csv(spark, str(tmp_path / "out")).collect()}
    assert got["1"].abstract == "xxxx" and got["1"].cite_source == "A, B"
    parts = writers.csv_frame(unique(spark), ["cite_source"])
    assert {r.duplicate_id: (r.source_A, r.source_B) for r in parts.collect()} == {"1": (True, True), "2": (True, False)}


def test_bib_export(spark, tmp_path):
    text = "".join(r.value for r in writers.as_text(writers.bib_note(unique(spark)), "bib").collect())
    assert "note={cite_source: A, B; cite_label: search, final; cite_string: s}" in text and "@ARTICLE{1," in text
    assert reader.read_refs(spark, [put(tmp_path / "x.bib", text)]).count() == 2


CITATIONS = [
    ("1", "A study of things", "Smith, J. and Lee, K.", "2001", "10.1/X", "Journal", "A"),
    ("2", "A study of things.", "Smith, J.; Lee, K.", "2001", "https://doi.org/10.1/x", None, "B"),
    ("3", "A Study of Things", "Smith, John", "2001", None, "Journal", "C"),
    ("4", "Something else", "Doe, J.", "2001", None, "Journal", "A"),
    ("5", "A study of thinks", "Smythe, J.", "2001", None, "Other", "D"),
]


def test_dedup_keeps_every_tag(spark):
    raw = spark.createDataFrame(CITATIONS, "record_id string, title string, author string, year string, doi string, journal string, cite_source string")
    got = {r.duplicate_id: r for r in dedup.dedup_citations(raw).collect()}
    assert got["1"].record_ids == "1, 2, 3" and "5" in got
    assert got["1"].cite_source.startswith("A, B") and got["1"].doi == "10.1/X" and "4" in got
    assert sum(len(r.record_ids.split(", ")) for r in got.values()) == 5
    unknown = dedup.dedup_citations(raw, show_unknown_tags=True).collect()
    assert all("unknown" in r.cite_label for r in unknown)


def test_manual_pairs(spark):
    raw = spark.createDataFrame(CITATIONS, "record_id string, title string, author string, year string, doi string, journal string, cite_source string")
    u, pairs = dedup.dedup_citations(raw, manual=True)
    assert {"title1", "title2", "title", "source1", "label2"} <= set(pairs.columns)
    merged = dedup.add_manual_pairs(u, spark.createDataFrame([("1", "4")], "duplicate_id1 string, duplicate_id2 string"))
    got = {r.duplicate_id: r for r in merged.collect()}
    assert "4" not in got and got["1"].record_ids.endswith("4")


def test_all_of_a_block_are_compared(spark, monkeypatch):
    """Duplicates further apart in a block than any window, and doubtful pairs of larger groups, against brute force."""
    import itertools

    from pyspark.sql import functions as F

    import tagweave.operators.dedup as d

    monkeypatch.setattr(d, "PART", 7)
    rows = [(f"r{i:03d}", f"{chr(97 + i % 26)}{i:03d} words of a title", "Doe, A.", "10.1/x") for i in range(60)]
    pairs = {tuple(r) for r in d.candidate_pairs(d.keys(d.normalised(spark.createDataFrame(rows, "record_id string, title string, author string, doi string"))), [("doi",)]).collect()}
    assert pairs == set(itertools.combinations([r[0] for r in rows], 2))
    rows = [(f"a{i:02d}" if i % 2 else f"z{i:02d}", "a long enough title of a paper", "Doe, John" if i < 30 else "Doe, Johanna Mary", None if i < 30 else "10.1/y", "s", "search") for i in range(60)]
    raw = spark.createDataFrame(rows, "record_id string, title string, author string, doi string, cite_source string, cite_label string").withColumn("year", F.when(F.col("doi").isNull(), "2001").otherwise("2002"))
    unique, doubtful = d.dedup_citations(raw, manual=True)
    assert unique.count() == 2
    one, two = ([r[0] for r in rows if (r[3] is None) == first] for first in (True, False))
    author = {r[0]: r[2].upper().replace(",", "") for r in rows}
    found = doubtful.collect()
    assert {(r.id1, r.id2) for r in found} == {tuple(sorted(p)) for p in itertools.product(one, two)} and len(found) == 900
    assert all((r.author1, r.author2) == (author[r.id1], author[r.id2]) for r in found)


def test_similar_titles_without_other_fields(spark):
    """Titles that differ in one place, at the beginning or the end, against the rule for doubtful pairs on all pairs."""
    import itertools
    import random

    from tagweave.functions.similarity import jaro_winkler_similarity

    rng, titles = random.Random(4), []
    for _ in range(12):
        words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(8)]
        titles += [" ".join(words), " ".join([*words[:-1], "qqqqqq"]), " ".join(["qqqqqq", *words[1:]])]
    rows = [(f"{i:02d}", t, "Doe, A.", "s") for i, t in enumerate(titles)]
    _, doubtful = dedup.dedup_citations(spark.createDataFrame(rows, "record_id string, title string, author string, cite_source string"), manual=True)
    score = {(a[0], b[0]): jaro_winkler_similarity(a[1].upper(), b[1].upper()) for a, b in itertools.combinations(rows, 2)}
    want = {p for p, x in score.items() if 0.85 <= x < 0.99}
    assert {(r.id1, r.id2) for r in doubtful.collect()} == want and len(want) >= 12 and max(score.values()) < 0.99


def test_numbered_titles_stay_apart(spark):
    rows = [(f"{i:02d}", f"Study {i:03d} about matters", "Doe, A.", "2001", None, "s") for i in range(30)]
    rows += [(f"v{i:02d}", "Proceedings of the society", "Doe, A.", "2001", str(i), "s") for i in range(30)]
    rows += [("d1", "Proceedings of the academy", "Doe, A.", "2001", "99", "s"), ("d2", "Proceedings of the Academy.", "Doe, A.", "2001", "99", "t")]
    got = dedup.dedup_citations(spark.createDataFrame(rows, "record_id string, title string, author string, year string, volume string, cite_source string")).collect()
    assert len(got) == 61 and [r.record_ids for r in got if "," in r.record_ids] == ["d1, d2"]


def test_dialects(spark, tmp_path):
    wos = "PT J\nAU Smith, J\n   Lee, K\nTI A title\n   goes on\nSO A Journal\nPY 2001\nVL 4\nBP 10\nEP 19\nDI 10.1/x\nUT WOS:1\nC1 Univ X\n   Univ Y\nER\n\nPT J\nAU Solo, H\nTI Other\nSO B\nPY 2002\nDI 10.1/y\nUT WOS:2\nER\n"
    ovid = "TY  - JOUR\nID  - 1\nT1  - A title\nA1  - Smith, J.\nA1  - Lee, K.\nY1  - 2001//\nJF  - A Journal\nM1  - 77\nXT  - Article\nER  - \n"
    files = [put(tmp_path / "w.ris", wos), put(tmp_path / "o.ris", ovid)]
    got = {r.cite_source + r.title: r for r in reader.read_citations(spark, files, only_key_fields=False).collect()}
    first, second = got["wA title goes on"], got["oA title"]
    assert (first.author, first.journal, first.pages, first.doi, first.accession, first.address) == ("Smith, J and Lee, K", "A Journal", "10-19", "10.1/x", "WOS:1", "Univ X and Univ Y")
    assert (second.author, second.journal, second.year, second.accession, second.document_type) == ("Smith, J. and Lee, K.", "A Journal", "2001", "77", "Article")
    plain = reader.read_citations(spark, files[1:], tag_naming="generic", only_key_fields=False).first()
    assert plain.number == "77" and plain.XT == "Article"
    assert {"T1", "A1"} <= set(reader.read_refs(spark, files[1:], "none").columns)
    with pytest.raises(ValueError):
        reader.read_refs(spark, files, "no such dialect")


def test_year_of_an_unknown_tag(spark, tmp_path):
    text = "".join(f"TY  - JOUR\nTI  - T{i}\nZY  - {1990 + i}\nZN  - {i}\nER  - \n" for i in range(12))
    got = reader.read_citations(spark, [put(tmp_path / "a.ris", text)]).collect()
    assert sorted(r.year for r in got) == [str(1990 + i) for i in range(12)]
    assert reader.read_refs(spark, [put(tmp_path / "b.ris", text.replace("ZY  - 1990", "ZY  - x").replace("ZY  - 1991", "ZY  - y"))]).columns.count("year") == 0


def test_many_fields_and_journal_names(spark, tmp_path):
    names = [f"JO  - Journal of {'x' * i}" for i in range(1100)]
    got = reader.read_citations(spark, [put(tmp_path / "a.ris", "\n".join(["TY  - JOUR", "TI  - T", *names, "ER  - ", ""]))], only_key_fields=["journal_secondary"]).first()
    assert len(got.journal_secondary.split("; ")) == 1099
    assert got.__fields__[:3] != sorted(got.__fields__)[:3]
    from tagweave.sources import ris

    fields = spark.createDataFrame([([("a", "1"), ("b", "2"), ("c", "3")],)], "fields array<struct<field:string,text:string>>")
    assert ris.present(fields, 3) == ["a", "b", "c"]
    with pytest.raises(ValueError):
        ris.present(fields, 2)


def test_long_records_take_linear_time(spark):
    import time

    from pyspark.sql import functions as F

    from tagweave.sources import ris

    df = spark.createDataFrame([("TY  - JOUR\nAB  - a\n" + "more words\n" * 30000,)], "r string")
    t = time.time()
    assert df.select(F.size(ris.entries(F.col("r")))).first()[0] == 30002 and time.time() - t < 30


def test_rendered_tables(spark):
    u = spark.createDataFrame([("1", "S1", "screened"), ("2", "S|2", "final")], "duplicate_id string, cite_source string, cite_label string")
    table = render.precision_sensitivity_table(counts.phase_records(u))
    assert "Screened Included" in table.markdown() and "S\\|2" in table.markdown() and table.rows[-1][0] == "Total"
    assert "screened" not in render.precision_sensitivity_table(counts.phase_records(u.where("cite_label = 'final'"))).columns
    assert "<caption>Record Counts</caption>" in render.initial_record_table(counts.initial_records(u)).html()


def test_guess_year(spark):
    df = spark.createDataFrame([(None, "12 May 2004", "2020"), ("1999", "2004", "x")], "year string, pub_date string, access_date string")
    assert [r.year for r in reader.guess_year(df).collect()] == ["2004", "1999"]
