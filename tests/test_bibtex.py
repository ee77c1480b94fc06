from tagweave.sources import bibtex

ENTRY = "@article{{k{0},\n  title = {{Title {0}}},\n  author = {{Doe, A.}},\n  year = {{2001}}\n}}\n"


def test_large_files_are_cut_at_entries(spark, tmp_path):
    """The plan reads no file whole, and tasks share a file; entries are those of the whole text."""
    path = tmp_path / "a b.bib"
    path.write_text("".join(ENTRY.format(i) for i in range(2000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = bibtex.records_of(spark, [f"file://{tmp_path}/a b.bib"])
        assert got.rdd.getNumPartitions() > 3
        assert sorted(dict((x.field, x.text) for x in r.fields)["title"] for r in got.collect()) == sorted(f"Title {i}" for i in range(2000))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_lines_that_begin_with_an_at_sign(spark, tmp_path):
    """Within a value, after spaces, after comments, and after a carriage return."""
    odd = "% made by hand\n@article{a,\n  title = {One\n@home and\n@work},\n  year = {2001}\n}\n  @book{b,\n  title = {Two},\n  year = {2002}\n}\n"
    (tmp_path / "o d.bib").write_text(odd, newline="")
    (tmp_path / "cr.bib").write_text("﻿" + "".join(ENTRY.format(i) for i in range(3)).replace("\n", "\r"), newline="")
    rows = bibtex.records_of(spark, [f"file://{tmp_path}/o d.bib", f"file://{tmp_path}/cr.bib"]).collect()
    titles = sorted(dict((x.field, x.text) for x in r.fields)["title"] for r in rows)
    assert titles == ["One @home and @work", "Title 0", "Title 1", "Title 2", "Two"]
