import pytest

from tagweave.functions import tags
from tagweave.operators import analyze, counts

FRAME = "duplicate_id string, cite_source string, cite_label string, cite_string string"


@pytest.fixture(scope="module")
def unique(spark):
    return spark.createDataFrame(
        [("101", "A, A, B", "search, screened", "s1"), ("102", "A", "search", "s1, s2"), ("103", "B, C", "search, final, screened", ""), ("104", None, "final", None), ("105", "C, unknown", "search", "s1")],
        FRAME,
    )


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_count_unique_is_a_cross_product(unique):
    got = analyze.count_unique(unique)
    assert rows(got.where("duplicate_id = '102'"), "cite_source", "cite_label", "cite_string", "unique", "type") == [("A", "search", "s1", True, "unique"), ("A", "search", "s2", True, "unique")]
    assert got.where("duplicate_id = '101'").count() == 4  # two sources, two labels, one string
    assert got.where("duplicate_id = '104'").count() == 0
    assert not any(r.unique for r in got.where("duplicate_id in ('101', '103')").collect())


def test_compare_sources(unique):
    got = {r.duplicate_id: r for r in analyze.compare_sources(unique, "sources").collect()}
    assert got["101"]["source__A"] and got["101"]["source__B"] and not got["101"]["source__C"]
    assert not any(got["104"][c] for c in ("source__A", "source__B", "source__C"))
    with pytest.raises(ValueError):
        analyze.compare_sources(unique, "journals")


def test_overlap_is_symmetric_and_has_sizes_on_its_diagonal(unique):
    got = {(r.a, r.b): r.records for r in analyze.overlap(unique).collect()}
    assert all(got[b, a] == n for (a, b), n in got.items())
    assert {r["item"]: r.records for r in analyze.set_sizes(unique).collect()} == {a: n for (a, b), n in got.items() if a == b}


def test_intersections_add_up_to_the_records_with_a_source(unique):
    got = analyze.set_intersections(unique).collect()
    assert sum(r.records for r in got) == 4
    assert {(r["items"], r.degree, r.records) for r in got} == {("A&B", 2, 1), ("A", 1, 1), ("B&C", 2, 1), ("C&unknown", 2, 1)}
    assert [r["items"] for r in analyze.set_intersections(unique, order_by="degree", limit=1).collect()] == ["A"]


def test_percent_labels(spark):
    df = spark.createDataFrame([(0.004, False, 1), (0.5, False, 2), (1.0, True, 7)], "s double, d boolean, n long")
    assert [r[0] for r in df.select(analyze.share_label(df.s, df.d, df.n)).collect()] == ["< 1%", "50%", "7"]


def test_centered_contributions(unique):
    got = analyze.contributions(analyze.count_unique(unique), center=True).collect()
    assert all((r.signed_n > 0) == (r.type == "unique") for r in got)


def test_contributions_in_order(unique):
    got = analyze.contributions(analyze.count_unique(unique), center=True, bar_order=["screened", "search"], facet_order=["C", "A"], color_order=["duplicated", "unique"])
    found = [(r.cite_source, r.cite_label, r.type) for r in got.collect()]
    facets, bars = [x[0] for x in found], ["screened", "search", "final"]
    assert facets == sorted(facets, key=lambda x: (["C", "A"].index(x) if x in ("C", "A") else 2, str(x)))
    assert all(bars.index(a[1]) <= bars.index(b[1]) for a, b in zip(found, found[1:]) if a[0] == b[0])
    assert all((r.signed_n > 0) == (r.type == "duplicated") for r in got.collect())
    one = analyze.contributions(analyze.count_unique(unique), facets=None)
    assert one.columns == ["cite_label", "type", "n"] and one.agg({"n": "sum"}).first()[0] == analyze.count_unique(unique).count()
    with pytest.raises(ValueError, match="nowhere"):
        analyze.contributions(unique, facets="nowhere", color="cite_string")


def test_warnings_of_labels(spark, unique):
    with pytest.warns(UserWarning, match="1 records lack the label search"):
        assert analyze.outside_search(analyze.compare_sources(unique, "labels")) == 1
    several = spark.createDataFrame([("1", "A", "search 1", ""), ("2", "A", "Search 2", "")], FRAME)
    assert analyze.outside_search(analyze.compare_sources(several, "labels")) == 0
    assert counts.absent_phases(unique) == []
    with pytest.warns(UserWarning, match="screened or final"):
        assert counts.absent_phases(several) == ["screened", "final"]
    with pytest.warns(UserWarning):
        assert counts.absent_phases(unique.limit(0)) == ["screened", "final"]


def test_filters(unique):
    assert rows(tags.row_filter(unique, cite_source=["C"]), "duplicate_id") == [("103",), ("105",)]
    assert rows(tags.item_filter(unique, True, cite_source=["A"]), "duplicate_id", "cite_source") == [("101", "A"), ("102", "A")]
    assert rows(tags.label_filter(unique, ["FINAL"]), "duplicate_id") == [("103",), ("104",)]
    assert tags.label_filter(unique, ["fin.l"], literal=True).count() == 0
    assert ("cite_source", "unknown") not in rows(tags.choices(unique, ["cite_source"], True), "tag", "value")


def test_record_summary_of_the_documented_example(spark):
    u = spark.createDataFrame([(str(i), s) for i, s in enumerate(["D1", "D1", "D2", "D3", "D3", "D3"])], "duplicate_id string, cite_source string")
    raw = spark.createDataFrame([(s,) for s in ["D1", "D1", "D1", "D2", "D2", "D3"]], "cite_source string")
    n = spark.createDataFrame([("0", "D1", "search", True), ("2", "D2", "final", False), ("3", "D2", "search", True), ("4", "D3", "search", True), ("5", "D3", "search", True), ("6", "D3", "final", False)], "duplicate_id string, cite_source string, cite_label string, unique boolean")
    got = {r.Source: tuple(r)[1:] for r in counts.record_summary(u, raw, n).collect()}
    assert got == {"D1": (3, 2, 1, 1, "33.3%", "25.0%", "50.0%"), "D2": (2, 1, 1, 0, "16.7%", "25.0%", "100.0%"), "D3": (1, 3, 2, 1, "50.0%", "50.0%", "66.7%"), "Total": (6, 6, 4, 2, None, None, None)}


def test_phase_records_of_the_documented_example(spark):
    u = spark.createDataFrame([("1", "S1", "screened"), ("2", "S2", "screened"), ("3", "S3", "final")], "duplicate_id string, cite_source string, cite_label string")
    got = {r.Source: tuple(r)[1:] for r in counts.phase_records(u).collect()}
    assert got == {"S1": (1, 1, 0, 0.0, 0.0), "S2": (1, 1, 0, 0.0, 0.0), "S3": (1, 0, 1, 100.0, 100.0), "Total": (3, 2, 1, 33.33, None)}


def test_phase_count_of_the_documented_example(spark):
    data = [("D1", "screened", "102"), ("D1", "final", "102"), ("D2", "screened", "103"), ("D3", "final", "103"), ("D3", "screened", "104"), ("D3", "final", "104")]
    u = spark.createDataFrame([(s, lab, i) for s, lab, i in data], "cite_source string, cite_label string, duplicate_id string")
    raw = spark.createDataFrame([(lab,) for lab in ["screened", "final"] * 3], "cite_label string")
    got = {r.Source: (r.screened, r.final, r.Recall) for r in counts.phase_count(u, raw).collect()}
    assert got["D1"] == (1, 1, 33.33) and got["D2"] == (1, 0, 0.0) and got["D3"] == (1, 2, 66.67) and got["Total"] == (3, 3, None)


def test_initial_records(spark, unique):
    three = spark.createDataFrame([("1", "S1", "search"), ("2", "S2", "search"), ("3", "S3", "search")], "duplicate_id string, cite_source string, cite_label string")
    assert {r.Source: tuple(r)[1:] for r in counts.initial_records(three).collect()} == {"S1": (1, 1), "S2": (1, 1), "S3": (1, 1), "Total": (3, 3)}
    assert {r.Source: tuple(r)[1:] for r in counts.initial_records(unique).collect()}["A"] == (3, 2)
    assert counts.initial_records(three, ["nothing"]).count() == 0
    n = analyze.count_unique(unique)
    assert counts.detailed_records(unique, n, ["nothing"]).count() == 0
    with pytest.raises(ValueError):
        counts.initial_records(three.drop("cite_label"))


def test_summary_of_stages(unique):
    got = {(r.stage, r["item"]): r for r in counts.citation_summary(unique).collect()}
    assert got["search", "A"].Records_total == 2 and got["search", "A"].Records_unique == 1
    assert got["final", "Total"].Records_total == 2 and got["final", "B"].Precision == 0.5
    assert {r["item"] for r in counts.citation_summary(unique, top_n=1).collect()} <= {"A", "B", "C", "Total"}
