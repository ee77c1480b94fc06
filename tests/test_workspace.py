import warnings

import pytest

from tagweave.plans.workspace import Workspace

RECORDS = [("A study of things", "Smith, J.", "2001", "10.1/x"), ("Others and more", "Doe, J.", "2002", ""), ("Third of them", "Lee, K.", "2003", "")]


def ris(path, records):
    path.write_text("".join(f"TY  - JOUR\nAU  - {a}\nTI  - {t}\nPY  - {y}\n{f'DO  - {d}{chr(10)}' if d else ''}ER  - \n\n" for t, a, y, d in records))
    return str(path)


def test_a_session(spark, tmp_path):
    w = Workspace(spark)
    seen = w.upload([ris(tmp_path / "one.ris", RECORDS[:2]), ris(tmp_path / "two.ris", [RECORDS[0], RECORDS[2]])])
    assert {r.cite_source: r.records for r in seen.collect()} == {"one": 2, "two": 2}
    w.upload([ris(tmp_path / "fin.ris", RECORDS[:1])], cite_labels=["final"])
    w.edit({"fin": {"cite_source": ""}, "two": {"cite_source": "second", "cite_string": "s2"}})
    with pytest.raises(ValueError):
        w.edit({"one": {"title": "x"}})
    got = {r.title: r for r in w.find_duplicates().collect()}
    first = got["A study of things"]
    assert len(got) == 3 and sorted(first.cite_source.split(", ")) == ["one", "second", "unknown"] and sorted(first.cite_label.split(", ")) == ["final", "search", "search"]
    tables = w.tables(sources=["one", "second"])
    assert [r[:3] for r in tables["initial"].rows] == [["one", "2", "2"], ["second", "2", "2"], ["Total", "4", "4"]]
    assert {(r.a, r.b): r.records for r in w.plots(sources=["one", "second"])["heatmap"].collect()}["second", "one"] == 1
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        assert w.record_table().count() == 3
    chosen = spark.createDataFrame([tuple(sorted((got["Others and more"].duplicate_id, got["Third of them"].duplicate_id)))], "duplicate_id1 string, duplicate_id2 string")
    assert w.merge(chosen).count() == 2 and w.shown_pairs().count() == 0
    w.export(str(tmp_path / "csv_out"))
    again = Workspace(spark)
    assert again.reimport(str(tmp_path / "csv_out")).count() == 2
    with pytest.raises(ValueError):
        again.find_duplicates()
