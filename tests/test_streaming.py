from tagweave.streaming import incremental


def test_files_are_counted_as_they_come(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    put = lambda name, n: (folder / name).write_text("".join(f"TY  - JOUR\nAU  - A{i}\nTI  - T{i}\nER  - \n\n" for i in range(n)))
    put("one.ris", 3)
    records = incremental.stream_ris(spark, str(folder), cite_label="search")
    query = incremental.source_counts(records).writeStream.outputMode("complete").format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        query.processAllAvailable()
        put("two.ris", 2)
        query.processAllAvailable()
        assert {(r.cite_source, r.cite_label, r.records) for r in spark.table("seen").collect()} == {("one", "search", 3), ("two", "search", 2)}
    finally:
        query.stop()
