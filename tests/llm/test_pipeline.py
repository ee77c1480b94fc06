import math

import corpus_pipeline
from tagweave.llm import bpe, registry

from .test_edges import components_of, shingles, words


def test_names():
    q, s = registry.queries(), registry.oracle_sql()
    assert {int(k[2:].split("_")[0]) for k in q} == set(range(1, 11)) and set(s) <= set(q)


def test_stages(spark, tmp_path):
    data = "/root/testdata/sf0.001"
    docs, kept = spark.read.parquet(f"{data}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, data).write.parquet(out := str(tmp_path / str(k)))
        kept[k] = docs = spark.read.parquet(out)
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    good, exact, near, mixed = ([r for r in kept[k].collect()] for k in range(4))
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    assert sum(labels.get(r.doc_id) == 0 for r in good) <= 2 and {i for i, q in labels.items() if q} - {r.doc_id for r in good} == set()
    last = {}
    for r in good:
        last[r.text or ""] = max(r.doc_id, last.get(r.text or "", r.doc_id))
    assert sorted(r.doc_id for r in exact) == sorted(last.values())
    sets = [(r.doc_id, shingles(r.text, 5)) for r in exact]
    linked = [(a, b) for a, s in sets for b, t in sets if a < b and s and t and 100 * len(s & t) >= 80 * len(s | t)]
    label = components_of({i for i, _ in sets}, linked)
    assert sorted(r.doc_id for r in near) == sorted(i for i in label if label[i] == i)
    size = {}
    for r in near:
        size[r.source] = size.get(r.source, 0) + len(words(r.text))
    taken = {}
    for r in mixed:
        taken[r.source] = taken.get(r.source, 0) + len(words(r.text))
    assert all(n <= 3 * size[s] for s, n in taken.items()) and sum(size.values()) - len(size) <= sum(taken.values()) <= sum(size.values())
    e = bpe.encoding(bpe.public_tokenizers.path(bpe.RANKS))
    tokens = kept[4].collect()
    assert all(r.round_trip for r in tokens) and math.fsum(r.n_tokens for r in tokens) == sum(len(e.encode_ordinary(r.text)) for r in mixed)


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls in any column, empty texts, repeated rows, rows that share an id, columns with clashing names, no rows."""
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    long = [" ".join(f"{w}{(i * k) % 97}" for i in range(60)) for k, w in ((3, "red"), (5, "tree"), (7, "stone"))]
    near = long[0].replace("red3 ", "red33 ", 1)
    rows = [(1, long[0], "en", "a"), (2, near, "en", "a"), (3, long[1], None, None), (3, long[1], None, None), (3, long[2], "de", "a"), (4, None, "en", "b"), (5, "", None, "b"), (None, long[1], "en", None), (6, None, None, None)]
    names = ["part", "copies", "key", "node", "bands", "ids", "n_tokens", "__c0", "kept", "size"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    path = str(tmp_path / "docs")
    spark.createDataFrame([(*r, len(r[1] or ""), *names) for r in rows], schema).coalesce(2).write.parquet(path)
    docs, out = spark.read.parquet(path), {}
    for name, stage in corpus_pipeline.STAGES:
        out[name] = stage(spark, docs, str(tmp_path))
        nothing = stage(spark, docs.limit(0), str(tmp_path))
        assert nothing.count() == 0 and nothing.columns == out[name].columns
        if name != "byte-level BPE encoding and decoding":
            assert out[name].columns == docs.columns and all([r[n] for n in names] == names for r in out[name].collect())
    ids = lambda name: sorted(((r.doc_id, r.text) for r in out[name].collect()), key=repr)
    assert len(ids("quality classifier")) <= len(rows)
    assert ids("exact dedup") == sorted([(1, long[0]), (2, near), (3, long[1]), (3, long[2]), *[x for x in ids("exact dedup") if not x[1]]], key=repr)
    assert [x[0] for x in ids("exact dedup") if not x[1]] == [6]
    assert (2, near) not in ids("MinHash near-dedup") and len(ids("MinHash near-dedup")) == len(rows) - 1
    assert all(t for _, t in ids("mixing sources to target weights"))
    last = out["byte-level BPE encoding and decoding"]
    assert last.where("round_trip").count() == len(rows) and "text" not in last.columns
    assert [c for c in last.columns if c in names] == [*(n for n in names if n not in ("ids", "n_tokens")), "n_tokens", "ids"]
