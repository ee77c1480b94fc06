"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from tagweave.llm import bpe, exact_dedup, gam, interpolation, minmax, mixing, pii, quality_rules, token_store, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, keep_id string, size string, key string, node string, component string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sample():
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghijkl", k=rng.randint(2, 7))) for _ in range(300)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    base = [text(80) for _ in range(12)]
    near = []
    for b in base[:6]:
        w = b.split()
        for _ in range(3):
            v = list(w)
            v[rng.randrange(len(v))] = "changed"
            near.append(" ".join(v))
    lone = [text(k) for k in (1, 2, 3, 4, 5, 60, 61)]
    texts = [*base, *near, *lone, base[0], base[0], base[7], None, None, "", "   \n\t", "É ÀÉ <|endoftext|> 日本 語  x\n\n y", text(30000), "z" * 40000, text(3) + "\n" + text(3), "A B C", "a b c"]
    rows = [(i, t, "en", f"s{i % 5}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, base[2], "en", "s1", 1), (None, "only here", None, None, None)]
    return [(*r, 0.5, True, "k", "z", "k", "n", "c") for r in rows]


@pytest.fixture(scope="module")
def rows():
    return sample()


@pytest.fixture(scope="module")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def sql(rows, query):
    import pandas as pd

    documents = pd.DataFrame([r[:4] for r in rows], columns=["doc_id", "text", "lang", "source"]).astype({"doc_id": "Int64"})
    con = duckdb.connect()
    con.register("documents", documents)
    return sorted(map(repr, con.execute(query).fetchall()))


def got(df, *columns):
    return sorted(repr(tuple(r)) for r in df.select(*columns).collect())


def words(text):
    return WORD.findall(text or "")


def test_mix(rows, docs, none, spark):
    from pyspark.sql import functions as F

    out = mixing.mix(docs)
    columns = ("doc_id", "size", "source_size", "target", "taken")
    assert got(out, *columns) == sql(rows, mixing.mix_sql())
    assert got(mixing.mix(docs, seed="other"), *columns) == sql(rows, mixing.mix_sql(seed="other"))
    by = {}
    for r in out.collect():
        by.setdefault(r.source, []).append(r)
        assert r.taken == r.copies * r["size"] + r.part and r.taken <= 3 * r["size"]
    assert all(sum(r.taken for r in rs) == math.floor(rs[0].target) for rs in by.values())
    assert sum(rs[0].target for rs in by.values()) == pytest.approx(sum(len(words(r[1])) for r in rows))
    clash = {"part": "p", "copies": 7, "taken": None, "__copy": "c", "target": 1.5, "__range": 2}
    more = docs.select("*", *(F.lit(v).alias(c) for c, v in clash.items()))
    assert sorted(map(repr, mixing.mixture(more).drop(*clash).collect())) == sorted(map(repr, mixing.mixture(docs).collect()))
    assert {tuple(r) for r in mixing.mixture(more).select(*clash).collect()} == {tuple(clash.values())}
    mixed = mixing.mixture(docs)
    assert mixed.columns == docs.columns
    assert sum(len(words(r.text)) for r in mixed.collect()) == sum(r.taken for rs in by.values() for r in rs)
    assert mixing.mix(none).count() == 0 and mixing.mixture(none).count() == 0
    empty = spark.createDataFrame([(1, None, "a"), (2, "", "b")], "doc_id long, text string, source string")
    assert [(r.target, r.taken) for r in mixing.mix(empty).collect()] == [(0.0, 0), (0.0, 0)]


def test_targets_are_a_fixed_point(spark):
    for seed in range(4):
        rng = random.Random(seed)
        total = {f"s{i:02d}": rng.choice([0, 1, 7, 50, 1000, 100000]) for i in range(rng.randint(1, 9))}
        weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(total))}
        free, left, want = set(total), float(sum(total.values())), {}
        while True:
            share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
            over = [s for s in free if share[s] > 3 * total[s]]
            if not over:
                want |= share
                break
            for s in over:
                want[s] = 3.0 * total[s]
                left -= want[s]
                free.discard(s)
        df = spark.createDataFrame([(False, s, n) for s, n in total.items()], "__null boolean, __source string, __total long")
        for r in mixing.source_targets(df).collect():
            assert r["__target"] == pytest.approx(want[r["__source"]])


def test_content_sort(rows, docs, none):
    columns = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    for parts in (1, 4, 37):
        assert got(exact_dedup.content_sort(docs, partitions=parts), *columns) == sql(rows, exact_dedup.exact_dedup_sql())
    small = exact_dedup.content_sort(docs, keep="smallest", partitions=5).where("kept")
    assert small.count() == len({r[1] or "" for r in rows})
    assert exact_dedup.content_sort(none).count() == 0
    kept = exact_dedup.distinct_texts(docs, partitions=11)
    assert kept.columns == docs.columns and sorted((r.text or "") for r in kept.collect()) == sorted({r[1] or "" for r in rows})
    from pyspark.sql import functions as F

    lowered = exact_dedup.content_sort(docs, normalise=F.lower)
    assert lowered.where("kept").count() == len({(r[1] or "").lower() for r in rows})


def test_one_text_fills_all_partitions(spark):
    df = spark.range(5000).selectExpr("id as doc_id", "'same text' as text")
    out = exact_dedup.content_sort(df, partitions=16)
    assert out.groupBy("keep_id", "group_size").count().collect()[0][:] == (4999, 5000, 5000)
    assert [r.doc_id for r in out.where("kept").collect()] == [4999]


def test_a_task_holds_one_row_of_a_text(spark, monkeypatch):
    """One text fills a partition: what the task holds doesn't grow with its rows."""
    caught = {}
    kind = type(spark.range(1))
    plain = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, fn, schema: caught.update(fn=fn, rows=self) or plain(self, fn, schema))
    df = spark.createDataFrame([(i, "x" * 50000, "c" * 10) for i in range(40)] + [(1000, None, "n"), (1001, "", "e")], "doc_id long, text string, `__none` string")
    out = {r.doc_id: r for r in exact_dedup.distinct_texts(df, partitions=1).collect()}
    assert set(out) == {39, 1001} and out[39].text == "x" * 50000 and out[39]["__none"] == "c" * 10
    assert exact_dedup.distinct_texts(df, keep="smallest", partitions=3).where("text is null").first().doc_id == 1000
    import tracemalloc

    import pyarrow as pa

    monkeypatch.setattr(exact_dedup.TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda self: 0})())
    batch = caught["rows"].toArrow().to_batches()[0].slice(0, 1)
    long = pa.RecordBatch.from_pylist([batch.to_pylist()[0] | {"__text": "y" * 100000}] * 100, schema=batch.schema)
    base = pa.total_allocated_bytes()
    tracemalloc.start()
    most, rows = 0, []
    for b in caught["fn"](iter([long] * 40)):
        rows.append((b.num_rows, b.column("group_size")[0].as_py()))
        most = max(most, pa.total_allocated_bytes() - base)
    assert rows == [(1, 4000)] and most + tracemalloc.get_traced_memory()[1] < 20 * 100000
    tracemalloc.stop()


def shingles(text, n):
    w = ["".join(c.lower() if "A" <= c <= "Z" else c for c in x) for x in words(text)]
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def components_of(ids, linked):
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            m = min(label[a], label[b])
            if label[a] != m or label[b] != m:
                label[a] = label[b] = m
                changed = True
    return label


@pytest.mark.parametrize("n", [4, 5])
def test_near_duplicates(rows, docs, none, n):
    sets = [(r[0], shingles(r[1], n)) for r in rows if r[0] is not None]
    linked = [(a, b) for a, s in sets for b, t in sets if a < b and s and t and 100 * len(s & t) >= 80 * len(s | t)]
    label = components_of({i for i, _ in sets}, linked)
    out = minmax.near_duplicates(docs, shingle=n).collect()
    assert len(out) == len(rows)
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in out if r.doc_id is not None) == sorted((i, len(s), label[i], label[i] == i) for i, s in sets)
    assert all(r.kept and r.component_id is None for r in out if r.doc_id is None)
    assert minmax.near_duplicates(none).count() == 0


def test_links_that_the_least_member_lacks(spark):
    """A chain in which each text is near the next only: all are one component, however they meet in buckets."""
    rng = random.Random(1)
    w = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    chain, now = [], list(w)
    for k in range(12):
        chain.append((k, " ".join(now)))
        for j in range(4):
            now[k * 12 + j] = f"n{k}-{j}"
    sets = [(i, shingles(t, 5)) for i, t in chain]
    linked = [(a, b) for a, s in sets for b, t in sets if a < b and 100 * len(s & t) >= 80 * len(s | t)]
    label = components_of({i for i, _ in chain}, linked)
    out = minmax.near_duplicates(spark.createDataFrame(chain, "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in out.collect()} == label and len(set(label.values())) < 12


def test_minmax_estimates_are_unbiased():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**63, 400, dtype=np.uint64)
    b = np.concatenate([a[:320], rng.integers(0, 2**63, 80, dtype=np.uint64)])
    shared = np.mean([np.concatenate(minmax.extremes(a)) == np.concatenate(minmax.extremes(b))])
    assert abs(shared - 320 / 480) < 0.1


def chars_inside_repeats(w, n):
    seen = Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
    return sum(len(w[j]) for j in {j for k in range(len(w) - n + 1) if seen[tuple(w[k : k + n])] > 1 for j in range(k, k + n)})


def test_repeats_of_all_lengths_against_brute_force():
    rng = random.Random(5)
    texts = []
    for size in (0, 4, 5, 11, 40, 90, 300, 1000):
        for letters in (1, 2, 6):
            w = ["".join(rng.choices("aé", k=rng.randint(1, 4))) + str(rng.randint(0, letters)) for _ in range(size)]
            cut = rng.randint(0, size)
            texts.append(" ".join(w + w[cut : cut + rng.randint(0, 15)]))
    m = quality_rules.measures([t.encode() for t in texts])
    for n in quality_rules.NGRAM_SHARES:
        assert m[f"dup_chars_{n}"].tolist() == [chars_inside_repeats(words(t), n) for t in texts]


def test_repetition_rules(rows, docs, none):
    out = {}
    for r in quality_rules.repetition_rules(docs).collect():
        out.setdefault(r.doc_id, r)
    for i, t, *_ in rows[:-2]:
        w, r = words(t), out[i]
        seen = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        inside = {j for k in range(len(w) - 4) if seen[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
        lines, dup = set(), 0
        for line in (t or "").split("\n"):
            if words(line):
                dup += line in lines
                lines.add(line)
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(w), sum(map(len, w)), len(inside), dup)
        assert r.n_symbols == sum((t or "").count(c) for c in "#*$%&|<>")
        assert r.base_failed == (len(w) < 10 or 100 * len(inside) > 20 * len(w))
        lines, again = set(), 0
        for line in (t or "").split("\n"):
            again += sum(map(len, words(line))) if line in lines else 0
            lines.add(line)
        good = not r.base_failed and again <= quality_rules.LINE_SHARE * r.word_chars
        for n, share in quality_rules.NGRAM_SHARES.items():
            chars = chars_inside_repeats(w, n)
            assert r[f"dup_chars_{n}"] == chars
            good = good and chars <= share * r.word_chars
        assert r.dup_line_chars == again and r.kept == good
    assert quality_rules.repetition_rules(none).count() == 0


def test_repeats_are_found():
    line = b"one two three four five six seven eight nine ten"
    m = quality_rules.measures([line + b"\n" + line + b"\n" + line, line])
    assert m["n_dup_lines"].tolist() == [2, 0] and m["n_repeat_words"].tolist() == [30, 0] and m["dup_line_chars"].tolist() == [2 * 39, 0]
    assert quality_rules.verdict(m)[1].tolist() == [False, True]


def test_ngram_rules_add_to_the_base_rule():
    lone = lambda n: [f"w{k:03d}" for k in range(n)]
    passage = [f"p{k:03d}" for k in range(12)]
    text = lambda parts, n: " ".join([*passage, *parts, *passage, *["q" + x for x in lone(n)]]).encode()
    # of words 16 % and 8 % (of characters 14 % and 7 %) lie in a passage of 12 words that is found twice
    m = quality_rules.measures([text(lone(60), 66), text(lone(140), 136), " ".join(lone(150)).encode()])
    failed, kept = quality_rules.verdict(m)
    assert m["n_repeat_words"].tolist() == [24, 24, 0] and m["n_words"].tolist() == [150, 300, 150] and m["n_dup_lines"].sum() == 0
    assert failed.tolist() == [False] * 3 and kept.tolist() == [False, True, True]
    # the rules for longer n-grams decide alone: 12.9 % is below 5-grams' 15 %, above 10-grams' 10 %
    m = quality_rules.measures([text(lone(70), 74)])
    assert 0.12 < m["dup_chars_5"][0] / m["word_chars"][0] < 0.15 and not quality_rules.verdict(m)[1][0]


def test_byte_bpe(rows, docs, none):
    e = bpe.encoding(bpe.public_tokenizers.path(bpe.RANKS))
    out = {}
    for r in bpe.token_digests(docs).collect():
        out.setdefault(r.doc_id, r)
    for i, t, *_ in rows[:-2]:
        ids = e.encode_ordinary(t or "")
        assert (out[i].n_tokens, out[i].ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert out[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    for text in ("a  b\n c don't  \n\n x", "x " * 500, " " * 200 + "y" * 100 + " z", "¿qué tal? 12 34"):
        for limit in (1, 7, 50):
            assert bpe.encode_text(text, bpe.public_tokenizers.path(bpe.RANKS), limit) == e.encode_ordinary(text)
            assert "".join(bpe.pieces(text, limit)) == text
    both = bpe.decode(bpe.encode(docs))
    assert all(bytes(r.decoded).decode() == (r.text or "") for r in both.collect())
    assert bpe.token_digests(none).count() == 0


def test_token_store(rows, docs, none):
    tokenizer = token_store.Tokenizer.from_file(token_store.public_tokenizers.path(token_store.TOKENIZER))
    tokenizer.encode_special_tokens = True
    manifest = token_store.write_shards(docs, shards=3)
    out = token_store.read_shards(manifest).collect()
    start, want = 0, []
    for i, t in sorted(((r[0], r[1] or "") for r in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.start, r.n_tokens, r.ids_crc32)) for r in out)
    for m in manifest.collect():
        shard = token_store.open_shard(m.uri)
        assert shard.get(10**9) is None
        if m.first_key is not None and m.first_key <= 5 <= m.last_key:
            assert shard.get(5).tolist() == [*tokenizer.encode(rows[5][1], add_special_tokens=False).ids, 0]
    assert token_store.read_shards(token_store.write_shards(none)).count() == 0


def test_added_tokens_in_texts(spark, tmp_path):
    """The query's ids are those of the library as it comes, also where a text holds an added token."""
    tokenizer = token_store.Tokenizer.from_file(token_store.public_tokenizers.path(token_store.TOKENIZER))
    texts = ["one two", "a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>y  z", "<|endoftext|", "three four <|endoftext|>", "", "last one"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    start, want = 0, []
    for i, t in enumerate(texts):
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert 50256 in tokenizer.encode(texts[1], add_special_tokens=False).ids
    assert sorted(tuple(r) for r in token_store.op9_token_store(spark, str(tmp_path)).collect()) == want


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(0).integers(-(2**62), 2**62, 20000))
    h = token_store.PerfectHash.build(keys)
    assert sorted(h.slots(keys).tolist()) == list(range(len(keys)))
    again = token_store.PerfectHash.frombytes(h.tobytes())
    assert (again.slots(keys) == h.slots(keys)).all()
    assert sum(len(x) for x in h.levels) * 64 < 5 * len(keys)
    assert len(token_store.PerfectHash.build(keys[:0]).slots(keys[:3])) == 3


def test_warc(spark, tmp_path):
    rows = [(1, "http://a/1", "<p>x</p>", 0), (2, "http://a/2", "<p>x</p>", 0), (3, None, None, 0), (4, "http://a/4", "", 0), (5, "http://a/\r\n5", "é" * 300000, 0), (6, "u", "<b>", 0), (6, "u", "<b>", 0), (None, "v", "<b>", 0), (7, "w", "\r\n\r\nWARC/1.1\r\n", 0)]
    path = str(tmp_path / "pages.parquet")
    spark.createDataFrame(rows, "page_id long, url string, html string, __digest int").repartition(3).write.parquet(path)
    pages = spark.read.parquet(path)
    for options in ({}, {"frame_bytes": 50, "bundle_bytes": 100}):
        manifest = warc.write_bundles(pages, **options)
        out = warc.read_bundles(manifest).collect()
        import pandas as pd

        con = duckdb.connect()
        con.register("pages", pd.DataFrame([r[:3] for r in rows], columns=["page_id", "url", "html"]).astype({"page_id": "Int64"}))
        want = con.execute(warc.warc_sql()).fetchall()
        back = [(r.page_id and int(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to and int(r.refers_to)) for r in out]
        assert sorted(map(repr, back)) == sorted(map(repr, want))
        for m in manifest.collect():
            bundle = warc.open_bundle(m.uri)
            for key in bundle.index:
                head, block = bundle.read(key)
                assert head["warc-record-id"] == f"<{key}>"
                if warc.page_of(key) == "5":
                    assert block.endswith("é".encode() * 300000)
    assert warc.read_bundles(warc.write_bundles(pages.limit(0))).count() == 0


def test_rows_that_share_a_page_id(spark, tmp_path):
    """Null ids, and an id with several payloads, in one bundle: each row keeps a record, and revisits name their own response."""
    rows = [(None, "a", "<p>1</p>"), (None, "b", "<p>2</p>"), (None, "c", "<p>2</p>"), (8, "d", "<p>3</p>"), (8, "e", "<p>4</p>"), (9, "f", "<p>3</p>"), (9, "g", "<p>4</p>"), (9, "h", "<p>3</p>")]
    path = str(tmp_path / "pages.parquet")
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(path)
    manifest = warc.write_bundles(spark.read.parquet(path))
    out = warc.read_bundles(manifest).collect()
    back = {r.url: (r.page_id and int(r.page_id), r.record_type, r.refers_to and int(r.refers_to)) for r in out}
    assert len(out) == len(rows) and sorted((r.page_id or "", r.url) for r in out) == sorted((str(i or ""), u) for i, u, _ in rows)
    assert [back[u][1:] for u in "defgh"] == [("response", None)] * 2 + [("revisit", 8)] * 3
    assert sorted(back[u][1] for u in "abc") == ["response", "response", "revisit"]
    (one,) = manifest.collect()
    bundle = warc.open_bundle(one.uri)
    assert one.records == len(bundle.index) == len(rows) and [len(bundle.find(i)) for i in (None, 8, 9, 10)] == [3, 2, 3, 0]
    heads = {h["warc-target-uri"]: h for h, _ in map(bundle.read, bundle.index)}
    for url, response in (("f", "d"), ("g", "e"), ("h", "d")):
        assert heads[url]["warc-refers-to"] == heads[response]["warc-record-id"]


def test_page_ids_of_any_string(spark, tmp_path):
    ids = ["a#1", "a#2", "x\r\nWARC-Type: y", "", None, "é <ü>", "#", "=", "%0A", " a", "a "]
    path = str(tmp_path / "pages.parquet")
    spark.createDataFrame([(i, "u", "same" if k % 2 else f"p{k}") for k, i in enumerate(ids)], "page_id string, url string, html string").coalesce(1).write.parquet(path)
    out = warc.read_bundles(warc.write_bundles(spark.read.parquet(path))).collect()
    assert sorted(map(repr, (r.page_id for r in out))) == sorted(map(repr, ids))
    assert {r.page_id: r.refers_to for r in out if r.record_type == "revisit"} == dict.fromkeys([i for k, i in enumerate(ids) if k % 2 and i != min(ids[1::2])], min(ids[1::2]))


def test_bundles_are_plain_zstandard(tmp_path):
    import zstandard

    path = tmp_path / "x.warc.zst"
    w = warc.BundleWriter(path.open("wb"), frame_bytes=40)
    for k in range(5):
        w.add(f"k{k}", warc.record("u", b"payload", "D", None, f"k{k}"))
    size = w.close()
    assert size == path.stat().st_size
    data = zstandard.ZstdDecompressor().stream_reader(path.open("rb"), read_across_frames=True).read()
    at, n = 0, 0
    while at < len(data):
        at, n = warc.parse(data, at)[2], n + 1
    assert n == 6


def test_language_model(rows, docs, none):
    from pyspark.sql import functions as F

    lower = lambda t: ["".join(c.lower() if "A" <= c <= "Z" else c for c in x) for x in words(t)]
    end = "\0end"
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    one, two = Counter(), Counter()
    for i, t, *_ in rows:
        if not held(i):
            before = end
            for w in [*lower(t), end]:
                one[w] += 1
                two[before, w] += 1
                before = w
    n, v = sum(one.values()), len(one)
    events = [((one[h] - 1), (c - 1) / max(one[h] - 1, 1), (one[w] - 1) / (n - 1), c) for (h, w), c in two.items()]
    context, p2, p1, count = (np.array(x, float) for x in zip(*events, strict=True))
    import pandas as pd

    k = interpolation._context(context)
    cells = pd.DataFrame({"cell": k * interpolation.BINS**2, "n": count, "two": p2 * count, "one": p1 * count})
    weights = interpolation.weights(cells, v)
    for size in (2000, 1 << 22):
        out = interpolation.language_model(docs, chunk_bytes=size, bucket_bytes=20000)
        by = {}
        for r in out.collect():
            by.setdefault((r.doc_id, r.n_tokens), r)
        assert out.count() == len(rows)
        for i, t, *_ in rows:
            tokens = [*lower(t), end]
            r = by[i, len(tokens)]
            assert (r.held_out, r.train_tokens, r.n_known) == (held(i), n, sum(one[w] > 0 for w in tokens))
            assert r.base_score == pytest.approx(sum(math.log10((one[w] + 1) / (n + v + 1)) for w in tokens))
            before, s = end, 0.0
            for w in tokens:
                a = weights[interpolation._context(np.array([one[before]]))[0]]
                s += math.log10(a[0] * two[before, w] / max(one[before], 1) + a[1] * one[w] / n + a[2] / (v + 1))
                before = w
            assert r.score == pytest.approx(s, rel=5e-3)
    assert interpolation.language_model(none).count() == 0
    only = docs.where(F.crc32(F.col("doc_id").cast("string")) % 7 == 2)
    assert all(r.train_tokens == 0 and math.isfinite(r.score) for r in interpolation.language_model(only).collect())


def test_base_spans():
    text = "Mail a.b+c@x.example.com@y.org, @no x@y 1.2.3.4 999.1.1.1 1.2.3.4.5.6.7.8 4111 1111 1111 1111 4111-1111-1111-1112 +1 (555) 010-9999 + +12 5555555555554444"
    patterns = {0: r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", 1: r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", 2: r"[0-9]([\x20-]?[0-9])+", 3: r"\+[0-9][\x20().0-9-]+[0-9]"}

    def brute(t):
        out = []
        for kind, p in patterns.items():
            for m in re.finditer(p, t):
                digits = re.findall("[0-9]", m[0])
                if kind == 0 or (kind == 1 and all(int(x) <= 255 for x in m[0].split("."))) or (kind == 2 and 14 <= len(digits) <= 19 and pii.luhn(digits)) or (kind == 3 and 10 <= len(digits) <= 15):
                    out.append((m.start(), kind, m.end()))
        return sorted(out)

    assert pii.base_spans(text) == brute(text) and len(brute(text)) == 5
    rng = random.Random(0)
    for _ in range(3000):
        t = "".join(rng.choices("a.@+-1 23(4)x5\n", k=60))
        assert pii.base_spans(t) == brute(t), t
    assert pii.base_spans("1" * 200000 + "a" * 200000 + "@" * 1000) == []


def test_contexts_discover_identifiers(spark):
    rows = [(i, f"Notes. Please call me on +1 (555) 010-{1000 + i} today. The fee was 12{i}45 euros") for i in range(30)]
    rows += [(100, "Notes. Please call me on 0555-0199x today"), (101, "nothing 12345 here"), (102, None), (103, ""), (100, "Notes. Please call me on 0555-0199x today")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, row int, base string")
    out = {r.doc_id: r for r in pii.personal_data(df).collect()}
    text = rows[30][1]
    assert [(s.kind, text[s.start : s.end]) for s in out[100].spans] == [(3, "0555-0199x")] and out[100].base == []
    assert out[101].spans == [] and out[102].spans == [] and out[3].spans == out[3].base and len(out[3].base) == 1
    assert pii.personal_data(df.limit(0)).count() == 0


def test_identifiers_are_whole():
    found = lambda t: [t[a:z] for a, z in pii.identifiers(t, pii.words_of(t), pii.merged(pii.base_spans(t)))]
    long = "x1" * 301
    assert found(f"id {long} and {'y2' * 5000}.") == [long, "y2" * 5000]
    assert found("call (212) 555 0123, or 12 34\n56 78 then (a1b2c) no12") == ["(212) 555 0123", "12 34", "56 78", "a1b2c", "no12"]
    assert found("a@b.cd x123 1.2.3.4 99 88") == ["x123", "99 88"] and found("123 no 1") == [] and found("") == []
    contexts = lambda t, x: pii.contexts(t, pii.words_of(t), t.index(x), t.index(x) + len(x))
    assert contexts("my Tel 42 is:55-66, ok", "55-66") == ["00 is: _", "is: _ ,"] and contexts("x123", "x123") == ["^ _", "^ _ $"]
    a, b = (contexts("w" * 100 + e + " x123", "x123")[0] for e in "ab")
    assert a != b and len(a) == len(b) < 80
    assert pii.digest("A" * 400 + "1") != pii.digest("a" * 400 + "2") and pii.digest("A1") == pii.digest("a1")


def test_discovery_against_brute_force(spark):
    """The graph of contexts and instances, scored round by round in plain Python; a chain of eight hops among them."""
    for seed in range(2):
        rng = random.Random(seed)
        seen = [(f"i{rng.randrange(40)}".encode(), rng.choice([-1, -1, 0, 1]), [f"c{rng.randrange(25)}", f"c{rng.randrange(25)}"]) for _ in range(150)]
        seen += [(f"s{k}".encode(), 0, ["h0a", "h0b", "h0c"]) for k in range(4)]
        for hop in range(8):  # each hop's context is known by the instances of the one before it
            seen += [(f"h{hop}-{k}".encode(), -1, [f"h{h}{x}" for h in (hop, hop + 1) for x in "abc"]) for k in range(4)]
        edges = {}
        for instance, kind, cs in seen:
            for c in cs:
                edges[c, instance] = max(kind, edges.get((c, instance), -1))
        known = {}

        def score():
            good = {}
            for c in {c for c, _ in edges}:
                own = [(known.get(i, (0.0, -1))[::-1] if k < 0 else (k, 1.0)) for (x, i), k in edges.items() if x == c]
                best = max(((sum(w for q, w in own if q == kind), kind) for kind in {q for q, _ in own if q >= 0}), default=None)
                if best and best[0] >= 1.2345 and best[0] / len(own) >= 0.3456:
                    good[c] = (best[1], best[0] / len(own))
            return good

        while True:
            good, votes = score(), {}
            for (c, i), k in edges.items():
                if k < 0 and i not in known and c in good:
                    votes.setdefault((i, good[c][0]), []).append(good[c][1])
            new = {}
            for (i, kind), cs in votes.items():
                s = 1 - math.prod(1 - min(x, 0.999) for x in cs)
                if s >= 0.3456:
                    new[i] = max(new.get(i, (0.0, -1)), (s, kind))
            if not new:
                break
            known |= new
        df = spark.createDataFrame(seen, "instance binary, kind int, contexts array<string>")
        out = {r.context: (r.kind, r.confidence) for r in pii.discover(df, least_known=1.2345, least_confidence=0.3456).collect()}
        assert set(out) == set(good)
        assert "h7a" in out
        assert all(out[c][0] == good[c][0] and out[c][1] == pytest.approx(good[c][1]) for c in out)
        assert "h7a" not in {r.context for r in pii.discover(df, rounds=3, least_known=1.2345, least_confidence=0.3456).collect()}


def test_gam(spark, tmp_path):
    rng = random.Random(2)
    words_ = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(200)]
    rows = []
    for i in range(600):
        w = rng.choices(words_, k=40)
        rows.append((i, " ".join(w) + "." if i % 3 else " ".join(x + "###" for x in w), i % 3 > 0))
    docs = spark.createDataFrame([(i, t, "x", 0.1) for i, t, _ in rows] + [(None, None, "x", 0.2), (700, "", "y", 0.3)], "doc_id long, text string, predicted string, score double")
    labels = spark.createDataFrame([(i, int(q), 0) for i, _, q in rows] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    model = gam.train(docs, labels)
    out = {r.doc_id: r for r in gam.score(docs, model).collect()}
    tested = [(out[i], q) for i, _, q in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(r.held_out for r, _ in tested) and sum((r.predicted == 1) == q for r, q in tested) / len(tested) > 0.98
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out.values()) and None in out
    again = gam.train(docs.repartition(7), labels)
    assert all((a == b).all() for a, b in zip(model.tables, again.tables, strict=True))
    kept = gam.accepted(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in out.values())
    often = docs.unionByName(docs.where("doc_id in (1, 7)")).unionByName(docs.where("doc_id = 7"))
    assert all((a == b).all() for a, b in zip(model.tables, gam.train(often, labels).tables, strict=True))
    nothing = gam.train(docs, labels.limit(0))
    assert {r.score for r in gam.score(docs, nothing).collect()} == {0.5} and gam.score(docs.limit(0), model).count() == 0


def test_trees_against_brute_force():
    rng = np.random.default_rng(4)
    part = lambda g, h: g.sum() ** 2 / (h.sum() + 2.0)
    for _ in range(20):
        g, h = rng.normal(size=9), rng.random(9)
        best = max(range(1, 9), key=lambda k: part(g[:k], h[:k]) + part(g[k:], h[k:]))
        step = np.concatenate([np.full(len(a), a.sum() / (b.sum() + 2.0)) for a, b in ((g[:best], h[:best]), (g[best:], h[best:]))])
        assert gam._tree(g, h, 2, 2.0) == pytest.approx(step)
        g, h, found = rng.normal(size=(4, 5)), rng.random((4, 5)), {}
        for i in range(1, 4):
            for j in range(1, 5):
                found[i, j] = sum(part(g[a, b], h[a, b]) for a in (slice(0, i), slice(i, 4)) for b in (slice(0, j), slice(j, 5)))
        (i, j), v = max(found.items(), key=lambda x: x[1])
        got, gain = gam._quadrants(g, h, 2.0)
        assert gain == pytest.approx(v) and got[0, 0] == pytest.approx(g[:i, :j].sum() / (h[:i, :j].sum() + 2.0))
        assert got[-1, -1] == pytest.approx(g[i:, j:].sum() / (h[i:, j:].sum() + 2.0))


def test_pairs_of_features_and_lookups():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)  # neither feature tells anything by itself
    model = gam.fit(x, y)
    assert (0, 1) in model.pairs and ((model.score(x) > 0.5) == (y > 0)).mean() > 0.9
    for row, p in zip(x[:50], model.score(x[:50]), strict=True):
        s = model.intercept + sum(t[sum(c <= v for c in cut)] for cut, t, v in zip(model.cuts, model.tables, row, strict=True))
        s += sum(t[sum(c <= row[a] for c in model.pair_cuts[a]), sum(c <= row[b] for c in model.pair_cuts[b])] for (a, b), t in zip(model.pairs, model.pair_tables, strict=True))
        assert p == pytest.approx(1 / (1 + math.exp(-s)))


def test_weights_against_em_on_raw_events():
    """Weights learnt from cells are near those that plain expectation-maximisation finds for the same events one by one."""
    rng = np.random.default_rng(8)
    import pandas as pd

    n, types = 4000, 500
    context = rng.integers(0, 300, n).astype(float)
    two = np.where(rng.random(n) < 0.6, rng.integers(1, 20, n) / np.maximum(context, 20), 0.0) * (context > 0)
    one = rng.integers(1, 50, n) / 10_000
    bucket = [int(math.log2(c + 1)) for c in context]
    cell = (interpolation._context(context) * interpolation.BINS + interpolation._bin(two)) * interpolation.BINS + interpolation._bin(one)
    cells = pd.DataFrame({"cell": cell, "n": 1, "two": two, "one": one}).groupby("cell", as_index=False).sum()
    got = interpolation.weights(cells, types)
    for k in sorted(set(bucket)):
        events = [(two[i], one[i], 1 / (types + 1)) for i in range(n) if bucket[i] == k]
        w = [0.0, 0.5, 0.5] if k == 0 else [1 / 3] * 3
        for _ in range(interpolation.EM_ROUNDS):
            sums = [0.0] * 3
            for p in events:
                total = sum(a * b for a, b in zip(w, p, strict=True))
                for j in range(3):
                    sums[j] += w[j] * p[j] / total
            w = [x / sum(sums) for x in sums]
        assert got[k] == pytest.approx(w, abs=0.03)
