import itertools
import random

import pytest

from tagweave.functions.pairwise import Texts, _levenshtein
from tagweave.functions.similarity import jaro_winkler_similarity
from tagweave.operators import dedup

MANY = [chr(i) for i in range(0x4E00, 0x4E00 + 400)]


@pytest.mark.parametrize("letters", ["ab", "abcdefgh é", "aж日\0😀", MANY])
def test_pairs_of_texts_against_one_by_one(letters):
    import numpy as np

    rng = random.Random(5)
    texts = ["".join(rng.choices(letters, k=rng.choice([0, 1, 3, 5, 20, 50, 63, 64, 65, 90]))) for _ in range(60)]
    i, j = (np.ravel(x) for x in np.meshgrid(np.arange(60), np.arange(60)))
    want, t = np.array([jaro_winkler_similarity(texts[a], texts[b]) for a, b in zip(i, j, strict=True)]), Texts(texts)
    assert (t.jaro_winkler(i, j) == want).all()
    for least in (0.6, 0.85):
        some = t.jaro_winkler(i, j, least)
        assert (some[want >= least] == want[want >= least]).all() and (some[want < least] < least).all() and t.may_reach(i, j, least)[want >= least].all()
    assert t.levenshtein(i[:900], j[:900]).tolist() == [_levenshtein(texts[a], texts[b]) for a, b in zip(i[:900], j[:900], strict=True)]


def _records(n):
    rng, rows = random.Random(3), []
    for i in range(n):
        title = f"{rng.choice(['red', 'blue'])} widgets {rng.choice(['in', 'of'])} the market {rng.choice('abcd')}{rng.choice('abcd')}"
        rows.append((f"r{i:03d}", rng.choice(["Doe, A.", "Doe, B."]), "2001", title, rng.choice([None, "1", "2"]), rng.choice([None, None, f"10.1/{i % 9}"]), rng.choice(["7", None])))
    return rows


def test_no_pair_is_shuffled(spark, monkeypatch):
    """The plan has no join or exchange above the pairs; those of blocks of several parts are all there, once."""
    monkeypatch.setattr(dedup, "PART", 16)
    df = spark.createDataFrame(_records(120), "record_id string, author string, year string, title string, volume string, doi string, number string")
    k = dedup.keys(dedup.normalised(df))
    pairs = dedup.scored_pairs(k, ("author_key", "year"), "title", Texts.jaro_winkler, dedup.T.DoubleType())
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan.split("MapInArrow")[0] and "Repartition" not in plan.split("MapInArrow")[0]
    found = pairs.collect()
    title = {r.record_id: r.title for r in k.collect()}
    want = {(a, b): jaro_winkler_similarity(title[a], title[b]) for a, b in itertools.combinations(sorted(title), 2)}
    assert {(r.id1, r.id2): r.score for r in found} == want and len(found) == len(want)


def test_rules_find_the_pairs_of_all_pairs(spark, monkeypatch):
    """With gaps in volumes and other volumes under one DOI: merged pairs are those that the rule holds for."""
    monkeypatch.setattr(dedup, "PART", 16)
    df = spark.createDataFrame(_records(60), "record_id string, author string, year string, title string, volume string, doi string, number string")
    k = dedup.keys(dedup.normalised(df))
    a, b = (k.select(*(dedup.F.col(c).alias(f"{c}{i}") for c in ("record_id", *dedup.FIELDS))) for i in (1, 2))
    every = a.crossJoin(b).where("record_id1 < record_id2").withColumns({f: dedup.jaro_winkler(f"{f}1", f"{f}2") for f in dedup.FIELDS})
    for merging, rule in ((True, dedup.automatic()), (False, dedup.doubtful())):
        want = {(r.record_id1, r.record_id2) for r in every.where(rule).collect()}
        found = [(r.id1, r.id2) for r in dedup.judged(k, [("doi",), ("author_key", "year")], merging).collect()]
        assert set(found) == want and len(found) == len(want) > 20
