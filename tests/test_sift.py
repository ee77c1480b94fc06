import random

import numpy as np
import pyarrow as pa
import pytest

from tagweave.functions.similarity import jaro_winkler_similarity
from tagweave.operators import blocks
from tagweave.operators.blocks import Rows, Sift, _pairs
from tagweave.operators.components import forest, roots

MANY = [chr(i) for i in range(0x4E00, 0x4E00 + 400)]


def _table(letters, n, part=False):
    rng = random.Random(7)
    base = ["".join(rng.choices(letters, k=rng.choice([3, 20, 50, 70]))) for _ in range(12)]
    title = [None if rng.random() < 0.05 else "".join(rng.choice(letters) if rng.random() < 0.06 else c for c in rng.choice(base)) for _ in range(n)]
    parts = sorted(rng.choice([0, 1]) for _ in range(n)) if part else [0] * n
    columns = {"record_id": [f"r{i:04d}" for i in rng.sample(range(n), n)], "title": title, "doi": [rng.choice([None, None, f"d{i % 40}"]) for i in range(n)]}
    int32 = lambda x: pa.array(x, pa.int32())
    return pa.table({**{k: pa.array(v, pa.string()) for k, v in columns.items()}, "__p": int32([0] * n), "__q": int32([int(part)] * n), "__part": int32(parts)})


@pytest.mark.parametrize("letters", ["ab", "abcdefgh é", MANY])
@pytest.mark.parametrize("part", [False, True])
@pytest.mark.parametrize("kept", [50, 1024])
def test_whole_tiles_are_sifted(letters, part, kept, monkeypatch):
    """No pair that counts is left out, and most that don't are never given places."""
    monkeypatch.setattr(blocks, "CACHED", kept)
    table = _table(letters, 200, part)
    rows, title, doi = Rows(table), table["title"].to_pylist(), table["doi"].to_pylist()
    first = np.array([0]) if part else np.array([0, 3, 120])
    block, parts = np.searchsorted(first, np.arange(200), "right"), table["__part"].to_pylist()
    every = [(a, b) for a in range(200) for b in range(a + 1, 200) if block[a] == block[b] and (not part or parts[a] != parts[b])]
    score = {(a, b): jaro_winkler_similarity(title[a], title[b]) if title[a] is not None and title[b] is not None else 0 for a, b in every}
    for least in (0.85, 0.9, 0.99):
        found = [tuple(sorted(p)) for i, j in _pairs(rows, first, Sift(rows, "title", "doi", least)) for p in zip(i.tolist(), j.tolist(), strict=True)]
        want = {(a, b) for a, b in every if score[a, b] >= least or (doi[a] is not None and doi[a] == doi[b])}
        assert want <= set(found) <= set(every) and len(found) == len(set(found))
        if len(letters) > 2:
            assert len(found) < len(every) / 2


def test_links_are_few(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(400 + i, 400 + j) for i in range(60) for j in range(i)]
    df = spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in links], "a string, b string").coalesce(1)
    found = [(int(r.a[1:]), int(r.b[1:])) for r in forest(df).collect()]
    ends = lambda x: [np.array(z) for z in zip(*x, strict=True)]
    assert (roots(*ends(found), 500) == roots(*ends(links), 500)).all()
    root = roots(*ends(links), 500)
    assert len(found) == sum(root != np.arange(500))


def test_roots_of_a_long_chain():
    order = np.random.default_rng(2).permutation(5000)
    assert (roots(order[:-1], order[1:], 5000) == 0).all()


def test_scores_are_rounded_where_they_are_made():
    from tagweave.functions.pairwise import Texts
    from tagweave.plans.queries import _six_places

    texts = ["MARTHA", "MARHTA", "DWAYNE", "DUANE", "DIXON", "DICKSONX"]
    i, j = (np.ravel(x) for x in np.indices((6, 6)))
    got = _six_places(Texts(texts), i, j).reshape(6, 6)
    assert (got[0, 1], got[2, 3], got[4, 5], got[0, 0]) == (0.961111, 0.84, 0.813333, 1.0)
