import warnings

from tagweave.functions import cite
from tagweave.functions.similarity import jaro_winkler_similarity

SIX = [f"{x}{x.lower()}ton, Q." for x in "BCDFGH"]
#: Authors and year, and the citation that tells them apart from all others here.
AUTHORS = [
    ("Okafor, Ada Nkem and Lindqvist, Per and Moreau, Inès and Tanaka, Ken and Haddad, Omar", 2010, "A. N. Okafor, Lindqvist, Moreau et al. (2010)"),
    ("Okafor, Ada Nkem and Lindqvist, Per and Castro, Rui", 2010, "A. N. Okafor, Lindqvist & Castro (2010)"),
    ("Okafor, Ben and Lindqvist, Per and Castro, Rui", 2010, "B. Okafor et al. (2010)"),
    ("Okafor, Ben and Lindqvist, Per and Castro, Rui", 2011, "B. Okafor et al. (2011)"),
    ("Petrov, Ivan and Silva, Ana", 2010, "Petrov & Silva (2010a)"),
    ("Weber, Eva", 2010, "E. Weber (2010)"),
    ("Petrov, Ivan and Silva, Ana", 2010, "Petrov & Silva (2010b)"),
    ("Weber, Uwe", 2010, "U. Weber (2010)"),
    # five common names: the sixth tells them apart, with one author more at most
    (" and ".join([*SIX, "Kato, R."]), 2012, "Bbton ... Hhton & Kato (2012)"),
    (" and ".join([*SIX[:5], "Diaz, L."]), 2012, "Bbton ... Ggton & Diaz (2012)"),
    (" and ".join([*SIX[:5], "Egan, M.", "Kato, R.", "Lund, S."]), 2012, "Bbton ... Egan et al. (2012)"),
]


def test_citations_are_told_apart(spark):
    df = spark.createDataFrame([(i, a, y) for i, (a, y, _) in enumerate(AUTHORS)], "duplicate_id int, author string, year int")
    got = {r.duplicate_id: r.citation for r in cite.apa_citations(df).collect()}
    assert [got[i] for i in range(len(AUTHORS))] == [c for _, _, c in AUTHORS]


def test_citations_without_authors(spark):
    df = spark.createDataFrame([(1, None, "2000"), (2, "Plato", None)], "duplicate_id int, author string, year string")
    assert {r.duplicate_id: r.citation for r in cite.apa_citations(df).collect()} == {1: None, 2: "Plato (NA)"}


def test_letters(spark):
    df = spark.createDataFrame([(1,), (26,), (27,), (52,), (702,), (703,)], "n int")
    assert [r[0] for r in df.select(cite.letter(df.n)).collect()] == ["a", "z", "aa", "az", "zz", "aaa"]


def test_reference(spark):
    df = spark.createDataFrame([("Smith, John A. and Lee, Kim", "2001", "On things", "THE JOURNAL", "4", "2", "10.1/x", None)], "author string, year string, title string, journal string, volume string, issue string, doi string, url string")
    assert df.select(cite.apa_reference(df)).first()[0] == "Smith, J. A. & Lee, K. (2001). On things. The Journal, 4(2). https://doi.org/10.1/x"
    assert '<i>The Journal</i><i>, 4</i>(2). <a href="https://doi.org/10.1/x"' in df.select(cite.apa_reference(df, return_html=True)).first()[0]


def test_reference_warns_of_missing_columns(spark):
    df = spark.createDataFrame([("Smith, John", 2001)], "author string, year int")
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        assert df.select(cite.apa_reference(df)).first()[0] == "Smith, J. (2001).  . "
    assert any("title" in str(w.message) for w in seen)


def test_record_level_table(spark):
    df = spark.createDataFrame([("1", "Smith, John", "2001", "T", "A, B"), ("2", "Lee, Kim", "2002", "U", "")], "duplicate_id string, author string, year string, title string, cite_source string")
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        got = {r.duplicate_id: r for r in cite.record_level_table(df, "sources", indicator_presence="x", indicator_absence="").collect()}
        assert got["1"]["source__A"] == "x" and got["2"]["source__A"] == "" and got["1"].citation == "Smith (2001)"
        assert cite.record_level_table(df, "sources", include_empty=False).count() == 1


def test_jaro_against_the_definition():
    import random
    import time

    from tagweave.functions.similarity import jaro

    def plain(a, b):
        if a == b:
            return 1.0
        reach, taken, left = max(0, max(len(a), len(b)) // 2 - 1), [False] * len(b), []
        for i, c in enumerate(a):
            j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if not taken[j] and b[j] == c), None)
            if j is not None:
                taken[j] = True
                left.append(c)
        if not left:
            return 0.0
        swaps, m = sum(x != y for x, y in zip(left, [c for c, t in zip(b, taken, strict=True) if t], strict=True)) // 2, len(left)
        return (m / len(a) + m / len(b) + (m - swaps) / m) / 3

    rng = random.Random(6)
    many = [chr(i) for i in range(0x4E00, 0x4E00 + 400)]
    for letters in ("ab", "abcdefgh é", "aж日\0😀", many):
        for _ in range(300):
            a, b = ("".join(rng.choices(letters, k=rng.randint(0, 30) if len(letters) < 99 else 300)) for _ in "ab")
            assert jaro(a, b) == plain(a, b)
    a, b = ("".join(rng.choices("etaoin shrdlu", k=1540)) for _ in "ab")
    t = time.process_time()
    jaro(a, b)
    assert time.process_time() - t < 0.02


def test_jaro_winkler():
    assert abs(jaro_winkler_similarity("MARTHA", "MARHTA") - 0.961111) < 1e-6
    assert abs(jaro_winkler_similarity("DIXON", "DICKSONX") - 0.813333) < 1e-6
    assert jaro_winkler_similarity("abc", "") == 0 and jaro_winkler_similarity("", "") == 1
