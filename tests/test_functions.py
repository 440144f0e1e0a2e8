import random

import pytest
from pyspark.sql import functions as F

from linkforge.functions import similarity, text


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize(("raw", "want"), [("L.L.C.", "llc"), ("l l c", "llc"), ("A & B Co", "a and b company"), ("Acme Pvt. Ltd.", "acme private limited"), (None, ""), ("  ", ""), ("Ａcme", "acme")])
def test_names(spark, raw, want):
    assert one(spark, text.normalize_business_name, raw) == want


def test_marks_are_kept_on_request(spark):
    raw = "राम मार्केटिंग"
    assert one(spark, text.normalize_business_name, raw) == "र म म र क ट ग"
    assert one(spark, lambda c: text.normalize_business_name(c, True), raw) == raw


@pytest.mark.parametrize(("raw", "want"), [("1 Rd 560001 12345", "560001"), ("x 12345-6789 54321", "12345-6789"), ("12345 54321", "54321"), ("1234", None), (None, None)])
def test_postal_codes(spark, raw, want):
    assert one(spark, text.extract_postal_code, raw) == want


def test_grams(spark):
    assert one(spark, text.grams, "") == [] and one(spark, text.grams, "abc") == ["abc"] and one(spark, text.grams, "aaaaaa") == ["aaaa"]


def plain_jaro_winkler(a, b):
    if not a or not b:
        return 0.0
    reach, free, first = max(0, max(len(a), len(b)) // 2 - 1), set(range(len(b))), []
    for i, c in enumerate(a):
        j = min((j for j in free if abs(i - j) <= reach and b[j] == c), default=None)
        if j is not None:
            free.discard(j)
            first.append(c)
    if not first:
        return 0.0
    m, second = len(first), [c for j, c in enumerate(b) if j not in free]
    jaro = (m / len(a) + m / len(b) + (m - sum(x != y for x, y in zip(first, second, strict=True)) // 2) / m) / 3
    prefix = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return jaro + 0.1 * prefix * (1 - jaro) if jaro > 0.7 else jaro


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for c in a:
        new = [0]
        for j, d in enumerate(b):
            new.append(row[j] + 1 if c == d else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_jaro_winkler_and_indel(monkeypatch):
    rng = random.Random(1)
    pairs = [("martha", "marhta"), ("", "a"), ("abc", "xyz"), (None, "x"), ("", ""), ("é😀a", "é😀b"), ("abcd", "abcdefghij"), ("a", "a")]
    pairs += [tuple("".join(rng.choices("abcdé", k=rng.randint(0, 60))) for _ in range(2)) for _ in range(400)]
    pairs += [(x, x[::-1]) for x, _ in pairs[20:40]] + [(x, x[:20] + "zz" + x[20:]) for x, _ in pairs[40:80]]
    a, b = (list(x) for x in zip(*pairs, strict=True))
    for cells in (50, 10_000, 2_000_000):
        monkeypatch.setattr(similarity, "CELLS", cells)
        assert similarity.jaro_winklers(a, b).tolist() == pytest.approx([plain_jaro_winkler(x, y) for x, y in pairs])
        assert similarity.indels(a, b).tolist() == pytest.approx([2 * plain_lcs(x, y) / (len(x) + len(y)) if x and y else 0 for x, y in pairs])
    assert abs(similarity.jaro_winklers(["martha"], ["marhta"])[0] - 0.9611111) < 1e-6


def test_48_features(spark):
    cols = [f"{s}_{c}" for s in ("s1", "cand") for c in ("name", "address", "country", "postal")]
    df = spark.createDataFrame([("Acme", "1 Rd", "US", "12345", "Acme", None, "us ", None, "S2")], ", ".join(f"{c} string" for c in [*cols, "candidate_source"]))
    out = similarity.pair_features(df)
    assert len(out.columns) - len(df.columns) == 48
    r = out.first()
    assert r.name_exact_match == 1 and r.country_match == 1 and r.candidate_address_missing == 1 and r.postal_match == 0 and r.name_jaro_winkler == 1
    assert len(similarity.feature_names(out)) == 45
