import math
from collections import Counter, defaultdict

import pytest

from linkforge.functions.text import preprocess
from linkforge.operators import sparse

RAW = "entity_id string, business_name string, business_address string, country string"


def _expected(sources, targets, top_k, max_df):
    """The definition, over all pairs that share a key."""
    def keys(r):
        c = r.business_name_compact
        out = {("token", t) for t in r.business_name_tokenized} | {("ngram", c[i : i + 4]) for i in range(max(len(c) - 3, 1)) if c}
        return out | ({("postal", r.postal_code)} if r.postal_code else set())

    df = Counter(k for r in targets for k in keys(r))
    n, held = len(targets), defaultdict(list)
    for r in targets:
        for k in keys(r):
            if k[0] == "postal" or df[k] <= max(2, max_df * n):
                held[k].append(r)
    known = {r.country_normalized for r in targets} - {""}
    out = set()
    for s in sources:
        raw, kinds, of = defaultdict(float), defaultdict(set), {}
        for k in sorted(keys(s)):
            for t in held[k]:
                raw[t.entity_id] += 10.0 if k[0] == "postal" else math.log(n / (df[k] + 1)) * (0.3 if k[0] == "ngram" else 1.0)
                kinds[t.entity_id].add(k[0])
                of[t.entity_id] = t.country_normalized
        rows = []
        for t, v in raw.items():
            if s.country_normalized in known:
                same = of[t] == s.country_normalized
                v, kinds[t] = v * (1.5 if same else 0.2), kinds[t] | ({"country"} if same else set())
            rows.append((-round(v, 6), t, ",".join(sorted(kinds[t]))))
        out |= {(s.entity_id, t, round(-v, 6), p, i + 1) for i, (v, t, p) in enumerate(sorted(rows)[:top_k])}
    return out


def _sides(spark, sources, targets):
    return [preprocess(spark.createDataFrame(rows, RAW)) for rows in (sources, targets)]


@pytest.mark.parametrize("parts", [(100_000, 125_000, 256), (7, 11, 5)])
@pytest.mark.parametrize("max_df", [0.01, 0.5])
def test_block_equals_definition(spark, monkeypatch, parts, max_df):
    for name, v in zip(("SOURCES", "TARGETS", "FEW"), parts, strict=True):
        monkeypatch.setattr(sparse, name, v)
    words = ["north", "coffee", "house", "Łódź", "bar", "x", "river", "garden", "old", "mill"]

    def record(kind, i):
        name = None if i % 13 == 0 else "" if i % 17 == 0 else " ".join(words[(i * k + k) % 10] for k in (1, 3, 7)[: 1 + i % 3])
        address = None if i % 11 == 0 else f"{i} Rd, {10000 + i % 3}"
        return f"{kind}-{i}", name, address, (None, "de", "es", "fr")[i % 4] if kind != "S1" else (None, "de", "xx", "es")[i % 4]

    # Copies of one record under many ids share all keys and a score: the smaller ids count.
    copies = [(f"S3-{900 + i}", "old mill bar", "1 Rd, 10001", "de") for i in range(20)]
    s, t = _sides(spark, [record("S1", i) for i in range(40)], [record("S2", i) for i in range(60)] + copies)
    got = {tuple(r) for r in sparse.block(s, t, 6, max_df=max_df).collect()}
    assert got == _expected(s.collect(), t.collect(), 6, max_df)


def test_block_of_two_records_has_a_negative_score(spark):
    s, t = _sides(spark, [("S1-1", "abcd", None, None)], [("S2-1", "abcd", None, None), ("S2-2", "abcd", None, None)])
    assert {tuple(r) for r in sparse.block(s, t).collect()} == _expected(s.collect(), t.collect(), 30, 0.01)
    assert sparse.block(s, t).first().score < 0


def test_block_of_nothing(spark):
    s, t = _sides(spark, [("S1-1", "abcd", None, None)], [("S2-1", "other", None, None)])
    assert sparse.block(s, t).count() == sparse.block(s.where("false"), t).count() == sparse.block(s, t.where("false")).count() == 0


def test_pairs_that_share_a_key_are_not_shuffled(spark):
    """200 sources and 300 targets share a postal code: 60,000 pairs, of which 3 for a source leave a task."""
    s, t = _sides(spark, [(f"S1-{i}", f"a{i}", "1 Rd, 12345", None) for i in range(200)], [(f"S2-{i}", f"b{i}", "1 Rd, 12345", None) for i in range(300)])
    out = sparse.block(s, t, 3)
    assert out.count() == 600
    out.collect()
    plan = out._jdf.queryExecution().executedPlan()
    written = []

    def visit(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return visit(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return visit(node.plan())
        if name == "ShuffleExchangeExec":
            written.append(node.metrics().apply("shuffleRecordsWritten").value())
        for i in range(node.children().size()):
            visit(node.children().apply(i))

    visit(plan)
    assert written and max(written) < 10_000, written


def test_features_are_not_shuffled_or_kept(spark, sf_dir):
    """Labels and records are joined while pairs are narrow; scores read six of the 48 features."""
    from linkforge.plans import fixtures

    plan = fixtures.features(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in plan.splitlines() if "Join" in x]
    assert joins and plan.index("name_token_jaccard") < plan.index(joins[0])
    assert not fixtures.features(spark, sf_dir).is_cached


def test_systems_in_one_pass_equal_each_alone(spark, sf_dir, monkeypatch):
    """The lists of several systems come from one set of packed records: keys and both sides are written once."""
    from linkforge.plans import fixtures

    s, t = fixtures.sources(spark, sf_dir), fixtures.targets(spark, sf_dir)
    written = []
    monkeypatch.setattr(sparse, "write_parquet", lambda df, path, put=sparse.write_parquet: written.append(path) or put(df, path))
    both = sparse.block_each(s, t, fixtures.SYSTEMS, 6).collect()
    assert len(written) == 3
    for name, paths in fixtures.SYSTEMS.items():
        alone = sparse.block(s, t, 6, paths).collect()
        assert alone and sorted(tuple(r) for r in alone) == sorted(tuple(r)[1:] for r in both if r.system == name)


def test_grams_are_made_once_for_a_pair(spark, sf_dir):
    """The scorer's plan makes grams once for the names and once for the addresses of each side."""
    from linkforge.operators import model
    from linkforge.plans import fixtures

    scores = model.fixed_score(fixtures.features(spark, sf_dir)).select("probability")
    pairs = scores._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert pairs.count("sequence(") == 4
