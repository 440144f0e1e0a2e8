import pytest
from helpers import same_rows

from linkforge.plans import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, duck, sf_dir, name):
    same_rows(queries.QUERIES[name](spark, sf_dir), duck, queries.ORACLE_SQL[name])


def test_trained_models(spark, sf_dir):
    scores = queries.i_trained_scores(spark, sf_dir).collect()
    assert scores and all(0 <= r.probability <= 1 for r in scores)
    assert all(0 <= r.singleton_prob <= 1 for r in queries.i_trained_gate(spark, sf_dir).collect())
    assert abs(sum(r.importance for r in queries.i_importance(spark, sf_dir).collect()) - 1) < 1e-6


def test_whole_run_has_every_source_once(spark, sf_dir):
    from linkforge.plans import fixtures

    rows = queries.p_linkage_run(spark, sf_dir).collect()
    ids = {r.source1_entity_id for r in rows}
    assert len(ids) == len(rows) == fixtures.spine(spark, sf_dir).count()
    owners = [c for r in rows for c in r.matched_entity_ids.split(",") if c]
    assert len(owners) == len(set(owners))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_blocking_plan_has_no_cartesian_product(spark, sf_dir):
    from linkforge.operators import sparse
    from linkforge.plans import fixtures

    plan = sparse.block(fixtures.sources(spark, sf_dir), fixtures.targets(spark, sf_dir))._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "WindowGroupLimit" in plan
    assert "html" not in plan


def test_matcher_rows_are_not_cached(spark, monkeypatch):
    from linkforge.operators import model

    def refused(*_):
        raise AssertionError("training rows are cached")

    monkeypatch.setattr(type(spark.range(0)), "persist", refused)
    rows = spark.range(200).selectExpr("double(id % 7) AS a", "int(id % 3) AS b", "int(id % 7 > 3) AS label", "id % 5 = 0 AS held_out")
    m = model.train_matcher(rows, ["a", "b"], trees=2, held_out="held_out")
    assert model.score(m, rows).where("(probability > 0.5) <> (label = 1)").count() == 0


def test_batch_scores_make_no_feature_again(spark, sf_dir):
    plan = queries.i_batch_scores(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Join" not in plan and "levenshtein" not in plan
