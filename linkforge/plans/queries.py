"""Queries of the linkage operators over the documents table, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkforge.functions import text as tx
from linkforge.functions.similarity import feature_names, indel
from linkforge.operators import candidates, dense, metrics, model, profile, resolve, sparse, validate
from linkforge.operators.candidates import PAIR
from linkforge.plans import fixtures as fx
from linkforge.plans.fixtures import sql
from linkforge.sources import tables
from linkforge.sources.scratch import new_path

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
#: The match sweep's thresholds.
GRID = [x / 100 for x in range(10, 100)]
GATES = [0.5, 0.6, 0.7, 0.8, 0.9, 0.95]


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = sql(oracle)
        return f
    return add


def _rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _levels_sql(values: list[float]) -> str:
    return "(VALUES " + ", ".join(f"({v}e0)" for v in values) + ") AS lv(threshold)"


_F05 = "CASE WHEN t = 0 AND s = 0 THEN 1e0 WHEN t = 0 OR s = 0 OR h = 0 THEN 0e0 ELSE 1.25e0 * (h / s::DOUBLE) * (h / t::DOUBLE) / (0.25e0 * (h / s::DOUBLE) + h / t::DOUBLE) END"
_PRF = "round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 6) AS recall, round(CASE WHEN tp = 0 THEN 0e0 ELSE 1.25e0 * tp / (1.25e0 * tp + fp + 0.25e0 * fn) END, 6) AS f05"


# Normalisation (C)


@query("""SELECT entity_id, source, country_normalized, name_n AS business_name_normalized, compact_n AS business_name_compact, array_to_string(toks, ' ') AS tokens, addr_n AS business_address_normalized,
  replace(addr_n, ' ', '') AS business_address_compact, postal AS postal_code, (postal IS NOT NULL)::INTEGER AS has_postal_code, strlen(business_name) <> length(business_name) AS name_has_non_ascii, false AS name_has_devanagari,
  concat('NAME: ', coalesce(business_name, ''), ' | ADDRESS: ', coalesce(business_address, ''), ' | COUNTRY: ', coalesce(country, '')) AS formatted FROM grammed""")
def c_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = fx.records(spark, sf_dir).withColumn("tokens", F.array_join("business_name_tokenized", " "))
    r = r.withColumn("formatted", tx.format_record(F.col("business_name"), F.col("business_address"), F.col("country")))
    return r.select("entity_id", "source", "country_normalized", "business_name_normalized", "business_name_compact", "tokens", "business_address_normalized", "business_address_compact", "postal_code", "has_postal_code", "name_has_non_ascii", "name_has_devanagari", "formatted")


@query("SELECT entity_id, len(grams)::INTEGER AS n, array_to_string(list_sort(grams), '|') AS grams FROM grammed")
def c_grams(spark, sf_dir):
    g = fx.records(spark, sf_dir).select("entity_id", tx.grams(F.col("business_name_compact")).alias("g"))
    return g.select("entity_id", F.size("g").alias("n"), F.array_join(F.array_sort("g"), "|").alias("grams"))


_LITERALS = ["L.L.C.", "A & B Co", "Acme Pvt. Ltd.", "Cafe De L'amour", "", "NA", "12 st 560001 near 12345-6789", "PO 12345, 54321 Dr", "900001 or 900002", None, "Ａcme ﬁn", "राम मार्केटिंग", "Ⅻ Ŀ  ½"]


@query("""SELECT *, i = 11 AS devanagari FROM (VALUES (0, 'llc', 'l l c', NULL), (1, 'a and b company', 'a b co', NULL), (2, 'acme private limited', 'acme pvt ltd', NULL), (3, 'cafe de l amour', 'cafe de l amour', NULL), (4, '', '', NULL), (5, 'na', 'na', NULL),
  (6, '12 st 560001 near 12345 6789', '12 street 560001 near 12345 6789', '560001'), (7, 'po 12345 54321 dr', 'po 12345 54321 drive', '54321'), (8, '900001 or 900002', '900001 or 900002', '900002'), (9, '', '', NULL),
  (10, 'acme fin', 'acme fin', NULL), (11, 'र म म र क ट ग', 'र म म र क ट ग', NULL), (12, 'xii l 1 2', 'xii l 1 2', NULL)) AS v(i, name, address, postal)""")
def c_literals(spark, sf_dir):
    v = spark.createDataFrame(list(enumerate(_LITERALS)), "i int, raw string")
    return v.select("i", tx.normalize_business_name(F.col("raw")).alias("name"), tx.normalize_address(F.col("raw")).alias("address"), tx.extract_postal_code(F.col("raw")).alias("postal"), tx.has_devanagari(F.col("raw")).alias("devanagari"))


# Sparse blocking (D)


@query("SELECT kind, key, df, round(weight, 6) AS weight FROM kw")
def d_key_weights(spark, sf_dir):
    t = fx.targets(spark, sf_dir)
    return _rounded(sparse.key_weights(sparse.keys(t), t.agg(F.count(F.lit(1)).alias("n"))))


@query("SELECT source1_entity_id, candidate_entity_id, score, provenance, rank FROM blocked")
def d_sparse_top30(spark, sf_dir):
    return fx.blocked(spark, sf_dir)


@query("SELECT source1_entity_id, candidate_entity_id, score, rank FROM blocked WHERE rank <= 5")
def d_sparse_top5(spark, sf_dir):
    return fx.blocked(spark, sf_dir).where("rank <= 5").select(*PAIR, "score", "rank")


@query("SELECT 'token' AS paths, count(*) AS pairs, round(sum(score), 3) AS total FROM by_token UNION ALL SELECT 'ngram', count(*), round(sum(score), 3) FROM by_ngram UNION ALL SELECT 'all', count(*), round(sum(score), 3) FROM blocked")
def d_path_ablation(spark, sf_dir):
    found = fx.systems(spark, sf_dir, *fx.SYSTEMS)
    parts = [found.where(F.col("system") == n).agg(F.lit(n).alias("paths"), F.count(F.lit(1)).alias("pairs"), F.round(F.sum("score"), 3).alias("total")) for n in fx.SYSTEMS]
    return parts[0].union(parts[1]).union(parts[2])


# Dense blocking (E)

_KNN_ALL = """
SELECT source1_entity_id, candidate_entity_id, score, rank FROM (
  SELECT *, (row_number() OVER (PARTITION BY source1_entity_id ORDER BY score DESC, candidate_entity_id))::INTEGER AS rank FROM (
    SELECT concat('V1-', a.vec_id) AS source1_entity_id, concat('V', b.vec_id % 3 + 1, '-', b.vec_id) AS candidate_entity_id,
      round(list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v)) / sqrt(list_dot_product(b.v, b.v)), 6) AS score
    FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 3 = 0) a, (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 3 <> 0) b))"""
_KNN_SQL = f"{_KNN_ALL} WHERE rank <= 30"


def _vectors(spark, sf_dir):
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    v = v.select(F.concat(F.lit("V"), (F.col("vec_id") % 3 + 1).cast("string"), F.lit("-"), F.col("vec_id").cast("string")).alias("entity_id"), dense.unit(F.col("embedding")).alias("embedding"))
    return v.where("entity_id like 'V1-%'"), v.where("entity_id not like 'V1-%'")


@query(_KNN_SQL)
def e_nearest30(spark, sf_dir):
    return dense.nearest(*_vectors(spark, sf_dir), 30)


@query(f"SELECT k, count(*) AS pairs, round(avg(score), 6) AS mean_score, round(min(score), 6) AS least FROM ({_KNN_ALL}), (VALUES (10), (20), (30), (50)) AS ks(k) WHERE rank <= k GROUP BY k")
def e_k_sweep(spark, sf_dir):
    ks = spark.createDataFrame([(10,), (20,), (30,), (50,)], "k int")
    return _rounded(dense.nearest(*_vectors(spark, sf_dir), 50).crossJoin(F.broadcast(ks)).where("rank <= k").groupBy("k").agg(F.count(F.lit(1)).alias("pairs"), F.avg("score").alias("mean_score"), F.min("score").alias("least")))


@query(f"SELECT count(*) AS pairs, true AS reached, 0::BIGINT AS differing FROM ({_KNN_SQL})")
def e_index_recall(spark, sf_dir):
    """Recall of the index against all products, and what saving and loading it changes."""
    sources, targets = _vectors(spark, sf_dir)
    index = dense.Index.fit(targets)
    path = new_path(spark, "index")
    index.save(path)
    found = index.search(sources, 30)
    again = dense.Index.load(spark, path).search(sources, 30)
    columns = [*PAIR, "score", "rank"]
    differing = found.select(*columns).exceptAll(again.select(*columns)).agg(F.count(F.lit(1)).alias("differing"))
    share = dense.recall(found, dense.nearest(sources, targets, 30))
    return share.select("pairs", (F.col("recall") >= 0.9).alias("reached")).crossJoin(differing)


@query("SELECT count(*) AS targets, 0::BIGINT AS differing FROM embeddings WHERE vec_id % 3 <> 0")
def e_index_insert(spark, sf_dir):
    """An index that gets its targets in two batches holds what one that gets all at once holds."""
    sources, targets = _vectors(spark, sf_dir)
    whole = dense.Index.fit(targets)
    odd = F.xxhash64("entity_id") % 2 == 0
    empty = dense.Index(whole.centres, whole.rows.where("false"), whole.probes)
    both = empty.insert(targets.where(odd)).insert(targets.where(~odd))
    columns = [*PAIR, "score", "rank"]
    differing = whole.search(sources, 10).select(*columns).exceptAll(both.search(sources, 10).select(*columns)).agg(F.count(F.lit(1)).alias("differing"))
    return both.rows.agg(F.count(F.lit(1)).alias("targets")).crossJoin(differing)


def _dense(spark, sf_dir):
    return fx.kept(spark, sf_dir, "dense", lambda: dense.nearest(dense.embed(fx.sources(spark, sf_dir)), dense.embed(fx.targets(spark, sf_dir)), 30))


@query()
def e_hashed_records(spark, sf_dir):
    return _dense(spark, sf_dir)


# Union and pruning (F): tokens stand for the sparse list and 4-grams for the dense one, so that SQL can follow

_UNION_SQL = """
SELECT coalesce(a.source1_entity_id, b.source1_entity_id) AS source1_entity_id, coalesce(a.candidate_entity_id, b.candidate_entity_id) AS candidate_entity_id,
  CASE WHEN b.rank IS NULL THEN 'SPARSE' WHEN a.rank IS NULL THEN 'DENSE' ELSE 'BOTH' END AS provenance, greatest(a.score, b.score) AS score
FROM by_token a FULL JOIN by_ngram b ON a.source1_entity_id = b.source1_entity_id AND a.candidate_entity_id = b.candidate_entity_id"""
_PLACED_SQL = f"SELECT *, row_number() OVER (PARTITION BY source1_entity_id ORDER BY CASE provenance WHEN 'BOTH' THEN 0 WHEN 'SPARSE' THEN 1 ELSE 2 END, score DESC, candidate_entity_id) AS place FROM ({_UNION_SQL})"


def _union(spark, sf_dir):
    found = fx.systems(spark, sf_dir, "token", "ngram")
    return candidates.union(found.where("system = 'token'"), found.where("system = 'ngram'"))


@query(_UNION_SQL)
def f_union(spark, sf_dir):
    return _union(spark, sf_dir)


@query(f"SELECT source1_entity_id, candidate_entity_id, provenance, score FROM ({_PLACED_SQL}) WHERE place <= 40")
def f_prune40(spark, sf_dir):
    return candidates.prune(_union(spark, sf_dir), 40)


@query(f"SELECT provenance, count(*) AS pairs, round(100e0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM ({_UNION_SQL}) GROUP BY provenance")
def f_provenance(spark, sf_dir):
    c = _union(spark, sf_dir).groupBy("provenance").agg(F.count(F.lit(1)).alias("pairs"))
    return _rounded(c.withColumn("percent", 100.0 * F.col("pairs") / F.sum("pairs").over(Window.partitionBy())))


@query(f"SELECT coalesce(provenance, 'MISSED') AS found_by, count(*) AS true_pairs FROM gt LEFT JOIN ({_UNION_SQL}) u USING (source1_entity_id, candidate_entity_id) GROUP BY 1")
def f_complementarity(spark, sf_dir):
    return fx.truth(spark, sf_dir).join(_union(spark, sf_dir), PAIR, "left").groupBy(F.coalesce("provenance", F.lit("MISSED")).alias("found_by")).agg(F.count(F.lit(1)).alias("true_pairs"))


@query(f"""WITH pl AS MATERIALIZED ({_PLACED_SQL}), ks AS (SELECT unnest([20, 30, 40, 50, 60])::INTEGER AS k)
SELECT k, (SELECT count(*) FROM pl WHERE place <= k) AS pairs, (SELECT count(*) FROM pl JOIN gt USING (source1_entity_id, candidate_entity_id) WHERE place <= k) AS found FROM ks""")
def f_k_ablation(spark, sf_dir):
    ks = F.broadcast(spark.createDataFrame([(k,) for k in (20, 30, 40, 50, 60)], "k int"))
    placed = candidates.with_labels(candidates.ranked(_union(spark, sf_dir)), fx.truth(spark, sf_dir))
    return placed.crossJoin(ks).where("place <= k").groupBy("k").agg(F.count(F.lit(1)).alias("pairs"), F.sum("label").alias("found"))


# Joins and set operations (G)


@query("""SELECT 'semi' AS op, count(*) AS n FROM tg WHERE entity_id IN (SELECT candidate_entity_id FROM gt) UNION ALL SELECT 'anti', count(*) FROM s1 WHERE entity_id NOT IN (SELECT source1_entity_id FROM gt)
UNION ALL SELECT 'intersect', count(*) FROM (SELECT country FROM s1 INTERSECT SELECT country FROM tg) UNION ALL SELECT 'except', count(*) FROM (SELECT business_name FROM s1 EXCEPT SELECT business_name FROM tg)
UNION ALL SELECT 'union', count(*) FROM (SELECT business_name FROM s1 UNION SELECT business_name FROM tg) UNION ALL SELECT 'union_all', count(*) FROM (SELECT business_name FROM s1 UNION ALL SELECT business_name FROM tg)
UNION ALL SELECT 'duplicates', count(*) - count(DISTINCT business_name) FROM rec""")
def g_set_operations(spark, sf_dir):
    s, t, g = fx.sources(spark, sf_dir), fx.targets(spark, sf_dir), fx.truth(spark, sf_dir)
    sn, tn = s.select("business_name"), t.select("business_name")
    parts = {
        "semi": t.join(g, t.entity_id == g.candidate_entity_id, "left_semi"), "anti": s.join(g, s.entity_id == g.source1_entity_id, "left_anti"),
        "intersect": s.select("country").intersect(t.select("country")), "except": sn.subtract(tn), "union": sn.union(tn).distinct(), "union_all": sn.unionByName(tn),
    }
    out = fx.records(spark, sf_dir).agg(F.lit("duplicates").alias("op"), (F.count("business_name") - F.countDistinct("business_name")).alias("n"))
    for op, df in parts.items():
        out = out.union(df.agg(F.lit(op), F.count(F.lit(1))))
    return out


@query("SELECT source1_entity_id, candidate_entity_id, candidate_source, label FROM feat")
def g_labelled_pairs(spark, sf_dir):
    return fx.labelled(spark, sf_dir).select(*PAIR, "candidate_source", "label")


# Features (H)

_NOT_SQL = {"name_edit_similarity", "address_edit_similarity", "name_jaro_winkler", "name_sorted_token_similarity"}
_ASCII = "regexp_matches(na, '^[\\x00-\\x7F]*$') AND regexp_matches(nb, '^[\\x00-\\x7F]*$') AND na <> '' AND nb <> ''"


@query("SELECT source1_entity_id, candidate_entity_id, round(COLUMNS(* EXCLUDE (source1_entity_id, candidate_entity_id, candidate_source, na, nb, aa, ab, label)), 6) FROM feat")
def h_features(spark, sf_dir):
    f = fx.features(spark, sf_dir)
    return _rounded(f.select(*PAIR, *[c for c in f.columns if c not in {*PAIR, "score", "rank", "provenance", "candidate_source", "label", *_NOT_SQL} and not c.startswith(("s1_name", "s1_address", "s1_country", "s1_postal", "cand_")) or c.endswith("_missing")]))


@query(f"""SELECT source1_entity_id, candidate_entity_id, round(1 - levenshtein(na, nb)::DOUBLE / greatest(length(na), length(nb)), 6) AS edit_similarity, round(jaro_winkler_similarity(na, nb), 6) AS jaro_winkler,
  round(CASE WHEN aa = '' OR ab = '' THEN 0e0 ELSE 1 - levenshtein(aa, ab)::DOUBLE / greatest(length(aa), length(ab)) END, 6) AS address_edit_similarity FROM feat WHERE {_ASCII} AND regexp_matches(aa || ab, '^[\\x00-\\x7F]*$')""")
def h_edit_ascii(spark, sf_dir):
    f = fx.features(spark, sf_dir).where(~F.col("s1_name").rlike(r"[^\x00-\x7F]") & ~F.col("cand_name").rlike(r"[^\x00-\x7F]") & (F.trim("s1_name") != "") & (F.trim("cand_name") != ""))
    f = f.where(~F.concat(*(F.coalesce(c, F.lit("")) for c in ("s1_address", "cand_address"))).rlike(r"[^\x00-\x7F]"))
    return _rounded(f.select(*PAIR, F.col("name_edit_similarity").alias("edit_similarity"), F.col("name_jaro_winkler").alias("jaro_winkler"), "address_edit_similarity"))


@query("SELECT * FROM (VALUES ('acme corp', 'corp acme', 1e0), ('kitten', 'sitting', 0.615385e0), ('', 'x', 0e0)) AS v(a, b, sorted_token)")
def h_sorted_tokens(spark, sf_dir):
    v = spark.createDataFrame([("acme corp", "corp acme"), ("kitten", "sitting"), ("", "x")], "a string, b string")
    a, b = (F.array_join(F.array_sort(tx.tokens(F.col(c))), " ") for c in ("a", "b"))
    return _rounded(v.select("a", "b", indel(a, b).alias("sorted_token")))


@query()
def h_all_48(spark, sf_dir):
    f = fx.features(spark, sf_dir)
    made = [c for c in f.columns if c not in {*PAIR, "score", "rank", "provenance", "candidate_source", "label"} and (not c.startswith(("s1_name", "s1_address", "s1_country", "s1_postal", "cand_")) or c.endswith("_missing"))]
    return f.select(*PAIR, *made)


@query("SELECT 45::BIGINT AS features, 48::BIGINT AS made, 0::BIGINT AS forbidden")
def h_feature_names(spark, sf_dir):
    """How many of the 48 features a model may use, and how many ids, labels or raw columns are among them (none)."""
    names, made = feature_names(fx.features(spark, sf_dir)), len(h_all_48(spark, sf_dir).columns) - len(PAIR)
    raw = {*PAIR, "label", "score", "rank", "probability", "provenance", "candidate_source"}
    return spark.createDataFrame([(len(names), made, len(raw.intersection(names)))], "features long, made long, forbidden long")


# Models (I)


@query("SELECT source1_entity_id, candidate_entity_id, label, probability FROM sc")
def i_fixed_scores(spark, sf_dir):
    return fx.scored(spark, sf_dir).select(*PAIR, "label", "probability")


_HARD_SQL = "SELECT source1_entity_id, candidate_entity_id, label, probability FROM (SELECT *, row_number() OVER (PARTITION BY source1_entity_id ORDER BY probability DESC, candidate_entity_id) AS r FROM sc WHERE label = 0 AND probability >= 0.01) WHERE r <= 3 ORDER BY probability DESC, source1_entity_id, candidate_entity_id LIMIT 200"


@query(_HARD_SQL)
def i_hard_negatives(spark, sf_dir):
    return candidates.hard_negatives(fx.scored(spark, sf_dir), 3, 0.01, 200).select(*PAIR, "label", "probability")


@query(f"""WITH hd AS MATERIALIZED ({_HARD_SQL}) SELECT source1_entity_id, candidate_entity_id, label, probability, 'positive' AS kind FROM sc WHERE label = 1
UNION ALL (SELECT source1_entity_id, candidate_entity_id, label, probability, 'ordinary' FROM sc ANTI JOIN hd USING (source1_entity_id, candidate_entity_id) WHERE label = 0 ORDER BY md5(concat(source1_entity_id, '|', candidate_entity_id)), 1, 2 LIMIT 500)
UNION ALL SELECT source1_entity_id, candidate_entity_id, label, probability, 'hard' FROM hd""")
def i_second_round(spark, sf_dir):
    s = fx.scored(spark, sf_dir)
    return candidates.second_round(s, candidates.hard_negatives(s, 3, 0.01, 200), 500)


@query("SELECT source1_entity_id, ('0x' || substr(md5(source1_entity_id), 1, 8))::BIGINT % 100 < 80 AS is_train FROM spine")
def i_split(spark, sf_dir):
    return candidates.split(fx.spine(spark, sf_dir))


_models: dict[tuple, tuple] = {}


def _trained(spark, sf_dir):
    """The matcher on all 45 features with the default number of trees, stopped early on the held-out sources; kept for the session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    rows = fx.model_rows(spark, sf_dir)
    if key not in _models:
        names = feature_names(rows)
        _models[key] = model.train_matcher(candidates.split(rows).withColumn("held_out", ~F.col("is_train")), names, held_out="held_out", is_stored=True), names
    m, names = _models[key]
    return m, rows, names


@query()
def i_trained_scores(spark, sf_dir):
    m, rows, names = _trained(spark, sf_dir)
    return model.score(m, rows.select(*PAIR, "label", *names)).select(*PAIR, "label", "probability")


@query("SELECT count(*) AS pairs, 0::BIGINT AS differing, true AS refused FROM feat")
def i_batch_scores(spark, sf_dir):
    """A saved matcher, loaded by its second path, scores with its own order of features as the one in memory does."""
    m, rows, names = _trained(spark, sf_dir)
    path = new_path(spark, "matcher")
    tables.save_model(spark, m, names, path)
    try:
        tables.load_model(spark, f"{path}-absent")
        refused = False
    except FileNotFoundError:
        refused = True
    again, order = tables.load_model(spark, f"{path}-absent", path)
    one = model.score(m, rows.select(*PAIR, *names), "p")  # both score a row as it is read, so nothing is joined
    two = model.score(again, one.select(*PAIR, "p", *order[::-1]))
    return two.agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("probability") != F.col("p")).alias("differing")).withColumn("refused", F.lit(refused))


@query()
def i_second_matcher(spark, sf_dir):
    """Probabilities of the matcher that is trained on the second-round set of the fixed scores."""
    s = fx.scored(spark, sf_dir)
    second = candidates.second_round(s, candidates.hard_negatives(s, 3, 0.01, 200), 500)
    rows = candidates.split(fx.features(spark, sf_dir)).withColumn("held_out", ~F.col("is_train"))
    names = feature_names(fx.features(spark, sf_dir))
    m = model.train_second(rows, second, names, held_out="held_out")
    return model.score(m, rows.select(*PAIR, "label", *names)).select(*PAIR, "label", "probability")


@query()
def i_importance(spark, sf_dir):
    return model.importance(_trained(spark, sf_dir)[0])


@query()
def i_trained_gate(spark, sf_dir):
    """The gate learns from the sources of the training side and scores those held out too."""
    st = candidates.split(fx.gate(spark, sf_dir).drop("singleton_prob"))
    return model.score(model.train_gate(st.where("is_train")), st, "singleton_prob").select("source1_entity_id", "is_singleton", "is_train", "singleton_prob")


# Resolution (J, B)


@query("SELECT source1_entity_id, round(max_prob, 6) AS max_prob, round(mean_prob, 6) AS mean_prob, round(median_prob + 1e-9, 6) AS median_prob, round(std_prob, 6) AS std_prob, candidate_count, high_prob_count, round(top1_minus_top2, 6) AS top1_minus_top2, round(top1_minus_mean, 6) AS top1_minus_mean, is_singleton FROM st")
def j_entity_statistics(spark, sf_dir):
    # A median of two lies on the edge of two roundings; both sides push it up a little.
    return _rounded(fx.gate(spark, sf_dir).drop("singleton_prob").withColumn("median_prob", F.col("median_prob") + 1e-9))


@query("SELECT source1_entity_id FROM st WHERE singleton_prob >= 0.5")
def j_gated(spark, sf_dir):
    return resolve.gated(fx.gate(spark, sf_dir))


@query("SELECT source1_entity_id, candidate_entity_id, probability, uniqueness_decision FROM own")
def j_best_owner(spark, sf_dir):
    return resolve.best_owner(fx.scored(spark, sf_dir)).select(*PAIR, "probability", "uniqueness_decision")


def _final(spark, sf_dir):
    return resolve.matches(fx.scored(spark, sf_dir), fx.gate(spark, sf_dir))


@query("SELECT source1_entity_id, candidate_entity_id, probability, label FROM fin")
def j_matches(spark, sf_dir):
    return _final(spark, sf_dir).select(*PAIR, "probability", "label")


@query("SELECT source1_entity_id, candidate_entity_id FROM sc WHERE probability >= 0.86 AND source1_entity_id NOT IN (SELECT source1_entity_id FROM st WHERE singleton_prob >= 0.5)")
def j_matches_shared(spark, sf_dir):
    return resolve.matches(fx.scored(spark, sf_dir), fx.gate(spark, sf_dir), unique=False).select(*PAIR)


@query("SELECT source1_entity_id, candidate_entity_id FROM (SELECT *, row_number() OVER (PARTITION BY candidate_entity_id ORDER BY probability DESC, source1_entity_id) AS r FROM sc WHERE probability >= 0.3) WHERE r = 1")
def j_reassigned(spark, sf_dir):
    return resolve.matches(fx.scored(spark, sf_dir), None, threshold=0.3, reassign=True).select(*PAIR)


@query("SELECT source1_entity_id, coalesce(ids, '') AS matched_entity_ids FROM spine LEFT JOIN (SELECT source1_entity_id, string_agg(candidate_entity_id, ',' ORDER BY candidate_entity_id) AS ids FROM fin GROUP BY 1) USING (source1_entity_id)")
def b_matching_results(spark, sf_dir):
    return resolve.results(fx.spine(spark, sf_dir), _final(spark, sf_dir))


@query("SELECT source1_entity_id, coalesce(ids, '') AS candidate_entity_ids FROM spine LEFT JOIN (SELECT source1_entity_id, string_agg(candidate_entity_id, ',' ORDER BY candidate_entity_id) AS ids FROM blocked GROUP BY 1) USING (source1_entity_id)")
def b_candidate_pairs(spark, sf_dir):
    return tables.roll_up(fx.spine(spark, sf_dir), fx.blocked(spark, sf_dir), "candidate_entity_ids")


@query("SELECT source1_entity_id, candidate_entity_id FROM blocked")
def a_exploded_lists(spark, sf_dir):
    return tables.explode_lists(b_candidate_pairs(spark, sf_dir), "candidate_entity_ids")


@query("""WITH c AS (SELECT source1_entity_id, count(b.candidate_entity_id) AS n FROM spine LEFT JOIN blocked b USING (source1_entity_id) GROUP BY 1)
SELECT count(*) AS sources, sum(n)::BIGINT AS candidates, round(avg(n), 6) AS mean_candidates, quantile_cont(n, 0.5)::DOUBLE AS median_candidates, round(quantile_cont(n, 0.95), 6)::DOUBLE AS p95_candidates, round(quantile_cont(n, 0.99), 6)::DOUBLE AS p99_candidates, max(n) AS max_candidates, count_if(n = 0)::BIGINT AS without_candidates,
  (SELECT count(*) FROM fin) AS matches, (SELECT count(*) FROM fin WHERE candidate_source = 'S2') AS s2_matches, (SELECT count(*) FROM fin WHERE candidate_source = 'S3') AS s3_matches, (SELECT count(DISTINCT source1_entity_id) FROM fin) AS matched_sources, 0.86::DOUBLE AS match_threshold, 0.5::DOUBLE AS gate_threshold FROM c""")
def j_summary(spark, sf_dir):
    return _rounded(resolve.summary(fx.spine(spark, sf_dir), fx.blocked(spark, sf_dir), _final(spark, sf_dir)))


_PLAIN = "regexp_replace({0}, '[\\t\\n\\r\"]', ' ', 'g')"
_CELL = "CASE WHEN {0} IN ('', 'NA', 'N/A', 'NULL', 'null', 'None', 'nan', 'NaN', 'n/a') THEN NULL ELSE {0} END AS {1}"
_FILE_SQL = ", ".join(_CELL.format(_PLAIN.format(c), c) for c in ("entity_id", "business_name", "business_address", "country"))


def _record_file(spark, sf_dir, kind: str, sep: str) -> str:
    """The records as a delimited file without an ending, written for this query."""
    stem = new_path(spark, "records")
    raw = fx.records(spark, sf_dir).select(*[F.coalesce(F.regexp_replace(c, r'[\t\n\r"]', " "), F.lit("")).alias(c) for c in ("entity_id", "business_name", "business_address", "country")])
    quote = "" if sep == "\t" else '"'
    raw.write.options(sep=sep, header=True, emptyValue="", quote=quote, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(f"{stem}.{kind}")
    return stem


@query(f"SELECT {_FILE_SQL} FROM rec")
def a_tsv_scan(spark, sf_dir):
    return tables.read_records(spark, _record_file(spark, sf_dir, "tsv", "\t") + ".tsv")


@query(f"SELECT 'csv' AS kind, {_FILE_SQL} FROM rec UNION ALL SELECT 'tsv', {_FILE_SQL} FROM rec")
def a_either_scan(spark, sf_dir):
    both = [tables.read_either(spark, _record_file(spark, sf_dir, kind, sep)).select(F.lit(kind).alias("kind"), "*") for kind, sep in (("csv", ","), ("tsv", "\t"))]
    return both[0].unionByName(both[1])


@query("SELECT entity_id FROM rec")
def a_id_scan(spark, sf_dir):
    return tables.read_ids(spark, _record_file(spark, sf_dir, "tsv", "\t") + ".tsv")


@query("SELECT doc_id // 250 AS chunk, count(*) AS rows, count(business_address) AS with_address FROM rec GROUP BY 1")
def a_chunked_scan(spark, sf_dir):
    return tables.in_chunks(fx.records(spark, sf_dir), "doc_id", 250).groupBy("chunk").agg(F.count(F.lit(1)).alias("rows"), F.count("business_address").alias("with_address"))


@query("SELECT 0.86::DOUBLE AS final_match_threshold, 0.5::DOUBLE AS singleton_gate_threshold, (SELECT count(*) FROM fin) AS matches")
def b_json(spark, sf_dir):
    path = new_path(spark, "metrics")
    tables.write_json(spark, {"singleton_gate_threshold": resolve.GATE, "final_match_threshold": resolve.MATCH, "matches": _final(spark, sf_dir).count()}, path)
    v = tables.read_json(spark, path)
    return spark.createDataFrame([(v["final_match_threshold"], v["singleton_gate_threshold"], v["matches"])], "final_match_threshold double, singleton_gate_threshold double, matches long")


@query("SELECT 'matching_results' AS file, source1_entity_id, '' AS ids FROM spine UNION ALL SELECT 'candidate_pairs', source1_entity_id, '' FROM spine")
def b_empty_results(spark, sf_dir):
    path = new_path(spark, "empty")
    tables.write_empty_results(fx.spine(spark, sf_dir), path)
    both = [spark.read.options(sep="\t", header=True).schema("source1_entity_id string, ids string").csv(f"{path}/{name}.tsv").select(F.lit(name).alias("file"), "source1_entity_id", F.coalesce("ids", F.lit("")).alias("ids")) for name in ("matching_results", "candidate_pairs")]
    return both[0].unionByName(both[1])


@query("SELECT source1_entity_id, candidate_entity_id, candidate_source, label, probability FROM sc")
def b_parquet(spark, sf_dir):
    return tables.write_parquet(fx.scored(spark, sf_dir).select(*PAIR, "candidate_source", "label", "probability"), new_path(spark, "predictions"))


@query(f"SELECT *, {_PRF} FROM (SELECT threshold, count_if(probability >= threshold AND label = 1)::BIGINT AS tp, count_if(probability >= threshold AND label = 0)::BIGINT AS fp, count_if(probability < threshold AND label = 1)::BIGINT AS fn FROM sc, {_levels_sql(GATES)} GROUP BY threshold)")
def b_csv(spark, sf_dir):
    report, path = k_pair_metrics(spark, sf_dir), new_path(spark, "report")
    tables.write_csv(report, path)
    return spark.read.option("header", True).schema(report.schema).csv(path)


# Evaluation (K)


@query("""WITH ks AS (SELECT unnest([10, 20, 30])::INTEGER AS k), cut AS MATERIALIZED (SELECT * FROM blocked, ks WHERE rank <= k), c AS (SELECT source1_entity_id, k, count(b.candidate_entity_id) AS n FROM (SELECT * FROM spine, ks) LEFT JOIN cut b USING (source1_entity_id, k) GROUP BY ALL)
SELECT k, t.true_pairs, t.found, mean_candidates, median_candidates, p90_candidates, p95_candidates, p99_candidates, max_candidates, percent_without, true_pairs - found AS missed, round(found / true_pairs::DOUBLE, 6) AS recall, round(100 * (1 - mean_raw / (SELECT count(*) FROM tg)), 6) AS reduction
FROM (SELECT k, avg(n) AS mean_raw, round(avg(n), 6) AS mean_candidates, quantile_cont(n, 0.5)::DOUBLE AS median_candidates, round(quantile_cont(n, 0.9), 6)::DOUBLE AS p90_candidates, round(quantile_cont(n, 0.95), 6)::DOUBLE AS p95_candidates, round(quantile_cont(n, 0.99), 6)::DOUBLE AS p99_candidates, max(n) AS max_candidates, round(100 * avg((n = 0)::INTEGER), 6) AS percent_without FROM c GROUP BY k)
JOIN (SELECT k, count(*) AS true_pairs, count(cut.rank) AS found FROM (SELECT * FROM gt, ks) LEFT JOIN cut USING (source1_entity_id, candidate_entity_id, k) GROUP BY k) t USING (k)""")
def k_blocking_recall(spark, sf_dir):
    return _rounded(metrics.blocking_recall(fx.spine(spark, sf_dir), fx.truth(spark, sf_dir), fx.blocked(spark, sf_dir), [10, 20, 30], fx.targets(spark, sf_dir).count()))


@query("""WITH sy AS (SELECT 'token' AS system, source1_entity_id, candidate_entity_id FROM by_token UNION ALL SELECT 'ngram', source1_entity_id, candidate_entity_id FROM by_ngram UNION ALL SELECT 'all', source1_entity_id, candidate_entity_id FROM blocked)
SELECT system, count(*) AS pairs, count(gt.candidate_entity_id) AS found, round(count(gt.candidate_entity_id) / (SELECT count(*) FROM gt)::DOUBLE, 6) AS recall,
  round(count(m.source1_entity_id) / (SELECT count(DISTINCT source1_entity_id) FROM gt)::DOUBLE, 6) AS mean_candidates,
  round(100 * (1 - count(m.source1_entity_id) / (SELECT count(DISTINCT source1_entity_id) FROM gt)::DOUBLE / (SELECT count(*) FROM tg)), 6) AS reduction
FROM sy LEFT JOIN gt ON gt.source1_entity_id = sy.source1_entity_id AND gt.candidate_entity_id = sy.candidate_entity_id LEFT JOIN (SELECT DISTINCT source1_entity_id FROM gt) m ON m.source1_entity_id = sy.source1_entity_id GROUP BY system""")
def k_system_comparison(spark, sf_dir):
    return _rounded(metrics.system_comparison(fx.truth(spark, sf_dir), fx.systems(spark, sf_dir, *fx.SYSTEMS).select("system", *PAIR), fx.targets(spark, sf_dir).count()))


_STRATA = "SELECT entity_id AS source1_entity_id, unnest(list_filter([concat('country ', country_normalized), CASE WHEN strlen(business_name) <> length(business_name) THEN 'non-ascii' ELSE 'ascii' END, CASE WHEN business_address IS NULL THEN 'no address' END], lambda x: x IS NOT NULL)) AS stratum FROM s1"


@query(f"WITH ss AS ({_STRATA}) SELECT stratum, count(*) AS true_pairs, count(b.rank) AS found, round(count(b.rank) / count(*)::DOUBLE, 6) AS recall FROM gt JOIN ss USING (source1_entity_id) LEFT JOIN blocked b ON b.source1_entity_id = gt.source1_entity_id AND b.candidate_entity_id = gt.candidate_entity_id GROUP BY stratum")
def k_stratified_recall(spark, sf_dir):
    s = fx.sources(spark, sf_dir)
    strata = F.array_compact(F.array(F.concat(F.lit("country "), "country_normalized"), F.when(F.col("name_has_non_ascii"), "non-ascii").otherwise("ascii"), F.when(F.col("business_address").isNull(), "no address")))
    return _rounded(metrics.recall_by(fx.truth(spark, sf_dir), fx.blocked(spark, sf_dir), s.select(F.col("entity_id").alias("source1_entity_id"), F.explode(strata).alias("stratum"))))


@query("SELECT source1_entity_id, candidate_entity_id, tg.business_name, tg.country FROM gt ANTI JOIN by_token USING (source1_entity_id, candidate_entity_id) JOIN tg ON tg.entity_id = candidate_entity_id")
def k_missed(spark, sf_dir):
    t = fx.targets(spark, sf_dir).select(F.col("entity_id").alias("candidate_entity_id"), "business_name", "country")
    return fx.truth(spark, sf_dir).join(fx.blocked(spark, sf_dir, ("token",)), PAIR, "left_anti").join(t, "candidate_entity_id").select(*PAIR, "business_name", "country")


_COUNTS = "count_if(probability >= threshold AND label = 1)::BIGINT AS tp, count_if(probability >= threshold AND label = 0)::BIGINT AS fp, count_if(probability < threshold AND label = 1)::BIGINT AS fn"


@query(f"SELECT *, {_PRF} FROM (SELECT threshold, {_COUNTS} FROM sc, {_levels_sql(GATES)} GROUP BY threshold)")
def k_pair_metrics(spark, sf_dir):
    return _rounded(metrics.pair_counts(fx.scored(spark, sf_dir), metrics.thresholds(spark, GATES)))


@query(f"SELECT *, {_PRF} FROM (SELECT candidate_source, threshold, {_COUNTS} FROM sc, {_levels_sql([0.5])} GROUP BY ALL)")
def k_by_source(spark, sf_dir):
    return _rounded(metrics.pair_counts(fx.scored(spark, sf_dir), metrics.thresholds(spark, [0.5]), ["candidate_source"]))


@query(f"SELECT threshold, round(avg({_F05}), 6) AS macro_f05 FROM (SELECT threshold, source1_entity_id, sum(label) AS t, count_if(probability >= threshold) AS s, count_if(probability >= threshold AND label = 1) AS h FROM sc, {_levels_sql(GATES)} GROUP BY ALL) GROUP BY threshold")
def k_macro_f05(spark, sf_dir):
    return _rounded(metrics.macro_f05(fx.scored(spark, sf_dir), metrics.thresholds(spark, GATES)))


def _set_macro_sql(variants: str) -> str:
    return f"""SELECT variant, count(*) AS sources, round(avg(f), 6) AS macro_f05, round(coalesce(avg(f) FILTER (t > 0), 0), 6) AS macro_f05_with_truth, count_if(t > 0 AND s = 0)::BIGINT AS emptied, round(coalesce(count_if(t > 0 AND s = 0) / nullif(count_if(t > 0), 0)::DOUBLE, 0), 6) AS emptied_rate FROM (SELECT variant, t, s, {_F05} AS f FROM (
  SELECT variant, source1_entity_id, (SELECT count(*) FROM gt WHERE gt.source1_entity_id = x.source1_entity_id) AS t, count(v.candidate_entity_id) AS s, count(gt.candidate_entity_id) AS h
  FROM (SELECT * FROM spine, (SELECT DISTINCT variant FROM ({variants}))) x LEFT JOIN ({variants}) v USING (variant, source1_entity_id) LEFT JOIN gt USING (source1_entity_id, candidate_entity_id) GROUP BY ALL)) GROUP BY variant"""


_OPEN = "source1_entity_id NOT IN (SELECT source1_entity_id FROM st WHERE singleton_prob >= 0.5)"
_VARIANTS = " UNION ALL ".join(f"SELECT '{n}' AS variant, source1_entity_id, candidate_entity_id FROM own WHERE {w}" for n, w in (("A base", "probability >= 0.5"), ("B gate", f"probability >= 0.5 AND {_OPEN}"), ("C unique", "probability >= 0.5 AND uniqueness_decision"), ("D both", f"probability >= 0.5 AND uniqueness_decision AND {_OPEN}"), ("E tuned", f"probability >= 0.86 AND uniqueness_decision AND {_OPEN}")))


@query(_set_macro_sql(_VARIANTS))
def k_variants(spark, sf_dir):
    s, g = fx.scored(spark, sf_dir), fx.gate(spark, sf_dir)
    made = {"A base": resolve.matches(s, None, 0.5, unique=False), "B gate": resolve.matches(s, g, 0.5, unique=False), "C unique": resolve.matches(s, None, 0.5), "D both": resolve.matches(s, g, 0.5), "E tuned": resolve.matches(s, g)}
    total = None
    for n, df in made.items():
        part = df.select(F.lit(n).alias("variant"), *PAIR)
        total = part if total is None else total.union(part)
    return _rounded(metrics.set_macro_f05(fx.spine(spark, sf_dir), fx.truth(spark, sf_dir), total, ["variant"]))


@query(f"SELECT threshold, count_if(true_empty)::BIGINT AS singletons, count_if(true_empty AND m >= threshold)::BIGINT AS wrong, round(count_if(true_empty AND m >= threshold) / nullif(count_if(true_empty), 0)::DOUBLE, 6) AS rate FROM (SELECT source1_entity_id, max(label) = 0 AS true_empty, max(probability) AS m FROM sc GROUP BY 1), {_levels_sql(GATES)} GROUP BY threshold")
def k_singleton_false_matches(spark, sf_dir):
    per = fx.scored(spark, sf_dir).groupBy("source1_entity_id").agg((F.max("label") == 0).alias("e"), F.max("probability").alias("m"))
    out = per.crossJoin(metrics.thresholds(spark, GATES)).groupBy("threshold").agg(F.count_if("e").alias("singletons"), F.count_if(F.col("e") & (F.col("m") >= F.col("threshold"))).alias("wrong"))
    return _rounded(out.withColumn("rate", F.try_divide("wrong", "singletons")))


@query("SELECT candidate_source, label, count(*) AS pairs, round(avg(probability), 6) AS mean_probability, round(median(probability), 6) AS median_probability FROM sc GROUP BY ALL")
def k_class_balance(spark, sf_dir):
    return _rounded(fx.scored(spark, sf_dir).groupBy("candidate_source", "label").agg(F.count(F.lit(1)).alias("pairs"), F.avg("probability").alias("mean_probability"), F.median("probability").alias("median_probability")))


@query("(SELECT 'fp' AS kind, source1_entity_id, candidate_entity_id, probability FROM sc WHERE label = 0 AND probability >= 0.8 ORDER BY probability DESC, 2, 3 LIMIT 20) UNION ALL (SELECT 'fn', source1_entity_id, candidate_entity_id, probability FROM sc WHERE label = 1 AND probability <= 0.2 ORDER BY probability, 2, 3 LIMIT 20)")
def k_severe_errors(spark, sf_dir):
    s = fx.scored(spark, sf_dir)
    fp = s.where("label = 0 and probability >= 0.8").orderBy(F.desc("probability"), *PAIR).limit(20)
    fn = s.where("label = 1 and probability <= 0.2").orderBy("probability", *PAIR).limit(20)
    return fp.select(F.lit("fp").alias("kind"), *PAIR, "probability").union(fn.select(F.lit("fn"), *PAIR, "probability"))


@query(f"SELECT threshold, count_if(probability >= threshold)::BIGINT AS negatives, round(100e0 * avg((probability >= threshold)::INTEGER), 6) AS percent FROM sc, {_levels_sql(GATES)} WHERE label = 0 GROUP BY threshold")
def k_threshold_ladder(spark, sf_dir):
    hit = F.col("probability") >= F.col("threshold")
    return _rounded(fx.scored(spark, sf_dir).where("label = 0").crossJoin(metrics.thresholds(spark, GATES)).groupBy("threshold").agg(F.count_if(hit).alias("negatives"), (100 * F.avg(hit.cast("int"))).alias("percent")))


#: A second fixed scorer, which leans on names; it stands for the second model where trees have no SQL.
_SECOND = {**model.WEIGHTS, "name_char_4gram_jaccard": 9.0, "address_char_4gram_jaccard": 2.0}
_SECOND_BIAS = -7.0
_SC2 = f"SELECT source1_entity_id, candidate_entity_id, label, round(1 / (1 + exp(-({_SECOND_BIAS}e0 + " + " + ".join(f"{w} * {c}" for c, w in _SECOND.items()) + "))), 6) AS probability FROM feat"


def _second(spark, sf_dir):
    return model.fixed_score(fx.features(spark, sf_dir), _SECOND, _SECOND_BIAS).select(*PAIR, "label", "probability")


@query(f"""WITH mm AS MATERIALIZED (SELECT 'first' AS model, source1_entity_id, label, probability FROM sc UNION ALL SELECT 'second', source1_entity_id, label, probability FROM ({_SC2}))
SELECT *, {_PRF} FROM (SELECT model, threshold, sum(h)::BIGINT AS tp, (sum(s) - sum(h))::BIGINT AS fp, (sum(t) - sum(h))::BIGINT AS fn, round(avg({_F05}), 6) AS macro_f05 FROM (
  SELECT model, threshold, source1_entity_id, sum(label) AS t, count_if(probability >= threshold) AS s, count_if(probability >= threshold AND label = 1) AS h FROM mm, {_levels_sql(GATES[:5])} GROUP BY ALL) GROUP BY model, threshold)""")
def k_model_ladder(spark, sf_dir):
    both = fx.scored(spark, sf_dir).select(F.lit("first").alias("model"), *PAIR, "label", "probability").union(_second(spark, sf_dir).select(F.lit("second"), *PAIR, "label", "probability"))
    return _rounded(metrics.model_ladder(both, metrics.thresholds(spark, GATES[:5])))


@query(f"""SELECT CASE WHEN before >= 0.3 AND label = 0 THEN 'fixed_fp' WHEN before < 0.3 AND label = 1 THEN 'fixed_fn' WHEN after >= 0.3 AND label = 0 THEN 'new_fp' ELSE 'new_fn' END AS kind, source1_entity_id, candidate_entity_id, before, after
FROM (SELECT a.source1_entity_id, a.candidate_entity_id, a.label, a.probability AS before, b.probability AS after FROM sc a JOIN ({_SC2}) b USING (source1_entity_id, candidate_entity_id)) WHERE (before >= 0.3) <> (after >= 0.3)""")
def k_changed_errors(spark, sf_dir):
    return metrics.changed_errors(fx.scored(spark, sf_dir), _second(spark, sf_dir), 0.3)


@query(f"""WITH pe AS MATERIALIZED (SELECT source1_entity_id, sum(label) AS t, count_if(probability >= 0.5) AS s, count_if(probability >= 0.5 AND label = 1) AS h FROM sc GROUP BY 1),
g AS (SELECT threshold, count_if(singleton_prob >= threshold)::BIGINT AS gated, count_if(singleton_prob >= threshold AND is_singleton = 1)::BIGINT AS "right", count_if(singleton_prob >= threshold AND is_singleton = 0)::BIGINT AS wrong FROM st, {_levels_sql(GATES)} GROUP BY threshold),
b AS (SELECT threshold, round(avg({_F05}), 6) AS base_macro_f05 FROM pe, {_levels_sql(GATES)} GROUP BY threshold),
c AS (SELECT threshold, round(avg({_F05}), 6) AS gated_macro_f05 FROM (SELECT threshold, t, CASE WHEN singleton_prob >= threshold THEN 0 ELSE s END AS s, CASE WHEN singleton_prob >= threshold THEN 0 ELSE h END AS h FROM pe JOIN st USING (source1_entity_id), {_levels_sql(GATES)}) GROUP BY threshold)
SELECT * FROM g JOIN b USING (threshold) JOIN c USING (threshold)""")
def k_gate_sweep(spark, sf_dir):
    return _rounded(metrics.gate_sweep(fx.gate(spark, sf_dir), metrics.thresholds(spark, GATES), fx.scored(spark, sf_dir)))


@query(f"""SELECT *, threshold = first_value(threshold) OVER (ORDER BY macro_f05 DESC, threshold) AS is_best FROM (SELECT *, {_PRF} FROM (SELECT threshold, sum(h)::BIGINT AS tp, (sum(s) - sum(h))::BIGINT AS fp, (sum(t) - sum(h))::BIGINT AS fn, sum(removed)::BIGINT AS removed, round(avg({_F05}), 6) AS macro_f05 FROM (
  SELECT threshold, source1_entity_id, sum(label) AS t, count_if(probability >= threshold AND uniqueness_decision) AS s, count_if(probability >= threshold AND uniqueness_decision AND label = 1) AS h, count_if(probability >= threshold AND NOT uniqueness_decision) AS removed
  FROM own, {_levels_sql(GRID)} GROUP BY ALL) GROUP BY threshold) JOIN (SELECT threshold, count_if(n > 1)::BIGINT AS conflicts FROM (SELECT threshold, count_if(probability >= threshold) AS n FROM sc, {_levels_sql(GRID)} GROUP BY threshold, candidate_entity_id) GROUP BY threshold) USING (threshold)) ORDER BY threshold""")
def k_match_sweep(spark, sf_dir):
    return _rounded(metrics.match_sweep(fx.scored(spark, sf_dir), metrics.thresholds(spark, GRID)))


@query("SELECT count(*) AS claims, count(DISTINCT candidate_entity_id) AS candidates, count_if(NOT uniqueness_decision)::BIGINT AS removed, count_if(NOT uniqueness_decision AND label = 1)::BIGINT AS removed_true FROM own WHERE probability >= 0.3")
def k_uniqueness_effect(spark, sf_dir):
    o = resolve.best_owner(fx.scored(spark, sf_dir)).where("probability >= 0.3")
    no = ~F.col("uniqueness_decision")
    return o.agg(F.count(F.lit(1)).alias("claims"), F.countDistinct("candidate_entity_id").alias("candidates"), F.count_if(no).alias("removed"), F.count_if(no & (F.col("label") == 1)).alias("removed_true"))


@query("SELECT count(*) AS pairs, count(DISTINCT candidate_entity_id) AS candidates, (SELECT count(*) FROM (SELECT candidate_entity_id FROM gt GROUP BY 1 HAVING count(DISTINCT source1_entity_id) > 1)) AS shared FROM gt")
def k_truth_uniqueness(spark, sf_dir):
    return profile.shared_candidates(fx.truth(spark, sf_dir))


@query("SELECT 'rows' AS what, source, count(*) AS n FROM rec GROUP BY source UNION ALL SELECT 'ids', source, count(DISTINCT entity_id) FROM rec GROUP BY source")
def k_overview(spark, sf_dir):
    one = fx.records(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("entity_id").alias("ids"))
    return one.select("source", F.expr("stack(2, 'rows', rows, 'ids', ids) AS (what, n)")).select("what", "source", "n")


_FIELDS = ("entity_id", "business_name", "business_address", "country")


@query(" UNION ALL ".join(f"SELECT '{c}' AS field, count(*) AS rows, count_if({c} IS NULL)::BIGINT AS nulls, count_if(trim({c}) = '')::BIGINT AS empties, round(100e0 * count_if({c} IS NULL) / count(*), 6) AS percent FROM rec" for c in _FIELDS))
def k_missing(spark, sf_dir):
    return _rounded(profile.missing(fx.records(spark, sf_dir), list(_FIELDS)))


@query("SELECT coalesce(country, '') AS country, count(*) FILTER (source = 'S1') AS \"S1\", count(*) FILTER (source = 'S2') AS \"S2\", count(*) FILTER (source = 'S3') AS \"S3\" FROM rec GROUP BY 1")
def k_country_pivot(spark, sf_dir):
    return profile.country_by_source(fx.records(spark, sf_dir), ["S1", "S2", "S3"])


@query("SELECT source, round(avg(length(business_name)), 6) AS mean_length, round(avg(len(string_split_regex(trim(business_name), '\\s+'))), 6) AS mean_words, count(DISTINCT business_name) AS distinct_names, count_if(strlen(business_name) <> length(business_name))::BIGINT AS non_ascii, 0::BIGINT AS devanagari FROM rec GROUP BY source")
def k_name_profile(spark, sf_dir):
    return _rounded(profile.names(fx.records(spark, sf_dir)))


@query("SELECT source, place::INTEGER AS place, business_name, rows FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY rows DESC, business_name) AS place FROM (SELECT source, business_name, count(*) AS rows FROM rec WHERE business_name IS NOT NULL GROUP BY source, business_name)) WHERE place <= 3")
def k_top_names(spark, sf_dir):
    return profile.top_names(fx.records(spark, sf_dir))


@query("SELECT country, count(*) AS n FROM rec GROUP BY country ORDER BY n DESC, country NULLS FIRST LIMIT 3")
def k_top_countries(spark, sf_dir):
    return profile.top_values(fx.records(spark, sf_dir), "country")


@query("SELECT source, round(avg(length(business_address)), 6) AS mean_length, round(100 * avg(coalesce(regexp_matches(business_address, '\\d'), false)::INTEGER), 6) AS percent_digit, round(100 * avg(coalesce(regexp_matches(business_address, '(?i)\\bnear\\b'), false)::INTEGER), 6) AS percent_near FROM rec GROUP BY source")
def k_address_profile(spark, sf_dir):
    return _rounded(profile.addresses(fx.records(spark, sf_dir)))


@query("SELECT matches, count(*) AS sources FROM (SELECT source1_entity_id, count(gt.candidate_entity_id) AS matches FROM spine LEFT JOIN gt USING (source1_entity_id) GROUP BY 1) GROUP BY matches")
def k_truth_sizes(spark, sf_dir):
    return profile.truth_sizes(fx.spine(spark, sf_dir), fx.truth(spark, sf_dir))


@query("SELECT count(*) AS sources, count_if(n = 0)::BIGINT AS singletons, round(100 * avg((n = 0)::INTEGER), 6) AS percent_singletons, round(avg(n), 6) AS mean_matches, quantile_cont(n, 0.5)::DOUBLE AS median_matches, max(n) AS most_matches FROM (SELECT source1_entity_id, count(gt.candidate_entity_id) AS n FROM spine LEFT JOIN gt USING (source1_entity_id) GROUP BY 1)")
def k_truth_summary(spark, sf_dir):
    return _rounded(profile.truth_summary(fx.spine(spark, sf_dir), fx.truth(spark, sf_dir)))


@query("SELECT count(DISTINCT business_name) AS raw_values, count(DISTINCT name_n) AS normal_forms, round(100e0 * (count(DISTINCT business_name) - count(DISTINCT name_n)) / count(DISTINCT business_name), 6) AS percent_merged, (SELECT count(*) FROM (SELECT name_n FROM norm WHERE business_name IS NOT NULL GROUP BY 1 HAVING count(DISTINCT business_name) > 1)) AS groups FROM norm WHERE business_name IS NOT NULL")
def k_collision_summary(spark, sf_dir):
    return _rounded(profile.collision_summary(fx.records(spark, sf_dir), "business_name", "business_name_normalized"))


@query("SELECT name_n AS normal, count(DISTINCT business_name) AS raws FROM norm GROUP BY 1 HAVING count(DISTINCT business_name) > 1")
def k_collisions(spark, sf_dir):
    return profile.collisions(fx.records(spark, sf_dir), "business_name", "business_name_normalized")


_STAT = ("name_char_4gram_jaccard", "name_token_jaccard", "name_length_ratio", "address_char_4gram_jaccard", "postal_match", "country_match")


@query(" UNION ALL ".join(f"SELECT '{c}' AS feature, 100e0 * avg(({c} IS NULL)::INTEGER) AS missing, round(min({c})::DOUBLE, 6) AS lowest, round(max({c})::DOUBLE, 6) AS highest, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS deviation FROM feat" for c in _STAT))
def k_feature_statistics(spark, sf_dir):
    return _rounded(profile.feature_statistics(fx.features(spark, sf_dir), list(_STAT)))


@query("SELECT a, b, round(r, 6) AS r FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM feat" for i, a in enumerate(_STAT) for b in _STAT[i + 1 :]) + ") WHERE abs(r) > 0.3")
def k_correlated(spark, sf_dir):
    return _rounded(profile.correlated(fx.features(spark, sf_dir), list(_STAT), 0.3))


@query("SELECT entity_id FROM rec ORDER BY md5(entity_id), entity_id LIMIT 100")
def k_sample(spark, sf_dir):
    return fx.records(spark, sf_dir).select("entity_id").orderBy(F.md5("entity_id"), "entity_id").limit(100)


@query("SELECT count(*) AS rows, count(DISTINCT source1_entity_id) AS ids, (SELECT count(*) FROM spine) AS required FROM spine")
def k_integrity(spark, sf_dir):
    r = b_matching_results(spark, sf_dir)
    return r.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("source1_entity_id").alias("ids")).crossJoin(F.broadcast(fx.spine(spark, sf_dir).agg(F.count(F.lit(1)).alias("required"))))


# Validation (L)

_LINES = ["S1-1\tS2-1,S3-2", "S1-2\t", "S1-2\tS2-9", "no tab here", "   ", "S1-3\tS2-5,S2-5", "S1-4\tS1-7,X-1", "S1-5\tS2-1, S2-2"]


@query("SELECT * FROM (VALUES ('no_tab', 1::BIGINT, 'no tab here'), ('duplicate_row', 1, 'S1-2'), ('duplicate_id', 1, 'S1-3'), ('self_match', 1, 'S1-7'), ('bad_prefix', 2, ' S2-2,X-1'), ('missing_source', 1, 'S1-6'), ('extra_source', 1, 'S1-5'), ('unknown_id', 1, 'S2-9')) AS v(rule, total, examples)")
def l_problems(spark, sf_dir):
    rows = validate.parse(spark.createDataFrame([(x,) for x in _LINES], "value string"))
    required = spark.createDataFrame([(f"S1-{i}",) for i in (1, 2, 3, 4, 6)], "entity_id string")
    valid = spark.createDataFrame([(x,) for x in ("S2-1", "S3-2", "S2-5")], "entity_id string")
    return validate.report(validate.problems(rows, required, valid))


_HEADER = "source1_entity_id\tmatched_entity_ids"


@query("SELECT * FROM (VALUES ('absent', 1, 'file', 1::BIGINT, 'FILE does not exist'), ('empty', 1, 'file', 1, 'the file is empty'), ('commas', 1, 'file', 1, 'the header is separated by commas'), ('other', 1, 'file', 1, 'the header is not source1_entity_id, matched_entity_ids'), ('bytes', 1, 'not_utf8', 1, 'S1-1' || chr(9) || 'S2-' || chr(65533)), ('whole', 0, NULL, NULL, NULL)) AS v(file, code, rule, total, examples)")
def l_files(spark, sf_dir):
    """Exit code and report of six files: one that is absent, four that are wrong, and the result of the whole run."""
    made, base = [], new_path(spark, "files")
    results = b_matching_results(spark, sf_dir)
    files = {"absent": None, "empty": [], "commas": ["source1_entity_id,matched_entity_ids"], "other": ["id\tids"], "bytes": [_HEADER, b"S1-1\tS2-\xff"]}
    for name, lines in files.items():
        path = f"{base}/{name}"
        if lines is not None:
            rows = [(x.encode() if isinstance(x, str) else x,) for x in lines]
            spark.createDataFrame(rows, "value binary").coalesce(1).select(F.expr("cast(value AS string)").alias("value")).write.text(path)
        code, report = validate.check_file(spark, path, _HEADER)
        made.append(report.select(F.lit(name).alias("file"), F.lit(code).alias("code"), "rule", "total", F.replace("examples", F.lit(path), F.lit("FILE")).alias("examples")))
    tables.write_tsv(results, f"{base}/whole")
    code, report = validate.check_file(spark, f"{base}/whole", _HEADER, fx.sources(spark, sf_dir), fx.targets(spark, sf_dir))
    made.append(spark.createDataFrame([("whole", code)], "file string, code int").crossJoin(spark.range(1).select()).join(report.select(F.lit("whole").alias("file"), "rule", "total", "examples"), "file", "left"))
    out = made[0]
    for part in made[1:]:
        out = out.unionByName(part)
    return out


@query("""WITH bad AS (SELECT source1_entity_id, row_number() OVER (ORDER BY source1_entity_id) AS n FROM spine)
SELECT 'bad_prefix' AS rule, count(*) AS total, string_agg(DISTINCT 'X-1') AS examples FROM bad WHERE n % 5 = 0 UNION ALL SELECT 'no_tab', count(*), (SELECT string_agg(source1_entity_id, ',' ORDER BY source1_entity_id) FROM (SELECT source1_entity_id FROM bad WHERE n % 5 = 1 ORDER BY 1 LIMIT 5)) FROM bad WHERE n % 5 = 1
UNION ALL SELECT 'missing_source', count(*), (SELECT string_agg(source1_entity_id, ',' ORDER BY source1_entity_id) FROM (SELECT source1_entity_id FROM bad WHERE n % 5 = 1 ORDER BY 1 LIMIT 5)) FROM bad WHERE n % 5 = 1
UNION ALL SELECT 'duplicate_row', count(*), (SELECT string_agg(source1_entity_id, ',' ORDER BY source1_entity_id) FROM (SELECT source1_entity_id FROM bad WHERE n % 5 = 2 ORDER BY 1 LIMIT 5)) FROM bad WHERE n % 5 = 2""")
def l_table_problems(spark, sf_dir):
    """A result table of all sources, of which every fifth line is broken in one of three ways."""
    n = F.row_number().over(Window.orderBy("source1_entity_id")) % 5
    line = F.when(F.col("n") == 0, F.concat("source1_entity_id", F.lit("\tX-1"))).when(F.col("n") == 1, F.col("source1_entity_id")).otherwise(F.concat("source1_entity_id", F.lit("\t")))
    lines = fx.spine(spark, sf_dir).withColumn("n", n).select("n", line.alias("value"))
    lines = lines.select("value").union(lines.where("n = 2").select("value"))
    return validate.report(validate.problems(validate.parse(lines), fx.sources(spark, sf_dir), fx.targets(spark, sf_dir)))


@query("SELECT source1_entity_id, candidate_entity_id AS id FROM fin ANTI JOIN by_token USING (source1_entity_id, candidate_entity_id)")
def l_not_candidates(spark, sf_dir):
    def lines(df: DataFrame, ids: str) -> DataFrame:
        return validate.parse(df.select(F.concat_ws("\t", "source1_entity_id", ids).alias("value")))

    token = tables.roll_up(fx.spine(spark, sf_dir), fx.blocked(spark, sf_dir, ("token",)), "ids")
    return validate.not_candidates(lines(b_matching_results(spark, sf_dir), "matched_entity_ids"), lines(token, "ids"))


@query()
def p_linkage_run(spark, sf_dir):
    from linkforge.plans.pipeline import run

    raw = ["entity_id", "business_name", "business_address", "country"]
    return run(fx.sources(spark, sf_dir).select(*raw), fx.targets(spark, sf_dir).select(*raw)).results
