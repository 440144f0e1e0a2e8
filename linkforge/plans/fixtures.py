"""Record views over the documents table, and the tables that most queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkforge.functions.similarity import feature_names, pair_features
from linkforge.functions.text import preprocess, source_tag
from linkforge.operators import candidates, model, sparse

_kept: dict[tuple, DataFrame] = {}
#: Paths of the sparse lists that are compared.
SYSTEMS = {"token": ("token",), "ngram": ("ngram",), "all": sparse.PATHS}


def kept(spark: SparkSession, sf_dir: str, name: str, make) -> DataFrame:
    """make(), cached for the session: many queries start from the same pairs."""
    return _once(spark, sf_dir, name, lambda: make().persist())


def _once(spark: SparkSession, sf_dir: str, name: str, make) -> DataFrame:
    key = (id(spark._jsparkSession), spark.sparkContext.applicationId, sf_dir, name)
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preprocessed records made of documents, with text_md5 and source."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n = F.col("n_chars")
    postal = F.when(F.col("lang") == "es", (100000 + n % 900000).cast("string")).when(F.col("lang") == "de", F.concat((10000 + n % 90000).cast("string"), F.lit("-"), (1000 + n % 9000).cast("string"))).otherwise((10000 + n % 90000).cast("string"))
    rec = d.select(
        F.concat(F.lit("S"), (F.col("doc_id") % 3 + 1).cast("string"), F.lit("-"), F.col("doc_id").cast("string")).alias("entity_id"),
        F.substring("text", 1, 40).alias("business_name"),
        F.when(F.col("doc_id") % 31 != 0, F.concat((n % 500).cast("string"), F.lit(" "), F.col("source"), F.lit(" Rd, "), postal)).alias("business_address"),
        F.when(F.col("doc_id") % 53 != 0, F.col("lang")).alias("country"),
        F.md5("text").alias("text_md5"),
        "doc_id",
    )
    return preprocess(rec).withColumn("source", source_tag(F.col("entity_id")))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1 records, one per text."""
    s1 = records(spark, sf_dir).where("source = 'S1'")
    first = s1.groupBy("text_md5").agg(F.min("doc_id").alias("doc_id"))
    return s1.join(first, ["text_md5", "doc_id"], "left_semi")


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).where("source <> 'S1'")


def spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(spark, sf_dir, "spine", lambda: sources(spark, sf_dir).select(F.col("entity_id").alias("source1_entity_id")))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make():
        t = targets(spark, sf_dir).select(F.col("entity_id").alias("candidate_entity_id"), "text_md5")
        return sources(spark, sf_dir).select(F.col("entity_id").alias("source1_entity_id"), "text_md5").join(t, "text_md5").select(*candidates.PAIR)
    return kept(spark, sf_dir, "truth", make)


def blocked(spark: SparkSession, sf_dir: str, paths=sparse.PATHS) -> DataFrame:
    return kept(spark, sf_dir, f"blocked {'+'.join(paths)}", lambda: sparse.block(sources(spark, sf_dir), targets(spark, sf_dir), 30, paths))


def systems(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """system and the pairs blocked by each of the named systems, found in one pass."""
    return kept(spark, sf_dir, f"systems {'+'.join(names)}", lambda: sparse.block_each(sources(spark, sf_dir), targets(spark, sf_dir), {n: SYSTEMS[n] for n in names}, 30))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocked pairs with candidate_source and label; no other column of the records."""
    pairs = candidates.with_labels(blocked(spark, sf_dir), truth(spark, sf_dir))
    return pairs.withColumn("candidate_source", source_tag(F.col("candidate_entity_id")))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled pairs with both records and 48 features. Not kept: rows are wide, and most queries use a few columns in one pass.

    Labels come first, while rows are narrow, so that no feature is shuffled.
    """
    pairs = candidates.with_labels(blocked(spark, sf_dir), truth(spark, sf_dir))
    return pair_features(candidates.pair_table(pairs, sources(spark, sf_dir), targets(spark, sf_dir)))


def model_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids and label of each pair and the features that a model may use, written to the shared folder once for the session.

    Training and scoring read them several times. Parquet holds the few values of a feature in a fraction of what cached rows take.
    """
    def make():
        rows = features(spark, sf_dir)
        return model.stored(rows.select(*candidates.PAIR, "label", *feature_names(rows)))
    return _once(spark, sf_dir, "model rows", make)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make():
        return model.fixed_score(features(spark, sf_dir)).select(*candidates.PAIR, "candidate_source", "label", "probability")
    return kept(spark, sf_dir, "scored", make)


def gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity statistics with singleton_prob = 1 - max_prob, a gate that needs no training."""
    from linkforge.operators.resolve import entity_statistics

    return entity_statistics(scored(spark, sf_dir)).withColumn("singleton_prob", F.round(1 - F.col("max_prob"), 6))


#: The same views as DuckDB CTEs, in dependency order.
CTES = {
    "rec": r"""
SELECT doc_id, concat('S', doc_id % 3 + 1, '-', doc_id) AS entity_id, substring(text, 1, 40) AS business_name,
  CASE WHEN doc_id % 31 <> 0 THEN concat(n_chars % 500, ' ', source, ' Rd, ', CASE lang WHEN 'es' THEN concat(100000 + n_chars % 900000)
    WHEN 'de' THEN concat(10000 + n_chars % 90000, '-', 1000 + n_chars % 9000) ELSE concat(10000 + n_chars % 90000) END) END AS business_address,
  CASE WHEN doc_id % 53 <> 0 THEN lang END AS country, md5(text) AS text_md5, concat('S', doc_id % 3 + 1) AS source
FROM documents""",
    "plain": r"""
SELECT *, lower(trim(coalesce(country, ''))) AS country_normalized,
  string_split(trim(regexp_replace(regexp_replace(replace(lower(coalesce(business_name, '')), '&', ' and '), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g')), ' ') AS nw,
  string_split(trim(regexp_replace(regexp_replace(lower(coalesce(business_address, '')), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g')), ' ') AS aw
FROM rec""",
    "norm": r"""
SELECT * EXCLUDE (nw, aw),
  regexp_replace(array_to_string(list_transform(nw, lambda w: CASE w WHEN 'pvt' THEN 'private' WHEN 'ltd' THEN 'limited' WHEN 'inc' THEN 'incorporated' WHEN 'corp' THEN 'corporation' WHEN 'co' THEN 'company' ELSE w END), ' '), '\bl l c\b', 'llc', 'g') AS name_n,
  array_to_string(list_transform(aw, lambda w: CASE w WHEN 'rd' THEN 'road' WHEN 'st' THEN 'street' WHEN 'ave' THEN 'avenue' WHEN 'blvd' THEN 'boulevard' WHEN 'dr' THEN 'drive' WHEN 'ln' THEN 'lane' ELSE w END), ' ') AS addr_n,
  coalesce(regexp_extract_all(business_address, '\b\d{6}\b')[-1], regexp_extract_all(business_address, '\b\d{5}-\d{4}\b')[-1], regexp_extract_all(business_address, '\b\d{5}\b')[-1]) AS postal
FROM plain""",
    "toked": r"""
SELECT *, replace(name_n, ' ', '') AS compact_n, list_filter(string_split(name_n, ' '), lambda t: t <> '') AS toks FROM norm""",
    "grammed": r"""
SELECT *, CASE WHEN compact_n = '' THEN [] ELSE list_distinct(list_transform(range(1, greatest(length(compact_n) - 3, 1) + 1), lambda i: substring(compact_n, i, 4))) END AS grams FROM toked""",
    "s1": "SELECT * FROM grammed WHERE source = 'S1' AND doc_id IN (SELECT min(doc_id) FROM rec WHERE source = 'S1' GROUP BY text_md5)",
    "tg": "SELECT * FROM grammed WHERE source <> 'S1'",
    "spine": "SELECT entity_id AS source1_entity_id FROM s1",
    "gt": "SELECT s1.entity_id AS source1_entity_id, tg.entity_id AS candidate_entity_id FROM s1 JOIN tg USING (text_md5)",
    "tk": """
SELECT entity_id, 'token' AS kind, unnest(list_distinct(toks)) AS key FROM tg UNION ALL SELECT entity_id, 'ngram', unnest(grams) FROM tg UNION ALL SELECT entity_id, 'postal', postal FROM tg WHERE postal IS NOT NULL""",
    "sk": """
SELECT entity_id, 'token' AS kind, unnest(list_distinct(toks)) AS key FROM s1 UNION ALL SELECT entity_id, 'ngram', unnest(grams) FROM s1 UNION ALL SELECT entity_id, 'postal', postal FROM s1 WHERE postal IS NOT NULL""",
    "kw": """
SELECT kind, key, df, CASE kind WHEN 'postal' THEN 10e0 WHEN 'ngram' THEN 0.3e0 * ln(n / (df + 1e0)) ELSE ln(n / (df + 1e0)) END AS weight
FROM (SELECT kind, key, count(*) AS df FROM tk GROUP BY kind, key), (SELECT count(*) AS n FROM tg) WHERE kind = 'postal' OR df <= greatest(2, n * 0.01)""",
    "hits": """
SELECT s.entity_id AS source1_entity_id, t.entity_id AS candidate_entity_id, kind, weight FROM sk s JOIN tk t USING (kind, key) JOIN kw USING (kind, key)""",
}


def _blocked_sql(kinds: tuple[str, ...], country: bool) -> str:
    listed = ", ".join(f"'{k}'" for k in kinds)
    known = "s.country_normalized IN (SELECT country_normalized FROM tg WHERE country_normalized <> '')" if country else "false"
    return f"""
SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY source1_entity_id ORDER BY score DESC, candidate_entity_id))::INTEGER AS rank FROM (
  SELECT h.source1_entity_id, h.candidate_entity_id,
    round(CASE WHEN {known} THEN h.raw * CASE WHEN s.country_normalized = t.country_normalized THEN 1.5e0 ELSE 0.2e0 END ELSE h.raw END, 6) AS score,
    array_to_string(list_sort(CASE WHEN {known} AND s.country_normalized = t.country_normalized THEN list_append(h.kinds, 'country') ELSE h.kinds END), ',') AS provenance
  FROM (SELECT source1_entity_id, candidate_entity_id, sum(weight) AS raw, list(DISTINCT kind) AS kinds FROM hits WHERE kind IN ({listed}) GROUP BY ALL) h
  JOIN s1 s ON s.entity_id = h.source1_entity_id JOIN tg t ON t.entity_id = h.candidate_entity_id)) WHERE rank <= 30"""


def _gram_sql(c: str) -> str:
    return f"CASE WHEN {c} = '' THEN [] ELSE list_distinct(list_transform(range(1, greatest(length({c}) - 3, 1) + 1), lambda i: substring({c}, i, 4))) END"


def _string_sql(a: str, b: str, p: str) -> str:
    ta, tb, ga, gb = f"{p}_ta", f"{p}_tb", f"{p}_ga", f"{p}_gb"
    some = f"({a} <> '' AND {b} <> '')"
    inter = lambda x, y: f"len(list_intersect({x}, {y}))"
    union = lambda x, y: f"len(list_distinct(list_concat({x}, {y})))"
    held = lambda num, den: f"CASE WHEN {some} THEN coalesce({num}::DOUBLE / nullif({den}, 0), 0) ELSE 0e0 END"
    compact = lambda x: f"regexp_replace({x}, '\\s+', '', 'g')"
    return f"""({a} = {b})::INTEGER AS {p}_exact_match, ({compact(a)} = {compact(b)} AND {compact(a)} <> '')::INTEGER AS {p}_compact_exact_match,
  coalesce(least(length({a}), length({b}))::DOUBLE / nullif(greatest(length({a}), length({b})), 0), 0) AS {p}_length_ratio, abs(length({a}) - length({b}))::DOUBLE AS {p}_length_difference,
  {held(inter(ta, tb), union(ta, tb))} AS {p}_token_jaccard, {held(inter(ta, tb), f"len({ta})")} AS {p}_token_overlap_s1, {held(inter(ta, tb), f"len({tb})")} AS {p}_token_overlap_candidate,
  {held(inter(ga, gb), union(ga, gb))} AS {p}_char_4gram_jaccard, {held(inter(ga, gb), f"least(len({ga}), len({gb}))")} AS {p}_char_4gram_overlap, {held(inter(ga, gb), union(ga, gb))} AS {p}_tfidf_cosine"""


def _tokens_sql(c: str) -> str:
    return f"list_distinct(list_filter(string_split_regex({c}, '\\s+'), lambda t: t <> ''))"


CTES |= {
    "blocked": _blocked_sql(("token", "ngram", "postal"), True),
    "by_token": _blocked_sql(("token",), False),
    "by_ngram": _blocked_sql(("ngram",), False),
    "prs": """
SELECT b.source1_entity_id, b.candidate_entity_id, split_part(b.candidate_entity_id, '-', 1) AS candidate_source,
  s.business_name AS s1_name, t.business_name AS cand_name, s.postal AS s1_postal, t.postal AS cand_postal, s.country AS s1_country, t.country AS cand_country, s.business_address AS s1_address, t.business_address AS cand_address,
  lower(trim(coalesce(s.business_name, ''))) AS na, lower(trim(coalesce(t.business_name, ''))) AS nb, lower(trim(coalesce(s.business_address, ''))) AS aa, lower(trim(coalesce(t.business_address, ''))) AS ab
FROM blocked b JOIN s1 s ON s.entity_id = b.source1_entity_id JOIN tg t ON t.entity_id = b.candidate_entity_id""",
    "prt": f"""
SELECT *, {_tokens_sql('na')} AS name_ta, {_tokens_sql('nb')} AS name_tb, {_gram_sql('na')} AS name_ga, {_gram_sql('nb')} AS name_gb,
  {_tokens_sql('aa')} AS address_ta, {_tokens_sql('ab')} AS address_tb, {_gram_sql('aa')} AS address_ga, {_gram_sql('ab')} AS address_gb FROM prs""",
    "feat": f"""
SELECT p.source1_entity_id, p.candidate_entity_id, p.candidate_source, na, nb, aa, ab, {_string_sql('na', 'nb', 'name')}, {_string_sql('aa', 'ab', 'address')},
  (coalesce(s1_postal, '') <> '' AND coalesce(cand_postal, '') <> '')::INTEGER AS postal_available_both, coalesce(s1_postal = cand_postal, false)::INTEGER AS postal_match,
  0 AS house_number_available_both, 0 AS house_number_match, 0 AS city_match, 0 AS locality_match, 0 AS state_match,
  (strlen(s1_name) <> length(s1_name))::INTEGER AS name_has_non_ascii_s1, (strlen(cand_name) <> length(cand_name))::INTEGER AS name_has_non_ascii_candidate,
  0 AS name_has_devanagari_s1, 0 AS name_has_devanagari_candidate, (strlen(s1_name) = length(s1_name) AND strlen(cand_name) = length(cand_name))::INTEGER AS both_name_same_script,
  0e0 AS dense_cosine_similarity, 0e0 AS dense_name_cosine, 0e0 AS dense_address_cosine,
  coalesce(upper(trim(s1_country)) = upper(trim(cand_country)) AND trim(s1_country) <> '', false)::INTEGER AS country_match,
  (candidate_source = 'S2')::INTEGER AS candidate_source_S2, (candidate_source = 'S3')::INTEGER AS candidate_source_S3,
  (trim(coalesce(s1_name, '')) = '')::INTEGER AS s1_name_missing, (trim(coalesce(s1_address, '')) = '')::INTEGER AS s1_address_missing, (trim(coalesce(s1_postal, '')) = '')::INTEGER AS s1_postal_missing,
  (trim(coalesce(cand_name, '')) = '')::INTEGER AS candidate_name_missing, (trim(coalesce(cand_address, '')) = '')::INTEGER AS candidate_address_missing, (trim(coalesce(cand_postal, '')) = '')::INTEGER AS candidate_postal_missing,
  (gt.candidate_entity_id IS NOT NULL)::INTEGER AS label
FROM prt p LEFT JOIN gt ON gt.source1_entity_id = p.source1_entity_id AND gt.candidate_entity_id = p.candidate_entity_id""",
    "sc": """
SELECT source1_entity_id, candidate_entity_id, candidate_source, label, round(1 / (1 + exp(-(-6e0 + 6 * name_char_4gram_jaccard + 2 * name_token_jaccard + name_length_ratio + 3 * address_char_4gram_jaccard + 1.5 * postal_match + 0.5 * country_match))), 6) AS probability
FROM feat""",
    "st": """
SELECT *, max_prob - coalesce(second, 0) AS top1_minus_top2, max_prob - mean_prob AS top1_minus_mean, round(1 - max_prob, 6) AS singleton_prob FROM (
  SELECT source1_entity_id, max(probability) AS max_prob, avg(probability) AS mean_prob, median(probability) AS median_prob, coalesce(stddev_samp(probability), 0) AS std_prob,
    count(*) AS candidate_count, count_if(probability >= 0.5) AS high_prob_count, max(CASE WHEN place = 2 THEN probability END) AS second, (max(label) = 0)::INTEGER AS is_singleton
  FROM (SELECT *, row_number() OVER (PARTITION BY source1_entity_id ORDER BY probability DESC, candidate_entity_id) AS place FROM sc) GROUP BY 1)""",
    "own": "SELECT *, row_number() OVER (PARTITION BY candidate_entity_id ORDER BY probability DESC, source1_entity_id) = 1 AS uniqueness_decision FROM sc",
    "fin": "SELECT * FROM own WHERE probability >= 0.86 AND uniqueness_decision AND source1_entity_id NOT IN (SELECT source1_entity_id FROM st WHERE singleton_prob >= 0.5)",
}


def sql(body: str) -> str:
    """body with the CTEs that it needs, in order."""
    import re

    need: set[str] = set()

    def visit(text: str) -> None:
        for name in CTES:
            if name not in need and re.search(rf"\b{name}\b", text):
                need.add(name)
                visit(CTES[name])

    visit(body)
    parts = [f"{name} AS MATERIALIZED ({CTES[name].strip()})" for name in CTES if name in need]
    body = body.strip()
    if body.startswith("WITH "):
        return "WITH " + ",\n".join([*parts, body[5:]])
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body
