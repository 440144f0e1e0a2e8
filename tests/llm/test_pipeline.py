import collections

import corpus_pipeline
from linkforge.llm import langid


def test_stages(spark, sf_dir, documents):
    from test_operators import brute_classes, brute_hits, brute_targets, words

    by = dict(corpus_pipeline.STAGES)
    known = by["language_id"](spark, documents, sf_dir)
    assert known.columns == documents.columns
    filters = langid.learn(documents)
    want = {r.doc_id for r in langid.identify(documents, filters).where("lang_pred <> 'und' and score >= 0.2").collect()}
    assert {r.doc_id for r in known.collect()} == want

    first = by["near_dedup"](spark, documents, sf_dir)
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert {r.doc_id for r in first.collect()} == {i for i, c in brute_classes(rows).items() if i == c}

    clean = by["decontaminate"](spark, documents.limit(60), sf_dir)
    some = [(r.doc_id, r.text) for r in documents.limit(60).collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").limit(40).collect()]
    short = [(i, t) for i, t in some if len(words(t)) < 300]
    dirty = {d for d, _ in brute_hits(short, items)}
    assert {r.doc_id for r in clean.collect()} & {i for i, _ in short} == {i for i, _ in short} - dirty

    mixed = by["mix"](spark, documents, sf_dir).collect()
    size, got = collections.Counter(), collections.Counter()
    for r in documents.collect():
        size[r.source] += len(words(r.text))
    for r in mixed:
        got[r.source] += len(words(r.text))
    target = brute_targets(dict(size))
    assert all(abs(target[s] - got[s]) < 1.001 for s in size)


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert {"doc_id", "text", "shard", "depth", "n_bytes"} <= set(out.columns) and out.count() > 0


def test_run_of_awkward_rows(spark, tmp_path, documents, awkward, sf_dir):
    """Nulls, empty and long texts, repeated rows, a null id and columns with names the stages use, beside documents to learn from."""
    from pyspark.sql import functions as F

    more = documents.select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars"), F.lit(1).alias("shard"), F.lit("x").alias("size"), F.lit(2).alias("place"), F.lit("y").alias("bands"), F.lit("no").alias("done"), F.lit("p").alias("prefix"))
    awkward.withColumn("doc_id", F.col("doc_id") + 10**6).unionByName(more).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in rows}
    far = {i for i in ids if i is None or i > 500_000}
    # Texts without a letter go, of equal texts the smallest id stays; the long text is no language that is known here.
    assert not far & {10**6 + i for i in (1, 2, 3, 6, 12)} and all(r.text for r in rows)
    assert {(r["size"], r.place, r.bands, r.done, r.prefix) for r in rows} == {("x", 2, "y", "no", "p")} and all(isinstance(r.shard, str) for r in rows)


def test_run_of_nothing(spark, tmp_path, documents, sf_dir):
    documents.where("false").write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
