"""The whole linkage run: from record tables to one result row per source record."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

from linkforge.functions.similarity import pair_features
from linkforge.functions.text import preprocess
from linkforge.operators import candidates, dense, model, resolve, sparse
from linkforge.sources import tables


@dataclass(frozen=True)
class Settings:
    """Candidates of each blocker and after pruning, thresholds, and whether lost candidates are dealt again."""

    sparse_k: int = 30
    dense_k: int = 30
    max_k: int = 40
    match: float = resolve.MATCH
    gate: float = resolve.GATE
    unique: bool = True
    reassign: bool = False


@dataclass
class Run:
    candidates: DataFrame
    scored: DataFrame
    final: DataFrame
    results: DataFrame
    candidate_lists: DataFrame
    summary: DataFrame
    #: Seconds that :func:`run` took: it writes the keys of the records and counts what sizes the parts.
    seconds: float = 0.0


def timed(made: Run, path: str) -> float:
    """Write results, candidate lists and summary under path; the seconds that :func:`run` and that took, which are the run's, as all else is lazy."""
    began = time.perf_counter()
    tables.write_tsv(made.results, f"{path}/matching_results.tsv")
    tables.write_tsv(made.candidate_lists, f"{path}/candidate_pairs.tsv")
    took = made.seconds + time.perf_counter() - began
    tables.write_json(made.summary.sparkSession, made.summary.first().asDict() | {"seconds": round(took, 3)}, f"{path}/summary")
    return took


def run(s1: DataFrame, others: DataFrame, settings: Settings = Settings(), matcher: PipelineModel | None = None, features: list[str] | None = None, gate: PipelineModel | None = None) -> Run:
    """Link raw records s1 to raw records others; without models the fixed scorer decides and no gate closes.

    Everything is lazy but the keys of the records and the counts that size the parts; ``seconds`` of :func:`timed` is a run's time.
    """
    began = time.perf_counter()
    sources, targets = preprocess(s1), preprocess(others)
    by_keys = sparse.block(sources, targets, settings.sparse_k)
    by_vectors = dense.nearest(dense.embed(sources), dense.embed(targets), settings.dense_k)
    union = candidates.prune(candidates.union(by_keys, by_vectors), settings.max_k)
    vectors = by_vectors.select(*candidates.PAIR, by_vectors["score"].alias("dense_cosine_similarity"))
    pairs = pair_features(candidates.pair_table(union, sources, targets).join(vectors, candidates.PAIR, "left"))
    scored = model.fixed_score(pairs) if matcher is None else model.score(matcher, pairs.select(*candidates.PAIR, "candidate_source", *features))
    shut = None
    if gate is not None:
        from pyspark.sql import functions as F

        shut = model.score(gate, resolve.entity_statistics(scored.withColumn("label", F.lit(0))), "singleton_prob")
    final = resolve.matches(scored, shut, settings.match, settings.gate, settings.unique, settings.reassign)
    spine = s1.selectExpr("entity_id AS source1_entity_id")
    return Run(union, scored, final, tables.roll_up(spine, final), tables.roll_up(spine, union, "candidate_entity_ids"), resolve.summary(spine, union, final, settings.match, settings.gate), time.perf_counter() - began)
