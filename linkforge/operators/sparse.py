"""Sparse blocking: candidates by weighted shared keys, added up in tasks of bounded size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkforge.functions.text import grams
from linkforge.sources.scratch import new_path
from linkforge.sources.tables import write_parquet

PATHS = ("token", "ngram", "postal", "country")
POSTAL_WEIGHT, GRAM_WEIGHT, SAME_COUNTRY, OTHER_COUNTRY = 10.0, 0.3, 1.5, 0.2
#: Which kinds of keys a pair shares, in order of the provenance, and whether the country.
BITS, COUNTRY_BIT = {"ngram": 1, "postal": 2, "token": 4}, 8
#: Sources and targets that meet in one task, at most about; FEW sources are worth a task.
SOURCES, TARGETS, FEW = 100_000, 125_000, 256


def keys(records: DataFrame, paths=PATHS, also: tuple[str, ...] = ()) -> DataFrame:
    """(entity_id, kind, key) and the columns ``also``: distinct tokens, 4-grams of the compact name and postal codes of preprocessed records."""
    parts = {
        "token": F.array_distinct(F.col("business_name_tokenized")),
        "ngram": grams(F.col("business_name_compact")),
        "postal": F.when(F.col("postal_code").isNotNull(), F.array("postal_code")).otherwise(F.array().cast("array<string>")),
    }

    def tagged(kind: str) -> Column:
        return F.transform(parts[kind], lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("key")))

    every = F.flatten(F.array(*[tagged(k) for k in parts if k in paths]))
    return records.select("entity_id", *also, F.explode(every).alias("k")).select("entity_id", *also, "k.kind", "k.key")


def key_weights(target_keys: DataFrame, n_targets: DataFrame, max_df: float = 0.01) -> DataFrame:
    """(kind, key, df, weight): inverse document frequency of the targets' keys, frequent tokens and grams pruned.

    A token or gram in more than max(2, max_df * n) targets is dropped; a postal code always stays.
    """
    df = target_keys.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n_targets))
    idf = F.log(F.col("n") / (F.col("df") + 1))
    weight = F.when(F.col("kind") == "postal", F.lit(POSTAL_WEIGHT)).when(F.col("kind") == "ngram", GRAM_WEIGHT * idf).otherwise(idf)
    return df.where((F.col("kind") == "postal") | (F.col("df") <= F.greatest(F.lit(2.0), max_df * F.col("n")))).select("kind", "key", "df", weight.alias("weight"))


def _flat(lists) -> tuple[np.ndarray, np.ndarray]:
    """The values of an Arrow list column one after another, and where each row's begin and the last end."""
    lists = lists.combine_chunks()
    ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).astype(np.int64)
    return lists.flatten().to_numpy(zero_copy_only=False), ends


def _best(top_k: int, systems: list[tuple[int, bool]]):
    """For a part of the sources and one of the targets, as packed by :func:`block_each`: the top_k targets of each source in rounded score.

    systems: the bits of each one's kinds of keys, and whether countries count.
    """
    # Kinds that the same systems use are added up together.
    used = [tuple(bool(kinds & b) for kinds, _ in systems) for b in BITS.values()]
    sums = sorted(set(used))
    sum_of = np.zeros(COUNTRY_BIT, np.int64)
    sum_of[list(BITS.values())] = [sums.index(u) for u in used]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        order = pc.sort_indices(right["entity_id"]).to_numpy()
        ids = right["entity_id"].take(pa.array(order))
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order))
        # The targets of each key, one key after another, as places in the order of their ids.
        numbers, ends = _flat(right["numbers"])
        order = np.argsort(numbers)
        posted = np.repeat(place, np.diff(ends))[order].astype(np.intp)
        numbers = numbers[order]
        first = np.flatnonzero(np.diff(numbers, prepend=-1))
        known, last = numbers[first], np.append(first[1:], len(posted))
        del order, numbers
        countries = right["country"].to_pylist()
        codes = {c: i for i, c in enumerate(sorted(set(countries) - {None}))}
        country = np.empty(len(place), np.int64)
        country[place] = [codes.get(c, -2) for c in countries]
        mine, ends = _flat(left["numbers"])
        weight, bit = _flat(left["weights"])[0], _flat(left["bits"])[0].astype(np.uint8)
        into = sum_of[bit]
        at = np.searchsorted(known, mine)
        held = at < len(known)
        held[held] = known[at[held]] == mine[held]
        raw, marks = [np.zeros(right.num_rows) for _ in sums], np.zeros(right.num_rows, np.uint8)
        numbered, rows, columns, scores, bits = [], [], [], [], []
        for s, own in enumerate(left["country"].to_pylist()):
            for g in range(ends[s], ends[s + 1]):
                if held[g]:
                    hits = posted[first[at[g]] : last[at[g]]]  # a target has a key once
                    raw[into[g]][hits] += weight[g]
                    marks[hits] |= bit[g]
            met = np.flatnonzero(marks != 0)
            for n, (kinds, by_country) in enumerate(systems):
                mark = marks[met] & kinds
                found = met[mark != 0]
                mark = mark[mark != 0]
                score = sum(raw[i][found] for i, u in enumerate(sums) if u[n])
                if by_country and own is not None:
                    same = country[found] == codes.get(own, -1)
                    score = score * np.where(same, SAME_COUNTRY, OTHER_COUNTRY)
                    mark = mark | np.where(same, COUNTRY_BIT, 0).astype(np.uint8)
                if len(found) > top_k:  # what rounds to no less than the last of top_k
                    near = score >= np.partition(score, -top_k)[-top_k] - 2e-6
                    found, score, mark = found[near], score[near], mark[near]
                score = np.round(score, 6)
                top = np.lexsort((found, -score))[:top_k]
                numbered.append(np.full(len(top), n, np.int32))
                rows.append(np.full(len(top), s))
                columns.append(found[top])
                scores.append(score[top])
                bits.append(mark[top].astype(np.int32))
            for r in raw:
                r[met] = 0
            marks[met] = 0
        joined = [np.concatenate(x) if x else np.zeros(0, t) for x, t in ((numbered, np.int32), (rows, np.int64), (columns, np.int64), (scores, np.float64), (bits, np.int32))]
        return pa.table({"number": joined[0], "source1_entity_id": left["entity_id"].take(pa.array(joined[1])), "candidate_entity_id": ids.take(pa.array(joined[2])), "score": joined[3], "bits": joined[4]})
    return run


def _dealt(rows: DataFrame, own: str, own_parts: int, other: str, other_parts: int) -> DataFrame:
    """Packed rows in their part of ``own_parts``, once for each part of the other side; a part of each meet in one task."""
    part = F.pmod(F.xxhash64("entity_id"), F.lit(own_parts)).cast("int").alias(own)
    out = rows.select("*", part, F.explode(F.sequence(F.lit(0), F.lit(other_parts - 1))).alias(other))
    # A number of partitions that is given isn't merged by bytes: a part takes long for its size. With many, few tasks get two.
    meet = own_parts * other_parts
    return out.repartition(max(2 * meet, min(8 * meet, 200)), "i", "j")


def block(sources: DataFrame, targets: DataFrame, top_k: int = 30, paths=PATHS, max_df: float = 0.01) -> DataFrame:
    """(source1_entity_id, candidate_entity_id, score, provenance, rank): the top_k targets of each source.

    Score: inverse document frequencies of shared tokens, 0.3 times those of shared 4-grams, 10 for the
    same postal code; times 1.5 for the same country and 0.2 for another, where the source's country
    occurs among the targets. Ties go to the smaller id. Only keys meet, never all records; pruning
    bounds what a key of tokens or grams holds.

    The pairs that share a key grow with the square of the input, so none is written: records are packed
    with their keys' numbers, and every part of the sources meets every part of the targets in a task of
    bounded size, which adds up the weights and gives its top_k to a source. The best of all parts stay.
    Of targets with equal keys and country only the top_k smallest ids can be among a source's top_k.
    Keys and packed records are written to the shared folder when this is called.
    """
    return block_each(sources, targets, {"": paths}, top_k, max_df).drop("system")


def block_each(sources: DataFrame, targets: DataFrame, systems: dict[str, tuple[str, ...]], top_k: int = 30, max_df: float = 0.01) -> DataFrame:
    """system and the columns of :func:`block`: what it gives for the paths of each system, under the system's name.

    All systems share one set of packed records, and a pair's keys are met once.
    """
    spark = sources.sparkSession
    paths = tuple(p for p in PATHS if any(p in own for own in systems.values()))
    weights = key_weights(keys(targets, paths), targets.agg(F.count(F.lit(1)).alias("n")), max_df)
    bit = F.lit(0)
    for kind, n in BITS.items():
        bit = F.when(F.col("kind") == kind, n).otherwise(bit)
    numbered = write_parquet(weights.select("kind", "key", "weight", bit.alias("bit"), F.monotonically_increasing_id().alias("number")), new_path(spark, "keys"))
    by_country, by_postal = "country" in paths, "postal" in paths
    country = F.lit(None).cast("string")
    known = targets.where("country_normalized <> ''").select("country_normalized").distinct()
    s = sources.join(known.withColumn("_country", F.col("country_normalized")), "country_normalized", "left") if by_country else sources.withColumn("_country", country)
    equal = ["business_name_compact", "business_name_tokenized", *(["postal_code"] if by_postal else []), *(["country_normalized"] if by_country else [])]
    place = F.row_number().over(Window.partitionBy(*equal).orderBy("entity_id"))
    t = targets.select("entity_id", *{*equal, "postal_code"}, F.col("country_normalized").alias("_country") if by_country else country.alias("_country")).withColumn("_place", place).where(F.col("_place") <= top_k)

    def packed(rows: DataFrame, name: str, **lists: str) -> DataFrame:
        held = keys(rows, paths, ("_country",)).join(numbered, ["kind", "key"]).groupBy("entity_id", F.col("_country").alias("country"))
        held = held.agg(F.collect_list(F.struct("number", *lists.values())).alias("k"))
        return write_parquet(held.select("entity_id", "country", F.col("k.number").alias("numbers"), *[F.col(f"k.{c}").alias(x) for x, c in lists.items()]), new_path(spark, name))

    mine, theirs = packed(s, "sources", weights="weight", bits="bit"), packed(t, "targets")
    n, m = mine.count(), theirs.count()
    there = max(-(-m // TARGETS), 1)
    here = max(-(-n // SOURCES), min(-(-2 * spark.sparkContext.defaultParallelism // there), -(-n // FEW)), 1)
    kinds = [(sum(n for k, n in BITS.items() if k in own), "country" in own) for own in systems.values()]
    a, b = _dealt(mine, "i", here, "j", there), _dealt(theirs, "j", there, "i", here)
    best = a.groupBy("i", "j").cogroup(b.groupBy("i", "j")).applyInArrow(_best(top_k, kinds), "number int, source1_entity_id string, candidate_entity_id string, score double, bits int")
    hit = F.concat_ws(",", *[F.when(F.col("bits").bitwiseAND(n) > 0, F.lit(k)) for k, n in {"country": COUNTRY_BIT, **BITS}.items()])
    order = Window.partitionBy("source1_entity_id", *(["system"] if len(systems) > 1 else [])).orderBy(F.col("score").desc(), "candidate_entity_id")
    name = F.element_at(F.array(*[F.lit(x) for x in systems]), F.col("number") + 1) if len(systems) > 1 else F.lit(next(iter(systems)))
    ranked = best.select(name.alias("system"), "source1_entity_id", "candidate_entity_id", "score", hit.alias("provenance"))
    return ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)
