"""Mixing sources to target weights, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkforge.llm.common import WORD, materialize, partitions

ROUNDS = 24
#: Sources up to this many rows are broadcast (about 100 bytes a row); more are joined by shuffle.
MOST_BROADCAST = 100_000


def permuted(x: Column, n: Column, *key: Column) -> Column:
    """Where a keyed pseudorandom permutation of 0..n-1 takes x: the swap-or-not shuffle.

    Round r reflects x about a hashed pivot when a hash bit of the unordered pair {x, reflection} is 1,
    so every round is its own inverse and the whole a bijection for any n, without tables or sorting.
    """
    def one(at: Column, r: Column) -> Column:
        mirror = F.pmod(F.pmod(F.xxhash64(*key, r), n) - at, n)
        return F.when(F.xxhash64(F.greatest(at, mirror), r, *key) % 2 == 0, at).otherwise(mirror)

    return F.when(n > 1, F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x, one)).otherwise(x)


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, row_hash and row_no (together they name a row), size, the words of the text, and doc, the whole row of docs."""
    w = Window.partitionBy("doc_id", "row_hash").orderBy(F.lit(1))
    d = docs.select("doc_id", F.xxhash64("text", "source").alias("row_hash"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.struct(*docs.columns).alias("doc"))
    return d.withColumn("row_no", F.row_number().over(w))


def targets(sizes: DataFrame, weights=(5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per source of sizes(source, size): source, src, source_size, target.

    Sources in code point order, null last, take the weights in turn. share * all words are dealt by
    weight; no target exceeds most * its source, and what is over is dealt again among the rest: the
    common level at which the dealt words add up, found from running sums in order of cap / weight.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = per.withColumn("src", F.row_number().over(order) - 1)
    w = w.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("src") % len(weights) + 1).cast("int")))
    w = w.withColumn("cap", most * F.col("source_size")).withColumn("level", F.col("cap") / F.col("weight"))
    before = Window.orderBy("level", "src").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    w = w.withColumn("total", share * F.sum("source_size").over(every))
    w = w.withColumn("free", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    w = w.withColumn("reach", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.col("free"))
    w = w.withColumn("common", F.min(F.when(F.col("reach") < F.col("level"), F.struct("level", "src", "reach"))).over(every)["reach"])
    return w.select("source", "src", "source_size", F.least("cap", F.coalesce(F.col("common") * F.col("weight"), F.col("cap"))).alias("target"))


def small(df: DataFrame, rows: int = MOST_BROADCAST) -> DataFrame:
    """df with a broadcast hint if it has at most ``rows`` rows."""
    return F.broadcast(df) if df.count() <= rows else df


def joined(rows: DataFrame, taken: DataFrame, how: str) -> DataFrame:
    """rows with what is taken of each by doc_id, row_hash and row_no; a null doc_id meets a null one."""
    own = taken.withColumnsRenamed({c: f"taken_{c}" for c in ("doc_id", "row_hash", "row_no")})
    on = F.col("doc_id").eqNullSafe(F.col("taken_doc_id")) & (F.col("row_hash") == F.col("taken_row_hash")) & (F.col("row_no") == F.col("taken_row_no"))
    return rows.join(own, on, how).drop("taken_doc_id", "taken_row_hash", "taken_row_no")


def mix(docs: DataFrame, weights=(5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0, block_words: int = 256, shard_slots: int = 1024, seed: int = 7) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Plan a mix of docs(doc_id, text, source, ...) in which every source has its target share of words.

    Each source's documents follow one another in a fixed pseudorandom order as a stream of words, cut
    into blocks of ``block_words``. A source fills floor(target) words of the mix with slots: slot k of
    pass e takes the block to which the source's permutation for that pass takes k, the source's short
    last block comes last, and the last slot is cut to the exact count, so no word is taken more than
    ``most`` times (rounded up). Output shards have ``shard_slots`` slots each, the last one fewer. Every
    slot of the mix goes to the place of the output to which one more permutation, of all slots, takes
    it, so a shard's source counts are a multinomial draw under the condition that the sources' totals
    over all shards are exact (see :func:`shard_counts`). Slots and the documents' pieces meet by block
    index.

    Returns (rows, sources, pieces): rows has doc_id, row_hash, row_no, source, size of every document;
    sources is :func:`targets`; pieces has one row per document part taken: doc_id, row_hash, row_no,
    pass, shard, slot (its place in the shard, from 0), first (word of the document, from 0), words. Null and empty texts have size 0
    and no piece; null is a source of its own; a repeated row counts once for each time. Empty: empty.

    Shuffles only ids and counts. A source's stream positions are prefix sums in two steps, by hash
    chunks of some 10,000 rows and over the chunks, so a source with most rows is no single task.
    """
    spark = docs.sparkSession
    # (doc_id, hash) rather than the text goes through the window that numbers repeated rows.
    slim = docs.select("doc_id", "source", F.xxhash64("text", "source").alias("row_hash"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    rows = materialize(slim.withColumn("row_no", F.row_number().over(Window.partitionBy("doc_id", "row_hash").orderBy(F.lit(1)))), "sized", narrow=True)
    sources = materialize(targets(rows, weights, share, most), "targets", narrow=True)
    n_chunks = max(16, rows.count() // 10_000)

    of = small(sources)
    streams = rows.where("size > 0").join(of, rows["source"].eqNullSafe(of["source"])).select("doc_id", "row_hash", "row_no", "size", "src", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(n_chunks)).alias("chunk"))
    chunk_sum = streams.groupBy("src", "chunk").agg(F.sum("size").alias("words"))
    chunk_off = chunk_sum.select("src", "chunk", (F.sum("words").over(Window.partitionBy("src").orderBy("chunk")) - F.col("words")).alias("chunk_off"))
    inside = Window.partitionBy("src", "chunk").orderBy("doc_id", "row_hash", "row_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = streams.withColumn("inside", F.sum("size").over(inside) - F.col("size")).join(chunk_off, ["src", "chunk"])
    placed = placed.withColumn("off", F.col("chunk_off") + F.col("inside"))
    block = F.lit(block_words).cast("long")
    parts = placed.select("src", "doc_id", "row_hash", "row_no", "size", "off", F.explode(F.sequence(F.floor(F.col("off") / block), F.floor((F.col("off") + F.col("size") - 1) / block))).alias("block"))

    s = sources.where("source_size > 0").select("src", "source_size", F.floor("target").alias("words"))
    s = s.withColumn("blocks", F.ceil(F.col("source_size") / block)).withColumn("whole", F.floor(F.col("source_size") / block))
    s = s.withColumn("passes", F.floor(F.col("words") / F.col("source_size"))).withColumn("rest", F.col("words") - F.col("passes") * F.col("source_size"))
    s = s.withColumn("slots", F.col("passes") * F.col("blocks") + F.ceil(F.col("rest") / block))
    s = s.withColumn("slots_before", F.sum("slots").over(Window.orderBy("src")) - F.col("slots"))
    n_slots = s.agg(F.sum("slots")).first()[0] or 0
    step = 4096
    dealt = s.where("slots > 0").withColumn("head", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1, F.lit(step).cast("long"))))
    # A fixed number of partitions: the few heads would else be merged into one task before they unfold.
    dealt = dealt.repartition(max(partitions(spark), n_slots // 100_000), F.col("src"), F.col("head")).withColumn("at", F.explode(F.sequence(F.col("head"), F.least(F.col("head") + step, F.col("slots")) - 1)))
    dealt = dealt.withColumn("pass", F.floor(F.col("at") / F.col("blocks"))).withColumn("k", F.col("at") % F.col("blocks"))
    key = [F.lit(seed), F.col("src"), F.col("pass")]
    taken = dealt.select(
        "src", "pass", "at",
        F.when(F.col("k") < F.col("whole"), permuted(F.col("k"), F.col("whole"), *key)).otherwise(F.col("k")).alias("block"),
        F.when(F.col("pass") < F.col("passes"), block).otherwise(F.least(block, F.col("rest") - F.col("k") * block)).alias("take"),
        permuted(F.col("slots_before") + F.col("at"), F.lit(max(1, n_slots)).cast("long"), F.lit(seed + 1)).alias("place"),
    )
    met = parts.hint("merge").join(taken.hint("merge"), ["src", "block"])
    start = F.greatest(F.col("off"), F.col("block") * block)
    stop = F.least(F.col("off") + F.col("size"), F.col("block") * block + F.col("take"))
    pieces = met.select("doc_id", "row_hash", "row_no", "src", "pass", F.floor(F.col("place") / shard_slots).alias("shard"), (F.col("place") % shard_slots).alias("slot"), (start - F.col("off")).alias("first"), (stop - start).alias("words")).where("words > 0")
    return rows, sources, pieces


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """Per row of docs: doc_id, size, source_size, target (its source's), taken (words in the mix), pieces, first_shard.

    pieces counts the runs of words taken; first_shard is the first output shard that holds one (null: none).
    """
    rows, sources, pieces = mix(docs, **options)
    took = pieces.groupBy("doc_id", "row_hash", "row_no").agg(F.sum("words").alias("taken"), F.count(F.lit(1)).alias("pieces"), F.min("shard").alias("first_shard"))
    of = small(sources)
    out = rows.join(of, rows["source"].eqNullSafe(of["source"])).drop(of["source"])
    return joined(out, took, "left").select("doc_id", "size", "source_size", "target", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("taken", "pieces")], "first_shard")


def shard_counts(pieces: DataFrame) -> DataFrame:
    """(shard, src, slots): the drawn number of slots of each source in each output shard of :func:`mix`'s pieces."""
    return pieces.select("shard", "src", "slot").distinct().groupBy("shard", "src").agg(F.count(F.lit(1)).alias("slots"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: for each pass a row per document that it takes, with docs' columns.

    A document taken whole keeps its text; else text is the taken words in their order, joined by one
    space. n_chars, where docs has it, is the length of the new text.
    """
    _, _, pieces = mix(docs, **options)
    runs = pieces.groupBy("doc_id", "row_hash", "row_no", "pass").agg(F.array_sort(F.collect_list(F.struct("first", "words"))).alias("runs"), F.sum("words").alias("taken"))
    keyed = sized(docs)
    both = joined(keyed, runs, "inner")
    words = F.regexp_extract_all("doc.text", F.lit(WORD), F.lit(0))
    cut = F.array_join(F.flatten(F.transform("runs", lambda r: F.slice("all_words", (r["first"] + 1).cast("int"), r["words"].cast("int")))), " ")
    both = both.withColumn("all_words", F.when(F.col("taken") < F.col("size"), words))
    both = both.withColumn("new_text", F.when(F.col("taken") < F.col("size"), cut).otherwise(F.col("doc.text")))
    made = {"text": F.col("new_text")}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.length("new_text").cast(docs.schema["n_chars"].dataType)
    return both.select(*[made.get(c, F.col("doc")[c]).alias(c) for c in docs.columns])
