"""Shards under a byte limit by extendible hashing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkforge.llm.common import materialize

#: Prefix bits that one reading of the hashes resolves; its directory has 2**16 entries at most.
STEP_BITS, STEPS = 16, 2
#: Limits of bytes that one running sum goes over.
SPLIT = 1000


def directory(sizes: DataFrame, limit: int, step: int) -> DataFrame:
    """For sizes(prefix, bits, bytes), bits of STEP_BITS in this step: (prefix, bits, depth, done, bytes).

    depth is the number of bits in this step at which the bucket of these bits first fits the limit,
    or STEP_BITS where it doesn't fit even then (done false). bytes is what the bits hold.
    """
    levels = F.explode(F.sequence(F.lit(0 if step == 0 else 1), F.lit(STEP_BITS)))
    cells = sizes.groupBy("prefix", "bits").agg(F.sum("bytes").alias("bytes"))
    by_level = cells.withColumnRenamed("bytes", "own").withColumn("depth", levels).withColumn("head", F.expr(f"shiftright(bits, {STEP_BITS} - depth)"))
    sums = by_level.groupBy("prefix", "depth", "head").agg(F.sum("own").alias("bytes"))
    fits = by_level.select("prefix", "bits", "depth", "head", "own").join(sums, ["prefix", "depth", "head"])
    return fits.groupBy("prefix", "bits").agg(F.min(F.when(F.col("bytes") <= limit, F.col("depth"))).alias("fit"), F.max("own").alias("own")).select("prefix", "bits", F.coalesce("fit", F.lit(STEP_BITS)).alias("depth"), F.col("fit").isNotNull().alias("done"), F.col("own").alias("bytes"))


def shards(docs: DataFrame, limit: int = 1_000_000) -> DataFrame:
    """docs and n_bytes, depth, shard: an extendible hash directory whose shards hold at most ``limit`` bytes.

    A document's key is the first 32 bits of md5(doc_id | text). All start in one bucket of no bits; a bucket
    over the limit, and only it, splits on the next bit. depth is the number of bits a shard uses and
    shard their string. The directory comes from bytes summed by the first 16 bits, and by the next 16
    where a bucket is still over the limit, so documents are read twice and never moved to be counted.

    n_bytes is the UTF-8 length of text (null: 0). What 32 bits can't divide (one document over the
    limit, or many equal rows) is cut by a running sum: shard then ends in ``+`` and the part's name,
    and only a part of a single row may exceed the limit. A null doc_id or text hashes as ''. Other columns pass through; columns of docs called n_bytes, depth or
    shard are replaced. Empty: empty.
    """
    names = [c for c in docs.columns if c not in ("n_bytes", "depth", "shard")]
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.coalesce("text", F.lit(""))))
    key = F.conv(F.substring(digest, 1, 2 * STEPS * STEP_BITS // 8), 16, 10).cast("long")
    rows = docs.select(*names, F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), key.alias("_key"))
    left = materialize(rows.select("n_bytes", "_key"), "keys", narrow=True).select(F.lit("").alias("prefix"), "_key", "n_bytes")
    out, open_ = None, rows.withColumn("_prefix", F.lit(""))
    done_parts = []
    for step in range(STEPS):
        down = STEP_BITS * (STEPS - 1 - step)
        bits = F.shiftright("_key", down).bitwiseAND((1 << STEP_BITS) - 1)
        cells = materialize(directory(left.select("prefix", bits.alias("bits"), F.col("n_bytes").alias("bytes")), limit, step), "directory", narrow=True)
        entries = cells.select(F.col("prefix").alias("_prefix"), F.col("bits").alias("_bits"), "depth", F.col("done").alias("_done"), F.col("bytes").alias("_bytes"))
        if step == 0:
            entries = F.broadcast(entries)  # 2**16 rows at most
        placed = open_.withColumn("_bits", bits).join(entries, ["_prefix", "_bits"])
        spelled = F.concat("_prefix", F.substring(F.lpad(F.bin("_bits"), STEP_BITS, "0"), F.lit(1), F.col("depth").cast("int")))
        placed = placed.withColumn("shard", spelled).withColumn("depth", F.col("depth") + step * STEP_BITS)
        done_parts.append(placed.where("_done").select(*names, "n_bytes", "depth", "shard"))
        open_ = placed.where("not _done").withColumn("_prefix", F.col("shard")).drop("_bits", "depth", "_done", "shard")
        if step + 1 < STEPS:
            open_ = open_.drop("_bytes")
        over = cells.where("not done").select("prefix", "bits")
        if over.limit(1).count() == 0:
            open_ = None
            break
        full = F.lpad(F.bin("bits"), STEP_BITS, "0")
        left = left.withColumn("bits", bits).join(over, ["prefix", "bits"]).select(F.concat("prefix", full).alias("prefix"), "_key", "n_bytes")
    for part in done_parts:
        out = part if out is None else out.unionByName(part)
    if open_ is not None:
        # Rows of half the limit or less fill parts of half the limit, over by one row at most; larger rows stand alone.
        half = limit // 2
        big = F.col("n_bytes") > half
        # A group of more than SPLIT limits (a third of all rows may be equal) is first dealt to as many runs.
        open_ = open_.withColumn("_run", F.pmod(F.monotonically_increasing_id(), F.ceil(F.col("_bytes") / (SPLIT * limit))))
        run = Window.partitionBy("_prefix", "_run", big).orderBy("text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        part = F.when(big, F.count(F.lit(1)).over(run)).otherwise(F.floor(F.sum("n_bytes").over(run) / F.lit(max(1, half))))
        cut = open_.withColumn("shard", F.concat("_prefix", F.when(big, F.lit("+b")).otherwise(F.lit("+s")), F.when(F.col("_run") > 0, F.concat(F.col("_run").cast("string"), F.lit("."))).otherwise(F.lit("")), part.cast("string"))).withColumn("depth", F.lit(STEPS * STEP_BITS))
        out = out.unionByName(cut.select(*names, "n_bytes", "depth", "shard"))
    return out


def write_shards(docs: DataFrame, path: str, limit: int = 1_000_000) -> None:
    """Write :func:`shards` as Parquet folders shard=..., each by one task of at most ``limit`` bytes of text."""
    out = shards(docs, limit)
    out.repartition("shard").write.partitionBy("shard").parquet(path)
