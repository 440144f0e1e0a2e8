"""Shared pieces: shared-folder tables, vectorised words and hashes."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from linkforge.sources.scratch import delete_at_exit, shared_dir

U64 = np.uint64
#: White space between words: the space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
#: UTF-8 bytes of text that one numpy step holds; bounds a Python worker's memory.
CHUNK_BYTES = 2_000_000
#: Rows of an Arrow batch between Spark and Python: bounds what the executor and its worker hold of it.
BATCH_ROWS = 1000
#: Rows of a few numbers that one file takes, where their number is known.
FILE_ROWS = 250_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession):
    """Queries that run inside hand Python at most BATCH_ROWS rows at a time; the setting is put back."""
    before = spark.conf.get(_BATCH)
    if 0 < int(before) <= BATCH_ROWS:
        yield
        return
    spark.conf.set(_BATCH, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def materialize(df: DataFrame, name: str, narrow: bool = False, rows: int | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors.

    ``narrow`` is for rows of a few numbers: they are gathered in an eighth of the files, or fewer if
    there are at most ``rows`` and these fill fewer. The files go when the driver ends, if
    :func:`drop_table` hasn't taken them before.
    """
    spark = df.sparkSession
    if narrow:
        files = partitions(spark) // 8
        df = df.repartition(max(1, files if rows is None else min(files, -(-rows // FILE_ROWS))))
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    delete_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a materialized table that nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def chunks(texts: list[str | None], most: int = CHUNK_BYTES):
    """Index ranges of texts of about ``most`` characters each, 30,000 texts at most; a longer text is a range of its own."""
    start, total = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and (total + n > most or i - start >= 30_000):
            yield start, i
            start, total = i, 0
        total += n
    if start < len(texts):
        yield start, len(texts)


def slices(batches, rows: int = 1000):
    """The batches in parts of that many rows, so that few texts are Python objects at a time."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (xor-shift and odd multiplications)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept, and made longer when needed."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        step = np.full(max(n, 4096), base, U64)
        step[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(step)
    return have[:n]


BASE_A, BASE_B = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
#: Hash values of every byte at the first places of a word; later places are hashed as they come.
_PLACES = 64
_BYTES = mix64(np.arange(_PLACES * 256, dtype=U64) + U64(0x9E3779B97F4A7C15))


def byte_hashes(data: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A hash of each byte and its place in its word. Sums of these have no structure, as powers of a base have."""
    if place.max(initial=0) < _PLACES:
        return _BYTES[(place << 8) | data]
    out = _BYTES[(np.minimum(place, _PLACES - 1) << 8) | data]
    far = np.flatnonzero(place >= _PLACES)
    out[far] = mix64((place[far].astype(U64) << U64(8)) + data[far] + U64(0x9E3779B97F4A7C15))
    return out


#: Marks bytes that separate words.
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


class Words:
    """Words of a few texts as arrays: 64-bit hash and text index of each, and counts and starts by text.

    ``skip``: byte values that count for nothing inside a word (a word of only such bytes vanishes).
    """

    def __init__(self, texts: list[str | None], skip: np.ndarray | None = None):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
        ends = np.cumsum(np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw)))
        blank = _SPACE[data]
        heads = ~blank
        heads[1:] &= blank[:-1]
        starts = np.flatnonzero(heads)
        self.n_texts = len(texts)
        if not len(starts):
            self.hash, self.text = np.empty(0, U64), np.empty(0, np.int64)
        else:
            quiet = blank if skip is None else blank | skip[data]
            loud = ~quiet
            if skip is None:
                place = np.arange(len(data), dtype=np.int64)
                place[: starts[0]] = 0
                place[starts[0] :] -= np.repeat(starts, np.diff(np.append(starts, len(data))))
            else:  # position among the bytes that count
                seen = np.cumsum(loud) - loud
                place = seen - np.repeat(np.append(0, seen[starts]), np.diff(np.concatenate([[0], starts, [len(data)]])))
            place[quiet] = 0
            value = byte_hashes(data, place)
            value[quiet] = 0
            total = np.add.reduceat(value, starts)
            size = np.add.reduceat(loud.astype(np.int64), starts)
            text = np.searchsorted(ends, starts, "right")
            if skip is not None:
                keep = size > 0
                total, size, text = total[keep], size[keep], text[keep]
            self.hash, self.text = mix64(total + mix64(size.astype(U64))), text
        self.count = np.bincount(self.text, minlength=len(texts)).astype(np.int64)
        self.start = np.cumsum(self.count) - self.count

    def windows(self, k: int, base: int = BASE_A) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every run of k words inside one text, and the position of its first word."""
        n = len(self.hash)
        if n < k:
            return np.empty(0, U64), np.empty(0, np.int64)
        up = powers(base, n + 1)
        down = powers(pow(base, -1, 1 << 64), n + 1)
        sums = np.concatenate([np.zeros(1, U64), np.cumsum(self.hash * up[:n], dtype=U64)])
        at = np.flatnonzero(self.text[: n - k + 1] == self.text[k - 1 :])
        return mix64((sums[at + k] - sums[at]) * down[at]), at


def shingles(words: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Multisets of k-word shingles: (text index, 48-bit shingle hash, count), sorted.

    A text of 1 to k-1 words has one shingle, all its words; a text without words has none.
    """
    h, at = words.windows(k)
    text = words.text[at]
    short = np.flatnonzero((words.count > 0) & (words.count < k))
    if len(short):
        whole = np.add.reduceat(words.hash * powers(BASE_B, len(words.hash))[np.arange(len(words.hash)) - words.start[words.text]], words.start[words.count > 0])
        of = np.flatnonzero(words.count > 0)
        pick = np.isin(of, short)
        h, text = np.concatenate([h, mix64(whole[pick] + U64(1))]), np.concatenate([text, of[pick]])
    key = np.sort((text.astype(U64) << U64(48)) | (h >> U64(16)))
    if not len(key):
        return np.empty(0, np.int64), np.empty(0, U64), np.empty(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    count = np.diff(np.append(first, len(key)))
    key = key[first]
    return (key >> U64(48)).astype(np.int64), key & U64((1 << 48) - 1), count
