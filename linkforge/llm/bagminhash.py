"""Near-duplicate classes by BagMinHash signatures, banding and exact verification."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkforge.llm.common import U64, Words, chunks, materialize, mix64, partitions, shingles, slices
from linkforge.llm.components import components

REGISTERS, ROWS = 64, 4
#: Random members of a component that stand for it in a bucket.
SALTS = 4
#: Registers, of 8 bits each, by which the members of a bucket are compared; a first look takes GLANCE of them.
LONG, GLANCE = 1024, 128
#: Standard deviations below the threshold at which a pair still goes on to exact verification.
SLACK = 3.5
#: Members of one side of a cell; bounds what a task holds of a bucket.
CELL = 256
_TO_UNIT = 2.0**-53


def _later(time: np.ndarray, state: np.ndarray, rate: np.ndarray | float) -> tuple[np.ndarray, np.ndarray]:
    """Times of the next points of Poisson processes, and the states that drew them."""
    state = mix64(state + U64(0x632BE59BD9B4E019))
    return time - np.log1p(-(state >> U64(11)).astype(np.float64) * _TO_UNIT) / rate, state


def signatures(text: np.ndarray, element: np.ndarray, weight: np.ndarray, n_texts: int, m: int = REGISTERS) -> np.ndarray:
    """BagMinHash: for each text, m register values of its weighted set (0 where the set is empty).

    The weight axis is cut into the dyadic cells [0,1), [1,2), [2,4), [4,8), ...; every (element, cell) is
    the root of a hierarchy of Poisson processes. A process wider than 1 splits at its first point: the half
    with the point keeps it, the other half goes on from that time with a process of its own, and a half
    that begins at or above the weight is left out. A point that has come down to width 1 counts for a
    register, each of which keeps its first. What is drawn depends on element and path only, so two texts
    agree in a register with the probability of their weighted Jaccard similarity. Processes go on only
    while a point can still be first somewhere.
    """
    cells = [(text, element, np.zeros(len(text), np.int64), weight)]
    edge = 1
    while True:
        over = weight > edge
        if not over.any():
            break
        cells.append((text[over], element[over], np.full(int(over.sum()), edge, np.int64), weight[over]))
        edge *= 2
    doc, element, low, weight = (np.concatenate(x) for x in zip(*cells, strict=True))
    width = np.maximum(low, 1)
    time, state = _later(np.zeros(len(doc)), mix64(element ^ mix64(low.astype(U64) + U64(0x51ED27))), m * width)
    first = np.full(n_texts * m, np.inf)
    while len(doc):
        draw = mix64(state ^ U64(0x8CB92BA72F3D8DD7))
        leaf = width == 1
        register = ((draw[leaf] >> U64(32)) * U64(m) >> U64(32)).astype(np.int64)
        np.minimum.at(first, doc[leaf] * m + register, time[leaf])
        after, onward = _later(time[leaf], state[leaf], float(m))
        if leaf.all():
            time, state = after, onward
        else:
            node = ~leaf
            half = width[node] // 2
            upper = (draw[node] & U64(1)).astype(np.int64) * half
            held = mix64(state[node] ^ U64(0x2545F4914F6CDD1D))
            free_time, free = _later(time[node], mix64(state[node] ^ U64(0x9E6C63D0876A9A47)), m * half)
            time, state = np.concatenate([after, time[node], free_time]), np.concatenate([onward, held, free])
            low = np.concatenate([low[leaf], low[node] + upper, low[node] + half - upper])
            width = np.concatenate([width[leaf], half, half])
            doc, weight = (np.concatenate([x[leaf], x[node], x[node]]) for x in (doc, weight))
        on = (low < weight) & (time < first.reshape(n_texts, m).max(1)[doc])
        doc, low, width, weight, state, time = (x[on] for x in (doc, low, width, weight, state, time))
    out = mix64(first.view(U64)).reshape(n_texts, m)
    out[np.isinf(first.reshape(n_texts, m)[:, 0])] = 0
    return out


def _mixed_bands(sig: np.ndarray) -> np.ndarray:
    """One hash for each band of ROWS registers."""
    bands = sig.reshape(len(sig), REGISTERS // ROWS, ROWS)
    mixed = bands[:, :, 0].copy()
    for r in range(1, ROWS):
        mixed = mix64(mixed ^ bands[:, :, r])
    return mixed


def _bands(batches):
    for batch in slices(batches):
        texts, ids = batch.column(1).to_pylist(), batch.column(0)
        for a, b in chunks(texts):
            words = Words(texts[a:b])
            text, element, count = shingles(words)
            mixed = _mixed_bands(signatures(text, element, count, b - a))
            some = words.count > 0
            flat = pa.array(mixed[some].reshape(-1).view(np.int64))
            offsets = np.concatenate([[0], np.cumsum(np.where(some, REGISTERS // ROWS, 0))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), batch.column(2).slice(a, b - a), pa.ListArray.from_arrays(pa.array(offsets), flat)], names=["doc_id", "same", "bands"])


def similarity(a: list[str | None], b: list[str | None]) -> np.ndarray:
    """Weighted Jaccard similarity of the 5-word shingle multisets of a[i] and b[i] (two empty ones: 0)."""
    n = len(a)
    words = Words([*a, *b])
    text, element, count = shingles(words)
    key, side = ((text % n).astype(U64) << U64(48)) | element, text >= n
    left, right = ~side, side
    _, i, j = np.intersect1d(key[left], key[right], assume_unique=True, return_indices=True)
    both = np.bincount((text[left] % n)[i], np.minimum(count[left][i], count[right][j]), minlength=n)
    union = np.bincount(text % n, count, minlength=n) - both
    return np.where(union > 0, both / np.maximum(union, 1), 0.0)


def differences(a: list[str | None], b: list[str | None]) -> np.ndarray:
    """Band keys (of 3 registers each) of the symmetric difference of the shingle multisets of a[i] and b[i]."""
    n = len(a)
    text, element, count = shingles(Words([*a, *b]))
    pair, side = text % n, text >= n
    key = (pair.astype(U64) << U64(48)) | element
    order = np.argsort(key, kind="stable")
    key, pair, element, signed = key[order], pair[order], element[order], np.where(side, -count, count)[order]
    heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, int)
    over = np.add.reduceat(signed, heads) if len(heads) else signed
    pair, element = pair[heads], element[heads]
    # What only the leader has is another element than what only the document has.
    element = np.where(over < 0, mix64(element) >> U64(16), element)
    left = over != 0
    sig = signatures(pair[left], element[left], np.abs(over[left]), n, 48).reshape(n, 16, 3)
    return mix64(sig[:, :, 0] ^ mix64(sig[:, :, 1] ^ mix64(sig[:, :, 2])))


def _verified():
    """(a, b, similarity, bands) of (a, b, central, text_a, text_b); bands of their difference for central leaders."""
    def run(batches):
        for batch in slices(batches, 500):
            a, b = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            central = batch.column(2).to_pylist()
            sizes = [(x or "") + (y or "") for x, y in zip(a, b, strict=True)]
            for s, e in chunks(sizes):
                same = similarity(a[s:e], b[s:e])
                bands: list = [None] * (e - s)
                apart = [i for i in range(e - s) if central[s + i] and same[i] < 1]
                if apart:
                    for i, keys in zip(apart, differences([a[s + i] for i in apart], [b[s + i] for i in apart]), strict=True):
                        bands[i] = keys.view(np.int64).tolist()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s, e - s), batch.column(1).slice(s, e - s), pa.array(same), pa.array(bands, pa.list_(pa.int64()))], names=["a", "b", "similarity", "bands"])
    return run


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, similarity, bands) of pairs(a, b, central) by exact multiset overlap of the texts(doc_id, text)."""
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "central", "text_a", "text_b")
    return both.mapInArrow(_verified(), "a long, b long, similarity double, bands array<long>")


def _several(rows: DataFrame) -> DataFrame:
    """The rows(key, doc_id) of keys that hold two documents or more."""
    keys = rows.groupBy("key").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y")).where("x < y").select("key")
    return rows.join(keys, "key").select("key", "doc_id")


def _split(rows: DataFrame, of: DataFrame) -> DataFrame:
    """(key, class, n, reps) of the keys of rows(key, doc_id) that hold two classes of of(node, class) or more.

    reps are SALTS random documents of the class in the bucket, each its minimum under another hash.
    """
    named = rows.join(of.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("class", F.coalesce("class", "doc_id"))
    reps = F.array(*[F.min_by("doc_id", F.xxhash64("key", "doc_id", F.lit(i))) for i in range(SALTS)])
    cells = named.groupBy("key", "class").agg(F.count(F.lit(1)).alias("n"), reps.alias("reps"))
    return _mixed(cells)


def _mixed(cells: DataFrame) -> DataFrame:
    keys = cells.groupBy("key").agg(F.min("class").alias("x"), F.max("class").alias("y"), F.max_by("reps", F.struct("n", "class")).alias("center"), F.max_by("class", F.struct("n", "class")).alias("main")).where("x < y")
    return cells.join(keys.select("key", "center", "main"), "key")


def _sketches(batches):
    """(doc_id, sketch): 8 bits of each of LONG registers, then 32 bits of each band."""
    for batch in slices(batches, 500):
        texts = batch.column(1).to_pylist()
        for a, b in chunks(texts, 1_000_000):
            text, element, count = shingles(Words(texts[a:b]))
            long = signatures(text, element, count, b - a, LONG).astype(np.uint8)
            bands = _mixed_bands(signatures(text, element, count, b - a)).astype("<u4").view(np.uint8)
            rows = np.concatenate([long, bands.reshape(b - a, -1)], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([r.tobytes() for r in rows], pa.binary())], names=["doc_id", "sketch"])


def _alike(band: int, same_block: bool, block: np.ndarray, doc: np.ndarray, of: np.ndarray, sketch: np.ndarray, threshold: float):
    """Pairs of documents of two classes in a cell whose sketches say that they may reach the threshold."""
    def least(m: int, deviations: float) -> float:
        return m * (threshold - deviations * (threshold * (1 - threshold) / m) ** 0.5)

    long, bands = sketch[:, :LONG], np.ascontiguousarray(sketch[:, LONG:]).view("<u4")
    order = np.arange(len(doc))
    left = order if same_block else order[block == block.min()]
    right = order if same_block else order[block != block.min()]
    for r in left:
        other = right[(of[right] != of[r]) & (right > r)] if same_block else right[of[right] != of[r]]
        for m, deviations in ((GLANCE, 5.0), (LONG, SLACK)):
            other = other[np.count_nonzero(long[other, :m] == long[r, :m], axis=1) >= least(m, deviations)]
        # A pair that shares an earlier band is told there.
        other = other[~(bands[other, :band] == bands[r, :band]).any(1)]
        if len(other):
            yield np.minimum(doc[other], doc[r]), np.maximum(doc[other], doc[r])


def _cell_pairs(threshold: float):
    """A mapInArrow function over rows sorted by (key, i, j); holds one cell at a time."""
    def told(cell, kept):
        block, doc, of, sketch = (np.concatenate(x) for x in zip(*kept, strict=True))
        found = list(_alike(cell[0] & 15, cell[1] == cell[2], block, doc, of, sketch, threshold))
        if found:
            a, b = (np.concatenate(x) for x in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def run(batches):
        now, kept = None, []
        for batch in slices(batches, 4096):
            cells = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(3)], axis=1)
            block, doc, of = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (3, 4, 5))
            sketch = np.frombuffer(b"".join(batch.column(6).to_pylist()), np.uint8).reshape(len(doc), -1)
            cut = np.flatnonzero(np.concatenate([[True], (cells[1:] != cells[:-1]).any(1)])) if len(doc) else np.empty(0, int)
            for a, b in zip(cut, [*cut[1:], len(doc)], strict=False):
                cell = tuple(cells[a].tolist())
                if kept and cell != now:
                    yield from told(now, kept)
                    kept = []
                now = cell
                kept.append((block[a:b], doc[a:b], of[a:b], sketch[a:b]))
        if kept:
            yield from told(now, kept)
    return run


def _rest(rows: DataFrame, known: DataFrame, texts: DataFrame, threshold: float, cell: int = CELL) -> DataFrame:
    """(a, b) of all pairs in different classes that share a bucket of rows(key, doc_id) and have alike sketches.

    The members of a bucket outside its largest class meet one another and that class. Both parts are cut
    into blocks of about ``cell`` members, and each pair of blocks is a cell, a small task's work.
    """
    named = rows.join(known.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("class", F.coalesce("class", "doc_id"))
    sizes = named.groupBy("key", "class").agg(F.count(F.lit(1)).alias("n"))
    keys = sizes.groupBy("key").agg(F.max_by("class", F.struct("n", "class")).alias("main"), F.max("n").alias("most"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("classes")).where("classes > 1")
    members = named.join(keys, "key").withColumn("of_main", F.col("class") == F.col("main"))
    members = members.withColumn("others", F.ceil((F.col("n") - F.col("most")) / cell)).withColumn("mains", F.ceil(F.col("most") / cell))
    own = F.when(F.col("of_main"), F.col("others") + F.pmod(F.xxhash64("doc_id", "key"), F.col("mains"))).otherwise(F.pmod(F.xxhash64("doc_id", "key"), F.col("others")))
    last = F.when(F.col("of_main"), F.col("others")).otherwise(F.col("others") + F.col("mains")) - 1
    members = materialize(members.select("key", "doc_id", "class", own.alias("block"), last.alias("last")), "members", narrow=True)
    sketches = texts.join(members.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "text").mapInArrow(_sketches, "doc_id long, sketch binary")
    dealt = members.join(materialize(sketches, "sketches").hint("merge"), "doc_id").withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))))
    dealt = dealt.select("key", F.least("block", "at").alias("i"), F.greatest("block", "at").alias("j"), "block", "doc_id", "class", "sketch")
    dealt = dealt.repartition(partitions(rows.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(_cell_pairs(threshold), "a long, b long")


def _joined(known: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """known(node, class) after links(a, b), and (class, to) of the classes that changed."""
    for end in ("a", "b"):
        links = links.join(known.withColumnRenamed("node", end), end, "left").withColumn(end, F.coalesce("class", end)).drop("class")
    merged = components(links.select("a", "b")).select(F.col("node").alias("class"), F.col("class").alias("to"))
    alone = merged.join(known, merged["class"] == known["node"], "left_anti").select(F.col("class").alias("node"), F.col("to").alias("class"))
    return materialize(known.join(merged, "class", "left").select("node", F.coalesce("to", "class").alias("class")).unionByName(alone), "known", narrow=True), merged


def _links(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    return materialize(verify(pairs.withColumn("central", F.lit(False)), texts).where(F.col("similarity") >= threshold).select("a", "b"), "more", narrow=True)


def _leaders(rows: DataFrame) -> DataFrame:
    """(key, central, other) of rows(key, doc_id): the document with the most company over all its keys, and a random one."""
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    company = rows.join(sizes, "key").groupBy("doc_id").agg(F.sum("n").alias("company"))
    ranked = rows.join(company, "doc_id")
    best = F.min_by("doc_id", F.struct(-F.col("company"), F.col("doc_id"))).alias("central")
    return ranked.groupBy("key").agg(best, F.min_by("doc_id", F.xxhash64("key", "doc_id")).alias("other"))


def classes(docs: DataFrame, threshold: float = 0.8, rounds: int = 2) -> DataFrame:
    """(doc_id, class_id, same, is_copy) for every row of docs(doc_id, text, ...): near-duplicate classes.

    Texts link when the weighted Jaccard similarity of their 5-word shingle multisets is at least
    ``threshold``; a class is a connected set of links, named by its smallest doc_id; is_copy marks all
    but that document; same is the SHA-256 of the text. Exact copies fold into their smallest doc_id
    before anything else. Signatures band into 16 keys of 4 registers (a pair at 0.8 shares a key with
    probability 0.9998).

    Inside a key's bucket the documents are compared with two leaders, the one with the most company in
    all its buckets and, in a quarter of the buckets, a random one; never all with all. Two documents
    that both fail a leader L can only be similar if their symmetric differences to L overlap (in more
    than a ninth of L). So where a leader does not hold its whole bucket, finer buckets are made by L
    and the bands, of 3 registers, of a signature of that difference: a large family of texts that are
    all somewhat alike falls apart. In every bucket, old or finer, that still holds several components,
    random members of each are then compared with random members of the largest, ``rounds`` times.
    That joins most of what belongs together cheaply. At last, in every bucket with several classes, all
    members of different classes meet as sketches of 1024 registers of 8 bits, cell by cell; every pair
    not more than 3.5 standard deviations below the threshold is verified exactly. So each pair that
    shares a bucket is decided, and one at the threshold is lost with a probability below 0.001.

    Null, empty and blank texts have no shingle: each such row is a class of its own. Texts of fewer
    than 5 words have one shingle, all their words. Of a doc_id with several texts the smallest text is
    verified, and each row takes the class of its own text. Other columns are ignored; an empty table
    gives an empty one.
    """
    base = docs.select("doc_id", "text")
    keyed = base.select("doc_id", "text", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("same"))
    sig = materialize(keyed.mapInArrow(_bands, "doc_id long, same binary, bands array<long>"), "bands")
    first = sig.where("size(bands) > 0 and doc_id is not null").groupBy("same").agg(F.min_by("bands", "doc_id").alias("bands"), F.min("doc_id").alias("doc_id"))
    keys = first.select("doc_id", F.posexplode("bands").alias("band", "key"))
    # The low four bits of a key are its band.
    keys = keys.select(F.xxhash64("band", "key").bitwiseAND(F.lit(-16).cast("long")).bitwiseOR(F.col("band").cast("long")).alias("key"), "doc_id")
    rows = materialize(_several(keys), "open", narrow=True)
    texts = materialize(base.hint("merge").join(rows.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")), "texts")

    led = rows.join(_leaders(rows), "key")
    pairs = led.select(F.col("central").alias("a"), F.col("doc_id").alias("b"), F.lit(True).alias("central"))
    pairs = pairs.union(led.where("key % 4 = 0").select("other", "doc_id", F.lit(False)))
    found = materialize(verify(pairs.where("a <> b").groupBy("a", "b").agg(F.max("central").alias("central")), texts), "found", narrow=True)
    known = components(found.where(F.col("similarity") >= threshold).select("a", "b"))

    tried = found.where("bands is not null").join(known.select(F.col("node").alias("a"), F.col("class").alias("class_a")), "a", "left").join(known.select(F.col("node").alias("b"), F.col("class").alias("class_b")), "b", "left")
    tried = materialize(tried.select("a", "b", "bands", (F.coalesce("class_a", "a") != F.coalesce("class_b", "b")).alias("apart")), "tried", narrow=True)
    # A leader that holds all of its buckets is done; from the others the held documents go on too, as links may lead from them.
    again = tried.join(tried.where("apart").select("a").distinct(), "a").select("a", F.col("b").alias("doc_id"), F.posexplode("bands").alias("band", "key"))
    finer = again.select(F.xxhash64("a", "band", "key").alias("key"), "doc_id")
    cells = materialize(_split(rows, known).unionByName(_split(finer, known)), "cells", narrow=True)
    for n in range(rounds):
        half = F.slice("reps", 1 + n * SALTS // rounds, SALTS // rounds)
        other = F.slice("center", 1 + n * SALTS // rounds, SALTS // rounds)
        pairs = cells.where(F.col("class") != F.col("main")).select(F.explode(F.arrays_zip(half.alias("a"), other.alias("b"))).alias("p"))
        pairs = pairs.select(F.least("p.a", "p.b").alias("a"), F.greatest("p.a", "p.b").alias("b")).distinct()
        more = _links(pairs, texts, threshold)
        if more.limit(1).count() == 0:
            continue
        known, merged = _joined(known, more)
        if n + 1 < rounds:
            moved = cells.join(merged, "class", "left").withColumn("class", F.coalesce("to", "class")).groupBy("key", "class").agg(F.sum("n").alias("n"), F.max_by("reps", "n").alias("reps"))
            cells = materialize(_mixed(moved), "cells", narrow=True)
    near = materialize(_rest(rows, known, texts, threshold), "near", narrow=True)
    known, _ = _joined(known, _links(near, texts, threshold))
    reps = first.select("same", F.col("doc_id").alias("rep"))
    named = reps.join(known.select(F.col("node").alias("rep"), "class"), "rep", "left").select("same", F.coalesce("class", "rep").alias("class_id"))
    out = sig.select("doc_id", "same", F.size("bands").alias("n")).join(named, "same", "left")
    out = out.select("doc_id", F.when(F.col("n") > 0, F.coalesce("class_id", "doc_id")).otherwise(F.col("doc_id")).alias("class_id"), "same")
    return out.withColumn("is_copy", F.coalesce(F.col("doc_id") != F.col("class_id"), F.lit(False)))


def drop_copies(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The rows of docs that come first in their near-duplicate class, with all columns; of equal rows one stays."""
    copies = classes(docs, threshold).where("is_copy").select("doc_id", "same").distinct()
    keyed = docs.withColumn("_same", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)))
    left = keyed.join(copies.select(F.col("doc_id").alias("_id"), F.col("same").alias("_of")), (F.col("doc_id") == F.col("_id")) & (F.col("_same") == F.col("_of")), "left_anti")
    return left.dropDuplicates(["doc_id", "_same"]).select(*docs.columns)
