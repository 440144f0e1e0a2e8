"""Benchmark decontamination: CGK embedding, repeated bit-sampling LSH, lossless filters, exact edit distance."""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkforge.llm.common import U64, Words, chunks, mix64, slices

#: Items that one pass over the documents looks for; more go in further passes.
ITEM_BLOCK = 20_000
#: A length class spans lengths up to this factor; windows of a class are as long as its shortest item.
SPAN = 1.25
REPEATS, SAMPLED = 24, 3
#: Pairs of adjacent words that one numpy step counts.
COUNTED = 1_000_000
_SKIP = np.zeros(256, bool)
_SKIP[[ord(c) for c in string.punctuation]] = True
_END = U64(0x2545F4914F6CDD1D)
_BITS = 22


def normal(texts: list[str | None]) -> Words:
    """Words in lower case without ASCII punctuation."""
    return Words([t.lower() if t else t for t in texts], _SKIP)


def allowed(n: int, share: float) -> int:
    """Word edits that an item of n words may have; items under 8 words must match exactly."""
    return int(n * share) if n >= 8 else 0


def adjacent(h: np.ndarray) -> np.ndarray:
    """Hashes of the pairs of adjacent words."""
    return mix64(h[:-1] * U64(0x9FB21C651E98DF25) + h[1:])


def pair_slot(h: np.ndarray) -> np.ndarray:
    """Table slots of the pairs of adjacent words."""
    return adjacent(h) >> U64(64 - _BITS)


def owned(pair: np.ndarray, item: np.ndarray | int) -> np.ndarray:
    """Hashes of (pair of adjacent words, item)."""
    return mix64(pair ^ mix64(np.atleast_1d(item).astype(U64) + U64(1)))


def spread(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of these sizes, one after the other: the run of each member, and its place in the run."""
    run = np.repeat(np.arange(len(size)), size)
    return run, np.arange(len(run)) - np.repeat(np.cumsum(size) - size, size)


class Index:
    """Items by length class, with the LSH tables of their embeddings. ``owners[i]``: the ids of item i's text."""

    def __init__(self, items: list[tuple[int, str]], share: float = 0.2, seed: int = 11):
        words = normal([t for _, t in items])
        distinct: dict[bytes, list] = {}
        for i, (item_id, _) in enumerate(items):
            h = words.hash[words.start[i] : words.start[i] + words.count[i]]
            if len(h):
                distinct.setdefault(h.tobytes(), [h, []])[1].append(item_id)
        order = sorted(distinct.values(), key=lambda x: (len(x[0]), min(x[1])))
        self.items, self.owners, self.share = [x[0] for x in order], [sorted(set(x[1])) for x in order], share
        self.seen = np.zeros(1 << _BITS, bool)
        for h in self.items:
            self.seen[h >> U64(64 - _BITS)] = True
        self.classes = []
        rng = np.random.default_rng(seed)
        at = 0
        while at < len(self.items):
            low = len(self.items[at])
            end = at
            while end < len(self.items) and len(self.items[end]) <= max(low, int(low * SPAN)):
                end += 1
            self.classes.append(self._tables(at, end, low, rng))
            at = end
        # Adjacent words of any item, with a bit for each length class (classes beyond 64 share bits).
        self.pairs = np.zeros(1 << _BITS, U64 if len(self.classes) > 8 else np.uint8)
        for c, k in enumerate(self.classes):
            for h in self.items[k["at"] : k["end"]]:
                self.pairs[pair_slot(h)] |= self.pairs.dtype.type(1 << c % 64)

    def _tables(self, at: int, end: int, low: int, rng) -> dict:
        walks, tables = [], []
        grid = np.stack([h[:low] for h in self.items[at:end]])
        for _ in range(REPEATS):
            coordinates = np.sort(rng.choice(2 * low, size=min(SAMPLED, 2 * low), replace=False))
            odd = rng.integers(1 << 62, size=coordinates[-1] + 1).astype(U64) * U64(2) + U64(1)
            keys = embed(grid.reshape(-1), np.arange(0, grid.size, low), np.arange(low, grid.size + 1, low), low, coordinates, odd)
            rank = np.argsort(keys, kind="stable")
            walks.append((coordinates, odd))
            tables.append((keys[rank], rank + at))
        high = len(self.items[end - 1])
        # The words that a run's first kept word can be, and the pairs of adjacent words, by item.
        heads = [np.unique(h[: allowed(len(h), self.share) + 1]) for h in self.items[at:end]]
        word, of = np.concatenate(heads), np.repeat(np.arange(at, end), [len(x) for x in heads])
        rank = np.argsort(word, kind="stable")
        pairs = np.sort(np.concatenate([owned(adjacent(self.items[i]), i) for i in range(at, end)]))
        return {"heads": (word[rank], of[rank]), "owned": pairs, "at": at, "end": end, "low": low, "high": high, "slack": allowed(high, self.share), "walks": walks, "tables": tables}


def embed(h: np.ndarray, begin: np.ndarray, stop: np.ndarray, low: int, coordinates: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """Hash of sampled coordinates of the CGK embedding of the windows h[begin : min(begin + low, stop)].

    The walk writes the symbol under its pointer at every step and moves on when a random bit of (step,
    symbol) says so; beyond the window it writes an end mark. Windows at a small edit distance write
    strings at a small Hamming distance, of which a few coordinates are compared.
    """
    pointer, edge = begin.copy(), np.minimum(begin + low, stop)
    key = np.zeros(len(begin), U64)
    wanted = set(coordinates.tolist())
    for j in range(len(odd)):
        inside = pointer < edge
        symbol = np.where(inside, h[np.minimum(pointer, len(h) - 1)], _END)
        if j in wanted:
            key = mix64(key ^ symbol)
        pointer += ((symbol * odd[j]) >> U64(63)).astype(np.int64)
    return key


def edit_distance(item: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least word edits between item and a prefix of each row of windows, and that prefix's length."""
    width = windows.shape[1]
    column = np.arange(width + 1)
    row = np.broadcast_to(column, (len(windows), width + 1)).copy()
    for i, symbol in enumerate(item):
        new = np.empty_like(row)
        new[:, 0] = i + 1
        new[:, 1:] = np.minimum(row[:, 1:] + 1, row[:, :-1] + (windows != symbol))
        row = np.minimum.accumulate(new - column, axis=1) + column
    best = row.argmin(1)
    return row[np.arange(len(row)), best], best


def search(index: Index, words: Words):
    """(text, item, start word, words, edits) of every occurrence found, the best of each text and item."""
    h, n = words.hash, len(words.hash)
    if not n:
        return
    stops = (words.start + words.count)[words.text]
    near = adjacent(h)
    pairs = np.concatenate([index.pairs[near >> U64(64 - _BITS)], np.zeros(1, index.pairs.dtype)])
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for number, c in enumerate(index.classes):
        low = c["low"]
        sums = np.concatenate([[0], np.cumsum((pairs >> pairs.dtype.type(number % 64)) & pairs.dtype.type(1), dtype=np.int32), np.zeros(low, np.int32)])
        sums[n + 1 :] = sums[n]
        # k word edits spoil at most 2 k of an item's pairs of adjacent words.
        begin = np.flatnonzero(sums[low - 1 : low - 1 + n] - sums[:n] >= low - 1 - 2 * c["slack"])
        begin = begin[index.seen[h[begin] >> U64(64 - _BITS)]]
        if not len(begin):
            continue
        met = []
        for (coordinates, odd), (keys, rank) in zip(c["walks"], c["tables"], strict=True):
            own = embed(h, begin, stops[begin], low, coordinates, odd)
            a, b = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
            hit = np.flatnonzero(b > a)
            run, offset = spread((b - a)[hit])
            met.append(np.stack([rank[a[hit][run] + offset], begin[hit][run]]))
        met = np.unique(np.concatenate(met, axis=1), axis=1)
        _verify(index, words, stops, met, best)
        for some in _in_reach(index, c, words, stops, near, begin, best):
            _verify(index, words, stops, some, best)
    for (text, item), (edits, begin, length) in best.items():
        # A run that begins with a replaced word costs as much as the one that begins at the first kept word.
        first = max(int(words.start[text]), begin - edits)
        if first < begin:
            cost, size = _distances(index.items[item], allowed(len(index.items[item]), index.share), h, stops, np.arange(first, begin))
            for i in np.flatnonzero(cost <= edits)[:1]:
                begin, length = first + int(i), int(size[i])
        yield text, item, begin - int(words.start[text]), length, edits


def _distances(symbols: np.ndarray, most: int, h: np.ndarray, stops: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """:func:`edit_distance` of an item and the windows that begin there."""
    at = begin[:, None] + np.arange(len(symbols) + most)
    return edit_distance(symbols, np.where(at < stops[begin][:, None], h[np.minimum(at, len(h) - 1)], _END))


def _verify(index: Index, words: Words, stops: np.ndarray, met: np.ndarray, best: dict) -> None:
    """Put the pairs (item, begin) of met that are within the item's edits in best, where they are better."""
    met = met[:, np.lexsort((met[1], met[0]))]
    for group in np.split(met, np.flatnonzero(np.diff(met[0])) + 1, axis=1) if met.size else ():
        item = int(group[0, 0])
        symbols = index.items[item]
        most = allowed(len(symbols), index.share)
        for s in range(0, group.shape[1], 4096):
            part = group[1, s : s + 4096]
            edits, length = _distances(symbols, most, words.hash, stops, part)
            for i in np.flatnonzero(edits <= most):
                key, found = (int(words.text[part[i]]), item), (int(edits[i]), int(part[i]), int(length[i]))
                if key not in best or found < best[key]:
                    best[key] = found


def _in_reach(index: Index, c: dict, words: Words, stops: np.ndarray, near: np.ndarray, begin: np.ndarray, best: dict):
    """All (item, begin) that may be within the item's edits and better than in best, in parts; loses nothing.

    A run within k edits can be cut at its first kept word, which is one of the item's first k + 1, at
    no more edits. Of its first n words (an item's length) then at most 2 k of the item's n - 1 pairs of
    adjacent words are missing, so the pairs found also say how many edits there are at least.
    """
    word, of = c["heads"]
    a, b = np.searchsorted(word, words.hash[begin], "left"), np.searchsorted(word, words.hash[begin], "right")
    width = np.fromiter((len(x) - 1 for x in index.items[c["at"] : c["end"]]), np.int64, c["end"] - c["at"])
    most = np.fromiter((allowed(len(x), index.share) for x in index.items[c["at"] : c["end"]]), np.int64, c["end"] - c["at"])
    ends = np.cumsum(b - a) * c["high"] // COUNTED
    for part in np.split(np.arange(len(begin)), np.flatnonzero(np.diff(ends)) + 1):
        run, offset = spread((b - a)[part])
        item, at = of[a[part][run] + offset], begin[part][run]
        if not len(item):
            continue
        size = np.minimum(width[item - c["at"]], stops[at] - 1 - at)
        pair, place = spread(size)
        key = owned(near[at[pair] + place], item[pair])
        have = c["owned"][np.minimum(np.searchsorted(c["owned"], key), len(c["owned"]) - 1)] == key if len(c["owned"]) else np.zeros(0, bool)
        least = (width[item - c["at"]] - np.bincount(pair, have, minlength=len(item)).astype(np.int64) + 1) // 2
        keep = np.flatnonzero(least <= most[item - c["at"]])
        better = [i for i in keep.tolist() if (x := best.get((int(words.text[at[i]]), int(item[i])))) is None or (least[i], at[i]) < x[:2]]
        yield np.stack([item[better], at[better]])


def _hits(index: Index):
    def run(batches):
        for batch in slices(batches):
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out = []
            for a, b in chunks(texts, 1_000_000):
                for text, item, start, length, edits in search(index, normal(texts[a:b])):
                    out += [(ids[a + text], owner, start, length, edits) for owner in index.owners[item]]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(5)], names=["doc_id", "item_id", "start_word", "n_words", "edits"])
    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = 0.2) -> DataFrame:
    """(doc_id, item_id, edits, start_word, n_words): items of benchmark(item_id, text) that documents hold.

    Words are compared in lower case and without ASCII punctuation. A document holds an item of n words
    if some run of its words is within floor(share * n) word edits of it (insert, delete, replace; none
    under 8 words); each pair is reported once, with the fewest edits and the first such run.

    Windows as long as a class of items begin at every word; a window with too few pairs of
    adjacent words of the items can't be within reach and is skipped, which loses nothing. The others are embedded by CGK
    walks, 24 times, and meet the items on 3 sampled coordinates; candidates are verified by the exact
    edit distance. Walks miss some, above all of long items; so all other windows with enough of an
    item's own pairs of adjacent words to be within reach, and to be better than what the walks found,
    are verified too. The result is exact. The items, not the documents, travel: in passes of 20,000
    items at most.

    Null, empty or wordless items and texts match nothing. Repeated rows count once. A null doc_id is
    reported as null. Other columns are ignored; if either table is empty, so is the result.
    """
    spark = docs.sparkSession
    passes = -(-benchmark.count() // ITEM_BLOCK)
    out = spark.createDataFrame([], "doc_id long, item_id long, start_word long, n_words long, edits long")
    for k in range(passes):
        own = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k).select("item_id", "text")
        index = Index([(r.item_id, r.text) for r in own.toLocalIterator()], share)
        if index.items:
            out = out.union(docs.select("doc_id", "text").mapInArrow(_hits(index), out.schema))
    first = F.min(F.struct("edits", "start_word", "n_words")).alias("x")
    return out.groupBy("doc_id", "item_id").agg(first).select("doc_id", "item_id", "x.edits", "x.start_word", "x.n_words")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, share: float = 0.2) -> DataFrame:
    """The rows of docs that hold no benchmark item, with all columns."""
    dirty = contaminated(docs, benchmark, share).select("doc_id").distinct()
    return docs.join(dirty, "doc_id", "left_anti").select(*docs.columns)
