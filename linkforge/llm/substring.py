"""Removal of repeated passages: fixed-block anchors, rolling probes, extension to exact windows."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkforge.llm.common import U64, Words, chunks, materialize, mix64, partitions, slices

WINDOW = 50
#: Every window of 50 words holds a whole reference block of 25, wherever blocks begin.
BLOCK = 25
#: Entries that a bucket task gathers before it compacts them; it waits until they are as many as those it keeps.
GATHER = 1_000_000
#: UTF-8 bytes of text whose windows make up a bucket, about: two million entries or so, whatever the size of the input.
BUCKET_BYTES = 8_000_000
#: Two 64-bit halves of a digest; numpy sorts and compares them as one value.
DIGEST = np.dtype([("high", "<u8"), ("low", "<u8")])
_ENTRIES = "bucket int, docs binary, counts binary, keys binary, marks binary"


def _pack(doc_ids: np.ndarray, text: np.ndarray, bucket: np.ndarray, key: np.ndarray, mark: np.ndarray | None):
    """One Arrow batch with a row per bucket: the ids present, entries of each, their keys and marks, without repeats."""
    order = np.lexsort((key, text, bucket)) if key.dtype != DIGEST else np.lexsort((key["low"], key["high"], text, bucket))
    bucket, text, key = bucket[order], text[order], key[order]
    new = np.ones(len(key), bool)
    new[1:] = (bucket[1:] != bucket[:-1]) | (text[1:] != text[:-1]) | (key[1:] != key[:-1])
    first = np.flatnonzero(new)
    marks = np.logical_or.reduceat(mark[order], first) if mark is not None and len(first) else np.zeros(len(first), bool)
    bucket, text, key = bucket[first], text[first], key[first]
    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.empty(0, int)
    rows = {c: [] for c in ("bucket", "docs", "counts", "keys", "marks")}
    for a, b in zip(cut, [*cut[1:], len(bucket)], strict=False):
        t = text[a:b]
        heads = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        rows["bucket"].append(int(bucket[a]))
        rows["docs"].append(doc_ids[t[heads]].astype("<i8").tobytes())
        rows["counts"].append(np.diff(np.append(heads, b - a)).astype("<u4").tobytes())
        rows["keys"].append(key[a:b].tobytes())
        rows["marks"].append(np.packbits(marks[a:b]).tobytes() if mark is not None else b"")
    return pa.RecordBatch.from_arrays([pa.array(rows["bucket"], pa.int32()), *(pa.array(rows[c], pa.binary()) for c in ("docs", "counts", "keys", "marks"))], names=list(rows))


def _parts(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    return ((h >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64), h.astype(np.uint32)


def _probes(buckets: int):
    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            texts = batch.column(1).to_pylist()
            for a, b in chunks(texts):
                words = Words(texts[a:b])
                h, at = words.windows(BLOCK)
                text = words.text[at]
                bucket, low = _parts(h, buckets)
                yield _pack(ids[a:b], text, bucket, low, (at - words.start[text]) % BLOCK == 0)
    return run


def _entries(batch: pa.RecordBatch, i: int, dtype):
    docs, counts, keys, marks = (batch.column(c)[i].as_py() for c in range(1, 5))
    key = np.frombuffer(keys, dtype)
    doc = np.repeat(np.frombuffer(docs, "<i8"), np.frombuffer(counts, "<u4"))
    mark = np.unpackbits(np.frombuffer(marks, np.uint8))[: len(key)].astype(bool) if marks else np.zeros(len(key), bool)
    return key, doc, mark


def _told(doc: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
    """(doc_id, found): for each document the values, as one binary."""
    order = np.argsort(doc, kind="stable")
    doc, value = doc[order], value[order]
    heads = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.empty(0, int)
    found = [value[a:b].tobytes() for a, b in zip(heads, [*heads[1:], len(doc)], strict=False)]
    return pa.RecordBatch.from_arrays([pa.array(doc[heads], pa.int64()), pa.array(found, pa.binary())], names=["doc_id", "found"])


def _by_bucket(compact, dtype):
    """A mapInArrow function over rows sorted by bucket: gathers entries and compacts them, never a whole hot key."""
    def run(batches):
        now, kept, size, held = None, [], 0, 0
        for batch in batches:
            for i, bucket in enumerate(batch.column(0).to_pylist()):
                if kept and (bucket != now or size > max(GATHER, held)):
                    out, rest = compact(now, *(np.concatenate(x) for x in zip(*kept, strict=True)))
                    if len(out[0]):
                        yield _told(*out)
                    kept, size, held = ([rest], 0, len(rest[0])) if bucket == now else ([], 0, 0)
                now = bucket
                kept.append(_entries(batch, i, dtype))
                size += len(kept[-1][0])
        if kept:
            out, _ = compact(now, *(np.concatenate(x) for x in zip(*kept, strict=True)))
            if len(out[0]):
                yield _told(*out)
    return run


_TOLD = np.iinfo(np.int64).min


def _shared(bucket, key, doc, mark):
    """Reference blocks whose key stands in another document too are hits.

    A window that two documents share holds a block of either of them, and each learns of its own.

    Of a key with hits one entry stays, under the id _TOLD, so that later entries of it are hits at once.
    """
    order = np.lexsort((doc, key))
    key, doc, mark = key[order], doc[order], mark[order]
    heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    group = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(key))))
    last = np.append(heads[1:], len(key)) - 1
    hit = (doc[heads] == _TOLD) | ((doc[heads] != doc[last]) & np.logical_or.reduceat(mark, heads))
    out = hit[group] & mark & (doc != _TOLD)
    value = key[out].astype(np.int64) | (np.int64(bucket) << np.int64(32))
    stay = ~hit[group]
    told = key[heads[hit]]
    return (doc[out], value), (np.concatenate([key[stay], told]), np.concatenate([doc[stay], np.full(len(told), _TOLD)]), np.concatenate([mark[stay], np.ones(len(told), bool)]))


def _later(bucket, key, doc, mark):
    """All entries but those of each key's smallest document, which alone stays."""
    order = np.lexsort((doc, key["low"], key["high"]))
    key, doc, mark = key[order], doc[order], mark[order]
    heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    least = np.repeat(doc[heads], np.diff(np.append(heads, len(key))))
    out = doc > least
    return (doc[out], key[out]), (key[heads], doc[heads], mark[heads])


def _digests(words: list[bytes], first: np.ndarray) -> np.ndarray:
    """128-bit digests of the windows of words that begin there: of the words themselves, joined by one space."""
    told = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter((len(w) + 1 for w in words), np.int64, len(words))) - 1
    starts = np.append(0, ends[:-1] + 1)
    each = [hashlib.blake2b(told[a:b], digest_size=16).digest() for a, b in zip(starts[first].tolist(), ends[first + WINDOW - 1].tolist(), strict=True)]
    return np.frombuffer(b"".join(each), DIGEST)


def _kept(words: list[bytes], removed: np.ndarray | None) -> tuple[int, int, str]:
    left = words if removed is None else [w for w, r in zip(words, removed.tolist(), strict=True) if not r]
    return len(words), len(words) - len(left), hashlib.sha256(b" ".join(left)).hexdigest()


def _raw(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def _runs(buckets: int):
    """Documents without a hit are done; of the others, the runs of windows that hold a hit are kept with the text."""
    def run(batches):
        for batch in batches:
            texts, founds = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            out = {c: [] for c in ("n", "sha", "text", "runs")}
            for text, found in zip(texts, founds, strict=True):
                runs = []
                if found:
                    words = Words([text])
                    h, at = words.windows(BLOCK)
                    bucket, low = _parts(h, buckets)
                    own = at % BLOCK == 0
                    hits = at[own][np.isin((low.astype(np.int64) | (bucket << 32))[own], np.frombuffer(b"".join(found), "<i8"))]
                    last = len(words.hash) - WINDOW
                    if len(hits) and last >= 0:
                        near = np.zeros(last + 2, np.int64)
                        np.add.at(near, np.clip(hits - (WINDOW - BLOCK), 0, last + 1), 1)
                        np.add.at(near, np.clip(hits + 1, 0, last + 1), -1)
                        on = np.concatenate([[0], (np.cumsum(near[:-1]) > 0).astype(np.int8), [0]])
                        edge = np.flatnonzero(np.diff(on))
                        runs = edge.tolist()
                n, _, sha = _kept(_raw(text), None) if not runs else (0, 0, None)
                out["n"].append(n)
                out["sha"].append(sha)
                out["text"].append(text if runs else None)
                out["runs"].append(runs)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out["n"], pa.int64()), pa.array(out["sha"], pa.string()), pa.array(out["text"], pa.string()), pa.array(out["runs"], pa.list_(pa.int32()))], names=["doc_id", "n_words", "kept_sha256", "text", "runs"])
    return run


def _in_runs(runs: list[int], n: int) -> np.ndarray:
    on = np.zeros(n + 1, np.int64)
    on[runs[0::2]] += 1
    on[runs[1::2]] -= 1
    return np.flatnonzero(np.cumsum(on)[:n])


def _anchors(text: str, first: np.ndarray) -> np.ndarray:
    """For each window that begins there the least hash of the 25-word runs in it.

    Equal windows have equal anchors, and so have most windows that follow one another: a document's
    windows go to few buckets, and what is found of them comes back in few rows, however many buckets there are.
    """
    h, _ = Words([text]).windows(BLOCK)
    return mix64(np.lib.stride_tricks.sliding_window_view(h, WINDOW - BLOCK + 1).min(1)[first]) if len(first) else np.empty(0, U64)


def _windows(buckets: int):
    def run(batches):
        for batch in slices(batches, 64):
            ids, texts, runs = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for a, b in chunks(texts):
                key, text, anchor = [np.empty(0, DIGEST)], [np.empty(0, np.int64)], [np.empty(0, U64)]
                for i in range(a, b):
                    words = _raw(texts[i])
                    first = _in_runs(runs[i], len(words))
                    key.append(_digests(words, first))
                    anchor.append(_anchors(texts[i], first))
                    text.append(np.full(len(key[-1]), i - a))
                yield _pack(ids[a:b], np.concatenate(text), _parts(np.concatenate(anchor), buckets)[0], np.concatenate(key), None)
    return run


def _cut(batches):
    for batch in slices(batches, 64):
        texts, runs, founds = (batch.column(c).to_pylist() for c in (1, 2, 3))
        out, texts_out = [], []
        for text, run, found in zip(texts, runs, founds, strict=True):
            words = _raw(text)
            covered = np.zeros(len(words) + 1, np.int64)
            if found:
                first = _in_runs(run, len(words))
                seen = set(np.frombuffer(b"".join(found), "V16").tolist())
                gone = first[np.fromiter((x in seen for x in _digests(words, first).view("V16").tolist()), bool, len(first))]
                np.add.at(covered, gone, 1)
                np.add.at(covered, gone + WINDOW, -1)
            removed = np.cumsum(covered)[:-1] > 0
            out.append(_kept(words, removed))
            texts_out.append(b" ".join(w for w, r in zip(words, removed.tolist(), strict=True) if not r).decode("utf-8", "surrogatepass"))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.string()), pa.array(texts_out, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])


def _dealt(entries: DataFrame, buckets: int, compact, dtype) -> DataFrame:
    by_bucket = entries.repartition(min(buckets, max(partitions(entries.sparkSession), buckets // 16)), "bucket").sortWithinPartitions("bucket")
    return by_bucket.mapInArrow(_by_bucket(compact, dtype), "doc_id long, found binary")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per row of docs(doc_id, text, ...): doc_id, n_words, n_removed, kept_sha256, kept.

    A window is 50 consecutive words of one document. A word goes if a window that covers it also
    starts in a document with a smaller doc_id. ``kept`` is the text of what is left, words joined by
    one space, for documents that lose words, else null (all words stay).

    1. Index: the non-overlapping blocks of 25 words of each document. Probe: every rolling 25 words.
       Both meet by hash in buckets as packed arrays, each hash once per document; a block whose hash
       stands in another document too is a hit.
    2. Each document extends its hits to runs of windows of 50 words; documents without hits are done.
    3. The windows of the runs, which are the repeats at full length, meet by a 128-bit digest of their
       words (blake2b, not the hash that chose the candidates), in buckets by an anchor in the window; all but those of the smallest document
       go back to their documents, which drop the covered words.

    A bucket task keeps one entry of a hash that many documents share, and no pairs are formed. Buckets
    are as many as the bytes of text ask for, so a task's memory is the same at every size, and time is
    in proportion however many documents share a passage. A document's hits come back in one row from
    each bucket that has some, at most one for each 25 words and one for each anchor. Null and empty texts have no
    words. Rows of one doc_id are one document to others, and each row is cut by itself; rows with a
    null doc_id neither lose words nor make others lose any. Other columns are ignored; empty: empty.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(min(1 << 31, max(16, size // BUCKET_BYTES)))
    base = docs.select("doc_id", "text")
    known = base.where("doc_id is not null")
    hits = _dealt(known.mapInArrow(_probes(buckets), _ENTRIES), buckets, _shared, "<u4")
    hits = materialize(hits.groupBy("doc_id").agg(F.collect_list("found").alias("found")), "hits")
    runs = materialize(base.join(hits, "doc_id", "left").select("doc_id", "text", "found").mapInArrow(_runs(buckets), "doc_id long, n_words long, kept_sha256 string, text string, runs array<int>"), "runs")
    open_ = runs.where("size(runs) > 0").select("doc_id", "text", "runs")
    gone = _dealt(open_.mapInArrow(_windows(buckets), _ENTRIES), buckets, _later, DIGEST).groupBy("doc_id").agg(F.collect_list("found").alias("found"))
    cut = open_.join(gone, "doc_id", "left").select("doc_id", "text", "runs", "found").mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
    whole = runs.where("size(runs) = 0").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256", F.lit(None).cast("string").alias("kept"))
    return whole.unionByName(cut)
