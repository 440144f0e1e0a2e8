"""Language identification by bit-sliced Bloom filters over character n-grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkforge.llm.common import U64, chunks, mix64, slices as parts

GRAMS = (3, 4)
#: Training rows a language has at most, about: the bound of the sample that the filters are learned from.
SAMPLE_ROWS = 4000
#: Share of a language's training rows in which an n-gram must stand to enter its filter.
LEAST_SHARE = 0.05
SLOT_BITS, HASHES = 21, 2
#: Languages in one set of masks; more take further sets.
WORD_LANGUAGES = 64
UNKNOWN = "und"
#: Characters that one numpy step holds; it needs some 150 bytes for each.
CHUNK_CHARS = 500_000

_LETTER: list[np.ndarray] = []


def letters() -> np.ndarray:
    """True at the code points that are letters."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


class Grams:
    """Hashes of the n-grams of lower-case letters and word edges of a few texts, with the text of each."""

    def __init__(self, texts: list[str | None]):
        low = [(t or "").lower() for t in texts]
        code = np.frombuffer((" " + " ".join(low) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in low), np.int64, len(low)))
        letter = letters()[code]
        self.has_letter = np.zeros(len(texts), bool)
        # Runs of other characters become one edge mark.
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        if len(keep):
            keep[0] = True
        at = np.flatnonzero(keep)
        symbol = np.where(letter[at], code[at], 0).astype(U64)
        text = np.searchsorted(ends, at - 1, "right")
        self.has_letter[text[letter[at]]] = True
        hashes, texts_of = [], []
        for n in GRAMS:
            if len(symbol) < n:
                continue
            h = np.zeros(len(symbol) - n + 1, U64)
            inner = np.ones(len(h), bool)
            for j in range(n):
                part = symbol[j : j + len(h)]
                h = h * U64(0x100000001B3) + part
                if 0 < j < n - 1:
                    inner &= part > 0
            pick = np.flatnonzero(inner)
            hashes.append(mix64(h[pick] + U64(n * 0x9E3779B97F4A7C15 % (1 << 64))))
            texts_of.append(text[pick + 1])
        self.hash = np.concatenate(hashes) if hashes else np.empty(0, U64)
        self.text = np.concatenate(texts_of) if texts_of else np.empty(0, np.int64)
        self.text = np.minimum(self.text, max(0, len(texts) - 1))


def slots(h: np.ndarray) -> list[np.ndarray]:
    """The Bloom filter slots of n-gram hashes."""
    return [(h >> U64(64 - SLOT_BITS - 21 * i)) & U64((1 << SLOT_BITS) - 1) for i in range(HASHES)]


@dataclass
class Filters:
    """One Bloom filter per language, sliced by bit: masks[w, slot] has bit l set where language 64 w + l has the slot."""

    languages: list[str]
    masks: np.ndarray

    def false_rate(self) -> np.ndarray:
        """Chance that a language's filter claims an n-gram it does not hold."""
        one = self.masks.dtype.type(1)
        fill = [float(((self.masks[i // WORD_LANGUAGES] >> self.masks.dtype.type(i % WORD_LANGUAGES)) & one).mean()) for i in range(len(self.languages))]
        return np.array(fill) ** HASHES

    def found(self, h: np.ndarray, word: int = 0) -> np.ndarray:
        """Bitmask of the languages of a set that contain each n-gram: one lookup for all of them."""
        first, *others = slots(h)
        mask = self.masks[word][first]
        for s in others:
            mask = mask & self.masks[word][s]
        return mask

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        grams = Grams(texts)
        n = np.bincount(grams.text, minlength=len(texts)).astype(float)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        best, most = np.zeros(len(texts), np.int64), np.full(len(texts), -1.0)
        for i, f in enumerate(self.false_rate()):
            if i % WORD_LANGUAGES == 0:
                mask = self.found(grams.hash, i // WORD_LANGUAGES)
            hits = np.bincount(grams.text, ((mask >> mask.dtype.type(i % WORD_LANGUAGES)) & mask.dtype.type(1)).astype(float), minlength=len(texts))
            share = np.clip((hits - f * n) / np.maximum(1.0, n * (1 - f)), 0, 1)
            better = share > most
            best[better], most[better] = i, share[better]
        known = grams.has_letter
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist(), strict=True)], np.where(known, most, 0.0)


def held_out():
    """Documents kept from training: crc32 of the id's digits, modulo 3, is 1 (a null id: not)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _gram_counts(batches):
    for batch in parts(batches):
        langs, texts = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_pylist()
        for a, b in chunks(texts, CHUNK_CHARS):
            grams = Grams(texts[a:b])
            names, code = np.unique(langs[a:b].astype(str), return_inverse=True)
            order = np.lexsort((grams.hash, grams.text))
            text, h = grams.text[order], grams.hash[order]
            new = np.ones(len(h), bool)
            new[1:] = (text[1:] != text[:-1]) | (h[1:] != h[:-1])
            lang, h = code[text[new]], h[new]
            order = np.lexsort((h, lang))
            lang, h = lang[order], h[order]
            heads = np.flatnonzero(np.concatenate([[True], (lang[1:] != lang[:-1]) | (h[1:] != h[:-1])])) if len(h) else np.empty(0, int)
            yield pa.RecordBatch.from_arrays([pa.array(names[lang[heads]].tolist(), pa.string()), pa.array(h[heads].view(np.int64)), pa.array(np.diff(np.append(heads, len(h))), pa.int64())], names=["lang", "gram", "n"])


def _slices(names: list[str], dtype: str):
    """(set, masks) of the languages in the batches."""
    def run(batches):
        masks: dict[int, np.ndarray] = {}
        number = {x: i for i, x in enumerate(names)}
        for batch in batches:
            of = np.array([number[x] for x in batch.column(0).to_pylist()], np.int64)
            h = np.asarray(batch.column(1).to_numpy(zero_copy_only=False)).view(U64)
            for word in np.unique(of // WORD_LANGUAGES).tolist():
                own = of // WORD_LANGUAGES == word
                bit = (U64(1) << (of[own] % WORD_LANGUAGES).astype(U64)).astype(dtype)
                for s in slots(h[own]):
                    np.bitwise_or.at(masks.setdefault(word, np.zeros(1 << SLOT_BITS, dtype)), s.astype(np.int64), bit)
        for word, mask in masks.items():
            yield pa.RecordBatch.from_arrays([pa.array([word], pa.int32()), pa.array([mask.tobytes()], pa.binary())], names=["word", "masks"])
    return run


def learn(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, least_share: float = LEAST_SHARE) -> Filters:
    """Filters from the labelled rows (lang not null, not held out) of docs(doc_id, text, lang).

    About ``sample_rows`` rows a language are taken, by a hash of the id; that is the only bound on the
    input. An n-gram enters a language's filter if it stands in ``least_share`` of its sample, twice at
    least. The filters have a fixed size (2**21 slots) and come to the driver as one slice a task for
    each 64 languages; their number has no limit, but every 64 take 16 MB in the driver and each worker.
    """
    rows = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    names = sorted(sizes)
    if not names:
        return Filters([], np.zeros((1, 1 << SLOT_BITS), np.uint8))
    scale = 1 << 30
    keep = F.create_map(*[F.lit(x) for k in names for x in (k, min(scale, int(scale * sample_rows / sizes[k]) + 1))])
    sample = rows.where(F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(scale)) < F.try_element_at(keep, F.col("lang")))
    taken = {r.lang: r.n for r in sample.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    least = F.create_map(*[F.lit(x) for k in names for x in (k, max(2, int(least_share * taken.get(k, 0))))])
    grams = sample.select("lang", "text").mapInArrow(_gram_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    grams = grams.where(F.col("n") >= F.try_element_at(least, F.col("lang"))).select("lang", "gram").coalesce(8)
    dtype = "u1" if len(names) <= 8 else "u8"
    masks = np.zeros((-(-len(names) // WORD_LANGUAGES), 1 << SLOT_BITS), dtype)
    for r in grams.mapInArrow(_slices(names, dtype), "word int, masks binary").toLocalIterator():
        masks[r.word] |= np.frombuffer(r.masks, dtype)
    return Filters(names, masks)


def _predictions(filters: Filters):
    def run(batches):
        for batch in parts(batches):
            texts = batch.column(1).to_pylist()
            for a, b in chunks(texts, CHUNK_CHARS):
                lang, score = filters.predict(texts[a:b])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])
    return run


def identify(docs: DataFrame, filters: Filters) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of docs(doc_id, text, ...).

    One lookup of an n-gram gives a bitmask of all languages that hold it. score is the share of the
    text's n-grams that the best language's filter holds, less those that it claims by mistake; ties go
    to the language that sorts first. Null texts and texts without a letter are ``und`` with score 0.
    Only the text decides. Empty: empty; rows that repeat, repeat.
    """
    return docs.select("doc_id", "text", held_out().alias("held_out")).mapInArrow(_predictions(filters), "doc_id long, held_out boolean, lang_pred string, score double")


def _accepted(filters: Filters, names: list[str], at: int, least: float):
    def run(batches):
        for batch in parts(batches):
            texts = batch.column(at).to_pylist()
            keep = []
            for a, b in chunks(texts, CHUNK_CHARS):
                lang, score = filters.predict(texts[a:b])
                keep += [x != UNKNOWN and s >= least for x, s in zip(lang, score.tolist(), strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_()))
    return run


def drop_unknown(docs: DataFrame, filters: Filters, least: float = 0.2) -> DataFrame:
    """The rows of docs whose text is in a learned language with a score of ``least`` or more, with all columns."""
    return docs.mapInArrow(_accepted(filters, docs.columns, docs.columns.index("text"), least), docs.schema)
