"""Document fingerprints by I-Match with randomised lexicon subsets, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkforge.llm.common import WORD, materialize

#: Terms in more than a LOW-th of all documents say little; below a HIGH-th the lexicon would grow with the corpus.
MOST_SHARE, LEAST_SHARE = 0.2, 0.001
#: A subset keeps one in 2**k lexicon terms; subsets of several widths suit short and long texts.
WIDTHS, SEEDS = (2, 3, 4, 5, 6, 7, 8, 9), 4
#: Ids of one block of the order; bounds what a window holds.
BLOCK = 512


def terms(text: Column) -> Column:
    """Distinct 64-bit term hashes of the words of a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, most: float = MOST_SHARE, least: float = LEAST_SHARE) -> DataFrame:
    """(term): hashes of the words of docs(text) whose share of documents lies in [least, most].

    The inverse document frequency band is [ln 1/most, ln 1/least]. Frequencies are counted over all
    documents, in the map tasks first. As a share is of all documents, there are at most
    (mean distinct words a document) / least terms at any corpus size.
    """
    counted = docs.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    n = docs.count()
    return counted.where((F.col("n") >= max(2.0, least * n)) & (F.col("n") <= most * n)).select("term")


def lookup(words: DataFrame) -> tuple[DataFrame, int]:
    """One row (table), and bits: the terms of words(term) in 2**bits lists by their first bits, at about one term a list.

    It goes to every task as a value of the query, and a term is looked up there in constant time.
    The lexicon's bound (see :func:`lexicon`) is its bound, at some 32 bytes a term.
    """
    bits = max(1, min(24, words.count().bit_length()))
    place = F.shiftrightunsigned("term", 64 - bits).cast("int")
    held = words.groupBy(place.alias("place")).agg(F.collect_list("term").alias("terms"))
    every = words.sparkSession.range(1 << bits).select(F.col("id").cast("int").alias("place")).join(held, "place", "left")
    every = every.select("place", F.coalesce("terms", F.array().cast("array<long>")).alias("terms"))
    table = F.array_sort(F.collect_list(F.struct("place", "terms")))
    return every.agg(F.transform(table, lambda x: x["terms"]).alias("table")), bits


def found(text: Column, table: Column, bits: int) -> Column:
    """The distinct terms of a text that the table of :func:`lookup` holds, sorted."""
    words = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))
    held = F.filter(words, lambda t: F.array_contains(F.element_at(table, F.shiftrightunsigned(t, 64 - bits).cast("int") + 1), t))
    return F.sort_array(F.array_distinct(held))


def edited(text: Column, next_text: Column) -> Column:
    """text whose last floor(n/2) code points give way to the first as many of next_text (or all)."""
    text, next_text = F.coalesce(text, F.lit("")), F.coalesce(next_text, F.lit(""))
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(next_text, F.lit(1), half))


def whole_hash(text: Column) -> Column:
    return F.when(F.length(text) > 0, F.xxhash64(text)).otherwise(F.lit(0).cast("long"))


def subset_hashes(df: DataFrame, terms: str, whole: Column, out: str) -> DataFrame:
    """df with a column ``out``: an array of one hash per lexicon subset over the sorted lexicon terms, 0 where a subset holds none.

    A subset of width w keeps the terms of which w bits of a seeded hash are 0; each width has its own
    bits. A text with no lexicon term at all has the hash of the text itself, ``whole``, in every place.
    """
    def seeded(seed: int) -> Column:
        return F.transform(terms, lambda t: F.xxhash64(t, F.lit(seed)))

    names = {s: f"_{out}_{s}" for s in range(SEEDS)}
    df = df.withColumns({names[s]: seeded(s) for s in names})

    def one(width: int, seed: int) -> Column:
        bits = ((1 << width) - 1) << sum(w for w in WIDTHS if w < width)
        kept = F.filter(names[seed], lambda h: h.bitwiseAND(F.lit(bits)) == 0)
        return F.xxhash64(kept)

    none = F.xxhash64(F.array().cast("array<long>"))
    hashes = [F.coalesce(F.nullif(one(w, s), none), F.lit(0).cast("long")) for w in WIDTHS for s in range(SEEDS)]
    every = F.when(F.size(terms) > 0, F.array(*hashes)).otherwise(F.array_repeat(whole, len(hashes)))
    return df.withColumn(out, every).drop(*names.values())


def likeness(a: Column, b: Column) -> Column:
    """Share of lexicon subsets, of those that hold terms of either text, on which two fingerprints agree."""
    both = F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    used = F.filter(both, lambda p: (p["x"] != 0) | (p["y"] != 0))
    same = F.filter(used, lambda p: p["x"] == p["y"])
    return F.when(F.size(used) > 0, F.size(same) / F.size(used)).otherwise(F.lit(1.0)).cast("double")


def spelled(subsets: Column) -> Column:
    return F.array_join(F.transform(subsets, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def _with_subsets(df: DataFrame, words: DataFrame, texts: dict[str, Column]) -> DataFrame:
    """df with a column of subset hashes for each text."""
    table, bits = lookup(words)
    for c, t in texts.items():
        # Used once, so that the optimizer puts the table's value where it is used: it is no column of any row.
        df = df.withColumn("_table", table.scalar()).withColumn("_found", found(t, F.col("_table"), bits)).drop("_table")
        df = subset_hashes(df, "_found", whole_hash(t), c).drop("_found")
    return df


def fingerprints(docs: DataFrame, text: str = "text", known: DataFrame | None = None) -> DataFrame:
    """docs with ``subsets`` and ``fingerprint`` of a text column: I-Match over the lexicon of docs, or a given one.

    Keeps the distinct terms of the lexicon's inverse-document-frequency band, sorts them and hashes
    those in each of 32 randomised lexicon subsets. Equal texts have equal fingerprints. Null and empty
    texts have subsets of zeros. Empty: empty; other columns pass through.
    """
    words = known if known is not None else materialize(lexicon(docs.select(F.col(text).alias("text"))), "lexicon", narrow=True)
    out = _with_subsets(docs, words, {"subsets": F.coalesce(F.col(text), F.lit(""))})
    return out.withColumn("fingerprint", spelled(F.col("subsets")))


def _blocks(docs: DataFrame) -> DataFrame:
    """(block, doc_id, text): blocks of BLOCK consecutive ids, or of more where ids are sparse, so that there are at most as many as there are BLOCKs of rows, and one more."""
    span = docs.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("doc_id").alias("n")).first()
    wide = BLOCK if not span.n else max(BLOCK, -(-(span.high - span.low + 1) // max(1, span.n // BLOCK)))
    # Halves keep the difference of any two ids inside 64 bits.
    half = min(max(1, wide // 2), 2**63 - 1)
    block = F.expr(f"(doc_id div 2 - {(span.low or 0) // 2}) div {half}")
    return docs.select(F.coalesce(block, F.lit(-1).cast("long")).alias("block"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))


def _under(rows: DataFrame, words: DataFrame) -> DataFrame:
    """(block, under_text, under_subsets): the largest document of the next smaller block, round to the largest of all.

    The blocks' order comes from their numbers alone, in windows of 4,096 blocks and over those windows.
    """
    best = F.max(F.struct("doc_id", "text")).alias("best")
    tops = rows.groupBy("block").agg(best).select("block", F.col("best.text").alias("text"))
    tops = materialize(_with_subsets(tops, words, {"subsets": F.col("text")}).select("block", F.struct("text", "subsets").alias("top")), "tops")
    near = tops.select("block", F.floor(F.col("block") / 4096).alias("set"))
    order = Window.orderBy("set")
    sets = near.groupBy("set").agg(F.max("block").alias("last"))
    sets = sets.select("set", F.coalesce(F.lag("last").over(order), F.max("last").over(Window.partitionBy())).alias("before"))
    near = near.withColumn("under", F.lag("block").over(Window.partitionBy("set").orderBy("block"))).join(sets, "set")
    near = near.select("block", F.coalesce("under", "before").alias("under"))
    met = near.join(tops.select(F.col("block").alias("under"), "top"), "under")
    return met.select("block", F.col("top.text").alias("under_text"), F.col("top.subsets").alias("under_subsets"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Per row of docs(doc_id, text): its fingerprint, its edited text's, and two likenesses.

    The edited text gives up its last floor(n/2) code points for the first as many of the next
    document, by descending doc_id (rows of one doc_id: by descending text; after the last: the first).
    near_edited is the likeness of the fingerprint to the edited text's, near_next to the next
    document's. Null text counts as empty; rows with a null doc_id are a block of their own and come last.

    Ids fall in blocks, so a window holds one block of texts; only the largest document of each block is
    carried to the next block. Texts move once, to their block; their terms meet the lexicon in place,
    in a table that every task holds, and only the subsets' hashes go on.
    """
    words = materialize(lexicon(docs), "lexicon", narrow=True)
    rows = _blocks(docs)
    under = _under(rows, words)
    order = Window.partitionBy("block").orderBy(F.col("doc_id").desc(), F.col("text").desc())
    rows = rows.withColumn("place", F.row_number().over(order)).withColumn("next_text", F.lead("text").over(order))
    rows = rows.join(under, "block")
    rows = rows.withColumn("edited", edited(F.col("text"), F.coalesce("next_text", "under_text")))
    rows = rows.select("block", "place", "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "under_subsets", "text", "edited")
    out = _with_subsets(rows, words, {"own": F.col("text"), "changed": F.col("edited")}).drop("text", "edited")
    after = F.lead("own").over(Window.partitionBy("block").orderBy("place"))
    out = out.withColumn("after", F.coalesce(after, "under_subsets"))
    return out.select(
        "doc_id", "n_chars", "edited_sha256",
        spelled(F.col("own")).alias("fingerprint"),
        spelled(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("after")).alias("near_next"),
    )
