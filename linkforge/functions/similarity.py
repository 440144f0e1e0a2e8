"""Similarity features of record pairs: one projection of built-in expressions, two Arrow UDFs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from linkforge.functions.text import compact, grams, has_devanagari, has_non_ascii, tokens


#: Cells of one side's character table that one numpy step holds.
CELLS = 2_000_000


def _tables(a: list[str], b: list[str]):
    """Parts (rows, codes of a, lengths, codes of b, lengths) of pairs of non-empty strings, of similar lengths; 0 and -1 fill up."""
    size = [(max(len(x), len(y)), i) for i, (x, y) in enumerate(zip(a, b, strict=True)) if x and y]
    size.sort()
    at = 0
    while at < len(size):
        end = at + 1
        while end < len(size) and size[end][0] * (end + 1 - at) <= CELLS:
            end += 1
        rows = np.array([i for _, i in size[at:end]])
        out = []
        for side, fill in ((a, 0), (b, -1)):
            texts = [side[i] for i in rows]
            n = np.array([len(x) for x in texts])
            codes = np.full((len(rows), n.max()), fill, np.int32)
            codes[np.arange(n.max()) < n[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.int32)
            out += [codes, n]
        yield rows, *out
        at = end


def jaro_winklers(a: list[str], b: list[str]) -> np.ndarray:
    """Jaro similarity of a[i] and b[i], raised by up to four common first characters where it is over 0.7; 0 where one is empty."""
    result = np.zeros(len(a))
    for rows, left, n, right, m in _tables(a, b):
        reach = np.maximum(0, np.maximum(n, m) // 2 - 1)
        place = np.arange(right.shape[1])
        free = place < m[:, None]
        matched = np.zeros(left.shape, bool)
        every = np.arange(len(rows))
        for i in range(left.shape[1]):  # each character takes the first free equal one within reach
            fits = free & (right == left[:, i : i + 1]) & (np.abs(place - i) <= reach[:, None]) & (i < n)[:, None]
            first = fits.argmax(1)
            hit = fits[every, first]
            matched[:, i] = hit
            free[every[hit], first[hit]] = False
        taken = ~free & (place < m[:, None])
        common = matched.sum(1)
        # The matched characters of both sides in their order, one list after another, are equally many.
        apart = np.bincount(np.repeat(every, common), left[matched] != right[taken], minlength=len(rows)).astype(np.int64) // 2
        some = np.maximum(common, 1)
        jaro = np.where(common > 0, (common / n + common / m + (common - apart) / some) / 3, 0.0)
        k = min(4, left.shape[1], right.shape[1])
        alike = np.minimum.accumulate((left[:, :k] == right[:, :k]) & (np.arange(k) < np.minimum(n, m)[:, None]), axis=1).sum(1)
        result[rows] = np.where(jaro > 0.7, jaro + 0.1 * alike * (1 - jaro), jaro)
    return result


def indels(a: list[str], b: list[str]) -> np.ndarray:
    """2 LCS / (|a| + |b|) of a[i] and b[i]; 0 where one is empty."""
    result = np.zeros(len(a))
    for rows, left, n, right, m in _tables(a, b):
        best = np.zeros((len(rows), right.shape[1] + 1), np.int32)
        for i in range(left.shape[1]):  # beyond its end a row of left equals nothing, so best stays
            equal = (right == left[:, i : i + 1]) & (i < n)[:, None]
            best[:, 1:] = np.maximum.accumulate(np.maximum(best[:, 1:], best[:, :-1] + equal), axis=1)
        result[rows] = 2 * best[:, -1] / (n + m)
    return result


@F.pandas_udf(DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(jaro_winklers(a.tolist(), b.tolist()))


@F.pandas_udf(DoubleType())
def indel(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(indels(a.tolist(), b.tolist()))


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("int")


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def with_parts(pairs: DataFrame, sides: dict[str, tuple[str, str]]) -> DataFrame:
    """pairs with the plain strings of both columns of each side, their tokens and grams, and how many they share, for :func:`string_features`.

    They are columns, one upon the other, so that each is made once for a pair and not once for each feature.
    """
    plain, sets, shared = {}, {}, {}
    for p, columns in sides.items():
        for x, c in zip("ab", columns, strict=True):
            plain[f"_{p}_{x}"] = F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
            sets[f"_{p}_t{x}"] = F.array_distinct(tokens(F.regexp_replace(F.col(f"_{p}_{x}"), r"\s+", " ")))
            sets[f"_{p}_g{x}"] = grams(F.col(f"_{p}_{x}"))
        shared |= {f"_{p}_{k}": F.size(F.array_intersect(f"_{p}_{k}a", f"_{p}_{k}b")) for k in "tg"}
    return pairs.withColumns(plain).withColumns(sets).withColumns(shared)


def string_features(p: str) -> dict[str, Column]:
    """Features named ``p``_... of the parts of side p; scores are 0 where either string is empty, two empty strings are an exact match."""
    a, b, ta, tb, ga, gb, both_t, both_g = (F.col(f"_{p}_{x}") for x in ("a", "b", "ta", "tb", "ga", "gb", "t", "g"))
    some = (a != "") & (b != "")

    def either(x: Column, y: Column, both: Column) -> Column:  # distinct lists
        return F.size(x) + F.size(y) - both

    jaccard = _ratio(both_g, either(ga, gb, both_g))

    def held(c: Column) -> Column:
        return F.when(some, c).otherwise(F.lit(0.0))

    out = {
        "exact_match": _flag(a == b),
        "compact_exact_match": _flag((compact(a) == compact(b)) & (compact(a) != "")),
        "length_ratio": _ratio(F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))),
        "length_difference": F.abs(F.length(a) - F.length(b)).cast("double"),
        "token_jaccard": held(_ratio(both_t, either(ta, tb, both_t))),
        "token_overlap_s1": held(_ratio(both_t, F.size(ta))),
        "token_overlap_candidate": held(_ratio(both_t, F.size(tb))),
        "edit_similarity": held(1 - _ratio(F.levenshtein(a, b), F.greatest(F.length(a), F.length(b)))),
        "char_4gram_jaccard": held(jaccard),
        "char_4gram_overlap": held(_ratio(both_g, F.least(F.size(ga), F.size(gb)))),
        "tfidf_cosine": held(jaccard),
    }
    if p == "name":
        out["jaro_winkler"] = jaro_winkler(a, b)
        out["sorted_token_similarity"] = indel(*(F.array_join(F.array_sort(tokens(F.regexp_replace(x, r"\s+", " "))), " ") for x in (a, b)))
    return {f"{p}_{k}": v for k, v in out.items()}


def _blank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def pair_features(pairs: DataFrame) -> DataFrame:
    """pairs with 48 feature columns.

    pairs has s1_ and cand_ columns name, address, country, postal, and candidate_source; a column
    dense_cosine_similarity is used if there is one. Parts of an address that no column holds
    (house_number, city, locality, state) count as unknown, so their flags are 0.
    """
    have = set(pairs.columns)
    name1, name2 = F.col("s1_name"), F.col("cand_name")
    out = string_features("name") | string_features("address")
    for part, both in (("postal", True), ("house_number", True), ("city", False), ("locality", False), ("state", False)):
        if {f"s1_{part}", f"cand_{part}"} <= have:
            a, b = F.col(f"s1_{part}"), F.col(f"cand_{part}")
            known, same = _flag(~_blank(a) & ~_blank(b)), _flag(~_blank(a) & (a == b))
        else:
            known = same = F.lit(0)
        out |= ({f"{part}_available_both": known} if both else {}) | {f"{part}_match": same}
    wide1, wide2, deva1, deva2 = has_non_ascii(name1), has_non_ascii(name2), has_devanagari(name1), has_devanagari(name2)
    out |= {"name_has_non_ascii_s1": _flag(wide1), "name_has_non_ascii_candidate": _flag(wide2), "name_has_devanagari_s1": _flag(deva1), "name_has_devanagari_candidate": _flag(deva2)}
    out["both_name_same_script"] = F.greatest(_flag(~wide1 & ~wide2), _flag(deva1 & deva2))
    out["dense_cosine_similarity"] = F.coalesce(F.col("dense_cosine_similarity"), F.lit(0.0)) if "dense_cosine_similarity" in have else F.lit(0.0)
    out |= {"dense_name_cosine": F.lit(0.0), "dense_address_cosine": F.lit(0.0)}
    k1, k2 = (F.upper(F.trim(F.coalesce(F.col(c), F.lit("")))) for c in ("s1_country", "cand_country"))
    out["country_match"] = _flag((k1 == k2) & (k1 != ""))
    out |= {f"candidate_source_{s}": _flag(F.col("candidate_source") == s) for s in ("S2", "S3")}
    for side, short in (("s1", "s1"), ("candidate", "cand")):
        out |= {f"{side}_{x}_missing": _blank(F.col(f"{short}_{x}")).cast("int") for x in ("name", "address", "postal")}
    sides = {"name": ("s1_name", "cand_name"), "address": ("s1_address", "cand_address")}
    return with_parts(pairs, sides).withColumns(out).select(*pairs.columns, *out)


def feature_names(features: DataFrame) -> list[str]:
    """Names of the numeric feature columns that a model may use: no ids, labels or raw record columns."""
    drop = {"source1_entity_id", "candidate_entity_id", "candidate_source", "label", "provenance", "score", "rank", "probability"}
    return [c for c, t in features.dtypes if c not in drop and not c.startswith(("s1_", "cand_")) and t in ("int", "tinyint", "bigint", "float", "double")]
