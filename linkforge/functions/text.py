"""Normalising names and addresses: Column expressions, JVM-side but for NFKC on non-ASCII text."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Whole words of a normalised name and what they stand for.
NAME_WORDS = {"pvt": "private", "ltd": "limited", "inc": "incorporated", "corp": "corporation", "co": "company"}
#: Whole words of a normalised address and what they stand for.
ADDRESS_WORDS = {"rd": "road", "st": "street", "ave": "avenue", "blvd": "boulevard", "dr": "drive", "ln": "lane"}

SPACE = r"(?U)[\s\x1C-\x1F]+"


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def clean_text(c: Column) -> Column:
    """NFKC, null as ''. Spark has no built-in for it. ASCII text is its own NFKC: of it only a null goes to Python."""
    c = F.coalesce(c, F.lit(""))
    return F.coalesce(_nfkc(F.when(has_non_ascii(c), c)), c)


def normalize_country(c: Column) -> Column:
    return F.lower(F.trim(clean_text(c)))


def _plain(c: Column, keep_marks: bool) -> Column:
    """Lower case, punctuation to spaces, white space collapsed. Combining marks count as punctuation unless kept."""
    other = r"(?U)[^\w\s]" if keep_marks else r"[^\p{L}\p{N}_\s]"
    return F.trim(F.regexp_replace(F.regexp_replace(c, other, " "), SPACE, " "))


def _words(c: Column, table: dict[str, str]) -> Column:
    mapped = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.array_join(F.transform(F.split(c, " "), lambda w: F.coalesce(F.try_element_at(mapped, w), w)), " ")


def normalize_business_name(c: Column, keep_marks: bool = False) -> Column:
    """NFKC, lower case, & as 'and', punctuation out, legal forms spelled out; 'l l c' and 'llc' become 'llc'."""
    plain = _plain(F.replace(F.lower(clean_text(c)), F.lit("&"), F.lit(" and ")), keep_marks)
    return F.regexp_replace(_words(plain, NAME_WORDS), r"(?U)\bl l c\b", "llc")


def normalize_address(c: Column, keep_marks: bool = False) -> Column:
    return _words(_plain(F.lower(clean_text(c)), keep_marks), ADDRESS_WORDS)


def compact(c: Column) -> Column:
    return F.regexp_replace(c, SPACE, "")


def tokens(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda t: t != "")


def grams(c: Column, n: int = 4) -> Column:
    """Distinct n-grams of a string; a shorter string is one gram, '' has none."""
    every = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - (n - 1), F.lit(1))), lambda i: F.substring(c, i, F.lit(n)))
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.array_distinct(every))


def extract_postal_code(c: Column) -> Column:
    """Last 6-digit number, else last ZIP+4, else last 5-digit number of the raw address, else null."""
    last = [F.try_element_at(F.regexp_extract_all(c, F.lit(p), F.lit(0)), F.lit(-1)) for p in (r"(?U)\b\d{6}\b", r"(?U)\b\d{5}-\d{4}\b", r"(?U)\b\d{5}\b")]
    return F.coalesce(*last)


def has_non_ascii(c: Column) -> Column:
    return F.coalesce(F.length(c) != F.octet_length(c), F.lit(False))


def has_devanagari(c: Column) -> Column:
    return F.coalesce(c.rlike(r"[ऀ-ॿ]"), F.lit(False))


def format_record(name: Column, address: Column, country: Column) -> Column:
    n, a, k = (F.coalesce(x, F.lit("")) for x in (name, address, country))
    return F.concat(F.lit("NAME: "), n, F.lit(" | ADDRESS: "), a, F.lit(" | COUNTRY: "), k)


def source_tag(entity_id: Column) -> Column:
    return F.split_part(entity_id, F.lit("-"), F.lit(1))


def preprocess(df: DataFrame, keep_marks: bool = False) -> DataFrame:
    """The records with all derived columns; the originals stay as they are."""
    name, address = F.col("business_name"), F.col("business_address")
    return df.withColumns(
        {
            "country_normalized": normalize_country(F.col("country")),
            "business_name_normalized": normalize_business_name(name, keep_marks),
            "name_has_non_ascii": has_non_ascii(name),
            "name_has_devanagari": has_devanagari(name),
            "business_address_normalized": normalize_address(address, keep_marks),
            "postal_code": extract_postal_code(address),
        }
    ).withColumns(
        {
            "business_name_compact": compact(F.col("business_name_normalized")),
            "business_name_tokenized": tokens(F.col("business_name_normalized")),
            "business_address_compact": compact(F.col("business_address_normalized")),
            "has_postal_code": F.col("postal_code").isNotNull().cast("int"),
        }
    )
