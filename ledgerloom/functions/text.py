"""String scalars: repair, normalisation and field processors, all as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Honorifics and degrees around names.
HONORIFICS = "mr|mrs|ms|miss|dr|shri|smt|kum|prof"
DEGREES = "md|mbbs|ms|mch|dnb|frcs"
#: Frequent misreadings of domain words, applied in this order.
DOMAIN_REPAIRS = (("hospita1", "hospital"), ("treatrnent", "treatment"), ("treatrment", "treatment"), ("cahrges", "charges"), ("chgs\\.", "charges"), ("consulttion", "consultation"), ("chagres", "charges"), ("adbomen", "abdomen"), ("rnedical", "medical"), ("c1aim", "claim"))


def squeeze(c: Column) -> Column:
    """One space between words, none around."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def strip_controls(c: Column) -> Column:
    return F.regexp_replace(c, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]", "")


def fold_quotes(c: Column) -> Column:
    return F.translate(c, "‘’“”–—", "''\"\"--")


def normalise(c: Column) -> Column:
    """Line ends, control characters, quotes, punctuation spacing and white space in one chain."""
    c = F.regexp_replace(c, "\r\n?", "\n")
    return squeeze(F.regexp_replace(fold_quotes(strip_controls(c)), " +([,.;:])", "$1"))


def domain_repair(c: Column) -> Column:
    """Known misreadings of domain words, in order, ignoring case."""
    for wrong, right in DOMAIN_REPAIRS:
        c = F.regexp_replace(c, f"(?i){wrong}", right)
    return c


def digits_read(c: Column) -> Column:
    """Letters in numeric context read as the figures they resemble."""
    return F.translate(c, "OoIlSsZzB", "001155228")


def letters_read(c: Column) -> Column:
    """Figures in alphabetic context read as the letters they resemble."""
    return F.translate(c, "015", "OIS")


def clean_name(c: Column) -> Column:
    """Honorifics before and degrees after a name removed; '' for null and for less than three characters."""
    bare = F.regexp_replace(squeeze(c), rf"(?i)^(?:(?:{HONORIFICS})(?:\.|\s|$)\s*)+", "")
    bare = F.regexp_replace(bare, rf"(?i)(?:[,\s]+(?:{DEGREES})\.?)+$", "")
    bare = F.trim(bare)
    return F.when(F.length(bare) < 3, "").otherwise(F.coalesce(bare, F.lit("")))


def clean_entity(c: Column) -> Column:
    """Brackets to spaces, squeezed, without figures and signs at the ends."""
    c = squeeze(F.regexp_replace(c, r"[\[\](){}<>|]", " "))
    return F.regexp_replace(F.regexp_replace(c, "^[^A-Za-z]+", ""), "[^A-Za-z.]+$", "")


def identity_name(c: Column) -> Column:
    """Lower case, letters and figures only, squeezed."""
    return squeeze(F.regexp_replace(F.lower(c), "[^a-z0-9 ]", " "))


def money(c: Column) -> Column:
    """The number in an amount text: currency words, signs and grouping commas removed; null if none is left."""
    bare = F.regexp_replace(F.regexp_replace(c, r"(?i)rs\.?|inr|₹|\$|/-", ""), r"[,\s]", "")
    return bare.try_cast("double")


def policy_number(c: Column) -> Column:
    """Upper case; blanks and slashes to one hyphen; empty ends removed."""
    return F.regexp_replace(F.regexp_replace(F.upper(F.trim(c)), r"[\s/]+", "-"), "^-+|-+$", "")


def masked_user(c: Column) -> Column:
    return F.concat(F.substring(c, 1, 1), F.lit("***"))


def token_sort(c: Column) -> Column:
    return F.array_join(F.array_sort(F.split(squeeze(F.lower(c)), " ")), " ")


def similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer length, of the sorted words."""
    x, y = token_sort(a), token_sort(b)
    return 1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y), F.lit(1))
