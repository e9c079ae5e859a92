"""Column expressions on strings."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

BLANKS = " \t\r\n"


def clean_id(c: Column | str) -> Column:
    """An id without white space at its ends; null if nothing is left."""
    return F.nullif(F.btrim(c, F.lit(BLANKS)), F.lit(""))


def clean_tag(c: Column | str) -> Column:
    """A tag without outer white space and leading '#', in lower case; null if nothing is left."""
    inner = F.regexp_replace(F.btrim(c, F.lit(BLANKS)), "^#+", "")
    return F.nullif(F.lower(F.btrim(inner, F.lit(BLANKS))), F.lit(""))


def letters_only_words(c: Column | str) -> Column:
    """Lower-case words of a text in which every character outside a-z, A-Z counts as a space."""
    return F.filter(F.split(F.lower(F.regexp_replace(c, "[^a-zA-Z]+", " ")), " "), lambda w: w != "")
