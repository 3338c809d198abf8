"""Words of a text, as expressions: maximal runs of code points outside ``[\\x20\\x09-\\x0D]``."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SPACES = "\t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text: Column) -> Column:
    """Array of words; empty for null."""
    spaced = F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES))
    return F.array_remove(F.split(spaced, " "), "")


def word_chars(text: Column) -> Column:
    """Code points inside words."""
    return F.char_length(F.translate(F.coalesce(text, F.lit("")), " " + SPACES, "")).cast("long")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else; ``lower`` is the same and faster where every character is one byte."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))
