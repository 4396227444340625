"""Cohort-name clean-up and key strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: A tag in brackets with the space or underscore behind it.
TAG = r"\[.*?\][ _]"


def untagged(name: Column) -> Column:
    return F.regexp_replace(name, TAG, "")


def underscored_name(name: Column, lower: bool = False) -> Column:
    """Cohort name without tags, words joined by underscores."""
    joined = F.translate(untagged(name), " ", "_")
    return F.lower(joined) if lower else joined


def display_name(name: Column) -> Column:
    """Cohort name without tags, words separated by spaces."""
    return F.translate(untagged(name), "_", " ")
