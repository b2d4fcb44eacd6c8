"""Canonical spellings of identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\r\n"


def trimmed(c: Column | str) -> Column:
    """Without blanks at both ends; null stays null."""
    return F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(BLANKS))


def key_form(c: Column | str) -> Column:
    """Blanks at both ends cut off, upper case."""
    return F.upper(trimmed(c))


def task_key(c: Column | str) -> Column:
    """Key form of task ids: blanks cut off, lower case."""
    return F.lower(trimmed(c))


def parent_key(c: Column | str) -> Column:
    """Key form of a parent reference; an empty string or "-" means no parent and becomes null."""
    k = task_key(c)
    return F.when(~k.isin("", "-"), k)
