"""Columns derived from sample names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

NEGATIVE_PREFIX = "negative_"


def base_name(name: Column) -> Column:
    return F.regexp_replace(name, r"^.*/", "")


def stem(name: Column) -> Column:
    """File name without directory and last extension."""
    return F.regexp_replace(base_name(name), r"(?<=.)\.[^.]*$", "")


def strip_image_dir(name: Column) -> Column:
    return F.regexp_replace(name, r"^(images-negative|images)/", "")


def is_negative(name: Column, ignore_case: bool = False) -> Column:
    return (F.lower(name) if ignore_case else name).startswith(NEGATIVE_PREFIX)


def is_negative_token(name: Column) -> Column:
    """The prefix before the first underscore is exactly ``negative``."""
    return F.substring_index(name, "_", 1) == "negative"


def is_zero_label(coords: Column) -> Column:
    return F.forall(coords, lambda c: F.abs(c) <= F.lit(1e-8))


def source_prefix(name: Column) -> Column:
    """First two underscore parts; the whole name when there is no underscore."""
    return F.substring_index(name, "_", 2)


def first_token(name: Column) -> Column:
    return F.lower(F.substring_index(name, "_", 1))


def has_prefix(name: Column, prefixes: Sequence[str], ignore_case: bool = True) -> Column:
    hit = F.lit(False)
    for p in prefixes:
        hit = hit | (F.lower(name).startswith(p.lower()) if ignore_case else name.startswith(p))
    return hit


def is_protected(name: Column) -> Column:
    s = stem(name)
    return s.startswith("MIDV") | F.lower(s).startswith("smartdoc")


def flag_list(**flags: Column) -> Column:
    """Comma-joined names of the true flags, in the order given."""
    return F.concat_ws(",", *[F.when(c, F.lit(n)) for n, c in flags.items()])


def issue_type(issue: Column) -> Column:
    return F.substring_index(issue, ":", 1)
