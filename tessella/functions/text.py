"""Text functions of the harvest: normal forms, markers, JSON scalars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm(s: Column) -> Column:
    """Lower case, only a-z and 0-9."""
    return F.regexp_replace(F.lower(s), "[^a-z0-9]", "")


def strip(s: Column) -> Column:
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def clean_context(s: Column) -> Column:
    """Trim, turn ' [title]' into '. ', drop bracketed parts, close double spaces."""
    out = F.replace(strip(s), F.lit(" [title]"), F.lit(". "))
    return F.replace(F.regexp_replace(out, r"\[.*?\]", ""), F.lit("  "), F.lit(" "))


def last_segment(s: Column, marker: str) -> Column:
    """What follows the last marker; the whole text without one."""
    return F.substring_index(s, marker, -1)


def before(s: Column, marker: str) -> Column:
    return F.substring_index(s, marker, 1)


def last_paragraph(s: Column) -> Column:
    return last_segment(s, "\n\n")


def capitalize(s: Column) -> Column:
    """First character upper, the rest lower."""
    return F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substring(s, 2, 1 << 30)))


def timestamp_of(path: Column) -> Column:
    """The time stamp in a file name, '' without one; compared as text."""
    return F.regexp_extract(path, r"(\d{4}-\d{2}-\d{2}T\d{2}-\d{2}-\d{2})", 1)


def decoded_list(s: Column) -> Column:
    """A JSON list of numbers; null if it does not parse or holds a null."""
    out = F.from_json(s, "array<double>")
    return F.when(~F.exists(out, lambda x: x.isNull()), out)


def token_counts(cont_tokens: Column, k: int) -> Column:
    """Tokens of each of ``k`` options, 1 at least and where none are listed."""
    size = lambda i: F.when(F.get(cont_tokens, i).isNotNull(), F.size(F.get(cont_tokens, i))).otherwise(1)
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.greatest(size(i), F.lit(1)))


def accuracy_flag(metrics: Column, flat: Column) -> Column:
    """The struct's value, else the flat one, rounded half to even."""
    return F.bround(F.coalesce(metrics, flat), 0).cast("int")


def file_name(model_id: Column) -> Column:
    return F.replace(model_id, F.lit("/"), F.lit("__"))


def identity(name: Column) -> Column:
    """``org/name`` from an explicit id, or from a file name without its prefix, split once at '__'; null otherwise."""
    bare = F.regexp_replace(name, r"^(details_|results_)", "")
    parts = F.split(bare, "__", 2)
    guess = F.when((F.size(parts) == 2) & (parts[0] != "") & (F.get(parts, F.lit(1)) != ""), F.concat(parts[0], F.lit("/"), F.get(parts, F.lit(1))))
    return F.when(name.rlike("^[^/]+/[^/]+$"), name).otherwise(guess)
