"""Names, parameters in names, sequences' letters: column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def group_of(name: Column) -> Column:
    """Family prefix: the text before the first dot or underscore."""
    return F.regexp_extract(name, r"^(.[^._]*)", 1)


def base_name(path: Column, suffix: str | None = None) -> Column:
    """File name without its folders, and without ``suffix`` or its last extension."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.regexp_replace(name, r"\.[^.]*$" if suffix is None else rf"\Q{suffix}\E$", "")


def derived_name(path: Column, folder: str, extension: str, **params) -> Column:
    """folder/base[.p1.p2]extension: the output that belongs to an input."""
    marks = "".join(f".{k}{v}" for k, v in params.items())
    return F.concat(F.lit(folder.rstrip("/") + "/"), base_name(path), F.lit(marks + extension))


def parameters(name: Column) -> Column:
    """Map of the .w4.d5-like marks of a file name: letter -> number."""
    marks = F.regexp_extract_all(name, F.lit(r"\.([a-zA-Z])(-?\d+)(?=\.|$)"), F.lit(0))
    entry = lambda m: F.struct(F.substring(m, 2, 1).alias("key"), F.substring(m, 3, 30).cast("int").alias("value"))
    return F.map_from_entries(F.transform(F.array_distinct(marks), entry))


def folder_parameters(path: Column) -> Column:
    """T, F, S of a folder named p_T_F_S."""
    part = lambda k: F.regexp_extract(path, r"(?:^|/)[^/]*?_(-?[\d.]+)_(-?[\d.]+)_(-?[\d.]+)(?:/|$)", k).cast("double")
    return F.struct(part(1).alias("t"), part(2).alias("f"), part(3).alias("s"))


def fixed_bases(sequence: Column) -> Column:
    """Upper case, every letter but A C G T U replaced by A."""
    return F.regexp_replace(F.upper(sequence), "[^ACGTU]", "A")


def bad_bases(sequence: Column) -> Column:
    """How many letters ``fixed_bases`` replaces."""
    return F.length(F.regexp_replace(F.upper(sequence), "[ACGTU]", ""))


def bad_letters(sequence: Column, allowed: str = "ACGTU") -> Column:
    """The distinct letters beyond ``allowed``, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.upper(sequence), F.lit(f"[^{allowed}]"), F.lit(0))))


def wrapped(sequence: Column, width: int = 100) -> Column:
    """A line feed after each ``width`` letters."""
    return F.regexp_replace(sequence, rf"(.{{{width}}})(?=.)", "$1\n")


def divided(num: Column, den: Column, default: float = 0.0) -> Column:
    """num / den, or ``default`` where den is zero."""
    return F.coalesce(F.try_divide(num, den), F.lit(default))


def fold_percent(ddg: Column, mfe: Column) -> Column:
    """Energy window in percent of the least energy, as folding programs want it."""
    return (-100 * ddg / mfe).cast("int") + 1


def provenance(**facts) -> Column:
    """Map of date, source and further facts about how a table was made."""
    items = [F.lit("date"), F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")]
    for k, v in facts.items():
        items += [F.lit(k), F.lit(str(v))]
    return F.create_map(*items)


def motif_checksum(code: str = "code", value: str = "n_stems") -> Column:
    """Aggregate: a sum of a motif table that does not depend on the order of its rows."""
    return F.bit_xor(F.xxhash64(F.col(code), F.col(value)))
