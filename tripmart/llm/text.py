"""Text expressions and small helpers that several operators share."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripmart.session import work_dir

#: Java and RE2 classes: what separates alphanumeric words, and what separates words by white space.
NOT_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPACE = r"[\x20\x09-\x0D]+"


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, everything else as it is; null becomes empty."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def words(text: Column, separator: str) -> Column:
    """The words of a text between runs of separators; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separator), "")


def gram_hashes(found: Column, k: int) -> Column:
    """A hash of every run of k words, by position; fewer words than k give an empty array."""
    hashes = F.transform(found, lambda w: F.xxhash64(w)) if k == 1 else found
    for i in range(1, k):
        hashes = F.zip_with(hashes, _from(found, i), lambda a, b: F.xxhash64(a, b))
    return F.slice(hashes, 1, F.greatest(F.size(found) - (k - 1), F.lit(0)))


def _from(array: Column, start: int) -> Column:
    return F.slice(array, start + 1, F.greatest(F.size(array) - start, F.lit(0)))


def row_key(*columns: Column) -> Column:
    """Tells rows apart by content: equal rows share a key, so ids may repeat or be null."""
    parts = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-")) for c in columns]
    return F.md5(F.concat_ws("\u0001", *parts))


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage by a table in the shared folder: computed once, and not again when an executor is lost."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drawn(column_: Column) -> Column:
    """A fixed number in [0, 1) for a value, spread evenly over values: what samples are ordered by."""
    return F.pmod(F.xxhash64(column_), F.lit(1 << 32)) / F.lit(float(1 << 32))


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names for working columns that the frame does not use (its names are compared without case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def column(df: DataFrame, name: str) -> Column:
    """A column by its exact name, dots included."""
    return df[f"`{name}`"]
