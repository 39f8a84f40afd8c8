"""Change detection: latest snapshot, new-or-changed rows, files not yet loaded."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripmart.functions.columns import fingerprint
from tripmart.operators.latest import _as_list, latest
from tripmart.operators.sizing import BROADCAST_ROWS, small_side

LOADED_AT = "loaded_at"


def latest_snapshot(log: DataFrame, keys: str | Sequence[str], loaded_at: str = LOADED_AT) -> DataFrame:
    """The last loaded row per key; equal load stamps are settled by the row's content, never doubled."""
    return latest(log, keys, loaded_at)


def detect_changes(source: DataFrame, existing: DataFrame, keys: str | Sequence[str],
                   loaded_at: str = LOADED_AT,
                   content: Callable[[DataFrame, list[str]], Column] = fingerprint,
                   broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Source rows whose key is unknown or whose content differs from the latest snapshot.

    Only key and hash of the snapshot take part in the join. Columns that one side lacks (a schema that has
    grown) count as null there. Keys gone from the source are left alone; see `deleted_keys`.
    """
    keys = _as_list(keys)
    snapshot = latest_snapshot(existing, keys, loaded_at)
    aligned = _with_columns_of(snapshot, source)
    hash_of = lambda df: content(df, [*keys, loaded_at])
    known = aligned.select(*[F.col(k).alias(f"_k_{k}") for k in keys], hash_of(aligned).alias("_known"))
    wide = _with_columns_of(source, snapshot)
    marked = wide.withColumn("_hash", hash_of(wide))
    cond = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return (
        marked.join(small_side(known, broadcast_rows), cond, "left")
        .where(F.col("_known").isNull() | (F.col("_hash") != F.col("_known")))
        .select(*source.columns)
    )


def _with_columns_of(df: DataFrame, other: DataFrame) -> DataFrame:
    """`df` with every column of `other`, in the other's types where both have it, nulls where it lacks one."""
    have = set(df.columns)
    types = {f.name: f.dataType for f in other.schema.fields}
    kept = [F.col(f"`{c}`").cast(types[c]).alias(c) if c in types and types[c] != df.schema[c].dataType
            else F.col(f"`{c}`") for c in df.columns]
    extra = [F.lit(None).cast(t).alias(c) for c, t in types.items() if c not in have]
    return df.select(*kept, *extra)


def deleted_keys(source: DataFrame, existing: DataFrame, keys: str | Sequence[str],
                 loaded_at: str = LOADED_AT) -> DataFrame:
    """Snapshot rows whose key the source no longer has."""
    keys = _as_list(keys)
    return latest_snapshot(existing, keys, loaded_at).join(source.select(*keys), keys, "left_anti")


def not_loaded(found: DataFrame, manifest: DataFrame, identity: Sequence[str]) -> DataFrame:
    """Listed files that the manifest does not hold. Joined by shuffle or broadcast as their sizes allow."""
    cond = [F.col(f"f.{c}").eqNullSafe(F.col(f"m.{c}")) for c in identity]
    return found.alias("f").join(manifest.select(*identity).alias("m"), cond, "left_anti")
