"""Locking and unlocking columns with AES-256.

The key comes in a table of one row, ``key BINARY`` with 32 bytes and optionally ``owner_key``,
never as a literal, so plans do not show it. A locked table has its columns as BINARY
and a ``locked`` flag per row; with an owner key each row also keeps the user key wrapped for the
owner in ``owner_slot``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY_BYTES = 32


def _checked(key: Column) -> Column:
    blank = key.isNull() | (F.octet_length(key) == 0)
    return (
        F.when(blank, F.raise_error(F.lit("the key cannot be blank")).cast("binary"))
        .when(
            F.octet_length(key) != KEY_BYTES,
            F.raise_error(F.lit(f"the key needs {KEY_BYTES} bytes")).cast("binary"),
        )
        .otherwise(key)
    )


def _scalar(keys: DataFrame, name: str) -> Column:
    """The only value of ``name``; also a table without rows is refused, when a row is read."""
    missing = F.raise_error(F.lit("the key table has no row")).cast("binary")
    return F.coalesce(keys.select(_checked(F.col(name)).alias(name)).scalar(), missing)


def _user_key(keys: DataFrame, restricted: bool) -> Column:
    key = _scalar(keys, "key")
    if restricted:
        same = F.raise_error(F.lit("user and owner key must differ")).cast("binary")
        differ = keys.select(F.when(F.col("key") == F.col("owner_key"), same).otherwise(F.col("key")).alias("key"))
        key = F.coalesce(differ.scalar(), key)
    return key


def protect_columns(df: DataFrame, cols: list[str], keys: DataFrame) -> DataFrame:
    """Lock ``cols``; rows that are already locked stay as they are."""
    restricted = "owner_key" in keys.columns
    key = _user_key(keys, restricted)
    locked = F.col("locked") if "locked" in df.columns else F.lit(False)
    changed = {
        c: F.when(locked, F.col(c).cast("binary")).otherwise(
            F.aes_encrypt(F.col(c).cast("binary"), key, F.lit("GCM"))
        )
        for c in cols
    }
    if restricted:
        owner = _scalar(keys, "owner_key")
        kept = F.col("owner_slot") if "owner_slot" in df.columns else F.lit(None).cast("binary")
        changed["owner_slot"] = F.when(locked, kept).otherwise(
            F.aes_encrypt(key, owner, F.lit("GCM"))
        )
    changed["locked"] = F.lit(True)
    return df.withColumns(changed)


def unprotect_columns(df: DataFrame, cols: list[str], keys: DataFrame) -> DataFrame:
    """Unlock ``cols``; adds ``status``: ``open``, ``unlocked`` or ``wrong key``.

    A row the key does not fit is not modified. The owner key opens rows that have an owner slot.
    """
    key = _user_key(keys, restricted=False)
    used = key
    if "owner_slot" in df.columns:
        used = F.coalesce(F.try_aes_decrypt("owner_slot", key, F.lit("GCM")), key)
    opened = df.withColumns(
        {f"_open_{c}": F.try_aes_decrypt(F.col(c), used, F.lit("GCM")) for c in cols}
    )
    fits = F.lit(True)
    for c in cols:
        fits = fits & (F.col(c).isNull() | F.col(f"_open_{c}").isNotNull())
    status = (
        F.when(~F.col("locked"), F.lit("open"))
        .when(key.isNotNull() & fits, F.lit("unlocked"))  # a try would hide a refused key
        .otherwise(F.lit("wrong key"))
    )
    result = opened.withColumn("status", status).withColumns(
        {
            c: F.when(F.col("status") == "unlocked", F.col(f"_open_{c}")).otherwise(F.col(c))
            for c in cols
        }
    )
    if "owner_slot" in df.columns:
        result = result.withColumn(
            "owner_slot", F.when(F.col("status") != "unlocked", F.col("owner_slot"))
        )
    return result.withColumn("locked", F.col("status") == "wrong key").drop(
        *[f"_open_{c}" for c in cols]
    )


def lock_report(unlocked: DataFrame) -> DataFrame:
    """Rows per status."""
    return unlocked.groupBy("status").agg(F.count(F.lit(1)).alias("rows"))
