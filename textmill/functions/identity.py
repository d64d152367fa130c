"""Digests that name documents, groups, splits and ranks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textmill.config import SplitPolicy


def sha(text: Column) -> Column:
    return F.sha2(text, 256)


def named_digest(namespace: str, value: Column) -> Column:
    """SHA-256 of a namespace, a zero byte and a text."""
    return F.sha2(F.concat(F.lit(namespace + "\0"), value), 256)


def named_hash(namespace: str, digest: Column) -> Column:
    """SHA-256 of a namespace, a zero byte and the bytes of a hex digest."""
    return F.sha2(F.concat(F.encode(F.lit(namespace), "utf-8"), F.unhex(F.lit("00")), F.unhex(digest)), 256)


def document_key(source: Column, doc_id: Column) -> Column:
    return F.sha2(F.concat(source, F.lit("\0"), doc_id.cast("string")), 256)


def split_of(group: Column, policy: SplitPolicy) -> Column:
    """Split of a group's hex digest: its first 64 bits as hex against the thresholds, a pure function of the group."""
    value = F.substring(named_hash(f"split:{policy.seed}", group), 1, 16)
    *held, (rest, _) = policy.thresholds()
    out = F.lit(rest)
    for name, end in reversed(held):
        out = F.when(value < F.lit(f"{end:016x}"), F.lit(name)).otherwise(out)
    return out


def selection_rank(key: Column, policy: SplitPolicy) -> Column:
    return named_hash(f"selection:{policy.seed}", key)
