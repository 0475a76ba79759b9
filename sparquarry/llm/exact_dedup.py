"""Exact dedup against a minimal perfect hash over historical distinct digests.

A digest is the SHA-256 of the text without white space.  History is reduced to
one row per distinct digest (with map-side combine, so copies never meet in one
task), dealt into buckets by the digest, and each bucket gets its own minimal
perfect hash: levels of collision-free bit arrays whose ranks number the slots.
A slot holds the full digest and the locator of the winner.  A batch is reduced
in the same way and looked up bucket by bucket; a hit counts only if all 32
bytes agree.  Digests that are not members are grouped among themselves.

Defined results: a null text is an empty text, all empty texts are one group;
a null id orders after every other id; rows that repeat both id and text are one
group of which one row is kept; an empty table gives an empty result; other
columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITESPACE, materialise, mix64, shuffle_partitions

#: Digests in a bucket of the index at most, on average.
BUCKET = 20_000
#: Bits of a level for each key that reaches it.
GAMMA = 2

INDEX = "bucket int, n long, levels binary, digests binary, locators binary"
FOUND = "digest binary, members long, size double, doc_id long, uid long, known boolean"
LOCATOR = np.dtype([("doc_id", "<i8"), ("null", "?"), ("size", "<i8"), ("uid", "<i8"), ("members", "<i8")])


class PerfectHash:
    """Maps each of a set of 32-byte digests to its own slot 0..n-1; other keys get some slot or -1."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.starts = np.cumsum([0, *(int(x.sum()) for x in levels)])

    @staticmethod
    def at(words: np.ndarray, level: int, size: int) -> np.ndarray:
        h = words[:, level % 4] + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & (2**64 - 1))
        return (mix64(h ^ (words[:, (level + 1) % 4] << np.uint64(1))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, digests: np.ndarray) -> PerfectHash:
        """digests: n rows of 32 bytes, all different."""
        words = np.ascontiguousarray(digests).view("<u8").reshape(-1, 4)
        levels = []
        while len(words):
            size = max(8, GAMMA * len(words))
            at = cls.at(words, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            words = words[~alone[at]]
        return cls(levels)

    def slots(self, digests: np.ndarray) -> np.ndarray:
        words = np.ascontiguousarray(digests).view("<u8").reshape(-1, 4)
        out, left = np.full(len(words), -1, np.int64), np.arange(len(words))
        for level, bits in enumerate(self.levels):
            at = self.at(words[left], level, len(bits))
            hit = bits[at]
            rank = np.cumsum(bits) - 1
            out[left[hit]] = self.starts[level] + rank[at[hit]]
            left = left[~hit]
        return out

    def to_bytes(self) -> bytes:
        head = np.array([len(self.levels), *(len(x) for x in self.levels)], "<i8").tobytes()
        return head + b"".join(np.packbits(x).tobytes() for x in self.levels)

    @classmethod
    def from_bytes(cls, raw: bytes) -> PerfectHash:
        n = int(np.frombuffer(raw, "<i8", 1)[0])
        sizes, at, levels = np.frombuffer(raw, "<i8", n, 8), 8 * (n + 1), []
        for size in sizes:
            used = (int(size) + 7) // 8
            levels.append(np.unpackbits(np.frombuffer(raw, np.uint8, used, at))[:size].astype(bool))
            at += used
        return cls(levels)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, digest (32 bytes), size (code points of the original text), uid (tells rows apart)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.unhex(F.sha2(F.regexp_replace(text, WHITESPACE, ""), 256)).alias("digest"), F.length(text).cast("long").alias("size"), F.monotonically_increasing_id().alias("uid"))


def distinct(rows: DataFrame) -> DataFrame:
    """One row per digest: how many rows have it and which of them wins (longest, then smallest id)."""
    best = F.min(F.struct((-F.col("size")).alias("less"), F.col("doc_id").isNull().alias("none"), "doc_id", "uid"))
    out = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("members"), best.alias("b"))
    return out.select("digest", "members", (-F.col("b.less")).alias("size"), F.col("b.doc_id").alias("doc_id"), F.col("b.uid").alias("uid"))


def _matrix(values) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.uint8).reshape(-1, 32)


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    keys = _matrix(pdf["digest"])
    mph = PerfectHash.build(keys)
    order = np.empty(len(keys), np.int64)
    order[mph.slots(keys)] = np.arange(len(keys))
    locators = np.zeros(len(keys), LOCATOR)
    locators["null"] = pdf["doc_id"].isna().to_numpy()[order]
    locators["doc_id"] = pdf["doc_id"].fillna(0).to_numpy(np.int64)[order]
    for name in ("size", "uid", "members"):
        locators[name] = pdf[name].to_numpy(np.int64)[order]
    return pd.DataFrame({"bucket": [int(pdf["bucket"].iloc[0])], "n": [len(keys)], "levels": [mph.to_bytes()], "digests": [keys[order].tobytes()], "locators": [locators.tobytes()]})


def build_index(history: DataFrame, buckets: int) -> DataFrame:
    """history: rows of distinct().  One row per bucket: the hash, the slots' digests and the slots' locators."""
    return history.withColumn("bucket", _bucket(buckets)).groupBy("bucket").applyInPandas(_build, INDEX)


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int")


def _lookup(index: pd.DataFrame, batch: pd.DataFrame) -> pd.DataFrame:
    out = batch[["digest", "members", "size", "doc_id", "uid"]].copy()
    out["known"] = False
    if not len(index):
        return out
    row = index.iloc[0]
    slots, locators = np.frombuffer(row["digests"], np.uint8).reshape(-1, 32), np.frombuffer(row["locators"], LOCATOR)
    rest = pd.DataFrame({"digest": [x.tobytes() for x in slots], "members": locators["members"], "size": locators["size"].astype(float), "doc_id": pd.array(locators["doc_id"], dtype="Int64"), "uid": locators["uid"], "known": True})
    rest.loc[locators["null"], "doc_id"] = pd.NA
    if not len(batch):
        return rest
    keys = _matrix(batch["digest"])
    at = PerfectHash.from_bytes(row["levels"]).slots(keys)
    at = np.where((at >= 0) & (slots[np.maximum(at, 0)] == keys).all(1), at, -1)
    hit = np.flatnonzero(at >= 0)
    # a member's group is the slot's group and the batch's rows together
    known, new = locators[at[hit]], batch.iloc[hit]
    rest.iloc[at[hit], rest.columns.get_loc("members")] += new["members"].to_numpy()
    none, size, ids = new["doc_id"].isna().to_numpy(), new["size"].to_numpy(np.int64), new["doc_id"].fillna(0).to_numpy(np.int64)
    better = (size > known["size"]) | ((size == known["size"]) & ((none < known["null"]) | ((none == known["null"]) & (ids < known["doc_id"]))))
    for name in ("size", "doc_id", "uid"):
        values = new[name].astype("Int64" if name == "doc_id" else float if name == "size" else "int64")
        rest.iloc[at[hit[better]], rest.columns.get_loc(name)] = values.to_numpy()[better] if name != "doc_id" else values.array[better]
    return pd.concat([rest, out[at < 0]], ignore_index=True)


def resolve(history: DataFrame, batch: DataFrame, buckets: int) -> DataFrame:
    """One row per digest of either side: members, the winner, and whether history knew it."""
    index = build_index(history, buckets)
    batch = batch.withColumn("bucket", _bucket(buckets))
    return index.groupBy("bucket").cogroup(batch.groupBy("bucket")).applyInPandas(_lookup, FOUND)


def exact_dedup(docs: DataFrame, history_ends: int | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, known (history holds the text), for every row.

    Rows with ids up to history_ends are the history, the others the batch that is
    held against it; by default the middle between the smallest and largest id.
    """
    spark = docs.sparkSession
    rows = materialise(digests(docs), "digests")
    if history_ends is None:
        lo, hi = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
        history_ends = (lo + hi) // 2 if lo is not None else 0
    old = F.coalesce(F.col("doc_id") <= history_ends, F.lit(False))
    history, batch = materialise(distinct(rows.where(old)), "history"), materialise(distinct(rows.where(~old)), "batch")
    # either side may hold nearly all digests
    buckets = max(4 * shuffle_partitions(spark), -(-max(history.count(), batch.count()) // BUCKET))
    groups = resolve(history, batch, buckets)
    groups = groups.select("digest", F.col("members").alias("group_size"), F.col("doc_id").alias("keep_id"), F.col("uid").alias("keep_uid"), "known")
    return rows.join(groups, "digest").select(
        "doc_id", "keep_id", "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "known"
    )

