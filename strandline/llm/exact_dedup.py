"""Exact dedup by an extendible-hash index kept in shared files. DataFrame operations only.

1. Keys: every row's 64-bit hash and sha-256 of its normalised text go to a narrow table (id, key, sha, copies).
2. Directory: slots are the keys' first ``depth`` bits. It starts with one bucket and doubles while a bucket holds more
   than ``capacity`` keys; a bucket keeps the local depth at which it last was split. Nothing bounds the depth but the
   64 bits of a key. The directory is a table of (slot, bucket, depth), made by aggregates; it grows with the keys.
3. Index: rows find their bucket through the directory. Copies within a task are combined, in ``SALTS`` parts, so that a hot text
   reaches its owner as so many rows at most. Owners take the ranges of keys that share their first ``OWNER_BITS`` bits: they
   compare the bytes of texts under one key, combine those that are equal, and chain those that differ, in order. They write
   an entry for each link, by bucket, key and place in the chain.
4. Lookup: each row of keys goes through the directory to its bucket, and along the chain of its key to the link of its
   sha-256, the digest that the link's bytes have.

Group sizes do not matter: a text in a third of all rows leaves each task as a few rows, and its lookup uses a
broadcast of the entries that hold more than 1/1024 of all rows, of which there can be at most 1024.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import ascii_lower, fresh, materialize

#: The directory is broadcast up to so many slots (some 20 MB); beyond, it is joined by slot like any other table.
MOST_BROADCAST = 1 << 20
#: An entry is hot if it has more than this part of all rows; so there are at most that many hot entries.
HOT_ENTRIES = 1024
#: Parts of a text's copies that are combined before they meet, and bits of a key that tell its owner.
SALTS, OWNER_BITS = 16, 12


def normalised(text: Column) -> Column:
    """Null as empty; A-Z lower-cased; nothing else changes."""
    return ascii_lower(F.coalesce(text, F.lit("")))


def _slot(depth: int) -> Column:
    return F.shiftrightunsigned("key", 64 - depth) if depth else F.lit(0).cast("long")


def build_directory(keys: DataFrame, capacity: int) -> tuple[DataFrame, int]:
    """(slot, bucket, depth) for each slot that has keys, and the directory's depth. keys: distinct keys.

    Doubling stops when no slot holds more than capacity keys, or at 64 bits, where each key is a slot. The first
    doublings are made at once, as many as the number of keys needs at least; a slot's local depth is the number of its
    prefixes that are overfull, since a prefix is split exactly then. bucket is the first slot of the bucket.
    """
    n = keys.count()
    depth = min(64, max(0, math.ceil(math.log2(max(n, 1) / capacity))) if n > capacity else 0)
    while True:
        slots = materialize(keys.groupBy(_slot(depth).alias("slot")).agg(F.count(F.lit(1)).alias("n")), "dedup-slots")
        if depth == 64 or not (slots.agg(F.max("n")).first()[0] or 0) > capacity:
            break
        depth += 1
    ahead = slots.select("slot", "n", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("bits"))
    prefix = F.when(F.col("bits") == 0, F.lit(0).cast("long")).otherwise(F.expr(f"shiftrightunsigned(slot, {depth} - bits)"))
    ahead = ahead.withColumn("prefix", prefix)
    overfull = ahead.groupBy("bits", "prefix").agg(F.sum("n").alias("all")).filter(F.col("all") > capacity).select("bits", "prefix")
    local = ahead.join(overfull, ["bits", "prefix"]).groupBy("slot").agg(F.count(F.lit(1)).cast("int").alias("depth"))
    # at the last bit an overfull slot can't be split: its keys are one bucket
    found = slots.select("slot").join(local, "slot", "left").select("slot", F.least(F.coalesce("depth", F.lit(0)), F.lit(depth)).alias("depth"))
    drop = f"({depth} - depth)"
    bucket = F.expr(f"CASE WHEN {drop} >= 64 THEN 0L ELSE shiftleft(shiftrightunsigned(slot, {drop}), {drop}) END")
    return materialize(found.select("slot", bucket.alias("bucket"), "depth"), "dedup-directory"), depth


def _located(rows: DataFrame, directory: DataFrame, depth: int) -> DataFrame:
    """rows with the bucket of their key, through the directory; it is broadcast up to MOST_BROADCAST slots."""
    small = depth <= 62 and 1 << depth <= MOST_BROADCAST
    buckets = directory.select("slot", "bucket")
    return rows.withColumn("slot", _slot(depth)).join(F.broadcast(buckets) if small else buckets, "slot").drop("slot")


def build_index(rows: DataFrame, keys: DataFrame, capacity: int = 65_536) -> tuple[DataFrame, int, DataFrame]:
    """(directory, its depth, entries) for rows of (id, key, norm) and a table of their keys.

    entries: (bucket, key, link, sha, size, keep), one for each different text of a key; links are numbered from 1 in text order.
    """
    directory, depth = build_directory(keys.select("key").distinct(), capacity)
    salted = _located(rows, directory, depth).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    parts = salted.groupBy("bucket", "key", "norm", "salt").agg(F.count(F.lit(1)).alias("size"), F.max("id").alias("keep"))
    # a range of keys is one task's; all below finds its rows there
    owned = parts.withColumn("owner", F.shiftrightunsigned("key", 64 - OWNER_BITS)).repartition("owner")
    links = owned.groupBy("owner", "bucket", "key", "norm").agg(F.sum("size").alias("size"), F.max("keep").alias("keep"))
    chain = Window.partitionBy("owner", "bucket", "key").orderBy("norm")
    entries = links.withColumn("link", F.row_number().over(chain)).select("bucket", "key", "link", F.sha2("norm", 256).alias("sha"), "size", "keep")
    return directory, depth, materialize(entries.sortWithinPartitions("bucket", "key", "link"), "dedup-index")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 65_536, key_bits: int = 64) -> DataFrame:
    """One row for each row of docs: id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are identical after A-Z are lower-cased. The largest id of a group stays; of several rows
    with that id and text exactly one is kept. Null texts count as empty and form a group with empty ones. Null ids
    lose against any other; a group of null ids only keeps one of its rows, with a null keep_id. An empty table gives
    an empty result. Other columns of docs play no part, whatever their names. key_bits below 64 makes keys collide,
    for tests.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), normalised(F.col(text_col)).alias("norm"))
    key = F.xxhash64("norm")
    rows = rows.withColumn("key", key if key_bits == 64 else F.shiftleft(F.shiftrightunsigned(key, 64 - key_bits), 64 - key_bits))
    keys = materialize(rows.groupBy("key", F.sha2("norm", 256).alias("sha"), "id").agg(F.count(F.lit(1)).alias("copies")), "dedup-keys")
    directory, depth, index = build_index(rows, keys, capacity)

    total = index.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    found, at = _located(keys, directory, depth), ["bucket", "key", "sha"]
    hot = index.filter(F.col("size") * HOT_ENTRIES > F.lit(total)).drop("link")
    cold = index.filter(F.col("size") * HOT_ENTRIES <= F.lit(total)).drop("link")
    in_hot = found.join(F.broadcast(hot), at)
    in_cold = found.join(F.broadcast(hot.select(*at)), at, "left_anti").join(cold, at)
    out = in_hot.unionByName(in_cold).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select(
        F.col("id").alias(id_col),
        F.col("keep").alias("keep_id"),
        F.col("size").alias("group_size"),
        (F.col("id").eqNullSafe(F.col("keep")) & (F.col("copy") == 1)).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the copies that exact_dedup() does not keep, with all columns."""
    own_sha, kept_id, kept_sha = fresh(docs, "own_sha", "kept_id", "kept_sha")
    judged = materialize(exact_dedup(docs, id_col, text_col), "dedup-judged")
    kept = judged.filter("kept").select(F.col(id_col).alias(kept_id), F.col("text_sha256").alias(kept_sha))
    out = docs.withColumn(own_sha, F.sha2(normalised(F.col(text_col)), 256))
    out = out.join(kept, F.col(id_col).cast("long").eqNullSafe(F.col(kept_id)) & (F.col(own_sha) == F.col(kept_sha)), "left_semi")
    repeated = judged.groupBy(id_col, "text_sha256").count().filter("count > 1")
    if not repeated.isEmpty():  # rows that repeat an id with an equal text: one of them stays
        out = out.dropDuplicates([id_col, own_sha])
    return out.drop(own_sha)
