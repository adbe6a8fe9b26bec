"""Exact deduplication through an extendible-hash index (DataFrame operations only).

1. Entries. Every text is normalised and hashed to 64 bits. Grouping by (hash, text) compares
   bytes: a grouping key is equal only when every byte is. Spark combines the entries of a task
   before the exchange, so a group that holds a third of all rows arrives as one entry per task.
2. Directory. Hash prefixes are counted at the global depth; a bucket over ``capacity`` entries
   splits by one more bit until it fits. While some prefix of the global depth is still overfull and
   holds more than one hash, the directory doubles: the global depth grows by STEP bits. So a bucket is
   over its capacity only if all of its entries collide in one hash. The directory has a slot per prefix
   in use, and slots of one bucket share its local depth.
3. Index. Owner tasks take ranges of (bucket, hash); the texts of one hash form a chain. The index
   is a table in the shared folder.
4. Probe. Every document finds its bucket by its slot of the directory, its chain by bucket and hash,
   and there the entry with its own SHA-256.

Defined results: a null text counts as empty, and empty texts equal each other. A row without id
never stays unless no row of its group has an id. Rows that repeat one id stay or go together.
An empty table gives no rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import common

#: Entries of a bucket before it splits.
CAPACITY = 4096
#: Bits by which the directory grows when it doubles, and at most; equal hashes form a chain.
STEP, MAX_DEPTH = 2, 62


def normalised(column: str = "text") -> Column:
    """The text with every run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(F.col(column), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def entries(docs: DataFrame) -> DataFrame:
    """(hash, text_sha256, keep_id, group_size), one row per distinct normalised text."""
    rows = docs.select("doc_id", normalised().alias("norm")).select("doc_id", "norm", F.xxhash64("norm").alias("hash"))
    same = rows.groupBy("hash", "norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return same.select("hash", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size")


def directory(found: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, int]:
    """(slot, local_depth, bucket) for each used slot, and the global depth."""
    n = found.count()
    depth = min(MAX_DEPTH, max(1, math.ceil(math.log2(max(1.0, n / capacity))) + 2))
    while depth < MAX_DEPTH:
        full = found.groupBy(slot_of(depth)).agg(F.count(F.lit(1)).alias("n"), F.min("hash").alias("lo"), F.max("hash").alias("hi"))
        if not full.where((F.col("n") > capacity) & (F.col("lo") < F.col("hi"))).limit(1).count():
            break
        depth = min(MAX_DEPTH, depth + STEP)
    slots = found.groupBy(slot_of(depth).alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    path = slots.select("slot", "n", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level"))
    path = path.withColumn("prefix", F.expr(f"shiftright(slot, {depth} - level)"))
    load = path.groupBy("level", "prefix").agg(F.sum("n").alias("load"))
    fits = F.min(F.when(F.col("load") <= capacity, F.col("level")))
    out = path.join(load, ["level", "prefix"]).groupBy("slot").agg(F.coalesce(fits, F.lit(depth)).alias("local_depth"))
    first = F.expr(f"shiftleft(shiftright(slot, {depth} - local_depth), {depth} - local_depth)")
    return out.withColumn("bucket", first), depth


def slot_of(depth: int) -> Column:
    return F.shiftrightunsigned(F.col("hash"), 64 - depth)


def in_bucket(rows: DataFrame, slots: DataFrame, depth: int) -> DataFrame:
    """The rows with the bucket of their hash, by a look-up in the directory."""
    own = slots.select("slot", "bucket")
    own = F.broadcast(own) if own.count() <= common.BROADCAST_IDS else own.hint("merge")
    return rows.withColumn("slot", slot_of(depth)).join(own, "slot").drop("slot")


def build_index(docs: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, DataFrame, int]:
    """(bucket, hash, chain), written to the shared folder by owners of key ranges; its directory and global depth."""
    found = common.materialize(entries(docs), "exact-entries")
    slots, depth = directory(found, capacity)
    slots = common.materialize(slots, "exact-directory")
    owners = max(1, int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    owned = in_bucket(found, slots, depth).select("bucket", "hash", "keep_id", "group_size", "text_sha256").repartitionByRange(owners, "bucket", "hash")
    link = F.struct("keep_id", "group_size", "text_sha256")
    index = common.materialize(owned.groupBy("bucket", "hash").agg(F.array_sort(F.collect_list(link)).alias("chain")), "exact-index")
    common.release(found)
    return index, slots, depth


def groups(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    index, slots, depth = build_index(docs, capacity)
    rows = docs.select("doc_id", normalised().alias("norm")).select("doc_id", F.xxhash64("norm").alias("hash"), F.sha2("norm", 256).alias("text_sha256"))
    found = in_bucket(rows, slots, depth).join(index.hint("merge"), ["bucket", "hash"])
    hit = F.filter("chain", lambda x: x["text_sha256"] == F.col("text_sha256"))[0]
    found = found.select("doc_id", hit.alias("hit"), "text_sha256")
    out = found.select("doc_id", F.col("hit.keep_id").alias("keep_id"), F.col("hit.group_size").alias("group_size"), F.coalesce(F.col("doc_id").eqNullSafe(F.col("hit.keep_id")), F.lit(False)).alias("kept"), "text_sha256")
    return common.reading(out, index, slots)


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns."""
    found = groups(docs)
    gone = common.materialize(found.where(~F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id").distinct(), "exact-gone")
    common.release(found)
    return common.reading(common.keep_ids(docs, gone, "doc_id", "left_anti"), gone)
