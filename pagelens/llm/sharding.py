"""Two-pass external shuffle of records into shards.

Method: pass one scatters the records uniformly into memory-sized buckets by a seeded
hash of the record; pass two loads one bucket at a time, permutes it by Fisher-Yates with
a seed of its own, and writes it out. A record's place is its bucket's offset plus its
place in the permuted bucket; places are dealt to the shards in turn, so that shard sizes
differ by one record at most (law ``rows``) and slots have no gaps.

Defined cases
  null text      size 8, no bytes, checksum 0
  null id        scattered by its text
  repeated rows  each gets its own place; equal texts spread like any others
  ties           rows of a bucket are ordered by (hash, id, text) before they are
                 permuted, so that the places follow from the rows alone
  empty table    an empty result
  other columns  carried along by shuffle_records, whatever their names; __place, __shard and __slot are replaced
  long texts     one record is never split; a bucket holds bucket_bytes and one record more
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

PLACE, SHARD, SLOT = "__place", "__shard", "__slot"
#: Offsets of up to so many buckets are sent to the tasks; more are joined by shuffle.
SEND_BUCKETS = 10_000
#: Buckets whose sizes are summed in one step when offsets are computed.
OFFSET_STEP = 4096


def _fisher_yates(n: int, seed: int) -> np.ndarray:
    """A uniform permutation of 0..n-1 by swaps from the end with earlier places."""
    order = np.arange(n)
    rng = np.random.Generator(np.random.PCG64(seed))
    swaps = (rng.random(n) * np.arange(1, n + 1)).astype(np.int64).tolist()
    items = order.tolist()
    for i in range(n - 1, 0, -1):
        j = swaps[i]
        items[i], items[j] = items[j], items[i]
    return np.array(items, dtype=np.int64)


def shuffle_records(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", seed: int = 17, bucket_bytes: int = 8 << 20) -> DataFrame:
    """The records in random order with the column __place, 0 to the number of records less one."""
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 8
    total = docs.select(size.alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    buckets = max(1, -(-total // bucket_bytes))
    # copies of a text have different ids and so scatter; without an id the text decides
    order = F.xxhash64(F.lit(seed), F.col(id_col), F.when(F.col(id_col).isNull(), F.col(text_col)))
    scattered = docs.select(F.struct(*docs.columns).alias("row"), order.alias("order")).withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed + 1), "order"), F.lit(buckets)))

    counts = scattered.groupBy("bucket").agg(F.count("*").alias("n")).withColumn("step", F.floor(F.col("bucket") / OFFSET_STEP))
    within = W.Window.partitionBy("step").orderBy("bucket").rowsBetween(W.Window.unboundedPreceding, -1)
    steps = counts.groupBy("step").agg(F.sum("n").alias("n"))
    before = steps.select("step", F.coalesce(F.sum("n").over(W.Window.orderBy("step").rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    offsets = counts.withColumn("within", F.coalesce(F.sum("n").over(within), F.lit(0))).join(before, "step").select("bucket", (F.col("within") + F.col("before")).alias("offset"))

    names = docs.columns
    at_id, at_text = names.index(id_col), names.index(text_col)
    fields = [T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema.fields)]
    schema = T.StructType([*fields, T.StructField("bucket", T.LongType()), T.StructField("place", T.LongType())])

    def permute(table: pa.Table) -> pa.Table:
        own, key = table.column(len(names) + 1)[0].as_py(), table.column(len(names))
        keys = pa.table({"a": key, "b": table.column(at_id), "c": pc.fill_null(table.column(at_text), "")})
        by = [("a", "ascending"), ("b", "ascending")] + ([] if pc.count_distinct(key).as_py() == len(key) else [("c", "ascending")])
        mixed = table.take(pc.sort_indices(keys, sort_keys=by).take(pa.array(_fisher_yates(table.num_rows, (seed << 32) + own))))
        return pa.Table.from_arrays([*mixed.columns[: len(names)], mixed.column(len(names) + 1), pa.chunked_array([pa.array(np.arange(table.num_rows))])], names=schema.names)

    plain = scattered.select(*(F.col("row").getField(c).alias(f"c{i}") for i, c in enumerate(names)), "order", "bucket")
    mixed = plain.groupBy("bucket").applyInArrow(permute, schema)
    placed = mixed.join(F.broadcast(offsets) if buckets <= SEND_BUCKETS else offsets, "bucket")
    return placed.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names) if c != PLACE), (F.col("place") + F.col("offset")).alias(PLACE))


def shard(docs: DataFrame, shards: int = 24, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """shuffle_records with the columns __shard and __slot under the law ``rows``."""
    return shuffle_records(docs, id_col=id_col, text_col=text_col, **how).withColumns({SHARD: F.pmod(PLACE, F.lit(shards)).cast("int"), SLOT: F.floor(F.col(PLACE) / shards).cast("long")})


def write_shards(docs: DataFrame, path: str, shards: int = 24, **how) -> None:
    """Writes the sharded records as Parquet, a folder for each shard, with their slots in __slot.

    The task that holds buckets writes its part of every shard itself, rows of a file in
    slot order, so that no task holds a shard: a shard has as many files as there are
    tasks, each of a task's input over the number of shards.
    """
    out = shard(docs, shards, **how)
    out.sortWithinPartitions(SHARD, SLOT).drop(PLACE).write.partitionBy(SHARD).parquet(path)
