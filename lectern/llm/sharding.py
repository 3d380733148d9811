"""Two-pass external shuffle of documents into shards of equal row counts.

Pass one scatters rows by a seeded hash into buckets sized to memory; the number of
buckets follows from the table's bytes. Pass two brings each bucket into a fixed order, shuffles
it with Fisher-Yates from a seed of its own, and writes it. Buckets follow one another, so a
row's place in the shuffled whole is its bucket's offset plus its place there; shard k takes the
k-th run of places and counts differ by at most one.

Defined results: a null text has size 1 and stays null; null and repeated ids spread over the buckets
and repeated rows are kept, each with its own slot; a very long text makes its bucket larger than
the others by itself; an empty table gives no rows; columns named shard or slot in the table are
replaced by the new ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from lectern.llm.shared import free_names, staged

SHARDS = 16
SEED = 20240229
BUCKET_BYTES = 24 << 20
#: Buckets that a task reads, on average, on tables of very many buckets.
TASK_BUCKETS = 8
#: Buckets whose offsets are sent to every worker, at most.
BROADCAST_BUCKETS = 1 << 20


def sizes(text_col: str = "text"):
    """UTF-8 bytes of a text plus one."""
    return (F.coalesce(F.octet_length(F.col(f"`{text_col}`")), F.lit(0)) + 1).cast("long")


def fisher_yates(n: int, seed: int) -> np.ndarray:
    """A uniform permutation of n places: numpy's shuffle swaps every place with one at or before it."""
    places = np.arange(n)
    np.random.default_rng(seed).shuffle(places)
    return places


def bucket_offsets(counts: DataFrame, bucket: str, group: int = 1 << 12) -> DataFrame:
    """(bucket, offset) of (bucket, count): rows in all buckets before.

    Sums of runs of ``group`` buckets first, then inside each run, so no task sees more buckets than that
    (and one more sum for each run).
    """
    runs = counts.withColumn("run", F.floor(F.col(bucket) / group))
    sums = runs.groupBy("run").agg(F.sum("count").alias("rows"))
    before = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("run", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("run").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    own = runs.withColumn("own", F.coalesce(F.sum("count").over(inside), F.lit(0)))
    return own.join(sums, "run").select(bucket, (F.col("base") + F.col("own")).alias("offset"))


def shuffle_into_buckets(docs: DataFrame, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, str, str, int]:
    """All rows dealt to buckets and shuffled in them, with the names of the columns of the bucket and of the place in it, and the number of buckets.

    A bucket is a hash of the row's number and id, so neither null nor repeated ids, nor rows repeated as a whole,
    gather in one. Rows are read once for their sizes and moved once.
    """
    names = docs.columns
    row, bucket, place = free_names(docs, "row", "bucket", "place")
    total = docs.agg(F.sum(sizes(text_col))).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    dealt = docs.withColumn(row, F.monotonically_increasing_id())
    dealt = dealt.withColumn(bucket, F.pmod(F.xxhash64(F.lit(seed), F.col(f"`{id_col}`"), F.col(row)), F.lit(buckets)))
    order = [(names.index(id_col), "ascending"), (names.index(text_col), "ascending"), (len(names), "ascending")]

    def shuffled(group: pa.Table) -> pa.Table:
        number = group.column(len(names) + 1)[0].as_py()
        plain = group.rename_columns([str(k) for k in range(group.num_columns)])
        plain = plain.sort_by([(str(k), way) for k, way in order]).take(pa.array(fisher_yates(len(plain), seed + number)))
        columns = [*plain.columns[: len(names)], plain.columns[-1], pa.array(np.arange(len(plain)))]
        return pa.Table.from_arrays(columns, names=[*names, bucket, place])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + f", `{bucket}` long, `{place}` long"
    # A task holds one bucket at a time and reads a few.
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-buckets // TASK_BUCKETS))
    dealt = dealt.select(*[F.col(f"`{c}`") for c in names], row, bucket).repartition(tasks, bucket)
    return dealt.groupBy(bucket).applyInArrow(shuffled, schema), bucket, place, buckets


def write_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the shuffled buckets to the shared folder; returns the written rows with ``shard`` and ``slot``.

    A shard is the k-th run of buckets, cut to equal counts: its rows stand one after another in the files of its
    buckets, in slot order.
    """
    docs = docs.drop("shard", "slot")
    made, bucket, place, buckets = shuffle_into_buckets(docs, seed, bucket_bytes, id_col, text_col)
    written = staged(made, "shuffled-buckets")
    counts = written.groupBy(bucket).agg(F.count("*").alias("count"))
    offset, = free_names(written, "offset")
    offsets = bucket_offsets(counts, bucket).withColumnRenamed("offset", offset)
    # 16 bytes a bucket; beyond the limit the join moves the rows.
    placed = written.join(F.broadcast(offsets) if buckets <= BROADCAST_BUCKETS else offsets, bucket)
    n = written.count()
    each, extra = divmod(n, shards)
    at = F.col(offset) + F.col(place)
    wide = extra * (each + 1)  # rows in shards with one row more
    shard = F.when(at < wide, F.floor(at / (each + 1))).otherwise(extra + F.floor((at - wide) / max(each, 1)))
    slot = at - F.when(at < wide, F.col("shard") * (each + 1)).otherwise(wide + (F.col("shard") - extra) * each)
    placed = placed.withColumn("shard", shard.cast("int")).withColumn("slot", slot.cast("long"))
    return placed.select(*[F.col(f"`{c}`") for c in docs.columns], "shard", "slot")
