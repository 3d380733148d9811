"""Nearest neighbours with vantage-point trees.

A small tree over a bounded sample deals all vectors to regions, regions are cut into shards of bounded
size, and each shard gets a tree of its own in a task. A query first searches a shard of its own region;
the distance it has then rules out other regions, and inside shards leaves, by the triangle inequality.
Bounds are compared with ``factor`` times that distance: factor one is exact search, less prunes more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from lectern.llm.shared import staged, table_of

#: Neighbours asked for, and the pruning factor of the registered query.
NEIGHBOURS = 10
FACTOR = 1.0
#: Vectors of a shard (on average; a shard is one tree in one task) and of a leaf.
SHARD_ROWS = 8192
LEAF_ROWS = 256
#: Queries that one task searches in one shard.
QUERY_ROWS = 4096
#: The tree over regions is fitted on at most so many distinct vectors and has at most so many regions; all vectors are indexed.
SAMPLE_ROWS = 4096
REGIONS = 512
#: Queries searched together.
_TOGETHER = 1024


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows of ``a`` and ``b``, squares added in order of the components."""
    if not a.shape[1]:
        return np.zeros(len(a))
    with np.errstate(over="ignore"):
        return np.sqrt(np.add.accumulate(((a - b) ** 2).T, axis=0)[-1])


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``a`` to all of ``b``, for screening; NaN where squares overflow."""
    with np.errstate(over="ignore", invalid="ignore"):
        return (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T)


def slack(*parts: np.ndarray) -> float:
    """What screening by ``squared`` may be off by, as a distance."""
    with np.errstate(over="ignore", invalid="ignore"):
        return 1e-6 * sum(float(np.sqrt((p * p).sum(1)).max(initial=0)) for p in parts)


class Tree:
    """A balanced vantage-point tree: split by rank of the distance to a vantage point, level by level."""

    def __init__(self, vectors: np.ndarray, depth: int, seed: int = 7) -> None:
        random = np.random.default_rng(seed)
        self.vectors, self.depth = vectors, depth
        order = np.arange(len(vectors))
        parts = [order]
        self.vantage, self.bounds = [], []
        for _ in range(depth):
            below, vantage, bounds = [], np.zeros((len(parts), vectors.shape[1])), np.zeros((len(parts), 2, 2))
            for k, part in enumerate(parts):
                own = vectors[part]
                vantage[k] = self._vantage(own, random)
                d = distances(own, vantage[k][None]) if len(own) else np.zeros(0)
                rank = np.argsort(d, kind="stable")
                middle = (len(part) + 1) // 2
                for side, piece in enumerate((rank[:middle], rank[middle:])):
                    bounds[k, side] = (d[piece].min(), d[piece].max()) if len(piece) else (np.inf, -np.inf)
                    below.append(part[piece])
            parts = below
            self.vantage.append(vantage)
            self.bounds.append(bounds)
        self.leaves = parts

    @staticmethod
    def _vantage(own: np.ndarray, random: np.random.Generator) -> np.ndarray:
        """Of a few candidates the one whose distances to a few others spread most."""
        if not len(own):
            return np.zeros(own.shape[1])
        candidates = own[random.integers(0, len(own), 8)]
        others = own[random.integers(0, len(own), 32)]
        spread = np.nan_to_num(squared(candidates, others), nan=0, posinf=0)
        return candidates[int(np.sqrt(np.maximum(spread, 0)).var(axis=1).argmax())]

    def lower_bounds(self, queries: np.ndarray, bounds: list[np.ndarray] | None = None) -> np.ndarray:
        """The least distance that anything in each leaf can have to each query (0 where nothing is known)."""
        least = np.zeros((len(queries), 1))
        for vantage, bound in zip(self.vantage, bounds or self.bounds, strict=True):
            with np.errstate(invalid="ignore"):
                d = np.sqrt(np.maximum(squared(queries, vantage), 0))[:, :, None]
                reach = np.maximum(d - bound[None, :, :, 1], bound[None, :, :, 0] - d)
            reach = np.where(np.isnan(reach), 0, reach)
            least = np.maximum(least[:, :, None], reach).reshape(len(queries), -1)
        return least

    def leaf_of(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf on whose side of every split a vector lies; vectors on a split go inside."""
        leaf = np.zeros(len(vectors), np.int64)
        for vantage, bound in zip(self.vantage, self.bounds, strict=True):
            leaf = 2 * leaf + (distances(vectors, vantage[leaf]) > bound[leaf, 0, 1])
        return leaf

    def open_bounds(self) -> list[np.ndarray]:
        """Bounds that hold for all vectors dealt by ``leaf_of``, not for the fitted ones alone."""
        return [np.stack([np.stack([np.zeros(len(b)), b[:, 0, 1]], 1), np.stack([b[:, 0, 1], np.full(len(b), np.inf)], 1)], 1) for b in self.bounds]


class Nearest:
    """The nearest vectors found so far for some queries: distances and row numbers, ties to the smaller key."""

    def __init__(self, queries: int, k: int, limits: np.ndarray) -> None:
        self.distance = np.full((queries, k), np.inf)
        self.row = np.full((queries, k), -1, np.int64)
        self.limits = limits

    def reach(self) -> np.ndarray:
        """The distance beyond which nothing can be among the nearest."""
        return np.minimum(self.limits, np.where(self.row[:, -1] >= 0, self.distance[:, -1], np.inf))

    def add(self, q: np.ndarray, rows: np.ndarray, distance: np.ndarray, keys: np.ndarray) -> None:
        """Take in candidates (query number, row number, distance), sorted by query number."""
        k = self.distance.shape[1]
        own, first, counts = np.unique(q, return_index=True, return_counts=True)
        width = int(counts.max())
        at = np.repeat(np.arange(len(own)), counts), np.arange(len(q)) - np.repeat(first, counts)
        d, r = np.full((len(own), k + width), np.inf), np.full((len(own), k + width), -1, np.int64)
        d[:, :k], r[:, :k] = self.distance[own], self.row[own]
        d[at[0], at[1] + k], r[at[0], at[1] + k] = distance, rows
        order = np.lexsort((np.where(r >= 0, keys[r], np.iinfo(np.int64).max), d, r < 0), axis=-1)[:, :k]
        self.distance[own], self.row[own] = np.take_along_axis(d, order, 1), np.take_along_axis(r, order, 1)


def search(tree: Tree, keys: np.ndarray, queries: np.ndarray, limits: np.ndarray, k: int, factor: float) -> Nearest:
    """The ``k`` nearest of the tree's vectors for each query, nearest leaves first, none beyond ``limits``.

    Leaves whose lower bound exceeds ``factor`` times the distance reached are passed over.
    """
    nearest = Nearest(len(queries), k, limits)
    off = slack(queries, tree.vectors)
    least = tree.lower_bounds(queries)
    turn = np.argsort(least, axis=1, kind="stable")
    least = np.take_along_axis(least, turn, 1)
    active = np.arange(len(queries))
    for step in range(turn.shape[1]):
        active = active[~(least[active, step] - off > factor * nearest.reach()[active])]
        if not len(active):
            break
        leaf = turn[active, step]
        order = np.argsort(leaf, kind="stable")
        for group in np.split(active[order], np.flatnonzero(np.diff(leaf[order])) + 1):
            rows = tree.leaves[turn[group[0], step]]
            if not len(rows):
                continue
            reach = nearest.reach()[group]
            within = ~(squared(queries[group], tree.vectors[rows]) > ((reach + off) ** 2)[:, None])
            q, r = np.nonzero(within)
            if len(q):
                q, r = group[q], rows[r]
                d = distances(queries[q], tree.vectors[r])
                kept = ~(d > np.repeat(reach, within.sum(1)))
                if kept.any():
                    by = np.argsort(q[kept], kind="stable")
                    nearest.add(q[kept][by], r[kept][by], d[kept][by], keys)
    return nearest


def usable(vector: str | Column) -> Column:
    """Neither null nor all zeros, and no component null, NaN or infinite."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def vectors_of(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Usable vectors of the table's most common length: vec_id, vector (doubles)."""
    rows = table.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable("vector"))
    length = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return rows.where(F.size("vector") == (length["size"] if length else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _regions(points: DataFrame) -> Tree:
    """The tree over regions, fitted on a sample by hash."""
    n = points.count()
    sample = points.select("vector").orderBy(F.xxhash64("vector"), "vector").limit(SAMPLE_ROWS).collect()
    vectors = np.array([r["vector"] for r in sample], float) if sample else np.zeros((0, 0))
    regions = max(1, min(REGIONS, n // SHARD_ROWS, len(sample) // 4))
    return Tree(vectors, regions.bit_length() - 1)


_DEALT = "kind int, id long, ids array<long>, vector array<double>, reach double, region int"


def _deal(rows: DataFrame, tree: Tree, factor: float, home: bool) -> DataFrame:
    """Rows with their own region, or a row for every other region they must search."""
    shared = rows.sparkSession.sparkContext.broadcast(tree)
    schema = pa.schema([("kind", pa.int32()), ("id", pa.int64()), ("ids", pa.list_(pa.int64())), ("vector", pa.list_(pa.float64())), ("reach", pa.float64()), ("region", pa.int32())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        for batch in batches:
            for first in range(0, batch.num_rows, _TOGETHER):
                part = batch.slice(first, _TOGETHER)
                vectors = _matrix(part.column("vector"))
                if home:
                    at, region = np.arange(len(vectors)), tree.leaf_of(vectors)
                else:
                    reach = part.column("reach").to_numpy()
                    least = tree.lower_bounds(vectors, tree.open_bounds())
                    at, region = np.nonzero(~(least - slack(vectors, *tree.vantage) > factor * reach[:, None]))
                part = part.take(pa.array(at))
                yield table_of(schema, region=region, **{c: part.column(c) for c in schema.names[:-1]})

    return rows.select("kind", "id", "ids", "vector", "reach").mapInArrow(deal, _DEALT)


_FOUND = "id long, shard int, region int, distance double, ids array<long>"


def _search_shards(points: DataFrame, queries: DataFrame, k: int, factor: float) -> DataFrame:
    """Search each query in the shard named in its row. Points and queries: kind, id, ids, vector, reach, region, shard.

    A shard that very many queries ask for is copied to several tasks. Rows come to a task sorted, a shard's
    points before its queries: a task holds the points of one shard and a thousand queries at a time.
    """
    shard = ["region", "shard"]
    asked = queries.groupBy(*shard).agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("parts"))
    queries = queries.join(asked, shard).withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int")).drop("parts")
    points = points.join(asked, shard).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    together = points.unionByName(queries).repartition(*shard, "part").sortWithinPartitions(*shard, "part", "kind")
    schema = pa.schema([("id", pa.int64()), ("shard", pa.int32()), ("region", pa.int32()), ("distance", pa.float64()), ("ids", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, index = None, [], None
        for batch in batches:
            region, part, number, kind = (batch.column(c).to_numpy() for c in ("region", "part", "shard", "kind"))
            cuts = np.flatnonzero((np.diff(region) != 0) | (np.diff(part) != 0) | (np.diff(number) != 0) | (np.diff(kind) != 0)) + 1
            for first, last in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if first == last:
                    continue
                if (now := (int(region[first]), int(number[first]), int(part[first]))) != key:
                    key, held, index = now, [], None
                rows = batch.slice(first, last - first)
                if kind[first] == 0:
                    held.append((_matrix(rows.column("vector")), rows.column("ids")))
                    continue
                if not held:
                    continue
                if index is None:
                    vectors, ids = np.concatenate([h[0] for h in held]), pa.concat_arrays([h[1] for h in held])
                    depth = max(0, int(np.ceil(np.log2(max(1, len(vectors)) / LEAF_ROWS))))
                    smallest = ids.flatten().to_numpy(zero_copy_only=False)[ids.offsets.to_numpy()[:-1] - ids.offsets[0].as_py()]
                    index = Tree(vectors, depth), smallest, ids
                for at in range(0, rows.num_rows, _TOGETHER):
                    some = rows.slice(at, _TOGETHER)
                    found = search(index[0], index[1], _matrix(some.column("vector")), some.column("reach").to_numpy(), k, factor)
                    q, place = np.nonzero(found.row >= 0)
                    yield table_of(
                        schema, id=some.column("id").take(pa.array(q)), shard=np.full(len(q), key[1]), region=np.full(len(q), key[0]),
                        distance=found.distance[q, place], ids=index[2].take(pa.array(found.row[q, place])),
                    )

    columns = ["kind", "id", "ids", "vector", "reach", "region", "shard", "part"]
    return together.select(*columns).mapInArrow(run, _FOUND)


def nearest_neighbours(
    table: DataFrame, is_query: Column, k: int = NEIGHBOURS, factor: float = FACTOR, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """The ``k`` nearest rows of ``table`` for each of its rows that ``is_query`` (over vec_id) marks, itself left out.

    Returns query_id, rank (from 1), vec_id, score: nearest first, ties to the smaller vec_id, all other rows if there
    are fewer. ``factor`` 1 returns exactly the nearest rows; a smaller one passes over regions and leaves whose lower
    bound exceeds that part of the distance reached.

    Equal vectors are one point, with the k + 1 smallest ids among them: no query can be shown more of them, so a vector
    that a third of all rows share stays one small row. Rows without an id, with a null, zero or non-finite vector, or with
    one of another length than most vectors have, take no part. A repeated row is a candidate, and a query, once for each
    time it occurs. An empty table has no result. Other columns of the table are not looked at.
    """
    rows = vectors_of(table, id_col, vector_col)
    by_id = Window.partitionBy("vector").orderBy("vec_id")
    points = rows.withColumn("place", F.row_number().over(by_id)).where(F.col("place") <= k + 1).groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    points = staged(points.select(F.lit(0).alias("kind"), F.col("ids")[0].alias("id"), "ids", "vector", F.lit(0.0).alias("reach")), "points")
    tree = _regions(points)
    points = staged(_deal(points, tree, factor, home=True), "dealt-points")
    sizes = points.groupBy("region").agg(F.ceil(F.count("*") / SHARD_ROWS).cast("int").alias("shards"))
    shards = points.join(sizes, "region").withColumn("shard", F.pmod(F.xxhash64("vector"), "shards").cast("int")).drop("shards")

    asking = rows.where(is_query).select(F.lit(1).alias("kind"), F.col("vec_id"), F.array("vec_id").alias("ids"), "vector", F.lit(float("inf")).alias("reach"))
    asking = staged(asking.drop("vec_id").withColumn("id", F.monotonically_increasing_id()), "queries")
    home = _deal(asking, tree, factor, home=True).join(sizes, "region").withColumn("shard", F.pmod(F.xxhash64("id"), "shards").cast("int")).drop("shards")
    first = staged(_search_shards(shards, home, k + 1, factor), "first-search")

    reach = first.groupBy("id").agg(F.count("*").alias("found"), F.max("distance").alias("farthest"), F.first("region").alias("own_region"), F.first("shard").alias("own_shard"))
    reach = reach.select("id", "own_region", "own_shard", F.when(F.col("found") > k, F.col("farthest")).alias("known"))
    known = asking.join(reach, "id", "left").withColumn("reach", F.coalesce("known", "reach"))
    others = _deal(known, tree, factor, home=False).join(sizes, "region").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).drop("shards")
    others = others.join(reach.drop("known"), "id", "left").where(~(F.col("region").eqNullSafe(F.col("own_region")) & F.col("shard").eqNullSafe(F.col("own_shard"))))
    second = _search_shards(shards, staged(others.drop("own_region", "own_shard"), "other-shards"), k + 1, factor)

    # The k + 1 nearest hold the query's own row, unless k others at distance 0 have smaller ids.
    near = first.unionByName(second).select("id", "distance", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("id").orderBy("distance", "vec_id")
    near = near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    near = near.join(asking.select("id", F.col("ids")[0].alias("query_id")), "id")
    own = Window.partitionBy("id", "is_own").orderBy("place")
    near = near.withColumn("is_own", (F.col("vec_id") == F.col("query_id")) & (F.col("distance") == 0)).withColumn("time", F.row_number().over(own))
    near = near.where(~(F.col("is_own") & (F.col("time") == 1))).withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("place")))
    return near.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.col("distance").alias("score"))


def oracle_sql(k: int = NEIGHBOURS) -> str:
    """Exact search (factor 1) for every hundredth row of ``embeddings`` in DuckDB."""
    return f"""
    WITH usable AS (
        SELECT vec_id, embedding::DOUBLE[] AS vector
        FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    ),
    vectors AS (
        SELECT row_number() OVER () AS row, vec_id, vector
        FROM usable
        WHERE len(vector) = (SELECT len(vector) FROM usable GROUP BY len(vector) ORDER BY count(*) DESC, len(vector) DESC LIMIT 1)
    ),
    pairs AS (
        SELECT q.row, q.vec_id AS query_id, c.vec_id,
            sqrt(list_reduce(list_transform(list_zip(q.vector, c.vector), lambda p: (p[1] - p[2]) * (p[1] - p[2])), lambda a, b: a + b)) AS score
        FROM vectors q JOIN vectors c ON q.row <> c.row
        WHERE q.vec_id % 100 = 0
    ),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score, vec_id)::INTEGER AS rank FROM pairs)
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {k}
    """
