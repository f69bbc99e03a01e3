"""Exact top-k inner products by Fagin's threshold algorithm.

Blocks.  Vectors are grouped by the dimension that is largest in them and its sign; large groups are dealt into blocks of about
BLOCK rows, small ones share one.  A block has a sorted list for each dimension; they are sorted once, and all queries pass by
them.

Search.  A query goes down all lists in step, from the end that its sign favours.  Vectors that are met for the first time are scored in
full; the sum of what the lists hold at that depth bounds every vector not met, and the search stops when the bound is below the
k-th score so far (at equality a smaller id might still come, so it goes on) or all vectors are met.  No vector is scored twice, and no other way of search is
taken: where the bound falls slowly, lists are walked far.  A query is first searched in the block that it stands in; its k-th score
there is its floor in all others.

Pairs of queries and blocks.  A block's bounds, the largest and smallest entry of each dimension, are one row.  Queries meet these rows
first, as matrices; only queries whose bound reaches their floor go to the block's vectors.  Queries are a stated set, so
this is a search in blocks and not a join of all rows with all.

Edge cases: vectors that are null, or hold a null or a number that is not finite, and rows without vec_id take no
part; a query's own row is no candidate of its own; rows of one vec_id are candidates each, and queries each; ties go to the smaller
vec_id; vectors of other lengths count as padded with zeros; scores of integers beyond 2^53 are summed exactly as
64-bit integers (and must fit there); empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import save

K, SCALE = 20, 64
#: Candidates and queries to a block, and blocks whose bounds are one row, about.
BLOCK, QUERIES, BOUNDS = 16_384, 4096, 1024
#: Each round of a search goes so many times as deep as the one before.
DEEPER = 1.5
HITS = "query long, query_id long, vec_id long, score long"


class SortedLists:
    """A block of vectors (one a row) with lists for each dimension, from its smallest value up and from its largest down."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        order = np.lexsort((rows, ids))
        self.rows, self.ids, self.vectors = rows[order], ids[order], vectors[order]
        m, width = vectors.shape
        depths = [1]
        while depths[-1] < m:
            depths.append(min(m, int(depths[-1] * DEEPER) + 1))
        self.depths = np.array(depths)
        up = np.argsort(self.vectors, axis=0, kind="stable").astype(np.int32)
        #: for either sign of a weight
        self.lists = np.stack([up.T, up[::-1].T])
        columns = np.arange(width)
        self.least, self.most = (self.vectors[edge[self.depths - 1], columns] for edge in (up, up[::-1]))
        #: Length of the longest vector, and a little.
        self.longest = 1 + 1.001 * float(np.sqrt((self.vectors.astype(float) ** 2).sum(axis=1).max(initial=0)))
        #: Vectors scored, and depths at which searches stopped, so far.
        self.scored, self.stopped = 0, []

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """What no vector below each depth can beat; (queries, depths)."""
        return np.maximum(queries, 0) @ self.most.T + np.minimum(queries, 0) @ self.least.T

    def best(self, places: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best, ties to smaller ids, which are earlier places."""
        if len(scores) > k:
            likely = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
            places, scores = places[likely], scores[likely]
        first = np.lexsort((places, -scores))[:k]
        return places[first], scores[first]

    def top(self, own: np.ndarray, queries: np.ndarray, k: int, floors: np.ndarray | None = None):
        """(query's place, places, scores) of the k best of each query; with floors, at least those that reach them."""
        for i, bound in enumerate(self.bounds(queries)):
            query, floor = queries[i], None if floors is None else floors[i]
            if floor is not None and bound[0] < floor:
                continue
            dims = np.flatnonzero(query)
            signs = (query[dims] > 0).astype(int)
            met = self.rows == own[i]
            left, places, scores, depth = len(met) - int(met.sum()), np.empty(0, np.int64), np.empty(0, queries.dtype), 0
            # while the bound is above what any vector of the block can score, no search stops
            attainable = self.longest * (1 + float(np.sqrt((query.astype(float) ** 2).sum())))
            first = min(int((bound >= attainable).sum()), len(bound) - 1)
            for deeper, least in zip(self.depths[first:].tolist(), bound[first:], strict=True):
                known = met.copy()
                met[self.lists[signs, dims, depth:deeper]] = True
                if not len(dims):
                    met[:] = True
                new, depth = np.flatnonzero(met & ~known), deeper
                left -= len(new)
                self.scored += len(new)
                places, scores = self.best(np.concatenate([places, new]), np.concatenate([scores, self.vectors.take(new, axis=0) @ query]), k)
                least_score = scores[-1] if len(scores) == k else None
                threshold = least_score if floor is None else floor if least_score is None else max(floor, least_score)
                if not left or (threshold is not None and least < threshold):
                    break
            self.stopped.append(int(depth))
            yield i, places, scores


def matrix(lists) -> np.ndarray:
    """Lists of integers as rows, the shorter ones padded with zeros."""
    lengths, values = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()
    if len(lengths) and (lengths == lengths[0]).all():
        return values.reshape(len(lengths), -1)
    out = np.zeros((len(lengths), int(lengths.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = values
    return out


def padded(x: np.ndarray, width: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, width - x.shape[1])))


def dtype_for(*arrays: np.ndarray) -> type:
    """The fastest type in which inner products of these integers are exact."""
    largest = float(arrays[0].shape[1])
    for a in arrays:
        largest *= float(np.abs(a).max(initial=0))
    return np.float32 if largest < 2**24 else np.float64 if largest < 2**53 else np.int64


def floors_as(floors: np.ndarray, kind: type) -> np.ndarray:
    """Floors, NaN where there is none, in the type of the scores."""
    least = np.iinfo(np.int64).min if kind is np.int64 else -np.inf
    return np.where(np.isnan(floors), least, np.nan_to_num(floors)).astype(kind)


def search(batches, k: int):
    """Rows (block, rows, ids, vectors, query rows, query ids, query vectors, floors) -> HITS.

    Queries without floors are those of the block itself.  Rows of a block follow each other."""
    last, lists = None, None
    for batch in batches:
        for r in range(batch.num_rows):
            block, rows, ids, vectors, own, own_ids, queries, floors = (c[r] for c in batch.columns)
            block, own, own_ids, q = block.as_py(), own.values.to_numpy(), own_ids.values.to_numpy(), matrix(queries.values)
            x = matrix(vectors.values) if last is None or last[0] != block else last[1]
            width = max(x.shape[1], q.shape[1])
            kind = dtype_for(padded(x, width), padded(q, width))
            if last is None or last[0] != block or last[2:] != (width, kind):
                last, lists = (block, x, width, kind), SortedLists(rows.values.to_numpy(), ids.values.to_numpy(), padded(x, width).astype(kind))
            floor = floors_as(floors.values.to_numpy(zero_copy_only=False), kind) if floors.is_valid else None
            found = list(lists.top(own, padded(q, width).astype(kind), k, floor))
            whose = np.repeat([i for i, *_ in found], [len(places) for _, places, _ in found]).astype(int)
            places, scores = (np.concatenate([f[c] for f in found]) if found else np.empty(0, int) for c in (1, 2))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (own[whose], own_ids[whose], lists.ids[places], scores.astype(np.int64))], names=[f.split()[0] for f in HITS.split(", ")])


SENT = "block int, query_rows array<long>, query_ids array<long>, queries array<array<long>>, floors array<double>"


def reaching(batches):
    """Rows (blocks, most, least, query rows, query ids, queries, homes, floors) -> SENT: for each block the queries that it may serve."""
    for batch in batches:
        for r in range(batch.num_rows):
            blocks, most, least, rows, ids, queries, homes, floors = (c[r] for c in batch.columns)
            blocks, homes = blocks.values.to_numpy(), homes.values.to_numpy()
            q, hi, lo = matrix(queries.values), matrix(most.values), matrix(least.values)
            width = max(q.shape[1], hi.shape[1])
            q, hi, lo = (padded(v, width) for v in (q, np.maximum(hi, 0), np.minimum(lo, 0)))  # shorter vectors hold zeros
            kind = dtype_for(q, np.maximum(hi, -lo))
            q, hi, lo = (v.astype(kind) for v in (q, hi, lo))
            bound = np.maximum(q, 0) @ hi.T + np.minimum(q, 0) @ lo.T
            sent = (bound >= floors_as(floors.values.to_numpy(zero_copy_only=False), kind)[:, None]) & (homes[:, None] != blocks)
            for j in np.flatnonzero(sent.any(axis=0)):
                some = pa.array(np.flatnonzero(sent[:, j]))
                lists = [v.values.take(some) for v in (rows, ids, queries, floors)]
                columns = [pa.array([blocks[j]], pa.int32()), *(pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), v) for v in lists)]
                yield pa.RecordBatch.from_arrays(columns, names=["block", "query_rows", "query_ids", "queries", "floors"])


def quantised(embedding: Column) -> Column:
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * SCALE))


def starts(sizes: list[int]) -> tuple[list[int], list[int], int]:
    """(first block, number of blocks) of each group, and the number of all: large groups have blocks of their own, small ones share."""
    first, parts, at, held = [], [], 0, 0
    for n in sizes:
        if held and held + n > BLOCK:
            at, held = at + 1, 0
        first.append(at)
        parts.append(max(1, n // BLOCK))
        if parts[-1] > 1:
            at, held = at + parts[-1], 0
        else:
            held += n
    return first, parts, at + bool(held)


def top_k(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score); vectors: (vec_id, embedding)."""
    spark = vectors.sparkSession
    wrong = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    used = vectors.where(F.col("embedding").isNotNull() & ~wrong & F.col("vec_id").isNotNull())
    used = used.select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding")).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    used = used.withColumn("sizes", F.transform("v", lambda x: F.abs(x))).withColumn("at", F.coalesce(F.array_position("sizes", F.array_max("sizes")), F.lit(0)).cast("int"))
    group = F.when(F.get("v", F.col("at") - 1) < 0, -F.col("at")).otherwise(F.col("at")).alias("g")
    used = save(used.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v", "asks", group), "vectors")

    groups = used.groupBy("g").agg(F.count("*").alias("n"), F.count_if("asks").alias("asking")).orderBy("g").collect()  # two rows a dimension at most
    first, parts, count = starts([r.n for r in groups])
    of = spark.createDataFrame([(r.g, p, at) for r, p, at in zip(groups, parts, first, strict=True)], "of int, parts int, start int")
    asking = max(1, -(-sum(r.asking for r in groups) // QUERIES))
    block = (F.col("start") + F.pmod(F.xxhash64("row"), F.col("parts"))).cast("int").alias("block")
    used = used.join(F.broadcast(of), F.col("g") == F.col("of")).select("row", "vec_id", "v", "asks", block)

    blocks = save(used.groupBy("block").agg(F.collect_list(F.struct("row", "vec_id", "v", "asks")).alias("x")), "blocks")
    side = [F.col("block"), F.col("x.row").alias("rows"), F.col("x.vec_id").alias("ids"), F.col("x.v").alias("vectors")]
    mine = blocks.withColumn("q", F.filter("x", lambda e: e["asks"])).where(F.size("q") > 0)
    mine = mine.select(*side, F.col("q.row").alias("query_rows"), F.col("q.vec_id").alias("query_ids"), F.col("q.v").alias("queries"), F.lit(None).cast("array<double>").alias("floors"))
    own = save(mine.mapInArrow(lambda batches: search(batches, k), HITS), "own")

    floors = own.groupBy("query").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    queries = used.where("asks").join(floors, F.col("row") == F.col("query"), "left").select("row", "vec_id", "v", "block", "floor")
    # a floor that a double cannot hold is left out
    floor = F.coalesce(F.when(F.abs("floor") < 2**53, F.col("floor").cast("double")), F.lit(float("nan"))).alias("floor")
    queries = queries.groupBy(F.pmod(F.xxhash64("row", F.lit("query")), F.lit(asking)).alias("b")).agg(F.collect_list(F.struct("row", "vec_id", "v", "block", floor)).alias("q"))
    rows = -(-count // BOUNDS)
    queries = queries.select("q", F.explode(F.sequence(F.lit(0), F.lit(max(rows - 1, 0)))).alias("bounds"))
    # the largest and smallest entry of each dimension, a row a block; as many blocks as BOUNDS to a row
    edge = lambda pick: F.aggregate("x", F.lit(None).cast("array<long>"), lambda a, e: F.when(a.isNull(), e["v"]).otherwise(F.zip_with(a, e["v"], lambda p, q: pick(F.coalesce(p, F.lit(0).cast("long")), F.coalesce(q, F.lit(0).cast("long"))))))
    edges = blocks.select("block", edge(F.greatest).alias("most"), edge(F.least).alias("least"))
    edges = edges.groupBy(F.pmod("block", F.lit(max(rows, 1))).alias("bounds")).agg(F.collect_list(F.struct("block", "most", "least")).alias("e"))
    both = queries.join(edges, "bounds").select(*(F.col(f"e.{c}").alias(f"e_{c}") for c in ("block", "most", "least")), *(F.col(f"q.{c}").alias(f"q_{c}") for c in ("row", "vec_id", "v", "block", "floor")))
    sent = both.mapInArrow(reaching, SENT)
    away = sent.hint("merge").join(blocks, "block").select(*side, "query_rows", "query_ids", "queries", "floors")
    hits = away.mapInArrow(lambda batches: search(batches, k), HITS).unionByName(own)
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = f"""
with v as materialized (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as e from embeddings
           where embedding is not null and vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.r as query, q.vec_id as query_id, c.vec_id, list_inner_product(q.e::double[], c.e::double[])::bigint as score
      from v q join v c on q.vec_id % 20 = 0 and c.r <> q.r),
r as (select *, row_number() over (partition by query order by score desc, vec_id) as rank from s)
select query_id, rank::integer as rank, vec_id, score from r where rank <= {K}
"""
