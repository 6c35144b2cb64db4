"""Exact top-k by inner product with MaxScore.

Each dimension is a query term. Its bound for a shard is the largest product the
shard's values allow. Terms are ordered by bound; the trailing ones whose bounds
together can't lift a vector over the current k-th score are non-essential. The
essential ones are scored for every vector of the shard; the others are probed
only for vectors that are still competitive. A query's k-th score is carried from
shard to shard of a task, and shards are merged in the end.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoframe.llm.common import arrow_map, table

QUERY_BLOCK, SHARD = 256, 2048
#: Shards that one task meets every query block with.
GROUP = 2
#: Query blocks whose k-th scores a task keeps.
CARRIED = 4096
#: Sums of products below this are exact in doubles.
EXACT = float(2**53)
#: Vectors looked at together while thresholds rise, and terms probed together.
STEP, PROBE = 512, 8


def _plain(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int):
    """The same by Python's integers, for components so large that doubles would not be exact; scores beyond 64 bits become the nearest long."""
    whole = [[int(c) for c in v] for v in vectors]
    for query, own in zip(queries, query_ids, strict=True):
        q = [int(c) for c in query]
        clipped = lambda v: max(min(sum(a * b for a, b in zip(q, v, strict=True)), 2**63 - 1), -(2**63))  # noqa: E731, B023
        scored = sorted((-clipped(v), int(name)) for v, name in zip(whole, ids, strict=True) if name != own)[:k]
        yield own, [(-s, name) for s, name in scored]


def max_score(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, floors: np.ndarray | None = None):
    """The k best rows of `vectors` for each row of `queries`: lists of (score, id).

    Both hold integers as float64; where sums might reach 2**53, Python's integers
    are used instead. Vectors with the query's own id take no part. Ties go to the
    smaller id. floors: for each query the k-th best score met elsewhere; vectors
    below it may be left out. It is raised in place.
    """
    if np.abs(queries).max(initial=0) * np.abs(vectors).max(initial=0) * max(vectors.shape[1], 1) >= EXACT:
        yield from _plain(queries, query_ids, vectors, ids, k)
        return
    floors = np.full(len(queries), -np.inf) if floors is None else floors
    high, low = vectors.max(axis=0), vectors.min(axis=0)
    order = np.argsort(ids, kind="stable")  # in id order, a later equal score never displaces an earlier one
    vectors, ids = vectors[order], ids[order]
    for n, (query, own) in enumerate(zip(queries, query_ids, strict=True)):
        bound = np.maximum(query * high, query * low)
        terms = np.argsort(-bound, kind="stable")
        rest = np.concatenate([np.cumsum(bound[terms][::-1])[::-1], [0.0]])  # bound of the terms from each place on
        best_score, best_id = np.empty(0), np.empty(0, np.int64)
        for at in range(0, len(ids), STEP):
            block, names = vectors[at : at + STEP], ids[at : at + STEP]
            floor = floors[n]
            essential = int(np.searchsorted(-rest, -floor, side="right")) if np.isfinite(floor) else len(terms)
            essential = min(len(terms), max(essential, PROBE))
            score = block[:, terms[:essential]] @ query[terms[:essential]]
            alive = np.flatnonzero((names != own) & (score + rest[essential] >= floor))
            score = score[alive]
            for j in range(essential, len(terms), PROBE):
                if not len(alive):
                    break
                part = terms[j : j + PROBE]
                score = score + block[alive][:, part] @ query[part]
                still = score + rest[min(j + PROBE, len(terms))] >= floor
                alive, score = alive[still], score[still]
            if len(alive):
                best_score, best_id = np.concatenate([best_score, score]), np.concatenate([best_id, names[alive]])
                top = np.lexsort((best_id, -best_score))[:k]
                best_score, best_id = best_score[top], best_id[top]
                if len(best_score) == k:
                    floors[n] = max(floors[n], best_score[-1])
        yield own, list(zip(best_score.astype(np.int64).tolist(), best_id.tolist(), strict=True))


def _packed(vectors: DataFrame, size: int, scale: int) -> DataFrame:
    """Rows of up to `size` vectors: ids and integer components as bytes, with their width."""

    def rows(batch):
        held = []
        for key, x in zip(batch["id"], batch["v"], strict=True):
            if key is None or x is None or any(c is None for c in x):
                continue
            a = np.asarray(x, np.float64)
            if not np.isfinite(a).all():
                continue
            held.append((key, np.floor(scale * a)))
        if held:
            width = max(len(a) for _, a in held)
            whole = np.zeros((len(held), width))
            for i, (_, a) in enumerate(held):
                whole[i, : len(a)] = a
            for at in range(0, len(held), size):
                keys = np.array([key for key, _ in held[at : at + size]], np.int64)
                yield (keys.tobytes(), whole[at : at + size].tobytes(), width)

    return arrow_map(vectors, rows, "ids binary, packed binary, width int", batch_rows=size)


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, groups: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k best other rows for each query row (id divisible by `every`), by integer inner product.

    Components become floor(scale * x). Returns query_id, rank, vec_id, score;
    ties go to the smaller id. Null ids, null vectors and vectors with null or
    non-finite components take no part; a shorter vector counts as padded with
    zeros. Rows with the query's id are not its candidates; repeated ids stay
    apart as candidates of other queries. An empty table gives an empty result.
    Components of any finite size count exactly; scores beyond 64 bits become the
    nearest long. Other columns are ignored.

    Vectors travel packed, SHARD to a row; query blocks are dealt to the groups
    of shards by an equi-join, and one pair of a block and a shard is in memory
    at a time. A query's list from each shard has k rows at most. `groups` follows
    from the number of rows: GROUP shards to each.
    """
    if groups is None:
        groups = max(1, -(-vectors.count() // (GROUP * SHARD)))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    shards = _packed(rows, SHARD, scale).withColumn("g", F.pmod(F.xxhash64("ids"), F.lit(groups)))
    asked = _packed(rows.filter(F.col("id") % every == 0), QUERY_BLOCK, scale).select(F.col("ids").alias("q_ids"), F.col("packed").alias("q_packed"), F.col("width").alias("q_width"))
    asked = asked.withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))

    floors: dict[bytes, np.ndarray] = {}

    def pair(batch):
        for q_ids, q_packed, q_width, ids, packed, width in zip(*(batch[c] for c in ("q_ids", "q_packed", "q_width", "ids", "packed", "width")), strict=True):
            q_ids, ids = np.frombuffer(q_ids, np.int64), np.frombuffer(ids, np.int64)
            queries, rows_ = np.frombuffer(q_packed).reshape(len(q_ids), q_width), np.frombuffer(packed).reshape(len(ids), width)
            same = min(q_width, width)  # what one side lacks counts as zero
            if len(floors) >= CARRIED:
                floors.clear()
            floor = floors.setdefault(q_ids.tobytes(), np.full(len(q_ids), -np.inf))
            for own, found in max_score(np.ascontiguousarray(queries[:, :same]), q_ids, np.ascontiguousarray(rows_[:, :same]), ids, k, floor):
                for score, name in found:
                    yield (int(own), name, score)

    pairs = shards.join(asked, "g").select("q_ids", "q_packed", "q_width", "ids", "packed", "width")

    def done():
        floors.clear()
        return ()

    found = arrow_map(pairs, pair, "query_id long, vec_id long, score long", batch_rows=4, finish=done)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_max_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as double)) as e
  from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.e, c.e) as bigint) as score
  from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id
)
select query_id, cast(rank as integer) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
where rank <= 5
"""
