"""Approximate nearest neighbours by a hash-prefix forest (op2), nearness: largest inner product.

Every vector gets one hash string of BITS hyperplane signs per tree (after lifting all vectors to
one norm, so that a large inner product is a small angle).  A tree is the sorted array of these strings, cut into
buckets by a prefix that is as long as it takes to hold at most BUCKET vectors.

* Descent: in its bucket of every tree a query takes the longest prefix that at least NEAR vectors share and
  scores them exactly.
* Synchronous ascent: a query whose 20th score leaves more than MISS probability that a nearer vector shares
  none of the prefixes reached gives up RISE bits in all trees at once, scores the vectors that share
  the shorter prefixes, and is judged again.  Prefixes that many vectors share are cut into blocks of BLOCK.
* Root: once the trees' prefixes together would hold more than all vectors (2^depth <= trees), what is
  still unsettled is scored against all vectors, in blocks of queries against blocks of vectors.

All vectors are indexed.  Equal vectors are one entry with its ``k + 1`` least ids, which is all that any
query can return of them.  Null, empty or zero vectors, those with null or non-finite components or
without an id take no part, nor do those that have not the commonest length (ties: the greater), as
there is no inner product between lengths.  Repeated rows of one id and vector count once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.llm.common import written
from lexiforge.llm.words import by_key

TREES = 12
BITS = 60
NEAR = 64
RISE = 2  # bits given up by a step of the ascent
BUCKET = 4096
MISS = 0.02
STEP = 6  # bits by which the prefix of an overfull bucket grows
BLOCK = 4096
_HITS = "rid long, id long, score double"


def _valid(vectors: DataFrame) -> DataFrame:
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    ok = vectors.select("vec_id", "embedding").where("vec_id is not null and embedding is not null").where(~bad).where(some)
    sizes = ok.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return ok.where(F.size("embedding") == (sizes["size"] if sizes else 0))


def _matrix(col: pa.Array) -> np.ndarray:
    flat = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return np.asarray(flat.flatten(), dtype=np.float64).reshape(len(flat), -1)


def signs(x: np.ndarray, trees: int, seed: int = 11) -> np.ndarray:
    """Hash strings (rows x trees) of BITS hyperplane signs each, as integers."""
    planes = np.random.default_rng(seed).normal(size=(x.shape[1], trees * BITS))
    bits = (x @ planes > 0).reshape(len(x), trees, BITS)
    return bits @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))


def _hashed(rows: DataFrame, top: float, query: bool, trees: int) -> DataFrame:
    """(rid, embedding, ids) -> (tree, h, rid, embedding, ids, query)."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1))
                lift = np.zeros(len(x)) if query else np.sqrt(np.maximum(top - (x**2).sum(axis=1), 0))
                h = signs(np.column_stack([x, lift]), trees)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(h), pa.list_(pa.int64()))], names=["rid", "embedding", "ids", "hs"])

    kind = rows.schema["embedding"].dataType.simpleString()
    return (rows.select("rid", "embedding", "ids").mapInArrow(task, f"rid long, embedding {kind}, ids array<long>, hs array<long>")
            .select(F.posexplode("hs").alias("tree", "h"), "rid", "embedding", "ids", F.lit(query).alias("query")))


def _best(q: np.ndarray, x: np.ndarray, ids: list[list[int]], k: int) -> list[tuple[int, float]]:
    """The k best (id, score) of the given vectors; scores summed in one fixed order."""
    if not len(x):
        return []
    s = x @ q
    if len(s) > k:
        cut = np.partition(s, len(s) - k)[len(s) - k]
        at = np.flatnonzero(s >= cut - 1e-9 * max(1.0, abs(cut)))
    else:
        at = np.arange(len(s))
    exact = (x[at] * q).sum(axis=1)
    got = [(i, float(e)) for a, e in zip(at.tolist(), exact.tolist(), strict=True) for i in ids[a]]
    return sorted(got, key=lambda t: (-t[1], t[0]))[:k]


def _descend(k: int, near: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_key(batches, ["tree", "depth", "prefix"]):
            isq = np.array(t.column("query"))
            if not isq.any() or isq.all():
                continue
            h, x = np.array(t.column("h")), _matrix(t.column("embedding"))
            rid, all_ids = np.array(t.column("rid")), t.column("ids").to_pylist()
            points = np.flatnonzero(~isq)
            points = points[np.argsort(h[points], kind="stable")]
            hs, px, pids = h[points], x[points], [all_ids[p] for p in points]
            qs = np.flatnonzero(isq)
            low = t.column("depth")[0].as_py()
            lo, hi, deep = np.zeros(len(qs), dtype=int), np.full(len(qs), len(hs)), np.full(len(qs), low)
            open_ = np.ones(len(qs), dtype=bool)
            for depth in range(BITS, low, -1):
                cut = h[qs] >> (BITS - depth)
                a, b = np.searchsorted(hs, cut << (BITS - depth)), np.searchsorted(hs, (cut + 1) << (BITS - depth))
                now = open_ & (b - a >= near)
                lo[now], hi[now], deep[now] = a[now], b[now], depth
                open_ &= ~now
                if not open_.any():
                    break
            tree, rows = t.column("tree")[0].as_py(), []
            for n, q in enumerate(qs):
                rows.append((int(rid[q]), tree, int(deep[n]), *zip(*(_best(x[q], px[lo[n]:hi[n]], pids[lo[n]:hi[n]], k) or [(None, None)]), strict=True)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32()),
                 pa.array([r[3] for r in rows], pa.list_(pa.int64())), pa.array([r[4] for r in rows], pa.list_(pa.float64()))],
                names=["rid", "tree", "depth", "id", "score"])

    return task


def _score(k: int, keys: list[str]):
    """Every query against every vector of its group."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_key(batches, keys):
            isq = np.array(t.column("query"))
            if not isq.any() or isq.all():
                continue
            x, rid, ids = _matrix(t.column("embedding")), np.array(t.column("rid")), t.column("ids").to_pylist()
            points = np.flatnonzero(~isq)
            px, pids = x[points], [ids[p] for p in points]
            rows = [(int(rid[q]), *r) for q in np.flatnonzero(isq) for r in _best(x[q], px, pids, k)]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.float64()), strict=True)],
                                             names=["rid", "id", "score"])

    return task


def _buckets(rows: DataFrame, depth: int, bucket: int) -> DataFrame:
    """Give every row the shortest prefix, from ``depth`` bits on, that at most ``bucket`` vectors share."""
    done, left = None, rows
    while True:
        at = left.withColumn("depth", F.lit(depth)).withColumn("prefix", F.shiftright("h", BITS - depth))
        if depth >= BITS:
            return at if done is None else done.union(at)
        full = written(at.where("not query").groupBy("tree", "prefix").agg(F.count("*").alias("n")).where(F.col("n") > bucket)
                       .select("tree", "prefix"), "forest-full")
        if full.isEmpty():
            return at if done is None else done.union(at)
        keep = at.join(full, ["tree", "prefix"], "left_anti").select(*at.columns)
        done = keep if done is None else done.union(keep)
        left = at.join(full, ["tree", "prefix"], "left_semi").select(*rows.columns)
        depth = min(BITS, depth + STEP)


def _ascend(strings: DataFrame, left: DataFrame, depth: int, k: int) -> DataFrame:
    """Hits of the queries ``left`` (rid) among the vectors that share ``depth`` bits in any tree."""
    at = strings.withColumn("prefix", F.shiftright("h", BITS - depth))
    asking = at.where("query").join(left.select("rid"), "rid", "left_semi")
    points = at.where("not query").join(asking.select("tree", "prefix").distinct(), ["tree", "prefix"], "left_semi")
    blocks = written(points.groupBy("tree", "prefix").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "forest-blocks")
    columns = ["tree", "prefix", "block", "rid", "embedding", "ids", "query"]
    grid = (points.join(blocks, ["tree", "prefix"]).withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int")).select(*columns)
            .union(asking.join(blocks, ["tree", "prefix"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(*columns)))
    keys = columns[:3]
    return grid.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_score(k, keys), _HITS)


def _unsettled(found: DataFrame, hits: DataFrame, mine: DataFrame, top: float, k: int, miss: float) -> DataFrame:
    """The queries (rid) of ``mine`` for which a nearer vector may share none of the prefixes (rid, tree, depth) of ``found``."""
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))) * math.sqrt(top)
    last = hits.groupBy("rid").agg(F.min("score").alias("score"), F.count("*").alias("n")).where(F.col("n") > k)
    stay = 1 - F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.col("score") / norm))) / math.pi
    risk = (found.select("rid", "tree", "depth").join(last, "rid").join(mine.select("rid", "embedding"), "rid")
            .groupBy("rid").agg(F.sum(F.log(F.greatest(1 - F.pow(stay, F.col("depth")), F.lit(1e-300)))).alias("risk")))
    return mine.select("rid").join(risk.where(F.col("risk") <= math.log(miss)), "rid", "left_anti")


def _top(hits: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("rid").orderBy(F.col("score").desc(), "id")
    return hits.groupBy("rid", "id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, trees: int = TREES, near: int = NEAR,
           bucket: int = BUCKET, miss: float = MISS) -> DataFrame:
    """The ``k`` nearest rows of ``vectors`` (vec_id, embedding) for each row of ``queries`` (vec_id):
    (query_id, rank, vec_id, score).  A query is a row of ``vectors`` and never finds its own id."""
    spark = vectors.sparkSession
    good = _valid(vectors)
    w = Window.partitionBy("embedding").orderBy("vec_id")
    few = good.groupBy("embedding", "vec_id").agg(F.lit(1)).withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1)
    reps = written(few.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
                   .select(F.col("ids")[0].alias("rid"), "embedding", "ids"), "forest-vectors")
    asked = written(good.join(queries.select("vec_id").distinct(), "vec_id", "left_semi").distinct()
                    .join(reps, "embedding").select("vec_id", "rid"), "forest-queries")
    n, top = reps.agg(F.count("*"), F.max(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    mine = reps.join(asked.select("rid").distinct(), "rid", "left_semi").select("rid", "embedding", "ids")
    rows = written(_hashed(reps, top, False, trees).union(_hashed(mine, top, True, trees)), "forest-strings")
    depth = max(0, math.ceil(math.log2(n / bucket)) + 1) if n > bucket else 0
    found = written(_buckets(rows, depth, bucket).repartition("tree", "depth", "prefix").sortWithinPartitions("tree", "depth", "prefix")
                    .mapInArrow(_descend(k + 1, near), "rid long, tree int, depth int, id array<long>, score array<double>"), "forest-found")
    hits = _top(found.select("rid", F.explode(F.arrays_zip("id", "score")).alias("x")).select("rid", "x.id", "x.score").where("id is not null"), k + 1)
    hits = written(hits.select("rid", "id", "score"), "forest-hits")
    reached = found.select("rid", "tree", "depth")
    open_ = written(_unsettled(reached, hits, mine, top, k, miss), "forest-open")
    level = math.ceil(math.log2(max(1, n / near))) - RISE
    while 2**level > trees and not open_.isEmpty():
        more = _ascend(rows, open_, level, k + 1)
        hits = written(_top(hits.union(more), k + 1).select("rid", "id", "score"), "forest-hits")
        reached = reached.withColumn("depth", F.least("depth", F.lit(level)))
        open_ = written(_unsettled(reached.join(open_, "rid", "left_semi"), hits, mine.join(open_, "rid", "left_semi"), top, k, miss), "forest-open")
        level -= RISE
    left = written(mine.join(open_, "rid", "left_semi"), "forest-ascending")
    pb, qb = math.ceil(n / BLOCK), max(1, math.ceil(left.count() / BLOCK))
    block = lambda m: F.pmod(F.xxhash64("rid"), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    grid = (reps.select(block(pb).alias("pb"), every(qb).alias("qb"), "rid", "embedding", "ids", F.lit(False).alias("query"))
            .union(left.select(every(pb).alias("pb"), block(qb).alias("qb"), "rid", "embedding", "ids", F.lit(True).alias("query"))))
    above = grid.repartition("qb", "pb").sortWithinPartitions("qb", "pb").mapInArrow(_score(k + 1, ["qb", "pb"]), _HITS)
    best = _top(hits.select("rid", "id", "score").union(above), k + 1)
    by_query = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return (asked.select(F.col("vec_id").alias("query_id"), "rid").join(written(best, "forest-best"), "rid").where("id <> query_id")
            .withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k)
            .select("query_id", "rank", F.col("id").alias("vec_id"), "score"))
