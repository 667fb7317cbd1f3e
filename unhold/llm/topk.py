"""Exact top-k by integer inner product over a pivot-distance index.

Vectors are scaled and floored to integers. With one more component,
sqrt(M^2 - |x|^2) for the largest norm M, the largest inner product is the
smallest distance: |q' - x'|^2 = M^2 + |q|^2 - 2 q.x. Every vector is keyed by
its nearest pivot and its distance to it, and the vectors of a pivot, sorted by
that distance, are cut into annuli of bounded size. An annulus also knows the
least and the largest distance of its vectors to each of ``BOUNDS`` pivots. A
query first reads the annulus that its own distance falls in at its nearest
pivots; the k-th best score there gives a radius r, and by the triangle
inequality only annuli whose intervals all overlap [d(q, p) - r, d(q, p) + r]
can hold anything better. Those are read; all others are proved to hold nothing.
Pivots and bounds of annuli only steer the work: the result is exact whatever
they are.

Rows whose vector is null or has null or non-finite components take no part; a
shorter vector is as one padded with zeros. Equal vectors are searched once and
keep their smallest ids; ties go to the smaller id; repeated ids count as one.
Scores are exact up to 2^53. An empty table gives an empty result. Only the id
and the vector are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import vectors
from .base import stored

SCALE = 1024
SAMPLE, PIVOTS = 8192, 64  # pivots are chosen from a bounded sample
RING_ROWS = 1024  # vectors of an annulus, about
RINGS_PER_TASK_QUERIES = 4096
FIRST_RINGS = 2  # annuli that a query reads first
CUTS = 256  # annuli of a pivot, at most
BOUNDS = 16  # pivots to which an annulus keeps the interval of its distances
QUERY_ROWS = 256  # queries compared with all annuli at a time
RINGED = "key long, v array<double>, ids array<long>, ring long, own double, at array<double>"


def pivots_of(sample: np.ndarray, n: int, seed: int = 3) -> np.ndarray:
    """Each pivot is the sample row farthest from those before it, which
    spreads them over the data."""
    sample = np.unique(sample, axis=0)
    chosen = [int(np.random.default_rng(seed).integers(len(sample)))]
    far = ((sample - sample[chosen[0]]) ** 2).sum(1)
    while len(chosen) < min(n, len(sample)):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    out = sample[chosen]
    for _ in range(4):  # moved to the middle of what is nearest: tighter annuli
        near = _distances(sample, out).argmin(1)
        total, size = np.zeros_like(out), np.bincount(near, minlength=len(out))
        np.add.at(total, near, sample)
        out = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], out)
    return out


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0))


def _lift(p: np.ndarray, norm2: float) -> np.ndarray:
    return np.column_stack([p, np.sqrt(np.maximum(norm2 - (p * p).sum(1), 0))])


def _keyed(pivots: np.ndarray, norm2: float, width: int):
    """(pivot, dist) of each vector."""
    def run(frames):
        for frame in frames:
            if len(frame):
                d = _distances(_lift(vectors.matrix(frame["v"], width), norm2), pivots)
                near = d.argmin(1)
                yield pd.DataFrame({"pivot": near.astype(np.int32), "dist": d[np.arange(len(d)), near]})
    return run


def _ringed(pivots: np.ndarray, cuts: dict[int, np.ndarray], norm2: float, width: int):
    """Each vector with its annulus and its distances to its own and the bounding pivots."""
    def run(frames):
        for frame in frames:
            if len(frame):
                d = _distances(_lift(vectors.matrix(frame["v"], width), norm2), pivots)
                near = d.argmin(1)
                own = d[np.arange(len(d)), near]
                nth = np.zeros(len(d), np.int64)
                for p in np.unique(near):
                    rows = near == p
                    nth[rows] = np.searchsorted(cuts[p], own[rows]) if p in cuts else 0
                yield frame.assign(ring=near.astype(np.int64) * CUTS + nth, own=own, at=list(d[:, :BOUNDS]))
    return run


def _gaps(q: np.ndarray, pivots: np.ndarray, rings: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Of each query and annulus: the query's distance to the annulus' pivot, and
    the distance below which it holds no vector, the largest that any interval proves."""
    d = _distances(np.column_stack([q, np.zeros(len(q))]), pivots)
    at = d[:, rings["ring"].to_numpy() // CUTS]
    gap = np.maximum(rings["low"].to_numpy() - at, at - rings["high"].to_numpy())
    for p in range(min(BOUNDS, len(pivots))):
        np.maximum(gap, rings[f"low{p}"].to_numpy() - d[:, p:p + 1], out=gap)
        np.maximum(gap, d[:, p:p + 1] - rings[f"high{p}"].to_numpy(), out=gap)
    return at, np.maximum(gap, 0, out=gap)


def _wanted(pivots: np.ndarray, rings: pd.DataFrame, norm2: float, width: int, first: bool):
    """(key, v, ring, least) for each ring that a query has to read."""
    ids = rings["ring"].to_numpy()

    def run(frames):
        for whole in frames:
            for s in range(0, len(whole), QUERY_ROWS):
                frame = whole.iloc[s:s + QUERY_ROWS]
                q = vectors.matrix(frame["v"], width)
                at, gap = _gaps(q, pivots, rings)
                if first:
                    # the ring nearest to the query's own distance, at its nearest pivots
                    near = np.argsort(at + gap, 1)[:, :FIRST_RINGS]
                    take = np.zeros(gap.shape, bool)
                    np.put_along_axis(take, near, True, 1)
                else:
                    reach = np.sqrt(np.maximum(norm2 + (q * q).sum(1) - 2 * frame["least"].to_numpy(), 0))
                    reach = np.where(np.isnan(reach), np.inf, reach * (1 + 1e-9) + 1e-6 * (1 + np.sqrt(norm2)))
                    take = gap <= reach[:, None]
                row, col = np.nonzero(take)
                out = frame.iloc[row].copy()
                out["ring"] = ids[col].astype(np.int64)
                yield out
    return run


def _scan(k: int, width: int):
    def run(key: tuple, asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(rows):
            return pd.DataFrame({"key": [], "found": [], "ids": [], "score": []})
        q, x = vectors.matrix(asked["v"], width), vectors.matrix(rows["v"], width)
        found, keys, ids = rows["key"].to_numpy(), asked["key"].to_numpy(), rows["ids"].to_numpy()
        least_id = np.array([i[0] for i in ids])
        floor = asked["least"].to_numpy() if "least" in asked else np.full(len(q), -np.inf)
        out = []
        for s in range(0, len(q), 512):
            score = q[s:s + 512] @ x.T  # whole numbers: exact in doubles
            for i, line in enumerate(score):
                hit = np.flatnonzero(line >= floor[s + i]) if floor[s + i] == floor[s + i] else np.arange(len(line))
                if len(hit) > k + 1:
                    hit = hit[np.lexsort((least_id[hit], -line[hit]))[:k + 1]]  # of equal scores the smaller ids
                out.append((np.full(len(hit), s + i), hit, line[hit]))
        row, hit, score = (np.concatenate(x) for x in zip(*out))
        return pd.DataFrame({"key": keys[row], "found": found[hit], "ids": ids[hit], "score": score.astype(np.int64)})
    return run


def integers(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    base = vectors.usable(rows, id_col, vector_col, False)
    return base.withColumn("v", F.transform("v", lambda x: F.floor(x * SCALE).cast("double")))


def search(rows: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` its k rows of
    the largest integer inner product, other than itself."""
    spark = rows.sparkSession
    asked = integers(queries, id_col, vector_col).dropDuplicates(["id"]).withColumn("key", F.xxhash64("v"))
    table = stored(vectors.distinct(integers(rows, id_col, vector_col), k + 1), "vectors")
    total, norm2, width = table.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)), F.max(F.size("v"))).first()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    sample = table.orderBy(F.xxhash64("key")).limit(SAMPLE).select("v").toPandas()["v"]  # bounded: SAMPLE vectors
    pivots = pivots_of(_lift(vectors.matrix(sample, width), norm2), PIVOTS)
    # annuli: cut points from each pivot's quantiles, about RING_ROWS rows apart
    cuts = (table.mapInPandas(_keyed(pivots, norm2, width), "pivot int, dist double").groupBy("pivot")
            .agg(F.count("*").alias("n"), F.percentile_approx("dist", [i / CUTS for i in range(1, CUTS)], 10 * CUTS).alias("at"))
            .withColumn("step", F.greatest(F.lit(1), F.ceil(F.lit(CUTS) * RING_ROWS / F.col("n"))).cast("int"))
            .select("pivot", F.filter("at", lambda x, i: (i + 1) % F.col("step") == 0).alias("at")))
    cuts = {r.pivot: np.array(r.at) for r in cuts.collect()}  # bounded: PIVOTS rows of CUTS - 1 numbers
    ringed = stored(table.mapInPandas(_ringed(pivots, cuts, norm2, width), RINGED), "rings")
    each = [f(F.col("at")[p]).alias(f"{name}{p}") for p in range(min(BOUNDS, len(pivots))) for name, f in (("low", F.min), ("high", F.max))]
    rings = ringed.groupBy("ring").agg(F.min("own").alias("low"), F.max("own").alias("high"), *each).toPandas()  # at most CUTS per pivot

    once = asked.select("key", "v").dropDuplicates(["key"])
    first = stored(_scanned(ringed, once.mapInPandas(_wanted(pivots, rings, norm2, width, True), "key long, v array<double>, ring long"), k, width), "first")
    # the score of the (k+1)-th best of each query's first annuli (its own row may be one); none when they hold fewer
    ranked = first.withColumn("n", F.sum(F.size("ids")).over(Window.partitionBy("key").orderBy(F.desc("score"), "found").rowsBetween(Window.unboundedPreceding, 0)))
    least = ranked.filter(F.col("n") >= k + 1).groupBy("key").agg(F.max("score").cast("double").alias("least"))
    rest = once.join(least, "key", "left").mapInPandas(_wanted(pivots, rings, norm2, width, False), "key long, v array<double>, least double, ring long")
    hits = _scanned(ringed, rest, k, width)
    return vectors.expand(asked, hits, k)


def _scanned(ringed: DataFrame, want: DataFrame, k: int, width: int) -> DataFrame:
    want = stored(want, "asked")
    left, right, at = vectors.in_blocks(ringed.select("key", "v", "ids", "ring"), want, "ring", 4 * RING_ROWS, RINGS_PER_TASK_QUERIES)
    return right.groupBy(*at).cogroup(left.groupBy(*at)).applyInPandas(_scan(k, width), "key long, found long, ids array<long>, score long")


def query(spark, sf_dir: str) -> DataFrame:
    from .base import table
    rows = table(spark, sf_dir, "embeddings")
    return search(rows, rows.filter("vec_id % 100 = 0"), 10)


SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
