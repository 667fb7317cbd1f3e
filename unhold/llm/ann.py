"""Approximate nearest neighbours by inner product over balanced posting lists.

Vectors get one more component, sqrt(M^2 - |v|^2) with M the largest norm, so
that the largest inner product is the smallest distance. Centroids are fitted
on a bounded sample by k-means with a penalty on a cluster's size, which keeps
lists balanced; their number follows the table's size. A vector goes to its
nearest list and, if it lies between lists, to others almost as near; how near
is set so that about a quarter of the vectors lies so. The centroids are always
searched through a neighbour graph held in memory (best first, a beam of
candidates). A query reads lists, nearest first, until they hold k + 1 vectors,
and from there those within a ratio of the distance reached. The ratio is the
least one that finds the wanted share of the sample's true neighbours, so it is
small where vectors form clusters and wide where they do not; no fixed number
ends the probes. Lists beyond those that hold k + 1 vectors return only what
scores no less than the (k + 1)-th best of the sample. A query finds k rows
whenever there are k candidates: only if a beam's lists hold too few are all
lists put in order. How near a boundary vector's lists are is set from vectors
beside the sample, if the table has more: the fitted ones are so much nearer to
their own centroids that by them nearly all others would lie between lists.

The lists lie stored in their order. Queries go to the tasks that read the lists
in chunks of bounded size, each query once with a bit for each list, and a task
keeps a query's k + 1 best: no task holds, and nothing writes, a row for each
query and list. Vectors are stored as wide as they come (floats stay floats).

Rows whose vector is null, zero or has null or non-finite components take no
part; equal vectors are searched once and keep their smallest ids; ties go to
the smaller id. Repeated ids count as one. Fewer candidates than k are all
returned; an empty table gives an empty result. Only the id and the vector are
read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import vectors
from .base import removed, scratch, shuffles_removed, stored

SAMPLE = 32768  # vectors that centroids are fitted on, at most
LIST_ROWS = 128  # aim for the vectors of a list
MAX_LISTS = 8192  # bounds what each task holds of the centroids
REPLICAS, CLOSE = 4, 1.15  # lists of a boundary vector, and how much farther than the nearest at most
BOUNDARY = 0.25  # share of the vectors that lies between lists
FOUND = 0.95  # share of the sample's true neighbours that the distance ratio has to find
ASKED = 512  # vectors of the sample whose neighbours set the ratio
HELD_OUT = 4096  # vectors that the boundary is set from, and of these beside the sample at most
NEIGHBOURS, RANDOM = 20, 4  # links of a centroid in the graph
ROW_BEAM, MORE_BEAM = 24, 16  # beam of a vector's own lists; of a query, beyond the lists it may read
VISITS = 6  # centroids that a step of a narrow beam visits
WALK, CELLS = 512, 1 << 20  # points that walk the graph together at most; numbers of a block held at once, about
CHUNK_BYTES = 32 << 20  # queries that all readers of lists hold at a time, with their bits
HITS = 1 << 19  # of a task, before they are cut to the best
TASKS = 2  # reading tasks for each core; each returns up to k + 1 rows for a query
ROUNDS = 12


def fit(sample: np.ndarray, lists: int, seed: int = 1) -> np.ndarray:
    """Centroids by k-means; a cluster's cost grows with its size."""
    rng = np.random.default_rng(seed)
    sample = np.unique(sample, axis=0)
    lists = min(lists, len(sample))
    centroids = sample[rng.choice(len(sample), lists, replace=False)]
    scale, extra = 0.0, np.zeros(lists)
    block = max(64, min(4096, 2 * CELLS // lists))
    for _ in range(ROUNDS):
        near, dist = np.empty(len(sample), np.int64), np.empty(len(sample))
        for s in range(0, len(sample), block):
            d = _squared(sample[s:s + block], centroids)
            near[s:s + block] = (d + extra).argmin(1)
            dist[s:s + block] = d[np.arange(len(d)), near[s:s + block]]
        size = np.bincount(near, minlength=lists)
        total = np.zeros_like(centroids)
        np.add.at(total, near, sample)
        centroids = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centroids)
        scale = 0.1 * dist.mean()
        extra = scale * np.maximum(0, size * lists / len(sample) - 1)
    return centroids


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0)


def graph(centroids: np.ndarray, neighbours: int = NEIGHBOURS, seed: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(neighbours of each centroid, entry points): the nearest ones and a few
    random ones, which keep the graph connected."""
    n = len(centroids)
    rng = np.random.default_rng(seed)
    near = min(neighbours, n)
    links = np.empty((n, near + min(RANDOM, n)), np.int64)
    for s in range(0, n, 256):
        d = _squared(centroids[s:s + 256], centroids)
        links[s:s + 256, :near] = np.argpartition(d, near - 1, 1)[:, :near]
    links[:, near:] = rng.integers(0, n, (n, links.shape[1] - near))
    return links, rng.choice(n, min(n, 64), replace=False)


def nearest_lists(points: np.ndarray, centroids: np.ndarray, links: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(lists, squared distances) of a beam of near centroids, nearest first; as
    many points walk together as keep their distances in bounded memory."""
    beam, step = min(beam, len(centroids)), max(1, CELLS // len(centroids))
    walk = _flood if beam * links.shape[1] >= len(centroids) else _walk
    parts = [walk(_squared(points[s:s + step], centroids), links, entry, beam) for s in range(0, len(points), step)]
    if not parts:
        return np.empty((0, beam), np.int64), np.empty((0, beam))
    wide = max(p[0].shape[1] for p in parts)
    pad = lambda i, x: np.concatenate([np.pad(p[i], ((0, 0), (0, wide - p[i].shape[1])), constant_values=x) for p in parts])
    return pad(0, 0), pad(1, np.inf)


def _walk(d: np.ndarray, links: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """A narrow beam: the nearest few that are not visited yet at each step."""
    n, m = d.shape
    rows = np.arange(n)[:, None]
    seen = np.zeros((n, m), bool)
    seen[:, entry] = True
    best = np.broadcast_to(entry, (n, len(entry)))
    dist = d[:, entry]
    done = np.zeros(best.shape, bool)
    while True:
        open_ = np.where(done, np.inf, dist)
        few = min(VISITS, open_.shape[1])
        pick = np.argpartition(open_, few - 1, 1)[:, :few]
        going = np.isfinite(np.take_along_axis(open_, pick, 1))
        if not going.any():
            break
        np.put_along_axis(done, pick, True, 1)
        new = np.where(going[:, :, None], links[np.take_along_axis(best, pick, 1)], -1).reshape(n, -1)
        new.sort(1)
        known = (new < 0) | seen[rows, new]
        known[:, 1:] |= new[:, 1:] == new[:, :-1]  # reached from several
        r, c = np.nonzero(~known)
        seen[r, new[r, c]] = True
        dist = np.concatenate([dist, np.where(known, np.inf, d[rows, new])], 1)
        best = np.concatenate([best, new], 1)
        done = np.concatenate([done, known], 1)
        if dist.shape[1] > beam:
            keep = np.argpartition(dist, beam - 1, 1)[:, :beam]
            dist, best, done = (np.take_along_axis(x, keep, 1) for x in (dist, best, done))
    order = np.argsort(dist, 1)
    return np.take_along_axis(best, order, 1), np.take_along_axis(dist, order, 1)


def _flood(d: np.ndarray, links: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """A beam whose links reach as many centroids as there are: all of the beam
    that is not visited yet at each step."""
    n, m = d.shape
    seen, done = np.zeros((n, m), bool), np.zeros((n, m), bool)
    seen[:, entry] = True
    flat, block = seen.reshape(-1), max(1, CELLS // links.shape[1])
    while True:
        open_ = seen & ~done
        if beam < m:
            open_ &= d <= np.partition(np.where(seen, d, np.inf), beam - 1, 1)[:, beam - 1:beam]
        open_ &= ~seen.all(1, keepdims=True)  # nothing is left to reach
        r, c = np.nonzero(open_)
        if not len(r):
            break
        done |= open_
        for s in range(0, len(r), block):
            flat[r[s:s + block, None] * m + links[c[s:s + block]]] = True
    dist = np.where(seen, d, np.inf)
    keep = np.argpartition(dist, beam - 1, 1)[:, :beam]
    dist = np.take_along_axis(dist, keep, 1)
    order = np.argsort(dist, 1)
    return np.take_along_axis(keep, order, 1), np.take_along_axis(dist, order, 1)


def ranked(points: np.ndarray, centroids: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``nearest_lists``, from the distances to all centroids."""
    beam = min(beam, len(centroids))
    lists, dist = np.empty((len(points), beam), np.int64), np.empty((len(points), beam))
    for s in range(0, len(points), 512):
        d = _squared(points[s:s + 512], centroids)
        near = np.argpartition(d, beam - 1, 1)[:, :beam]
        d = np.take_along_axis(d, near, 1)
        order = np.argsort(d, 1)
        lists[s:s + 512], dist[s:s + 512] = np.take_along_axis(near, order, 1), np.take_along_axis(d, order, 1)
    return lists, dist


def boundary(lifted: np.ndarray, centroids: np.ndarray) -> float:
    """How much farther than its nearest list another one of a vector may be."""
    if len(centroids) < 2:
        return 1.0
    apart = []
    for s in range(0, min(len(lifted), 4096), 512):
        d = np.sqrt(np.partition(_squared(lifted[s:s + 512], centroids), 1, 1)[:, :2])
        apart.append(d[:, 1] / np.maximum(d[:, 0], 1e-300))
    return min(CLOSE, float(np.quantile(np.concatenate(apart), BOUNDARY)))


def calibrate(sample: np.ndarray, norm2: float, centroids: np.ndarray, close: float, home: np.ndarray, k: int, found: float = FOUND) -> tuple[float, int]:
    """(ratio, most lists read) at which some of the sample's vectors, asked
    against all of it, reach the lists of so many of their k true neighbours. In
    the whole table neighbours are nearer than in a sample, and need no more."""
    keep = min(k, len(sample) - 1)
    if keep < 1 or len(centroids) < 2:
        return 1.0, 1
    lifted, asked = _lifted(sample, norm2), sample[:ASKED]
    q = _scaled(asked, norm2)
    needs, lists = [], []
    for s in range(0, len(asked), 64):
        score = asked[s:s + 64] @ sample.T
        score[np.arange(len(score)), s + np.arange(len(score))] = -np.inf
        near = np.argpartition(-score, keep - 1, 1)[:, :keep]
        d = _squared(q[s:s + 64], centroids)
        base = _reached(np.sort(d, 1), home[np.argsort(d, 1)], k + 1)
        for i, line in enumerate(near):
            own = _squared(lifted[line], centroids)
            most = min(REPLICAS, len(centroids))
            at = np.argpartition(own, most - 1, 1)[:, :most]
            own = np.take_along_axis(own, at, 1)
            theirs = np.where(own <= own.min(1, keepdims=True) * close * close, d[i][at], np.inf)
            needs.append(theirs.min(1) / base[i])
        lists.append((d / base).astype(np.float32))
    square = max(1.0, float(np.quantile(np.concatenate(needs), found, method="higher")))
    return float(np.sqrt(square)), int((np.concatenate(lists) <= square).sum(1).max())


def _lifted(p: np.ndarray, norm2: float) -> np.ndarray:
    return np.column_stack([p, np.sqrt(np.maximum(norm2 - (p * p).sum(1), 0))])


def _scaled(p: np.ndarray, norm2: float) -> np.ndarray:
    """Queries: their scale changes no order; at the rows' largest norm distance
    ratios mean the same as theirs."""
    return np.column_stack([p * np.sqrt(norm2 / np.maximum((p * p).sum(1, keepdims=True), 1e-300)), np.zeros(len(p))])


def _reached(d: np.ndarray, held: np.ndarray, need: int) -> np.ndarray:
    """Squared distance of the list at which those before it and it hold ``need``."""
    reach = np.minimum((np.cumsum(held, 1) < need).sum(1), d.shape[1] - 1)[:, None]
    return np.maximum(np.take_along_axis(d, reach, 1), 1e-12)


def _reach(lists: np.ndarray, d: np.ndarray, home: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of the list at which those up to it hold ``need`` vectors, rows whose lists hold fewer)."""
    held = np.cumsum(np.where(np.isfinite(d), home[lists], 0), 1)  # a walk may reach fewer lists than its beam is wide
    return np.minimum((held < need).sum(1), d.shape[1] - 1)[:, None], held[:, -1] < need


def _floors(asked: np.ndarray, sample: np.ndarray, need: int) -> np.ndarray:
    """The ``need``-th best score among the sample's vectors: those of the whole
    table are no worse, so nothing below it can be a result."""
    if len(sample) < need:
        return np.full(len(asked), -np.inf)
    best = [np.partition(asked[s:s + 64] @ sample.T, -need, 1)[:, -need] for s in range(0, len(asked), 64)]
    best = np.concatenate(best)
    return best - 1e-9 * np.sqrt((asked * asked).sum(1) * (sample * sample).sum(1).max())  # sums may differ in their last bits


def _taken(lists: np.ndarray, d: np.ndarray, most: int, ratio: float, home: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray]:
    """(mask of the lists to take, rows whose lists hold fewer than ``need``
    vectors): those up to ``need`` and, from there, within a ratio."""
    known = np.isfinite(d)
    reach, short = _reach(lists, d, home, need)
    nth = np.arange(d.shape[1])[None]
    near = d <= np.maximum(np.take_along_axis(d, reach, 1) * ratio * ratio, 1e-12)
    return known & ((nth <= reach) | ((nth < most) & near)), short


def _assign(index: dict, most: int, ratio: float, beam: int, home: np.ndarray | None = None, need: int = 0):
    """Rows of (list, key) for each row of (key, v): the lists that hold ``need``
    vectors, of ``home`` in each, and others within a ratio of them. A row's own
    lists (without ``home``) tell its nearest one. Wide beams yield few rows' lists
    at a time."""
    def run(frames):
        c, links = index["centroids"], index["links"]
        held = np.zeros(len(c), np.int64) if home is None else home
        some, all_ = (max(1, min(WALK, CELLS // 4 // b)) for b in (min(beam, len(c)), len(c)))
        for frame in frames:
            for s in range(0, len(frame), some):
                part = frame.iloc[s:s + some]
                raw = vectors.matrix(part["v"], index["width"])
                p = (_lifted if index["lift"] == "row" else _scaled)(raw, index["norm2"])
                lists, d = nearest_lists(p, c, links, index["entry"], beam)
                take, short = _taken(lists, d, most, ratio, held, need)
                short &= (lists.shape[1] < len(c)) | ~np.isfinite(d).all(1)
                if short.any():  # the beam holds too little: all lists, in order
                    take[short] = False
                    again = np.flatnonzero(short)
                    for t in range(0, len(again), all_):
                        at = again[t:t + all_]
                        far, e = ranked(p[at], c, len(c))
                        row, col = np.nonzero(_taken(far, e, most, ratio, held, need)[0])
                        out = part.iloc[at[row]].copy()
                        out["list"] = far[row, col].astype(np.int32)
                        if home is not None:
                            out["floor"] = -np.inf
                        yield out
                row, col = np.nonzero(take)
                out = part.iloc[row].copy()
                out["list"] = lists[row, col].astype(np.int32)
                if home is None:
                    out["home"] = col == 0
                else:
                    out["floor"] = np.where(col <= _reach(lists, d, held, need)[0][row, 0], -np.inf, _floors(raw, index["sample"], need)[row])
                yield out
    return run


def _packed(assign, lists: int):
    """One row for each key of ``assign``'s rows: (key, v, floor, nearest, others),
    the lists without and with a floor as a bit each."""
    def run(frames):
        for out in assign(frames):
            if not len(out):
                continue
            at, keys = pd.factorize(out["key"])
            first, own = np.unique(at, return_index=True)[1], out["floor"].to_numpy()
            floor = np.full(len(keys), -np.inf)
            np.maximum.at(floor, at, own)
            bits = np.zeros((2, len(keys), lists), bool)
            bits[(own > -np.inf).astype(int), at, out["list"].to_numpy()] = True
            nearest, others = ([r.tobytes() for r in b] for b in np.packbits(bits, axis=2))
            yield pd.DataFrame({"key": keys, "v": out["v"].to_numpy()[first], "floor": floor, "nearest": nearest, "others": others})
    return run


class _Best:
    """Of the rows read so far, each query's k + 1 best, ties by their first ids."""

    def __init__(self, asked: dict, k: int):
        self.q, self.keys, self.k = asked["q"], asked["key"], k
        self.floor, self.low = asked["floor"], np.full(len(asked["key"]), -np.inf)
        self.parts, self.held = [], 0

    def add(self, i: np.ndarray, j: np.ndarray, x: np.ndarray, rows: dict, least: np.ndarray) -> None:
        """Pairs of a query ``i`` and a row ``j`` that may reach ``least[i]``."""
        for s in range(0, len(i), CELLS // 16):
            a, b = i[s:s + CELLS // 16], j[s:s + CELLS // 16]
            exact = (self.q[a] * x[b]).sum(1)  # the same sum for a pair wherever it is found
            good = np.flatnonzero(exact >= least[a])
            b = b[good]
            self.parts.append((a[good].astype(np.int32), exact[good], rows["key"][b], rows["first"][b], rows["ids"].take(pa.array(b))))
            self.held += len(good)
        if self.held > HITS + len(self.keys) * (self.k + 1):
            self.cut()

    def cut(self) -> None:
        """What is not among a query's k + 1 best goes, with copies from other lists."""
        i, score, found, first = (np.concatenate([p[n] for p in self.parts]) for n in range(4))
        ids = pa.concat_arrays([p[4] for p in self.parts])
        order = np.lexsort((found, first, -score, i))
        i, score, found, first = (a[order] for a in (i, score, found, first))
        start = np.ones(len(i), bool)
        start[1:] = i[1:] != i[:-1]
        other = start.copy()
        other[1:] |= (score[1:] != score[:-1]) | (first[1:] != first[:-1])
        nth = np.cumsum(other)
        nth -= np.repeat(nth[start] - 1, np.diff(np.append(np.flatnonzero(start), len(i))))
        copy = np.zeros(len(i), bool)
        copy[1:] = ~other[1:] & (found[1:] == found[:-1])
        self.low[i[nth == self.k + 1]] = score[nth == self.k + 1]
        keep = np.flatnonzero((nth <= self.k + 1) & ~copy)
        self.parts = [(i[keep], score[keep], found[keep], first[keep], ids.take(pa.array(order[keep])))]
        self.held = len(keep)

    def rows(self):
        if not self.held:
            return
        self.cut()
        i, score, found, _, ids = self.parts[0]
        for s in range(0, len(i), 10_000):
            e = slice(s, s + 10_000)
            yield pa.RecordBatch.from_arrays([pa.array(self.keys[i[e]]), pa.array(found[e]), ids[e], pa.array(score[e])], ["key", "found", "ids", "score"])


def _read(asked: dict, k: int, width: int, norm: float):
    """(key, found, ids, score): the best of what a task reads, of lists in their
    order, for each of the queries whose bits name the list."""
    def run(batches):
        best, q, unit = _Best(asked, k), asked["q"], asked["unit"]
        slack = (width + 4) * 1.2e-7  # what single precision loses at most; the exact sum decides
        for batch in batches:
            if not batch.num_rows:
                continue
            x, lists, ids = vectors.flat(batch["v"], width), batch["list"].to_numpy(), batch["ids"]
            y = (x / norm).astype(np.float32)
            rows = {"key": batch["key"].to_numpy(), "ids": ids, "first": ids.values.take(ids.offsets[:-1]).to_numpy()}
            cuts = np.flatnonzero(np.diff(lists)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(lists)]):
                byte, bit = lists[a] >> 3, 128 >> int(lists[a] & 7)
                near, others = (np.flatnonzero(asked[n][byte] & bit) for n in ("nearest", "others"))
                keep, step = min(k + 1, b - a), max(1, CELLS // (b - a))
                for s in range(0, len(near), step):
                    at = near[s:s + step]
                    score = q[at] @ x[a:b].T
                    j = np.argpartition(-score, keep - 1, 1)[:, :keep].reshape(-1)
                    best.add(np.repeat(at, keep), a + j, x, rows, best.low)
                for s in range(0, len(others), step):
                    at = others[s:s + step]
                    least = np.maximum(best.floor, best.low)
                    i, j = np.nonzero(unit[at] @ y[a:b].T >= (least[at] / asked["scale"][at] - slack).astype(np.float32)[:, None])
                    best.add(at[i], a + j, x, rows, least)
        yield from best.rows()
    return run


def _chunk(probes: DataFrame, nth: int, chunks: int, lists: int, width: int, norm2: float) -> dict:
    """The queries of one chunk as arrays; bits by list."""
    t = probes.filter(F.pmod(F.xxhash64("key"), F.lit(chunks)) == nth).toArrow().combine_chunks()
    q = vectors.flat(t["v"], width)
    length = np.sqrt((q * q).sum(1))
    asked = {"key": t["key"].to_numpy(), "q": q, "floor": t["floor"].to_numpy(), "scale": length * np.sqrt(norm2), "unit": (q / length[:, None]).astype(np.float32)}
    for n in ("nearest", "others"):
        asked[n] = np.ascontiguousarray(np.frombuffer(b"".join(t[n].to_pylist()), np.uint8).reshape(len(q), -(-lists // 8)).T)
    return asked


def _sampled(table: DataFrame, total: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(sample, vectors of which as large a share lies in the sample as of the
    table's), by a hash of the key; tasks sort little more than these."""
    most, by = SAMPLE + HELD_OUT, F.xxhash64("key")
    first = lambda t: vectors.flat(t.orderBy(by).limit(most).select("v").toArrow()["v"], width)  # noqa: E731  bounded: SAMPLE + HELD_OUT vectors
    got = first(table.filter(by < int((1.5 * most / total - 0.5) * 2.0 ** 64))) if total > 3 * most else first(table)
    if len(got) < min(most, total):
        got = first(table)
    fitted = round(HELD_OUT * min(1, SAMPLE / total))
    return got[:SAMPLE], np.concatenate([got[:min(fitted, SAMPLE)], got[SAMPLE:]])[:HELD_OUT]


def search(rows: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` its k rows of
    the largest inner product found, other than itself."""
    with shuffles_removed(rows.sparkSession):
        return _search(rows, queries, k, id_col, vector_col)


def _search(rows: DataFrame, queries: DataFrame, k: int, id_col: str, vector_col: str) -> DataFrame:
    spark = rows.sparkSession
    base = vectors.usable(rows, id_col, vector_col, True, True)
    asked = vectors.usable(queries, id_col, vector_col, True, True).dropDuplicates(["id"]).withColumn("key", F.xxhash64("v"))
    place = scratch(spark, "vectors")
    table = stored(vectors.distinct(base, k + 1), "vectors", place=place)
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    total, norm2, width = table.agg(F.count("*"), F.max(square), F.max(F.size("v"))).first()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lists = int(min(MAX_LISTS, max(1, total // LIST_ROWS)))
    sample, spread = _sampled(table, total, width)
    centroids = fit(_lifted(sample, norm2), lists)
    close = boundary(_lifted(spread, norm2), centroids)
    links, entry = graph(centroids)
    index = {"centroids": centroids, "links": links, "entry": entry, "norm2": norm2, "width": width, "lift": "row"}
    v = table.schema["v"].dataType.simpleString()
    owned = table.mapInPandas(_assign(index, REPLICAS, close, ROW_BEAM), f"key long, v {v}, ids array<long>, list int, home boolean")
    posted = stored(owned.hint("rebalance", "list").sortWithinPartitions("list"), "postings")
    removed(spark, place)
    home = np.zeros(len(centroids), np.int64)  # vectors of which a list is the nearest, so that none counts twice
    for r in posted.filter("home").groupBy("list").count().collect():  # bounded: one row per list
        home[r["list"]] = r["count"]
    ratio, most = calibrate(sample, norm2, centroids, close, home, k)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # a walk is long for its few bytes: not put together
    assign = _assign(index | {"lift": "query", "sample": sample}, most, ratio, most + MORE_BEAM, home, k + 1)
    v = asked.schema["v"].dataType.simpleString()
    probes = stored(asked.select("key", "v").repartition(tasks, "key").dropDuplicates(["key"]).mapInPandas(
        _packed(assign, len(centroids)), f"key long, v {v}, floor double, nearest binary, others binary"), "probes")
    chunks = max(1, -(-probes.count() * (12 * width + len(centroids) // 4 + 40) // CHUNK_BYTES))
    read = posted.drop("home").coalesce(TASKS * spark.sparkContext.defaultParallelism)
    nth = F.dense_rank().over(Window.partitionBy("key").orderBy(F.desc("score"), F.col("ids")[0]))
    best = []
    for c in range(chunks):
        part = _chunk(probes, c, chunks, len(centroids), width, norm2)
        if not len(part["key"]):
            continue
        hits = read.mapInArrow(_read(part, k, width, float(np.sqrt(norm2))), "key long, found long, ids array<long>, score double")
        # a query's best rows are among its k + 1 best vectors, copies in other lists aside; each reader keeps no more
        best.append(stored(hits.withColumn("nth", nth).filter(F.col("nth") <= k + 1).drop("nth").dropDuplicates(["key", "found"]), "hits"))
    if not best:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return vectors.expand(asked, reduce(DataFrame.union, best), k)


def query(spark, sf_dir: str) -> DataFrame:
    from .base import table
    rows = table(spark, sf_dir, "embeddings")
    return search(rows, rows.filter("vec_id % 20 = 0"), 20)
