"""Vector searches and url rules against brute force and on odd input."""

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from llm_fixtures import SF, no_docs, odd_docs  # noqa: F401
from unhold.llm import ann, topk, urlfilter, vectors

SCHEMA = "vec_id long, embedding array<float>, label int, key string, v string, id string"


@pytest.fixture(scope="module")
def odd_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 8)], 0) for i in range(300)]
    rows += [(300 + i, rows[7][1], 0) for i in range(40)]  # a vector that many rows share
    rows += [(400, None, 0), (401, [0.0] * 8, 0), (402, [float("nan")] * 8, 0), (403, [1.0, None] * 4, 0), (404, [float("inf")] * 8, 0), (None, rows[1][1], None), (5, rows[5][1], 1)]
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)


def usable(df, nonzero):
    out = {}
    for r in df.select("vec_id", "embedding").collect():
        if r.vec_id is not None and r.embedding is not None and all(x is not None and np.isfinite(x) for x in r.embedding) and (any(r.embedding) or not nonzero):
            out[r.vec_id] = np.array(r.embedding, float)
    return out


def test_exact_top_k(spark, odd_vectors):
    for df, every in ((odd_vectors, 3), (spark.read.parquet(f"{SF}/embeddings.parquet"), 10)):
        all_ = {k: np.floor(v * 1024) for k, v in usable(df, False).items()}
        got = {}
        for r in topk.search(df, df.where(f"vec_id % {every} = 0"), 10).collect():
            got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
        want = {}
        for q in (k for k in all_ if k % every == 0):
            best = sorted(((-int(all_[q] @ x), k) for k, x in all_.items() if k != q))[:10]
            want[q] = [(i + 1, k, -s) for i, (s, k) in enumerate(best)]
        assert {k: sorted(v) for k, v in got.items()} == want


def annuli(x, n_pivots, n_cuts):
    """(pivots, ring of each vector, bounds of the rings) as ``topk.search`` makes them."""
    norm2 = (x * x).sum(1).max()
    lifted = topk._lift(x, norm2)
    pivots = topk.pivots_of(lifted, n_pivots)
    d = topk._distances(lifted, pivots)
    near = d.argmin(1)
    cuts = {p: np.quantile(d[near == p, p], np.arange(1, n_cuts) / n_cuts) for p in np.unique(near)}
    frame = next(topk._ringed(pivots, cuts, norm2, x.shape[1])(iter([pd.DataFrame({"v": list(x)})])))
    wide = pd.concat([frame[["ring", "own"]], pd.DataFrame(np.stack(frame["at"])).add_prefix("d")], axis=1)
    each = {f"{name}{p}": (f"d{p}", f) for p in range(min(topk.BOUNDS, len(pivots))) for name, f in (("low", "min"), ("high", "max"))}
    return pivots, frame["ring"].to_numpy(), wide.groupby("ring", as_index=False).agg(low=("own", "min"), high=("own", "max"), **each)


def share_read(x, k, n_pivots, n_cuts, bounds):
    """Share of the vectors that queries read when the radius of the true k-th is known."""
    pivots, ring, rings = annuli(x, n_pivots, n_cuts)
    if not bounds:
        rings = rings.assign(**{c: (-np.inf if c.startswith("low") else np.inf) for c in rings.columns if c[-1].isdigit()})
    q = x[:60]
    _, gap = topk._gaps(q, pivots, rings)
    norm2 = (x * x).sum(1).max()
    away = np.sqrt(np.maximum(norm2 + (q * q).sum(1)[:, None] - 2 * q @ x.T, 0))
    at = np.searchsorted(rings["ring"].to_numpy(), ring)
    assert (gap[:, at] <= away + 1e-6).all()  # no vector is nearer than its annulus' bound
    rows = np.bincount(at, minlength=len(rings))
    reach = np.sort(away, 1)[:, k]
    return ((gap <= reach[:, None] + 1e-6) @ rows).mean() / len(x)


def test_bounds_of_annuli_hold_and_more_intervals_prove_more():
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (40, 8))[rng.integers(40, size=4000)] + rng.normal(0, 0.05, (4000, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    one, more = (share_read(x, 10, 16, 8, bounds) for bounds in (False, True))
    assert more < one and more < 0.1
    share_read(rng.normal(0, 1, (500, 8)), 10, 16, 4, True)


def test_nearest_neighbours(spark, odd_vectors):
    for df, every in ((odd_vectors, 3), (spark.read.parquet(f"{SF}/embeddings.parquet"), 10)):
        all_ = usable(df, True)
        got = {}
        for r in ann.search(df, df.where(f"vec_id % {every} = 0"), 20).collect():
            got.setdefault(r.query_id, []).append(r)
        hit = total = 0
        assert set(got) == {k for k in all_ if k % every == 0}
        for q, rows in got.items():
            rows.sort(key=lambda r: r.rank)
            assert [r.rank for r in rows] == list(range(1, len(rows) + 1)) and q not in {r.vec_id for r in rows}
            assert all(abs(r.score - all_[q] @ all_[r.vec_id]) < 1e-9 for r in rows)
            assert [(-r.score, r.vec_id) for r in rows] == sorted((-r.score, r.vec_id) for r in rows)
            best = sorted(((-(all_[q] @ x), k) for k, x in all_.items() if k != q))[:20]
            hit, total = hit + len({k for _, k in best} & {r.vec_id for r in rows}), total + len(best)
        assert hit >= 0.9 * total


def found_and_right(spark, x, asked, k):
    """(rows found per query, share of the true nearest among them)."""
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": list(x)}))
    got = {int(q): set() for q in asked}
    for r in ann.search(df, df.where(F.col("vec_id").isin([int(q) for q in asked])), k).collect():
        got[r.query_id].add(r.vec_id)
    score = x[asked] @ x.T
    score[np.arange(len(asked)), asked] = -np.inf
    best = np.argsort(-score, 1)[:, :k]
    return [len(v) for v in got.values()], np.mean([len(got[int(q)] & set(b.tolist())) / k for q, b in zip(asked, best)])


def test_tight_groups_find_all_k(spark, monkeypatch):
    rng = np.random.default_rng(8)
    unit = lambda a: a / np.linalg.norm(a, axis=1, keepdims=True)
    x = unit(np.repeat(rng.normal(size=(40, 16)), 60, 0) + 0.3 * rng.normal(size=(2400, 16)))
    tight = unit(np.repeat(rng.normal(size=(60, 16)), 10, 0) + 1e-4 * rng.normal(size=(600, 16)))
    monkeypatch.setattr(ann, "LIST_ROWS", 16)
    counts, right = found_and_right(spark, np.concatenate([x, tight]), np.arange(2400, 3000, 5), 20)
    assert set(counts) == {20} and right >= 0.9


def test_recall_where_lists_far_exceed_the_probes(spark, monkeypatch):
    x = np.random.default_rng(9).normal(size=(12000, 24))
    monkeypatch.setattr(ann, "LIST_ROWS", 6)  # 2,000 lists
    counts, right = found_and_right(spark, x, np.arange(0, 12000, 80), 20)
    assert set(counts) == {20} and right >= 0.9


def test_a_query_reads_on_until_its_lists_hold_enough():
    lists, d = np.array([[0, 1, 2, 3]] * 2), np.array([[0.0, 1.0, 1.5, 9.0]] * 2)
    take, short = ann._taken(lists, d, 3, 1.45, np.array([9, 9, 50, 50]), 21)
    assert take.tolist() == [[True, True, True, False]] * 2 and not short.any()
    assert ann._taken(lists, d, 1, 1.45, np.array([9, 9, 1, 1]), 21)[1].all()


def read_share(x, asked, k):
    """(share of the table that a query reads, share of its nearest it finds),
    by the index's own parts."""
    norm2 = (x * x).sum(1).max()
    lifted = ann._lifted(x, norm2)
    c = ann.fit(lifted, max(1, len(x) // ann.LIST_ROWS))
    links, entry = ann.graph(c)
    close = ann.boundary(lifted, c)
    lists, d = ann.nearest_lists(lifted, c, links, entry, ann.ROW_BEAM)
    take, _ = ann._taken(lists, d, ann.REPLICAS, close, np.zeros(len(c), int), 0)
    held = np.zeros((len(x), len(c)), bool)
    row, col = np.nonzero(take)
    held[row, lists[row, col]] = True
    home = np.bincount(lists[:, 0], minlength=len(c))
    ratio, most = ann.calibrate(x[np.random.default_rng(2).permutation(len(x))], norm2, c, close, home, k)
    lists, d = ann.nearest_lists(ann._scaled(x[asked], norm2), c, links, entry, most + ann.MORE_BEAM)
    take, _ = ann._taken(lists, d, most, ratio, home, k + 1)
    score = x[asked] @ x.T
    score[np.arange(len(asked)), asked] = -np.inf
    best = np.argsort(-score, 1)[:, :k]
    found = np.mean([held[b][:, lists[i][take[i]]].any(1).mean() for i, b in enumerate(best)])
    return held.sum(0)[np.where(take, lists, 0)][take].sum() / len(asked) / len(x), found


def test_the_ratio_follows_the_data():
    """Clusters are read alone; vectors without clusters need most of the table."""
    rng = np.random.default_rng(0)
    clustered = rng.normal(size=(100, 32))[rng.integers(0, 100, 8000)] + 0.2 * rng.normal(size=(8000, 32))
    share, found = read_share(clustered, np.arange(0, 8000, 40), 20)
    assert share <= 0.1 and found >= 0.95
    got = duckdb.sql("SELECT embedding FROM '/root/testdata/sf0.1/embeddings.parquet' WHERE embedding IS NOT NULL").fetchnumpy()["embedding"]
    share, found = read_share(np.array([list(v) for v in got], float), np.arange(0, len(got), 20), 20)
    assert share <= 1.5 and found >= 0.9  # 3.98 with a fixed ratio and four lists a vector


def test_every_search_walks_the_graph(monkeypatch):
    """Whatever the number of lists: all of them are put in order only where a beam holds too few vectors."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 8))
    norm2 = (x * x).sum(1).max()
    monkeypatch.setattr(ann, "ranked", lambda *a: pytest.fail("ranked"))
    for n in (1, 3, 70, 400):
        c = ann.fit(ann._lifted(x, norm2), n)
        links, entry = ann.graph(c)
        index = {"centroids": c, "links": links, "entry": entry, "norm2": norm2, "width": 8, "lift": "row", "sample": x[:500]}
        frame = pd.DataFrame({"key": np.arange(len(x)), "v": list(x)})
        out = pd.concat(ann._assign(index, 4, 1.02, ann.ROW_BEAM)([frame]))
        assert out[out["home"]].shape[0] == len(x)
        home = np.bincount(out["list"][out["home"]], minlength=len(c))
        asked = pd.concat(ann._assign(index | {"lift": "query"}, 8, 1.1, 24, home, 21)([frame[:50]]))
        assert asked["key"].nunique() == 50 and asked["list"].between(0, len(c) - 1).all() and not asked.duplicated(["key", "list"]).any()


def test_floors_rule_out_no_result():
    x = np.random.default_rng(7).normal(size=(4000, 16))
    asked = x[:100]
    floor = ann._floors(asked, x[2000:3000], 21)
    best = np.sort(asked @ x.T, 1)[:, -21]
    assert (floor <= best).all() and (floor > -np.inf).all()
    assert (ann._floors(asked, x[:20], 21) == -np.inf).all()


def test_a_walk_that_reaches_too_little_is_made_whole():
    """Centroids without links to most others: what the beam misses is ranked."""
    x = np.random.default_rng(6).normal(size=(200, 4))
    norm2 = (x * x).sum(1).max()
    c = ann.fit(ann._lifted(x, norm2), 40)
    index = {"centroids": c, "links": np.arange(40)[:, None], "entry": np.array([0]), "norm2": norm2, "width": 4, "lift": "query", "sample": x[:50]}
    frame = pd.DataFrame({"key": np.arange(5), "v": list(x[:5])})
    out = pd.concat(ann._assign(index, 40, 1.0, 40, np.full(40, 5), 21)([frame]))
    assert (out.groupby("key").size() >= 5).all() and out["list"].between(0, 39).all()


def test_few_and_no_vectors(spark, odd_vectors):
    few, none = odd_vectors.where("vec_id < 3"), odd_vectors.limit(0)
    for search in (ann.search, topk.search):
        assert search(few, few, 10).count() == 6
        assert search(none, none, 10).count() == 0
        assert search(odd_vectors, none, 10).count() == 0


def test_queries_of_many_lists_stay_bounded():
    """A frame held a row, with its vector, for each of 512 queries and their lists: 4 million rows."""
    rng = np.random.default_rng(3)
    c, x = rng.normal(size=(8192, 5)), rng.normal(size=(80, 4))
    links, entry = ann.graph(c)
    index = {"centroids": c, "links": links, "entry": entry, "norm2": (x * x).sum(1).max(), "width": 4, "lift": "query", "sample": x}
    assign = ann._assign(index, 8192, 1e9, 8192, np.full(8192, 50), 21)
    frame = pd.DataFrame({"key": np.arange(80), "v": list(x)})
    frames = list(assign([frame]))
    assert max(map(len, frames)) <= 1 << 18 and sum(map(len, frames)) >= 0.99 * 80 * 8192
    packed = pd.concat(ann._packed(assign, 8192)([frame]))
    assert packed["key"].tolist() == list(range(80)) and {len(b) for b in packed["others"]} == {1024}
    bits = np.unpackbits(np.frombuffer(b"".join(packed["nearest"]) + b"".join(packed["others"]), np.uint8)).sum()
    assert bits == sum(map(len, frames)) and (packed["floor"] > -np.inf).all()


def test_what_is_stored_follows_rows_and_queries(spark, monkeypatch):
    """One row a query, whatever it reads, and about a quarter of the rows in more than one list."""
    x = np.random.default_rng(12).normal(size=(12000, 24))
    stored, rows = ann.stored, {}

    def counted(df, name, *a, **b):
        out = stored(df, name, *a, **b)
        rows[name] = out.count()
        return out
    for name, value in (("SAMPLE", 2000), ("LIST_ROWS", 16), ("stored", counted)):
        monkeypatch.setattr(ann, name, value)
    counts, right = found_and_right(spark, x, np.arange(0, 12000, 60), 20)
    assert set(counts) == {20} and right >= 0.9
    assert rows["vectors"] == 12000 and rows["probes"] == 200 and rows["postings"] < 1.8 * 12000  # 100,000 probes, 3.5 lists a row


def test_chunks_of_queries_change_nothing(spark, monkeypatch, odd_vectors):
    ask = odd_vectors.where("vec_id % 3 = 0")
    want = sorted(map(tuple, ann.search(odd_vectors, ask, 20).collect()))
    monkeypatch.setattr(ann, "CHUNK_BYTES", 4000)
    assert sorted(map(tuple, ann.search(odd_vectors, ask, 20).collect())) == want


def test_readers_keep_the_best(monkeypatch):
    """Cut again and again, with copies in several lists and ties."""
    rng = np.random.default_rng(13)
    x, q, k = rng.integers(-3, 4, (900, 4)).astype(float), rng.integers(-3, 4, (30, 4)).astype(float), 4
    q[(q == 0).all(1)] = 1
    monkeypatch.setattr(ann, "HITS", 40)
    home = np.sort(np.append(rng.integers(0, 20, 900), np.arange(20)))
    row = np.append(np.arange(900), rng.integers(0, 900, 20))[rng.permutation(920)]
    batches = [pa.RecordBatch.from_pydict({"key": row[s:s + 100] * 7, "v": pa.array(list(x[row[s:s + 100]])), "ids": pa.array([[int(r)] for r in row[s:s + 100]], pa.list_(pa.int64())), "list": pa.array(home[s:s + 100], pa.int32())}) for s in range(0, 920, 100)]
    takes = rng.random((30, 20)) < 0.6
    bits = np.packbits(takes, axis=1).T
    length = np.sqrt((q * q).sum(1))
    floor = np.full(30, 6.0)
    asked = {"key": np.arange(30), "q": q, "unit": (q / length[:, None]).astype(np.float32), "scale": length * 6, "floor": floor, "nearest": bits * 0, "others": bits}
    for near in (False, True):
        if near:
            asked |= {"nearest": bits, "others": bits * 0}
        got = {i: set() for i in range(30)}
        for b in ann._read(asked, k, 4, 6.0)(batches):
            for i, found, ids, score in zip(*(b[n].to_pylist() for n in ("key", "found", "ids", "score"))):
                assert found == 7 * ids[0]
                got[i].add((-score, found))
        for i in range(30):
            there = {int(r) for r, h in zip(row, home) if takes[i, h]}
            best = sorted((-(q[i] @ x[r]), 7 * r) for r in there if near or q[i] @ x[r] >= 6)[:k + 1]
            assert [g for g in sorted(got[i])][:k + 1] == best if not near else [g[0] for g in sorted(got[i])][:k + 1] == [b[0] for b in best]


def test_sample_is_the_first_by_hash(spark, monkeypatch):
    table = spark.range(4000).select(F.xxhash64("id").alias("key"), F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("v"))
    monkeypatch.setattr(ann, "SAMPLE", 50)
    monkeypatch.setattr(ann, "HELD_OUT", 20)
    sample, spread = ann._sampled(table, 4000, 2)
    want = [r.v for r in table.orderBy(F.xxhash64("key")).limit(70).collect()]
    assert sample.tolist() == want[:50] and spread.tolist() == want[50:]
    sample, spread = ann._sampled(table.limit(30), 30, 2)
    assert len(sample) == 30 and spread.tolist() == sample[:20].tolist()


def test_arrow_columns_of_lists():
    column = pa.array([[1.0, 2.0], [3.0], [], [4.0, 5.0, 6.0]], pa.list_(pa.float32()))
    assert vectors.flat(column, 3).tolist() == vectors.matrix(column.to_pylist(), 3).tolist()
    assert vectors.flat(pa.chunked_array([column[:2], column[2:]]), 2).tolist() == [[1, 2], [3, 0], [0, 0], [4, 5]]


def test_walk_finds_near_lists():
    rng = np.random.default_rng(1)
    c = rng.normal(0, 1, (500, 16))
    links, entry = ann.graph(c)
    p = rng.normal(0, 1, (50, 16))
    lists, _ = ann.nearest_lists(p, c, links, entry, 64)
    assert all(len(set(r)) == len(r) for r in lists.tolist())
    exact = ann._squared(p, c).argsort(1)[:, :10]
    assert np.mean([len(set(a) & set(b[:64])) / 10 for a, b in zip(exact, lists)]) > 0.9


def test_url_rules(spark):
    urls = ["http://a.com/x", "https://WWW.Example.COM/en/1", "http://b.example.com/en/2?q#f", "http://example.com", "http://net/es/", "http://x.net/fr/a", "ftp://com/",
            "no scheme", "", None, "http:///en/", "http://notexample.com/en/", "http://example.com./en/", "://x.net/es/a://b", "http://x.net?/es/", "http://a..com/"]
    rows = [(i, u, "h", "x", "y") for i, u in enumerate(urls)] + [(0, urls[0], "h", "x", "y"), (None, urls[1], "h", "x", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string, rule string")
    con = duckdb.connect()
    frame = pages.select("page_id", "url").toPandas()  # noqa: F841
    con.execute("CREATE VIEW pages AS SELECT page_id::BIGINT AS page_id, url FROM frame")
    want = con.execute(urlfilter.SQL).fetchall()
    got = [tuple(r) for r in urlfilter.judge(pages, urlfilter.rules_table(spark)).select("page_id", "host", "path", "rule", "verdict").collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert urlfilter.judge(pages.limit(0), urlfilter.rules_table(spark)).count() == 0
    none = urlfilter.judge(pages, urlfilter.rules_table(spark).limit(0), default="block").collect()
    assert {(r.rule, r.verdict) for r in none} == {(None, "block")}


def test_cascade_is_exact_over_its_universe(spark):
    from pyspark.sql import functions as F
    every = spark.range(20000).select(F.concat(F.lit("k"), F.col("id")).alias("key"), "id")
    hashed = every.select("key", "id", *urlfilter._hashed(F.col("key")))
    listed = hashed.where("id % 17 = 0").drop("id")
    levels = urlfilter.cascade_of(listed, hashed.drop("id"))
    rows = hashed.toPandas()
    assert (urlfilter.members(levels, rows["h1"].to_numpy(), rows["h2"].to_numpy()) == (rows["id"] % 17 == 0)).all()


def test_registered():
    q = E.queries()
    assert "pipeline" in q and {n.split("_")[0] for n in q if n.startswith("op")} >= {f"op{i}" for i in range(1, 11)}
