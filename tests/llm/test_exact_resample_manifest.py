"""Exact dedup, importance resampling and the Merkle manifest against brute
force, and on nulls, empties, ties, repeated rows, empty tables and clashing
columns."""

import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from llm_fixtures import DOCS, SF, no_docs, odd_docs  # noqa: F401
from pyspark.sql import functions as F
from unhold.llm import exactdup, manifest, resample, words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows_of(df):
    return [tuple(r) for r in df.collect()]


# -- exact dedup ------------------------------------------------------------

@pytest.mark.parametrize("n, scale", [(1, 5), (7, 1), (1000, 3), (5000, 1 << 20), (200, 1 << 40)])
def test_golomb_round_trip(n, scale):
    gaps = np.random.default_rng(n).integers(0, scale, n).astype(np.uint64)
    code = exactdup.golomb(gaps)
    assert (exactdup.degolomb(code, n) == gaps).all()
    if n == 5000:
        assert len(code) * 8 < n * 23  # 20-bit gaps cost little more than their entropy


def brute_dedup(rows):
    """Of (doc_id, text) rows: digest rows without ``kept``, and how many stay in each group."""
    norm = [re.sub(r"[ \t-\r]", "", t or "") for _, t in rows]
    by = {}
    for (i, t), x in zip(rows, norm):
        by.setdefault(x, []).append((-len(t or ""), i is None, i or 0))
    first = {x: min(v) for x, v in by.items()}
    return sorted(((i, None if first[x][1] else first[x][2], len(by[x]), hashlib.sha256(x.encode()).hexdigest()) for (i, _), x in zip(rows, norm)), key=str), len(by)


def test_exact_dedup_against_brute_force(spark, odd_docs, no_docs):
    blank = spark.createDataFrame([(20, " a b\n", "en", "s", 5), (21, "ab", "en", "s", 2), (22, "a\x0bb\x0c\r\t", "en", "s", 6), (23, "a b", "en", "s", 3),
                                   (24, "AB", "en", "s", 2), (25, "  ab ", "en", "s", 5), (26, "a b \n", "en", "s", 5)], DOCS)
    for df in (odd_docs, blank, spark.read.parquet(f"{SF}/documents.parquet"), no_docs):
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        want, n_groups = brute_dedup(rows)
        found = exactdup.digest(exactdup.groups(df)).collect()
        assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found), key=str) == want
        assert sum(r.kept for r in found) == n_groups
        assert all(r.doc_id == r.keep_id for r in found if r.kept)


def test_exact_dedup_keeps_all_columns_and_one_of_tied_rows(spark, odd_docs):
    kept = exactdup.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert [r.n for r in kept.filter("doc_id = 1").groupBy().agg(F.count("*").alias("n")).collect()] == [1]
    assert kept.count() == odd_docs.select(F.translate(F.coalesce("text", F.lit("")), exactdup.BLANKS, "")).distinct().count()


def test_a_hot_group_and_short_fingerprints(spark, monkeypatch):
    """A third of all rows alike; with few bits many suspects differ and stay."""
    monkeypatch.setattr(exactdup, "SPARE_BITS", 0)
    monkeypatch.setattr(exactdup, "MESSAGE_HASHES", 64)
    df = spark.range(0, 3000, 1, 7).select("id", F.when(F.col("id") % 3 == 0, F.lit("hot text")).otherwise(F.concat(F.lit("t"), (F.col("id") / 2).cast("int"))).alias("body"))
    found = exactdup.groups(df, "id", "body").collect()
    rows = [(r.id, r.body) for r in df.collect()]
    want, n_groups = brute_dedup(rows)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, bytes(r.sha).hex()) for r in found), key=str) == want
    assert sum(r.kept for r in found) == n_groups and max(r.group_size for r in found) == 1000


def test_texts_are_not_shuffled_by_the_exchange(spark):
    """Stored rows are read by their homes as they lie."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").select(F.lit(1).alias("home"), F.lit(0).cast("long").alias("split"), F.monotonically_increasing_id().alias("row"), F.xxhash64("text").alias("fp"), "text")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.write.mode("overwrite").bucketBy(n, "home").saveAsTable("bucketed_probe")
    try:
        base = spark.table("bucketed_probe")
        marks = exactdup.suspects(base, 20, 1).hint("shuffle_hash")
        plan = base.join(marks, "home").groupBy("home").agg(F.max("text"))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1  # the marks, not the texts
    finally:
        spark.sql("DROP TABLE bucketed_probe")


# -- importance resampling ---------------------------------------------------

def brute_features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    grams = [" ".join(w[i:i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]
    return len(w), [zlib.crc32(g.encode()) % 10000 for g in grams]


def brute_resample(docs, target):
    s, t = np.zeros(10000, int), np.zeros(10000, int)
    per = [(i, *brute_features(x)) for i, x in docs]
    for _, _, f in per:
        np.add.at(s, f, 1)
    for x in target:
        np.add.at(t, brute_features(x)[1], 1)
    gain = [math.floor(1000 * math.log((int(b) + 1) * (int(s.sum()) + 10000) / ((int(a) + 1) * (int(t.sum()) + 10000)))) for a, b in zip(s, t)]
    out = []
    for n, (i, w, f) in enumerate(per):
        weight = sum(gain[b] for b in f)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, w])
    fit = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for k, r in enumerate(fit[:5 * len(fit) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def test_features_against_brute_force():
    texts = ["One two  THREE, four-five.", "", None, "é日本 x1 y z", "Ünï ÀB", "a" * 63 + " " + "b" * 64 + " " + "c" * 65 + " " + "d" * 1000 + " e", "x", "\x7f\x00", "end", "start of next"]
    doc, bucket, count = resample.features(words.as_texts(pa.array(texts)))
    for i, t in enumerate(texts):
        n, want = brute_features(t)
        assert count[i] == n and sorted(bucket[doc == i].tolist()) == sorted(want)


def test_resampling_query_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert sorted(rows_of(resample.query(spark, SF)), key=str) == brute_resample(docs, target)


def test_resampling_ties_nulls_and_empty_tables(spark, odd_docs, no_docs):
    text = "one two three four five six seven eight nine ten " * 3
    ties = spark.createDataFrame([(i // 2, text, "en", "s", 1) for i in range(100)] + [(None, text, "en", "s", 1)] * 3, DOCS)
    target = spark.createDataFrame([("one two three",), (None,), ("",)], "text string")
    for df, other in ((odd_docs, target), (ties, target), (no_docs, target), (odd_docs, target.limit(0)), (no_docs, target.limit(0))):
        want = brute_resample([(r.doc_id, r.text) for r in df.collect()], [r.text for r in other.collect()])
        assert sorted(rows_of(resample.resample(df, other)), key=str) == want


def test_selection_among_full_ties(spark, tmp):
    """One score for all: the search goes on to ids, then to rows of one id."""
    spark.createDataFrame([(u, None if u < 3 else 5 + u // 10, 7) for u in range(60)], "uid long, doc_id long, score long").write.parquet(f"{tmp}/s")
    scored = spark.read.parquet(f"{tmp}/s")
    for k in (0, 1, 3, 4, 10, 17, 60):
        got = sorted(r.uid for r in resample.select(scored, k).collect())
        assert got == list(range(k))
        assert sorted((r.uid, r.rank) for r in resample.ranked(resample.select(scored, k)).collect()) == [(u, u + 1) for u in range(k)]


# -- Merkle manifest ----------------------------------------------------------

def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_manifest(rows):
    """Digest rows of (doc_id, source, lang, n_chars, text)."""
    def own(values):
        return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])

    def tree(hashes):
        """(root, siblings of each leaf as (left, right) by level)."""
        paths, at, level = [[] for _ in hashes], list(range(len(hashes))), hashes
        while len(level) > 1:
            for k, i in enumerate(at):
                run = level[i // 8 * 8:i // 8 * 8 + 8]
                paths[k].append(("".join(run[:i % 8]), "".join(run[i % 8 + 1:])))
                at[k] = i // 8
            level = [sha(*level[j:j + 8]) for j in range(0, len(level), 8)]
        return level[0], paths

    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    parts, tops = {}, []
    for g in names:
        members = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, own(r)))
        top, paths = tree([own(r) for r in members])
        parts[g] = (members, paths, top)
        tops.append(top)
    if not names:
        return []
    root, upper = tree(tops)
    out = []
    for g, above in zip(names, upper):
        members, paths, top = parts[g]
        for r, path in zip(members, paths):
            path = path + above
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None
            node = own((*r[:4], r[4].translate(LOWER))) if hit else own(r)
            for left, right in path:
                node = sha(left, node, right)
            out.append((r[0], own(r), top, root, sha(*[x + y for x, y in path]), node, node == root))
    return sorted(out, key=str)


def fields_of(df):
    return [tuple(r) for r in df.select(*manifest.FIELDS[:1], "source", "lang", "n_chars", "text").collect()]


def test_manifest_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = sorted(rows_of(manifest.query(spark, SF)), key=str)
    assert got == brute_manifest(fields_of(docs))
    assert 0 < sum(r[-1] for r in got) < len(got)


def test_manifest_of_odd_and_empty_tables(spark, odd_docs, no_docs):
    for df in (odd_docs, no_docs, odd_docs.filter("doc_id = 9")):
        got = manifest.digest(manifest.manifest(df, tampered=manifest.lower_every_third))
        assert sorted(rows_of(got), key=str) == brute_manifest(fields_of(df))
    assert all(r.verified for r in manifest.manifest(odd_docs).collect())


def test_manifest_of_many_rounds(spark, monkeypatch):
    """Several rounds below and above, groups of one, of exact powers and one more."""
    monkeypatch.setattr(manifest, "LEVELS", 1)
    monkeypatch.setattr(manifest, "BLOCK", 8)
    sizes = {None: 1, "": 8, "a": 9, "b": 64, "c": 65, "Z": 530, **{f"g{i}": 1 for i in range(70)}}
    rows = [(1000 * k + i, f"s{i % 3}", g, i, f"Text {i} OF {g}") for k, (g, n) in enumerate(sizes.items()) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    assert sorted(rows_of(manifest.digest(manifest.manifest(df, tampered=manifest.lower_every_third))), key=str) == brute_manifest(rows)
