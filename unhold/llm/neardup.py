"""Near-duplicate documents by fast similarity sketching.

A document's set is its distinct five-word shingles. Documents with equal sets
are one node. A node's sketch has BINS coordinates: in round i each shingle is
hashed to one coordinate and a value in [i, i+1); in round BINS+j to coordinate
j, so that every coordinate fills after 2*BINS rounds at most, and each keeps
its least value. Bands of ROWS coordinates make buckets. In a bucket every node
is checked against the smallest one on full sets; buckets whose nodes are not
all linked by then are checked pair by pair, in blocks of bounded size sorted
by set size, skipping blocks whose sizes rule a link out. So no link between
nodes that share a bucket is lost, and a pair of similarity 0.85 shares none
with probability (1 - 0.85**ROWS)**BANDS, below 1e-5; for other thresholds the
number of bands follows from that bound (29 at 0.80).

Nulls and empty texts have an empty set: n_shingles 0, linked with nothing,
component_id their own doc_id, kept. A null doc_id counts as larger than any
other. Repeated rows are members of one node, each with its row in the result.
An empty table gives an empty result. Only the id and the text are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .base import stored
from .components import components

SHINGLE, THRESHOLD = 5, 85  # words; percent
BANDS, ROWS = 20, 5
BINS = BANDS * ROWS
MISSED = 1e-5  # the probability, at most, that a pair at the threshold shares no band
BLOCK_HASHES = 1 << 19  # shingles of a block of a bucket that is checked pair by pair

_U = np.uint64
_FULL = _U(0xFFFFFFFFFFFFFFFF)


def sketches(sets: list[np.ndarray], bins: int = BINS) -> np.ndarray:
    """(sets x bins) least hashed values; a row of an empty set stays full."""
    out = np.full((len(sets), bins), _FULL, np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    items = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    flat = out.reshape(-1)
    for i in range(2 * bins):
        if not len(items):
            break
        h = words.mix(items + _U((i + 1) * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF))
        at = (h >> _U(32)) * _U(bins) >> _U(32) if i < bins else np.full(len(h), i - bins, np.uint64)
        np.minimum.at(flat, owner * bins + at.astype(np.int64), (_U(i) << _U(56)) | words.mix(h) >> _U(8))
        open_ = (out == _FULL).any(1)[owner]
        items, owner = items[open_], owner[open_]
    return out


def bands(sketch: np.ndarray, n_bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    key = np.zeros((len(sketch), n_bands), np.uint64)
    for r in range(rows):
        key = words.mix(key + sketch[:, r:n_bands * rows:rows] + _U(r + 1))
    return words.mix(key + np.arange(n_bands, dtype=np.uint64)[None, :] * _U(0x9E3779B97F4A7C15)).view(np.int64)


def bands_for(threshold: int, rows: int = ROWS) -> int:
    """Bands that keep the probability of a missed pair at MISSED, at least BANDS."""
    return max(BANDS, int(np.ceil(np.log(MISSED) / np.log1p(-(threshold / 100) ** rows))))


def fingerprints(sets: list[np.ndarray]) -> list[bytes | None]:
    """16 bytes that two different sets share with negligible probability."""
    out = []
    for s in sets:
        if len(s):
            out.append((words.mix(s).sum(keepdims=True) + _U(len(s))).tobytes() + np.bitwise_xor.reduce(words.mix(s * _U(0xA24BAED4963EE407)), keepdims=True).tobytes())
        else:
            out.append(None)
    return out


def _signatures(n_bands: int):
    def run(batches):
        for batch in batches:
            texts = words.as_texts(batch.column(2))
            for first, part in words.slices(texts):
                sets = words.shingle_sets(part, SHINGLE)
                n = len(part)
                keys = bands(sketches(sets, n_bands * ROWS), n_bands)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, n), batch.column(1).slice(first, n), pa.array(fingerprints(sets), pa.binary()),
                     pa.array([len(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * n_bands), pa.array(keys.reshape(-1)))],
                    ["doc_id", "text_hash", "node", "n_shingles", "bands"])
    return run


def _sets(batches):
    for batch in batches:
        texts, want = words.as_texts(batch.column(1)), batch.column(0).to_pylist()
        for first, part in words.slices(texts):
            sets = words.shingle_sets(part, SHINGLE)
            right = [k for k, f in enumerate(fingerprints(sets)) if f == want[first + k]]
            yield pa.RecordBatch.from_arrays([pa.array([want[first + k] for k in right], pa.binary()), pa.array([sets[k].view(np.int64) for k in right], pa.list_(pa.int64()))],
                                             ["node", "shingles"])


def _cross_links(threshold: int):
    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        """One link for every node and other component that it is linked with,
        between the two blocks of a bucket that meet here."""
        out = []
        left, right = frame[frame["side"] == 0], frame[frame["side"] == 1]
        if len(left) and len(right):
            sets = [np.asarray(s, np.int64) for s in right["shingles"]]
            known, flat = np.unique(np.concatenate(sets), return_inverse=True)  # shingles numbered within the block
            mark = np.zeros(len(known), np.int64)
            ends = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
            size, root, nodes = np.diff(ends), right["root"].to_numpy(), right["node"].to_numpy()
            for node, mine, shingles in zip(left["node"], left["root"], left["shingles"]):
                own = np.searchsorted(known, shingles)
                own = own[known[np.minimum(own, len(known) - 1)] == shingles]
                if 100 * len(own) < threshold * len(shingles):  # what it shares with the whole block is too little for any link
                    continue
                mark[own] = 1
                same = np.add.reduceat(mark[flat], ends[:-1])
                mark[own] = 0
                hit = np.flatnonzero(100 * same >= threshold * (len(shingles) + size - same))
                seen = {mine}
                for j in hit:
                    if root[j] not in seen:
                        seen.add(root[j])
                        out.append((node, nodes[j]))
        return pd.DataFrame(out, columns=["a", "b"])
    return run


def _linked(a: str, b: str, threshold: int):
    same = F.size(F.array_intersect(a, b))
    return same * 100 >= (F.size(a) + F.size(b) - same) * threshold


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, text_hash, node, n_shingles, component_id: one row per row of
    ``docs``; the rows of a group share component_id. ``threshold`` is in percent."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    id_type = docs.schema[id_col].dataType.simpleString()
    signed = stored(rows.mapInArrow(_signatures(bands_for(threshold)), f"doc_id {id_type}, text_hash long, node binary, n_shingles long, bands array<long>"), "signed")

    # a node: the smallest document that has its set (null last)
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    nodes = stored(signed.filter("node IS NOT NULL").groupBy("node").agg(
        F.min(first).alias("first"), F.any_value("n_shingles").alias("n"), F.any_value("bands").alias("bands")), "nodes")
    keyed = nodes.select("node", "n", F.explode("bands").alias("band"))
    full = keyed.groupBy("band").agg(F.count("*").alias("size"), F.min(F.struct("node", "n")).alias("least")).filter("size > 1")
    members = stored(keyed.join(full, "band").select("band", "node", "n", "size", F.col("least.node").alias("lead"), F.col("least.n").alias("lead_n")), "buckets")

    wanted = members.select("node").distinct().join(nodes.select("node", "first"), "node")
    texts = rows.alias("r").join(wanted.alias("w"), (F.col("r.text_hash") == F.col("w.first.text_hash")) & F.col("r.doc_id").eqNullSafe(F.col("w.first.doc_id")))
    sets = stored(texts.select("w.node", "r.text").mapInArrow(_sets, "node binary, shingles array<long>").dropDuplicates(["node"]), "sets")

    stars = (members.filter("node != lead").filter(F.least("n", "lead_n") * 100 >= F.greatest("n", "lead_n") * threshold)
             .select(F.col("node").alias("a"), F.col("lead").alias("b")).distinct()
             .join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a")), "a")
             .join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b")), "b")
             .filter(_linked("of_a", "of_b", threshold)).select("a", "b"))
    forest = components(stars)
    links = forest.select("a", F.col("root").alias("b")).unionByName(_missed(members, forest, sets, threshold))
    found = components(links)

    # the smallest doc_id of a component, over the members of its nodes
    rooted = nodes.select("node", F.col("first.doc_id").alias("least")).join(found.withColumnRenamed("a", "node"), "node", "left") \
        .withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_node = rooted.select("node", "root").join(least, "root").select("node", "component_id")
    return (signed.drop("bands").join(of_node, "node", "left")
            .withColumn("component_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))))


def _missed(members: DataFrame, forest: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Links (a, b) across the components of a bucket's nodes: all pairs of a
    node outside the bucket's largest component with any node of the bucket."""
    rooted = members.filter("size > 2").join(forest.withColumnRenamed("a", "node"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    per_root = rooted.groupBy("band", "root").agg(F.count("*").alias("in_root"))
    split = per_root.groupBy("band").agg(F.count("*").alias("roots"), F.max(F.struct("in_root", "root")).alias("largest")).filter("roots > 1")
    open_ = rooted.join(split.select("band", F.col("largest.root").alias("main")), "band").select("band", "node", "n", "root", (F.col("root") == F.col("main")).alias("in_main"))
    # blocks by set size: the rows of a block have n in [2^(k/8), 2^((k+1)/8)) and are dealt to as many parts as their shingles need
    step = F.floor(F.log2("n") * 8).cast("int")
    sized = open_.withColumn("step", step)
    need = sized.groupBy("band", "step").agg(F.ceil(F.sum("n") / BLOCK_HASHES).cast("int").alias("parts"))
    reach = int(np.ceil(8 * np.log2(100 / threshold)))  # steps of 2^(1/8) that the sizes of a link are apart at most (2 at 0.85)
    blocks = sized.join(need, ["band", "step"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    other = need.select("band", F.col("step").alias("other_step"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other_part"))
    left = (blocks.filter("NOT in_main").withColumn("other_step", F.explode(F.array(*[F.col("step") + d for d in range(-reach, reach + 1)])))
            .join(other, ["band", "other_step"]))
    meets = left.select("band", "step", "part", "other_step", "other_part").distinct()
    right = blocks.select("band", F.col("step").alias("other_step"), F.col("part").alias("other_part"), "node", "root").join(meets, ["band", "other_step", "other_part"])
    at = ["band", "step", "part", "other_step", "other_part"]
    both = left.select(*at, "node", "root", F.lit(0).alias("side")).unionByName(right.select(*at, "node", "root", F.lit(1).alias("side")))
    return both.join(sets, "node").groupBy(*at).applyInPandas(_cross_links(threshold), "a binary, b binary")


def digest(grouped: DataFrame) -> DataFrame:
    return grouped.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each group: all columns, rows with an empty set
    all stay. Of repeated rows that would both stay, one does."""
    found = stored(groups(docs, id_col, text_col, threshold), "groups")
    best = found.filter("node IS NOT NULL").filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    # one text where a repeated id has several in a group, and how often it is there
    one = best.groupBy("doc_id", "component_id").agg(F.min("text_hash").alias("h"), F.count("*").alias("times"))
    prefix = "_" * (1 + max(len(c) for c in docs.columns))
    hashed = docs.withColumn(f"{prefix}h", F.xxhash64(text_col)).withColumn(f"{prefix}i", F.col(id_col))
    blank = found.filter("node IS NULL").select(F.col("text_hash").alias("h"), F.col("doc_id"), F.lit(1).cast("long").alias("times")).distinct()
    pick = one.select("h", "doc_id", "times").unionByName(blank).select(F.col("h").alias(f"{prefix}kh"), F.col("doc_id").alias(f"{prefix}ki"), F.col("times").alias(f"{prefix}t"))
    stay = hashed.join(pick, (F.col(f"{prefix}h") == F.col(f"{prefix}kh")) & F.col(f"{prefix}i").eqNullSafe(F.col(f"{prefix}ki")))
    stay = stored(stay, "kept")
    once = stay.filter(F.col(f"{prefix}t") == 1)
    more = stay.filter(F.col(f"{prefix}t") > 1).dropDuplicates([f"{prefix}h", f"{prefix}i"])
    return once.unionByName(more).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    from .base import table
    return digest(groups(table(spark, sf_dir, "documents")))


# Pairs that share a shingle, so for small tables only.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN []::VARCHAR[] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS s
  FROM w),
each AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS both_have
  FROM each a JOIN each b ON a.shingle = b.shingle AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM shared WHERE 100 * both_have >= 85 * (na + nb - both_have)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT doc_id, doc_id FROM sets UNION SELECT reach.a, ways.b FROM reach JOIN ways ON ways.a = reach.b),
found AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN found ON found.a = sets.doc_id
"""
