"""Importance resampling towards a target text distribution.

1. Bucket counts of all word 1- to 3-grams of the corpus and of the target are
   added up in Spark; the driver holds one array of 10,000 gains.
2. Each text is scored by gathering its features' gains from that array, and a
   draw is added that depends only on the seed and the id. Scores are stored.
3. The cutoff is found by bisection: each step is one count over the stored
   scores, first of the score, then of the id among rows tied at it, then of the
   row's number among rows tied on both. No rows are sorted or collected.
4. Only selected rows are range-partitioned by (score, id); a row's rank is its
   place in its partition plus the sizes of those before it.

The CRC-32 of an n-gram follows from those of its words: appending k bytes is a
linear map of the sum, looked up for each k, so no n-gram is built as bytes.

Null and empty texts have no features and weight 0. A null id is drawn for as an
empty one and comes first in ties; ids are whole numbers. Repeated rows count each and are drawn each.
Tables may be empty, the target too. Texts are read whole at any length, in
slices of some MB; a longer text is a slice of its own. Only ids and texts are
read, so extra columns and their names do no harm.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .base import stored, table

BUCKETS, SEED, LEAST_WORDS, PERCENT, SCALE = 10000, 42, 20, 5, 1000

_KEEP = np.zeros(256, bool)
_KEEP[0x30:0x3A] = _KEEP[0x61:0x7B] = _KEEP[0x80:] = True
_SHORT = 64  # words of up to so many bytes are summed byte by byte over all words at once


def _byte_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


_CRC = _byte_table()


@lru_cache(4096)
def _append(k: int) -> np.ndarray:
    """4 x 256 parts of the linear map of a CRC-32 when k zero bytes follow."""
    if k == 1:
        c = np.arange(256, dtype=np.uint32)
        return np.stack([_CRC, c, c << np.uint32(8), c << np.uint32(16)])
    half = _append(k // 2)
    out = _map(half, half)
    return out if k % 2 == 0 else _map(_append(1), out)


def _map(maps: np.ndarray, sums: np.ndarray) -> np.ndarray:
    m = np.uint32(255)
    return maps[0][sums & m] ^ maps[1][(sums >> np.uint32(8)) & m] ^ maps[2][(sums >> np.uint32(16)) & m] ^ maps[3][sums >> np.uint32(24)]


def _appended(sums: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each sum's map for its own number of following bytes."""
    known, which = np.unique(lengths, return_inverse=True)
    maps = np.stack([_append(int(k)) for k in known])
    m = np.uint32(255)
    return (maps[which, 0, sums & m] ^ maps[which, 1, (sums >> np.uint32(8)) & m]
            ^ maps[which, 2, (sums >> np.uint32(16)) & m] ^ maps[which, 3, sums >> np.uint32(24)])


def _word_sums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: bytes = b"") -> np.ndarray:
    """CRC-32 of ``before`` and each word."""
    size = ends - starts
    out = np.full(len(starts), zlib.crc32(before) ^ 0xFFFFFFFF, np.uint32)
    order = np.argsort(-np.minimum(size, _SHORT + 1), kind="stable")
    long = int(np.count_nonzero(size > _SHORT))
    live = order[long:]
    more = np.searchsorted(-size[live], -np.arange(1, _SHORT + 1), side="right")  # words with at least so many bytes
    for j, n in enumerate(more.tolist()):
        if not n:
            break
        at = live[:n]
        out[at] = _CRC[(out[at] ^ data[starts[at] + j]) & np.uint32(255)] ^ (out[at] >> np.uint32(8))
    out ^= np.uint32(0xFFFFFFFF)
    for i in order[:long].tolist():
        out[i] = zlib.crc32(data[starts[i]:ends[i]], zlib.crc32(before))
    return out


def features(texts: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, bucket) of every 1- to 3-gram, and each text's words."""
    data, offs = words.raw(texts)
    data = words.LOWER[data]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    starts, ends = words.segments(_KEEP[data], offs)
    doc = np.searchsorted(offs, starts, side="right") - 1
    one, spaced, size = _word_sums(data, starts, ends), _word_sums(data, starts, ends, b" "), ends - starts + 1
    docs, sums, last = [doc], [one], one
    for k in (1, 2):
        if len(doc) <= k:
            break
        last = _appended(last[:-1], size[k:]) ^ spaced[k:]
        same = doc[k:] == doc[:-k]  # within one text
        docs.append(doc[k:][same])
        sums.append(last[same])
    return np.concatenate(docs), np.concatenate(sums).astype(np.int64) % buckets, np.bincount(doc, minlength=len(texts))


def bucket_counts(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket over all rows: one array of fixed length."""
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, part in words.slices(words.as_texts(batch.column(0))):
                total += np.bincount(features(part, buckets)[1], minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["bucket", "n"])

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * ln of the smoothed ratio of shares) for each bucket."""
    n, s, t = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(scale * math.log((b + 1.0) * (s + n) / ((a + 1.0) * (t + n)))) for a, b in zip(source.tolist(), target.tolist())], np.int64)


def _draw(doc_id, seed: int, scale: int) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-scale * math.log(-math.log((h + 0.5) / 4294967296)))


def score(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, scale: int = SCALE) -> DataFrame:
    """uid, doc_id, words, n_features, weight, score."""
    def run(batches):
        for batch in batches:
            ids, texts = batch.column(1), words.as_texts(batch.column(2))
            for first, part in words.slices(texts):
                doc, bucket, count = features(part, len(gain))
                n = len(part)
                # whole numbers far below 2^53, so sums in doubles are exact
                weight = np.bincount(doc, weights=gain[bucket], minlength=n).astype(np.int64)
                own = ids.slice(first, n)
                drawn = weight + np.array([_draw(x, seed, scale) for x in own.to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), own, pa.array(count), pa.array(np.bincount(doc, minlength=n)),
                                                  pa.array(weight), pa.array(drawn)], ["uid", "doc_id", "words", "n_features", "weight", "score"])

    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"uid long, doc_id {docs.schema[id_col].dataType.simpleString()}, words long, n_features long, weight long, score long")


def _kth(rows: DataFrame, column: str, k: int) -> tuple[int, int]:
    """(the k-th smallest value of a whole-number column, rows below it), by
    counts over rows; k is at least 1 and at most the number of rows."""
    low, high = rows.agg(F.min(column), F.max(column)).first()
    below = 0
    while low < high:
        mid = (low + high) // 2
        n = rows.filter(F.col(column) <= mid).count()
        if n >= k:
            high = mid
        else:
            low, below = mid + 1, n
    return low, below


def select(scored: DataFrame, k: int) -> DataFrame:
    """The k rows of highest score, ties to the smaller id, then to the row read
    first. ``scored`` is a stored table: every step of the search reads it."""
    if k <= 0:
        return scored.limit(0)
    cut, above = _kth(scored.withColumn("low", -F.col("score")), "low", k)
    tied, left = scored.filter(F.col("score") == -cut), k - above
    nulls = tied.filter("doc_id IS NULL").count()
    here = F.col("score") == -cut
    if left <= nulls:
        uid, _ = _kth(tied.filter("doc_id IS NULL"), "uid", left)
        return scored.filter((F.col("score") > -cut) | (here & F.col("doc_id").isNull() & (F.col("uid") <= uid)))
    known = tied.filter("doc_id IS NOT NULL")
    doc, smaller = _kth(known, "doc_id", left - nulls)
    uid, _ = _kth(known.filter(F.col("doc_id") == doc), "uid", left - nulls - smaller)
    inside = F.col("doc_id").isNull() | (F.col("doc_id") < doc) | ((F.col("doc_id") == doc) & (F.col("uid") <= uid))
    return scored.filter((F.col("score") > -cut) | (here & inside))


def ranked(selected: DataFrame) -> DataFrame:
    """uid, rank: 1, 2, 3... by score downwards, id, row number."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first(), "uid"]
    place = F.monotonically_increasing_id()
    dealt = stored(selected.select("uid", "doc_id", "score").repartitionByRange(*order).sortWithinPartitions(*order).select("uid", place.alias("place")), "drawn")
    part, at = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    dealt = dealt.select("uid", part.alias("part"), at.alias("at"))
    from pyspark.sql import Window
    # one row for each range partition
    sizes = dealt.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return dealt.join(before, "part").select("uid", (F.col("before") + F.col("at") + 1).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
             percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row; the rows drawn,
    floor(percent * N / 100) of the N with enough words, have a rank."""
    gain = gains(bucket_counts(docs, text_col), bucket_counts(target, target_col))
    scored = stored(score(docs, gain, id_col, text_col, seed), "scores")
    fit = scored.filter(F.col("words") >= least_words)
    drawn = ranked(select(fit, percent * fit.count() // 100))
    return scored.join(drawn, "uid", "left").select("doc_id", "n_features", "weight", "score", "rank")


def query(spark, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# CRC-32 of a feature: of one byte by eight steps, of a text by the table of these for all bytes.
SQL = r"""
WITH
crc AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda v, i: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END))) AS t),
w AS (
  SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT 0 AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark)),
g AS (
  SELECT kind, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
                          list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS feature FROM w),
c AS (SELECT kind, id, feature, count(*) AS n FROM g GROUP BY ALL),
x AS (SELECT feature, list_transform(range(1, strlen(feature) + 1), lambda i: ('0x' || substr(hex(feature), 2 * i - 1, 2))::BIGINT) AS bytes FROM (SELECT DISTINCT feature FROM c)),
b AS (
  SELECT feature, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda s, y: xor(s >> 8, t[1 + (xor(s, y) & 255)]))) % 10000 AS bucket
  FROM x, crc),
per AS (SELECT kind, id, bucket, sum(n)::BIGINT AS n FROM c JOIN b USING (feature) GROUP BY ALL),
sums AS (
  SELECT coalesce(sum(n) FILTER (kind = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (kind = 1), 0)::DOUBLE AS t FROM per),
gains AS (
  SELECT bucket, floor(1000 * ln((coalesce(sum(n) FILTER (kind = 1), 0)::DOUBLE + 1) * (any_value(sums.s) + 10000)
                                 / ((coalesce(sum(n) FILTER (kind = 0), 0)::DOUBLE + 1) * (any_value(sums.t) + 10000))))::BIGINT AS gain
  FROM per, sums GROUP BY bucket),
weights AS (SELECT id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM per JOIN gains USING (bucket) WHERE kind = 0 GROUP BY id),
scored AS (
  SELECT id AS doc_id, len(w) AS words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM w LEFT JOIN weights USING (id) WHERE kind = 0),
drawn AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE words >= 20
  QUALIFY rank <= 5 * (SELECT count(*) FROM scored WHERE words >= 20) // 100)
SELECT doc_id, n_features, weight, score, rank FROM scored LEFT JOIN drawn USING (doc_id)
"""
