"""URL rules by a Bloom filter cascade: exact membership without joins.

A rule is a host and a path prefix; it fits its host, all subdomains, and paths
that begin with its path; the longest rule that fits wins (of equal lengths the
one with the longer host). A url's candidate keys are its host's suffixes by
label, each with the prefixes of its path that have the length of some rule's
path. All distinct candidate keys of the corpus are the universe. Level 1 of
the cascade is a Bloom filter of the listed keys, level 2 one of the universe's
keys that pass level 1 but are not listed, level 3 one of the listed keys that
pass level 2, and so on until nothing passes wrongly. Over the universe the
answer is then exact. The filters' size follows the list, and only the logarithm
of the universe's size: each task holds them, and pages are judged in place. A
second cascade, over the listed keys, tells block from allow.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
lower-cased; path: then up to ``?``, ``#`` or the end. A null url or one without
``://`` has both empty and fits no rule; then the verdict is the default.
Repeated rows are judged each; a null id stays null; an empty table gives an
empty result; with no rules every verdict is the default. Of a rule given twice
with different actions, block holds. Only the id and the url are read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words
from .base import stored

MAX_LEVELS = 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def host_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), _UPPER, _LOWER)
    return F.when(F.instr(url, "://") > 0, host).otherwise("")


def path_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)).otherwise("")


def candidates(host: Column, path: Column, lengths: list[int]) -> Column:
    """array<string> of a url's candidate keys, longest first (then longer host)."""
    labels = F.split(host, "\\.", -1)
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n), "."))
    prefixes = F.array(*[F.when(F.length(path) >= k, F.substring(path, 1, k)) for k in lengths])
    pair = lambda s, p: F.struct((-F.length(s) - F.length(p)).alias("back"), (-F.length(s)).alias("host"), F.concat(s, p).alias("key"))
    every = F.flatten(F.transform(suffixes, lambda s: F.transform(F.filter(prefixes, lambda p: p.isNotNull()), lambda p: pair(s, p))))
    none = F.array().cast("array<string>")
    return F.when((F.length(host) > 0) & F.lit(bool(lengths)), F.transform(F.array_sort(every), lambda x: x["key"])).otherwise(none)


class Filter:
    """A Bloom filter as a bit array; keys come as pairs of 64-bit hashes."""

    def __init__(self, level: int, bits: int, probes: int):
        self.level, self.bits, self.probes = level, bits, probes
        self.words = np.zeros(-(-bits // 32), np.int64)

    def places(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        seed = np.uint64(self.level * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        a, b = words.mix(h1.view(np.uint64) + seed), words.mix(h2.view(np.uint64) ^ seed) | np.uint64(1)
        return np.stack([(words.mix(a + b * np.uint64(i + 1)) % np.uint64(self.bits)).astype(np.int64) for i in range(self.probes)])

    def passes(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        p = self.places(h1, h2)
        return ((self.words[p >> 5] >> (p & 31)) & 1).all(0)


def members(cascade: list[Filter], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Whether each key is listed: it is if it stops at an even level, counted
    from 1, or passes an odd number of levels in all."""
    out = np.full(len(h1), len(cascade) % 2 == 1)
    going = np.arange(len(h1))
    for i, f in enumerate(cascade):
        if not len(going):
            break
        passed = f.passes(h1[going], h2[going]).astype(bool)
        out[going[~passed]] = i % 2 == 1
        going = going[passed]
    return out


def _built(keys: DataFrame, level: int, n: int, rate: float) -> Filter:
    """The filter of all rows (h1, h2): bits are gathered by word, so that the
    driver gets no more rows than the filter has words."""
    probes = max(1, round(math.log2(1 / rate)))
    f = Filter(level, max(64, math.ceil(1.45 * n * math.log2(1 / rate))), probes)

    def run(batches):
        for batch in batches:
            p = f.places(batch.column(0).to_numpy(), batch.column(1).to_numpy()).reshape(-1)
            yield pa.RecordBatch.from_arrays([pa.array(p >> 5), pa.array(np.int64(1) << (p & 31))], ["word", "bit"])

    for row in keys.select("h1", "h2").mapInArrow(run, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toLocalIterator():
        f.words[row["word"]] = row["bits"]
    return f


def cascade_of(listed: DataFrame, universe: DataFrame) -> list[Filter]:
    """Filters that tell, for every key of ``universe``, whether it is listed.
    Both have distinct rows (key, h1, h2)."""
    inside = stored(listed.join(universe.select("key"), "key", "left_semi"), "listed")
    outside = stored(universe.join(listed.select("key"), "key", "left_anti"), "unlisted")
    n, others = inside.count(), outside.count()
    if not n:
        return []
    rate = min(0.5, max(2.0 ** -40, n * math.sqrt(0.5) / max(1, others)))
    levels: list[Filter] = []
    yes, no = inside, outside
    while True:
        levels.append(_built(yes, len(levels) + 1, n, rate if not levels else 0.5))
        wrong = stored(_passing(no, levels[-1]), f"level-{len(levels)}")
        n = wrong.count()
        if not n:
            return levels
        if len(levels) == MAX_LEVELS:
            raise RuntimeError("two keys have the same 128-bit hash")
        yes, no = wrong, yes


def _passing(keys: DataFrame, f: Filter) -> DataFrame:
    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(f.passes(batch.column(1).to_numpy(), batch.column(2).to_numpy()).astype(bool)))
    return keys.select("key", "h1", "h2").mapInArrow(run, keys.select("key", "h1", "h2").schema)


def _hashed(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")]


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict. ``rules`` has (action, host, path);
    the lengths of their paths (at most some thousands) are read by the driver."""
    listed = (rules.groupBy(F.concat("host", "path").alias("key")).agg(F.max((F.col("action") == "block").cast("int")).alias("block"), F.max(F.length("path")).alias("length"))
              .select("key", "block", "length", *_hashed(F.col("key"))))
    lengths = sorted(r[0] for r in listed.select("length").distinct().collect())
    rows = pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"))
    split = rows.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    keyed = split.withColumn("keys", candidates(F.col("host"), F.col("path"), lengths))
    universe = stored(keyed.select(F.explode("keys").alias("key")).distinct().select("key", *_hashed(F.col("key"))), "universe")
    known = listed.select("key", "h1", "h2")
    in_list = cascade_of(known, universe)
    blocked = cascade_of(listed.filter("block = 1").select("key", "h1", "h2"), known)
    hashed = keyed.withColumn("h1", F.transform("keys", lambda k: F.xxhash64(k))).withColumn("h2", F.transform("keys", lambda k: F.xxhash64(F.lit(1), k)))

    def run(batches):
        for batch in batches:
            h1, h2, keys = (batch.column(i) for i in (4, 5, 3))
            a, b = h1.flatten().to_numpy(), h2.flatten().to_numpy()
            at = h1.offsets.to_numpy() - h1.offsets[0].as_py()
            hit = np.flatnonzero(members(in_list, a, b))
            owner = np.searchsorted(at, hit, side="right") - 1
            rows_, first = np.unique(owner, return_index=True)  # keys lie longest first
            rule = np.full(batch.num_rows, -1)
            rule[rows_] = hit[first]
            found = rule >= 0
            verdict = np.full(batch.num_rows, default, object)
            verdict[found] = np.where(members(blocked, a[rule[found]], b[rule[found]]), "block", "allow")
            named = keys.flatten().take(pa.array(np.where(found, rule, 0), mask=~found))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], named, pa.array(verdict, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    return hashed.mapInArrow(run, f"page_id {rows.schema['page_id'].dataType.simpleString()}, host string, path string, rule string, verdict string")


def rules_table(spark: SparkSession, rules=None) -> DataFrame:
    return spark.createDataFrame(RULES if rules is None else rules, "action string, host string, path string")


def query(spark, sf_dir: str) -> DataFrame:
    from .base import table
    return judge(table(spark, sf_dir, "pages"), rules_table(spark))


SQL = """
WITH u AS (
  SELECT page_id, coalesce(url, '') AS url, instr(coalesce(url, ''), '://') AS pos FROM pages),
r AS (SELECT page_id, pos, substr(url, pos + 3) AS rest FROM u),
h AS (SELECT page_id,
             CASE WHEN pos > 0 THEN translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
             CASE WHEN pos > 0 THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM r),
j AS (SELECT page_id, host, path, CASE
        WHEN ('.' || host) LIKE '%.www.example.com' AND path LIKE '/en/%' THEN 'www.example.com/en/'
        WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/en/%' THEN 'example.com/en/'
        WHEN ('.' || host) LIKE '%.net' AND path LIKE '/es/%' THEN 'net/es/'
        WHEN ('.' || host) LIKE '%.net' AND path LIKE '/fr/%' THEN 'net/fr/'
        WHEN ('.' || host) LIKE '%.com' AND path LIKE '/%' THEN 'com/' END AS rule FROM h)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict FROM j
"""
