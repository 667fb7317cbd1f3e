"""Mixing sources to target weights by Pfair scheduling. DataFrame functions only.

A source's documents, in order of a seeded hash, are cut into blocks of
``block_chars`` characters (a document is in the block that its first character
falls in). Weights are rounded to whole slots out of a period of D slots: w =
c / D. Block j (from 0) of a source is released at floor(j / w) and due at
ceil((j + 1) / w); each slot goes to the released block with the earliest
deadline. At full use every deadline is met, so after any number of slots every
source has had its share to within less than one block. The schedule repeats
every D slots, so one period of it, a bounded table, places all blocks by an
equi-join. When a source has run out, its slots stay empty and the others go on
in proportion.

Places within a source are running sums taken in two steps (within hash
buckets, then over the buckets' totals), so no task holds a whole source.

Nulls: a null source is a source of its own; a null or empty text has no
characters and lies where it falls; repeated rows are placed each, in no fixed
order among themselves; a source that is given no weight gets the weight 1; an
empty table gives an empty result. Columns other than id, text and source are
kept by ``ordered`` and not read by ``schedule``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .base import stored

BLOCK_CHARS = 65536
PERIOD = 1000  # slots of a period, at least
HEX = 3  # hash digits that make a bucket: 16**HEX buckets per source
SEED = "mix"
MAX_BROADCAST_SOURCES = 10000  # the timetable is sent to all tasks only when it has no more rows


def _key(source: Column) -> Column:
    """A source's name as a key that is never null."""
    return F.coalesce(F.concat(F.lit("s:"), source.cast("string")), F.lit("n"))


def natural_weights(sized: DataFrame) -> DataFrame:
    """(key, weight): the square root of a source's characters, in thousandths,
    so that large sources are damped and small ones raised."""
    return sized.groupBy("key").agg(F.sum("chars").alias("chars")).select(
        "key", F.floor(F.sqrt(F.greatest("chars", F.lit(1)).cast("double")) * 1000).cast("long").alias("weight"))


def shares_of(weights: DataFrame, period: int = PERIOD) -> DataFrame:
    """(key, share, period): whole slots of a period per source, one at least;
    what is left over goes to the heaviest first."""
    every = Window.partitionBy(F.lit(0))  # one row per source
    total = weights.withColumn("n", F.count("*").over(every)).withColumn("all", F.sum("weight").over(every))
    cut = (total.withColumn("period", F.greatest(F.lit(period), 4 * F.col("n")).cast("long"))
           .withColumn("share", 1 + F.floor((F.col("period") - F.col("n")) * F.col("weight") / F.col("all")).cast("long")))
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("weight"), "key"))
    left = F.col("period") - F.sum("share").over(every)
    return cut.withColumn("share", F.col("share") + F.when(rank <= left, 1).otherwise(0)).select("key", "share", "period")


def timetable(shares: DataFrame) -> DataFrame:
    """(key, share, period, turns): the slots of a source's turns in a period, by
    earliest deadline first among the released blocks; ties go to the smaller key."""
    one = shares.groupBy("period").agg(F.sort_array(F.collect_list(F.struct("key", "share"))).alias("s"))
    whole = F.col("period")

    def step(acc: Column, t: Column) -> Column:
        due = F.zip_with(F.col("s.share"), acc["had"], lambda c, h: F.when(F.floor(h * whole / c) <= t, F.ceil((h + 1) * whole / c)))
        first = F.array_position(due, F.array_min(due))  # array_min passes over those not released
        return F.struct(F.transform(acc["had"], lambda h, i: h + F.when(i + 1 == first, 1).otherwise(0)).alias("had"),
                        F.concat(acc["out"], F.array(first)).alias("out"))

    start = F.struct(F.transform("s", lambda x: F.lit(0).cast("long")).alias("had"), F.array().cast("array<bigint>").alias("out"))
    run = F.aggregate(F.sequence(F.lit(0).cast("long"), whole - 1), start, step, lambda acc: acc["out"])
    each = one.select("period", "s", F.posexplode(run).alias("slot", "nth")).withColumn("of", F.element_at("s", F.col("nth").cast("int")))
    return each.groupBy(F.col("of.key").alias("key"), F.col("of.share").alias("share"), "period").agg(F.sort_array(F.collect_list(F.col("slot").cast("long"))).alias("turns"))


def _planned(rows: DataFrame, block_chars: int, weights: DataFrame | None, period: int) -> DataFrame:
    """Rows (key, doc_id, chars, hash, ...) with block, slot, release, deadline."""
    rows = rows.withColumn("bucket", F.substring("hash", 1, HEX))
    per = stored(rows.groupBy("key", "bucket").agg(F.sum("chars").alias("chars")), "buckets")
    given = natural_weights(per) if weights is None else weights.select(_key(F.col("source")).alias("key"), F.col("weight").cast("long").alias("weight"))
    if weights is not None:  # a source without a weight goes last in proportion: the least weight of all
        given = per.select("key").distinct().join(given, "key", "left").fillna({"weight": 1})
    table = stored(timetable(shares_of(given, period)), "timetable")
    before = F.sum("chars").over(Window.partitionBy("key").orderBy("bucket")) - F.col("chars")  # 16**HEX rows per source
    per = per.withColumn("before", before).drop("chars")
    within = F.sum("chars").over(Window.partitionBy("key", "bucket").orderBy("hash", "doc_id").rowsBetween(Window.unboundedPreceding, 0)) - F.col("chars")
    blocked = rows.withColumn("within", within).join(per, ["key", "bucket"]).withColumn("block", F.floor((F.col("before") + F.col("within")) / block_chars).cast("long"))
    few = table.limit(MAX_BROADCAST_SOURCES + 1).count() <= MAX_BROADCAST_SOURCES
    at = blocked.join(F.broadcast(table) if few else table, "key")
    turn = F.col("block") % F.col("share")
    return (at.withColumn("slot", F.floor(F.col("block") / F.col("share")) * F.col("period") + F.element_at("turns", (turn + 1).cast("int")))
            .withColumn("release", F.floor(F.col("block") * F.col("period") / F.col("share")))
            .withColumn("deadline", F.ceil((F.col("block") + 1) * F.col("period") / F.col("share"))))


def _rows(docs: DataFrame, id_col: str, text_col: str, source_col: str, *more: Column) -> DataFrame:
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return docs.select(_key(F.col(source_col)).alias("key"), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                       F.coalesce(F.length(text_col), F.lit(0)).cast("long").alias("chars"), F.md5(F.concat(F.lit(SEED + ":"), ident)).alias("hash"), *more)


def schedule(docs: DataFrame, block_chars: int = BLOCK_CHARS, weights: DataFrame | None = None, period: int = PERIOD,
             id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, chars, block, slot, release, deadline, hash. Read by
    (slot, hash, doc_id), the sources are mixed to their weights. ``weights`` has
    rows (source, weight) with whole positive weights."""
    rows = _rows(docs, id_col, text_col, source_col)
    return _planned(rows, block_chars, weights, period).select("doc_id", "source", "chars", "block", "slot", "release", "deadline", "hash")


def ordered(docs: DataFrame, block_chars: int = BLOCK_CHARS, weights: DataFrame | None = None, period: int = PERIOD,
            id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs``, all rows and columns, sorted across its files by the schedule."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    planned = _planned(_rows(docs, id_col, text_col, source_col, row), block_chars, weights, period)
    order = ["slot", "hash", "doc_id"]
    return planned.select("row", *order).repartitionByRange(*order).sortWithinPartitions(*order).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    from .base import table
    return schedule(table(spark, sf_dir, "documents"))


SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce('s:' || source, 'n') AS key, coalesce(length(text), 0)::BIGINT AS chars,
         md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS hash
  FROM documents),
placed AS (
  SELECT *, ((sum(chars) OVER (PARTITION BY key ORDER BY hash, doc_id ROWS UNBOUNDED PRECEDING) - chars) // {BLOCK_CHARS})::BIGINT AS block FROM d),
w AS (SELECT key, floor(sqrt(greatest(sum(chars), 1)::DOUBLE) * 1000)::BIGINT AS weight FROM d GROUP BY key),
p AS (SELECT greatest({PERIOD}, 4 * count(*))::BIGINT AS period, count(*) AS n, sum(weight)::BIGINT AS total FROM w),
c0 AS (SELECT key, weight, period, (1 + (period - n) * weight // total)::BIGINT AS share0 FROM w, p),
c AS (SELECT key, period, (share0 + CASE WHEN row_number() OVER (ORDER BY weight DESC, key) <= period - sum(share0) OVER () THEN 1 ELSE 0 END)::BIGINT AS share FROM c0),
s AS (SELECT list(share ORDER BY key) AS cs, list(key ORDER BY key) AS ks, any_value(period) AS period FROM c),
edf(t, had, pick, cs, ks, period) AS (
  SELECT -1::BIGINT, list_transform(cs, lambda x: 0::BIGINT), 0::BIGINT, cs, ks, period FROM s
  UNION ALL
  SELECT t + 1, list_transform(had, lambda h, i: h + CASE WHEN i = pick_now THEN 1 ELSE 0 END), pick_now, cs, ks, period
  FROM (SELECT *, list_min(list_transform(had, lambda h, i: CASE WHEN h * period // cs[i] <= t + 1
                    THEN (((h + 1) * period + cs[i] - 1) // cs[i]) * 1000000 + i END)) % 1000000 AS pick_now
        FROM edf WHERE t + 1 < period)),
turns AS (SELECT ks[pick] AS key, t AS slot, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS turn FROM edf WHERE t >= 0)
SELECT doc_id, source, chars, block, ((block // share) * c.period + turns.slot)::BIGINT AS slot, (block * c.period // share)::BIGINT AS release,
       (((block + 1) * c.period + share - 1) // share)::BIGINT AS deadline, hash
FROM placed JOIN c USING (key) JOIN turns ON turns.key = placed.key AND turns.turn = block % share
"""
