"""Exact duplicates by an exchange of Golomb-coded fingerprints.

1. The normalised text (without x20, x09-x0D) of every row is stored once,
   bucketed by its home: a group of input partitions.
2. Each home sorts the distinct fingerprints of its rows and sends them,
   Golomb-coded in ranges, to the ranges' owners. Fingerprints have 12 bits
   more than the row count needs, so about one row in 4,096 is a suspect in vain.
3. An owner decodes what all homes sent and answers each message with a bitmap
   of the fingerprints that other homes sent too. With its own repeats a home
   then knows the suspects among its rows.
4. Only suspects' texts are shuffled: grouping by the bytes of the text is the
   verification, with copies combined before the shuffle. Distinct texts of one
   SHA-256 would raise an error.
5. Narrow rows of suspects meet the groups. Groups of more than a thousandth of
   all rows (at most 1,000 of them) are broadcast; the others are joined.

Null texts are empty; all empty and blank texts are equal. Of equal texts the
row with the most code points stays, then the smallest doc_id (null last), then
the first read: of repeated rows that tie, exactly one stays. Every row gives
one row, however often its id occurs. An empty table gives an empty result. A
text is normalised whole at any length. Only the id and the text are read, so
extra columns and their names do no harm.
"""

from __future__ import annotations

import struct
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import scratch, stored

BLANKS = " \t\n\x0b\x0c\r"
SPARE_BITS = 12         # fingerprint bits beyond those that number the rows
OWNER_HASHES = 1 << 22  # fingerprints that one owner decodes (expected number)
MESSAGE_HASHES = 1 << 12  # small tables: not more owners than rows / this
HOT_GROUPS = 1000       # groups above 1/1000 of the rows: at most so many

MESSAGES = "home int, owner int, n int, codes binary"
REPLIES = "home int, owner int, bits binary"
MARKS = "home int, splits array<long>, first array<long>, bits array<long>"


def golomb(gaps: np.ndarray) -> bytes:
    """Golomb code of non-negative integers, its parameter a power of two near
    0.69 of their mean. Quotients (unary) and remainders lie one after another."""
    mean = float(gaps.mean()) if len(gaps) else 0.0
    k = max(0, int(np.log2(max(1.0, 0.69 * mean))))
    quotient = (gaps >> np.uint64(k)).astype(np.int64)
    ends = np.cumsum(quotient + 1)
    unary = np.zeros(int(ends[-1]) if len(gaps) else 0, np.uint8)
    unary[ends - 1] = 1
    rest = ((gaps[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    head = np.packbits(unary).tobytes()
    return struct.pack("<BI", k, len(head)) + head + np.packbits(rest).tobytes()


def degolomb(code: bytes, n: int) -> np.ndarray:
    k, size = struct.unpack_from("<BI", code)
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(code, np.uint8, size, 5)))[:n]
    quotient = np.diff(ends, prepend=-1) - 1
    rest = np.unpackbits(np.frombuffer(code, np.uint8, offset=5 + size))[:n * k].reshape(n, k).astype(np.uint64)
    return (quotient.astype(np.uint64) << np.uint64(k)) + (rest << np.arange(k, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def _starts(bits: int, owners: int) -> np.ndarray:
    """The first fingerprint of each owner's range, and the end of the last."""
    return np.array([(o << bits) // owners for o in range(owners + 1)], np.uint64)


def _short(column, bits: int) -> np.ndarray:
    return column.to_numpy().astype(np.int64).view(np.uint64) >> np.uint64(64 - bits)


def _send(bits: int, owners: int):
    def run(table: pa.Table) -> pa.Table:
        home = table["home"][0].as_py()
        values = np.unique(_short(table["fp"], bits))
        starts = _starts(bits, owners)
        cuts = np.searchsorted(values, starts)
        out = []
        for owner in np.flatnonzero(np.diff(cuts)):
            part = values[cuts[owner]:cuts[owner + 1]]
            gaps = np.diff(part, prepend=starts[owner])
            gaps[1:] -= np.uint64(1)
            out.append((home, int(owner), len(part), golomb(gaps)))
        return _table(out, MESSAGES)
    return run


def _answer(bits: int, owners: int):
    def run(table: pa.Table) -> pa.Table:
        counts = table["n"].to_numpy()
        ends = np.cumsum(counts)
        values = np.empty(int(ends[-1]), np.uint64)
        start = _starts(bits, owners)[table["owner"][0].as_py()]
        for code, n, end in zip(table["codes"], counts.tolist(), ends.tolist()):
            gaps = degolomb(code.as_py(), n)
            gaps[1:] += np.uint64(1)
            values[end - n:end] = np.cumsum(gaps) + start
        _, each, times = np.unique(values, return_inverse=True, return_counts=True)
        several = times[each] > 1
        replies = [np.packbits(several[e - n:e]).tobytes() for n, e in zip(counts, ends)]
        return pa.table([table["home"], table["owner"], pa.array(replies, pa.binary())], names=["home", "owner", "bits"])
    return run


def _mark(bits: int, owners: int):
    def run(rows: pa.Table, replies: pa.Table) -> pa.Table:
        if not len(rows):
            return _table([], MARKS)
        values, each, times = np.unique(_short(rows["fp"], bits), return_inverse=True, return_counts=True)
        several = times > 1
        cuts = np.searchsorted(values, _starts(bits, owners))
        for owner, mask in zip(replies["owner"].to_pylist(), replies["bits"].to_pylist()):
            s, e = cuts[owner], cuts[owner + 1]
            several[s:e] |= np.unpackbits(np.frombuffer(mask, np.uint8))[:e - s].astype(bool)
        split, row = rows["split"].to_numpy(), rows["row"].to_numpy()
        splits, at = np.unique(split, return_inverse=True)
        size = np.zeros(len(splits), np.int64)
        np.maximum.at(size, at, row + 1)
        first = np.cumsum(size) - size
        flags = np.zeros(-(-int(size.sum()) // 64) * 64, bool)
        flags[first[at] + row] = several[each]
        words = np.packbits(flags, bitorder="little").view("<i8")
        return _table([(rows["home"][0].as_py(), splits.tolist(), first.tolist(), words)], MARKS)
    return run


_ARROW = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}


def _table(rows: list[tuple], schema: str) -> pa.Table:
    fields = [f.split() for f in schema.split(", ")]
    return pa.table([pa.array([r[i] for r in rows], _ARROW[t]) for i, (_, t) in enumerate(fields)], names=[f for f, _ in fields])


def suspects(rows: DataFrame, bits: int, owners: int) -> DataFrame:
    """MARKS of stored rows (home, split, row, fp): bit first[i] + row of bits
    tells whether a row of splits[i] shares its fingerprint with another row."""
    rows = rows.select("home", "split", "row", "fp")
    messages = stored(rows.groupBy("home").applyInArrow(_send(bits, owners), MESSAGES), "fingerprint-messages")
    replies = messages.groupBy("owner").applyInArrow(_answer(bits, owners), REPLIES)
    return stored(rows.groupBy("home").cogroup(replies.groupBy("home")).applyInArrow(_mark(bits, owners), MARKS), "suspect-marks")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", uid_col: str | None = None) -> DataFrame:
    """uid, doc_id, keep_id, group_size, kept, sha (binary): one row per row of
    ``docs``; ``uid`` numbers the rows as read, unless a column has their numbers."""
    spark = docs.sparkSession
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.length(text).cast("long").alias("n_cp"), F.translate(text, BLANKS, "").alias("norm"),
                       F.monotonically_increasing_id().alias("place"), *([F.col(uid_col).alias("uid")] if uid_col else [])) \
        .withColumns({"sha": F.unhex(F.sha2("norm", 256)), "fp": F.xxhash64("norm"), "split": F.shiftright("place", 33),
                      "row": F.col("place").bitwiseAND((1 << 33) - 1)}) \
        .withColumn("home", F.pmod("split", F.lit(4 * shuffles)).cast("int"))
    rows = rows.drop("place") if uid_col else rows.withColumnRenamed("place", "uid")
    name = f"exact_texts_{uuid.uuid4().hex}"
    # one file a task and bucket: joins and groups by home read it as it lies, without a shuffle of texts
    rows.write.option("path", scratch(spark, "exact-texts")).option("compression", "zstd").bucketBy(shuffles, "home").saveAsTable(name)
    base = spark.table(name)
    n = base.count()
    bits = min(48, max(n, 2).bit_length() + SPARE_BITS)
    owners = max(1, n // OWNER_HASHES, min(shuffles, n // MESSAGE_HASHES))
    marks = suspects(base, bits, owners).hint("shuffle_hash")
    at = F.get("first", F.array_position("splits", F.col("split")).cast("int") - 1) + F.col("row")
    marked = base.join(marks, "home").withColumn("suspect", F.getbit(F.get("bits", F.shiftright(at, 6).cast("int")), at.bitwiseAND(63)) == 1)

    # texts of one fingerprint, byte for byte
    equal = stored(marked.filter("suspect").groupBy("fp", "norm").agg(F.count("*").alias("size")).select(F.unhex(F.sha2("norm", 256)).alias("sha"), "size"), "equal-texts")
    flags = stored(marked.select("uid", "doc_id", "n_cp", "sha", "suspect"), "suspect-flags")
    spark.sql(f"DROP TABLE {name}")  # the catalog's entry; the files stay for reads that a lost executor repeats

    found = flags.filter("suspect").drop("suspect")
    best = F.min(F.struct((-F.col("n_cp")).alias("short"), F.col("doc_id").isNull().alias("none"), "doc_id", "uid"))
    heads = found.groupBy("sha").agg(best.alias("best"), F.count("*").alias("rows"))
    proof = equal.groupBy("sha").agg(F.count("*").alias("texts"), F.sum("size").alias("group_size"))
    sound = (F.col("texts") == 1) & (F.col("rows") == F.col("group_size"))
    heads = stored(heads.join(proof, "sha", "left").select(
        "sha", F.col("best.doc_id").alias("keep_id"), F.col("best.uid").alias("keep_uid"),
        F.when(sound, F.col("group_size")).otherwise(F.raise_error(F.lit("texts of one SHA-256 differ in their bytes")).cast("long")).alias("group_size")), "equal-heads")

    hot = heads.filter(F.col("group_size") * HOT_GROUPS > n).withColumn("hot", F.lit(True))
    near = found.join(F.broadcast(hot), "sha", "left")
    far = near.filter("hot IS NULL").select("uid", "doc_id", "sha").join(heads, "sha")
    out = ["uid", "doc_id", "keep_id", "keep_uid", "group_size", "sha"]
    alone = flags.filter("NOT suspect").select("uid", "doc_id", F.col("doc_id").alias("keep_id"), F.col("uid").alias("keep_uid"), F.lit(1).cast("long").alias("group_size"), "sha")
    return (alone.unionByName(near.filter("hot").select(*out)).unionByName(far.select(*out))
            .withColumn("kept", F.col("uid") == F.col("keep_uid")).drop("keep_uid"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the row of each group that stays: all columns."""
    uid = "_" * (1 + max(len(c) for c in docs.columns)) + "uid"
    base = stored(docs.withColumn(uid, F.monotonically_increasing_id()), "exact-docs")
    kept = groups(base, id_col, text_col, uid).filter("kept").select(F.col("uid").alias(uid))
    return base.join(kept, uid, "left_semi").drop(uid)


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    from .base import table
    return digest(groups(table(spark, sf_dir, "documents")))


SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
g AS (
  SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
