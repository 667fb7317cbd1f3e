"""Vectors as Spark rows, for both searches: usable rows, distinct vectors
with their smallest ids, and blocks of lists that bound a task's work."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def usable(rows: DataFrame, id_col: str, vector_col: str, nonzero: bool, floats: bool = False) -> DataFrame:
    """(id, v) of rows whose vector has finite components only; the others take no
    part. ``floats`` stay half as wide as doubles."""
    v = F.col(vector_col)
    if not floats or rows.schema[vector_col].dataType.simpleString() != "array<float>":
        v = v.cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter(F.col("v").isNotNull() & ~bad & F.col("id").isNotNull())
    return rows.filter(F.exists("v", lambda x: x != 0)) if nonzero else rows


def distinct(rows: DataFrame, keep: int) -> DataFrame:
    """(key, v, ids): each distinct vector with its ``keep`` smallest ids, in
    order; equal vectors tie at every query, so no others can be among the
    nearest. The ranking keeps at most ``keep`` rows of a key on each mapper."""
    keyed = rows.withColumn("key", F.xxhash64("v"))
    first = keyed.withColumn("nth", F.row_number().over(Window.partitionBy("key", "v").orderBy("id"))).filter(F.col("nth") <= keep)
    return first.groupBy("key", "v").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def matrix(column, width: int | None = None) -> np.ndarray:
    """A column of lists as rows of doubles; a shorter vector is padded with zeros."""
    rows = [np.asarray(x, np.float64) for x in column]
    width = width or max((len(x) for x in rows), default=0)
    out = np.zeros((len(rows), width))
    for i, x in enumerate(rows):
        out[i, :min(len(x), width)] = x[:width]
    return out


def flat(column, width: int) -> np.ndarray:
    """As ``matrix``, of an Arrow column of lists; a longer vector is cut."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (sizes == width).all():
        return values.reshape(-1, width)
    out, row = np.zeros((len(sizes), width)), np.repeat(np.arange(len(sizes)), sizes)
    nth = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row[nth < width], nth[nth < width]] = values[nth < width]
    return out


def in_blocks(lists: DataFrame, asked: DataFrame, at: str, list_rows: int, asked_rows: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides dealt so that rows of one list meet in blocks of bounded size:
    a list's rows go to ``ceil(rows / list_rows)`` parts, its queries likewise,
    and every part meets every part of the other side."""
    parts = (lists.groupBy(at).agg(F.ceil(F.count("*") / list_rows).cast("int").alias("lp"))
             .join(asked.groupBy(at).agg(F.ceil(F.count("*") / asked_rows).cast("int").alias("qp")), at))
    deal = lambda df, own, other, a, b: (
        df.join(parts, at).withColumn(a, F.pmod(F.xxhash64("key"), F.col(own)).cast("int"))
        .withColumn(b, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop("lp", "qp"))
    return deal(lists, "lp", "qp", "l", "q"), deal(asked, "qp", "lp", "q", "l"), [at, "l", "q"]


def expand(queries: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) from the best vectors of each distinct
    query (key, v): hits are (key, ids, score), one row per vector."""
    each = hits.select("key", "score", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")
    best = each.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k + 1).drop("nth")
    own = (queries.select(F.col("id").alias("query_id"), "key").join(best, "key").filter("vec_id != query_id")
           .withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= k))
    return own.select("query_id", "rank", "vec_id", "score")
