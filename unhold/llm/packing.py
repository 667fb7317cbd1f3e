"""Best-fit packing of tokenised documents by swap-based local search.

Documents are tokenised whole, an end id is added, and only documents longer
than a sequence are cut (full pieces, the first may be shorter). Shards of
bounded size are windows of the input order: files by name, their splits, their
rows, in whatever order Spark's tasks read them. In a shard, pieces are placed
best-fit in decreasing order, then underfull sequences exchange one piece for
one, two for one, or move one or two, until no exchange raises the sum of squared
fills. The pieces of all badly filled sequences are dealt anew by hash, into
shards of the same size, and packed again while that saves sequences.

Long texts: ids are made in pieces of bounded size, but a text's ids are held at
once (some ten bytes for each byte of text). Nulls: a null text is empty and packs as its end id; a null doc_id stays null.
Repeated rows are packed each. An empty table gives an empty result. Columns
other than the id and the text are not read, so clashing names do no harm.
"""

from __future__ import annotations

from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens, words
from .base import stored

LENGTH, END_ID = 2048, 0
SHARD_PIECES = 16384
BADLY_FILLED = 64  # sequences with more than 1/64 of their length free are packed again
LEAST_GAIN = 256   # as long as that saves more than 1/256 of them

PIECES = "doc_id {id}, piece int, start long, length long, file string, split long, ids binary"
PLACED = "uid long, length long, at long, sequence_id long, offset long, open boolean"


def pieces(docs: DataFrame, length: int = LENGTH, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text",
           vocabulary: str = tokens.VOCABULARY) -> DataFrame:
    """One row per piece: ids are little-endian unsigned 32-bit integers. ``file``
    and ``split`` say where the row was read (empty, -1: not from a file)."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                       F.input_file_name().alias("file"), F.input_file_block_start().alias("split"))

    def run(batches):
        for batch in batches:
            ids_of, texts, file, split = batch.column(0), words.as_texts(batch.column(1)), batch.column(2), batch.column(3)
            for first, part in words.slices(texts):
                ids, ends = tokens.encode(part, vocabulary)
                sizes = np.diff(ends) + 1
                count = -(-sizes // length)
                doc = np.repeat(np.arange(len(sizes)), count)
                nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                head = (sizes - 1) % length + 1  # tokens of the first piece
                start = np.where(nth == 0, 0, head[doc] + (nth - 1) * length)
                size = np.where(nth == 0, head[doc], length)
                all_ids = np.insert(ids, ends[1:], end_id).astype("<u4")
                began = (np.cumsum(sizes) - sizes)[doc] + start
                # pieces lie one after another in all_ids
                offs = np.append(began, began[-1] + size[-1]) * 4
                blob = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(all_ids)])
                row = pa.array(first + doc)
                yield pa.RecordBatch.from_arrays([ids_of.take(row), pa.array(nth, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()),
                                                  file.take(row), split.take(row), blob.cast(pa.binary())],
                                                 ["doc_id", "piece", "start", "length", "file", "split", "ids"])

    return docs.mapInArrow(run, PIECES.format(id=docs.schema["doc_id"].dataType.simpleString()))


def local_search(sizes: np.ndarray, length: int, passes: int | None = None) -> np.ndarray:
    """The bin of each piece: best fit in decreasing order, then exchanges until
    none raises the sum of squared fills (``passes``: so many times over the bins)."""
    n = len(sizes)
    where = np.empty(n, np.int64)
    inside: list[dict[int, list[int]]] = []  # pieces of each bin by size
    room: list[int] = []
    by_gap: list[list[int]] = [[] for _ in range(length + 1)]  # open bins by free room
    has = 0  # bit g is set while by_gap[g] is not empty
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        fits = has >> s
        if fits:
            g = s + (fits & -fits).bit_length() - 1
            b = by_gap[g].pop()
            if not by_gap[g]:
                has &= ~(1 << g)
        else:
            b, g = len(room), length
            room.append(length)
            inside.append({})
        room[b] = g - s
        inside[b].setdefault(s, []).append(i)
        if room[b]:
            by_gap[room[b]].append(b)
            has |= 1 << room[b]
    turn = 0
    while turn != passes and _improve(room, inside, length):
        turn += 1
    kept = [b for b in range(len(room)) if inside[b]]
    for k, b in enumerate(kept):
        for own in inside[b].values():
            where[own] = k
    return where


class _Donors:
    """Underfull bins by the size of each piece, or of each two pieces, that they
    can give; the emptiest bin of a size comes first. Entries of a bin that has
    changed since are passed over."""

    def __init__(self, length: int):
        self.heaps: list[list[int]] = [[] for _ in range(2 * length + 1)]
        self.known = 0  # bit s is set while heap s may hold a bin

    def add(self, size: int, entry: int) -> None:
        heappush(self.heaps[size], entry)
        self.known |= 1 << size

    def best(self, above: int, most: int, taken: int, version: list[int]) -> tuple[int, int] | None:
        """(size, bin) of the largest size with above < size <= most that an
        exchange can take: the giving bin is less full than the taking one,
        ``taken`` + size, then is."""
        known = self.known & ((1 << (most + 1)) - 1)
        while True:
            size = known.bit_length() - 1
            if size <= above:
                return None
            heap = self.heaps[size]
            while heap:
                b, v = heap[0] >> 32 & 0xFFFFFF, heap[0] & 0xFFFFFFFF
                if version[b] == v:
                    break
                heappop(heap)
            else:
                self.known &= ~(1 << size)
            if heap and heap[0] >> 56 < taken + size:
                return size, b
            known &= ~(1 << size)


def _improve(room: list[int], inside: list[dict[int, list[int]]], length: int) -> bool:
    """One pass over all underfull bins, the fullest first. Each takes pieces of
    others by the exchange that fills it most - a piece or two moved, one for
    one, two for one - until none raises the sum of squares, then rests until it
    has given something itself.

    With d more in the taking bin and d less in the giving one, the sum of squares
    rises if the giving bin was less than d fuller. So passes come to an end."""
    one, two = _Donors(length), _Donors(length)
    version = [0] * len(room)
    order: list[int] = []  # heap of underfull bins, the fullest first

    def offer(b: int, rests: bool = False) -> None:
        version[b] += 1
        if not inside[b] or not room[b]:
            return
        entry = (length - room[b]) << 56 | b << 32 | version[b]
        sizes = sorted(inside[b])
        for x, s in enumerate(sizes):
            one.add(s, entry)
            if len(inside[b][s]) > 1:
                two.add(2 * s, entry)
            for s2 in sizes[x + 1:]:
                two.add(s + s2, entry)
        if not rests:
            heappush(order, room[b] << 56 | b << 32 | version[b])

    for b in range(len(room)):
        offer(b)
    changed = False
    while order:
        entry = heappop(order)
        a = entry >> 32 & 0xFFFFFF
        if version[a] != entry & 0xFFFFFFFF:
            continue
        version[a] += 1  # out of the donors while it takes
        while room[a]:
            gap, best = room[a], None
            for o in (0, *inside[a]):
                for kind, donors in ((0, one), (1, two)):
                    hit = donors.best(o + (best[0] if best else 0), o + gap, length - gap - o, version)
                    if hit:
                        best = (hit[0] - o, o, kind, hit[0], hit[1])
                if best and best[0] == gap:
                    break
            if not best:
                break
            d, o, kind, size, b = best
            if kind:
                first = next(s for s in inside[b] if size - s in inside[b] and (size != 2 * s or len(inside[b][s]) > 1))
                given = (first, size - first)
            else:
                given = (size,)
            _shift(inside[b], inside[a], given)
            if o:
                _shift(inside[a], inside[b], (o,))
            room[a] -= d
            room[b] += d
            offer(b)
            changed = True
        offer(a, rests=True)
    return changed


def _shift(source: dict[int, list[int]], target: dict[int, list[int]], sizes: tuple[int, ...]) -> None:
    for s in sizes:
        target.setdefault(s, []).append(source[s].pop())
        if not source[s]:
            del source[s]


def _pack_shard(length: int):
    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "at"], ascending=[False, True], kind="stable").reset_index(drop=True)
        sizes, at = frame["length"].to_numpy(), frame["at"].to_numpy()
        where = local_search(sizes, length)
        order = np.argsort(where, kind="stable")
        first = np.searchsorted(where[order], np.arange(where.max() + 1))
        ends = np.cumsum(sizes[order])
        starts = ends - sizes[order]
        offset = np.empty(len(sizes), np.int64)
        offset[order] = starts - starts[first][where[order]]
        fill = np.add.reduceat(sizes[order], first)
        named = np.minimum.reduceat(at[order], first)  # a sequence is named by its first piece in input order
        bad = (length - fill) * BADLY_FILLED > length
        return pd.DataFrame({"uid": frame["uid"], "length": sizes, "at": at, "sequence_id": named[where], "offset": offset, "open": bad[where]})
    return run


def _windows(sized: DataFrame, shard_pieces: int) -> DataFrame:
    """``sized`` with each row's place in the input (from 0) and the window of
    ``shard_pieces`` rows that it falls in. A task's rows of one split of a file
    follow one another, so a place is the split's first place and the row's
    distance in uid from the split's first row."""
    where = ["file", "split", "part"]
    sized = sized.withColumn("part", F.shiftright("uid", 33))
    # one row for each split of a file
    parts = sized.groupBy(*where).agg(F.count("*").alias("n"), F.min("uid").alias("least"))
    by_name = Window.orderBy(F.length("file"), *where)  # part-99999 before part-100000
    before = F.sum("n").over(by_name.rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(*where, "least", F.coalesce(before, F.lit(0)).alias("before"))
    return (sized.join(parts, where).withColumn("at", F.col("before") + F.col("uid") - F.col("least"))
            .select("uid", "length", "at", F.floor(F.col("at") / shard_pieces).alias("shard")))


def place(sized: DataFrame, length: int = LENGTH, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """(uid, sequence_id, offset) of rows (uid, length, file, split) with 0 < length <=
    ``length`` and uid as monotonically_increasing_id() gives it to the rows as they
    are read; rows without file and split are in order of uid. A sequence is named
    by the place in the input of its first piece, so that sequences in order of
    their ids follow the input, window by window."""
    if "file" not in sized.columns:
        sized = sized.withColumns({"file": F.lit(""), "split": F.lit(-1).cast("long")})
    dealt, turn = _windows(sized, shard_pieces), 0
    done = kept = None
    while True:
        placed = stored(dealt.groupBy("shard").applyInPandas(_pack_shard(length), PLACED), f"packing-{turn}")
        bins, shards, left, bad = placed.agg(F.count_distinct("sequence_id"), F.ceil(F.count("*") / shard_pieces), F.count_if("open"),
                                             F.count_distinct(F.when(F.col("open"), F.col("sequence_id")))).first()
        if turn and bins >= before:  # badly filled sequences packed anew became no fewer: they stay as they were
            return done.unionByName(kept)
        closed, kept = (placed.filter(F.col("open") == o).select("uid", "sequence_id", "offset") for o in (False, True))
        done = done.unionByName(closed) if turn else closed
        if shards <= 1 or bad < 2 or (turn and (before - bins) * LEAST_GAIN < before):
            return done.unionByName(kept)
        before, turn = bad, turn + 1
        dealt = placed.filter("open").select("uid", "length", "at", F.pmod(F.xxhash64("uid", F.lit(turn)), F.lit(-(-left // shard_pieces))).alias("shard"))


def pack(docs: DataFrame, length: int = LENGTH, **options) -> DataFrame:
    """Pieces with their ids, sequence and place: doc_id, piece, start, length,
    ids, sequence_id, offset."""
    cut = stored(pieces(docs, length, **options).withColumn("uid", F.monotonically_increasing_id()), "pieces", "zstd")
    return cut.join(place(cut.select("uid", "length", "file", "split"), length), "uid").drop("uid", "file", "split")


def query(spark, sf_dir: str) -> DataFrame:
    from .base import table
    return digest(pack(table(spark, sf_dir, "documents")))


def digest(packed: DataFrame) -> DataFrame:
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
