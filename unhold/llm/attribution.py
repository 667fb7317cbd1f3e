"""Token counts of a document's sections by offset-mapped attribution.

A document is encoded once, whole. Each token covers a span of the text (the
vocabulary is byte-level, so its ids' byte lengths add up to the text's), each
section a span between section marks, and tokens are joined to the sections
that their spans meet. A token that crosses a boundary goes to one section by
an explicit rule: ``start`` (the section of its first byte), ``end`` (of its
last byte) or ``most`` (the one with most of its bytes, the earlier of equals).
So the sections' counts add up to the document's.

A section ends after a line feed. A null or empty text has one empty section
with no tokens. Repeated rows are counted each; a null id stays null; an empty
table gives an empty result. Only the id and the text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens, words

RULES = ("start", "end", "most")


def _owners(begin: np.ndarray, end: np.ndarray, cuts: np.ndarray, rule: str) -> np.ndarray:
    """The section of each token [begin, end); section s ends at cuts[s]."""
    first = np.searchsorted(cuts, begin, side="right")
    last = np.searchsorted(cuts, end - 1, side="right")
    if rule == "start":
        return first
    if rule == "end":
        return last
    out = first.copy()
    for i in np.flatnonzero(last > first):
        edges = np.concatenate(([begin[i]], cuts[first[i]:last[i]], [end[i]]))
        out[i] = first[i] + int(np.diff(edges).argmax())
    return out


def attribute(docs: DataFrame, rule: str = "most", id_col: str = "doc_id", text_col: str = "text", vocabulary: str = tokens.VOCABULARY) -> DataFrame:
    """doc_id, section (from 0), start, end (code points, end exclusive),
    n_tokens (attributed), n_crossing (tokens that meet it and another)."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        size = tokens.byte_lengths(vocabulary)
        for batch in batches:
            texts = words.as_texts(batch.column(1))
            for first, part in words.slices(texts):
                data, offs = words.raw(part)
                ids, at = tokens.encode(part, vocabulary)
                end = np.cumsum(size[ids])
                begin = end - size[ids]
                n = len(part)
                # section ends: after each line feed, and at the end of each text
                feeds = np.flatnonzero(data == 10) + 1
                cuts = np.union1d(feeds, offs[1:])
                empty = np.flatnonzero(np.diff(offs) == 0)
                owner = _owners(begin, end, cuts, rule)
                meets = np.stack([np.searchsorted(cuts, begin, side="right"), np.searchsorted(cuts, end - 1, side="right")])
                over = meets[:, meets[1] > meets[0]]
                begins = np.concatenate(([0], cuts[:-1])) if len(cuts) else cuts
                some = cuts > begins
                doc = np.searchsorted(offs, begins[some], side="right") - 1
                count, cross = np.bincount(owner, minlength=len(cuts))[some], _running(over, len(cuts))[some]
                chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))  # code points before each byte
                start, stop = chars[begins[some]] - chars[offs[doc]], chars[cuts[some]] - chars[offs[doc]]
                nth = np.arange(len(doc)) - np.searchsorted(doc, doc)
                zero = np.zeros(len(empty), np.int64)
                cols = [np.concatenate(x) for x in ((doc, empty), (nth, zero), (start, zero), (stop, zero), (count, zero), (cross, zero))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(first + cols[0])), pa.array(cols[1], pa.int32()), *[pa.array(c, pa.int64()) for c in cols[2:]]],
                    ["doc_id", "section", "start", "end", "n_tokens", "n_crossing"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, section int, start long, end long, n_tokens long, n_crossing long")


def _running(over: np.ndarray, n: int) -> np.ndarray:
    """Crossing tokens that meet each section, from their first and last ones."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, over[0], 1)
    np.add.at(change, over[1] + 1, -1)
    return np.cumsum(change)[:n]


def query(spark, sf_dir: str) -> DataFrame:
    from .base import table
    return attribute(table(spark, sf_dir, "documents"))
