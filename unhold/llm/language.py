"""Language of whole texts, with the spans of mixed-language ones.

Learning (Spark, all labelled rows): byte trigrams of every word are hashed
into a fixed table of log probabilities per language, and each script's share
per language is counted. Labelling: a word's script narrows the candidate
languages, its trigrams score them, and Viterbi over the words of a text with
a penalty for each switch labels spans. The text's language is that of most
bytes; its score is their share.

Results: ``und`` with score 0 and no span for a null text or one without a
letter. Repeated rows are labelled each; a null id stays null. With nothing to
learn from, every text is ``und``. Ties go to the label that comes first by name.
All labels are learned, however many. A text of any length is labelled whole: a
long one in sections, with the state of the search carried on. An empty table
gives an empty result. Columns other than those named are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words
from .base import stored

TABLE = 1 << 15  # hashed trigrams; the model has TABLE x languages numbers
SWITCH = 12.0  # log-probability cost of a change of language between words
SCRIPT_SHARE = 0.002
SCORED = 1 << 24  # numbers (bytes x languages) that are gathered at a time
_BARRED = -60.0

# The first code point of each Unicode block range and its script.
_RANGES = [
    (0x0000, "latin"), (0x0250, "other"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0700, "syriac"), (0x0750, "arabic"), (0x0780, "thaana"), (0x07C0, "nko"), (0x0800, "other"),
    (0x0860, "syriac"), (0x08A0, "arabic"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"),
    (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"),
    (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "cherokee"), (0x1400, "canadian"), (0x1680, "other"), (0x1780, "khmer"),
    (0x1800, "mongolian"), (0x18B0, "other"), (0x1C90, "georgian"), (0x1CC0, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "coptic"), (0x2D00, "georgian"), (0x2D30, "tifinagh"), (0x2D80, "ethiopic"),
    (0x2DE0, "cyrillic"), (0x2E00, "other"), (0x2E80, "han"), (0x3000, "other"), (0x3040, "hiragana"), (0x30A0, "katakana"),
    (0x3100, "bopomofo"), (0x3130, "hangul"), (0x3190, "other"), (0x31F0, "katakana"), (0x3200, "other"), (0x3400, "han"),
    (0xA000, "yi"), (0xA4D0, "other"), (0xA640, "cyrillic"), (0xA6A0, "other"), (0xA720, "latin"), (0xA800, "other"),
    (0xA8E0, "devanagari"), (0xA900, "other"), (0xA960, "hangul"), (0xA980, "other"), (0xAB30, "latin"), (0xAB70, "cherokee"),
    (0xABC0, "other"), (0xAC00, "hangul"), (0xD800, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB13, "armenian"),
    (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"), (0xFE70, "arabic"), (0xFF00, "latin"), (0xFF66, "katakana"),
    (0xFFA0, "hangul"), (0xFFE0, "other"), (0x1B000, "hiragana"), (0x1B170, "other"), (0x20000, "han"), (0x323B0, "other")]
_FIRST = np.array([r for r, _ in _RANGES])
_NAMES = sorted({n for _, n in _RANGES})
_OF_RANGE = np.array([_NAMES.index(n) for _, n in _RANGES])
SCRIPTS = len(_NAMES)


def _scripts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The script of the code point at each place of UTF-8 data."""
    padded = np.concatenate((data, np.zeros(3, np.uint8)))
    b = [padded[starts + k].astype(np.int64) for k in range(4)]
    tail = [x & 0x3F for x in b]
    point = np.select([b[0] < 0x80, b[0] < 0xE0, b[0] < 0xF0],
                      [b[0], (b[0] & 0x1F) << 6 | tail[1], (b[0] & 0x0F) << 12 | tail[1] << 6 | tail[2]],
                      (b[0] & 0x07) << 18 | tail[1] << 12 | tail[2] << 6 | tail[3])
    return _OF_RANGE[np.searchsorted(_FIRST, point, side="right") - 1]


_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _trigrams(texts: pa.Array):
    """Bytes' table index, word starts and lengths, script and text of words."""
    data, offs = words.raw(texts)
    keep = _LETTER[data]
    starts, ends = words.segments(keep, offs)
    low = words.LOWER[data].astype(np.int64)
    low[~keep] = 32
    before, after = np.empty_like(low), np.empty_like(low)
    before[:1], before[1:] = 32, low[:-1]
    after[-1:], after[:-1] = 32, low[1:]
    before[starts], after[ends - 1] = 32, 32
    code = (before << 16 | low << 8 | after) * 0x9E3779B1 & 0xFFFFFFFF
    return code >> 17, keep, starts, ends, _scripts(data, starts), np.searchsorted(offs, starts, side="right") - 1


def _counts(batches):
    """(label, cell, n) of a partition; cells above TABLE are scripts."""
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        labels, texts = batch.column(0).to_numpy(zero_copy_only=False), words.as_texts(batch.column(1))
        for first, part in words.slices(texts):
            cell, keep, starts, ends, script, doc = _trigrams(part)
            if not len(starts):
                continue
            names, of_doc = np.unique(labels[first:first + len(part)].astype(str), return_inverse=True)
            of_word = of_doc[doc]
            of_byte = np.repeat(of_word, ends - starts)
            for k, name in enumerate(names):
                row = total.setdefault(name, np.zeros(TABLE + SCRIPTS, np.int64))
                row[:TABLE] += np.bincount(cell[keep][of_byte == k], minlength=TABLE)
                row[TABLE:] += np.bincount(script[of_word == k], minlength=SCRIPTS)
    for name, row in total.items():
        at = np.flatnonzero(row)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(row[at])], ["lang", "cell", "n"])


def learn(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text") -> dict:
    """A model of languages x (TABLE + SCRIPTS) numbers from all rows with a label:
    128 KB for each distinct label that has a word, however many rows there are."""
    rows = labelled.filter(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    counted = stored(rows.mapInArrow(_counts, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")), "trigram-counts")
    names = sorted(r["lang"] for r in counted.filter(F.col("cell") >= TABLE).select("lang").distinct().collect())
    table = np.zeros((len(names), TABLE + SCRIPTS), np.float32)
    for at in range(0, len(names), 64):  # some labels at a time, so that rows held besides the table are few
        some = names[at:at + 64]
        got = counted.filter(F.col("lang").isin(some)).toPandas()
        table[pd.Index(names).get_indexer(got["lang"]), got["cell"]] = got["n"]
    grams, scripts = table[:, :TABLE] + np.float32(0.05), table[:, TABLE:]
    logs = np.log(grams / grams.sum(1, keepdims=True, dtype=np.float64)) if names else grams
    allowed = scripts >= np.maximum(1, SCRIPT_SHARE * scripts.sum(1, keepdims=True))
    allowed |= ~allowed.any(0)  # a script that no language uses leaves all of them
    return {"names": names, "logs": np.ascontiguousarray(logs.T, np.float32), "barred": np.where(allowed, 0.0, _BARRED).T.astype(np.float32)}


def viterbi(scores: np.ndarray, doc: np.ndarray, n_docs: int, switch: float = SWITCH) -> np.ndarray:
    """The label of each word: the best path through each text's words. All
    texts advance one word at a time; longer ones come first, so that those
    still going on are a prefix."""
    n, k = scores.shape
    begin = np.searchsorted(doc, np.arange(n_docs + 1))
    count = np.diff(begin)
    order = np.argsort(-count, kind="stable")
    begin, count = begin[:-1][order], count[order]
    going = np.searchsorted(-count, -np.arange(count[0] if n_docs else 0), side="left")
    label = np.zeros(n, np.int64)
    if k == 1 or not n:
        return label
    from_best = np.zeros((n, k), bool)  # the path to (word, label) comes from the best label before it
    best_of = np.zeros(n, np.int64)
    value = np.zeros((n_docs, k), np.float32)
    last = np.zeros(n_docs, np.int64)
    for t, m in enumerate(going):
        at = begin[:m] + t
        v = value[:m]
        if t:
            top = v.argmax(1)
            jump = (v[np.arange(m), top] - switch)[:, None]
            best_of[at] = top
            from_best[at] = jump > v
            v = np.maximum(v, jump)
        value[:m] = v + scores[at]
    last[:] = value.argmax(1)
    for t in range(len(going) - 1, -1, -1):
        m = going[t]
        at = begin[:m] + t
        now = last[:m]
        label[at] = now
        last[:m] = np.where(from_best[at, now], best_of[at], now)
    return label


def _scores(model: dict, cell, keep, starts, ends, script) -> np.ndarray:
    """(words x languages) scores; bytes x languages are gathered in blocks."""
    out = np.empty((len(starts), model["logs"].shape[1]), np.float32)
    step = max(1, SCORED // out.shape[1])
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + step, side="right")))
        s, e = starts[i], ends[j - 1]
        if j == i + 1 and e - s > step:  # one word longer than a block
            out[i] = sum(model["logs"][cell[k:min(k + step, e)]].sum(0) for k in range(s, e, step))
        else:
            each = model["logs"][cell[s:e]]
            each[~keep[s:e]] = 0
            out[i:j] = np.add.reduceat(each, starts[i:j] - s, axis=0)
        i = j
    return out + model["barred"][script]


def _label(model: dict, part: pa.Array):
    """(label per word, bytes and text of words) of a slice."""
    cell, keep, starts, ends, script, doc = _trigrams(part)
    if not len(starts) or not model["names"]:
        return np.zeros(0, np.int64), starts[:0], doc[:0]
    return viterbi(_scores(model, cell, keep, starts, ends, script), doc, len(part)), ends - starts, doc


def _sections(text: pa.Array, limit: int):
    """One long text as consecutive texts of about ``limit`` bytes, cut before a
    byte that is no letter."""
    data, _ = words.raw(text)
    at = 0
    while at < len(data):
        end = min(len(data), at + limit)
        while end < len(data):
            stop = np.flatnonzero(~_LETTER[data[end:end + limit]])
            if len(stop):
                end += int(stop[0])
                break
            end = min(len(data), end + limit)
        yield pa.LargeStringArray.from_buffers(1, pa.py_buffer(np.array([0, end - at])), pa.py_buffer(np.ascontiguousarray(data[at:end])))
        at = end


def _label_long(model: dict, text: pa.Array, limit: int):
    """``_label`` of one long text: the same path, with the scores of one section
    held at a time and one bit a word and language for the way back."""
    k = len(model["names"])
    value, ways, bests, sizes = None, [], [], []
    for section in _sections(text, limit):
        cell, keep, starts, ends, script, _ = _trigrams(section)
        if not len(starts):
            continue
        scores = _scores(model, cell, keep, starts, ends, script)
        way, best = np.zeros((len(starts), k), bool), np.zeros(len(starts), np.int32)
        for i in range(len(starts)):
            if value is None:
                value = scores[i].copy()
                continue
            best[i] = value.argmax()
            jump = value[best[i]] - np.float32(SWITCH)
            way[i] = jump > value
            value = np.maximum(value, jump) + scores[i]
        ways.append(np.packbits(way, axis=1))
        bests.append(best)
        sizes.append(ends - starts)
    if value is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    best, size = np.concatenate(bests), np.concatenate(sizes)
    lab, now, n = np.zeros(len(best), np.int64), int(value.argmax()), len(best)
    for way, first in zip(reversed(ways), reversed(np.cumsum([0, *map(len, ways)])[:-1].tolist())):
        for i in range(len(way) - 1, -1, -1):
            lab[first + i] = now
            if way[i, now >> 3] >> (7 - (now & 7)) & 1:
                now = int(best[first + i])
    return lab, size, np.zeros(n, np.int64)


def label(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, kept columns, lang_pred, score, spans (lang, first and end word)."""
    keep = keep or {}
    names = np.array([*model["names"], "und"], dtype=object)
    rows = docs.select(F.col(id_col).alias("doc_id"), *[c.alias(k) for k, c in keep.items()],
                       F.when(F.col(text_col).rlike(r"\p{L}"), F.col(text_col)).alias("text"))
    limit = max(1 << 16, words.SLICE_BYTES * 4 // max(4, len(names)))

    def run(batches):
        for batch in batches:
            texts = words.as_texts(batch.column(batch.num_columns - 1))
            n = len(texts)
            longest = np.argsort(-np.diff(words.raw(texts)[1]), kind="stable")
            pred, score = np.full(n, "und", object), np.zeros(n)
            spans: list = [[] for _ in range(n)]
            for first, part in words.slices(texts.take(pa.array(longest)), limit):
                long = len(part) == 1 and len(model["names"]) and words.raw(part)[1][-1] > limit
                lab, length, doc = _label_long(model, part, limit) if long else _label(model, part)
                if not len(lab):
                    continue
                m, k = len(part), len(model["names"])
                size = np.bincount(doc * k + lab, weights=length, minlength=m * k).reshape(m, k)
                rows_ = longest[first:first + m]
                some = size.sum(1) > 0
                pred[rows_[some]] = names[size[some].argmax(1)]
                score[rows_[some]] = size[some].max(1) / size[some].sum(1)
                new = np.ones(len(lab), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (lab[1:] != lab[:-1])
                at = np.flatnonzero(new)
                word0 = np.searchsorted(doc, np.arange(m))
                for d, l, s, e in zip(doc[at].tolist(), lab[at].tolist(), at.tolist(), [*at[1:].tolist(), len(lab)]):
                    spans[rows_[d]].append({"lang": names[l], "start": s - int(word0[d]), "end": e - int(word0[d])})
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(pred, pa.string()), pa.array(score), pa.array(spans, pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))],
                [*batch.schema.names[:-1], "lang_pred", "score", "spans"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{fields}, lang_pred string, score double, spans array<struct<lang:string,start:int,end:int>>")


def fold(id_col: str, parts: int) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % parts


def query(spark, sf_dir: str) -> DataFrame:
    from .base import table
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(fold("doc_id", 3) == 1, F.lit(False))
    model = learn(docs.filter(~held_out))
    return label(docs, model, keep={"held_out": held_out})
