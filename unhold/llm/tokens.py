"""Token ids of whole texts by a public byte-level BPE vocabulary.

The reference tokenizer is ``tokenizers`` with ``byte_bpe_50k.json``. A space
that follows a non-space always starts a new pre-token of that vocabulary, so
a text is cut there, each distinct word of a batch is encoded once, and the
words' ids are gathered back with Arrow. Distinct words within Latin ranges
are encoded by ``tiktoken`` over the same ranks (equal ids, tested), all other
words and all texts with runs of white space by ``tokenizers`` itself, in pieces
of bounded size: no pre-token of the vocabulary goes on from a non-space to
white space, from a letter to another kind of character, or from a digit to
another kind, so a text may be cut there. Only a run without any such place is
longer than a piece.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

VOCABULARY = "byte_bpe_50k"
_PLAIN = r"^[\x21-\x7e\x{a1}-\x{24f}]+$"
_RUNS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}] "
_CUT = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=[^\p{L}])|(?<=\p{N})(?=[^\p{N}])")
PIECE_CHARS = 1 << 16  # text that the tokenizer's own objects are held for at a time


@lru_cache(2)
def _encoders(name: str):
    import os
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    import public_tokenizers as P
    import tiktoken
    from tokenizers import Tokenizer
    full = Tokenizer.from_file(P.path(f"{name}.json"))
    full.encode_special_tokens = True
    with open(P.path(f"{name}.tiktoken"), "rb") as fh:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, fh)}
    quick = tiktoken.Encoding(name, pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    size = np.zeros(max(ranks.values()) + 2, np.int64)
    size[list(ranks.values())] = [len(k) for k in ranks]
    return full, quick, size


def byte_lengths(name: str = VOCABULARY) -> np.ndarray:
    """Bytes of text that each id stands for."""
    return _encoders(name)[2]


def _cut(text: str) -> list[str]:
    """The text in pieces of about PIECE_CHARS, cut where pre-tokens end."""
    out, at = [], 0
    while len(text) - at > PIECE_CHARS:
        end = _CUT.search(text, at + PIECE_CHARS)
        if not end or end.start() == len(text):
            break
        out.append(text[at:end.start()])
        at = end.start()
    out.append(text[at:])
    return out


def _whole(texts: list[str], name: str) -> list[np.ndarray]:
    """Ids of each text. The tokenizer's results hold some hundred bytes a token,
    so they are turned into arrays after every PIECE_CHARS of text."""
    full = _encoders(name)[0]
    parts, of = [], []
    batch, size, owners = [], 0, []

    def flush():
        parts.extend(np.array(e.ids, np.uint32) for e in full.encode_batch_fast(batch, add_special_tokens=False))
        of.extend(owners)

    for i, text in enumerate(texts):
        for piece in _cut(text):
            batch.append(piece)
            owners.append(i)
            size += len(piece)
            if size >= PIECE_CHARS:
                flush()
                batch, size, owners = [], 0, []
    flush()
    if len(parts) == len(texts):
        return parts
    bounds = np.searchsorted(of, np.arange(len(texts) + 1))
    return [np.concatenate(parts[s:e]) for s, e in zip(bounds[:-1], bounds[1:])]


def _plain_ids(plain: pa.Array, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words with a space before each, one after another, and how many
    each word has."""
    if not len(plain):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    _, quick, size = _encoders(name)
    ids = np.array(quick.encode_ordinary(" " + " ".join(plain.to_pylist())), np.uint32)
    ends = np.cumsum(pc.binary_length(plain).to_numpy() + 1)
    return ids, np.diff(np.searchsorted(np.cumsum(size[ids]), ends, side="left") + 1, prepend=0)


def encode(texts: pa.Array, name: str = VOCABULARY) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, offsets of each text in them) of a large_string array."""
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint32), np.zeros(1, np.int64)
    odd = pc.match_substring_regex(texts, _RUNS).to_numpy(zero_copy_only=False)
    split = pc.split_pattern(pc.if_else(pa.array(odd), "", texts), " ")
    at = split.offsets.to_numpy() - split.offsets[0].as_py()
    coded = split.flatten().dictionary_encode()
    known = coded.dictionary
    # entries of the pool of ids: the distinct words, plain ones first, then first words and whole texts
    plain = pc.match_substring_regex(known, _PLAIN).to_numpy(zero_copy_only=False)
    order = np.concatenate((np.flatnonzero(plain), np.flatnonzero(~plain)))
    n_plain = int(plain.sum())
    entry = np.empty(len(known), np.int64)
    entry[order] = np.arange(len(known))
    pool, lens = _plain_ids(known.take(pa.array(order[:n_plain])), name)
    parts = _whole([" " + w for w in known.take(pa.array(order[n_plain:])).to_pylist()], name) if n_plain < len(known) else []
    flat = coded.indices.to_numpy().astype(np.int64)
    full = entry[flat]
    # the first word of a text has no space before it; it is encoded by itself
    own = np.flatnonzero(~odd)
    heads, which = np.unique(flat[at[own]], return_inverse=True)
    full[at[own]] = n_plain + len(parts) + which
    if len(heads):
        parts += _whole(known.take(pa.array(heads)).to_pylist(), name)
    whole = np.flatnonzero(odd)
    full[at[whole]] = n_plain + len(parts) + np.arange(len(whole))
    if len(whole):
        parts += _whole(texts.take(pa.array(whole)).to_pylist(), name)
    lens = np.concatenate((lens, np.array([len(x) for x in parts], np.int64)))
    bounds = np.concatenate(([0], np.cumsum(lens)))
    lists = pa.LargeListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate([pool, *parts])))
    ids = lists.take(pa.array(full)).flatten().to_numpy()
    ends = np.concatenate(([0], np.cumsum(lens[full])))
    return ids, ends[at]
