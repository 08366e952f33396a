"""Periodic runs of words: online sparse diagonal DP over earlier occurrences.

A lag q is a diagonal: it lives while successive words equal the words q before
them, and its match length grows by one per word. A run of period q needs at
least 3q matches in a row. A diagonal is therefore advanced by *grams* instead
of single words: lags from 2^t to 2^(t+1) - 1 are advanced by the grams of 3 * 2^t
words that end at each word. The earlier occurrence that counts is the nearest
one: inside a run of smallest period q it lies exactly q before (rotations of a
primitive period are distinct), and a lag with a nearer occurrence has a smaller
period. So each word advances at most one diagonal per tier, a text of n words
costs O(n log n) whatever its word frequencies, and a diagonal that ends with
sufficient length is a run at once, with its smallest period.

Tasks handle Arrow batches in slices of about ``SLICE_BYTES`` (a longer text is a
slice of its own): words are dictionary codes, grams are ranks of pairs of
shorter grams (exact, no hashing); grams that occur once are left out of all
longer tiers, so ordinary prose ends after two or three of them.

Defined cases: a null or blank text has no word, no run, and the hashes of the
empty string; a null id keeps its row and its words unchanged; repeated rows are
judged one by one; an empty table gives an empty result; texts are read whole at
any length; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

MIN_LENGTH = 6        # words of a run at least
MIN_EXPONENT = 4      # its length is at least so many periods
SLICE_BYTES = 4 << 20

SCHEMA = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
          "runs_sha256 string, collapsed_sha256 string, runs array<struct<start:long,length:long,period:long>>, collapsed binary")

_GAP = np.zeros(256, bool)
_GAP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def planted(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """(a, p): words from a on repeat with period p; only for ids whose crc32 is divisible by 10."""
    if doc_id is None or n == 0:
        return None
    g, rest = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if rest:
        return None
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def _words(data: np.ndarray, starts: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Dictionary-coded words of texts laid end to end, and the number of the first word of each text.

    ``starts``: byte offsets of the texts and the end. Words end at white space and at text ends."""
    gap = _GAP[data]
    first = ~gap
    first[1:] &= gap[:-1]
    edge = starts[:-1][starts[:-1] < len(data)]
    first[edge] = ~gap[edge]
    at = np.flatnonzero(first)
    kept = np.concatenate([[0], np.cumsum(~gap)])          # bytes of words before each byte
    offsets = np.concatenate([kept[at], kept[-1:]]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data[~gap])])
    return words.dictionary_encode(), np.searchsorted(at, starts)


def _ranks(values: np.ndarray, where: np.ndarray, n: int) -> np.ndarray:
    """Dense ranks of ``values`` (which belong to the positions ``where``); -1 elsewhere and for values that occur once."""
    out = np.full(n, -1, np.int64)
    _, rank, count = np.unique(values, return_inverse=True, return_counts=True)
    again = count[rank] > 1
    out[where[again]] = rank[again]
    return out


def _pairs(left: np.ndarray, right: np.ndarray, shift: int) -> np.ndarray:
    """Ranks of the grams (gram ending ``shift`` words before, gram ending here)."""
    n = len(right)
    where = np.flatnonzero((right[shift:] >= 0) & (left[:n - shift] >= 0)) + shift
    return _ranks(left[where - shift] * n + right[where], where, n)


def _matches(grams: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, lag) where the nearest earlier occurrence of a gram lies ``low`` to 2 * ``low`` - 1 words before."""
    where = np.flatnonzero(grams >= 0)
    where = where[np.argsort(grams[where], kind="stable")]
    lag = np.diff(where)
    hit = (np.diff(grams[where]) == 0) & (lag >= low) & (lag < 2 * low)
    at, lag = where[1:][hit], lag[hit]
    order = np.argsort(at)
    return at[order], lag[order]


def diagonals(matches: Iterator[tuple[int, int]], span: int) -> Iterator[tuple[int, int, int]]:
    """Online step: (start, length, lag) of each diagonal that ended with sufficient length.

    ``matches`` are (position, lag) in order of position, at most one per position: the ``span`` words that end there
    equal those ``lag`` before. A match lengthens the active diagonal of its lag; any other ends it."""
    begin = last = lag = -1
    for at, q in matches:
        if at == last + 1 and q == lag:
            last = at
            continue
        if lag > 0 and (length := last - begin + span + lag) >= max(MIN_LENGTH, MIN_EXPONENT * lag):
            yield last + 1 - length, length, lag
        begin, last, lag = at, at, q
    if lag > 0 and (length := last - begin + span + lag) >= max(MIN_LENGTH, MIN_EXPONENT * lag):
        yield last + 1 - length, length, lag


def find_runs(codes: np.ndarray, text_of: np.ndarray, longest: int) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of texts laid end to end; no run crosses a text's edge.

    ``codes`` name the words, ``text_of`` the text of each word, ``longest`` is the longest text's number of words."""
    n = len(codes)
    if n == 0:
        return []
    grams = _ranks(text_of * (int(codes.max()) + 1) + codes, np.arange(n), n)     # a word of one text is no word of another
    low, runs = 1, []                                                              # grams of ``low`` words
    while max(MIN_LENGTH, MIN_EXPONENT * low) <= longest and (grams >= 0).any():
        double = _pairs(grams, grams, low)
        triple = _pairs(double, grams, low)      # 2 * low words, then low more
        at, lag = _matches(triple, low)
        runs += diagonals(zip(at.tolist(), lag.tolist()), 3 * low)
        grams, low = double, 2 * low
    return sorted(runs, key=lambda r: (r[0], r[2]))


def _slice(ids: list[int | None], texts: pa.Array, plant: bool) -> pa.RecordBatch:
    """Rows of ``SCHEMA`` for one slice of a batch; ``texts`` is large_binary without nulls."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    coded, first = _words(data, offsets - offsets[0])
    codes, size = coded.indices.to_numpy().astype(np.int64), np.diff(first)
    for k, doc_id in enumerate(ids if plant else ()):
        if change := planted(doc_id, int(size[k])):
            a, p = change
            own = codes[first[k]:first[k + 1]]
            own[a:] = own[a:][np.arange(len(own) - a) % p]
    text_of = np.repeat(np.arange(len(ids)), size)
    found: list[list[tuple[int, int, int]]] = [[] for _ in ids]
    kept = np.ones(len(codes), bool)
    for start, length, period in find_runs(codes, text_of, int(size.max(initial=0))):
        k = int(text_of[start])
        found[k].append((start - int(first[k]), length, period))
        kept[start + period:start + length] = False
    left = np.concatenate([[0], np.cumsum(kept)])[first]
    lists = pa.LargeListArray.from_arrays(pa.array(left, pa.int64()), coded.dictionary.take(pa.array(codes[kept])))
    collapsed = pc.binary_join(lists, pa.scalar(b" ", pa.large_binary()))
    best = [max(f, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None)) for f in found]
    return pa.RecordBatch.from_pydict({
        "doc_id": pa.array(ids, pa.int64()), "n_runs": pa.array([len(f) for f in found], pa.int64()),
        **{name: pa.array([b[i] for b in best], pa.int64()) for i, name in enumerate(("start", "length", "period"))},
        "exponent_milli": pa.array([b[1] and 1000 * b[1] // b[2] for b in best], pa.int64()),
        "runs_sha256": pa.array([hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in f).encode()).hexdigest() for f in found]),
        "collapsed_sha256": pa.array([hashlib.sha256(c.as_buffer()).hexdigest() for c in collapsed]),
        "runs": pa.array([[{"start": s, "length": n, "period": q} for s, n, q in f] for f in found],
                         pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))),
        "collapsed": collapsed.cast(pa.binary()),
    })


def periodic_runs(docs: DataFrame, plant: bool = False) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: ``SCHEMA``.

    ``runs`` lists every run by start, then period; ``collapsed`` is the text with each run reduced to its first
    period, words joined by one space. start, length, period and exponent_milli describe the run of the greatest
    exact length / period (ties: smallest start, then period). ``plant`` applies ``planted`` to the words first."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").cast(pa.int64()).to_pylist()
            texts = batch.column("text").cast(pa.large_string()).cast(pa.large_binary()).fill_null(b"")
            ends = np.cumsum(pc.binary_length(texts).to_numpy()) // SLICE_BYTES
            cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(ids)]
            for a, b in zip(cuts, cuts[1:]):
                if a < b:
                    yield _slice(ids[a:b], texts.slice(a, b - a), plant)

    return docs.select("doc_id", "text").mapInArrow(rows, SCHEMA)
