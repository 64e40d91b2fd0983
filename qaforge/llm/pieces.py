"""Spans of bytes as ragged numpy arrays: gathering, and exact numbers for equal spans."""

from __future__ import annotations

import numpy as np

from qaforge.llm.common import span_hashes


def ragged(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions start, start+1, ... of every span one after the other, and where each span begins among them (end included)."""
    begin = np.zeros(len(sizes) + 1, dtype="int64")
    np.cumsum(sizes, out=begin[1:])
    return np.repeat(starts - begin[:-1], sizes) + np.arange(begin[-1]), begin


def distinct_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(digest of each distinct span, a span that holds it, number of each span). Spans get one number only if their bytes are equal.

    Spans are numbered by digest; each span's bytes are then compared with those of its representative, so that two spans which share a digest by
    chance are told apart.
    """
    keys, first, of = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    sizes = ends - starts
    wrong = sizes != sizes[first[of]]
    at, begin = ragged(starts, sizes)
    twin = at + np.repeat(starts[first[of]] - starts, sizes)
    differs = data[at] != data[np.minimum(twin, len(data) - 1)] if len(data) else np.zeros(0, dtype=bool)
    if differs.any():
        wrong[np.searchsorted(begin, np.flatnonzero(differs), side="right") - 1] = True
    if wrong.any():
        extra: dict[bytes, int] = {}
        odd = np.flatnonzero(wrong)
        names = [extra.setdefault(data[starts[i] : ends[i]].tobytes(), len(extra)) for i in odd.tolist()]
        new, at_first = np.unique(names, return_index=True)
        of[odd] = len(keys) + np.array(names)
        # A digest of zero marks them as spans that no table of digests may hold.
        keys, first = np.concatenate([keys, np.zeros(len(new), dtype="uint64")]), np.concatenate([first, odd[at_first]])
    return keys, first, of
