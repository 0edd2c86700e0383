"""Blockwise suffix sorting with a difference cover, to a bounded depth, in numpy.

Sample suffixes are those whose place modulo V lies in COVER. Any two places i,
j have a shift d < V that takes both into the sample, so two suffixes that agree
on V bytes are ordered by the ranks of their samples at i + d, j + d. Sample
ranks are made once for a text, by doubling: places i and i + V have the same
residue, so ranks of V bytes give ranks of 2V, 4V, ... bytes.

The suffixes asked for are then sorted one bucket at a time. A bucket is a range
of V-byte prefixes; memory beside the text is the sample ranks and one bucket.
"""

from __future__ import annotations

import numpy as np

#: A perfect difference set; every difference modulo V comes from one pair.
V, COVER = 7, (0, 1, 3)
#: Suffixes in a bucket, unless one prefix alone has more.
BUCKET = 1 << 16


def _shifts() -> np.ndarray:
    out = np.zeros((V, V), np.int64)
    for r in range(V):
        for s in range(V):
            out[r, s] = next(d for d in range(V) if (r + d) % V in COVER and (s + d) % V in COVER)
    return out


SHIFT = _shifts()
_SLOT = np.array([COVER.index(r) if r in COVER else -1 for r in range(V)])


def prefix_keys(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The V bytes from each place as one number; zeros follow the text."""
    padded = np.concatenate((text, np.zeros(V, np.uint8)))
    key = np.zeros(len(at), np.uint64)
    for k in range(V):
        key = (key << np.uint64(8)) | padded[at + k].astype(np.uint64)
    return key


class CoverRanks:
    """Ranks of the sample suffixes by their first `depth` bytes, or some more."""

    def __init__(self, text: np.ndarray, depth: int):
        whole = -(-len(text) // V) + 1
        at = (np.arange(whole, dtype=np.int64)[:, None] * V + np.array(COVER)).ravel()
        at_text = np.minimum(at, len(text))
        rank = np.unique(prefix_keys(text, at_text), return_inverse=True)[1].astype(np.int64) + 1
        rank[at >= len(text)] = 0
        known, step = V, len(COVER)
        while known < depth:
            later = np.concatenate((rank[step:], np.zeros(min(step, len(rank)), np.int64)))
            rank = np.unique(rank * (rank.max() + 1) + later, return_inverse=True)[1].astype(np.int64) + 1
            known, step = known * 2, step * 2
        self.rank = rank

    def of(self, at: np.ndarray) -> np.ndarray:
        """at: places in the sample."""
        return self.rank[np.minimum(at // V * len(COVER) + _SLOT[at % V], len(self.rank) - 1)]


def _less(at: np.ndarray, key: np.ndarray, ranks: CoverRanks) -> np.ndarray:
    """For each suffix of a bucket, how many suffixes of the bucket are smaller."""
    residue = at % V
    classes = [np.flatnonzero(residue == r) for r in range(V)]
    base = np.int64(ranks.rank.max() + 1)
    less = np.zeros(len(at), np.int64)
    for r in range(V):
        for s in range(V):
            if len(classes[r]) and len(classes[s]):
                d = SHIFT[r, s]
                mine, other = (key[c] * base + ranks.of(at[c] + d) for c in (classes[r], classes[s]))
                less[classes[r]] += np.searchsorted(np.sort(other), mine)
    return less


def repeated(text: np.ndarray, at: np.ndarray, depth: int, bucket: int = BUCKET) -> np.ndarray:
    """For each place whether the `depth` bytes from it also start at another of the places. All lie within the text."""
    out = np.zeros(len(at), bool)
    if len(at) < 2:
        return out
    prefix = np.unique(prefix_keys(text, at), return_inverse=True, return_counts=True)
    key, count = prefix[1].astype(np.int64), prefix[2]
    tied = np.flatnonzero(count[key] > 1)  # a prefix that one suffix has is in order already
    if not len(tied):
        return out
    tied = tied[np.argsort(key[tied], kind="stable")]
    ranks = CoverRanks(text, depth)
    window = np.lib.stride_tricks.sliding_window_view(text, depth)
    begin = 0
    while begin < len(tied):
        end = min(begin + bucket, len(tied))
        if end < len(tied):  # to the end of the last prefix, or to its begin if that leaves anything
            cut = int(np.searchsorted(key[tied], key[tied[end]]))
            end = cut if cut > begin else int(np.searchsorted(key[tied], key[tied[end]], "right"))
        own = tied[begin:end]
        local = np.unique(key[own], return_inverse=True)[1].astype(np.int64)
        order = own[np.argsort(_less(at[own], local, ranks), kind="stable")]
        for a in range(0, len(order) - 1, BUCKET // 4):  # equal strings are neighbours
            x, y = order[a : a + BUCKET // 4], order[a + 1 : a + 1 + BUCKET // 4]
            x = x[: len(y)]
            same = (window[at[x]] == window[at[y]]).all(axis=1)
            out[x[same]] = True
            out[y[same]] = True
        begin = end
    return out
