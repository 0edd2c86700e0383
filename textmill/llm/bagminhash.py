"""BagMinHash signatures of weighted sets, many sets at a time, in numpy.

An element x of weight w owns the strip [0, w] of a plane whose other axis is
time. Points fall on the plane as a Poisson process fixed by x alone; each point
belongs to one of M components, and a component's signature is its earliest
point on the strip. Two sets agree in a component with probability
sum(min) / sum(max) of their weights, without bias.

The strip is discretised dyadically: (0, 1], (1, 2], (2, 4], ... each has its own
process, whose rate is the length of the interval. In the interval that w cuts,
points above w are dropped. Points are made in order of time and only up to a
limit per set that its total weight suggests; a set of which a component is
still empty, or beyond its limit, doubles it. So a set costs about
M * (ln M + SLACK) points however large it is.
"""

from __future__ import annotations

import numpy as np

SLACK = 4.0
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _uniform(x: np.ndarray) -> np.ndarray:
    """In (0, 1]."""
    return ((x >> _U(11)).astype(np.float64) + 1.0) * 2.0**-53


def signatures(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, n_sets: int, m: int) -> np.ndarray:
    """owner: set of each element, element: its 64-bit hash, weight: an integer of at least 1.

    Returns n_sets x m hashes of the winning points; sets without elements get zeros.
    """
    time = np.full((n_sets, m), np.inf)
    mark = np.zeros((n_sets, m), np.uint64)
    if not len(owner):
        return mark
    # one process for each interval that a weight reaches
    levels = np.ceil(np.log2(weight)).astype(np.int64) + 1
    at = np.repeat(np.arange(len(owner)), levels)
    level = np.arange(len(at)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level == 0, 0, 2.0 ** (level - 1))
    rate = np.where(level == 0, 1.0, low)
    seed = mix(element[at] + level.astype(np.uint64) * _U(0x9E3779B97F4A7C15))
    share = np.minimum((weight[at] - low) / rate, 1.0)  # of the interval that lies on the strip
    of = owner[at]
    total = np.bincount(owner, weights=weight, minlength=n_sets)
    limit = np.where(total > 0, m * (np.log(m) + SLACK) / np.maximum(total, 1), 0)
    clock = np.zeros(len(at))
    count = np.zeros(len(at), np.int64)
    live = np.arange(len(at))
    open_sets = total > 0
    while len(live):
        # next points of the processes that are still below their set's limit
        active = live
        while len(active):
            x = mix(seed[active] + (count[active] + 1).astype(np.uint64) * _U(0xD1342543DE82EF95))
            t = clock[active] - np.log(_uniform(x)) / rate[active]
            early = t <= limit[of[active]]
            # the point that lies beyond the limit is made again, from the same numbers, if the limit grows
            active, x, t = active[early], x[early], t[early]
            clock[active] = t
            count[active] += 1
            y = mix(x + _U(0xA0761D6478BD642F))
            on = share[active] >= 1
            if not on.all():
                on |= _uniform(mix(y + _U(0xE7037ED1A0B428DB))) <= share[active]
            cell = of[active[on]] * m + (y[on] >> _U(33)).astype(np.int64) % m
            t, x = t[on], x[on]
            flat_t, flat_m = time.ravel(), mark.ravel()
            better = t < flat_t[cell]
            cell, t, x = cell[better], t[better], x[better]
            order = np.argsort(-t, kind="stable")  # of several points in one cell the earliest is written last
            flat_t[cell[order]] = t[order]
            flat_m[cell[order]] = x[order]
        # a component is settled if its point lies below the limit, up to which all points are known
        open_sets &= np.isinf(time).any(axis=1)
        limit[open_sets] *= 2
        live = live[open_sets[of[live]]]
    return mark
