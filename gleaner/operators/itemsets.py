"""Item sets that agree with what is known: some items are positive, some negative, and of each pending set at least one item is negative.

A random set has every positive item, no negative one, each other item with a chance of a half, and no pending set as a
whole. The chance that it holds all of a row's items is a product over groups of items that pending sets tie together. Groups of up to
EXACT items are enumerated; of larger ones a chain gives samples: it flips one item at a time and leaves a pending set
incomplete always, so it never has to be drawn again, however many pending sets there are."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

EXACT, SAMPLES, SWEEPS = 14, 50, 20


class ConflictError(ValueError):
    """Labels that no item set agrees with."""


def groups_of(pending: Iterable[frozenset[int]]) -> list[tuple[list[int], list[list[int]]]]:
    """(items, pending sets as places in items) of each group of items that pending sets tie together."""
    groups: list[tuple[set[int], list[frozenset[int]]]] = []
    for p in pending:
        joined, sets = set(p), [p]
        rest = []
        for items, own in groups:
            if items & joined:
                joined |= items
                sets += own
            else:
                rest.append((items, own))
        groups = [*rest, (joined, sets)]
    out = []
    for items, sets in sorted(groups, key=lambda g: sorted(g[0])):
        place = {i: k for k, i in enumerate(sorted(items))}
        out.append((sorted(items), sorted(sorted(place[i] for i in s) for s in set(sets))))
    return out


def consistent(n: int, pending: list[list[int]], samples: int = SAMPLES, seed: int = 0) -> np.ndarray:
    """Sets (rows of booleans over n items) that hold no pending set whole: all of them for few items, else samples of a chain."""
    if n <= EXACT:
        every = (np.arange(1 << n)[:, None] >> np.arange(n)) & 1 > 0
        return every[~np.any([every[:, p].all(axis=1) for p in pending], axis=0)] if pending else every
    rng = np.random.default_rng(seed)
    member = np.zeros((len(pending), n), bool)
    for k, p in enumerate(pending):
        member[k, p] = True
    of = [np.flatnonzero(member[:, i]) for i in range(n)]
    now, missing, out = np.zeros(n, bool), member.sum(axis=1), []
    for _ in range(samples):
        for i, up in zip(rng.integers(0, n, SWEEPS * n).tolist(), (rng.random(SWEEPS * n) < 0.5).tolist()):
            if up != now[i] and not (up and (missing[of[i]] == 1).any()):
                now[i] = up
                missing[of[i]] += -1 if up else 1
        out.append(now.copy())
    return np.array(out)


def share(held: np.ndarray, positive: np.ndarray, negative: np.ndarray, pending: Iterable[frozenset[int]], samples: int = SAMPLES, seed: int = 0) -> np.ndarray:
    """For each row (booleans over the items) the chance that a random set that agrees with what is known holds all of its items."""
    groups = groups_of(pending)
    tied = np.zeros(held.shape[1], bool)
    tied[[i for items, _ in groups for i in items]] = True
    out = np.where((held & negative).any(axis=1), 0.0, 0.5 ** (held & ~positive & ~negative & ~tied).sum(axis=1))
    for items, sets in groups:
        drawn = consistent(len(items), sets, samples, seed)
        patterns, which = np.unique(held[:, items], axis=0, return_inverse=True)
        chance = np.array([(drawn | ~p).all(axis=1).mean() for p in patterns])
        out *= chance[which.ravel()]
    return out
