"""Vantage-point trees over 64-bit fingerprints under Hamming distance.

Trees cut the space into shards. At a node with vantage ``v`` and radius ``mu`` a fingerprint at
distance ``d`` belongs inside if ``d <= mu``, else outside. Distances of 64 bits concentrate, so that a
slack of ``reach`` bits would copy a large share of the fingerprints at every level. A pair within
``reach`` bits, though, agrees wholly on one of ``reach + 1`` blocks of bits (more blocks: on several).
So there is a tree for each choice of agreeing blocks, whose distances count those bits alone: by the
triangle inequality such a pair has equal distances to every vantage there, the slack is zero, and each
fingerprint lies in one shard of each tree, however many there are. Only a shard that such splits
cannot make small is split further by all bits, where fingerprints within ``reach`` beyond the radius
also visit the inner side. Where each item also has a length and linked items must agree in it up to
a ratio, such nodes may take the empty text as vantage and the difference of log lengths as distance.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np

#: Fingerprints compared exhaustively at a leaf of the recursion.
LEAF = 384
#: Cells of one XOR block: bounds the memory of a comparison.
CELLS = 1 << 21
#: A split must leave each side below this share, or the recursion ends.
GAIN = 0.87
#: Sampled fingerprints that a shard of the top tree rests on.
PER_SHARD = 32
#: Trees, at most, that blocks of bits are combined for; and bits that such a tree must have.
MOST_TREES = 24
LEAST_BITS = 8
#: Links held before they are thinned to a spanning forest.
HELD = 1 << 20

ALL = (1 << 64) - 1


@dataclass
class Rule:
    """When two items are linked: bits, and optionally length ratio and sketch similarity."""

    reach: int = 3
    ratio: float | None = None
    similar: float | None = None

    @property
    def span(self) -> float:
        return -math.log(self.ratio) + 1e-9 if self.ratio else math.inf


def masks(reach: int, shards: float) -> list[int]:
    """Sets of bits such that a pair within ``reach`` bits agrees wholly on one of them at least.

    ``b`` blocks, ``b - reach`` of which make a set: as few as still tell four times ``shards`` cells apart.
    None where the sets would be too small to split by.
    """
    out: list[int] = []
    for blocks in range(reach + 1, 64):
        if math.comb(blocks, reach) > MOST_TREES and out:
            break
        edge = [64 * i // blocks for i in range(blocks + 1)]
        part = [(1 << b) - (1 << a) for a, b in zip(edge, edge[1:])]
        bits = 64 * (blocks - reach) // blocks
        if bits >= LEAST_BITS and math.comb(blocks, reach) <= MOST_TREES:
            out = [sum(c) for c in combinations(part, blocks - reach)]
        if bits >= LEAST_BITS and 2.0 ** (bits - 2) >= shards or math.comb(blocks, reach) > MOST_TREES:
            break
    return out


@dataclass
class Tree:
    """Nodes in arrays; a child below zero is the leaf ``-1 - child``. ``bits`` zero: by length."""

    rule: Rule
    roots: list[int] = field(default_factory=list)
    leaf_mask: list[int] = field(default_factory=list)
    nodes: dict = field(default_factory=lambda: {k: [] for k in ("bits", "vantage", "mu", "slack", "inner", "outer")})
    flat: dict | None = None

    @property
    def leaves(self) -> int:
        return len(self.leaf_mask)

    def place(self, fp: np.ndarray, size: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for every shard that a fingerprint belongs to or visits, a level of the trees at a time."""
        if self.flat is None:
            kinds = {"bits": np.uint64, "vantage": np.uint64, "mu": np.float64, "slack": np.float64, "inner": np.int64, "outer": np.int64}
            self.flat = {k: np.array(v, dtype=kinds[k]) for k, v in self.nodes.items()}
        t, rows, leaves = self.flat, [], []
        long = None if size is None else np.log1p(size.astype(np.float64))
        at, node = np.tile(np.arange(len(fp)), len(self.roots)), np.repeat(np.array(self.roots, dtype=np.int64), len(fp))
        while len(at):
            done = node < 0
            rows.append(at[done])
            leaves.append(-1 - node[done])
            at, node = at[~done], node[~done]
            d = np.bitwise_count((fp[at] ^ t["vantage"][node]) & t["bits"][node]).astype(np.float64)
            if long is not None:
                d = np.where(t["bits"][node] == 0, long[at], d)
            inside, outside = d <= t["mu"][node] + t["slack"][node], d > t["mu"][node]
            at, node = np.concatenate([at[inside], at[outside]]), np.concatenate([t["inner"][node[inside]], t["outer"][node[outside]]])
        return np.concatenate(rows) if rows else np.empty(0, dtype=np.int64), np.concatenate(leaves).astype(np.int32) if leaves else np.empty(0, dtype=np.int32)


@dataclass
class Split:
    bits: int
    vantage: int
    mu: float
    slack: float
    share: float

    def sides(self, fp: np.ndarray, size: np.ndarray | None, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = np.log1p(size[at].astype(np.float64)) if not self.bits else np.bitwise_count((fp[at] ^ np.uint64(self.vantage)) & np.uint64(self.bits))
        return at[d <= self.mu + self.slack], at[d > self.mu]


def _split(fp: np.ndarray, size: np.ndarray | None, rule: Rule, rng: np.random.Generator, bits: int = ALL) -> Split | None:
    """The best of a few vantages and its radius; none if a side would keep more than GAIN."""
    n, best = len(fp), None
    slack = rule.reach if bits == ALL else 0
    for vantage in fp[rng.integers(0, n, 6)].tolist():
        within = np.cumsum(np.bincount(np.bitwise_count((fp ^ np.uint64(vantage)) & np.uint64(bits)), minlength=65 + slack))
        share = np.maximum(within[slack : 65 + slack], n - within[:65]) / n
        mu = int(np.argmin(share))
        if best is None or share[mu] < best.share:
            best = Split(bits, vantage, float(mu), float(slack), float(share[mu]))
    if rule.ratio and bits == ALL:
        d = np.sort(np.log1p(size.astype(np.float64)))
        for q in (0.3, 0.36, 0.42, 0.5):
            mu = float(d[int(q * (n - 1))])
            share = max(np.searchsorted(d, mu + rule.span, "right"), n - np.searchsorted(d, mu, "right")) / n
            if share < best.share:
                best = Split(0, 0, mu, rule.span, share)
    return best if best.share <= GAIN else None


def fit(fp: np.ndarray, size: np.ndarray | None, total: int, shard: int, rule: Rule, seed: int = 7) -> Tree:
    """Trees from a sample that stands for ``total`` items, down to about ``shard`` items a leaf.

    The sample should hold PER_SHARD fingerprints for each shard that is wanted.
    """
    tree, rng = Tree(rule), np.random.default_rng(seed)
    scale = total / max(1, len(fp))

    def grow(at: np.ndarray, mask: int) -> int:
        found = None
        if len(at) * scale > shard and len(at) >= PER_SHARD:
            sized = None if size is None else size[at]
            found = (_split(fp[at], sized, rule, rng, mask) if mask else None) or _split(fp[at], sized, rule, rng)
        if found is None:
            tree.leaf_mask.append(mask)
            return -tree.leaves
        me = len(tree.nodes["bits"])
        for k, v in (("bits", found.bits), ("vantage", found.vantage), ("mu", found.mu), ("slack", found.slack), ("inner", 0), ("outer", 0)):
            tree.nodes[k].append(v)
        inner, outer = found.sides(fp, size, at)
        tree.nodes["inner"][me] = grow(inner, mask)
        tree.nodes["outer"][me] = grow(outer, mask)
        return me

    for mask in masks(rule.reach, max(1.0, total / shard)) or [0]:
        tree.roots.append(grow(np.arange(len(fp)), mask))
    return tree


def _agree(a: np.ndarray, b: np.ndarray, size: np.ndarray | None, sketch: np.ndarray | None, rule: Rule) -> np.ndarray:
    """Which of the pairs (a, b) also agree in length and sketch."""
    ok = np.ones(len(a), dtype=bool)
    if rule.ratio:
        x, y = size[a].astype(np.float64), size[b].astype(np.float64)
        ok &= np.minimum(x, y) >= rule.ratio * np.maximum(x, y)
    if rule.similar:
        for at in range(0, len(a), 8192):
            part = np.flatnonzero(ok[at : at + 8192]) + at
            s, t = sketch[a[part]], sketch[b[part]]
            union = ((s != 0) | (t != 0)).sum(1)
            ok[part] = ((s == t) & (s != 0)).sum(1) >= rule.similar * np.maximum(union, 1)
    return ok


def _hits(left: np.ndarray, right: np.ndarray, fp: np.ndarray, size: np.ndarray | None, sketch: np.ndarray | None, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    i, j = np.nonzero(np.bitwise_count(fp[left][:, None] ^ fp[right][None, :]) <= rule.reach)
    a, b = left[i], right[j]
    if rule.ratio or rule.similar:
        ok = _agree(a, b, size, sketch, rule)
        a, b = a[ok], b[ok]
    return a, b


def _leaf(at: np.ndarray, fp: np.ndarray, size: np.ndarray | None, sketch: np.ndarray | None, rule: Rule, out: list) -> None:
    """Link what is connected among ``at``; a dense group is walked from one item on, not written as all its pairs."""
    step, found = max(1, CELLS // max(1, len(at))), []
    for k in range(0, len(at), step):
        a, b = _hits(np.arange(k, min(k + step, len(at))), np.arange(k, len(at)), fp[at], None if size is None else size[at], None if sketch is None else sketch[at], rule)
        found.append(np.stack([at[a[a < b]], at[b[a < b]]], axis=1))
        if sum(map(len, found)) > 16 * len(at) + 4096:
            break
    else:
        out += [x for x in found if len(x)]
        return
    rest = at
    while len(rest) > 1:
        frontier, rest = rest[:1], rest[1:]
        while len(frontier) and len(rest):  # everything in the frontier hangs together already
            part, frontier = frontier[:64], frontier[64:]
            for k in range(0, len(rest), CELLS // 64):
                a, b = _hits(part, rest[k : k + CELLS // 64], fp, size, sketch, rule)
                new, first = np.unique(b, return_index=True)
                if len(new):
                    out.append(np.stack([a[first], new], axis=1))
                    frontier = np.concatenate([frontier, new])
            rest = rest[~np.isin(rest, frontier)]


def _forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A spanning forest of the given links, as rows (a, b): min-label hooking with pointer jumping."""
    if not len(a):
        return np.empty((0, 2), dtype=np.int64)
    ids, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(ids))
    while True:
        ru, rv = root[u], root[v]
        if (ru == rv).all():
            break
        np.minimum.at(root, np.maximum(ru, rv), np.minimum(ru, rv))
        while True:
            jumped = root[root]
            if (jumped == root).all():
                break
            root = jumped
    child = np.flatnonzero(root != np.arange(len(ids)))
    return np.stack([ids[child], ids[root[child]]], axis=1).astype(np.int64)


def links(fp: np.ndarray, size: np.ndarray | None, sketch: np.ndarray | None, rule: Rule, seed: int = 11, mask: int = 0) -> np.ndarray:
    """Rows (i, j) that connect exactly the items connected by links within one shard.

    ``mask``: only pairs that agree on these bits have to be found here. Without one, all sets of bits
    are taken in turn. Fingerprints that agree on a set are a ball of radius zero: those of small balls
    are compared directly, larger balls are split by all bits.
    """
    rng, out = np.random.default_rng(seed), []
    for bits in [mask] if mask else masks(rule.reach, len(fp) / LEAF) or [0]:
        if not len(fp):
            break
        cell = fp & np.uint64(bits)
        order = np.argsort(cell, kind="stable")
        start = np.flatnonzero(np.r_[True, np.diff(cell[order]) != 0])
        within_cells(order, start, fp, size, sketch, rule, rng, out)
    pairs = np.concatenate(out) if out else np.empty((0, 2), dtype=np.int64)
    return _forest(pairs[:, 0], pairs[:, 1])


def within_cells(order: np.ndarray, start: np.ndarray, fp: np.ndarray, size: np.ndarray | None, sketch: np.ndarray | None, rule: Rule, rng: np.random.Generator, out: list) -> None:
    """Links inside each of the cells order[start[i] : start[i + 1]]: small ones all at once, large ones by ``_inside``."""
    length = np.diff(np.r_[start, len(order)])
    left = np.repeat(start + length, length) - np.arange(len(order)) - 1  # members of the cell that follow
    left[np.repeat(length > LEAF, length)] = 0
    for k in range(1, LEAF):
        at = np.flatnonzero(left >= k)
        if not len(at):
            break
        a, b = order[at], order[at + k]
        near = np.bitwise_count(fp[a] ^ fp[b]) <= rule.reach
        a, b = a[near], b[near]
        if rule.ratio or rule.similar:
            ok = _agree(a, b, size, sketch, rule)
            a, b = a[ok], b[ok]
        if len(a):
            out.append(np.stack([a, b], axis=1))
        if sum(map(len, out)) > HELD:
            pairs = np.concatenate(out)
            out[:] = [_forest(pairs[:, 0], pairs[:, 1])]
    for i in np.flatnonzero(length > LEAF).tolist():
        _inside(np.sort(order[start[i] : start[i] + length[i]]), fp, size, sketch, rule, rng, out)


def _inside(at: np.ndarray, fp: np.ndarray, size: np.ndarray | None, sketch: np.ndarray | None, rule: Rule, rng: np.random.Generator, out: list) -> None:
    """Links among ``at``, by vantage points over all bits down to LEAF items or where no split helps."""
    todo = [at]
    while todo:
        at = todo.pop()
        found = _split(fp[at], None if size is None else size[at], rule, rng) if len(at) > LEAF else None
        if found is None:
            _leaf(at, fp, size, sketch, rule, out)
        else:
            todo += found.sides(fp, size, at)
