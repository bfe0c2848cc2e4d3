"""Bridges between two cells: forward probabilities, then a walk drawn backwards.

One engine serves all walks.  The state is a cell and, where a class is
correlated, the direction of the last move.  A move from cell ``p`` takes the
kernels of the class at ``p``; targets outside the grid or of a forbidden
class get nothing and the rest is renormalised.  Layers are cut to the box
that both ends reach, which changes no bridge, and are kept whole, or every
k-th of them when they would take more than ``MEMORY`` bytes.
"""

from __future__ import annotations

import hashlib
import math
from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from dataclasses import field as dataclass_field
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailweave.functions.kernels import KernelParams, kernels_of, offsets, sector_masks
from trailweave.schemas import WALK

MEMORY = 256 << 20
OK, UNREACHABLE, FALLBACK = "OK", "UNREACHABLE", "FALLBACK"
#: Cells of a terrain that may be broadcast.
TERRAIN_CELLS = 64_000_000
#: States of a grid whose moves are tabled, so that its walks are drawn many at a time; and those up to which the table is a matrix.
TABLE_STATES, MATRIX_STATES = 4096, 724
#: Bytes of layers, and of tables, that drawing many walks keeps.
TABLE_MEMORY = 128 << 20
#: Segments drawn at a time, and the most points that they may have if all were as long as the longest.
ROWS, POINTS = 20_000, 1 << 20


def check_arguments(width: int, height: int, T: int, S: int | None = None, D: int | None = None, cells: tuple = ()) -> None:
    """ValueError for sizes that aren't positive and cells outside the grid."""
    for name, value in (("width", width), ("height", height), ("T", T), ("S", S), ("D", D)):
        if value is not None and value <= 0:
            raise ValueError(f"{name} must be positive")
    for x, y in cells:
        if not (0 <= x < width and 0 <= y < height):
            raise ValueError(f"({x}, {y}) is outside the grid of {width} x {height}")


def uniform(*key) -> float:
    """A number in [0, 1) from the key alone, so that no partitioning changes a walk."""
    return int(hashlib.md5(repr(key).encode()).hexdigest()[:13], 16) / 16**13


#: Shifts and constants of MD5 (RFC 1321), and which word each of its steps takes.
_MD5_SHIFT = [r[i % 4] for r in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for i in range(16)]
_MD5_ADD = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_MD5_WORD = [(i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16 for i in range(64)]


def _md5_start(words: np.ndarray) -> np.ndarray:
    """The first eight bytes of the MD5 of messages of one block, ``[word, message]``, as big-endian numbers."""
    first = [np.full(words.shape[1], v, np.uint32) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = (v.copy() for v in first)
    some, f, g = words.any(1), np.empty_like(a), np.empty_like(a)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
        a += f
        a += _MD5_ADD[i]
        if some[_MD5_WORD[i]]:
            a += words[_MD5_WORD[i]]
        np.left_shift(a, np.uint32(_MD5_SHIFT[i]), out=g)
        a >>= np.uint32(32 - _MD5_SHIFT[i])
        a |= g
        a += b
        a, b, c, d = d, a, b, c
    high, low = ((v + w).byteswap().astype(np.uint64) for v, w in zip((a, b), first[:2], strict=True))
    return high << np.uint64(32) | low


class _Keys:
    """Texts of many keys without the bracket at the end, for ``uniform(*key, last)`` of many of them at once."""

    #: Bytes of a block, those of them that a text and what ends it may have, and messages that fit a cache.
    BLOCK, ROOM, MANY = 64, 56, 8192

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_binary())
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        self.start, self.size = at[:-1], np.diff(at)
        self.raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        kept = np.minimum(self.size, self.ROOM)
        self.text = np.zeros((len(texts), self.BLOCK), np.uint8)
        inside = np.arange(self.BLOCK) < kept[:, None]
        self.text[inside] = self.raw[at[0] : at[-1]] if (kept == self.size).all() else self.raw[(at[:-1, None] + np.arange(self.BLOCK))[inside]]

    @classmethod
    def of(cls, seed: int, animal: pa.Array, seg: pa.Array) -> _Keys:
        """Of ``(seed, animal, seg, last)``."""
        if pc.all(pc.match_substring_regex(animal, "^[A-Za-z0-9_.: -]*$"), skip_nulls=False).as_py() and not seg.null_count:
            return cls(pc.binary_join_element_wise(f"({seed!r}, '", animal.cast(pa.string()), "', ", seg.cast(pa.string()), ""))
        pairs = zip(animal.to_pylist(), seg.to_pylist(), strict=True)
        return cls(pa.array([repr((seed, a, s))[:-1].encode() for a, s in pairs], pa.large_binary()))

    def take(self, rows: np.ndarray) -> _Keys:
        out = object.__new__(_Keys)
        out.raw, out.start, out.size, out.text = self.raw, self.start[rows], self.size[rows], self.text[rows]
        return out

    def uniforms(self, rows: np.ndarray, last) -> np.ndarray:
        """``uniform`` of the keys of ``rows``; ``last`` is one for all, or a number for each."""
        each = isinstance(last, np.ndarray)
        values, which = np.unique(last, return_inverse=True) if each else ([last], np.zeros(len(rows), int))
        tails = [f", {v!r})".encode() for v in (values.tolist() if each else values)]
        width = max(map(len, tails), default=0) + 1
        ends = np.frombuffer(b"".join((t + b"\x80").ljust(width, b"\0") for t in tails), np.uint8).reshape(-1, width)
        bits = np.array([8 * len(t) for t in tails])
        out = np.empty(len(rows), np.uint64)
        for k in range(0, len(rows), self.MANY):
            r, e = rows[k : k + self.MANY], which[k : k + self.MANY]
            size = self.size[r]
            long = size + width > self.ROOM
            text, at = self.text[r], np.arange(len(r)) * self.BLOCK + np.where(long, 0, size)
            flat = text.ravel()
            for j in range(width):
                flat[at + j] = ends[e, j] if each else ends[0, j]
            words = text.view("<u4").T.astype(np.uint32, order="C")
            words[14] = 8 * size + bits[e]
            out[k : k + self.MANY] = _md5_start(words)
            for i in np.flatnonzero(long).tolist():
                whole = self.raw[self.start[r[i]] :][: size[i]].tobytes() + tails[e[i]]
                out[k + i] = int.from_bytes(hashlib.md5(whole).digest()[:8], "big")
        return (out >> np.uint64(12)).astype(float) / 16**13


@dataclass
class Field:
    """What a walk moves through.

    ``kernels[k]`` are those of class index ``k``, one for each direction;
    ``classes(t)`` gives the grid of class indices for the move to point
    ``t`` (None: class 0 everywhere); ``open`` says where a walk may be;
    ``shift(t)`` moves a kernel's centre.
    """

    width: int
    height: int
    kernels: list[np.ndarray]
    classes: Callable[[int], np.ndarray | None] = lambda t: None
    open: np.ndarray | None = None
    shift: Callable[[int], tuple[int, int]] = lambda t: (0, 0)
    still: bool = True
    renormalise: bool = True
    at: Callable[[int], list[np.ndarray]] | None = None
    #: Moves of boxes met before, where they are the same at all points.
    made: dict = dataclass_field(default_factory=dict)

    def kernels_at(self, t: int) -> list[np.ndarray]:
        return self.at(t) if self.at else self.kernels

    @property
    def D(self) -> int:
        return max(len(k) for k in self.kernels)


def _band(profile: np.ndarray, targets: np.ndarray, sources: np.ndarray, bias: int) -> np.ndarray:
    """``[target, source]`` weights of a one-dimensional kernel."""
    at = targets[:, None] - sources[None, :] - bias + len(profile) // 2
    inside = (at >= 0) & (at < len(profile))
    return np.where(inside, profile[np.where(inside, at, 0)], 0.0)


@lru_cache(maxsize=512)
def _profiles(raw: bytes, side: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """A kernel as a sum of products of a column and a row; a Gaussian is one."""
    kernel = np.frombuffer(raw).reshape(side, side)
    y, x = divmod(int(kernel.argmax()), side)
    down, across = kernel[:, x], kernel[y] / kernel[y, x]
    # as it is: a decomposition is only as exact as the largest weight, and loses what is small
    if np.allclose(np.outer(down, across), kernel, rtol=1e-12, atol=0):
        return [(down, across)]
    u, s, v = np.linalg.svd(kernel)
    return [(u[:, r] * s[r], v[r]) for r in range(side) if s[r] > 1e-15 * s[0]]


class _Moves:
    """The moves to one point, on the box ``x0 <= x < x1, y0 <= y < y1``."""

    def __init__(self, field: Field, t: int, box: tuple[int, int, int, int]):
        x0, x1, y0, y1 = box
        self.box, self.D = box, field.D
        bx, by = field.shift(t)
        grid = field.classes(t)
        cls = np.zeros((y1 - y0, x1 - x0), int) if grid is None else grid[y0:y1, x0:x1]
        free = np.ones((field.height, field.width), bool) if field.open is None else field.open
        self.free = free[y0:y1, x0:x1]
        self.parts = []
        for k, kernel in enumerate(field.kernels_at(t)):
            own = cls == k
            if not own.any():
                continue
            S = kernel.shape[1] // 2
            shifts = offsets(S) + (by, bx)
            weights = kernel.reshape(len(kernel), -1)
            bands = None
            if self.D == 1:
                rows, cols = np.arange(y0, y1), np.arange(x0, x1)
                halves = _profiles(np.ascontiguousarray(kernel[0], float).tobytes(), 2 * S + 1)
                wide_bands = [(_band(u, np.arange(field.height), rows, by), _band(v, np.arange(field.width), cols, bx)) for u, v in halves]
                bands = [(a[y0:y1], b[x0:x1].T.copy()) for a, b in wide_bands]
                # normalised against the whole grid, before the cut
                total = sum(a.T @ free @ b for a, b in wide_bands)[None]
                total = np.where(total > 1e-12, total, 0.0)
                scale = np.where(total > 0, 1 / np.where(total > 0, total, 1), 0.0) if field.renormalise else np.ones_like(total)
                self.parts.append((own, shifts, weights, scale, np.ones((1, len(shifts))), np.zeros(1, int), bands))
                continue
            reach = np.zeros((len(kernel), *own.shape))
            pad = int(np.abs(shifts).max())
            wide = np.zeros((field.height + 2 * pad, field.width + 2 * pad), bool)
            wide[pad : pad + field.height, pad : pad + field.width] = free
            for (dy, dx), w in zip(shifts, weights.T, strict=True):
                reach += w[:, None, None] * wide[y0 + pad + dy : y1 + pad + dy, x0 + pad + dx : x1 + pad + dx]
            scale = np.where(reach > 0, 1 / np.where(reach > 0, reach, 1), 0.0) if field.renormalise else np.ones_like(reach)
            masks = sector_masks(self.D, S).reshape(self.D, -1)
            # the kernel's direction for each direction of the state, by angle
            turn = np.array([round(d * len(kernel) / self.D) % len(kernel) for d in range(self.D)])
            self.parts.append((own, shifts, weights, scale, masks, turn, bands))

    def forward(self, a: np.ndarray) -> np.ndarray:
        out = np.zeros_like(a)
        h, w = a.shape[1:]
        for own, shifts, weights, scale, masks, turn, bands in self.parts:
            if bands is not None:
                source = np.where(own, a[0], 0.0) * scale[0]
                for down, across in bands:
                    out[0] += down @ source @ across
                continue
            n = len(weights)
            source = np.zeros((n, h, w))
            np.add.at(source, turn, np.where(own, a, 0.0))
            source *= scale
            if not source.any():
                continue
            for j, (dy, dx) in enumerate(shifts):
                if abs(dy) >= h or abs(dx) >= w or not weights[:, j].any():
                    continue
                moved = np.tensordot(weights[:, j], source, 1)[max(0, -dy) : h - max(0, dy), max(0, -dx) : w - max(0, dx)]
                for d in np.flatnonzero(masks[:, j]):
                    out[d, max(0, dy) : h - max(0, -dy), max(0, dx) : w - max(0, -dx)] += masks[d, j] * moved
        return np.where(self.free & (out > 1e-300), out, 0.0)

    def back(self, a: np.ndarray, d: int, y: int, x: int, u: float) -> tuple[int, int, int] | None:
        """A predecessor ``(d, y, x)`` of a state, drawn by ``u`` in a fixed order."""
        if self.D == 1 and len(self.parts) == 1:
            return self._back_plain(a[0], y, x, u)
        weights_, states = [], []
        h, w = a.shape[1:]
        for own, shifts, weights, scale, masks, turn, _ in self.parts:
            py, px = y - shifts[:, 0], x - shifts[:, 1]
            inside = (py >= 0) & (py < h) & (px >= 0) & (px < w)
            j = np.flatnonzero(inside)
            j = j[own[py[j], px[j]] & (masks[d, j] > 0)]
            if not len(j):
                continue
            p = a[:, py[j], px[j]] * weights[turn][:, j] * scale[turn][:, py[j], px[j]] * masks[d, j]
            weights_.append(p.ravel())
            states += [(k, py[i], px[i]) for k in range(self.D) for i in j]
        if not states:
            return None
        total = np.cumsum(np.concatenate(weights_))
        if total[-1] <= 0:
            return None
        return states[min(int(np.searchsorted(total, u * total[-1], "right")), len(states) - 1)]


    def _back_plain(self, a: np.ndarray, y: int, x: int, u: float) -> tuple[int, int, int] | None:
        """The same for one class without directions: the kernel turned round over the cells about the state."""
        own, shifts, weights, scale, *_ = self.parts[0]
        h, w = a.shape
        side = math.isqrt(len(shifts))
        # predecessors go from the first shift's downwards
        py, px = y - int(shifts[0, 0]), x - int(shifts[0, 1])
        r0, c0 = max(0, py - h + 1), max(0, px - w + 1)
        r1, c1 = min(side, py + 1), min(side, px + 1)
        if r0 >= r1 or c0 >= c1:
            return None
        at = np.s_[py - r1 + 1 : py - r0 + 1, px - c1 + 1 : px - c0 + 1]
        p = (a[at] * scale[0][at] * own[at])[::-1, ::-1] * weights[0].reshape(side, side)[r0:r1, c0:c1]
        total = p.ravel().cumsum()
        if total[-1] <= 0:
            return None
        k = min(int(total.searchsorted(u * total[-1], "right")), len(total) - 1)
        return 0, py - r0 - k // (c1 - c0), px - c0 - k % (c1 - c0)


class _Table:
    """The moves to a point between all states ``(d, y, x)`` of a grid, numbered in row order, for many walks at once.

    The predecessors of a state stand in the order in which ``_Moves.back``
    takes them: by class, direction and offset.  In a small grid that is one
    order of all states for every target, and the weights are a matrix.
    """

    def __init__(self, moves: _Moves):
        D, (h, w) = moves.D, moves.free.shape
        self.n = D * h * w
        sources, targets, weights_, order = [], [], [], []
        for own, shifts, weights, scale, masks, turn, _ in moves.parts:
            # the offsets to a target rise as its sources fall
            y, x = (c[::-1] for c in np.nonzero(own))
            ty, tx = y[:, None] + shifts[:, 0], x[:, None] + shifts[:, 1]
            inside = (ty >= 0) & (ty < h) & (tx >= 0) & (tx < w)
            inside[inside] = moves.free[ty[inside], tx[inside]]
            i, j = np.nonzero(inside)
            source, target = (y * w + x)[i], (ty * w + tx)[i, j]
            for k in range(D):
                order.append(k * h * w + y * w + x)
                p = weights[turn[k], j] * scale[turn[k], y[i], x[i]]
                for d in range(D):
                    q = p * masks[d, j]
                    some = q > 0
                    sources.append(source[some] + k * h * w)
                    targets.append(target[some] + d * h * w)
                    weights_.append(q[some])
        source, target, weight = (np.concatenate(c) if c else np.zeros(0, t) for c, t in ((sources, int), (targets, int), (weights_, float)))
        self.matrix = self.n <= MATRIX_STATES
        if self.matrix:
            self.order = np.concatenate(order) if order else np.arange(self.n)
            place = np.argsort(self.order)
            self.weight = np.zeros((self.n, self.n))
            self.weight[target, place[source]] = weight
            self.bytes = self.weight.nbytes
            return
        by = np.argsort(target, kind="stable")
        self.flat_source, self.flat_weight = source[by], weight[by]
        count = np.bincount(target, minlength=self.n)
        self.filled = np.flatnonzero(count)
        first = np.concatenate([[0], np.cumsum(count)[:-1]])
        self.first = first[self.filled]
        width = max(1, int(count.max()))
        self.source, self.weight = np.zeros((self.n, width), np.int32), np.zeros((self.n, width))
        at = target[by], np.arange(len(by)) - np.repeat(first, count)
        self.source[at], self.weight[at] = self.flat_source, self.flat_weight
        self.bytes = self.source.nbytes + self.weight.nbytes + 16 * len(by)

    def forward(self, a: np.ndarray) -> np.ndarray:
        """Layers, one a row, moved on and divided by their sums."""
        if self.matrix:
            out = a[:, self.order] @ self.weight.T
        else:
            out = np.zeros_like(a)
            if len(self.filled):
                for row, layer in zip(out, a, strict=True):
                    row[self.filled] = np.add.reduceat(layer[self.flat_source] * self.flat_weight, self.first)
        out[out <= 1e-300] = 0.0
        total = out.sum(1, keepdims=True)
        return out / np.where(total > 0, total, 1.0)

    def back(self, layers: np.ndarray, row: np.ndarray, state: np.ndarray, u: np.ndarray, alike: np.ndarray | None = None) -> np.ndarray:
        """A predecessor of each state by the layer ``layers[row]`` before it; -1 where there is none.

        ``alike`` gives for each the place of one of the same row and state; they share their sums.
        """
        out = np.empty(len(state), int)
        one = np.arange(len(state)) if alike is None else np.flatnonzero(alike == np.arange(len(state)))
        number = np.empty(len(state), int)
        number[one] = np.arange(len(one))
        mine = number if alike is None else number[alike]
        width = self.weight.shape[1]
        # one less than a power of two, so that a search by halves stays inside
        wide = (1 << width.bit_length()) - 1
        block = max(1, (2 << 20) // (8 * wide))
        for b in range(0, len(one), block):
            r, s = row[one[b : b + block]], state[one[b : b + block]]
            p = self.weight[s]
            p *= layers[r][:, self.order] if self.matrix else layers[r[:, None], self.source[s]]
            sums = np.full((len(s), wide), np.inf)
            np.cumsum(p, 1, out=sums[:, :width])
            flat, total = sums.ravel(), sums[:, width - 1].copy()
            if len(one) <= block:
                which, m, v, of = slice(None), mine, u, state
            else:
                which = np.flatnonzero((mine >= b) & (mine < b + block))
                m, v, of = mine[which] - b, u[which], state[which]
            full = total[m]
            # how many sums are not above it
            v, k, at = v * full, np.zeros(len(m), int), m * wide - 1
            step = (wide + 1) >> 1
            while step:
                k += step * (flat[at + (k + step)] <= v)
                step >>= 1
            beyond = np.flatnonzero(k >= width)
            if len(beyond):
                k[beyond] = np.minimum((sums[m[beyond], :width] < full[beyond, None]).sum(1), width - 1)
            found = self.order[k] if self.matrix else self.source[of, k]
            out[which] = np.where(full > 0, found, -1)
        return out


class _Tables:
    """The tables of a task, by grid, directions and label; those not used for longest go first."""

    def __init__(self, field_of):
        self.field_of, self.kept = field_of, OrderedDict()

    def __call__(self, size: tuple[int, int], D: int, first, label) -> _Table:
        key = size, D, label
        if key not in self.kept:
            field = self.field_of.field(size, first, label)
            self.kept[key] = _Table(_Moves(field, 1, (0, size[0], 0, size[1])))
            while len(self.kept) > 1 and sum(t.bytes for t in self.kept.values()) > TABLE_MEMORY:
                self.kept.popitem(last=False)
        self.kept.move_to_end(key)
        return self.kept[key]


def walk_many(
    tables: _Tables, size: tuple[int, int], D: int, first, start: np.ndarray, end: np.ndarray, T: np.ndarray, labels: np.ndarray | None,
    heads: _Keys | list[bytes], end_direction: int | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """``walk`` for many segments of one grid, from cell to cell ``y * width + x``: ``[segment, t]`` cells, and whether each end was reached.

    ``labels[segment, t]`` name the moves to point ``t``; without them all
    points have the same, and segments of one start share their layers.
    ``heads`` are the texts of the segments' keys without the bracket at the end.
    """
    keys = heads if isinstance(heads, _Keys) else _Keys(pa.array(heads, pa.large_binary()))
    cells = size[0] * size[1]
    n, N = D * cells, len(T)
    path = np.full((N, int(T.max())), -1, np.int32)
    reached = np.zeros(N, bool)
    line, lineage = np.unique(start, return_inverse=True) if labels is None else (start, np.arange(N))
    points = np.zeros(len(line), int)
    np.maximum.at(points, lineage, T)
    piece = (np.cumsum(points) - 1) // max(1, TABLE_MEMORY // (8 * n))
    for one in np.unique(piece).tolist():
        lines, mine = np.flatnonzero(piece == one), np.flatnonzero(piece[lineage] == one)
        if labels is None:
            # those with a move to a point come first
            mine = mine[np.argsort(-T[mine], kind="stable")]
        base = np.zeros(len(line), int)
        base[lines] = np.cumsum(points[lines]) - points[lines]
        layers = np.zeros((int(points[lines].sum()), n))
        for d in range(D):
            layers[base[lines], d * cells + line[lines]] = 1 / D
        # a table at a time: all lines whose next point has its label move on, as far as it goes
        t, live = np.ones(len(lines), int), np.flatnonzero(points[lines] > 1)
        while len(live):
            label = np.zeros(len(live), int) if labels is None else labels[lines[live], t[live]]
            now = int(label.min())
            which, table = live[label == now], tables(size, D, first, now)
            while len(which):
                at = base[lines[which]] + t[which]
                layers[at] = table.forward(layers[at - 1])
                t[which] += 1
                which = which[t[which] < points[lines[which]]]
                if labels is not None:
                    which = which[labels[lines[which], t[which]] == now]
            live = live[t[live] < points[lines[live]]]
        base, t = base[lineage[mine]], T[mine] - 1
        last = layers[(base + t)[:, None], np.arange(D) * cells + end[mine, None]]
        u = keys.uniforms(mine, "d") if D > 1 else np.zeros(len(mine))
        d = np.minimum((np.cumsum(last, 1) <= (u * last.sum(1))[:, None]).sum(1), D - 1)
        if end_direction is not None:
            d = np.where(last[:, end_direction % D] > 0, end_direction % D, d)
        state = np.where(last.sum(1) > 0, d * cells + end[mine], -1)
        path[mine, t] = end[mine]
        if labels is None:
            _back_alike(tables, size, D, first, layers, base, lineage[mine] - lines[0], len(lines), t, state, keys, mine, path)
            reached[mine] = state >= 0
            continue
        live = np.flatnonzero((state >= 0) & (t > 0))
        while len(live):
            label = labels[mine[live], t[live]]
            now = int(label.max())
            which, table = live[label == now], tables(size, D, first, now)
            while len(which):
                v = keys.uniforms(mine[which], t[which])
                state[which] = table.back(layers, base[which] + t[which] - 1, state[which], v)
                t[which] -= 1
                path[mine[which], t[which]] = state[which] % cells
                which = which[(t[which] > 0) & (state[which] >= 0)]
                which = which[labels[mine[which], t[which]] == now]
            live = live[(t[live] > 0) & (state[live] >= 0)]
        reached[mine] = state >= 0
    return path, reached


def _back_alike(
    tables: _Tables, size: tuple[int, int], D: int, first, layers: np.ndarray, base: np.ndarray, line: np.ndarray, lines: int, last: np.ndarray,
    state: np.ndarray, keys: _Keys, mine: np.ndarray, path: np.ndarray,
) -> None:
    """The way back of walks ``mine`` by one table, longest first and point by point, so that those of one start meet; ``state`` and ``path`` are filled."""
    cells, n = size[0] * size[1], D * size[0] * size[1]
    by = np.full((int(last[0]), len(mine)), -1, np.int32)
    place = np.empty(lines * n, int)
    for t in range(int(last[0]), 0, -1):
        which = np.arange(np.searchsorted(-last, -t, "right"))
        if (state[which] < 0).any():
            which = which[state[which] >= 0]
        code = line[which] * n + state[which]
        # any of those alike stands for all
        place[code] = np.arange(len(which))
        state[which] = tables(size, D, first, 0).back(layers, base[which] + t - 1, state[which], keys.uniforms(mine[which], t), place[code])
        by[t - 1, which] = np.where(state[which] >= 0, state[which] % cells, -1)
    inside = np.arange(len(by)) < last[:, None]
    rows = path[mine]
    rows[:, : len(by)][inside] = by.T[inside]
    path[mine] = rows


def _box(field: Field, start: tuple[int, int], end: tuple[int, int], T: int) -> tuple[int, int, int, int]:
    reach = 0
    for t in range(1, T) if not field.still else (1,):
        bx, by = field.shift(t)
        reach = max(reach, max(k.shape[1] // 2 for k in field.kernels_at(t)) + max(abs(bx), abs(by)))
    far = reach * (T - 1)
    low = [max(0, start[i] - far, end[i] - far) for i in (0, 1)]
    high = [min(n, start[i] + far + 1, end[i] + far + 1) for i, n in ((0, field.width), (1, field.height))]
    return low[0], max(high[0], low[0]), low[1], max(high[1], low[1])


def walk(field: Field, start: tuple[int, int], end: tuple[int, int], T: int, key: tuple = (0,), end_direction: int | None = None) -> list[tuple[int, int]] | None:
    """``T`` cells from ``start`` to ``end``; None if the end can't be reached."""
    check_arguments(field.width, field.height, T, cells=(start, end))
    if field.open is not None and not (field.open[start[1], start[0]] and field.open[end[1], end[0]]):
        return None
    if T == 1:
        return [start] if start == end else None
    x0, x1, y0, y1 = box = _box(field, start, end, T)
    if not (x0 <= start[0] < x1 and y0 <= start[1] < y1 and x0 <= end[0] < x1 and y0 <= end[1] < y1):
        return None
    moves: dict[int, _Moves] = {}

    def to(t: int) -> _Moves:
        if field.still:
            if box not in field.made:
                if len(field.made) >= 32:
                    field.made.clear()
                field.made[box] = _Moves(field, 1, box)
            return field.made[box]
        k = t
        if k not in moves:
            if len(moves) > 8:
                moves.clear()
            moves[k] = _Moves(field, k, box)
        return moves[k]

    def step(a: np.ndarray, t: int) -> np.ndarray:
        a = to(t).forward(a)
        total = a.sum()  # a factor for each layer cancels in the walk
        return a / total if total > 0 else a

    first = np.zeros((field.D, y1 - y0, x1 - x0))
    first[:, start[1] - y0, start[0] - x0] = 1 / field.D
    every = max(1, math.ceil(math.sqrt(T))) if first.nbytes * T > MEMORY else 1
    kept, a = {0: first}, first
    for t in range(1, T):
        a = step(a, t)
        if t % every == 0 or t == T - 1:
            kept[t] = a
    y, x = end[1] - y0, end[0] - x0
    here = kept[T - 1][:, y, x]
    if here.sum() <= 0:
        return None
    if end_direction is not None and here[end_direction % field.D] > 0:
        d = end_direction % field.D
    else:
        d = min(int(np.searchsorted(np.cumsum(here), uniform(*key, "d") * here.sum(), "right")), field.D - 1)
    path, block = [end], {}
    for t in range(T - 1, 0, -1):
        if t - 1 not in kept and t - 1 not in block:
            s = (t - 1) // every * every
            block, a = {}, kept[s]
            for r in range(s + 1, t):
                a = step(a, r)
                block[r] = a
        layer = kept[t - 1] if t - 1 in kept else block[t - 1]
        found = to(t).back(layer, d, y, x, uniform(*key, t))
        if found is None:
            return None
        d, y, x = found
        path.append((int(x) + x0, int(y) + y0))
    return path[::-1]


def brownian_field(width: int, height: int, S: int = 3, kernel: np.ndarray | None = None) -> Field:
    check_arguments(width, height, 1, S)
    return Field(width, height, [(kernels_of(KernelParams(S=S))[0] if kernel is None else kernel)[None]])


def correlated_field(width: int, height: int, D: int = 4, S: int = 3, kernels: np.ndarray | None = None) -> Field:
    check_arguments(width, height, 1, S, D)
    return Field(width, height, [kernels_of(KernelParams(False, S, D)) if kernels is None else kernels])


def biased_field(width: int, height: int, biases: list, S: int = 7, kernel: np.ndarray | None = None, rotation: bool = False) -> Field:
    """A bias for each point: ``(x, y)`` offsets of the kernel's centre, or degrees to turn it by; T is their number."""
    from trailweave.functions.kernels import rotate

    base = brownian_field(width, height, S, kernel).kernels[0]
    if not rotation and any(len(b) != 2 for b in biases):
        raise ValueError("an offset has an x and a y")
    if rotation:
        return Field(width, height, [base], still=False, at=lambda t: [rotate(base[0], float(biases[t]))[None]])
    return Field(width, height, [base], shift=lambda t: (int(biases[t][0]), int(biases[t][1])), still=False)


def terrain_field(
    terrain: np.ndarray, mapping: dict[int, KernelParams], kappa: float = 2.0, renormalise: bool = True, kernels: dict[int, np.ndarray] | None = None,
    biases: list | None = None,
) -> Field:
    """Kernels by landcover class; a class outside the mapping is forbidden.

    ``kernels`` are the user's own sets for some classes; ``biases`` move the
    kernels' centre, ``(x, y)`` for each point.
    """
    order = sorted(mapping)
    index = np.searchsorted(order, terrain)
    index = np.minimum(index, len(order) - 1)
    known = np.array(order)[index] == terrain
    free = known & ~np.array([mapping[c].forbidden for c in order])[index]
    own = [np.asarray(kernels[c], float) if kernels and c in kernels else kernels_of(mapping[c], kappa) for c in order]
    if biases is None:
        return Field(terrain.shape[1], terrain.shape[0], own, lambda t: index, free, renormalise=renormalise)
    shift = lambda t: (int(biases[t][0]), int(biases[t][1]))
    return Field(terrain.shape[1], terrain.shape[0], own, lambda t: index, free, shift, still=False, renormalise=renormalise)


def layers(field: Field, start: tuple[int, int], T: int) -> Iterator[tuple[int, int, int, int, float]]:
    """``(t, d, x, y, p)``: the forward probabilities from ``start``, point by point, two layers in memory."""
    check_arguments(field.width, field.height, T, cells=(start,))
    a = np.zeros((field.D, field.height, field.width))
    a[:, start[1], start[0]] = 1 / field.D
    box, moves = (0, field.width, 0, field.height), None
    for t in range(T):
        if t:
            moves = moves if moves is not None and field.still else _Moves(field, t, box)
            a = moves.forward(a)
        for d, y, x in zip(*(c.tolist() for c in np.nonzero(a)), strict=True):
            yield t, d, x, y, float(a[d, y, x])


def layer_tables(starts: DataFrame, field_of: Callable[[dict], Field]) -> DataFrame:
    """``(animal_id, seg, t, d, x, y, p)``: the forward probabilities of each row ``(animal_id, seg, x0, y0, T)``; written with ``sinks.writers.layers``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                rows = layers(field_of(row), (int(row["x0"]), int(row["y0"])), int(row["T"]))
                while part := list(islice(rows, 50_000)):
                    yield pd.DataFrame([(row["animal_id"], row["seg"], *r) for r in part], columns=["animal_id", "seg", "t", "d", "x", "y", "p"])

    return starts.mapInPandas(run, "animal_id string, seg int, t int, d int, x int, y int, p double")


def straight_line(start: tuple[int, int], end: tuple[int, int]) -> list[tuple[int, int]]:
    return [start, end]


def terrain_array(terrain: DataFrame) -> np.ndarray:
    """A terrain table ``(x, y, cls)`` as an array; its size is checked first."""
    w, h = terrain.agg(F.max("x") + 1, F.max("y") + 1).first()
    if w is None:
        raise ValueError("the terrain is empty")
    if w * h > TERRAIN_CELLS:
        raise ValueError(f"a terrain of {w} x {h} cells is too large to broadcast; use terrain_bridge, which cuts it by segment")
    rows = terrain.select("x", "y", "cls").toArrow()
    out = np.zeros((h, w), np.int64)
    out[rows["y"].to_numpy(), rows["x"].to_numpy()] = rows["cls"].to_numpy()
    return out


def bridge(segments: DataFrame, field_of: Callable[[dict], Field], seed: int = 0, fallback: bool = False, end_direction: int | None = None) -> DataFrame:
    """``(animal_id, seg, t, x, y, status)`` for each segment ``(animal_id, seg, x0, y0, x1, y1, T, ...)``.

    ``field_of`` makes the field of a segment's row.  A segment without
    length gives its point once.  One whose end can't be reached gives a row
    of status UNREACHABLE without a cell, or its two ends if ``fallback``.
    Segments are dealt evenly, since their costs differ widely.  Where
    ``field_of`` shares its moves between rows (``walks.ByGrid``, ``ByHour``)
    those alike are dealt together and drawn many at a time.
    """
    if hasattr(field_of, "field"):
        return _bridge_shared(segments, field_of, seed, fallback, end_direction)
    columns = ["animal_id", "seg", "t", "x", "y", "status"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                start, end = (int(row["x0"]), int(row["y0"])), (int(row["x1"]), int(row["y1"]))
                status = OK
                if start == end and row["T"] <= 1:
                    path = [start]
                else:
                    path = walk(field_of(row), start, end, int(row["T"]), (seed, row["animal_id"], int(row["seg"])), end_direction)
                if path is None:
                    status = FALLBACK if fallback else UNREACHABLE
                    path = straight_line(start, end) if fallback else []
                rows = [(row["animal_id"], row["seg"], t, x, y, status) for t, (x, y) in enumerate(path)]
                out += rows or [(row["animal_id"], row["seg"], None, None, None, status)]
                if len(out) >= 20_000:
                    yield pd.DataFrame(out, columns=columns).astype({"t": "Int32", "x": "Int32", "y": "Int32"})
                    out = []
            yield pd.DataFrame(out, columns=columns).astype({"t": "Int32", "x": "Int32", "y": "Int32"})

    n = max(segments.sparkSession.sparkContext.defaultParallelism, 1) * 4
    return segments.repartition(n, F.xxhash64("animal_id", "seg")).mapInPandas(run, WALK)


def _bridge_shared(segments: DataFrame, field_of, seed: int, fallback: bool, end_direction: int | None) -> DataFrame:
    """``bridge`` with a ``field_of`` whose rows of one ``width, height`` move by the same tables."""

    def paths(batch: pa.RecordBatch, tables: _Tables) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How many points each row has (0: the end can't be reached), and the cells ``x`` and ``y`` of all points, row by row."""
        names = ["width", "height", "x0", "y0", "x1", "y1", "T"]
        width, height, x0, y0, x1, y1, T = (batch.column(c).to_numpy(zero_copy_only=False).astype(int) for c in names)
        still = (x0 == x1) & (y0 == y1) & (T <= 1)
        count, found = still.astype(int), []
        bad = ~still & ((T <= 0) | (np.minimum(np.minimum(x0, x1), np.minimum(y0, y1)) < 0) | (np.maximum(x0, x1) >= width) | (np.maximum(y0, y1) >= height))
        for i in np.flatnonzero(bad):
            check_arguments(int(width[i]), int(height[i]), int(T[i]), cells=((x0[i], y0[i]), (x1[i], y1[i])))
        move = np.flatnonzero(~still & (T > 1))
        labels = field_of.labels(batch)
        first = np.zeros(len(T), int) if labels is None else labels[:, 0]
        keys = _Keys.of(seed, batch.column("animal_id"), batch.column("seg"))
        kind = pd.factorize(width[move] << 32 | height[move])[0]
        kind = pd.factorize(kind << 40 | (first[move] - first.min(initial=0)))[0]
        kinds: dict[tuple, list[int]] = {}
        for k, i in enumerate(move[np.unique(kind, return_index=True)[1]].tolist()):
            size = int(width[i]), int(height[i])
            kinds.setdefault((size, field_of.directions(size, int(first[i]))), []).append(k)
        for (size, D), some in kinds.items():
            rows = move[np.isin(kind, some)]
            if D * size[0] * size[1] > TABLE_STATES:
                table = batch.take(pa.array(rows)).to_pandas().to_dict("records")
                for i, r in zip(rows.tolist(), table, strict=True):
                    path = walk(field_of(r), (int(x0[i]), int(y0[i])), (int(x1[i]), int(y1[i])), int(T[i]), (seed, r["animal_id"], int(r["seg"])), end_direction)
                    if path is not None:
                        count[i] = len(path)
                        found.append((np.array([i]), np.array([[x + y * size[0] for x, y in path]]), size[0]))
                continue
            one = int(first[rows[0]])
            is_open = field_of.field(size, one, one).open
            if is_open is not None:
                rows = rows[is_open[y0[rows], x0[rows]] & is_open[y1[rows], x1[rows]]]
            if not len(rows):
                continue
            part = None if labels is None else labels[rows]
            start, end = y0[rows] * size[0] + x0[rows], y1[rows] * size[0] + x1[rows]
            cells, reached = walk_many(tables, size, D, one, start, end, T[rows], part, keys.take(rows), end_direction)
            count[rows[reached]] = T[rows[reached]]
            found.append((rows[reached], cells[reached], size[0]))
        place = np.cumsum(count) - count
        x, y = (np.empty(int(count.sum()), np.int32) for _ in "xy")
        x[place[still]], y[place[still]] = x0[still], y0[still]
        for rows, cells, wide in found:
            t = np.arange(cells.shape[1])
            inside = t < count[rows, None]
            at, cells = (place[rows, None] + t)[inside], cells[inside]
            x[at], y[at] = cells % wide, cells // wide
        return count, x, y

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows enough to share layers, as few as ``POINTS`` allows where walks are long."""
        kept: list[pa.RecordBatch] = []

        def cut(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            n = part.num_rows
            if n > 1 and n * (pc.max(part.column("T")).as_py() or 1) > POINTS:
                yield from cut(part.slice(0, n // 2))
                yield from cut(part.slice(n // 2))
            elif n:
                yield part

        for batch in batches:
            kept.append(batch)
            if sum(b.num_rows for b in kept) >= ROWS:
                yield from cut(pa.concat_batches(kept))
                kept = []
        if kept:
            yield from cut(pa.concat_batches(kept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, kinds = _Tables(field_of), pa.array([OK, FALLBACK, UNREACHABLE])
        for part in pieces(batches):
            count, x, y = paths(part, tables)
            status = np.where(count > 0, 0, 1 if fallback else 2)
            if fallback and status.any():
                lost = np.flatnonzero(status)
                at = np.repeat((np.cumsum(count) - count)[lost], 2)
                ends = (np.stack([part.column(f"{c}{k}").to_numpy(zero_copy_only=False)[lost] for k in "01"], 1).ravel() for c in "xy")
                x, y = (np.insert(v, at, e) for v, e in zip((x, y), ends, strict=True))
                count[lost] = 2
            cells = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), pa.array(x.astype(np.int64) << 32 | y))
            columns = [part.column("animal_id"), part.column("seg"), kinds.take(pa.array(status)), cells]
            yield pa.RecordBatch.from_arrays(columns, ["animal_id", "seg", "status", "cells"])

    n = max(segments.sparkSession.sparkContext.defaultParallelism, 1) * 4
    each = F.xxhash64("animal_id", "seg")
    order = ["width", "height", *field_of.order, each]
    if field_of.scattered:
        # one number to sample and to sort by: those of one start stand together, in no order otherwise
        start = F.hash("width", "height", *field_of.order).cast("long")
        order = [F.shiftleft(start, 32).bitwiseOR(F.shiftrightunsigned(each, 32))]
    # what a walk needs is dealt, no more
    segments = segments.select(*dict.fromkeys(["animal_id", "seg", "x0", "y0", "x1", "y1", "T", "width", "height", *field_of.order]))
    walks = segments.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(run, "animal_id string, seg int, status string, cells array<bigint>")
    # a row of status UNREACHABLE has no cells and stays
    points = walks.select("animal_id", "seg", F.posexplode_outer("cells").alias("t", "cell"), "status")
    return points.select("animal_id", "seg", "t", F.shiftright("cell", 32).cast("int").alias("x"), F.expr("cast(cell & 4294967295 as int)").alias("y"), "status")


def terrain_bridge(segments: DataFrame, terrain: DataFrame, mapping: dict[int, KernelParams], seed: int = 0, fallback: bool = False) -> DataFrame:
    """``bridge`` through a terrain table ``(x, y, cls)`` of any size: each segment is joined with the cells that its walk can reach.

    A segment reaches its two ends and the steps of its points beyond them;
    cells outside that box change no bridge, but for the renormalisation of
    moves at the box's rim, which a margin of one step covers.  Cells are
    dealt in tiles, so that this is an equi-join.
    """
    tile = 64
    step = max(p.S for p in mapping.values())
    reach = F.lit(step) * F.col("T")
    box = segments.select(
        "*", *(F.greatest(F.lit(0), F.least(f"{c}0", f"{c}1") - reach).cast("int").alias(f"{c}_lo") for c in "xy"),
        *((F.greatest(f"{c}0", f"{c}1") + reach).cast("int").alias(f"{c}_hi") for c in "xy"),
    )
    size = terrain.agg(F.max("x").alias("w"), F.max("y").alias("h")).first()
    if size["w"] is None:
        raise ValueError("the terrain is empty")
    box = box.withColumns({"x_hi": F.least("x_hi", F.lit(size["w"])), "y_hi": F.least("y_hi", F.lit(size["h"]))})
    tiles = lambda c: F.explode(F.sequence(F.floor(F.col(f"{c}_lo") / tile), F.greatest(F.floor(F.col(f"{c}_lo") / tile), F.floor(F.col(f"{c}_hi") / tile))))
    wanted = box.withColumn("tx", tiles("x")).withColumn("ty", tiles("y"))
    packed = terrain.groupBy(F.floor(F.col("x") / tile).alias("tx"), F.floor(F.col("y") / tile).alias("ty")).agg(F.collect_list(F.struct("x", "y", "cls")).alias("cells"))
    keys = segments.columns

    def run(table: pd.DataFrame) -> pd.DataFrame:
        row = table.iloc[0].to_dict()
        x0, y0 = int(row["x_lo"]), int(row["y_lo"])
        grid = np.full((int(row["y_hi"]) - y0 + 1, int(row["x_hi"]) - x0 + 1), -1, np.int64)
        for cells in table["cells"]:
            for c in cells if cells is not None else ():
                if y0 <= c["y"] <= row["y_hi"] and x0 <= c["x"] <= row["x_hi"]:
                    grid[c["y"] - y0, c["x"] - x0] = c["cls"]
        start, end = (int(row["x0"]) - x0, int(row["y0"]) - y0), (int(row["x1"]) - x0, int(row["y1"]) - y0)
        path = [start] if start == end and row["T"] <= 1 else walk(terrain_field(grid, mapping), start, end, int(row["T"]), (seed, row["animal_id"], int(row["seg"])))
        status = OK if path is not None else FALLBACK if fallback else UNREACHABLE
        path = path if path is not None else straight_line(start, end) if fallback else []
        out = [(row["animal_id"], row["seg"], t, x + x0, y + y0, status) for t, (x, y) in enumerate(path)] or [(row["animal_id"], row["seg"], None, None, None, status)]
        return pd.DataFrame(out, columns=["animal_id", "seg", "t", "x", "y", "status"]).astype({"t": "Int32", "x": "Int32", "y": "Int32"})

    return wanted.join(packed, ["tx", "ty"], "left").groupBy(*(k for k in keys if k in ("animal_id", "seg"))).applyInPandas(run, WALK)
