"""External induced sorting of the suffixes of a byte string, with common-prefix values.

Suffixes are typed L or S by comparison with their successor; S suffixes after an L one
(S*) are sorted first, by names of the substrings between them and recursive renaming of
name pairs. Two induction passes then carry (position, common prefix) tuples through
priority queues: a queue is keyed by first byte and order of arrival, hands out whole
batches of its smallest key, and keeps the tuples beyond a memory bound in a file of the
task's own scratch space. Common-prefix values are carried as minima over the sequence of
inducing suffixes, capped at the depth asked for; order beyond the depth is not defined.
"""

from __future__ import annotations

import sys
import tempfile

import numpy as np

from prismatica.llm.common import ship

ship(sys.modules[__name__])

class ByteQueue:
    """Monotone priority queue of suffix tuples, keyed by (first byte, arrival)."""

    def __init__(self, held: int):
        self.bound, self.held, self.file = held, 0, None
        self.runs: dict[int, list] = {}

    def push(self, byte: int, at: np.ndarray, lcp: np.ndarray) -> None:
        self.runs.setdefault(byte, []).append((at, lcp))
        self.held += len(at)
        if self.held > self.bound:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        for runs in self.runs.values():
            for i, (at, lcp) in enumerate(runs):
                if lcp is not None:
                    runs[i] = (self.file.seek(0, 2), len(at)), None
                    self.file.write(at.tobytes())
                    self.file.write(lcp.tobytes())
        self.held = 0

    def pop(self, byte: int) -> tuple[np.ndarray, np.ndarray] | None:
        """All tuples of this byte that have arrived so far, in order."""
        runs = self.runs.pop(byte, None)
        if not runs:
            return None
        for i, (at, lcp) in enumerate(runs):
            if lcp is None:
                self.file.seek(at[0])
                runs[i] = np.frombuffer(self.file.read(at[1] * 8), np.int64), np.frombuffer(self.file.read(at[1] * 2), np.uint16)
            else:
                self.held -= len(at)
        return np.concatenate([at for at, _ in runs]), np.concatenate([lcp for _, lcp in runs])

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def _words(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eight bytes from each position as one big-endian number; ``text`` is padded."""
    return np.ndarray((len(text) - 7,), "<u8", text, strides=(1,))[at].byteswap()


def _ranked(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Dense ranks of the pairs, from 1."""
    if int(second.max()) < 1 << 32 and int(first.max()) < 1 << 31:
        pair = (first.astype(np.uint64) << np.uint64(32)) | second.astype(np.uint64)
    elif int(first.max()) == 0:
        pair = second
    else:
        return _ranked(first, _ranked(np.zeros(len(first), np.int64), second))
    order = np.argsort(pair)
    there = pair[order]
    new = np.ones(len(order), np.int64)
    new[1:] = there[1:] != there[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def _common(text: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix of the suffixes at a[i] and b[i], up to ``depth``; ``text`` is padded."""
    out = np.zeros(len(a), np.uint16)
    alive = np.arange(len(a))
    for step in range(0, depth, 8):
        x = _words(text, a[alive] + step) ^ _words(text, b[alive] + step)
        differs = x != 0
        lead = np.zeros(len(x), np.uint16)
        if differs.any():
            d, n = x[differs], np.zeros(int(differs.sum()), np.uint16)
            for bits in (32, 16, 8):
                low = (d >> np.uint64(64 - bits)) == 0
                n[low] += bits // 8
                d = np.where(low, d << np.uint64(bits), d)
            lead[differs] = n
        lead[~differs] = 8
        out[alive] += lead
        alive = alive[~differs]
        if not len(alive):
            break
    return np.minimum(out, depth)


def _sorted_stars(text: np.ndarray, stars: np.ndarray, depth: int) -> np.ndarray:
    """S* positions in suffix order up to ``depth`` bytes: names, then pairs of names."""
    n = len(stars)
    ends = np.append(stars[1:], stars[-1])
    length = np.minimum(ends - stars + 1, depth + 8)
    names = np.zeros(n, np.int64)
    for step in range(0, int(length.max()), 8):
        active = np.flatnonzero(length > step)
        w = np.full(n, np.uint64(0xFFFFFFFFFFFFFFFF))
        kept = np.minimum(length[active] - step, 8).astype(np.uint64)
        pad = np.where(kept == 8, np.uint64(0), np.uint64(0xFFFFFFFFFFFFFFFF) >> (kept * np.uint64(8) & np.uint64(63)))
        w[active] = _words(text, stars[active] + step) | pad
        names = _ranked(names, w)
    names[-1] = 0  # the end of the text is the smallest suffix
    names = np.append(0, np.cumsum(np.bincount(names)))[names]  # places of the groups of equal names
    cover, hop = np.append(np.diff(stars), depth), 1
    while True:
        shared = np.flatnonzero((np.bincount(names, minlength=n) > 1)[names])
        if not len(shared) or int(cover[shared].min()) >= depth:
            return stars[np.argsort(names)]
        padded = np.append(names, np.zeros(hop, np.int64))
        pair = (names[shared].astype(np.uint64) << np.uint64(32)) | padded[shared + hop].astype(np.uint64)
        order = np.argsort(pair)
        pair = pair[order]
        place = np.arange(len(order))
        group = pair >> np.uint64(32)
        new = np.append(True, pair[1:] != pair[:-1])
        first = np.append(True, group[1:] != group[:-1])
        start = place[new][np.cumsum(new) - 1] - place[first][np.cumsum(first) - 1]
        names[shared[order]] += start
        cover = np.minimum(cover + np.append(cover[hop:], np.full(min(hop, n), depth)), depth)
        hop *= 2


class _Spread:
    """Hands the predecessors of a processed sequence to their queues, with common prefixes."""

    def __init__(self, text: np.ndarray, wanted: np.ndarray, queue: ByteQueue, depth: int):
        self.text, self.wanted, self.queue, self.depth = text, wanted, queue, depth
        self.low = np.zeros(256, np.uint16)  # minimum since the last push to each byte

    def take(self, at: np.ndarray, lcp: np.ndarray) -> None:
        before = at - 1
        chosen = np.flatnonzero((before >= 0) & self.wanted[before])
        byte = self.text[before[chosen]]
        by = np.argsort(byte, kind="stable")
        byte, chosen = byte[by], chosen[by]
        edges = np.flatnonzero(np.append(True, byte[1:] != byte[:-1])) if len(byte) else []
        running = np.minimum(self.low, lcp.min())
        for start, end in zip(edges, [*edges[1:], len(byte)]):
            c, index = int(byte[start]), chosen[start:end]
            starts = np.append(0, index[:-1] + 1)
            least = np.minimum.reduceat(lcp[:index[-1] + 1], starts)
            least[0] = min(least[0], self.low[c])
            self.queue.push(c, before[index], np.minimum(least + 1, self.depth))
            rest = lcp[index[-1] + 1:]
            running[c] = rest.min() if len(rest) else self.depth
        self.low = running


def sorted_suffixes(raw: bytes, depth: int, held: int = 4_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Positions in suffix order up to ``depth`` bytes, and each one's common prefix with the
    one before it (0 for the first), capped at ``depth``. At most ``held`` tuples of a queue
    are in memory. An empty string gives empty arrays."""
    n = len(raw)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.uint16)
    text = np.frombuffer(raw + bytes(depth + 16), np.uint8)
    body = text[:n]
    nxt = np.empty(n, np.int16)
    nxt[:-1], nxt[-1] = body[1:], -1
    sign = np.sign(nxt - body.astype(np.int16)).astype(np.int8)
    change = np.flatnonzero(sign)
    run_end = change[np.searchsorted(change, np.arange(n))]  # last position of the run of equal bytes
    small = sign[run_end] > 0  # S type; the last position is L, before the end of the text
    run = np.minimum(run_end - np.arange(n) + 1, depth).astype(np.uint16)
    star = np.zeros(n, bool)
    star[1:] = small[1:] & ~small[:-1]
    stars = np.flatnonzero(star)
    if len(stars):
        # the end of the text stands after all S* as one more, smaller than every other
        stars = _sorted_stars(text, np.append(stars, n), depth)[1:]
        seeds = np.zeros(len(stars), np.uint16)
        seeds[1:] = _common(text, stars[:-1], stars[1:], depth)
    else:
        seeds = np.empty(0, np.uint16)
    bytes_of_stars = body[stars]
    cuts = np.searchsorted(bytes_of_stars, np.arange(257))

    def joint(prev: int | None, at: int, byte: int) -> int:
        return 0 if prev is None or body[prev] != byte else int(min(run[prev], run[at]))

    queue = ByteQueue(held)
    spread = _Spread(body, ~small, queue, depth)
    larger: dict[int, list] = {}
    spread.low[:] = 0
    queue.push(int(body[n - 1]), np.array([n - 1]), np.zeros(1, np.uint16))  # induced by the end of the text
    for c in range(256):
        last = None
        while (items := queue.pop(c)) is not None:
            at, lcp = items
            if last is None:
                lcp[0] = 0
            larger.setdefault(c, []).append((at, lcp))
            spread.take(at, lcp)
            last = int(at[-1])
        if cuts[c] < cuts[c + 1]:
            at, lcp = stars[cuts[c]:cuts[c + 1]], seeds[cuts[c]:cuts[c + 1]].copy()
            lcp[0] = joint(last, int(at[0]), c)
            spread.take(at, lcp)
    queue.close()

    queue = ByteQueue(held)
    spread = _Spread(body, small, queue, depth)
    parts_at, parts_lcp = [], []
    for c in range(255, -1, -1):
        done: list = []
        last = None
        while (items := queue.pop(c)) is not None:
            at, lcp = items
            if last is None:
                lcp[0] = 0
            done.append((at, lcp))
            spread.take(at, lcp)
            last = int(at[-1])
        if c in larger:
            at = np.concatenate([x for x, _ in larger[c]])[::-1]
            up = np.concatenate([x for _, x in larger[c]])[::-1]  # with the next smaller one
            lcp = np.append(np.uint16(joint(last, int(at[0]), c)), up[:-1])
            done.append((at, lcp))
            spread.take(at, lcp)
        if done:
            parts_at.append(np.concatenate([x for x, _ in done]))
            parts_lcp.append(np.concatenate([x for _, x in done]))
    queue.close()
    down, with_next = np.concatenate(parts_at), np.concatenate(parts_lcp)
    lcp = np.append(with_next[1:], np.uint16(0))[::-1]  # of each with the one before it
    return down[::-1], lcp
