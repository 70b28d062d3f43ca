"""Words of many texts at once, as 64-bit hashes, by numpy."""

from __future__ import annotations

import re

import numpy as np
import xxhash

#: Bytes that are worked on at once; bytes of a word up to which it is hashed by the polynomial.
TOGETHER, LONG = 1 << 20, 64
_SPACES = [32, *range(9, 14)]
_P, _LENGTH = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_AFTER = re.compile(rb"[\x20\x09-\x0D]")


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of an odd number, and of its inverse, modulo 2**64."""
    one = lambda x: np.multiply.accumulate(np.full(n, x, np.uint64))
    return one(_P), one(pow(_P, -1, 1 << 64))


def parts(raw: bytes) -> list[bytes]:
    """raw in parts of about TOGETHER bytes that begin at white space."""
    out, at = [], 0
    while at < len(raw):
        to = at + TOGETHER
        if to < len(raw):
            found = _AFTER.search(raw, to)
            to = found.start() if found else len(raw)
        out.append(raw[at:to])
        at = to
    return out


class Words:
    """Hashes of the words of texts, A-Z lower-cased unless told otherwise."""

    def __init__(self, lower: bool = True):
        self.space = np.zeros(256, bool)
        self.space[_SPACES] = True
        self.low = np.arange(256, dtype=np.uint8)
        if lower:
            self.low[65:91] += 32
        self.powers = powers(2 * TOGETHER)

    def of(self, texts: list[str | bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, first three bytes as one number) of each word in order, and the number of words of each text."""
        hashes, heads, counts, held, total = [], [], [], [], 0

        def flush() -> None:
            nonlocal held, total
            if held:
                h, head, n = self._some(held)
                hashes.append(h)
                heads.append(head)
                counts.append(n)
            held, total = [], 0

        for x in texts:
            raw = x.encode("utf-8", "surrogatepass") if isinstance(x, str) else x if isinstance(x, bytes) else b""
            if total + len(raw) > TOGETHER:
                flush()
            if len(raw) > TOGETHER:  # a long text goes part by part
                own = [self._some([p]) for p in parts(raw)]
                hashes += [o[0] for o in own]
                heads += [o[1] for o in own]
                counts.append(np.array([sum(int(o[2][0]) for o in own)]))
                continue
            held.append(raw)
            total += len(raw) + 1
        flush()
        none = np.zeros(0, np.uint64)
        return np.concatenate([none, *hashes]), np.concatenate([none, *heads]), np.concatenate([np.zeros(0, np.int64), *counts])

    def _some(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        raw = np.frombuffer(b"\n".join(texts) + b"\n\n\n", np.uint8)
        power, inverse = self.powers if len(raw) <= 2 * TOGETHER else powers(len(raw))
        space = self.space[raw]
        edges = np.flatnonzero(np.diff(space, prepend=True))  # a word begins, and ends, in turn
        starts, ends = edges[::2], edges[1::2]
        low = self.low[raw].astype(np.uint64)
        total = np.cumsum((low + np.uint64(1)) * power[: len(raw)])
        before = np.where(starts > 0, total[starts - 1], np.uint64(0))
        size = (ends - starts).astype(np.uint64)
        h = (total[ends - 1] - before) * inverse[starts] + size * np.uint64(_LENGTH)
        h ^= h >> np.uint64(31)
        for k in np.flatnonzero(size > LONG).tolist():
            h[k] = xxhash.xxh3_64_intdigest(low[starts[k] : ends[k]].astype(np.uint8).tobytes())
        head = low[starts] | np.where(size > 1, low[starts + 1] << np.uint64(8), np.uint64(0)) | np.where(size > 2, low[starts + 2] << np.uint64(16), np.uint64(0))
        bounds = np.cumsum([0, *(len(x) + 1 for x in texts)])
        return h, head, np.diff(np.searchsorted(starts, bounds))
