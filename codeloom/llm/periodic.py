"""Periodic runs of words, by Lyndon roots.

A run is a stretch of words with smallest period q that no neighbouring word extends; runs of at least LEAST words and POWER
periods are found. Each holds, in one of the two orders of its words, a Lyndon word of q words that begins at one of its
places, so the longest Lyndon words at all places (the Lyndon array) of both orders give every run a root.

The Lyndon array comes straight from the first phase of the grouping suffix sorter: suffixes are grouped by their first word,
groups are taken from the highest down, and each suffix that a group's members point to (the nearest one before them in a
lower group) moves to a new group right above its own, whose context is its old context followed by the group's, as often as
the group points to it. When all groups are done, a suffix's context is the longest Lyndon word that begins there. A root is
then extended to both sides by the longest common extension of the text with itself q words on, compared in doubling blocks.

Before that, an exact filter: in a run of max(LEAST, POWER * q) words every three consecutive words occur at least three
times. Stretches of words outside such triples hold no part of a run and are left out; what is left is grouped.

Defined results: a null, empty or blank text has no words and no run; repeated rows are worked on each; other columns than
those asked for as `keep` are left out; a null in a kept column stays null.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.hashing import TOGETHER, Words

LEAST, POWER = 6, 4
RUNS = "array<struct<start:long,length:long,period:long>>"
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def lyndon(s: list[int]) -> list[int]:
    """For each place of s the length of the longest Lyndon word that begins there."""
    places: dict[int, list[int]] = {}
    for i, x in enumerate(s):
        places.setdefault(x, []).append(i)
    letters = sorted(places)
    members = [places[x] for x in letters]
    number = {x: g for g, x in enumerate(letters)}
    group, size = [number[x] for x in s], [1] * len(letters)
    below, above = [*range(-1, len(letters) - 1)], [*range(1, len(letters)), -1]
    done, prev = bytearray(len(s)), [-1] * len(s)
    g = len(letters) - 1
    while g >= 0:
        own = [i for i in members[g] if group[i] == g]
        for i in own:
            done[i] = 1
        moved: dict[tuple[int, int], list[int]] = {}
        met, times = -1, 0
        for i in own:
            p = i - 1
            while p >= 0 and done[p]:
                p = prev[p]
            prev[i] = p
            if p == met:
                times += 1
                continue
            if met >= 0:
                moved.setdefault((times, group[met]), []).append(met)
            met, times = p, 1
        if met >= 0:
            moved.setdefault((times, group[met]), []).append(met)
        for times, old in sorted(moved, reverse=True):  # more pointers first, so that fewer come to stand below them
            new, up = len(members), above[old]
            members.append(moved[times, old])
            size.append(size[old] + times * size[g])
            below.append(old)
            above.append(up)
            above[old], below[up] = new, new
            for p in moved[times, old]:
                group[p] = new
        g = below[g]
    return [size[g] for g in group]


def _equal_ahead(s: np.ndarray, i: int, j: int, most: int) -> int:
    """How many of the next `most` words from i and from j on are equal, one after the other."""
    n, block = 0, 16
    while n < most:
        k = min(block, most - n)
        if (wrong := np.flatnonzero(s[i + n : i + n + k] != s[j + n : j + n + k])).size:
            return n + int(wrong[0])
        n, block = n + k, 2 * block
    return n


def runs(s: np.ndarray, least: int = LEAST, power: int = POWER) -> set[tuple[int, int, int]]:
    """(start, length, period) of the runs of s that are as long as asked for; power is at least 4."""
    n, found = len(s), set()
    back = s[::-1]
    for order in (s, -s):
        roots = np.array(lyndon(order.tolist()), np.int64)
        # A run of four periods holds three roots in a row, each the longest Lyndon word of its place.
        second, third = np.arange(n) + roots, np.arange(n) + 2 * roots
        inside = third < n
        at = np.flatnonzero(inside)
        at = at[(roots[second[at]] == roots[at]) & (roots[third[at]] == roots[at])]
        at = at[np.lexsort((at, roots[at]))]
        period, end = 0, 0
        for i, q in zip(at.tolist(), roots[at].tolist()):
            if q == period and i + q <= end:
                continue  # a root of the run found last
            ahead = _equal_ahead(s, i, i + q, n - i - q)
            behind = _equal_ahead(back, n - i, n - i - q, i)
            if q + ahead + behind >= max(least, power * q):
                period, end = q, i + q + ahead
                found.add((i - behind, q + ahead + behind, q))
    return found


def _stretches(hashes: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(text, from, to) in words: the stretches in which runs can lie, for texts whose words' hashes stand one after the other."""
    text = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    if len(hashes) < LEAST:
        return
    t = hashes[:-2] * _ODD[0] + hashes[1:-1] * _ODD[1] + hashes[2:] * _ODD[2] + text[2:].astype(np.uint64) * _ODD[3]
    t ^= t >> np.uint64(32)
    whole = text[:-2] == text[2:]
    ordered = np.sort(t[whole])
    often = np.unique(ordered[:-2][ordered[:-2] == ordered[2:]]) if len(ordered) > 2 else ordered[:0]
    if not len(often):
        return
    near = np.minimum(np.searchsorted(often, t), len(often) - 1)
    marked = np.flatnonzero(whole & (often[near] == t))
    # A new stretch where a triple is left out or another text begins.
    cuts = np.flatnonzero((np.diff(marked) > 1) | (np.diff(text[marked]) > 0)) + 1
    for lo, hi in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(marked)]])):
        if hi - lo >= LEAST - 2:
            k = int(text[marked[lo]])
            yield k, int(marked[lo] - first[k]), int(marked[hi - 1] + 3 - first[k])


def runs_of(texts: list[bytes], words: Words) -> dict[int, list[tuple[int, int, int]]]:
    """By the number of each text that has any: its runs, by start and period."""
    hashes, _, counts = words.of(texts)
    out: dict[int, list[tuple[int, int, int]]] = {}
    for k, some in groupby(_stretches(hashes, counts), key=lambda x: x[0]):
        own = texts[k].split()
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number) + 1) for w in own), np.int64, len(own))
        found = {(lo + start, length, q) for _, lo, hi in some for start, length, q in runs(ids[lo:hi])}
        if found:
            out[k] = sorted(found, key=lambda x: (x[0], x[2]))
    return out


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    keep = np.ones(len(words), bool)
    for start, length, q in found:
        keep[start + q : start + length] = False
    return [words[i] for i in np.flatnonzero(keep)]


def with_runs(docs: DataFrame, *keep: str) -> DataFrame:
    """docs: text and the columns of keep. Those columns, `runs` by start and period, and `collapsed`: the words kept, joined by
    one space. Each text is worked on whole by the task that reads it; nothing is shuffled."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(lower=False)
        for b in batches:
            texts = [(x or "").encode() for x in b.column("_text").to_pylist()]
            found, held, total = {}, [], 0
            for k in range(len(texts) + 1):  # some texts at once
                if k == len(texts) or total > TOGETHER:
                    found |= {held[i]: x for i, x in runs_of([texts[j] for j in held], words).items()}
                    held, total = [], 0
                if k < len(texts):
                    held.append(k)
                    total += len(texts[k])
            left = [b" ".join(collapsed(x.split(), found[k]) if k in found else x.split()).decode() for k, x in enumerate(texts)]
            rows = [[{"start": s, "length": n, "period": q} for s, n, q in found.get(k, ())] for k in range(len(texts))]
            kind = pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")]))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(rows, kind), pa.array(left, pa.string())], [*keep, "runs", "collapsed"])

    kinds = dict(docs.select(*keep).dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), f"runs {RUNS}", "collapsed string"])
    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(work, schema)
