"""Bulk-synchronous best-fit packing of tokenized documents into sequences of a fixed length.

Documents are tokenized where they lie, and only those longer than a sequence are cut. The pieces are placed class by class,
from long to short: those of more than half of `top` tokens and no more than it, then `top` is halved. No two of the first class
fit together, so each of them opens a sequence, which has its number. From then on a gap offers a class as many
slots of `top` tokens as it holds, and what is left over as one more.

A superstep range-sorts the pieces of the class and the slots by size, falling, and looks for each piece's successor, the
smallest free slot that holds it, ties to the smallest gap. Each range is swept by itself: a slot goes on a stack, a piece takes the
top. Pieces that found no slot in their range and slots that were left over are settled among the ranges by rank: the r-th
such piece takes the r-th slot from the top of the ranges above, which a table of one row for each range tells; the sweep adds that row
to what it writes. The gaps are summed up from what was placed when the next superstep reads them, and the rest of the class goes round again. Once no more than half of what went round was placed, new sequences
are opened for the rest. Once no more than REST of all pieces, the shortest ones, are left, they are
placed by one sweep over the counts of their lengths and of the gaps, best-fit decreasing: so many supersteps do at any size.

Defined results: a null or empty text is one end token; repeated rows are packed each; a null id is an id like others;
other columns are not looked at, so they may have any names.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.llm.hashing import LONG, TOGETHER, parts, powers
from codeloom.llm.shared import running_total, small, written

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Units that a worker remembers the ids of; documents whose pieces are handed on at once.
REMEMBERED, HANDED = 200_000, 500
#: The share of the pieces that one sweep over their lengths places at the end; rows of a range of a superstep, and rows of three
#: numbers that may be broadcast.
REST, RANGE, NARROW = 1 / 2, 1 << 16, 200_000
#: The number of the first sequence that no piece of more than half of it opens; the others have their pieces' numbers.
SHARED = 1 << 62


_SPACE, _LETTER, _DIGIT, _MARK, _HARD = range(5)


def _classes() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Class and lower case of each byte, and of each code point of two bytes up to U+02FF: those whose lower case is a letter
    of two bytes, too, are letters. The apostrophe begins contractions, and so is hard; as is all else."""
    kind, low = np.full(256, _HARD, np.uint8), np.arange(256, dtype=np.uint8)
    kind[[32, *range(9, 14)]] = _SPACE
    for b in range(33, 127):
        c = chr(b)
        kind[b] = _LETTER if c.isalpha() else _DIGIT if c.isdigit() else _HARD if c == "'" else _MARK
        low[b] = ord(c.lower())
    kind2, low2 = np.full(0x300, _HARD, np.uint8), np.arange(0x300, dtype=np.uint16)
    for k in range(0x80, 0x300):
        c = chr(k).lower()
        if chr(k).isalpha() and len(c) == 1 and 0x80 <= ord(c) < 0x300:
            kind2[k], low2[k] = _LETTER, ord(c)
    return kind, low, kind2, low2


class WordTokens:
    """Token ids of texts by a tokenizer file of byte-level pairs whose tokens never hold white space, whose last token of a
    pre-token ends in a mark of its own, and whose normalizer composes and lower-cases.

    Texts are cut into units by numpy: runs of letters of the Latin blocks, of marks, and single digits are pre-tokens; a word
    that holds anything else is one unit. The distinct units of many texts meet those that are remembered by 64-bit
    hashes; the new ones go to the model as one text, cut at white space alone, or by the whole tokenizer if a word."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab()
        mark = self.tokenizer.model.end_of_word_suffix
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for x, i in vocabulary.items() if x.endswith(mark)]] = True
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow 255
        rest = [b for b in range(256) if b not in shown]
        self.alphabet = {b: 256 + k for k, b in enumerate(rest) if b != 32}
        self.kind, self.low, self.kind2, self.low2 = _classes()
        # Remembered units: their hashes, sorted; where their ids are in the pool, and how many; how often they came again.
        self.keys, self.at, self.size, self.uses = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, "<u4")

    @functools.cached_property
    def powers(self) -> tuple[np.ndarray, np.ndarray]:
        return powers(2 * TOGETHER)

    def _units(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """raw ends in white space. Of each unit: start, end, whether it is hard; and the bytes, lower-cased unless hard."""
        kind, low = self.kind[raw], self.low[raw]
        two = np.flatnonzero((raw[:-1] >= 0xC2) & (raw[:-1] < 0xCC))
        if len(two):
            points = ((raw[two].astype(np.int64) & 31) << 6) | (raw[two + 1] & 63)
            letter = self.kind2[points] == _LETTER
            at, lower = two[letter], self.low2[points[letter]]
            kind[at], kind[at + 1] = _LETTER, _LETTER
            low[at], low[at + 1] = 0xC0 | (lower >> 6), 0x80 | (lower & 63)
        kind[:-1][(raw[:-1] == 60) & (raw[1:] == 124)] = _HARD  # it may become a special token
        space = kind == _SPACE
        begins = np.empty(len(raw), bool)
        begins[0], begins[1:] = ~space[0], (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        begins &= ~space
        ends = np.append(False, ~space[:-1]) & space  # the white space after a word
        word = np.empty(len(raw), bool)
        word[0], word[1:] = ~space[0], space[:-1] & ~space[1:]
        edges = np.flatnonzero(begins | ends)
        starts = begins[edges]
        wide = np.flatnonzero(starts[:-1] & (np.diff(edges) > LONG))
        hard_at = np.concatenate([np.flatnonzero(kind == _HARD), edges[wide]])
        if len(hard_at):
            firsts = np.flatnonzero(word)
            hard_words = np.unique(np.searchsorted(firsts, hard_at, "right") - 1)
            cover = np.zeros(len(raw) + 1, np.int8)
            cover[firsts[hard_words]] = 1
            lasts = np.flatnonzero(ends)
            cover[lasts[hard_words]] -= 1
            inside = np.cumsum(cover[:-1], dtype=np.int8) > 0
            begins &= ~inside | word
            low[inside] = raw[inside]
            edges = np.flatnonzero(begins | ends)
            starts = begins[edges]
            at = np.flatnonzero(starts)
            return edges[at], edges[at + 1], inside[edges[at]], low
        at = np.flatnonzero(starts)
        return edges[at], edges[at + 1], np.zeros(len(at), bool), low

    def _ids(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the units start, how many ids each has, and all ids."""
        starts, ends, hard, low = self._units(raw)
        if not len(starts):
            return starts, starts, self.pool[:0]
        power, inverse = self.powers if len(raw) <= 2 * TOGETHER else powers(len(raw))
        total = np.cumsum((low.astype(np.uint64) + np.uint64(1)) * power[: len(raw)])
        h = (total[ends - 1] - np.where(starts > 0, total[starts - 1], np.uint64(0))) * inverse[starts]
        h += (ends - starts).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + hard * np.uint64(0x165667B19E3779F9)
        keys, first, own = np.unique(h, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        if len(self.keys):
            known = self.keys[np.minimum(at, len(self.keys) - 1)] == keys
            self.uses[at[known]] += 1
        fresh = first[~known]
        pool_at, size = np.empty(len(keys), np.int64), np.empty(len(keys), np.int64)
        pool_at[known], size[known] = self.at[at[known]], self.size[at[known]]
        if len(fresh):
            pool_at[~known], size[~known] = self._learn(low, starts[fresh], ends[fresh], hard[fresh])
            every = np.concatenate([self.keys, keys[~known]])
            order = np.argsort(every, kind="stable")
            self.keys = every[order]
            self.at, self.size = np.concatenate([self.at, pool_at[~known]])[order], np.concatenate([self.size, size[~known]])[order]
            self.uses = np.concatenate([self.uses, np.zeros(len(fresh), np.int64)])[order]
        sizes = size[own]
        before = np.cumsum(sizes) - sizes
        ids = self.pool[np.repeat(pool_at[own] - before, sizes) + np.arange(int(sizes.sum()))]
        if len(self.keys) > REMEMBERED:
            self._forget(self.uses > 0)
            if len(self.keys) > REMEMBERED // 2:
                self._forget(np.zeros(len(self.keys), bool))
        return starts, sizes, ids

    def _forget(self, keep: np.ndarray) -> None:
        self.keys, at, self.size, self.uses = self.keys[keep], self.at[keep], self.size[keep], np.zeros(int(keep.sum()), np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.pool = self.pool[np.repeat(at - self.at, self.size) + np.arange(int(self.size.sum()))]

    def _learn(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, hard: np.ndarray, together: int = 500) -> tuple[np.ndarray, np.ndarray]:
        """Puts the ids of units into the pool; where, and how many."""
        size, new, at = np.empty(len(starts), np.int64), [], np.empty(len(starts), np.int64)
        end = len(self.pool)
        plain = np.flatnonzero(~hard)
        if len(plain):
            s, n = starts[plain], ends[plain] - starts[plain] + 1  # and the white space, or another unit's first byte, after it
            to = np.cumsum(n)
            joined = low[np.repeat(s - (to - n), n) + np.arange(int(to[-1]))]
            joined[to - 1] = 32
            text = joined.tobytes().decode("latin-1")
            text = text if text.isascii() else text.translate(self.alphabet)
            cuts = [0, *to[together - 1 :: together].tolist(), len(text)]
            ids = [np.array(x.ids, "<u4") for x in self.plain.encode_batch_fast([text[a:b] for a, b in zip(cuts, cuts[1:])], add_special_tokens=False)]
            ids = np.concatenate(ids)
            lasts = np.flatnonzero(self.last[ids]) + 1
            if len(lasts) != len(plain):
                raise ValueError("the tokenizer does not mark the ends of words")
            size[plain] = np.diff(lasts, prepend=0)
            at[plain] = end + lasts - size[plain]
            new.append(ids)
            end += len(ids)
        for k in np.flatnonzero(hard).tolist():
            ids = np.array(self.tokenizer.encode(low[starts[k] : ends[k]].tobytes().decode(), add_special_tokens=False).ids, "<u4")
            size[k], at[k] = len(ids), end
            new.append(ids)
            end += len(ids)
        self.pool = np.concatenate([self.pool, *new])
        return at, size

    def many(self, texts: list[str | None]) -> Iterator[bytes]:
        """For each text its unsigned 32-bit ids, little-endian as the machine is."""
        held, total = [], 0
        for x in texts:
            raw = x.encode("utf-8", "replace") if isinstance(x, str) else b""
            if total and total + len(raw) > TOGETHER:
                yield from self._some(held)
                held, total = [], 0
            if len(raw) > TOGETHER:  # a long text goes part by part, cut at white space
                yield b"".join(b"".join(self._some([part])) for part in parts(raw))
                continue
            held.append(raw)
            total += len(raw) + 1
        yield from self._some(held)

    def _some(self, texts: list[bytes]) -> Iterator[bytes]:
        if not texts:
            return
        raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        starts, sizes, ids = self._ids(raw)
        bounds = np.cumsum([0, *(len(x) + 1 for x in texts)])
        tokens = np.append(0, np.cumsum(sizes))[np.searchsorted(starts, bounds)] * 4
        whole = ids.tobytes()
        for a, b in itertools.pairwise(tokens.tolist()):
            yield whole[a:b]

    def ids(self, text: str | None) -> bytes:
        return b"".join(self.many([text]))


@functools.cache
def _tokens(path: str) -> WordTokens:
    """A worker's, for all the tasks that it runs."""
    return WordTokens(path)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end: int = 0, keep_ids: bool = False) -> DataFrame:
    """PIECES, `document`, and `ids` (little-endian unsigned 32-bit) if they are to be kept: each document's tokens and one `end`. document:
    a number for each row of docs, which tells rows with the same id apart."""
    last, schema = np.array([end], "<u4").tobytes(), f"{PIECES}, document long" + ", ids binary" * keep_ids

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens, number = _tokens(tokenizer), TaskContext.get().partitionId() << 40
        for some in (b.iloc[at : at + HANDED] for b in batches for at in range(0, len(b), HANDED)):
            rows = []
            for doc, ids in zip(some.doc_id.astype(object), tokens.many(some.text.tolist())):
                ids += last
                number += 1
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(own) // 4, zlib.crc32(own), number) + ((own,) if keep_ids else ()))
            out = pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")])
            yield out.astype({"doc_id": "Int64"})

    return docs.select("doc_id", "text").mapInPandas(cut, schema)


def sweep(runs: dict[int, int], capacity: int, free: dict[int, int] | None = None) -> list[tuple[int, int, int, int, int]]:
    """runs: pieces by length; free: gaps by size. Returns (length, from rank, to rank, first, offset): ranks of a run against
    sequences, numbered through the gaps in the order of `free` and then through new ones. The result is best-fit decreasing's."""
    gaps: list[int] = []  # sorted
    ranges: dict[int, list[tuple[int, int]]] = {}  # by gap: ranges of sequences
    out, opened = [], 0

    def add(gap: int, first: int, n: int) -> None:
        if gap:
            if gap not in ranges:
                bisect.insort(gaps, gap)
                ranges[gap] = []
            ranges[gap].append((first, n))

    for gap, n in (free or {}).items():
        add(gap, opened, n)
        opened += n

    for length in sorted(runs, reverse=True):
        rank, left, fresh = 0, runs[length], []
        while left:
            at = bisect.bisect_left(gaps, length)
            if at == len(gaps):  # no gap holds it: new sequences, each as full of this run as it gets
                per = capacity // length
                n = -(-left // per)
                for k in range(per):
                    own = min(n, left)
                    if own:
                        out.append((length, rank, rank + own, opened, k * length))
                        rank, left = rank + own, left - own
                    filled = own
                    if own < n:
                        break
                k_full = k + (1 if filled == n else 0)
                if filled < n and filled:
                    add(capacity - (k + 1) * length, opened, filled)
                    add(capacity - k * length, opened + filled, n - filled)
                else:
                    add(capacity - k_full * length, opened, n)
                opened += n
                continue
            gap = gaps[at]
            first, n = ranges[gap].pop()
            own = min(n, left)
            out.append((length, rank, rank + own, first, capacity - gap))
            rank, left = rank + own, left - own
            if own < n:
                ranges[gap].append((first + own, n - own))
            elif not ranges[gap]:
                del ranges[gap], gaps[at]
            fresh.append((gap - length, first, own))
            # What is left of a gap stands open to the same run at once: one piece more may be its best fit.
            for x in fresh:
                add(*x)
            fresh.clear()
    return out


def _slots(gaps: DataFrame, top: int, low: int) -> DataFrame:
    """(size, kind 0, gap, id): what the gaps offer to pieces of more than `low` and at most `top` tokens."""
    whole, rest = F.expr(f"cast(gap div {top} as int)"), F.col("gap") % top
    sizes = F.concat(F.array_repeat(F.lit(top).cast("long"), whole), F.when(rest > low, F.array(rest)).otherwise(F.array().cast("array<long>")))
    return gaps.where(F.col("gap") > low).select(F.explode(sizes).alias("size"), F.lit(0).alias("kind"), "gap", F.col("seq").alias("id"))


def _swept(pieces: DataFrame, gaps: DataFrame, top: int, low: int, ranges: int) -> DataFrame:
    """Each range by itself: (part, what, rank, uid, length, seq, gap). what: 0 a piece in its slot, 1 a piece that found none,
    2 a slot left over; ranks are in order from 0 of either kind. 3, at the end of each: how many were placed as its rank, lost as its
    uid, and left over as its length."""
    items = _slots(gaps, top, low).unionByName(pieces.select(F.col("length").alias("size"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("gap"), F.col("uid").alias("id")))
    order = [F.desc("size"), F.asc("kind"), F.desc("gap"), F.asc("id")]

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stack: list[tuple[int, int]] = []
        part, met, lost = TaskContext.get().partitionId(), 0, 0
        columns = ["part", "what", "rank", "uid", "length", "seq", "gap"]
        for b in batches:
            out = []
            for size, kind, gap, own in zip(b["size"].tolist(), b.kind.tolist(), b.gap.tolist(), b.id.tolist()):
                if not kind:
                    stack.append((own, gap))
                elif stack:
                    out.append((part, 0, 0, own, size, *stack.pop()))
                    met += 1
                else:
                    out.append((part, 1, lost, own, size, -1, -1))
                    lost += 1
            yield pd.DataFrame(out, columns=columns)
        rest = [(part, 2, k, -1, -1, *x) for k, x in enumerate(stack)]
        yield pd.DataFrame([*rest, (part, 3, met, lost, len(stack), -1, -1)], columns=columns)

    schema = "part int, what int, rank long, uid long, length long, seq long, gap long"
    return written(items.repartitionByRange(ranges, *order).sortWithinPartitions(*order).mapInPandas(match, schema), "swept")


def _flows(summary: list) -> tuple[list[tuple], dict[int, int]]:
    """summary: for each range, in order: (part, pieces lost, slots over). Ranks of pieces against ranks of slots of ranges
    above: (piece part, from rank, to rank, slot part, slots' end, first number), and how many pieces each range could settle."""
    stack: list[list[int]] = []
    flows, settled, number = [], {}, 0
    for part, lost, over in summary:
        at = 0
        while at < lost and stack:
            n = min(lost - at, stack[-1][1])
            flows.append((part, at, at + n, stack[-1][0], stack[-1][1], number))
            stack[-1][1] -= n
            at, number = at + n, number + n
            if not stack[-1][1]:
                stack.pop()
        settled[part] = at
        if over:
            stack.append([part, over])
    return flows, settled


def superstep(pieces: DataFrame, gaps: DataFrame, top: int, low: int, ranges: int) -> tuple[DataFrame, DataFrame, int, int]:
    """pieces: (uid, length), all of more than `low` and at most `top`; gaps: (seq, gap). Returns what was placed (uid, length,
    seq), the pieces left, how many were placed, and how many are left."""
    spark = pieces.sparkSession
    swept = _swept(pieces, gaps, top, low, ranges)
    summary = sorted(swept.where("what = 3").select("part", "rank", "uid", "length").collect())  # a row for each range
    flows, settled = _flows([(r[0], r[2], r[3]) for r in summary])
    across = sum(settled.values())
    met = swept.where("what = 0").select("uid", "length", "seq")
    if flows:
        flow = F.broadcast(spark.createDataFrame(flows, "p int, lo long, hi long, q int, top long, first long"))  # two rows a range at most
        lost = swept.where("what = 1").join(flow, (F.col("part") == F.col("p")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
        over = swept.where("what = 2").join(flow, (F.col("part") == F.col("q")) & (F.col("rank") < F.col("top")) & (F.col("rank") >= F.expr("top - (hi - lo)")))
        lost = lost.select("uid", "length", F.expr("first + rank - lo").alias("number"))
        over = over.select("seq", F.expr("first + top - 1 - rank").alias("number"))
        met = met.unionByName(lost.join(F.broadcast(over) if across <= NARROW else over, "number").select("uid", "length", "seq"))
    took = F.broadcast(spark.createDataFrame([*settled.items()], "part int, took long"))
    left = swept.where("what = 1").join(took, "part").where("rank >= took").select("uid", "length")
    return written(met, "placed"), left, sum(r[1] for r in summary) + across, sum(r[2] for r in summary) - across


def _last(pieces: DataFrame, gaps: DataFrame | None, opened: int, capacity: int) -> DataFrame:
    """(uid, length, seq, at) of the last pieces, `at` their order in a sequence: by the counts of their lengths, and of the gaps by size, `capacity` rows each."""
    pieces, gaps = written(pieces.withColumn("one", F.lit(1)), "rest"), None if gaps is None else written(gaps.withColumn("one", F.lit(1)), "gaps")
    runs = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    free = {} if gaps is None else {r[0]: r[1] for r in gaps.groupBy("gap").count().collect()}
    plan = sweep(runs, capacity, free)
    spark, known = pieces.sparkSession, sum(free.values())
    plan = spark.createDataFrame(pd.DataFrame(plan, columns=["run", "lo", "hi", "first", "offset"]).astype("int64"), "run long, lo long, hi long, first long, offset long")
    ranked = running_total(pieces, "length", ["uid"], "one", "rank", counts=runs)
    met = ranked.join(F.broadcast(plan), (F.col("length") == F.col("run")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    met = written(met.select("uid", "length", F.expr("first + rank - lo").alias("place"), F.col("offset").alias("at")).coalesce(-(-sum(runs.values()) // RANGE)), "last")
    new = met.where(F.col("place") >= known).select("uid", "length", (F.col("place") - known + opened + SHARED).alias("seq"), "at")
    if not known:
        return new
    starts, at = [], 0
    for gap, n in free.items():
        starts.append((gap, at))
        at += n
    starts = F.broadcast(spark.createDataFrame(starts, "gap long, at long"))
    numbered = running_total(gaps, "gap", ["seq"], "one", "nth", counts=free).join(starts, "gap").select("seq", (F.col("at") + F.col("nth")).alias("place"))
    return met.join(numbered, "place").select("uid", "length", "seq", "at").unionByName(new)


def packed(cut: DataFrame, capacity: int = 2048) -> DataFrame:
    """cut: the pieces. Adds sequence_id and offset."""
    cut = written(cut.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    runs = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}  # at most `capacity` rows
    spark, top, opened, placed, rest, left = cut.sparkSession, capacity // 2, 0, [], sum(runs.values()), None
    last, least = int(REST * rest), -(-sum(k * n for k, n in runs.items()) // capacity)
    alone = sum(n for k, n in runs.items() if k > top) if rest > last else 0
    if alone:  # no two of them fit together
        long = cut.where(F.col("length") > top).select("uid", "length", F.col("uid").alias("seq"))
        placed.append(long)
        rest -= alone
    else:
        top = capacity

    def gaps() -> DataFrame | None:
        """(seq, gap): what is left of each sequence, by what was placed so far."""
        if not alone + opened:
            return None
        own = spark.range(SHARED, SHARED + opened).select(F.col("id").alias("seq"), F.lit(capacity).cast("long").alias("gap"))
        if alone:
            own = own.unionByName(long.where(F.col("length") < capacity).select("seq", (capacity - F.col("length")).alias("gap")))
        for x in placed[bool(alone) :]:
            own = own.unionByName(x.select("seq", (-F.col("length")).alias("gap")))
        left = own.groupBy("seq").agg(F.sum("gap").alias("gap")).where("gap > 0")
        return left.coalesce(-(-(alone + opened) // RANGE))  # one row for each sequence at most

    while rest > last:
        low = top // 2
        own = {k: n for k, n in runs.items() if low < k <= top}
        n, tokens = sum(own.values()), sum(k * n for k, n in own.items())
        left = cut.where((F.col("length") > low) & (F.col("length") <= top)).select("uid", "length")
        done = n if alone + opened else 0
        while n and rest > last:
            if done < n:  # as many as their tokens need at least; the last few of a class at once, if all have so many
                more = -(-n // (capacity // top))
                if top < capacity and (n > last // 16 or alone + opened + more > least):
                    more = -(-(tokens or left.agg(F.sum("length")).first()[0]) // capacity)
                opened += more
            ranges = -(-(n + alone + opened) // RANGE)
            out, left, done, n = superstep(left, gaps(), top, low, ranges)
            tokens = 0 if done else tokens  # else as before
            placed.append(out)
            rest -= done
        if not n:
            left, top = None, low
    small_ones = cut.where(F.col("length") <= (top if left is None else top // 2)).select("uid", "length")
    placed = [x.select(F.lit(k).alias("step"), "uid", "length", "seq", F.col("uid").alias("at")) for k, x in enumerate(placed)]
    if rest:
        last = _last(small_ones if left is None else small_ones.unionByName(left), gaps(), opened, capacity)
        placed.append(last.select(F.lit(len(placed)).alias("step"), "uid", "length", "seq", "at"))
    if not placed:
        return cut.drop("uid").withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long"))
    # A sequence's pieces, `capacity` at most, lie in the order in which they were placed.
    before = W.partitionBy("seq").orderBy("step", "at").rowsBetween(W.unboundedPreceding, -1)
    every = functools.reduce(DataFrame.unionByName, placed).select("uid", "seq", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"))
    met = cut.join(every, "uid")
    return met.select(*[c for c in cut.columns if c != "uid"], F.col("seq").alias("sequence_id"), "offset")


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end: int = 0, keep_ids: bool = False) -> DataFrame:
    """A row for each piece: PIECES, sequence_id and offset, and its ids if they are to be kept."""
    return packed(pieces(docs, tokenizer, capacity, end, keep_ids), capacity)
