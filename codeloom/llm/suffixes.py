"""Removal of repeated passages by suffix arrays, built shard by shard by induced sorting.

A byte goes if a string of LENGTH bytes over it also starts earlier. Equal strings must meet in one shard, whatever their
documents: each window of LENGTH bytes has an anchor, the GRAM bytes in it with the least hash (the leftmost, if equal),
which depends on the window alone. Consecutive windows with one anchor are one context, LENGTH - 1 bytes and a byte for
each window. Contexts whose anchor occurs once hold no repeat. Of the others, equal contexts become one, with its earliest
place and the rule that all later places repeat it; the distinct ones are dealt into shards by their anchor, and one that
is alone with its anchor there has no equal. An anchor whose distinct contexts hold more than SHARD bytes would not fit one
task: its windows are hashed one by one to 128 bits and meet in an aggregate, of which all but the earliest are repeats.

A shard is one text. Its suffixes are classified as larger or smaller than the next, the leftmost smaller ones sorted by
induction, their substrings named and the shorter text of names sorted in turn; then the whole array is induced, linearly.
The common prefix of each suffix with its predecessor is computed in the order of the text (permuted), up to LENGTH. Runs
of windows with LENGTH bytes in common are equal strings, of which all but the earliest are repeats.

Defined results: a null text is empty; matches do not cross documents; rows that repeat an id and a text share their places,
so that the same text at the same place is no repeat of itself; rows that repeat an id with different texts are documents of
their own, in an order by hashes of their texts: their places are FAR apart. A null id comes before all others. Other columns
may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.shared import running_total, small, written

LENGTH, GRAM = 100, 20
#: Bytes of text that are hashed, or sorted, at once.
BUFFER, SHARD = 1 << 18, 4 << 20
#: Alphabets up to so many characters are induced a bucket at a time, larger ones, of names, a suffix at a time.
LETTERS = 1024
_NULL = -(1 << 63)
#: Where the places of the next of the texts with one id begin; no text is as long.
FAR = 1 << 31


def _words(raw: np.ndarray, at: int, n: int) -> np.ndarray:
    """The n 8-byte words that start at each byte from `at` on."""
    return np.ndarray((n,), "<u8", raw, at, (1,))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def anchors(raw: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
    """raw: documents end to end, of up to 2**20 bytes, with 8 bytes to spare; windows may start in [first, last) of each.

    Contexts: place of the first window, number of windows, hash of the anchor."""
    n = len(raw) - 8 - GRAM + 1
    span = LENGTH - GRAM + 1
    if n < span:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    h = _words(raw, 0, n) * np.uint64(0x9E3779B97F4A7C15)
    for k in [*range(8, GRAM - 8, 8), GRAM - 8]:
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F) + _words(raw, k, n)
    h = _mix(h)
    low = (h >> np.uint64(20) << np.uint64(20)) | np.arange(n, dtype=np.uint64)  # ties go to the left
    size = 1
    while size * 2 <= span:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < span:
        low = np.minimum(low[: len(low) - (span - size)], low[span - size :])
    place = (low & np.uint64((1 << 20) - 1)).astype(np.int64)
    inside = np.zeros(len(place) + 1, np.int8)
    keep = (last > first) & (first < len(place))
    np.add.at(inside, first[keep], 1)
    np.add.at(inside, np.minimum(last[keep], len(place)), -1)
    inside = np.cumsum(inside[:-1], dtype=np.int8) > 0
    begins = inside.copy()
    begins[1:] &= (place[1:] != place[:-1]) | ~inside[:-1]
    at = np.flatnonzero(begins)
    ends = np.flatnonzero(inside & np.append(begins[1:] | ~inside[1:], True))
    return at, ends - at + 1, h[place[at]]


def contexts(docs: DataFrame, hashed: bool) -> DataFrame:
    """(key) or (key, own, d, at, n) of every context: own is a hash of its bytes, d the document, at its place there."""
    columns = ["key", "own", "d", "at", "n"] if hashed else ["key"]

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            held, total = [], 0
            for d, base, text in zip(b.d, b.base, b.text):
                raw = text.encode("utf-8", "surrogatepass") if text else b""
                # A long document is cut where no window is lost: parts overlap by LENGTH - 1 bytes.
                for at in range(0, max(1, len(raw) - LENGTH + 1), BUFFER):
                    part = raw[at : at + BUFFER + LENGTH - 1]
                    if len(part) < LENGTH:
                        continue
                    held.append((d, base + at, part))
                    total += len(part)
                    if total >= BUFFER:
                        yield emit(held)
                        held, total = [], 0
            if held:
                yield emit(held)

    def emit(held: list) -> pd.DataFrame:
        joined = b"".join(x for _, _, x in held) + b"\0" * 8
        raw = np.frombuffer(joined, np.uint8)
        sizes = np.array([len(x) for _, _, x in held])
        starts = np.cumsum(sizes) - sizes
        at, n, key = anchors(raw, starts, starts + sizes - LENGTH + 1)
        out = {"key": key.view(np.int64)}
        if hashed:
            doc = np.searchsorted(starts, at, "right") - 1
            own = [hashlib.blake2b(joined[a : a + m + LENGTH - 1], digest_size=8).digest() for a, m in zip(at.tolist(), n.tolist())]
            out["own"] = np.frombuffer(b"".join(own), np.int64)
            out["d"] = np.array([d for d, _, _ in held], np.int64)[doc]
            out["at"], out["n"] = at - starts[doc] + np.array([o for _, o, _ in held])[doc], n.astype(np.int32)
        return pd.DataFrame(out, columns=columns)

    schema = "key long, own long, d long, at long, n int" if hashed else "key long"
    return docs.mapInPandas(find, schema)


def _induce(t: np.ndarray, smaller: np.ndarray, seeds: np.ndarray, size: int) -> np.ndarray:
    """The suffix array that follows from the order of the leftmost smaller suffixes `seeds`."""
    n = len(t)
    counts = np.bincount(t, minlength=size)
    ends = np.cumsum(counts)
    heads, tails = ends - counts, ends.copy()
    by = t[seeds]
    seed_at = np.searchsorted(by, np.arange(size + 1))
    sa = np.full(n, -1, np.int64)
    larger = ~smaller

    def spread(prev: np.ndarray, step: int, pointer: np.ndarray) -> None:
        """Puts prev, in order, into their buckets: upwards from the heads, or downwards from the tails."""
        ch = t[prev]
        order = np.argsort(ch, kind="stable")
        sorted_ch, own = ch[order], np.bincount(ch, minlength=size)
        nth = np.arange(len(ch)) - (np.cumsum(own) - own)[sorted_ch]
        if step > 0:
            sa[pointer[sorted_ch] + nth] = prev[order]
            pointer += own
        else:
            sa[pointer[sorted_ch] - 1 - nth] = prev[order]
            pointer -= own

    begin = heads.copy()
    for c in range(size):  # larger suffixes, bucket by bucket; a run of one character goes round again
        if not counts[c]:
            continue
        done = begin[c]
        while done < heads[c]:
            now = sa[done : heads[c]]
            done = heads[c]
            prev = now[now > 0] - 1
            prev = prev[larger[prev]]
            if len(prev):
                spread(prev, 1, heads)
        own = seeds[seed_at[c] : seed_at[c + 1]]
        prev = own[own > 0] - 1
        if len(prev):
            spread(prev, 1, heads)
    for c in range(size - 1, -1, -1):  # smaller suffixes, from the end
        if not counts[c]:
            continue
        done = ends[c]
        while done > tails[c]:
            now = sa[tails[c] : done][::-1]
            done = tails[c]
            prev = now[now > 0] - 1
            prev = prev[smaller[prev]]
            if len(prev):
                spread(prev, -1, tails)
        now = sa[begin[c] : heads[c]][::-1]
        prev = now[now > 0] - 1
        prev = prev[smaller[prev]]
        if len(prev):
            spread(prev, -1, tails)
    sa[0] = n - 1  # the end, smaller than all and induced by nothing
    return sa


def _induce_each(t: np.ndarray, smaller: np.ndarray, seeds: np.ndarray, size: int) -> np.ndarray:
    """As _induce, for large alphabets, whose buckets hold a suffix or two: one after the other."""
    n, ends, by = len(t), np.cumsum(np.bincount(t, minlength=size)), t[seeds]
    own = np.bincount(by, minlength=size)
    sa = np.full(n, -1, np.int64)
    sa[(ends - np.cumsum(own))[by] + np.arange(len(seeds))] = seeds  # at the ends of their buckets
    sa = sa.tolist()
    # The character before each suffix, if what begins with it is induced in this pass; the last number is that of empty places.
    before = np.full(n + 1, -1, np.int64)
    before[1:n] = np.where(smaller[:-1], -1, t[:-1])
    before, at = before.tolist(), np.append(0, ends[:-1]).tolist()
    for i in sa:  # grows to the right of where it is read
        c = before[i]
        if c >= 0:
            k = at[c]
            sa[k] = i - 1
            at[c] = k + 1
    before = np.full(n + 1, -1, np.int64)
    before[1:n] = np.where(smaller[:-1], t[:-1], -1)
    before, at = before.tolist(), ends.tolist()
    for i in reversed(sa):  # grows to the left
        c = before[i]
        if c >= 0:
            at[c] = k = at[c] - 1
            sa[k] = i - 1
    return np.array(sa, np.int64)


def suffix_array(t: np.ndarray, size: int) -> np.ndarray:
    """t: numbers below `size`, the last one 0 and the only 0."""
    n = len(t)
    if n < 3:
        return np.argsort(t, kind="stable") if n < 2 else np.array([1, 0])
    step = np.sign(t[1:].astype(np.int64) - t[:-1])
    step = np.append(step, -1)  # the last is larger than the end, which is smaller by rule
    where = np.where(step != 0, np.arange(n), n - 1)
    nxt = np.minimum.accumulate(where[::-1])[::-1]
    smaller = step[nxt] > 0
    smaller[n - 1] = True
    leftmost = np.flatnonzero(smaller & np.append(False, ~smaller[:-1]))
    seeds = leftmost[np.argsort(t[leftmost], kind="stable")]
    induce = _induce if size <= LETTERS else _induce_each
    sa = induce(t, smaller, seeds, size)
    is_left = np.zeros(n, bool)
    is_left[leftmost] = True
    ordered = sa[is_left[sa]]
    # Names: equal substrings from a leftmost smaller suffix to the next one, both ends included, have the same.
    length = np.ones(n, np.int64)
    length[leftmost[:-1]] = np.diff(leftmost) + 1
    a, b = ordered[:-1], ordered[1:]
    same = length[a] == length[b]
    left, k = np.flatnonzero(same), 0
    while len(left):
        differ = t[a[left] + k] != t[b[left] + k]
        same[left[differ]] = False
        k += 1
        left = left[~differ & (length[a[left]] > k)]
    name = np.zeros(n, np.int64)
    name[ordered] = np.append(0, np.cumsum(~same))
    names = int(name[ordered[-1]]) + 1
    if names < len(leftmost):
        short = name[leftmost]
        ordered = leftmost[suffix_array(short, names)]
    return induce(t, smaller, ordered, size)


def permuted_prefixes(raw: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """For each suffix in `sa`, in the order of the text: the length it shares with the one before it in sa, up to `most`.

    raw: bytes, with `most` + 8 to spare. Suffixes that aren't in sa have 0."""
    phi = np.full(len(raw), -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    p = np.flatnonzero(phi >= 0)
    q = phi[p]
    out = np.zeros(len(raw), np.int64)
    words, left, k = _words(raw, 0, len(raw) - 7), np.arange(len(p)), 0
    while len(left) and k < most:
        x = words[p[left] + k] ^ words[q[left] + k]
        equal = x == 0
        some = ~equal
        low = x[some] & (~x[some] + np.uint64(1))  # the lowest bit that differs
        out[p[left[some]]] = k + (np.log2(low.astype(np.float64)).astype(np.int64) >> 3)
        left, k = left[equal], k + 8
        out[p[left]] = k
    return np.minimum(out, most)


def repeats(texts: list[bytes], windows: np.ndarray, place: np.ndarray) -> list[np.ndarray]:
    """texts: distinct contexts, with so many windows each; place: their order in the corpus. For each the windows that an
    earlier context holds as well."""
    sizes = np.array([len(x) for x in texts])
    starts = np.cumsum(sizes + 1) - sizes - 1
    joined = b"\0".join(texts)
    codes = np.frombuffer(joined + b"\0\0", np.uint8).astype(np.int64) + 2
    codes[starts + sizes] = 1  # between contexts
    codes[-1] = 0
    sa = suffix_array(codes, 258)
    n = len(codes)
    owner, at = np.repeat(np.arange(len(texts)), windows), None
    at = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    spot = starts[owner] + at
    who = np.full(n, -1, np.int64)
    who[spot] = owner
    sa = sa[who[sa] >= 0]
    raw = np.frombuffer(joined + b"\0" * (LENGTH + 16), np.uint8)
    shared = permuted_prefixes(raw, sa, LENGTH)
    group = np.cumsum(shared[sa] < LENGTH)
    order = place[who[sa]]
    least = np.full(int(group[-1]) + 1 if len(group) else 0, np.iinfo(np.int64).max)
    np.minimum.at(least, group, order)
    gone = sa[order > least[group]]
    marked = np.zeros(n, bool)
    marked[gone] = True
    return [np.flatnonzero(marked[s : s + w]) for s, w in zip(starts, windows)]


def _spans(at: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of bytes that windows starting at sorted `at` cover, joined where they meet."""
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > LENGTH) + 1
    return [(int(x[0]), int(x[-1]) + LENGTH) for x in np.split(at, cut)]


def large_anchors(firsts: DataFrame, shared: DataFrame) -> DataFrame:
    """(key) of the anchors whose distinct contexts hold more than SHARD bytes."""
    many = small(shared.where("many").select("key"))  # so many contexts that they may
    sizes = firsts.join(many, "key").groupBy("key").agg(F.sum(F.col("n") + LENGTH - 1).alias("bytes"))
    return written(sizes.where(F.col("bytes") > SHARD).select("key"), "large")


def _by_text(firsts: DataFrame, *columns: str) -> DataFrame:
    return firsts.groupBy("d", F.expr(f"at - pmod(at, {FAR})").alias("base")).agg(F.collect_list(F.struct(*columns)).alias("own"))


def placed(docs: DataFrame, *keep: str) -> DataFrame:
    """(d, base, text, keep...): where the places of a row's text begin, other than 0 only where an id has different texts."""
    d = docs.select(F.coalesce("doc_id", F.lit(_NULL)).cast("long").alias("d"), "text", *keep)
    again = small(written(d.groupBy("d").count().where("count > 1").select("d"), "again"))
    if again.isEmpty():
        return d.select("d", F.lit(0).cast("long").alias("base"), "text", *keep)
    texts = written(d.join(again, "d").select("d", F.xxhash64("text").alias("t")).distinct().withColumn("one", F.lit(FAR)), "texts")
    bases = small(written(running_total(texts, "d", ["t"], "one", "base").select("d", "t", "base"), "bases"))
    met = d.withColumn("t", F.xxhash64("text")).join(bases, ["d", "t"], "left")
    return met.select("d", F.coalesce("base", F.lit(0)).cast("long").alias("base"), "text", *keep)


def repeated_windows(docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """(d, lo, hi): the windows of these contexts that start earlier, too. No anchor's windows have to meet in one task."""
    wanted = _by_text(firsts, "at", "n")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for d, base, text, own in zip(b.d, b.base, b.text, b.own):
                raw = text.encode("utf-8", "surrogatepass") if text else b""
                at = [k for x in own for k in range(x["at"] - base, x["at"] - base + x["n"])]
                both = np.frombuffer(b"".join(hashlib.blake2b(raw[k : k + LENGTH], digest_size=16).digest() for k in at), np.int64).reshape(-1, 2)
                yield pd.DataFrame({"h": both[:, 0], "g": both[:, 1], "d": np.full(len(at), d, np.int64), "at": np.array(at, np.int64) + base})

    windows = written(docs.join(wanted, ["d", "base"]).mapInPandas(cut, "h long, g long, d long, at long"), "windows")
    least = windows.groupBy("h", "g").agg(F.min(F.struct("d", "at")).alias("x"), F.count("*").alias("copies")).where("copies > 1")
    least = small(written(least.select("h", "g", F.col("x.d").alias("d0"), F.col("x.at").alias("at0")), "least"))
    return windows.join(least, ["h", "g"]).where("d <> d0 or at <> at0").select("d", F.col("at").alias("lo"), (F.col("at") + LENGTH).alias("hi"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """docs: (d, base, text). (d, lo, hi): ranges of bytes that go, from base on; they may overlap."""
    shared = written(contexts(docs, False).groupBy("key").count().where("count > 1").select("key", (F.col("count") > SHARD // (2 * LENGTH)).alias("many")), "anchors")
    found = written(contexts(docs, True).join(shared.select("key"), "key"), "contexts")
    firsts = found.groupBy("key", "own").agg(F.min(F.struct("d", "at", "n")).alias("x"), F.count("*").alias("copies"))
    firsts = written(firsts.select("key", "own", "x.*", "copies"), "firsts")
    again = firsts.where("copies > 1").select("key", "own", F.col("d").alias("d0"), F.col("at").alias("at0"))
    later = found.join(again, ["key", "own"]).where("d <> d0 or at <> at0").select("d", F.col("at").alias("lo"), F.expr(f"at + n + {LENGTH - 1}").alias("hi"))

    large = large_anchors(firsts, shared)
    if large.count():
        large = small(large)
        later = later.unionByName(repeated_windows(docs, firsts.join(large, "key", "left_semi")))
        firsts = firsts.join(large, "key", "left_anti")
    wanted = _by_text(firsts, "key", "at", "n")

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for d, base, text, own in zip(b.d, b.base, b.text, b.own):
                raw = text.encode("utf-8", "surrogatepass") if text else b""
                out += [(x["key"], d, x["at"], x["n"], raw[x["at"] - base : x["at"] - base + x["n"] + LENGTH - 1]) for x in own]
            yield pd.DataFrame(out, columns=["key", "d", "at", "n", "part"])

    schema = "key long, d long, at long, n int, part binary"
    parts = docs.join(wanted, ["d", "base"]).mapInPandas(texts, schema)
    shards = max(1, parts.sparkSession.conf.get("spark.sql.shuffle.partitions") and int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = parts.repartition(shards, "key").sortWithinPartitions("key")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        total = 0
        for b in batches:
            held.append(b)
            total += int(b.part.map(len).sum())
            if total >= SHARD:  # all but the last anchor, whose contexts may go on
                own = pd.concat(held, ignore_index=True)
                whole = own.key != own.key.iloc[-1]
                if whole.any():
                    yield marks(own[whole])
                held = [own[~whole]]
                total = int(held[0].part.map(len).sum())
        if held:
            yield marks(pd.concat(held, ignore_index=True))

    def marks(own: pd.DataFrame) -> pd.DataFrame:
        own = own.drop_duplicates(["key", "part", "d", "at"])
        own = own[own.duplicated("key", keep=False)]  # a context alone with its anchor has no equal
        out = []
        if len(own):
            order = np.empty(len(own), np.int64)
            by = np.lexsort((own["at"].to_numpy(), own.d.to_numpy()))
            order[by] = np.arange(len(own))
            # One order over different contexts: where anchors differ no window is equal.
            offsets = own["at"].to_numpy()
            for d, at, gone in zip(own.d, offsets, repeats(list(own.part), own.n.to_numpy(), order)):
                out += [(d, at + lo, at + hi) for lo, hi in _spans(gone)]
        return pd.DataFrame(out, columns=["d", "lo", "hi"]).astype("int64")

    return later.unionByName(dealt.mapInPandas(search, "d long, lo long, hi long"))


def removed(docs: DataFrame) -> DataFrame:
    """(row, spans, kept): of each row, a struct of all columns of docs, the maximal ranges of bytes that go, and the bytes that stay."""
    spans = written(repeated_spans(placed(docs)), "spans")
    per = spans.groupBy("d", F.expr(f"lo - pmod(lo, {FAR})").alias("base")).agg(F.collect_list(F.struct("lo", "hi")).alias("own"))

    @F.pandas_udf("spans array<struct<lo: long, hi: long>>, kept binary")
    def cut(texts: pd.Series, bases: pd.Series, found: pd.Series) -> pd.DataFrame:
        spans, kept = [], []
        for text, base, own in zip(texts, bases, found):
            raw = text.encode("utf-8", "surrogatepass") if text else b""
            joined: list[list[int]] = []
            for x in sorted((x["lo"] - base, x["hi"] - base) for x in (own if own is not None else ())):
                if joined and x[0] <= joined[-1][1]:
                    joined[-1][1] = max(joined[-1][1], x[1])
                else:
                    joined.append(list(x))
            edges = [0, *(e for x in joined for e in x), len(raw)]
            kept.append(b"".join(raw[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)))
            spans.append([{"lo": lo, "hi": hi} for lo, hi in joined])
        return pd.DataFrame({"spans": spans, "kept": kept})

    rows = docs.select("doc_id", "text", F.struct("*").alias("row"))  # so that no name of docs can clash
    met = placed(rows, "row").join(per, ["d", "base"], "left").select("row", cut("text", "base", "own").alias("x"))
    return met.select("row", "x.spans", "x.kept")
