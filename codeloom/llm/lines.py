"""Line deduplication by a segment-partition edit join.

Lines within EDITS edits of each other share one of EDITS + 1 segments: of a line cut into that many parts, one part at
least is found unchanged in the other line, near its place. The distinct lines index their segments by length and number
of the segment, and probe for those of lines that are up to EDITS shorter, at the places alone that EDITS edits allow. What
has one key meets in a bucket. A sketch of the counts of characters (a bit for each of 32 groups: odd or even) must differ in
no more bits than EDITS edits can change, two each; lines without such a partner in the bucket leave it.

A line is a repeat if an earlier line (by doc_id, text and number of the line) equals it or is within EDITS edits of it. So a
bucket need not hand on its pairs. Its lines are taken in order, and each is compared by a banded bit-parallel edit distance
with the earlier ones until it is known as a repeat, and with one line at most of each class of lines that it has been
linked with. What leaves a bucket are the links of a spanning forest: fewer than it has lines, though every line that has an
earlier neighbour has a link to one, and lines that links join, over any number of them, stay joined.

A bucket of more than DEAL lines, such as those of one template with a number in it, is dealt anew by grams of up to three
characters, numbered by how often they have come in the line before. Two edits destroy at most EDITS * q grams of q
characters, so of each line's EDITS * q + 1 rarest grams in the bucket, in one order for all its lines, two lines that are
near share at least one: those are the keys of smaller buckets, and so on as long as a bucket has at most 1 / SHRINK of the
lines of the one that it came from. Other buckets of more than BLOCK lines are dealt into blocks by a hash; then the blocks
meet, each task holding one of them while the lines of the others stream by, and only lines that are no repeats yet, or of
different classes, are compared. A sketch of the counts of pairs of characters (128 bits, four for an edit) tells in a block
which of them need the distance.

Lines are what splits at \\n. Blank ones, and those of fewer than `short` code points (1: none), take no part and are always kept. Lines of up to EDITS code points are all within EDITS edits of each other, so
they repeat by equality alone; longer ones are compared with those of more than EDITS code points.

Defined results: a null or empty text has no line that takes part; rows with the same id and text share their places, so
that their lines are no repeats of each other, and each has its row; rows with the same id and different texts are documents
of their own, in the order of a hash of their texts; a null id comes before all others; other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.components import components
from codeloom.llm.shared import small, written

EDITS = 2
#: Rows up to which a bucket's lines are looked through at once for partners, and up to which they are compared at once.
MEET, BLOCK = 1024, 2048
#: Lines from which on a bucket is dealt anew by its rarest grams, and by how much each of the new buckets must be smaller.
DEAL, SHRINK = 4 * BLOCK, 4
_NULL = -(1 << 63)
BLANK = " \t\n\v\f\r"


def segments(length: int, edits: int = EDITS) -> list[tuple[int, int]]:
    """Start and length of each of edits + 1 parts, the last ones longer by 1."""
    base, longer = divmod(length, edits + 1)
    out, at = [], 0
    for i in range(edits + 1):
        size = base + (i >= edits + 1 - longer)
        out.append((at, size))
        at += size
    return out


def places(length: int, shorter: int, edits: int = EDITS) -> list[tuple[int, int, int]]:
    """(number of the segment, start, length) at which a line probes for the segments of a line `shorter` characters shorter.

    A segment with i before it and edits - i after it has moved by at most i edits seen from the left, and by as many as
    are left over seen from the right.
    """
    out = []
    for i, (at, size) in enumerate(segments(length - shorter, edits)):
        low = max(0, at - i, at + shorter - (edits - i))
        high = min(length - size, at + i, at + shorter + (edits - i))
        out += [(i, p, size) for p in range(low, high + 1)]
    return out


def within(a: str, b: str, edits: int = EDITS) -> bool:
    """Whether the edit distance is at most `edits`: bit-parallel in a band of diagonals, after equal ends are cut off."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > edits:
        return False
    x, y = (np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32) for s in (a, b))
    n = len(x)
    same = x == y[:n]
    head = n if same.all() else int(same.argmin())
    tail_same = x[head:][::-1] == y[head:][::-1][: n - head]
    tail = n - head if tail_same.all() else int(tail_same.argmin())
    a, b = a[head : n - tail], b[head : len(b) - tail]
    m, wide = len(a), 2 * edits + 1
    if m == 0 or len(b) <= edits:
        return len(b) <= edits
    # Bit d of level e: with e edits, all of b's first j characters match a's first j + d - edits. One word a level.
    full = (1 << wide) - 1
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | (1 << i)
    levels = [0] * (edits + 1)
    for e in range(edits + 1):
        for d in range(edits, edits + e + 1):  # the first d - edits characters of a deleted
            if d - edits <= m:
                levels[e] |= 1 << d
    for j, c in enumerate(b):
        hits, at = where.get(c, 0), j - edits  # bit d of the band stands for the character a[at + d]
        band = (hits >> at if at >= 0 else hits << -at) & full
        limit = m - (j + 1) + edits  # diagonals beyond the end of a
        inside = full if limit >= wide - 1 else (1 << (limit + 1)) - 1 if limit >= 0 else 0
        if at < 0:
            inside &= ~((1 << max(0, -(j + 1) + edits)) - 1)
        before, fresh = 0, 0
        for e in range(edits + 1):
            old = levels[e]
            fresh = old & band  # a match keeps the diagonal
            if e:
                fresh |= levels_before | (levels_before >> 1) | (before << 1)  # change, insertion into b, deletion from a
            fresh &= inside & full
            levels_before, before = old, fresh
            levels[e] = fresh
        if not fresh:
            return False
    end = m - len(b) + edits
    return any(level >> end & 1 for level in levels)


def _hash(x: str) -> int:
    return xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass"))


def _signed(x: list[int]) -> np.ndarray:
    return np.array(x, np.uint64).view(np.int64)


def sketches(texts: list[str]) -> np.ndarray:
    """32 bits for each text: whether the characters of each group occur an odd number of times."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    group = (codes * np.uint32(0x9E3779B1)) >> np.uint32(27)
    counts = np.bincount(np.repeat(np.arange(len(texts)) * 32, sizes) + group, minlength=32 * len(texts))
    return np.packbits((counts & 1).astype(np.uint8).reshape(-1, 32), axis=1, bitorder="little").view("<i4").ravel()


def _parities(owner: np.ndarray, group: np.ndarray, n: int, bits: int) -> np.ndarray:
    counts = np.bincount(owner * bits + group.astype(np.int64), minlength=bits * n)
    return np.packbits((counts & 1).astype(np.uint8).reshape(-1, bits), axis=1, bitorder="little")


def pair_sketches(texts: list[str]) -> np.ndarray:
    """Two words of 64 bits for each text: whether the pairs of characters of each group occur an odd number of times."""
    out = [np.zeros((0, 2), np.uint64)]
    for at in range(0, len(texts), 256):  # so that few counts are held at once
        some = texts[at : at + 256]
        line, pair = grams(some, 2, numbered=False)
        out.append(_parities(line, (pair * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(57), len(some), 128).view(np.uint64))
    return np.concatenate(out)


def grams(texts: list[str], q: int, numbered: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(number of the text, gram) of all grams of q <= 3 characters; numbered: a hash of the gram and of its number among equal ones."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    line, ends = np.repeat(np.arange(len(texts)), sizes), np.repeat(np.cumsum(sizes), sizes)
    at = np.flatnonzero(np.arange(len(codes)) + q <= ends)
    line, gram = line[at], codes[at]
    for j in range(1, q):  # 21 bits a character
        gram = (gram << np.uint64(21)) | codes[at + j]
    if not numbered or not len(gram):
        return line, gram
    order = np.lexsort((gram, line))
    line, gram = line[order], gram[order]
    fresh = np.append(True, (line[1:] != line[:-1]) | (gram[1:] != gram[:-1]))
    return line, _mixed(gram, _rank(fresh))


def _rank(fresh: np.ndarray) -> np.ndarray:
    """The place of each row after the last one that is marked as fresh."""
    here = np.arange(len(fresh))
    return here - np.maximum.accumulate(np.where(fresh, here, 0))


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def rows_of(docs: DataFrame) -> DataFrame:
    """(doc, text_id, text): what tells one row from another, and the order of the rows."""
    return docs.select(F.coalesce("doc_id", F.lit(_NULL)).cast("long").alias("doc"), F.xxhash64("text").alias("text_id"), "text")


def lines_of(docs: DataFrame, short: int = 1) -> DataFrame:
    """(doc, text_id, line, id, sketch, keys, probes): each line that takes part, the hash of its text, of its segments and probes.

    In a task only the first of equal lines has keys and probes; but after many lines, one more may. Lines of up to EDITS
    code points have none."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plans: dict[int, tuple] = {}
        seen: set[int] = set()
        for b in (part.iloc[at : at + 500] for part in batches for at in range(0, len(part), 500)):  # so that few lines are held at once
            owner, line, ids, index_of, fresh = [], [], [], [], []
            if len(seen) > 500_000:
                seen.clear()
            all_keys, all_probes = [], []
            for doc, text in enumerate(b.text):
                for k, x in enumerate(text.split("\n") if text else ()):
                    n = len(x)
                    if n < short or not x.strip(BLANK):
                        continue
                    own = _hash(x)
                    owner.append(doc)
                    line.append(k)
                    ids.append(own)
                    if n <= EDITS or own in seen:
                        all_keys.append(None)
                        all_probes.append(None)
                        continue
                    seen.add(own)
                    index_of.append(len(ids) - 1)
                    fresh.append(x)
                    if n not in plans:
                        if len(plans) > 20_000:
                            plans.clear()
                        still = {(i, at, size) for i, (at, size) in enumerate(segments(n))}
                        plans[n] = (sorted(still), [(s, *p) for s in range(EDITS + 1) for p in places(n, s) if n - s > EDITS and (s or p not in still)])
                    index, probe = plans[n]
                    # A key: the text of the segment, its number and the length of the line that it indexes.
                    keys = [_hash(x[at : at + size]) + (n * 8 + i) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF for i, at, size in index]
                    probes = [_hash(x[at : at + size]) + ((n - s) * 8 + i) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF for s, i, at, size in probe]
                    all_keys.append(_signed(keys))
                    all_probes.append(_signed(probes))
            sketch = np.zeros(len(ids), np.int32)
            if fresh:
                sketch[index_of] = sketches(fresh)
            yield pd.DataFrame({
                "doc": b.doc.to_numpy()[owner] if owner else np.zeros(0, np.int64), "text_id": b.text_id.to_numpy()[owner] if owner else np.zeros(0, np.int64),
                "line": np.array(line, np.int32), "id": _signed(ids), "sketch": sketch, "keys": pd.Series(all_keys, dtype=object), "probes": pd.Series(all_probes, dtype=object),
            })

    return rows_of(docs).mapInPandas(cut, "doc long, text_id long, line int, id long, sketch int, keys array<long>, probes array<long>")


def _partners(key: np.ndarray, own: np.ndarray, sketch: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Rows sorted by key, those of the index first: which have a different line in their bucket that they may be near; in
    buckets above MEET rows all, if any is of the index."""
    hit, n = np.zeros(len(key), bool), len(key)
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    sizes = np.diff(np.append(starts, n))
    large = np.repeat(sizes > MEET, sizes)
    hit[large & np.repeat(index[starts], sizes)] = True
    here, d = np.flatnonzero(~large & np.repeat(sizes > 1, sizes)), 1
    while len(here):
        here = here[here + d < n]
        here = here[key[here] == key[here + d]]
        there = here + d
        some = (index[here] | index[there]) & (own[here] != own[there])
        some &= np.bitwise_count(sketch[here] ^ sketch[there]) <= 2 * EDITS
        hit[here[some]] = True
        hit[there[some]] = True
        d += 1
    return hit


def buckets(firsts: DataFrame) -> DataFrame:
    """firsts: (id, sketch, keys, probes). (key, id) of the lines that may have a partner in the bucket; written."""
    every = firsts.where("keys is not null")
    one = lambda name: every.select(F.explode(name).alias("key"), "id", "sketch", F.lit(name == "keys").alias("index"))

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, passing, indexed = None, None, False

        def out(key: np.ndarray, own: np.ndarray) -> pd.DataFrame:
            return pd.DataFrame({"key": key, "id": own}).drop_duplicates()

        for b in batches:
            rows = [b.key.to_numpy(), b.id.to_numpy(), b.sketch.to_numpy().view(np.uint32), b["index"].to_numpy(bool)]
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows)]
            key = rows[0]
            if passing is not None:  # a bucket that has grown beyond MEET goes on as it is
                n = int(np.searchsorted(key, passing, "right"))
                if n and indexed:
                    yield out(key[:n], rows[1][:n])
                rows = [x[n:] for x in rows]
                key = rows[0]
                passing = passing if not len(key) else None
            held = None
            if not len(key):
                continue
            whole = int(np.searchsorted(key, key[-1], "left"))  # the last bucket may go on
            held = [x[whole:] for x in rows]
            if len(held[0]) > MEET:
                passing, indexed, held, whole = key[-1], bool(rows[3][whole]), None, len(key)
            hit = _partners(*(x[:whole] for x in rows))
            if hit.any():
                yield out(key[:whole][hit], rows[1][:whole][hit])
        if held is not None:
            hit = _partners(*held)
            yield out(held[0][hit], held[1][hit])

    met = one("keys").unionByName(one("probes")).repartition("key").sortWithinPartitions("key", F.desc("index"))
    return written(met.mapInPandas(meet, "key long, id long"), "buckets")


def texts_of(ids: DataFrame, firsts: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, doc, text_id, line, text) of the lines in ids, read from the documents where they are first; written."""
    wanted = firsts.join(ids, "id", "left_semi").groupBy("doc", "text_id").agg(F.collect_list(F.struct("line", "id")).alias("own"))
    wanted = small(written(wanted, "wanted"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc, text_id, text, own in zip(b.doc, b.text_id, b.text, b.own):
                cut = text.split("\n")
                out += [(x["id"], doc, text_id, x["line"], cut[x["line"]]) for x in own]
            yield pd.DataFrame(out, columns=["id", "doc", "text_id", "line", "text"])

    schema = "id long, doc long, text_id long, line int, text string"
    return written(rows_of(docs).join(wanted, ["doc", "text_id"]).mapInPandas(read, schema).dropDuplicates(["id"]), "texts")


class _Block:
    """The lines of a bucket, or of a block of it, in order, with their classes and whether they are known as repeats."""

    def __init__(self, ids: list, places: list[tuple], texts: list[str], group: list, known: list):
        self.ids, self.places, self.texts = ids, places, texts
        self.sketch, self.pairs = sketches(texts).view(np.uint32), pair_sketches(texts)
        self.lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.group, self.known = np.array(group, np.int64), np.array(known, bool)
        self.links: list[tuple[int, int]] = []

    def near(self, sketch, pairs, length: int, wanted: np.ndarray) -> np.ndarray:
        """The wanted lines, of the first ones, whose sketches and lengths allow EDITS edits."""
        n = len(wanted)
        x = np.flatnonzero(wanted & (np.bitwise_count(self.sketch[:n] ^ sketch) <= 2 * EDITS) & (np.abs(self.lengths[:n] - length) <= EDITS))
        return x[np.bitwise_count(self.pairs[x] ^ pairs).sum(axis=1) <= 4 * EDITS]

    def inside(self) -> None:
        """Links each line with an earlier one, and with one of each class beside its own."""
        for k in range(1, len(self.ids)):
            wanted = np.ones(k, bool) if not self.known[k] else self.group[:k] != self.group[k]
            for y in self.near(self.sketch[k], self.pairs[k], self.lengths[k], wanted):
                if (self.group[y] != self.group[k] or not self.known[k]) and within(self.texts[y], self.texts[k]):
                    self.links.append((self.ids[y], self.ids[k]))
                    self.known[k] = True
                    self.group[self.group == self.group[y]] = self.group[k]

    def across(self, own: int, place: tuple, text: str, group: int, same: dict[int, int], sketch, pairs) -> None:
        """Links a line of another block with these. same: classes that have been joined here since."""
        while group in same:
            group = same[group]
        for x in self.near(sketch, pairs, len(text), (self.group != group) | ~self.known):
            later = place < self.places[x]
            if (self.group[x] != group or (later and not self.known[x])) and within(text, self.texts[x]):
                self.links.append((own, self.ids[x]) if later else (self.ids[x], own))
                self.known[x] |= later
                if self.group[x] != group:
                    gone = int(self.group[x])
                    self.group[self.group == gone] = group
                    same[gone] = group


def dealt_anew(cand: DataFrame, own: DataFrame) -> DataFrame:
    """cand, own: as for `forest`. The buckets, those of more than DEAL lines split by the rarest grams of their lines, so that
    lines within EDITS edits of each other that shared a bucket still share one."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in (part.iloc[at : at + 1000] for part in batches for at in range(0, len(part), 1000)):
            for q, rows in b.groupby("q"):
                line, gram = grams(rows.text.tolist(), int(q))
                found = pd.DataFrame({"key": rows.key.to_numpy()[line], "gram": gram.view(np.int64)})
                yield found.groupby(["key", "gram"]).size().reset_index(name="c")

    def deal(here: pd.DataFrame, often: pd.DataFrame) -> pd.DataFrame:
        if not len(here):
            return pd.DataFrame({"key": [], "id": [], "parent": []}, dtype="int64")
        q = int(here.q.iloc[0])
        line, gram = grams(here.text.tolist(), q)
        rarity = np.zeros(len(gram), np.int64)  # all grams that aren't frequent are alike
        if len(often):
            known, c = np.asarray(often["grams"].iloc[0], np.int64).view(np.uint64), np.asarray(often["counts"].iloc[0], np.int64)
            sort = np.argsort(known)
            at = np.minimum(np.searchsorted(known[sort], gram), len(known) - 1)
            rarity = np.where(known[sort][at] == gram, c[sort][at], 0)
        order = np.lexsort((gram, rarity, line))
        line, gram = line[order], gram[order]
        rarest = _rank(np.append(True, line[1:] != line[:-1])) <= EDITS * q
        line, gram = line[rarest], gram[rarest]
        key = _mixed(np.full(len(gram), here.key.iloc[0]).astype(np.int64).view(np.uint64), gram).view(np.int64)
        return pd.DataFrame({"key": key, "id": here.id.to_numpy()[line], "parent": here.n.to_numpy()[line]})

    parts, now = [], cand.withColumn("parent", F.lit(None).cast("long"))
    while True:
        sizes = now.groupBy("key").agg(F.count("*").alias("n"), F.max("parent").alias("parent"))
        some = now.join(sizes.where("n > 1"), "key", "left_semi") if parts else now
        sizes = written(sizes.where((F.col("n") > DEAL) & (F.col("parent").isNull() | (F.col("n") * SHRINK <= F.col("parent")))), "large")
        if sizes.isEmpty():
            return written(reduce(DataFrame.unionByName, [*parts, some.select("key", "id")]), "buckets") if parts else cand
        sizes = small(sizes.select("key", "n"))
        parts.append(some.join(sizes, "key", "left_anti").select("key", "id"))
        rows = written(now.select("key", "id").join(sizes, "key").join(own.select("id", "text"), "id"), "rows")
        # Lines of 3 * q characters and more have more grams than EDITS edits destroy.
        q = written(rows.groupBy("key").agg(F.least(F.lit(3), F.expr(f"min(length(text)) div {EDITS + 1}")).cast("int").alias("q")), "widths")
        rows = rows.join(small(q), "key")
        often = rows.select("key", "q", "text").mapInPandas(count, "key long, gram long, c long").groupBy("key", "gram").agg(F.sum("c").alias("c"))
        often = often.join(sizes, "key").where(F.col("c") * 32 > F.col("n")).groupBy("key", "n").agg(F.collect_list(F.struct("gram", "c")).alias("x"))
        blocks = F.ceil(F.col("n") / BLOCK).cast("int")
        often = often.select("key", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.col("x.gram").alias("grams"), F.col("x.c").alias("counts"))
        here = rows.withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int")).groupBy("key", "block")
        now = written(here.cogroup(often.groupBy("key", "block")).applyInPandas(deal, "key long, id long, parent long"), "dealt")


def forest(cand: DataFrame, own: DataFrame) -> DataFrame:
    """cand: (key, id) of the lines of each bucket; own: their texts. (u, v), u before v: links within EDITS edits that give
    every line an earlier neighbour if it has one, and join whatever links join."""
    schema = "key long, block int, id long, doc long, text_id long, line int, text string, group long, known boolean"
    columns = [x.split()[0] for x in schema.split(", ")]
    cand = dealt_anew(cand, own)
    large = cand.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("blocks > 1")
    large = written(large, "large")
    split = large.count() > 0
    large = small(large)
    dealt = cand.join(large, "key", "left") if split else cand.withColumn("blocks", F.lit(None).cast("int"))
    dealt = dealt.withColumn("block", F.coalesce(F.pmod(F.xxhash64("id"), F.col("blocks")), F.lit(0)).cast("int"))
    first = dealt.join(own, "id").withColumn("group", F.col("id")).withColumn("known", F.lit(False))

    def inside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, []
        for b in batches:
            out: list[tuple[int, int]] = []
            for r in zip(*(b[c].tolist() for c in columns)):
                if r[:2] != at:
                    out += found(held)
                    at, held = r[:2], []
                held.append(r)
            yield pd.DataFrame(out, columns=["u", "v"], dtype="int64")
        yield pd.DataFrame(found(held), columns=["u", "v"], dtype="int64")

    def block_of(rows: list[tuple]) -> _Block:
        return _Block([r[2] for r in rows], [r[3:6] for r in rows], [r[6] for r in rows], [r[7] for r in rows], [r[8] for r in rows])

    def found(rows: list[tuple]) -> list[tuple[int, int]]:
        if len(rows) == 2:
            return [(rows[0][2], rows[1][2])] if within(rows[0][6], rows[1][6]) else []
        if len(rows) < 2:
            return []
        block = block_of(rows)
        block.inside()
        return block.links

    sorted_ = lambda df, *c: df.select(*c).repartition("key", "block").sortWithinPartitions("key", "block", *c[9:], "doc", "text_id", "line")
    links = written(sorted_(first, *columns).mapInPandas(inside, "u long, v long").distinct(), "links")
    if not split:
        return links

    # Each block of a large bucket meets the lines of its other blocks, which stream by.
    groups, repeats_ = written(components(links), "groups"), links.select(F.col("v").alias("id")).distinct().withColumn("known", F.lit(True))
    rows = dealt.where("blocks is not null").join(own, "id").join(repeats_, "id", "left")
    rows = rows.join(groups, rows["id"] == groups["node"], "left").withColumn("group", F.coalesce("component", "id")).withColumn("known", F.coalesce("known", F.lit(False)))
    here = rows.select(*columns)
    others = rows.select(*columns, "blocks").withColumn("own", F.col("block")).withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)"))).where("block <> own").drop("blocks")
    met = here.withColumn("other", F.lit(0)).unionByName(others.drop("own").withColumn("other", F.lit(1)))

    def across(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, gathered, block, same = None, [], None, {}
        for b in batches:
            for r, sketch, pairs in zip(zip(*(b[c].tolist() for c in [*columns, "other"])), sketches(b.text.tolist()).view(np.uint32), pair_sketches(b.text.tolist())):
                if r[:2] != at:
                    at, gathered, block, same = r[:2], [], None, {}
                if not r[9]:
                    gathered.append(r)
                    continue
                if block is None:
                    if not gathered:  # a block that the hash left empty
                        continue
                    block = block_of(gathered)
                block.across(r[2], r[3:6], r[6], r[7], same, sketch, pairs)
                if block.links:
                    yield pd.DataFrame(block.links, columns=["u", "v"], dtype="int64")
                    block.links = []

    return written(links.unionByName(sorted_(met, *columns, "other").mapInPandas(across, "u long, v long")).distinct(), "links")


def links(firsts: DataFrame, docs: DataFrame) -> DataFrame:
    """(u, v), u before v: ids of different lines within EDITS edits of each other, as `forest` has them."""
    cand = buckets(firsts)
    return forest(cand, texts_of(cand.select("id").distinct(), firsts, docs))


def repeats(docs: DataFrame, short: int = 1, classes: bool = True) -> tuple[DataFrame, DataFrame]:
    """(doc, text_id, line, near, of) of the lines that repeat an earlier one, near if none that equals them is earlier; `of`
    is the doc_id where their class begins (null if classes aren't asked for). And all lines: (doc, text_id, line, id)."""
    lines = written(lines_of(docs, short), "lines")
    some = F.when(F.col("keys").isNotNull(), F.struct("sketch", "keys", "probes"))
    firsts = lines.groupBy("id").agg(F.min(F.struct("doc", "text_id", "line")).alias("first"), F.count("*").alias("n"), F.first(some, ignorenulls=True).alias("x"))
    firsts = written(firsts.select("id", "first.*", "n", "x.*"), "firsts")
    near = links(firsts, docs)
    later = near.select(F.col("v").alias("id")).distinct().withColumn("later", F.lit(True))
    place = F.struct("doc", "text_id", "line")
    known = firsts.select("id", "n", place.alias("first")).join(later, "id", "left").where("n > 1 or later")
    if classes:
        groups = written(components(near), "groups")
        at = groups.join(firsts.select("id", "doc", place.alias("at")), groups["node"] == F.col("id"))
        least = at.groupBy("component").agg(F.min_by("doc", "at").alias("begins"))
        of = groups.join(least, "component").select(F.col("node").alias("id"), "begins")
        known = known.join(of, "id", "left").withColumn("of", F.coalesce("begins", "first.doc"))
        known = known.withColumn("of", F.nullif("of", F.lit(_NULL)))
    else:
        known = known.withColumn("of", F.lit(None).cast("long"))
    known = small(written(known.select("id", "first", F.coalesce("later", F.lit(False)).alias("later"), "of"), "known"))
    is_first = place == F.col("first")
    met = lines.select("doc", "text_id", "line", "id").join(known, "id").where(~is_first | F.col("later"))
    return met.select("doc", "text_id", "line", is_first.alias("near"), "of"), lines.select("doc", "text_id", "line", "id")


def report(docs: DataFrame, short: int = 1) -> DataFrame:
    """(doc_id, n_lines, n_exact, n_near, repeats, classes), a row for each of docs: its lines that take part, those that repeat
    an earlier one exactly or nearly, the numbers of the repeats from 0, and for each the doc_id where its class begins: of
    all the lines that links join, the earliest one's."""
    out, lines = repeats(docs, short)
    exact = F.sum(F.when(~F.col("near"), 1).otherwise(0))
    per = out.groupBy("doc", "text_id").agg(
        exact.alias("n_exact"), F.sum(F.when(F.col("near"), 1).otherwise(0)).alias("n_near"), F.array_sort(F.collect_set(F.struct("line", "of"))).alias("all")
    )
    counts = lines.groupBy("doc", "text_id").agg(F.count("*").alias("n_lines"))
    # Rows with the same id and text have counted each other's lines.
    ids = rows_of(docs).groupBy("doc", "text_id").agg(F.count("*").alias("rows"))
    every = ids.join(counts, ["doc", "text_id"], "left").join(per, ["doc", "text_id"], "left")
    every = every.withColumn("row", F.explode(F.expr("sequence(1, rows)")))
    share = lambda c: F.expr(f"coalesce({c} div rows, 0)").cast("long").alias(c)
    list_ = lambda c, t: F.coalesce(F.col(f"all.{c}"), F.array().cast(f"array<{t}>"))
    return every.select(F.nullif("doc", F.lit(_NULL)).alias("doc_id"), share("n_lines"), share("n_exact"), share("n_near"), list_("line", "int").alias("repeats"), list_("of", "long").alias("classes"))


def deduplicated(docs: DataFrame, short: int = 1) -> DataFrame:
    """The documents without the lines that repeat earlier ones, with the columns of docs; a document none of whose words
    are left goes, if it had any."""
    out, _ = repeats(docs, short, classes=False)
    per = out.groupBy("doc", "text_id").agg(F.collect_set("line").alias("drop"))

    @F.pandas_udf("string")
    def without(texts: pd.Series, drops: pd.Series) -> pd.Series:
        kept = []
        for text, drop in zip(texts, drops):
            if drop is not None:
                gone = set(map(int, drop))
                text = "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone)
            kept.append(text)
        return pd.Series(kept, dtype=object)

    # Whole rows are one column, so that no name of docs can clash.
    rows = docs.select(F.struct("*").alias("row"), F.coalesce("doc_id", F.lit(_NULL)).cast("long").alias("doc"), F.xxhash64("text").alias("text_id"))
    met = rows.join(per, ["doc", "text_id"], "left").withColumn("kept", F.when(F.col("drop").isNull(), F.col("row.text")).otherwise(without("row.text", "drop")))
    met = met.where(F.col("drop").isNull() | F.col("kept").rlike(r"[^\x20\x09-\x0D]"))
    field = lambda c: F.col("row").getField(c)
    columns = []
    for c in docs.columns:
        if c == "text":
            x = F.col("kept")
        elif c == "n_chars":
            x = F.when(F.col("drop").isNull(), field(c)).otherwise(F.length("kept")).cast(docs.schema[c].dataType)
        else:
            x = field(c)
        columns.append(x.alias(c))
    return met.select(*columns)
