"""Near-duplicate documents by circulant MinHash, confirmed by the exact Jaccard similarity of their shingle sets.

Two permutations give all coordinates of a signature: one orders the shingles anew, the other, shifted by k places around
the circle of 2**32 values, gives coordinate k as the least value that it takes. BANDS bands of ROWS coordinates pick the
candidates: at a similarity of 0.85 a pair shares no band with probability (1 - 0.85**4)**32, about 6e-11.

Documents with the same set are one class. In a band's bucket each class is compared with the least class of the bucket,
so that candidates are linear in the rows. Buckets whose classes these links leave in several components are then compared
in full, in blocks of BLOCK by BLOCK classes: where signatures agree in as many coordinates as five standard deviations
below the threshold, the sets, as 32-bit hashes, are intersected in the task. A block hands on no more links than it
takes to join its components, each confirmed on the full sets; so no link between two components is lost, and what leaves
a block is linear in its classes.

Defined results: a null, empty or blank text has an empty set and is linked with nothing; a text of fewer than five words
has one shingle, the whole. Rows are told apart by id and text: rows that repeat both are one document's, and an id with several
texts stands for as many documents, whose components are joined only if their texts are linked. Rows with a null id take part as
all others; a component without any other id has a null component_id. Where one document of a group stays, it is the one with
the smallest id, null last, and then the smallest hash of its text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.components import components
from codeloom.llm.shared import small, written

WIDTH, BANDS, ROWS = 5, 32, 4
COORDINATES = BANDS * ROWS
BLOCK = 256
#: Odd multipliers: of the places in a shingle, and of the mixers below.
_PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """The set of a text: sorted 64-bit hashes of its distinct shingles of WIDTH words."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(w) - WIDTH + 1
    if n < 1:
        return _mix64((w * _PLACES[: len(w)]).sum(keepdims=True) + np.uint64(len(w)))
    total = np.zeros(n, np.uint64)
    for k in range(WIDTH):
        total += w[k : k + n] * _PLACES[k]
    return np.unique(_mix64(total))


def signature(own: np.ndarray) -> np.ndarray:
    """COORDINATES values of 32 bits of a set that isn't empty."""
    first = (_mix64(own + np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)
    least, shifts = np.full(COORDINATES, 0xFFFFFFFF, np.uint32), np.arange(COORDINATES, dtype=np.uint32)[:, None]
    for at in range(0, len(first), 1024):
        x = first[None, at : at + 1024] - shifts
        x ^= x >> np.uint32(16)
        x *= np.uint32(0x85EBCA6B)
        x ^= x >> np.uint32(13)
        x *= np.uint32(0xC2B2AE35)
        x ^= x >> np.uint32(16)
        np.minimum(least, x.min(axis=1), out=least)
    return least


def bands(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band, its number included."""
    rows = sig.reshape(BANDS, ROWS).astype(np.uint64)
    return _mix64((rows * _PLACES[:ROWS]).sum(axis=1) + np.arange(BANDS, dtype=np.uint64) * _PLACES[4]).view(np.int64)


def set_id(own: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "little", signed=True)


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, h, n_shingles, cls, bands, sig), a row for each of docs; h: a hash of the text; cls and the rest null for empty sets."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for text in b.text:
                own = shingles(text)
                sig = signature(own) if len(own) else None
                rows.append((len(own), None, None, None) if sig is None else (len(own), set_id(own), bands(sig), sig.astype(np.uint16).tobytes()))
            out = pd.DataFrame(rows, columns=["n_shingles", "cls", "bands", "sig"])
            yield pd.DataFrame({"id": b.id.array, "none": b.none.array, "h": b.h.array, "n_shingles": out.n_shingles, "cls": pd.array([r[1] for r in rows], "Int64"), "bands": out.bands, "sig": out.sig})

    # An id and whether it is null are two columns, as pandas has no null among whole numbers.
    rows = docs.select(F.coalesce("doc_id", F.lit(0)).cast("long").alias("id"), F.col("doc_id").isNull().alias("none"), F.xxhash64("text").alias("h"), "text")
    out = rows.mapInPandas(sign, "id long, none boolean, h long, n_shingles long, cls long, bands array<long>, sig binary")
    return out.select(F.when(~F.col("none"), F.col("id")).alias("doc_id"), "h", "n_shingles", "cls", "bands", "sig")


def least_agree(percent: int) -> int:
    """Coordinates that a pair at the threshold shares, less five standard deviations."""
    p = percent / 100
    return int(COORDINATES * p - 5 * (COORDINATES * p * (1 - p)) ** 0.5)


def _agreeing(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose signatures agree in least_agree(percent) coordinates."""

    @F.pandas_udf("int")
    def agree(a: pd.Series, b: pd.Series) -> pd.Series:
        x, y = (np.frombuffer(b"".join(s), np.uint16).reshape(-1, COORDINATES) for s in (a, b))
        return pd.Series((x == y).sum(axis=1), dtype="int32")

    met = pairs.join(classes.select(F.col("cls").alias("u"), F.col("sig").alias("su")), "u").join(classes.select(F.col("cls").alias("v"), F.col("sig").alias("sv")), "v")
    return met.where(agree("su", "sv") >= least_agree(percent)).select("u", "v")


def sets_of(ids: DataFrame, classes: DataFrame, docs: DataFrame, kind: str) -> DataFrame:
    """(cls, own) of the classes in ids: their sets, as array<long>, or as binary of sorted unsigned 32-bit hashes."""
    reps = small(written(classes.join(ids, "cls", "left_semi").select("rep", F.col("h").alias("_h"), "cls"), "reps"))

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 1000):
                part = b.iloc[at : at + 1000]
                own = [shingles(x) for x in part.text]
                keep = [i for i, (x, c) in enumerate(zip(own, part.cls)) if set_id(x) == c]
                shape = (lambda x: x.view(np.int64)) if kind == "array<long>" else (lambda x: np.unique((x >> np.uint64(32)).astype(np.uint32)).tobytes())
                if keep:
                    yield pd.DataFrame({"cls": part.cls.iloc[keep].array, "own": pd.Series([shape(own[i]) for i in keep], dtype=object)})

    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    met = rows.join(reps, F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("h") == F.col("_h"))).select("text", "cls")
    return met.mapInPandas(sets, f"cls long, own {kind}").dropDuplicates(["cls"])


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) of classes whose full sets have 100 * intersection >= percent * union."""
    ids = pairs.select(F.col("u").alias("cls")).unionByName(pairs.select(F.col("v").alias("cls"))).distinct()
    own = written(sets_of(ids, classes, docs, "array<long>"), "sets")
    met = pairs.join(own.select(F.col("cls").alias("u"), F.col("own").alias("a")), "u").join(own.select(F.col("cls").alias("v"), F.col("own").alias("b")), "v")
    shared = F.size(F.array_intersect("a", "b"))
    return met.where(100 * shared >= percent * (F.size("a") + F.size("b") - shared)).select("u", "v")


def _across(members: DataFrame, percent: int) -> DataFrame:
    """members: (key, cls, sig, own, component, n) of buckets with n classes. Links that join their components."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")
    m = members.withColumn("blocks", blocks).withColumn("mine", dealt).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    m = m.select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "cls", "component", "sig", "own")

    least = least_agree(percent)

    def compare(b: pd.DataFrame) -> pd.DataFrame:
        sig = np.frombuffer(b"".join(b.sig), np.uint16).reshape(-1, COORDINATES)
        sets = [np.frombuffer(x, np.uint32) for x in b.own]
        sizes = np.array([len(x) for x in sets])
        cls, comp, mine = b.cls.to_numpy(), b.component.to_numpy().copy(), b.mine.to_numpy()
        i, j = b.i.iloc[0], b.j.iloc[0]
        left, right = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
        found = []
        for x in left:
            y = right[(comp[right] != comp[x]) & ((cls[right] > cls[x]) | (i != j))]
            y = y[100 * np.minimum(sizes[y], sizes[x]) >= (percent - 1) * np.maximum(sizes[y], sizes[x])]
            for k in y[(sig[y] == sig[x]).sum(axis=1) >= least]:
                if comp[k] == comp[x]:
                    continue
                a, c = sets[x], sets[k]
                at = np.searchsorted(a, c)
                shared = int((a[np.minimum(at, len(a) - 1)] == c).sum())
                # 32-bit hashes only ever make sets look a little smaller or nearer, so a little less than percent will do.
                if 100 * shared >= (percent - 0.5) * (len(a) + len(c) - shared):
                    found.append((min(cls[x], cls[k]), max(cls[x], cls[k])))
                    if 100 * shared >= (percent + 0.5) * (len(a) + len(c) - shared):
                        comp[comp == comp[k]] = comp[x]
        return pd.DataFrame(found, columns=["u", "v"], dtype="int64")

    return m.groupBy("key", "i", "j").applyInPandas(compare, "u long, v long").distinct()


#: The order of a component's documents: the first is the one that stays.
_ORDER = ("none", "doc_id", "h")


def grouped(docs: DataFrame, percent: int = 85) -> DataFrame:
    """(doc_id, h, n_shingles, component_id, stays), a row for each of docs: 100 * intersection >= percent * union links two documents."""
    signed = written(signatures(docs), "signed")
    full = signed.where("n_shingles > 0").withColumn("none", F.col("doc_id").isNull())
    first = F.min_by(F.struct("doc_id", "h", "bands", "sig"), F.struct(*_ORDER)).alias("x")
    classes = full.groupBy("cls").agg(first, (F.min(F.struct(*_ORDER)) != F.max(F.struct(*_ORDER))).alias("several"))
    classes = written(classes.select("cls", F.col("x.doc_id").alias("rep"), "x.h", "several", "x.bands", "x.sig"), "classes")
    keyed = classes.select("cls", F.explode("bands").alias("key"))
    buckets = written(keyed.groupBy("key").agg(F.min("cls").alias("centre"), F.count("*").alias("n")).where("n > 1"), "buckets")
    members = written(keyed.join(buckets, "key"), "members")
    pairs = members.where("cls <> centre").select(F.col("centre").alias("u"), F.col("cls").alias("v")).distinct()
    near = written(_agreeing(pairs, classes, percent), "pairs")
    links = written(confirmed(near, classes, docs, percent), "links")
    linked = written(components(links), "linked")

    # Buckets of two have been compared; of the others, those that still hold several components.
    rest = members.where("n > 2").join(linked, members["cls"] == linked["node"], "left").select("key", "cls", "n", F.coalesce("component", "cls").alias("component"))
    rest = written(rest, "rest")
    split = written(rest.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key"), "split")
    rest = written(rest.join(split, "key"), "rest")
    sets = written(sets_of(rest.select("cls").distinct(), classes, docs, "binary"), "sets")
    rest = rest.join(classes.select("cls", "sig"), "cls").join(sets, "cls")
    more = written(_across(rest, percent), "pairs")
    links = written(links.unionByName(confirmed(more, classes, docs, percent)), "links")
    linked = written(components(links), "linked")

    named = classes.select("cls", "rep", "h", "several").join(linked, classes["cls"] == linked["node"], "left")
    alone = named.where("node is null and several").select("cls", F.col("rep").alias("component_id"), F.col("h").alias("least_h"))
    joined = written(named.where("node is not null").select("cls", F.col("rep").isNull().alias("none"), F.col("rep").alias("doc_id"), "h", "component"), "named")
    least = written(joined.groupBy("component").agg(F.min(F.struct(*_ORDER)).alias("x")).select("component", F.col("x.doc_id").alias("component_id"), F.col("x.h").alias("least_h")), "least")
    known = joined.join(least, "component").select("cls", "component_id", "least_h").unionByName(alone)
    known = written(known.withColumn("grouped", F.lit(True)), "known")
    out = signed.select("doc_id", "h", "n_shingles", "cls").join(known, "cls", "left")
    stays = F.col("grouped").isNull() | (F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("h") == F.col("least_h")))
    return out.select("doc_id", "h", "n_shingles", F.when(F.col("grouped"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), stays.alias("stays"))


def groups(docs: DataFrame, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each of docs."""
    return grouped(docs, percent).select("doc_id", "n_shingles", "component_id")


def deduplicated(docs: DataFrame, percent: int = 85) -> DataFrame:
    """One document of each group, with the columns of docs."""
    keep = grouped(docs, percent).where("stays").select(F.col("doc_id").alias("id"), "h").distinct()
    # Whole rows are one column, so that no name of docs can clash.
    rows = docs.select(F.struct("*").alias("row"))
    return rows.join(keep, F.col("row.doc_id").eqNullSafe(F.col("id")) & (F.xxhash64("row.text") == F.col("h")), "left_semi").select("row.*")
