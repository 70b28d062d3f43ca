"""The training-data operators against brute force, round trips and held-out figures, on small made-up rows."""

import base64
import hashlib
import io
import itertools
import math
import os
import random
import time
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.llm import alignment, components, langid, lines, lm, minhash, mixing, packing, periodic, quality, suffixes, topk, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = ["alpha", "beta", "gamma", "delta", "eps", "zeta,", "Eta", "theta.", "iota", "kappa", "été", "ñu"]


def text_of(rng, n):
    out = []
    for _ in range(n):
        out.append(rng.choice(WORDS) + rng.choice(["", "", "x", "y", "zz"]) + rng.choice([" ", " ", " ", "\n"]))
    return "".join(out)


@pytest.fixture(scope="module")
def rows():
    """Random texts, exact and near copies, nulls, blanks, a long text, repeated rows."""
    rng = random.Random(7)
    texts = [text_of(rng, rng.choice([1, 3, 20, 80, 200])) for _ in range(60)]
    texts += [texts[5], texts[5], None, "", " \n\t ", "one two", "one two", "é" * 300 + " " + "é" * 300, text_of(rng, 9000)]
    base = text_of(rng, 120).split(" ")
    for _ in range(20):
        own = list(base)
        for _ in range(rng.choice([0, 1, 2, 6])):
            own[rng.randrange(len(own))] = "changed"
        texts.append(" ".join(own))
    out = [(i, t, "en", None if i % 11 == 0 else f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    return out + [out[5], out[62]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumnRenamed("lang", "key").repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return (t or "").encode().split()


def test_quality(docs, rows, empty):
    got = {(r.doc_id): r for r in quality.ledger(docs).collect()}
    for i, t, *_ in rows:
        w = words(t)
        tri = Counter(zip(w, w[1:], w[2:]))
        hit = {k + j for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for j in range(3)}
        ls = [x for x in (t or "").split("\n") if x.strip()]
        r = got[i]
        assert (r.n_words, r.n_repeat_words, r.n_dup_lines) == (len(w), len(hit), len(ls) - len(set(ls)))
        assert r.word_chars == sum(len(x.decode()) for x in w)
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in t or "")
        assert bool(r.bits & 1) == (len(w) < 50)
    kept = quality.filtered(docs)
    assert kept.columns == docs.columns
    assert kept.count() == sum(1 for i, *_ in rows if got[i].bits == 0)
    table = {r.rule: r for r in quality.ablations(quality.ledger(docs)).collect()}
    assert table["few_words"].rejected == sum(got[i].bits & 1 for i, *_ in rows)
    assert table["few_words"].rejected_alone == sum(got[i].bits == 1 for i, *_ in rows)
    assert quality.filtered(empty).count() == 0


def test_targets(spark):
    t = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1), (None, 500), ("d", 0)], "source string, total long")
    got = {r.source: r for r in mixing.targets(t).collect()}
    assert {k: r.weight for k, r in got.items()} == {"a": 1, "b": 2, "c": 3, "d": 1, None: 2}
    total, caps, w = 1511, {k: 3 * r.total for k, r in got.items()}, {k: r.weight for k, r in got.items()}
    want, free = {}, set(w)
    while True:
        left = total - sum(want.values())
        share = {k: left * w[k] / sum(w[x] for x in free) for k in free}
        over = [k for k in free if share[k] >= caps[k]]
        if not over:
            want |= share
            break
        for k in over:
            want[k] = caps[k]
            free.discard(k)
    for k, r in got.items():
        assert r.target == pytest.approx(want[k])


def test_mix(docs, rows, empty):
    out, slots = mixing.mix(docs, block=16, shard_slots=64)
    first = {r.doc_id: r for r in out.collect()}
    again = {r.doc_id: r for r in mixing.mix(docs, block=16, shard_slots=64)[0].collect()}
    assert first == again and len(first) == len({i for i, *_ in rows})
    sizes = Counter()
    for i, t, *_ in rows:
        sizes[i] += len(words(t))
    by = defaultdict(lambda: [0, 0, 0.0])
    for i, r in first.items():
        assert r["size"] == sizes[i] and 0 <= r.taken <= 3 * r["size"]
        by[r.source][0] += r.taken
        by[r.source][1] += r["size"]
        by[r.source][2] = r.target
        assert r.source_size >= r["size"]
    for taken, size, target in by.values():
        assert abs(taken - target) <= 16 + 0.02 * target
    s = slots.collect()
    per = defaultdict(list)
    for r in s:
        per[r.source].append(r["index"])
    assert all(sorted(x) == list(range(len(x))) for x in per.values())
    kept = mixing.mixed_documents(docs.dropDuplicates(["doc_id"]))
    assert kept.columns == docs.columns
    assert mixing.mix(empty)[0].count() == 0 and mixing.mixed_documents(empty).count() == 0


def brute_groups(rows, percent):
    sets = {}
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j]:
                n = len(sets[i] & sets[j])
                if 100 * n >= percent * len(sets[i] | sets[j]):
                    a, b = sorted((root(i), root(j)))
                    up[b] = a
    return {i: root(i) for i in sets}, {i: len(s) for i, s in sets.items()}


@pytest.mark.parametrize("percent", [80, 85])
def test_minhash(docs, rows, empty, percent):
    want, sizes = brute_groups(rows, percent)
    got = minhash.groups(docs, percent).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.component_id, r.n_shingles) == (want[r.doc_id], sizes[r.doc_id])
    if percent == 80:
        kept = minhash.deduplicated(docs, percent)
        assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i in want if want[i] == i}
        assert minhash.groups(empty, percent).count() == 0


def test_minhash_blocks(spark, monkeypatch):
    """Chains of near copies that no single centre links, compared in blocks."""
    rng, rows = random.Random(2), []
    base = [f"w{k}" for k in range(100)]
    for i in range(40):
        for k in rng.sample(range(100), 1):
            base[k] = f"v{i}"
        rows.append((i * 7 % 41, " ".join(base), "en", "s", 0))
    monkeypatch.setattr(minhash, "BLOCK", 8)
    want, _ = brute_groups(rows, 85)
    got = {r.doc_id: r.component_id for r in minhash.groups(spark.createDataFrame(rows, SCHEMA), 85).collect()}
    assert got == want


def near_texts(n=100):
    """Texts of which each is near the next one at 0.85, but not near the one after that."""
    base = [f"w{k}" for k in range(n)]
    out = []
    for i in range(4):
        out.append(" ".join(base))
        base[10 + 20 * i] = f"v{i}"
    return out


def test_minhash_of_equal_and_null_ids(spark):
    """An id with two texts, in parts of their own, and null ids that alone link two documents."""
    a, b, c, d = near_texts()
    other = " ".join(f"x{k}" for k in range(60))
    rows = [(1, a), (1, other), (5, b), (0, other + " y"), (None, c), (7, d), (None, "lone words stand here for once"), (None, None), (2**60 + 1, "a b c d e f g h"), (None, "a b c d e f g h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(len(rows))
    got = {(r.doc_id, r.text): (r.component_id, r.stays) for r in minhash.grouped(docs, 85).join(docs.select(F.xxhash64("text").alias("h"), "text").distinct(), "h").collect()}
    assert got == {
        (1, a): (1, True), (5, b): (1, False), (None, c): (1, False), (7, d): (1, False), (0, other + " y"): (0, True), (1, other): (0, False), (None, rows[6][1]): (None, True), (None, None): (None, True),
        (2**60 + 1, rows[8][1]): (2**60 + 1, True), (None, rows[8][1]): (2**60 + 1, False),
    }
    kept = minhash.deduplicated(docs, 85).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in kept) == sorted((str(i), str(t)) for (i, t), (_, stays) in got.items() if stays)


def test_minhash_of_null_ids_alone(spark):
    a, b, *_ = near_texts()
    docs = spark.createDataFrame([(None, a), (None, b), (None, a)], "doc_id long, text string").repartition(3)
    assert [r.component_id for r in minhash.groups(docs, 85).collect()] == [None] * 3
    assert len({r.text for r in minhash.deduplicated(docs, 85).collect()}) == 1


def test_components(spark):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(40)] + [(100, x) for x in range(101, 130)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: root(x) for x in linked}


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def test_edit_distance_and_segments():
    rng = random.Random(3)
    for t in range(4000):
        a = "".join(rng.choice("ab" if t % 2 else "abcdefghé") for _ in range(rng.randint(0, 14)))
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            k, r = rng.randint(0, len(b)), rng.random()
            if r < 0.33:
                b.insert(k, rng.choice("abc"))
            elif k < len(b):
                b[k : k + 1] = rng.choice("abc") if r < 0.66 else ""
        b = "".join(b)
        near = distance(a, b) <= 2
        assert lines.within(a, b) == near
        if near and a != b and min(len(a), len(b)) >= 3:
            s, long = sorted((a, b), key=len)
            index = {(i, s[p : p + z]) for i, (p, z) in enumerate(lines.segments(len(s)))}
            assert index & {(i, long[p : p + z]) for i, p, z in lines.places(len(long), len(long) - len(s))}


def test_grams_and_sketches():
    """What EDITS edits leave of grams and sketches, in any order of the grams."""
    rng = random.Random(8)
    for t in range(3000):
        a = "".join(rng.choice("ab" if t % 2 else "abcdefé") for _ in range(rng.randint(3, 16)))
        b = list(a)
        for _ in range(rng.randint(1, 2)):
            k, r = rng.randint(0, len(b)), rng.random()
            if r < 0.33:
                b.insert(k, rng.choice("abc"))
            elif k < len(b):
                b[k : k + 1] = rng.choice("abc") if r < 0.66 else ""
        b = "".join(b)
        if len(b) < 3:
            continue
        x, y = lines.pair_sketches([a, b])
        assert np.bitwise_count(x ^ y).sum() <= 8
        q = min(3, len(a) // 3, len(b) // 3)
        line, gram = lines.grams([a, b], q)
        both = [gram[line == k].tolist() for k in (0, 1)]
        assert [len(set(z)) for z in both] == [len(a) - q + 1, len(b) - q + 1]
        order = {g: rng.random() for g in both[0] + both[1]}
        assert set(sorted(both[0], key=order.get)[: 2 * q + 1]) & set(sorted(both[1], key=order.get)[: 2 * q + 1])
    assert lines.pair_sketches([]).shape == (0, 2) and len(lines.grams([], 2)[0]) == 0


def brute_lines(every, short):
    """Per row of `every`, whose rows differ: [lines, exact, near, numbers of repeats, docs where their classes begin]."""
    at = [(i, k, x) for i, t, *_ in every for k, x in enumerate((t or "").split("\n")) if len(x) >= short and x.strip(" \t\n\v\f\r")]
    first = {}
    for i, k, x in at:
        first.setdefault(x, (i, k))
    own = sorted(first, key=first.get)
    up, later = {x: x for x in own}, set()

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for p in range(len(own)):
        for q in range(p):
            a, b = own[p], own[q]
            if min(len(a), len(b)) > 2 and abs(len(a) - len(b)) <= 2 and sum((Counter(a) - Counter(b)).values()) <= 2 and distance(a, b) <= 2:
                later.add(a)
                x, y = sorted((root(a), root(b)), key=first.get)
                up[y] = x
    want = defaultdict(lambda: [0, 0, 0, [], []])
    for i, k, x in at:
        w = want[i]
        w[0] += 1
        copy = first[x] != (i, k)
        w[1] += copy
        w[2] += x in later and not copy
        if copy or x in later:
            w[3].append(k)
            w[4].append(first[root(x)][0])
    assert later
    return want


def test_lines(spark, docs, rows, empty):
    rng = random.Random(4)
    extra = []
    for k in range(30):
        x = "".join(rng.choice("abcdefgh ") for _ in range(40))
        y = list(x)
        y[rng.randrange(40)] = "Z"
        extra.append((1000 + 2 * k, x + "\nshort", "en", "s", 0))
        extra.append((1001 + 2 * k, "".join(y) + "\n" + (x if k % 3 == 0 else "another line that is long " + str(k * 12345)), "en", "s", 0))
    every = sorted(list({r[0]: r for r in rows}.values()) + extra, key=lambda r: r[0])
    want = brute_lines(every, 20)
    df = spark.createDataFrame(every, SCHEMA)
    got = lines.report(df, 20).collect()
    assert len(got) == len(every)
    for r in got:
        assert [r.n_lines, r.n_exact, r.n_near, r.repeats, r.classes] == want[r.doc_id]
    kept = {r.doc_id: r.text for r in lines.deduplicated(df, 20).collect()}
    for i, t, *_ in every:
        left = "\n".join(x for k, x in enumerate((t or "").split("\n")) if k not in want[i][3])
        assert kept.get(i, None) == (None if want[i][3] and not left.split() else t if not want[i][3] else left)
    assert lines.report(empty).count() == 0 and lines.deduplicated(empty).count() == 0


@pytest.mark.parametrize("meet, block, deal", [(1024, 2048, 8192), (8, 4, 8192), (8, 4, 6), (8, 4, 12)])
def test_line_buckets(spark, monkeypatch, meet, block, deal):
    """Large groups of near lines, chains and templates: a link to an earlier line and the classes survive blocks of any size."""
    monkeypatch.setattr(lines, "MEET", meet)
    monkeypatch.setattr(lines, "BLOCK", block)
    monkeypatch.setattr(lines, "DEAL", deal)
    rng = random.Random(7)
    base = "the quick brown fox jumps over the lazy dog"
    pool = [base[:k] + rng.choice("xyz") + base[k + 1 :] for k in range(0, 40, 2)]  # all within two of each other
    chain = list("a long line that changes slowly")
    for k in range(0, 30, 2):  # each within two of the next only
        chain[k : k + 2] = "#%"
        pool.append("".join(chain))
    pool += [f"item number {k:04d} of the list" for k in rng.sample(range(10000), 60)]
    pool += [f"{rng.randrange(300)}{x}" for x in ("abcd", "aa", "é#")] + [f"7{k:03d}" for k in rng.sample(range(1000), 40)] + ["a" * k for k in range(3, 30)]
    rng.shuffle(pool)
    every = [(i, "\n".join(rng.choice(pool) for _ in range(3)), "en", "s", 0) for i in range(70)]
    want = brute_lines(every, 1)
    for r in lines.report(spark.createDataFrame(every, SCHEMA), short=1).collect():
        assert [r.n_lines, r.n_exact, r.n_near, r.repeats, r.classes] == want[r.doc_id]


def test_lines_of_equal_ids(spark):
    """Rows with one id and different texts don't cut each other's lines; null ids and any names of columns are safe."""
    every = [
        (1, "only here in the first row\nshared by both of the rows", "a"), (1, "shared by both of the rows\nonly here in the second row", "b"),
        (None, "a line of the row without an id", "c"), (2, "a line of the row without an id\nanother line which stays as it is", "d"), (3, None, "e"), (3, "", "f"),
        (4, "the same text twice and the same id", "g"), (4, "the same text twice and the same id", "h"),
    ]
    names = ["row", "doc", "drop", "kept", "text_id", "_d", "_kept", "_drop", "n_chars"]
    df = spark.createDataFrame([(i, t, *[f"{n}{k}" for k in range(8)], len(t or "")) for i, t, n in every], "doc_id long, text string, " + ", ".join(f"{x} string" for x in names[:8]) + ", n_chars int")
    got = lines.deduplicated(df, 1).collect()
    assert lines.deduplicated(df, 1).columns == df.columns
    assert all(r[k + 2] == r[2][0] + str(k) for r in got for k in range(8)) and all(r.n_chars == len(r.text or "") for r in got)
    kept = {r[2][0]: r.text for r in got}
    both = [kept["a"], kept["b"]]
    assert "only here in the first row" in both[0] and "only here in the second row" in both[1] and sum("shared" in x for x in both) == 1
    assert kept["c"] == every[2][1] and kept["d"] == "another line which stays as it is" and kept["e"] is None and kept["f"] == ""
    assert kept["g"] == kept["h"] == every[6][1]
    got = lines.report(df, 1).collect()
    assert len(got) == 8 and sorted(r.n_lines for r in got if r.doc_id == 4) == [1, 1] and not any(r.repeats for r in got if r.doc_id == 4)
    assert [r.classes for r in got if r.doc_id == 2] == [[None]]


def test_short_lines(spark, tmp_path):
    """op8 and the pipeline's stage take lines of any length; only blank ones take no part."""
    import corpus_pipeline
    from codeloom.llm import registry

    rng = random.Random(12)
    pool = ["Read more", "Read more!", "Subscribe now", "订阅我们的频道", "订阅我们的频道。", "a", "b", "ab", "ba", "", " \t", "\u3000", "x" * 19, "x" * 18 + "y", "abc", "abd", "dcb"]
    pool += ["".join(rng.choice("abcé ") for _ in range(rng.randint(1, 24))) for _ in range(60)]
    every = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 6))), "en", "s", 0) for i in range(50)]
    want = brute_lines(every, 1)
    assert sum(w[1] for w in want.values()) and sum(w[2] for w in want.values())
    df = spark.createDataFrame(every, SCHEMA)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    for r in registry.op8_line_dedup(spark, str(tmp_path)).collect():
        assert [r.n_lines, r.n_exact, r.n_near, r.repeats, r.classes] == want[r.doc_id]
    kept = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, df, str(tmp_path)).collect()}
    for i, t, *_ in every:
        left = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want[i][3])
        assert kept.get(i) == (None if want[i][3] and not left.strip(" \t\n\v\f\r") else left)


@pytest.mark.parametrize("letters", [0, 1024])
def test_suffix_array(monkeypatch, letters):
    monkeypatch.setattr(suffixes, "LETTERS", letters)
    rng = random.Random(5)
    for _ in range(150):
        x = [rng.randint(1, rng.choice([2, 3, 200])) for _ in range(rng.randint(1, 70))] + [0]
        assert suffixes.suffix_array(np.array(x, np.int64), 256).tolist() == sorted(range(len(x)), key=lambda i: x[i:])


def test_suffix_array_recurses(monkeypatch):
    """Names are sorted recursively on a text as long as a shard's, too, whose names are far more than its letters."""
    rng, depth, sizes, own = random.Random(6), [0], [], suffixes.suffix_array
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(30_000)]
    raw = " ".join(rng.choice(words) for _ in range(60_000)).encode()

    def spied(t, size):
        sizes.append(size)
        return own(t, size)

    monkeypatch.setattr(suffixes, "suffix_array", spied)
    codes = np.append(np.frombuffer(raw, np.uint8).astype(np.int64) + 2, 0)
    sa = spied(codes, 258)
    assert len(sizes) >= 3 and sizes[1] > 20_000
    assert sorted(sa.tolist()) == list(range(len(codes)))
    for k in rng.sample(range(len(sa) - 1), 3000):
        assert raw[sa[k] :] < raw[sa[k + 1] :]


def test_suffixes_of_names_are_induced_quickly():
    """The suffixes of a large alphabet are placed with one lookup each: less time than by looking up the character and its kind."""
    rng = np.random.default_rng(5)
    t = np.append(rng.integers(1, 90_000, 300_000), 0)
    n, size, largest = len(t), 90_001, np.append(t[1:] > t[:-1], True)
    for k in np.flatnonzero(t[1:] == t[:-1])[::-1]:
        largest[k] = largest[k + 1]
    smaller, ordered = largest, np.array(sorted(range(n), key=lambda i: t[i : i + 9].tolist()))
    leftmost = np.flatnonzero(smaller & np.append(False, ~smaller[:-1]))
    seeds = ordered[np.isin(ordered, leftmost)]

    def plain() -> list[int]:
        ends = np.cumsum(np.bincount(t, minlength=size))
        text, small, sa = t.tolist(), smaller.tolist(), [-1] * n
        heads, tails = np.append(0, ends[:-1]).tolist(), ends.tolist()
        for i in reversed(seeds.tolist()):
            c = text[i]
            tails[c] -= 1
            sa[tails[c]] = i
        for i in sa:
            if i > 0 and not small[i - 1]:
                c = text[i - 1]
                sa[heads[c]] = i - 1
                heads[c] += 1
        tails = ends.tolist()
        for k in range(len(sa) - 1, -1, -1):
            i = sa[k]
            if i > 0 and small[i - 1]:
                c = text[i - 1]
                tails[c] -= 1
                sa[tails[c]] = i - 1
        return sa

    def took(f) -> float:
        begun = time.process_time()
        f()
        return time.process_time() - begun

    own = lambda: suffixes._induce_each(t, smaller, seeds, size)
    assert own().tolist() == plain() == ordered.tolist()
    assert min(took(own) for _ in range(4)) < 0.85 * min(took(plain) for _ in range(4))


def test_suffix_dedup(spark, rows, empty):
    rng = random.Random(6)
    passage = text_of(rng, 60)
    more = [(500 + k, text_of(rng, 30) + passage[k : 150 + 2 * k] + text_of(rng, 5), "en", "s", 0) for k in range(25)]
    more += [(600, "ab" * 300, "en", "s", 0), (601, passage[:99], "en", "s", 0), (602, passage[:100], "en", "s", 0), (603, passage * 2, "en", "s", 0)]
    every = list({r[0]: r for r in rows}.values()) + more
    seen, want = {}, {}
    for i, t, *_ in sorted(every, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            else:
                seen[b[p : p + 100]] = 1
        want[i] = (sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), bytes(x for x, g in zip(b, gone) if not g))
    df = spark.createDataFrame(every, SCHEMA).withColumnRenamed("source", "d").repartition(3)
    for r in suffixes.removed(df).collect():
        assert (sum(x.hi - x.lo for x in r.spans), len(r.spans), bytes(r.kept)) == want[r.row.doc_id]
    assert suffixes.removed(empty).count() == 0


def test_suffix_large_anchor(spark, monkeypatch):
    """An anchor whose contexts exceed a shard is not gathered in one task, and loses no repeat."""
    monkeypatch.setattr(suffixes, "SHARD", 3000)
    large, found = suffixes.large_anchors, []
    monkeypatch.setattr(suffixes, "large_anchors", lambda *a: found.append(large(*a)) or found[-1])
    rng = random.Random(14)
    passage = text_of(rng, 40)[:170]
    rows = [(k, text_of(rng, 20) + passage[k % 4 :] + text_of(rng, 20), "en", "s", 0) for k in range(60)]
    rows += [(100, passage * 2, "en", "s", 0), (101, rows[3][1], "en", "s", 0), (102, None, "en", "s", 0), rows[5]]
    seen, want = set(), {}
    for i, t, *_ in sorted({r[0]: r for r in rows}.values(), key=lambda r: r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(b[p : p + 100])
        want[i] = bytes(x for x, g in zip(b, gone) if not g)
    got = suffixes.removed(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert len(got) == len(rows) and all(bytes(r.kept) == want[r.row.doc_id] for r in got)
    assert found[0].count() > 0


def test_suffix_long_document(spark, monkeypatch):
    """Documents longer than a buffer are cut without losing a window."""
    monkeypatch.setattr(suffixes, "BUFFER", 500)
    rng = random.Random(8)
    x = text_of(rng, 400)
    rows = [(1, x, "en", "s", 0), (2, text_of(rng, 50) + x[300:2000], "en", "s", 0)]
    got = {r.row.doc_id: r for r in suffixes.removed(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert sum(s.hi - s.lo for s in got[2].spans) >= len(x[300:2000].encode())


CLASHING = ["row", "spans", "kept", "ledger", "_m", "_ledger", "id", "from", "copies", "copy", "_source", "_copies", "_copy", "own", "d", "base", "key", "bits", "_doc", "_x", "_all"]


def clashing(spark, texts):
    """(doc_id, text, source) with columns of many names, whose values tell their row."""
    rows = [(i, t, src, *[f"{k}.{c}" for c in CLASHING]) for k, (i, t, src) in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in CLASHING))


def whole(r):
    return all(r[c] == r.row.split(".")[0] + "." + c for c in CLASHING)


def test_suffix_dedup_of_equal_ids(spark):
    rng = random.Random(21)
    own = ["".join(rng.choice("abcdefghijklmnop") for _ in range(220)) for _ in range(4)]
    texts = [(1, own[0], "s"), (1, own[0][:150] + own[1], "s"), (None, own[2], "s"), (2, own[2], "s"), (3, own[3], "s"), (3, own[3], "s"), (4, None, "s"), (4, "", "s")]
    got = {r.row.row.split(".")[0]: r for r in suffixes.removed(clashing(spark, texts)).collect()}
    assert len(got) == 8 and all(whole(r.row) for r in got.values())
    kept = {k: bytes(r.kept).decode() for k, r in got.items()}
    # Of the two texts with id 1 one is first, and the other loses what they share alone.
    assert (kept["0"], kept["1"]) in [(own[0], own[1]), (own[0][150:], own[0][:150] + own[1])]
    assert (kept["2"], kept["3"]) == (own[2], "") and kept["4"] == kept["5"] == own[3] and kept["6"] == kept["7"] == ""


def test_names_and_nulls_of_other_stages(spark, empty):
    rng = random.Random(22)
    texts = [(None if k % 9 == 0 else k % 20, text_of(rng, 70) if k % 7 else None, None if k % 5 == 0 else f"s{k % 3}") for k in range(60)]
    df = clashing(spark, texts)
    kept = quality.filtered(df)
    assert kept.columns == df.columns and kept.count() and all(whole(r) for r in kept.collect())
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns and mixed.count() and all(whole(r) for r in mixed.collect())
    assert mixing.mixed_documents(empty).count() == 0 and quality.filtered(empty).count() == 0
    held = [r.held for r in df.select(toxicity.held_out().alias("held")).collect()]
    assert None not in held and held == [i is not None and zlib.crc32(str(i).encode()) % 5 == 0 for i, *_ in texts]


def test_permutation(spark):
    """Each source's indexes are permuted, whatever their number; far beyond 2**31 blocks nothing overflows."""
    sizes = [1, 2, 3, 4, 5, 7, 16, 17, 99, 100, 101, 1000]
    df = spark.createDataFrame([(n,) for n in sizes], "n long").selectExpr("n", "explode(sequence(0L, n - 1)) as i")
    got = defaultdict(list)
    for r in df.select("n", "i", mixing.permuted("i", "n", "n", "7").alias("p")).orderBy("n", "i").collect():
        got[r.n].append(r.p)
    assert all(sorted(x) == list(range(n)) for n, x in got.items()) and sorted(got) == sizes
    assert got[1000][:20] != list(range(20)) and len({got[1000][k + 1] - got[1000][k] for k in range(999)}) > 300
    n = 10**13
    far = spark.range(2000).select(mixing.permuted(f"({n} - 1 - id)", f"cast({n} as bigint)", "'s'", "7").alias("p")).collect()
    assert len({r.p for r in far}) == 2000 and all(0 <= r.p < n for r in far)


def test_packing(docs, rows, empty):
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path)
    ids = {i: [*plain.encode(t or "", add_special_tokens=False).ids, 0] for i, t, *_ in rows}
    out = packing.pack(docs, path, 256, 0, keep_ids=True).collect()
    by, at = defaultdict(list), defaultdict(list)
    for r in out:
        assert r.ids_crc32 == zlib.crc32(bytes(r.ids)) and len(r.ids) == 4 * r.length
        by[r.doc_id].append((r.piece, r.start, np.frombuffer(bytes(r.ids), "<u4").tolist()))
        at[r.sequence_id].append((r.offset, r.length))
    copies = Counter(i for i, *_ in rows)
    for i, x in by.items():
        x.sort()
        assert [t for *_, own in x[:: copies[i]] for t in own] == ids[i]
        assert all(s == 256 * p for p, s, _ in x)
    for x in at.values():
        end = 0
        for offset, length in sorted(x):
            assert offset == end
            end += length
        assert end <= 256
    gaps, n = [], 0
    for length in sorted((r.length for r in out), reverse=True):  # best-fit decreasing
        fits = [k for k, g in enumerate(gaps) if g >= length]
        if fits:
            gaps[min(fits, key=lambda k: gaps[k])] -= length
        else:
            gaps.append(256 - length)
    assert len(at) <= len(gaps)
    assert packing.pack(empty, path).count() == 0


def test_word_tokens(monkeypatch):
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    plain, own = Tokenizer.from_file(path), packing.WordTokens(path)
    want = lambda x: np.array(plain.encode(x, add_special_tokens=False).ids, "<u4").tobytes()
    odd = ["áb é ́x", "İstanbul ΣΑΣ Σ", "don't I'LL 'S it's, 's. H̱ H̱,", "a\x1cb a\xa0b c", "<|endoftext|> x<|startoftext|>y <|EndOfText|>", "１２ ½ ǅ ﬁ", "日本語　x", "a.. a., .. ,a É. é,"]
    odd += [f"x{chr(k)}y {chr(k)} A{chr(k)}" for k in range(0x7F, 0x310)] + [" ", "\n\n a", "a" * 65, "É" * 40 + " b", "<", "a<", "|a <| b", "1a23b4", "a_b-c", "\x00a \x7f", "Ab1.C2;" * 20, "x" * 3000]
    for x in odd:
        assert own.ids(x) == want(x), x
    rng = random.Random(9)
    pieces = ["a", "B", "é", "É", "ß", "Ż", "1", "'", ".", "<", "|", ">", " ", "\n", "\t", "the", "İ", "́", "日", "<|endoftext|>", "²", "\xa0"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 40))) for _ in range(600)] + [None, ""]
    assert list(own.many(texts)) == [want(x or "") for x in texts]
    monkeypatch.setattr(packing, "REMEMBERED", 50)
    monkeypatch.setattr(packing, "TOGETHER", 200)
    small = packing.WordTokens(path)
    texts += [" ".join(texts[:50])]
    assert list(small.many(texts)) == [want(x or "") for x in texts]


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01/documents.parquet"), reason="without the given tables")
def test_word_tokens_of_documents(spark):
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    plain = Tokenizer.from_file(path)
    for x, ids in zip(texts, packing.WordTokens(path).many(texts), strict=True):
        assert ids == np.array(plain.encode(x or "", add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize("rest, lengths", [(0, "mixed"), (0.3, "mixed"), (0, "ones"), (1, "mixed"), (0, "middle")])
def test_supersteps(spark, monkeypatch, rest, lengths):
    """Every piece has its place, sequences have no holes, and there are hardly more than best-fit decreasing has."""
    monkeypatch.setattr(packing, "REST", rest)
    monkeypatch.setattr(packing, "RANGE", 64)
    rng = random.Random(3)
    sizes = {"mixed": [min(256, int(rng.lognormvariate(4, 1)) + 1) for _ in range(400)], "ones": [1] * 500, "middle": [rng.randint(70, 140) for _ in range(200)]}[lengths]
    df = spark.createDataFrame([(k, 0, 0, n, 0) for k, n in enumerate(sizes)], packing.PIECES)
    out = packing.packed(df, 256).collect()
    assert sorted((r.doc_id, r.length) for r in out) == list(enumerate(sizes))
    at = defaultdict(list)
    for r in out:
        at[r.sequence_id].append((r.offset, r.length))
    for x in at.values():
        end = 0
        for offset, length in sorted(x):
            assert offset == end
            end += length
        assert end <= 256
    gaps = []
    for length in sorted(sizes, reverse=True):
        fits = [k for k, g in enumerate(gaps) if g >= length]
        if fits:
            gaps[min(fits, key=lambda k: gaps[k])] -= length
        else:
            gaps.append(256 - length)
    assert len(at) <= len(gaps) * 1.02 + 1


def test_supersteps_write_little(spark, monkeypatch):
    """No superstep for pieces of more than half a sequence, and two tables for each of the others: what was swept, and placed."""
    names, tops, own, step = [], [], packing.written, packing.superstep
    monkeypatch.setattr(packing, "written", lambda df, name: names.append(name) or own(df, name))
    monkeypatch.setattr(packing, "superstep", lambda p, g, top, *rest: tops.append(top) or step(p, g, top, *rest))
    sizes = [256] * 3 + [129] * 20 + [200] * 20 + [100] * 30 + [56, 40, 30, 20] * 40
    out = packing.packed(spark.createDataFrame([(k, 0, 0, n, 0) for k, n in enumerate(sizes)], packing.PIECES), 256).collect()
    assert sorted((r.doc_id, r.length) for r in out) == list(enumerate(sizes))
    assert tops and max(tops) == 128
    assert Counter(names) == {"pieces": 1, "swept": len(tops), "placed": len(tops), "rest": 1, "gaps": 1, "last": 1}
    at = defaultdict(list)
    for r in out:
        at[r.sequence_id].append((r.offset, r.length))
    for x in at.values():
        assert [o for o, _ in sorted(x)] == [sum(n for _, n in sorted(x)[:k]) for k in range(len(x))] and sum(n for _, n in x) <= 256
    assert len(at) <= -(-sum(sizes) // 256) + 3


def test_warc(spark):
    rows = [(3, "u", "<p>same</p>"), (1, "u", "<p>same</p>"), (2, None, None), (4, "u\r\nX: y", ""), (5, "u", "é" * 5000), (1, "u", "<p>same</p>"), (None, "u", "<p>same</p>"), (None, "u", "alone")]
    rows += [(k, "u", f"<html>{k % 9} some page that many share</html>" * 20) for k in range(10, 60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(warc.round_trip(pages).collect(), key=lambda r: (r.page_id is None, r.page_id or 0, r.payload_bytes))
    assert len(got) == len(rows) and not any(r.error for r in got)
    first = {}
    for p, _, h in rows:
        if p is not None:
            first[h or ""] = min(first.get(h or "", p), p)
    want = []
    for p, _, h in rows:
        x = (h or "").encode()
        f = first.get(h or "")
        revisit = f is not None and f != p
        want.append((p, len(x), base64.b32encode(hashlib.sha1(x).digest()).decode(), "revisit" if revisit else "response", f if revisit else None))
    want.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert [tuple(r)[:5] for r in got] == want
    assert all(r.record_type == "response" for r in warc.round_trip(pages, 10**6).collect())
    assert warc.round_trip(pages.where("page_id > 1000")).count() == 0


def test_warc_reader_checks():
    raw = [warc.record(k, "u", b"payload %d" % k * 50, None) for k in range(40)]
    packed = warc.archive(raw)
    assert packed[:4] == warc.SKIPPABLE
    assert list(warc.frames(io.BytesIO(packed), 64)) == raw
    assert list(warc.frames(io.BytesIO(warc.archive(raw[:2])))) == raw[:2]
    assert warc.parse(raw[0])[-1] is None
    assert warc.parse(raw[0][:-1])[-1] == "wrong length"
    assert warc.parse(raw[0].replace(b"payload 0", b"payload 9", 1))[-1]
    assert warc.parse(b"junk")[-1] == "no WARC header"
    with pytest.raises(ValueError):
        list(warc.frames(io.BytesIO(packed[:-3])))


def test_top_k(spark):
    rng = np.random.default_rng(0)
    v = [(i, [float(x) for x in rng.normal(0, 1, 24)]) for i in range(700)]
    v += [(700 + i, v[i][1]) for i in range(20)] + [(900, None), (901, [1.0, None] + [0.0] * 22), (902, [float("nan")] * 24), (903, [float("inf")] * 24), (904, []), (950, [1.0, 2.0]), (951, [3.0, -1.0])]
    df = spark.createDataFrame(v, "vec_id long, embedding array<float>")
    own = topk.whole_numbers(df)
    ints = {r.id: np.array(r.v) for r in own.collect()}
    for i, x in v[:50]:
        assert ints[i].tolist() == [math.floor(256 * float(np.float32(c))) for c in x]
    assert not {900, 901, 902, 903, 904} & set(ints)
    got = defaultdict(list)
    for r in topk.top_k(own.where("id % 50 = 0"), own, 5).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    for q in [i for i in ints if i % 50 == 0]:
        all_ = sorted(((-int(ints[q] @ x), i) for i, x in ints.items() if i != q and len(x) == len(ints[q])))[:5]
        assert got[q] == [(i, -s) for s, i in all_]
    assert topk.top_k(own.where("false"), own).count() == 0 and topk.top_k(own, own.where("false")).count() == 0


def test_toxicity(spark, empty):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(500):
        w = text_of(rng, rng.choice([30, 120])).split()
        bad = i % 4 == 0
        if bad:
            for _ in range(max(2, len(w) // 30)):
                w[rng.randrange(len(w))] = "stupid" + rng.choice(["", "er", "ly", "kr", "ix", "o"])
        rows.append((i, " ".join(w), "en", "s", 0))
        labels.append((i, 1, int(bad)))
    rows += [(1000, None, "en", "s", 0), (1001, "", "en", "s", 0), (1002, "nothing but stupidest words", "en", "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    known = spark.createDataFrame([*labels, (3, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.score for r in toxicity.scored(docs, toxicity.fitted(docs, known)).collect()}
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values())
    held = [(i, y) for i, _, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i] >= 0.5) == bool(y) for i, y in held) / len(held) > 0.95
    assert got[1000] < 0.5 and got[1001] < 0.5 and got[1002] >= 0.5
    none = toxicity.fitted(docs, known.where("false"))
    assert {r.score for r in toxicity.scored(docs, none).collect()} == {0.0}


def test_toxicity_reads_all(spark):
    """Every start of a span counts, and every character of a word."""
    rng = np.random.default_rng(4)
    for n in (1, 8, 9, 10, 11, 30, 200):
        x = rng.normal(0, 1, n)
        size = min(n, toxicity.SPAN)
        assert toxicity.top_span(x)[2] == pytest.approx(max(x[k : k + size].mean() for k in range(n - size + 1)))
    for n in (*range(1, 140), 1000):
        w = "".join(map(chr, range(0x4E00, 0x4E00 + n)))
        got = toxicity.words_of(f"a {w} b")[1:-1]
        assert {w[k : k + 5] for k in range(n - 4)} == {x[k : k + 5] for x in got for k in range(len(x) - 4)}
        assert set("".join(got)) == set(w) and all(len(x) <= 64 for x in got)
    by_row = np.zeros(toxicity.BUCKETS, np.float32)
    by_row[toxicity.features(["stupid"])[0]] = 9
    calm, bad = ["calm"] * 40, ["stupid"] * 8
    texts = [" ".join(calm[:k] + bad + calm[k:]) for k in range(12)] + ["-".join(calm), "-".join(calm + ["stupid"]), "-".join(["stupid"] + calm)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.score for r in toxicity.scored(df, (by_row, -2.0)).orderBy("doc_id").collect()]
    assert got[:12] == pytest.approx([got[0]] * 12) and got[0] > 0.5
    assert min(got[13:]) > got[12]


def test_lm(spark, docs, rows, empty):
    got = lm.scored(docs).collect()
    assert len(got) == len(rows)
    w = [(i, [*(t or "").encode().lower().split(), b" "]) for i, t, *_ in rows]
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in w}
    c = Counter(x for i, own in w if not held[i] for x in own)
    n, v = sum(c.values()), len(c)
    want = {i: own for i, own in w}
    for r in got:
        own = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(own), sum(c[x] > 0 for x in own), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in own))
        assert r.score < 0
    assert lm.scored(empty).count() == 0


def test_lm_end_token(spark, monkeypatch):
    """The end token has its count, and the network its words, however many words are as frequent."""
    monkeypatch.setattr(lm, "KNOWN", 40)
    many = " ".join(f"w{k:03d}" for k in range(90))
    docs = spark.createDataFrame([(k, f"{many} {many} top top top"[: 900 - k]) for k in range(4)], "doc_id long, text string")
    tokens_of = lambda t: [*t.encode().lower().split(), None]
    want = Counter(w for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 7 != 2 for w in tokens_of(r.text))
    hashed = dict(zip(want, [*(int(lm.Words().of([w.decode()])[0][0]) if w else int(lm.END) for w in want)]))
    ids, _, numbers = lm.frequent(lm.counts(docs))
    assert ids[0] == lm.END and sorted(ids.tolist()) == sorted(hashed.values())
    assert dict(zip(ids.tolist(), numbers.tolist())) == {hashed[w]: n for w, n in want.items()}
    assert numbers[1:].tolist() == sorted((n for w, n in want.items() if w), reverse=True)
    n, v = sum(want.values()), len(want)
    for r in lm.scored(docs).collect():
        own = tokens_of(f"{many} {many} top top top"[: 900 - r.doc_id])
        assert (r.n_tokens, r.n_known) == (len(own), sum(want[w] > 0 for w in own))
        assert r.base_score == pytest.approx(sum(math.log10((want[w] + 1) / (n + v + 1)) for w in own))


def test_lm_learns_from_all(spark, monkeypatch):
    """Held-out texts are likelier than by counts alone, with one task or many, and whichever documents hold a pattern."""
    monkeypatch.setattr(lm, "FAN", 2)
    monkeypatch.setattr(lm, "TASKS", 8)
    monkeypatch.setattr(lm, "PER_TASK", 20_000)
    rng = random.Random(8)
    pool = [f"w{k}" for k in range(40)]
    texts = [" ".join(f"{(w := rng.choice(pool))} {w}b {w}c" for _ in range(120)) for _ in range(400)]
    for tasks in (1, 5):
        docs = spark.createDataFrame([(None if k == 7 else k, x) for k, x in enumerate(texts)], "doc_id long, text string").repartition(tasks)
        got = lm.scored(docs).collect()
        held = [r for r in got if r.held_out]
        assert len(got) == 400 and 30 < len(held) < 90 and not [r for r in got if r.doc_id is None][0].held_out
        gain = sum(r.score - r.base_score for r in held) / sum(r.n_tokens for r in held)
        assert gain > 0.1


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01/documents.parquet"), reason="without the given tables")
def test_lm_on_documents(spark):
    """Held-out documents of the given table are likelier than by counts alone."""
    got = lm.scored(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").collect()
    assert sum(r.score for r in got) / sum(r.n_tokens for r in got) > sum(r.base_score for r in got) / sum(r.n_tokens for r in got) + 0.2


def test_lm_network():
    """Gradients against differences, and scores by windows against one long window."""
    rng = np.random.default_rng(3)
    heads, tails = rng.integers(1, 50, lm.HEAD).astype(float), rng.integers(1, 50, lm.TAILS).astype(float)
    net = lm.Network(heads, tails)
    docs = [rng.integers(0, lm.HEAD + lm.TAILS, n) for n in (1, 5, 70, 33)]
    laid = lambda x: (np.concatenate(x), np.cumsum([0, *map(len, x)]))
    got = net.score(*laid(docs))
    for d, s in zip(docs, got):
        states, _ = net.run(net.project(), np.append(0, d[:-1])[:, None], np.zeros((1, lm.HIDDEN), np.float32))
        assert s == pytest.approx(net.log_p(states[:, 0], d).sum(), rel=1e-4)
    x = laid([np.tile([1, 2, 3], 20)])
    before = net.score(*x)[0]
    net.learn(np.concatenate([np.tile([1, 2, 3, 4 + k % 2], 200) for k in range(40)]), 0.01, 1)
    assert net.score(*x)[0] > before + 20
    total = 0.0
    states = np.zeros((1, lm.HIDDEN), np.float32)
    for k in range(lm.HEAD // lm.CLASS):
        own = np.arange(k * lm.CLASS, (k + 1) * lm.CLASS)
        total += np.exp(net.log_p(np.repeat(states, lm.CLASS, 0), own)).sum()
    own = np.arange(lm.HEAD, lm.HEAD + lm.TAILS)
    assert total + np.exp(net.log_p(np.repeat(states, lm.TAILS, 0), own)).sum() == pytest.approx(1, rel=1e-3)


def test_lm_blocks():
    """Probabilities and gradients in blocks: as those of plain formulas, without arrays of all logits; large weights are cut."""
    rng = np.random.default_rng(4)
    net = lm.Network(rng.integers(1, 50, lm.HEAD).astype(float), rng.integers(1, 50, lm.TAILS).astype(float))
    states = np.tanh(rng.normal(size=(3 * lm.BLOCK + 7, lm.HIDDEN))).astype(np.float32)
    targets = rng.integers(0, lm.HEAD + lm.TAILS, len(states))

    def plain(w: dict, states: np.ndarray) -> np.ndarray:
        soft = lambda x: x - np.log(np.exp(x - x.max(1, keepdims=True)).sum(1, keepdims=True)) - x.max(1, keepdims=True)
        cls = np.where(targets < lm.HEAD, targets // lm.CLASS, targets - lm.HEAD + lm.HEAD // lm.CLASS)
        out = soft(states.astype(float) @ w["c"] + w["cb"])[np.arange(len(cls)), cls]
        near = np.flatnonzero(targets < lm.HEAD)
        inner = np.einsum("nh,nch->nc", states[near].astype(float), w["o"][cls[near]]) + w["ob"][cls[near]]
        out[near] += soft(inner)[np.arange(len(near)), targets[near] % lm.CLASS]
        return out

    for scale in (1, 1000):
        for k in ("c", "o"):
            net.w[k] = net.w[k] * scale
        want = plain(net.w, states)
        logs, back = net.log_p(states, targets, grad := {})
        assert logs == pytest.approx(want, rel=1e-3, abs=1e-3) and net.log_p(states, targets) == pytest.approx(want, rel=1e-3, abs=1e-3)
        assert scale > 1 or lm._Scorer(net.w).log_p(states, targets) == pytest.approx(want, rel=1e-3, abs=1e-3)
        for k in ("c", "cb", "o", "ob"):  # gradients are of minus the logs
            step, at = rng.normal(size=net.w[k].shape), 1e-4 / scale
            differ = (plain(net.w | {k: net.w[k] + at * step}, states) - plain(net.w | {k: net.w[k] - at * step}, states)).sum() / (2 * at)
            assert -(grad[k] * step).sum() == pytest.approx(differ, rel=0.02, abs=0.02 * float(np.abs(grad[k]).sum()) ** 0.5)
        step, at = rng.normal(size=states.shape), 1e-4 / scale
        differ = (plain(net.w, states + at * step) - plain(net.w, states - at * step)).sum() / (2 * at)
        assert -(back * step).sum() == pytest.approx(differ, rel=0.02, abs=0.02 * float(np.abs(back).sum()) ** 0.5)
    states, targets = np.tile(states, (5, 1)), np.tile(targets, 5)
    tracemalloc.start()
    net.log_p(states, targets)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 0.8 * 4 * len(states) * (lm.HEAD // lm.CLASS + lm.TAILS)


def test_lm_gradients_through_time():
    """A step from equal moments goes down the differences of the windows' logs, for each of the network's weights."""
    rng = np.random.default_rng(7)
    net = lm.Network(rng.integers(1, 50, lm.HEAD).astype(float), rng.integers(1, 50, lm.TAILS).astype(float))
    for k in net.w:
        net.w[k] = (net.w[k] * (5 if k in "exu" else 1)).astype(np.float32)
    inputs, targets = rng.integers(0, 60, (9, 6)), rng.integers(0, 60, (9, 6))
    w, start = {k: x.copy() for k, x in net.w.items()}, rng.normal(0, 0.3, (6, lm.HIDDEN)).astype(np.float32)

    def total(w: dict) -> float:
        net.w = w
        states, _ = net.run(net.project(), inputs, start)
        return float(net.log_p(states.reshape(-1, lm.HIDDEN), targets.reshape(-1)).sum(dtype=float))

    net.w = {k: x.copy() for k, x in w.items()}
    net.train(inputs, targets, start, 0.0)
    for k in ("e", "x", "u", "b"):
        g = net.m[k] / 0.1 * inputs.size  # the first moment of the first step
        step = g / np.sqrt((g * g).sum())
        differ = (total(w | {k: w[k] + 0.01 * step}) - total(w | {k: w[k] - 0.01 * step})) / 0.02
        assert -float((g * step).sum()) == pytest.approx(differ, rel=0.03), k


def test_lm_counts(spark, monkeypatch):
    """Words are counted with their open classes, in one part or many."""
    rng = random.Random(2)
    texts = [" ".join(f"{rng.choice('abc')}{rng.randrange(50)}" for _ in range(k % 90)) for k in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    want = Counter(w for k, x in enumerate(texts) if zlib.crc32(str(k).encode()) % 7 != 2 for w in [*x.split(), None])
    numbers, heads, _ = lm.Words().of([" ".join(w for w in want if w)])
    words = dict(zip((w for w in want if w), zip(numbers.view(np.int64).tolist(), lm.open_class(heads).tolist()))) | {None: (int(lm.END.view(np.int64)), 0)}
    for read in (lm.READ, 300):
        monkeypatch.setattr(lm, "READ", read)
        assert {(r.id, r.k): r.n for r in lm.counts(docs).collect()} == {words[w]: n for w, n in want.items()}
    keys, order, first = lm._distinct(np.array([7, 3, 7, 9, 3, 7], np.uint64))
    assert keys.tolist() == [3, 7, 9] and first.tolist() == [0, 2, 5] and sorted(order[2:5].tolist()) == [0, 2, 5]


def test_lm_steps_reuse_arrays():
    """A step of training makes few new arrays, and what it hands on is its own."""
    rng = np.random.default_rng(5)
    net = lm.Network(rng.integers(1, 50, lm.HEAD).astype(float), rng.integers(1, 50, lm.TAILS).astype(float))
    lanes = rng.integers(0, lm.HEAD + lm.TAILS, (lm.WINDOW + 1, lm.STREAMS))
    _, state = net.train(lanes[:-1], lanes[1:], np.zeros((lm.STREAMS, lm.HIDDEN), np.float32), 0.01)
    before = state.copy()
    tracemalloc.start()
    net.train(lanes[:-1], lanes[1:], state, 0.01)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (state == before).all()
    assert most < 4 * 4 * lm.HIDDEN * lanes[1:].size


def test_lm_windows_gathered(monkeypatch):
    """Windows of few documents are scored together, as they are one by one."""
    rng = np.random.default_rng(6)
    net = lm.Network(rng.integers(1, 50, lm.HEAD).astype(float), rng.integers(1, 50, lm.TAILS).astype(float))
    lengths = np.array([*rng.integers(1, 90, 40), 4000, 2500, 1])
    symbols, bounds = rng.integers(0, lm.HEAD + lm.TAILS, lengths.sum()), np.cumsum([0, *lengths])
    calls, log_p = [], lm._Scorer.log_p
    monkeypatch.setattr(lm._Scorer, "log_p", lambda own, states, targets: calls.append(len(targets)) or log_p(own, states, targets))
    got = net.score(symbols, bounds)
    assert sum(calls) == len(symbols) and len(calls) <= 2
    monkeypatch.setattr(lm, "READY", 1, raising=False)
    assert got == pytest.approx(net.score(symbols.astype(np.uint16), bounds), rel=1e-6)
    assert len(calls) > 100


def test_lm_scored_in_parts(spark, monkeypatch):
    """Documents have their own scores and counts, however many are read and scored at once."""
    rng = random.Random(4)
    docs = spark.createDataFrame([(k, " ".join(f"w{rng.randrange(30)}" for _ in range(k % 60)) + f" rare{k}") for k in range(200)], "doc_id long, text string").coalesce(1)
    want = {r.doc_id: r for r in lm.scored(docs).collect()}
    monkeypatch.setattr(lm, "READ", 500)
    monkeypatch.setattr(lm, "SCORED", 300, raising=False)
    for r in lm.scored(docs).collect():
        w = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.base_score) == (w.n_tokens, w.n_known, pytest.approx(w.base_score))
        assert r.score == pytest.approx(w.score, rel=1e-4)
    assert len(want) == 200


def test_pipeline(spark, docs, rows, tmp_path):
    """Each stage against brute force on its own input, and sequences decoded to the texts of the mix."""
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(tmp_path)
    rng = random.Random(3)
    long_texts = [text_of(rng, 90) for _ in range(8)]
    extra = [(500 + i, t + ("" if i % 2 else " tail of its own"), "en", f"s{i % 3}", 0) for i, t in enumerate(long_texts * 2)] + [(None, text_of(rng, 70), "en", "s1", 0)]
    plain = spark.createDataFrame([*rows, *extra], SCHEMA)
    plain.write.parquet(f"{path}/documents.parquet")
    kept, at = {}, plain
    for name, stage in corpus_pipeline.STAGES:
        before, at = at, stage(spark, at, path).cache()
        kept[name] = [tuple(r) for r in at.collect()]
        if name != corpus_pipeline.STAGES[-1][0]:
            assert at.columns == before.columns and kept[name]
    first = lambda name: Counter(r[:2] for r in kept[name])
    ledger = quality.ledger(plain)
    good = Counter((r.doc_id, r.text) for r in plain.join(ledger.where(~quality.fails(("full", 1))).select(F.col("doc_id").alias("i")).distinct(), F.col("doc_id").eqNullSafe(F.col("i"))).collect())
    assert first("quality_rules") == good
    want, _ = brute_groups([(i, t) for i, t, *_ in kept["line_dedup"] if i is not None], 80)
    groups_of = {want[i] for i, *_ in kept["line_dedup"] if i is not None}
    assert {i for i, *_ in kept["near_dedup"] if i is not None} == groups_of
    # The mix takes whole rows of what near_dedup kept; the sequences hold exactly those, each document by itself.
    assert set(first("mix_sources")) <= set(first("near_dedup"))
    out = corpus_pipeline.best_fit_packing(spark, spark.createDataFrame(kept["mix_sources"], plain.schema), path).collect()
    ids = defaultdict(list)
    for r in sorted(out, key=lambda r: (r.document, r.piece)):
        own = np.frombuffer(r.ids, "<u4").tolist()
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(own) == r.length and r.start == len(ids[r.doc_id, r.document])
        ids[r.doc_id, r.document] += own
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    wanted = Counter((i, tuple(t.encode(text or "", add_special_tokens=False).ids + [0])) for i, text, *_ in kept["mix_sources"])
    assert Counter((i, tuple(x)) for (i, _), x in ids.items()) == wanted
    for seq in {r.sequence_id for r in out}:
        own = sorted((r.offset, r.length) for r in out if r.sequence_id == seq)
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 2048
    whole = corpus_pipeline.run(spark, path)
    assert {"doc_id", "document", "ids", "sequence_id", "offset"} <= set(whole.columns)
    assert Counter((r.doc_id, bytes(r.ids)) for r in whole.collect()) == Counter((r.doc_id, bytes(r.ids)) for r in out)
    none = plain.where("false")
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, path)
    assert none.count() == 0


# Alignment, runs and languages ------------------------------------------------------------------------------------------


def bounds(rng, n, more=()):
    return sorted(set(rng.sample(range(1, n + 1), rng.randrange(0, n))) | {n, *more})


def test_groups_and_links():
    rng = random.Random(3)
    for k in range(1500):
        n = rng.randrange(1, 80)
        a = bounds(rng, n)
        b = bounds(rng, n) if k % 3 else sorted((set(a) ^ set(rng.sample(range(1, n + 1), min(n, 3)))) | {n})
        both = sorted(set(a) & set(b))
        last_a, last_b = alignment.groups(a, b)
        assert [a[i - 1] for i in last_a] == both and [b[i - 1] for i in last_b] == both
        i, j = alignment.links(np.array(a), np.array(b))
        start_a, start_b = [0, *a], [0, *b]
        assert sorted(zip(i.tolist(), j.tolist())) == [(x, y) for x in range(len(a)) for y in range(len(b)) if max(start_a[x], start_b[y]) < min(a[x], b[y])]
    same = list(range(1, 3000))
    assert alignment.groups(same, same) == (same, same)


def brute_alignment(texts):
    import public_tokenizers

    t = alignment.Tokens(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    per, count = [], Counter()
    for x in texts:
        a, b = (t.a.encode(" " + x, add_special_tokens=False).ids, t.b.encode(x)) if x else ([], [])
        bytes_a, bytes_b = ([own[k] for k in ids] for own, ids in ((t.bytes_a, a), (t.bytes_b, b)))
        if not x or not b"".join(bytes_a) == (" " + x).encode() == b"".join(bytes_b):
            per.append(None)
            continue
        ends = [np.cumsum([len(y) for y in ys]).tolist() for ys in (bytes_a, bytes_b)]
        both = sorted(set(ends[0]) & set(ends[1]))
        cut = lambda ids, own: [",".join(str(i) for i, e in zip(ids, own) if lo < e <= hi) for lo, hi in zip([0, *both], both)]
        starts = [[0, *e[:-1]] for e in ends]
        pairs = [(a[i], b[j]) for i in range(len(a)) for j in range(len(b)) if max(starts[0][i], starts[1][j]) < min(ends[0][i], ends[1][j])]
        count.update(pairs)
        per.append((len(a), len(b), len(both), pairs, ";".join(f"{x}|{y}" for x, y in zip(cut(a, ends[0]), cut(b, ends[1])))))
    most = defaultdict(int)
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    return [(0,) * 6 + ("",) if p is None else (*p[:3], len(p[3]), sum(count[x] == most[x[1]] for x in p[3]), sum(count[x] for x in p[3]), hashlib.sha256(p[4].encode()).hexdigest()) for p in per]


@pytest.mark.parametrize("block, texts", [(1 << 23, 1 << 16), (300, 3)])
def test_alignment(spark, monkeypatch, block, texts):
    import public_tokenizers

    monkeypatch.setattr(alignment, "BLOCK", block)
    own = ["", None, " ", "  a  b ", "\n\n x\ty\n", "a<|endoftext|>b <s> </s> <unk> <0x41>", "é̀ ﬁ ½ ® 你好 世界 🎉🎉  🎉", "▁x a▁b ▁", "a b\u3000c\u2003d", "'s don't I'll 's", "x" * 300, "1234 567 8.9", "a \u200b b", "\r\n \r\n", " <s>a", "same words here", "same words here"]
    own += [text_of(random.Random(k), 40) for k in range(12)]
    df = spark.createDataFrame([(None if k == 3 else k * 2**40, x, "z") for k, x in enumerate(own)], "doc_id long, text string, n_a string").repartition(3)
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    got = {r.doc_id: tuple(r)[1:] for r in alignment.aligned(df, *paths).collect()}
    assert len(got) == len(own)
    for k, row in enumerate(brute_alignment(own)):
        assert got[None if k == 3 else k * 2**40] == row, own[k]
    assert alignment.aligned(df.where("false"), *paths).count() == 0


def brute_runs(s, least=6, power=4):
    out, n = [], len(s)
    for q in range(1, n // power + 1):
        i = 0
        while i + q < n:
            if s[i] != s[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and s[j] == s[j + q]:
                j += 1
            if j + q - i >= max(least, power * q) and not any(all(s[k] == s[k + r] for k in range(i, j + q - r)) for r in range(1, q)):
                out.append((i, j + q - i, q))
            i = j + 1
    return sorted(out, key=lambda x: (x[0], x[2]))


def test_lyndon_arrays():
    rng = random.Random(1)
    for _ in range(1000):
        s = [rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(rng.randrange(1, 20))]
        longest = [max(j - i for j in range(i + 1, len(s) + 1) if all(s[i:j] < s[k:j] for k in range(i + 1, j))) for i in range(len(s))]
        assert periodic.lyndon(s) == longest


def test_periodic_runs(spark, empty):
    rng, texts = random.Random(2), []
    for _ in range(150):
        s: list[str] = []
        while len(s) < rng.randrange(1, 90):
            w = [f"w{rng.randrange(4)}" for _ in range(rng.randrange(1, 9))]
            s += (w * rng.randrange(1, 8))[: rng.randrange(1, 60)]
        texts.append(rng.choice([" ", "\n", "  "]).join(s))
    texts += [None, "", " \t", "W w W w W w W w", "a " * 5000, "a a a a a"]
    df = spark.createDataFrame([(k if k % 7 else None, x, str(k)) for k, x in enumerate(texts)], "doc_id long, text string, runs string").repartition(4)
    got = {r._text_no: r for r in periodic.with_runs(df.withColumnRenamed("runs", "_text_no"), "doc_id", "_text_no").collect()}
    for k, x in enumerate(texts):
        r, own = got[str(k)], (x or "").split()
        want = brute_runs(own) if len(own) < 1000 else [(0, 5000, 1)]
        assert [tuple(y) for y in r.runs] == want and r.doc_id == (k if k % 7 else None)
        dropped = {i for s, n, q in want for i in range(s + q, s + n)}
        assert r.collapsed == " ".join(w for i, w in enumerate(own) if i not in dropped)
    assert periodic.with_runs(empty, "doc_id").count() == 0


def test_repeated_tails(spark):
    """The words that the query makes periodic, by the formula."""
    from codeloom.llm import registry

    rows = [(k, " ".join(f"v{i}" for i in range(n))) for k, n in zip(range(300), itertools.cycle([0, 1, 2, 7, 40, 90]))] + [(None, "a b")]
    got = {r.doc_id: r.text for r in registry.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, x in rows:
        w, h = x.split(), zlib.crc32(str(k).encode())
        if k is not None and h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            x = " ".join(w[i] if i < a else w[a + (i - a) % p] for i in range(n))
        assert got[k] == x


def test_viterbi():
    rng = np.random.default_rng(0)
    for _ in range(60):
        counts, n = rng.integers(0, 8, 6), int(rng.integers(1, 4))
        scores = rng.normal(0, 10, (counts.sum(), n)).astype(np.float32)
        labels, at = langid.viterbi(scores, counts), 0
        for c in counts.tolist():
            own, path = scores[at : at + c], labels[at : at + c].tolist()
            value = lambda p: sum(own[i, x] for i, x in enumerate(p)) - langid.PENALTY * sum(x != y for x, y in itertools.pairwise(p))  # noqa: B023, E731
            assert value(path) == pytest.approx(max(value(p) for p in itertools.product(range(n), repeat=c)), abs=1e-3)
            at += c


def test_languages(spark, empty):
    rng = random.Random(5)
    made = {"en": ["the", "thing", "with", "other", "shall"], "de": ["der", "schön", "nicht", "über", "straße"], "ru": ["это", "слово", "который", "время"], "el": ["είναι", "λόγος", "και"]}
    say = lambda lang, n: " ".join("".join(rng.choices(made[lang], k=rng.choice([1, 1, 2]))) for _ in range(n))
    rows = [(k, say(lang, rng.randrange(5, 40)), lang) for k, lang in enumerate(rng.choices([*made], k=400))]
    model = langid.fitted(spark.createDataFrame([*rows, (None, "no language here", None), (1000, None, "de")], "doc_id long, text string, lang string"))
    assert model.languages == sorted(made)
    mixed = say("en", 30) + ". " + say("ru", 20) + " 123, " + say("de", 30)
    asked = [(k, say(lang, 20), lang) for k, lang in enumerate(rng.choices([*made], k=80))] + [(100, mixed, "en"), (101, None, "und"), (102, "12 _ ½ 3!", "und"), (103, "", "und"), (104, "你好世界", None), (105, "ÜBER " * 3000 + "x" * 500, "de"), (None, say("el", 9), "el"), (None, say("el", 9), "el")]
    df = spark.createDataFrame(asked, "doc_id long, text string, score string").repartition(3)
    got = langid.labelled(df.withColumnRenamed("score", "want"), model, "doc_id", "want").collect()
    assert len(got) == len(asked)
    for r in got:
        assert 0 <= r.score <= 1 and (r.lang_pred in model.languages or r.lang_pred == "und")
        if r.want is not None:
            assert r.lang_pred == r.want
        if r.lang_pred == "und":
            assert r.spans == [] and r.score == 0
        if r.doc_id == 100:
            assert [(s.lang) for s in r.spans] == ["en", "ru", "de"]
            assert [mixed[s.start : s.end].split()[0] for s in r.spans] == [mixed.split()[0], mixed.split()[30], mixed.split()[51]] and r.spans[-1].end == len(mixed)
    nothing = langid.fitted(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert [(r.lang_pred, r.score) for r in langid.labelled(df.limit(1), nothing, "doc_id").collect()] == [("und", 0.0)]
    assert langid.labelled(empty, model, "doc_id").count() == 0


def test_languages_of_documents(spark):
    from codeloom.llm import registry

    d = "/root/testdata/sf0.001"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = [r for r in registry.op13_language_id(spark, d).collect() if r.held_out]
    assert len(got) > 20 and sum(r.lang_pred == lang[r.doc_id] for r in got) >= 0.95 * len(got)
