"""Alignment of the tokens that two tokenizers give for one text, and how often their ids meet in a whole corpus.

The tokens of each side end at byte offsets. Where both sides have an end, a group ends. While the tokens of both sides stand one
to one, their ends agree at a constant shift between the two indexes, along a diagonal: stretches of doubling length are
compared at that shift, halved again where they differ, and jumped over as far as they agree. Where they differ, the side that is
behind takes tokens until both end together: an irregular group, after which the shift is another. Inside a group every A token
overlaps a run of B tokens; these pairs are the links.

Corpus-wide counts: documents are put together into blocks of about BLOCK bytes, written once with their links as distinct pairs
of ids and, for each pair, the documents that hold it. Only each block's distinct pairs are shuffled to be counted, and the counts
come back to the block. A task holds one block; a longer text is a block by itself.

Both tokenizers are run on units, cut at a space between two characters that aren't white space: the pre-tokenizer of A begins a
token there, and no piece of B has its space mark after another character (which is checked), so units are encoded alike alone and
in their text. Units met before are remembered.

Defined results: texts that are null, empty, or whose tokens don't give back their bytes on both sides have no tokens, zeros and
''; repeated rows are aligned each and counted each; a null id stays; other columns are left out.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.shared import Numbers, written

#: Bytes of text, and texts, of a block; units that a task remembers.
BLOCK, TEXTS, REMEMBERED = 1 << 23, 1 << 16, 800_000
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Tokens of a stretch that are compared one by one before stretches of doubling length are.
FIRST = 8
#: A pair of ids is one number: A's id, and B's in the lowest bits.
_SHIFT = 1 << 24
_DIGEST = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def groups(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """a, b: ends of the tokens of one text, rising to the same last end. The index after each group's last token, in a and in b."""
    i = j = 0
    out_a, out_b = [], []
    n, m = len(a), len(b)
    while i < n and j < m:
        if a[i] == b[j]:  # one to one, and perhaps more at this shift
            most, k = min(n - i, m - j), 1
            first = min(most, FIRST)
            while k < first and a[i + k] == b[j + k]:
                k += 1
            width = k if k == FIRST else 0
            while width and k < most:
                width = min(2 * width, most - k)
                if a[i + k : i + k + width] != b[j + k : j + k + width]:
                    break
                k += width
            if width and k < most:
                while width > 1:  # the first difference lies in this stretch
                    half = width // 2
                    if a[i + k : i + k + half] == b[j + k : j + k + half]:
                        k, width = k + half, width - half
                    else:
                        width = half
            out_a += range(i + 1, i + k + 1)
            out_b += range(j + 1, j + k + 1)
            i, j = i + k, j + k
            continue
        x, y = a[i], b[j]
        while x != y:
            if x < y:
                i += 1
                x = a[i]
            else:
                j += 1
                y = b[j]
        i, j = i + 1, j + 1
        out_a.append(i)
        out_b.append(j)
    return out_a, out_b


def links(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a, b: ends of tokens, rising. The indexes in a and in b of each pair of tokens whose bytes overlap: one begins at each place
    where a token of either side begins."""
    both = np.concatenate([a, b])
    order = np.argsort(both, kind="stable")
    from_a = order < len(a)
    new = np.flatnonzero(np.diff(both[order], prepend=-1))
    before = np.cumsum(from_a) - from_a
    return before[new], (np.arange(len(both)) - before)[new]


def _byte_values() -> dict[str, int]:
    """The byte of each character of byte-level vocabularies: printable bytes are themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [x for x in range(256) if x not in plain]
    return {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(rest)}


class Tokens:
    """Both tokenizers, with the bytes of each id."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        value = _byte_values()
        size = self.a.get_vocab_size(with_added_tokens=True)
        self.bytes_a = [bytes(map(value.get, x)) if x and all(c in value for c in x) else b"" for x in map(self.a.id_to_token, range(size))]
        self.fast = self._by_ranks(path_a)
        pieces = [self.b.id_to_piece(k) for k in range(self.b.vocab_size())]
        self.bytes_b = [bytes([int(x[3:5], 16)]) if self.b.is_byte(k) else x.replace("▁", " ").encode() for k, x in enumerate(pieces)]
        if size >= 1 << 23 or len(pieces) >= _SHIFT:
            raise ValueError("too many ids for pairs to be numbers")
        if any(re.search("[^▁]▁", x) for x in pieces):
            raise ValueError("a piece has its space mark after another character, so texts can't be cut at spaces")
        self.size_a, self.size_b = (np.array([len(x) for x in xs], np.int64) for xs in (self.bytes_a, self.bytes_b))
        self.n_a, self.n_b = self.size_a.tolist(), self.size_b.tolist()
        # Digits with what follows: between tokens of one side, after A's last of a group, after B's last of a group.
        text = [b"%d%c" % (k, end) for n, ends in ((size, b",|"), (len(pieces), b",;")) for end in ends for k in range(n)]
        self.text = np.array(text).view(np.uint8).reshape(len(text), -1)
        self.places = (0, size, 2 * size, 2 * size + len(pieces))
        self.forget()

    def _by_ranks(self, path: str):
        """A faster encoder of the same vocabulary, if its merges are made in the order of their tokens' ids and it splits texts as usual."""
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocab, merges = file["model"].get("vocab", {}), file["model"].get("merges", [])
        made = [vocab.get("".join(x.split(" ") if isinstance(x, str) else x), -1) for x in merges]
        usual = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}.items() <= (file.get("pre_tokenizer") or {}).items()
        if not usual or file.get("normalizer") or made != sorted(set(made)) or (made and made[0] < 256):
            return None
        special = {x["content"] for x in file.get("added_tokens", [])}
        ranks = {self.bytes_a[k]: k for x, k in vocab.items() if x not in special}
        return tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encoded_a(self, texts: list[str]) -> list[list[int]]:
        if self.fast:
            return self._split(texts)
        return [x.ids for x in self.a.encode_batch_fast(texts, add_special_tokens=False)]

    def _split(self, texts: list[str], together: int = 512) -> list[list[int]]:
        """The texts encoded many at once, one after the other: each begins with a space, where a token begins unless white space is
        beside it. Where a token doesn't end with its text, the texts of that part are encoded one by one."""
        out: list[list[int]] = []
        for at in range(0, len(texts), together):
            some = texts[at : at + together]
            ids = self.fast.encode_ordinary("".join(some))
            ends = np.cumsum(np.fromiter(map(self.n_a.__getitem__, ids), np.int64, len(ids)))
            wanted = np.cumsum([len(x.encode()) for x in some])
            cuts = np.searchsorted(ends, wanted)
            plain = not any(x[1:2].isspace() or x[-1].isspace() for x in some)
            if plain and len(ends) and cuts[-1] < len(ends) and (ends[cuts] == wanted).all():
                bounds = [0, *(cuts + 1).tolist()]
                out += [ids[a:b] for a, b in zip(bounds, bounds[1:])]
            else:
                out += map(self.fast.encode_ordinary, some)
        return out

    def forget(self) -> None:
        self.known = Numbers()
        self.ok = np.zeros(0, bool)
        self.ids, self.counts = [np.zeros(0, np.int32)] * 2, [np.zeros(0, np.int32)] * 2

    def units(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all units of the texts, and how many each text has."""
        cut = [_CUT.split(x) for x in texts]
        if len(self.known) > REMEMBERED:
            self.forget()
        counts = np.fromiter(map(len, cut), np.int64, len(cut))
        units = np.fromiter(map(self.known.__getitem__, chain.from_iterable(cut)), np.int64, int(counts.sum()))
        if fresh := self.known.fresh:
            a = self.encoded_a([" " + u for u in fresh])
            b = self.b.encode(fresh, num_threads=1)
            text = [b" " + u.encode() for u in fresh]
            ok = [True] * len(fresh)
            bounds = [np.cumsum([0, *map(len, x)]) for x in (text, a, b)]
            flat = [np.fromiter(chain.from_iterable(x), np.int64, bounds[k][-1]) for k, x in ((1, a), (2, b))]
            sizes = [np.diff(bounds[0]), *(np.add.reduceat(np.append(n[x], 0), at[:-1]) * (np.diff(at) > 0) for n, x, at in ((self.size_a, flat[0], bounds[1]), (self.size_b, flat[1], bounds[2])))]
            whole = [b"".join(text), *(b"".join(map(own.__getitem__, x.tolist())) for own, x in ((self.bytes_a, flat[0]), (self.bytes_b, flat[1])))]
            if not (whole[0] == whole[1] == whole[2] and (sizes[0] == sizes[1]).all() and (sizes[0] == sizes[2]).all()):  # then they are looked at one by one
                ok = [b"".join(map(self.bytes_a.__getitem__, x)) == t == b"".join(map(self.bytes_b.__getitem__, y)) for x, y, t in zip(a, b, text)]
            self.ok = np.concatenate([self.ok, ok])
            for k in range(2):
                self.ids[k] = np.concatenate([self.ids[k], flat[k].astype(np.int32)])
                self.counts[k] = np.concatenate([self.counts[k], np.diff(bounds[k + 1]).astype(np.int32)])
            self.known.fresh = []
        return units, counts

    def encoded(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """(A's ids, B's ids) of each text; None where the tokens don't give back its bytes."""
        units, counts = self.units(texts)
        own = np.repeat(np.arange(len(texts)), counts)
        bad = np.zeros(len(texts), bool)
        bad[own[~self.ok[units]]] = True
        both = []
        for ids, n in zip(self.ids, self.counts):
            starts, k = np.cumsum(n, dtype=np.int64) - n, n[units].astype(np.int64)
            at = np.repeat(starts[units] - (np.cumsum(k) - k), k) + np.arange(k.sum())
            both.append(np.split(ids[at].astype(np.int64), np.cumsum(np.bincount(own, k, len(texts)).astype(np.int64))[:-1]))
        return [None if x else (a, b) for x, a, b in zip(bad, *both)]

    def written(self, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> bytes:
        """The groups as `a1,a2|b1;a3|b2,b3`."""
        closes_a, closes_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        closes_a[last_a - 1], closes_b[last_b - 1] = 1, 1
        group_a, group_b = np.cumsum(closes_a) - closes_a, np.cumsum(closes_b) - closes_b
        out = np.zeros(len(a) + len(b), np.int64)
        out[np.arange(len(a)) + np.concatenate([[0], last_b])[group_a]] = a + np.where(closes_a == 1, self.places[1], self.places[0])
        out[np.arange(len(b)) + last_a[group_b]] = b + np.where(closes_b == 1, self.places[3], self.places[2])
        text = self.text[out]
        return text[text != 0].tobytes()[:-1]


@lru_cache(maxsize=1)
def _tokens(path_a: str, path_b: str) -> Tokens:
    """One for all tasks of a worker, with the units it remembers."""
    return Tokens(path_a, path_b)


@dataclass
class _Block:
    """Documents of a block, and their links as (pair, document)."""

    rows: list[tuple] = field(default_factory=list)
    pairs: list[np.ndarray] = field(default_factory=list)
    owners: list[np.ndarray] = field(default_factory=list)
    bytes: int = 0

    def add(self, doc_id: int | None, n_a: int, n_b: int, n_groups: int, digest: str, pairs: np.ndarray, size: int) -> None:
        self.owners.append(np.full(len(pairs), len(self.rows), np.int64))
        self.rows.append((doc_id, n_a, n_b, n_groups, len(pairs), digest))
        self.pairs.append(pairs)
        self.bytes += size

    def row(self, number: int) -> pa.RecordBatch:
        pairs, owners = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (self.pairs, self.owners))
        both = np.sort(pairs * TEXTS + owners)  # below 2**63, as ids are below 2**23 and 2**24
        pairs, owners = both // TEXTS, both % TEXTS
        new = np.flatnonzero(np.diff(pairs, prepend=-1) | np.diff(owners, prepend=-1))  # a pair in a document
        times, owners, pairs = np.diff(np.append(new, len(pairs))), owners[new], pairs[new]
        first = np.flatnonzero(np.diff(pairs, prepend=-1))  # a pair in the block
        held = np.diff(np.append(first, len(pairs)))
        total = np.add.reduceat(times, first) if len(first) else times
        # Gaps between pairs, and between a pair's documents, need few bytes.
        gaps = np.diff(owners, prepend=0)
        gaps[first] = owners[first]
        columns = list(zip(*self.rows))
        kinds = [pa.int64()] * 5 + [pa.string()]
        arrays = [pa.array([number], pa.int64()), *(pa.array([c], pa.list_(k)) for c, k in zip(columns, kinds))]
        arrays += [pa.array([x.astype(k).tobytes()], pa.binary()) for x, k in ((pairs[first], "i8"), (total, "i8"), (held, "u4"), (gaps, "u4"), (times, "u4"))]
        return pa.RecordBatch.from_arrays(arrays, [*_COLUMNS])


_COLUMNS = {
    "block": "long", "doc_ids": "array<long>", "n_a": "array<long>", "n_b": "array<long>", "n_groups": "array<long>", "n_links": "array<long>", "digests": "array<string>",
    "pairs": "binary", "totals": "binary", "held": "binary", "gaps": "binary", "times": "binary",
}


def blocks(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """docs: doc_id, text. A row for each block."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, block = _tokens(path_a, path_b), _Block()
        number = TaskContext.get().partitionId() << 32
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            at = 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and size < 1 << 20:
                    size += len(texts[to] or "")
                    to += 1
                some = [x or "" for x in texts[at:to]]
                for doc_id, text, got in zip(ids[at:to], some, tokens.encoded(some)):
                    if block.rows and (block.bytes + len(text) > BLOCK or len(block.rows) == TEXTS):
                        yield block.row(number)
                        block, number = _Block(), number + 1
                    if not text or got is None:
                        block.add(doc_id, 0, 0, 0, "", np.zeros(0, np.int64), len(text))
                        continue
                    a, c = got
                    end_a, end_b = np.cumsum(tokens.size_a[a]), np.cumsum(tokens.size_b[c])
                    last_a, last_b = groups(end_a.tolist(), end_b.tolist())
                    i, j = links(end_a, end_b)
                    digest = hashlib.sha256(tokens.written(a, c, np.array(last_a), np.array(last_b))).hexdigest()
                    block.add(doc_id, len(a), len(c), len(last_a), digest, a[i] * _SHIFT + c[j], len(text))
                at = to
        if block.rows:
            yield block.row(number)

    return docs.select("doc_id", "text").mapInArrow(work, ", ".join(f"{c} {k}" for c, k in _COLUMNS.items()))


def pairs_of(table: DataFrame) -> DataFrame:
    """(pair, block, n): how often each pair of ids is linked in each block."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, pairs, totals in zip(*(b.column(c).to_pylist() for c in range(3))):
                pair, n = np.frombuffer(pairs, "i8"), np.frombuffer(totals, "i8")
                yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(np.full(len(pair), block)), pa.array(n)], ["pair", "block", "n"])

    return table.select("block", "pairs", "totals").mapInArrow(work, "pair long, block long, n long")


def counted(pairs: DataFrame) -> DataFrame:
    """(pair, count, best): of each pair of ids, its links corpus-wide, and whether no pair of its B id has more."""
    counts = written(pairs.groupBy("pair").agg(F.sum("n").alias("count")), "counts")
    b = F.col("pair") % _SHIFT
    most = counts.groupBy(b.alias("b")).agg(F.max("count").alias("most"))
    # A number for each id of B's vocabulary that occurs, at most _SHIFT; Spark broadcasts it where it is small.
    return counts.join(most, b == F.col("b")).select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """docs: doc_id, text. A row for each: n_a, n_b, n_groups, n_links; n_best: links whose pair is its B id's most frequent;
    count_sum: of the counts of its links; groups_sha256."""
    table = written(blocks(docs, path_a, path_b), "blocks")
    pairs = pairs_of(table)
    back = pairs.select("pair", "block").join(written(counted(pairs), "counted"), "pair")

    def work(block: pa.Table, met: pa.Table) -> pa.Table:
        out = []
        for x in block.to_batches():
            for k in range(x.num_rows):
                ids, n_a, n_b, n_groups, n_links, digests = (x.column(c).slice(k, 1).flatten() for c in ("doc_ids", "n_a", "n_b", "n_groups", "n_links", "digests"))
                order = np.argsort(met.column("pair").to_numpy())
                count, best = met.column("count").to_numpy()[order], met.column("best").to_numpy()[order]
                held, gaps, times = (np.frombuffer(x.column(c)[k].as_py(), "u4").astype(np.int64) for c in ("held", "gaps", "times"))
                if len(count) != len(held):
                    raise ValueError("a block's pairs and their counts differ")
                first, run = np.cumsum(held) - held, np.cumsum(gaps)
                owner = run - np.repeat(run[first] - gaps[first], held)
                sums, bests = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
                np.add.at(sums, owner, times * np.repeat(count, held))
                np.add.at(bests, owner, times * np.repeat(best, held))
                out.append(pa.RecordBatch.from_arrays([ids, n_a, n_b, n_groups, n_links, pa.array(bests), pa.array(sums), digests], names))
        return pa.Table.from_batches(out, pa.schema([(c, pa.int64()) for c in names[:-1]] + [(names[-1], pa.string())]))

    names = [c.split()[0] for c in _DIGEST.split(", ")]
    return table.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(work, _DIGEST)
