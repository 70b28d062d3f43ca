"""Languages of texts with spans of mixed language.

A text is cut into words: stretches of letters of one script. The script, known by ranges of code points, narrows the
languages that a word may be of to those that were seen to use it. Each word has a score for each language, its naive Bayes
log-likelihood by character n-grams hashed into BUCKETS counts. Viterbi over the words, with PENALTY for a change of language,
labels spans; a text's language is the one whose spans hold most letters.

The n-gram counts come from about LEARNED texts of each language, whole ones, taken by a hash, and from the LANGUAGES that most
rows have. Everything else covers all rows and whole texts. The words of many texts go through Viterbi step by step together.

Defined results: a null text, or one without a letter, is `und` with score 0 and no spans, and so is every text if nothing was
learned; ties go to the language whose name is smaller; repeated rows are labelled each; a null id counts as learnable if its
text and language are there; a null language isn't learned from; columns other than those asked for as `keep` are left out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.shared import Numbers, small, written

LEARNED, LANGUAGES = 4000, 256
BUCKETS, GRAMS, LONG = 1 << 16, (1, 2, 3, 4), 32
#: What a change of language costs, in natural log units; the least share of a language's letters that make a script its own.
PENALTY, OWN_SCRIPT = 12.0, 0.01
#: Cells (words by languages) and words that one task works on and remembers at once.
CELLS, REMEMBERED = 1 << 22, 400_000
UNKNOWN = "und"

# Scripts and their ranges of code points.
SCRIPTS = {
    "latin": "A-Za-zªºÀ-ÖØ-öø-ʯḀ-ỿⱠ-ⱿꜢ-ꟿＡ-Ｚａ-ｚ",
    "greek": "Ͱ-Ͽἀ-῿",
    "cyrillic": "Ѐ-ԯᲀ-᲏ⷠ-ⷿꙀ-ꚟ",
    "armenian": "԰-֏",
    "hebrew": "֐-׿",
    "arabic": "؀-ۿݐ-ݿࢠ-ࣿﭐ-﷿ﹰ-ﻼ",
    "devanagari": "ऀ-ॿ",
    "bengali": "ঀ-৿",
    "gurmukhi": "਀-੿",
    "gujarati": "઀-૿",
    "tamil": "஀-௿",
    "telugu": "ఀ-౿",
    "kannada": "ಀ-೿",
    "malayalam": "ഀ-ൿ",
    "sinhala": "඀-෿",
    "thai": "฀-๿",
    "lao": "຀-໿",
    "tibetan": "ༀ-࿿",
    "burmese": "က-႟",
    "georgian": "Ⴀ-ჿᲐ-Ჿⴀ-⴯",
    "ethiopic": "ሀ-᎟",
    "khmer": "ក-៿",
    "kana": "぀-ヿㇰ-ㇿｦ-ﾟ",
    "hangul": "ᄀ-ᇿ㄰-㆏가-힯",
    "han": "⺀-⿟々-〇㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff",
}
OTHER = len(SCRIPTS)
_ALL = "".join(SCRIPTS.values())
#: A word: letters (and other word characters that aren't digits) of one script.
_WORD = re.compile("|".join([*(f"(?:(?![\\d_])[{x}])+" if k != "latin" else f"[{x}]+" for k, x in SCRIPTS.items()), rf"(?:(?![{_ALL}])[^\W\d_])+"]))
#: In lower-cased texts without any of these, every letter is latin and every word character but digits and _ is a letter.
_OTHERS = re.compile("[µ²³¹¼½¾\u0250-\u1fff\u2070-\U0010ffff]")
_LATIN_WORD = re.compile(r"[^\W\d_]+")
_EACH = [re.compile(f"[{x}]") for x in SCRIPTS.values()]


def script_of(word: str) -> int:
    """The number of the script of a word's letters."""
    return next((k for k, x in enumerate(_EACH) if x.match(word)), OTHER)


def words_of(text: str | None) -> list[str]:
    """The lower-cased words that hold a letter; those beyond LONG characters in pieces."""
    low = text.lower() if text else ""
    words = (_WORD if _OTHERS.search(low) else _LATIN_WORD).findall(low)
    if any(len(w) > LONG or not w.isalpha() for w in words):
        words = [p for w in words for p in (w[at : at + LONG] for at in range(0, len(w), LONG)) if any(map(str.isalpha, p))]
    return words


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(rows, starts): the buckets of each word's n-grams, its bounds included, one word after the other."""
    wrapped = [f"<{w}>" for w in words]
    sizes = np.fromiter(map(len, wrapped), np.int64, len(wrapped))
    codes = np.frombuffer("".join(wrapped).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))
    owner = np.repeat(np.arange(len(words)), sizes)
    rolled, owners, rows = np.zeros(len(codes), np.uint64), [], []
    for k in range(max(GRAMS)):
        rolled[: len(codes) - k] = rolled[: len(codes) - k] * np.uint64(0x100000001B3) + codes[k:] + np.uint64(k + 1)
        if k + 1 in GRAMS:
            at = np.flatnonzero(left >= k + 1)
            owners.append(owner[at])
            rows.append(rolled[at])
    owners, rows = np.concatenate(owners), np.concatenate(rows)
    rows = (rows ^ (rows >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    rows = ((rows ^ (rows >> np.uint64(32))) % np.uint64(BUCKETS)).astype(np.int64)
    counts = np.bincount(owners, minlength=len(words))
    return rows[np.argsort(owners, kind="stable")], np.cumsum(counts) - counts


@dataclass
class Model:
    """languages in order of name; scores: log-likelihood by (bucket, language); allowed: by (script, language)."""

    languages: list[str]
    scores: np.ndarray
    allowed: np.ndarray

    def of_words(self, words: list[str]) -> np.ndarray:
        """(word, language): each word's score; far below all others where its script rules a language out."""
        if not words:
            return np.zeros((0, len(self.languages)), np.float32)
        rows, starts = grams(words)
        own = np.add.reduceat(self.scores[rows], starts, axis=0) / len(GRAMS)
        scripts = np.fromiter(map(script_of, words), np.int64, len(words))
        return np.where(self.allowed[scripts], own, np.float32(-1e9)).astype(np.float32)


def fitted(docs: DataFrame) -> Model:
    """docs: text, lang; the rows to learn from. The texts are counted in tasks, the driver gets sums: at most BUCKETS numbers a
    language."""
    rows = docs.where("text is not null and lang is not null").select("lang", "text")
    known = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES)
    share = small(written(known.select("lang", (F.lit(float(LEARNED)) / F.col("count")).alias("share")), "share"))
    some = rows.join(share, "lang").where(F.pmod(F.xxhash64("text", F.lit(13)), F.lit(1 << 20)) < F.lit(1 << 20) * F.col("share")).select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: dict[str, Counter] = {}
        for b in batches:
            for lang, text in zip(b.lang, b.text):
                words.setdefault(lang, Counter()).update(words_of(text))
        for lang, own in words.items():
            if not own:
                continue
            rows, starts = grams(list(own))
            times = np.fromiter(own.values(), np.int64, len(own))
            n = np.bincount(rows, np.repeat(times, np.diff(np.append(starts, len(rows)))), BUCKETS).astype(np.int64)
            letters = np.zeros(OTHER + 1, np.int64)
            np.add.at(letters, [script_of(w) for w in own], [len(w) * k for w, k in own.items()])
            at, used = np.flatnonzero(n), np.flatnonzero(letters)
            yield pd.DataFrame({"lang": lang, "bucket": np.concatenate([at, -1 - used]), "n": np.concatenate([n[at], letters[used]])})

    summed = some.mapInPandas(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = summed.toPandas()
    languages = sorted(set(got.lang))
    lang, bucket, n = np.searchsorted(np.array(languages, object), got.lang.to_numpy()) if languages else np.zeros(0, int), got.bucket.to_numpy(int), got.n.to_numpy(int)
    counts, letters = np.zeros((BUCKETS, len(languages))), np.zeros((OTHER + 1, len(languages)))
    gram = bucket >= 0
    counts[bucket[gram], lang[gram]] = n[gram]
    letters[-1 - bucket[~gram], lang[~gram]] = n[~gram]
    scores = np.log((counts + 0.5) / (counts.sum(0) + 0.5 * BUCKETS)).astype(np.float32)
    allowed = letters >= OWN_SCRIPT * letters.sum(0)
    return Model(languages, scores, allowed | ~allowed.any(1, keepdims=True))


def viterbi(scores: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The label of each word on its text's best path. scores: (word, label), texts one after the other; counts: their words."""
    order = np.argsort(-counts, kind="stable")
    order = order[counts[order] > 0]
    first, size = (np.cumsum(counts) - counts)[order], counts[order]
    labels = np.zeros(len(scores), np.int64)
    if not len(order):
        return labels
    steps = int(size[0])
    live = np.searchsorted(-size, -np.arange(steps), side="left")  # texts that have a word at each step
    value = scores[first].astype(np.float64)
    best, came = [np.zeros(0, np.int16)], [np.zeros((0, 0), np.uint8)]
    for t in range(1, steps):
        n = live[t]
        now = value[:n]
        top = now.argmax(1)
        other = now[np.arange(n), top] - PENALTY
        change = other[:, None] > now
        best.append(top.astype(np.int16))
        came.append(np.packbits(change, axis=1))
        value[:n] = np.where(change, other[:, None], now) + scores[first[:n] + t]
    state = value.argmax(1)
    for t in range(steps - 1, -1, -1):
        n = live[t]
        labels[first[:n] + t] = state[:n]
        if t:
            bit = (came[t][np.arange(n), state[:n] >> 3] >> (7 - (state[:n] & 7)).astype(np.uint8)) & 1
            state[:n] = np.where(bit == 1, best[t], state[:n])
    return labels


class _Scorer:
    """Remembers words that it has scored."""

    def __init__(self, model: Model):
        self.model, self.known = model, Numbers()
        self.scores = np.zeros((0, len(model.languages)), np.float32)

    def label(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(scores, labels) of the words of all texts, one after the other."""
        if len(self.known) > REMEMBERED:
            self.known, self.scores = Numbers(), self.scores[:0]
        counts = np.fromiter(map(len, texts), np.int64, len(texts))
        at = np.fromiter(map(self.known.__getitem__, chain.from_iterable(texts)), np.int64, int(counts.sum()))
        if self.known.fresh:
            self.scores = np.concatenate([self.scores, self.model.of_words(self.known.fresh)])
            self.known.fresh = []
        own = self.scores[at]
        return own, viterbi(own, counts)

    def results(self, texts: list[str | None]) -> Iterator[tuple[str, float, list[dict]]]:
        """(language, score, spans) of each text."""
        words = [words_of(x) for x in texts]
        names = self.model.languages
        if not names:
            yield from ((UNKNOWN, 0.0, []) for _ in texts)
            return
        scores, labels = self.label(words)
        at = 0
        for text, own in zip(texts, words):
            mine, s = labels[at : at + len(own)], scores[at : at + len(own)]
            at += len(own)
            if not own:
                yield UNKNOWN, 0.0, []
                continue
            letters = np.bincount(mine, np.fromiter(map(len, own), np.int64, len(own)), len(names))
            k = int(letters.argmax())
            total = s[mine == k].sum(0, dtype=np.float64)
            likely = np.exp(total - total.max())
            yield names[k], float(letters[k] / letters.sum() * likely[k] / likely.sum()), self._spans(text, mine)

    def _spans(self, text: str, mine: np.ndarray) -> list[dict]:
        """Each span begins with its first word, the first one with the text, and ends where the next begins."""
        names, cuts = self.model.languages, [0, *(np.flatnonzero(np.diff(mine)) + 1).tolist()]
        starts = [0]
        if len(cuts) > 1:
            low = text.lower()
            pieces = [m.start() + at for m in _WORD.finditer(low) for at in range(0, m.end() - m.start(), LONG) if any(map(str.isalpha, m.group()[at : at + LONG]))]
            if len(low) != len(text):  # lower-casing made the text longer: count back
                grown = np.cumsum([len(c.lower()) for c in text])
                pieces = np.searchsorted(grown, pieces, side="right").tolist()
            starts += [pieces[c] for c in cuts[1:]]
        return [{"start": a, "end": b, "lang": names[int(mine[c])]} for a, b, c in zip(starts, [*starts[1:], len(text)], cuts)]


def labelled(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """docs: text and the columns of keep. Those columns, lang_pred, score (the share of the letters that spans of lang_pred hold,
    times how likely it is for them against the other languages) and spans (start, end, lang) in characters."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers a language, of at most LANGUAGES
    kinds = dict(docs.select(*keep).dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "lang_pred string, score double, spans array<struct<start:long,end:long,lang:string>>"])
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(shared.value)
        for b in batches:
            texts, found, held, size = b.column("_text").to_pylist(), [], [], 0
            for k in range(len(texts) + 1):
                if held and (k == len(texts) or size * len(scorer.model.languages) > 6 * CELLS):  # about six letters a word
                    found += scorer.results(held)
                    held, size = [], 0
                if k < len(texts):
                    held.append(texts[k])
                    size += len(texts[k] or "")
            lang, score, spans = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(spans, span)], [*keep, "lang_pred", "score", "spans"])

    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(work, schema)
