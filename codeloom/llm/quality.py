"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document: the ledger holds the measurements and one failure bit per rule. A policy is a
named, versioned set of rules; applying it, or asking what each of its rules rejects alone, only reads the bits.

Defined results: a null or empty text has no words and fails `few_words`; repeated rows are judged each, and ids, null or
not, play no part; other columns may have any names and are kept as they are by `filtered`; an empty table gives an empty
ledger.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower"]
SYMBOLS = "#*$%&|<>"
#: Rules in the order of their bits; each is a condition over the measurements under which a document fails.
RULES = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "repeated_lines": "10 * n_dup_lines > 4 * n_lines and n_dup_lines >= 3",
    "word_length": "word_chars < 2 * n_words or word_chars > 15 * n_words",
    "upper_case": "n_upper > n_lower",
}
POLICIES = {
    ("base", 1): ["few_words", "repeated_windows"],
    ("full", 1): list(RULES),
}
_SPACES = " \t\n\v\f\r"


def mask(policy: tuple[str, int]) -> int:
    return sum(1 << list(RULES).index(r) for r in POLICIES[policy])


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of one text, in the order of MEASURES."""
    if not text:
        return (0,) * len(MEASURES)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    triples = list(zip(words, words[1:], words[2:]))
    seen = Counter(triples)
    repeated = 0
    if len(seen) < len(triples):
        at = np.fromiter((seen[x] > 1 for x in triples), bool, len(triples))
        inside = np.zeros(n, bool)
        for k in range(3):
            inside[k : k + len(at)] |= at
        repeated = int(inside.sum())
    lines = [x for x in raw.split(b"\n") if x.strip()]
    codes = np.bincount(np.frombuffer(raw, np.uint8), minlength=128)
    return (
        n, len(text) - int(codes[list(map(ord, _SPACES))].sum()), int(codes[list(map(ord, SYMBOLS))].sum()),
        len(lines) - len(set(lines)), repeated, len(lines), int(codes[65:91].sum()), int(codes[97:123].sum()),
    )


def _measured(texts: pd.Series) -> pd.DataFrame:
    rows = [measure(x) for x in texts]
    return pd.DataFrame(np.array(rows, np.int64).reshape(len(rows), len(MEASURES)), columns=MEASURES)


def judged(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """(keep..., ledger): a struct of the measurements and `bits`, whose bit i is set if rule i fails."""
    measures = F.pandas_udf(_measured, ", ".join(f"{m} long" for m in MEASURES))
    out = docs.select(*keep, measures(F.col(text)).alias("ledger"))
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(RULES.values()):
        for m in MEASURES:
            rule = rule.replace(m, f"ledger.{m}")
        bits = bits + F.when(F.expr(rule), F.lit(1 << i)).otherwise(0)
    return out.select(*keep, F.struct("ledger.*", bits.alias("bits")).alias("ledger"))


def ledger(docs: DataFrame) -> DataFrame:
    """(doc_id, measurements..., bits), to be written once and then read by any policy."""
    return judged(docs.select("doc_id", "text"), "doc_id").select("doc_id", "ledger.*")


def fails(policy: tuple[str, int], bits: str = "bits"):
    return F.col(bits).bitwiseAND(F.lit(mask(policy))) != 0


def ablations(ledger: DataFrame, policy: tuple[str, int] = ("full", 1)) -> DataFrame:
    """A row for each rule of the policy: documents it rejects, and those that no other of its rules rejects."""
    own = F.col("bits").bitwiseAND(F.lit(mask(policy)))
    by_bits = ledger.groupBy(own.alias("own")).agg(F.count("*").alias("n"))
    rules = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(1 << list(RULES).index(r)).cast("long").alias("bit")) for r in POLICIES[policy]))
    each = by_bits.withColumn("r", F.explode(rules)).groupBy("r.rule", "r.bit")
    rejects = F.col("own").bitwiseAND(F.col("r.bit")) != 0
    return each.agg(
        F.coalesce(F.sum(F.when(rejects, F.col("n"))), F.lit(0)).alias("rejected"),
        F.coalesce(F.sum(F.when(F.col("own") == F.col("r.bit"), F.col("n"))), F.lit(0)).alias("rejected_alone"),
    ).drop("bit")


def filtered(docs: DataFrame, policy: tuple[str, int] = ("full", 1)) -> DataFrame:
    """The documents that the policy keeps, with the columns of docs."""
    rows = docs.select(F.struct("*").alias("row"))  # one column, so that no name of docs can clash
    return judged(rows, "row", text="row.text").where(~fails(policy, "ledger.bits")).select("row.*")
