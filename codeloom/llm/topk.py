"""Exact top-k search by inner product: columnar branch and bound.

Vectors are packed into chunks in vertical layout, a row for each dimension. A query's scores over a chunk are summed up
block of dimensions by block; what the remaining dimensions can still add is at most the product of the remaining lengths
(Cauchy-Schwarz). Candidates that cannot reach the k-th best score so far are dropped and the survivors compacted.

Defined results: vectors that are null, empty, or hold a null or non-finite component take no part; vectors are compared
with those of the same length only; ties go to the smaller id; a row with the query's id is its own and no candidate;
repeated rows are candidates each. Scores are 64-bit whole numbers: vectors whose products would sum up to more than 2**62, such as of
components beyond 10**7, have no defined score; ids and vectors are all that is read, so other columns may have any names.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.llm.shared import written

CHUNK = "chunk long, n int, dim int, ids binary, cells binary"
CANDIDATES, QUERIES, TOGETHER = 4096, 512, 16


def whole_numbers(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(id, v): each component x as floor(scale * x); rows that take no part are left out."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    good = vectors.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & (F.size("embedding") > 0)).where(~bad)
    return good.select(F.col("vec_id").alias("id"), F.transform(x, lambda e: F.floor(e * scale).cast("long")).alias("v"))


def _packed(vectors: DataFrame, rows: int, name: str) -> DataFrame:
    """Chunks of up to `rows` vectors of one length, numbered from 0; written."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}
        task, count = TaskContext.get().partitionId(), itertools.count()
        for b in batches:
            for i, v in zip(b.id, b.v):
                own = held.setdefault(len(v), [])
                own.append((i, v))
                if len(own) == rows:
                    yield chunk(own, task, next(count))
                    own.clear()
        for own in held.values():
            if own:
                yield chunk(own, task, next(count))

    def chunk(own: list, task: int, number: int) -> pd.DataFrame:
        ids, cells = np.array([i for i, _ in own], np.int64), np.stack([v for _, v in own]).astype(np.int64)
        return pd.DataFrame({"task": [task], "number": [number], "n": [len(own)], "dim": [cells.shape[1]], "ids": [ids.tobytes()], "cells": [np.ascontiguousarray(cells.T).tobytes()]})

    chunks = written(vectors.mapInPandas(pack, "task int, number int, " + CHUNK.split(", ", 1)[1]), name)
    order = W.orderBy("task", "number")  # of as many small rows as there are chunks
    keys = chunks.select("task", "number").withColumn("chunk", F.row_number().over(order).cast("long") - 1)
    return chunks.join(keys, ["task", "number"]).select(*[x.split()[0] for x in CHUNK.split(", ")])


def best(q: np.ndarray, own: int, ids: np.ndarray, cells: np.ndarray, rest: np.ndarray, k: int, block: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Indexes and scores of the k best columns of `cells` (dim, n) for q, ties to smaller ids.

    rest[j]: for each column, the length of its part from dimension j * block on.
    """
    dim, alive = len(q), np.flatnonzero(ids != own)
    if not len(alive):
        return alive, np.zeros(0, np.int64)
    scores, level = np.zeros(len(alive), np.int64), None
    whole = len(alive) == cells.shape[1]
    for j, at in enumerate(range(0, dim, block)):
        part = cells[at : at + block] if whole else cells[at : at + block, alive]
        scores = scores + q[at : at + block] @ part
        if at + block >= dim:
            break
        left = np.sqrt(float((q[at + block :].astype(float) ** 2).sum()))
        can = scores + left * rest[j + 1, alive] * (1 + 1e-9) + 1e-6
        if len(alive) > k:
            sure = np.argpartition(-can, k - 1)[:k]
            full = q @ cells[:, alive[sure]]
            level = full.min() if level is None else max(level, full.min())
            stay = can >= level
            if stay.sum() < 0.7 * len(alive):
                alive, scores, whole = alive[stay], scores[stay], False
    order = np.lexsort((ids[alive], -scores))[:k]
    return alive[order], scores[order]


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5) -> DataFrame:
    """Both: (id, v array<long>). Returns (query_id, rank, vec_id, score), the k best candidates of each query.

    Each chunk of candidates meets the queries in groups of TOGETHER chunks, so that a task holds one chunk of either
    kind at a time and nothing is broadcast.
    """
    c, q = _packed(candidates, CANDIDATES, "candidates"), _packed(queries, QUERIES, "queries")
    nc, nq = (x.agg(F.coalesce(F.max("chunk") + 1, F.lit(0))).first()[0] for x in (c, q))
    c = c.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(max(0, (nq - 1) // TOGETHER))))).withColumn("with", F.col("chunk"))
    q = q.withColumn("part", F.expr(f"cast(chunk div {TOGETHER} as int)")).withColumn("with", F.explode(F.expr(f"sequence(0L, {max(0, nc - 1)}L)")))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            own = left.iloc[0]
            ids, cells = np.frombuffer(own.ids, np.int64), np.frombuffer(own.cells, np.int64).reshape(own.dim, own.n)
            tail = np.cumsum((cells.astype(float) ** 2)[::-1], axis=0)[::-1]
            rest = np.sqrt(tail[::8])
            for r in right[right.dim == own.dim].itertuples():
                qids, qs = np.frombuffer(r.ids, np.int64), np.frombuffer(r.cells, np.int64).reshape(r.dim, r.n).T
                for i in range(r.n):
                    at, score = best(np.ascontiguousarray(qs[i]), qids[i], ids, cells, rest, k)
                    out.append(pd.DataFrame({"query_id": qids[i], "query_row": r.chunk * QUERIES + i, "vec_id": ids[at], "score": score}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "query_row": [], "vec_id": [], "score": []}, dtype="int64")

    met = c.groupBy("with", "part").cogroup(q.groupBy("with", "part")).applyInPandas(search, "query_id long, query_row long, vec_id long, score long")
    order = W.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id")
    ranked = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
