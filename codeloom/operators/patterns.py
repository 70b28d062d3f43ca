"""Graph patterns as data: vertices and steps between them, compiled to joins.

A pattern names its vertices, each with a label and a condition, and its steps: edges of some types, forwards, of one hop or of
several, required or optional. Each step becomes a table of pairs, filtered by its ends, and is counted; the required ones are
joined from the smallest on, always one that shares a vertex with what is joined already, so no product arises. Optional steps are
left joins, in the order given, and may hang on each other.

Defined results: a row for each match, with the ids of the vertices; edges that differ in their type alone count once; several hops
are each pair's least number of them, and pairs of a vertex with itself are left out; a null id matches nothing. A pattern whose
required steps aren't connected is an error, as is one without any step.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.operators.trace import reach
from codeloom.tables import stored


@dataclass(frozen=True)
class Vertex:
    name: str
    label: str | None = None
    where: Column | None = None

    @property
    def free(self) -> bool:
        return self.label is None and self.where is None


@dataclass(frozen=True)
class Step:
    """From the vertex src to dst: edges of the types; most: of so many hops at most, None for any number; hops: a column for their number."""

    src: str
    dst: str
    types: tuple[str, ...]
    most: int | None = 1
    optional: bool = False
    hops: str | None = None


def _hops(edges: DataFrame, starts: DataFrame, most: int | None, backwards: bool) -> DataFrame:
    """(start, node, distance): by breadth from the starts, up to `most` hops."""
    return reach(edges, starts, backwards, most)


class Pattern:
    def __init__(self, vertices: list[Vertex], steps: list[Step]):
        self.vertices, self.steps = {v.name: v for v in vertices}, steps
        if not any(not s.optional for s in steps):
            raise ValueError("a pattern needs a required step")
        for s in steps:
            for end in (s.src, s.dst):
                self.vertices.setdefault(end, Vertex(end))

    def _ids(self, nodes: DataFrame, name: str) -> DataFrame:
        v = self.vertices[name]
        out = nodes if v.label is None else nodes.where(F.col("label") == v.label)
        return (out if v.where is None else out.where(v.where)).select(F.col("id").alias(name))

    def _pairs(self, nodes: DataFrame, edges: DataFrame, step: Step) -> DataFrame:
        e = edges.where(F.col("type").isin(*step.types)).select("src", "dst").where("src is not null and dst is not null")
        src, dst = self.vertices[step.src], self.vertices[step.dst]
        if step.most == 1:
            out = e.distinct().select(F.col("src").alias(step.src), F.col("dst").alias(step.dst), *([F.lit(1).alias(step.hops)] if step.hops else []))
        else:
            # Walks begin at the end that says more about its nodes.
            backwards = src.free and not dst.free
            here = step.dst if backwards else step.src
            walked = _hops(stored(e, "steps"), self._ids(nodes, here).withColumnRenamed(here, "start"), step.most, backwards)
            ends = ("node", "start") if backwards else ("start", "node")
            out = walked.select(F.col(ends[0]).alias(step.src), F.col(ends[1]).alias(step.dst), *([F.col("distance").alias(step.hops)] if step.hops else []))
        for v in (src, dst):
            if not v.free:
                out = out.join(self._ids(nodes, v.name), v.name, "left_semi")
        return stored(out, "pairs")

    def plan(self, counts: dict[int, int]) -> list[int]:
        """The order of the required steps, by their counted pairs."""
        left, known, order = [k for k, s in enumerate(self.steps) if not s.optional], set(), []
        while left:
            near = [k for k in left if not known or known & {self.steps[k].src, self.steps[k].dst}]
            if not near:
                raise ValueError("the required steps of a pattern must be connected")
            # One that closes a cycle only filters, so it goes first.
            best = min(near, key=lambda k: (not {self.steps[k].src, self.steps[k].dst} <= known, counts[k], k))
            order.append(best)
            left.remove(best)
            known |= {self.steps[best].src, self.steps[best].dst}
        return order

    def match(self, nodes: DataFrame, edges: DataFrame) -> DataFrame:
        pairs = {k: self._pairs(nodes, edges, s) for k, s in enumerate(self.steps)}
        counts = {k: p.count() for k, p in pairs.items() if not self.steps[k].optional}
        out = None
        for k in self.plan(counts):
            out = pairs[k] if out is None else out.join(pairs[k], sorted({self.steps[k].src, self.steps[k].dst} & set(out.columns)))
        for k, s in enumerate(self.steps):
            if s.optional:
                shared = sorted({s.src, s.dst} & set(out.columns))
                if not shared:
                    raise ValueError("an optional step must begin or end at a vertex that is matched before")
                out = out.join(pairs[k], shared, "left")
        extra = [s.hops for s in self.steps if s.hops]
        return stored(out.select(*(v for v in self.vertices if v in out.columns), *extra), "matches")
