"""Call traces: depth-bounded expansion from an entry method, guarded against cycles along each path.

Each level is one equi join of the frontier with the calls, for all entries at once. The frontier is written between levels,
so a level's plan holds one join and a lost executor repeats one level at most.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions import scalars as s
from codeloom.tables import stored


@dataclass(frozen=True)
class TraceConfig:
    depth: int = 5
    base_packages: list[str] = field(default_factory=list)
    excluded_prefixes: list[str] = field(default_factory=list)
    excluded_names: list[str] = field(default_factory=list)
    hide_conditional_details: bool = False
    hide_chain_details: bool = False


#: Stands between the links of a chain in a place, after all that the calls inside of the first one are numbered with.
LINK = 1 << 30


def _excluded(config: TraceConfig) -> F.Column:
    return s.excluded(F.regexp_extract("callee", r"(?s)^(.*)\.[^.]*$", 1), F.substring_index("callee", ".", -1), config.excluded_prefixes, config.excluded_names)


def chained(calls: DataFrame) -> DataFrame:
    """calls with `chain`, the ordinals of the links up to a call, LINK between them; `via`, the callee of the link before; in_chain.
    A call whose receiver isn't among calls goes with it. Each round goes one link further along all chains."""
    first = F.array(F.col("ordinal").cast("int"))
    none = F.lit(None).cast("string").alias("via")
    if not {"call_id", "receiver_call_id"} <= set(calls.columns):
        return calls.select("*", first.alias("chain"), none, F.lit(False).alias("in_chain"))
    receivers = calls.where("receiver_call_id is not null").select(F.col("receiver_call_id").alias("_r")).distinct()
    calls = stored(calls.join(receivers, F.col("call_id") == F.col("_r"), "left").withColumn("in_chain", F.col("_r").isNotNull() | F.col("receiver_call_id").isNotNull()).drop("_r"), "calls")
    last = done = calls.where("receiver_call_id is null").select("*", first.alias("chain"), none)
    rest = calls.where("receiver_call_id is not null")
    while True:
        up = last.select(F.col("call_id").alias("receiver_call_id"), F.col("chain").alias("_chain"), F.col("callee").alias("via"))
        last = stored(rest.join(up, "receiver_call_id").withColumn("chain", F.concat("_chain", F.array(F.lit(LINK)), first)).select(*done.columns), "links")
        if last.isEmpty():
            return done
        done = done.unionByName(last)


def trace(calls: DataFrame, entries: DataFrame, config: TraceConfig = TraceConfig()) -> DataFrame:
    """calls: (caller, callee, ordinal, ...), callers and callees as `class.method`; entries: (entry).

    Returns a row for each call reached: entry, depth, caller, callee, path (the methods that are on the stack), frame (the place of
    the call that leads here), place (the ordinals down to the call: its order is the order of a depth-first walk, and a link of a
    chain stands inside the link before it), below_chain (whether a chained call leads here), via (the callee of the link
    before), and the other columns of calls. A call is
    shown if it isn't excluded; it is expanded if its callee isn't on the stack and lies in a base package. Null callees
    are left out; ties in ordinal follow the callee's name.
    """
    shown = calls.where(F.col("callee").isNotNull() & ~_excluded(config))
    linked = {"call_id", "receiver_call_id"} <= set(calls.columns)
    calls = None if linked else chained(shown)
    frontier = entries.select("entry", F.col("entry").alias("caller"), F.array("entry").alias("path"), F.array().cast("array<int>").alias("frame"), F.lit(False).alias("below_chain"))
    levels = []
    for depth in range(1, config.depth + 1):
        if linked:  # chains lie within a caller, so a level adds those of the callers that it meets first
            here = frontier.select("caller").distinct()
            here = here if calls is None else here.join(calls.select("caller"), "caller", "left_anti")
            fresh = chained(shown.join(here, "caller", "left_semi").select(*shown.columns))
            calls = fresh if calls is None else calls.unionByName(fresh)
        others = [c for c in calls.columns if c not in ("caller", "callee", "ordinal", "chain", "in_chain")]
        met = frontier.join(calls, "caller").select("entry", F.lit(depth).alias("depth"), "caller", "callee", "path", F.concat("frame", "chain").alias("place"), "frame", "below_chain", "in_chain", *others)
        level = stored(met, "level")
        levels.append(level.drop("in_chain"))
        if depth == config.depth:
            break
        open_ = level.where(~F.array_contains("path", F.col("callee")) & s.starts_with_any("callee", config.base_packages))
        frontier = open_.select("entry", F.col("callee").alias("caller"), F.concat("path", F.array("callee")).alias("path"), F.col("place").alias("frame"), (F.col("below_chain") | F.col("in_chain")).alias("below_chain")).distinct()
        if frontier.isEmpty():
            break
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out


def traced_fragments(traced: DataFrame, fragments: DataFrame) -> DataFrame:
    """(entry, first, last, level, type, condition, ladder, ordinal): each fragment that holds calls of the trace, in each frame of
    the stack; from the place of its first call, or chain, to that of its last one. Fragments around fragments are followed one level a round."""
    at = traced.where("parent_fragment_id is not null").select("entry", "frame", F.col("parent_fragment_id").alias("fragment_id"), F.slice("place", F.lit(1), F.size("frame") + 1).alias("place"))
    at = at.groupBy("entry", "frame", "fragment_id").agg(F.min("place").alias("first"), F.max("place").alias("last"))
    up = fragments.select("fragment_id", "parent_fragment_id")
    every = at = stored(at, "fragments")
    while True:
        at = stored(at.join(up, "fragment_id").where("parent_fragment_id is not null").select("entry", "frame", F.col("parent_fragment_id").alias("fragment_id"), "first", "last"), "fragments")
        if at.isEmpty():
            break
        every = every.unionByName(at)
    every = stored(every.groupBy("entry", "frame", "fragment_id").agg(F.min("first").alias("first"), F.max("last").alias("last")), "fragments")
    # All that lies around a fragment is among them, so the others are of no use from here on.
    fragments = stored(fragments.join(every.select("fragment_id").distinct(), "fragment_id", "left_semi"), "fragments")
    up = fragments.select("fragment_id", "parent_fragment_id")
    # The level is how many fragments of the frame lie around a fragment: those that reach as far and are its ancestors.
    depth, level, k = fragments.where("parent_fragment_id is null").select("fragment_id", F.lit(0).alias("level")), None, 0
    while not depth.isEmpty():
        level = depth if level is None else level.unionByName(depth)
        k += 1
        depth = stored(up.join(depth.select(F.col("fragment_id").alias("parent_fragment_id")), "parent_fragment_id").select("fragment_id", F.lit(k).alias("level")), "levels")
    own = fragments.select("fragment_id", "type", "condition", F.coalesce("ladder_id", "fragment_id").alias("ladder"), "ordinal")
    met = every.join(own, "fragment_id")
    met = met.join(level, "fragment_id") if level is not None else met.withColumn("level", F.lit(0))
    return met.select("entry", "frame", "first", "last", "level", "type", "condition", "ladder", "ordinal")


def involved_methods(traced: DataFrame) -> DataFrame:
    """(entry, method): the entry and every callee shown."""
    return traced.select("entry", F.col("callee").alias("method")).unionByName(traced.select("entry", F.col("entry").alias("method"))).distinct()


def reach(edges: DataFrame, starts: DataFrame, backwards: bool = False, most: int | None = None) -> DataFrame:
    """(start, node, distance) of all nodes that edges (src, dst) lead to, by breadth; backwards: that lead to a start; most: in so many
    steps at most.

    Each round joins the new nodes only, and drops those known by an anti join; so cycles end by themselves, and the rounds
    are as many as the longest way has steps. What is known is written every few rounds, so that plans stay short."""
    here, there = ("dst", "src") if backwards else ("src", "dst")
    step = edges.select(F.col(here).alias("at"), F.col(there).alias("node")).where("at <> node").distinct()
    known = starts.select(F.col("start"), F.col("start").alias("node"), F.lit(0).alias("distance"))
    frontier, k = known, 0
    while True:
        k += 1
        found = frontier.select("start", F.col("node").alias("at")).join(step, "at").select("start", "node").distinct()
        fresh = stored(found.join(known.select("start", "node"), ["start", "node"], "left_anti").withColumn("distance", F.lit(k)), "reach")
        if fresh.isEmpty():
            return known.where("distance > 0")
        known, frontier = known.unionByName(fresh), fresh
        if k == most:
            return known.where("distance > 0")
        if k % 16 == 0:
            known = stored(known, "reached")
