"""Sequence diagrams: a trace becomes ordered items, the items lines of text.

Items are rows (entry, place, kind, ...); their order is that of `place`, an array of numbers. Adjacent items are rewritten
with lead and lag, and the indentation is a running sum. A trace is bounded by its depth, and each entry is a partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.functions import scalars as s
from codeloom.operators.trace import TraceConfig
from codeloom.tables import stored

ITEMS = ["entry", "place", "kind", "src", "dst", "text"]
_LAST = 2**31 - 1


def call_items(traced: DataFrame) -> DataFrame:
    """Items of the calls: the call, and activation around what it calls in turn."""
    owner = lambda c: F.regexp_extract(c, r"(?s)^(.*)\.[^.]*$", 1)
    # A link of a chain is called by what the link before it was called on.
    src, dst = s.safe_id(owner(F.coalesce("via", "caller"))), s.safe_id(owner("callee"))
    name = F.substring_index("callee", ".", -1)
    arguments = F.array_join(F.transform("arguments", s.simplified_argument), ", ") if "arguments" in traced.columns else F.lit("")
    text = F.concat(name, F.lit("("), arguments, F.lit(")"))
    if "assigned_to" in traced.columns:
        text = F.concat(F.when(F.coalesce("assigned_to", F.lit("")) != "", F.concat("assigned_to", F.lit(" : "))).otherwise(F.lit("")), text)
    at = lambda *x: F.concat("place", F.array(*(F.lit(k) for k in x)))
    calls = traced.select("entry", at(-1, 0).alias("place"), F.lit("call").alias("kind"), src.alias("src"), dst.alias("dst"), text.alias("text"))
    frames = traced.where("depth > 1").select("entry", F.col("frame").alias("up"), s.safe_id(owner("caller")).alias("dst"))
    links = traced.where("via is not null").select("entry", F.slice("place", 1, F.size("place") - 2).alias("up"), src.alias("dst"))
    inner = frames.unionByName(links).distinct()
    on = inner.select("entry", F.concat("up", F.array(F.lit(-1), F.lit(1))).alias("place"), F.lit("activate").alias("kind"), F.col("dst").alias("src"), "dst", F.lit("").alias("text"))
    off = inner.select("entry", F.concat("up", F.array(F.lit(_LAST))).alias("place"), F.lit("deactivate").alias("kind"), F.col("dst").alias("src"), "dst", F.lit("").alias("text"))
    return calls.unionByName(on).unionByName(off)


def entry_items(entries: DataFrame) -> DataFrame:
    owner = s.safe_id(F.regexp_extract("entry", r"(?s)^(.*)\.[^.]*$", 1))
    rows = F.array(
        F.struct(F.array(F.lit(-2)).alias("place"), F.lit("call").alias("kind"), F.lit("User").alias("src"), owner.alias("dst"), F.concat(F.substring_index("entry", ".", -1), F.lit("()")).alias("text")),
        F.struct(F.array(F.lit(-1)).alias("place"), F.lit("activate").alias("kind"), owner.alias("src"), owner.alias("dst"), F.lit("").alias("text")),
        F.struct(F.array(F.lit(_LAST)).alias("place"), F.lit("deactivate").alias("kind"), owner.alias("src"), owner.alias("dst"), F.lit("").alias("text")),
    )
    return entries.select("entry", F.explode(rows).alias("x")).select("entry", "x.*")


def fragment_items(fragments: DataFrame) -> DataFrame:
    """fragments: as trace.traced_fragments has them. alt, else, loop and opt before their first call, an end after the last.

    The first branch of a ladder that holds calls opens it, the later ones are its else branches, and it ends once."""
    w = W.partitionBy("entry", "frame", "ladder")
    f = fragments.withColumn("nth", F.row_number().over(w.orderBy("ordinal"))).withColumn("end", F.max("last").over(w))
    kind = F.when(F.col("type") == "LOOP", "loop").when(F.col("type") == "OPTIONAL", "opt").when(F.col("nth") == 1, "alt").otherwise("else")
    none = F.lit(None).cast("string")
    open_ = f.select("entry", F.concat("first", F.array(F.lit(-3), F.col("level"))).alias("place"), kind.alias("kind"), none.alias("src"), none.alias("dst"), F.coalesce("condition", F.lit("")).alias("text"))
    end = f.where("nth = 1").select("entry", F.concat("end", F.array(F.lit(_LAST), -F.col("level"))).alias("place"), F.lit("end").alias("kind"), none.alias("src"), none.alias("dst"), F.lit("").alias("text"))
    return open_.unionByName(end)


def annotation_notes(traced: DataFrame, uses: DataFrame) -> DataFrame:
    """(entry, place, dst, text): beside each call of a trace, what annotates its method: `@A(p=v), @B`."""
    one = F.concat(F.lit("@"), "simple_name", F.when(F.size("params") > 0, F.concat(F.lit("("), F.array_join(F.transform("params", lambda p: F.concat(p["name"], F.lit("="), p["value"])), ", "), F.lit(")"))).otherwise(F.lit("")))
    text = uses.where("target_type = 'Method'").groupBy(F.col("target_fqn").alias("callee")).agg(F.array_join(F.array_sort(F.collect_set(one)), ", ").alias("text"))
    met = traced.join(text, "callee")
    return met.select("entry", F.concat("place", F.array(F.lit(-1), F.lit(2))).alias("place"), s.safe_id(F.regexp_extract("callee", r"(?s)^(.*)\.[^.]*$", 1)).alias("dst"), "text")


def numbered(items: DataFrame) -> DataFrame:
    return items.withColumn("ord", F.row_number().over(W.partitionBy("entry").orderBy("place", "kind", "dst")))


def peephole(items: DataFrame) -> DataFrame:
    """items: (entry, ord, kind, dst, text). An empty opt goes; then an empty alt becomes a note beside the last callee."""
    w = W.partitionBy("entry").orderBy("ord")
    pair = lambda opening: ((F.col("kind") == opening) & (F.lead("kind").over(w) == "end"), (F.col("kind") == "end") & (F.lag("kind").over(w) == opening))
    first, second = pair("opt")
    out = items.withColumn("_gone", F.coalesce(first, F.lit(False)) | F.coalesce(second, F.lit(False))).where(~F.col("_gone")).drop("_gone")
    first, second = pair("alt")
    callee = F.last(F.when(F.col("kind") == "call", F.col("dst")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    out = out.withColumn("_note", F.coalesce(first, F.lit(False))).withColumn("_gone", F.coalesce(second, F.lit(False))).withColumn("_callee", callee).where(~F.col("_gone"))
    return out.withColumn("kind", F.when(F.col("_note"), "note").otherwise(F.col("kind"))).withColumn("dst", F.when(F.col("_note"), F.col("_callee")).otherwise(F.col("dst"))).drop("_note", "_gone", "_callee")


def indented(items: DataFrame) -> DataFrame:
    """items with `indent`: what activations, alternatives, options and loops before an item have opened and not closed."""
    delta = F.when(F.col("kind").isin("activate", "alt", "opt", "loop"), 1).when(F.col("kind").isin("deactivate", "end"), -1).otherwise(0)
    w = W.partitionBy("entry").orderBy("ord").rowsBetween(W.unboundedPreceding, -1)
    return items.withColumn("indent", F.coalesce(F.sum(delta).over(w), F.lit(0)).cast("int"))


def item_text(dashed: str = "dashed") -> F.Column:
    value = s.safe_value("text")
    return (
        F.when(F.col("kind") == "call", F.concat("src", F.lit("->>"), "dst", F.lit(": "), value))
        .when(F.col("kind") == dashed, F.concat("src", F.lit("-->>"), "dst", F.lit(": "), value))
        .when(F.col("kind") == "note", F.concat(F.lit("Note right of "), "dst", F.lit(": "), value))
        .when(F.col("kind").isin("activate", "deactivate"), F.concat("kind", F.lit(" "), "dst"))
        .when(F.col("kind") == "end", F.lit("end"))
        .otherwise(F.rtrim(F.concat("kind", F.lit(" "), value)))
    )


def diagrams(traced: DataFrame, entries: DataFrame, fragments: DataFrame | None = None, notes: DataFrame | None = None, config: TraceConfig = TraceConfig()) -> DataFrame:
    """(entry, diagram). fragments: of trace.traced_fragments; notes: (entry, place, dst, text), as of annotations. The config may
    hide the calls within fragments, whose frames stay, and what the links of chained calls call in turn."""
    shown = traced
    if config.hide_conditional_details and "parent_fragment_id" in traced.columns:
        shown = shown.where("parent_fragment_id is null")
    if config.hide_chain_details:
        shown = shown.where("not below_chain")
    items = call_items(shown).unionByName(entry_items(entries))
    if fragments is not None:
        items = items.unionByName(fragment_items(fragments))
    if notes is not None:
        items = items.unionByName(notes.select("entry", "place", F.lit("note").alias("kind"), F.lit(None).cast("string").alias("src"), "dst", "text"))
    items = stored(indented(peephole(numbered(items))), "items")
    body = items.select("entry", "ord", F.concat(F.expr("repeat('  ', greatest(indent - if(kind in ('deactivate', 'end', 'else'), 1, 0), 0))"), item_text()).alias("line"))
    first = items.where("dst is not null").groupBy("entry", "dst").agg(F.min("ord").alias("ord"))
    people = first.select("entry", "ord", F.concat(F.lit("participant "), "dst", F.lit(" as "), F.replace("dst", F.lit("_"), F.lit("."))).alias("line"))
    lines = lambda df: df.groupBy("entry").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "\n").alias("t"))
    a, b = lines(people).withColumnRenamed("t", "people"), lines(body).withColumnRenamed("t", "body")
    return stored(a.join(b, "entry").select("entry", F.concat_ws("\n", F.lit("sequenceDiagram"), F.lit("actor User"), "people", "body").alias("diagram")), "diagrams")
