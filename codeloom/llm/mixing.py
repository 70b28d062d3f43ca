"""Mixing sources to target weights, with DataFrame functions only.

The words of each source, documents in a pseudorandom order, are packed into blocks of a fixed length. Output shards of
equally many slots draw a source for each slot, so that a shard's counts by source are multinomial. The drawn totals are
then settled: slots that a source drew beyond its quota go to the sources that drew too few. The i-th slot of a source
maps to the block that a pseudorandom permutation of the source's blocks has at i, a new permutation for each time round,
and joins that block by its index. The permutation is a balanced network of keyed rounds over the smallest even number of
bits that holds the source's blocks; what falls beyond them walks on along its cycle until it falls among them.

Defined results: a null text has size 0; a null source is a source of its own; a source without words has target 0;
rows that repeat an id and a source are one document of `mix`, of the size of all their words, and each of them is taken as
often as that document is by `mixed_documents`; a null id is an id like others; other columns may have any names and are
kept as they are. Sources may be as many as there are rows, and of any size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.llm.shared import n_words, running_total, small, written

#: Rounds of the index permutation, and how often an index that falls beyond the blocks may walk on.
ROUNDS, WALK = 3, 64
#: Rows of a range of sources, or of shards, that is summed up by itself.
RANGE = 100_000


def permuted(index: str, n: str, *key: str) -> F.Column:
    """A pseudorandom permutation of [0, n) at `index`, chosen by `key`; all are SQL expressions.

    The numbers below a * b, a and b about the root of n, are pairs; each side in turn is shifted by a keyed hash of the other.
    At most 2 * sqrt(n) + 1 of the pairs stand for numbers beyond n, and a walk meets each of them once; so WALK steps are enough
    up to n = 900 by count, and beyond that but for a chance of (2 / sqrt(n)) ** WALK, less than 1e-75."""
    a = f"cast(ceil(sqrt({n})) as bigint)"
    b = f"cast(ceil({n} / {a}) as bigint)"
    keys = ", ".join(key)
    left = f"pmod(s.l + pmod(xxhash64(s.r, i, {keys}), {a}), {a})"
    right = f"pmod(s.r + pmod(xxhash64({left}, i, {keys}), {b}), {b})"
    once = lambda x: f"aggregate(sequence(1, {ROUNDS}), named_struct('l', {x} div {b}, 'r', {x} % {b}), (s, i) -> named_struct('l', {left}, 'r', {right}), s -> s.l * {b} + s.r)"
    return F.expr(f"aggregate(sequence(1, {WALK}), {once(index)}, (y, k) -> if(y < {n}, y, {once('y')}))")


def prefix(df: DataFrame, order: list, **sums) -> DataFrame:
    """df with a column for each of `sums`: the sum of that expression over the rows before. Ranges of about RANGE rows are summed by
    themselves, and start from the sums of the ranges before, of which there is one row each."""
    parts = max(1, -(-df.count() // RANGE))
    d = df.select("*", *(F.coalesce(x, F.lit(0)).alias(f"_x{k}") for k, x in enumerate(sums.values())))
    d = written(d.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "ranges")
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # a row for each range
    per = d.groupBy("_part").agg(*(F.sum(f"_x{k}").alias(f"_s{k}") for k in range(len(sums))))
    per = per.select("_part", *(F.coalesce(F.sum(f"_s{k}").over(before), F.lit(0)).alias(f"_s{k}") for k in range(len(sums))))
    inner = W.partitionBy("_part").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    return d.join(F.broadcast(per), "_part").select(*df.columns, *((F.col(f"_s{k}") + F.coalesce(F.sum(f"_x{k}").over(inner), F.lit(0))).alias(name) for k, name in enumerate(sums)))


def targets(totals: DataFrame, cap: float = 3.0) -> DataFrame:
    """totals: (source, total), a row per source. Adds weight (1, 2, 3, repeating in order of the source) and target.

    The targets share the sum of totals by weight; a target stops at cap * total and its excess is shared again. The
    stopped sources are those with cap * total / weight up to a level; the level is found by one pass in that order.
    """
    t = prefix(totals, [F.col("source").asc_nulls_last()], _nth=F.lit(1))
    t = t.withColumn("weight", (F.col("_nth") % 3 + 1).cast("int")).withColumn("_cap", F.col("total") * cap).withColumn("_level", F.col("_cap") / F.col("weight"))
    t = written(prefix(t, ["_level", "weight", F.col("source").asc_nulls_last()], _before=F.col("_cap"), _less=F.col("weight")), "levels")
    every, weights = t.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    t = t.withColumn("_stops", F.col("_before") + F.col("_level") * (F.lit(weights) - F.col("_less")) <= every)
    stopped = F.coalesce(F.sum(F.when(F.col("_stops"), F.col("_cap"))), F.lit(0.0))
    free, stopped = t.agg(F.coalesce(F.sum(F.when(~F.col("_stops"), F.col("weight"))), F.lit(1)), stopped).first()
    t = t.withColumn("target", F.when(F.col("_stops"), F.col("_cap")).otherwise(F.lit(float(every - stopped)) / free * F.col("weight")).cast("double"))
    return t.select(*totals.columns, "weight", "target")


def _intervals(plan: DataFrame, length: str, slots: int, bins: int = 4096) -> tuple[DataFrame, int]:
    """Lays the sources end to end over [0, slots); a row for each bin that a source reaches into."""
    width = max(1, -(-slots // bins))
    laid = prefix(plan.where(F.col(length) > 0).select("skey", F.col(length).alias("_n")), ["skey"], lo=F.col("_n")).withColumn("hi", F.col("lo") + F.col("_n"))
    return laid.select("skey", "lo", "hi", F.explode(F.sequence(F.expr(f"lo div {width}"), F.expr(f"(hi - 1) div {width}"))).alias("bin")), width


def slots_of(plan: DataFrame, shard_slots: int, seed: int) -> DataFrame:
    """(shard, skey, index): each source has the indexes from 0 to its quota, each once."""
    spark = plan.sparkSession
    n = plan.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0]
    bins, width = _intervals(plan, "quota", n)
    drawn = spark.range(n).select(F.expr(f"id div {shard_slots}").alias("shard"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(max(n, 1))).alias("x")).withColumn("bin", F.expr(f"x div {width}"))
    bins = small(written(bins, "bins"))
    counts = drawn.join(bins, "bin").where("x >= lo and x < hi").groupBy("shard", "skey").agg(F.count("*").alias("n"))
    counts = written(counts, "counts")
    before = W.partitionBy("skey").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    runs = counts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    index = runs.select("shard", "skey", F.explode(F.expr("sequence(start, start + n - 1)")).alias("index"))
    got = counts.groupBy("skey").agg(F.sum("n").alias("got"))
    settle = plan.select("skey", "quota").join(got, "skey", "left").select("skey", "quota", F.coalesce("got", F.lit(0)).alias("got"))
    over, under = F.greatest(F.expr("got - quota"), F.lit(0)), F.greatest(F.expr("quota - got"), F.lit(0))
    settle = small(written(prefix(settle, ["skey"], over_at=over, under_at=under), "settle"))
    index = index.join(settle, "skey")
    own = index.where("index < quota").select("shard", "skey", "index")
    spare = index.where("index >= quota").select("shard", F.expr("over_at + index - quota").alias("x"))
    lacks = settle.where("got < quota").select("skey", "got", "under_at", F.explode(F.expr("sequence(got, quota - 1)")).alias("index"))
    moved = lacks.withColumn("x", F.expr("under_at + index - got")).join(spare, "x").select("shard", "skey", "index")
    return own.unionByName(moved)


def mix(docs: DataFrame, block: int = 64, cap: float = 3.0, shard_slots: int = 65536, seed: int = 20240) -> tuple[DataFrame, DataFrame]:
    """docs: (doc_id, text, source, ...). Returns the documents (doc_id, size, source_size, target, taken) and the blocks
    of the mix (shard, source, index, block); `taken` counts the words of a document in those blocks, repeats included."""
    sized = docs.groupBy("doc_id", "source").agg(F.sum(n_words(F.col("text"))).cast("long").alias("size"))
    skey = F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col("source")))
    sized = written(sized.withColumn("skey", skey), "sized")
    totals = sized.groupBy("source", "skey").agg(F.sum("size").alias("total"))
    plan = targets(totals, cap).withColumn("blocks", F.ceil(F.col("total") / block).cast("long"))
    quota = F.least(F.floor(cap * F.col("blocks")), F.round(F.col("target") / (F.col("total") / F.col("blocks"))))
    plan = written(plan.withColumn("quota", F.when(F.col("blocks") > 0, quota).otherwise(0).cast("long")), "plan")
    known = small(plan)

    placed = running_total(sized, "skey", ["doc_id"], "size", "at").where("size > 0")
    last = F.expr(f"(at + size - 1) div {block}")
    pieces = placed.select("doc_id", "skey", "at", "size", F.explode(F.sequence(F.expr(f"at div {block}"), last)).alias("block"))
    words = F.least(F.expr("at + size"), F.expr(f"(block + 1) * {block}")) - F.greatest(F.col("at"), F.expr(f"block * {block}"))
    pieces = pieces.select("doc_id", "skey", "block", words.alias("words"))

    slots = slots_of(plan, shard_slots, seed).join(known.select("skey", "source", "blocks"), "skey")
    slots = slots.withColumn("block", permuted("(index % blocks)", "blocks", "skey", "index div blocks", str(seed)))

    uses = slots.groupBy("skey", "block").agg(F.count("*").alias("uses"))
    taken = pieces.join(uses, ["skey", "block"]).groupBy("doc_id", "skey").agg(F.sum(F.expr("words * uses")).alias("taken"))
    taken = taken.select(F.col("doc_id").alias("_id"), F.col("skey").alias("_key"), "taken")
    out = sized.join(taken, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("skey") == F.col("_key")), "left").join(known.select("skey", "total", "target"), "skey")
    out = out.select("doc_id", "source", "size", F.col("total").alias("source_size"), "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    return out, slots.select("shard", "source", "index", "block")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents as the mix takes them: taken / size copies each, a part of a copy rounded by a hash of the id."""
    out, _ = mix(docs, **options)
    part = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(1 << 20)) / float(1 << 20)
    copies = out.where("taken > 0").select(F.col("doc_id").alias("id"), F.col("source").alias("from"), F.floor(F.col("taken") / F.col("size") + part).cast("int").alias("copies"))
    # Whole rows are one column, so that no name of docs can clash. The join shuffles the texts it keeps: copies grow with them.
    rows = docs.select(F.struct("*").alias("row"))
    kept = rows.join(copies, F.col("row.doc_id").eqNullSafe(F.col("id")) & F.col("row.source").eqNullSafe(F.col("from")))
    return kept.select("row", F.explode(F.expr("array_repeat(0, copies)")).alias("copy")).select("row.*")
