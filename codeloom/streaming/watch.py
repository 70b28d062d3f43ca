"""Sources that arrive over time: files are parsed as they come and upserted, a micro-batch at a time.

The stream's checkpoint remembers the files; a batch that runs again upserts the same rows, so a restart repeats nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import scalars as s
from codeloom.operators import convert
from codeloom.operators.changelog import IncrementalStore
from codeloom.operators.java import Parsed
from codeloom.operators.store import GraphStore
from codeloom.tables import written


def upsert_sources(store: GraphStore, files: DataFrame, created_at: int | None = None):
    """files: (path, content). Replaces what the store has of these files by what they hold now, in one version.

    Calls are matched with the methods of these files and with those that the store has of others. All calls are kept beside the
    store, by file, and matched again whenever files arrive: so a class may come after its callers, or go and come back."""
    sources = files.select(F.col("path").alias("source_file")).distinct()
    others = store.nodes().join(sources, "source_file", "left_anti")
    full = F.concat_ws(".", F.nullif("package", F.lit("")), "class_name")
    types = others.where("label in ('Class', 'Interface')").select("package", F.concat_ws(".", F.nullif("package", F.lit("")), "name").alias("class_fqn"))
    p = Parsed(files, types)
    nodes, edges = convert.graph(p.types, p.methods, p.calls, p.annotation_uses, created_at=created_at)
    methods = convert.kept_methods(p.methods).select("class_fqn", "name").unionByName(others.where("label = 'Method'").select(full.alias("class_fqn"), "name"))
    caller = F.regexp_extract("method_full_name", r"(?s)^(.*)\.[^.]*$", 1)
    fresh = p.calls.where("callee <> 'unknown'").select("file", "method_full_name", "callee", "method_name").unionByName(
        # A bare name that no file explained may be a class of the caller's package that is still to come.
        p.calls.where("callee <> 'unknown' and not contains(callee, '.')").select("file", "method_full_name", F.concat_ws(".", F.nullif(F.regexp_extract(caller, r"(?s)^(.*)\.[^.]*$", 1), F.lit("")), "callee").alias("callee"), "method_name")
    )
    calls = written(store.calls().join(sources.withColumnRenamed("source_file", "file"), "file", "left_anti").unionByName(fresh.distinct()), "calls")
    return store.replace_sources(sources, nodes, edges.unionByName(convert.calls_edges(calls, methods)), calls)


def upsert_changes(store: IncrementalStore, files: DataFrame, created_at: int | None = None):
    """`upsert_sources` for an incremental store: only the buckets that these files, their nodes and the classes they name fall into
    are read and appended to."""
    p = Parsed(files)
    nodes, edges = convert.graph(p.types, p.methods, p.calls, p.annotation_uses, created_at=created_at)
    targets = p.calls.where("callee <> 'unknown'").select("file", "method_full_name", "callee", "method_name")
    caller = F.regexp_extract("method_full_name", r"(?s)^(.*)\.[^.]*$", 1)
    # A bare name may be a class of the caller's package that is still to come.
    package = F.nullif(F.regexp_extract(caller, r"(?s)^(.*)\.[^.]*$", 1), F.lit(""))
    bare = targets.where("not contains(callee, '.')").withColumn("callee", F.concat_ws(".", package, "callee"))
    calls = targets.unionByName(bare)
    src = s.method_id(F.substring_index("method_full_name", ".", -1), s.simple_name(caller))
    calls = calls.select("file", src.alias("src"), s.strip_type_arguments("callee").alias("callee_class"), F.col("method_name").alias("callee_name"))
    return store.replace_sources(files.select(F.col("path").alias("source_file")), written(nodes, "nodes"), written(edges, "edges"), calls)


def watch(spark: SparkSession, folder: str, store: GraphStore | IncrementalStore, checkpoint: str, extension: str = ".java", **trigger):
    """Starts the stream; trigger as in writeStream.trigger, e.g. availableNow=True."""
    stream = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", f"*{extension}").load(folder)
    rows = stream.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))

    def load(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            (upsert_changes if isinstance(store, IncrementalStore) else upsert_sources)(store, batch, created_at=number)

    return rows.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(**trigger).start()
