"""Runs over source files: a status for each file, and totals that are counted in the pass that writes the tables.

A file's status is `ok`, `empty` (nothing but white space and comments), `unbalanced` (a bracket closes what isn't open, or stays open) or
`unreadable` (no content). The totals of a run come from observations of the writes themselves: no table is read a second time.

Defined results: files of a status other than ok are still parsed as far as they can be; an empty run has zeros.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from codeloom.operators import convert, marks
from codeloom.operators.java import Parsed


def file_status(files: DataFrame, m: DataFrame) -> DataFrame:
    """files: (path, content); m: their marks. (file, status, error)."""
    step = F.when(F.col("mark").isin("(", "{"), 1).when(F.col("mark").isin(")", "}"), -1).otherwise(0)
    # A closing bracket whose level has no opener, or one of the other kind, is the first sign of what is wrong.
    wrong = F.col("mark").isin(")", "}") & (F.col("in_mark").isNull() | (F.col("in_mark") != F.when(F.col("mark") == ")", "(").otherwise("{")))
    seen = m.groupBy("file").agg(F.sum(step).alias("open"), F.min(F.when(wrong, F.col("at"))).alias("at"))
    rows = files.select(F.col("path").alias("file"), F.col("content").isNull().alias("_none"), (F.trim(F.translate(marks.without_comments(F.coalesce("content", F.lit(""))), "\n\r\t", "   ")) == "").alias("_blank")).join(seen, "file", "left")
    error = F.when(F.col("_none"), "no content").when(F.col("at").isNotNull(), F.concat(F.lit("a bracket closes nothing at "), F.col("at").cast("string"))).when(F.coalesce("open", F.lit(0)) > 0, F.concat(F.col("open").cast("string"), F.lit(" brackets stay open")))
    status = F.when(F.col("_none"), "unreadable").when(F.col("_blank"), "empty").when(error.isNotNull(), "unbalanced").otherwise("ok")
    return rows.select("file", status.alias("status"), error.alias("error"))


@dataclass(frozen=True)
class Totals:
    total: int
    success: int
    error: int
    nodes: int
    edges: int


def graph_run(files: DataFrame, path: str, excluded: list[str] | None = None, created_at: int | None = None) -> Totals:
    """Parses the files and writes `status`, `nodes` and `edges` below path; a file with an error doesn't stop the others."""
    p = Parsed(files)
    n, e = convert.graph(p.types, p.methods, p.calls, p.annotation_uses, excluded, created_at)
    seen = {name: Observation(name) for name in ("status", "nodes", "edges")}
    good = F.col("status").isin("ok", "empty")
    status = file_status(files, p.marks_).observe(seen["status"], F.count("*").alias("total"), F.count_if(good).alias("success"), F.count_if(~good).alias("error"))
    status.write.parquet(f"{path}/status", mode="overwrite")
    n.observe(seen["nodes"], F.count("*").alias("n")).write.parquet(f"{path}/nodes", mode="overwrite")
    e.observe(seen["edges"], F.count("*").alias("n")).write.parquet(f"{path}/edges", mode="overwrite")
    got = {name: o.get for name, o in seen.items()}
    return Totals(got["status"]["total"], got["status"]["success"], got["status"]["error"], got["nodes"]["n"], got["edges"]["n"])
