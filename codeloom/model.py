"""Table schemas of the document and the graph layer, and the text defaults that readers rely on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SOURCE_FILES = "path string, root string, content string"
TYPES = "file string, package string, class_fqn string, class_type string, extends_fqn string, implements_fqns array<string>, start_line int, end_line int, modifiers array<string>"
METHODS = "file string, class_fqn string, name string, signature string, return_type string, full_name string, start_line int, end_line int, thrown array<string>, modifiers array<string>, ordinal int"
CALLS = "file string, call_id string, method_full_name string, seq int, caller string, callee string, callee_variable string, callee_instance string, method_name string, arguments array<string>, return_type string, assigned_to string, line int, receiver_call_id string, parent_fragment_id string, region string, static_type string, targets array<struct<name: string, signature: string>>"
FRAGMENTS = "file string, fragment_id string, parent_fragment_id string, method_full_name string, type string, condition string, start_line int, end_line int, ordinal int, ladder_id string"
ANNOTATION_USES = "file string, target_type string, target_fqn string, name string, simple_name string, params array<struct<name: string, value: string, kind: string>>, start_line int, end_line int"
NODES = "id string, label string, name string, package string, class_name string, node_type string, target_type string, source_file string, line_number int, column_number int, body_length int, return_type string, parameters array<string>, flags map<string, boolean>, props map<string, string>, created_at bigint"
EDGES = "src string, dst string, type string, attr string"

#: What a missing property of a node becomes.
DEFAULTS = {"name": "", "package": "", "class_name": "", "node_type": "", "target_type": "", "source_file": "", "return_type": "", "line_number": 0, "column_number": 0, "body_length": 0}


def names(schema: str) -> list[str]:
    import re

    flat = re.sub(r"<[^<>]*(<[^<>]*>)?[^<>]*>", "", schema)
    return [x.split()[0] for x in flat.split(", ")]


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def as_nodes(df: DataFrame, created_at: int | None = None) -> DataFrame:
    """df with the columns of NODES, absent ones as their defaults."""
    clock = F.lit(created_at).cast("bigint") if created_at is not None else F.unix_millis(F.current_timestamp())
    extra = {
        "parameters": F.array().cast("array<string>"), "flags": F.create_map().cast("map<string,boolean>"),
        "props": F.create_map().cast("map<string,string>"), "created_at": clock,
    }
    out = []
    for c in names(NODES):
        fallback = F.lit(DEFAULTS[c]) if c in DEFAULTS else extra.get(c, F.lit(None))
        out.append((F.coalesce(F.col(c), fallback) if c in df.columns else fallback).alias(c))
    return df.select(*out).withColumns({c: F.col(c).cast("int") for c in ("line_number", "column_number", "body_length")})


def as_edges(df: DataFrame) -> DataFrame:
    return df.select("src", "dst", "type", (F.col("attr") if "attr" in df.columns else F.lit(None).cast("string")).alias("attr"))
