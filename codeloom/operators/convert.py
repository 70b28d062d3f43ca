"""Documents to graph: node and edge tables from the tables of types, methods, calls and annotation uses.

Everything is a projection, a filter, or an equi join on (file, class) or (class, method); nothing is looked up row by row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.functions import scalars as s
from codeloom.model import as_edges, as_nodes

DEFAULT_EXCLUDED = ("Override", "Deprecated", "SuppressWarnings")


def excluded_annotations(setting: str | None) -> list[str]:
    """The configured names, trimmed, empty ones dropped, and the defaults."""
    own = [x.strip() for x in (setting or "").split(",")]
    return list(dict.fromkeys([*(x for x in own if x), *DEFAULT_EXCLUDED]))


def _flags(**conditions) -> F.Column:
    return F.create_map(*(x for k, v in conditions.items() for x in (F.lit(k), F.coalesce(v, F.lit(False)))))


def _has(word: str) -> F.Column:
    return F.array_contains("modifiers", word)


def class_nodes(types: DataFrame, created_at: int | None = None) -> DataFrame:
    own = types.where((F.coalesce("class_fqn", F.lit("")) != "") & (F.lower(F.coalesce("class_type", F.lit(""))) != "interface"))
    return as_nodes(own.select(
        s.class_id("class_fqn").alias("id"), F.lit("Class").alias("label"), s.simple_name("class_fqn").alias("name"), s.package_of("class_fqn").alias("package"),
        s.or_default("class_type", "Class").alias("node_type"), F.col("file").alias("source_file"), F.col("start_line").alias("line_number"),
        _flags(is_abstract=_has("abstract"), is_final=_has("final"), is_public=_has("public"), is_private=_has("private"), is_protected=_has("protected"), is_static=_has("static")).alias("flags"),
    ), created_at)


def interface_nodes(types: DataFrame, created_at: int | None = None) -> DataFrame:
    own = types.where((F.coalesce("class_fqn", F.lit("")) != "") & (F.lower("class_type") == "interface"))
    return as_nodes(own.select(
        s.interface_id("class_fqn").alias("id"), F.lit("Interface").alias("label"), s.simple_name("class_fqn").alias("name"), s.package_of("class_fqn").alias("package"),
        F.col("file").alias("source_file"), F.col("start_line").alias("line_number"), _flags(is_public=_has("public")).alias("flags"),
    ), created_at)


def kept_methods(methods: DataFrame) -> DataFrame:
    """Methods that a graph shows: no constructors, standard methods, or accessors whose counterpart is in the same file."""
    class_name = s.simple_name("class_fqn")
    reads = methods.where(s.is_getter("name")).select("file", s.property_of_accessor("name").alias("_p"), F.lit(False).alias("_setter"))
    writes = methods.where(s.is_setter("name")).select("file", s.property_of_accessor("name").alias("_p"), F.lit(True).alias("_setter"))
    other = reads.unionByName(writes).distinct().select(F.col("file").alias("_f"), "_p", (~F.col("_setter")).alias("_for_setter"))
    m = methods.where(~(s.is_constructor_like("name", class_name) | s.is_standard("name")))
    paired = (F.col("file") == F.col("_f")) & (s.property_of_accessor("name") == F.col("_p")) & (s.is_setter("name") == F.col("_for_setter")) & (s.is_getter("name") | s.is_setter("name"))
    return m.join(other, paired, "left_anti")


def method_nodes(methods: DataFrame, created_at: int | None = None) -> DataFrame:
    """One node for each method; overloads share an id and differ in props.signature_id. return_type keeps the parameter text
    that readers of the graph expect, or void; props.return_type is the real one."""
    class_name = s.simple_name("class_fqn")
    return as_nodes(methods.select(
        s.method_id("name", class_name).alias("id"), F.lit("Method").alias("label"), "name", class_name.alias("class_name"), s.package_of("class_fqn").alias("package"),
        s.or_default("signature", "void").alias("return_type"), F.col("file").alias("source_file"), F.col("start_line").alias("line_number"),
        (F.col("end_line") - F.col("start_line") + 1).alias("body_length"),
        F.when(F.coalesce("signature", F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split("signature", ", ")).alias("parameters"),
        _flags(is_constructor=F.col("name") == class_name, is_getter=s.is_getter("name"), is_setter=s.is_setter("name"), is_abstract=_has("abstract"), is_static=_has("static"), is_public=_has("public"), is_private=_has("private"), is_final=_has("final")).alias("flags"),
        F.create_map(F.lit("return_type"), F.coalesce("return_type", F.lit("void")), F.lit("signature_id"), F.concat(s.method_id("name", class_name), F.lit("("), F.coalesce("signature", F.lit("")), F.lit(")"))).alias("props"),
    ), created_at)


def used_annotations(uses: DataFrame, excluded: list[str]) -> DataFrame:
    name = F.coalesce(F.nullif(F.col("name"), F.lit("")), F.col("simple_name"))
    return uses.withColumn("name", name).where(s.blank("name") | ~F.trim(F.col("name")).isin(excluded))


def annotation_nodes(uses: DataFrame, excluded: list[str] | None = None, created_at: int | None = None) -> DataFrame:
    """One node for each kind of target and name, of its first use by file and line."""
    u = used_annotations(uses, list(DEFAULT_EXCLUDED) if excluded is None else excluded)
    rows = u.select(
        s.annotation_id("name", "target_type").alias("id"), F.lit("Annotation").alias("label"), "name", "target_type", F.col("file").alias("source_file"),
        F.col("start_line").alias("line_number"), s.parameter_text("params").alias("parameters"),
    )
    rows = rows.groupBy("id").agg(F.min_by(F.struct("label", "name", "target_type", "source_file", "line_number", "parameters"), F.struct("source_file", "line_number")).alias("x"))
    return as_nodes(rows.select("id", "x.*"), created_at)


def contains_edges(types: DataFrame, methods: DataFrame) -> DataFrame:
    """Class or interface to method, joined within the file on the class."""
    is_interface = F.lower(F.coalesce("class_type", F.lit(""))) == "interface"
    t = types.where(F.coalesce("class_fqn", F.lit("")) != "").select("file", "class_fqn", F.when(is_interface, s.interface_id("class_fqn")).otherwise(s.class_id("class_fqn")).alias("src"))
    m = methods.select("file", "class_fqn", s.method_id("name", s.simple_name("class_fqn")).alias("dst"))
    return as_edges(t.join(m, ["file", "class_fqn"]).select("src", "dst", F.lit("CONTAINS").alias("type")).distinct())


def call_targets(calls: DataFrame) -> DataFrame:
    """(src, callee_class, callee_name) of calls: the caller's node, and the callee's type without its type arguments."""
    return calls.select(
        s.method_id(F.substring_index("method_full_name", ".", -1), s.simple_name(F.regexp_extract("method_full_name", r"(?s)^(.*)\.[^.]*$", 1))).alias("src"),
        s.strip_type_arguments("callee").alias("callee_class"), F.col("method_name").alias("callee_name"),
    ).distinct()


def met_calls(targets: DataFrame, methods: DataFrame) -> DataFrame:
    """targets joined with the methods (class_fqn, name) that they name."""
    known = methods.select(F.col("class_fqn").alias("callee_class"), F.col("name").alias("callee_name")).distinct()
    met = targets.join(known, ["callee_class", "callee_name"]).select("src", s.method_id("callee_name", s.simple_name("callee_class")).alias("dst"), F.lit("CALLS").alias("type"))
    return as_edges(met.where("src <> dst").distinct())


def calls_edges(calls: DataFrame, methods: DataFrame) -> DataFrame:
    """Method to method: the callee's type, without its type arguments, and the name are looked up among all methods."""
    return met_calls(call_targets(calls), methods)


def overload_edges(calls: DataFrame) -> DataFrame:
    """Method to overload: calls to the signature ids that a method node has in props.signature_id; of overloads that fit equally well,
    all."""
    each = calls.select("method_full_name", "callee", F.explode("targets").alias("t"))
    caller = s.method_id(F.substring_index("method_full_name", ".", -1), s.simple_name(F.regexp_extract("method_full_name", r"(?s)^(.*)\.[^.]*$", 1)))
    target = F.concat(s.method_id(F.col("t.name"), s.simple_name(s.strip_type_arguments("callee"))), F.lit("("), F.col("t.signature"), F.lit(")"))
    return as_edges(each.select(caller.alias("src"), target.alias("dst"), F.lit("CALLS").alias("type")).distinct())


def annotation_edges(uses: DataFrame, excluded: list[str] | None = None) -> DataFrame:
    u = used_annotations(uses, list(DEFAULT_EXCLUDED) if excluded is None else excluded)
    owner = F.regexp_extract("target_fqn", r"(?s)^(.*)\.[^.]*$", 1)
    src = (
        F.when(F.col("target_type") == "Interface", s.interface_id("target_fqn"))
        .when(F.col("target_type") == "Method", s.method_id(F.substring_index("target_fqn", ".", -1), s.simple_name(owner)))
        .otherwise(s.class_id("target_fqn"))
    )
    return as_edges(u.select(src.alias("src"), s.annotation_id("name", "target_type").alias("dst"), F.lit("HAS_ANNOTATION").alias("type")).distinct())


def inheritance_edges(types: DataFrame) -> DataFrame:
    """EXTENDS and IMPLEMENTS. An interface's supertypes are EXTENDS between interfaces."""
    is_interface = F.lower(F.coalesce("class_type", F.lit(""))) == "interface"
    up = types.where(F.coalesce("extends_fqn", F.lit("")) != "").select(
        F.when(is_interface, s.interface_id("class_fqn")).otherwise(s.class_id("class_fqn")).alias("src"),
        F.when(is_interface, s.interface_id("extends_fqn")).otherwise(s.class_id("extends_fqn")).alias("dst"), F.lit("EXTENDS").alias("type"),
    )
    each = types.select("class_fqn", is_interface.alias("i"), F.explode("implements_fqns").alias("to"))
    impl = each.select(
        F.when(F.col("i"), s.interface_id("class_fqn")).otherwise(s.class_id("class_fqn")).alias("src"), s.interface_id("to").alias("dst"),
        F.when(F.col("i"), F.lit("EXTENDS")).otherwise(F.lit("IMPLEMENTS")).alias("type"),
    )
    return as_edges(up.unionByName(impl).distinct())


def instance_ids(calls: DataFrame) -> DataFrame:
    """calls with callee_instance: this1 for `this`, else the variable and its running count in the file."""
    w = W.partitionBy("file", "callee_variable").orderBy("seq")
    n = F.row_number().over(w)
    return calls.withColumn("callee_instance", F.when(F.col("callee_variable") == "this", F.lit("this1")).otherwise(F.concat("callee_variable", n.cast("string"))))


def graph(types: DataFrame, methods: DataFrame, calls: DataFrame, uses: DataFrame, excluded: list[str] | None = None, created_at: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The node and edge tables of a set of documents."""
    kept = kept_methods(methods)
    nodes = class_nodes(types, created_at).unionByName(interface_nodes(types, created_at)).unionByName(method_nodes(kept, created_at)).unionByName(annotation_nodes(uses, excluded, created_at))
    edges = contains_edges(types, kept).unionByName(calls_edges(calls, kept)).unionByName(annotation_edges(uses, excluded)).unionByName(inheritance_edges(types))
    return nodes, edges
