"""The query library over nodes and edges: equality finders, flags, one-hop patterns, existence, counts.

Every name of CATALOG is a query of its own; all of them are built from three shapes, so Catalyst sees plain filters and
joins, with the edge filter (type and one end) pushed to the scan before the join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def find(nodes: DataFrame, label: str, **equal) -> DataFrame:
    out = nodes.where(F.col("label") == label)
    for k, v in equal.items():
        out = out.where(F.col(k) == F.lit(v))
    return out


def with_flag(nodes: DataFrame, label: str, flag: str) -> DataFrame:
    return nodes.where((F.col("label") == label) & (F.col("flags")[flag] == F.lit(True)))


def hop(nodes: DataFrame, edges: DataFrame, kind: str | None, start: str, label: str | None, backwards: bool = False) -> DataFrame:
    """The nodes at the other end of the edges that leave (or, backwards, reach) `start`."""
    here, there = ("dst", "src") if backwards else ("src", "dst")
    e = edges.where(F.col(here) == start)
    if kind:
        e = e.where(F.col("type") == kind)
    n = nodes.where(F.col("label") == label) if label else nodes
    return n.join(e.select(F.col(there).alias("id")), "id").select(*n.columns)


def hops(nodes: DataFrame, edges: DataFrame, kind: str, backwards: bool = False) -> DataFrame:
    """`hop` for every start at once: (start, and the columns of nodes)."""
    here, there = ("dst", "src") if backwards else ("src", "dst")
    e = edges.where(F.col("type") == kind).select(F.col(here).alias("start"), F.col(there).alias("id"))
    return nodes.join(e, "id").select("start", *nodes.columns)


def relationships(nodes: DataFrame, edges: DataFrame, start: str) -> DataFrame:
    e = edges.where(F.col("src") == start).select("src", "type", F.col("dst").alias("id"))
    return e.join(nodes, "id").select("src", "type", F.col("id").alias("dst"), "label", "name")


def existing_ids(nodes: DataFrame, label: str, ids: DataFrame) -> DataFrame:
    return nodes.where(F.col("label") == label).select("id").join(ids.select("id"), "id", "left_semi")


def button_workflow(nodes: DataFrame, edges: DataFrame, button: str) -> DataFrame:
    """The button, what it triggers, what it interacts with, and the functions that interact with it: three optional matches."""
    return workflows(nodes, edges, nodes.where(F.col("id") == button).select(F.col("id").alias("button")))


def workflows(nodes: DataFrame, edges: DataFrame, buttons: DataFrame, by_functions: DataFrame | None = None) -> DataFrame:
    """`button_workflow` of all buttons (button); by_functions: the edges in which to look for functions, if not all."""
    side = lambda kind, here, there, name: edges.where(F.col("type") == kind).select(F.col(here).alias("button"), F.col(there).alias(name))
    callers = (edges if by_functions is None else by_functions).where("type = 'INTERACTS_WITH'").select(F.col("dst").alias("button"), F.col("src").alias("function"))
    functions = callers.join(nodes.where("node_type = 'JSFunction'").select(F.col("id").alias("function")), "function", "left_semi")
    return buttons.join(side("TRIGGERS", "src", "dst", "method"), "button", "left").join(side("INTERACTS_WITH", "src", "dst", "element"), "button", "left").join(functions, "button", "left").select("button", "method", "element", "function")


def functions_by_complexity(nodes: DataFrame, least: int) -> DataFrame:
    score = F.col("props")["complexity_score"].cast("int")
    return nodes.where((F.col("node_type") == "JSFunction") & (score >= least)).orderBy(F.desc(score), "id")


def functions_by_tag(nodes: DataFrame, tag: str) -> DataFrame:
    return nodes.where((F.col("node_type") == "JSFunction") & F.array_contains(F.split(F.col("props")["purpose_tags"], ","), tag))


def count_by(rows: DataFrame, column: str) -> DataFrame:
    """Counts by a column, the largest first."""
    return rows.groupBy(column).agg(F.count("*").alias("count")).orderBy(F.desc("count"), column)


def exists(rows: DataFrame) -> DataFrame:
    """One row: whether there is any; one row is read of each partition at most."""
    return rows.limit(1).agg((F.count("*") > 0).alias("found"))


def annotation_usages(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    a = nodes.where((F.col("label") == "Annotation") & (F.col("name") == name)).select(F.col("id").alias("dst"))
    return edges.where("type = 'HAS_ANNOTATION'").join(a, "dst").agg(F.count("*").alias("usages"))


def usages_by_annotation(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """`annotation_usages` of all annotations: (name, usages)."""
    a = nodes.where("label = 'Annotation'").select(F.col("id").alias("dst"), "name")
    return edges.where("type = 'HAS_ANNOTATION'").join(a, "dst").groupBy("name").agg(F.count("*").alias("usages"))


def methods_per_class(edges: DataFrame) -> DataFrame:
    return edges.where("type = 'CONTAINS'").groupBy(F.col("src").alias("class_id")).agg(F.count("*").alias("methods"))


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Totals and counts by label and by edge type, in one table (kind, name, count)."""
    per = nodes.groupBy(F.lit("label").alias("kind"), F.col("label").alias("name")).agg(F.count("*").alias("count"))
    types = edges.groupBy(F.lit("type").alias("kind"), F.col("type").alias("name")).agg(F.count("*").alias("count"))
    totals = nodes.agg(F.lit("total").alias("kind"), F.lit("nodes").alias("name"), F.count("*").alias("count")).unionByName(edges.agg(F.lit("total").alias("kind"), F.lit("edges").alias("name"), F.count("*").alias("count")))
    return per.unionByName(types).unionByName(totals)


#: The kinds of nodes of the page layer, whatever label they carry.
PAGE_TYPES = ("Page", "JSFComponent", "JSFunction", "BackendMethod", "ExternalJS", "DOMElement")


def _finders() -> dict[str, Callable[..., DataFrame]]:
    out: dict[str, Callable[..., DataFrame]] = {}

    def by(owner: str, name: str, label: str, *columns: str) -> None:
        out[f"{owner}.{name}"] = lambda n, e, *values: find(n, label, **dict(zip(columns, values, strict=True)))

    def fixed(owner: str, name: str, label: str, **equal) -> None:
        out[f"{owner}.{name}"] = lambda n, e: find(n, label, **equal)

    def flag(owner: str, name: str, label: str, which: str) -> None:
        out[f"{owner}.{name}"] = lambda n, e: with_flag(n, label, which)

    def step(owner: str, name: str, kind: str, label: str | None, backwards: bool = False) -> None:
        out[f"{owner}.{name}"] = lambda n, e, start: hop(n, e, kind, start, label, backwards)

    def number(owner: str, name: str, query: str) -> None:
        out[f"{owner}.{name}"] = lambda n, e, *values: out[f"{owner}.{query}"](n, e, *values).agg(F.count("*").alias("count"))

    for label in ("Class", "Interface", "Method", "Annotation"):
        by(label, "by_name", label, "name")
        by(label, "by_source_file", label, "source_file")
        fixed(label, "all", label)
        number(label, "count", "all")
        out[f"{label}.existing_ids"] = lambda n, e, ids, label=label: existing_ids(n, label, ids)
    for label in ("Class", "Interface"):
        by(label, "by_package", label, "package")
        by(label, "by_name_and_package", label, "name", "package")
        number(label, "count_by_package", "by_package")
        flag(label, "all_public", label, "is_public")
        step(label, "contained_methods", "CONTAINS", "Method")
        step(label, "annotations", "HAS_ANNOTATION", "Annotation")
    for name, which in (("all_abstract", "is_abstract"), ("all_final", "is_final")):
        flag("Class", name, "Class", which)
    by("Class", "by_node_type", "Class", "node_type")
    fixed("Class", "all_abstract_by_type", "Class", node_type="AbstractClass")
    fixed("Class", "all_interfaces_by_type", "Class", node_type="Interface")
    step("Class", "sub_classes", "EXTENDS", "Class", True)
    step("Class", "super_classes", "EXTENDS", "Class")
    step("Class", "implemented_interfaces", "IMPLEMENTS", "Interface")
    out["Class.count_by_node_type"] = lambda n, e: count_by(find(n, "Class"), "node_type")
    step("Interface", "extended", "EXTENDS", "Interface")
    step("Interface", "extending", "EXTENDS", "Interface", True)
    step("Interface", "implementing_classes", "IMPLEMENTS", "Class", True)
    by("Method", "by_class", "Method", "class_name")
    by("Method", "by_name_and_class", "Method", "name", "class_name")
    for name, which in (("constructors", "is_constructor"), ("getters", "is_getter"), ("setters", "is_setter"), ("abstract", "is_abstract"), ("static", "is_static")):
        flag("Method", f"all_{name}", "Method", which)
    for name in ("called", "called_by_caller"):
        step("Method", name, "CALLS", "Method")
    for name in ("calling", "calling_by_callee"):
        step("Method", name, "CALLS", "Method", True)
    step("Method", "annotations", "HAS_ANNOTATION", "Annotation")
    for name in ("of_class", "of_class_id"):
        step("Method", name, "CONTAINS", "Method")
    number("Method", "count_by_class", "of_class")
    by("Annotation", "by_target", "Annotation", "target_type")
    by("Annotation", "by_name_and_target", "Annotation", "name", "target_type")
    number("Annotation", "count_by_target", "by_target")
    out["Annotation.count_usages"] = annotation_usages
    for label in ("Class", "Method", "Interface"):
        fixed("Annotation", f"all_{label.lower()}", "Annotation", target_type=label)
        step("Annotation", f"annotated_{label.lower()}", "HAS_ANNOTATION", label, True)
        step("Annotation", f"by_{label.lower()}", "HAS_ANNOTATION", "Annotation")
    page = PAGE_TYPES
    layer = lambda n: n.where(F.col("node_type").isin(*page))
    out["JspNode.by_file"] = lambda n, e, file: layer(n).where(F.col("source_file") == file)
    out["JspNode.by_id"] = lambda n, e, ident: layer(n).where(F.col("id") == ident)
    out["JspNode.by_type"] = lambda n, e, kind: layer(n).where(F.col("node_type") == kind)
    out["JspNode.by_file_and_type"] = lambda n, e, file, kind: layer(n).where((F.col("source_file") == file) & (F.col("node_type") == kind))
    out["JspNode.all"] = lambda n, e: layer(n)
    number("JspNode", "count", "all")
    step("JspNode", "interacting", "INTERACTS_WITH", None)
    for label in ("JSPFile", "JSPBackendMethod", "JSPComponent"):
        by(label, "by_file", label, "source_file")
        by(label, "by_id", label, "id")
        fixed(label, "all", label)
        number(label, "count", "all")
        step(label, "interacting", "INTERACTS_WITH", None)
    for kind in page:
        out[f"JspNode.all_{kind}"] = lambda n, e, kind=kind: n.where(F.col("node_type") == kind)
    out["JspNode.page_of_file"] = lambda n, e, file: n.where((F.col("node_type") == "Page") & (F.col("source_file") == file))
    out["JspNode.with_ajax"] = lambda n, e: n.where((F.col("node_type") == "JSFunction") & F.col("flags")["contains_ajax_call"])
    out["JspNode.with_navigation"] = lambda n, e: n.where((F.col("node_type") == "JSFunction") & F.col("flags")["contains_navigation"])
    out["JspNode.by_complexity"] = lambda n, e, least=5: functions_by_complexity(n, least)
    out["JspNode.by_tag"] = lambda n, e, tag: functions_by_tag(n, tag)
    out["JspNode.workflow"] = button_workflow
    out["JspNode.relationships"] = relationships
    out["JspNode.type_statistics"] = lambda n, e: count_by(n.where(F.col("node_type").isin(*page)), "node_type")
    out["JspNode.relationship_statistics"] = lambda n, e: count_by(e, "type")
    out["JspNode.exists"] = lambda n, e: exists(n.where(F.col("node_type").isin(*page)))
    out["JspNode.count_relationships"] = lambda n, e: e.agg(F.count("*").alias("count"))
    step("JspNode", "triggering", "TRIGGERS", None, True)
    step("JSPComponent", "triggering", "TRIGGERS", "JSPComponent", True)
    step("JspNode", "page_containing", "CONTAINS", "JSPFile", True)
    step("JSPFile", "containing", "CONTAINS", "JSPFile", True)
    out["JSPFile.by_pagecode"] = lambda n, e, c: n.where((F.col("label") == "JSPFile") & (F.col("props")["pagecode_class"] == c))
    by("JSPBackendMethod", "by_class", "JSPBackendMethod", "class_name")
    by("JSPBackendMethod", "by_method", "JSPBackendMethod", "name")
    by("JSPBackendMethod", "by_class_and_method", "JSPBackendMethod", "class_name", "name")
    for key in ("component_type", "tag_name"):
        out[f"JSPComponent.by_{key}"] = lambda n, e, v, key=key: n.where((F.col("label") == "JSPComponent") & (F.col("props")[key] == v))
    out["JSPComponent.by_file_and_type"] = lambda n, e, f, v: n.where((F.col("label") == "JSPComponent") & (F.col("source_file") == f) & (F.col("props")["component_type"] == v))
    return out


CATALOG = _finders()
#: Tags that analysis writes, by the names that presets ask for.
PRESET_TAGS = {"navigation": "Navigation", "validation": "Data_Validation", "form-submission": "Form_Submission", "ui-manipulation": "UI_Manipulation"}


def answer(nodes: DataFrame, edges: DataFrame, name: str, *values, most: int = 1000) -> dict:
    """A query's count, and its first `most` rows as dictionaries; or what went wrong, without raising."""
    try:
        found = CATALOG[name](nodes, edges, *values)
        rows = [r.asDict(recursive=True) for r in found.limit(most).collect()]
        return {"success": True, "records": rows, "count": len(rows) if len(rows) < most else found.count()}
    except Exception as e:  # the answer carries the error
        return {"success": False, "error": str(e)}


def preset(nodes: DataFrame, name: str) -> DataFrame:
    """The functions with the tag that a preset stands for."""
    return functions_by_tag(nodes, PRESET_TAGS[name])


def node_details(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> DataFrame:
    """ids: (id). Each node with its edges out and in, each sorted: (id, label, name, out, incoming), structs of type and node."""
    side = lambda here, there, name: edges.join(ids.select(F.col("id").alias(here)).distinct(), here, "left_semi").groupBy(F.col(here).alias("id")).agg(F.array_sort(F.collect_list(F.struct("type", F.col(there).alias("node")))).alias(name))
    own = nodes.join(ids.select("id").distinct(), "id", "left_semi").select("id", "label", "name")
    none = F.array().cast("array<struct<type:string,node:string>>")
    met = own.join(side("src", "dst", "out"), "id", "left").join(side("dst", "src", "incoming"), "id", "left")
    return met.select("id", "label", "name", F.coalesce("out", none).alias("out"), F.coalesce("incoming", none).alias("incoming"))


def page_report(nodes: DataFrame, edges: DataFrame, least: int = 5) -> DataFrame:
    """(section, name, value): node types, edge types, functions with calls to the server, and functions of at least that complexity."""
    types, kinds = CATALOG["JspNode.type_statistics"](nodes, edges), CATALOG["JspNode.relationship_statistics"](nodes, edges)
    ajax = CATALOG["JspNode.with_ajax"](nodes, edges).select(F.lit("ajax").alias("section"), "name", F.lit(1).cast("long").alias("value"))
    hard = nodes.where((F.col("node_type") == "JSFunction") & (F.col("props")["complexity_score"].cast("int") >= least))
    hard = hard.select(F.lit("complexity").alias("section"), "name", F.col("props")["complexity_score"].cast("long").alias("value"))
    part = lambda df, section, column: df.select(F.lit(section).alias("section"), F.col(column).alias("name"), F.col("count").alias("value"))
    return part(types, "nodes", "node_type").unionByName(part(kinds, "relationships", "type")).unionByName(ajax).unionByName(hard)


def methods_by_class(methods: DataFrame) -> DataFrame:
    """methods: (class_fqn, name). (class_fqn, names): the distinct names of each class."""
    return methods.select("class_fqn", "name").distinct().groupBy("class_fqn").agg(F.array_sort(F.collect_list("name")).alias("names"))


def folder_totals(nodes: DataFrame) -> DataFrame:
    """(folder, files, components, functions, methods, scripts): the page layer's totals for each folder of a page."""
    folder = F.regexp_extract("source_file", r"^(.*)/[^/]*$", 1)
    some = lambda kind: F.count_if(F.col("node_type") == kind)
    return nodes.where(F.col("node_type").isin(*PAGE_TYPES)).groupBy(folder.alias("folder")).agg(
        some("Page").alias("files"), some("JSFComponent").alias("components"), some("JSFunction").alias("functions"), some("BackendMethod").alias("methods"), some("ExternalJS").alias("scripts"),
    )
