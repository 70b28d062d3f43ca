"""Page extraction: components, script functions, outside scripts and their graph, by pattern functions of Spark.

Offsets come without Python: matches are searched for one after the other, and line breaks are counted between them. The body of
a function ends where its braces do: braces are exploded with their offsets alone, matched by windows, and the text meets its
bodies once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.functions import scalars as s

# The patterns of page directives, components and scripts.
ACTION = r'(?is)<(jc:commandLinkEx|jc:download)\s+[^>]*?action="#\{([^}]+)\}'
DECODE = r'(?is)<hx:scriptCollector\s+[^>]*?decode="#\{([^}]+)\}'
IDENTITY = r'(?i)id="([^"]+)"'
PAGECODE = r'(?i)<%--\s*jsf:pagecode[^>]*location="([^"]+)"'
SCRIPT = r"(?is)<script[^>]*>(.*?)</script>"
FUNCTION = r"(?i)function\s+([a-zA-Z_$][a-zA-Z0-9_$]*)\s*\("
AJAX = r'(?i)ajaxActionCall\s*\([^,]+,\s*"([^"]+)"'
NAVIGATION = r"(?i)winopen\s*\([^,]+,\s*[^,]+,\s*[^)]+\)"
OUTSIDE = r'(?i)<jc:script[^>]*src="([^"]+)"'
ELEMENT = r"""(?i)document\.getElementById\(["']([^"']+)["']\)"""


def matches(df: DataFrame, text: str, pattern: str, group: int, *keep: str) -> DataFrame:
    """(keep..., ordinal, found, before, whole, at): each match, what stands before it, and its 0-based offset."""
    rows = df.select(*keep, F.col(text).alias("_t"), F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)).alias("_all"), F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(group)).alias("_own"))
    # Matches don't overlap and are in order, so offsets add up: each is searched for after the end of the last.
    places = F.aggregate(
        "_all", F.struct(F.lit(1).alias("next"), F.array().cast("array<int>").alias("at")),
        lambda a, x: F.struct((F.call_function("locate", x, F.col("_t"), a["next"]) + F.length(x)).alias("next"), F.concat(a["at"], F.array(F.call_function("locate", x, F.col("_t"), a["next"]) - 1)).alias("at")),
    )
    rows = rows.withColumn("_at", places["at"])
    zipped = rows.select(*keep, "_t", F.posexplode(F.arrays_zip("_all", "_own", "_at")).alias("ordinal", "_x"))
    return zipped.select(*keep, (F.col("ordinal") + 1).alias("ordinal"), F.col("_x._own").alias("found"), F.col("_x._all").alias("whole"), F.col("_x._at").alias("at"), F.substring(F.col("_t"), F.lit(1), F.col("_x._at")).alias("before"), F.substring(F.col("_t"), F.col("_x._at") + 1, F.length("_t")).alias("after"))


def places(df: DataFrame, text: str, pattern: str, group: int, *keep: str, until: str | None = None) -> DataFrame:
    """(keep..., ordinal, found, whole, at, line, tail): each match with its 0-based offset and the line it stands on, as `pieces` of what is
    before it would tell; tail: from the match on, up to the first `until`. The text is gone through once, from match to match, and
    isn't copied beside them."""
    t = F.col(text)
    rows = df.select(*keep, t.alias("_t"), F.regexp_extract_all(t, F.lit(pattern), F.lit(0)).alias("_all"), F.regexp_extract_all(t, F.lit(pattern), F.lit(group)).alias("_own"))
    empty = F.array().cast("array<struct<at:int,line:int>>")
    find = lambda x, a: F.call_function("locate", x, F.col("_t"), a)

    def step(a, x):
        at = find(x, a["next"]) - 1
        # The text since the last match began: its line breaks, and those right before this one, which don't count.
        gap = F.substring(F.col("_t"), a["from"] + 1, at - a["from"])
        breaks, last = a["breaks"] + F.regexp_count(gap, F.lit("\n")), F.length(F.regexp_extract(gap, r"\n*$", 0))
        line = F.when(at == 0, 1).when(last == at, 0).otherwise(breaks - last + 1)
        return F.struct((at + F.length(x) + 1).alias("next"), at.alias("from"), breaks.alias("breaks"), F.concat(a["out"], F.array(F.struct(at.alias("at"), line.cast("int").alias("line")))).alias("out"))

    start = F.struct(F.lit(1).alias("next"), F.lit(0).alias("from"), F.lit(0).alias("breaks"), empty.alias("out"))
    rows = rows.withColumn("_p", F.aggregate("_all", start, step)["out"])
    tail = F.transform("_p", lambda p: F.substring(F.col("_t"), p["at"] + 1, F.greatest(find(F.lit(until), p["at"] + 1) - p["at"], F.lit(0)))) if until else F.transform("_p", lambda p: F.lit(""))
    zipped = rows.withColumn("_tail", tail).select(*keep, F.posexplode(F.arrays_zip("_all", "_own", "_p", "_tail")).alias("ordinal", "_x"))
    return zipped.select(*keep, (F.col("ordinal") + 1).alias("ordinal"), F.col("_x._own").alias("found"), F.col("_x._all").alias("whole"), F.col("_x._p.at").alias("at"), F.col("_x._p.line").alias("line"), F.col("_x._tail").alias("tail"))


def regions(blocks: DataFrame, text: str, starts: DataFrame, *key: str) -> DataFrame:
    """blocks: (key..., text); starts: (key..., ordinal, at). (key..., ordinal, content): from each start to the brace that closes the first one
    after it; 500 characters if none does.

    Braces are exploded without the text around them; a running sum gives each its depth, a brace closes the last opener of its
    depth, and each start finds the first opener after it in a window. The text meets its regions once a block."""
    found = blocks.select(*key, F.posexplode(F.arrays_zip(F.transform(F.split(text, r"[{}]", -1), F.length).alias("gap"), F.regexp_extract_all(text, F.lit(r"[{}]"), F.lit(0)).alias("mark"))).alias("ord", "_x"))
    found = found.select(*key, "ord", F.col("_x.gap").alias("gap"), F.col("_x.mark").alias("mark")).where("mark is not null")
    w = W.partitionBy(*key).orderBy("ord")
    before = w.rowsBetween(W.unboundedPreceding, -1)
    total = lambda x: F.coalesce(F.sum(x).over(before), F.lit(0))
    opens = F.col("mark") == "{"
    found = found.withColumns({"at": total(F.col("gap") + 1) + F.col("gap"), "level": total(F.when(opens, 1).otherwise(-1)) + F.when(opens, 1).otherwise(0)})
    close = F.first(F.when(~opens, F.col("at")), ignorenulls=True).over(W.partitionBy(*key, "level").orderBy("ord").rowsBetween(1, W.unboundedFollowing))
    openers = found.withColumn("close", close).where(opens).select(*key, "at", F.lit(0).alias("ordinal"), F.struct("close").alias("opener"))
    both = starts.select(*key, "at", "ordinal", F.lit(None).cast("struct<close:bigint>").alias("opener")).unionByName(openers)
    after = W.partitionBy(*key).orderBy("at", "ordinal").rowsBetween(1, W.unboundedFollowing)
    ends = both.withColumn("end", F.first("opener", ignorenulls=True).over(after)["close"]).where("ordinal > 0")
    each = ends.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("ordinal", "at", "end"))).alias("_r"))
    cut = F.transform("_r", lambda r: F.struct(r["ordinal"].alias("ordinal"), F.substring(F.col(text), (r["at"] + 1).cast("int"), F.coalesce(r["end"] - r["at"] + 1, F.lit(500)).cast("int")).alias("content")))
    return blocks.select(*key, text).join(each, list(key)).select(*key, F.inline(cut))


def pagecode_class(text) -> F.Column:
    place = F.regexp_extract(text, PAGECODE, 1)
    cut = F.replace(F.replace(F.replace(place, F.lit("/src/"), F.lit("")), F.lit(".java"), F.lit("")), F.lit("/"), F.lit("."))
    return F.when(place != "", cut)


def components(pages: DataFrame, file: str = "file", text: str = "content") -> DataFrame:
    """(file, id, type, action, event_type, line): tags with an action, and script collectors."""
    identity = F.coalesce(F.nullif(F.regexp_extract("tail", IDENTITY, 1), F.lit("")), F.lit("unknown"))
    a = places(pages, text, ACTION, 2, file, until=">").select(file, identity.alias("id"), F.regexp_extract("whole", ACTION, 1).alias("type"), F.col("found").alias("action"), F.lit(None).cast("string").alias("event_type"), "line")
    b = places(pages, text, DECODE, 1, file, until=">").select(file, identity.alias("id"), F.lit("scriptCollector").alias("type"), F.col("found").alias("action"), F.lit("onPagePost").alias("event_type"), "line")
    return a.unionByName(b)


def functions(pages: DataFrame, file: str = "file", text: str = "content") -> DataFrame:
    """(file, name, line, content, has_ajax, ajax_calls, has_navigation) of each named function in a script block. Pages are told apart by file and
    text; rows that repeat both are one page."""
    doc = pages.select(file, text, F.xxhash64(text).alias("doc"))
    blocks = places(doc, text, SCRIPT, 1, file, "doc").select(file, "doc", F.col("ordinal").alias("block"), F.col("found").alias("script"), F.col("line").alias("block_line"))
    found = places(blocks, "script", FUNCTION, 1, file, "doc", "block", "block_line").select(file, "doc", "block", "ordinal", "at", F.col("found").alias("name"), (F.col("block_line") + F.col("line")).alias("line"))
    key = (file, "doc", "block")
    found = found.dropDuplicates([*key, "ordinal"])
    out = found.drop("at").join(regions(blocks.dropDuplicates(list(key)), "script", found, *key), [*key, "ordinal"]).select(file, "name", "line", "content")
    ajax = F.regexp_extract_all("content", F.lit(AJAX), F.lit(1))
    return out.withColumn("ajax_calls", ajax).withColumn("has_ajax", F.size("ajax_calls") > 0).withColumn("has_navigation", F.col("content").rlike(NAVIGATION))


def element_ids(content) -> F.Column:
    return F.array_distinct(F.regexp_extract_all(content, F.lit(ELEMENT), F.lit(1)))


# The words in an element's id that tell its type, and those in a function's body that tell its purpose.
def element_type(x) -> F.Column:
    has = lambda *words: F.col(x).rlike("|".join(words)) if isinstance(x, str) else x.rlike("|".join(words))
    return F.when(has("btn"), "Button").when(has("txt", "input"), "Input").when(has("combo"), "ComboBox").when(has("rdo"), "RadioButton").when(has("chk"), "CheckBox").when(has("date"), "DatePicker").when(has("form"), "Form").otherwise("Unknown")


def purpose_tags(content) -> F.Column:
    c = F.col(content) if isinstance(content, str) else content
    return F.array_compact(F.array(
        F.when(c.rlike("(?i)check|validate"), "Data_Validation"), F.when(c.contains("style.display") | c.contains(".value"), "UI_Manipulation"),
        F.when(c.rlike(NAVIGATION), "Navigation"), F.when(c.rlike(r"(?i)\.submit\s*\("), "Form_Submission"),
    ))


def complexity(content) -> F.Column:
    """Branches and loops of a function, plus one."""
    return F.regexp_count(content, F.lit(r"\b(if|for|while|case|catch)\b|&&|\|\||\?")) + 1


def parsed_analysis(text) -> F.Column:
    """What stands between the first { and the last } of a model's answer, as a struct; null where it isn't JSON."""
    schema = (
        "summary string, purpose_tags array<string>, interacts_with_ids array<string>, ui_manipulation string, data_flow string, business_logic string, "
        "complexity_score int, maintainability_notes string, potential_backend_calls array<string>"
    )  # fixed values: the keys of an answer
    return F.from_json(F.regexp_extract(text, r"(?s)(\{.*\})", 1), schema)


def page_graph(pages: DataFrame, file: str = "file", text: str = "content") -> tuple[DataFrame, DataFrame]:
    """Nodes (id, label, node_type, name, class_name, source_file, line_number, flags, props) and edges (src, dst, type, attr)."""
    page_id = F.concat(F.lit("page_"), F.col(file))
    method_id = lambda c: F.concat(F.lit("method_"), F.replace(c, F.lit("."), F.lit("_")))
    none = F.create_map().cast("map<string,boolean>")
    empty = F.create_map().cast("map<string,string>")

    def node(df, ident, label, kind, name, cls=None, line=None, flags=None, props=None):
        return df.select(ident.alias("id"), F.lit(label).alias("label"), F.lit(kind).alias("node_type"), name.alias("name"), (cls if cls is not None else F.lit("")).alias("class_name"), F.col(file).alias("source_file"), (line if line is not None else F.lit(0)).cast("int").alias("line_number"), (flags if flags is not None else none).alias("flags"), (props if props is not None else empty).alias("props"))

    def edge(df, src, dst, kind, attr):
        return df.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type"), (F.lit(attr) if isinstance(attr, str) or attr is None else attr).cast("string").alias("attr"))

    page = pages.select(file, pagecode_class(F.col(text)).alias("pagecode"))
    comp, funs = components(pages, file, text), functions(pages, file, text)
    outside = pages.select(file, F.explode(F.regexp_extract_all(F.col(text), F.lit(OUTSIDE), F.lit(1))).alias("path"))
    outside_id = F.concat(F.lit("external_"), F.regexp_replace("path", "[^a-zA-Z0-9]", "_"))
    called = comp.where("action <> ''").select(file, F.col("action").alias("method")).unionByName(funs.select(file, F.explode("ajax_calls").alias("method"))).distinct().join(page, file)
    touched = funs.select(file, "name", F.explode(element_ids(F.col("content"))).alias("element"))
    dom_id = F.concat(F.lit("dom_"), F.replace("element", F.lit(":"), F.lit("_")))
    fun_id = F.concat(F.lit("js_"), F.col("name"))
    nodes = [
        node(page, page_id, "JSPFile", "Page", F.col(file), line=F.lit(1), props=F.create_map(F.lit("pagecode_class"), F.coalesce("pagecode", F.lit("")))),
        node(comp, F.col("id"), "JSPComponent", "JSFComponent", F.col("id"), line=F.col("line"), props=F.create_map(F.lit("component_type"), F.col("type"), F.lit("tag_name"), F.col("type"), F.lit("action"), F.col("action"), F.lit("event_type"), F.coalesce("event_type", F.lit("action")))),
        node(funs, fun_id, "JspNode", "JSFunction", F.col("name"), line=F.col("line"), flags=F.create_map(F.lit("contains_ajax_call"), F.col("has_ajax"), F.lit("contains_navigation"), F.col("has_navigation")), props=F.create_map(F.lit("purpose_tags"), F.array_join(purpose_tags("content"), ","), F.lit("complexity_score"), complexity(F.col("content")).cast("string"))),
        node(called, method_id(F.col("method")), "JSPBackendMethod", "BackendMethod", F.col("method"), F.coalesce("pagecode", F.lit("unknown"))),
        node(touched.select(file, "element").distinct(), dom_id, "JspNode", "DOMElement", F.col("element"), props=F.create_map(F.lit("element_type"), element_type("element"))),
        node(outside, outside_id, "JspNode", "ExternalJS", F.col("path"), props=F.create_map(F.lit("file_path"), F.col("path"))),
    ]
    edges = [
        edge(comp, page_id, F.col("id"), "CONTAINS", None), edge(comp.where("action <> ''"), F.col("id"), method_id(F.col("action")), "TRIGGERS", F.coalesce("event_type", F.lit("action"))),
        edge(funs, page_id, fun_id, "CONTAINS", None), edge(touched, fun_id, dom_id, "INTERACTS_WITH", "manipulates"),
        edge(funs.select(file, "name", F.explode("ajax_calls").alias("method")), fun_id, method_id(F.col("method")), "TRIGGERS", "ajax"),
        edge(outside, page_id, outside_id, "DEPENDS_ON", "script_dependency"),
    ]
    all_nodes, all_edges = nodes[0], edges[0]
    for x in nodes[1:]:
        all_nodes = all_nodes.unionByName(x)
    for x in edges[1:]:
        all_edges = all_edges.unionByName(x)
    # The page that names a node first, by file and line, describes it.
    best = all_nodes.groupBy("id").agg(F.min_by(F.struct(*all_nodes.columns[1:]), F.struct("source_file", "line_number")).alias("x"))
    return best.select("id", "x.*"), all_edges.groupBy("src", "dst", "type").agg(F.min("attr").alias("attr"))


def linked(backend: DataFrame, methods: DataFrame) -> DataFrame:
    """backend: (id, class_name, name): with linked_id, the method of that class and name; an action's bean prefix doesn't count."""
    name = F.substring_index("name", ".", -1)
    m = methods.groupBy(F.col("name").alias("_n"), F.col("class_name").alias("_c")).agg(F.min("id").alias("linked_id"))
    return backend.join(m, (name == F.col("_n")) & (F.substring_index("class_name", ".", -1) == F.col("_c")), "left").drop("_n", "_c")


def unlinked(links: DataFrame, node_id: str) -> DataFrame:
    return links.withColumn("linked_id", F.when(F.col("id") != node_id, F.col("linked_id")))
