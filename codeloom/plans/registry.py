"""Every query over the reference data model, by name, with its DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.functions import scalars as s
from codeloom.operators import changelog, convert, finders, java, pages, patterns, render, runs, store, trace, weave
from codeloom.plans import lens
from codeloom.sources import files
from codeloom.tables import shared_dir, stored, written

_QUERIES: dict = {}
_SQL: dict[str, str] = {}

# The lens in SQL. {x} of an oracle is replaced by nothing else than these common tables.
_LENS = """
with types as (select 'nation/' || n_name file, r_name package, r_name || '.' || n_name class_fqn, n_name, r_name, n_nationkey,
   case when n_nationkey % 5 = 0 then 'AbstractClass' else 'Class' end class_type,
   first_value(n_name) over (partition by r_name order by n_nationkey) first_name from nation join region on n_regionkey = r_regionkey),
 methods as (select 'nation/' || n_name file, class_fqn, n_name, r_name, c_name as name, c_mktsegment return_type, c_custkey k, 'c' kind from customer join types on c_nationkey = n_nationkey
   union all select 'nation/' || n_name, class_fqn, n_name, r_name, s_name, 'void', s_suppkey, 's' from supplier join types on s_nationkey = n_nationkey),
 nodes as (select 'class_' || replace(r_name, '.', '_') || '_' || n_name id, 'Class' label, n_name as name, r_name package, '' class_name, class_type node_type, '' target_type, file source_file, n_nationkey line_number, '' return_type from types
   union all select 'interface_' || r_name, 'Interface', r_name, '', '', '', '', 'region/' || r_name, r_regionkey, '' from region
   union all select 'method_' || n_name || '_' || name, 'Method', name, r_name, n_name, '', '', file, k, 'void' from methods
   union all select 'annotation_Method_' || c_mktsegment, 'Annotation', c_mktsegment, '', '', '', 'Method', min(f), cast(arg_min(c_custkey, f || lpad(cast(c_custkey as varchar), 20, '0')) as bigint), ''
     from (select *, 'nation/' || n_name f from customer join nation on c_nationkey = n_nationkey) group by c_mktsegment),
 edges as (select 'class_' || r_name || '_' || m.n_name src, 'method_' || m.n_name || '_' || m.name dst, 'CONTAINS' "type" from methods m
   union select 'class_' || r_name || '_' || n_name, 'class_' || r_name || '_' || first_name, 'EXTENDS' from types where n_name <> first_name
   union select 'class_' || r_name || '_' || n_name, 'interface_' || r_name, 'IMPLEMENTS' from types
   union select 'method_' || n_name || '_' || name, 'annotation_Method_' || return_type, 'HAS_ANNOTATION' from methods where kind = 'c'
   union select 'method_' || a.n_name || '_' || a.name, 'method_' || b.n_name || '_' || b.name, 'CALLS' from orders join lineitem on o_orderkey = l_orderkey
     join methods a on a.kind = 'c' and a.k = o_custkey join methods b on b.kind = 's' and b.k = l_suppkey)
"""
_EVENTS = """
with recursive step as (select distinct caller, callee from (select 'u' || user_id || '.' || event_type caller,
   'u' || user_id || '.' || lead(event_type) over (partition by user_id order by ts, event_id) callee from events) where callee is not null and caller <> callee)
"""


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def _n(columns: str):
    return [c.strip() for c in columns.split(",")]


# Nodes and edges ---------------------------------------------------------------------------------------------------


@query(_LENS + "select id, name, package, node_type, source_file, cast(line_number as integer) line_number from nodes where label = 'Class'")
def build_class_nodes(spark: SparkSession, d: str) -> DataFrame:
    return convert.class_nodes(lens.types(spark, d), 0).select(*_n("id, name, package, node_type, source_file, line_number"))


@query(_LENS + "select id, name, package, source_file from nodes where label = 'Interface'")
def build_interface_nodes(spark, d):
    return convert.interface_nodes(lens.types(spark, d), 0).select(*_n("id, name, package, source_file"))


@query(_LENS + "select 'method_' || n_name || '_' || name id, name, n_name class_name, r_name package, 'void' return_type, return_type real_type, cast(5 as integer) body_length from methods")
def build_method_nodes(spark, d):
    m = convert.method_nodes(lens.methods(spark, d), 0)
    return m.select(*_n("id, name, class_name, package, return_type"), F.col("props")["return_type"].alias("real_type"), "body_length")


@query(_LENS + "select id, name, target_type, source_file, 'value=' || name parameter from nodes where label = 'Annotation'")
def build_annotation_nodes(spark, d):
    return convert.annotation_nodes(lens.annotation_uses(spark, d), created_at=0).select("id", "name", "target_type", "source_file", F.col("parameters")[0].alias("parameter"))


@query(_LENS + "select src, dst from edges where type = 'CONTAINS'")
def contains_edges(spark, d):
    return convert.contains_edges(lens.types(spark, d), lens.methods(spark, d)).select("src", "dst")


@query(_LENS + "select src, dst from edges where type = 'CALLS'")
def calls_edges(spark, d):
    return convert.calls_edges(lens.calls(spark, d), lens.methods(spark, d)).select("src", "dst")


@query(_LENS + "select src, dst from edges where type = 'HAS_ANNOTATION'")
def has_annotation_edges(spark, d):
    return convert.annotation_edges(lens.annotation_uses(spark, d)).select("src", "dst")


@query(_LENS + "select src, dst from edges where type = 'EXTENDS'")
def extends_edges(spark, d):
    return convert.inheritance_edges(lens.types(spark, d)).where("type = 'EXTENDS'").select("src", "dst")


@query(_LENS + "select src, dst from edges where type = 'IMPLEMENTS'")
def implements_edges(spark, d):
    return convert.inheritance_edges(lens.types(spark, d)).where("type = 'IMPLEMENTS'").select("src", "dst")


_ACCESSORS = """
with m as (select 'nation/' || c_nationkey file, (case when c_custkey % 4 = 0 then 'get' when c_custkey % 4 = 1 then 'set' when c_custkey % 4 = 2 then 'is' else 'work' end) || c_mktsegment || cast(c_custkey % 10 as varchar) as name from customer),
 p as (select distinct file, name, left(name, 3) = 'set' setter, regexp_replace(name, '^(get|set|is)', '') prop from m where name not like 'work%')
"""


@query(_ACCESSORS + """select file, name, count(*) n from m where name like 'work%' or not exists (select 1 from p where p.file = m.file and p.prop = regexp_replace(m.name, '^(get|set|is)', '')
 and p.setter <> (left(m.name, 3) = 'set')) group by file, name""")
def accessor_pair_filter(spark, d):
    k = F.col("c_custkey") % 4
    name = F.concat(F.when(k == 0, "get").when(k == 1, "set").when(k == 2, "is").otherwise("work"), "c_mktsegment", (F.col("c_custkey") % 10).cast("string"))
    m = lens.table(spark, d, "customer").select(F.concat(F.lit("nation/"), F.col("c_nationkey").cast("string")).alias("file"), F.lit("a.B").alias("class_fqn"), name.alias("name"))
    return convert.kept_methods(m).groupBy("file", "name").agg(F.count("*").alias("n"))


@query("""select id, name, version from (select 'p' || p_partkey id, case when p_partkey % 3 = 0 then p_name || '!' else p_name end as name, case when p_partkey % 3 = 0 then 2 else 1 end version from part)
union all select 'new' || p_partkey, p_name, 2 from part where p_partkey % 100 = 1""")
def upsert_last_wins(spark, d):
    p = lens.table(spark, d, "part")
    old = p.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("name"), F.lit(1).alias("version"), F.lit(0).cast("bigint").alias("created_at"))
    same = p.where("p_partkey % 3 = 0").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.concat("p_name", F.lit("!")).alias("name"), F.lit(2).alias("version"), F.lit(1).cast("bigint").alias("created_at"))
    new = p.where("p_partkey % 100 = 1").select(F.concat(F.lit("new"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("name"), F.lit(2).alias("version"), F.lit(1).cast("bigint").alias("created_at"))
    return store.upsert_nodes(old, same.unionByName(new)).drop("created_at")


@query(_LENS + "select src, dst from edges e where type = 'CALLS' and not exists (select 1 from nodes n where n.id = e.dst and n.line_number % 2 = 0)")
def dangling_edges_dropped(spark, d):
    n = lens.nodes(spark, d).where("label <> 'Method' or name like 'Customer%' or line_number % 2 = 0").select("id")
    return store.dangling_edges(lens.edges(spark, d).where("type = 'CALLS'"), n).select("src", "dst")


@query(_LENS + ", gone as (select id from nodes where source_file = 'nation/NATION_7') select type, count(*) n from edges where src not in (select id from gone) and dst not in (select id from gone) group by type")
def cascade_delete_by_source(spark, d):
    n, e = lens.nodes(spark, d), lens.edges(spark, d)
    _, kept = store.detach_delete(n, e, n.where("source_file = 'nation/NATION_7'"))
    return kept.groupBy("type").agg(F.count("*").alias("n"))


@query(_LENS + """, g as (select id from nodes where label = 'Annotation'), e2 as (select * from edges where dst not in (select id from g) and src not in (select id from g)),
 c as (select cast(0 as bigint) nodes_created, cast(0 as bigint) relationships_created, (select count(*) from g) nodes_deleted, (select count(*) from edges) - (select count(*) from e2) relationships_deleted)
 select *, nodes_created + relationships_created + nodes_deleted + relationships_deleted total from c""")
def write_counters(spark, d):
    n, e = lens.nodes(spark, d), lens.edges(spark, d)
    left, kept = store.detach_delete(n, e, n.where("label = 'Annotation'"))
    return store.change_counts(n, left, e, kept)


# Counts ------------------------------------------------------------------------------------------------------------


@query(_LENS + "select label, count(*) n from nodes group by label")
def label_counts(spark, d):
    return finders.count_by(lens.nodes(spark, d), "label").withColumnRenamed("count", "n")


@query(_LENS + "select node_type, count(*) \"count\" from nodes where label = 'Class' group by node_type")
def counts_by_node_type(spark, d):
    return finders.CATALOG["Class.count_by_node_type"](lens.nodes(spark, d), lens.edges(spark, d))


@query(_LENS + "select type, count(*) \"count\" from edges group by type")
def edge_type_counts_desc(spark, d):
    return finders.count_by(lens.edges(spark, d), "type")


@query(_LENS + "select name, count(*) usages from edges join nodes on dst = id where type = 'HAS_ANNOTATION' group by name")
def annotation_usage_counts(spark, d):
    return finders.usages_by_annotation(lens.nodes(spark, d), lens.edges(spark, d))


@query(_LENS + "select src as class_id, count(*) methods from edges where type = 'CONTAINS' group by src")
def methods_per_class(spark, d):
    return finders.methods_per_class(lens.edges(spark, d))


@query(_LENS + "select package, count(*) n from nodes where label in ('Class', 'Interface') group by package")
def counts_by_package(spark, d):
    return finders.count_by(lens.nodes(spark, d).where("label in ('Class', 'Interface')"), "package").withColumnRenamed("count", "n")


@query(_LENS + "select (count(*) > 0) found from nodes where name = 'NATION_3'")
def exists_any(spark, d):
    return finders.exists(lens.nodes(spark, d).where("name = 'NATION_3'"))


@query(_LENS + """select 'label' kind, label as name, count(*) "count" from nodes group by label union all select 'type', type, count(*) from edges group by type
 union all select 'total', 'nodes', count(*) from nodes union all select 'total', 'edges', count(*) from edges""")
def graph_statistics(spark, d):
    return finders.statistics(lens.nodes(spark, d), lens.edges(spark, d))


@query(_LENS + ", c as (select src, count(*) n from edges where type = 'CALLS' group by src) select class_name, count(*) callers, cast(sum(n) as bigint) calls, max(n) most from c join nodes on src = id group by class_name")
def call_totals_per_class(spark, d):
    c = lens.edges(spark, d).where("type = 'CALLS'").groupBy("src").agg(F.count("*").alias("n"))
    m = lens.nodes(spark, d).where("label = 'Method'").select("id", "class_name")
    return c.join(m, c["src"] == m["id"]).groupBy("class_name").agg(F.count("*").alias("callers"), F.sum("n").alias("calls"), F.max("n").alias("most"))


# Finders -----------------------------------------------------------------------------------------------------------


@query(_LENS + "select id from nodes where label = 'Class' and name = 'NATION_4' and package = 'MIDDLE EAST'")
def find_by_name_and_package(spark, d):
    return finders.CATALOG["Class.by_name_and_package"](lens.nodes(spark, d), None, "NATION_4", "MIDDLE EAST").select("id")


@query(_LENS + "select id from nodes where label = 'Method' and id in (select 'method_' || n_name || '_' || c_name from customer join nation on c_custkey % 25 = n_nationkey)")
def find_by_ids_in_list(spark, d):
    n = lens.table(spark, d, "nation")
    c = lens.table(spark, d, "customer")
    ids = c.join(F.broadcast(n), F.col("c_custkey") % 25 == F.col("n_nationkey")).select(s.method_id("c_name", "n_name").alias("id"))
    return finders.existing_ids(lens.nodes(spark, d), "Method", ids)


@query("""select 'abstract' flag, r_name || '.' || n_name fqn from nation join region on n_regionkey = r_regionkey where n_nationkey % 5 = 0
 union all select 'final', r_name || '.' || n_name from nation join region on n_regionkey = r_regionkey where n_nationkey % 5 <> 0 and n_nationkey % 3 = 0
 union all select 'public', r_name || '.' || n_name from nation join region on n_regionkey = r_regionkey where n_nationkey % 5 = 0 or n_nationkey % 3 <> 0""")
def flags_filter(spark, d):
    n, out = lens.nodes(spark, d), None
    for flag in ("abstract", "final", "public"):
        one = finders.CATALOG[f"Class.all_{flag}"](n, None).select(F.lit(flag).alias("flag"), F.concat("package", F.lit("."), "name").alias("fqn"))
        out = one if out is None else out.unionByName(one)
    return out


def _pairs(kind: str, here: str, there: str):
    return lambda spark, d: finders.hops(lens.nodes(spark, d), lens.edges(spark, d), kind, backwards=here == "dst").select("start", "name", "label")


for _name, _kind, _here, _there in (
    ("superclasses", "EXTENDS", "src", "dst"), ("subclasses", "EXTENDS", "dst", "src"), ("implementers", "IMPLEMENTS", "dst", "src"), ("implemented_interfaces", "IMPLEMENTS", "src", "dst"),
    ("callees", "CALLS", "src", "dst"), ("callers", "CALLS", "dst", "src"), ("annotated_methods", "HAS_ANNOTATION", "dst", "src"), ("annotations_of_method", "HAS_ANNOTATION", "src", "dst"),
    ("methods_of_class", "CONTAINS", "src", "dst"), ("class_of_methods", "CONTAINS", "dst", "src"),
):
    _QUERIES[_name] = _pairs(_kind, _here, _there)
    _SQL[_name] = _LENS + f"select {_here} as start, name, label from edges join nodes on {_there} = id where type = '{_kind}'"


@query(_LENS + "select n.id, n.name from edges e join nodes n on e.dst = n.id where e.type = 'CALLS' and e.src = 'method_NATION_2_Customer#000000000'")
def called_by_one(spark, d):
    return finders.CATALOG["Method.called"](lens.nodes(spark, d), lens.edges(spark, d), "method_NATION_2_Customer#000000000").select("id", "name")


@query(_LENS + "select e.src, e.type, n.id dst, n.label, n.name from edges e join nodes n on e.dst = n.id where e.src = 'class_ASIA_NATION_7'")
def node_relationships(spark, d):
    return finders.relationships(lens.nodes(spark, d), lens.edges(spark, d), "class_ASIA_NATION_7")


@query(_LENS + """, b as (select distinct src from edges where type = 'CONTAINS' and src like 'class%')
 select b.src button, a.dst as method, i.dst as element, f.src as "function" from b left join edges a on a.src = b.src and a.type = 'EXTENDS' left join edges i on i.src = b.src and i.type = 'IMPLEMENTS'
 left join (select e.src, e.dst from edges e where e.type = 'EXTENDS') f on f.dst = b.src""")
def button_workflow_left_joins(spark, d):
    n, e = lens.nodes(spark, d), lens.edges(spark, d)
    # Classes stand for buttons: what they extend is triggered, what they implement is interacted with, who extends them are functions.
    kind = F.when(F.col("type") == "EXTENDS", "TRIGGERS").when(F.col("type") == "IMPLEMENTS", "INTERACTS_WITH").otherwise(F.col("type"))
    mapped = e.where("type in ('EXTENDS', 'IMPLEMENTS')").withColumn("type", kind).unionByName(e.where("type = 'EXTENDS'").withColumn("type", F.lit("INTERACTS_WITH")).withColumn("attr", F.lit("function")))
    # As functions interact with buttons, those edges must not be read as what a button interacts with.
    buttons = e.where("type = 'CONTAINS' and src like 'class%'").select(F.col("src").alias("button")).distinct()
    return finders.workflows(n.withColumn("node_type", F.lit("JSFunction")), mapped.where("attr is null or attr <> 'function'"), buttons, mapped.where("attr = 'function'"))


@query("select p_partkey, p_size score, p_type tag from part where p_size >= 40")
def complexity_ge_desc(spark, d):
    p = lens.table(spark, d, "part")
    n = p.select("p_partkey", F.col("p_partkey").alias("id"), F.col("p_type").alias("tag"), F.lit("JSFunction").alias("node_type"), F.create_map(F.lit("complexity_score"), F.col("p_size").cast("string")).alias("props"))
    return finders.functions_by_complexity(n, 40).select("p_partkey", F.col("props")["complexity_score"].cast("int").alias("score"), "tag")


@query("select p_partkey from part where list_contains(string_split(p_name, ' '), 'red')")
def functions_by_tag(spark, d):
    n = lens.table(spark, d, "part").select("p_partkey", F.lit("JSFunction").alias("node_type"), F.create_map(F.lit("purpose_tags"), F.replace("p_name", F.lit(" "), F.lit(","))).alias("props"))
    return finders.functions_by_tag(n, "red").select("p_partkey")


_LINKS = "with b as (select c_custkey, 'bean.' || c_name as name, n_name class_name from customer join nation on (c_nationkey + c_custkey % 3) % 25 = n_nationkey), m as (select n_name, c_name, 'method_' || n_name || '_' || c_name id from customer join nation on c_nationkey = n_nationkey) "


def _links(spark, d):
    n = F.broadcast(lens.table(spark, d, "nation").select("n_nationkey", "n_name"))
    b = lens.table(spark, d, "customer").join(n, (F.col("c_nationkey") + F.col("c_custkey") % 3) % 25 == F.col("n_nationkey"))
    b = b.select("c_custkey", F.concat(F.lit("bean."), "c_name").alias("name"), F.col("n_name").alias("class_name"))
    return pages.linked(b, lens.nodes(spark, d).where("label = 'Method'"))


@query(_LINKS + "select c_custkey, id linked_id from b join m on b.name = 'bean.' || m.c_name and b.class_name = m.n_name")
def linked_methods(spark, d):
    return _links(spark, d).where("linked_id is not null").select("c_custkey", "linked_id")


@query(_LINKS + "select c_custkey from b where not exists (select 1 from m where b.name = 'bean.' || m.c_name and b.class_name = m.n_name)")
def unlinked_methods(spark, d):
    return _links(spark, d).where("linked_id is null").select("c_custkey")


@query(_LENS + "select id from nodes where label = 'Method' and not (package like 'A%' or name like 'Supplier%') ")
def prefix_exclusion(spark, d):
    n = lens.nodes(spark, d).where("label = 'Method'")
    return n.where(~s.excluded("package", "name", ["A"], []) & ~s.starts_with_any("name", ["Supplier"])).select("id")


@query("""select 'class_' || replace(x, '.', '_') id, case when contains(x, '.') then regexp_extract(x, '^(.*)\\.[^.]*$', 1) else '' end package, regexp_extract(x, '[^.]*$') as simple
 from (select distinct regexp_replace(lower(p_brand) || '.' || p_type || '.' || split_part(p_name, ' ', 1), '<.*', '') x from part)""")
def names_from_fqn(spark, d):
    x = lens.table(spark, d, "part").select(F.concat_ws(".", F.lower("p_brand"), "p_type", F.substring_index("p_name", " ", 1), ).alias("x")).distinct()
    x = x.withColumn("x", F.concat("x", F.lit("<T.U>")))
    return x.select(s.class_id("x").alias("id"), s.package_of("x").alias("package"), s.simple_name("x").alias("simple")).distinct()


# Traces ------------------------------------------------------------------------------------------------------------


def _entries(spark, d):
    return lens.table(spark, d, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(".signup")).alias("entry")).distinct()


_TRACE = _EVENTS + """, t as (select distinct 'u' || user_id || '.signup' entry, 0 depth, cast(null as varchar) caller, 'u' || user_id || '.signup' callee, ['u' || user_id || '.signup'] path from events
 union all select t.entry, t.depth + 1, s.caller, s.callee, case when list_contains(t.path, s.callee) then list_append(t.path, '#') else list_append(t.path, s.callee) end
 from t join step s on s.caller = t.callee where t.depth < 3 and not list_contains(t.path, '#')) """


@query(_TRACE + "select entry, depth, caller, callee, count(*) n from t where depth > 0 group by all")
def trace_depth_n(spark, d):
    t = trace.trace(lens.event_calls(spark, d), _entries(spark, d), trace.TraceConfig(depth=3))
    return t.groupBy("entry", "depth", "caller", "callee").agg(F.count("*").alias("n"))


@query(_TRACE + "select distinct entry, callee as method from t where entry in (select caller from step)")
def trace_involved_methods(spark, d):
    return trace.involved_methods(trace.trace(lens.event_calls(spark, d), _entries(spark, d), trace.TraceConfig(depth=3)))


@query(_EVENTS + """, r as (select callee as start, caller as node, 1 distance from step union select r.start, s.caller, r.distance + 1 from r join step s on s.callee = r.node where r.distance < 6)
 select start, node, cast(min(distance) as integer) distance from r where start <> node and start like '%.purchase' group by start, node""")
def upstream_impact(spark, d):
    e = lens.event_calls(spark, d).select(F.col("caller").alias("src"), F.col("callee").alias("dst"))
    starts = e.where("dst like '%.purchase'").select(F.col("dst").alias("start")).distinct()
    return trace.reach(e, starts, backwards=True)


@query("select event_id, event_type || cast(row_number() over (partition by user_id, event_type order by event_id) as varchar) as instance from events")
def instance_numbering(spark, d):
    e = lens.table(spark, d, "events").select(F.col("user_id").cast("string").alias("file"), F.col("event_type").alias("callee_variable"), F.col("event_id").alias("seq"))
    return convert.instance_ids(e).select(F.col("seq").alias("event_id"), F.col("callee_instance").alias("instance"))


# Text --------------------------------------------------------------------------------------------------------------

_KIND = "case when event_type = 'signup' then 'activate' when event_type = 'purchase' then 'deactivate' when event_type = 'click' then 'alt' when event_type = 'error' then 'end' else 'call' end"


def _items(spark, d):
    e = F.col("event_type")
    kind = F.when(e == "signup", "activate").when(e == "purchase", "deactivate").when(e == "click", "alt").when(e == "error", "end").otherwise("call")
    return lens.table(spark, d, "events").select(F.col("user_id").cast("string").alias("entry"), F.col("event_id").alias("ord"), kind.alias("kind"), F.concat(F.lit("n"), F.col("event_id").cast("string")).alias("dst"), F.lit("").alias("text"))


@query(f"""select entry, ord, cast(coalesce(sum(delta) over (partition by entry order by ord rows between unbounded preceding and 1 preceding), 0) as integer) as indent from
 (select cast(user_id as varchar) entry, event_id ord, case {_KIND} when 'activate' then 1 when 'alt' then 1 when 'deactivate' then -1 when 'end' then -1 else 0 end delta from events)""")
def indent_levels(spark, d):
    return render.indented(_items(spark, d)).select("entry", "ord", "indent")


@query(f"""with i as (select cast(user_id as varchar) entry, event_id ord, {_KIND} kind from events),
 w as (select *, lead(kind) over (partition by entry order by ord) nxt, lag(kind) over (partition by entry order by ord) prv,
  last_value(case when kind = 'call' then 'n' || ord end ignore nulls) over (partition by entry order by ord rows between unbounded preceding and current row) callee from i)
 select entry, ord, case when kind = 'alt' and nxt = 'end' then 'note' else kind end kind, case when kind = 'alt' and nxt = 'end' then callee else 'n' || ord end dst from w where not (kind = 'end' and coalesce(prv, '') = 'alt')""")
def peephole_pairs(spark, d):
    return render.peephole(_items(spark, d)).select("entry", "ord", "kind", "dst")


@query("""select p_partkey, case when regexp_matches(x, '^get[A-Z][A-Za-z0-9_$]*$') then lower(substr(x, 4, 1)) || substr(x, 5) else x end argument from
 (select p_partkey, regexp_replace(regexp_replace(case when p_partkey % 2 = 0 then 'a.' || p_type || '.getName()' else 'item.' || p_type end, '\\b[A-Za-z_$][A-Za-z0-9_$]*\\.', '', 'g'), '\\(\\)$', '') x from part)""")
def argument_simplify(spark, d):
    x = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("a."), "p_type", F.lit(".getName()"))).otherwise(F.concat(F.lit("item."), "p_type"))
    return lens.table(spark, d, "part").select("p_partkey", s.simplified_argument(x).alias("argument"))


_LINES = "with d as (select doc_id, regexp_replace(coalesce(text, ''), '\\n+$', '') t from documents), l as (select doc_id, unnest(string_split(t, chr(10))) as text, generate_subscripts(string_split(t, chr(10)), 1) line from d) "


def _doc_lines(spark, d):
    return weave.lines_of(lens.table(spark, d, "documents"), "text", "doc_id")


@query(_LINES + "select doc_id, count(*) lines, cast(sum(length(text)) as bigint) chars from l group by doc_id")
def source_lines(spark, d):
    return _doc_lines(spark, d).groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum(F.length("text")).alias("chars"))


@query(_LINES + ", m as (select *, max(case when contains(text, 'Licen') then 1 else 0 end) over (partition by doc_id order by line rows between unbounded preceding and current row) begun from l) select doc_id, count(*) lines from m where begun = 1 group by doc_id")
def weave_header_prefix(spark, d):
    # The text's `Licen` stands for the class line.
    lines = _doc_lines(spark, d).withColumn("text", F.when(F.col("text").contains("Licen"), F.concat(F.lit("class "), "text")).otherwise(F.concat(F.lit("x"), "text")))
    return weave.marked(lines, "doc_id").where("in_class").groupBy("doc_id").agg(F.count("*").alias("lines"))


@query(_LINES + ", r as (select doc_id, 2 + quality as a, 4 + quality b from labels) select l.doc_id, cast(line as integer) line, length(text) as length from l where exists (select 1 from r where r.doc_id = l.doc_id and line between a and b)")
def weave_kept_ranges(spark, d):
    r = lens.table(spark, d, "labels").select("doc_id", (F.col("quality") + 2).alias("start_line"), (F.col("quality") + 4).alias("end_line"))
    return weave.in_ranges(_doc_lines(spark, d), r, "doc_id").select("doc_id", "line", F.length("text").cast("bigint").alias("length"))


@query("""select distinct user_id, event_type as class_fqn, md5('## u' || user_id || '/' || event_type || chr(10) || chr(10) || '**Class**: `' || event_type || '`' || chr(10) || chr(10) || '```java' || chr(10) || 'class ' || event_type || chr(10) || '```' || chr(10) || chr(10)) digest, cast(1 as integer) as lines from events""")
def merge_markdown(spark, d):
    e = lens.table(spark, d, "events").select("user_id", "event_type").distinct()
    rows = e.select("user_id", F.col("event_type").alias("class_fqn"), F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("/"), "event_type").alias("relative_path"), F.concat(F.lit("class "), "event_type").alias("source"))
    return weave.sections(rows, "user_id").select("user_id", "class_fqn", F.md5(F.col("section").cast("binary")).alias("digest"), F.col("lines").cast("int").alias("lines"))


@query("""select doc_id, cast(place as bigint) place, cast(case when p = '' then 1 when regexp_replace(p, '\n+$', '') = '' then 0 else len(string_split(regexp_replace(p, '\n+$', ''), chr(10))) end as integer) line from
 (select doc_id, length(text) - length(text) // 3 as place, substr(text, 1, length(text) - length(text) // 3) p from documents where text is not null)""")
def line_number_of_offset(spark, d):
    at = F.expr("length(text) - length(text) div 3")
    return lens.table(spark, d, "documents").where("text is not null").select("doc_id", at.cast("bigint").alias("place"), s.line_of_offset(F.col("text"), at).alias("line"))


@query("select event_type, cast(json_extract_string(props, '$.k') as integer) k, count(*) n from events group by all")
def json_props_tree(spark, d):
    e = lens.table(spark, d, "events")
    return e.groupBy("event_type", F.from_json("props", "k int")["k"].alias("k")).agg(F.count("*").alias("n"))


# Pages -------------------------------------------------------------------------------------------------------------


@query("select page_id, len(regexp_extract_all(html, '(?is)<script[^>]*>(.*?)</script>')) blocks, md5(regexp_extract(html, '(?is)<script[^>]*>(.*?)</script>', 1)) digest from pages")
def script_blocks(spark, d):
    p = lens.table(spark, d, "pages")
    all_ = F.regexp_extract_all("html", F.lit(pages.SCRIPT), F.lit(1))
    return p.select("page_id", F.size(all_).cast("bigint").alias("blocks"), F.md5(F.coalesce(F.get(all_, F.lit(0)), F.lit("")).cast("binary")).alias("digest"))


@query("""with p as (select page_id, string_split(html, 'href="') s from pages), x as (select page_id, unnest(s[2:]) t, unnest(range(1, len(s))) i, s from p)
 select page_id, cast(i as integer) as ordinal, split_part(t, '"', 1) as path, cast(length(array_to_string(s[1:i], 'href="')) as integer) as at from x where contains(t, '"') and substr(t, 1, 1) <> '"'""")
def external_refs(spark, d):
    rows = pages.matches(lens.table(spark, d, "pages"), "html", r'href="([^"]+)"', 1, "page_id")
    return rows.select("page_id", F.col("ordinal").cast("int").alias("ordinal"), F.col("found").alias("path"), F.col("at").cast("int").alias("at"))


@query("""select page_id, length(split_part(html, '<script', 1)) as at, len(string_split(split_part(html, '<script', 1), chr(10))) as line from pages where contains(html, '<script')""")
def script_offsets(spark, d):
    rows = pages.matches(lens.table(spark, d, "pages"), "html", pages.SCRIPT, 1, "page_id").where("ordinal = 1")
    return rows.select("page_id", F.col("at").cast("bigint").alias("at"), F.size(F.split("before", "\n", -1)).cast("bigint").alias("line"))


@query("""select page_id, call, count(*) n from (select page_id, unnest(regexp_extract_all(html, '([a-zA-Z_]+)\\(', 1)) call from pages) group by all""")
def ajax_like_calls(spark, d):
    return pages.matches(lens.table(spark, d, "pages"), "html", r"([a-zA-Z_]+)\(", 1, "page_id").groupBy("page_id", F.col("found").alias("call")).agg(F.count("*").alias("n"))


_PAGES = """
with p as (select page_id, 'site/d' || (page_id % 5) || '/p' || page_id || '.jsp' file, html from pages where html is not null),
 sc as (select page_id, file, unnest(regexp_extract_all(html, '(?is)<script[^>]*>(.*?)</script>', 1)) b from p),
 fn as (select page_id, file, regexp_extract(x, '([a-zA-Z_]+)\\(', 1) as name from (select page_id, file, unnest(regexp_extract_all(b, '([a-zA-Z_]+)\\((\\d+)\\);')) x from sc)),
 ex as (select distinct file, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) path from p)
"""


@query(_PAGES + "select file, 'c' || page_id id, 'jc:download' type, 'bean.m' || (page_id % 7) as action, cast(1 as integer) line from p")
def tag_ids(spark, d):
    return pages.components(lens.made_pages(spark, d)).select("file", "id", "type", "action", "line")


@query("select page_id, regexp_matches(html, '(?i)check|validate') validates, contains(html, 'style.display') or contains(html, '.value') as manipulates from pages")
def js_tags(spark, d):
    tags = pages.purpose_tags("html")
    return lens.table(spark, d, "pages").select("page_id", F.array_contains(tags, "Data_Validation").alias("validates"), F.array_contains(tags, "UI_Manipulation").alias("manipulates"))


@query(_PAGES + """select 'page_' || file src, 'c' || page_id dst, 'CONTAINS' "type" from p union select 'c' || page_id, 'method_bean_m' || (page_id % 7), 'TRIGGERS' from p
 union select 'page_' || file, 'js_' || name, 'CONTAINS' from fn union select 'js_' || name, 'method_bean_' || name, 'TRIGGERS' from fn
 union select 'page_' || file, 'external_' || regexp_replace(path, '[^a-zA-Z0-9]', '_', 'g'), 'DEPENDS_ON' from ex""")
def page_graph_edges(spark, d):
    return pages.page_graph(lens.made_pages(spark, d))[1].select("src", "dst", "type")


@query(_PAGES + "select 'js_' || name id, min(file) source_file, true as ajax, true as navigates, cast(2 as integer) as complexity from fn group by name")
def page_functions(spark, d):
    n = pages.page_graph(lens.made_pages(spark, d))[0].where("node_type = 'JSFunction'")
    return n.select("id", "source_file", F.col("flags")["contains_ajax_call"].alias("ajax"), F.col("flags")["contains_navigation"].alias("navigates"), F.col("props")["complexity_score"].cast("int").alias("complexity"))


@query(_PAGES + """, n as (select file, 'Page' kind, 'page_' || file id from p union select file, 'JSFComponent', 'c' || page_id from p union select min(file), 'JSFunction', 'js_' || name from fn group by name
 union select min(file), 'BackendMethod', id from (select file, 'method_bean_m' || (page_id % 7) id from p union all select file, 'method_bean_' || name from fn) group by id
 union select min(file), 'ExternalJS', x from (select file, 'external_' || regexp_replace(path, '[^a-zA-Z0-9]', '_', 'g') x from ex) group by x)
 select regexp_extract(file, '^(.*)/[^/]*$', 1) folder, count(*) filter (kind = 'Page') files, count(*) filter (kind = 'JSFComponent') components, count(*) filter (kind = 'JSFunction') functions,
  count(*) filter (kind = 'BackendMethod') methods, count(*) filter (kind = 'ExternalJS') scripts from n group by 1""")
def page_folder_totals(spark, d):
    return finders.folder_totals(pages.page_graph(lens.made_pages(spark, d))[0])


@query(_PAGES + """, n as (select 'Page' kind, 'page_' || file id from p union select 'JSFComponent', 'c' || page_id from p union select 'JSFunction', 'js_' || name from fn
 union select 'BackendMethod', 'method_bean_m' || (page_id % 7) from p union select 'BackendMethod', 'method_bean_' || name from fn union select 'ExternalJS', 'external_' || regexp_replace(path, '[^a-zA-Z0-9]', '_', 'g') from ex),
 q as (select 'by_type' query, kind arg, id from n union all select 'by_tag_name', 'jc:download', id from n where kind = 'JSFComponent' union all select 'with_ajax', '', id from n where kind = 'JSFunction'
  union all select 'with_navigation', '', id from n where kind = 'JSFunction' union all select 'all', '', id from n union all select 'preset', 'navigation', id from n where kind = 'JSFunction'
  union all select 'by_complexity', '2', id from n where kind = 'JSFunction')
 select query, arg, count(*) n, md5(string_agg(id, ',' order by id)) digest from q group by query, arg""")
def page_finders(spark, d):
    n, e = pages.page_graph(lens.made_pages(spark, d))
    n, e = written(n, "nodes"), written(e, "edges")
    c = finders.CATALOG
    found = [("by_type", k, c["JspNode.by_type"](n, e, k)) for k in ("Page", "JSFComponent", "JSFunction", "BackendMethod", "ExternalJS")]
    found += [("by_tag_name", "jc:download", c["JSPComponent.by_tag_name"](n, e, "jc:download")), ("with_ajax", "", c["JspNode.with_ajax"](n, e)), ("with_navigation", "", c["JspNode.with_navigation"](n, e))]
    found += [("all", "", c["JspNode.all"](n, e)), ("preset", "navigation", finders.preset(n, "navigation")), ("by_complexity", "2", c["JspNode.by_complexity"](n, e, 2))]
    every = None
    for query_, arg, rows in found:
        one = rows.select(F.lit(query_).alias("query"), F.lit(arg).alias("arg"), "id")
        every = one if every is None else every.unionByName(one)
    return every.groupBy("query", "arg").agg(F.count("*").alias("n"), F.md5(F.array_join(F.array_sort(F.collect_list("id")), ",").cast("binary")).alias("digest"))


#: Queries of the catalog with their arguments, and the condition under which a node is found in SQL.
_C, _I, _M, _A = "class_ASIA_NATION_7", "interface_ASIA", "method_NATION_2_Customer#000000000", "annotation_Method_BUILDING"
_FOUND: list[tuple[str, tuple, str]] = [
    *((f"{x}.all", (), f"label = '{x}'") for x in ("Class", "Interface", "Method", "Annotation")),
    ("Class.by_name", ("NATION_7",), "label = 'Class' and name = 'NATION_7'"), ("Interface.by_name", ("ASIA",), "label = 'Interface' and name = 'ASIA'"),
    ("Class.by_package", ("ASIA",), "label = 'Class' and package = 'ASIA'"), ("Class.by_source_file", ("nation/NATION_7",), "label = 'Class' and source_file = 'nation/NATION_7'"),
    ("Method.by_source_file", ("nation/NATION_7",), "label = 'Method' and source_file = 'nation/NATION_7'"), ("Method.by_class", ("NATION_7",), "label = 'Method' and class_name = 'NATION_7'"),
    ("Method.by_name_and_class", ("Customer#000000000", "NATION_2"), "label = 'Method' and name = 'Customer#000000000' and class_name = 'NATION_2'"),
    ("Class.by_node_type", ("AbstractClass",), "label = 'Class' and node_type = 'AbstractClass'"), ("Class.all_abstract_by_type", (), "label = 'Class' and node_type = 'AbstractClass'"), ("Class.all_interfaces_by_type", (), "false"),
    ("Annotation.by_target", ("Method",), "label = 'Annotation' and target_type = 'Method'"), ("Annotation.by_name_and_target", ("BUILDING", "Method"), "label = 'Annotation' and name = 'BUILDING'"), ("Annotation.all_method", (), "label = 'Annotation'"),
    ("Annotation.all_class", (), "false"), ("Method.all_getters", (), "false"), ("Method.all_constructors", (), "false"), ("Interface.all_public", (), "label = 'Interface'"),
    *((name, (start,), f"id in (select {there} from edges where {here} = '{start}' and type = '{kind}') and label = '{label}'") for name, start, kind, label, here, there in (
        ("Class.contained_methods", _C, "CONTAINS", "Method", "src", "dst"), ("Class.super_classes", _C, "EXTENDS", "Class", "src", "dst"), ("Class.sub_classes", "class_ASIA_NATION_2", "EXTENDS", "Class", "dst", "src"),
        ("Class.implemented_interfaces", _C, "IMPLEMENTS", "Interface", "src", "dst"), ("Interface.implementing_classes", _I, "IMPLEMENTS", "Class", "dst", "src"), ("Interface.extending", _I, "EXTENDS", "Interface", "dst", "src"),
        ("Method.called", _M, "CALLS", "Method", "src", "dst"), ("Method.calling", "method_NATION_1_Supplier#000000001", "CALLS", "Method", "dst", "src"), ("Method.called_by_caller", _M, "CALLS", "Method", "src", "dst"),
        ("Method.annotations", _M, "HAS_ANNOTATION", "Annotation", "src", "dst"), ("Method.of_class", _C, "CONTAINS", "Method", "src", "dst"), ("Annotation.annotated_method", _A, "HAS_ANNOTATION", "Method", "dst", "src"),
        ("Annotation.by_method", _M, "HAS_ANNOTATION", "Annotation", "src", "dst"), ("Class.annotations", _C, "HAS_ANNOTATION", "Annotation", "src", "dst"),
    )),
]


@query(_LENS + "select query, count(id) n, md5(coalesce(string_agg(id, ',' order by id), '')) digest from (" + " union all ".join(f"select '{name} {' '.join(args)}' query, id from (select 1) left join nodes on {where}" for name, args, where in _FOUND) + ") group by query")
def catalog_finders(spark, d):
    """What the queries of the catalog find, as a count and a digest of the sorted ids."""
    n, e = written(lens.nodes(spark, d), "nodes"), written(lens.edges(spark, d), "edges")
    every = None
    for name, args, _ in _FOUND:
        one = finders.CATALOG[name](n, e, *args).select(F.lit(f"{name} {' '.join(args)}").alias("query"), "id")
        every = one if every is None else every.unionByName(one)
    queries_ = spark.createDataFrame([(f"{name} {' '.join(args)}",) for name, args, _ in _FOUND], "query string")
    found = every.groupBy("query").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("id")), ",").alias("ids"))
    return queries_.join(found, "query", "left").select("query", F.coalesce("n", F.lit(0)).alias("n"), F.md5(F.coalesce("ids", F.lit("")).cast("binary")).alias("digest"))


@query(_LENS + """select n.id, n.label, n.name, cast((select count(*) from edges where src = n.id) as integer) as out, cast((select count(*) from edges where dst = n.id) as integer) incoming from nodes n where n.label in ('Class', 'Interface', 'Annotation')""")
def node_details(spark, d):
    n, e = lens.nodes(spark, d), lens.edges(spark, d)
    out = finders.node_details(n, e, n.where("label <> 'Method'").select("id"))
    return out.select("id", "label", "name", F.size("out").alias("out"), F.size("incoming").alias("incoming"))


@query(_LENS + "select class_fqn, count(distinct name) n, md5(string_agg(name, ',' order by name)) digest from methods group by class_fqn")
def methods_by_class(spark, d):
    out = finders.methods_by_class(lens.methods(spark, d))
    return out.select("class_fqn", F.size("names").cast("bigint").alias("n"), F.md5(F.array_join("names", ",").cast("binary")).alias("digest"))


@query("select p_partkey, case when p_partkey % 2 = 0 then p_brand || '.X' else case when p_partkey % 3 = 0 then p_brand else p_type || '.' || p_brand end end fqn, p_brand || case when p_partkey % 2 = 0 then ':' || p_partkey else '' end || ':' || p_type as label from part")
def composed_names_and_labels(spark, d):
    k = F.col("p_partkey")
    name = F.when(k % 2 == 0, F.concat("p_brand", F.lit(".X"))).otherwise(F.col("p_brand"))
    package = F.when(k % 3 == 0, "").otherwise(F.col("p_type"))
    p = lens.table(spark, d, "part").withColumn("instance", F.when(k % 2 == 0, k.cast("string")))
    return p.select("p_partkey", java.composed_name(package, name).alias("fqn"), java.label("p_brand", "instance", "p_type").alias("label"))


@query(_LENS + "select id, name from nodes where label = 'Class' and package = 'ASIA'")
def variable_param_query(spark, d):
    return spark.sql("select id, name from {n} where label = :label and package = :package", args={"label": "Class", "package": "ASIA"}, n=lens.nodes(spark, d))


# Java sources, written from `part` ------------------------------------------------------------------------------------

_JAVA = """
with m as (select p_partkey k, p_partkey // 50 g, p_size n, row_number() over (partition by p_partkey // 50 order by p_partkey) - 1 i from part),
 f as (select g, count(*) n from m group by g),
 c as (select *, 'parts.b' || (g % 7) package, 'parts.b' || (g % 7) || '.C' || g fqn, 'src/C' || g || '.java' file from f),
 b as (select m.*, package, fqn, file, 10 + 14 * i as line from m join c using (g))
"""


def _parsed(spark, d) -> java.Parsed:
    return java.Parsed(lens.java_files(spark, d).unionByName(lens.java_helper(spark)))


@query(_JAVA + "select file, package, fqn class_fqn, 'Class' class_type, 'Base' || (g % 5) extends_fqn, 'Shape' implements, cast(6 as integer) start_line, cast(10 + 14 * n as integer) end_line, 'public' modifiers from c")
def java_types(spark, d):
    t = _parsed(spark, d).types.where("file <> 'src/Helper.java'")
    return t.select("file", "package", "class_fqn", "class_type", "extends_fqn", F.array_join("implements_fqns", ",").alias("implements"), "start_line", "end_line", F.array_join("modifiers", ",").alias("modifiers"))


@query(_JAVA + "select file, fqn class_fqn, 'm' || k as name, 'int, String' as signature, 'int' return_type, cast(line as integer) start_line, cast(line + 12 as integer) end_line, cast(i + 1 as integer) as ordinal from b")
def java_methods(spark, d):
    return _parsed(spark, d).methods.where("file <> 'src/Helper.java'").select("file", "class_fqn", "name", "signature", "return_type", "start_line", "end_line", "ordinal")


@query(_JAVA + """select fqn || '.m' || k method_full_name, callee, method_name, arguments, return_type, cast(line + o as integer) line, region, chained from b,
 lateral (values ('util.Helper', 'compute', 'a|"x;{' || n || '"', 'void', 2, 'content', false), (fqn, 'n' || k, 'b', 'void', 4, 'content', false), ('util.Helper', 'rest', '', 'void', 6, 'content', false),
  ('util.Helper', 'door', '', 'Door', 9, 'content', false), ('Door', 'shut', 'i', 'void', 9, 'content', true)) x(callee, method_name, arguments, return_type, o, region, chained)""")
def java_calls(spark, d):
    c = _parsed(spark, d).calls.where("file <> 'src/Helper.java'")
    return c.select("method_full_name", "callee", "method_name", F.array_join("arguments", "|").alias("arguments"), "return_type", "line", "region", F.col("receiver_call_id").isNotNull().alias("chained"))


@query(_JAVA + "select file, cast(line + 5 as integer) as line, fqn || '.m' || k full_name from b where k % 3 = 0")
def java_method_at_line(spark, d):
    p = _parsed(spark, d)
    places = p.methods.where("class_fqn like 'parts.%' and cast(substring(name, 2) as bigint) % 3 = 0").select("file", (F.col("start_line") + 5).alias("line"))
    return p.method_at(places)


@query(_JAVA + """select fqn || '.m' || k method_full_name, type, condition, cast(line + a as integer) start_line, cast(line + z as integer) end_line, cast(o as integer) as ordinal from b,
 lateral (values ('ALTERNATIVE', 'a > ' || n, 3, 5, 0), ('ALTERNATIVE', '', 5, 7, 1), ('LOOP', 'for loop', 8, 10, 0)) x(type, condition, a, z, o)""")
def java_fragments(spark, d):
    return _parsed(spark, d).fragments.select("method_full_name", "type", "condition", "start_line", "end_line", "ordinal")


@query(_JAVA + """select file, 'Method' target_type, fqn || '.m' || k target_fqn, 'Size' as name, 'value=' || n || ':number' params, cast(line as integer) line from b
 union all select file, 'Class', fqn, 'Service', 'name=c,' || g || ':string level=' || (g % 4) || ':number', 6 from c""")
def java_annotations(spark, d):
    u = _parsed(spark, d).annotation_uses
    params = F.array_join(F.transform("params", lambda p: F.concat(p["name"], F.lit("="), p["value"], F.lit(":"), p["kind"])), " ")
    return u.select("file", "target_type", "target_fqn", "name", params.alias("params"), F.col("start_line").alias("line"))


@query(_JAVA + """select 'class_' || replace(fqn, '.', '_') src, 'method_C' || g || '_m' || k dst, 'CONTAINS' "type" from b union all select 'method_C' || g || '_m' || k, 'annotation_Method_Size', 'HAS_ANNOTATION' from b
 union all select 'class_' || replace(fqn, '.', '_'), 'annotation_Class_Service', 'HAS_ANNOTATION' from c union all select 'method_C' || g || '_m' || k, 'method_Helper_' || x, 'CALLS' from b, (values ('compute'), ('rest'), ('door')) v(x)""")
def java_graph_edges(spark, d):
    p = _parsed(spark, d)
    n, e = convert.graph(p.types, p.methods, p.calls, p.annotation_uses, created_at=0)
    return store.valid_edges(e, n).where("src not like '%Helper%'").select("src", "dst", "type")


@query(_JAVA + """select fqn || '.m' || k entry, fqn class_fqn, 'ok' status, cast(20 + (select n from f where f.g = b.g) as integer) as lines from b where k % 10 = 0
 union all select fqn || '.m' || k, 'util.Helper', 'ok', 11 from b where k % 10 = 0""")
def java_extraction(spark, d):
    """What each tenth method needs: its class with that method alone, and the class of its helper."""
    p, files = _parsed(spark, d), lens.java_files(spark, d).unionByName(lens.java_helper(spark))
    entries = p.methods.where("class_fqn like 'parts.%' and cast(substring(name, 2) as bigint) % 10 = 0").select(F.col("full_name").alias("entry"))
    out = weave.woven_classes(p, files, entries, trace.TraceConfig(depth=2, base_packages=["parts", "util"]))
    return out.select("entry", "class_fqn", "status", F.size(F.split("source", "\n", -1)).alias("lines"))


@query(_JAVA + "select fqn || '.m' || k entry, cast(6 as bigint) calls, cast(1 as bigint) alts, cast(1 as bigint) elses, cast(1 as bigint) loops, cast(2 as bigint) ends, cast(1 as bigint) notes from b where k % 25 = 0")
def java_diagrams(spark, d):
    """Diagrams with the control flow around the calls, and annotations beside them."""
    p = _parsed(spark, d)
    entries = p.methods.where("class_fqn like 'parts.%' and cast(substring(name, 2) as bigint) % 25 = 0").select(F.col("full_name").alias("entry"))
    t = trace.trace(java.trace_calls(p), entries, trace.TraceConfig(depth=1))
    own = entries.select("entry", F.array(F.lit(-1), F.lit(-1)).alias("place"), F.col("entry").alias("callee"))
    out = render.diagrams(t, entries, trace.traced_fragments(t, p.fragments), render.annotation_notes(own, p.annotation_uses))
    n = lambda x: F.regexp_count("diagram", F.lit(x)).cast("bigint")
    return out.select("entry", n("->>").alias("calls"), n(r"(?m)^\s*alt ").alias("alts"), n(r"(?m)^\s*else").alias("elses"), n(r"(?m)^\s*loop ").alias("loops"), n(r"(?m)^\s*end$").alias("ends"), n(r"Note right of \w+: @Size").alias("notes"))


#: The class tree: what each class calls, and the nearest class upwards that declares it (a null if none does).
_TREE = """
with recursive c as (select s_suppkey k, greatest(s_suppkey // 2, 1) o, 'tree.p' || (s_suppkey % 4) || '.T' || s_suppkey fqn from supplier),
 a as (select k, k u, 0 d from c union all select k, u // 2, d + 1 from a where u > 1),
 near as (select k, j, arg_min(u, d) u from a, (values (0), (1), (2)) j(j) where u % 3 = j group by k, j),
 x as (select k, o, fqn, x.* from c, lateral (values
  (1, 'StringBuilder', null, 'StringBuilder', '', 10, 'content', '', false), (2, 'StringBuilder', null, 'append', 'n', 11, 'content', '', false), (3, 'unknown', null, 'append', '"k' || k || ', (x"', 11, 'content', '', true),
  (4, 'unknown', null, 'toString', '', 11, 'content', '', true), (5, null, 0, 'm0', 'n', 12, 'content', 'int', false), (6, 'o', 1, 'm1', '"a;b"', 12, 'content', 'String', false),
  (7, null, 2, 'm2', 'm2(1)|"c"', 14, 'content', 'int, String', false), (8, null, 2, 'm2', '1', 14, 'content', 'int', false), (9, null, null, 'ready', 'i', 15, 'condition', '', false),
  (10, 'o', 0, 'm0', 'other.m1(i) + other.m1("z")', 16, 'content', 'String;int', false), (11, 'o', 1, 'm1', 'i', 16, 'content', 'int', false), (12, 'o', 1, 'm1', '"z"', 16, 'content', 'String', false)
 ) x(seq, kind, j, method_name, arguments, line, region, targets, chained)),
 r as (select x.*, near.u, case when kind = 'o' then o else x.k end as recv from x left join near on near.k = case when kind = 'o' then o else x.k end and near.j = x.j),
 calls as (select *, case when u is not null then 'tree.p' || (u % 4) || '.T' || u when kind in ('StringBuilder', 'unknown') then kind else 'tree.p' || (recv % 4) || '.T' || recv end callee from r)
"""


def _tree(spark, d) -> java.Parsed:
    return java.Parsed(lens.java_tree(spark, d))


@query(_TREE + "select fqn caller, cast(seq as integer) seq, callee, method_name, arguments, cast(line as integer) line, region, case when u is null then '' else targets end targets, chained from calls")
def java_call_sites(spark, d):
    """Calls by position: chains, calls in arguments of calls, inherited members, overloads by their arguments."""
    c = _tree(spark, d).calls
    targets = F.array_join(F.array_sort(F.transform("targets", lambda t: t["signature"])), ";")
    return c.select("caller", "seq", "callee", "method_name", F.array_join("arguments", "|").alias("arguments"), "line", "region", targets.alias("targets"), F.col("receiver_call_id").isNotNull().alias("chained"))


@query(_TREE + """select fqn || '.run' method_full_name, type, condition, cast(a as integer) start_line, cast(z as integer) end_line, cast(n as integer) as ordinal, inner_of from c,
 lateral (values ('ALTERNATIVE', 'n > ' || k, 12, 12, 0, ''), ('ALTERNATIVE', 'n < 0', 12, 12, 1, ''), ('ALTERNATIVE', '', 13, 14, 2, ''), ('LOOP', 'for loop', 15, 16, 0, ''), ('LOOP', 'while (ready(i))', 15, 16, 0, 'for loop')) x(type, condition, a, z, n, inner_of)""")
def java_bare_statements(spark, d):
    """Control flow without braces: a ladder, and a loop in a loop."""
    f = _tree(spark, d).fragments
    up = f.select(F.col("fragment_id").alias("parent_fragment_id"), F.col("condition").alias("inner_of"))
    return f.join(up, "parent_fragment_id", "left").select("method_full_name", "type", "condition", "start_line", "end_line", "ordinal", F.coalesce("inner_of", F.lit("")).alias("inner_of"))


@query(_TREE + """select distinct 'method_T' || k || '_run' src, 'method_T' || u || '_' || method_name || '(' || t || ')' dst, 'CALLS' "type" from (select *, unnest(string_split(targets, ';')) t from calls where u is not null)""")
def java_overload_edges(spark, d):
    return convert.overload_edges(_tree(spark, d).calls).select("src", "dst", "type")


@query(_TREE + "select distinct 'method_T' || k || '_run' src, 'method_T' || u || '_' || method_name dst from calls where u is not null")
def java_inherited_calls(spark, d):
    """CALLS edges that end at the class that declares the method, however far up it stands."""
    p = _tree(spark, d)
    return stored(convert.calls_edges(p.calls, p.methods), "edges").select("src", "dst")


@query(_TREE + "select c.fqn class_fqn, 'tree.p' || (u % 4) || '.T' || u up, cast(d as integer) distance from a join c using (k) where d > 0")
def java_supertypes(spark, d):
    return _tree(spark, d).ancestors.select("class_fqn", "up", "distance")


@query(_TREE + """select 'class_tree_p' || (c.k % 4) || '_T' || c.k class, 'class_tree_p' || (u % 4) || '_T' || u up, cast(d as integer) distance, 'method_T' || c.k || '_m' || (c.k % 3) entry,
 case when u % 3 = 0 then 'method_T' || u || '_m0' end as optional_method from a join c using (k) where d > 0""")
def pattern_inheritance(spark, d):
    """(class)-[EXTENDS, any number]->(up), (class)-[CONTAINS]->(a method), and, if there is one, (up)-[CONTAINS]->(a method m0)."""
    p = _tree(spark, d)
    n, e = convert.graph(p.types, p.methods, p.calls, p.annotation_uses, created_at=0)
    chain = patterns.Pattern(
        [patterns.Vertex("class", "Class"), patterns.Vertex("up", "Class"), patterns.Vertex("entry", "Method"), patterns.Vertex("optional_method", "Method", F.col("name") == "m0")],
        [patterns.Step("class", "up", ("EXTENDS",), most=None, hops="distance"), patterns.Step("class", "entry", ("CONTAINS",)), patterns.Step("up", "optional_method", ("CONTAINS",), optional=True)],
    )
    return chain.match(stored(n, "nodes"), stored(e, "edges")).select("class", "up", "distance", "entry", "optional_method")


@query(_EVENTS + """, r as (select callee as start, caller as node, 1 distance from step union select r.start, s.caller, r.distance + 1 from r join step s on s.callee = r.node where r.distance < 3)
 select node as source, start as target, cast(min(distance) as integer) hops from r where start <> node and start like '%.purchase' group by start, node""")
def pattern_upstream_impact(spark, d):
    """(source)-[CALLS, up to three]->(target, a purchase): walked from the end that says more."""
    e = lens.event_calls(spark, d).select(F.col("caller").alias("src"), F.col("callee").alias("dst"), F.lit("CALLS").alias("type"))
    n = e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id"))).distinct().withColumn("label", F.lit("Method"))
    impact = patterns.Pattern([patterns.Vertex("target", "Method", F.col("id").like("%.purchase"))], [patterns.Step("source", "target", ("CALLS",), most=3, hops="hops")])
    return impact.match(written(n, "nodes"), written(e, "edges")).select("source", "target", "hops")


@query(_PAGES + """, f as (select distinct page_id, file, name from fn)
 select 'page_' || p.file page, 'c' || p.page_id as component, 'method_bean_m' || (p.page_id % 7) as method, 'js_' || f.name as "function", 'method_bean_' || f.name as called from p left join f using (page_id)""")
def pattern_button_workflow(spark, d):
    """(page)-[CONTAINS]->(component)-[TRIGGERS]->(method), and, if there are any, (page)-[CONTAINS]->(function)-[TRIGGERS]->(called)."""
    n, e = pages.page_graph(lens.made_pages(spark, d))
    kind = lambda name, k: patterns.Vertex(name, where=F.col("node_type") == k)
    flow = patterns.Pattern(
        [kind("page", "Page"), kind("component", "JSFComponent"), kind("method", "BackendMethod"), kind("function", "JSFunction"), kind("called", "BackendMethod")],
        [
            patterns.Step("page", "component", ("CONTAINS",)), patterns.Step("component", "method", ("TRIGGERS",)), patterns.Step("page", "function", ("CONTAINS",), optional=True),
            patterns.Step("function", "called", ("TRIGGERS",), optional=True),
        ],
    )
    return flow.match(written(n, "nodes"), written(e, "edges")).select("page", "component", "method", "function", "called")


@query(_LENS + """, gone as (select id from nodes where source_file = 'nation/NATION_7'), late as (select * from nodes where source_file = 'nation/NATION_3'),
 e2 as (select * from edges where src not in (select id from gone) and dst not in (select id from gone))
 select 1 as version, (select count(*) from nodes) - (select count(*) from late) nodes_created, (select count(*) from edges where src not in (select id from late) and dst not in (select id from late)) relationships_created, cast(0 as bigint) nodes_deleted, cast(0 as bigint) relationships_deleted
 union all select 2, (select count(*) from late), (select count(*) from edges) - (select count(*) from edges where src not in (select id from late) and dst not in (select id from late)), 0, 0
 union all select 3, 0, 0, (select count(*) from gone), (select count(*) from edges) - (select count(*) from e2)
 union all select -1, (select count(*) from nodes) - (select count(*) from gone), (select count(*) from e2), 0, 0""")
def incremental_store(spark, d):
    """Three batches (all files but one, that one with all edges, the deletion of a file): the counters of each, and in row -1 what the logs
    hold at the end."""
    import uuid

    n, e = stored(lens.nodes(spark, d), "nodes"), stored(lens.edges(spark, d), "edges")
    g = changelog.IncrementalStore(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}", buckets=32)
    late = F.col("source_file") == "nation/NATION_3"
    g.apply(n.where(~late), e)
    g.apply(n.where(late), e)
    g.delete_source("nation/NATION_7")
    totals = g.nodes().agg(F.count("*").alias("nodes_created")).withColumn("_k", F.lit(1)).join(g.edges().agg(F.count("*").alias("relationships_created")).withColumn("_k", F.lit(1)), "_k")
    zero = F.lit(0).cast("long")
    end = totals.select(F.lit(-1).cast("long").alias("version"), "nodes_created", "relationships_created", zero.alias("nodes_deleted"), zero.alias("relationships_deleted"))
    return g.history().unionByName(end).withColumn("version", F.col("version").cast("int"))


@query("""with o as (select 'C' || o_custkey class_fqn, 'src/' || (o_orderkey % 97) || '/' || o_orderkey || '.java' file, cast(o_orderkey % 13 as integer) load_ord from orders)
 select class_fqn, arg_max(file, lpad(cast(load_ord as varchar), 4, '0') || file) file from o group by class_fqn""")
def class_index_by_load(spark, d):
    """Of a class that several files declare the one that was loaded last counts, whatever its path."""
    o = lens.table(spark, d, "orders")
    k = F.col("o_orderkey")
    path = F.concat(F.lit("src/"), (k % 97).cast("string"), F.lit("/"), k.cast("string"), F.lit(".java"))
    return files.class_index(o.select(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("class_fqn"), path.alias("file"), (k % 13).cast("int").alias("load_ord")))


@query(_TREE + """select 'tree/T' || k || '.java' file, case when k % 5 = 0 then 'unbalanced' when k % 7 = 0 then 'empty' when k % 11 = 0 then 'unreadable' else 'ok' end status,
 case when k % 5 = 0 then case when k % 2 = 0 then '1 brackets stay open' else 'a bracket closes nothing at ' || (length('package tree.p' || (k % 4) || ';') + 1) end when k % 7 <> 0 and k % 11 = 0 then 'no content' end error from c""")
def file_statuses(spark, d):
    """A status for each file of a run, some of which are broken."""
    k = F.regexp_extract("path", r"T(\d+)\.java", 1).cast("long")
    broken = F.when(k % 2 == 0, F.concat("content", F.lit("class Open {"))).otherwise(F.regexp_replace("content", r"(?s)^([^;]*;).*$", "$1 }"))
    content = F.when(k % 5 == 0, broken).when(k % 7 == 0, " // nothing { here\n").when(k % 11 == 0, None).otherwise(F.col("content"))
    tree = lens.java_tree(spark, d).select("path", content.alias("content"))
    return runs.file_status(tree, written(runs.marks.marks(tree), "marks"))


def _text(*lines: str) -> str:
    """An SQL expression for lines of text; what stands between ~ is an expression."""
    parts = "\n".join(lines).split("~")
    quoted = lambda x: " || chr(10) || ".join("'" + y.replace("'", "''") + "'" for y in x.split("\n"))
    return " || ".join(quoted(x) if k % 2 == 0 else x for k, x in enumerate(parts))


_DIAGRAM = _text(
    "sequenceDiagram", "actor User", "User->>~s~: run()", "activate ~s~", "  ~s~->>StringBuilder: sb : StringBuilder()", "  ~s~->>StringBuilder: append(n)", "  activate StringBuilder", "    StringBuilder->>unknown: append(\"k~k~, (x\")",
    "    activate unknown", "      unknown->>unknown: toString()", "    deactivate unknown", "  deactivate StringBuilder", "  alt n > ~k~", "    ~s~->>~c5~: m0(n)", "  else n < 0", "    ~s~->>~c6~: m1(\"a_b\")", "  else",
    "    ~s~->>~c7~: m2(m2(1), \"c\")", "    ~s~->>~c8~: m2(1)", "  end", "  loop for loop", "    loop while (ready(i))", "      ~s~->>~c9~: ready(i)", "      ~s~->>~c10~: m0(m1(i) + m1(\"z\"))", "      ~s~->>~c11~: m1(i)",
    "      ~s~->>~c12~: m1(\"z\")", "    end", "  end", "deactivate ~s~",
)


@query(_TREE + ", d as (select fqn, k, replace(fqn, '.', '_') s, " + ", ".join(f"replace(max(case when seq = {i} then callee end), '.', '_') c{i}" for i in range(5, 13)) + f" from calls group by fqn, k) select fqn || '.run' entry, md5({_DIAGRAM}) digest from d")
def java_diagram_texts(spark, d):
    """Whole diagrams but for their participants: chains that nest, ladders, loops in loops, arguments as they stand in the source."""
    p = _tree(spark, d)
    entries = p.methods.where("name = 'run'").select(F.col("full_name").alias("entry"))
    t = trace.trace(java.trace_calls(p), entries, trace.TraceConfig(depth=1))
    out = render.diagrams(t, entries, trace.traced_fragments(t, p.fragments))
    return out.select("entry", F.md5(F.regexp_replace("diagram", r"(?m)^participant .*\n", "").cast("binary")).alias("digest"))


_WOVEN = _text(
    "package tree.p~(k % 4)~;", "import tree.p~(o % 4)~.T~o~;", "public class T~k~~case when k > 1 then ' extends T' || o else '' end~ {",
    "~case when used then '    public int m' || (k % 3) || '(int a) { return a; }' || chr(10) || '    public int m' || (k % 3) || '(String s) { return 1; }' || chr(10) || '    public int m' || (k % 3) || '(int a, String s) { return 2; }' || chr(10) else '' end~    public void run(int n, T~o~ other) {",
    "        StringBuilder sb = new StringBuilder();", "        sb.append(n).append(\"k~k~, (x\").toString();", "        if (n > ~k~) this.m0(n); else if (n < 0) other.m1(\"a;b\");", "        else", "            m2(m2(1), \"c\");",
    "        for (int i = 0; i < n; i++) while (ready(i))", "            other.m0(other.m1(i) + other.m1(\"z\"));", "    }", "}",
)


@query(_TREE + f", w as (select k, o, fqn, coalesce(bool_or(u = k), false) used from calls group by k, o, fqn) select fqn || '.run' entry, fqn class_fqn, md5({_WOVEN}) digest from w")
def java_woven_texts(spark, d):
    """The text of each entry's own class: its imports, its head, and the methods that the trace needs."""
    p = _tree(spark, d)
    entries = p.methods.where("name = 'run'").select(F.col("full_name").alias("entry"))
    out = weave.woven_classes(p, lens.java_tree(spark, d), entries, trace.TraceConfig(depth=1, base_packages=["tree"]))
    return out.where("entry = class_fqn || '.run'").select("entry", "class_fqn", F.md5(F.col("source").cast("binary")).alias("digest"))


# Text without an oracle: held against brute force in the tests -----------------------------------------------------------


@query()
def sequence_diagrams(spark, d):
    """A diagram for each user's first calls."""
    entries = _entries(spark, d)
    return render.diagrams(trace.trace(lens.event_calls(spark, d), entries, trace.TraceConfig(depth=2)), entries)


@query()
def script_functions(spark, d):
    """Named functions of the pages' scripts, after each call is made a function of its own."""
    p = lens.table(spark, d, "pages").select(F.col("page_id").cast("string").alias("file"), F.regexp_replace("html", r"([a-zA-Z_]+)\((\d+)\);", "function $1($2){ if ($2) { winopen(a, b, c); } ajaxActionCall(this, \"$1.run\"); }").alias("content"))
    return pages.functions(p)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls per class over the whole graph: who calls, how often, and how many methods each class contains."""
    return call_totals_per_class(spark, sf_dir).join(
        methods_per_class(spark, sf_dir).select(F.regexp_extract("class_id", r"(NATION_\d+)$", 1).alias("class_name"), F.col("methods")), "class_name"
    )


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict:
    return dict(_SQL)
