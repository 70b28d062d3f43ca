"""The graph library on small snippets, and every registered query against its oracle."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from codeloom.functions import scalars as s
from codeloom.model import as_edges, as_nodes
from codeloom.operators import convert, finders, java, pages, render, store, trace, weave
from codeloom.plans import registry
from codeloom.sources import files

DATA = "/root/testdata/sf0.001"

CART = '''package shop;

import shop.util.Prices;
import java.util.List;

/** A cart { with braces } */
@Service("cart")
public class Cart extends Base implements Countable, Named<String> {
    private final Prices prices;
    private List<Item> items;

    public Cart(Prices prices) {
        this.prices = prices;
    }

    @Audited(level = 3)
    public int total(int rate, List<Item> more) throws ShopException {
        int sum = 0; // not a call total(
        for (Item item : items) {
            if (item.isFree("if (x) {")) {
                log(item);
            } else if (check(item)) {
                sum = prices.of(item);
            } else {
                sum = new Discount(rate).apply(item);
            }
        }
        return Math.max(sum, this.floor());
    }

    private boolean check(Item item) { return item.name().trim().isEmpty(); }
    private void log(Item item) { }
    static class Inner {
        void audit() { check(null); }
    }
    public int getRate() { return 1; }
    public void setRate(int rate) { }
    private int floor() { while (more()) { step(); } return 0; }
}
'''
COUNTABLE = "package shop;\npublic interface Countable extends Sized {\n    int total(int rate);\n}\n"


@pytest.fixture(scope="module")
def source_dir(tmp_path_factory):
    d = tmp_path_factory.mktemp("src")
    (d / "shop").mkdir()
    (d / "shop/Cart.java").write_text(CART)
    (d / "shop/Countable.java").write_text(COUNTABLE)
    (d / "shop/empty.java").write_text("")
    (d / "shop/notes.txt").write_text("class NotJava {}")
    return str(d)


@pytest.fixture(scope="module")
def parsed(spark, source_dir):
    return java.Parsed(files.source_files(spark, source_dir))


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f("x").alias("y")).first().y


@pytest.mark.parametrize("f, x, y", [
    (s.class_id, "a.b.C<D.E>", "class_a_b_C"), (s.class_id, "", "class_unknown"), (s.class_id, "C", "class_C"), (s.interface_id, None, "interface_unknown"),
    (s.package_of, "a.b.C<D.E>", "a.b"), (s.simple_name, "a.b.C<D.E>", "C"), (s.class_of_method, "a.B.m(int)", "a.B"), (s.class_of_method, "a.B.m", ""),
    (s.signature_of_method, "a.B.m(x.Y)", "m(x.Y)"), (s.safe_id, "a.B<C>(d,e)", "a_BCd__e"), (s.pieces, "a\n\n", 1), (s.pieces, "", 1), (s.pieces, "\n\n", 0), (s.pieces, "a\nb", 2),
    (s.simplified_argument, "this.item.getName()", "name"), (s.simplified_argument, "a.b", "b"), (s.is_getter, "isX", True), (s.is_getter, "get", False), (s.is_setter, "setX", True),
    (s.property_of_accessor, "isOpen", "Open"), (s.safe_value, "a&b;c", "a_b_c"),
])
def test_scalars(spark, f, x, y):
    assert one(spark, x, f) == y


def test_java_types_and_methods(parsed):
    assert rows(parsed.types, "class_fqn", "class_type") == [("shop.Cart", "Class"), ("shop.Cart.Inner", "Class"), ("shop.Countable", "Interface")]
    cart = parsed.types.where("class_fqn = 'shop.Cart'").first()
    assert (cart.extends_fqn, cart.implements_fqns, cart.modifiers) == ("Base", ["shop.Countable", "Named"], ["public"])
    assert (cart.start_line, cart.end_line) == (7, 39)
    m = {(r.class_fqn, r.name): r for r in parsed.methods.collect()}
    assert len(m) == 9
    total = m["shop.Cart", "total"]
    assert (total.signature, total.return_type, total.thrown, total.start_line, total.end_line) == ("int, List", "int", ["ShopException"], 16, 29)
    assert m["shop.Countable", "total"].modifiers == ["abstract"] and m["shop.Cart.Inner", "audit"].return_type == "void"


def test_java_bodies(parsed):
    f = parsed.fragments.orderBy("start_line").collect()
    assert [(r.type, r.condition, r.ordinal, r.parent_fragment_id is None) for r in f] == [
        ("LOOP", "item : items", 0, True), ("ALTERNATIVE", 'item.isFree("if (x) {")', 0, False), ("ALTERNATIVE", "check(item)", 1, False), ("ALTERNATIVE", "", 2, False), ("LOOP", "while (more())", 0, True),
    ]
    c = {r.seq: r for r in parsed.calls.collect()}
    assert [(c[k].callee, c[k].method_name, c[k].line, c[k].region) for k in (1, 3, 4, 5)] == [
        ("Item", "isFree", 20, "condition"), ("shop.Cart", "check", 22, "condition"), ("shop.util.Prices", "of", 23, "content"), ("Discount", "Discount", 25, "content"),
    ]
    assert c[4].assigned_to == "sum" and c[4].arguments == ["item"] and c[6].receiver_call_id == c[5].call_id
    assert c[11].receiver_call_id == c[10].call_id and c[10].receiver_call_id == c[9].call_id
    assert rows(parsed.annotation_uses, "target_fqn", "name") == [("shop.Cart", "Service"), ("shop.Cart.total", "Audited")]


SITES = '''package a;
public class X extends Base implements Shape {
    private Store store;
    int put(int a) { return a; }
    int put(String a) { return 1; }
    int put(Object a, int b) { return 1; }
    public void run(int n, Object... rest) {
        StringBuilder sb = new StringBuilder();
        sb.append(n).append("x, y").toString();
        f(f(1, "a;b{"), m.get("a"));
        int z = store.get(1) + store.get(2);
        if (n > 1) store.put("k");
        else if (n < 0) { go(); } else this.inherited();
        for (int i = 0; i < n; i++) for (String s : names) if (s.isEmpty()) a1(); else b1(s);
        while (more("x")) step(x -> { if (x) deep(x); }, 3);
        put(1); put("s"); put(store, 2); put(null); put(mystery());
        super.base();
        store.area();
        if (n > 2) if (n > 3) c1(); else d1();
        do { e1(); } while (ok());
        try { t1(); } catch (E e) { t2(e); } finally { t3(); }
        for (;;) { break; }
        Map<String, List<Item>> all = new HashMap<String, List<Item>>(3, 4);
        items[0].use(); ((Store) other).get(7);
        if (n > 4) try { u1(); } finally { u2(); }
        after();
    }
    int f(int a, String b) { return a; }
    enum E { A(1), B(2) { void q() { } }; E(int k) { } void z() { put(1); } }
}
@interface An { String value() default "x"; int size(); }
'''
ABOVE = '''package a;
class Base extends Root { void base() { } void inherited() { } }
class Root { void deepest(int a) { inherited(); } }
class Store extends Root implements Shape { Store get(int k) { return this; } void put(String k) { get(1).deepest(2); } }
interface Shape extends Sized { double width(); }
interface Sized { int area(); }
'''


@pytest.fixture(scope="module")
def sites(spark):
    return java.Parsed(spark.createDataFrame([("X.java", SITES), ("B.java", ABOVE), ("none.java", None), ("empty.java", ""), ("broken.java", "class Q { void m( { } } ) ; } }")], "path string, content string"))


def test_call_sites(sites):
    calls = [r for r in sites.calls.where("file = 'X.java' and caller = 'a.X'").orderBy("seq").collect()]
    by_id = {r.call_id: r for r in sites.calls.collect()}
    got = [(r.callee, r.method_name, r.arguments) for r in calls]
    assert got[:9] == [
        ("StringBuilder", "StringBuilder", []), ("StringBuilder", "append", ["n"]), ("unknown", "append", ['"x, y"']), ("unknown", "toString", []), ("a.X", "f", ['f(1, "a;b{")', 'm.get("a")']), ("a.X", "f", ["1", '"a;b{"']),
        ("unknown", "get", ['"a"']), ("a.Store", "get", ["1"]), ("a.Store", "get", ["2"]),
    ]
    assert [by_id[r.receiver_call_id].method_name if r.receiver_call_id else None for r in calls[:5]] == [None, None, "append", "append", None]
    named = {(r.method_name, tuple(r.arguments)): r for r in calls}
    # Members of superclasses and superinterfaces, each at the class that declares it.
    assert [named[m, ()].callee for m in ("inherited", "base", "area")] == ["a.Base", "a.Base", "a.Sized"]
    assert {(r.callee, r.method_name) for r in by_id.values() if r.caller == "a.Store"} == {("a.Store", "get"), ("a.Root", "deepest")}
    targets = lambda *a: sorted(t.signature for t in named["put", a].targets)
    assert [targets("1"), targets('"s"'), targets("store", "2"), targets("null"), targets("mystery()")] == [["int"], ["String"], ["Object, int"], ["String"], ["String", "int"]]
    assert named["HashMap", ("3", "4")].callee == "HashMap" and named["use", ()].callee_variable == "items" and named["get", ("7",)].callee == "unknown"
    assert not any(r.method_name in ("A", "B", "put", "m") and r.caller == "a.X.E" and r.callee != "a.X" for r in by_id.values())
    assert [r.callee for r in by_id.values() if r.caller == "a.X.E"] == ["a.X"]  # an inner class calls what its outer one declares


def test_bare_statements(sites):
    f = {r.fragment_id: r for r in sites.fragments.where("file = 'X.java'").collect()}
    shown = lambda r: (r.type, r.condition, r.ordinal, f[r.parent_fragment_id].condition if r.parent_fragment_id else None)
    assert [shown(r) for r in sorted(f.values(), key=lambda r: int(r.fragment_id.split("#")[1]))] == [
        ("ALTERNATIVE", "n > 1", 0, None), ("ALTERNATIVE", "n < 0", 1, None), ("ALTERNATIVE", "", 2, None), ("LOOP", "for loop", 0, None), ("LOOP", "s : names", 0, "for loop"), ("ALTERNATIVE", "s.isEmpty()", 0, "s : names"),
        ("ALTERNATIVE", "", 1, "s : names"), ("LOOP", 'while (more("x"))', 0, None), ("ALTERNATIVE", "x", 0, 'while (more("x"))'), ("ALTERNATIVE", "n > 2", 0, None), ("ALTERNATIVE", "n > 3", 0, "n > 2"), ("ALTERNATIVE", "", 1, "n > 2"),
        ("LOOP", "for loop", 0, None), ("ALTERNATIVE", "n > 4", 0, None),
    ]
    inside = {r.method_name: (f[r.parent_fragment_id].condition if r.parent_fragment_id else None, r.region) for r in sites.calls.where("file = 'X.java'").collect()}
    assert [inside[m] for m in ("go", "a1", "b1", "deep", "c1", "d1", "isEmpty", "t2", "u1", "u2", "after")] == [
        ("n < 0", "content"), ("s.isEmpty()", "content"), ("", "content"), ("x", "content"), ("n > 3", "content"), ("", "content"), ("s.isEmpty()", "condition"), (None, "content"), ("n > 4", "content"), ("n > 4", "content"), (None, "content"),
    ]


def test_members(spark, sites):
    m = rows(sites.methods.where("file = 'X.java'"), "class_fqn", "name", "signature", "return_type")
    assert [x[:3] for x in m if x[0] != "a.X"] == [("a.An", "size", ""), ("a.An", "value", ""), ("a.X.E", "E", "int"), ("a.X.E", "z", "")]
    assert rows(sites.ancestors, "class_fqn", "up", "distance") == [
        ("a.Base", "a.Root", 1), ("a.Shape", "a.Sized", 1), ("a.Store", "a.Root", 1), ("a.Store", "a.Shape", 1), ("a.Store", "a.Sized", 2), ("a.X", "a.Base", 1), ("a.X", "a.Root", 2), ("a.X", "a.Shape", 1), ("a.X", "a.Sized", 2),
    ]
    edges = {(r.src, r.dst) for r in convert.overload_edges(sites.calls).collect()}
    assert {("method_X_run", "method_X_put(int)"), ("method_X_run", "method_X_put(Object, int)"), ("method_X_run", "method_Base_inherited()")} <= edges


def test_graph_of_sources(spark, parsed, tmp_path):
    nodes, edges = convert.graph(parsed.types, parsed.methods, parsed.calls, parsed.annotation_uses, created_at=1)
    ids = {r.id for r in nodes.collect()}
    assert {"class_shop_Cart", "interface_shop_Countable", "method_Cart_total", "annotation_Class_Service"} <= ids
    assert "method_Cart_getRate" not in ids and "method_Cart_setRate" not in ids and "method_Cart_Cart" not in ids
    g = store.GraphStore(spark, str(tmp_path / "g"))
    first = g.upsert(nodes, edges)
    assert first.nodes_created == len(ids) and first.relationships_created > 0 and first.nodes_deleted == 0
    again = g.upsert(nodes, edges)
    assert again.total == 0 and g.version == 2
    got = {(r.src, r.dst, r.type) for r in g.edges().collect()}
    assert ("class_shop_Cart", "interface_shop_Countable", "IMPLEMENTS") in got and ("method_Cart_total", "method_Cart_check", "CALLS") in got
    assert not any(d == "class_Base" for _, d, _ in got)  # its end isn't there
    assert rows(finders.CATALOG["Method.called"](g.nodes(), g.edges(), "method_Cart_total"), "name") == [("check",), ("floor",), ("log",)]
    assert rows(g.sql("select id from {nodes} where label = :l", l="Interface"), "id") == [("interface_shop_Countable",)]
    with pytest.raises(ValueError):
        g.sql(" ")
    gone = g.delete_label("Annotation")
    assert gone.nodes_deleted == 2 and gone.relationships_deleted == 2
    assert g.clear().nodes_deleted > 0 and g.nodes().count() == 0
    assert finders.answer(nodes, edges, "Class.by_name", "Cart")["count"] == 1 and not finders.answer(nodes, edges, "no such")["success"]


def test_every_finder_runs(spark, parsed):
    nodes, edges = convert.graph(parsed.types, parsed.methods, parsed.calls, parsed.annotation_uses, created_at=1)
    nodes, edges = nodes.cache(), edges.cache()
    ids = spark.createDataFrame([("class_shop_Cart",)], "id string")
    for name, f in finders.CATALOG.items():
        for args in ((), ("class_shop_Cart",), ("a", "b")):
            try:
                f(nodes, edges, *([ids] if name.endswith("existing_ids") else args)).schema  # noqa: B018
                break
            except (TypeError, ValueError):
                continue
        else:
            raise AssertionError(name)


def test_finders_against_brute_force(spark):
    """The catalog's queries on a small graph of both layers, each against a comprehension over its rows."""
    flags = lambda *x: dict.fromkeys(x, True)
    raw = [
        # id, label, name, package, class_name, node_type, target_type, source_file, flags, props
        ("c1", "Class", "A", "p", "", "Class", "", "A.java", flags("is_public", "is_final"), {}), ("c2", "Class", "B", "p", "", "AbstractClass", "", "B.java", flags("is_abstract", "is_public"), {}), ("c3", "Class", "A", "q", "", "Interface", "", "A2.java", {}, {}),
        ("i1", "Interface", "I", "p", "", "", "", "I.java", flags("is_public"), {}), ("i2", "Interface", "J", "q", "", "", "", "I.java", {}, {}),
        ("m1", "Method", "run", "p", "A", "", "", "A.java", flags("is_static", "is_public"), {}), ("m2", "Method", "getX", "p", "A", "", "", "A.java", flags("is_getter"), {}), ("m3", "Method", "setX", "p", "B", "", "", "B.java", flags("is_setter", "is_abstract"), {}), ("m4", "Method", "B", "p", "B", "", "", "B.java", flags("is_constructor"), {}),
        ("a1", "Annotation", "X", "", "", "", "Class", "A.java", {}, {}), ("a2", "Annotation", "X", "", "", "", "Method", "A.java", {}, {}), ("a3", "Annotation", "Y", "", "", "", "Interface", "I.java", {}, {}),
        ("page", "JSPFile", "x.jsp", "", "", "Page", "", "x.jsp", {}, {"pagecode_class": "pc.X"}), ("page2", "JSPFile", "y.jsp", "", "", "Page", "", "y.jsp", {}, {"pagecode_class": ""}),
        ("b1", "JSPComponent", "b1", "", "", "JSFComponent", "", "x.jsp", {}, {"component_type": "jc:download", "tag_name": "jc:download"}), ("b2", "JSPComponent", "b2", "", "", "JSFComponent", "", "y.jsp", {}, {"component_type": "scriptCollector", "tag_name": "scriptCollector"}),
        ("f1", "JspNode", "f", "", "", "JSFunction", "", "x.jsp", {"contains_ajax_call": True, "contains_navigation": False}, {"complexity_score": "7", "purpose_tags": "Navigation,Form_Submission"}), ("f2", "JspNode", "g", "", "", "JSFunction", "", "y.jsp", {"contains_ajax_call": False, "contains_navigation": True}, {"complexity_score": "2", "purpose_tags": ""}),
        ("bm", "JSPBackendMethod", "bean.save", "", "pc.X", "BackendMethod", "", "x.jsp", {}, {}), ("d1", "JspNode", "txt", "", "", "DOMElement", "", "x.jsp", {}, {}), ("e1", "JspNode", "a.js", "", "", "ExternalJS", "", "x.jsp", {}, {}),
    ]
    columns = "id string, label string, name string, package string, class_name string, node_type string, target_type string, source_file string, flags map<string,boolean>, props map<string,string>"
    triples = [
        ("c1", "m1", "CONTAINS"), ("c1", "m2", "CONTAINS"), ("c2", "m3", "CONTAINS"), ("i1", "m3", "CONTAINS"), ("c1", "c2", "EXTENDS"), ("i1", "i2", "EXTENDS"), ("c1", "i1", "IMPLEMENTS"), ("c2", "i1", "IMPLEMENTS"), ("m1", "m2", "CALLS"), ("m1", "m3", "CALLS"), ("m3", "m2", "CALLS"),
        ("c1", "a1", "HAS_ANNOTATION"), ("m1", "a2", "HAS_ANNOTATION"), ("m2", "a2", "HAS_ANNOTATION"), ("i1", "a3", "HAS_ANNOTATION"), ("page", "b1", "CONTAINS"), ("page", "f1", "CONTAINS"), ("b1", "bm", "TRIGGERS"), ("f1", "bm", "TRIGGERS"), ("f1", "d1", "INTERACTS_WITH"), ("b1", "d1", "INTERACTS_WITH"), ("f2", "b1", "INTERACTS_WITH"),
    ]
    nodes = as_nodes(spark.createDataFrame(raw, columns).coalesce(1), 0).cache()
    edges = as_edges(spark.createDataFrame(triples, "src string, dst string, type string").coalesce(1)).cache()
    n = {r[0]: dict(zip(("id", "label", "name", "package", "class_name", "node_type", "target_type", "source_file", "flags", "props"), r)) for r in raw}
    where = lambda **k: {i for i, r in n.items() if all(r[c] == v for c, v in k.items())}
    flag = lambda label, x: {i for i, r in n.items() if r["label"] == label and r["flags"].get(x)}
    out = lambda start, kind, label=None: {d for s_, d, t in triples if s_ == start and t == kind and (not label or n[d]["label"] == label)}
    into = lambda start, kind, label=None: {s_ for s_, d, t in triples if d == start and t == kind and (not label or n[s_]["label"] == label)}
    layer = {i for i, r in n.items() if r["node_type"] in finders.PAGE_TYPES}
    want = {
        ("Class.by_name_and_package", "A", "q"): where(label="Class", name="A", package="q"), ("Interface.by_name_and_package", "I", "p"): {"i1"}, ("Interface.by_package", "q"): {"i2"}, ("Interface.by_source_file", "I.java"): {"i1", "i2"},
        ("Annotation.by_source_file", "A.java"): {"a1", "a2"}, ("Annotation.by_name", "X"): {"a1", "a2"}, ("Method.by_name", "run"): {"m1"}, ("Class.all_final",): {"c1"}, ("Class.all_abstract",): {"c2"}, ("Class.all_public",): {"c1", "c2"}, ("Interface.all_public",): {"i1"},
        ("Class.all_interfaces_by_type",): {"c3"}, ("Class.all_abstract_by_type",): {"c2"}, ("Interface.extended", "i1"): {"i2"}, ("Interface.extending", "i2"): {"i1"}, ("Interface.contained_methods", "i1"): {"m3"}, ("Interface.annotations", "i1"): {"a3"},
        ("Method.all_getters",): flag("Method", "is_getter"), ("Method.all_setters",): flag("Method", "is_setter"), ("Method.all_constructors",): {"m4"}, ("Method.all_abstract",): {"m3"}, ("Method.all_static",): {"m1"},
        ("Method.calling_by_callee", "m2"): into("m2", "CALLS"), ("Method.calling", "m2"): {"m1", "m3"}, ("Method.called_by_caller", "m1"): {"m2", "m3"}, ("Method.of_class_id", "c1"): out("c1", "CONTAINS"), ("Annotation.all_interface",): {"a3"}, ("Annotation.all_class",): {"a1"},
        ("Annotation.annotated_class", "a1"): {"c1"}, ("Annotation.annotated_interface", "a3"): {"i1"}, ("Annotation.annotated_method", "a2"): {"m1", "m2"}, ("Annotation.by_class", "c1"): {"a1"}, ("Annotation.by_interface", "i1"): {"a3"}, ("Annotation.by_method", "m2"): {"a2"},
        ("JspNode.by_file", "x.jsp"): {i for i in layer if n[i]["source_file"] == "x.jsp"}, ("JspNode.by_id", "f1"): {"f1"}, ("JspNode.by_id", "c1"): set(), ("JspNode.by_file_and_type", "y.jsp", "JSFunction"): {"f2"}, ("JspNode.all",): layer, ("JspNode.interacting", "f1"): {"d1"},
        ("JSPFile.by_file", "x.jsp"): {"page"}, ("JSPFile.by_id", "page2"): {"page2"}, ("JSPFile.all",): {"page", "page2"}, ("JSPBackendMethod.all",): {"bm"}, ("JSPComponent.all",): {"b1", "b2"}, ("JSPComponent.interacting", "b1"): {"d1"},
        **{(f"JspNode.all_{k}",): where(node_type=k) for k in finders.PAGE_TYPES}, ("JspNode.page_of_file", "y.jsp"): {"page2"}, ("JspNode.by_tag", "Form_Submission"): {"f1"}, ("JspNode.by_complexity", 3): {"f1"}, ("JspNode.triggering", "bm"): {"b1", "f1"}, ("JSPComponent.triggering", "bm"): {"b1"},
        ("JspNode.page_containing", "b1"): {"page"}, ("JSPFile.containing", "f1"): {"page"}, ("JSPFile.by_pagecode", "pc.X"): {"page"}, ("JSPBackendMethod.by_class", "pc.X"): {"bm"}, ("JSPBackendMethod.by_method", "bean.save"): {"bm"}, ("JSPBackendMethod.by_class_and_method", "pc.X", "bean.save"): {"bm"},
        ("JSPComponent.by_component_type", "scriptCollector"): {"b2"}, ("JSPComponent.by_file_and_type", "x.jsp", "jc:download"): {"b1"}, ("JSPComponent.by_file_and_type", "y.jsp", "jc:download"): set(),
    }
    every = None
    for k, (key, _) in enumerate(want.items()):
        one = finders.CATALOG[key[0]](nodes, edges, *key[1:]).select(F.lit(k).alias("k"), "id")
        every = one if every is None else every.unionByName(one)
    got = {key: set() for key in want}
    for r in every.coalesce(2).collect():
        got[[*want][r.k]].add(r.id)
    assert {k: v for k, v in got.items() if v != want[k]} == {}
    value = lambda name, *args: finders.CATALOG[name](nodes, edges, *args).first()[0]
    assert [value("Class.count"), value("Interface.count_by_package", "p"), value("Method.count_by_class", "c1"), value("Annotation.count_by_target", "Method"), value("Annotation.count_usages", "X"), value("JspNode.count"), value("JSPComponent.count"), value("JspNode.count_relationships")] == [3, 1, 2, 1, 3, len(layer), 2, len(triples)]
    assert value("JspNode.exists") and rows(finders.CATALOG["Class.existing_ids"](nodes, edges, spark.createDataFrame([("c1",), ("i1",), ("no",)], "id string")), "id") == [("c1",)]
    assert rows(finders.CATALOG["JspNode.workflow"](nodes, edges, "b1"), "button", "method", "element", "function") == [("b1", "bm", "d1", "f2")]
    assert rows(finders.CATALOG["Class.count_by_node_type"](nodes, edges), "node_type", "count") == [("AbstractClass", 1), ("Class", 1), ("Interface", 1)]
    assert rows(finders.CATALOG["JspNode.relationships"](nodes, edges, "f1"), "dst", "type") == [("bm", "TRIGGERS"), ("d1", "INTERACTS_WITH")]
    report = rows(finders.page_report(nodes, edges), "section", "name", "value")
    assert ("ajax", "f", 1) in report and ("complexity", "f", 7) in report and ("nodes", "Page", 2) in report and ("relationships", "TRIGGERS", 2) in report and not any(x[:2] == ("complexity", "g") for x in report)


def test_trace_against_walk(spark):
    calls = [("p.A.a", "p.B.b", 1), ("p.A.a", "p.C.c", 2), ("p.B.b", "p.C.c", 1), ("p.B.b", "p.A.a", 2), ("p.C.c", "p.C.c", 1), ("p.C.c", "q.D.d", 2), ("q.D.d", "p.A.a", 1), ("p.A.a", "x.Log.log", 3)]
    df = spark.createDataFrame(calls, "caller string, callee string, ordinal int")
    config = trace.TraceConfig(depth=4, base_packages=["p."], excluded_prefixes=["x."])

    def walk(at, depth, stack):
        out = []
        for a, b, _ in sorted((c for c in calls if c[0] == at), key=lambda c: c[2]):
            if b.startswith("x."):
                continue
            out.append((depth, a, b))
            if depth < 4 and b not in stack and b.startswith("p."):
                out += walk(b, depth + 1, [*stack, b])
        return out

    entries = spark.createDataFrame([("p.A.a",)], "entry string")
    t = trace.trace(df, entries, config)
    assert [(r.depth, r.caller, r.callee) for r in t.orderBy("place").collect()] == walk("p.A.a", 1, ["p.A.a"])
    assert rows(trace.involved_methods(t), "method") == [("p.A.a",), ("p.B.b",), ("p.C.c",), ("q.D.d",)]
    text = render.diagrams(t, entries).first().diagram
    assert text.startswith("sequenceDiagram\nactor User\n") and text.count("activate") == 2 * text.count("deactivate")
    r = trace.reach(df.selectExpr("caller src", "callee dst"), spark.createDataFrame([("q.D.d",)], "start string"), backwards=True)
    assert rows(r, "node", "distance") == [("p.A.a", 2), ("p.B.b", 2), ("p.C.c", 1)]


CHAIN = '''package p;
public class A {
    private B b;
    public void run() {
        b.first().second(1).third();
        if (b.ready()) b.first().last();
    }
}
'''
LINKS = '''package p;
class B { C first() { deep(); return null; } boolean ready() { return true; } void deep() { } }
class C { D second(int k) { return null; } void last() { } }
class D { void third() { inner(); } void inner() { } }
'''


@pytest.mark.parametrize("hide", [False, True])
def test_chains_in_diagrams(spark, hide):
    """Each link is called by the one before it, inside its activation; what links call in turn can be hidden."""
    p = java.Parsed(spark.createDataFrame([("A.java", CHAIN), ("B.java", LINKS)], "path string, content string"))
    entries, config = spark.createDataFrame([("p.A.run",)], "entry string"), trace.TraceConfig(depth=3, base_packages=["p"], hide_chain_details=hide)
    t = trace.trace(java.trace_calls(p), entries, config)
    body = render.diagrams(t, entries, trace.traced_fragments(t, p.fragments), config=config).first().diagram.split("\n")
    deep = lambda k: [] if hide else ["  " * k + "p_B->>p_B: deep()"]
    assert [x for x in body if not x.startswith("participant")] == [
        "sequenceDiagram", "actor User", "User->>p_A: run()", "activate p_A", "  p_A->>p_B: first()", "  activate p_B", *deep(2), "    p_B->>p_C: second(1)", "    activate p_C", "      p_C->>p_D: third()",
        *([] if hide else ["      activate p_D", "        p_D->>p_D: inner()", "      deactivate p_D"]), "    deactivate p_C", "  deactivate p_B", "  alt b.ready()", "    p_A->>p_B: ready()", "    p_A->>p_B: first()", "    activate p_B", *deep(3),
        "      p_B->>p_C: last()", "    deactivate p_B", "  end", "deactivate p_A",
    ]


def test_patterns(spark):
    from codeloom.operators.patterns import Pattern, Step, Vertex

    nodes = spark.createDataFrame([(x, x[0]) for x in ("a1", "a2", "b1", "b2", "c1", "c2")] + [(None, "a")], "id string, label string")
    edges = [("a1", "b1", "X"), ("a1", "b1", "Y"), ("a1", "b2", "X"), ("a2", "b2", "Z"), ("b1", "c1", "X"), ("b2", "c1", "X"), ("c1", "c2", "X"), ("c2", "c1", "X"), ("a1", None, "X")]
    e = spark.createDataFrame(edges, "src string, dst string, type string")
    got = lambda vertices, steps, *c: rows(Pattern(vertices, steps).match(nodes, e), *c)
    two = [Vertex("p", "a"), Vertex("q", "b"), Vertex("r", "c")]
    assert got(two, [Step("p", "q", ("X", "Y")), Step("q", "r", ("X",))], "p", "q", "r") == [("a1", "b1", "c1"), ("a1", "b2", "c1")]
    assert got([Vertex("p", "a")], [Step("p", "r", ("X",), most=None, hops="n")], "p", "r", "n") == [("a1", "b1", 1), ("a1", "b2", 1), ("a1", "c1", 2), ("a1", "c2", 3)]
    assert got([Vertex("r", where=F.col("id") == "c2")], [Step("p", "r", ("X",), most=2)], "p", "r") == [("b1", "c2"), ("b2", "c2"), ("c1", "c2")]
    assert got([Vertex("p", "a"), Vertex("s", where=F.col("id") == "b1")], [Step("p", "q", ("X", "Z")), Step("p", "s", ("Y",), optional=True)], "p", "q", "s") == [("a1", "b1", "b1"), ("a1", "b2", "b1"), ("a2", "b2", None)][:3]
    # A cycle filters, and a pattern in two pieces is an error.
    assert got([], [Step("x", "y", ("X",)), Step("y", "x", ("X",))], "x", "y") == [("c1", "c2"), ("c2", "c1")]
    for wrong in ([Step("x", "y", ("X",)), Step("z", "w", ("X",))], [Step("x", "y", ("X",), optional=True)]):
        with pytest.raises(ValueError):
            Pattern([], wrong).match(nodes, e)


def test_peephole(spark):
    items = [("e", 1, "call", "x", ""), ("e", 2, "opt", None, "c"), ("e", 3, "end", None, ""), ("e", 4, "alt", None, "cond"), ("e", 5, "end", None, ""), ("e", 6, "alt", None, "y"), ("e", 7, "call", "z", ""), ("e", 8, "end", None, "")]
    df = spark.createDataFrame(items, "entry string, ord int, kind string, dst string, text string")
    got = render.indented(render.peephole(df)).orderBy("ord").collect()
    assert [(r.ord, r.kind, r.dst, r.indent) for r in got] == [(1, "call", "x", 0), (4, "note", "x", 0), (6, "alt", None, 0), (7, "call", "z", 1), (8, "end", None, 1)]


def test_weave(spark, parsed):
    src = spark.createDataFrame([("f", CART)], "path string, content string")
    lines = weave.lines_of(src)
    whole = weave.joined(weave.whole_class(lines, imports=False, comments=False)).first().source
    assert whole.startswith("public class Cart") and "import" not in whole
    m = parsed.methods.where("class_fqn = 'shop.Cart'").withColumn("path", F.lit("f"))
    used = spark.createDataFrame([("f", "check")], "path string, name string")
    text = weave.joined(weave.used_methods(lines, m, used, fields=False), closing="}").first().source
    assert "private boolean check" in text and "getRate" not in text and "package shop;" in text and text.endswith("}")
    one_ = weave.merged(spark.createDataFrame([("b.B", "b/B.java", "y"), ("a.A", "a/A.java", "x")], "class_fqn string, relative_path string, source string"), "e", "now").first()
    assert one_.total_classes == 2 and one_.markdown.index("a.A") < one_.markdown.index("b.B")


PAGE = '''<%-- jsf:pagecode language="java" location="/src/pagecode/Login.java" --%>
<hx:scriptCollector id="sc" decode="#{pc_Login.onLoad}">
<jc:commandLinkEx styleClass="x"
  id="form1:btnSave" action="#{pc_Login.doSave}">
<jc:script src="/js/a-b.js"/>
<script>
function save(a) {
  if (a) { ajaxActionCall(this, "pc_Login.doAjax"); }
  document.getElementById('txtName').value = 1;
}
function open2() { winopen('a', 'b', 'c'); }
function broken( { x
</script>'''


def test_pages(spark):
    df = spark.createDataFrame([("login.jsp", PAGE), ("none.jsp", "<p>"), ("null.jsp", None)], "file string, content string")
    assert rows(pages.components(df), "id", "type", "action", "line") == [("form1:btnSave", "jc:commandLinkEx", "pc_Login.doSave", 2), ("sc", "scriptCollector", "pc_Login.onLoad", 1)]  # a break right before an offset does not count
    f = {r.name: r for r in pages.functions(df).collect()}
    assert set(f) == {"save", "open2", "broken"}
    assert f["save"].has_ajax and f["save"].ajax_calls == ["pc_Login.doAjax"] and f["save"].content.endswith("= 1;\n}")
    assert f["open2"].has_navigation and not f["open2"].has_ajax and f["broken"].content.startswith("function broken( { x")
    nodes, edges = pages.page_graph(df)
    n = {r.id: r for r in nodes.collect()}
    assert n["page_login.jsp"].props["pagecode_class"] == "pagecode.Login" and n["external__js_a_b_js"].node_type == "ExternalJS"
    assert n["method_pc_Login_doAjax"].class_name == "pagecode.Login" and n["dom_txtName"].props["element_type"] == "Input"
    e = {(r.src, r.dst, r.type) for r in edges.collect()}
    assert {("js_save", "method_pc_Login_doAjax", "TRIGGERS"), ("js_save", "dom_txtName", "INTERACTS_WITH"), ("page_login.jsp", "external__js_a_b_js", "DEPENDS_ON")} <= e
    methods = spark.createDataFrame([("method_Login_doAjax", "Login", "doAjax")], "id string, class_name string, name string")
    links = pages.linked(nodes.where("node_type = 'BackendMethod'").select("id", "class_name", "name"), methods)
    assert rows(links.where("linked_id is not null"), "id", "linked_id") == [("method_pc_Login_doAjax", "method_Login_doAjax")]
    assert pages.unlinked(links, "method_pc_Login_doAjax").where("linked_id is not null").count() == 0


def test_files(spark, source_dir, tmp_path):
    f = files.source_files(spark, source_dir)
    assert sorted(r.relative_path.split("/", 1)[1] for r in f.collect()) == ["shop/Cart.java", "shop/Countable.java"]  # Spark leaves out files of no bytes
    with pytest.raises(files.MissingRoot):
        files.source_files(spark, "/no/such/folder")
    (tmp_path / "a.json").write_text('{"name": "x", "n": 1}')
    (tmp_path / "b.json").write_text('{"name": ')
    d = files.json_documents(spark, str(tmp_path), "name string, n int")
    assert rows(files.scan_statistics(d), "total", "success", "error") == [(2, 1, 1)]
    assert files.packed(f).where("markdown like '%class Cart%' and markdown not like '%not a call%'").count() == 1
    (tmp_path / "pom.xml").write_text("<project/>")
    os.makedirs(tmp_path / "src/main/java")
    assert files.project_kind(str(tmp_path)) == "maven" and files.source_roots(str(tmp_path)) == [str(tmp_path / "src/main/java")]
    assert convert.excluded_annotations(" A, ,B") == ["A", "B", "Override", "Deprecated", "SuppressWarnings"]


def test_incremental_store(spark, tmp_path):
    """Batches of upserts, deletes and repeated rows against dictionaries; a bucket with many batches is compacted."""
    import random

    from codeloom.operators.changelog import IncrementalStore

    g = IncrementalStore(spark, str(tmp_path / "g"), buckets=4, files=1)
    rng, nodes, edges = random.Random(4), {}, set()
    for k in range(4):
        new = {f"n{rng.randrange(12)}": (f"f{rng.randrange(3)}", k) for _ in range(4)}
        made = [(i, f, k) for i, (f, _) in new.items()]
        wanted = {(f"n{rng.randrange(14)}", f"n{rng.randrange(14)}", "T") for _ in range(6)}
        gone = {f"n{rng.randrange(12)}" for _ in range(2)} if k else set()
        n = as_nodes(spark.createDataFrame(made, "id string, source_file string, line_number int"), k)
        e = as_edges(spark.createDataFrame([*wanted, ("n1", None, "T")], "src string, dst string, type string"))
        got = g.apply(n, e, spark.createDataFrame([(x,) for x in gone], "id string"))
        left = {x for x in gone if x in nodes and x not in new}
        off = {x for x in edges if left & {x[0], x[1]}}
        created = set(new) - set(nodes)
        nodes = {**{i: x for i, x in nodes.items() if i not in left}, **new}
        fresh = {x for x in wanted if x[0] in nodes and x[1] in nodes} - edges
        edges = (edges - off) | fresh
        assert (got.nodes_created, got.relationships_created, got.nodes_deleted, got.relationships_deleted) == (len(created), len(fresh), len(left), len(off))
        assert {r.id: (r.source_file, r.line_number) for r in g.nodes().collect()} == nodes
        assert {(r.src, r.dst, r.type) for r in g.edges().collect()} == edges
    assert os.path.isdir(tmp_path / "g/base/nodes") and g.version == 4 == g.history().count()
    assert max(len(after) for _, after in g._nodes.live().values()) <= 2
    start = next(iter(edges))[0]
    assert rows(g.hop(spark.createDataFrame([(start,)], "id string"), "T"), "id") == sorted((d,) for s_, d, _ in edges if s_ == start)
    assert rows(g.hop(spark.createDataFrame([(start,)], "id string"), backwards=True), "id") == sorted((s_,) for s_, d, _ in edges if d == start)
    file = next(iter(nodes.values()))[0]
    g.delete_source(file)
    assert {r.id for r in g.nodes().collect()} == {i for i, (f, _) in nodes.items() if f != file}


def test_incremental_batch_reads_its_buckets(spark, tmp_path):
    """A batch of one key writes one file of nodes, whatever the store holds."""
    from codeloom.operators.changelog import IncrementalStore

    g = IncrementalStore(spark, str(tmp_path / "g"), buckets=16)
    many = as_nodes(spark.range(300).select(F.concat(F.lit("n"), "id").alias("id"), F.lit("f").alias("source_file")), 1)
    g.apply(many)
    g.apply(as_nodes(spark.createDataFrame([("n7", "g")], "id string, name string"), 2))
    assert len(glob.glob(str(tmp_path / "g/log/nodes/v=1/bucket=*"))) == 16 and len(glob.glob(str(tmp_path / "g/log/nodes/v=2/bucket=*"))) == 1
    assert g.find("n7").first().name == "g" and g.nodes().count() == 300
    # A batch that failed before it was counted isn't seen, and its repetition replaces it.
    g._nodes.append(as_nodes(spark.createDataFrame([("n8", "half")], "id string, name string"), 3), spark.createDataFrame([], "id string"), 3)
    assert g.find("n8").first().name == ""


def test_stream(spark, source_dir, tmp_path):
    from codeloom.operators.changelog import IncrementalStore
    from codeloom.streaming.watch import watch

    for k, g in enumerate((store.GraphStore(spark, str(tmp_path / "g0")), IncrementalStore(spark, str(tmp_path / "g1"), buckets=4))):
        for _ in range(2):
            watch(spark, source_dir + "/shop", g, str(tmp_path / f"c{k}"), availableNow=True).awaitTermination()
        assert g.version == 1 and g.nodes().where("label = 'Class'").count() == 2


@pytest.mark.parametrize("incremental", [False, True])
def test_stream_replaces_and_resolves(spark, tmp_path, incremental):
    """A file that comes again replaces what it held; calls meet classes that came before, or come after."""
    from codeloom.operators.changelog import IncrementalStore
    from codeloom.streaming.watch import upsert_changes, upsert_sources

    g = IncrementalStore(spark, str(tmp_path / "g"), buckets=4) if incremental else store.GraphStore(spark, str(tmp_path / "g"))
    load = lambda *files: (upsert_changes if incremental else upsert_sources)(g, spark.createDataFrame(files, "path string, content string"), created_at=1)
    a = "package p;\n@Table(name = \"users, all\")\npublic class A {\n    private B b;\n    public void work1() {\n        b.work2();\n    }\n    public void more() {\n    }\n}\n"
    b = "package p;\npublic class B {\n    public void work2() {\n        new A().more();\n    }\n}\n"
    load(("A.java", a))
    calls = lambda: {(r.src, r.dst) for r in g.edges().where("type = 'CALLS'").collect()}
    assert calls() == set() and g.nodes().where("label = 'Annotation'").count() == 1
    load(("B.java", b))  # the class arrives after its caller, and calls a class of an earlier batch
    assert calls() == {("method_A_work1", "method_B_work2"), ("method_B_work2", "method_A_more")}
    load(("A.java", a.replace("@Table(name = \"users, all\")\n", "").replace("    public void more() {\n    }\n", "")))
    ids = {r.id for r in g.nodes().collect()}
    assert "method_A_more" not in ids and not any(i.startswith("annotation") for i in ids)
    assert calls() == {("method_A_work1", "method_B_work2")}
    assert ("class_p_A", "method_A_more") not in {(r.src, r.dst) for r in g.edges().collect()}
    load(("A.java", a))
    assert calls() == {("method_A_work1", "method_B_work2"), ("method_B_work2", "method_A_more")}


def test_annotation_arguments(spark):
    text = """package p;
/** Not @This one. */
@Table(name = "users, (all)", indexes = {@Index(columnList = "a, b"), @Index("c")})
@Marker
public class A {
    @Query("select ')' from x") // no @Comment
    @Limit(max = 5, strict = true, type = String.class)
    public void find() { call("@No"); }
}
"""
    uses = {r["name"]: r for r in java.Parsed(spark.createDataFrame([("A.java", text)], "path string, content string")).annotation_uses.collect()}
    got = {k: [(p["name"], p["value"], p["kind"]) for p in r.params] for k, r in uses.items()}
    assert got["Table"][0] == ("name", "users, (all)", "string") and got["Marker"] == [] and "This" not in got and "Comment" not in got and "No" not in got
    assert got["Query"] == [("value", "select ')' from x", "string")] and got["Limit"] == [("max", "5", "number"), ("strict", "true", "boolean"), ("type", "String", "type")]
    assert (uses["Table"].start_line, uses["Marker"].start_line, uses["Query"].start_line, uses["Limit"].start_line) == (3, 4, 6, 7)


def test_answers_of_models(spark):
    text = 'Sure: {"summary": "s", "purpose_tags": ["Navigation"], "interacts_with_ids": ["x"], "ui_manipulation": "u", "data_flow": "d", "business_logic": "b", "complexity_score": 4, "maintainability_notes": "m", "potential_backend_calls": ["c"]} done'
    r = spark.createDataFrame([(text,), ("none",), (None,)], "t string").select(pages.parsed_analysis(F.col("t")).alias("x")).collect()
    assert r[0].x.asDict() == {"summary": "s", "purpose_tags": ["Navigation"], "interacts_with_ids": ["x"], "ui_manipulation": "u", "data_flow": "d", "business_logic": "b", "complexity_score": 4, "maintainability_notes": "m", "potential_backend_calls": ["c"]}
    assert r[1].x is None or r[1].x.summary is None


def test_extraction(spark, source_dir):
    from codeloom.operators.trace import TraceConfig

    f = files.source_files(spark, source_dir)
    p = java.Parsed(f)
    out = weave.extract_code(p, f, "shop.Cart.total", TraceConfig(depth=2, base_packages=["shop"]), "now").first()
    assert "shop.Cart" in out.involved_classes and out.total_classes == len(out.involved_classes) and "total" in out.merged_source and out.error is None
    none = weave.extract_code(p, f, "other.X.y", TraceConfig(depth=2, base_packages=["shop"])).first()
    assert (none.involved_classes, none.merged_source, none.total_classes, none.total_lines) == ([], "", 0, 0) and "other.X.y" in none.error


def test_documents_and_pages_on_disk(spark, source_dir, tmp_path):
    p = java.Parsed(files.source_files(spark, source_dir))
    files.save_documents(p, str(tmp_path / "docs"))
    for name in ("types", "methods", "calls", "fragments"):
        assert files.load_documents(spark, str(tmp_path / "docs"), name).count() == getattr(p, name).count()
    (tmp_path / "pages").mkdir()
    (tmp_path / "pages/a.jsp").write_text("<p>é</p>")
    (tmp_path / "pages/b.jsp").write_bytes(b"\xff\xfe<p>")
    got = {r.file.rsplit("/", 1)[1]: (r.content, r.error) for r in files.read_pages(spark, str(tmp_path / "pages")).collect()}
    assert got["a.jsp"] == ("<p>é</p>", None) and got["b.jsp"][0] is None and got["b.jsp"][1]


def test_run_statistics(spark, tmp_path):
    from codeloom.operators import runs

    files_ = [("A.java", "package p; class A { void a() { b(); } void b() { } }"), ("B.java", "class B { void c( }"), ("C.java", "/* { */ "), ("D.java", None), ("E.java", "class E { } }")]
    got = runs.graph_run(spark.createDataFrame(files_, "path string, content string"), str(tmp_path / "run"), created_at=1)
    status = {r.file: (r.status, r.error) for r in spark.read.parquet(str(tmp_path / "run/status")).collect()}
    assert status["A.java"] == ("ok", None) and status["C.java"][0] == "empty" and status["D.java"] == ("unreadable", "no content") and status["E.java"] == ("unbalanced", "a bracket closes nothing at 12") and status["B.java"][0] == "unbalanced"
    nodes, edges = (spark.read.parquet(str(tmp_path / f"run/{x}")).count() for x in ("nodes", "edges"))
    assert (got.total, got.success, got.error, got.nodes, got.edges) == (5, 2, 3, nodes, edges) and edges >= 3
    none = runs.graph_run(spark.createDataFrame([], "path string, content string"), str(tmp_path / "none"))
    assert (none.total, none.success, none.error, none.nodes, none.edges) == (0, 0, 0, 0, 0)


def test_load_order(spark, tmp_path):
    """The later load wins, though its path is smaller."""
    one = lambda path: java.Parsed(spark.createDataFrame([(path, "package p; class A { }")], "path string, content string"))
    assert files.save_documents(one("z/A.java"), str(tmp_path)) == 1 and files.save_documents(one("b/A.java"), str(tmp_path), append=True) == 2
    types = files.load_documents(spark, str(tmp_path), "types")
    assert rows(files.class_index(types), "class_fqn", "file") == [("p.A", "b/A.java")]
    assert rows(files.class_index(types.drop("load_ord")), "class_fqn", "file") == [("p.A", "z/A.java")]


def test_long_ways(spark):
    n = 130
    e = spark.createDataFrame([(f"n{k:03d}", f"n{k + 1:03d}") for k in range(n)], "src string, dst string")
    got = trace.reach(e, spark.createDataFrame([("n000",)], "start string"))
    assert got.count() == n and got.agg(F.max("distance")).first()[0] == n


def test_nulls_in_nodes(spark):
    n = as_nodes(spark.createDataFrame([("a", None)], "id string, name string"), 0).first()
    assert n.name == "" and n.line_number == 0 and n.flags == {} and n.created_at == 0
    e = as_edges(spark.createDataFrame([("a", "b", "T")], "src string, dst string, type string")).first()
    assert e.attr is None


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, name):
    import duckdb

    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    want, got = c.sql(registry.oracle_sql()[name]).df(), registry.queries()[name](spark, DATA).toPandas()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    plain = lambda df: sorted(map(str, df[columns].astype(object).where(df[columns].notna(), None).values.tolist()))
    assert plain(got) == plain(want)


def _broadcasts(spark, run) -> list[int]:
    """The rows of each table that is broadcast while run() works."""
    store = spark._jsparkSession.sharedState().statusStore()
    ids = lambda: {x.executionId() for x in (lambda e: [e.apply(i) for i in range(e.size())])(store.executionsList())}
    before, out = ids(), []
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    for k in ids() - before:
        nodes, values = store.planGraph(k).allNodes(), store.executionMetrics(k)
        for n in (nodes.apply(i) for i in range(nodes.size())):
            for m in (n.metrics().apply(i) for i in range(n.metrics().size())) if n.name() == "BroadcastExchange" else ():
                if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    out.append(int(values.apply(m.accumulatorId()).replace(",", "")))
    return out


def _star(spark, path, parts: int, suppliers: int) -> str:
    """The tables that the made sources are written from, as one small file each."""
    spark.range(parts).selectExpr("id p_partkey", "'ring' p_name", "'Brand#1' p_brand", "'LARGE' p_type", "cast(id % 50 as int) p_size", "1D p_retailprice").coalesce(1).write.parquet(f"{path}/part.parquet")
    spark.range(suppliers).selectExpr("id s_suppkey", "concat('S', id) s_name", "cast(id % 25 as int) s_nationkey", "0D s_acctbal").coalesce(1).write.parquet(f"{path}/supplier.parquet")
    return str(path)


@pytest.fixture
def tight(spark):
    """A limit for broadcasts that the made tables pass only by how small they are on disk, and the rows that it is enough for."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "32k")
    yield (32 << 10) // 32
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_extraction_broadcasts_nothing_by_its_size_on_disk(spark, tmp_path, tight):
    from codeloom.plans import registry

    d = _star(spark, tmp_path, 1500, 1)
    got = []
    assert max(_broadcasts(spark, lambda: got.extend(registry.java_extraction(spark, d).collect())), default=0) <= tight
    assert len(got) == 300 and {(r.class_fqn == "util.Helper", r.lines) for r in got} == {(True, 11), (False, 70)}


@pytest.mark.parametrize("name", ["pattern_inheritance", "java_diagram_texts", "java_woven_texts", "java_inherited_calls", "java_overload_edges", "java_call_sites"])
def test_tree_broadcasts_nothing_by_its_size_on_disk(spark, tmp_path, tight, name):
    import duckdb

    from codeloom.plans import registry

    d = _star(spark, tmp_path, 1, 300)
    got = []
    assert max(_broadcasts(spark, lambda: got.extend(registry.queries()[name](spark, d).collect())), default=0) <= tight
    c = duckdb.connect()
    c.sql(f"create view supplier as select * from '{d}/supplier.parquet/*.parquet'")
    want = c.sql(registry.oracle_sql()[name])
    columns = [want.columns.index(x) for x in got[0].asDict()]
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(tuple(r[k] for k in columns)) for r in want.fetchall())


def test_trace_chains_only_the_callers_that_it_meets(spark, monkeypatch):
    real, made = trace.stored, []
    monkeypatch.setattr(trace, "stored", lambda df, name: made.append((name, df.count())) or real(df, name))
    calls = [("a.A.m", "b.B.x", 1, "c1", None), ("a.A.m", "b.B.y", 2, "c2", "c1"), ("b.B.y", "b.B.x", 1, "c3", None), ("z.Z.q", "b.B.x", 1, "c4", None)]
    calls = spark.createDataFrame(calls, "caller string, callee string, ordinal int, call_id string, receiver_call_id string")
    entries = spark.createDataFrame([("a.A.m",)], "entry string")
    t = trace.trace(calls, entries, trace.TraceConfig(depth=3)).collect()
    assert sorted((r.depth, r.callee, r.place, r.via) for r in t) == [(1, "b.B.x", [1], None), (1, "b.B.y", [1, trace.LINK, 2], "b.B.x"), (2, "b.B.x", [1, trace.LINK, 2, 1], None)]
    assert [n for name, n in made if name == "calls"][:2] == [2, 1]


def test_bucket_of_one_batch_is_read_without_a_shuffle(spark, tmp_path):
    from codeloom.operators.changelog import IncrementalStore

    g = IncrementalStore(spark, str(tmp_path / "one"), buckets=2)
    node = lambda *ids: spark.createDataFrame([(x, f"{x}.java") for x in ids], "id string, source_file string")
    g.apply(node(*"abcdef"))
    plan = g.nodes()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and sorted(r.id for r in g.nodes().collect()) == list("abcdef")
    g.apply(gone=node("b").select("id"))
    assert sorted(r.id for r in g.nodes().collect()) == list("acdef")
