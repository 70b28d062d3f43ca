"""The data model over the star-schema, event and page tables, so that every operator runs on tables of any size.

region: interfaces; nation: classes that implement them; customer and supplier: methods of their nation; orders with their
lines: calls from customers to suppliers; market segments: annotations; events: calls from one event type to the next of a
user; pages: the page layer; documents: source text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.operators import convert


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def types(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, n = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    named = n.join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"])  # 5 regions, 25 nations, whatever the scale
    first = named.groupBy("r_name").agg(F.min_by("n_name", "n_nationkey").alias("first_name"))
    named = named.join(F.broadcast(first), "r_name")
    fqn = lambda c: F.concat("r_name", F.lit("."), c)
    none = F.array().cast("array<string>")
    classes = named.select(
        F.concat(F.lit("nation/"), "n_name").alias("file"), F.col("r_name").alias("package"), fqn("n_name").alias("class_fqn"),
        F.when(F.col("n_nationkey") % 5 == 0, "AbstractClass").otherwise("Class").alias("class_type"),
        F.when(F.col("n_name") != F.col("first_name"), fqn("first_name")).alias("extends_fqn"), F.array("r_name").alias("implements_fqns"),
        F.col("n_nationkey").alias("start_line"), F.col("n_nationkey").alias("end_line"),
        F.when(F.col("n_nationkey") % 5 == 0, F.array(F.lit("public"), F.lit("abstract"))).when(F.col("n_nationkey") % 3 == 0, F.array(F.lit("final"))).otherwise(F.array(F.lit("public"))).alias("modifiers"),
    )
    interfaces = r.select(
        F.concat(F.lit("region/"), "r_name").alias("file"), F.lit("").alias("package"), F.col("r_name").alias("class_fqn"), F.lit("Interface").alias("class_type"),
        F.lit(None).cast("string").alias("extends_fqn"), none.alias("implements_fqns"), F.col("r_regionkey").alias("start_line"), F.col("r_regionkey").alias("end_line"), F.array(F.lit("public")).alias("modifiers"),
    )
    return classes.unionByName(interfaces)


def methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    own = F.broadcast(n.join(r, n["n_regionkey"] == r["r_regionkey"]).select("n_nationkey", "n_name", F.concat("r_name", F.lit("."), "n_name").alias("class_fqn")))
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    part = lambda df, nation, name, returns, key: df.join(own, df[nation] == own["n_nationkey"]).select(
        F.concat(F.lit("nation/"), "n_name").alias("file"), "class_fqn", F.col(name).alias("name"), F.lit("").alias("signature"), returns.alias("return_type"),
        F.concat("class_fqn", F.lit("."), F.col(name)).alias("full_name"), F.col(key).cast("int").alias("start_line"), (F.col(key) + 4).cast("int").alias("end_line"),
        F.array().cast("array<string>").alias("thrown"), F.array(F.lit("public")).alias("modifiers"), F.col(key).cast("int").alias("ordinal"),
    )
    return part(c, "c_nationkey", "c_name", F.col("c_mktsegment"), "c_custkey").unionByName(part(s, "s_nationkey", "s_name", F.lit("void"), "s_suppkey"))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (method_full_name, callee, method_name): the pairs are made distinct by key before names are joined."""
    o, l = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")  # noqa: E741
    pairs = o.join(l, o["o_orderkey"] == l["l_orderkey"]).select("o_custkey", "l_suppkey").distinct()
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    own = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select("n_nationkey", F.concat("r_name", F.lit("."), "n_name").alias("class_fqn"))
    c = table(spark, sf_dir, "customer").join(F.broadcast(own), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.concat("class_fqn", F.lit("."), "c_name").alias("method_full_name"))
    s = table(spark, sf_dir, "supplier").join(F.broadcast(own), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("class_fqn").alias("callee"), F.col("s_name").alias("method_name"))
    return pairs.join(c, pairs["o_custkey"] == c["c_custkey"]).join(s, pairs["l_suppkey"] == s["s_suppkey"]).select("method_full_name", "callee", "method_name")


def annotation_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = methods(spark, sf_dir).where("name like 'Customer%'")
    return m.select(
        "file", F.lit("Method").alias("target_type"), F.col("full_name").alias("target_fqn"), F.col("return_type").alias("name"), F.col("return_type").alias("simple_name"),
        F.array(F.struct(F.lit("value").alias("name"), F.col("return_type").alias("value"), F.lit("string").alias("kind"))).alias("params"), "start_line", "end_line",
    )


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, m, u = types(spark, sf_dir), methods(spark, sf_dir), annotation_uses(spark, sf_dir)
    return convert.class_nodes(t, 0).unionByName(convert.interface_nodes(t, 0)).unionByName(convert.method_nodes(m, 0)).unionByName(convert.annotation_nodes(u, created_at=0))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, m = types(spark, sf_dir), methods(spark, sf_dir)
    return convert.contains_edges(t, m).unionByName(convert.calls_edges(calls(spark, sf_dir), m)).unionByName(convert.annotation_edges(annotation_uses(spark, sf_dir))).unionByName(convert.inheritance_edges(t))


def event_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(caller, callee, ordinal): user and type of an event to the next one of the user; a cyclic graph that grows with the users."""
    e = table(spark, sf_dir, "events")
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    name = lambda c: F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("."), c)
    step = e.select("user_id", name(F.col("event_type")).alias("caller"), name(F.lead("event_type").over(w)).alias("callee")).where("callee is not null and caller <> callee").distinct()
    return step.select("caller", "callee", F.row_number().over(W.partitionBy("caller").orderBy("callee")).alias("ordinal"))


def made_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, content): the pages with a component in front, an outside script at each link, and each call made a function of its own."""
    p = table(spark, sf_dir, "pages").where("html is not null")
    text = F.regexp_replace(F.regexp_replace("html", r"([a-zA-Z_]+)\((\d+)\);", "function $1($2){ if ($2) { winopen(a, b, c); } ajaxActionCall(this, \"bean.$1\"); }"), r'href="([^"]+)"', "href=\"$1\"><jc:script src=\"$1\"")
    k = F.col("page_id").cast("string")
    head = F.concat(F.lit('<jc:download id="c'), k, F.lit('" action="#{bean.m'), (F.col("page_id") % 7).cast("string"), F.lit('}">\n'))
    return p.select(F.concat(F.lit("site/d"), (F.col("page_id") % 5).cast("string"), F.lit("/p"), k, F.lit(".jsp")).alias("file"), F.concat(head, text).alias("content"))


#: Methods of a made source file, and the lines that stand before them and that each takes.
PER_FILE, HEAD_LINES, METHOD_LINES = 50, 9, 14


def java_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): Java sources written from `part`, a class for each PER_FILE parts and a method for each part."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand", F.expr(f"p_partkey div {PER_FILE}").alias("g"))
    k, n = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    method = F.concat(
        F.lit("    @Size("), n, F.lit(")\n    public int m"), k, F.lit("(int a, String b) {\n        helper.compute(a, \"x;{"), n, F.lit("\");\n        if (a > "), n,
        F.lit(") {\n            this.n"), k, F.lit("(b); // not() a call\n        } else {\n            helper.rest();\n        }\n        for (int i = 0; i < 3; i++) {\n            helper.door().shut(i);\n        }\n        return a;\n    }\n\n"),
    )
    rows = p.withColumn("method", method).groupBy("g").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "method"))), lambda x: x["method"]), "").alias("body"))
    g = F.col("g").cast("string")
    head = F.concat(
        F.lit("package parts.b"), (F.col("g") % 7).cast("string"), F.lit(";\n\nimport java.util.List;\nimport util.Helper;\n\n@Service(name = \"c,"), g, F.lit("\", level = "), (F.col("g") % 4).cast("string"),
        F.lit(")\npublic class C"), g, F.lit(" extends Base"), (F.col("g") % 5).cast("string"), F.lit(" implements Shape {\n    private Helper helper;\n\n"),
    )
    return rows.select(F.concat(F.lit("src/C"), g, F.lit(".java")).alias("path"), F.concat(head, "body", F.lit("}\n")).alias("content"))


def java_helper(spark: SparkSession) -> DataFrame:
    """The class that the made files call."""
    text = "package util;\n\npublic class Helper {\n    public void compute(int a, String b) {\n        rest();\n    }\n    public Door door() {\n        return null;\n    }\n    public void rest() {\n    }\n}\n"
    return spark.range(1).select(F.lit("src/Helper.java").alias("path"), F.lit(text).alias("content"))


def java_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): a class for each supplier k, in a tree where k extends k div 2, with overloads of one of three methods, and
    calls whose receivers are chains, supertypes and arguments of other calls, below control heads without braces."""
    k = F.col("k")
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k")).withColumn("o", F.greatest(F.floor(k / 2), F.lit(1)))
    text = lambda c: F.col(c).cast("string")
    extends = F.when(k > 1, F.concat(F.lit(" extends T"), text("o"))).otherwise("")
    m = F.concat(F.lit("m"), (k % 3).cast("string"))
    content = F.concat(
        F.lit("package tree.p"), (k % 4).cast("string"), F.lit(";\n\nimport tree.p"), (F.col("o") % 4).cast("string"), F.lit(".T"), text("o"), F.lit(";\n\npublic class T"), text("k"), extends, F.lit(" {\n    public int "),
        m, F.lit("(int a) { return a; }\n    public int "), m, F.lit("(String s) { return 1; }\n    public int "), m, F.lit("(int a, String s) { return 2; }\n    public void run(int n, T"), text("o"),
        F.lit(" other) {\n        StringBuilder sb = new StringBuilder();\n        sb.append(n).append(\"k"), text("k"), F.lit(", (x\").toString();\n        if (n > "), text("k"),
        F.lit(") this.m0(n); else if (n < 0) other.m1(\"a;b\");\n        else\n            m2(m2(1), \"c\");\n        for (int i = 0; i < n; i++) while (ready(i))\n            other.m0(other.m1(i) + other.m1(\"z\"));\n    }\n}\n"),
    )
    return rows.select(F.concat(F.lit("tree/T"), text("k"), F.lit(".java")).alias("path"), content.alias("content"))
