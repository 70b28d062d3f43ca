"""Source extraction: lines of classes filtered by what a trace uses, and merged into one text.

A source is exploded into numbered lines; whether the class has begun is a running maximum, and the lines of the methods kept
are a semi join on ranges within a file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.functions import scalars as s
from codeloom.operators import java, trace
from codeloom.operators.trace import TraceConfig
from codeloom.tables import stored


def lines_of(sources: DataFrame, content: str = "content", key: str = "path") -> DataFrame:
    """(key, line, text), lines from 1; empty lines at the end don't count."""
    cut = F.regexp_replace(F.coalesce(F.col(content), F.lit("")), r"\n+$", "")
    return sources.select(key, F.posexplode(F.split(cut, "\n", -1)).alias("line", "text")).withColumn("line", F.col("line") + 1)


def marked(lines: DataFrame, key: str = "path", modifiers: bool = True) -> DataFrame:
    """Adds in_class (the class line or later), is_import and is_comment."""
    t = F.trim("text")
    class_line = t.rlike(r"^((public|protected|private|abstract|final|static|sealed)\s+)*(class|interface|enum|record)\s") if modifiers else t.rlike(r"^(public )?class ")
    w = W.partitionBy(key).orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    return lines.withColumns({
        "is_class_line": class_line, "in_class": F.max(class_line).over(w),
        "is_import": t.startswith("package ") | t.startswith("import "), "is_comment": t.startswith("//") | t.startswith("/*") | t.startswith("*"),
    })


def whole_class(lines: DataFrame, key: str = "path", imports: bool = True, comments: bool = True, modifiers: bool = True) -> DataFrame:
    m = marked(lines, key, modifiers)
    before = F.col("is_import") if imports else F.lit(False)
    inside = F.lit(True) if comments else ~F.col("is_comment")
    return m.where(F.when(F.col("in_class"), inside).otherwise(before)).select(*lines.columns)


def in_ranges(lines: DataFrame, ranges: DataFrame, key: str = "path") -> DataFrame:
    """The lines in a range (key, start_line, end_line) of their file; equal on the key, so never a join of all with all."""
    r = ranges.select(F.col(key).alias("_k"), "start_line", "end_line")
    return lines.join(r, (F.col(key) == F.col("_k")) & F.col("line").between(F.col("start_line"), F.col("end_line")), "left_semi")


def used_methods(lines: DataFrame, methods: DataFrame, used: DataFrame, key: str = "path", imports: bool = True, constructors: bool = False, fields: bool = True) -> DataFrame:
    """methods: (key, name, class_fqn, start_line, end_line); used: (key, name). Imports, the class line, the methods used, the
    constructors if wanted, and, with fields, the lines of the class that belong to no method."""
    own = methods.join(used.select(key, "name").distinct(), [key, "name"], "left_semi")
    if constructors:
        own = own.unionByName(methods.where(F.col("name") == s.simple_name("class_fqn")).select(*own.columns)).distinct()
    m = marked(lines, key)
    out = outline(m, methods if fields else None, key, imports).unionByName(in_ranges(_body(m), own, key))
    return out.select(*lines.columns)


def _body(m: DataFrame) -> DataFrame:
    return m.where(F.col("in_class") & ~F.col("is_class_line"))


def outline(m: DataFrame, methods: DataFrame | None, key: str = "path", imports: bool = True) -> DataFrame:
    """m: marked lines. The imports, the class line, and, if methods are given, the lines of the class that belong to none."""
    out = m.where(F.when(F.col("in_class"), F.col("is_class_line")).otherwise(F.col("is_import") if imports else F.lit(False)))
    if methods is not None:
        r = methods.select(F.col(key).alias("_k"), "start_line", "end_line")
        out = out.unionByName(_body(m).join(r, (F.col(key) == F.col("_k")) & F.col("line").between(F.col("start_line"), F.col("end_line")), "left_anti").where(F.trim("text") != "}"))
    return out


def joined(lines: DataFrame, key: str = "path", closing: str | None = None) -> DataFrame:
    """(key, source): the lines of each key in order; a key without any text left isn't there."""
    ordered = F.array_sort(F.collect_list(F.struct("line", "text")))
    text = F.array_join(F.transform(ordered, lambda x: x["text"]), "\n")
    out = lines.groupBy(key).agg((F.concat(text, F.lit("\n" + closing)) if closing else text).alias("source"))
    return out.where(~s.blank("source"))


def sections(sources: DataFrame, *keep: str) -> DataFrame:
    """sources: (class_fqn, relative_path, source). (ord, class_fqn, section, lines): the Markdown section of each, in order."""
    section = F.concat(F.lit("## "), "relative_path", F.lit("\n\n**Class**: `"), "class_fqn", F.lit("`\n\n```java\n"), "source", F.lit("\n```\n\n"))
    return sources.select(*keep, "class_fqn", section.alias("section"), s.pieces("source").alias("lines"))


def merged(sources: DataFrame, entry: str, timestamp: str) -> DataFrame:
    """sources: (class_fqn, relative_path, source) of one entry's trace. One row: classes, lines, and the Markdown text, classes in order."""
    one = sections(sources).agg(F.count("*").alias("total_classes"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("class_fqn", F.col("section").alias("t")))), lambda x: x["t"]), "").alias("body"))
    head = F.concat(F.lit(f"# Extracted code\n\n- **Entry**: `{entry}`\n- **Time**: {timestamp}\n- **Classes**: "), F.col("total_classes").cast("string"), F.lit("\n\n"))
    return one.select("total_classes", F.concat(head, "body").alias("markdown")).withColumn("total_lines", s.pieces("markdown"))


def woven_classes(parsed, sources: DataFrame, entries: DataFrame, config: TraceConfig = TraceConfig(), all_methods: bool = False) -> DataFrame:
    """parsed: java.Parsed; sources: (path, content); entries: (entry). (entry, class_fqn, relative_path, source, status): of each class
    that an entry's trace involves and that lies in a base package, the source with the methods that the trace uses, or with all its methods;
    the whole source where weaving leaves nothing. status: ok, whole, or missing, if no file holds the class (its source is null).

    An entry outside the base packages involves nothing."""
    inside = s.starts_with_any("entry", config.base_packages)
    traced = trace.trace(java.trace_calls(parsed), entries.where(inside), config)
    used = trace.involved_methods(traced).unionByName(entries.where(inside).select("entry", F.col("entry").alias("method"))).distinct()
    owner = s.strip_type_arguments(F.regexp_extract("method", r"(?s)^(.*)\.[^.]*$", 1))
    used = used.select("entry", owner.alias("class_fqn"), F.substring_index("method", ".", -1).alias("name")).where(s.starts_with_any("class_fqn", config.base_packages) & (F.col("class_fqn") != "unknown"))
    classes = stored(used.select("entry", "class_fqn").distinct(), "classes")
    files = parsed.types.select("class_fqn", F.col("file").alias("path")).groupBy("class_fqn").agg(F.min("path").alias("path"))
    at = stored(classes.join(files, "class_fqn", "left"), "places")
    # A class is cut up once, however many entries need it: its outline, and the lines of each of its methods.
    known = at.where("path is not null")
    each = known.select("class_fqn", "path").distinct()
    whole = stored(each.join(sources.select("path", F.col("content").alias("whole")), "path"), "sources")
    spans = each.select("class_fqn").join(parsed.methods.select("class_fqn", "name", "start_line", "end_line"), "class_fqn").where("start_line <= end_line")
    spans = stored(spans.select("class_fqn", "name", F.explode(F.sequence("start_line", "end_line")).alias("line")).distinct(), "spans")
    m = stored(marked(lines_of(whole, "whole", "class_fqn"), "class_fqn"), "lines")
    gathered = lambda df, key, c: df.groupBy(*key).agg(F.collect_list(F.struct("line", "text")).alias(c))
    outside = outline(m, None, "class_fqn").unionByName(_body(m).join(spans, ["class_fqn", "line"], "left_anti").where(F.trim("text") != "}").select(*m.columns))
    head = whole.join(gathered(outside, ["class_fqn"], "_head"), "class_fqn", "left").select("class_fqn", "_head", F.when(F.col("_head").isNull(), F.col("whole")).alias("_whole"))
    if all_methods:
        used = known.select("entry", "class_fqn").join(spans.select("class_fqn", "name").distinct(), "class_fqn")
    used = stored(used.distinct(), "used")
    inside = _body(m).join(spans.join(used.select("class_fqn", "name").distinct(), ["class_fqn", "name"], "left_semi"), ["class_fqn", "line"])
    body = used.join(gathered(inside, ["class_fqn", "name"], "_own"), ["class_fqn", "name"]).groupBy("entry", "class_fqn").agg(F.flatten(F.collect_list("_own")).alias("_body"))
    met = known.join(body, ["entry", "class_fqn"], "left").join(head, "class_fqn")
    none = F.array().cast("array<struct<line:int,text:string>>")
    met = met.withColumn("_lines", F.array_sort(F.concat(F.coalesce("_head", none), F.coalesce("_body", none))))
    # A line that two of the methods share counts once.
    once = F.filter("_lines", lambda x, i: (i == 0) | (F.get(F.col("_lines"), i - 1)["line"] != x["line"]))
    woven = F.when(F.size("_lines") > 0, F.concat(F.array_join(F.transform(once, lambda x: x["text"]), "\n"), F.lit("\n}")))
    met = met.select("entry", "class_fqn", F.col("path").alias("relative_path"), F.coalesce(woven, "_whole").alias("source"), F.when(F.size("_lines") > 0, "ok").otherwise("whole").alias("status"))
    lost = at.where("path is null").select("entry", "class_fqn", F.lit(None).cast("string").alias("relative_path"), F.lit(None).cast("string").alias("source"), F.lit("missing").alias("status"))
    return stored(met.unionByName(lost), "woven")


def extract_code(parsed, sources: DataFrame, entry: str, config: TraceConfig = TraceConfig(), timestamp: str = "", all_methods: bool = False) -> DataFrame:
    """One row: involved_classes, merged_source, total_classes, total_lines, error. An entry outside the base packages, or one that no
    class holds, has no classes and no text; error says so."""
    spark = sources.sparkSession
    found = woven_classes(parsed, sources, spark.createDataFrame([(entry,)], "entry string"), config, all_methods)
    text = merged(found.where("source is not null"), entry, timestamp)
    names = found.where("source is not null").agg(F.array_sort(F.collect_list("class_fqn")).alias("involved_classes"), F.count_if(F.col("class_fqn") == F.lit(entry.rpartition(".")[0])).alias("_own"))
    error = F.when(F.size("involved_classes") == 0, F.lit(f"no source holds {entry}")).when(F.col("_own") == 0, F.lit(f"the class of {entry} is unknown"))
    one = names.withColumn("_k", F.lit(1)).join(text.withColumn("_k", F.lit(1)), "_k")
    some = F.col("total_classes") > 0
    return one.select("involved_classes", F.when(some, F.col("markdown")).otherwise("").alias("merged_source"), "total_classes", F.when(some, F.col("total_lines")).otherwise(0).alias("total_lines"), error.alias("error"))
