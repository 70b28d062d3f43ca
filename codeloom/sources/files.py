"""File scans: source trees, JSON documents, pages, and the class index, as DataFrames read by the executors."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import scalars as s
from codeloom.model import empty


class MissingRoot(ValueError):
    """A root that isn't there; readers that report instead of raising turn it into their error text."""


def _scan(spark: SparkSession, roots: list[str], glob: str) -> DataFrame:
    out = None
    for root in roots:
        try:
            one = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                raise MissingRoot(f"{root} does not exist") from e
            raise
        one = one.select(F.col("_metadata.file_path").alias("path"), F.lit(root).alias("root"), F.col("value").alias("content"))
        out = one if out is None else out.unionByName(one)
    return out


def _below(path, root) -> F.Column:
    """What of the path lies below the root, whatever scheme it is written with."""
    bare = F.regexp_replace(path, r"^[a-z0-9]+:/+", "/")
    base = F.regexp_replace(F.regexp_replace(root, r"^[a-z0-9]+:/+", "/"), r"/+$", "")
    return F.substring(bare, F.length(base) + 2, F.length(bare))


def source_files(spark: SparkSession, roots: list[str] | str, extension: str = ".java") -> DataFrame:
    """(path, root, content, relative_path): a row for each file below the roots; relative_path is the root, its slashes as
    underscores, and the path below it."""
    own = [x.strip() for x in (roots.split(",") if isinstance(roots, str) else roots) if x.strip()]
    df = _scan(spark, own, f"*{extension}")
    prefix = F.replace(F.regexp_replace(F.regexp_replace("root", r"^[a-z0-9]+:/+", "/"), r"^/+|/+$", ""), F.lit("/"), F.lit("_"))
    return df.withColumn("relative_path", F.concat_ws("/", prefix, _below(F.col("path"), F.col("root"))))


def page_files(spark: SparkSession, path: str, extensions: tuple[str, ...] = (".jsp", ".faces")) -> DataFrame:
    """(file, content): pages of a folder, or one file; extensions match whatever their case."""
    df = _scan(spark, [path], "*")
    wanted = "(?i)(" + "|".join(re.escape(x) for x in extensions) + ")$"
    return df.where(F.col("path").rlike(wanted)).select(F.substring_index("path", "/", -1).alias("file"), "content")


def json_documents(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """One JSON document a file: (path, doc, ok). A file that can't be read as the schema has ok = false and a null doc."""
    df = _scan(spark, [folder], "*.json")
    doc = F.from_json("content", schema, {"mode": "PERMISSIVE"})
    good = F.try_parse_json("content").isNotNull()
    return df.select("path", F.when(good, doc).alias("doc"), good.alias("ok"))


def scan_statistics(documents: DataFrame) -> DataFrame:
    return documents.agg(F.count("*").alias("total"), F.count_if("ok").alias("success"), F.count_if(~F.col("ok")).alias("error"))


def class_index(types: DataFrame) -> DataFrame:
    """(class_fqn, file): of a class that several files declare the one loaded last counts, by `load_ord` if types has it; of one load the
    largest path."""
    order = F.struct("load_ord", "file") if "load_ord" in types.columns else F.col("file")
    return types.where(F.coalesce("class_fqn", F.lit("")) != "").groupBy("class_fqn").agg(F.max_by("file", order).alias("file"))


def source_of(index: DataFrame, sources: DataFrame, classes: DataFrame, how: str = "left") -> DataFrame:
    """(class_fqn, content) of the classes asked for; without a source null (left), left out (inner), or only the names that
    have one (left_semi). Type arguments of the names don't count."""
    wanted = classes.select(s.strip_type_arguments("class_fqn").alias("class_fqn"))
    known = index.join(sources.select(F.col("path").alias("file"), "content"), "file").select("class_fqn", "content")
    return wanted.join(known, "class_fqn", how)


def packed(sources: DataFrame, excluded: list[str] = ()) -> DataFrame:
    """One row for each folder: its files without comments, blanks collapsed, in the order of their paths, as Markdown."""
    df = sources
    for x in excluded:
        df = df.where(~F.col("path").contains(f"/{x}/"))
    bare = F.regexp_replace(F.regexp_replace("content", r"(?s)/\*.*?\*/", ""), r"(?m)(^|[^:])//[^\n]*$", "$1")
    bare = F.trim(F.regexp_replace(F.regexp_replace(bare, r"[ \t]+", " "), r"(\s*\n)+\s*", "\n"))
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    rows = df.select(folder.alias("folder"), "path", F.concat(F.lit("## "), F.substring_index("path", "/", -1), F.lit("\n```\n"), bare, F.lit("\n```\n")).alias("part"))
    parts = F.array_sort(F.collect_list(F.struct("path", "part")))
    return rows.groupBy("folder").agg(F.array_join(F.transform(parts, lambda x: x["part"]), "\n").alias("markdown"))


MARKERS = (("gradle", ("build.gradle", "settings.gradle", "build.gradle.kts")), ("maven", ("pom.xml",)), ("eclipse", (".classpath", ".project")))


def project_kind(path: str) -> str:
    """gradle, maven or eclipse, by the first marker file found in that order. A few names are looked up; no build is run."""
    for kind, files in MARKERS:
        if any(os.path.exists(os.path.join(path, x)) for x in files):
            return kind
    raise ValueError(f"{path} is no project of a known kind")


def source_roots(path: str) -> list[str]:
    """The source folders of a project: by convention, or by the entries of its class path file."""
    kind = project_kind(path)
    if kind == "eclipse" and os.path.exists(os.path.join(path, ".classpath")):
        import xml.etree.ElementTree as xml

        entries = xml.parse(os.path.join(path, ".classpath")).getroot().iter("classpathentry")
        return [os.path.join(path, e.get("path", "")) for e in entries if e.get("kind") == "src"]
    found = []
    for top, folders, _ in os.walk(path):
        if os.path.basename(top) == "java" and os.path.basename(os.path.dirname(top)) in ("main", "test"):
            found.append(top)
            folders.clear()
    return sorted(found)


def scanned_or_error(spark: SparkSession, roots: str, schema: str) -> tuple[DataFrame, str | None]:
    """The scan, or an empty table and what is missing."""
    try:
        return source_files(spark, roots), None
    except MissingRoot as e:
        return empty(spark, schema), str(e)


TABLES = ("types", "methods", "calls", "fragments", "annotation_uses")


def save_documents(parsed, folder: str, append: bool = False) -> int:
    """Writes the parsed documents as JSON lines, compact and not one file per source: a folder for each table and load, in one place. The
    load's ordinal, one more than the largest there is, or 1 if the folder is written anew."""
    spark = parsed.types.sparkSession
    n = 1 + (load_documents(spark, folder, "types").agg(F.coalesce(F.max("load_ord"), F.lit(0))).first()[0] if append else 0)
    for name in TABLES:
        df = getattr(parsed, name).withColumn("load_ord", F.lit(n))
        df.write.mode("append" if append else "overwrite").partitionBy("load_ord").json(f"{folder}/{name}")
    return n


def load_documents(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the documents saved there, with its schema and `load_ord`."""
    from codeloom import model

    return spark.read.schema(f"{getattr(model, name.upper())}, load_ord int").json(f"{folder}/{name}")


def read_pages(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(file, content, error): the pages below a folder as text. A file that isn't valid UTF-8 has its error, and no content."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    text = F.col("content").cast("string")
    bad = text.cast("binary") != F.col("content")
    broken = F.expr("not is_valid_utf8(cast(content as string))")
    return raw.select(F.col("path").alias("file"), F.when(~(broken | bad), text).alias("content"), F.when(broken | bad, F.lit("not valid UTF-8")).alias("error"))
