"""Java sources to tables of types, methods, calls, fragments and annotation uses, by column functions and windows.

`marks` cuts a file into segments and call sites. Here segments become types, methods, fragments and annotation uses, and call
sites become calls whose receivers are resolved: a variable of the method, a field, a type, the superclass, or what the call
before it in a chain returns. Names are completed by the imports, the package, or the classes known. A call belongs to the nearest
class, from its receiver's type upwards along EXTENDS and IMPLEMENTS, that has a method of that name; its overloads are ranked by
their number of parameters and by how many argument types fit, and all of the best rank are its targets.

Defined results: a null or empty file has no rows; unbalanced braces leave what follows at the depth they lead to; a call
without a known target keeps its receiver's type and has no targets; ties between overloads stay several targets.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.operators import marks
from codeloom.operators.marks import KEYWORDS
from codeloom.operators.pages import matches
from codeloom.operators.trace import reach
from codeloom.tables import stored

# Fixed values.
MODIFIERS = ["public", "protected", "private", "static", "final", "abstract", "synchronized", "native", "default", "strictfp", "sealed"]
BOXES = {"int": "Integer", "long": "Long", "short": "Short", "byte": "Byte", "char": "Character", "float": "Float", "double": "Double", "boolean": "Boolean"}
WIDER = {"byte": ["short", "int", "long", "float", "double"], "short": ["int", "long", "float", "double"], "char": ["int", "long", "float", "double"], "int": ["long", "float", "double"], "long": ["float", "double"], "float": ["double"]}
_TYPE = r"\b(class|interface|enum|record|@interface)\s+([A-Za-z_$][\w$]*)"
_METHOD = r"(?s)([A-Za-z_$][\w$]*)\s*\(((?:[^()]|\([^()]*\))*)\)\s*(?:throws\s+([\w.,\s]+?))?\s*$"
_BEFORE = r"(?s)^(?:\s*@[\w.]+(?:\((?:[^()]|\([^()]*\))*\))?)*\s*((?:(?:" + "|".join(MODIFIERS) + r")\s+)*)(?:<[^(]*?>\s+)?((?:[\w$.]+(?:<[^(]*?>)?(?:\[\])*\s+)?)[A-Za-z_$][\w$]*\s*\("
_ANNOTATION = r"@([A-Za-z_][\w.]*)(\((?:[^()]|\([^()]*\))*\))?"
_CONTROL = r"^(?:[\w$]+\s*:(?!:)\s*|case\b[^:]*:\s*|default\s*:\s*)*"


def segments(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """files: (path, content). Its marks and its segments."""
    m = stored(marks.marks(files), "marks")
    head, end = F.col("head"), F.col("end")
    is_type = (end == "{") & F.regexp_like("head", F.lit(_TYPE)) & ~head.rlike(r"=\s*new\b")
    member = F.regexp_replace("head", r"(?s)\)\s*default\b.*$", ")")
    name = F.regexp_extract(member, _METHOD, 1)
    method = end.isin("{", ";") & (name != "") & ~name.isin(KEYWORDS) & ~member.rlike(r"^[^(]*=(?![^(]*\()") & ~is_type
    typed = F.trim(F.regexp_extract(member, _BEFORE, 2)) != ""
    is_if = head.rlike(_CONTROL + r"(?:else\s+)?if\s*\(")
    control = is_if | head.rlike(_CONTROL + r"(?:for|while)\s*\(") | (head == "else")
    bit = lambda c, k: F.when(c, k).otherwise(0)
    bits = (
        bit(end == "{", marks.OPENS) + bit(end == "}", marks.CLOSES) + bit(end == "h", marks.BARE) + bit(is_if, marks.IS_IF) + bit(head.rlike(r"^else\b"), marks.IS_ELSE)
        + bit(head.rlike(r"^(?:catch|finally)\b|^[,).]") | ((head == "") & (end == ";")), marks.GOES_ON) + bit(is_type, marks.IS_TYPE) + bit(method & typed, marks.IS_METHOD) + bit(method & ~typed, marks.IS_CONSTRUCTOR) + bit(control, marks.IS_CONTROL)
    )
    rows = marks.segments(m, bits.cast("int"), F.when(is_type, F.regexp_extract("head", _TYPE, 2)).when(method, name))
    kept = F.when(F.col("kind").isin("type", "method"), F.col("name"))
    return m, rows.withColumns({"name": kept, "head": F.when(F.col("kind") == "method", member).otherwise(head)})


class Parsed:
    """The tables of a set of files: types, methods, calls, fragments, annotation_uses."""

    def __init__(self, files: DataFrame, earlier: DataFrame | None = None):
        """earlier: (package, class_fqn) of types that other files are known to hold."""
        m, rows = segments(files)
        self.marks_, self.rows, self.files, self.earlier = m, stored(rows, "segments"), files, earlier
        head = files.select(F.col("path").alias("file"), F.col("content"))
        text = F.coalesce(F.col("content"), F.lit(""))
        self.units = stored(head.select("file", F.regexp_extract(text, r"(?m)^\s*package\s+([\w.]+)\s*;", 1).alias("package"), F.regexp_extract_all(text, F.lit(r"(?m)^\s*import\s+(?:static\s+)?([\w.]+)\s*;"), F.lit(1)).alias("imports")), "units")
        self.types = stored(self._types(), "types")
        self.methods_ = stored(self._methods(), "methods")

    def _resolve(self, df: DataFrame, column: str) -> DataFrame:
        """df, which has `file`: the column's type name completed by imports, the package, or the known classes."""
        bare = F.regexp_replace(F.regexp_replace(F.trim(F.col(column)), r"(?s)<.*>", ""), r"\[\]|\.\.\.", "")
        imports = self.units.select("file", F.explode("imports").alias("_i")).groupBy("file", F.substring_index("_i", ".", -1).alias("_n")).agg(F.min("_i").alias("_import"))
        types = self.types.select("package", "class_fqn")
        types = types.unionByName(self.earlier.select("package", "class_fqn")) if self.earlier is not None else types
        same = types.groupBy("package", F.substring_index("class_fqn", ".", -1).alias("_n2")).agg(F.min("class_fqn").alias("_same"))
        met = df.withColumn("_bare", bare).join(imports.withColumnRenamed("file", "_f"), (F.col("file") == F.col("_f")) & (F.col("_bare") == F.col("_n")), "left").drop("_f", "_n")
        met = met.join(self.units.select(F.col("file").alias("_f"), F.col("package").alias("_package")), F.col("file") == F.col("_f"), "left").drop("_f")
        met = met.join(same, (F.col("_package") == F.col("package")) & (F.col("_bare") == F.col("_n2")), "left").drop("package", "_n2") if "package" not in df.columns else met.withColumn("_same", F.lit(None).cast("string"))
        return met.withColumn(column, F.coalesce("_import", "_same", "_bare")).drop("_bare", "_import", "_same", "_package")

    def _types(self) -> DataFrame:
        t = self.rows.where("kind = 'type'").join(self.units, "file")
        outer = t.select("file", F.col("ord").alias("owner"), F.col("name").alias("_outer"), F.col("owner").alias("_owner2"))
        t = t.join(outer, ["file", "owner"], "left")
        name = F.concat_ws(".", F.nullif("package", F.lit("")), "_outer", "name")
        is_interface = F.regexp_extract("head", _TYPE, 1).isin("interface", "@interface")
        mods = F.filter(F.split(F.regexp_extract("head", r"(?s)^(.*?)\b(?:class|@?interface|enum|record)\s", 1), r"\s+"), lambda x: x.isin(MODIFIERS))
        up = F.regexp_extract("head", r"(?s)\bextends\s+(.*?)(?:\bimplements\b|\bpermits\b|$)", 1)
        impl = F.regexp_extract("head", r"(?s)\bimplements\s+(.*?)(?:\bpermits\b|$)", 1)
        names = lambda x: F.filter(F.transform(F.split(F.regexp_replace(x, r"<[^<>]*(<[^<>]*>)?[^<>]*>", ""), ","), lambda x: F.trim(x)), lambda y: y != "")
        out = t.select(
            "file", F.col("ord"), "package", name.alias("class_fqn"), F.when(is_interface, "Interface").when(F.array_contains(mods, "abstract"), "AbstractClass").otherwise("Class").alias("class_type"),
            F.when(~is_interface, F.get(names(up), F.lit(0))).alias("extends_fqn"),
            F.when(is_interface, names(up)).otherwise(names(impl)).alias("implements_fqns"), F.col("line").alias("start_line"), "end_line", mods.alias("modifiers"), F.col("head"),
        )
        # Supertypes are completed by the imports, or by the package for names of its own files.
        local = out.groupBy("package").agg(F.map_from_entries(F.collect_set(F.struct(F.substring_index("class_fqn", ".", -1), "class_fqn"))).alias("_own"))
        imports = self.units.select("file", F.map_from_entries(F.array_distinct(F.transform("imports", lambda i: F.struct(F.substring_index(i, ".", -1), i)))).alias("_imports"))
        full = out.join(imports, "file").join(local, "package")
        fill = lambda x: F.coalesce(F.col("_imports")[x], F.col("_own")[x], x)
        return full.withColumn("extends_fqn", fill(F.col("extends_fqn"))).withColumn("implements_fqns", F.transform("implements_fqns", fill)).drop("_imports", "_own")

    def _methods(self) -> DataFrame:
        t = self.types.select("file", F.col("ord").alias("owner"), "class_fqn")
        m = self.rows.where("kind = 'method'").join(t, ["file", "owner"])
        head = F.concat("head", F.lit(""))
        args = F.regexp_extract("head", _METHOD, 2)
        each = F.filter(F.split(F.regexp_replace(args, r"<[^<>]*(<[^<>]*>)?[^<>]*>", ""), ","), lambda x: F.trim(x) != "")
        clean = F.transform(each, lambda x: F.trim(F.regexp_replace(x, r"@[\w.]+(\([^)]*\))?\s*|\bfinal\s+", "")))
        kinds = F.transform(clean, lambda x: F.trim(F.regexp_replace(x, r"\s*[A-Za-z_$][\w$]*$", "")))
        names = F.transform(clean, lambda x: F.regexp_extract(x, r"([A-Za-z_$][\w$]*)$", 1))
        returns = F.trim(F.regexp_extract(head, _BEFORE, 2))
        mods = F.filter(F.split(F.regexp_extract(head, _BEFORE, 1), r"\s+"), lambda x: x != "")
        thrown = F.filter(F.transform(F.split(F.regexp_extract("head", _METHOD, 3), ","), lambda x: F.trim(x)), lambda x: x != "")
        body = F.col("end") == "{"
        return m.select(
            "file", F.col("ord"), "class_fqn", "name", F.array_join(kinds, ", ").alias("signature"), F.nullif(returns, F.lit("")).alias("return_type"), F.concat_ws(".", "class_fqn", "name").alias("full_name"),
            F.col("line").alias("start_line"), "end_line", thrown.alias("thrown"), F.when(body | F.array_contains(mods, "abstract"), mods).otherwise(F.concat(mods, F.array(F.lit("abstract")))).alias("modifiers"),
            F.row_number().over(W.partitionBy("file").orderBy("ord")).alias("ordinal"), F.arrays_zip(names.alias("var"), kinds.alias("kind")).alias("arguments"), F.col("head"),
        )

    @staticmethod
    def _key(c: str) -> F.Column:
        return F.concat_ws("#", "file", F.col(c).cast("string"))

    @staticmethod
    def _around() -> F.Column:
        """The id of the fragment that a segment of a method lies in, if it is one of the method's own."""
        return F.when(F.col("fragment") > F.col("method"), Parsed._key("fragment"))

    @cached_property
    def fragments_(self) -> DataFrame:
        m = self.methods_.select("file", F.col("ord").alias("method"), "full_name")
        own = self.rows.where("method is not null and kind = 'fragment'").join(m, ["file", "method"])
        head = F.regexp_replace("head", _CONTROL, "")
        loop = head.rlike(r"^(for|while)\s*\(")
        inner = F.trim(F.regexp_extract(F.regexp_replace("own", r"^\s+|\s+$", ""), r"(?s)" + _CONTROL + r"(?:else\s+)?(?:if|for|while)\s*\((.*)\)\s*$", 1))
        condition = F.when(head == "else", "").when(head.startswith("while"), F.concat(F.lit("while ("), inner, F.lit(")"))).when(head.startswith("for") & ~inner.rlike(r"^[^;]*:[^;]*$"), "for loop").otherwise(
            F.when(head.startswith("for"), F.regexp_replace(inner, r"^(?:final\s+)?[\w$<>\[\], .]+\s+([\w$]+)\s*:\s*", "$1 : ")).otherwise(inner))
        # An else belongs to the if whose statement it goes on with: the place in its ladder is its ordinal.
        start = F.when(~head.startswith("else"), F.col("ord"))
        ladder = F.last(start, ignorenulls=True).over(W.partitionBy("file", "parent").orderBy("ord"))
        frags = own.withColumns({"_head": head, "_loop": loop, "_condition": condition}).withColumn("_ladder", ladder)
        return stored(frags.select(
            "file", self._key("ord").alias("fragment_id"), self._around().alias("parent_fragment_id"), F.col("full_name").alias("method_full_name"),
            F.when(F.col("_loop"), "LOOP").otherwise("ALTERNATIVE").alias("type"), F.col("_condition").alias("condition"), F.col("line").alias("start_line"), "end_line",
            (F.row_number().over(W.partitionBy("file", "_ladder").orderBy("ord")) - 1).alias("ordinal"), self._key("_ladder").alias("ladder_id"),
        ), "fragments")

    @cached_property
    def ancestors(self) -> DataFrame:
        """(class_fqn, up, distance): each type's supertypes among the known types, those of supertypes, and so on, with the least number
        of steps."""
        up = self.types.select(F.col("class_fqn").alias("src"), F.explode(F.array_compact(F.concat(F.array("extends_fqn"), "implements_fqns"))).alias("dst"))
        up = up.join(self.types.select(F.col("class_fqn").alias("dst")), "dst", "left_semi")
        starts = up.select(F.col("src").alias("start")).distinct()
        return stored(reach(stored(up, "supertypes"), starts).select(F.col("start").alias("class_fqn"), F.col("node").alias("up"), "distance"), "ancestors")

    @cached_property
    def outer(self) -> DataFrame:
        """(class_fqn, up, distance): the types that a type is declared in, further away than any supertype."""
        names = self.types.select("class_fqn").distinct()
        parts = F.split("class_fqn", r"\.")
        each = names.withColumn("_p", parts).select("class_fqn", F.posexplode(F.transform("_p", lambda x, i: F.array_join(F.slice("_p", F.lit(1), i + 1), "."))).alias("_k", "up")).where("up <> class_fqn")
        return stored(each.join(names.withColumnRenamed("class_fqn", "up"), "up").select("class_fqn", "up", (F.lit(1 << 20) - F.col("_k")).alias("distance")), "outer")

    @cached_property
    def members(self) -> DataFrame:
        """(class_fqn, name, signature, arity, varargs, kinds, returns, at): what the types declare; a type without constructors has none."""
        m = self._resolve(self.methods_.select("file", "class_fqn", "name", "signature", "ordinal", F.col("return_type").alias("returns"), F.col("arguments.kind").alias("kinds")), "returns")
        last = F.element_at("kinds", -1)
        return stored(m.select("class_fqn", "name", "signature", F.size("kinds").alias("arity"), F.when(F.size("kinds") > 0, last.endswith("...")).otherwise(False).alias("varargs"), "kinds", "returns", F.struct("file", "ordinal").alias("at")), "members")

    @cached_property
    def calls_(self) -> DataFrame:
        m = self.methods_.select("file", F.col("ord").alias("method"), "full_name", "class_fqn")
        segs = self.rows.where("method is not null and kind not in ('type', 'method')")
        own = segs.join(m, ["file", "method"])
        found = marks.call_sites(self.marks_, segs.select("file", "ord", "at", "own")).where(~F.col("name").isin(KEYWORDS))
        at = own.select("file", F.col("ord").alias("seg"), "method", "full_name", "class_fqn", "line", "raw", "head", F.when(F.col("kind") == "fragment", self._key("ord")).otherwise(self._around()).alias("parent_fragment_id"), F.when(F.col("kind") == "fragment", "condition").otherwise("content").alias("region"))
        found = found.join(at, ["file", "seg"])
        breaks = lambda x: F.regexp_count(x, F.lit("\n"))
        number = lambda c: F.concat_ws("#", "file", F.lit("c"), F.col(c).cast("string"))
        before = F.expr("substring(raw, 1, in_seg)")
        bare = F.regexp_replace("receiver", r"^this\.", "")
        found = found.withColumns({
            "call_id": number("key"), "receiver_call_id": F.when(F.col("receiver_key").isNotNull(), number("receiver_key")), "line": (F.col("line") + breaks(before) - breaks(F.regexp_extract("raw", r"^\s*", 0))).cast("int"),
            "assigned_to": F.nullif(F.regexp_extract("head", r"(?s)([A-Za-z_$][\w$]*)\s*=[^=]", 1), F.lit("")),
            "var": F.when(F.col("foreign") | F.col("receiver_key").isNotNull(), None).when(F.col("receiver").isNull() | (F.col("receiver") == "this"), F.lit("this")).otherwise(F.regexp_replace(F.substring_index(bare, ".", 1), r"\[.*$", "")), "_path": F.size(F.split(bare, r"\.")),
        })
        args = self.methods_.select("file", F.col("ord").alias("method"), F.explode("arguments").alias("a")).select("file", "method", F.col("a.var").alias("var"), F.col("a.kind").alias("vtype"))
        declared = r"(?s)(?:^|[(;\s])(?:final\s+)?([A-Z][\w$.]*(?:<[^;=()]*>)?(?:\[\])*|int|long|short|byte|char|float|double|boolean)\s+([A-Za-z_$][\w$]*)\s*(?:=|:|$)"
        local = own.select("file", "method", F.regexp_extract("head", declared, 2).alias("var"), F.regexp_extract("head", declared, 1).alias("vtype")).where("var <> ''")
        by_method = args.unionByName(local).groupBy("file", "method", "var").agg(F.min("vtype").alias("t"))
        t = self.types.select("file", F.col("ord").alias("owner"), "class_fqn", "extends_fqn")
        inside = self.rows.select("file", "ord", "kind", "owner", "method", "head").where("kind = 'statement' and method is null and owner is not null")
        fields = inside.select("file", F.regexp_extract("head", declared, 2).alias("var"), F.regexp_extract("head", declared, 1).alias("vtype")).where("var <> ''").groupBy("file", "var").agg(F.min("vtype").alias("t"))
        by_method, fields = stored(by_method, "variables"), stored(fields, "fields")
        known = lambda df, var, out: df.join(by_method.select("file", "method", F.col("var").alias(var), F.col("t").alias("_t1")), ["file", "method", var], "left").join(fields.select("file", F.col("var").alias(var), F.col("t").alias("_t2")), ["file", var], "left").withColumn(out, F.coalesce("_t1", "_t2")).drop("_t1", "_t2")
        up = t.groupBy("file", "class_fqn").agg(F.min("extends_fqn").alias("_super"))
        met = known(found, "var", "_vtype").join(up, ["file", "class_fqn"], "left")
        static = F.when(F.col("receiver").rlike(r"^(?:[\w$]+\.)*[A-Z][\w$]*$"), F.col("receiver"))
        unknown = F.lit("unknown")
        callee = F.when(F.col("is_new"), F.col("name")).when(F.col("literal"), F.lit("String")).when(F.col("foreign") | F.col("receiver_key").isNotNull(), unknown).when(F.col("var") == "this", F.col("class_fqn")).when(
            F.col("var") == "super", F.coalesce("_super", unknown)).otherwise(F.coalesce(F.when(F.col("_path") <= 1, F.col("_vtype")), static, unknown))
        met = self._resolve(met.withColumn("callee", callee), "callee")
        met = stored(met.withColumn("seq", F.row_number().over(W.partitionBy("file").orderBy("name_at"))).withColumn("static_type", F.col("callee")), "found")
        met = self._linked(met, stored(self._argument_types(met, known), "argument_types"))
        running = F.row_number().over(W.partitionBy("file", "var").orderBy("seq"))
        return stored(met.select(
            "file", "call_id", F.col("full_name").alias("method_full_name"), "seq", F.col("class_fqn").alias("caller"), "callee", F.col("var").alias("callee_variable"),
            F.when(F.col("var") == "this", "this1").otherwise(F.concat("var", running.cast("string"))).alias("callee_instance"), F.col("name").alias("method_name"), "arguments",
            F.when(F.col("is_new"), F.col("callee")).otherwise(F.coalesce("returns", F.lit("void"))).alias("return_type"), "assigned_to", "line",
            "receiver_call_id", "parent_fragment_id", "region", "static_type", "targets",
        ), "calls")

    def _argument_types(self, calls: DataFrame, known) -> DataFrame:
        """(call_id, types): of each call's arguments, null where the text doesn't tell: literals, variables, new objects, this."""
        a = calls.select("file", "call_id", "method", "class_fqn", F.posexplode("arguments").alias("nth", "x"))
        x = F.col("x")
        text = F.when(x.startswith('"'), "String").when(x.startswith("'"), "char").when(x == "null", "null").when(x.isin("true", "false"), "boolean").when(x.rlike(r"^-?\d[\d_]*$"), "int").when(x.rlike(r"^-?\d[\d_]*[lL]$"), "long")
        text = text.when(x.rlike(r"^-?[\d_]*\.?\d+[fF]$"), "float").when(x.rlike(r"^-?[\d_]*\.[\d_]+[dD]?$"), "double").when(x == "this", F.col("class_fqn")).when(x.rlike(r"(?s)^new\s+[\w$.]+[^.]*\)$"), F.regexp_extract("x", r"^new\s+([\w$.]+)", 1))
        text = text.when(x.rlike(r"(?s)^\(\s*[A-Z][\w$.]*\s*\)"), F.regexp_extract("x", r"^\(\s*([\w$.]+)", 1))
        a = a.withColumns({"_text": text, "_var": F.when(x.rlike(r"^(?:this\.)?[A-Za-z_$][\w$]*$"), F.regexp_replace("x", r"^this\.", "")).otherwise("")})
        a = known(a, "_var", "_vtype").withColumn("t", F.coalesce("_text", "_vtype"))
        return a.groupBy("call_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("nth", "t"))), lambda y: y["t"]).alias("types"))

    def _targets(self, calls: DataFrame) -> DataFrame:
        """calls with `targets`, the overloads of the best rank in the nearest class that has the name, `returns`, what the first of them
        returns, and callee made that class. calls: with static_type, name, types."""
        members = self.members.withColumnRenamed("class_fqn", "_owner").withColumnRenamed("name", "_name")
        wanted = calls.select("static_type", "name", "is_new").distinct()
        near = wanted.select("static_type", "name", F.col("static_type").alias("owner"), F.lit(0).alias("_far")).unionByName(
            wanted.where("not is_new").join(self.ancestors.unionByName(self.outer), wanted["static_type"] == F.col("class_fqn")).select("static_type", "name", F.col("up").alias("owner"), F.col("distance").alias("_far"))
        )
        is_constructor = F.col("_name") == F.substring_index("_owner", ".", -1)
        known = near.join(members, (F.col("owner") == F.col("_owner")) & ((F.col("name") == F.col("_name")) | (is_constructor & (F.col("name") == F.substring_index("static_type", ".", -1)))))
        each = known.groupBy("static_type", "name", "owner", "_far").agg(F.sort_array(F.collect_list(F.struct("at", "_name", "signature", "arity", "varargs", "kinds", "returns"))).alias("all"))
        best = each.groupBy("static_type", "name").agg(F.min_by(F.struct("owner", "all"), F.struct("_far", "owner")).alias("near"))
        c = calls.join(best, ["static_type", "name"], "left")
        n, simple = F.size("types"), lambda t: F.regexp_replace(F.regexp_replace(F.substring_index(t, ".", -1), r"(?s)<.*>", ""), r"\.\.\.$", "")
        boxed = F.create_map(*(F.lit(x) for k, v in BOXES.items() for x in (k, v)))
        wide = F.create_map(*(y for k, v in WIDER.items() for y in (F.lit(k), F.array(*map(F.lit, v)))))
        plain = lambda t: F.coalesce(boxed[simple(t)], simple(t))
        # 3: the same type, 2: it fits by widening or boxing, 1: one of the two isn't known to differ, -8: it can't fit.
        fits = lambda t, p: F.when(t.isNull(), 1).when(t == "null", F.when(boxed[simple(p)].isNotNull(), -8).otherwise(2)).when(simple(t) == simple(p), 3).when((plain(t) == plain(p)) | F.coalesce(F.array_contains(wide[simple(t)], simple(p)), F.lit(False)), 2).when(boxed[simple(t)].isNotNull() & boxed[simple(p)].isNotNull(), -8).when(
            boxed[simple(t)].isNotNull() | boxed[simple(p)].isNotNull(), F.when(plain(p) == "Object", 1).otherwise(-8)).when((simple(t) == "String") & ~simple(p).isin("Object", "CharSequence", "Comparable"), F.when(F.length(simple(p)) == 1, 1).otherwise(-8)).otherwise(1)
        kind_at = lambda m, i: F.get(m["kinds"], F.least(i, m["arity"] - 1))
        fit = lambda m: F.aggregate(F.transform("types", lambda t, i: fits(t, kind_at(m, i))), F.lit(0), lambda a, x: a + x)
        score = lambda m: F.when(m["arity"] == n, F.when(n == 0, 1000).otherwise(1000 + fit(m))).when(m["varargs"] & (n >= m["arity"] - 1), 500 + fit(m)).otherwise(-1000 - F.abs(m["arity"] - n))
        scored = c.withColumn("_scores", F.transform("near.all", score)).withColumn("_top", F.array_max("_scores"))
        kept = F.filter(F.arrays_zip(F.col("near.all").alias("m"), F.col("_scores").alias("score")), lambda x: x["score"] == F.col("_top"))
        targets = F.transform(kept, lambda x: F.struct(x["m"]["_name"].alias("name"), x["m"]["signature"].alias("signature")))
        scored = scored.withColumns({"targets": F.coalesce(targets, F.array().cast("array<struct<name:string,signature:string>>")), "returns": F.get(F.transform(kept, lambda x: x["m"]["returns"]), F.lit(0)), "callee": F.coalesce("near.owner", "static_type")})
        return scored.drop("_scores", "_top", "near")

    def _linked(self, calls: DataFrame, types: DataFrame) -> DataFrame:
        """calls with their targets. A chained call is made on what its receiver returns: each round goes one link further along
        all chains."""
        none = F.array().cast("array<string>")
        calls = stored(calls.join(types, "call_id", "left").withColumn("types", F.coalesce("types", none)), "calls")
        rest = calls.where("receiver_call_id is not null")
        last = done = stored(self._targets(calls.where("receiver_call_id is null")), "links")
        left, linked = rest.count(), 1
        while left and linked:
            up = last.select(F.col("call_id").alias("receiver_call_id"), F.coalesce(F.when(F.col("is_new"), F.col("static_type")), "returns").alias("_type"))
            kind = F.regexp_replace(F.coalesce("_type", F.lit("void")), r"(?s)<.*>", "")
            met = rest.join(up, "receiver_call_id").withColumn("static_type", F.when(kind.isin("void", ""), F.lit("unknown")).otherwise(kind)).drop("_type")
            last = stored(self._targets(met.select(*calls.columns)), "links")
            linked = last.count()
            left, done = left - linked, done.unionByName(last)
        return done

    @property
    def methods(self) -> DataFrame:
        return self.methods_.drop("arguments", "head", "ord")

    @property
    def calls(self) -> DataFrame:
        return self.calls_

    @property
    def fragments(self) -> DataFrame:
        return self.fragments_

    @property
    def annotation_uses(self) -> DataFrame:
        """Uses on types and methods. They are found where literals are blanked, and read, with their arguments, from the same place
        of the segment's own text."""
        t = self.types.select("file", "ord", F.when(F.col("class_type") == "Interface", "Interface").otherwise("Class").alias("target_type"), F.col("class_fqn").alias("target_fqn"))
        m = self.methods_.select("file", "ord", F.lit("Method").alias("target_type"), F.col("full_name").alias("target_fqn"))
        rows = self.rows.where("raw like '%@%'").select("file", "ord", "line", "raw", "own").join(t.unionByName(m), ["file", "ord"])
        keep = ("file", "target_type", "target_fqn", "line", "raw", "own")
        uses = matches(rows, "raw", _ANNOTATION, 0, *keep).where("whole not like '@interface%'")
        breaks = lambda x: F.regexp_count(x, F.lit("\n"))
        lead = F.regexp_extract("raw", r"^\s*", 0)
        start = (F.col("line") + breaks(F.col("before")) - F.when(F.length(lead) <= F.length("before"), breaks(lead)).otherwise(breaks(F.col("before")))).cast("int")
        uses = uses.withColumn("use", F.substring(F.col("own"), F.col("at") + 1, F.length("whole"))).withColumn("start_line", start)
        # Arguments are cut at the commas of the blanked text, which stand at the same places.
        inside = F.regexp_extract("whole", r"(?s)^@[\w.]+\s*\((.*)\)$", 1)
        uses = uses.withColumn("_in", inside).withColumn("_at", F.locate("(", F.col("whole")))
        pieces = F.split("_in", r",(?![^\[(]*[)\]])", -1)
        cut = F.aggregate(pieces, F.struct((F.col("_at") + 1).alias("p"), F.array().cast("array<string>").alias("out")), lambda a, x: F.struct((a["p"] + F.length(x) + 1).alias("p"), F.concat(a["out"], F.array(F.trim(F.substring(F.col("use"), a["p"], F.length(x))))).alias("out")))["out"]
        named = r"(?s)^([A-Za-z_$][\w$]*)\s*=(?!=)\s*(.*)$"
        value = lambda x: F.when(x.rlike(named), F.regexp_extract(x, named, 2)).otherwise(x)
        kind = lambda v: F.when(v.rlike(r'^"'), "string").when(v.rlike(r"\.class$"), "type").when(v.rlike(r"^-?[0-9][\w.]*$"), "number").when(v.isin("true", "false"), "boolean").otherwise("expression")
        plain = lambda v: F.when(v.rlike(r'(?s)^"(?:\\.|[^"\\])*"$'), F.regexp_extract(v, r'(?s)^"(.*)"$', 1)).when(v.rlike(r"\.class$"), F.regexp_replace(v, r"\.class$", "")).otherwise(v)
        params = F.transform(F.filter(cut, lambda x: x != ""), lambda x: F.struct(F.when(x.rlike(named), F.regexp_extract(x, named, 1)).otherwise(F.lit("value")).alias("name"), plain(value(x)).alias("value"), kind(value(x)).alias("kind")))
        name = F.regexp_extract("use", _ANNOTATION, 1)
        return uses.select("file", "target_type", "target_fqn", name.alias("name"), F.substring_index(name, ".", -1).alias("simple_name"), params.alias("params"), "start_line", (F.col("start_line") + breaks(F.col("whole"))).cast("int").alias("end_line"))

    def method_at(self, places: DataFrame) -> DataFrame:
        """places: (file, line). The innermost method around each, if any: (file, line, full_name)."""
        m = self.methods.select("file", "full_name", "start_line", "end_line")
        met = places.select("file", "line").distinct().join(m, "file").where("line between start_line and end_line")
        return met.groupBy("file", "line").agg(F.max_by("full_name", F.struct("start_line", "full_name")).alias("full_name"))

    def first_methods(self) -> DataFrame:
        """(class_fqn, name, full_name, signature, start_line): the first overload of each name."""
        m = self.methods
        return m.groupBy("class_fqn", "name").agg(F.min_by(F.struct("full_name", "signature", "start_line"), "ordinal").alias("x")).select("class_fqn", "name", "x.*")


def label(var: str, instance: str, kind: str) -> F.Column:
    """`var:instance:type`; what is null is left out."""
    return F.concat_ws(":", F.col(var), F.col(instance), F.col(kind))


def fragment_label() -> F.Column:
    """`method: type (condition)`; without a condition no parentheses."""
    cond = F.when(F.coalesce("condition", F.lit("")) != "", F.concat(F.lit(" ("), F.col("condition"), F.lit(")"))).otherwise(F.lit(""))
    return F.concat(F.substring_index("method_full_name", ".", -1), F.lit(": "), F.lower("type"), cond)


def composed_name(package, name) -> F.Column:
    """A dotted name is a full one; any other belongs to the package, if there is one."""
    package, name = (F.col(x) if isinstance(x, str) else x for x in (package, name))
    return F.when(name.contains("."), name).otherwise(F.concat_ws(".", F.nullif(package, F.lit("")), name))


def trace_calls(parsed: Parsed) -> DataFrame:
    """(caller, callee, ordinal, arguments, assigned_to, line, parent_fragment_id, region, call_id, receiver_call_id) for a trace."""
    c = parsed.calls
    others = ("arguments", "assigned_to", "line", "parent_fragment_id", "region", "call_id", "receiver_call_id")
    return c.select(F.col("method_full_name").alias("caller"), F.concat_ws(".", "callee", "method_name").alias("callee"), F.col("seq").alias("ordinal"), *others)
