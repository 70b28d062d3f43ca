"""Java text as marks, segments and call sites, by windows over the marks of a file.

A file's comments are blanked, and the text is cut into marks: brackets, commas, semicolons, literals, annotation names, control
words, and names that stand before a parenthesis. A running sum over opening and closing brackets gives each mark its level; the
bracket it lies in is the last opener of that level. So every parenthesis knows its end, its commas and what stands before it,
however calls are nested.

Segments end at a brace, at a semicolon outside of parentheses, at the end of a control head (its parenthesis, `else` or `do`)
that no brace follows, or where the annotation-free text ends. A fold over the segments of a file, a few bits each, finds what
each is inside of, and where the one statement after a head without a brace ends: there the head's scope closes, and those of the
heads around it, down to the `if` that a following `else` belongs to.

Defined results: null and empty texts have no rows; unbalanced brackets leave what follows at the level they lead to.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Words that look like calls or types and are none.
KEYWORDS = ["if", "for", "while", "switch", "catch", "return", "new", "synchronized", "try", "super", "this", "throw", "assert", "else", "do", "instanceof", "case", "default", "finally"]
HEADS = ["if", "for", "while"]
_NAME = r"[A-Za-z_$][\w$]*"
_COMMENT = r"""(?s)/\*.*?\*/|//[^\n]*|\"\"\".*?\"\"\"|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'"""
_GENERIC = r"<(?:[\w$.?,\s\[\]]|<(?:[\w$.?,\s\[\]]|<[\w$.?,\s\[\]]*>)*>)*>"
_MARK = (
    r"""(?s)\"\"\".*?\"\"\"|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|[(){};,]|@(?!interface\b)[A-Za-z_][\w.]*"""
    rf"|\bnew\s+[\w$.]+(?:\s*{_GENERIC})?(?=\s*\()|{_GENERIC}|\b(?:if|for|while|else|do)\b|(?<![\w$]){_NAME}(?=\s*\()"
)
#: Bits of a segment for the fold.
OPENS, CLOSES, BARE, IS_IF, IS_ELSE, GOES_ON, IS_TYPE, IS_METHOD, IS_CONSTRUCTOR, IS_CONTROL = (1 << k for k in range(10))
KINDS = ["statement", "closing", "block", "type", "method", "fragment"]
_FOLDED = ",".join(f"{c}:array<int>" for c in ("parent", "close", "owner", "method", "fragment", "kind", "closes"))


def blanked(x: Column) -> Column:
    return F.regexp_replace(x, r"[^\n]", " ")


def without_comments(content: Column) -> Column:
    """The text with its comments blanked; lengths and lines stay."""
    parts, found = F.split(content, _COMMENT, -1), F.regexp_extract_all(content, F.lit(_COMMENT), F.lit(0))
    clean = F.transform(found, lambda x: F.when(x.startswith("/"), blanked(x)).otherwise(x))
    return F.array_join(F.zip_with(parts, clean, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def _blank(x: Column) -> Column:
    return F.coalesce(F.trim(F.translate(x, "\n\r\t", "   ")), F.lit("")) == ""


def marks(files: DataFrame) -> DataFrame:
    """files: (path, content). (file, ord, gap, mark, at, level, key, role, in_key, in_role, seg, cut, ...): the text before a mark and the
    mark, its 0-based offset, the opener it lies in or is (key), and what stands before that one (role: a control word, `call`,
    `annotation` or null); cut: what it ends as a segment's last mark."""
    text = files.where(F.coalesce("content", F.lit("")) != "").select(F.col("path").alias("file"), without_comments(F.col("content")).alias("_t"))
    both = F.arrays_zip(F.split("_t", _MARK, -1).alias("gap"), F.regexp_extract_all("_t", F.lit(_MARK), F.lit(0)).alias("mark"))
    m = text.select("file", F.posexplode(both).alias("ord", "_x")).select("file", "ord", F.col("_x.gap").alias("gap"), F.col("_x.mark").alias("mark")).where("mark is not null")
    w = W.partitionBy("file").orderBy("ord")
    before = w.rowsBetween(W.unboundedPreceding, -1)
    total = lambda x: F.coalesce(F.sum(x).over(before), F.lit(0))
    opens, mark = F.col("mark").isin("(", "{"), F.col("mark")
    step = F.when(opens, 1).when(mark.isin(")", "}"), -1).otherwise(0)
    m = m.withColumns({
        "at": (total(F.length("gap") + F.length("mark")) + F.length("gap")).cast("int"), "level": (total(step) + F.when(opens, 1).otherwise(0)).cast("int"),
        "p1": F.lag("mark", 1).over(w), "p2": F.lag("mark", 2).over(w), "p3": F.lag("mark", 3).over(w), "g1": F.lag("gap", 1).over(w), "g2": F.lag("gap", 2).over(w), "next": F.lead("mark").over(w), "next_gap": F.lead("gap").over(w),
    })
    named = F.col("p1").rlike(rf"^(?:new\s|{_NAME}$)") & ~F.col("p1").isin("else", "do")
    role = F.when((mark == "(") & _blank(F.col("gap")), F.when(F.col("p1").startswith("@"), "annotation").when(F.col("p1").isin(HEADS), F.col("p1")).when(named & ~F.col("p1").isin(KEYWORDS), "call"))
    scope = W.partitionBy("file", "level").orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    m = m.withColumn("role", role)
    m = m.withColumn("_open", F.last(F.when(opens, F.struct("ord", "mark", "role")), ignorenulls=True).over(scope))
    m = m.withColumns({"key": F.col("_open.ord"), "in_mark": F.col("_open.mark"), "in_role": F.col("_open.role")}).drop("_open")
    # What lies in an annotation's parentheses cuts nothing.
    inside = total(F.when((mark == "(") & (F.col("role") == "annotation"), 1).when((mark == ")") & (F.col("in_role") == "annotation"), -1).otherwise(0))
    m = m.withColumns({"k1": F.lag("key", 1).over(w), "k2": F.lag("key", 2).over(w), "k3": F.lag("key", 3).over(w), "_inside": inside, "role2": F.lag("in_role", 2).over(w), "role3": F.lag("in_role", 3).over(w)})
    follows = lambda *x: F.coalesce(_blank(F.col("next_gap")) & F.col("next").isin(*x), F.lit(False))
    done_while = (F.col("in_role") == "while") & follows(";")
    cut = F.when(F.col("_inside") > 0, None).when(mark.isin("{", "}"), mark).when((mark == ";") & ~F.coalesce(F.col("in_mark") == "(", F.lit(False)), mark)
    cut = cut.when((mark == ")") & F.col("in_role").isin(HEADS) & ~follows("{") & ~done_while, "h").when((mark == "else") & ~follows("{", "if"), "h").when((mark == "do") & ~follows("{"), "h")
    m = m.withColumn("cut", cut).drop("_inside")
    return m.withColumn("seg", F.count("cut").over(before).cast("int"))


def _folded(flags: pd.Series, names: pd.Series) -> pd.DataFrame:
    """For each segment of each file: its opener, the segment that closes it, the type, method and fragment around it (-1: none), its
    kind, and how many scopes end after it."""
    out = []
    for bits, called in zip(flags, names):
        n = len(bits)
        parent, close, owner, method, fragment, kind, closes = ([-1] * n, [*range(n)], [-1] * n, [-1] * n, [-1] * n, [0] * n, [0] * n)
        stack: list[int] = []  # open scopes, by the segment that opened each
        for i in range(n):
            b = int(bits[i])
            up = stack[-1] if stack else -1
            parent[i] = up
            if up >= 0:
                owner[i] = up if kind[up] == 3 else owner[up]
                method[i] = up if kind[up] == 4 else method[up]
                fragment[i] = up if kind[up] == 5 else fragment[up]
            in_type = up >= 0 and kind[up] == 3
            if in_type and not b & (IS_TYPE | CLOSES) and (b & IS_METHOD or (b & IS_CONSTRUCTOR and called[i] == called[up])):
                kind[i] = 4
            elif b & IS_TYPE:
                kind[i] = 3
            elif b & (OPENS | BARE):
                kind[i] = 5 if b & IS_CONTROL else 2
            elif b & CLOSES:
                kind[i] = 1
            if b & (OPENS | BARE):
                stack.append(i)
                continue
            ended_if = False
            if b & CLOSES:
                while stack and bits[stack[-1]] & BARE:  # a head whose statement is missing
                    close[stack.pop()] = i
                if stack:
                    top = stack.pop()
                    close[top] = i
                    closes[i] += 1
                    ended_if = bool(bits[top] & IS_IF)
            following = int(bits[i + 1]) if i + 1 < n else 0
            if following & GOES_ON:
                continue
            while stack and bits[stack[-1]] & BARE and not (ended_if and following & IS_ELSE):
                top = stack.pop()
                close[top] = i
                closes[i] += 1
                ended_if = bool(bits[top] & IS_IF)
        for top in stack:
            close[top] = n - 1
        out.append((parent, close, owner, method, fragment, kind, closes))
    return pd.DataFrame(out, columns=[x.split(":")[0] for x in _FOLDED.split(",")])


def segments(m: DataFrame, bits: Column, name: Column) -> DataFrame:
    """m: marks. bits and name: of a segment's `head` and `end`, for the fold. (file, ord, head, raw, own, end, at, line, last_line, parent,
    close, owner, method, fragment, kind, name, depth): raw has the insides of literals blanked, own has not; head is raw without
    white space around it; line is where it begins, end_line where the segment ends that closes it."""
    literal = F.col("mark").startswith('"') | F.col("mark").startswith("'")
    masked = F.when(literal, F.concat(F.substring("mark", 1, 1), blanked(F.expr("substring(mark, 2, length(mark) - 2)")), F.substring("mark", 1, 1)))
    masked = masked.when(F.col("mark").startswith("@") | ~F.col("mark").isin("{", "}", ";"), F.col("mark")).otherwise(F.when(F.col("cut").isNull(), F.translate("mark", "{};", "[],")).otherwise(F.col("mark")))
    pieces = m.select("file", "seg", "ord", "cut", (F.col("at") - F.length("gap")).alias("_from"), F.concat("gap", masked).alias("_raw"), F.concat("gap", "mark").alias("_own"))
    text = lambda c: F.array_join(F.transform("_p", lambda x: x[c]), "")
    s = pieces.groupBy("file", F.col("seg").alias("ord")).agg(F.max("cut").alias("end"), F.min("_from").alias("at"), F.sort_array(F.collect_list(F.struct("ord", "_raw", "_own"))).alias("_p")).where("end is not null")
    s = s.select("file", "ord", "end", "at", text("_raw").alias("raw"), text("_own").alias("own"))
    cut = lambda c: F.when(F.col("end") == "h", F.col(c)).otherwise(F.expr(f"substring({c}, 1, length({c}) - 1)"))
    s = s.withColumns({"raw": cut("raw"), "own": cut("own")}).withColumn("head", F.regexp_replace("raw", r"^\s+|\s+$", ""))
    breaks = lambda c: F.regexp_count(c, F.lit("\n"))
    w = W.partitionBy("file").orderBy("ord").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(breaks("raw")).over(w), F.lit(0)) + 1
    s = s.withColumns({"line": (start + breaks(F.regexp_extract("raw", r"^\s*", 0))).cast("int"), "last_line": (start + breaks("raw")).cast("int"), "bits": bits, "name": name})
    columns = ["ord", "end", "at", "raw", "own", "head", "line", "last_line", "name"]
    each = s.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("ord", "bits", *columns[1:]))).alias("s"))
    folded = F.pandas_udf(_folded, f"struct<{_FOLDED}>")
    each = each.withColumn("f", folded(F.transform("s", lambda x: x["bits"]), F.transform("s", lambda x: F.coalesce(x["name"], F.lit("")))))
    got = lambda c, i: F.nullif(F.get(F.col(f"f.{c}"), i), F.lit(-1))
    rows = F.transform("s", lambda x, i: F.struct(
        *(x[c].alias(c) for c in columns), *(got(c, i).alias(c) for c in ("parent", "close", "owner", "method", "fragment")), F.get(F.col("f.kind"), i).alias("kind"), F.get(F.col("f.closes"), i).alias("closes"),
        F.get(F.col("s"), F.get(F.col("f.close"), i))["last_line"].alias("end_line"), F.get(F.transform("s", lambda y: y["name"]), F.get(F.col("f.parent"), i)).alias("_up"),
    ))
    out = each.select("file", F.inline(rows))
    opener = F.when(F.col("end").isin("{", "h"), 1).otherwise(0) - F.col("closes")
    out = out.withColumn("depth", F.coalesce(F.sum(opener).over(w), F.lit(0)).cast("int")).withColumn("kind", F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1))
    return out.withColumn("end_line", F.when(F.col("end").isin("{", "h"), F.col("end_line")).otherwise(F.col("line"))).drop("_up", "closes")


def call_sites(m: DataFrame, segs: DataFrame) -> DataFrame:
    """(file, key, seg, name, is_new, receiver, receiver_key, foreign, name_at, arguments) of each name before a parenthesis. receiver: the
    names before it; receiver_key: the call whose result it is called on; foreign: it is called on some other expression."""
    parens = m.where("in_role = 'call' and mark in ('(', ')', ',')")
    generic = F.col("p2").startswith("<")
    gap, prev = F.when(generic, F.col("g2")).otherwise(F.col("g1")), F.when(generic, F.col("p3")).otherwise(F.col("p2"))
    info = F.struct(
        F.col("p1").alias("name"), gap.alias("gap"), prev.alias("prev"), F.when(generic, F.col("k3")).otherwise(F.col("k2")).alias("prev_key"), F.when(generic, F.col("role3")).otherwise(F.col("role2")).alias("prev_role"),
        (F.col("at") - F.length("gap") - F.length("p1")).alias("name_at"), F.col("at").alias("open_at"), F.col("seg").alias("seg"),
    )
    c = parens.groupBy("file", "key").agg(
        F.max(F.when(F.col("mark") == "(", info)).alias("x"), F.max(F.when(F.col("mark") == ")", F.col("at"))).alias("close_at"),
        F.sort_array(F.collect_list(F.when(F.col("mark") == ",", F.col("at")))).alias("commas"),
    ).select("file", "key", "x.*", "close_at", "commas").where("name is not null")
    is_new = F.col("name").rlike(r"^new\s")
    dot = F.col("gap").rlike(r"\.\s*$")
    chain = F.regexp_replace(F.regexp_extract("gap", rf"((?:{_NAME}(?:\s*\[[^\[\]]*\])*\s*\.\s*)+)$", 1), r"\s+|\.\s*$", "")
    after_dot = F.col("gap").rlike(r"^\s*\.")
    of_call = F.coalesce((F.trim("gap") == ".") & (F.col("prev") == ")") & (F.col("prev_role") == "call"), F.lit(False))
    c = c.withColumns({
        "is_new": is_new, "receiver": F.when(~is_new & (chain != "") & ~after_dot, chain), "receiver_key": F.when(~is_new & of_call, F.col("prev_key")),
        "foreign": F.coalesce(~is_new & dot & ~of_call & ((chain == "") | after_dot), F.lit(False)), "literal": F.coalesce(F.col("prev").startswith('"') & (F.trim("gap") == "."), F.lit(False)),
    })
    t = segs.select("file", F.col("ord").alias("seg"), F.col("at").alias("seg_at"), "own")
    c = c.join(t, ["file", "seg"])
    starts, ends = F.concat(F.array("open_at"), "commas"), F.concat("commas", F.array(F.coalesce("close_at", F.col("seg_at") + F.length("own"))))
    arguments = F.zip_with(starts, ends, lambda a, b: F.trim(F.regexp_replace(F.substring(F.col("own"), a + 2 - F.col("seg_at"), b - a - 1), r"\s*\n\s*", " ")))
    name = F.regexp_replace(F.regexp_replace("name", r"^new\s+", ""), r"(?s)\s*<.*>$", "")
    return c.select("file", "key", "seg", name.alias("name"), "is_new", "receiver", "receiver_key", "foreign", "literal", "name_at", (F.col("name_at") - F.col("seg_at")).alias("in_seg"), F.filter(arguments, lambda x: x != "").alias("arguments"))
