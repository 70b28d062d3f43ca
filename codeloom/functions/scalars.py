"""Scalar rules of the data model as column expressions; all stay inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Method names that a call graph leaves out.
OBJECT_METHODS = ["toString", "equals", "hashCode", "clone", "finalize", "getClass", "notify", "notifyAll", "wait"]
LIFECYCLE_METHODS = ["main", "run", "start", "stop", "destroy", "dispose", "close", "open", "load", "validate", "process", "handle", "execute"]
CONSTRUCTOR_NAMES = ["init", "<init>", "<clinit>"]


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def blank(x) -> Column:
    x = _col(x)
    return x.isNull() | (F.trim(x) == "")


def or_default(x, default) -> Column:
    """x, or the default where x is null or empty."""
    x = _col(x)
    return F.when(x.isNull() | (x == ""), F.lit(default)).otherwise(x)


def without_generics(fqn) -> Column:
    return F.regexp_replace(_col(fqn), r"(?s)<.*", "")


def strip_type_arguments(fqn) -> Column:
    """Drops from the first `<` to the last `>`, as lookups do."""
    return F.regexp_replace(_col(fqn), r"(?s)<.*>", "")


def simple_name(fqn) -> Column:
    return F.substring_index(without_generics(fqn), ".", -1)


def package_of(fqn) -> Column:
    return F.regexp_extract(without_generics(fqn), r"(?s)^(.*)\.[^.]*$", 1)


def _type_id(prefix: str, fqn) -> Column:
    package = F.replace(package_of(fqn), F.lit("."), F.lit("_"))
    name = F.when(package == "", simple_name(fqn)).otherwise(F.concat_ws("_", package, simple_name(fqn)))
    return F.concat(F.lit(prefix + "_"), F.when(_col(fqn).isNull() | (_col(fqn) == ""), F.lit("unknown")).otherwise(name))


def class_id(fqn) -> Column:
    return _type_id("class", fqn)


def interface_id(fqn) -> Column:
    return _type_id("interface", fqn)


def method_id(name, class_name) -> Column:
    return F.concat_ws("_", F.lit("method"), or_default(class_name, "Unknown"), or_default(name, "unknown"))


def annotation_id(name, target_type) -> Column:
    return F.concat_ws("_", F.lit("annotation"), or_default(target_type, "Unknown"), or_default(name, "unknown"))


def id_type(node_id) -> Column:
    return F.substring_index(_col(node_id), "_", 1)


def class_of_method(fqn) -> Column:
    """What stands before the last dot ahead of the parenthesis; empty without a parenthesis."""
    return F.regexp_extract(_col(fqn), r"^([^(]*)\.[^.(]*\(", 1)


def signature_of_method(fqn) -> Column:
    return F.regexp_extract(_col(fqn), r"^(?:[^(]*\.)?([^.(]*\(.*)$", 1)


def method_fqn(callee, name) -> Column:
    return F.concat(_col(callee), F.lit("."), _col(name), F.lit("()"))


def safe_id(x) -> Column:
    """An id that a diagram accepts: dots become `_`, brackets go, commas become `__`."""
    return F.replace(F.regexp_replace(F.replace(_col(x), F.lit("."), F.lit("_")), r"[()<>]", ""), F.lit(","), F.lit("__"))


def is_constructor_like(name, class_name) -> Column:
    n = F.trim(_col(name))
    return ~blank(name) & (n.contains("Constructor") | n.isin(CONSTRUCTOR_NAMES) | F.coalesce(n == _col(class_name), F.lit(False)))


def is_getter(name) -> Column:
    return F.coalesce(F.trim(_col(name)).rlike(r"(?s)^(get|is|has)."), F.lit(False))


def is_setter(name) -> Column:
    return F.coalesce(F.trim(_col(name)).rlike(r"(?s)^set."), F.lit(False))


def is_standard(name) -> Column:
    return F.coalesce(_col(name).isin(OBJECT_METHODS + LIFECYCLE_METHODS), F.lit(False))


def property_of_accessor(name) -> Column:
    """What follows get, set, has or is; each prefix by its own length."""
    return F.regexp_extract(F.trim(_col(name)), r"(?s)^(?:get|set|has|is)(.+)$", 1)


def starts_with_any(x, prefixes: list[str]) -> Column:
    """Whether x starts with one of the prefixes; an empty list means any."""
    if not prefixes:
        return F.lit(True)
    found = F.lit(False)
    for p in prefixes:
        found = found | F.startswith(_col(x), F.lit(p))
    return F.coalesce(found, F.lit(False))


def excluded(class_fqn, method, prefixes: list[str], names: list[str]) -> Column:
    by_class = starts_with_any(class_fqn, prefixes) if prefixes else F.lit(False)
    by_name = F.coalesce(_col(method).isin(names), F.lit(False)) if names else F.lit(False)
    return by_class | by_name


def pieces(x) -> Column:
    """Number of lines where empty lines at the end don't count: 1 for '', 0 for text made of newlines only."""
    x = _col(x)
    cut = F.regexp_replace(x, r"\n+$", "")
    return F.when(x == "", 1).when(cut == "", 0).otherwise(F.size(F.split(cut, "\n", -1)))


def line_of_offset(x, offset) -> Column:
    """The line in which the 0-based character offset of x lies, by the rule of `pieces`."""
    return pieces(F.substring(_col(x), F.lit(1), _col(offset)))


def simplified_argument(x) -> Column:
    """Qualifiers and a trailing () go; getName becomes name."""
    cut = F.regexp_replace(F.regexp_replace(_col(x), r"\b[A-Za-z_$][A-Za-z0-9_$]*\.", ""), r"\(\)$", "")
    rest = F.regexp_extract(cut, r"^get([A-Z][A-Za-z0-9_$]*)$", 1)
    return F.when(rest != "", F.concat(F.lower(F.substring(rest, 1, 1)), F.substring(rest, 2, 1_000_000))).otherwise(cut)


def safe_value(x) -> Column:
    return F.regexp_replace(_col(x), "[&;]", "_")


def parameter_text(params) -> Column:
    """An array of (name, value) as `name=value`."""
    return F.transform(_col(params), lambda p: F.concat_ws("=", p["name"], p["value"]))


def annotation_text(simple, params) -> Column:
    inner = F.array_join(parameter_text(params), ", ")
    return F.concat(F.lit("@"), _col(simple), F.when(F.size(_col(params)) > 0, F.concat(F.lit("("), inner, F.lit(")"))).otherwise(F.lit("")))
