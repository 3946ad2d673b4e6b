"""Column functions over paths, class names and method names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def norm_path(path: Column) -> Column:
    """Lower case with forward slashes."""
    return F.lower(F.translate(path, "\\", "/"))


def layer(path: Column) -> Column:
    """The layer of highest priority that the path names as a directory, or as its last part; else ``other``."""
    p = norm_path(path)
    out = F
    for name in fixed.LAYER_PRIORITY:
        hit = p.contains(f"/{name}/") | p.endswith(f"/{name}") | p.endswith(f"/{name}.java")
        out = out.when(hit, name)
    return F.coalesce(out.otherwise("other"), F.lit("other"))


def layer_priority(name: Column) -> Column:
    out = F
    for k, v in fixed.LAYER_PRIORITY.items():
        out = out.when(name == k, v)
    return out.otherwise(fixed.OTHER_PRIORITY)


def dirs(path: Column) -> Column:
    """Directory segments of a path, the file name left out."""
    parts = F.split(F.translate(path, "\\", "/"), "/")
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def domain(path: Column) -> Column:
    """The last directory that isn't a known layer or build name, lower case; else ``other``."""
    parts = F.filter(F.transform(dirs(path), F.lower), lambda x: ~x.isin(*fixed.DOMAIN_SKIP) & ~x.endswith(".java"))
    return F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit("other"))


def coarse_bucket(path: Column, cls: Column) -> Column:
    """ui, db, bl or other: directories decide before the class name does."""
    p, c = norm_path(F.coalesce(path, F.lit(""))), F.lower(F.coalesce(cls, F.lit("")))
    out = F
    for bucket, names in fixed.BUCKET_PATHS.items():
        out = out.when(_any([p.contains(f"/{n}/") for n in names]), bucket)
    for bucket, names in fixed.BUCKET_ENDS.items():
        out = out.when(_any([c.endswith(n) for n in names] + [c.startswith(n) for n in fixed.BUCKET_BEGINS[bucket]]), bucket)
    return out.otherwise("other")


def prefix_layer(cls: Column) -> Column:
    """The layer that a class name's beginning stands for."""
    c = F.upper(cls)
    named = F.when(cls.isNull() | (cls == ""), "unknown")
    for p in ("BL", "UI", "DB", "DTO", "VO", "ENTITY", "EN"):
        named = named.when(c.startswith(p), "EN" if p == "ENTITY" else p)
    return named.otherwise("Util/Other")


def is_util(cls: Column) -> Column:
    return F.lower(F.coalesce(cls, F.lit(""))).rlike("util|helper|common")


def write_category(name: Column) -> Column:
    """Category of an unresolved callee as it's stored when linking."""
    return F.when(name.isin(*fixed.JDK_METHODS), "jdk_unknown").otherwise("business_unknown")


def unknown_category(stored: Column, callee: Column, caller_class: Column) -> Column:
    """The five actionable categories, in order of precedence.

    A stored category of the five stands; ``jdk_unknown`` is jdk_core. The JDK list
    is compared with the lower-cased name, so that only its all-lower-case names match.
    """
    raw, name, cls = (F.lower(F.trim(F.coalesce(x, F.lit("")))) for x in (stored, callee, caller_class))
    return (
        F.when(raw.isin(*fixed.UNKNOWN_CATEGORIES), raw)
        .when((raw == "jdk_unknown") | name.isin(*fixed.JDK_METHODS), "jdk_core")
        .when(name.rlike("|".join(fixed.INFRA_MARKERS)), "infra_framework")
        .when(name.rlike("|".join(fixed.THIRD_PARTY_MARKERS)), "third_party_lib")
        .when(name.rlike("|".join(fixed.SHARED_MARKERS)) | cls.rlike("|".join(fixed.SHARED_CLASS_MARKERS)), "internal_shared_lib_missing")
        .otherwise("true_unresolved")
    )


def role_bonus(cls: Column) -> Column:
    c = F.lower(F.coalesce(cls, F.lit("")))
    out = F
    for marks, bonus in fixed.ROLE_BONUS:
        out = out.when(c.rlike("|".join(marks)), bonus)
    return out.otherwise(0)


def path_overlap(a: Column, b: Column) -> Column:
    """How many leading directories two paths share."""
    x, y = dirs(a), dirs(b)
    n = F.least(F.size(x), F.size(y))
    first = F.array_min(F.filter(F.transform(F.zip_with(x, y, lambda p, q: p != q), lambda d, i: F.when(d | (i >= n), i)), lambda i: i.isNotNull()))
    return F.when(n <= 0, 0).otherwise(F.least(F.coalesce(first, n), n))


def type_name(name: Column) -> Column:
    """Last dotted part of a type, generics cut; ``Object`` if there's nothing."""
    last = F.element_at(F.split(F.trim(F.coalesce(name, F.lit(""))), r"\."), -1)
    return F.coalesce(F.nullif(F.trim(F.substring_index(last, "<", 1)), F.lit("")), F.lit("Object"))


def method_key(cls: Column, name: Column) -> Column:
    return F.trim(F.concat_ws(".", cls, name), F.lit("."))


def chunk_id(path: Column, cls: Column, name: Column) -> Column:
    return F.concat_ws("::", F.regexp_replace(path, r"\\", "/"), cls, name)


def class_and_method(text: Column) -> tuple[Column, Column]:
    """Split ``C.m`` at the first dot; without a dot the whole is the method."""
    at = F.instr(text, ".")
    return F.when(at > 0, F.substring(text, F.lit(1), at - 1)), F.when(at > 0, F.substring(text, at + 1, F.length(text))).otherwise(text)


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where there's nothing to divide by."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def stereotype_flags(annotations: Column, beans: tuple[str, ...] = fixed.BEAN_ANNOTATIONS, mappers: tuple[str, ...] = fixed.MAPPER_ANNOTATIONS) -> tuple[Column, Column]:
    """(is_mapper, is_service) of a class with these annotations."""
    has = lambda names: F.coalesce(F.arrays_overlap(annotations, F.array(*map(F.lit, names))), F.lit(False))
    return has(mappers), has([x for x in beans if x != "Bean"])
