"""Path functions as Column expressions (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Supported source extensions and the resolver's candidate
# orders (extensions tried by importer language, then index files).
SUPPORTED_EXTS = [".py", ".js", ".jsx", ".mjs", ".ts", ".tsx"]
JS_EXTS = [".js", ".jsx", ".mjs", ".ts", ".tsx"]
TS_EXTS = [".ts", ".tsx", ".js", ".jsx", ".mjs"]
JS_INDEX = ["/index.js", "/index.jsx", "/index.ts", "/index.tsx"]
PY_INDEX = "/__init__.py"


def extension_of(path: Column) -> Column:
    """Lower-cased extension including the dot ('' if none)."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def language_of(path: Column) -> Column:
    """python / typescript / javascript (anything else reads as javascript)."""
    ext = extension_of(path)
    return (F.when(ext == ".py", F.lit("python"))
            .when(ext.isin(".ts", ".tsx"), F.lit("typescript"))
            .otherwise(F.lit("javascript")))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """Everything before the last '/', '' for a bare name."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def parent_n(path: Column, n: Column) -> Column:
    """Drop the last ``n`` segments (``n`` may be 0)."""
    parts = F.split(path, "/")
    keep = F.greatest(F.size(parts) - n, F.lit(0))
    return F.when(keep > 0, F.array_join(F.slice(parts, F.lit(1), keep), "/")).otherwise(F.lit(""))


def normpath(path: Column) -> Column:
    """Fold '.' and '..' segments like ``os.path.normpath`` on relative
    paths: leading '..' that climb above the start are kept."""
    parts = F.split(path, "/")
    empty = F.array().cast("array<string>")
    folded = F.aggregate(
        parts, empty,
        lambda acc, x: F.when((x == "..") & (F.size(acc) > 0) & (F.element_at(acc, -1) != ".."),
                              F.slice(acc, F.lit(1), F.size(acc) - 1))
        .when((x == ".") | (x == ""), acc)
        .otherwise(F.concat(acc, F.array(x))))
    joined = F.array_join(folded, "/")
    absolute = F.startswith(path, F.lit("/"))
    return F.when(absolute, F.concat(F.lit("/"), joined)).otherwise(
        F.when(joined == "", F.lit(".")).otherwise(joined))


def join_path(base: Column, rel: Column) -> Column:
    return F.when(base == "", rel).otherwise(F.concat(base, F.lit("/"), rel))
