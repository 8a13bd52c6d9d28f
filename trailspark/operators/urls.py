"""Event names from URLs by a tree of paths, with built-in functions only."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ParameterError
from ..schema import StreamSchema

#: Fixed value: a language tag as first segment of a path.
LOCALE = r"^[a-z]{2}(-[a-z]{2,4})*$"
NODE_KEYS = {"path", "aggregate_children", "name", "exclude"}


def _normal(path: str) -> str:
    return path.lower().strip("/")


def url_parts(url: Column, strip_host: bool, strip_query: bool, strip_locale: bool) -> dict[str, Column]:
    """path, host, query and locale of a URL; absolute, relative or without a scheme."""
    # scheme: [//authority] path [?query] [#fragment]
    pattern = r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
    part = lambda k: F.regexp_extract(url, pattern, k)
    raw = F.regexp_replace(part(2), r";[^/]*$", "")
    path = raw if strip_host or strip_query else F.concat(raw, F.when(part(3) != "", F.concat(F.lit("?"), part(3))).otherwise(""))
    path = F.regexp_replace(F.lower(path), "^/+|/+$", "")
    path = F.when((path == "") & (raw != ""), F.lit("/")).otherwise(path)
    first = F.substring_index(path, "/", 1)
    locale = F.when(first.rlike(LOCALE), first).otherwise("")
    if strip_locale:
        rest = F.regexp_replace(path, "^[^/]*/?", "")
        path = F.when(locale != "", F.when(rest == "", F.lit("/")).otherwise(rest)).otherwise(path)
    return {"path": path, "host": part(1), "query": part(3), "locale": locale}


def urls_to_events(df: DataFrame, schema: StreamSchema, column: str, nodes: list[dict] | None = None, strip_host: bool = True, strip_query: bool = True, strip_locale: bool = True, keep_full_paths: bool = False, host_col: str | None = None, query_col: str | None = None, locale_col: str | None = None, slug_col: str | None = None) -> tuple[DataFrame, StreamSchema]:
    if column not in df.columns:
        raise ParameterError(f"no column {column!r}")
    tree: dict[str, dict] = {}
    for n in nodes or ():
        if "path" not in n or set(n) - NODE_KEYS:
            raise ParameterError(f"a node has path and perhaps {sorted(NODE_KEYS - {'path'})}, got {n}")
        tree[_normal(n["path"])] = n
    columns, url = df.columns, F.col(column).cast("string")
    parts = url_parts(F.coalesce(url, F.lit("")), strip_host, strip_query, strip_locale)
    rows = df.withColumns({f"__url_{k}": v for k, v in parts.items()})
    path = F.col("__url_path")
    under = lambda p: (path == p) | path.startswith(p + "/")
    for p, n in tree.items():
        if n.get("exclude"):
            rows = rows.filter(~under(p))
    name, slug = path, F.lit("")
    cuts = [] if keep_full_paths else sorted((p for p, n in tree.items() if n.get("aggregate_children")), key=len)
    for p in cuts:  # the deepest cut is the outermost case
        child = F.regexp_extract(F.substring(path, F.lit(len(p) + 2), F.lit(1 << 20)), "^([^/]*)", 1)
        default = (tree[p].get("name") or "").strip() or "sub-page"
        below = F.lit(default)
        for q, n in tree.items():
            if q.rpartition("/")[0] == p and (own := (n.get("name") or "").strip()):
                below = F.when(child == q.rpartition("/")[2], F.lit(own)).otherwise(below)
        name = F.when(path == p, F.lit(p)).when(path.startswith(p + "/"), F.concat(F.lit(p + "/"), below)).otherwise(name)
        slug = F.when(path == p, F.lit("")).when(path.startswith(p + "/"), below).otherwise(slug)
    rows = rows.withColumn("__name", name).withColumn("__slug", slug)
    event = schema.event_col
    rows = rows.withColumn(event, F.col("__name") if column == event else F.concat(F.col(event), F.lit(":/"), F.col("__name")))
    new = {}
    for col, value in ((host_col, "__url_host"), (query_col, "__url_query"), (locale_col, "__url_locale"), (slug_col, "__slug")):
        if col:
            rows = rows.withColumn(col, F.col(value))
            new[col] = True
    if new and schema.custom_cols is not None:
        schema = replace(schema, custom_cols=(*schema.custom_cols, *(c for c in new if c not in schema.custom_cols)))
    return rows.select(*columns, *(c for c in new if c not in columns)), schema
