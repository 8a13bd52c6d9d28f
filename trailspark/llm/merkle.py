"""Operator 11: a Merkle tree over the rows of each source and over the sources, with a proof for every row.

1. Each row becomes a leaf (SHA-256 of its five fields).  Leaves are dealt by ranges of source and doc_id;
   the counts of the ranges give each leaf its place in its source.
2. ``FANOUT`` ** ``LOCAL_LEVELS`` consecutive places are a chunk: its lowest levels are hashed by itself.
3. Chunks then swap roots round by round, a butterfly: in round r a chunk sends the hash of its subtree of
   ``FANOUT`` ** r chunks to one chunk of each of the other subtrees under the same parent, the one that stands at
   its own place, and hashes the parent from what it gets.  Where the last subtree is smaller, its
   chunks send to several.  So every chunk ends with the root and the siblings on its way up, without
   a pass down; each gets at most ``FANOUT`` rows in a round.
4. The sources' roots are the leaves of one more such tree, whose paths join the chunks by source.

Edge cases: a null field is ``-``, an empty text ``0:``; in a source null ids come first, and rows of one id
follow their leaves' order; a row without siblings has the hash of nothing as its proof; a single row is leaf,
subroot and root in one; a null id isn't tampered with; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, settled

FANOUT = 16
#: Levels that a chunk hashes by itself; it has FANOUT ** LOCAL_LEVELS leaves.
LOCAL_LEVELS = 2
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PATH = "array<struct<before: string, after: string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(text: Column) -> Column:
    return digest(*(field(text if c == "text" else F.col(c)) for c in FIELDS))


def div(a: Column, b: int | Column) -> Column:
    return F.call_function("div", a, F.lit(b) if isinstance(b, int) else b)


def placed(rows: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """``rows`` with t (number of their group ``g``), i (place in the group) and n (its size); and the groups (t, n).

    Rows are written once, sorted by ranges; of each range only its counts go on.
    """
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranges = materialize(rows.repartitionByRange("g", *order).sortWithinPartitions("g", *order).withColumns({"p": F.spark_partition_id(), "at": at}))
    counts = materialize(ranges.groupBy("p", "g").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("f")))
    start = F.sum("n").over(Window.partitionBy("g").orderBy("p")) - F.col("n")
    groups = counts.groupBy("g").agg(F.min(F.struct("p", "f")).alias("first"), F.sum("n").alias("n"))
    # groups are numbered like their rows: a row for each range is all that meets in one place
    firsts = groups.groupBy("first.p").agg(F.count(F.lit(1)).alias("k"))
    before = firsts.select("p", (F.sum("k").over(Window.orderBy("p")) - F.col("k")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("first.p").orderBy("first.f")) - 1
    numbered = materialize(groups.select("g", "n", F.col("first.p").alias("p"), rank.alias("j")).join(before, "p").select("g", (F.col("before") + F.col("j")).alias("t"), "n"))
    where = materialize(counts.select("p", "g", (start - F.col("f")).alias("start")).join(numbered, "g"))
    return ranges.join(where, ["p", "g"]).withColumn("i", F.col("at") + F.col("start")).drop("p", "g", "at", "start"), numbered.select("t", "n")


def chunks(leaves: DataFrame, carried: list[str]) -> DataFrame:
    """t, n, c, leaves (node and what it carries, by place) and the nodes l0, l1, .. of the chunk's own levels."""
    span = FANOUT**LOCAL_LEVELS
    out = leaves.groupBy("t", "n", div(F.col("i"), span).alias("c")).agg(F.sort_array(F.collect_list(F.struct("i", "node", *carried))).alias("leaves"))
    out = out.withColumn("l0", F.transform("leaves", lambda x: x["node"]))
    for level in range(LOCAL_LEVELS):
        below = F.col(f"l{level}")
        runs = F.sequence(F.lit(0), F.ceil(F.size(below) / FANOUT).cast("int") - 1)
        joined = F.transform(runs, lambda j: digest(F.array_join(F.slice(below, j * FANOUT + 1, FANOUT), "")))  # noqa: B023
        out = out.withColumn(f"l{level + 1}", F.when(F.col("n") > FANOUT**level, joined).otherwise(below))
    return out


def swapped(state: DataFrame, block: int) -> DataFrame:
    """A round of the butterfly over subtrees of ``block`` chunks: the state (t, c, m, node, path) one level up."""
    c, m = F.col("c"), F.col("m")
    own, place, last = div(c, block), c % block, div(m - 1, block)
    size = lambda q: F.least(F.lit(block).cast("long"), m - q * block)
    first = own - own % FANOUT

    def of(q: Column) -> Column:
        reached = F.when(place < size(q), F.sequence(q * block + place, q * block + size(q) - 1, size(own)))
        return F.when(q == own, F.array(c)).otherwise(F.coalesce(reached, F.array().cast("array<bigint>")))

    to = F.when(last > 0, F.flatten(F.transform(F.sequence(first, F.least(first + FANOUT - 1, last)), of))).otherwise(F.array(c))
    sent = state.withColumn("to", F.explode(to)).select("t", F.col("to").alias("c"), "m", F.struct((own % FANOUT).alias("d"), "node").alias("x"), F.when(F.col("to") == c, F.col("path")).alias("path"))
    met = sent.groupBy("t", "c", "m").agg(F.sort_array(F.collect_list("x")).alias("run"), F.first("path", ignorenulls=True).alias("path"))
    digit, nodes = own % FANOUT, lambda keep: F.array_join(F.transform(F.filter("run", keep), lambda x: x["node"]), "")
    step = F.array(F.struct(nodes(lambda x: x["d"] < digit).alias("before"), nodes(lambda x: x["d"] > digit).alias("after")))
    up = last > 0
    node = F.when(up, digest(nodes(lambda x: F.lit(True)))).otherwise(F.get("run", F.lit(0))["node"])
    return met.select("t", "c", "m", node.alias("node"), F.when(up, F.concat("path", step)).otherwise(F.col("path")).alias("path"))


def climbed(parts: DataFrame, most: int) -> DataFrame:
    """t, c, node (the root of tree t) and path (siblings above the chunk's own levels); ``most``: leaves of the largest tree."""
    span = FANOUT**LOCAL_LEVELS
    m = F.ceil(F.col("n") / span).cast("long")
    state = parts.select("t", "c", m.alias("m"), F.get(f"l{LOCAL_LEVELS}", F.lit(0)).alias("node"), F.array().cast(_PATH).alias("path"))
    block, m = 1, -(-most // span)
    while block < m:
        state = swapped(state, block)
        block *= FANOUT
    return state.select("t", "c", "node", "path")


def own_path(j: Column) -> Column:
    """Siblings of the leaf at place ``j`` of its chunk on the chunk's own levels."""
    steps = []
    for level in range(LOCAL_LEVELS):
        at, nodes = div(j, FANOUT**level), F.col(f"l{level}")
        before, after = F.slice(nodes, at - at % FANOUT + 1, at % FANOUT), F.slice(nodes, at + 2, F.lit(FANOUT - 1) - at % FANOUT)
        steps.append(F.when(F.col("n") > FANOUT**level, F.struct(F.array_join(before, "").alias("before"), F.array_join(after, "").alias("after"))))
    return F.array_compact(F.array(*steps))


def each_leaf(parts: DataFrame, path: Callable[[Column], Column], result: Callable[[Column, Column], Column]) -> DataFrame:
    """``result(leaf, path(place))`` of each leaf, a struct, as columns."""
    rows = F.transform("leaves", lambda x, j: F.struct(x.alias("x"), path(j).alias("path")))
    return parts.select(F.inline(F.transform(rows, lambda y: result(y["x"], y["path"]))))


def folded(path: Column, node: Column) -> Column:
    return F.aggregate(path, node, lambda h, s: digest(s["before"], h, s["after"]))


def merkle_manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified for each row of ``docs``."""

    def build() -> DataFrame:
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", "n_chars", "text")
        tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, leaf(F.translate("text", UPPER, LOWER)))
        g = F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("source")))
        leaves, trees = placed(rows.select(g.alias("g"), "doc_id", leaf(F.col("text")).alias("node"), tampered.alias("other")), ["doc_id", "node"])
        parts = materialize(chunks(leaves, ["doc_id", "other"]))
        facts = trees.agg(F.max("n").alias("most"), F.count(F.lit(1)).alias("trees")).first()
        state = materialize(climbed(parts, facts["most"] or 0))

        roots = state.filter("c = 0").select(F.lit(0).cast("long").alias("t"), F.lit(facts["trees"]).alias("n"), F.col("t").alias("i"), "node")
        top = chunks(roots, [])
        top = top.join(climbed(top, facts["trees"]).withColumnRenamed("node", "root"), ["t", "c"])
        above = each_leaf(top, lambda j: F.concat(own_path(j), F.col("path")), lambda x, path: F.struct(x["i"].alias("t"), path.alias("above"), F.col("root").alias("root")))
        above = materialize(above)

        def result(x: Column, path: Column) -> Column:
            proof = digest(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""))
            return F.struct(x["doc_id"].alias("doc_id"), x["node"].alias("leaf"), F.col("subroot").alias("subroot"), F.col("root").alias("root"), proof.alias("proof_sha256"), folded(path, F.coalesce(x["other"], x["node"])).alias("folded_root"))

        whole = parts.join(state.withColumnRenamed("node", "subroot"), ["t", "c"]).join(above, "t")
        out = each_leaf(whole, lambda j: F.concat(own_path(j), F.col("path"), F.col("above")), result)
        return out.withColumn("verified", F.col("folded_root") == F.col("root"))

    return settled(docs.sparkSession, build)


def _crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of decimal digits."""
    return f"xor(list_reduce(list_transform(range(1, length({text}) + 1), lambda i: ascii(substring({text}, i, 1))::BIGINT), lambda c, b: xor(c >> 8, crc[xor(c & 255, b) + 1]), 4294967295::BIGINT), 4294967295::BIGINT)"


def _tree_sql(name: str, levels: int) -> str:
    """Levels {name}0 .. (t, i, n, node) from {name}0, with the runs of each level, and {name}f: the way of each leaf."""
    out = []
    for k in range(levels):
        out.append(f"{name}r{k} AS MATERIALIZED (SELECT t, i // {FANOUT} AS i, any_value(n) AS n, list(node ORDER BY i) AS run FROM {name}{k} GROUP BY t, i // {FANOUT})")
        out.append(f"{name}{k + 1} AS MATERIALIZED (SELECT t, i, (n + {FANOUT - 1}) // {FANOUT} AS n, CASE WHEN n = 1 THEN run[1] ELSE sha256(array_to_string(run, '')) END AS node FROM {name}r{k})")
    steps = [f"CASE WHEN r{k}.n > 1 THEN {{{{'b': array_to_string(r{k}.run[:(l.i // {FANOUT**k}) % {FANOUT}], ''), 'a': array_to_string(r{k}.run[(l.i // {FANOUT**k}) % {FANOUT} + 2:], '')}}}} END".replace("{{", "{").replace("}}", "}") for k in range(levels)]
    joins = " ".join(f"JOIN {name}r{k} r{k} ON r{k}.t = l.t AND r{k}.i = l.i // {FANOUT ** (k + 1)}" for k in range(levels))
    out.append(f"{name}f AS (SELECT l.t, l.i, top.node AS root, list_filter([{', '.join(steps)}], lambda s: s IS NOT NULL) AS path FROM {name}0 l {joins} JOIN {name}{levels} top ON top.t = l.t)")
    return ",\n".join(out)


#: The same rows in DuckDB's SQL, for up to FANOUT ** 5 rows a source and FANOUT ** 4 sources.
MERKLE_SQL = f"""
WITH crcs AS (SELECT list(v ORDER BY k) AS crc FROM (SELECT k, list_reduce(range(8), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k) AS v FROM (SELECT range AS k FROM range(256)))),
d AS (SELECT *, CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS x,
    CASE WHEN doc_id IS NULL THEN '-' ELSE length(doc_id::VARCHAR) || ':' || doc_id END || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
    || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END || CASE WHEN n_chars IS NULL THEN '-' ELSE length(n_chars::VARCHAR) || ':' || n_chars END AS y FROM documents),
h AS (SELECT doc_id, source, sha256(y || x) AS leaf, CASE WHEN doc_id IS NOT NULL AND {_crc32_sql("doc_id::VARCHAR")} % 5 = 0 THEN sha256(y || translate(x, '{UPPER}', '{LOWER}')) END AS other FROM d, crcs),
o AS MATERIALIZED (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS t, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM h),
a0 AS MATERIALIZED (SELECT t, i, n, leaf AS node FROM o),
{_tree_sql("a", 5)},
b0 AS MATERIALIZED (SELECT 0 AS t, t AS i, count(*) OVER () AS n, node FROM a5),
{_tree_sql("b", 4)},
p AS (SELECT o.doc_id, o.leaf, coalesce(o.other, o.leaf) AS other, af.root AS subroot, bf.root, list_concat(af.path, bf.path) AS path FROM o JOIN af ON o.t = af.t AND o.i = af.i JOIN bf ON bf.i = o.t),
f AS (SELECT *, list_reduce(list_transform(path, lambda s: [s.b, s.a]), lambda h, s: [sha256(s[1] || h[1] || s[2])], [other])[1] AS folded_root FROM p)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda s: s.b || s.a), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM f
"""
