"""Merkle manifest of a dataset, built with lag/lead windows.

Every row is a leaf; the leaves of one group (``lang``) form a tree in the
order of their ids, and the groups' subroots form the tree of the root.  A
node is the SHA-256 of the concatenated hex digests of up to ``fanout``
consecutive nodes below it; the last run of a level may be shorter, a lone
node is hashed alone, and a tree of one node is that node.

**Levels.**  Positions within a tree are cut into blocks of
``fanout ** LEVELS`` and a window runs over (tree, block).  A node of level
``l`` lives on the row of its first leaf, so its siblings stand at the fixed
distances ``k * fanout ** l``: lag and lead columns of these distances, masked
by the node's slot in its run and by the length of the run, are the siblings,
and the first child's row hashes the parent.  Once LEVELS levels are done the
first row of each block is a node of the next, ``fanout ** LEVELS`` times
smaller pass.

**Proofs.**  A row's path is the list of (left, right) siblings of its
ancestors.  Paths are put together from the top: a pass joins its rows with
the block they belong to, at most ``fanout ** LEVELS`` rows a key, so no tree,
however large, becomes one key of a join or one task of a window.

**Positions** come from a range partitioning over (tree, order), counts per
range and tree, and a running sum over the ranges.

Defined results: ties of an id are ordered by their leaf; repeated rows are
leaves of their own; a null group is a tree of its own, the first; rows
without id come first in their tree and are never tampered with; null and
empty values have different leaves; a length that cannot grow by 1 is tampered
with to null; an empty table has no rows (and no root);
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slimctx.session import materialize

FANOUT = 2
LEVELS = 10
#: The fields of a document's leaf, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    """H: the SHA-256 of the concatenated texts, in lower-case hex."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value with its length in bytes in front, so that neighbouring fields
    cannot run into each other; null is ``-``."""
    text = value.cast("string")
    return (F.when(value.isNull(), F.lit("-"))
            .otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path lead to."""
    return F.aggregate(path, leaf, lambda node, s: digest(s["left"], node, s["right"]))


def siblings_digest(path: Column) -> Column:
    """H of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def positions(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows(tree, ...)`` with ``pos``, the place from 0 on in the tree by
    ``order``, and ``n``, the number of rows of the tree."""
    keys = ["tree", "part"]
    dealt = materialize(rows.repartitionByRange("tree", *order)
                        .withColumn("part", F.spark_partition_id()), "ranges")
    ranges = Window.partitionBy("tree").orderBy("part")
    before = F.sum("held").over(ranges.rowsBetween(Window.unboundedPreceding, -1))
    starts = (dealt.groupBy(*keys).agg(F.count("*").alias("held"))
              .select(*keys, F.coalesce(before, F.lit(0)).alias("start"),
                      F.sum("held").over(Window.partitionBy("tree")).alias("n")))
    here = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return (dealt.withColumn("here", here).join(starts, keys)
            .withColumn("pos", F.col("start") + F.col("here")).drop("part", "here", "start"))


def _levels(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """``nodes(tree, pos, n, node)`` with ``path``, the siblings over
    ``levels`` levels, and ``top``, on the first row of a block the node they
    lead to."""
    size = fanout ** levels
    block = Window.partitionBy("tree", "block").orderBy("pos")
    so_far = block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = nodes.withColumn("block", F.expr(f"pos div {size}")).withColumn("at0", F.col("node"))
    steps = []
    for level in range(levels):
        step = fanout ** level
        at, n, nth = F.col(f"at{level}"), F.expr(f"(n + {step - 1}) div {step}"), F.expr(f"pos div {step}")
        slot = nth % fanout
        run = F.least(F.lit(fanout), n - (nth - slot))
        left = F.concat(*[F.when(F.lit(k) <= slot, F.lag(at, k * step).over(block)).otherwise("")
                          for k in range(fanout - 1, 0, -1)])
        right = F.concat(*[F.when(slot + k < run, F.lead(at, k * step).over(block)).otherwise("")
                           for k in range(1, fanout)])
        here = F.col("pos") % step == 0
        df = df.withColumns({f"left{level}": F.when(here, left), f"right{level}": F.when(here, right)})
        parent = F.when(n > 1, digest(at, F.col(f"right{level}"))).otherwise(at)
        df = df.withColumn(f"at{level + 1}", F.when(here & (slot == 0), parent))
        steps.append(F.when(n > 1, F.struct(
            F.last(f"left{level}", ignorenulls=True).over(so_far).alias("left"),
            F.last(f"right{level}", ignorenulls=True).over(so_far).alias("right"))))
    return df.select(*nodes.columns, "block", F.array_compact(F.array(*steps)).alias("path"),
                     F.col(f"at{levels}").alias("top"))


def _climb(nodes: DataFrame, fanout: int, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """The written passes from ``nodes(tree, pos, n, node)`` up, and the tops:
    (tree, node) for each tree."""
    size, passes = fanout ** levels, []
    most = nodes.agg(F.max("n")).first()[0] or 1
    while True:
        done = materialize(_levels(nodes, fanout, levels), "merkle")
        passes.append(done)
        nodes = (done.filter(F.col("pos") % size == 0)
                 .select("tree", F.col("block").alias("pos"),
                         F.expr(f"(n + {size - 1}) div {size}").alias("n"), F.col("top").alias("node")))
        most = -(-most // size)
        if most == 1:
            return passes, nodes.select("tree", "node")


def _descend(passes: list[DataFrame], upper: DataFrame) -> DataFrame:
    """The rows of the first pass with their whole path and the columns of
    ``upper(tree, above, ...)``, which has one row per tree."""
    carried = [c for c in upper.columns if c not in ("tree", "above")]
    key = ["tree"]
    for done in reversed(passes):
        rows = done.join(upper, key).withColumn("path", F.concat("path", "above"))
        upper = rows.select("tree", F.col("pos").alias("block"), F.col("path").alias("above"), *carried)
        key = ["tree", "block"]
    return rows.drop("above", "block", "top", "node", "n")


def manifest(rows: DataFrame, group: str, order: Sequence[str], leaf: str = "leaf",
             fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """``rows`` with (subroot, root, path) added.

    ``group`` names the column whose values have a tree each, ``order`` the
    columns that order the leaves of a tree (ties go by the leaf), ``leaf`` the
    column of the leaf digests.  ``fold(leaf, path)`` gives the root again."""
    # '' for null sorts first, '=' before each other name keeps their order
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    sort = [f"o{i}" for i in range(len(order))]
    packed = rows.select(
        F.struct(*rows.columns).alias("row"), tree.alias("tree"), F.col(leaf).alias("node"),
        *[F.col(c).alias(a) for c, a in zip(order, sort)], F.monotonically_increasing_id().alias("rid"))
    # written first: the ids of the rows must not change between two readings
    packed = materialize(packed, "leaves")
    leaves = positions(packed, [*sort, "node", "rid"]).drop(*sort, "rid")
    passes, subroots = _climb(leaves, fanout, levels)

    ranked = positions(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "node"), ["name"])
    top, root = _climb(ranked.withColumn("subroot", F.col("node")), fanout, levels)
    root = root.select("tree", F.col("node").alias("root"), F.array().cast(
        "array<struct<left:string,right:string>>").alias("above"))
    upper = _descend(top, root).select(F.col("name").alias("tree"), F.col("path").alias("above"),
                                       "subroot", "root")
    return _descend(passes, upper).select("row.*", "subroot", "root", "path")


def op11_query(docs: DataFrame) -> DataFrame:
    """The manifest of the documents, and what tampering with n_chars does."""
    def leaf(n_chars: Column) -> Column:
        return digest(*[field(n_chars if c == "n_chars" else F.col(c)) for c in FIELDS])

    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    rows = docs.select("doc_id", "lang", leaf(F.col("n_chars")).alias("leaf"), F.when(
        tampered, leaf(F.try_add(F.col("n_chars"), F.lit(1)))).alias("tampered"))
    folded = fold(F.coalesce("tampered", "leaf"), F.col("path"))
    return (manifest(rows, "lang", ["doc_id"])
            .select("doc_id", "leaf", "subroot", "root", siblings_digest(F.col("path")).alias("proof_sha256"),
                    folded.alias("folded_root"))
            .withColumn("verified", F.col("folded_root") == F.col("root")))


OP11_SQL = r"""
WITH RECURSIVE f AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-')
         || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-') AS head,
         coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS size,
         coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') AS other_size,
         coalesce(strlen(text) || ':' || text, '-') AS body,
         xor(4294967295, list_reduce(
           list_prepend(4294967295::BIGINT, list_transform(
             string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
           lambda crc, b: list_reduce(
             list_prepend(xor(crc, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
             lambda x, z: xor(x >> 1, 3988292384 * (x & 1))))) % 7 = 0 AS tampered
  FROM documents
), h AS (
  SELECT doc_id, tree, sha256(head || size || body) AS leaf,
         CASE WHEN tampered THEN sha256(head || other_size || body) END AS other
  FROM f
), l AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         count(*) OVER (PARTITION BY tree) AS n FROM h
), nodes AS (
  SELECT tree, 0 AS lvl, pos, n, leaf AS node FROM l
  UNION ALL
  SELECT tree, lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY pos))
  FROM nodes WHERE n > 1 GROUP BY tree, lvl, pos // 2, n
), sub AS (
  SELECT tree, node AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n
  FROM nodes WHERE n = 1
), tops AS (
  SELECT 0 AS lvl, pos, n, subroot AS node FROM sub
  UNION ALL
  SELECT lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY pos))
  FROM tops WHERE n > 1 GROUP BY lvl, pos // 2, n
), sizes AS (
  SELECT DISTINCT tree, lvl FROM nodes WHERE n > 1
), top_sizes AS (
  SELECT DISTINCT lvl FROM tops WHERE n > 1
), low_path AS (
  SELECT l.tree, l.pos, list(CASE WHEN s.node IS NULL THEN '-' WHEN s.pos % 2 = 0 THEN 'L' || s.node
                             ELSE 'R' || s.node END ORDER BY z.lvl) AS path
  FROM l JOIN sizes z ON z.tree = l.tree
  LEFT JOIN nodes s ON s.tree = l.tree AND s.lvl = z.lvl AND s.pos = xor(l.pos >> z.lvl, 1)
  GROUP BY ALL
), top_path AS (
  SELECT sub.tree, list(CASE WHEN s.node IS NULL THEN '-' WHEN s.pos % 2 = 0 THEN 'L' || s.node
                        ELSE 'R' || s.node END ORDER BY z.lvl) AS path
  FROM sub CROSS JOIN top_sizes z
  LEFT JOIN tops s ON s.lvl = z.lvl AND s.pos = xor(sub.pos >> z.lvl, 1)
  GROUP BY ALL
), p AS (
  SELECT l.doc_id, l.leaf, coalesce(l.other, l.leaf) AS seen, sub.subroot,
         (SELECT node FROM tops WHERE n = 1) AS root,
         coalesce(a.path, []) || coalesce(b.path, []) AS path
  FROM l JOIN sub ON sub.tree = l.tree
  LEFT JOIN low_path a ON a.tree = l.tree AND a.pos = l.pos
  LEFT JOIN top_path b ON b.tree = l.tree
), r AS (
  SELECT doc_id, leaf, subroot, root,
         sha256(coalesce(list_aggregate(list_transform(path, lambda s: substr(s, 2)), 'string_agg', ''), ''))
           AS proof_sha256,
         list_reduce(list_prepend(seen, path), lambda a, s: CASE s[1]
           WHEN 'L' THEN sha256(substr(s, 2) || a) WHEN 'R' THEN sha256(a || substr(s, 2))
           ELSE sha256(a) END) AS folded_root
  FROM p
)
SELECT *, folded_root = root AS verified FROM r
"""
