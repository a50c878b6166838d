"""Near-duplicate embeddings through an inverted multi-index.

Unit vectors are cut in two halves; each half has its own codebook, so a cell
of the product grid is a pair (i, j).  A query visits the cells in the order
of the multi-sequence algorithm: by the least squared distance that a vector
of the cell can have from the query, the sum of one bound per half.  The
bound of a half is the distance to the farthest of the planes that separate a
codeword's region from the other codewords' regions.  Traversal stops when
the sum exceeds the squared distance of the threshold times ``reach``**2; with
``reach`` 1 no link can lie in an unvisited cell, so recall is 1.  Vectors of
visited cells are compared in double precision.

Tasks get one block of a grid column (label, i) and one block of the queries
that visit it, never a whole column.  A task returns the number of links of
each query and the links of a spanning forest, so a dense group costs rows in
proportion to its vectors, not to its pairs.  Equal vectors are one class
before all this.

The codebooks are fitted on at most ``sample`` vectors (least hash of the id).

Defined results: vectors that are null, empty, zero or hold null or non-finite
components, and those without label or vec_id, link with nothing; vectors of
different length never link; rows equal in vec_id, label and vector are one
vector; one vec_id with several vectors gives a row for each, all in one
component; ``component_id`` is the smallest vec_id reachable; other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slimctx.llm.common import arrow_batches, components, digest128, join_unique
from slimctx.session import materialize

THRESHOLD = 0.98
SAMPLE = 20_000
PER_COLUMN = 256         # vectors wanted in a cell of the grid
MAX_CODEWORDS = 256
INDEX_BLOCK, QUERY_BLOCK = 1024, 4096
PLANES = 1 << 20         # plane distances computed at once
SLACK = 1e-6             # of rounding in bounds

KEYS = ["label", "dim", "i", "iblock", "qblock"]


def matrix(column, width: int) -> np.ndarray:
    """The rows of an Arrow list column as unit vectors, padded with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((n, width))
    if n and (sizes == width).all():
        out[:] = values.reshape(n, width)
    else:
        at = 0
        for r, s in enumerate(sizes):
            out[r, :s] = values[at:at + s]
            at += s
    big = np.abs(out).max(1, keepdims=True, initial=0)
    out /= np.where(big > 0, big, 1)       # no overflow or underflow of squares
    norm = np.sqrt((out * out).sum(1, keepdims=True))
    return out / np.where(norm > 0, norm, 1)


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's algorithm from k distinct rows; empty codewords are dropped."""
    rows = np.unique(x, axis=0)
    rng = np.random.RandomState(0)
    c = rows[rng.permutation(len(rows))[:k]]
    for _ in range(rounds):
        near = squares(x, c).argmin(1)
        n = np.bincount(near, minlength=len(c))
        s = np.zeros_like(c)
        np.add.at(s, near, x)
        c = s[n > 0] / n[n > 0, None]
    return np.unique(c, axis=0)


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None], 0)


class Half:
    """The codebook of one half: nearest codeword and bounds to all regions."""

    def __init__(self, codebook: np.ndarray):
        self.c = codebook
        gaps = np.sqrt(squares(codebook, codebook))
        np.fill_diagonal(gaps, 1)
        self.gaps = 2 * np.maximum(gaps, 1e-12)

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(nearest codeword, least squared distance to each region)."""
        d = squares(x, self.c)
        plane = np.empty_like(d)
        rows = max(1, PLANES // len(self.c) ** 2)
        for i in range(0, len(d), rows):
            e = d[i:i + rows]
            plane[i:i + rows] = ((e[:, :, None] - e[:, None, :]) / self.gaps[None]).max(2)
        return d.argmin(1), np.maximum(plane - SLACK, 0) ** 2


def visited(a: np.ndarray, b: np.ndarray, limit: float) -> list[tuple[int, np.ndarray]]:
    """The cells (i, js) that the multi-sequence order over the bounds ``a``
    and ``b`` has passed when their sum reaches ``limit``: with both sorted,
    the cells passed are a staircase of prefixes."""
    order = np.argsort(b, kind="stable")
    steps = np.searchsorted(b[order], limit - a, "right")
    return [(int(i), order[:steps[i]]) for i in np.argsort(a, kind="stable") if steps[i]]


def usable(vector="embedding"):
    v = F.col(vector)
    return F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size(v) > 0)
                      & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x)
                                 & (F.abs(x) < float("inf")))
                      & F.exists(v, lambda x: x != 0), F.lit(False))


def fit(classes: DataFrame, n: int, width: int, sample: int = SAMPLE) -> tuple[Half, Half]:
    """Codebooks of about sqrt(n / PER_COLUMN) codewords from a bounded sample."""
    rows = (classes.select("cid", "embedding").orderBy(F.xxhash64("cid")).limit(sample)
            .select("embedding").toArrow())
    x = matrix(rows.column("embedding"), width)
    k = int(min(MAX_CODEWORDS, max(4, np.sqrt(n / PER_COLUMN))))
    cut = width // 2
    return Half(kmeans(x[:, :cut], k)), Half(kmeans(x[:, cut:], k))


def _spanning(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and their component's smallest node, for the links (u, v)."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[:len(u)], ends[len(u):]
    low = np.arange(len(nodes))
    while True:
        m = np.minimum(low[a], low[b])
        new = low.copy()
        np.minimum.at(new, a, m)
        np.minimum.at(new, b, m)
        new = new[new]
        if (new == low).all():
            return nodes, nodes[low]
        low = new


def link_classes(classes: DataFrame, threshold: float = THRESHOLD, reach: float = 1.0,
                 sample: int = SAMPLE) -> DataFrame:
    """(cid, links, root) rows: the copies that a class links with, found in
    one task, and a class it is connected with there."""
    spark = classes.sparkSession
    arrow_batches(spark)
    size = classes.agg(F.count("*").alias("n"), F.max("dim").alias("w")).first()
    out = "cid long, links long, root long"
    if not size["n"]:
        return spark.createDataFrame([], out)
    width = max(size["w"], 2)
    cut = width // 2
    limit = (2 - 2 * threshold) * reach * reach + SLACK
    one, two = fit(classes, size["n"], width, sample)
    visit = pa.struct([("i", pa.int32()), ("js", pa.list_(pa.int32()))])

    def place(batches):
        for batch in batches:
            x = matrix(batch.column("embedding"), width)
            (i, a), (j, b) = one.bounds(x[:, :cut]), two.bounds(x[:, cut:])
            cells = [[{"i": p, "js": q} for p, q in visited(a[r], b[r], limit)]
                     for r in range(len(x))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(i, pa.int32()), pa.array(j, pa.int32()),
                 pa.array(cells, pa.list_(visit))],
                names=[*batch.schema.names, "i", "j", "cells"])

    schema = classes.schema.simpleString()[7:-1]
    placed = materialize(classes.mapInArrow(
        place, schema + ",i int,j int,cells array<struct<i:int,js:array<int>>>"), "placed")
    column = ["label", "dim", "i"]
    index = placed.select("label", "dim", "i", "j", "cid", "copies", "embedding")
    queries = (placed.select("label", "dim", "cid", "copies", "embedding",
                             F.explode("cells").alias("cell"))
               .select("label", "dim", "cell.i", "cell.js", "cid", "copies", "embedding"))
    blocks = (index.groupBy(*column).agg(F.ceil(F.count("*") / INDEX_BLOCK).alias("ni"))
              .join(queries.groupBy(*column).agg(F.ceil(F.count("*") / QUERY_BLOCK).alias("nq")),
                    column))

    def spread(rows, own, own_n, other, other_n):
        return (rows.join(F.broadcast(blocks) if few else blocks, column)
                .withColumn(own, F.pmod(F.xxhash64("cid"), F.col(own_n)))
                .withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"),
                                                        F.col(other_n) - 1))))

    few = blocks.count() <= 100_000
    none = F.lit(None)
    both = (spread(index, "iblock", "ni", "qblock", "nq").withColumn("js", none.cast("array<int>"))
            .unionByName(spread(queries, "qblock", "nq", "iblock", "ni")
                         .withColumn("j", none.cast("int"))))

    def compare(group: pa.Table) -> pa.Table:
        j = group.column("j").to_pandas().to_numpy()
        is_query = np.isnan(j.astype(float))
        x = matrix(group.column("embedding"), width)
        cid = group.column("cid").to_numpy()
        copies = group.column("copies").to_numpy()
        q_at = np.flatnonzero(is_query)
        js = [np.asarray(v) for v in group.column("js").take(pa.array(q_at)).to_pylist()]
        who = np.repeat(q_at, [len(v) for v in js])
        cell = np.concatenate(js) if js else np.empty(0, int)
        links, us, vs = np.zeros(len(cid), np.int64), [], []
        for c in np.unique(cell):
            y_at = np.flatnonzero(~is_query & (j == c))
            if not len(y_at):
                continue
            a_at = who[cell == c]
            hit, to = np.nonzero(x[a_at] @ x[y_at].T >= threshold)
            hit, to = a_at[hit], y_at[to]
            other = cid[hit] != cid[to]
            hit, to = hit[other], to[other]
            np.add.at(links, hit, copies[to])
            if len(hit):
                nodes, root = _spanning(cid[hit], cid[to])
                us.append(nodes), vs.append(root)
        some = np.flatnonzero(links)
        u = np.concatenate(us) if us else np.empty(0, np.int64)
        v = np.concatenate(vs) if vs else np.empty(0, np.int64)
        return pa.table({"cid": np.concatenate([cid[some], u]).astype(np.int64),
                         "links": np.concatenate([links[some], np.zeros(len(u), np.int64)]),
                         "root": np.concatenate([cid[some], v]).astype(np.int64)})

    packed = both.select(*KEYS, "j", "js", "cid", "copies", "embedding")
    return packed.groupBy(*KEYS).applyInArrow(compare, out)


def embedding_dedup(vectors: DataFrame, threshold: float = THRESHOLD, reach: float = 1.0,
                    sample: int = SAMPLE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of ``vectors`` (vec_id,
    embedding, label)."""
    h1, h2 = digest128(F.col("embedding"))
    key = ["label", "dim", "h1", "h2"]
    rows = materialize(vectors.select("vec_id", "label", "embedding").distinct()
                       .withColumn("ok", usable())
                       .withColumn("dim", F.size("embedding"))
                       .withColumn("h1", h1).withColumn("h2", h2), "vectors")
    good = rows.filter("ok")
    classes = materialize(good.groupBy(*key).agg(F.min("vec_id").alias("first_id"),
                                                 F.count("*").alias("copies"),
                                                 F.first("embedding").alias("embedding"))
                          .withColumn("cid", F.xxhash64(*key)), "classes")
    found = materialize(link_classes(classes.select("cid", "label", "dim", "embedding", "copies"),
                                     threshold, reach, sample), "links")
    # the classes of one vec_id with several vectors are linked
    several = (good.groupBy("vec_id").agg(F.count("*").alias("n")).filter("n > 1")
               .select("vec_id"))
    owned = (good.join(several, "vec_id")
             .select("vec_id", F.xxhash64(*key).alias("cid")))
    same = (owned.join(owned.groupBy("vec_id").agg(F.min("cid").alias("b")), "vec_id")
            .select(F.col("cid").alias("a"), "b"))
    roots = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b"))
                       .unionByName(same))
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    placed = materialize(
        classes.select(*key, "cid", "first_id", "copies").join(links, "cid", "left")
        .join(roots, F.col("cid") == F.col("node"), "left")
        .select(*key, "copies", "first_id", F.coalesce("links", F.lit(0)).alias("links"),
                F.coalesce("root", "cid").alias("root")), "classes-placed")
    least = placed.groupBy("root").agg(F.min("first_id").alias("component_id"),
                                       F.count("*").alias("w"))
    known = join_unique(placed, least, ["root"], "w", placed.count()).select(
        *key, "copies", "links", "component_id")
    linked = (join_unique(good.select("vec_id", *key), known, key, "copies", good.count())
              .select("vec_id", (F.col("copies") - 1 + F.col("links")).cast("long")
                      .alias("n_links"), F.col("component_id").cast("long")
                      .alias("component_id")))
    alone = rows.filter("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"),
                                         F.col("vec_id").cast("long").alias("component_id"))
    return linked.unionByName(alone).withColumn(
        "kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op10_query(vectors: DataFrame) -> DataFrame:
    """Near-duplicate vectors with equal labels, cosine of at least 0.98."""
    return embedding_dedup(vectors)


OP10_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e,
         label IS NOT NULL AND len(embedding) > 0
         AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
         AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS ok FROM embeddings
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b
  FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE a.ok AND b.ok AND list_dot_product(a.e, b.e)
        >= 0.98 * sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), low AS (
  SELECT a, min(b) AS component_id FROM reach GROUP BY a
), n AS (
  SELECT a, count(*) AS n_links FROM links GROUP BY a
)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN low ON low.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""
