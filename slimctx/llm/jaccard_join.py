"""Self-join of documents on the Jaccard similarity of their word shingles,
with signature trees, up to connected components.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case, a document's set its
distinct 5-word shingles (fewer words: the whole sequence is the one shingle).
Two documents link when 100 * intersection >= ``percent`` * union.

1. Frequent shingles, found by one counting pass, go to the end of a global
   order of shingles; the rest is ordered by hash.  Any order gives the same
   links, this one keeps passages that many documents share out of the way.
2. Equal sets are one class.  Each class sends its prefix in that order, n -
   ceil(percent n / 100) + 1 shingles, and a 512-bit bitmap of its whole set.
   Two linked sets share a shingle of their prefixes.
3. Classes that share one of their first prefix shingles are chained, in
   another random order for each shingle, and the chains' pairs verified:
   groups of near copies become components at linear cost.
4. Where a prefix shingle still connects different components, a signature
   tree is built over its classes in order of size: a node holds the OR of
   the bitmaps, the size range, the range of components and the most shingles
   that the bitmaps of its sets can hide.  The dual traversal drops a pair of
   nodes when their sizes, their components or their largest possible overlap
   exclude a new link.
5. Pairs never leave the trees.  Classes left with an open partner go on as
   rows, first to the same trees with bitmaps as wide as their sets need, then
   to those with the whole sets, where pairs are verified closest first and a
   link comes out if it joins two components.  So every step makes at most as
   many rows as it reads, also of groups whose pairs are all just under the
   threshold.  Shingles held by the same classes count as one, and a pair is
   left to an earlier shingle if both classes name that among their first.

Whole sets are compared by 40-bit shingle hashes.  Shingles with very many
classes are cut into blocks, every pair of blocks is a unit of its own, so no
task holds an unbounded group.

Defined results: null and word-free texts have no shingles and are their own
component; rows equal in doc_id and text are one document (one row); several
texts of one doc_id are rows of their own; component_id is the smallest
doc_id of the component (null only where no row of it has one); other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slimctx.llm.common import (arrow_batches, components, join_unique, sized_broadcast,
                                text_buffers)
from slimctx.llm.textvec import blocks, byte_values, lower_ascii, mix, segment_hashes, words
from slimctx.session import materialize

SHINGLE = 5
PERCENT = 80
TEXT_BLOCK = 1 << 20
COUNTED = 2_000_000       # shingles counted together in a task
HOT_DOCS = 100            # documents that make a shingle frequent
MAX_HOT = 200_000         # frequent shingles sent to every task, at most
CHAIN = 6                 # prefix shingles of a document that chain, of the rare
                          # and of the frequent ones
SALT = 8192               # classes of a frequent shingle chained together
GROUP_BLOCK = 1024        # classes of a shingle in one block, at most
LEAST_BLOCK = 256         # and at least
OPEN_BLOCK = 64           # at least, of the few classes left with an open partner
COPIES = 16               # blocks of a shingle, while they are below GROUP_BLOCK
BLOCK_SHINGLES = 2_000_000
FIRST = 8                 # first shingles that a row names
UNIT_ROWS, UNIT_BYTES = 8192, 32 << 20    # rows of whole units taken together
FANOUT = 8                # of the signature tree
BITS = 512
MAX_BROADCAST = 2_000_000

BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True


def need(percent: int, n):
    """The least intersection with any set that a set of n can link with."""
    return (percent * n + 99) // 100


def shingle_sets(data: np.ndarray, off: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    start, stop, doc = words(data, off, BLANK)
    n_docs = len(off) - 1
    if not len(start):
        for _ in range(n_docs):
            yield np.empty(0, np.uint64)
        return
    h = segment_hashes(byte_values(lower_ascii())[data], start, stop)
    bounds = np.searchsorted(doc, np.arange(n_docs + 1))
    first, last = bounds[:-1], bounds[1:]
    begin = np.arange(len(h))
    room = last[doc] - begin
    size = last[doc] - first[doc]
    ok = (room >= SHINGLE) | ((size < SHINGLE) & (begin == first[doc]))
    begin = begin[ok]
    end = begin + np.minimum(SHINGLE, size[ok])
    grams, gdoc = segment_hashes(h, begin, end), doc[ok]
    cuts = np.searchsorted(gdoc, np.arange(n_docs + 1))
    for i in range(n_docs):
        yield np.unique(grams[cuts[i]:cuts[i + 1]])


def _sets(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    data, off = text_buffers(batch.column("text"))
    for i, j in blocks(off, TEXT_BLOCK):
        yield from shingle_sets(data[off[i]:off[j]], off[i:j + 1] - off[i])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, n) of shingles met at least three times within COUNTED ones."""
    def flush(held):
        token, n = np.unique(np.concatenate(held), return_counts=True)
        token, n = token[n > 2], n[n > 2]
        return pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n)],
                                          names=["token", "n"])

    held, size = [], 0
    for batch in batches:
        for s in _sets(batch):
            held.append(s)
            size += len(s)
            if size >= COUNTED:
                yield flush(held)
                held, size = [], 0
    if held:
        yield flush(held)


def frequent_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(sorted shingles, counts) of at most MAX_HOT frequent shingles."""
    seen = materialize(docs.select("text").mapInArrow(_count, "token long, n long")
                       .groupBy("token").agg(F.sum("n").alias("n"))
                       .filter(F.col("n") >= HOT_DOCS), "frequent")
    total = seen.agg(F.sum("n")).first()[0] or 0
    hot = seen.filter(F.col("n") > total // MAX_HOT).toArrow()
    token = hot.column("token").to_numpy().view(np.uint64)
    order = np.argsort(token)
    return token[order], hot.column("n").to_numpy()[order]


def _is_hot(s: np.ndarray, hot: np.ndarray) -> np.ndarray:
    if not len(hot):
        return np.zeros(len(s), bool)
    return hot[np.minimum(np.searchsorted(hot, s), len(hot) - 1)] == s


def profiles(docs: DataFrame, hot: np.ndarray, percent: int) -> DataFrame:
    """(doc_id, rid, n, d1, d2, cold, prefix, bits) of every document; d1, d2
    digest the set, ``cold`` is the number of prefix shingles not in ``hot``."""
    out = ("doc_id long, rid long, n long, d1 long, d2 long, cold int, prefix binary, "
           "bits binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for s in _sets(batch):
                common = _is_hot(s, hot)
                k = len(s) - need(percent, len(s)) + 1 if len(s) else 0
                prefix = np.concatenate([s[~common], s[common]])[:k]
                bits = np.zeros(BITS, bool)
                bits[(s >> np.uint64(32)) % np.uint64(BITS)] = True
                rows.append((len(s), int(s.sum(dtype=np.uint64).view(np.int64)),
                             int(mix(s).sum(dtype=np.uint64).view(np.int64)),
                             min(k, int((~common).sum())), prefix.tobytes(),
                             np.packbits(bits).tobytes()))
            cols = list(zip(*rows)) if rows else [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("rid"),
                 *[pa.array(c, t) for c, t in zip(cols, kinds)]],
                names=["doc_id", "rid", "n", "d1", "d2", "cold", "prefix", "bits"])

    return docs.mapInArrow(run, out)


def prefix_rows(classes: DataFrame, hot: np.ndarray, counts: np.ndarray) -> DataFrame:
    """(token, salt, n, rid, chain) for every prefix shingle of the classes."""
    salts = np.maximum(-(-counts // SALT), 1).astype(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = batch.column("prefix").to_pylist()
            token = np.frombuffer(b"".join(blobs), np.uint64)
            size = np.array([len(b) // 8 for b in blobs], np.int64)
            at = np.repeat(np.arange(len(size)), size)
            rank = np.arange(len(token)) - np.repeat(np.cumsum(size) - size, size)
            rank -= batch.column("cold").to_numpy()[at]
            rid = batch.column("rid").to_numpy()[at]
            # classes are chained in another random order for each shingle
            nth = mix(token ^ mix(rid.view(np.uint64)))
            first = rank + batch.column("cold").to_numpy()[at]
            chain = (first < CHAIN) | ((rank >= 0) & (rank < CHAIN))
            salt = np.zeros(len(token), np.uint64)
            common = np.flatnonzero(rank >= 0)
            if len(common):
                t = token[common]
                salt[common] = (mix(t ^ rid[common].view(np.uint64))
                                % salts[np.searchsorted(hot, t)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(token.view(np.int64)), pa.array(salt.astype(np.int32)),
                 pa.array(batch.column("n").to_numpy()[at]), pa.array(rid),
                 pa.array(nth.view(np.int64)), pa.array(chain), pa.array(rank >= 0)],
                names=["token", "salt", "n", "rid", "nth", "chain", "hot"])

    return classes.select("rid", "n", "cold", "prefix").mapInArrow(
        run, "token long, salt int, n long, rid long, nth long, chain boolean, hot boolean")


def _chained(percent: int):
    """Sorted prefix rows to rows of shared shingles with the class before in
    ``prev`` if their sizes admit a link; two rows of the last batch are kept."""
    names = ["token", "salt", "n", "rid", "chain", "hot"]

    def emit(cols, lo, hi):
        token, salt, n, rid, chain, hot = cols
        same = np.zeros(len(token) + 1, bool)
        same[1:-1] = (token[1:] == token[:-1]) & (salt[1:] == salt[:-1])
        before = np.roll(rid, 1)
        near = np.roll(n, 1)
        fits = same[:-1] & chain & (100 * np.minimum(near, n) >= percent * np.maximum(near, n))
        take = np.zeros(len(token), bool)
        take[lo:hi] = (same[:-1] | same[1:] | hot)[lo:hi]
        return pa.RecordBatch.from_arrays(
            [pa.array(token[take]), pa.array(n[take]), pa.array(rid[take]),
             pa.array(before[take], mask=~fits[take])], names=["token", "n", "rid", "prev"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, lo = None, 0
        for batch in batches:
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
            if kept is not None:
                cols = [np.concatenate(x) for x in zip(kept, cols)]
            if not len(cols[0]):
                continue
            last = len(cols[0]) - 1
            yield emit(cols, lo, last)
            back = max(last - 1, 0)
            kept, lo = [c[back:] for c in cols], last - back
        if kept is not None:
            yield emit(kept, lo, len(kept[0]))
    return run


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(-1, dtype=np.int64)


def tree_pairs(unit: np.ndarray, side: np.ndarray, n: np.ndarray, comp: np.ndarray,
               bits: np.ndarray, percent: int, fanout: int = FANOUT):
    """Index pairs within units that may link and are in different components.

    Rows are sorted by (unit, n).  ``side``: 0 pairs with everything of its
    unit, else only with the other side.  The trees of all units are built
    and traversed level by level together."""
    levels = [{"unit": unit, "lo": n, "hi": n, "c0": comp, "c1": comp, "s0": side, "s1": side,
               "bits": bits, "hide": n - _popcount(bits), "kid": None, "kids": None}]
    while True:
        low = levels[-1]
        size = len(low["unit"])
        first = np.r_[True, low["unit"][1:] != low["unit"][:-1]]
        begin = np.flatnonzero(first)
        if len(begin) == size:
            break
        nth = np.arange(size) - np.repeat(begin, np.diff(np.r_[begin, size]))
        kid = np.flatnonzero(nth % fanout == 0)
        put = {k: f.reduceat(low[k], kid) for k, f in (
            ("lo", np.minimum), ("hi", np.maximum), ("c0", np.minimum), ("c1", np.maximum),
            ("s0", np.minimum), ("s1", np.maximum), ("hide", np.maximum))}
        levels.append(put | {"unit": low["unit"][kid], "kid": kid,
                             "bits": np.bitwise_or.reduceat(low["bits"], kid, axis=0),
                             "kids": np.diff(np.r_[kid, size])})

    def open_pairs(v, a, b):
        """The pairs of nodes that no bound excludes."""
        lo = np.maximum(v["lo"][a], v["lo"][b])
        keep = 100 * np.minimum(v["hi"][a], v["hi"][b]) >= percent * lo
        keep &= (v["c0"][a] != v["c1"][b]) | (v["c1"][a] != v["c0"][b])
        keep &= ~((v["s0"][a] == v["s1"][a]) & (v["s0"][b] == v["s1"][b])
                  & (v["s0"][a] == v["s0"][b]) & (v["s0"][a] > 0))
        a, b = a[keep], b[keep]
        if not len(a):
            return a, b
        shared = _popcount(v["bits"][a] & v["bits"][b])
        # inter >= percent (n_a + n_b) / (100 + percent)
        least = percent * (v["lo"][a] + v["lo"][b])
        room = np.minimum(v["hide"][a], v["hide"][b]) + shared
        keep = (a == b) | ((100 + percent) * room >= least)
        return a[keep], b[keep]

    top = levels[-1]
    a = b = np.arange(len(top["unit"]))
    a, b = open_pairs(top, a, b)
    for v, low in zip(reversed(levels[1:]), reversed(levels[:-1])):
        found = []
        for at in range(0, len(a), 1 << 15):
            p, q = a[at:at + (1 << 15)], b[at:at + (1 << 15)]
            i = np.arange(fanout)
            x = (v["kid"][p][:, None] + i)[:, :, None]
            y = (v["kid"][q][:, None] + i)[:, None, :]
            ok = ((i < v["kids"][p][:, None])[:, :, None] & (i < v["kids"][q][:, None])[:, None, :]
                  & (x <= y))
            x, y = np.broadcast_arrays(x, y)
            found.append(open_pairs(low, x[ok], y[ok]))
        a = np.concatenate([f[0] for f in found]) if found else np.empty(0, np.int64)
        b = np.concatenate([f[1] for f in found]) if found else np.empty(0, np.int64)
    apart = a != b
    return a[apart], b[apart]


def _bitmaps(column) -> np.ndarray:
    blob = b"".join(column.to_pylist())
    return np.frombuffer(blob, np.uint64).reshape(-1, BITS // 64)


def blocks_of(least: int):
    """The blocks of a token of k classes and w shingles."""
    most = F.least(F.greatest(F.ceil(F.col("k") / COPIES), F.lit(least)), F.lit(GROUP_BLOCK))
    return F.greatest(F.ceil(F.col("k") / most),
                      F.ceil(F.col("w") / BLOCK_SHINGLES)).cast("int").alias("blocks")


def with_blocks(rows: DataFrame) -> DataFrame:
    """``rows`` (token, n, rid, ...) with the number of their token's blocks."""
    size = rows.groupBy("token").agg(F.count("*").alias("k"), F.sum("n").alias("w"))
    size = materialize(size.select("token", "k", blocks_of(OPEN_BLOCK)), "sizes")
    return join_unique(rows, size, ["token"], "k", rows.count()).drop("k")


def dealt(rows: DataFrame) -> DataFrame:
    """``rows`` with ``blocks`` dealt to (token, b1, b2), the pairs of blocks
    of their token; ``block`` is a row's own one."""
    return (rows.withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .withColumn("b1", F.least("block", "other"))
            .withColumn("b2", F.greatest("block", "other")).drop("blocks", "other"))


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by (token, b1, b2, n) as tables of whole units."""
    held, rows, size = [], 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        size += batch.nbytes
        if rows < UNIT_ROWS and size < UNIT_BYTES:
            continue
        t = pa.Table.from_batches(held)
        key = [t.column(c).to_numpy() for c in ("token", "b1", "b2")]
        other = np.flatnonzero(np.logical_or.reduce([k != k[-1] for k in key]))
        cut = int(other[-1]) + 1 if len(other) else 0   # rows of the last unit wait
        if cut:
            yield t.slice(0, cut)
            held, rows = t.slice(cut).to_batches(), len(t) - cut
            size = sum(b.nbytes for b in held)
    if held:
        yield pa.Table.from_batches(held)


def _earlier(t: pa.Table) -> np.ndarray:
    """The tokens that each row names before its own, the rest the least long."""
    tokens = t.column("tokens").combine_chunks()
    size = tokens.value_lengths().to_numpy()
    at = np.repeat(np.arange(len(size)), size)
    nth = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
    out = np.full((len(size), FIRST), np.iinfo(np.int64).min)
    out[at, nth] = tokens.flatten().to_numpy()
    out[out >= t.column("token").to_numpy()[:, None]] = np.iinfo(np.int64).min
    return out


def _open(t: pa.Table, bits: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of the units that ``bits`` leave open and that are not left to
    a token which both rows name before this one."""
    key = [t.column(c).to_numpy() for c in ("token", "b1", "b2")]
    new = np.zeros(len(key[0]), bool)
    for k in key:
        new[1:] |= k[1:] != k[:-1]
    block = t.column("block").to_numpy()
    side = np.where(key[1] == key[2], 0, np.where(block == key[1], 1, 2))
    a, b = tree_pairs(np.cumsum(new), side, t.column("n").to_numpy(), t.column("comp").to_numpy(),
                      bits, percent)
    x = _earlier(t)
    y = np.where(x == np.iinfo(np.int64).min, np.iinfo(np.int64).max, x)
    met = np.zeros(len(a), bool)
    for at in range(0, len(a), 1 << 16):
        p, q = a[at:at + (1 << 16)], b[at:at + (1 << 16)]
        for i in range(FIRST):
            met[at:at + (1 << 16)] |= (x[p, i, None] == y[q]).any(1)
    return a[~met], b[~met]


def _near(t: pa.Table, wide: list[bytes], percent: int) -> list[tuple[float, int, int]]:
    """(share, a, b): the pairs of the units that wide bitmaps leave open, with
    the largest possible overlap as a share of both sets."""
    bits = np.stack([_fold(w, BITS // 64) for w in wide])
    first, second = _open(t, bits, percent)
    n = t.column("n").to_pylist()
    found = []
    for a, b in zip(first.tolist(), second.tolist()):
        da, db = _apart(wide[a], wide[b])
        most = min(n[a] - da, n[b] - db)
        if (100 + percent) * most >= percent * (n[a] + n[b]):
            found.append((most / (n[a] + n[b]), a, b))
    return found


def _kept(t: pa.Table, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
    keep = np.zeros(len(t), bool)
    keep[ends] = True
    return iter(t.select(["token", "n", "rid", "comp"]).filter(pa.array(keep)).to_batches())


def _with_open_pair(percent: int):
    """Rows of units to those with an open partner by their bitmaps."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _units(batches):
            yield from _kept(t, np.concatenate(_open(t, _bitmaps(t.column("bits")), percent)))
    return run


def _with_near_pair(percent: int):
    """Rows of units to those with an open partner by their wide bitmaps."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _units(batches):
            pairs = _near(t, t.column("wide").to_pylist(), percent)
            yield from _kept(t, np.array([x for _, a, b in pairs for x in (a, b)], np.int64))
    return run


def _new_links(percent: int):
    """Rows of units with their whole sets to the links that connect, with the
    known components, what all linking pairs of the units connect."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}            # of the task: its links all come out

        def root(c):
            while c in up:
                up[c] = c = up.get(up[c], up[c])
            return c

        for t in _units(batches):
            whole = [_unpack(x) for x in t.column("whole").to_pylist()]
            pairs = _near(t, [_wide(x, 8) for x in whole], percent)
            comp, rid = t.column("comp").to_pylist(), t.column("rid").to_pylist()
            links = []
            for _, a, b in sorted(pairs, reverse=True):
                x, y = root(comp[a]), root(comp[b])
                if x != y and _link(whole[a], whole[b], percent):
                    up[max(x, y)] = min(x, y)
                    links.append((min(rid[a], rid[b]), max(rid[a], rid[b])))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["a", "b"])
    return run


def _prune(percent: int):
    """Pairs whose bitmaps leave room for a link."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            if not t.num_rows:
                continue
            x, y = _bitmaps(t.column("abits")), _bitmaps(t.column("bbits"))
            na, nb = t.column("an").to_numpy(), t.column("bn").to_numpy()
            most = np.minimum(na - _popcount(x & ~y), nb - _popcount(y & ~x))
            keep = pa.array((100 + percent) * most >= percent * (na + nb))
            yield t.select(["a", "b"]).filter(keep)
    return run


def _pack(s: np.ndarray) -> bytes:
    """The upper 40 bits of sorted hashes."""
    return (s >> np.uint64(24)).astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].tobytes()


def _unpack(blob: bytes) -> np.ndarray:
    raw = np.zeros((len(blob) // 5, 8), np.uint8)
    raw[:, 3:] = np.frombuffer(blob, np.uint8).reshape(-1, 5)
    return raw.reshape(-1).view(">u8").astype(np.uint64)


def _wide(s: np.ndarray, low: int = 32) -> bytes:
    """A bitmap of the set by its bits from ``low`` on (8 for unpacked sets),
    the power of two from 4n bits on as its width."""
    width = max(BITS, 1 << (4 * len(s) - 1).bit_length()) if len(s) else BITS
    bits = np.zeros(width, bool)
    bits[(s >> np.uint64(low)) % np.uint64(width)] = True
    return np.packbits(bits).tobytes()


def _fold(wide: bytes, size: int) -> np.ndarray:
    """The bitmap of the same set with ``size`` words."""
    return np.bitwise_or.reduce(np.frombuffer(wide, np.uint64).reshape(-1, size), axis=0)


def _apart(x: bytes, y: bytes) -> tuple[int, int]:
    """The least number of shingles of x that are not in y, and of y not in
    x; the wider bitmap is folded to the width of the other."""
    size = min(len(x), len(y)) // 8
    fx, fy = _fold(x, size), _fold(y, size)
    return int(_popcount(fx & ~fy)), int(_popcount(fy & ~fx))


def _close(percent: int):
    """Pairs whose wide bitmaps leave room for a link."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            keep = []
            for na, nb, x, y in zip(*[t.column(c).to_pylist() for c in ("an", "bn", "aw", "bw")]):
                dx, dy = _apart(x, y)
                keep.append((100 + percent) * min(na - dx, nb - dy) >= percent * (na + nb))
            yield t.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def _whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = list(_sets(batch))
        yield pa.RecordBatch.from_arrays(
            [batch.column("rid"), pa.array([len(s) for s in sets], pa.int64()),
             pa.array([_wide(s) for s in sets], pa.binary()),
             pa.array([_pack(s) for s in sets], pa.binary())],
            names=["rid", "n", "wide", "whole"])


def _link(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    inter = int((both[1:] == both[:-1]).sum())
    return 100 * inter >= percent * (len(both) - inter)


def _linked(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            keep = [_link(_unpack(x), _unpack(y), percent)
                    for x, y in zip(t.column("x").to_pylist(), t.column("y").to_pylist())]
            yield t.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def whole_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(rid, n, wide, whole) of the documents in ``ids``, repeated rows repeated."""
    ids, _ = sized_broadcast(materialize(ids.select("rid").distinct(), "open-ids"), MAX_BROADCAST)
    return materialize(docs.join(ids, "rid", "left_semi").select("rid", "text").mapInArrow(
        _whole_sets, "rid long, n long, wide binary, whole binary"), "whole-sets")


def verify(pairs: DataFrame, docs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes that link, by their whole sets."""
    bits = classes.select("rid", "n", "bits")
    wide = (pairs.join(bits.toDF("a", "an", "abits"), "a").join(bits.toDF("b", "bn", "bbits"), "b")
            .select("a", "b", "an", "bn", "abits", "bbits"))
    left = materialize(wide.mapInArrow(_prune(percent), "a long, b long"), "open-pairs")
    sets = whole_sets(docs, left.select(F.col("a").alias("rid")).unionByName(
        left.select(F.col("b").alias("rid"))))
    wide, whole = sets.select("rid", "n", "wide"), sets.select("rid", "whole")
    near = materialize(
        left.join(wide.toDF("a", "an", "aw"), "a").join(wide.toDF("b", "bn", "bw"), "b")
        .select("a", "b", "an", "bn", "aw", "bw")
        .mapInArrow(_close(percent), "a long, b long"), "close-pairs")
    full = (near.join(whole.toDF("a", "x"), "a").join(whole.toDF("b", "y"), "b")
            .select("a", "b", "x", "y"))
    return materialize(full.mapInArrow(_linked(percent), "a long, b long"), "links")


def tree_links(placed: DataFrame, docs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect, with the components of ``placed`` (token, n,
    rid, comp), what all linking pairs that share a token connect."""
    names = ["token", "b1", "b2", "block", "n", "rid", "comp"]
    row = "token long, n long, rid long, comp long"
    # tokens of the same classes count once
    mixed = (placed.groupBy("token")
             .agg(F.count("*").alias("k"), F.min("comp").alias("c0"), F.max("comp").alias("c1"),
                  F.sum("n").alias("w"), F.bit_xor(F.xxhash64("rid")).alias("s0"),
                  F.bit_xor(F.xxhash64(F.lit(7), "rid")).alias("s1"))
             .filter("c0 < c1").groupBy("s0", "s1", "k", "w").agg(F.min("token").alias("token"))
             .select("token", "k", blocks_of(LEAST_BLOCK)))
    rows = materialize(join_unique(placed, materialize(mixed, "mixed"), ["token"], "k",
                                   placed.count()).drop("k"), "mixed-rows")
    named = materialize(rows.groupBy("rid").agg(
        F.slice(F.sort_array(F.collect_list("token")), 1, FIRST).alias("tokens"))
        .join(classes.select("rid", "bits"), "rid"), "named")

    def units(rows: DataFrame, side: DataFrame, given: str) -> DataFrame:
        return (dealt(rows).join(side, "rid").select(*names, "tokens", given)
                .repartition("token", "b1", "b2").sortWithinPartitions("token", "b1", "b2", "n"))

    def with_sets(given: str) -> DataFrame:
        return named.select("rid", "tokens").join(
            sets.select("rid", given).dropDuplicates(["rid"]), "rid")

    rows = materialize(units(rows, named, "bits")
                       .mapInArrow(_with_open_pair(percent), row).distinct(), "open-rows")
    sets = whole_sets(docs, rows)
    rows = materialize(units(with_blocks(rows), with_sets("wide"), "wide")
                       .mapInArrow(_with_near_pair(percent), row).distinct(), "near-rows")
    return materialize(units(with_blocks(rows), with_sets("whole"), "whole")
                       .mapInArrow(_new_links(percent), "a long, b long").distinct(), "tree-links")


def jaccard_join(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, rid, n_shingles, component_id, root) of ``docs`` (doc_id, text);
    ``rid`` identifies the text of a row, ``root`` the component, also where
    component_id is null or that of another component."""
    spark = docs.sparkSession
    arrow_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                       F.xxhash64("doc_id", "text").alias("rid"))
    hot, counts = frequent_shingles(docs)
    every = materialize(profiles(docs, hot, percent), "profiles")
    classes = materialize(
        every.filter("n > 0").groupBy("d1", "d2", "n")
        .agg(F.min("rid").alias("rid"), F.count("*").alias("copies"), F.first("cold").alias("cold"),
             F.first("prefix").alias("prefix"), F.first("bits").alias("bits")), "classes")

    rows = (prefix_rows(classes, hot, counts)
            .repartition("token", "salt").sortWithinPartitions("token", "salt", "nth"))
    shared = materialize(rows.mapInArrow(_chained(percent),
                                         "token long, n long, rid long, prev long"), "shared")
    first = materialize(shared.filter("prev is not null and prev <> rid")
                        .select(F.least("rid", "prev").alias("a"),
                                F.greatest("rid", "prev").alias("b")).distinct(), "chain-pairs")
    links = verify(first, docs, classes, percent)

    roots = components(links)
    placed = materialize(
        shared.select("token", "n", "rid")
        .join(roots, F.col("rid") == F.col("node"), "left")
        .select("token", "n", "rid", F.coalesce("root", "rid").alias("comp")), "placed")
    links = links.unionByName(tree_links(placed, docs, classes, percent))

    roots = components(links)
    known = classes.select("d1", "d2", "n", "rid", "copies").join(
        roots, F.col("rid") == F.col("node"), "left").select(
        "d1", "d2", "n", "copies", F.coalesce("root", "rid").alias("root"))
    member = materialize(join_unique(
        every.filter("n > 0").select("doc_id", "rid", "n", "d1", "d2"), known,
        ["d1", "d2", "n"], "copies", every.count()).select("doc_id", "rid", "n", "root"), "members")
    least = member.groupBy("root").agg(F.min("doc_id").alias("component_id"),
                                       F.count("*").alias("w"))
    linked = join_unique(member, least, ["root"], "w", member.count())
    alone = (every.filter("n = 0").withColumn("component_id", F.col("doc_id"))
             .withColumn("root", F.col("rid")))
    cols = ["doc_id", "rid", F.col("n").alias("n_shingles"), "component_id", "root"]
    return linked.select(*cols).unionByName(alone.select(*cols)).distinct()


def op7_query(docs: DataFrame) -> DataFrame:
    """Components of documents with a shingle similarity of 0.8 or more."""
    return jaccard_join(docs.select("doc_id", "text")).drop("rid", "root")


OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i + 1 : i + 5], ' ') AS sh
  FROM (SELECT doc_id, ws, unnest(range(0, greatest(len(ws) - 4, 1))) AS i FROM w WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), links AS (
  SELECT a, b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k
    FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id
  ) p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
  WHERE 100 * k >= 80 * (na.n + nb.n - k)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM w
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), low AS (
  SELECT a, min(b) AS component_id FROM reach GROUP BY a
)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, component_id
FROM w JOIN low ON low.a = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id
"""
