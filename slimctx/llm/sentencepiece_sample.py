"""SentencePiece encoding and decoding with samples without replacement.

Segmentations of a text are drawn by Gumbel top-k: each segmentation has a
perturbed log probability, its own plus a Gumbel variate, and the k largest
are k distinct samples.  The search is A-star over sets of segmentations: a set
is "this prefix, then not these pieces, then anything", its bound is the
exact maximum of the perturbed values in it, a Gumbel variate at the log of its
probability truncated at the bound of the set it came from.  The set of
largest bound is opened, the maximum's segmentation drawn from it, and what is
left of the set is split at every piece of that segmentation.  Bounds are
exact, so sets are opened in the order of the samples.

The inclusion score of a sample is the logarithm of the probability that its
perturbed value exceeds the (k+1)-th largest one.

All random numbers are hashes of (seed, row key, rank, position in the text):
results do not depend on batches, partitions or retries.

Lattices, draws, sums and bounds are vectorised over a batch of texts
(``piece_lattice``).  Decoding concatenates the pieces' bytes.

Defined results: null and empty texts have one segmentation without pieces,
with log probability and inclusion score 0; a text with fewer than k
segmentations gives all of them with inclusion score 0 (certain); repeated
rows give equal results; a null doc_id is a key like others; other columns are
ignored.  A text is held whole by one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slimctx.llm.common import arrow_batches
from slimctx.llm.piece_lattice import (Lattice, Vocabulary, code_points, distinct_segments,
                                       segments)
from slimctx.llm.textvec import mix

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES = 2
ALPHA = 0.5
SEED = 17
BLOCK = 1 << 17          # code points worked on at once
CHOICE, BOUND, ROOT = 1, 2, 3
SCHEMA = ("doc_id long, rank int, ids array<int>, log_prob double, log_inclusion double, "
          "decoded_sha256 string, exact boolean")


def uniform(key: np.ndarray, rank: int, pos: np.ndarray, use: int) -> np.ndarray:
    """Hashed numbers in (0, 1)."""
    x = mix(key ^ mix(np.uint64(rank * 4 + use) + (pos.astype(np.uint64) << np.uint64(16))))
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0 ** 53


def truncated(mean: np.ndarray, bound: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel variates at ``mean`` given that they are below ``bound``."""
    with np.errstate(over="ignore", invalid="ignore"):
        g = mean - np.log(np.exp(mean - bound) - np.log(u))
    return np.where(np.isneginf(mean), -np.inf, np.minimum(g, bound))


def _cuts(owner: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(owner, np.arange(n + 1))


class Batch:
    """Samples of texts that have at least one code point."""

    def __init__(self, texts: list[str], keys: np.ndarray, vocab: Vocabulary):
        self.vocab, self.keys, self.n = vocab, keys, len(texts)
        self.cp, off = code_points(texts)
        begin = segments(self.cp, off, vocab)
        cp, own, index = distinct_segments(self.cp, begin)
        self.lattice = Lattice(cp, own, vocab)
        self.state = own[index]                       # where each part starts
        self.base = begin - self.state                # text position of state 0
        self.part_doc = np.searchsorted(off, begin, "right") - 1
        self.base -= off[self.part_doc]
        self.parts = _cuts(self.part_doc, self.n)

    def _free(self, part: np.ndarray, state: np.ndarray, rank: int):
        """Draw parts ``part`` from ``state`` on: (edges, part of each)."""
        key = self.keys[self.part_doc[part]]
        e, i = self.lattice.walk(state, self.base[part],
                                 lambda live, pos: uniform(key[live], rank, pos, CHOICE))
        return e, part[i]

    def _bounds(self, s: dict, rank: int) -> None:
        """Bounds of what each step of a sample leaves out."""
        lat, doc = self.lattice, self.part_doc[s["part"]]
        lq = lat.lq[s["edge"]]
        cut = s["cut"] = _cuts(doc, self.n)
        s["before"], s["log_prob"] = np.empty(len(lq)), np.zeros(self.n)
        for d, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())):
            if a < b:      # each text summed alone: no rounding from its neighbours
                upto = np.cumsum(lq[a:b])
                s["before"][a:b] = upto - lq[a:b]
                s["log_prob"][d] = upto[-1]
        mean = s["before"] + lat.other(s["edge"])
        step = np.arange(len(doc)) - cut[doc]
        mean[step < s["from"][doc]] = -np.inf         # split off by an earlier sample
        pos = self.base[s["part"]] + lat.start[s["edge"]]
        s["g"] = truncated(mean, s["bound"][doc], uniform(self.keys[doc], rank, pos, BOUND))

    def samples(self, k: int) -> tuple[list[dict], np.ndarray]:
        """Up to k samples and, per text, the (k+1)-th perturbed value.

        A sample holds ``docs`` (texts it exists for), edges, parts, cuts,
        log_prob and bound (its perturbed value)."""
        n, lat = self.n, self.lattice
        every = np.arange(len(self.state))
        edge, part = self._free(every, self.state, 1)
        u = uniform(self.keys, 1, np.zeros(n, np.int64), ROOT)
        s = {"docs": np.arange(n), "edge": edge, "part": part, "bound": -np.log(-np.log(u)),
             "from": np.zeros(n, np.int64)}
        self._bounds(s, 1)
        out, barred = [s], {}
        for rank in range(2, k + 2):
            best = np.full(n, -np.inf)
            which = np.zeros(n, np.int64)
            for j, o in enumerate(out):
                full = np.flatnonzero(o["cut"][1:] > o["cut"][:-1])
                top = np.full(n, -np.inf)
                if len(full):
                    top[full] = np.maximum.reduceat(o["g"], o["cut"][full])
                o["top"] = top
                which[top > best] = j
                best = np.maximum(best, top)
            if rank == k + 1:
                return out, best
            docs = np.flatnonzero(best > -np.inf)
            if not len(docs):
                return out, best
            out.append(self._open(out, docs, which, best, barred, rank))
        return out, best

    def _open(self, out: list[dict], docs: np.ndarray, which: np.ndarray, best: np.ndarray,
              barred: dict, rank: int) -> dict:
        """The next sample of ``docs``, from the open set of largest bound."""
        lat = self.lattice
        heads, parts, states = [], [], []
        from_ = np.zeros(self.n, np.int64)
        tops = []
        for d in docs:
            o = out[which[d]]
            a, b = o["cut"][d], o["cut"][d + 1]
            t = a + int(np.argmax(o["g"][a:b]))
            tops.append((a, t, o["part"][t], lat.start[o["edge"][t]]))
        pos = np.array([self.base[part] + p for _, _, part, p in tops])
        choice = uniform(self.keys[docs], rank, pos, CHOICE)
        means = np.empty(len(docs))
        for i, (d, (a, t, part, p)) in enumerate(zip(docs, tops)):
            o, step = out[which[d]], t - a
            not_these = barred.setdefault((which[d], t), [o["edge"][t]])
            edges = np.array([x for x in range(lat.first[p], lat.first[p + 1])
                              if x not in not_these])
            odds = np.cumsum(lat.q[edges])
            e = edges[min(np.searchsorted(odds, choice[i] * odds[-1], "right"), len(edges) - 1)]
            # what is left of the opened set stays open in the parent, with
            # this sample's value as its bound
            not_these.append(e)
            rest = lat.q[edges[edges != e]].sum()
            means[i] = o["before"][t] + (np.log(rest) if rest > 0 else -np.inf)
            from_[d] = step + 1
            heads.append((np.append(o["edge"][a:t], e), np.append(o["part"][a:t], part)))
            more = np.arange(part + 1, self.parts[d + 1])
            state = self.state[more]
            if lat.to[e] < lat.stop[p]:
                more, state = np.append(part, more), np.append(lat.to[e], state)
            parts.append(more), states.append(state)
        left = truncated(means, best[docs], uniform(self.keys[docs], rank, pos, BOUND))
        for d, (_, t, _, _), g in zip(docs, tops, left):
            out[which[d]]["g"][t] = g
        edge, part = self._free(np.concatenate(parts), np.concatenate(states), rank)
        cut = _cuts(self.part_doc[part], self.n)
        edges, owners = [], []
        for (he, hp), d in zip(heads, docs):
            edges += [he, edge[cut[d]:cut[d + 1]]]
            owners += [hp, part[cut[d]:cut[d + 1]]]
        s = {"docs": docs, "edge": np.concatenate(edges), "part": np.concatenate(owners),
             "bound": best.copy(), "from": from_}
        self._bounds(s, rank)
        return s

    def ids(self, s: dict) -> tuple[np.ndarray, np.ndarray]:
        """(piece ids, cuts per text): byte edges become their byte pieces."""
        lat, v = self.lattice, self.vocab
        piece = lat.piece[s["edge"]].astype(np.int64)
        bare = np.flatnonzero(piece < 0)
        if not len(bare):
            return piece, s["cut"]
        raw = [chr(0x2581 if c == 0x110000 else c).encode("utf-8")
               for c in lat.cp[lat.start[s["edge"][bare]]].tolist()]
        size = np.ones(len(piece), np.int64)
        size[bare] = [len(r) for r in raw]
        out = np.repeat(piece, size)
        out[out < 0] = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64) + v.bytes_at
        return out, np.r_[0, np.cumsum(size)][s["cut"]]


def encode_texts(texts: list[str], keys: np.ndarray, vocab: Vocabulary, k: int) -> list[list]:
    """Per text the list of (ids, log_prob, log_inclusion), best rank first."""
    out: list[list] = [[] for _ in texts]
    full = [i for i, t in enumerate(texts) if t]
    for i, t in enumerate(texts):
        if not t:
            out[i].append((np.empty(0, np.int64), 0.0, 0.0))
    if full:
        b = Batch([texts[i] for i in full], keys[full], vocab)
        found, kappa = b.samples(k)
        for s in found:
            ids, cut = b.ids(s)
            over = s["log_prob"] - kappa     # log(1 - exp(-exp(over))), about over if small
            with np.errstate(over="ignore", divide="ignore"):
                log_in = np.where(over < -30, over, np.log(-np.expm1(-np.exp(over))))
            for d in s["docs"]:
                out[full[d]].append((ids[cut[d]:cut[d + 1]], float(s["log_prob"][d]),
                                     float(min(log_in[d], 0.0))))
    return out


def encode(docs: DataFrame, model: str = MODEL, samples: int = SAMPLES, alpha: float = ALPHA,
           seed: int = SEED) -> DataFrame:
    """(doc_id, rank, ids, log_prob, log_inclusion, decoded_sha256, exact) of
    ``docs`` (doc_id, text); ``exact`` tells whether the ids decode to the
    text, whose digest is ``decoded_sha256``."""
    arrow_batches(docs.sparkSession)
    vocab = Vocabulary.load(model, alpha)
    kinds = [pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.float64(), pa.float64(),
             pa.string(), pa.bool_()]
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def rows(ids: list[int | None], texts: list[str], keys: np.ndarray) -> pa.RecordBatch:
        cols: list[list] = [[] for _ in names]
        flat, sizes = [], [0]
        for doc_id, text, found in zip(ids, texts, encode_texts(texts, keys, vocab, samples)):
            plain = text.encode()
            for rank, (pieces, log_prob, log_in) in enumerate(found, 1):
                back = vocab.joined(pieces)
                flat.append(pieces.astype(np.int32))
                sizes.append(len(pieces))
                digest = hashlib.sha256(back).hexdigest()
                for c, x in zip(cols, (doc_id, rank, None, log_prob, log_in, digest,
                                       back == plain)):
                    c.append(x)
        lists = pa.ListArray.from_arrays(
            pa.array(np.cumsum(sizes), pa.int32()),
            pa.array(np.concatenate(flat) if flat else np.empty(0, np.int32), pa.int32()))
        return pa.RecordBatch.from_arrays(
            [lists if n == "ids" else pa.array(c, t) for n, c, t in zip(names, cols, kinds)],
            names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            texts = [t or "" for t in batch.column("text").to_pylist()]
            keys = batch.column("key").to_numpy().view(np.uint64)
            i = 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and (j == i or size + len(texts[j]) <= BLOCK):
                    size += len(texts[j])
                    j += 1
                yield rows(ids[i:j], texts[i:j], keys[i:j])
                i = j

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                        F.xxhash64(F.lit(seed), F.col("doc_id")).alias("key"))
            .mapInArrow(run, SCHEMA))


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """``encoded`` with ``ids`` (array<int>) replaced by the decoded ``text``."""
    arrow_batches(encoded.sparkSession)
    vocab = Vocabulary.load(model, 1.0)
    keep = [c for c in encoded.columns if c not in ("ids", "text")]
    sent = encoded.select(F.struct(*keep).alias("row"), "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"),
                 pa.array([None if x is None else vocab.decode(x)
                           for x in batch.column("ids").to_pylist()], pa.string())],
                names=["row", "text"])

    schema = sent.select("row").schema.add("text", "string")
    return sent.mapInArrow(run, schema).select(*[F.col("row")[c].alias(c) for c in keep], "text")


def op5_query(docs: DataFrame) -> DataFrame:
    """Two sampled segmentations of every document, and their way back."""
    return encode(docs.select("doc_id", "text"))
