"""Cross-tokenizer alignment with inverted pair bitmaps.

Two tokenizers cut the same bytes.  Wherever a token of A and a token of B end
at the same byte offset a group ends; tokens of one group are linked, each of A
with each of B.  How many documents hold a pair of ids linked says how well the
pair translates from one vocabulary to the other.

**Postings.**  A task numbers its documents in chunks of at most ``CHUNK_DOCS``
documents and ``CHUNK_LINKS`` (document, pair) entries.  For a pair and a chunk
it writes compressed bitmaps of the chunk's documents: plane -1 holds the
documents with the pair, plane ``j`` those where bit ``j`` of (number of links
- 1) is set.  A bitmap of few documents is a list of 16-bit positions, a dense
one is 4,096 bytes.  Every document of a chunk is one bit, so the OR over the
batches that make up a chunk sets bits, bitmaps of different chunks are
disjoint, and popcounts add up: the sum over plane -1 is the pair's number of
documents, the sum over all planes weighted by ``2 ** j`` its number of links.

**Scores.**  The popcounts are summed per pair (partial sums before the
shuffle), the highest count of each id of A is broadcast (one row per id, so at
most the vocabulary).  Counts join the bitmaps by pair; a pair has at most one
bitmap per chunk and plane, so no pair can hold a large share of the rows.  The
scored bitmaps then go to their chunk, whose task adds them up into two arrays
of CHUNK_DOCS numbers: one row per document comes back.

Tokens are ids of whole texts.  A works on a blank and the text; B adds that
blank itself.  A is byte-level BPE: its merges are applied in the order of their
ids by ``tiktoken``; texts with very long runs of one kind of character go
through ``tokenizers`` instead, whose time stays linear there (equal ids).

Defined results: null and empty texts, and texts that a tokenizer does not give
back byte by byte, have no tokens, all numbers 0 and an empty groups digest;
repeated rows are documents of their own; doc_id is only carried along and may
be null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slimctx.llm.common import arrow_batches
from slimctx.session import materialize

VOCABULARY_A = "/opt/tokenizers/byte_bpe_50k.json"
VOCABULARY_B = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK_DOCS, CHUNK_LINKS = 1 << 15, 1 << 22
DENSE_BYTES = CHUNK_DOCS // 8
#: Characters of text that are aligned at a time, and open sums of a task.
BLOCK, OPEN_CHUNKS = 1 << 18, 64
#: Groups of more links are counted by distinct ids, others link by link.
LARGE_GROUP = 256
ID_BITS = 21
# Fixed value: how byte-level BPE cuts a text before it merges.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LONG_RUN = re.compile(r"\S{5000}|\s{5000}")
_BYTE_PIECE = re.compile(r"<0x([0-9A-Fa-f]{2})>")
DOC = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
SCHEMA = ("chunk long, pos int, doc_id long, n_a long, n_b long, n_groups long, n_links long, "
          "groups_sha256 string, a int, b int, plane int, bits binary")
_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
_ARROW = pa.schema([(n, _KINDS[t]) for n, t in (x.split() for x in SCHEMA.split(", "))])


class ByteBPE:
    """Tokenizer A from its JSON text: ids of texts, bytes of ids."""

    def __init__(self, spec: str):
        import tiktoken

        self.spec, self._slow = spec, None
        data = json.loads(spec)
        special = {t["content"] for t in data.get("added_tokens", [])}
        vocab = {t: i for t, i in data["model"]["vocab"].items() if t not in special}
        merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in data["model"]["merges"]]
        if any(x >= y for x, y in zip(merged, merged[1:])):
            raise ValueError("the merges of this vocabulary are not in the order of their ids")
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        char = {chr(b): b for b in shown} | {
            chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        ranks = {bytes(char[c] for c in t): i for t, i in vocab.items()}
        self.token = [b""] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            self.token[i] = t
        self._fast = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if _LONG_RUN.search(text) is None:
            return self._fast.encode_ordinary(text)
        if self._slow is None:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_str(self.spec)
            self._slow.encode_special_tokens = True
        return self._slow.encode(text, add_special_tokens=False).ids


class Pieces:
    """Tokenizer B from the bytes of its model."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.token = [bytes([int(m[1], 16)]) if (m := _BYTE_PIECE.fullmatch(n))
                      else n.replace("▁", " ").encode() for n in names]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def _starts(group: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(first index, size) of each of the ``n`` groups of sorted ``group``."""
    size = np.bincount(group, minlength=n)
    return np.cumsum(size) - size, size


class Aligner:
    """Aligns batches of texts."""

    def __init__(self, spec_a: str, model_b: bytes):
        self.a, self.b = ByteBPE(spec_a), Pieces(model_b)
        self.size_a = np.array([len(t) for t in self.a.token], np.int64)
        self.size_b = np.array([len(t) for t in self.b.token], np.int64)
        n_a, n_b = len(self.size_a), len(self.size_b)
        self.written = [sep + str(i) for sep, n in (("", n_a), (";", n_a), (",", n_a), ("|", n_b), (",", n_b))
                        for i in range(n)]

    def _tokens(self, texts: list[str | None]) -> list[tuple[int, list[int], list[int]]]:
        full = [i for i, t in enumerate(texts) if t]
        out = []
        for i, b in zip(full, self.b.encode([texts[i] for i in full])):
            a, raw = self.a.encode(" " + texts[i]), (" " + texts[i]).encode()
            if (b"".join(map(self.a.token.__getitem__, a)) == raw
                    and b"".join(map(self.b.token.__getitem__, b)) == raw):
                out.append((i, a, b))
        return out

    def __call__(self, texts: list[str | None]):
        """(n_a, n_b, n_groups, n_links) arrays and group digests per text, and
        (text, a << ID_BITS | b, number of links) arrays in the order of texts."""
        found = self._tokens(texts)
        numbers, digests = np.zeros((4, len(texts)), np.int64), [""] * len(texts)
        if not found:
            return numbers, digests, (np.empty(0, np.int64),) * 3
        who = np.array([i for i, _, _ in found])
        len_a, len_b = (np.array([len(x[k]) for x in found]) for k in (1, 2))
        a = np.fromiter((x for f in found for x in f[1]), np.int64, len_a.sum())
        b = np.fromiter((x for f in found for x in f[2]), np.int64, len_b.sum())
        # a text ends at the same byte for both, so one running sum serves all
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        ends = np.intersect1d(end_a, end_b, assume_unique=True)
        in_a, in_b = np.searchsorted(ends, end_a), np.searchsorted(ends, end_b)
        first_a, n_a = _starts(in_a, len(ends))
        first_b, n_b = _starts(in_b, len(ends))
        stop_a = np.cumsum(len_a)
        stop_group = in_a[stop_a - 1] + 1
        text_of = np.repeat(np.arange(len(found)), np.diff(stop_group, prepend=0))
        links = n_a * n_b
        numbers[:, who] = (len_a, len_b, np.diff(stop_group, prepend=0),
                           np.add.reduceat(links, np.r_[0, stop_group[:-1]]))

        sep_a = np.where(np.arange(len(a)) == first_a[in_a], 1, 2)
        sep_a[stop_a - len_a] = 0
        opens_b = np.arange(len(b)) == first_b[in_b]
        code = np.empty(len(a) + len(b), np.int64)
        v_a, v_b = len(self.size_a), len(self.size_b)
        code[np.arange(len(a)) + first_b[in_a]] = sep_a * v_a + a
        code[np.arange(len(b)) + (first_a + n_a)[in_b]] = 3 * v_a + np.where(opens_b, 0, v_b) + b
        at = 0
        for i, stop in zip(who, np.cumsum(len_a + len_b)):
            digests[i] = hashlib.sha256("".join(
                map(self.written.__getitem__, code[at:stop].tolist())).encode()).hexdigest()
            at = stop

        small = links <= LARGE_GROUP
        times = np.where(small, n_b, 0)[in_a]
        left = np.repeat(np.arange(len(a)), times)
        nth = np.arange(len(left)) - np.repeat(np.cumsum(times) - times, times)
        group = in_a[left]
        keys = [text_of[group] << 2 * ID_BITS | a[left] << ID_BITS | b[first_b[group] + nth]]
        counts = [np.ones(len(left), np.int64)]
        for g in np.flatnonzero(~small):
            ids_a, times_a = np.unique(a[first_a[g]:first_a[g] + n_a[g]], return_counts=True)
            ids_b, times_b = np.unique(b[first_b[g]:first_b[g] + n_b[g]], return_counts=True)
            keys.append((text_of[g] << 2 * ID_BITS | ids_a[:, None] << ID_BITS | ids_b).ravel())
            counts.append(np.outer(times_a, times_b).ravel())
        key, count = np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(key)
        key, count = key[order], count[order]
        cut = np.flatnonzero(np.diff(key, prepend=-1))
        key, count = key[cut], np.add.reduceat(count, cut)
        return numbers, digests, (who[key >> 2 * ID_BITS], key & (1 << 2 * ID_BITS) - 1, count)


def _batch(**columns) -> pa.RecordBatch:
    """A batch of SCHEMA; what is not given is null."""
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays(
        [columns[f.name] if isinstance(columns.get(f.name), pa.Array)
         else pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type)
         for f in _ARROW], schema=_ARROW)


def bitmaps(chunk: int, pos: np.ndarray, pair: np.ndarray, count: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The compressed bitmaps of a chunk's entries (ascending ``pos``), plane by plane."""
    for plane in range(-1, int(count.max(initial=1) - 1).bit_length()):
        here = (count - 1) >> plane & 1 == 1 if plane >= 0 else np.ones(len(pos), bool)
        if not here.any():
            continue
        order = np.argsort(pair[here], kind="stable")
        p, docs = pair[here][order], pos[here][order].astype("<u2")
        cut = np.flatnonzero(np.diff(p, prepend=-1))
        size = np.diff(cut, append=len(p))
        dense = size * 2 >= DENSE_BYTES
        same = {"a": p[cut] >> ID_BITS, "b": p[cut] & (1 << ID_BITS) - 1}
        if not dense.all():
            flat = docs[~np.repeat(dense, size)]
            offsets = np.r_[0, np.cumsum(size[~dense] * 2)].astype(np.int32)
            bits = pa.Array.from_buffers(pa.binary(), len(offsets) - 1,
                                         [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
            yield _batch(chunk=np.full(len(bits), chunk), plane=np.full(len(bits), plane), bits=bits,
                         **{k: v[~dense] for k, v in same.items()})
        for i in np.flatnonzero(dense):
            marks = np.zeros(CHUNK_DOCS, bool)
            marks[docs[cut[i]:cut[i] + size[i]]] = True
            yield _batch(chunk=[chunk], plane=[plane], bits=[np.packbits(marks, bitorder="little").tobytes()],
                         **{k: v[i:i + 1] for k, v in same.items()})


def postings(docs: DataFrame, vocabulary_a: str = VOCABULARY_A, vocabulary_b: str = VOCABULARY_B) -> DataFrame:
    """``docs(doc_id, text)`` to two kinds of rows in one written table: one per
    document (``pos`` set) and one per bitmap (``bits`` set)."""
    arrow_batches(docs.sparkSession)
    with open(vocabulary_a, encoding="utf-8") as f:
        spec = f.read()
    with open(vocabulary_b, "rb") as f:
        model = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = Aligner(spec, model)
        chunk, used, held, entries = TaskContext.get().partitionId() << 32, 0, 0, []
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            i = 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and (j == i or size + len(texts[j] or "") <= BLOCK):
                    size += len(texts[j] or "")
                    j += 1
                if used + j - i > CHUNK_DOCS or held > CHUNK_LINKS:
                    yield from bitmaps(chunk, *map(np.concatenate, zip(*entries)))
                    chunk, used, held, entries = chunk + 1, 0, 0, []
                numbers, digests, (text, pair, count) = align(texts[i:j])
                yield _batch(chunk=np.full(j - i, chunk), pos=np.arange(used, used + j - i),
                             doc_id=ids.slice(i, j - i), groups_sha256=digests,
                             **dict(zip(DOC[1:5], numbers)))
                entries.append(((used + text).astype(np.uint16), pair, count.astype(np.int32)))
                used, held, i = used + j - i, held + len(pair), j
        if entries:
            yield from bitmaps(chunk, *map(np.concatenate, zip(*entries)))

    return materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
                       .mapInArrow(run, SCHEMA), "postings")


def pair_scores(maps: DataFrame) -> DataFrame:
    """(a, b, docs, links, best) per pair of ids: the popcounts of its bitmaps
    and whether no other pair of ``a`` is found in more documents."""
    held = (F.when(F.octet_length("bits") == DENSE_BYTES, F.bitmap_count("bits"))
            .otherwise(F.octet_length("bits") / 2).cast("long"))
    pairs = materialize(maps.groupBy("a", "b").agg(
        F.sum(F.when(F.col("plane") < 0, held).otherwise(0)).alias("docs"),
        F.sum(held * _weight()).alias("links")), "pairs")
    top = pairs.groupBy("a").agg(F.max("docs").alias("top"))
    return (pairs.join(F.broadcast(top), "a")
            .select("a", "b", "docs", "links", (F.col("docs") == F.col("top")).alias("best")))


def _weight():
    return F.expr("shiftleft(1L, greatest(plane, 0))")


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, pos, n_best, count_sum): what scored bitmaps add to their documents."""
    open_: dict[int, np.ndarray] = {}

    def close(chunk: int) -> pa.RecordBatch:
        best, total = open_.pop(chunk)
        at = np.flatnonzero(total)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(at), chunk)), pa.array(at.astype(np.int32)), pa.array(best[at]),
             pa.array(total[at])], names=["chunk", "pos", "n_best", "count_sum"])

    for batch in batches:
        chunks, docs, best, weight = (batch.column(c).to_numpy(zero_copy_only=False)
                                      for c in ("chunk", "docs", "best", "weight"))
        bits = batch.column("bits")
        start = np.frombuffer(bits.buffers()[1], np.int32)[bits.offset:bits.offset + len(bits) + 1]
        data = np.frombuffer(bits.buffers()[2], np.uint8)
        size = np.diff(start)
        order = np.argsort(chunks, kind="stable")
        cuts = np.flatnonzero(np.diff(chunks[order], prepend=-1))
        for rows in np.split(order, cuts[1:]):
            chunk = int(chunks[rows[0]])
            if chunk not in open_ and len(open_) == OPEN_CHUNKS:
                yield close(next(iter(open_)))
            sums = open_.setdefault(chunk, np.zeros((2, CHUNK_DOCS), np.int64))
            dense = size[rows] == DENSE_BYTES
            for r in rows[dense]:
                at = np.flatnonzero(np.unpackbits(data[start[r]:start[r + 1]], bitorder="little"))
                sums[:, at] += np.array([[weight[r] * best[r]], [weight[r] * docs[r]]])
            rows = rows[~dense]
            n = size[rows] // 2
            nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            low = np.repeat(start[rows].astype(np.int64), n) + 2 * nth
            at = data[low] | data[low + 1].astype(np.int64) << 8
            np.add.at(sums[0], at, np.repeat(weight[rows] * best[rows], n))
            np.add.at(sums[1], at, np.repeat(weight[rows] * docs[rows], n))
    for chunk in list(open_):
        yield close(chunk)


def align(docs: DataFrame, vocabulary_a: str = VOCABULARY_A,
          vocabulary_b: str = VOCABULARY_B) -> tuple[DataFrame, DataFrame]:
    """(documents, pairs) of ``docs(doc_id, text)``: documents as DOC with
    n_best and count_sum, pairs as in ``pair_scores``."""
    written = postings(docs, vocabulary_a, vocabulary_b)
    maps = written.filter("bits is not null").select("chunk", "a", "b", "plane", "bits")
    pairs = materialize(pair_scores(maps), "scores")
    scored = (maps.join(pairs.select("a", "b", "docs", F.col("best").cast("long").alias("best")), ["a", "b"])
              .select("chunk", "bits", "docs", "best", _weight().alias("weight")))
    sums = (scored.repartition("chunk").mapInArrow(_sums, "chunk long, pos int, n_best long, count_sum long")
            .groupBy("chunk", "pos").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")))
    rows = written.filter("pos is not null").select("chunk", "pos", *DOC).join(sums, ["chunk", "pos"], "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum")]
    return rows.select(*DOC[:5], *zero, DOC[5]), pairs


def op12_query(docs: DataFrame) -> DataFrame:
    """Both public vocabularies over all documents."""
    return align(docs.select("doc_id", "text"))[0]
