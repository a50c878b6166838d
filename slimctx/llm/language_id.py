"""Language identification by error-correcting output codes.

Every language gets a codeword of signs; a binary n-gram classifier per code
position says which sign a text has.  The classifiers are weighted byte
3-grams (log odds of the mean gram distributions of both sides, so a frequent
language does not outweigh a rare one).  Decoding sums, for every codeword,
the logistic loss of each position weighted by how far apart that position
holds its two sides; the codeword of least loss wins, and a text is flagged
ambiguous when the runner-up is close.

Learning reads at most ``per_lang`` labelled documents of each language,
chosen by the hash of their doc_id; everything is predicted from the whole text alone.

Defined results: ``und`` with score 0 if the text is null or has no letter, or
if nothing could be learned; a text with letters but no 3-gram gets the first
language in code order, flagged ambiguous; rows with a null doc_id are
predicted but never learned from and not held out; repeated rows are predicted
each; null labels are never learned; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from slimctx.llm.common import arrow_batches, sized_broadcast, text_buffers
from slimctx.session import materialize

PER_LANG = 2000        # labelled documents read for each language, at most
MAX_LANGS = 1000       # for which the counts of languages are broadcast
AMBIGUOUS = 0.2        # least distance of the two best scores
SLOTS = 1 << 16        # of hashed 3-grams
SHARPNESS = 4.0        # of the logistic loss
BLOCK = 1 << 19        # bytes scored at once
UNKNOWN = "und"

#: Bytes that are no letters count as blanks; A-Z as a-z.
_FOLD = np.full(256, 32, np.uint8)
_FOLD[128:] = np.arange(128, 256)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def _slots(data: np.ndarray) -> np.ndarray:
    """The hashed 3-gram that starts at each byte but the last two."""
    b = _FOLD[data].astype(np.uint32)
    code = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int32)


BLANK = int(_slots(np.full(3, 32, np.uint8))[0])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, slot, n) of all rows (lang, text) of the task."""
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        data, off = text_buffers(batch.column("text"))
        for i, lang in enumerate(batch.column("lang").to_pylist()):
            doc = data[off[i]:off[i + 1]]
            acc = totals.setdefault(lang, np.zeros(SLOTS))
            for a in range(0, max(len(doc) - 2, 0), BLOCK):
                acc += np.bincount(_slots(doc[a:a + BLOCK + 2]), minlength=SLOTS)
    for lang, acc in totals.items():
        slot = np.flatnonzero(acc)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(slot), pa.string()), pa.array(slot.astype(np.int32)),
             pa.array(acc[slot])], names=["lang", "slot", "n"])


def codewords(n_langs: int) -> np.ndarray:
    """Signs, one row per language: the exhaustive code up to 7 languages,
    else the widest of some random codes of 10 log2(n) positions."""
    if n_langs <= 1:
        return np.ones((n_langs, 1))
    if n_langs <= 7:
        bits = np.arange(1, 2 ** (n_langs - 1))
        rows = [np.zeros(len(bits), int)] + [(bits >> i) & 1 for i in range(n_langs - 1)]
        return np.array(rows) * 2.0 - 1
    width, best, at = int(np.ceil(10 * np.log2(n_langs))), None, -1
    rng = np.random.RandomState(n_langs)
    for _ in range(20):
        code = rng.randint(0, 2, (n_langs, width)) * 2.0 - 1
        code = code[:, np.abs(code.sum(0)) < n_langs]
        near = (code.shape[1] - (code @ code.T - 2 * code.shape[1] * np.eye(n_langs)).max()) / 2
        if near > at:
            best, at = code, near
    return best


class Model:
    """langs, code and, per 3-gram slot, the weights of all code positions
    with a last column that counts the gram."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs, self.code = langs, codewords(len(langs))
        counts = counts.copy()
        counts[:, BLANK] = 0
        p = (counts + 0.5) / (counts + 0.5).sum(1, keepdims=True)
        n_bits = self.code.shape[1]
        self.weights = np.zeros((SLOTS + 1, n_bits + 1), np.float32)
        self.mid, self.gap = np.zeros(n_bits), np.ones(n_bits)
        for b in range(n_bits):
            plus, minus = self.code[:, b] > 0, self.code[:, b] < 0
            if plus.any() and minus.any():
                q, r = p[plus].mean(0), p[minus].mean(0)
                w = np.log(q / r)
                w[BLANK] = 0
                self.weights[:SLOTS, b] = w
                hi, lo = (q * w).sum(), (r * w).sum()
                self.mid[b], self.gap[b] = (hi + lo) / 2, max(hi - lo, 1e-9)
        self.weights[:SLOTS, n_bits] = 1
        self.weights[BLANK, n_bits] = 0

    def sums(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Summed weights of each document; blocks never mix into the sum of a
        document, so results do not depend on the batch."""
        n = len(off) - 1
        out = np.zeros((n, self.weights.shape[1]))
        i = 0
        while i < n:
            j = i + 1
            while j < n and off[j + 1] - off[i] <= BLOCK:
                j += 1
            if j == i + 1:
                doc = data[off[i]:off[i + 1]]
                for a in range(0, max(len(doc) - 2, 0), BLOCK):
                    out[i] += self.weights[_slots(doc[a:a + BLOCK + 2])].sum(0, dtype=np.float64)
            else:
                part = data[off[i]:off[j]]
                slot = np.full(len(part), SLOTS, np.int32)
                if len(part) > 2:
                    slot[:-2] = _slots(part)
                ends = off[i + 1:j + 1] - off[i]
                for back in (1, 2):
                    at = ends - back
                    slot[at[at >= 0]] = SLOTS
                begins = off[i:j] - off[i]
                full = ends > begins
                if full.any():
                    out[np.arange(i, j)[full]] = np.add.reduceat(
                        self.weights[slot], begins[full], axis=0)
            i = j
        return out

    def decode(self, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the best language, its score, distance to the runner-up."""
        n = np.maximum(sums[:, -1:], 1)
        z = 2 * (sums[:, :-1] / n - self.mid) / self.gap
        z[sums[:, -1] == 0] = 0
        share = self.gap / self.gap.sum() * len(self.gap)
        loss = np.stack([(share * np.logaddexp(0, -SHARPNESS * c * z)).sum(1) for c in self.code],
                        axis=1)
        like = np.exp(-(loss - loss.min(1, keepdims=True)))
        like /= like.sum(1, keepdims=True)
        best = loss.argmin(1)
        top = np.sort(like, axis=1)
        second = top[:, -2] if top.shape[1] > 1 else np.zeros(len(top))
        return best, like[np.arange(len(best)), best], top[:, -1] - second


def low_hash(doc_id: Column, n: Column, per_lang: int) -> Column:
    """Whether a document is among about 1.5 per_lang of ``n``; in doubles, as
    the product of longs overflows beyond 2**23 documents."""
    h = F.pmod(F.xxhash64(doc_id), F.lit(1 << 40)).cast("double")
    return h * n < F.lit((1 << 40) * 1.5 * per_lang)


def fit(labelled: DataFrame, per_lang: int = PER_LANG) -> Model:
    """Learn from ``labelled`` (doc_id, text, lang): the counts are summed on
    the cluster; languages times SLOTS numbers reach the driver."""
    spark = labelled.sparkSession
    arrow_batches(spark)
    usable = labelled.filter("doc_id is not null and lang is not null and text is not null")
    # a hash bound leaves about 1.5 per_lang rows of each language before any
    # of them are ranked, so a frequent language is not sorted in one task
    counts, _ = sized_broadcast(materialize(
        usable.groupBy("lang").agg(F.count("*").alias("n")), "lang-counts"), MAX_LANGS)
    order = W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    picked = materialize(usable.select("doc_id", "lang").join(counts, "lang")
                         .filter(low_hash(F.col("doc_id"), F.col("n"), per_lang)).withColumn("rank", F.row_number().over(order))
                         .filter(F.col("rank") <= per_lang)
                         .select("doc_id", "lang").distinct(), "lang-sample")
    grams = (usable.select("doc_id", "text", "lang").join(picked, ["doc_id", "lang"])
             .select("lang", "text")
             .mapInArrow(_count_grams, "lang string, slot int, n double")
             .groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas())
    langs = sorted(grams["lang"].unique())
    counts = np.zeros((len(langs), SLOTS))
    if langs:
        counts[np.searchsorted(langs, grams["lang"]), grams["slot"]] = grams["n"]
    return Model(langs, counts)


def predict(docs: DataFrame, model: Model, ambiguous: float = AMBIGUOUS) -> DataFrame:
    """``docs`` with (lang_pred, score, ambiguous), from ``text`` alone."""
    arrow_batches(docs.sparkSession)
    # only keys and numbers come back from Python; texts stay out of the result
    keep = [c for c in docs.columns if c != "text"]
    sent = docs.select(F.struct(*keep).alias("row"), "text",
                       F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letter"))
    schema = sent.select("row").schema.add("lang_pred", "string").add("score", "double") \
        .add("ambiguous", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model   # sent with the function; Spark broadcasts what is large
        names = np.array([*m.langs, UNKNOWN], object)
        for batch in batches:
            letter = batch.column("letter").to_numpy(zero_copy_only=False)
            data, off = text_buffers(batch.column("text"))
            if m.langs:
                best, score, lead = m.decode(m.sums(data, off))
            else:
                best, score, lead = (np.zeros(batch.num_rows, int), np.zeros(batch.num_rows),
                                     np.ones(batch.num_rows))
            known = letter & bool(m.langs)
            best = np.where(known, best, len(m.langs))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(names[best], pa.string()),
                 pa.array(np.where(known, np.clip(score, 0, 1), 0.0)),
                 pa.array(known & (lead < ambiguous))],
                names=["row", "lang_pred", "score", "ambiguous"])

    out = sent.mapInArrow(run, schema)
    return out.select(*[F.col("row")[c].alias(c) for c in keep if c not in (
        "lang_pred", "score", "ambiguous")], "lang_pred", "score", "ambiguous")


def op6_query(docs: DataFrame) -> DataFrame:
    """Language of every document; one third of the documents is held out."""
    model = fit(docs.select("doc_id", "text", "lang").filter(~held_out(F.col("doc_id"))))
    return (predict(docs.select("doc_id", "text"), model)
            .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score",
                    "ambiguous"))
