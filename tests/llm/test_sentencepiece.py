import math
from collections import Counter

import numpy as np
import pytest
from helpers import documents

from slimctx.llm import sentencepiece_sample as S
from slimctx.llm.piece_lattice import Lattice, Table, Vocabulary
from slimctx.llm.textvec import mix

PIECES = ["▁", "a", "b", "ab", "ba", "▁a", "aba", "bb"]


@pytest.fixture(scope="module")
def small():
    return Vocabulary(PIECES, list(range(1, 9)), 100, 400, list(range(8)))


def every(v, text):
    """All segmentations with their log probabilities."""
    lattice = "▁" + text.replace("▁", "\0").replace(" ", "▁") if text else ""
    out = []

    def walk(i, ids, w):
        if i == len(lattice):
            out.append((tuple(ids), w))
            return
        for k, p in enumerate(PIECES):
            if lattice.startswith(p, i):
                walk(i + len(p), ids + [k], w + v.weight[k])
        if lattice[i] not in PIECES:
            raw = ("▁" if lattice[i] == "\0" else lattice[i]).encode()
            walk(i + 1, ids + [100 + b for b in raw], w + v.byte_weight * len(raw))

    walk(0, [], 0.0)
    z = np.logaddexp.reduce([w for _, w in out])
    return {k: w - z for k, w in out}


@pytest.mark.parametrize("text", ["", "a", "ab", "abab b", "é▁ a", "bbbb aba\n", " a  b ", "🙂"])
def test_all_segmentations_and_scores(small, text):
    want = every(small, text)
    got = S.encode_texts([text], np.array([5], np.uint64), small, len(want) + 3)[0]
    assert len(got) == len(want)                      # all of them, each once
    for ids, log_prob, log_in in got:
        assert math.isclose(want[tuple(ids.tolist())], log_prob, abs_tol=1e-9)
        assert log_in == 0
        assert small.decode(ids.tolist()) == text


def test_gumbel_top_k_distribution(small):
    """First and second sample follow sampling without replacement, and the
    inclusion scores give unbiased sums."""
    n, text = 20000, "abab b"
    p = {k: math.exp(w) for k, w in every(small, text).items()}
    keys = mix(np.arange(n, dtype=np.uint64) * np.uint64(7919) + np.uint64(3))
    got = S.encode_texts([text] * n, keys, small, 2)
    first = Counter(tuple(x[0][0].tolist()) for x in got)
    second = Counter(tuple(x[1][0].tolist()) for x in got)
    want = Counter()
    for i in p:
        for j in p:
            if i != j:
                want[j] += p[i] * p[j] / (1 - p[i])
    assert max(abs(first[k] / n - p[k]) for k in p) < 0.015
    assert max(abs(second[k] / n - want[k]) for k in p) < 0.015
    assert abs(np.mean([sum(math.exp(lp - li) for _, lp, li in x) for x in got]) - 1) < 0.02


def test_results_do_not_depend_on_the_batch(small):
    texts, keys = ["abab b", "", "ba ab", "abab b"], np.array([9, 8, 7, 9], np.uint64)
    whole = S.encode_texts(texts, keys, small, 3)
    for i, t in enumerate(texts):
        alone = S.encode_texts([t], keys[i:i + 1], small, 3)[0]
        assert [(a.tolist(), b) for a, b, _ in alone] == [(a.tolist(), b) for a, b, _ in whole[i]]
    assert [x[0].tolist() for x in whole[0]] == [x[0].tolist() for x in whole[3]]


def test_hash_table():
    keys = mix(np.arange(1000, dtype=np.uint64))
    t = Table(keys, np.arange(1000, dtype=np.int32))
    assert (t(keys) == np.arange(1000)).all()
    assert (t(mix(np.arange(1000, 2000, dtype=np.uint64))) == -1).all()


def test_work_follows_the_edges_that_are_drawn(small, monkeypatch):
    looked_up, logs = [], []
    lookup, expm1 = Table.__call__, np.expm1
    monkeypatch.setattr(Table, "__call__", lambda t, keys: looked_up.append(len(keys)) or lookup(t, keys))
    cp, begin = np.array([ord(c) for c in "ab" * 200], np.uint32), np.array([0])
    lattice = Lattice(cp, begin, small)
    # heads of pieces need no hash table; "ab", "ba" are looked up, then "aba"
    assert looked_up[:2] == [399, 398] and sum(looked_up) < 1200
    monkeypatch.setattr(np, "expm1", lambda x: logs.append(len(x)) or expm1(x))
    some = np.array([0, 3, 7])
    p = lattice.start[some]
    rest = [lattice.q[lattice.first[i]:lattice.first[i + 1]].sum() for i in p] - lattice.q[some]
    assert np.allclose(np.exp(lattice.other(some)), rest) and logs == [3]
    odd = Lattice(np.array([0x110000, 0x4E00, ord("a")], np.uint32), begin, small)
    assert odd.piece.tolist() == [-1, -1, 1]


def test_random_numbers_of_a_rank_are_drawn_together(small, monkeypatch):
    calls, draw = [], S.uniform
    monkeypatch.setattr(S, "uniform", lambda *a: calls.append(a[3]) or draw(*a))
    S.encode_texts(["ab"] * 500, np.arange(500, dtype=np.uint64), small, 2)
    assert len(calls) < 50


def test_operator(spark):
    long = "Some words, été ▁ and 漢字.\n" * 4000
    rows = [(1, "Hello  world\n▁x", None), (2, None, None), (3, "", None), (4, long, None),
            (1, "Hello  world\n▁x", None), (None, "null key", None), (5, "x" * 3000, None)]
    df = documents(spark, rows)
    out = S.encode(df, samples=3)
    got = out.collect()
    assert all(r.exact for r in got)
    texts = {r[0]: r[1] or "" for r in rows}
    back = S.decode(out.select("doc_id", "rank", "ids")).collect()
    assert all(r.text == texts[r.doc_id] for r in back) and len(back) == len(got)
    n = Counter(r.doc_id for r in got)
    assert n == {1: 6, 2: 1, 3: 1, 4: 3, None: 3, 5: 3}
    for d in (4, None, 5):
        assert len({tuple(r.ids) for r in got if r.doc_id == d}) == 3
    assert all(r.log_inclusion <= 0 and math.isfinite(r.log_inclusion) for r in got)
    assert S.encode(df.limit(0)).count() == 0
    again = S.encode(df.repartition(5), samples=3).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.rank)
    assert sorted(again, key=key) == sorted(got, key=key)


def test_query_on_a_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = S.op5_query(docs)
    assert got.filter("not exact").count() == 0
    assert got.select("doc_id").distinct().count() == docs.count()
