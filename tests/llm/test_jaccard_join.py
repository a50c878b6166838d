import random

import numpy as np
import pyarrow as pa
import pytest
from helpers import Components, blank_words, documents

from slimctx.llm import jaccard_join as J


def sets(docs):
    out = {}
    for i, t in docs.items():
        w = blank_words(t)
        out[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else \
            ({tuple(w)} if w else set())
    return out


def brute(docs, percent=80):
    s, ids = sets(docs), sorted(docs)
    c = Components(ids)
    for i in ids:
        for j in ids:
            if i < j and s[i] and s[j]:
                k = len(s[i] & s[j])
                if 100 * k >= percent * (len(s[i]) + len(s[j]) - k):
                    c.link(i, j)
    return {i: (len(s[i]), c.find(i)) for i in ids}


def corpus(seed, n=60):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    text = lambda k: [rnd.choice(vocab) for _ in range(k)]
    shared, docs = text(25), {}
    for i in range(n):
        kind = i % 4
        if kind == 0 or i < 4:
            w = text(rnd.randint(1, 120))
        else:                                        # a near copy, around the threshold
            w = list(docs[rnd.randrange(i)])
            for _ in range(rnd.randint(0, 1 + len(w) // 45)):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
        if kind == 2:
            a = rnd.randrange(len(w) + 1)
            w = w[:a] + shared + w[a:]
        docs[i] = w
    out = {i: " ".join(w) for i, w in docs.items()}
    out |= {n: None, n + 1: "", n + 2: " \n\t", n + 3: "one two", n + 4: "ONE  two\n", n + 5: out[0].upper(),
            n + 6: " ".join(text(9000)), n + 7: "É a b c d e", n + 8: "é a b c d e"}
    out[n + 9] = out[n + 6] + " tail"
    return out


@pytest.mark.parametrize("seed,small", [(1, False), (2, True), (3, True)])
def test_against_brute_force(spark, seed, small, monkeypatch):
    if small:     # frequent shingles, blocks, salts and deep trees on little data
        for name, value in (("HOT_DOCS", 3), ("SALT", 3), ("GROUP_BLOCK", 4), ("FANOUT", 2),
                            ("CHAIN", 1), ("MAX_BROADCAST", 0)):
            monkeypatch.setattr(J, name, value)
    docs = corpus(seed)
    rows = [(i, t, None) for i, t in docs.items()]
    df = documents(spark, rows + rows[:3])
    got = J.op7_query(df).collect()
    assert len(got) == len(docs)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(docs)


def test_near_copies_of_one_text(spark):
    rnd = random.Random(9)
    base = [f"t{rnd.randrange(10 ** 6)}" for _ in range(100)]
    docs = {}
    for i in range(300):
        w = list(base)
        w[rnd.randrange(100)] = f"edit{i}"
        docs[i] = " ".join(w)
    got = J.op7_query(documents(spark, [(i, t, None) for i, t in docs.items()])).collect()
    assert {r.component_id for r in got} == {0} and len(got) == 300


@pytest.mark.parametrize("edits", [8, 5])
def test_rows_follow_the_documents(spark, edits, monkeypatch):
    """Copies of one text just under the threshold (8 edits) or around it (5):
    no step makes more rows than there are prefix shingles."""
    rnd = random.Random(edits)
    base = [f"t{i}" for i in range(404)]
    docs = {}
    for i in range(300):
        w = list(base)
        for k in rnd.sample(range(404), edits):
            w[k] = f"edit{i}x{k}"
        docs[i] = " ".join(w)
    made, write = {}, J.materialize

    def counted(df, name="table"):
        out = write(df, name)
        made[name] = max(made.get(name, 0), out.count())
        return out

    monkeypatch.setattr(J, "materialize", counted)
    got = J.op7_query(documents(spark, [(i, t, None) for i, t in docs.items()])).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(docs)
    assert max(made.values()) <= 300 * (400 - 320 + 1), made


def test_new_links_come_out_of_every_unit():
    """Closest pairs first, none between joined components; pairs that share
    an earlier token are left to it."""
    x = np.arange(1, 101, dtype=np.uint64) << np.uint64(40)
    sets = [x, x[:90], x[:81], x[50:]]
    order = [3, 2, 1, 0]                                  # by size
    def rows(token, tokens):                              # noqa: E306
        return pa.RecordBatch.from_pydict({
            "token": [token] * 4, "b1": [0] * 4, "b2": [0] * 4, "block": [0] * 4,
            "n": [len(sets[i]) for i in order], "rid": order, "comp": order,
            "tokens": [tokens] * 4, "whole": [J._pack(sets[i]) for i in order]})

    def links(*batches):
        return [(a, b) for r in J._new_links(80)(iter(batches))
                for a, b in zip(r["a"].to_pylist(), r["b"].to_pylist())]

    assert sorted(links(rows(5, [5, 9]), rows(9, [5, 9]))) == [(0, 1), (1, 2)]
    assert links(rows(9, [5, 9])) == []


def test_tree_pairs_lose_nothing():
    """Every pair that links and is in different components comes out."""
    rnd = np.random.RandomState(0)
    for _ in range(40):
        k = rnd.randint(1, 60)
        unit = np.sort(rnd.randint(0, 4, k))
        tokens = [set(rnd.randint(0, 60, rnd.randint(1, 40)).tolist()) for _ in range(k)]
        order = np.lexsort(([len(t) for t in tokens], unit))
        unit, tokens = unit[order], [tokens[i] for i in order]
        n = np.array([len(t) for t in tokens])
        comp = rnd.randint(0, 6, k)
        side = np.where(unit % 2, rnd.randint(1, 3, k), 0)
        bits = np.zeros((k, J.BITS), bool)
        for i, t in enumerate(tokens):
            bits[i, [x % 16 for x in t]] = True
        a, b = J.tree_pairs(unit, side, n, comp, np.packbits(bits, axis=1).view(np.uint64), 50, 3)
        got = set(zip(a.tolist(), b.tolist()))
        for i in range(k):
            for j in range(i + 1, k):
                inter = len(tokens[i] & tokens[j])
                if (unit[i] == unit[j] and comp[i] != comp[j]
                        and 100 * inter >= 50 * (n[i] + n[j] - inter)
                        and (side[i] == 0 or side[i] != side[j])):
                    assert (i, j) in got


def test_packed_sets_keep_order():
    s = np.unique(np.random.RandomState(1).randint(0, 2 ** 62, 1000).astype(np.uint64))
    assert (J._unpack(J._pack(s)) == s >> np.uint64(24)).all()


def test_empty_and_null_ids(spark):
    df = documents(spark, [(None, "a b c d e f", None), (4, "a b c d e f", None), (4, "other words", None),
                           (5, None, None), (None, None, None)])
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in J.op7_query(df).collect())
    assert got == [(0, 0, 0), (0, 2, 4), (4, 1, 4), (4, 2, 4), (5, 0, 5)]
    assert J.op7_query(df.limit(0)).count() == 0
