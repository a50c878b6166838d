import hashlib
import random

import pytest
from helpers import documents, plain_words

from slimctx.llm import decontaminate as D


def brute(docs, items, window=10):
    wins = []
    for item, text in items:
        w = plain_words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            wins.append((tuple(w[i:i + n]), "null" if item is None else str(item)))
    out = {}
    for i, text in docs:
        w, hit, found = plain_words(text), set(), set()
        for k, item in wins:
            for s in range(len(w) - len(k) + 1):
                if tuple(w[s:s + len(k)]) == k:
                    hit.update(range(s, s + len(k)))
                    found.add(item)
        ids = ",".join(sorted(found))
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(),
                  bool(hit))
    return out


def cases():
    rnd = random.Random(3)
    vocab = ["".join(rnd.choice("abcdé") for _ in range(3)) for _ in range(60)]
    text = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    items = [(i, text(rnd.choice([12, 15, 30]))) for i in range(12)]
    items += [(100, "zig zag"), (101, "solo"), (102, ""), (103, None), (104, "..."),
              (7, items[3][1]), (105, items[2][1].upper()), (None, "qqq rrr sss")]
    docs = []
    for i in range(60):
        t = text(rnd.randint(0, 40))
        if i % 3 == 0:
            w = rnd.choice(items[:12])[1].split()
            a = rnd.randint(0, 4)
            t += rnd.choice([" ", ", ", "\n"]) + "; ".join(w[a:a + rnd.choice([9, 10, 12, 30])]) + " " + text(5)
        docs.append((i, t))
    docs += [(1000, None), (1001, ""), (1002, "!!! --"), (1003, "x Zig-Zag y solo"), (1004, "QQQ. rrr sss"),
             (1005, items[0][1] + " " + items[0][1]), (1006, "É é " + items[1][1]),
             (1007, ("filler " * 3000) + items[4][1] + (" tail" * 3000))]
    return docs, items


@pytest.mark.parametrize("limit", [D.MAX_BROADCAST, 0])
def test_against_brute_force(spark, limit):
    docs, items = cases()
    df = documents(spark, [(i, t, None) for i, t in docs + docs[:5]]).withColumnRenamed("n", "m")
    bench = spark.createDataFrame(items, "item_id long, text string")
    report, spans = D.decontaminate(df, bench, max_broadcast=limit)
    want = brute(docs, items)
    rows = report.collect()
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows}
    assert len(rows) == len(docs) and got == want
    covered = {}
    for s in spans.collect():
        covered[s.doc_id] = covered.get(s.doc_id, 0) + s.stop - s.start
    assert covered == {i: v[1] for i, v in want.items() if v[1]}


def test_empty_tables_and_null_ids(spark):
    docs = documents(spark, [(None, "a b c d e f g h i j k", None), (1, "a b", None),
                             (1, "another text", None)])
    none = spark.createDataFrame([], "item_id long, text string")
    report, spans = D.decontaminate(docs, none)
    assert sorted(r.n_words for r in report.collect()) == [2, 2, 11] and spans.count() == 0
    some = spark.createDataFrame([(1, "b c d e f g h i j k l"), (2, "a b c d e f g h i j")],
                                 "item_id long, text string")
    report, _ = D.decontaminate(docs, some)
    assert {r.doc_id: r.n_hit for r in report.collect() if r.n_hit} == {None: 11}
    assert D.decontaminate(docs.limit(0), some)[0].count() == 0
