import hashlib
import random
from collections import defaultdict

from helpers import LOW, documents

from slimctx.llm import line_dedup as D

PAD = "a repeated line that is long enough to count"


def brute(docs, min_chars=40, min_docs=5):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOW)
    held = defaultdict(set)
    for i, t in docs.items():
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                held[key(line)].add(i)
    out = {}
    for i, t in docs.items():
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(held.get(key(x), ())) >= min_docs and i < max(held[key(x)]))]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def corpus():
    rnd = random.Random(8)
    pool = [f"{PAD} number {i} é" for i in range(12)] + ["short", "", " " * 60]
    docs = {i: "\n".join(rnd.choice([" ", "", "\t"]) + (x.upper() if rnd.random() < .3 else x) + rnd.choice(["", "\r"])
                         for x in rnd.choices(pool, k=rnd.randint(0, 5))) for i in range(60)}
    docs |= {100: None, 101: "", 102: "\n", 103: "\n".join([PAD + " number 1 é"] * 500 + [f"own {i}" for i in range(3000)]),
             104: "x" * 39, 105: "Ä" + PAD, 106: "ä" + PAD}
    return docs


def test_against_brute_force(spark):
    docs = corpus()
    rows = [(i, t, None) for i, t in docs.items()]
    for batches, fanout in ((4, 4), (3, 2), (1, 4)):
        got = D.line_dedup(documents(spark, rows + rows[:3]), batches=batches, fanout=fanout).collect()
        assert len(got) == len(docs) + 3
        assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept) for r in got} == brute(docs)
    out = {r.doc_id: r.kept_sha256 for r in D.op8_query(documents(spark, rows)).collect()}
    assert out == {i: hashlib.sha256(v[2].encode()).hexdigest() for i, v in brute(docs).items()}


def test_null_ids_several_texts_and_empty_table(spark):
    rows = [(None, PAD, None)] * 6 + [(1, PAD, None), (1, "other " + PAD, None)] + [
        (i, PAD, None) for i in range(2, 6)]
    got = D.line_dedup(documents(spark, rows)).collect()
    assert [r.n_dropped for r in got if r.doc_id is None] == [0] * 6
    kept = {(r.doc_id, r.kept) for r in got if r.doc_id is not None}
    assert kept == {(1, ""), (1, "other " + PAD), (2, ""), (3, ""), (4, ""), (5, PAD)}
    assert D.line_dedup(documents(spark, rows).limit(0)).count() == 0


def test_stream_of_batches_keeps_the_first(spark):
    runs, seen = D.LineRuns(spark, fanout=2), set()
    rnd = random.Random(10)
    for b in range(5):
        docs = {b * 10 + i: "\n".join(f"{PAD} {rnd.randrange(15)}" for _ in range(4)) for i in range(6)}
        df = documents(spark, [(i, t, None) for i, t in docs.items()])
        got = {(r.doc_id, r.pos) for r in runs.fresh(D.line_entries(df)).collect()}
        want = set()
        for i in sorted(docs):
            for pos, line in enumerate(docs[i].split("\n")):
                if line not in seen:
                    seen.add(line)
                    want.add((i, pos))
        assert got == want
    assert len(runs.runs()) <= 3                       # five batches, merged by twos
    assert runs.merged().count() == len(seen)
    digests = [(r.h1, r.h2) for r in runs.runs()[0].coalesce(1).collect()]
    assert digests == sorted(digests) or runs.runs()[0].rdd.getNumPartitions() > 1
