import random

import numpy as np
from helpers import LOW, documents, plain_words

from slimctx.llm import substring_dedup as S


UP = str.maketrans("abcdefghij", "ABCDEFGHIJ")


def corpus(seed=4, n=150):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("abcdefghijé") for _ in range(rnd.randint(2, 8))) for _ in range(30000)]
    text = lambda k: " ".join(rnd.choice(vocab) + (".\n" if rnd.random() < .04 else "")
                              for _ in range(k))
    docs = {i: text(rnd.randint(60, 250)) for i in range(n)}
    plants = []
    for _ in range(25):
        p = text(52).replace("\n", " ")
        where = sorted(rnd.sample(range(n), 3))
        for d in where:
            w = docs[d].split(" ")
            a = rnd.randrange(len(w))
            docs[d] = " ".join(w[:a] + [p.translate(UP) if d == where[1] else p] + w[a:])
        plants.append((where, p))
    return docs, plants


def brute(docs):
    """Spans by the same units, grouped with dictionaries."""
    rows, first = [], {}
    for d in sorted(docs):
        data = np.frombuffer((docs[d] or "").encode(), np.uint8)
        _, num, digest, a, b = S.units(data, np.array([0, len(data)]))
        for k in range(len(num)):
            rows.append((d, int(num[k]), int(digest[k]), int(a[k]), int(b[k])))
            first.setdefault(int(digest[k]), (d, int(num[k])))
    out, run = set(), []
    for row in rows + [(None, 0, None, 0, 0)]:
        again = row[2] is not None and first[row[2]] != row[:2]
        if run and (not again or run[-1][0] != row[0]):
            if run[-1][4] - run[0][3] >= S.MIN_CHARS:
                out.add((run[0][0], run[0][3], run[-1][4], len(run), first[run[0][2]][0]))
            run = []
        if again:
            run.append(row)
    return out


def test_planted_passages_and_brute_force(spark):
    docs, plants = corpus()
    docs |= {900: None, 901: "", 902: "...", 903: docs[3], 904: "short", 905: "short"}
    df = documents(spark, [(i, t, None) for i, t in docs.items()] + [(0, docs[0], None)])
    found = S.repeats(df)
    spans = found.collect()
    assert {(s.doc_id, s.start, s.stop, s.n_units, s.kept_doc_id) for s in spans} == brute(docs)
    for where, p in plants:
        for d in where[1:]:
            at = docs[d].lower().find(p)
            if at >= 0:
                inside = sum(max(0, min(s.stop, at + len(p)) - max(s.start, at))
                             for s in spans if s.doc_id == d)
                assert inside > 0.3 * len(p)
    clean = set(range(150)) - {d for w, _ in plants for d in w}
    assert not clean & {s.doc_id for s in spans}
    for r in S.remove(df, found).collect():
        whole = docs[r.doc_id]
        assert "".join((whole or "")[k.start:k.stop] for k in r.kept) == (r.text or "")
        if not any(s.doc_id == r.doc_id for s in spans):
            assert r.text == whole


def test_units_do_not_depend_on_context():
    rnd = random.Random(5)
    p = " ".join(str(rnd.random())[2:8] for _ in range(60))

    def digests(text):
        data = np.frombuffer(text.encode(), np.uint8)
        return set(S.units(data, np.array([0, len(data)]))[2].tolist())

    both = digests("one two three " + p + " four") & digests("x " + p.replace(" ", ", ") + " y z")
    assert len(both) >= 4


def test_empty_and_null(spark):
    df = documents(spark, [(None, "a b c " * 100, None), (1, None, None), (2, "", None)])
    assert S.repeats(df).count() == 0
    assert S.repeats(df.limit(0)).count() == 0
    assert S.remove(df, S.repeats(df)).count() == 3


def test_several_texts_of_one_id(spark):
    t = " ".join(f"w{i}" for i in range(80))
    df = documents(spark, [(1, "first " + t, None), (1, "second " + t, None), (2, t, None)])
    assert len(S.repeats(df).collect()) == 2


def line_spans(docs):
    """(doc_id, start, stop, first doc) of every repeated line, without S.units."""
    first, out = {}, set()
    for d in sorted(docs):
        at = 0
        for line in (docs[d] or "").split("\n"):
            ws = plain_words(line)
            if ws:
                low = line.translate(LOW)
                a, b = at + low.index(ws[0]), at + low.rindex(ws[-1]) + len(ws[-1])
                if tuple(ws) in first:
                    out.add((d, a, b, first[tuple(ws)]))
                else:
                    first[tuple(ws)] = d
            at += len(line) + 1
    return out


def test_whole_lines_of_any_length(spark):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghijé") for _ in range(6))
    common = [" ".join(word() for _ in range(k)) for k in (1, 2, 4, 9, 14, 40)]
    docs = {}
    for i in range(60):
        own = [" ".join(word() for _ in range(rnd.randint(1, 30))) for _ in range(6)]
        for line in rnd.sample(common, 3):
            styled = rnd.choice([line, "  " + line.translate(UP) + ".", line.replace(" ", ", ")])
            own.insert(rnd.randrange(len(own) + 1), styled)
        docs[i] = "\n".join(own)
    # lines inside of other lines are no repeats, lines without words no units
    docs |= {70: "x " + common[3] + " y\n--\n--", 71: common[0] + "\n\n" + common[0], 72: docs[3],
             73: None, 74: "---"}
    df = documents(spark, [(i, t, None) for i, t in docs.items()] + [(None, docs[0], None),
                                                                    (0, docs[0], None)])
    found = S.repeats(df, whole_lines=True)
    spans = found.collect()
    passages = {(s.doc_id, s.start, s.stop) for s in S.repeats(df).collect()}
    want = line_spans(docs)
    short = {w for w in want if not any(
        p[0] == w[0] and p[1] <= w[1] and w[2] <= p[2] for p in passages)}
    assert len(short) > 80 and len(passages) > 10
    got = {(s.doc_id, s.start, s.stop, s.kept_doc_id) for s in spans}
    assert {g for g in got if g[:3] not in passages} == short
    assert passages <= {g[:3] for g in got} and len(got) == len(spans)
    lines = {(s.doc_id, s.start, s.stop, s.kept_doc_id) for s in S.op3_query(df).collect()}
    assert lines == got
    for r in S.remove(df.filter("doc_id is not null"), found).collect():
        whole = docs[r.doc_id]
        assert "".join((whole or "")[k.start:k.stop] for k in r.kept) == (r.text or "")
    seen = set()
    for d in sorted(docs):
        text = docs[d] or ""
        for s in sorted((s for s in spans if s.doc_id == d), key=lambda s: -s.start):
            text = text[:s.start] + text[s.stop:]
        for line in text.split("\n"):
            ws = tuple(plain_words(line))
            assert not ws or ws not in seen
            seen.add(ws)
