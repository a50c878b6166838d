import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from helpers import documents

from slimctx.llm import merkle as M


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(nodes, fanout):
    """The root of ``nodes`` and for each the (left, right) siblings of its path."""
    members, paths = [[i] for i in range(len(nodes))], [[] for _ in nodes]
    while len(nodes) > 1:
        up, owned = [], []
        for a in range(0, len(nodes), fanout):
            run = nodes[a:a + fanout]
            for k, ms in enumerate(members[a:a + fanout]):
                for m in ms:
                    paths[m].append(("".join(run[:k]), "".join(run[k + 1:])))
            up.append(h(*run))
            owned.append([m for ms in members[a:a + fanout] for m in ms])
        nodes, members = up, owned
    return nodes[0], paths


def brute(rows, fanout):
    """rows of (doc_id, source, lang, n_chars, text)."""
    def leaf(r):
        return h(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in r])

    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0] is not None, r[0] or 0, leaf(r), r))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: (sorted(groups[g], key=lambda x: x[:3])) for g in names}
    lows = {g: tree([x[2] for x in trees[g]], fanout) for g in names}
    root, tops = tree([lows[g][0] for g in names], fanout)
    out = []
    for g, top in zip(names, tops):
        for (_, _, digest, r), path in zip(trees[g], lows[g][1]):
            path, node = path + top, digest
            if r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0:
                node = leaf((*r[:3], r[3] + 1, r[4]))
            for left, right in path:
                node = h(left, node, right)
            out.append((r[0], digest, lows[g][0], root, h(*[a + b for a, b in path]), node, node == root))
    return sorted(out, key=str)


def corpus(n):
    rnd = random.Random(n)
    rows = [(i, f"text é {i}" if i % 11 else None, rnd.choice(["en", "en", "en", "fr", "", None]))
            for i in range(n)]
    return rows + [(7, "", "en"), (7, "other", "en"), (7, "other", "en"), (None, "no id", "fr"),
                   (None, "x" * 300_000, "fr"), (-5, "minus", "de"), (2 ** 62, "far", "zz")]


@pytest.mark.parametrize("fanout,levels,n", [(2, 10, 90), (2, 2, 150), (3, 1, 60), (4, 2, 0)])
def test_against_brute_force(spark, monkeypatch, fanout, levels, n):
    monkeypatch.setattr(M.manifest, "__defaults__", ("leaf", fanout, levels))
    rows = corpus(n)
    got = [tuple(r) for r in M.op11_query(documents(spark, rows)).collect()]
    plain = [(i, "s", lang, len(t) if t is not None else None, t) for i, t, lang in rows]
    assert sorted(got, key=str) == brute(plain, fanout)


def test_one_row_and_empty_table(spark):
    df = documents(spark, [(1, "a", None)])
    row = M.op11_query(df).first()
    assert row.leaf == row.subroot == row.root == row.folded_root and row.verified
    assert row.proof_sha256 == h()
    assert M.op11_query(df.limit(0)).count() == 0


def test_the_largest_length_is_tampered_with_too(spark):
    doc = next(i for i in range(50) if zlib.crc32(str(i).encode()) % 7 == 0)
    df = spark.createDataFrame([(doc, "s", "en", 2 ** 63 - 1, "t")],
                               "doc_id long, source string, lang string, n_chars long, text string")
    assert not M.op11_query(df).first().verified
