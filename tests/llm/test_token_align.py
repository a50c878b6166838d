import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from helpers import documents

from slimctx.llm import token_align as T


def brute(texts):
    """Plain loops over the tokenizers' own ids."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_model = Tokenizer.from_file(T.VOCABULARY_A)
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_file=T.VOCABULARY_B)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    char = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}

    def ends(parts):
        return np.cumsum([len(p) for p in parts]).tolist()

    docs = []
    for t in texts:
        groups = []
        if t:
            a = a_model.encode(" " + t, add_special_tokens=False).ids
            b = b_model.encode(t)
            bytes_a = [bytes(char[c] for c in a_model.id_to_token(i)) for i in a]
            bytes_b = []
            for i in b:
                p = b_model.id_to_piece(i)
                bytes_b.append(bytes([int(p[3:5], 16)]) if b_model.is_byte(i) else p.replace("▁", " ").encode())
            if b"".join(bytes_a) == b"".join(bytes_b) == (" " + t).encode():
                end_a, end_b = ends(bytes_a), ends(bytes_b)
                i = j = 0
                for e in sorted(set(end_a) & set(end_b)):
                    p, q = i, j
                    while i < len(a) and end_a[i] <= e:
                        i += 1
                    while j < len(b) and end_b[j] <= e:
                        j += 1
                    groups.append((a[p:i], b[q:j]))
        docs.append(groups)
    links = [Counter((x, y) for a, b in g for x in a for y in b) for g in docs]
    count = Counter(p for x in links for p in x)
    top = Counter()
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    out = []
    for g, held in zip(docs, links):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        out.append((sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(held.values()),
                    sum(n for p, n in held.items() if count[p] == top[p[0]]),
                    sum(n * count[p] for p, n in held.items()),
                    hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return out, count, sum(links, Counter())


def corpus():
    rnd = random.Random(12)
    words = ["the", "of", "Thorough", "éêaux", "日本語", "x=1;", "\n", "  ", "<|endoftext|>", "<s>", "🙂", "don't",
             "١٢٣", "antidisestablishment", "\t", "<0x41>"]
    texts = [" ".join(rnd.choices(words, k=rnd.randint(1, 40))) for _ in range(150)]
    return texts + [None, "", " ", "\n", "▁literal", "á é ﬁ ①", "\x00\x07", "ab " * 30_000, " " * 6_000,
                    "a" * 20_000, "the", "the", "一" * 700 + "é" * 700, "end "]


@pytest.mark.parametrize("docs,links,block,large", [
    (T.CHUNK_DOCS, T.CHUNK_LINKS, T.BLOCK, T.LARGE_GROUP), (T.CHUNK_DOCS, 500, 2_000, 3)])
def test_against_brute_force(spark, monkeypatch, docs, links, block, large):
    texts = corpus()
    if links == 500:
        texts = texts[:60] + texts[-9:]
        monkeypatch.setattr(T, "CHUNK_LINKS", links)
        monkeypatch.setattr(T, "BLOCK", block)
        monkeypatch.setattr(T, "LARGE_GROUP", large)
    rows, pairs = T.align(documents(spark, [(i, t, None) for i, t in enumerate(texts)]).select("doc_id", "text"))
    want, count, links = brute(texts)
    got = {r.doc_id: tuple(r)[1:] for r in rows.collect()}
    assert got == dict(enumerate(want))
    assert {(r.a, r.b): (r.docs, r.links) for r in pairs.collect()} == {p: (count[p], links[p]) for p in count}


def test_dense_bitmaps_null_ids_repeats_and_empty_table(spark):
    rows = [(i if i % 3 else None, "the cat and the dog" if i < 2500 else "the end", None) for i in range(5000)]
    df = documents(spark, rows).coalesce(1)
    written = T.postings(df)
    assert {r.n for r in written.filter("bits is not null").selectExpr("octet_length(bits) as n").collect()} >= {4096}
    out = T.op12_query(df).collect()
    want, _, _ = brute([t for _, t, _ in rows])
    assert sorted(tuple(r)[1:] for r in out) == sorted(want)
    assert sum(r.doc_id is None for r in out) == len(range(0, 5000, 3))
    assert T.op12_query(df.limit(0)).count() == 0
    assert T.op12_query(documents(spark, [(1, None, None)])).first().n_links == 0


def test_both_ways_of_tokenizer_a_agree():
    import tokenizers

    with open(T.VOCABULARY_A, encoding="utf-8") as f:
        a = T.ByteBPE(f.read())
    plain = tokenizers.Tokenizer.from_file(T.VOCABULARY_A)
    plain.encode_special_tokens = True
    for t in corpus():
        text = " " + (t or "")
        assert a._fast.encode_ordinary(text) == plain.encode(text, add_special_tokens=False).ids == a.encode(text)
