import random
import re
from collections import Counter

from helpers import CLASH

from slimctx.llm import host_rules as R

SCHEMA = ("doc_id long, text string, source string, "
          + ", ".join(f"{c} int" for c in [*CLASH, "host", "host_docs", "n_words"]))


def table(spark, rows):
    return spark.createDataFrame([(*r, *range(len(CLASH) + 3)) for r in rows], SCHEMA)


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def verdict(m):
    n, chars, symbols, dup, repeat = m
    base = n < 50 or 100 * repeat > 50 * n
    return base, base or symbols * 10 > n or dup * 20 > n or chars < 2 * n or chars > 15 * n


def prose(rnd, n):
    return " ".join("".join(rnd.choices("abcdefghé", k=rnd.randint(2, 9))) + rnd.choice(["", "", ",", "\n"])
                    for _ in range(n))


def test_measures_against_brute_force():
    rnd = random.Random(13)
    texts = [None, "", " \t\n\x0b", "a", "a a a", "a a a a", "a b c a b c", "x\ny\nx\n \n \nx", "#*$%&|<> #",
             "    w\x85w", prose(rnd, 20_000), "w " * 100_000]
    texts += [" ".join(rnd.choices("abc", k=rnd.randint(0, 30))) for _ in range(200)]
    for t in texts:
        assert R.measure(t) == brute(t)


def corpus():
    rnd = random.Random(14)
    rows = []
    for i in range(240):
        host = ["good", "good", "bad", "mixed"][i % 4]
        text = prose(rnd, rnd.randint(60, 120))
        if host == "bad" and i % 8 != 2 or host == "bad" and rnd.random() < .8 or host == "mixed" and rnd.random() < .3:
            text = text + " # # | | <>" * 10
        rows.append((i, text, host))
    return rows + [(300, None, "good"), (301, "", None), (302, prose(rnd, 80), None), (303, "few words", "tiny"),
                   (None, prose(rnd, 80), "tiny2"), (0, rows[0][1], "good"), (304, "same words here " * 40, "good")]


def test_hosts_against_brute_force(spark):
    rows = corpus()
    judged = [(i, h, brute(t), *verdict(brute(t))) for i, t, h in rows]
    n, x = Counter(), Counter()
    for _, h, _, _, failed in judged:
        if h is not None:
            n[h] += 1
            x[h] += failed
    m = sum(x.values()) / sum(n.values())
    spread = sum(n[h] * (x[h] / n[h] - m) ** 2 for h in n)
    room = sum(n.values()) - sum(v * v for v in n.values()) / sum(n.values()) - (len(n) - 1)
    rho = (spread / (m * (1 - m)) - (len(n) - 1)) / room
    assert 0 < rho < 1
    k = 1 / rho - 1
    rate = {h: (x[h] + m * k) / (n[h] + k) for h in n}
    assert rate["bad"] > .5 > rate["mixed"] > rate["good"] and 0 < rate["tiny"] < 1
    got = R.host_rules(table(spark, rows).select("doc_id", R.F.col("source").alias("host"), "text")).collect()
    assert all(r.host is None or abs(r.host_rate - rate[r.host]) < 1e-9 for r in got)
    out = R.op13_query(table(spark, rows)).collect()
    want = [(i, *ms, base, not base and (h is None or rate[h] <= .5)) for i, h, ms, base, _ in judged]
    assert sorted((tuple(r)[:8] for r in out), key=str) == sorted(want, key=str)
    assert all(r.kept for r in out if r.doc_id in (302, None))


def test_hosts_that_are_alike_and_empty_tables(spark):
    good = prose(random.Random(15), 90)
    rows = [(i, good, f"h{i % 3}") for i in range(9)]
    assert all(r.kept for r in R.op13_query(table(spark, rows)).collect())
    one = R.op13_query(table(spark, [(1, None, "h")])).first()
    assert (one.n_words, one.base_failed, one.kept) == (0, True, False)
    assert R.op13_query(table(spark, rows).limit(0)).count() == 0
    assert R.op13_query(table(spark, [(1, good, None)])).first().kept
