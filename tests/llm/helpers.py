"""Small tables with the awkward cases, and brute-force versions."""

import re

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Columns that share names with columns the operators work with.
CLASH = ["text_h", "rid", "n", "kept", "drop", "row", "key", "score", "h1", "pos", "_text"]


def documents(spark, rows):
    """documents(doc_id, text, lang, source, n_chars) with clashing columns."""
    data = [(i, t, lang, "s", len(t) if t is not None else None, *range(len(CLASH)))
            for i, t, lang in rows]
    return spark.createDataFrame(
        data, "doc_id long, text string, lang string, source string, n_chars long, "
        + ", ".join(f"{c} int" for c in CLASH))


def blank_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


class Components:
    def __init__(self, nodes):
        self.up = {n: n for n in nodes}

    def find(self, a):
        while self.up[a] != a:
            a = self.up[a]
        return a

    def link(self, a, b):
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
