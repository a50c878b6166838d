"""Lattices of vocabulary pieces over texts, for whole batches, in numpy.

A text is its code points with blanks written as U+2581, after one U+2581 of
its own.  Pieces of the vocabulary are the edges; a code point that is no piece
has one edge of its UTF-8 bytes (U+2581 in the text is one of these, so every
text has its way back).  A lattice falls apart wherever no piece holds the two
neighbouring code points; each distinct part is built once per batch."""

from __future__ import annotations

import numpy as np

from slimctx.llm.textvec import mix, segment_hashes

SPACE, LITERAL = 0x2581, 0x110000
SHIFT = np.uint64(21)


class Table:
    """A hash table of 64-bit keys with vectorised lookups."""

    EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(3 * len(keys) + 1))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, self.EMPTY)
        self.values = np.full(1 << bits, -1, np.int32)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[slot[left]] == self.EMPTY]
            at, one = np.unique(slot[free], return_index=True)
            self.keys[at], self.values[at] = keys[free[one]], values[free[one]]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & self.mask

    def _slot(self, keys):
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The values of the keys, -1 where there is none."""
        slot = self._slot(keys)
        have = self.keys[slot]
        hit = have == keys
        out = np.where(hit, self.values[slot], np.int32(-1))
        # nearly all keys end here; the others go on to the next slot
        left = np.flatnonzero(~hit & (have != self.EMPTY))
        slot[left] = (slot[left] + 1) & self.mask
        while len(left):
            at = slot[left]
            have = self.keys[at]
            hit = have == keys[left]
            out[left[hit]] = self.values[at[hit]]
            more = ~hit & (have != self.EMPTY)
            left = left[more]
            slot[left] = (slot[left] + 1) & self.mask
        return out


class Vocabulary:
    """Pieces, weights and lookup tables.  The weight of a piece is -alpha
    log(1 + rank), rank from its score, a Zipf law over the vocabulary's order;
    a byte piece weighs like the last rank."""

    def __init__(self, pieces: list[str], ranks: list[float], bytes_at: int, n_ids: int,
                 ids: list[int] | None = None, alpha: float = 1.0):
        ids = list(range(len(pieces))) if ids is None else ids
        self.bytes_at, self.n_ids = bytes_at, n_ids
        last = float(n_ids)
        self.weight = np.full(n_ids, -alpha * np.log1p(last))
        self.weight[ids] = -alpha * np.log1p(np.minimum(np.abs(ranks), last))
        self.byte_weight = -alpha * np.log1p(last)
        self.text = [b""] * n_ids
        for b in range(256):
            self.text[bytes_at + b] = bytes([b])
        nodes, keys, kids, term, pairs = {"": 0}, [], [], [-1], set()
        for i, piece in zip(ids, pieces):
            self.text[i] = piece.replace(chr(SPACE), " ").encode()
            for k in range(len(piece)):
                prefix = piece[:k + 1]
                if prefix not in nodes:
                    nodes[prefix] = len(term)
                    keys.append((nodes[piece[:k]] << 21) | ord(piece[k]))
                    kids.append(len(term))
                    term.append(-1)
                if k:
                    pairs.add((ord(piece[k - 1]) << 21) | ord(piece[k]))
            term[nodes[piece]] = i
        # children of the root by code point, the last entry stands for all beyond
        heads = {key: kid for key, kid in zip(keys, kids) if key >> 21 == 0}
        self.root = np.full(max(heads, default=0) + 2, -1, np.int32)
        self.root[list(heads)] = list(heads.values())
        self.text = np.array(self.text, object)
        self.child = Table(np.array(keys, np.uint64), np.array(kids, np.int32))
        pairs = np.array(sorted(pairs), np.uint64)
        self.pair = Table(pairs, np.zeros(len(pairs), np.int32))
        self.term = np.array(term, np.int32)
        self.longest = max(map(len, pieces), default=1)

    @classmethod
    def load(cls, model: str, alpha: float) -> "Vocabulary":
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        ids = [i for i in range(n)
               if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        return cls([sp.id_to_piece(i) for i in ids], [sp.get_score(i) for i in ids],
                   sp.piece_to_id("<0x00>"), n, ids, alpha)

    def joined(self, ids) -> bytes:
        """The text of the ids in UTF-8."""
        return b"".join(self.text[ids].tolist())[1:]

    def decode(self, ids) -> str:
        return self.joined(np.asarray(ids, np.int64)).decode("utf-8")


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts as in the lattice, and where each begins.
    Empty texts have none."""
    parts, sizes = [], []
    for t in texts:
        p = np.frombuffer(t.encode("utf-32-le"), np.uint32) if t else np.empty(0, np.uint32)
        if len(p):
            p = np.where(p == SPACE, LITERAL, np.where(p == 32, SPACE, p))
            p = np.concatenate([[SPACE], p])
        parts.append(p.astype(np.uint32))
        sizes.append(len(p))
    return (np.concatenate(parts) if parts else np.empty(0, np.uint32),
            np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64))


def segments(cp: np.ndarray, off: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """Where the independent parts of the texts begin."""
    wide = cp.astype(np.uint64)
    cut = np.ones(len(cp), bool)
    if len(cp) > 1:
        cut[1:] = vocab.pair((wide[:-1] << SHIFT) | wide[1:]) < 0
    cut[off[:-1][off[:-1] < len(cp)]] = True
    return np.flatnonzero(cut)


class Lattice:
    """The edges of distinct segments.  For a position p: edges
    first[p]:first[p + 1] in order of length, with ``to`` (position in the
    same numbering; ``stop`` for the end), ``piece`` (-1: bytes), ``q`` the
    probability of the edge given p, ``lq`` its logarithm."""

    def __init__(self, cp: np.ndarray, begin: np.ndarray, vocab: Vocabulary):
        n = len(cp)
        size = np.diff(np.r_[begin, n])
        self.stop = np.repeat(begin + size, size)
        wide = cp.astype(np.uint64)
        at, node = np.arange(n), np.zeros(n, np.uint64)
        starts, ends, pieces, nth = [], [], [], []
        count = np.zeros(n, np.int64)

        def add(p, k, piece):
            starts.append(p), ends.append(p + k + 1), pieces.append(piece), nth.append(count[p])
            count[p] += 1

        for k in range(vocab.longest):
            if k:
                ok = at + k < self.stop[at]
                at, node = at[ok], node[ok]
                kid = vocab.child((node << SHIFT) | wide[at + k])
            else:
                kid = vocab.root[np.minimum(cp, len(vocab.root) - 1)]
            ok = kid >= 0
            at, kid = at[ok], kid[ok]
            node = kid.astype(np.uint64)
            piece = vocab.term[kid]
            hit = piece >= 0
            add(at[hit], k, piece[hit])
            if k == 0:
                bare = np.flatnonzero(count == 0)
                add(bare, 0, np.full(len(bare), -1, np.int32))
        self.first = np.r_[0, np.cumsum(count)]
        put = self.first[np.concatenate(starts)] + np.concatenate(nth)
        start, to = np.empty(len(put), np.int64), np.empty(len(put), np.int64)
        piece = np.empty(len(put), np.int32)
        for whole, given in ((start, starts), (to, ends), (piece, pieces)):
            whole[put] = np.concatenate(given)
        n_bytes = 1 + (cp >= 0x80).astype(int) + (cp >= 0x800) + ((cp >= 0x10000) & (cp != LITERAL))
        w = np.where(piece >= 0, vocab.weight[piece], vocab.byte_weight * n_bytes[start])
        # log weight of all ways from p to its segment's end, from the end back;
        # what ends there goes on to position n, which weighs 0
        total = np.zeros(n + 1)
        stop = self.stop[start]
        left = stop - start
        # two bytes are sorted by radix
        back = np.argsort(left.astype(np.uint16) if size.max(initial=0) < 1 << 16 else left,
                          kind="stable")
        onward = np.where(to == stop, n, to)
        w_back, onward_back, start_back = w[back], onward[back], start[back]
        # edges of a position lie together, those of equal distance follow one another
        heads = np.flatnonzero(np.r_[True, start_back[1:] != start_back[:-1]]) if len(back) else back
        bounds = np.searchsorted(left[back], np.arange(1, int(size.max(initial=0)) + 2))
        nths = np.searchsorted(heads, bounds)
        for a, b, i, j in zip(bounds[:-1], bounds[1:], nths[:-1], nths[1:]):
            head = heads[i:j]
            total[start_back[head]] = np.logaddexp.reduceat(
                w_back[a:b] + total[onward_back[a:b]], head - a)
        self.lq = w + total[onward] - total[start]
        self.q = np.exp(self.lq)
        self.to, self.piece, self.start, self.cp = to, piece, start, cp

    def other(self, edges: np.ndarray) -> np.ndarray:
        """The log probability of taking another edge where these begin."""
        p = self.start[edges]
        with np.errstate(divide="ignore"):
            rest = np.log(np.maximum(-np.expm1(np.minimum(self.lq[edges], 0)), 0))
        return np.where(self.first[p + 1] - self.first[p] > 1, rest, -np.inf)

    def choose(self, p: np.ndarray, u: np.ndarray) -> np.ndarray:
        """For each position the edge that ``u`` in [0, 1) falls on."""
        out, last = self.first[p], self.first[p + 1] - 1
        r = u - self.q[out]
        left = np.flatnonzero((r >= 0) & (out < last))
        r, e, last = r[left], out[left], last[left]     # of those that go on
        while len(left):
            e = e + 1
            out[left] = e
            r = r - self.q[e]
            on = (r >= 0) & (e < last)
            left, r, e, last = left[on], r[on], e[on], last[on]
        return out

    def walk(self, state: np.ndarray, base: np.ndarray, draw) -> tuple[np.ndarray, np.ndarray]:
        """Ways from the given positions to the ends of their segments:
        (edges, which start they belong to), in order.  ``draw(i, pos)`` gives
        the uniform number of start i at text position pos = base + state."""
        n = len(state)
        state, live = state.copy(), np.arange(n)
        steps = []
        while len(live):
            p = state[live]
            e = self.choose(p, draw(live, base[live] + p))
            steps.append((live, e))
            state[live] = self.to[e]
            live = live[self.to[e] < self.stop[p]]
        count = np.zeros(n, np.int64)
        for who, _ in steps:
            count[who] += 1
        put = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.int64)
        for k, (who, e) in enumerate(steps):
            out[put[who] + k] = e
        return out, np.repeat(np.arange(n), count)


def distinct_segments(cp: np.ndarray, begin: np.ndarray):
    """(code points of the distinct segments, their begins, index of each
    segment among them)."""
    stop = np.r_[begin[1:], len(cp)]
    h = segment_hashes(mix(cp.astype(np.uint64) + np.uint64(1)), begin, stop)
    _, one, index = np.unique(h, return_index=True, return_inverse=True)
    size = (stop - begin)[one]
    own = np.cumsum(size) - size
    src = np.repeat(begin[one] - own, size) + np.arange(int(size.sum()))
    return cp[src], own, index.reshape(-1)
