"""Sampling segmentations into sentence pieces, in numpy.

A text is cut between two characters wherever no piece of the model holds the
bytes at the cut side by side (before every word, at most punctuation), so no
segmentation is lost. Each distinct unit has a lattice: its byte
positions, joined by the vocabulary's pieces; bytes of characters outside
the vocabulary are joined by byte pieces. Pieces are weighted by the model's merge
order, w = (rank + 1) ** -alpha, since a byte-pair model has no probabilities;
``alpha`` smooths the distribution as in subword regularisation. The
lattices are summed backwards, which gives every edge its probability given
its start: so a segmentation has probability proportional to its weights'
product.

Segmentations are drawn by Gumbel top-k without replacement, as a best-first
search over prefixes: a prefix carries the largest perturbed
log-probability of its completions; the best child inherits it, the others get
Gumbel values truncated by it. The prefixes popped are the k segmentations of the
largest perturbed values; the value of the next one is the threshold of the
inclusion probabilities 1 - exp(-exp(logp - threshold)). Once a prefix is so
unlikely that no sibling can reach the values already queued (32 random bits
bound a Gumbel draw by 23), the rest of the text is drawn for all texts at once.
"""

from __future__ import annotations

import functools
import heapq
import math
import random

import numpy as np

from labeltext.llm import bytetext
from labeltext.llm.bytetext import U64, mix64

#: No Gumbel value made of 32 random bits is larger.
REACH = 23.0
#: Bytes of units whose lattices are made together, and bytes of text walked together.
BLOCK_BYTES = 1 << 16
WALK_BYTES = 1 << 18
ALPHA = 0.2
SLOT_BITS = 18


class Vocabulary:
    """Pieces of a sentencepiece model as bytes, with lookup tables of hashes."""

    def __init__(self, model_file: str, alpha: float = ALPHA) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = model.get_piece_size()
        self.bytes_of: list[bytes] = [b""] * n
        self.byte_id = np.full(256, model.unk_id(), np.int32)
        normal = []
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes_of[i] = bytes([int(piece[3:5], 16)])
                self.byte_id[int(piece[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.bytes_of[i] = piece.replace("▁", " ").encode()
                normal.append(i)
        order = sorted(normal, key=lambda i: (-model.get_score(i), i))
        self.log_weight = np.full(n, -alpha * math.log(n + 1.0))
        self.log_weight[order] = -alpha * np.log(np.arange(len(order)) + 2.0)
        self.longest = max((len(self.bytes_of[i]) for i in normal), default=1)
        prefixes: dict[bytes, int] = {}
        for i in normal:
            b = self.bytes_of[i]
            for k in range(1, len(b)):
                prefixes.setdefault(b[:k], -1)
        for i in normal:
            prefixes[self.bytes_of[i]] = i
        flat = np.frombuffer(b"".join(prefixes), np.uint8)
        sizes = np.array([len(p) for p in prefixes], np.int64)
        ends = np.cumsum(sizes)
        hashes = raw_hash(bytetext.prefix_hash(flat), ends - sizes, ends)
        #: Open addressing: hash and piece (-1: only a prefix of one) by slot.
        self.slot_hash, self.slot_piece = np.zeros(1 << SLOT_BITS, U64), np.full(1 << SLOT_BITS, -2, np.int32)
        for h, i in zip(hashes.tolist(), prefixes.values()):
            at = h >> (64 - SLOT_BITS)
            while self.slot_piece[at] != -2:
                if self.slot_hash[at] == h:
                    raise ValueError("two prefixes of pieces share a hash")
                at = (at + 1) % (1 << SLOT_BITS)
            self.slot_hash[at], self.slot_piece[at] = h, i
        #: Whether two bytes stand side by side in a piece, or in one character.
        self.joined = np.zeros((256, 256), bool)
        self.joined[:, 0x80:0xC0] = True
        for i in normal:
            b = np.frombuffer(self.bytes_of[i], np.uint8)
            self.joined[b[:-1], b[1:]] = True
        self.flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.size = np.array([len(b) for b in self.bytes_of], np.int64)
        self.first = np.cumsum(self.size) - self.size

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Piece id of each hash; -1: a proper prefix only; -2: neither."""
        at = (h >> U64(64 - SLOT_BITS)).astype(np.int64)
        out = np.full(len(h), -2, np.int32)
        todo = np.arange(len(h))
        while len(todo):
            piece = self.slot_piece[at]
            same = (self.slot_hash[at] == h[todo]) & (piece != -2)
            out[todo[same]] = piece[same]
            on = ~same & (piece != -2)
            todo, at = todo[on], (at[on] + 1) % (1 << SLOT_BITS)
        return out


def raw_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of byte spans; upper bits are good, and cheaper than span_hash."""
    _, down = bytetext._power_table(len(prefix))
    x = (prefix[end] - prefix[start]) * down[start]
    return (x ^ (x >> U64(32))) * U64(0x9FB21C651E98DF25)


class Lattices:
    """The lattices of distinct units laid end to end: ``data`` holds their
    bytes, each followed by one place more for its end."""

    def __init__(self, vocab: Vocabulary, data: np.ndarray, size: np.ndarray) -> None:
        n = len(data)
        stop = np.cumsum(size) - 1  # each unit's end node
        left = np.repeat(stop, size) - np.arange(n)  # bytes to the unit's end
        prefix = bytetext.prefix_hash(data)
        found: list[tuple[np.ndarray, np.ndarray, int]] = []
        alive = np.flatnonzero(left > 0)
        single = np.zeros(n, bool)  # a piece of just this character exists
        width = np.ones(n, np.int64)
        width[data >= 0xC0] = 2
        width[data >= 0xE0] = 3
        width[data >= 0xF0] = 4
        for k in range(1, vocab.longest + 1):
            alive = alive[left[alive] >= k]
            if not len(alive):
                break
            piece = vocab.lookup(raw_hash(prefix, alive, alive + k))
            on = piece != -2
            alive, piece = alive[on], piece[on]
            hit = piece >= 0
            src = alive[hit]
            found.append((src, piece[hit], k))
            if k <= 4:
                single[src[width[src] == k]] = True
        lead = ((data & 0xC0) != 0x80) & (left > 0)
        begin = np.flatnonzero(lead)
        char = np.cumsum(lead) - 1
        bare = np.zeros(n, bool)
        if len(begin):
            bare = (left > 0) & ~single[begin[np.maximum(char, 0)]]
        at = np.flatnonzero(bare)
        found.append((at, vocab.byte_id[data[at]], 0))  # step of one byte
        count = np.zeros(n + 1, np.int64)
        for src, _, _ in found:
            count[src] += 1
        self.first = np.concatenate(([0], np.cumsum(count)))[: n + 1]
        self.count = count
        total = int(count.sum())
        self.piece, self.dst = np.zeros(total, np.int32), np.zeros(total, np.int32)
        free = self.first.copy()
        for src, piece, k in reversed(found):  # longer pieces first
            at = free[src]
            self.piece[at] = piece
            self.dst[at] = src + (k or 1)
            free[src] = at + 1
        self._chances(vocab, left, stop)

    def _chances(self, vocab: Vocabulary, left: np.ndarray, stop: np.ndarray) -> None:
        """``back``: per node the logarithm of the summed weights of its ways to
        the end; ``chance``: per edge its probability given its start; ``run``: the
        running sum of these. Nodes are summed by their distance from the
        end, in plain numbers as far as these cannot underflow, else in logarithms."""
        plain_to = int(600 / max(1e-9, float(-vocab.log_weight.min())))
        weight = np.exp(vocab.log_weight)[self.piece]
        nodes = np.argsort(left.astype(np.uint16) if left.max(initial=0) < 1 << 16 else left, kind="stable")
        nodes = nodes[self.count[nodes] > 0]
        many = self.count[nodes]
        starts = np.concatenate(([0], np.cumsum(many)))
        edge = np.repeat(self.first[nodes] - starts[:-1], many) + np.arange(starts[-1])
        w, to = weight[edge], self.dst[edge]
        deepest = int(left.max(initial=0))
        cut = np.searchsorted(left[nodes], np.arange(1, deepest + 2))
        plain = np.zeros(len(left))
        plain[stop] = 1.0
        for d in range(1, min(deepest, plain_to) + 1):
            lo, hi = cut[d - 1], cut[d]
            if hi > lo:
                e0, e1 = starts[lo], starts[hi]
                plain[nodes[lo:hi]] = np.add.reduceat(w[e0:e1] * plain[to[e0:e1]], starts[lo:hi] - e0)
        with np.errstate(divide="ignore", invalid="ignore"):
            self.back = np.log(plain)
            self.chance = weight * plain[self.dst] / np.repeat(plain, self.count[:-1])
        if deepest > plain_to:
            for d in range(plain_to + 1, deepest + 1):
                lo, hi = cut[d - 1], cut[d]
                if hi > lo:
                    e0, e1 = starts[lo], starts[hi]
                    self.back[nodes[lo:hi]] = np.logaddexp.reduceat(np.log(w[e0:e1]) + self.back[to[e0:e1]], starts[lo:hi] - e0)
            src = np.repeat(np.arange(len(left)), self.count[:-1])
            far = np.flatnonzero(left[src] > plain_to)
            self.chance[far] = np.exp(np.log(weight[far]) + self.back[self.dst[far]] - self.back[src[far]])
        self.run = np.cumsum(self.chance)
        self.before = np.concatenate(([0.0], self.run))[self.first]
        self.run[(self.first + self.count - 1)[self.count > 0]] += 1.0  # the last edge is never passed
        self.more = self.count > 0

    @classmethod
    def of_units(cls, vocab: Vocabulary, data: np.ndarray, size: np.ndarray) -> Lattices:
        """The lattices of many units, made in blocks that stay in the cache."""
        ends = np.cumsum(size)
        cuts = [0]
        while cuts[-1] < len(size):
            done = ends[cuts[-1] - 1] if cuts[-1] else 0
            cuts.append(max(cuts[-1] + 1, int(np.searchsorted(ends, done + BLOCK_BYTES, side="right"))))
        parts = [cls(vocab, data[ends[a] - size[a] : ends[b - 1]], size[a:b]) for a, b in zip(cuts, cuts[1:])]
        if len(parts) == 1:
            return parts[0]
        whole = cls.__new__(cls)
        edges = np.cumsum([0] + [len(x.piece) for x in parts])
        nodes = np.cumsum([0] + [len(x.back) for x in parts])
        for name in ("piece", "chance", "run", "back"):
            setattr(whole, name, np.concatenate([getattr(x, name) for x in parts]) if parts else np.zeros(0))
        for name in ("count", "before", "more"):  # these have one place more
            setattr(whole, name, np.concatenate([getattr(x, name)[:-1] for x in parts] + [np.zeros(1, bool if name == "more" else np.int64)]))
        whole.first = np.concatenate([x.first[:-1] + e for x, e in zip(parts, edges)] + [edges[-1:]])
        whole.dst = np.concatenate([x.dst + np.int32(n) for x, n in zip(parts, nodes)]) if parts else np.zeros(0, np.int32)
        return whole

    @functools.cached_property
    def steps(self) -> dict[int, tuple]:
        """What :meth:`step` gave for the nodes that searches came by; texts
        share units, so most nodes are met again."""
        return {}

    def step(self, node: int) -> tuple[int, list[float] | None, list[int], list[int] | int]:
        """(count, chances, pieces, ends) of a node's edges. A node with one edge:
        (1, None, the pieces of the way as long as it has no choice, its end)."""
        c, way = self.count.item(node), []
        if c == 1:
            while c == 1:
                a = self.first.item(node)
                way.append(self.piece.item(a))
                node = self.dst.item(a)
                c = self.count.item(node)
            return 1, None, way, node
        if c == 0:
            return 0, None, way, node
        a = self.first.item(node)
        return c, self.chance[a : a + c].tolist(), self.piece[a : a + c].tolist(), self.dst[a : a + c].tolist()

    def walk(self, start: np.ndarray, row: np.ndarray, place: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Draw a way to the unit's end from each ``start`` node. Returns (pieces
        in order, number of pieces per start). The random numbers depend on the
        row's ``seed`` and ``place`` (byte offset) alone."""
        n = len(start)
        used = np.zeros(n, np.int64)
        at, shift = start.copy(), place - start
        active = np.flatnonzero(self.more[at])
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        while len(active):
            node = at[active]
            key = seed[row[active]] ^ ((shift[active] + node).astype(U64) * U64(0x9E3779B97F4A7C15))
            key ^= key >> U64(32)
            key *= U64(0xD6E8FEB86659FD93)
            key ^= key >> U64(32)
            key *= U64(0xD6E8FEB86659FD93)
            key >>= U64(12)
            goal = key.astype(np.float64)
            goal *= 2.0**-52
            goal += self.before[node]
            e = self.first[node]
            on = np.flatnonzero(goal >= self.run[e])
            while len(on):
                e[on] += 1
                on = on[goal[on] >= self.run[e[on]]]
            steps.append((active, self.piece[e]))
            used[active] += 1
            node = self.dst[e]
            at[active] = node
            active = active[self.more[node]]
        first = np.cumsum(used) - used
        out = np.zeros(int(used.sum()), np.int32)
        for k, (who, piece) in enumerate(steps):
            out[first[who] + k] = piece
        return out, used


def _uniform(rnd: random.Random) -> float:
    return (rnd.getrandbits(32) + 0.5) * 2.0**-32


def _search(lat: Lattices, units: list[int], k: int, seed: int) -> tuple[list[tuple[float, float, list[int], int, int]], float]:
    """Best-first search over the prefixes of one text. ``units`` holds the
    first node of each unit. Returns up to ``k`` prefixes
    (perturbed value, log-probability, pieces, unit, node) whose rest is to be
    drawn freely, by falling value, and the value of the next one."""
    rnd = random.Random(seed)
    bits, draw, log, exp, steps, n = rnd.getrandbits, rnd.random, math.log, math.exp, lat.steps, len(units)
    heap: list[tuple[float, int, float, int, int, tuple]] = [(log(-log(_uniform(rnd))), 0, 0.0, 0, units[0], ())]
    made, out = 1, []
    while heap:
        value, _, phi, unit, node, path = heapq.heappop(heap)
        value = -value
        if len(out) == k:
            return out, value
        tail: list[int] = []
        need = k - len(out)  # values wanted besides this one
        queued = [-x[0] for x in heapq.nsmallest(need, heap)][::-1]  # the largest, as a heap
        filled = len(queued) == need
        while unit < n:
            step = steps.get(node)
            if step is None:
                step = steps[node] = lat.step(node)
            c, chance, piece, dst = step
            if c == 0:
                unit += 1
                if unit < n:
                    node = units[unit]
                continue
            if filled and phi + REACH < queued[0]:
                break
            if c == 1:
                tail += piece
                node = dst
                continue
            u, best = draw(), 0
            while best < c - 1 and u >= chance[best]:
                u -= chance[best]
                best += 1
            # A sibling's value exceeds the least of the queued only if -log(u) < chance * near,
            # and 1 - u is at most -log(u): most are told so without a logarithm.
            near = exp(min(phi - queued[0], 700.0)) * (1.0 + 1e-6) if filled else math.inf
            for i, x in enumerate(chance):
                if i != best and x > 0:
                    u = (bits(32) + 0.5) * 2.0**-32
                    if 1.0 - u > x * near:
                        continue
                    loc = phi + log(x)
                    g = loc - log(exp(min(loc - value, 700.0)) - log(u))
                    if not filled:
                        heapq.heappush(queued, g)
                        filled = len(queued) == need
                    elif g > queued[0]:
                        heapq.heapreplace(queued, g)
                    else:
                        continue  # it could not be among the first
                    heapq.heappush(heap, (-g, made, loc, unit, dst[i], (*path, *tail, piece[i])))
                    made += 1
            tail.append(piece[best])
            phi += log(chance[best])
            node = dst[best]
        out.append((value, phi, [*path, *tail], unit, node))
    return out, -math.inf


def sample(vocab: Vocabulary, data: np.ndarray, offsets: np.ndarray, keys: np.ndarray, k: int, seed: int):
    """Up to ``k`` distinct segmentations of each text of a slice.

    Returns (text number, rank, pieces flat, piece counts, log-probability,
    perturbed value, log of the inclusion probability), one entry per
    segmentation, by text and rank. Like the model, a text is given a space in
    front; an empty one has no pieces and one segmentation.
    """
    n = len(offsets) - 1
    size = np.diff(offsets)
    full = np.flatnonzero(size > 0)
    # The texts with a space before each, and their cuts into units.
    at = np.concatenate(([0], np.cumsum(np.where(size > 0, size + 1, 0))))
    body = np.full(int(at[-1]), 0x20, np.uint8)
    body[np.arange(len(data)) + np.repeat(at[:-1] + 1 - offsets[:-1], size)] = data
    cut = np.ones(len(body), bool)
    cut[1:] = ~vocab.joined[body[:-1], body[1:]]
    cut[at[:-1][full]] = True
    start = np.flatnonzero(cut)
    end = np.append(start[1:], len(body))
    name = bytetext.span_hash(bytetext.prefix_hash(body), start, end) if len(start) else np.zeros(0, U64)
    _, first_use, which = np.unique(name, return_index=True, return_inverse=True)
    length = (end - start)[first_use] + 1
    base = np.cumsum(length) - length
    units = np.zeros(int(length.sum()), np.uint8)
    inner = np.repeat(start[first_use] - base, length) + np.arange(len(units))
    stop = base + length - 1
    keep = np.ones(len(units), bool)
    keep[stop] = False
    units[keep] = body[inner[keep]]
    lat = Lattices.of_units(vocab, units, length)
    node = base[which]  # first node of each unit in the texts
    unit_of = np.searchsorted(start, at)  # first unit of each text
    with np.errstate(over="ignore"):
        seeds = mix64(keys.astype(U64) + U64(seed) * U64(0xD1342543DE82EF95))

    parts = []
    for lo, hi in bytetext.slices(offsets, WALK_BYTES):
        parts.append(_sample_rows(vocab, lat, lo, hi, size, seeds, node, start, unit_of, at, k))
    if not parts:
        return (np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int64), *(np.zeros(0),) * 3)
    return tuple(np.concatenate([p[i] for p in parts]) for i in range(7))


def _sample_rows(vocab: Vocabulary, lat: Lattices, lo: int, hi: int, size, seeds, node, start, unit_of, at, k: int):
    """The segmentations of the texts ``lo`` to ``hi`` of the slice."""
    text_no, rank, value, phi, threshold = [], [], [], [], []
    heads: list[list[int]] = []
    rest: list[tuple[int, int, int]] = []  # row, first unit that is left, node in it
    for t in range(lo, hi):
        if size[t] == 0:
            text_no.append(t), rank.append(1), value.append(0.0), phi.append(0.0), threshold.append(-math.inf), heads.append([])
            rest.append((-1, 0, 0))
            continue
        own = node[unit_of[t] : unit_of[t + 1]].tolist()
        found, limit = _search(lat, own, k, int(seeds[t]))
        for r, (g, p, head, unit, place) in enumerate(found):
            text_no.append(t), rank.append(r + 1), value.append(g), phi.append(p), threshold.append(limit), heads.append(head)
            rest.append((-1, 0, 0) if unit >= len(own) else (len(text_no) - 1, unit_of[t] + unit, place))
    row_text = np.array(text_no, np.int64)
    rows = len(row_text)
    # The rest of every row: from its cut to the end of its text.
    live = [r for r in rest if r[0] >= 0]
    which_row = np.array([r[0] for r in live], np.int64)
    from_unit = np.array([r[1] for r in live], np.int64)
    many = unit_of[row_text[which_row] + 1] - from_unit if len(live) else np.zeros(0, np.int64)
    occ_row = np.repeat(which_row, many)
    occ = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(from_unit, many)
    begin = node[occ]
    head_at = np.cumsum(many) - many
    begin[head_at] = [r[2] for r in live]
    place = start[occ] - at[row_text[occ_row]] + (begin - node[occ])
    with np.errstate(over="ignore"):
        row_seed = mix64(seeds[row_text] + np.array(rank, U64) * U64(0xA24BAED4963EE407))
    pieces, used = lat.walk(begin, occ_row, place, row_seed)
    weight = np.concatenate(([0.0], np.cumsum(vocab.log_weight[pieces])))
    until = np.cumsum(used)
    phi = np.array(phi) + np.bincount(occ_row, weights=weight[until] - weight[until - used] - lat.back[begin], minlength=rows)
    tail_n = np.bincount(occ_row, weights=used, minlength=rows).astype(np.int64)
    head_n = np.array([len(h) for h in heads], np.int64)
    count = head_n + tail_n
    out = np.zeros(int(count.sum()), np.int32)
    row_at = np.cumsum(count) - count
    is_head = np.zeros(len(out), bool)
    is_head[np.arange(int(head_n.sum())) + np.repeat(row_at - (np.cumsum(head_n) - head_n), head_n)] = True
    out[is_head] = [p for h in heads for p in h]
    out[~is_head] = pieces
    gap = phi - np.array(threshold)
    with np.errstate(divide="ignore", over="ignore"):
        log_inclusion = np.where(gap < -30, gap, np.log(-np.expm1(-np.exp(np.minimum(gap, 700)))))
    return row_text, np.array(rank, np.int32), out, count, phi, np.array(value), log_inclusion


def decode(vocab: Vocabulary, pieces: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the texts that lists of pieces spell; the space in
    front is taken off."""
    size = vocab.size[pieces]
    total = int(size.sum())
    out = vocab.flat[np.arange(total) + np.repeat(vocab.first[pieces] - (np.cumsum(size) - size), size)]
    ends = np.concatenate(([0], np.cumsum(size)))
    bound = ends[np.concatenate(([0], np.cumsum(count)))]
    keep = np.ones(total, bool)
    keep[bound[:-1][(count > 0)]] = False
    shift = np.concatenate(([0], np.cumsum(count > 0)))
    return out[keep], bound - shift
