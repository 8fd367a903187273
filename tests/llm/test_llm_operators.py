"""The operators of labeltext.llm against brute force on small inputs, and on
nulls, empty and long texts, ties, repeated rows, empty tables and columns
whose names clash with those used inside."""

import hashlib
import itertools
import math
import random
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from labeltext.llm import bytecnn, bytetext, components, decontaminate, domcrf, hosttrust, langid, neardup, orderminhash, piecelattice, pieces, pii, slots, superminhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket int, node string, rank int, range int, tail boolean, key long, sig string, next_text string, label int, chunks int"
WORDS = "the of and to a in is was for with that on as by this from are or it be".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "ing", "ed"]) for _ in range(n))


def edge_rows() -> list[tuple]:
    long = prose(1, 30_000)
    texts = [(1, prose(2, 40)), (2, None), (3, ""), (None, "one two"), (4, long), (1, prose(2, 40)), (5, prose(2, 40)), (6, "x" * 5000), (None, None), (7, " \n\t "), (8, "漢字 ñandú 😀 ▁x"), (9, "One  TWO three"), (10, "one two THREE")]
    return [(i, t, None if i == 2 else "en", None if i == 3 else "src0", 0, 1, "n", 1, 1, True, 1, "s", "t", 1, 1) for i, t in texts]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def naive_sets(text, width):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return set()
    return {tuple(w)} if len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def naive_components(rows, width, percent):
    sets = [(i, naive_sets(t, width)) for i, t in rows]
    uf = components.UnionFind()
    for (a, (_, x)), (b, (_, y)) in itertools.combinations(enumerate(sets), 2):
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            uf.union(a, b)
    out = []
    for n, (i, s) in enumerate(sets):
        ids = [sets[m][0] for m in range(len(sets)) if uf.find(m) == uf.find(n) and sets[m][0] is not None]
        c = min(ids) if ids and s else i
        out.append((i, len(s), c, i == c))
    return sorted(out, key=repr)


def test_shingles_and_signatures():
    texts = ["A b  c\td e", "a B c d e", "", None, "one", "a b c d e a b c d e", prose(3, 500)]
    data, offsets = bytetext.buffers(pa.array(texts))
    h, owner = bytetext.shingle_hashes(data, offsets, 4)
    assert np.bincount(owner, minlength=len(texts)).tolist() == [len(naive_sets(t, 4)) for t in texts]
    sig = superminhash.signatures(h, owner, len(texts), 64)
    assert (sig[0] == sig[1]).all() and (sig[2] == sig[3]).all()

    def one(elements):  # element by element, as in the paper
        out = [np.iinfo(np.int64).max] * 64
        for e in elements:
            p = list(range(64))
            for j in range(64):
                d = int(bytetext.mix64(np.array([(int(e) + (j + 1) * 0x9E3779B97F4A7C15) % 2**64], np.uint64))[0])
                k = j + ((d & 0xFFFFFFFF) * (64 - j) >> 32)
                p[j], p[k] = p[k], p[j]
                out[p[j]] = min(out[p[j]], (j << 32) + (d >> 32))
        return out

    for t in (0, 4, 5):
        assert sig[t].tolist() == one(h[owner == t])


def test_signature_estimates_similarity():
    r = np.random.default_rng(1)
    got = []
    for s in range(30):
        common, a, b = (r.integers(1, 2**63, n).astype(np.uint64) for n in (200, 25, 25))
        x, y = np.sort(np.r_[common, a]), np.sort(np.r_[common, b])
        sig = superminhash.signatures(np.r_[x, y], np.repeat([0, 1], 225), 2, 240)
        got.append((sig[0] == sig[1]).mean())
    assert abs(np.mean(got) - 0.8) < 0.02


def test_near_duplicates_brute_force(spark, edges, nothing):
    rows = [(r[0], r[1]) for r in edge_rows()]
    base = prose(7, 120).split()
    for k in range(40):  # a hot group of near copies, more than one block
        r = random.Random(k)
        w = list(base)
        for _ in range(r.randint(0, 9)):
            w[r.randrange(len(w))] = f"w{r.randrange(1000)}"
        rows.append((100 + k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = neardup.near_duplicates(df, shingle=4, percent=80, block=8).collect()
    assert sorted(map(tuple, got), key=repr) == naive_components(rows, 4, 80)
    assert neardup.near_duplicates(edges, shingle=4).count() == len(edge_rows())
    assert neardup.near_duplicates(nothing).collect() == []


def repeated_id_rows():
    """Ids on different texts, copies under one id or none, near copies of both."""
    a, b, c, d = (prose(300 + k, 60) for k in range(4))
    rows = [(5, a), (5, b), (7, a + " more"), (8, b + " more"), (9, c), (9, c), (None, d), (None, d), (None, d + " more"), (3, None), (3, ""), (None, ""), (5, a)]
    return rows + [(20, prose(400, 50)), (None, prose(401, 50)), (21, prose(402, 50)), (21, prose(403, 50)), (21, prose(403, 50) + " x y")]


def test_repeated_ids_lose_no_link(spark):
    rows = repeated_id_rows()
    for seed in range(3):
        shift = [(i + seed if i is not None else None, t) for i, t in rows]
        got = neardup.near_duplicates(spark.createDataFrame(shift, "doc_id long, text string").repartition(3 + seed), shingle=4).collect()
        assert sorted(map(tuple, got), key=repr) == naive_components(shift, 4, 80)
    by_id = {(r["doc_id"], r["component_id"]) for r in got}
    assert (9, 7) in by_id and (10, 7) in by_id  # 7 and 8, shifted, belong to the two texts of id 5


def test_one_row_of_each_component_stays(spark):
    rows = repeated_id_rows()
    df = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, set_name_of int").repartition(4)
    kept = neardup.one_of_each(df, shingle=4)
    assert kept.columns == df.columns
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr)
    sets, uf = [naive_sets(t, 4) for _, t in rows], components.UnionFind()
    for x, y in itertools.combinations(range(len(rows)), 2):
        if sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
            uf.union(x, y)
    want = [(i, t) for (i, t), s in zip(rows, sets) if not s]
    for root in {uf.find(n) for n in range(len(rows)) if sets[n]}:
        mine = [rows[n] for n in range(len(rows)) if sets[n] and uf.find(n) == root]
        want.append(min(mine, key=lambda r: (r[0] is None, r[0] or 0)))
    assert [w[0] for w in got] == [w[0] for w in sorted(want, key=repr)] and len(got) == len(want)
    assert {frozenset(naive_sets(t, 4)) for _, t in got} == {frozenset(naive_sets(t, 4)) for _, t in want} or all(i is None for i, t in set(got) ^ set(want))
    assert neardup.one_of_each(df.where("false")).collect() == []


def test_blocks_are_bounded_in_bytes(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_BYTES", 2000)
    base = prose(7, 300).split()
    rows = [(k, " ".join(base[: 280 + k])) for k in range(12)] + [(50, prose(8, 300))]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4).collect()
    assert sorted(map(tuple, got), key=repr) == naive_components(rows, 4, 80)


def test_components_over_binary_names(spark):
    edges = [(b"c", b"b"), (b"b", b"a"), (b"x", b"x"), (b"z", b"y")]
    got = {bytes(r[0]): bytes(r[1]) for r in components.components(spark.createDataFrame(edges, "u binary, v binary")).collect()}
    assert got == {b"a": b"a", b"b": b"a", b"c": b"a", b"y": b"y", b"z": b"y"}


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(60)] + [(200, 200), (300, 301), (301, 300)]
    got = {r[0]: r[1] for r in components.components(spark.createDataFrame(edges, "u long, v long").repartition(5)).collect()}
    assert got == {**{i: 0 for i in range(61)}, 300: 300, 301: 300}


def naive_rule(host, path, rules):
    fit = [(len(h + p), len(h), h + p, v) for v, h, p in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[2:] if fit else (None, None)


def test_host_trust_brute_force(spark):
    rules = [("allow", "com", "/"), ("block", "b.com", "/x/"), ("block", "bad.net", "/")]
    urls = ["http://a.com/p?q#f", "HTTP://B.COM/x/1", "http://b.com/x", "http://c.org", "http://bad.net/", "http://d.org/z", "nothing", None, "://e.org?x", "http://a.com/p"]
    html = ['<a href="http://c.org/1">x</a>', "", None, '<a href="http://d.org/">', "", '<p><a class=x href=//bad.net/2>', "", "", "", '<A HREF="HTTPS://c.org">']
    df = spark.createDataFrame([(i, u, h, "clash") for i, (u, h) in enumerate(zip(urls, html))], "page_id long, url string, html string, rule string")
    got = {r["page_id"]: r for r in hosttrust.judge_urls(df, rules, domain_weight=0.5, tolerance=1e-4).collect()}
    nodes, edge = set(), {}
    want = {}
    for i, u in enumerate(urls):
        m = re.search(r"://([^/?#]*)([^?#]*)", u or "")
        want[i] = (m[1].lower(), m[2]) if m else ("", "")
        assert (got[i]["host"], got[i]["path"]) == want[i]
        rule, verdict = naive_rule(*want[i], rules)
        assert got[i]["rule"] == rule
        if rule:
            assert got[i]["verdict"] == verdict
    hosts = {h for h, _ in want.values() if h}
    for i, h in enumerate(html):
        for d in re.findall(r'(?i)href=["]?(?:https?:)?//([^/"\'> ]+)', h or ""):
            if want[i][0] and d.lower() != want[i][0]:
                edge[want[i][0], d.lower()] = edge.get((want[i][0], d.lower()), 0) + 1
    nodes = hosts | {x for e in edge for x in e}

    def rank(edge, seed):
        total = sum(seed.values()) or 1
        v = {n: seed.get(n, 0) / total for n in nodes}
        for _ in range(400):
            new = {n: 0.15 * seed.get(n, 0) / total for n in nodes}
            for n in nodes:
                out = {d: w for (s, d), w in edge.items() if s == n} or {n: 1}
                for d, w in out.items():
                    new[d] += 0.85 * v[n] * w / sum(out.values())
            v = new
        return v

    seeds = {"allow": {}, "block": {}}
    for i in want:
        if got[i]["rule"]:
            kind = naive_rule(*want[i], rules)[1]
            seeds[kind][want[i][0]] = seeds[kind].get(want[i][0], 0) + 1
    good, bad = rank(edge, seeds["allow"]), rank({(d, s): w for (s, d), w in edge.items()}, seeds["block"])
    for i, (h, _) in want.items():
        assert got[i]["trust"] == pytest.approx(good.get(h, 0), abs=1e-4) and got[i]["distrust"] == pytest.approx(bad.get(h, 0), abs=1e-4)
        if not got[i]["rule"]:
            b, g = bad.get(h, 0), good.get(h, 0)
            assert got[i]["verdict"] == ("block" if b > 0 and b >= 0.5 * (b + g) else "allow")
    assert got[5]["distrust"] > 0  # d.org links to a blocked host
    assert hosttrust.judge_urls(df.limit(0), rules).collect() == []


def test_distrust_reaches_the_whole_domain_and_far_along_links(spark):
    """Subdomains of a blocked domain that have no page on the way, and a chain of 30 hosts."""
    rows = [(1, "http://bad.net/", ""), (2, "http://x.cdn2.bad.net/a", ""), (3, "http://q.r.s.t.bad.net/", ""), (4, "http://fine.org/", '<a href="http://deep.u.v.bad.net/">')]
    rows += [(100 + k, f"http://h{k}.chain{k}.xyz/", f'<a href="http://h{k + 1}.chain{k + 1}.xyz/">') for k in range(30)]
    rows += [(130, "http://h30.chain30.xyz/", '<a href="http://bad.net/">'), (200, "http://" + "a." * 3000 + "net/", ""), (201, "http://other.com/", None)]
    got = {r["page_id"]: r for r in hosttrust.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), [("block", "bad.net", "/"), ("allow", "com", "/")]).collect()}
    assert all(got[k]["verdict"] == "block" for k in (1, 2, 3, 4, *range(100, 131)))
    assert got[201]["verdict"] == got[200]["verdict"] == "allow" and len(got) == len(rows)
    free = hosttrust.judge_urls(spark.createDataFrame(rows[1:4] + [(9, "http://w.bad.net/x/", "")], "page_id long, url string, html string"), [("block", "w.bad.net", "/x/")])
    assert all(r["distrust"] > 0 for r in free.where("page_id < 5").collect())  # by way of bad.net, which has no page


def slow_spans(text):
    e = [m.span() for m in pii.EMAIL.finditer(text)]
    i = [m.span() for m in pii.IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    c = [m.span() for m in pii.CARD.finditer(text) if 16 <= len(d := re.sub(r"\D", "", m[0])) <= 19 and pii.luhn(d)]
    p = [m.span() for m in pii.PHONE.finditer(text) if 8 <= sum(x.isdigit() for x in m[0]) <= 15]
    return [e, i, c, p]


def test_base_spans_match_the_patterns():
    r = random.Random(4)
    for _ in range(6000):
        text = "".join(r.choice("ab@.@-+ 0129(é") for _ in range(r.randint(0, 40)))
        assert pii.base_spans(text) == slow_spans(text)
    card = "pay 4111 1111 1111 1111, 4111111111111112 +1 (555) 010-2030 x@y.de 10.0.0.256 1.2.3.4"
    assert pii.base_spans(card) == slow_spans(card) and len(pii.base_spans(card)[2]) == 1


def test_semi_markov_recursions_against_enumeration():
    w = pii.fitted_weights()
    text = "call 555-010-2030 ok"
    atoms = [m.span() for m in pii.ATOM.finditer(text)]
    segs = pii._segments(text, atoms)
    marginal, path, log_z = pii._inference(len(atoms), segs, w)
    total, each = 0.0, [0.0] * len(segs)

    def walk(at, score, used):
        nonlocal total
        if at == len(atoms):
            total += math.exp(score)
            for s in used:
                each[s] += math.exp(score)
            return
        walk(at + 1, score, used)
        for s, (i, j, k, f) in enumerate(segs):
            if i == at:
                walk(j, score + float(w[k] @ f), [*used, s])

    walk(0, 0.0, [])
    assert log_z == pytest.approx(math.log(total))
    assert marginal == pytest.approx([x / total for x in each])
    assert [text[atoms[segs[s][0]][0] : atoms[segs[s][1] - 1][1]] for s in path] == ["555-010-2030"]


def test_crf_on_unseen_islands_and_tables(spark, edges, nothing):
    w = pii.fitted_weights()
    hit = truth = false = 0
    for text, gold in pii.training_islands(seed=123, n=200):
        found = set(pii._crf_spans(text, w))
        hit, truth, false = hit + len(found & set(gold)), truth + len(gold), false + len(found - set(gold))
    assert hit / truth > 0.7 and false / truth < 0.03
    assert pii.mask_text("mail a.b@c.org now", w) == "mail <EMAIL> now" and pii.mask_text(None, w) is None
    assert pii.find(edges).count() == len(edge_rows()) and pii.find(nothing).collect() == []
    same = pii.redact(edges)
    assert same.columns == edges.columns and same.count() == len(edge_rows())


def whole_spans(text, w):
    """Segments found when the whole text is one island."""
    atoms = [m.span() for m in pii.ATOM.finditer(text)]
    segs = pii._segments(text, atoms)
    marginal, path, _ = pii._inference(len(atoms), segs, w)
    return [(atoms[segs[s][0]][0], atoms[segs[s][1] - 1][1], segs[s][2]) for s in path if marginal[s] >= pii.MIN_MARGINAL]


def slow_segments(text, atoms):
    """All spans of at most MAX_ATOMS atoms that ``features`` accepts."""
    out = []
    for i in range(len(atoms)):
        first = text[atoms[i][0]]
        if first.isspace() or not (first.isalnum() or first in "+(._%-"):
            continue
        for j in range(i, min(len(atoms), i + pii.MAX_ATOMS)):
            words = [text[a:b] for a, b in atoms[i : j + 1]]
            if "\n" in text[atoms[i][0] : atoms[j][1]] or atoms[j][1] - atoms[i][0] > pii.MAX_SPAN:
                break
            if words[-1][-1].isspace():
                continue
            kinds = [0] if j > i and any(w.lower() in ("at", "@") for w in words) else []
            kinds += [1, 2, 3] if (first.isdigit() or first in "+(") and words[-1][0].isdigit() and words[-1].isascii() else []
            out += [(i, j + 1, k, tuple(f)) for k in kinds if (f := pii.features(pii.KINDS[k], text, atoms[i][0], atoms[j][1])) is not None]
    return out


def test_early_tests_refuse_no_candidate():
    r = random.Random(21)
    parts = ["1", "22", "333", "4444", "12345678", "9" * 16, " ", "  ", ".", "-", "/", "(", ")", "+", "[.]", "(.)", "a", "x at y.de", "@", "b.c", "\t", "\n", ",", "٣", "é", ". ", " ."]
    found = 0
    for _ in range(1500):
        text = "".join(r.choice(parts) for _ in range(r.randint(1, 24)))
        atoms = [m.span() for m in pii.ATOM.finditer(text)]
        got = [(i, j, k, tuple(f)) for i, j, k, f in pii._segments(text, atoms)]
        assert sorted(got) == sorted(slow_segments(text, atoms)), text
        found += len(got)
    assert found > 1000


def test_spelt_at_signs_are_found_like_lower_case_ones():
    w = pii.fitted_weights()
    for spelt in ("john [at] example [dot] com", "john [AT] example [DOT] com", "john AT example DOT com", "john {at} example {dot} com", "john [ at ] example [ dot ] com"):
        assert pii.mask_text(f"please write {spelt} now", w) == "please write <EMAIL> now"


def test_islands_never_change_the_result():
    w, r = pii.fitted_weights(), random.Random(8)
    at = [" at ", " AT ", " aT ", "[at]", " [AT] ", "{ at }", "(At)", "@", " @ ", " at{dot}", "\tat\t", " at {dot} dot "]
    dot = [" dot ", ".", " . ", " DOT ", "[dot]", " { Dot } ", "\t(dot)", " dot{dot} dot ", ". "]
    found = 0
    for n in range(1500):
        text = prose(n, r.randint(0, 30))
        for _ in range(r.randint(1, 3)):
            value = r.choice(["john", "a.b", "the", "x-1", "K"]) + r.choice(at) + r.choice(["example", "Mail-host", "dot", "at"]) + r.choice(dot) + r.choice(["com", "ORG", "info", "then"])
            text += r.choice([" ", ", ", " mail: ", "\n"]) + r.choice([value, value, "+1 (555) 010-2030", "10.0.0.1", "y" * 90, "at"]) + r.choice([" ", ". "]) + prose(n + 5000, r.randint(0, 40))
        want = whole_spans(text, w)
        assert pii._crf_spans(text, w) == want
        found += len(want)
    assert found > 500


def test_slots(spark, edges, nothing, tmp_path):
    rows = slots.assign(edges, shards=3, slots=64, map_path=str(tmp_path / "map")).collect()
    assert len(rows) == len(edge_rows())
    for shard in {r["shard"] for r in rows}:
        assert sorted(r["position"] for r in rows if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in rows)))
    want = sorted((i if i is not None else -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in edge_rows())
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["size"], r["text_crc32"]) for r in rows) == want
    owner = slots.load_map(spark, str(tmp_path / "map"), 2)
    assert all(owner[r["virtual_slot"]] == r["shard"] for r in rows)
    assert slots.load_map(spark, str(tmp_path / "map"), 1) == slots.first_map(64, 3)
    assert slots.assign(nothing, shards=3, slots=16).collect() == []


def test_rebalance_moves_little_and_evens_out():
    r = random.Random(2)
    load = [r.randint(1, 1000) for _ in range(4096)]
    first = slots.rebalance(slots.first_map(4096, 16), load, 16)
    total = [sum(v for v, o in zip(load, first) if o == k) for k in range(16)]
    assert max(total) - min(total) <= 10
    grown = slots.rebalance(first, load, 17)
    moved = [s for s in range(4096) if grown[s] != first[s]]
    assert sum(grown[s] == 16 for s in moved) >= 0.8 * len(moved) and len(moved) < 4096 / 8


def spark_hash(*values):
    """xxhash64 of longs (int), 4-byte ints ((int,)) and texts, as Spark chains it."""
    seed = 42
    for v in values:
        data = v.encode() if isinstance(v, str) else struct.pack("<q", v) if isinstance(v, int) else struct.pack("<i", v[0])
        seed = xxhash.xxh64_intdigest(data, seed)
    return seed - (1 << 64) if seed >> 63 else seed


def naive_signature(text):
    words = [spark_hash(w) for w in re.split(r"[\x09-\x0D\x20]+", text) if w]
    hashes = [spark_hash(words[i], words[i + 1] if i + 1 < len(words) else 0) for i in range(max(len(words) - 1, min(len(words), 1)))]
    seen, bins = {}, {}
    for i, h in enumerate(hashes):
        top = ((((h << 28) & (2**64 - 1)) ^ (1 << 63)) - (1 << 63)) >> 28  # the 36 bits that are kept
        v = (spark_hash(top, (seen.get(top, 0),)) & (2**64 - 1)) >> 29 & ((orderminhash.BINS << 30) - 1)
        seen[top] = seen.get(top, 0) + 1
        bins.setdefault(v >> 30, []).append((v & ((1 << 30) - 1), i))
    lowest = {b: sorted(k)[: orderminhash.PICKED] for b, k in bins.items()}
    return [spark_hash(*[r for r, _ in sorted(lowest[b], key=lambda x: x[1])]) if b in lowest else None for b in range(orderminhash.BINS)]


def naive_likeness(a, b):
    filled = [(x, y) for x, y in zip(a, b) if x is not None or y is not None]
    return sum(x == y for x, y in filled) / len(filled) if filled else 1.0


def test_order_minhash(spark, edges, nothing):
    """Every column against brute force, with null, repeated and hot ids."""
    extra = [(77, prose(600 + i, 30)) for i in range(60)] + [(None, prose(700 + i, 20)) for i in range(40)] + [(i, prose(800 + i, 25)) for i in range(200, 260)]
    texts = [(i, t or "") for i, t, *_ in edge_rows()] + extra
    rows = edges.select("doc_id", "text", "key", "sig", "range", "tail").unionByName(spark.createDataFrame(extra, "doc_id long, text string"), allowMissingColumns=True)
    got = orderminhash.fingerprints(rows.repartition(5)).collect()
    ordered = sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0, spark_hash(r[1]), r[1]))
    want = []
    hexed = lambda sig: "".join(orderminhash.EMPTY if x is None else f"{x & 0xFFFFFFFF:08x}" for x in sig)
    for n, (i, t) in enumerate(ordered):
        after = ordered[(n + 1) % len(ordered)][1]
        cut = len(t) // 4
        edited = t[: len(t) - cut] + after[:cut]
        mine, other, new = naive_signature(t), naive_signature(after), naive_signature(edited)
        want.append((i, len(t), hexed(mine), edited, hexed(new), round(naive_likeness(mine, new), 9), round(naive_likeness(mine, other), 9)))
    rounded = [(*r[:5], round(r[5], 9), round(r[6], 9)) for r in map(tuple, got)]
    assert sorted(map(repr, rounded)) == sorted(map(repr, want))
    assert orderminhash.fingerprints(nothing).collect() == []


def test_order_minhash_spreads_a_hot_id(spark):
    """A third of the rows without an id: no range holds more than a few shares."""
    rows = spark.createDataFrame([(None if i % 3 == 0 else i, f"t{i}") for i in range(3000)], "doc_id long, text string")
    keyed = rows.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("key"), F.xxhash64("text").alias("tie"), "text")
    out = orderminhash.with_next(keyed, "key", "tie", ["text"])
    plan = out._jdf.queryExecution().analyzed().toString()
    assert out.count() == 3000 and "range" in plan
    ordered = sorted(((i if i % 3 else -(1 << 63), spark_hash(f"t{i}"), f"t{i}") for i in range(3000)))
    after = {r[2]: ordered[(n + 1) % 3000][2] for n, r in enumerate(ordered)}
    assert {r["text"]: r["next_text"] for r in out.collect()} == after


def test_order_minhash_numbers_occurrences_and_follows_order(spark):
    """(bin, rank) of every numbered k-mer against a count in Python."""
    text = "a b a b c a b"
    df = spark.createDataFrame([(text,)], "text string")
    packed = df.select(orderminhash.numbered(orderminhash.kmers(F.col("text")))).first()[0]
    words = text.split()
    hashes = {w: h for w, h in df.select(F.explode(F.split("text", " ")).alias("w")).select("w", F.xxhash64("w")).distinct().collect()}
    seen, want = {}, []
    for i in range(len(words) - 1):
        h = spark.range(1).select(F.xxhash64(F.lit(hashes[words[i]]), F.lit(hashes[words[i + 1]]))).first()[0]
        top = (((h << 28) & (2**64 - 1)) ^ (1 << 63)) - (1 << 63) >> 28  # the 36 bits kept, signed
        number = seen.get(top, 0)
        seen[top] = number + 1
        v = spark.range(1).select(F.xxhash64(F.lit(top).cast("long"), F.lit(number))).first()[0] & (2**64 - 1)
        want.append((((v >> 29) & ((orderminhash.BINS << 30) - 1)) << 28) | i)
    assert packed == sorted(want)
    near = spark.createDataFrame([(prose(5, 300),)], "a string").withColumn("b", F.concat(F.substring("a", 700, 10_000), F.lit(" "), F.substring("a", 1, 700)))
    same_bag = near.select(orderminhash.likeness(orderminhash.signature(F.col("a")), orderminhash.signature(F.col("b")))).first()[0]
    assert 0 < same_bag < 1  # nearly the same k-mers, but in another order


def test_language_id(spark, edges, nothing):
    texts = {"en": "the house is on the hill and the dog was there", "fr": "la maison est sur la colline et le chien est là", "de": "das haus ist auf dem hügel und der hund war dort"}
    train = spark.createDataFrame([(i, t * 3, lang) for i, (lang, t) in enumerate(list(texts.items()) * 5)], "doc_id long, text string, lang string")
    model = langid.fit(train, ["en", "fr", "de"])
    scores = langid.text_scores(model, pa.array(["thé", None, ""]))
    raw = "thé".encode()
    want = sum(model[((int.from_bytes(raw[k : k + 3], "big") * 0x9E3779B1) % 2**32) >> 16] for k in range(len(raw) - 2))
    assert scores[0] == pytest.approx(want, rel=1e-5) and not scores[1:].any()
    probe = spark.createDataFrame([(i, t, None, "h") for i, t in enumerate(texts.values())] + [(9, None, "de", "h"), (10, "", None, None)], "doc_id long, text string, lang string, language string")
    got = {r["doc_id"]: r for r in langid.identify(probe, model, ["en", "fr", "de"], F.col("text"), F.col("lang"), F.col("language")).collect()}
    assert [got[i]["language"] for i in range(3)] == ["en", "fr", "de"] and len(got) == 5
    assert langid.identify(edges, model, ["en", "fr", "de"], F.col("text"), F.col("lang"), F.col("source")).count() == len(edge_rows())
    assert langid.identify(nothing, model, ["en", "fr", "de"], F.col("text")).collect() == []


def naive_fusion(rows, model, names, kappa=20.0):
    """(language, confidence) of (text, declared, host) rows, step by step."""
    languages = names[:-1]
    scores = [[x * langid.TEXT_WEIGHT for x in langid.text_scores(model, pa.array([t]))[0]] for t, _, _ in rows]
    tag = [re.match(r"\s*([A-Za-z]*)", d or "")[1].lower() for _, d, _ in rows]
    claim = ["none" if not t else t if t in languages else "other" for t in tag]
    host = [(h or "").lower() for _, _, h in rows]
    suffix = [langid.SUFFIXES.get(h.rsplit(".", 1)[-1], "none") if "." in h else "none" for h in host]
    suffix = [x if x in languages else "none" for x in suffix]
    domain = [".".join(h.split(".")[-2:]) if h.count(".") > 1 else h for h in host]
    guess = [max(range(len(names)), key=lambda k: (s[k], -k)) if max(s) > min(s) else None for s in scores]
    known = [n for n, g in enumerate(guess) if g is not None]
    count = lambda test: [sum(guess[n] == k and test(n) for n in known) for k in range(len(names))]
    every = count(lambda n: True)
    corpus = [(c + 1) / (sum(every) + len(names)) for c in every]
    out = []
    for n in range(len(rows)):
        total = list(scores[n])
        for value, column in ((claim[n], claim), (suffix[n], suffix)):
            here = count(lambda m: column[m] == value)
            for k in range(len(names)):
                total[k] += math.log((here[k] + 1) / (every[k] + len(languages) + 2))
        of_domain, of_host = count(lambda m: domain[m] == domain[n]), count(lambda m: host[m] == host[n])
        parent = [(of_domain[k] + kappa * corpus[k]) / (sum(of_domain) + kappa) for k in range(len(names))]
        prior = [(of_host[k] + kappa * parent[k]) / (sum(of_host) + kappa) for k in range(len(names))] if sum(of_host) else corpus
        total = [t + math.log(p) for t, p in zip(total, prior)]
        best = max(range(len(names)), key=lambda k: (total[k], -k))
        out.append((names[best], 1 / sum(math.exp(t - total[best]) for t in total)))
    return out


def test_fused_posterior_brute_force(spark):
    texts = {"en": "the house is on the hill and the dog was there", "fr": "la maison est sur la colline et le chien est là", "de": "das haus ist auf dem hügel und der hund war dort"}
    train = spark.createDataFrame([(i, t * 3, lang) for i, (lang, t) in enumerate(list(texts.items()) * 5)], "doc_id long, text string, lang string")
    languages = ["en", "fr", "de"]
    model = langid.fit(train, languages)
    r = random.Random(12)
    rows = []
    for _ in range(150):
        words = r.choice(list(texts.values())).split()
        text = r.choice([" ".join(r.sample(words, r.randint(0, 6))), "zzq xkw 12", "", None, "a"])
        rows.append((text, r.choice(["en", "de-AT", " FR", "xx", "", None]), r.choice(["a.b.de", "c.b.de", "x.fr", "www.y.co.uk", "plain", "", None, "e.org"])))
    df = spark.createDataFrame([(i, *row, "clash", i, "x") for i, row in enumerate(rows)], "n int, text string, declared string, host string, language string, li_text int, li_host string").repartition(4)
    got = langid.identify(df, model, languages, F.col("text"), F.col("declared"), F.col("host")).orderBy("n").collect()
    want = naive_fusion(rows, model, [*languages, langid.UND])
    assert all(g["li_text"] == g["n"] and g["li_host"] == "x" and g["text"] == rows[g["n"]][0] for g in got)
    for g, (language, confidence) in zip(got, want):
        assert g["language"] == language and g["confidence"] == pytest.approx(confidence, abs=1e-6)


def test_language_of_pages_reads_markup_address_and_text(spark, tmp_path):
    docs = [(i, t * 3, lang) for i, (lang, t) in enumerate([("en", "the house is on the hill and the dog was there "), ("fr", "la maison est sur la colline et le chien est là "), ("de", "das haus ist auf dem hügel und der hund war dort "), ("es", "la casa está en la colina y el perro estaba allí ")] * 6)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    page = lambda text, lang=None: f"<html{f' lang={lang}' if lang else ''}><head><script>the and of is</script><style>the</style></head><body><!-- the the --><p>{text}</p></body></html>"
    rows = [(i, f"http://h{i % 2}.example.org/{i}", page(t, lang)) for i, t, lang in docs]
    rows += [(100, "http://a.de/", page("", "de")), (101, None, None), (102, "http://h0.example.org/", page("das haus ist auf dem hügel und der hund")), (103, "x", page("das haus ist auf dem hügel", "fr"))]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    from labeltext.llm.queries import language_of_pages

    got = {r["page_id"]: r["language"] for r in language_of_pages(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows) and all(got[i] == lang for i, _, lang in docs)
    assert got[100] == got[102] == got[103] == "de"


def test_host_prior_decides_a_text_without_evidence(spark):
    train = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([("the and of with that", "en"), ("und der die das nicht", "de")] * 8)], "doc_id long, text string, lang string")
    model = langid.fit(train, ["en", "de"])
    rows = [(i, "und der die das nicht", "a.de.example") for i in range(30)] + [(40 + i, "the and of with that", "b.example") for i in range(60)] + [(999, "", "a.de.example")]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, host string"), model, ["en", "de"], F.col("text"), host=F.col("host"))
    assert got.where("doc_id = 999").first()["language"] == "de"


@pytest.fixture(scope="module")
def vocab():
    return piecelattice.Vocabulary(pieces.MODEL)


def test_piece_sampling_follows_the_lattice(vocab):
    word = {b: i for i, b in enumerate(vocab.bytes_of) if b and i > 258}

    def ways(s):
        if not s:
            yield (), 0.0
        for n in range(1, len(s) + 1):
            if s[:n] in word:
                for rest, p in ways(s[n:]):
                    yield (word[s[:n]], *rest), p + vocab.log_weight[word[s[:n]]]

    p = {s: math.exp(v) for s, v in ways(b" the at")}
    z = sum(p.values())
    n = 3000
    data, offsets = bytetext.buffers(pa.array(["the at"] * n))
    text, rank, ids, count, logp, value, inclusion = piecelattice.sample(vocab, data, offsets, np.arange(n), 2, 9)
    ends = np.concatenate(([0], np.cumsum(count)))
    first, thompson = {}, {}
    for i, (t, r) in enumerate(zip(text, rank)):
        seg = tuple(ids[ends[i] : ends[i + 1]].tolist())
        assert logp[i] == pytest.approx(math.log(p[seg] / z))
        if r == 1:
            first[seg] = first.get(seg, 0) + 1 / n
            previous = seg
        else:
            assert seg != previous
        thompson[seg] = thompson.get(seg, 0) + p[seg] / z / math.exp(inclusion[i]) / n
    for seg in sorted(p, key=p.get)[-4:]:
        assert first[seg] == pytest.approx(p[seg] / z, abs=0.04)
        assert thompson[seg] == pytest.approx(p[seg] / z, abs=0.05)  # inclusion scores are unbiased weights


def test_piece_round_trip(spark, edges, nothing):
    got = pieces.encode(edges, k=3).collect()
    assert all(r["round_trip"] for r in got)
    by_row = {}
    for r in got:
        by_row.setdefault(r["doc_id"], []).append((r["rank"], tuple(r["pieces"])))
    assert by_row[3] == [(1, ())] and sorted(by_row[1])[:2] == sorted(by_row[1])[0:1] * 2  # equal rows, equal draws
    assert len({p for _, p in by_row[9]}) == 3
    back = pieces.decode(pieces.encode(edges.where("doc_id = 8"), k=2)).collect()
    assert {r["text"] for r in back} == {"漢字 ñandú 😀 ▁x"}
    again = {(r["doc_id"], r["rank"], tuple(r["pieces"])) for r in pieces.encode(edges.repartition(7), k=3).collect()}
    assert again == {(r["doc_id"], r["rank"], tuple(r["pieces"])) for r in got}
    assert pieces.encode(nothing).collect() == []


def naive_edits(a, b):
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_best_edits():
    r = random.Random(8)
    for _ in range(800):
        a, b = ("".join(r.choice("abc") for _ in range(r.randint(lo, 18))) for lo in (1, 0))
        assert decontaminate.best_edits(a, b)[0] == naive_edits(a, b)


def test_decontamination_recall_and_precision(spark, edges, nothing):
    r = random.Random(6)
    items = [(i, prose(500 + i, r.randint(18, 60))) for i in range(20)]
    docs, truth = [], set()
    for d in range(60):
        text, item = prose(900 + d, 60), items[d % 20][1]
        if d < 40:
            x = list(item)
            for _ in range(int(len(x) * (0 if d < 20 else 0.05))):
                at, k = r.randrange(len(x)), r.random()
                x[at : at + (k < 0.67)] = r.choice("xyz") * (k < 0.34 or k >= 0.67)
            text = text[:90] + " " + "".join(x) + " " + text[90:]
        docs.append((d, text))
        truth |= {(d, i) for i, t in items if naive_edits(t, text) <= int(0.1 * len(t))}
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*items, (99, None), (98, "")], "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]) for x in decontaminate.matches(df, bench).collect()}
    assert got <= truth and len(got) >= 0.97 * len(truth) and {d for d, _ in got} >= set(range(20))
    blocks = {(x["doc_id"], x["item_id"]) for x in decontaminate.matches(df, bench, block_items=6).collect()}
    assert blocks == got
    assert {x["doc_id"] for x in decontaminate.clean_documents(df, bench).collect()} == set(range(60)) - {d for d, _ in got}
    assert decontaminate.clean_documents(edges, bench).columns == edges.columns
    assert decontaminate.matches(nothing, bench).collect() == [] and decontaminate.matches(edges, bench.limit(0)).collect() == []


def edited_items(length: int, count: int):
    """Items of random letters, and texts that hold each with all edits allowed."""
    r = random.Random(length)
    letters = "".join(c * n for c, n in zip("etaoinshrdlu cm", (12, 9, 8, 8, 7, 7, 6, 6, 6, 4, 4, 3, 18, 3, 2)))
    random_text = lambda n: "".join(r.choice(letters) for _ in range(n))
    items = [(i, random_text(length)) for i in range(count)]
    docs = []
    for _, item in items:
        x = list(item)
        for _ in range(int(0.1 * length)):
            at, k = r.randrange(len(x)), r.random()
            x[at : at + (k < 0.67)] = r.choice("xyz") * (k < 0.34 or k >= 0.67)
        docs.append(random_text(r.randint(0, 300)) + "".join(x) + random_text(r.randint(0, 300)))
    docs += [random_text(2 * length), "", items[0][1], items[0][1][: length - int(0.1 * length)]]
    return items, docs


@pytest.mark.parametrize("length", [9, 10, 15, 30, 63, 100, 200, 400, 800, 1600, 3200, 6000])
def test_decontamination_recall_at_the_full_edit_limit(length):
    items, docs = edited_items(length, 40 if length < 400 else 20 if length < 1000 else 8)
    found = decontaminate.Index(items, 0.1).search(docs)
    want = [{k: n for k, (_, item) in enumerate(items) if (n := decontaminate.best_edits(item, doc)[0]) <= int(0.1 * length)} for doc in docs]
    hits = sum(len({k for k, _, _ in f} & set(w)) for f, w in zip(found, want))
    assert all(n == w[k] for f, w in zip(found, want) for k, n, _ in f if length < 400 or n == 0) and all({k for k, _, _ in f} <= set(w) for f, w in zip(found, want))
    assert hits >= 0.95 * sum(map(len, want)) and sum(map(len, want)) >= len(items)
    assert [k for k, _, _ in found[-2]] == [0]


def test_candidates_come_from_lsh_buckets_alone(monkeypatch):
    """Without buckets nothing is found, not even an exact copy; with buckets of one walk, less than with all."""
    items, docs = edited_items(400, 10)
    full = decontaminate.Index(items, 0.1)
    assert sum(map(len, full.search(docs))) >= 10
    for group in full.groups.values():
        group.key = np.zeros_like(group.key)
    assert all(not f for f in full.search(docs))
    monkeypatch.setattr(decontaminate, "lsh_size", lambda shortest: (int(1.6 * shortest), 1, 1, 18, 8))
    assert sum(map(len, decontaminate.Index(items, 0.1).search(docs))) < 10


def test_dom_marginals_against_enumeration():
    w = domcrf.fitted()
    nodes, runs = domcrf.parse("<div><p>One two, three.</p><ul><li><a href=x>y</a></ul></div><footer>z")
    x = domcrf.unary(nodes, runs)
    prob, _ = domcrf.marginals(nodes, x, w)
    total, each = 0.0, [0.0] * len(nodes)
    for y in itertools.product((0, 1), repeat=len(nodes)):
        s = sum(float(x[i] @ w.unary) * y[i] for i in range(len(nodes))) + sum(w.edge[domcrf._kind(nodes[i])][y[nodes[i].parent]][y[i]] for i in range(1, len(nodes)))
        total += math.exp(s)
        each = [e + math.exp(s) * v for e, v in zip(each, y)]
    assert prob == pytest.approx([e / total for e in each])


def test_dom_extraction(spark):
    w = domcrf.fitted()
    r, bad, blocks = random.Random(41), 0, 0
    for _ in range(120):
        nodes, runs = domcrf.parse(domcrf.labelled_page(r))
        prob, _ = domcrf.marginals(nodes, domcrf.unary(nodes, runs), w)
        for i, n in enumerate(nodes[1:], 1):
            if n.own:
                blocks += 1
                bad += (prob[i] >= 0.5) != any(a == "data-y" for a, _ in n.attrs)
    assert bad / blocks < 0.01
    page = (
        '<html><head><title>t</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><a href=/>Home</a> <a href=/b>News</a></nav>'
        '<div class="cookie-notice">We use cookies</div><article><h1>A  &amp; B</h1><p><b>Bold<br>text<p>More text, with\n<a href=x>a link</a> in it &copy;.</article>'
        '<section id="comments"><div class="comment"><p>Nice one.</p></div></section><aside class=sidebar><ul><li><a href=q>Other</a></ul></aside><footer>&copy; me</footer>'
    )
    df = spark.createDataFrame([(1, "u", page, 1), (2, None, None, 1), (3, "u", "", 1), (None, "u", "<p", 1), (1, "u", page, 1)], "page_id long, url string, html string, text int")
    got = domcrf.extract(df).collect()
    assert [r["text"] for r in got if r["page_id"] == 1] == ["A & B Bold text More text, with a link in it ©."] * 2
    assert [(r["text"], r["n_chars"]) for r in got if r["page_id"] != 1] == [("", 0)] * 3
    assert domcrf.extract(df.limit(0)).collect() == []


def shown(html):
    return " ".join(t for _, t in domcrf.parse(html)[1])


@pytest.mark.parametrize(
    "html, text",
    [
        ("<html><head><title>t</title><body><article>One", "One"),
        ("<html><head><title>t</title><style>p{}</style><article>One", "One"),
        ("<head><meta charset=x> <title>t</title>One<p>two", "One two"),
        ("<head><noscript><link rel=x><body>One", "One"),
        ("<head><title>t</title></html>One", "One"),
        ("<head><template><body>no</template></head>One", "One"),
        ("<p>One</p><head><title>t</title><p>two", "One two"),
        ("a <select><option>A<option>B</select>b", "a b"),
        ("a <select><optgroup><option>A<option>B<select><option>C</select>b", "a b"),
        ("<datalist><option>A<option>B</datalist>b", "b"),
        ("<div><option>A</div><p>b", "b"),
        ("<option>A<p>b", "b"),
        ("<div><svg><g><path></div>b", "b"),
        ("<svg><g><path/><text>no</text></svg>b", "b"),
        ("<svg><path><p>b", "b"),
        ("<svg><foreignObject><p>no</p></foreignObject></svg>b", "b"),
        ("<div><noscript><b>no</div>no</noscript>b", "b"),
        ("<object><object>no</object>no</object>b", "b"),
        ("<a href=x><svg><a>no</svg>in</a> b", "in b"),
        ("plain", "plain"),
        ("plain <p", "plain"),
    ],
)
def test_dom_hidden_elements_end(html, text):
    assert shown(html) == text


def test_dom_reads_the_whole_class():
    nodes, runs = domcrf.parse(f'<div class="{"x " * 400}sidebar">a')
    assert domcrf.unary(nodes, runs)[1, len(domcrf.TAGS) + 1 + list(domcrf.WORDS).index("side")] == 1


def test_byte_cnn(spark, edges, nothing):
    r = random.Random(3)
    good = [prose(50 + i, r.randint(5, 200)) for i in range(150)]
    bad = [" ".join(w + r.choice(["###", "$$$", "!!"]) for w in prose(700 + i, r.randint(5, 200)).split()) for i in range(150)]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(good + bad)], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(300)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    model = bytecnn.fit(docs, labels)
    rows = bytecnn.score(docs, model).collect()
    held = [x for x in rows if x["held_out"]]
    assert all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 3 == 1) for x in rows)
    assert np.mean([x["predicted"] == int(x["doc_id"] < 150) for x in held]) > 0.9
    data, offsets = bytetext.buffers(pa.array(["", "ab", prose(4, 100), None]))
    got = bytecnn.document_features(model, data, offsets)
    for k, text in enumerate(["", "ab", prose(4, 100), ""]):
        b = text.encode()
        conv = np.array([[sum(model.table[j][b[i + j] if i + j < len(b) else 0][f] for j in range(bytecnn.WIDTH)) for f in range(bytecnn.FILTERS)] for i in range(len(b))])
        half = [conv[i : i + bytecnn.HALF].max(axis=0) for i in range(0, len(b), bytecnn.HALF)]
        chunk = [np.maximum(np.maximum(p, q) + model.bias, 0) for p, q in zip(half, half[1:])] or [np.maximum(h + model.bias, 0) for h in half]
        want = np.r_[np.mean(chunk, axis=0), np.max(chunk, axis=0)] if chunk else np.zeros(2 * bytecnn.FILTERS)
        assert got[k] == pytest.approx(want, abs=1e-4)
    assert bytecnn.score(edges, model).count() == len(edge_rows()) and bytecnn.score(nothing, model).collect() == []
    assert bytecnn.fit(nothing, labels).unit.any() == False  # noqa: E712


def test_byte_cnn_learns_from_whole_texts(spark):
    """What marks a bad text stands behind its first 4 KB only."""
    marks = ["###", "$$$", "!!"]

    def text(n, bad):
        w = prose(n, 1200).split()
        return " ".join(w[:900] + [x + (random.Random(n).choice(marks) if bad else "") for x in w[900:]])

    rows = [(i, text(i, i % 2 == 0), i % 2) for i in range(160)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    assert min(r[1].find("#") for r in rows if "#" in r[1]) > 4000
    got = [x for x in bytecnn.score(docs, bytecnn.fit(docs, labels)).collect() if x["held_out"]]
    assert np.mean([x["predicted"] == x["doc_id"] % 2 for x in got]) > 0.9
    small = bytecnn.fit(docs, labels, size=1)
    assert small.unit.any() == False  # noqa: E712  one text is one label: a constant


def test_gumbel_pieces_query_gives_its_pieces(spark, tmp_path):
    """The registered query returns the segmentations with all scores; the digest is theirs."""
    rows = [(1, "A small text, cut twice."), (2, ""), (3, None), (None, "no id ü你"), (1, "A small text, cut twice.")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    from labeltext.llm.queries import op7_gumbel_pieces

    out = op7_gumbel_pieces(spark, str(tmp_path))
    got = out.collect()
    assert len(got) == 8 and all(r.round_trip and r.perturbed is not None and r.n_pieces == len(r.pieces) for r in got)
    assert all(r.pieces_sha256 == hashlib.sha256(np.array(r.pieces, "<i4").tobytes()).hexdigest() for r in got)
    assert {(r.doc_id, r.text) for r in pieces.decode(out).collect()} == {(i, t or "") for i, t in rows}
    gaps = spark.createDataFrame([([5, 6],), (None,), ([],)], "pieces array<int>").coalesce(1)
    assert [r[0] is None for r in gaps.select(pieces.digest("pieces")).collect()] == [False, True, False]


def test_gumbel_pieces_query_sends_no_arrays_back_to_python(spark, tmp_path):
    from labeltext.llm.queries import op7_gumbel_pieces

    rows = [(1, "one text, and more"), (2, ""), (3, None), (4, "x" * 50), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = op7_gumbel_pieces(spark, str(tmp_path))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan
    packed = pieces.encode(docs, k=2, packed=True).withColumns({"a": pieces.digest("packed", packed=True), "b": pieces.digest("pieces")}).collect()
    assert len(packed) == 8 and all(r.a == r.b and bytes(r.packed) == np.array(r.pieces, "<i4").tobytes() for r in packed)
    empty = pieces.encode(docs.where("doc_id in (2, 3)"), packed=True).collect()
    assert [(r.pieces, bytes(r.packed)) for r in empty] == [([], b"")] * 2
