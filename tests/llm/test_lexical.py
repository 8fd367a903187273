"""Ranked lexical search against brute force, and against DuckDB SQL."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from labeltext.llm import lexical, sqltext
from labeltext.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, n long, terms string, tf int, score double, rank int, number int, salt int"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text):
    return TERM.findall((text or "").translate(FOLD))


def naive_search(docs, items, k):
    counts = [(i, Counter(terms_of(t)), len(terms_of(t))) for i, t in docs]
    counts = [c for c in counts if c[2]]
    n_docs, n_terms = len(counts), sum(c[2] for c in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        ranked = []
        for i, c, n in counts:
            m = 100 - 50 + (50 * n * n_docs) // n_terms
            s = 0
            for t in set(terms_of(text)):
                if t in c:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    s += w * ((10**9 * c[t]) // (1000 * c[t] + 20 * m))
            if s > 0:
                ranked.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(ranked, key=lambda x: x[:3])[:k])]
    return sorted(out, key=repr)


def corpus(seed=1, n=400):
    r = random.Random(seed)
    words = ["w%d" % int(r.paretovariate(0.7)) for _ in range(3000)]
    docs = [(i, " ".join(r.choice(words) for _ in range(r.randint(1, 60)))) for i in range(n)]
    docs += [(1000 + i, docs[5][1]) for i in range(120)] + [(5, docs[5][1]), (None, docs[5][1]), (None, "w1 w2")]
    docs += [(2000, None), (2001, ""), (2002, " .,!\x00\x7f "), (2003, "Ärger ärger W1\x00w2 漢字😀 naïve_w3"), (2004, " ".join(r.choice(words) for _ in range(60_000)))]
    items = [(k, " ".join(r.choice(words) for _ in range(r.randint(1, 30)))) for k in range(12)]
    items += [(20, docs[5][1]), (20, docs[5][1]), (20, "w1"), (21, None), (22, " - "), (23, "ärger 漢字😀"), (24, "absent"), (None, "w2 w3"), (25, " ".join(f"w{i}" for i in range(1, 200)))]
    return docs, items


@pytest.mark.parametrize("k,block", [(50, 1000), (3, 4)])
def test_search_brute_force(spark, k, block):
    docs, items = corpus()
    table = spark.createDataFrame([(i, t, 1, "x", 1, 0.5, 1, 1, 1) for i, t in docs], SCHEMA).repartition(7)
    asked = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    got = lexical.search(table, asked, k, block_items=block)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, naive_search(docs, items, k)))


def test_search_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(none, items).collect() == []
    assert lexical.search(items.withColumnRenamed("item_id", "doc_id"), items.where("false")).collect() == []


def test_masks_group_exactly_and_the_search_ends_early():
    r = np.random.default_rng(3)
    for terms in (1, 7, 64, 65, 200):
        present = (r.random((terms, 500)) < 0.02).astype(np.uint8)
        first, group = lexical.mask_groups(present)
        assert (present[:, first][:, group] == present).all() and len({c.tobytes() for c in present.T}) == len(first)
    present = (r.random((8, 5000)) < 0.3).astype(np.uint8)
    impact = present * r.integers(90, 110, present.shape)
    doc, none = r.permutation(5000), np.zeros(5000, bool)
    best = lexical.Best(50)
    seen = lexical.search_chunk(best, present, impact, impact.max(axis=1), doc, none)
    score = impact.sum(axis=0)
    want = np.lexsort((doc, -score))[:50]
    assert best.doc.tolist() == doc[want].tolist() and best.score.tolist() == score[want].tolist()
    assert seen < 500


def test_search_sql(spark, duck):
    rows = QUERIES["op11_mask_search"](spark, "/root/testdata/sf0.001")
    got = rows.select(sorted(rows.columns)).collect()
    want = duck.execute(sqltext.ORACLE["op11_mask_search"]).df()
    assert len(got) and sorted(map(tuple, got)) == sorted(want[sorted(want.columns)].itertuples(index=False, name=None))
