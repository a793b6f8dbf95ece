"""Ranked search against a brute-force version."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from emberframe.llm import lexical_search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
ITEMS = "item_id bigint, text string, doc_id string, score int"


def split(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_search(docs, items, top):
    bags = [(key, Counter(split(text))) for key, text in docs]
    some, total = sum(1 for _, b in bags if b), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        found = []
        for key, bag in bags:
            m = 75 + (25 * bag.total() * some) // max(total, 1)
            score = sum(n * math.floor(1000 * math.log((2 * some + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 12 * m))
                        for t, n in Counter(split(text)).items() if bag[t])
            if score > 0:
                found.append((-score, key is None, key))
        out += [(item, place, key, -score) for place, (score, _, key) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:top], 1)]
    return Counter(out)


def found_by(docs, items, **how):
    rows = lexical_search.search(docs, items, **how).collect()
    return Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in rows)


@pytest.mark.parametrize("how", [{}, {"block_docs": 7, "group_bytes": 300}, {"block_docs": 40, "top": 2}])
def test_odd_rows(spark, make_docs, odd_texts, how):
    rng = np.random.default_rng(5)
    words = ["the", "Of", "and", "Ünï", "x1", "rare", "b", "C", "word3", "naïve"] + [f"t{i}" for i in range(40)]
    texts = [" ".join(rng.choice(words, rng.integers(1, 30), p=np.arange(50, 0, -1) / 1275)) for _ in range(150)]
    docs = make_docs([*odd_texts, *texts, *texts[:20], "A-b_c" * 10, "x" * 3_000_000, "long tail " * 300_000])
    items = [(1, "the and of rare", None, 1), (2, None, "q", 2), (3, "", "q", 2), (4, "no such words at all", None, None),
             (5, "b b b B. x1 t3-t4 naïve Ünï", None, None), (5, "t39 the", None, None), (None, "rare word3", None, None), (7, texts[3], None, None)]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute_search(rows, [i[:2] for i in items], how.get("top", 20))
    assert found_by(docs, spark.createDataFrame(items, ITEMS), **how) == want


def test_empty(spark, make_docs):
    some = spark.createDataFrame([(1, "a", None, None)], ITEMS)
    assert not found_by(make_docs([]), some)
    assert not found_by(make_docs(["a"]), some.limit(0))
    assert not found_by(make_docs([None, ""]), some)


def test_terms_over_pieces(monkeypatch):
    monkeypatch.setattr(lexical_search, "_CHUNK", 5)
    text = "Aé-bcdefghijkl  m__nopqrs9 ü"
    assert [t.decode() for part in lexical_search.terms_of(text.encode()) for t in part] == split(text)


def test_owners_take_shares_of_postings():
    df = np.array([1000, 1, 2, 0, 500, 30, 40, 3])
    owner = lexical_search.owners(df)
    assert owner[0] == 2 and owner[1] == owner[2] == owner[3] == 0
    assert (np.diff(owner[np.argsort(df, kind="stable")]) >= 0).all()
