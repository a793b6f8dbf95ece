"""Removal of repeated passages against a brute-force version over all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from emberframe.llm import suffix_dedup
from emberframe.llm.queries import QUERIES

LENGTH = suffix_dedup.LENGTH


def brute_repeats(docs):
    texts = [(key, (text or "").encode()) for key, text in docs]
    seen = Counter(t[i : i + LENGTH] for _, t in texts for i in range(len(t) - LENGTH + 1))
    out = Counter()
    for key, t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - LENGTH + 1):
            if seen[t[i : i + LENGTH]] > 1:
                gone[i : i + LENGTH] = True
        kept = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        out[key, len(t), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()] += 1
    return out


def found(docs):
    rows = suffix_dedup.remove_repeats(docs).collect()
    return Counter((r["id"], r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows)


def pairs(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def test_odd_rows(make_docs, odd_texts):
    docs = make_docs([t if not isinstance(t, str) or len(t) < 9_000 else t[:9_000] for t in odd_texts])
    assert found(docs) == brute_repeats(pairs(docs))
    assert not found(make_docs([]))
    assert not found(make_docs([]).limit(0))


@pytest.mark.parametrize("seed", range(4))
def test_edited_copies(make_docs, seed):
    rng = random.Random(seed)
    letters = ["ab", "abcdefghij ", "a"][seed % 3]

    def text(n):
        return "".join(rng.choices(letters if letters != "a" else "abcdefgh ", k=n))

    passage, shared = text(430), text(199)
    texts = [text(rng.randint(0, 900)) for _ in range(30)]
    for _ in range(40):
        a, b = rng.choice(texts), rng.choice(texts)
        at = rng.randint(0, len(a))
        cut = sorted(rng.randint(0, len(b)) for _ in range(2))
        piece = rng.choice([b[cut[0] : cut[1]], passage, passage[rng.randint(0, 200) :], shared, shared + "x", "z" * 260, "yx" * 150, "ü" * 120])
        texts.append(a[:at] + piece + a[at:])
    texts += [texts[3], texts[3] + "tail", "z" * 201, "z" * 200, "é" * 100, "é" * 100, passage[:199], passage[1:201]]
    docs = make_docs(texts)
    assert found(docs) == brute_repeats(pairs(docs))


def test_long_texts(make_docs, monkeypatch):
    """A passage across the pieces in which a long text is scanned; the rest is incompressible."""
    rng = random.Random(1)
    body = "".join(rng.choices("0123456789abcdefghijklmnopqrstuvwxyz", k=(1 << 18) * 2 + 5_000))
    edge = 1 << 18
    passages = [body[edge - 300 : edge + 50], body[edge - 10 : edge + 400], body[2 * edge + 100 : 2 * edge + 320], body[50:249]]
    docs = make_docs([body, *passages])
    got = {r["id"]: r for r in suffix_dedup.remove_repeats(docs).collect()}
    assert [got[i].n_removed for i in (1, 2, 3, 4)] == [350, 410, 220, 0]
    assert got[0].n_removed == 700 + 220 and got[0].n_spans == 2
    kept = body[: edge - 300] + body[edge + 400 : 2 * edge + 100] + body[2 * edge + 320 :]
    assert got[0].kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()


def test_kept_bytes(make_docs):
    rng = random.Random(2)
    texts = ["".join(rng.choices("abcdef ", k=700)) for _ in range(4)]
    texts += [texts[0][100:400] + "own", texts[1], None]
    rows = suffix_dedup.remove_repeats(make_docs(texts), with_text=True).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and len(r.kept) == r.n_bytes - r.n_removed


def test_query_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = QUERIES["op11_suffix_dedup"](spark, sf_dir).collect()
    assert Counter(map(tuple, rows)) == brute_repeats(pairs(docs))
    assert sum(r.n_removed > 0 for r in rows) > 0


def test_samples_depend_on_the_window_alone():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 100, 5_000).astype(np.uint8).tobytes()
    whole = {}
    for *_, place, first, last, _ in suffix_dedup._sampled([("k", data)]):
        for x, a, b in zip(place, first, last, strict=True):
            whole.update({int(i): int(x) for i in range(a, b + 1)})
    assert sorted(whole) == list(range(5_000 - LENGTH + 1))
    for start in (0, 17, 1_234):
        for *_, place, first, last, _ in suffix_dedup._sampled([("k", data[start : start + 700])]):
            assert all(whole[start + i] == start + x for x, a, b in zip(place, first, last, strict=True) for i in range(a, b + 1))


def test_common_passage_is_counted_by_partial_sums(make_docs):
    """One passage in every text: its rows are aggregated before the shuffle, and removed everywhere."""
    rng = random.Random(4)
    passage = "".join(rng.choices("abcdefgh", k=260))
    docs = make_docs([f"{i:05d}" + passage + "".join(rng.choices("xyz", k=50)) for i in range(400)])
    want = brute_repeats(pairs(docs))
    assert found(docs) == want and all(removed >= 260 for _, _, removed, _, _ in want)
