"""The prefix trie against a brute-force version, on shards of one row too."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from emberframe.llm import prefix_trie

TURNS = "conv_id bigint, turn bigint, role string, text string, id string, depth int"


def brute_trie(sequences):
    """sequences: id to list of (role, text)."""
    members, ends = defaultdict(list), defaultdict(list)
    for key, seq in sequences.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(key)
        ends[tuple(seq)].append(key)
    rows = set()
    for node, own in members.items():
        below = [p for p in members if p[: len(node)] == node]
        children = [p for p in below if len(p) == len(node) + 1]
        leaves = [p for p in below if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in below)]
        saved = sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        sha = hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest()
        rows.add((min(own), len(node), min(members[node[:-1]]) if node else None, len(own), len(children), len(leaves), saved, sha))
    return rows


def rebuilt(turns, group=5, heads=9):
    seqs = defaultdict(list)
    for key, turn, role, text, *_ in turns:
        if key is not None:
            digest = hashlib.md5(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest()
            seqs[key].append(((turn is not None, turn or 0), digest, (role or "", text or "")))
    seqs = {k: [t[2] for t in sorted(v)] for k, v in seqs.items()}
    out = {}
    for key, seq in seqs.items():
        h = zlib.crc32(str(key).encode()) % heads
        out[key] = seqs.get(key - key % group, [])[:h] + seq[h:]
    return out


def as_set(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def trie_of(spark, turns, **how):
    df = spark.createDataFrame(turns, TURNS)
    return as_set(prefix_trie.prefix_trie(prefix_trie.share_heads(prefix_trie.turn_sequences(df)), **how))


def test_odd_rows(spark):
    turns = [(k, t, "user", "same start", "x", 1) for k in range(40) for t in (0,)]
    turns += [(k, 1 + t, ["user", None][t % 2], random.Random(k % 3 * 100 + t).choice(["a", "b", None, "", "ü" * 5]), None, None)
              for k in range(40) for t in range(k % 7)]
    turns += [(None, 0, "user", "nobody", None, None), (50, None, None, None, None, None), (50, None, None, None, None, None),
              (50, 3, "user", "tie"), (50, 3, "user", "eit"), (51, 2, "bot", "x" * 100_000), (52, 0, "u", "own"), (101, 0, "u", "no base")]
    turns += [(60, t, "u", f"turn {t % 90}", None, None) for t in range(200)] + [(65, t, "u", f"turn {t % 90}", None, None) for t in range(210)]
    turns = [(*t, None, None)[:6] for t in turns]
    want = brute_trie(rebuilt(turns))
    assert trie_of(spark, turns) == want
    assert trie_of(spark, turns, shard_turns=2) == want


@pytest.mark.parametrize("seed", range(3))
def test_random_sequences(spark, seed):
    rng = random.Random(seed)
    turns = [(k, t, "r", rng.choice("aab"), None, None) for k in range(60) for t in range(rng.choice([1, 2, 3, 3, 70]))]
    assert trie_of(spark, turns, shard_turns=rng.choice([5, 300, 10_000])) == brute_trie(rebuilt(turns))


def test_copies_over_shards(spark):
    """Copies of one conversation span shards; their ids are digested in order."""
    turns = [(5 * k, t, "r", f"{t}", None, None) for k in range(300) for t in range(3)] + [(7, 0, "r", "0", None, None)]
    assert trie_of(spark, turns, shard_turns=20) == brute_trie(rebuilt(turns))


def test_empty(spark):
    assert trie_of(spark, []) == set()
    assert trie_of(spark, [(None, 1, "a", "b", None, None)]) == set()
