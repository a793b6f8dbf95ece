"""Mixing sources to target weights with soft domain membership.

1. A softmax classifier over hashed byte pairs is trained on labelled documents
   (a bounded sample: ``max_rows`` rows of at most ``max_bytes``) and predicts
   the probability p[d, k] that document d belongs to domain k.
2. With t[d] tokens (white-space words) in document d, nonnegative rates r[d]
   shall bring the expected domain totals S[k] = sum of t r p[., k] to targets
   T[k]: least squares of (S - T) / sqrt(C), where C are the totals at rate 1.
   Projected gradient in the tokens' metric has the step
   ``r = max(0, r - sum over k of p[d, k] (S[k] - T[k]) / C[k])``; its largest
   eigenvalue is 1, so that a full step never overshoots.  An iteration is one
   aggregation of K sums over the stored probabilities; rates are written every
   few iterations, so expressions stay short.  ``residual`` measures how far the
   shares reached are from the targets.
3. A rate becomes floor(rate + u) copies, u being a hash of the key in [0, 1):
   the expected number of copies is the rate.

The fitted steps are a few numbers per iteration, so ``mixed`` computes rates
again from the text, in one pass over the documents without a join.

Defined results: a null or empty text has no tokens, does not count for the
totals and gets the rate of the classifier's prior; rows repeated with one key
get equal copies; an empty table gives an empty result; a target domain without
labelled documents or without tokens is left out, and the others' weights are
scaled to 1; rows with a null label or domain do not train.  ``mixed`` keeps
every column of its input.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberframe.llm.common import map_rows, stash, text_table
from emberframe.session import ship_package

_BUCKETS = 2048
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def byte_pairs(text: str) -> tuple[np.ndarray, int]:
    """Square roots of the hashed byte pairs' shares, and the number of words."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if not len(data):
        return np.zeros(_BUCKETS), 0
    blank = _SPACE[data]
    words = int(np.count_nonzero(blank[:-1] & ~blank[1:])) + int(not blank[0])
    pair = (data[:-1].astype(np.int64) * 263 + data[1:]) % _BUCKETS
    return np.sqrt(np.bincount(pair, minlength=_BUCKETS) / max(1, len(pair))), words


@dataclass
class DomainModel:
    domains: list[str]
    weights: np.ndarray  # (buckets + 1, domains); the last row is the bias

    def posterior(self, x: np.ndarray) -> np.ndarray:
        if not self.domains:
            return np.zeros((*x.shape[:-1], 0))
        z = x @ self.weights[:-1] + self.weights[-1]
        e = np.exp(z - z.max(axis=-1, keepdims=True))
        return e / e.sum(axis=-1, keepdims=True)


def fit_domains(texts: list[str], names: list[str], steps: int = 200, rate: float = 0.3, l2: float = 1e-5) -> DomainModel:
    """Softmax regression by Adam on the given texts."""
    domains = sorted(set(names))
    if not domains:
        return DomainModel([], np.zeros((_BUCKETS + 1, 0)))
    x = np.column_stack([np.array([byte_pairs(t)[0] for t in texts]).reshape(len(texts), _BUCKETS), np.ones(len(texts))])
    y = np.array([[n == d for d in domains] for n in names], float)
    w = np.zeros((_BUCKETS + 1, len(domains)))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        p = DomainModel(domains, w).posterior(x[:, :-1])
        g = x.T @ (p - y) / len(texts) + l2 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return DomainModel(domains, w)


def train_domains(
    docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain",
    max_rows: int = 3000, max_bytes: int = 20_000,
) -> DomainModel:
    """Train on rows of ``docs`` whose key is in ``labelled`` (key, domain); the smallest domain wins if a key has several."""
    marks = labelled.where(F.col(domain_col).isNotNull()).groupBy(F.col(f"`{id_col}`").alias("id")).agg(
        F.min(domain_col).alias("domain"))
    texts = text_table(docs, id_col, text_col).where(F.octet_length("text") <= max_bytes)
    chosen = texts.select("id").distinct().join(marks, "id").orderBy(F.xxhash64("id"), "id").limit(max_rows)
    rows = texts.join(F.broadcast(chosen), "id").orderBy(F.xxhash64("id"), "id", F.xxhash64("text")).limit(max_rows)
    sample = rows.select("text", "domain").toArrow()
    return fit_domains(sample["text"].to_pylist(), sample["domain"].to_pylist())


def membership(docs: DataFrame, model: DomainModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tokens, p0, p1, ...) of every row."""
    docs = text_table(docs, id_col, text_col)

    def rows(texts: Iterator[tuple]) -> Iterable[tuple]:
        for key, text in texts:
            x, words = byte_pairs(text)
            yield key, words, *model.posterior(x).tolist()

    columns = "".join(f", p{k} double" for k in range(len(model.domains)))
    return map_rows(docs, rows, f"id {dict(docs.dtypes)['id']}, tokens bigint{columns}")


def _stepped(rate: Column, steps: list[np.ndarray]) -> Column:
    for g in steps:
        change = sum((F.col(f"p{k}") * F.lit(float(x)) for k, x in enumerate(g)), F.lit(0.0))
        rate = F.greatest(F.lit(0.0), rate - change)
    return rate


def _rates(posterior: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    rate = np.ones(len(posterior))
    for g in steps:
        rate = np.maximum(0.0, rate - posterior @ g)
    return rate


def fit_rates(
    members: DataFrame, domains: list[str], weights: Mapping[str, float], total: float | None = None,
    iterations: int = 30, tolerance: float = 1e-4, rewrite_every: int = 6,
) -> tuple[DataFrame, list[np.ndarray]]:
    """``members`` (as stored by the caller) with ``rate``, and the steps that lead to it.

    ``weights`` are the domains' target shares.  ``total`` is the target number
    of tokens; by default the smallest for which no domain has to shrink.
    """
    k = len(domains)
    sums = lambda df, rate: np.array([x or 0.0 for x in df.agg(
        *[F.sum(F.col("tokens") * rate * F.col(f"p{i}")) for i in range(k)]).first()], float)
    base = sums(members, F.lit(1.0)) if k else np.zeros(0)
    share = np.array([weights.get(d, 0.0) for d in domains], float) * (base > 0)
    if not share.sum():
        return members.withColumn("rate", F.lit(1.0)), []
    share /= share.sum()
    if total is None:
        total = float((base[share > 0] / share[share > 0]).max())
    target = share * total
    state, steps, pending, now = members.withColumn("rate", F.lit(1.0)), [], [], base
    for _ in range(iterations):
        if np.abs(now - target).max() <= tolerance * total:
            break
        g = np.where(base > 0, (now - target) / np.where(base > 0, base, 1.0), 0.0)
        steps.append(g)
        pending.append(g)
        if len(pending) > rewrite_every:
            state, pending = stash(state.withColumn("rate", _stepped(F.col("rate"), pending)), "rates"), []
        now = sums(state, _stepped(F.col("rate"), pending))
    return state.withColumn("rate", _stepped(F.col("rate"), pending)), steps


def residual(rated: DataFrame, domains: list[str], weights: Mapping[str, float]) -> float:
    """Largest difference between a domain's share of the rated tokens and its target share; 0 without tokens or targets.

    The steps of ``fit_rates`` end at its tolerance or after its iterations; this tells which.
    """
    if not domains:
        return 0.0
    totals = rated.agg(*[F.sum(F.col("tokens") * x * F.col(f"p{i}")) for x in (F.lit(1.0), F.col("rate")) for i in range(len(domains))]).first()
    base, now = np.array([x or 0.0 for x in totals], float).reshape(2, -1)
    share = np.array([weights.get(d, 0.0) for d in domains], float) * (base > 0)
    if not share.sum() or not now.sum():
        return 0.0
    return float(np.abs(now / now.sum() - share / share.sum()).max())


def copies(key: Column, rate: Column, least: int = 0, seed: int = 17) -> Column:
    """floor(rate + u), u in [0, 1) from the key; at least ``least``."""
    u = F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11).cast("double") * F.lit(2.0 ** -53)
    return F.greatest(F.floor(rate + u).cast("int"), F.lit(least))


def mixed(
    docs: DataFrame, model: DomainModel, steps: list[np.ndarray], id_col: str = "doc_id", text_col: str = "text", least: int = 0
) -> DataFrame:
    """``docs`` with every row as often as its rate says; ``least=1`` keeps every row at least once."""
    ship_package(docs.sparkSession)

    @F.pandas_udf("double")
    def rate(texts):
        import pandas as pd

        return pd.Series([float(_rates(model.posterior(byte_pairs(t or "")[0])[None, :], steps)[0]) for t in texts], dtype=float)

    n = copies(F.col(f"`{id_col}`"), rate(F.col(f"`{text_col}`")) if model.domains else F.lit(1.0), least)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    row = docs.select(F.struct(*[c.alias(name) for c, name in zip(columns, docs.columns, strict=True)]).alias("row"), n.alias("n"))
    many = row.select("row", F.explode(F.array_repeat(F.lit(0), F.col("n"))).alias("copy"))
    return many.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
