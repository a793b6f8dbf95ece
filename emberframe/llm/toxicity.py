"""Toxicity by multiple-instance learning: sentences score, documents are labelled.

A sentence has probability p = sigmoid(b + sum of its words' weights); a document
is toxic if any sentence is: 1 - prod(1 - p) (noisy-or).  Weights are trained on
document labels by gradient descent through the noisy-or, so that the model has
to find the sentences by itself; ``sentence_scores`` returns them with spans.

Training takes at most ``max_rows`` labelled documents of at most ``max_bytes``
each, those with the smallest key hashes: a bounded sample, read by the driver.
The vocabulary is the ``max_words`` features of the sample with the strongest
association with either label.  Scoring reads every text whole, in one pass
without a shuffle; the model that tasks get has at most ``max_words`` numbers.

Sentences end at ``.``, ``!``, ``?`` or a line feed.  Words are runs of letters
in lower case; features are the distinct words of a sentence with their first
four and five letters, which catch inflected forms.  Labels, language, source and key are never inputs of a score.

Defined results: a null or empty text, or one without words, has no sentence and
scores 0; repeated rows score alike; an empty table gives an empty result; a
training sample without both labels gives a model that scores every text 0;
``keep_clean`` keeps every column of its input.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from math import exp, log1p

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberframe.llm.common import map_rows, text_table
from emberframe.session import ship_package

_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"[^\W\d_]+")
THRESHOLD = 0.7


def features(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in (4, 5) if len(word) >= n)]


class _WordWeights(dict):
    """Sum of a word's feature weights, kept by word; emptied when it grows large."""

    def __init__(self, weights: dict[str, float], most: int = 300_000):
        super().__init__()
        self.weights, self.most = weights, most

    def __missing__(self, word: str) -> float:
        if len(self) >= self.most:
            self.clear()
        self[word] = total = sum(self.weights.get(f, 0.0) for f in features(word))
        return total


@dataclass
class Model:
    bias: float = -100.0
    weights: dict[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self._words = _WordWeights(self.weights)

    def __reduce__(self):
        return Model, (self.bias, self.weights)

    def sentence_logits(self, text: str) -> Iterator[tuple[int, int, float]]:
        """(start, end, logit) of the sentences that hold a word."""
        weigh = self._words.__getitem__
        for m in _SENTENCE.finditer(text):
            words = set(_WORD.findall(m[0].lower()))
            if words:
                yield m.start(), m.end(), self.bias + sum(map(weigh, sorted(words)))

    def score(self, text: str) -> float:
        clean = -sum(_softplus(x) for _, _, x in self.sentence_logits(text))
        return min(1.0, max(0.0, 1.0 - exp(clean)))


def _softplus(x: float) -> float:
    return max(x, 0.0) + log1p(exp(-abs(x)))


def choose_words(texts: list[str], labels: np.ndarray, max_words: int, least_docs: int = 3) -> list[str]:
    """Features by their G-test against the labels, strongest first."""
    by_label = (Counter(), Counter())
    for text, label in zip(texts, labels, strict=True):
        by_label[int(label)].update({f for w in set(_WORD.findall(text.lower())) for f in features(w)})
    words = [w for w in by_label[0].keys() | by_label[1].keys() if by_label[0][w] + by_label[1][w] >= least_docs]
    n = np.array([np.sum(labels == 0), np.sum(labels == 1)], float)
    seen = np.array([[by_label[0][w], by_label[1][w]] for w in words], float).reshape(-1, 2)
    cells = np.stack([seen, n - seen], axis=2)
    expected = cells.sum(axis=1, keepdims=True) * (n / n.sum())[None, :, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        strength = np.nansum(cells * np.log(cells / expected), axis=(1, 2))
    order = sorted(range(len(words)), key=lambda i: (-strength[i], words[i]))
    return [words[i] for i in order[:max_words]]


def fit(texts: list[str], labels: list[int], max_words: int = 2000, steps: int = 250, rate: float = 0.1, l2: float = 0.004) -> Model:
    """Noisy-or logistic regression by Adam; needs both labels, else the model that finds nothing."""
    y = np.asarray(labels)
    if len(set(labels) & {0, 1}) < 2:
        return Model()
    words = choose_words(texts, y, max_words)
    column = {w: i for i, w in enumerate(words)}
    doc_of, sentence_of, word_of = [], [], []
    for d, text in enumerate(texts):
        for m in _SENTENCE.finditer(text):
            found = set(_WORD.findall(m[0].lower()))
            if found:
                here = [column[f] for w in sorted(found) for f in features(w) if f in column]
                sentence_of += [len(doc_of)] * len(here)
                word_of += here
                doc_of.append(d)
    docs, sents, cols = (np.array(x, np.int64) for x in (doc_of, sentence_of, word_of))
    w, b = np.zeros(len(words)), -6.0
    moments, n = np.zeros((2, len(words) + 1)), len(texts)
    for step in range(1, steps + 1):
        logit = b + np.bincount(sents, weights=w[cols], minlength=len(docs))
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        clean = -np.bincount(docs, weights=np.logaddexp(0, logit), minlength=n)  # log of prod(1 - p)
        toxic = np.clip(-np.expm1(clean), 1e-9, 1.0)
        # d loss / d clean: labelled clean 1, labelled toxic -(1 - toxic) / toxic; d clean / d logit = -p
        slope = np.where(y == 1, np.exp(clean) / toxic, -1.0)
        g_logit = -slope[docs] * p / n
        g = np.append(np.bincount(cols, weights=g_logit[sents], minlength=len(words)) + l2 * w / n, g_logit.sum())
        moments[0] = 0.9 * moments[0] + 0.1 * g
        moments[1] = 0.99 * moments[1] + 0.01 * g * g
        change = rate * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.99**step)) + 1e-9)
        w, b = w - change[:-1], b - change[-1]
    return Model(float(b), {word: float(x) for word, x in zip(words, w, strict=True)})


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    max_rows: int = 6000, max_bytes: int = 20_000, max_words: int = 2000,
) -> Model:
    """Fit on the labelled rows of ``docs``; rows of ``labels`` without a 0 or 1 are left out.

    A key labelled more than once counts as toxic if any of its labels does.
    """
    return fit(*labelled_sample(docs, labels, id_col, text_col, label_col, max_rows, max_bytes), max_words)


def labelled_sample(docs, labels, id_col, text_col, label_col, max_rows, max_bytes) -> tuple[list[str], list[int]]:
    """At most ``max_rows`` texts of at most ``max_bytes`` with their labels.

    Keys are chosen before any text moves; then their rows are read by a
    broadcast of at most ``max_rows`` keys.
    """
    marks = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(f"`{id_col}`").alias("id")).agg(
        F.max(label_col).cast("int").alias("label"))
    texts = text_table(docs, id_col, text_col).where(F.octet_length("text") <= max_bytes)
    chosen = texts.select("id").distinct().join(marks, "id").orderBy(F.xxhash64("id"), "id").limit(max_rows)
    rows = texts.join(F.broadcast(chosen), "id").orderBy(F.xxhash64("id"), "id", F.xxhash64("text")).limit(max_rows)
    sample = rows.select("text", "label").toArrow()
    return sample["text"].to_pylist(), sample["label"].to_pylist()


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, n_offending, worst_start, worst_end, worst_score): the span is null without sentences."""
    docs = text_table(docs, id_col, text_col)

    def rows(texts: Iterator[tuple]) -> Iterable[tuple]:
        for key, text in texts:
            clean, offending, worst = 0.0, 0, None
            for start, end, logit in model.sentence_logits(text):
                clean += _softplus(logit)
                offending += logit > 0
                if worst is None or logit > worst[2]:
                    worst = start, end, logit
            start, end, logit = worst or (None, None, None)
            yield (key, min(1.0, max(0.0, 1.0 - exp(-clean))), offending, start, end,
                   None if logit is None else exp(-_softplus(-logit)))

    kind = dict(docs.dtypes)["id"]
    return map_rows(docs, rows, f"id {kind}, score double, n_offending bigint, worst_start bigint, worst_end bigint, worst_score double")


def sentence_scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """(id, start, end, score, sentence) of every sentence of at least that score."""
    docs = text_table(docs, id_col, text_col)

    def rows(texts: Iterator[tuple]) -> Iterable[tuple]:
        for key, text in texts:
            for start, end, logit in model.sentence_logits(text):
                if (p := exp(-_softplus(-logit))) >= least:
                    yield key, start, end, p, text[start:end]

    return map_rows(docs, rows, f"id {dict(docs.dtypes)['id']}, start bigint, end bigint, score double, sentence string")


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows that score below ``threshold``, unchanged."""
    ship_package(docs.sparkSession)

    @F.pandas_udf("double")
    def score(texts):
        return texts.map(lambda t: model.score(t or ""))

    return docs.where(score(F.col(f"`{text_col}`")) < threshold)
