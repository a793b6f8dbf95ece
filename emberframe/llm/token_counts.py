"""Token counts of unigram segmentation, with forward scores shared between prefixes.

Every white-space word becomes a pre-token (a word-start mark and the word).
The best segmentation of a pre-token into vocabulary pieces maximises the sum of
the pieces' scores.  Distinct pre-tokens of a task are inserted into a trie; the
best score of a trie node is the best score of that prefix, computed once when
the node is made and shared by all pre-tokens that run through it.  A terminal
node stores the number of pieces.  A document's count is the sum over its
pre-tokens.

Each task keeps its own trie, so nothing shuffles and a hot word costs one walk
per task.  A node's score comes from the pieces that end there, found by walking a
trie of the reversed pieces to the first missing edge.  The trie is begun anew
when it reaches ``max_nodes``; results of words are kept for one more generation,
so that frequent words are not computed again.  Nodes end at ``_DEEPEST``
characters: the rest of a longer word is scored with a sliding window.  Memory is
bounded, and results do not depend on it.

Scores: the vocabulary is public and not trained here.  Its pieces come in rank
order, and a piece of rank r (from 0) scores -ln(r + 2) (Zipf's law without its
constant).  A character that is no piece costs one piece per UTF-8 byte, each
scored like a piece after the last one.  Between equal scores fewer pieces win.

Defined results: a null or empty text has no pre-tokens, no tokens and score 0;
repeated rows are counted one by one alike; an empty table gives an empty
result; further columns are not read.  A very long word takes time by its
length and memory for the longest piece.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache
from math import log

from pyspark.sql import DataFrame

from emberframe.llm.common import map_rows, text_table

WORD_START = "▁"


_DEEPEST = 256  # characters of a word that have nodes


@lru_cache(maxsize=2)
def vocabulary(model_file: str) -> tuple[dict[str, float], float, int]:
    """Scores by piece, the score of a fallback byte, and the length of the longest piece."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    scores: dict[str, float] = {}
    for i in range(model.vocab_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
            scores.setdefault(model.id_to_piece(i), -log(len(scores) + 2))
    return scores, -log(len(scores) + 2), max(map(len, scores))


class PrefixTrie:
    """Nodes are numbers; ``edges`` maps node * 2^21 + character to the next one."""

    def __init__(self, scores: dict[str, float], byte_score: float, longest: int, max_nodes: int = 800_000):
        self.scores, self.byte_score, self.longest, self.max_nodes = scores, byte_score, longest, max_nodes
        self.reversed: dict = {}  # characters from a piece's end to its start, then "" and the score
        for piece, score in scores.items():
            state = self.reversed
            for char in reversed(piece):
                state = state.setdefault(char, {})
            state[""] = score
        self.words: dict[str, tuple[float, int]] = {}
        self.clear()

    def clear(self) -> None:
        self.edges: dict[int, int] = {}
        self.best: list[tuple[float, int]] = [(0.0, 0)]  # of the prefix: (score, minus pieces)
        self.earlier, self.words = self.words, {}

    def count(self, word: str) -> tuple[float, int]:
        """(score, pieces) of a white-space word."""
        found = self.words.get(word)
        if found is None:
            found = self.earlier.get(word) or self.insert(WORD_START + word)
            if len(word) < _DEEPEST:
                if len(self.words) > self.max_nodes:
                    self.clear()
                self.words[word] = found
        return found

    def insert(self, word: str) -> tuple[float, int]:
        """(score, pieces) of a pre-token; nodes that are there already are not computed again."""
        if len(self.best) > self.max_nodes:
            self.clear()
        edges, best, node, path = self.edges, self.best, 0, [0]
        for char in word[:_DEEPEST]:
            key = node << 21 | ord(char)
            child = edges.get(key)
            if child is None:
                edges[key] = child = len(best)
                best.append(self._forward(word, path, best))
            node = child
            path.append(node)
        score, negative = best[node]
        if len(word) > _DEEPEST:
            last = [best[n] for n in path[-self.longest :]]
            for end in range(_DEEPEST, len(word)):
                last.append(self._forward(word[end + 1 - self.longest : end + 1], range(len(last)), last))
                if len(last) > 64 * self.longest:
                    del last[: -self.longest]
            score, negative = last[-1]
        return score, -negative

    def _forward(self, word: str, path: Sequence[int], best: list[tuple[float, int]]) -> tuple[float, int]:
        """The best score behind the character that follows the ``path`` of prefixes; ``word`` ends there or goes on if the path has all prefixes."""
        end = min(len(path), len(word))
        state, found = self.reversed, None
        for back in range(1, end + 1):
            state = state.get(word[end - back])
            if state is None:
                break
            piece = state.get("")
            if piece is not None:
                before, count = best[path[-back]]
                here = before + piece, count - 1
                if found is None or here > found:
                    found = here
        char = word[end - 1]
        if char not in self.scores:
            before, count = best[path[-1]]
            n = len(char.encode("utf-8", "surrogatepass"))
            here = before + n * self.byte_score, count - n
            if found is None or here > found:
                found = here
        assert found is not None
        return found


def count_tokens(
    docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", max_nodes: int = 800_000
) -> DataFrame:
    """(id, n_pretokens, n_tokens, score) of every row."""

    def rows(texts: Iterator[tuple]) -> Iterable[tuple]:
        trie = PrefixTrie(*vocabulary(model_file), max_nodes)
        for key, text in texts:
            words = text.split()
            total, n = 0.0, 0
            for word in words:
                score, pieces = trie.count(word)
                total += score
                n += pieces
            yield key, len(words), n, total

    docs = text_table(docs, id_col, text_col)
    kind = dict(docs.dtypes)["id"]
    return map_rows(docs, rows, f"id {kind}, n_pretokens bigint, n_tokens bigint, score double")
