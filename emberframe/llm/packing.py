"""Best-fit packing improved by swap-based local search.

1. Every task tokenizes its texts and cuts them into pieces.  Only numbers go on
   (id, piece, start, length, checksum), never the tokens.
2. Pieces are dealt evenly, by counter and not by key, to groups of at most
   about ``group_size`` pieces.  Each group is packed on its own: best fit in
   decreasing order, then local search between underfull sequences until the
   number of sequences reaches a lower bound or no step is left.
3. The pieces of sequences that stayed emptier than ``settled`` are dealt anew
   to fewer groups and packed again, until they fit one group or a round no
   longer saves a sequence.  Every group leaves about one such sequence, so a
   round is a small part of the one before.

A step of the local search takes an underfull donor, emptiest first, and moves a
piece, or exchanges one for one, two for one or one for two, with the other
sequence of the group for which the sum of squared fills grows most; pieces are
told apart by length alone.  The sum
grows with each step and is bounded, so the search ends; donors run empty.

Tokenization results are written to the shared folder first: groups come from
stored counters, so a repeated task deals alike.

Defined results: a null or empty text is one piece with only the end id; repeated
rows are packed one by one; an empty table gives an empty result; very long
texts become many pieces; further columns are not read.  Strings of the
tokenizer's added tokens inside a text become their ids.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberframe.llm.common import map_rows, stash, text_table
from emberframe.session import ship_package

END_ID = 0


@lru_cache(maxsize=2)
def encoder(tokenizer_file: str) -> Callable[[str], list[int]]:
    """Byte-level BPE of a ``tokenizer.json``, run by the faster of two libraries that give equal ids."""
    import json
    from pathlib import Path

    import public_tokenizers
    import tiktoken

    # Byte-level vocabularies write printable bytes as themselves and number the others from U+0100.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(others)}
    spec = json.loads(Path(tokenizer_file).read_text(encoding="utf-8"))
    added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(byte_of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in added}
    ordinary = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    cut = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True))) or "(?!)")

    def encode(text: str) -> list[int]:
        ids, at = [], 0
        for found in cut.finditer(text):  # the text between added tokens is encoded on its own
            ids += [*ordinary(text[at : found.start()]), added[found[0]]]
            at = found.end()
        return ids + ordinary(text[at:]) if at else ordinary(text)

    return encode


def cut_lengths(n: int, capacity: int) -> list[int]:
    """Piece lengths of a document of ``n`` ids: full ones, the first takes the rest."""
    rest = n % capacity
    return ([rest] if rest else []) + [capacity] * (n // capacity)


def token_pieces(
    docs: DataFrame, tokenizer_file: str, capacity: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, piece, start, length, ids_crc32, deal): the pieces, and a counter to deal them by."""

    def rows(texts: Iterator[tuple]) -> Iterable[tuple]:
        encode = encoder(tokenizer_file)
        deal = TaskContext.get().partitionId() * 7919
        for key, text in texts:
            ids = array("I", encode(text))
            ids.append(END_ID)
            start = 0
            for piece, length in enumerate(cut_lengths(len(ids), capacity)):
                yield key, piece, start, length, zlib.crc32(ids[start:start + length].tobytes()), deal
                start += length
                deal += 1

    docs = text_table(docs, id_col, text_col)
    kind = dict(docs.dtypes)["id"]
    return map_rows(docs, rows, f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, deal bigint")


def least_bins(lengths: np.ndarray, capacity: int) -> int:
    """A lower bound: for a size s, pieces over capacity - s stand alone, those over half need a bin each,
    and what is at least s and fits nowhere beside them takes its volume."""
    counts = np.bincount(lengths, minlength=capacity + 1)[: capacity + 1]
    number, volume = np.cumsum(counts), np.cumsum(counts * np.arange(capacity + 1))
    half, best = capacity // 2, -(-int(volume[-1]) // capacity)
    s = np.arange(half + 1)
    alone = number[-1] - number[capacity - s]
    paired = number[capacity - s] - number[half]
    paired_volume = volume[capacity - s] - volume[half]
    small = volume[half] - np.where(s > 0, volume[s - 1], 0)
    more = np.maximum(0, -(-(small - (paired * capacity - paired_volume)) // capacity))
    return max(best, int((alone + paired + more).max()))


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of positions: longest first, each into the fullest bin that has room."""
    bins: list[list[int]] = []
    by_space: dict[int, list[int]] = {}
    open_spaces = 0  # bit s: a bin with s free
    for at in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[at])
        room = open_spaces >> size
        if room:
            space = size + (room & -room).bit_length() - 1
            target = by_space[space].pop()
            if not by_space[space]:
                open_spaces &= ~(1 << space)
            bins[target].append(at)
        else:
            space, target = capacity, len(bins)
            bins.append([at])
        left = space - size
        if left:
            by_space.setdefault(left, []).append(target)
            open_spaces |= 1 << left
    return bins


class _Parts:
    """What the bins can take out: nothing, a piece, or two pieces; each sum of lengths once per bin.

    Entries of all bins lie in common arrays.  A bin that changes gets new ones at
    the end; its old ones become so large that nothing can be exchanged for them.
    """

    GONE = 1 << 40

    def __init__(self, bins: list[list[int]], lengths: np.ndarray, capacity: int):
        self.bins, self.lengths, self.capacity = bins, lengths, capacity
        self._fill_up()

    def of(self, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sum, first, second) of bin ``b``; a length of 0 stands for no piece."""
        own, times = np.unique(self.lengths[self.bins[b]], return_counts=True)
        i, j = np.triu_indices(len(own))
        real = (i < j) | (times[i] > 1)
        first, second = own[i[real]], own[j[real]]
        both, at = np.unique(first + second, return_index=True)
        zero = np.zeros(1, np.int64)
        return (np.concatenate((zero, own, both)), np.concatenate((zero, own, first[at])),
                np.concatenate((zero, np.zeros(len(own), np.int64), second[at])))

    def _fill_up(self) -> None:
        parts = [self.of(b) for b in range(len(self.bins))]
        sizes = [len(p[0]) for p in parts]
        self.n = sum(sizes)
        ends = np.cumsum(sizes)
        self.place = [(e - k, e) for e, k in zip(ends.tolist(), sizes, strict=True)]
        room = np.zeros(self.n + 64, np.int64)
        self.total, self.first, self.second = (
            np.concatenate([*(p[k] for p in parts), room]) for k in range(3))
        self.total[self.n :] = self.GONE
        self.owner = np.concatenate([np.repeat(np.arange(len(parts)), sizes), room])

    def renew(self, b: int) -> None:
        start, end = self.place[b]
        self.total[start:end] = self.GONE
        total, first, second = self.of(b)
        start, end = self.n, self.n + len(total)
        if end > len(self.total):
            self._fill_up()
            return
        self.total[start:end], self.first[start:end], self.second[start:end], self.owner[start:end] = total, first, second, b
        self.place[b], self.n = (start, end), end


def local_search(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Improve ``bins`` by moves and exchanges that raise the sum of squared fills; drop empty bins.

    Pieces are told apart by length only, so that a bin has at most ``capacity`` sums to
    exchange, whatever its number of pieces.  A donor takes its best steps until it
    has none left or is empty; donors are visited emptiest first, again and again until a
    round brings no step.
    """
    bound = least_bins(lengths, capacity)
    if len(bins) <= bound:
        return bins
    fill = np.array([int(lengths[m].sum()) for m in bins], np.int64)
    alive, parts = len(bins), _Parts(bins, lengths, capacity)

    def best_step(donor: int) -> tuple | None:
        start, end = parts.place[donor]
        given, second = parts.total[start:end], parts.second[start:end]
        n = parts.n
        total, owner = parts.total[:n], parts.owner[:n]
        base = fill[owner] - fill[donor]
        room = capacity - fill[owner]
        room[(owner == donor) | (fill[owner] == 0)] = 0
        single = (parts.first[:n] > 0) & (parts.second[:n] == 0)
        found, step = 0, None
        for rows, columns in (((given > 0) & (second == 0), None), (second > 0, np.flatnonzero(single))):
            rows = np.flatnonzero(rows)
            if not len(rows):
                continue
            t, base_t, room_t = (total, base, room) if columns is None else (total[columns], base[columns], room[columns])
            grown = given[rows][:, None] - t[None, :]
            gain = np.where((grown > 0) & (grown <= room_t), grown * (base_t + grown), 0)
            at = int(gain.argmax())
            row, column = divmod(at, gain.shape[1])
            if gain[row, column] > found:
                found = int(gain[row, column])
                step = start + int(rows[row]), column if columns is None else int(columns[column])
        return step

    def moved(from_: int, to: int, entry: int) -> list[tuple[int, int, int]]:
        out, left = [], list(bins[from_])
        for size in (int(parts.first[entry]), int(parts.second[entry])):
            if size:
                piece = next(i for i in left if lengths[i] == size)
                left.remove(piece)
                out.append((piece, from_, to))
        return out

    changed = True
    while changed and alive > bound:
        changed = False
        for donor in sorted((b for b in range(len(bins)) if 0 < fill[b] < capacity), key=lambda b: fill[b]):
            while alive > bound and bins[donor] and (step := best_step(donor)) is not None:
                target = int(parts.owner[step[1]])
                for piece, from_, to in moved(donor, target, step[0]) + moved(target, donor, step[1]):
                    bins[from_].remove(piece)
                    bins[to].append(piece)
                    fill[from_] -= lengths[piece]
                    fill[to] += lengths[piece]
                alive -= not bins[donor]
                parts.renew(donor)
                parts.renew(target)
                changed = True
    return [b for b in bins if b]


def pack_lengths(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    return local_search(best_fit(lengths, capacity), lengths, capacity)


_PACKED = "id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, deal bigint, sequence_id bigint, offset bigint, fill bigint"


def _pack_groups(pieces: DataFrame, groups: int, capacity: int, round_no: int) -> DataFrame:
    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["deal", "piece"], kind="stable").reset_index(drop=True)
        lengths = group["length"].to_numpy(np.int64)
        sequence, offset, fill = (np.empty(len(group), np.int64) for _ in range(3))
        # Numbers of a round, a group and a bin; a group has at most 2^22 pieces.
        first = (round_no << 58) | (int(group["group"].iloc[0]) << 22)
        for n, members in enumerate(pack_lengths(lengths, capacity)):
            sizes = lengths[members]
            sequence[members], fill[members] = first + n, sizes.sum()
            offset[members] = np.cumsum(sizes) - sizes
        return group.drop(columns=["group"]).assign(sequence_id=sequence, offset=offset, fill=fill)

    kind = dict(pieces.dtypes)["id"]
    dealt = pieces.select("id", "piece", "start", "length", "ids_crc32", "deal",
                          F.pmod("deal", F.lit(groups)).cast("bigint").alias("group"))
    # A stated number of partitions: the search costs time by pieces, not by bytes.
    parts = min(groups, 4 * int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return dealt.repartition(parts, "group").groupBy("group").applyInPandas(pack, _PACKED.format(kind=kind))


def pack_documents(
    docs: DataFrame, tokenizer_file: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text",
    group_size: int = 4096, settled: float = 0.9, rounds: int = 8,
) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) of every piece; see above for the steps.

    ``rounds`` bounds the number of re-packing passes, not the pieces packed: all are packed after the first one.
    """
    ship_package(docs.sparkSession)
    rest = stash(token_pieces(docs, tokenizer_file, capacity, id_col, text_col), "pieces")
    columns = [c for c in rest.columns if c != "deal"] + ["sequence_id", "offset"]
    n, before, done = rest.count(), None, []
    for round_no in range(rounds):
        groups = max(1, -(-n // group_size))
        packed = stash(_pack_groups(rest, groups, capacity, round_no), f"packed-{round_no}")
        loose = F.col("fill") < settled * capacity
        first = F.col("offset") == 0
        n, after, emptier = packed.agg(
            F.count_if(loose), F.count_if(first), F.count_if(first & loose)).first()
        if groups == 1 or not n or (before is not None and after >= before) or round_no == rounds - 1:
            done.append(packed)
            break
        done.append(packed.where(~loose))
        rest, before = packed.where(loose), emptier
    return reduce(DataFrame.unionAll, [part.select(*columns) for part in done])
