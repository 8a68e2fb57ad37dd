"""Runs: maximal stretches of words that repeat with a period, found as maximal pairs.

A run is a stretch of a text's words with smallest period q, at least ``max(min_length, 2 q)`` words long, that cannot be
extended on either side with period q.

1. Words become numbers, a text's own. The suffixes of all texts of a batch are sorted together by doubling
   (vectorised); texts share no numbers, so no repeat crosses a border. The ranks of every doubling are kept, and
   from them come the longest common prefixes (LCP) of neighbours.
2. The LCP-interval tree is walked bottom-up with a stack. An interval of LCP l holds the places where one string of l words
   begins, in *class lists*: lists of places with the same left word, cut so that they stand in text order
   (neighbouring lists have different left words). A child's places are put into the larger side's lists.
3. Two places of different children (different next word) and of different left words are a maximal pair. Its distance p
   and length l make a run if p <= l and p + l >= min_length: the stretch is the pair's own p + l words, and as both
   ends differ nothing has to be extended. Only intervals with 2 l >= min_length matter, so only suffixes whose first
   ceil(min_length / 2) words repeat in their text enter the tree.
4. The pairs of a run at multiples of its period give the same stretch; the least distance is the period.

A run's own pair stands next to each other in the lists of its interval: if a place m stood between i and i + q, the
q + l words from i would have periods q and m - i, hence (Fine and Wilf) a period dividing both, less than q. So a new place is compared
with its two neighbours only, and the walk takes O(n log n) list steps however many occurrences or classes there are.

Defined cases: a null or empty text has no words, no runs and an empty collapsed text; a word is a maximal stretch without
space and U+0009..U+000D; repeated rows get a result each; an empty table gives an empty result; other columns are
carried as they came, unless they have the name of a result column, which replaces them.

Scale: one pass, no shuffle; a text stays in its task. Batches are cut into slices of ``SLICE`` words (one text at least).
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Callable, Iterator, Sequence
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from ledgerlens.llm.common import WORD, small_batches

MIN_LENGTH = 12
SLICE = 1 << 18

RUN = StructType([StructField("start", LongType()), StructField("length", LongType()), StructField("period", LongType())])
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


class ClassLists:
    """Places in text order, in lists of one left word each; ``add`` yields the neighbours with another left word."""

    __slots__ = ("heads", "lists", "size")

    def __init__(self, place: int):
        self.heads, self.lists, self.size = [place], [[place]], 1

    def places(self) -> Iterator[int]:
        return chain.from_iterable(self.lists)

    def add(self, place: int, left: list[int]) -> Iterator[tuple[int, int]]:
        heads, lists, own = self.heads, self.lists, left[place]
        self.size += 1
        at = bisect_right(heads, place)
        before = lists[at - 1] if at else None
        if before and place < before[-1]:
            if left[before[0]] == own:
                insort(before, place)
                return
            # a place of another class cuts the list
            cut = bisect_right(before, place)
            heads.insert(at, before[cut])
            lists.insert(at, before[cut:])
            del before[cut:]
        after = lists[at] if at < len(lists) else None
        same = False
        if before:
            if left[before[-1]] == own:
                before.append(place)
                same = True
            else:
                yield before[-1], place
        if after:
            if left[after[0]] != own:
                yield place, after[0]
            elif not same:
                after.insert(0, place)
                heads[at] = place
                same = True
        if not same:
            heads.insert(at, place)
            lists.insert(at, [place])


def suffix_order(ids: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, lcp): the suffixes whose first ``least`` numbers occur again, in order, and each one's LCP with the one before (0 for the first).

    A rank is the number of suffixes in smaller groups, so groups split in place.
    """
    n = len(ids)

    def regroup(at: np.ndarray, first: np.ndarray, second: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Sort ``at`` by (first, second), set the new ranks, and return those not yet alone, in order."""
        order = np.lexsort((second, first))
        at, first, second = at[order], first[order], second[order]
        new = np.ones(len(at) + 1, dtype=bool)
        old_head = np.ones(len(at), dtype=bool)
        old_head[1:] = first[1:] != first[:-1]
        new[1:-1] = old_head[1:] | (second[1:] != second[:-1])
        spot = np.arange(len(at))
        # place of a group within its old one, counted from the old group's rank
        within = np.maximum.accumulate(np.where(new[:-1], spot, 0)) - np.maximum.accumulate(np.where(old_head, spot, 0))
        rank[at] = first + within
        return at[~(new[:-1] & new[1:])]

    order = np.argsort(ids, kind="stable")
    head = np.ones(n, dtype=bool)
    head[1:] = ids[order][1:] != ids[order][:-1]
    rank = np.full(n + 1, -1, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    tail = np.append(head[1:], True)
    open_, levels, width, first = order[~(head & tail)], [(1, rank)], 1, None
    while True:
        if width >= least and first is None:
            first = open_
        if not len(open_):
            break
        step = min(width, least - width) if width < least else width
        last = rank
        rank = last.copy()
        open_ = regroup(open_, last[open_], last[np.minimum(open_ + step, n)], rank)
        width += step
        levels.append((width, rank))
    if first is None or not len(first):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    places = first[np.argsort(rank[first], kind="stable")]
    a, b = places[:-1], places[1:]
    lcp = np.zeros(len(places), dtype=np.int64)
    for w, r in reversed(levels):
        off = lcp[1:]
        same = r[np.minimum(a + off, n)] == r[np.minimum(b + off, n)]
        lcp[1:] += np.where(same, w, 0)
    return places, lcp


def maximal_pairs(ids: np.ndarray, min_length: int) -> list[tuple[int, int, int]]:
    """(start, length, distance) of the neighbouring maximal pairs whose distance satisfies the length constraints."""
    least = max(1, -(-min_length // 2))
    places, lcps = suffix_order(ids, least)
    if not len(places):
        return []
    word = ids.tolist()
    left, word = [-1, *word], [*word, -1]
    found, stack = [], []          # stack: [LCP, class lists] of the intervals still open

    def merged(a: ClassLists, b: ClassLists, lcp: int) -> ClassLists:
        if a.size < b.size:
            a, b = b, a
        for place in b.places():
            for i, j in a.add(place, left):
                p = j - i
                # different children: the words after the common ones differ
                if p <= lcp and p + lcp >= min_length and word[i + lcp] != word[j + lcp]:
                    found.append((i, p + lcp, p))
        return a

    for place, lcp in zip(places.tolist(), [*lcps.tolist()[1:], 0]):
        # the leaf belongs to the interval of the greater of its two neighbouring LCPs
        now = ClassLists(place)
        while stack and stack[-1][0] > lcp:
            depth, lists = stack.pop()
            now = merged(lists, now, depth)
        if lcp < least:
            stack.clear()
        elif stack and stack[-1][0] == lcp:
            stack[-1][1] = merged(stack[-1][1], now, lcp)
        else:
            stack.append([lcp, now])
    return found


def word_numbers(texts: Sequence[list[str]]) -> np.ndarray:
    """One array for all texts, equal numbers for equal words of one text."""
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    codes = pd.factorize(np.array(list(chain.from_iterable(texts)), dtype=object))[0].astype(np.int64)
    return np.repeat(np.arange(len(texts)), sizes) * (int(codes.max(initial=0)) + 1) + codes


def runs_of(texts: Sequence[list[str]], min_length: int = MIN_LENGTH) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each word list, by start, then period."""
    ends = np.cumsum([0, *map(len, texts)])
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not ends[-1]:
        return out
    period: dict[tuple[int, int], int] = {}
    for start, length, p in maximal_pairs(word_numbers(texts), min_length):
        period[start, length] = min(p, period.get((start, length), p))
    if period:
        owners = np.searchsorted(ends, np.array([s for s, _ in period]), side="right") - 1
        for ((start, length), p), k in zip(period.items(), owners.tolist()):
            out[k].append((start - int(ends[k]), length, p))
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def collapsed_words(words: list[str], runs: Sequence[tuple[int, int, int]]) -> list[str]:
    """The words left when each run keeps its first period only."""
    if not runs:
        return words
    kept = bytearray(b"\x01") * len(words)
    for start, length, period in runs:
        kept[start + period:start + length] = bytes(length - period)
    return [w for w, k in zip(words, kept) if k]


def _slices(sizes: list[int]) -> Iterator[tuple[int, int]]:
    begin = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > SLICE:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)


def periodic_runs(docs: DataFrame, min_length: int = MIN_LENGTH, key: str = "doc_id", text: str = "text",
                  edit: Callable[[int | None, list[str]], list[str]] | None = None) -> DataFrame:
    """Add n_words, runs (array of start, length, period) and collapsed (words joined by one space) to docs.

    ``edit(key, words)`` may change a text's words first. The text column itself is not carried.
    """
    added = [StructField("n_words", LongType()), StructField("runs", ArrayType(RUN)), StructField("collapsed", StringType())]
    taken = {f.name.lower() for f in added}
    carried = [f for f in docs.schema.fields if f.name not in (text, key) and f.name.lower() not in taken]
    columns = [docs[f"`{key}`"], docs[f"`{text}`"], *[docs[f"`{f.name}`"] for f in carried]]
    # names by position inside, since the table's own may hold dots or clash
    source = docs.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)])
    inner = [StructField("c0", docs.schema[key].dataType), *[StructField(f"c{i + 2}", f.dataType) for i, f in enumerate(carried)], *added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [WORD.findall(t) if t else [] for t in batch.column(1).to_pylist()]
            if edit:
                words = list(map(edit, batch.column(0).to_pylist(), words))
            for a, b in _slices(list(map(len, words))):
                some = words[a:b]
                runs = runs_of(some, min_length)
                own = [c.slice(a, b - a) for i, c in enumerate(batch.columns) if i != 1]
                new = [pa.array(list(map(len, some)), pa.int64()),
                       pa.array([[{"start": s, "length": n, "period": p} for s, n, p in r] for r in runs], _RUNS),
                       pa.array([" ".join(collapsed_words(w, r)) for w, r in zip(some, runs)], pa.string())]
                yield pa.RecordBatch.from_arrays([*own, *new], names=[f.name for f in inner])

    out = small_batches(source).mapInArrow(run, StructType(inner))
    names = {"c0": key, **{f"c{i + 2}": f.name for i, f in enumerate(carried)}}
    return out.select(*[out[f.name].alias(names.get(f.name, f.name)) for f in inner])
