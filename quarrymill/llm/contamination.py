"""Held-out test items leaking into a corpus: n-gram seeds, then Smith-Waterman alignment."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from quarrymill.plans.shipping import ship

GRAM = 4
#: A case of an exact leak: so many consecutive words of the item, or the whole of a shorter item.
RUN = 12
MATCH, MISMATCH, GAP = 2, -1, -1
#: Items are searched in blocks of about so many words; the corpus is read once for each block.
BLOCK_WORDS = 2_000_000
#: Alignments computed side by side: so many cases, or fewer of longer items, by the words of the longest one.
ALIGN_AT_ONCE, WORDS_AT_ONCE = 128, 1 << 15
_TAG, _WORD = re.compile("<[^>]*>"), re.compile("[a-z0-9]+")
FOUND = "doc_id long, item_id long, run int, score int, item_words int, doc_from int, doc_to int"


def words(text: str | None) -> list[str]:
    """Runs of a-z and 0-9 in the lower-case text, each <...> taken for a space."""
    return _WORD.findall(_TAG.sub(" ", text).lower()) if text else []


class Items:
    """Word codes of a block of items, their words with counts, and the positions of their n-grams."""

    def __init__(self, texts: list[tuple[int, str | None]]):
        code: dict[str, int] = {}
        self.words = {i: np.array([code.setdefault(w, len(code)) for w in words(t)], np.int32) for i, t in texts}
        self.words = {i: w for i, w in self.words.items() if len(w)}
        self.code = code
        self.bags = {i: np.unique(w, return_counts=True) for i, w in self.words.items()}
        grams: dict[tuple[int, ...], list[tuple[int, int]]] = defaultdict(list)
        for i, w in self.words.items():
            n = min(GRAM, len(w))
            for k in range(len(w) - n + 1):
                grams[tuple(w[k : k + n].tolist())].append((i, k))
        self.grams = sorted(grams)
        # by number of an item: its id, length, and words with counts; by number of an n-gram: items and places
        self.ids = np.array(list(self.words), np.int64)
        self.length = np.array([len(w) for w in self.words.values()], np.int64)
        number = {i: k for k, i in enumerate(self.words)}
        self.bag_word, self.bag_times, self.bag_from = _end_to_end([self.bags[i] for i in self.words])
        self.at_item, self.at_place, self.at_from = _end_to_end([([number[i] for i, _ in grams[g]], [k for _, k in grams[g]]) for g in self.grams])
        self.keys = {n: self._table(n) for n in sorted({len(g) for g in self.grams})}

    def _table(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted keys of the n-grams, and the number of each in self.grams."""
        own = [k for k, g in enumerate(self.grams) if len(g) == n]
        keys = self._key(np.array([self.grams[k] for k in own], np.int64).T)
        order = np.argsort(keys, kind="stable")
        return keys[order], np.array(own)[order]

    @staticmethod
    def _key(columns: np.ndarray) -> np.ndarray:
        key = np.zeros(len(columns[0]), np.uint64)
        for c in columns:
            key = key * np.uint64(0x9E3779B97F4A7C15) + c.astype(np.uint64) + np.uint64(1)
        return key

    def hits(self, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the item n-grams in a document's word codes, and where they begin."""
        found, places = [], []
        for n, (keys, own) in self.keys.items():
            if len(doc) < n:
                continue
            known = np.ones(len(doc) - n + 1, bool)
            for j in range(n):
                known &= doc[j : len(doc) - n + 1 + j] >= 0
            at = np.flatnonzero(known)
            if not len(at):
                continue
            k = self._key(np.array([doc[at + j] for j in range(n)]))
            place = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
            same = keys[place] == k
            found.append(own[place[same]])
            places.append(at[same])
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(found), np.concatenate(places)

    def may_reach(self, item: int, passage: np.ndarray, score: float) -> bool:
        """Whether an alignment score is possible by the words that item and passage have in common, in any order.

        No alignment scores more than a match for each common word; nor more than the best stretch of one side,
        if each of its words that the other side has is a match and each other word costs a mismatch or a gap.
        """
        own, times = self.bags[item]
        at = np.minimum(np.searchsorted(own, passage), len(own) - 1)
        same = own[at] == passage
        held = np.bincount(at[same], minlength=len(own))
        if MATCH * int(np.minimum(held, times).sum()) < score or _best_stretch(same) < score:
            return False
        return _best_stretch(held[np.searchsorted(own, self.words[item])] > 0) >= score


def _end_to_end(pairs: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two lists of each pair laid end to end, and where each begins."""
    starts = np.concatenate(([0], np.cumsum([len(a) for a, _ in pairs]))).astype(np.int64)
    flat = [np.concatenate([np.asarray(p[k], np.int64) for p in pairs]) if pairs else np.zeros(0, np.int64) for k in (0, 1)]
    return *flat, starts


def _spread(starts: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of the lists `which` that begin at `starts`, and their lengths."""
    n = starts[which + 1] - starts[which]
    return np.repeat(starts[which] - np.cumsum(n) + n, n) + np.arange(n.sum()), n


def _best_stretch(matches: np.ndarray) -> int:
    sums = np.concatenate(([0], np.cumsum(np.where(matches, MATCH, max(MISMATCH, GAP)))))
    return int((sums - np.minimum.accumulate(sums)).max())


def leaked_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", min_share: float = 0.5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Pairs of document and test item of which a passage leaked, exact or edited.

    1. One pass over the corpus finds the item n-grams of each document (4 words; an item of fewer words is
       one n-gram). Each of them is a seed, however many documents hold it, so whether a pair comes out does
       not depend on other documents.
    2. `run` is the longest run of consecutive equal words on the seeds' diagonals. A passage around seeds
       goes on if its run suffices, or if the words it has in common with the item, in any order, allow the
       least score; all others cannot reach it.
    3. These passages are aligned with the item by Smith-Waterman (match 2, mismatch -1, gap -1).
    A pair is kept with run >= min(12, words of the item), or a score of at least min_share of the item's
    best possible one. No exact run of 12 words is missed, and no edited copy that keeps an n-gram; one with
    every fourth word changed keeps none.

    Items are taken in blocks of `block_words` words, each with a pass of its own, so the part of the items
    that travels to the tasks is bounded. Null, blank and word-less texts match nothing; null ids are left
    out; repeated rows of an id give one row, the best; other columns are not used; empty tables give no row.
    Ids are bigint. Result: doc_id, item_id, run, score, item_words, doc_from, doc_to (words of the passage).
    """
    ship(docs.sparkSession)
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(doc_text).alias("text")).where("doc_id is not null and text is not null")
    items = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).where("item_id is not null and text is not null")
    out = None
    for block in _blocks(items, block_words):
        part = _block_leaks(docs, Items(block), min_share)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return docs.sparkSession.createDataFrame([], FOUND)
    best = F.max(F.struct("run", "score", "item_words", "doc_from", "doc_to")).alias("b")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.*")


def _blocks(items: DataFrame, block_words: int) -> Iterator[list[tuple[int, str]]]:
    block, size = [], 0
    for r in items.orderBy("item_id", "text").toLocalIterator():
        block.append((r["item_id"], r["text"]))
        size += len(r["text"]) // 4 + 1
        if size >= block_words:
            yield block
            block, size = [], 0
    if block:
        yield block


def _block_leaks(docs: DataFrame, items: Items, min_share: float) -> DataFrame:
    spark = docs.sparkSession
    if not items.grams:
        return spark.createDataFrame([], FOUND)
    shared = spark.sparkContext.broadcast(items)  # bounded by the block of items

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        code = own.code.get
        for pdf in batches:
            rows, cases = [], []
            for d, text in zip(pdf["doc_id"], pdf["text"]):
                doc = np.array([code(w, -1) for w in words(text)], np.int32)
                for case in _cases(d, doc, own, min_share):
                    cases.append(case)
                    if len(cases) == ALIGN_AT_ONCE:
                        rows += _aligned(cases, min_share)
                        cases = []
            rows += _aligned(cases, min_share)
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "run", "score", "item_words", "doc_from", "doc_to"])

    return docs.mapInPandas(scan, FOUND)


def _aligned(cases: list[tuple], min_share: float) -> list[tuple]:
    cases, rows, start = sorted(cases, key=lambda c: len(c[3])), [], 0
    for k in range(1, len(cases) + 1):
        if k == len(cases) or (k - start + 1) * len(cases[k][3]) > WORDS_AT_ONCE:
            part = cases[start:k]
            start = k
            scores = smith_waterman([c[3] for c in part], [c[4] for c in part])
            rows += [(d, i, run, score, len(item), lo, hi) for (d, i, run, item, _, lo, hi), score in zip(part, scores) if run >= min(RUN, len(item)) or score >= min_share * MATCH * len(item)]
    return rows


def _cases(doc_id: int, doc: np.ndarray, items: Items, min_share: float) -> Iterator[tuple]:
    """Passages of a document to align: seeds of an item lie close to each other, with room for the item around.

    All passages are judged at once by the words they share with their items, and only those that may reach the
    least score, or hold enough seeds of a full run on one diagonal, are looked at one by one.
    """
    grams, at = items.hits(doc)
    if not len(grams):
        return
    which, n = _spread(items.at_from, grams)
    item, at = items.at_item[which], np.repeat(at, n)
    shift = at - items.at_place[which]
    order = np.lexsort((at, item))
    item, at, shift = item[order], at[order], shift[order]
    m = items.length[item]
    begin = np.flatnonzero(np.concatenate(([True], (item[1:] != item[:-1]) | (at[1:] - at[:-1] > m[1:]))))
    end = np.append(begin[1:], len(at))
    begin, end = _cut(at, m, begin, end)
    own = item[begin]
    size = items.length[own]
    lo, hi = np.maximum(0, at[begin] - size), np.minimum(len(doc), at[end - 1] + size)
    least = min_share * MATCH * size
    # a run of r words holds r - n + 1 seeds of n words on its diagonal
    full = np.minimum(RUN, size)
    _, back, times = np.unique(item * (1 << 40) + shift, return_inverse=True, return_counts=True)
    dense = times[back] >= np.minimum(RUN, m) - np.minimum(GRAM, m) + 1
    run = np.logical_or.reduceat(dense, begin)
    for k in np.flatnonzero(run | (_common_words(doc, items, own, lo, hi) >= least)).tolist():
        mine = slice(begin[k], end[k])
        words_, shifts = items.words[items.ids[own[k]]], set(shift[mine].tolist())
        passage = doc[lo[k] : hi[k]]
        exact = run[k] and any(longest_run(words_, doc, s) >= full[k] for s in set(shift[mine][dense[mine]].tolist()))
        if exact or items.may_reach(items.ids[own[k]], passage, least[k]):
            yield doc_id, int(items.ids[own[k]]), max(longest_run(words_, doc, s) for s in shifts), words_, passage, int(lo[k]), int(hi[k])


def _cut(at: np.ndarray, m: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Groups of seeds that span more than four lengths of their item are cut where they pass it."""
    if not (at[end - 1] - at[begin] > 4 * m[begin]).any():
        return begin, end
    starts = []
    for b, e in zip(begin.tolist(), end.tolist()):
        while b < e:
            starts.append(b)
            b += int(np.searchsorted(at[b:e], at[b] + 4 * m[b], "right"))
    return np.array(starts), np.array([*starts[1:], end[-1]])


def _common_words(doc: np.ndarray, items: Items, own: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A match for each word that an item and its passage doc[lo:hi] have in common, in any order."""
    n = len(doc) + 1
    known = np.flatnonzero(doc >= 0)
    places = np.sort(doc[known].astype(np.int64) * n + known)
    which, k = _spread(items.bag_from, own)
    word = items.bag_word[which] * n
    held = np.searchsorted(places, word + np.repeat(hi, k)) - np.searchsorted(places, word + np.repeat(lo, k))
    return MATCH * np.add.reduceat(np.minimum(held, items.bag_times[which]), np.cumsum(k) - k)


def longest_run(item: np.ndarray, doc: np.ndarray, shift: int) -> int:
    """Longest run of equal words where item[j] stands against doc[j + shift]."""
    a, b = max(0, -shift), min(len(item), len(doc) - shift)
    same = np.concatenate(([0], item[a:b] == doc[a + shift : b + shift], [0])).astype(np.int8)
    edge = np.diff(same)
    return int((np.flatnonzero(edge == -1) - np.flatnonzero(edge == 1)).max(initial=0))


def smith_waterman(items: list[np.ndarray], passages: list[np.ndarray]) -> list[int]:
    """Best local alignment scores of many (item, passage) pairs at once, by anti-diagonals."""
    m, n = max(map(len, items)), max(map(len, passages))
    x = np.full((len(items), m), -2, np.int32)
    y = np.full((len(items), n), -3, np.int32)
    for k, (a, b) in enumerate(zip(items, passages)):
        x[k, : len(a)] = a
        y[k, : len(b)] = b
    back = y[:, ::-1]
    kind = np.int16 if MATCH * min(m, n) < 2**15 - 8 else np.int32  # no score is larger than that of the shorter side
    best = np.zeros(len(items), kind)
    # on anti-diagonal d, index i stands for cell (i, d - i), borders included
    before = np.zeros((len(items), m + 1), kind)
    last = np.zeros((len(items), m + 1), kind)
    for d in range(2, m + n + 1):
        lo, hi = max(1, d - n), min(m, d - 1)
        i = slice(lo, hi + 1)
        up = slice(lo - 1, hi)
        # y index d - i - 1 for i = lo..hi, reversed: n - d + i
        same = x[:, lo - 1 : hi] == back[:, n - d + lo : n - d + hi + 1]
        cell = before[:, up] + np.where(same, MATCH, MISMATCH).astype(kind)
        np.maximum(cell, np.maximum(last[:, up], last[:, i]) + kind(GAP), out=cell)
        np.maximum(cell, 0, out=cell)
        new = np.zeros_like(last)
        new[:, i] = cell
        np.maximum(best, cell.max(axis=1), out=best)
        before, last = last, new
    return best.tolist()
