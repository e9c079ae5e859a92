"""Keyword-stuffed and link-list pages: pointwise mutual information of neighbouring words, repeated collocations."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quarrymill.plans.shipping import ship
from quarrymill.plans.skew import attach_counts
from quarrymill.plans.storage import materialize

#: Marks of a word, in the low bits of its code.
LINK, END, LIST = 1, 2, 4
MARKS = 3
#: Words counted in the table of neighbours; pairs with any other word, and these words, are counted by key.
VOCABULARY = 4096
#: Words on either side over which the features of a word are averaged.
AROUND = 10
#: At most so many labelled documents are used to fit the weights, the first by a hash of doc_id.
LABELLED = 2000
#: Tasks among which the labelled documents are divided.
SAMPLE_TASKS = 32
#: Words of a labelled document that enter the fit, evenly spread.
PER_DOCUMENT = 24
#: Words whose features are computed at once.
WORDS_AT_ONCE = 200_000
#: Cells of the table of neighbours that travel together.
BLOCK = 1 << 18
FEATURES = 10
#: A pair's key: this bit, and the hashes of its words.
WORD_BITS, PAIR = 28, 1 << 56
_ODD = 0x9E3779B97F4A7C15
_ENDS = tuple(".!?…")
_TRIM = "\"'`“”‘’«»<>()[]{}*_~|,;:.!?…-–—/\\#=&"


def _code(word: str) -> int:
    low = word.lower()
    bare = low.strip(_TRIM)
    marks = 0
    if "://" in low or "](" in low or "href=" in low or low.startswith("www.") or ("/" in bare and "." in bare):
        marks, bare = LINK, "<link>"
    elif not bare:
        marks, bare = LIST, "<mark>" + low[:2]
    else:
        if low.endswith(_ENDS) or word[-2:-1] in _ENDS:
            marks |= END
        if "#" in low or "=" in low or "|" in low or ";" in low[:-1] or (any(c.isdigit() for c in bare) and any(c.isalpha() for c in bare)):
            marks |= LIST
        if bare.isdigit():
            bare = "<number>"
    return (zlib.crc32(bare.encode("utf-8", "surrogatepass")) >> 4) << MARKS | marks


class Encoder:
    """Codes of the white-space-separated words of texts: 28 bits of a hash and the marks."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def __call__(self, text: str) -> np.ndarray:
        known, out = self.known, []
        for w in text.split():
            c = known.get(w)
            if c is None:
                if len(known) > 300_000:
                    known.clear()
                c = known[w] = _code(w)
            out.append(c)
        return np.array(out, np.int32)


class Corpus:
    """The words of the table of neighbours, and what the whole corpus says of them and their neighbours."""

    def __init__(self, codes: np.ndarray):
        self.codes = np.sort(codes)

    def classes(self, codes: np.ndarray) -> np.ndarray:
        h = codes >> MARKS
        at = np.minimum(np.searchsorted(self.codes, h), len(self.codes) - 1)
        return np.where(self.codes[at] == h, at + 1, 0).astype(np.int32) if len(self.codes) else np.zeros(len(h), np.int32)

    @property
    def size(self) -> int:
        return len(self.codes) + 1

    def finish(self, pairs: np.ndarray, words: int | None = None) -> None:
        """Keep log2 of the smoothed probabilities of pairs and words, as halves; `words` are distinct in the corpus."""
        n = self.pairs = max(1, int(pairs.sum()))
        first = pairs.sum(axis=1, dtype=np.float64) + 1
        self.words = n + (words or len(first))
        self.log_word = np.log2(first / self.words).astype(np.float32)
        self.log_pair = np.empty(pairs.shape, np.float16)
        for i in range(len(pairs)):
            self.log_pair[i] = np.log2((pairs[i] + 0.25) / n)

    def outside(self, codes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
        """Words that are not in the table and pairs that hold one: their places, then their keys."""
        c, h = self.classes(codes), codes.astype(np.int64) >> MARKS
        inner = np.flatnonzero(doc[:-1] == doc[1:])
        word, pair = np.flatnonzero(c == 0), inner[(c[inner] == 0) | (c[inner + 1] == 0)]
        return word, pair, h[word], PAIR | h[pair] << WORD_BITS | h[pair + 1]


def word_features(codes: np.ndarray, lengths: np.ndarray, corpus: Corpus, outside: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Features of each word of several documents laid end to end: means over the words around it.

    0 mutual information with the next word, 1 share of it below 0, 2 how much oftener the pair stands in this
    document than its corpus rate explains (log2), 3 share of pairs at least twice as often, 4 as 2 for single
    words, 5 links, 6 ends of sentences, 7 list marks, 8 log2 of the word's corpus rate, 9 rare words.

    `outside` has the sorted keys of these documents' words and pairs outside the table and their corpus counts;
    a key that is not among them stands in no other document, so its count is the one found here.
    """
    n = len(codes)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    size = np.repeat(lengths, lengths).astype(np.float32)
    c, h = corpus.classes(codes), (codes >> MARKS).astype(np.uint64)
    one = corpus.log_word[c]
    x = np.zeros((n, FEATURES), np.float32, order="F")
    inner = np.flatnonzero(doc[:-1] == doc[1:]) if n else np.zeros(0, np.int64)
    pair = corpus.log_pair[c[inner], c[inner + 1]].astype(np.float32)
    if outside is not None:
        keys, counts = outside
        word_at, pair_at, word_key, pair_key = corpus.outside(codes, doc)
        followed = np.append(doc[:-1] == doc[1:], False)[word_at] if n else np.zeros(0)
        one[word_at] = np.log2((_counts_of(word_key, followed, keys, counts) + 1) / corpus.words)
        pair[np.searchsorted(inner, pair_at)] = np.log2((_counts_of(pair_key, np.ones(len(pair_key)), keys, counts) + 0.25) / corpus.pairs)
    pmi = np.clip(pair - one[inner] - one[inner + 1], -4, 10)
    excess = _excess(doc[inner], h[inner] * np.uint64(_ODD) + h[inner + 1], size[inner] * np.exp2(pair))
    for k, v in enumerate((pmi, pmi < 0, excess, excess > 1)):
        x[inner, k] = v
        last = inner[np.flatnonzero(np.diff(inner, append=n + 1) > 1)]
        x[last + 1, k] = x[last, k]
    x[:, 4] = _excess(doc, h, size * np.exp2(one))
    x[:, 5], x[:, 6], x[:, 7] = (codes & LINK) > 0, (codes & END) > 0, (codes & LIST) > 0
    x[:, 8], x[:, 9] = one, c == 0
    i = np.arange(n)
    ends = np.cumsum(lengths)
    lo = np.maximum(np.repeat(ends - lengths, lengths), i - AROUND)
    hi = np.minimum(np.repeat(ends, lengths), i + AROUND + 1)
    total = np.zeros(n + 1)
    for k in range(FEATURES):  # column by column, which keeps a very long document small
        np.cumsum(x[:, k], dtype=np.float64, out=total[1:])
        x[:, k] = (total[hi] - total[lo]) / (hi - lo)
    return x


def _counts_of(key: np.ndarray, weight: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The corpus count of each key, or the sum of its weights here where `keys` lacks it."""
    at = np.minimum(np.searchsorted(keys, key), max(0, len(keys) - 1))
    known = keys[at] == key if len(keys) else np.zeros(len(key), bool)
    out = np.zeros(len(key))
    out[known] = counts[at[known]]
    _, back = np.unique(key[~known], return_inverse=True)
    out[~known] = np.bincount(back, weight[~known])[back] if len(back) else 0
    return out


def _excess(doc: np.ndarray, key: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """log2 of each key's count in its document over what the corpus rate explains, from 0 to 6."""
    mixed = (key * np.uint64(_ODD)) >> np.uint64(20) | doc.astype(np.uint64) << np.uint64(44)
    _, back, times = np.unique(mixed, return_inverse=True, return_counts=True)
    return np.clip(np.log2(times[back] / (1 + expected)), 0, 6)


def _expanded(z: np.ndarray) -> np.ndarray:
    i, j = np.triu_indices(z.shape[1])
    return np.hstack([np.ones((len(z), 1)), z, z[:, i] * z[:, j]])


class Weights:
    """Logistic regression on the word features and their products, fitted on labelled documents.

    A document's label says which kind most of its words are, not each of them. So after a first fit on all
    words the fit is repeated, leaving out the words of stuffed documents that look like sentences and those of
    ordinary documents that look stuffed, and whole documents that contradict their label.
    """

    def __init__(self, documents: list[np.ndarray], stuffed: list[bool], rounds: int = 3, only: tuple[int, ...] | None = None):
        x = np.vstack(documents).astype(np.float64)
        self.used = np.isin(np.arange(FEATURES), only) if only is not None else np.ones(FEATURES, bool)
        size = np.array([len(d) for d in documents])
        doc = np.repeat(np.arange(len(documents)), size)
        y = np.array(stuffed)[doc].astype(float)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = _expanded(self._scaled(x))
        keep = np.ones(len(y), bool)
        for _ in range(rounds):
            w = _logistic(z[keep], y[keep], (1 / size[doc])[keep])
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            share = np.bincount(doc, p > 0.5, minlength=len(documents)) / size
            fits = np.where(y > 0, share[doc] > 0.3, share[doc] < 0.6)
            again = fits & np.where(y > 0, p > 0.4, p < 0.6)
            if not (again & (y > 0)).any() or not (again & (y == 0)).any():
                break
            keep = again
        self.constant, self.linear = w[0], w[1 : FEATURES + 1]
        self.square = np.zeros((FEATURES, FEATURES))
        self.square[np.triu_indices(FEATURES)] = w[FEATURES + 1 :]

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -5, 5) * self.used

    def stuffed_words(self, features: np.ndarray) -> np.ndarray:
        out = np.zeros(len(features), bool)
        for k in range(0, len(features), WORDS_AT_ONCE):
            z = self._scaled(features[k : k + WORDS_AT_ONCE])
            out[k : k + WORDS_AT_ONCE] = self.constant + z @ self.linear + np.einsum("ij,ij->i", z @ self.square, z) > 0
        return out


class Rule:
    """Stands in for Weights where there are no labels of both kinds."""

    def stuffed_words(self, features: np.ndarray) -> np.ndarray:
        pmi, repeated, links = features[:, 0], features[:, 2], features[:, 5]
        return (pmi < 0) | (repeated > 1.5) | (links > 0.25)


def _logistic(z: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Newton's method."""
    w, weight = np.zeros(z.shape[1]), weight / weight.sum()
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (weight * (p - y)) + ridge * w
        h = (z * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z
        step = np.linalg.solve(h + ridge * np.eye(len(w)), gradient)
        w -= step
        if np.abs(step).max() < 1e-2:
            break
    return w


def stuffed_pages(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "label", stuffed: str = "stuffed", vocabulary: int = VOCABULARY, labelled: int = LABELLED, only: tuple[int, ...] | None = None) -> DataFrame:
    """Of each document, how many of its white-space-separated words stand in keyword repetition, word salad or lists.

    1. One pass over the texts writes their words as codes (hash and marks).
    2. Every word and every pair of neighbouring words is counted over the whole corpus. Pairs of the
       `vocabulary` most used words: every task counts those of its documents in a table of that fixed size,
       and the tables are summed. All other words and pairs, each of them seldom: rows of (key, document),
       summed by key, map-side first, and brought back to the documents that hold them, those of keys that
       very many documents hold apart from the others; a key of one document needs no bringing back. So
       `vocabulary` decides where a pair is counted, not its count.
    3. Each word gets the mean pointwise mutual information of the pairs around it, the excess of repeated
       pairs over their corpus rate, and further means (word_features); from weights fitted on labelled
       documents it is judged stuffed or not. Word salad and lists lack the coherence of sentences, repeated
       phrases have too much of it.
    The fit uses at most `labelled` documents, chosen by a hash of doc_id; a document with labels of both
    kinds counts as the more frequent, a tie as not stuffed. Counts and scores cover every document whole.
    Without labels of both kinds a fixed rule on mutual information, repetition and links stands in. `only` names
    the features to use, all by default; (0, 1, 2, 3) are mutual information and repeated pairs alone.

    Null, blank texts and null ids give no row; repeated rows of an id give one row, the one with most words
    (then the larger share); other columns are not used; an empty table gives no row.
    Result: doc_id, words, stuffed_words, mean_pmi.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null")
    coded = materialize(rows.mapInArrow(_encode, "doc_id long, codes array<int>"), "word-codes")
    words = materialize(coded.select(F.explode("codes").alias("c")).groupBy(F.shiftright("c", MARKS).alias("h")).count(), "words")
    top = words.orderBy(F.desc("count"), "h").limit(vocabulary).collect()  # `vocabulary` rows
    corpus = Corpus(np.array([r["h"] for r in top], np.int64))
    corpus.finish(_pair_table(coded, corpus), words.count())
    shared = spark.sparkContext.broadcast(corpus)  # of a fixed size, given by `vocabulary`
    held = materialize(coded.mapInArrow(_outside(shared), "doc_id long, key long, n long"), "outside-keys")
    sums = materialize(held.groupBy("key").agg(F.sum("n").alias("count"), F.count("*").alias("docs")).where("docs > 1"), "outside-sums")
    held = attach_counts(held.select("doc_id", "key"), sums, "key", "docs", ["doc_id"]).select("doc_id", F.struct("key", "count").alias("k"))
    outside = materialize(held.groupBy("doc_id").agg(F.collect_list("k").alias("k")).select("doc_id", F.col("k.key").alias("keys"), F.col("k.count").alias("counts")), "outside-counts")
    empty = F.array().cast("array<bigint>")
    counted = lambda df: df.join(outside, "doc_id", "left").withColumns({k: F.coalesce(k, empty) for k in ("keys", "counts")})
    chosen = labels.select(F.col(doc_id).alias("doc_id"), (F.col(label) == stuffed).alias("s")).dropna().groupBy("doc_id").agg(F.avg(F.col("s").cast("int")).alias("s"))
    chosen = coded.join(chosen, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)
    spread = counted(chosen).repartition(SAMPLE_TASKS, "doc_id")
    samples = spread.mapInPandas(_samples(shared), "doc_id long, s double, x binary").collect()  # at most `labelled` rows of fixed size
    samples.sort(key=lambda r: (r["doc_id"], r["x"]))
    kinds = [r["s"] > 0.5 for r in samples]
    features = [np.frombuffer(r["x"], np.float32).reshape(-1, FEATURES) for r in samples]
    judge = spark.sparkContext.broadcast(Weights(features, kinds, only=only) if len(set(kinds)) == 2 else Rule())
    scored = counted(coded).mapInPandas(_scores(shared, judge), "doc_id long, words long, stuffed_words long, mean_pmi double")
    best = F.max(F.struct("words", "stuffed_words", "mean_pmi")).alias("b")
    return scored.groupBy("doc_id").agg(best).select("doc_id", "b.*")


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encode = Encoder()
    for b in batches:
        codes = [encode(t) for t in b.column(1).to_pylist()]
        full = np.array([len(c) > 0 for c in codes], bool)
        ids = b.column(0).filter(pa.array(full))
        codes = [c for c in codes if len(c)]
        offsets = np.concatenate([[0], np.cumsum([len(c) for c in codes])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(codes) if codes else np.zeros(0, np.int32)))
        yield pa.RecordBatch.from_arrays([ids, lists], ["doc_id", "codes"])


def _parts(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of documents with about WORDS_AT_ONCE words, a longer document alone."""
    start, held = 0, 0
    for k, n in enumerate(lengths.tolist()):
        if k > start and (held + n > WORDS_AT_ONCE or k - start >= 2**16):
            yield start, k
            start, held = k, 0
        held += n
    if len(lengths) > start:
        yield start, len(lengths)


def _outside(corpus):
    """(doc_id, key, n) for each word outside the table and each pair with one; a word counts where another follows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, lists = np.asarray(b.column(0)), b.column(1)
            codes, lengths = np.asarray(lists.flatten()), np.asarray(lists.value_lengths())
            ends = np.cumsum(lengths)
            for start, end in _parts(lengths):
                own = codes[ends[start] - lengths[start] : ends[end - 1]]
                doc = np.repeat(np.arange(start, end), lengths[start:end])
                word, pair, word_key, pair_key = corpus.value.outside(own, doc)
                if not len(word):
                    continue
                followed = np.append(doc[:-1] == doc[1:], False)[word]
                at = np.concatenate([doc[word], doc[pair]])
                key = np.concatenate([word_key, pair_key])
                n = np.concatenate([followed.astype(np.int64), np.ones(len(pair), np.int64)])
                order = np.lexsort((key, at))
                at, key, n = at[order], key[order], n[order]
                first = np.flatnonzero(np.append(True, (np.diff(at) != 0) | (np.diff(key) != 0)))
                yield pa.RecordBatch.from_arrays([pa.array(ids[at[first]]), pa.array(key[first]), pa.array(np.add.reduceat(n, first))], ["doc_id", "key", "n"])

    return run


def _lookup(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    own, at = np.unique(np.concatenate(keys).astype(np.int64), return_index=True)
    return own, np.concatenate(counts).astype(np.int64)[at]


def _pair_table(coded: DataFrame, corpus: Corpus) -> np.ndarray:
    size = corpus.size

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(size * size, np.int32)
        for b in batches:
            lists = b.column(0)
            c = corpus.classes(np.asarray(lists.flatten())).astype(np.int64)
            doc = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths()))
            pairs = (c[:-1] * size + c[1:])[doc[:-1] == doc[1:]]
            cells, n = np.unique(pairs, return_counts=True)
            table[cells] += n.astype(np.int32)
        for k in range(0, len(table), BLOCK):
            block = table[k : k + BLOCK]
            if block.any():
                yield _block(k // BLOCK, block.astype(np.int64))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for k, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                cells = np.frombuffer(zlib.decompress(data), np.int64)
                held[k] = held[k] + cells if k in held else cells
        for k, cells in held.items():
            yield _block(k, cells)

    schema = "block int, cells binary"
    summed = coded.select("codes").mapInArrow(count, schema).repartition(8, "block").mapInArrow(add, schema)
    table = np.zeros(size * size, np.int64)
    for r in summed.toLocalIterator(prefetchPartitions=True):  # the table's fixed size
        cells = np.frombuffer(zlib.decompress(r["cells"]), np.int64)
        table[r["block"] * BLOCK : r["block"] * BLOCK + len(cells)] = cells
    return table.reshape(size, size)


def _block(k: int, cells: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(cells.tobytes(), 1)], pa.binary())], ["block", "cells"])


def _samples(corpus):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for codes, keys, counts in zip(pdf["codes"], pdf["keys"], pdf["counts"]):
                x = word_features(codes, np.array([len(codes)]), corpus.value, _lookup([keys], [counts]))
                at = np.linspace(0, len(x) - 1, min(len(x), PER_DOCUMENT)).astype(int)
                out.append(np.ascontiguousarray(x[at]).tobytes())
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "s": pdf["s"], "x": out})

    return run


def _scores(corpus, judge):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            lengths = pdf["codes"].map(len).to_numpy(np.int64)
            for start, end in _parts(lengths):
                own = lengths[start:end]
                part = {k: pdf[k].iloc[start:end].tolist() for k in ("codes", "keys", "counts")}
                x = word_features(np.concatenate(part["codes"]), own, corpus.value, _lookup(part["keys"], part["counts"]))
                doc = np.repeat(np.arange(len(own)), own)
                hit = np.bincount(doc, judge.value.stuffed_words(x), minlength=len(own)).astype(np.int64)
                pmi = np.bincount(doc, x[:, 0], minlength=len(own)) / own
                yield pd.DataFrame({"doc_id": pdf["doc_id"].iloc[start:end].to_numpy(), "words": own, "stuffed_words": hit, "mean_pmi": pmi})

    return run
