"""Filling containers of fixed capacity: harmonic packing, each worker for itself."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quarrymill.plans.shipping import ship
from quarrymill.plans.storage import materialize

#: Documents that are packed together, about; more of them gain little, fewer leave more last bins half full.
WINDOW = 50_000
#: White space from so many characters on is encoded past the splitting pattern, which cannot take a million.
LONG_BLANK = 50_000
#: Fixed value: the splitting pattern of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Fixed value: the name of its file.
VOCABULARY = "byte_bpe_50k.tiktoken"
PACKED = "container string, doc_id long, piece int, token_from long, tokens long, at long"


def token_counter(vocabulary: str | Path | bytes, long_blank: int = LONG_BLANK) -> Callable[[list[str]], list[int]]:
    """A function from texts to their numbers of tokens, by a public byte-level vocabulary: the file or what it holds.

    The cost grows with the length of a text, also of one without a space. A long run of white space is a piece
    of its own but for its last character, which belongs to what follows, so it is cut off and encoded apart.
    """
    import tiktoken

    lines = vocabulary if isinstance(vocabulary, bytes) else _file(vocabulary).read_bytes()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}
    encoding = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    blank = re.compile(r"[^\S\x1c-\x1f]{%d,}" % long_blank)

    def count(text: str) -> int:
        n, at = 0, 0
        for run in blank.finditer(text) if len(text) >= long_blank else ():
            end = run.end() - (run.end() < len(text))
            n += len(encoding.encode_ordinary(text[at : run.start()])) + len(encoding._encode_single_piece(text[run.start() : end]))
            at = end
        return n + len(encoding.encode_ordinary(text[at:]))

    return lambda texts: [count(t) for t in texts]


def _file(vocabulary: str | Path) -> Path:
    """The vocabulary itself, or the one used by default in a folder of them."""
    path = Path(vocabulary)
    return path / VOCABULARY if path.is_dir() else path


def pack_sizes(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item of size 1..capacity.

    Class i holds the sizes in (capacity / (i + 1), capacity / i], so that i of its items always fit in one
    bin. From the largest items on, a class first fills what earlier classes' bins left free, each bin
    taking the fixed number that surely fits, and then opens bins of its own with i items each. In a class
    items are taken by descending size, so that a bin holds like sizes.
    """
    bins, at = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    free = np.zeros(0, np.int64)
    order = np.argsort(-sizes, kind="stable")
    classes = capacity // sizes[order]
    starts = np.flatnonzero(np.diff(classes, prepend=0))
    for start, end in zip(starts, [*starts[1:], len(order)]):
        i, items = int(classes[start]), order[start:end]
        while len(items):
            largest = int(sizes[items[0]])
            open_bins = np.flatnonzero(free >= largest)
            if not len(open_bins):
                break
            open_bins = open_bins[np.argsort(free[open_bins], kind="stable")]
            slots = np.repeat(open_bins, free[open_bins] // largest)[: len(items)]
            _place(items[: len(slots)], slots, sizes, bins, at, free, capacity)
            items = items[len(slots) :]
        if len(items):
            own = len(free) + np.arange(len(items)) // i
            free = np.concatenate([free, np.full(own[-1] + 1 - len(free), capacity, np.int64)])
            _place(items, own, sizes, bins, at, free, capacity)
    return bins, at


def _place(items: np.ndarray, slots: np.ndarray, sizes: np.ndarray, bins: np.ndarray, at: np.ndarray, free: np.ndarray, capacity: int) -> None:
    """Put items into the bins of equal rank in `slots`, in which equal bins stand together."""
    s = sizes[items]
    before = np.cumsum(s) - s
    first = np.flatnonzero(np.diff(slots, prepend=-1))
    inside = before - np.repeat(before[first], np.diff([*first, len(slots)]))
    bins[items] = slots
    at[items] = capacity - free[slots] + inside
    np.subtract.at(free, slots, s)


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 2048, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Assign documents, measured in tokens, to containers of `capacity` tokens.

    Tokens are counted where the texts lie; only (id, tokens) travel, to groups of about `window` documents by
    a hash of id and text, and each group is packed by itself (see pack_sizes). So neither the partitioning
    nor the number of workers changes a container. A text of more than `capacity` tokens is cut into full
    pieces, which fill a container each, and a rest; no other is cut. Null and blank texts take no place and
    give no row; a null doc_id is packed like any other. Each row of a repeated doc_id is packed. Other
    columns are not used; an empty table gives no row.

    `vocabulary` is a file of ranks, or a folder with the default one; it is read once, here, and sent to the
    tasks. Result, one row for each piece: container, doc_id, piece (from 0), token_from in the document,
    tokens, at (offset in the container).
    """
    spark = docs.sparkSession
    ship(spark)
    ranks = spark.sparkContext.broadcast(_file(vocabulary).read_bytes())  # one vocabulary: some MB

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = token_counter(ranks.value)
        for b in batches:
            texts = b.column(2).to_pylist()
            full = np.array([bool(t) and not t.isspace() for t in texts], bool)
            kept = b.filter(pa.array(full))
            tokens = count([t for t, f in zip(texts, full) if f])
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), pa.array(tokens, pa.int64())], ["doc_id", "h", "tokens"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(doc_id, text).alias("h"), F.col(text).alias("text"))
    sizes = materialize(rows.mapInArrow(measure, "doc_id long, h long, tokens long"), "token-counts")
    groups = max(1, -(-sizes.count() // window))
    grouped = sizes.withColumn("g", F.pmod(F.xxhash64("h"), F.lit(groups))).repartition("g").sortWithinPartitions("g", "h", "doc_id", "tokens")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            g = np.asarray(b.column("g"))
            cuts = [0, *(np.flatnonzero(np.diff(g)) + 1).tolist(), len(g)]
            for start, end in zip(cuts, cuts[1:]):
                if held and held[0].column("g")[0].as_py() != g[start]:
                    yield from _packed(pa.Table.from_batches(held), capacity)
                    held = []
                if end > start:
                    held.append(b.slice(start, end - start))
        if held:
            yield from _packed(pa.Table.from_batches(held), capacity)

    return grouped.mapInArrow(pack, PACKED)


def _packed(group: pa.Table, capacity: int) -> Iterator[pa.RecordBatch]:
    n, ids, name = group.column("tokens").to_numpy(), group.column("doc_id").combine_chunks(), group.column("g")[0].as_py()
    pieces = -(-n // capacity)
    doc = np.repeat(np.arange(len(n)), pieces)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    size = np.minimum(capacity, n[doc] - piece * capacity)
    bins, at = pack_sizes(size, capacity)
    columns = [pa.array([f"{name}-{b}" for b in bins]), ids.take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(piece * capacity), pa.array(size), pa.array(at)]
    whole = pa.RecordBatch.from_arrays(columns, ["container", "doc_id", "piece", "token_from", "tokens", "at"])
    for k in range(0, len(whole), 10_000):
        yield whole.slice(k, 10_000)
