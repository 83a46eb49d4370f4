"""Benchmark passages in documents: a set join on the rarest shingle of each window."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraudspark.llm.common import ALNUM, runs, signed, slices, small_batches, whole, words
from fraudspark.sources.staging import stage

WINDOW, SHINGLE = 10, 5
BLOCK_BYTES = 8_000_000


@dataclass
class Windows:
    """Windows of a block of items: words, and what an index needs of them."""

    size: int
    texts: list[tuple[bytes, ...]] = field(default_factory=list)
    items: list[list[str]] = field(default_factory=list)
    full: list[int] = field(default_factory=list)
    shingles: list[np.ndarray] = field(default_factory=list)


def item_windows(items: list[tuple[str, str]], window: int = WINDOW) -> dict[int, Windows]:
    """Different windows by length: ``window``, or that of a shorter item."""
    out: dict[int, Windows] = {}
    known: dict[tuple[bytes, ...], tuple[int, int]] = {}
    for item, text in items:
        if not text:
            continue
        (s,) = slices(pa.array([text]))
        w = words(s, ALNUM, lower=True)
        n = len(w.start)
        size = min(n, window)
        if not size:
            continue
        kind = out.setdefault(size, Windows(size))
        g = min(SHINGLE, size)
        full, parts = runs(w.hash, size), runs(w.hash, g)
        for i in range(n - size + 1):
            key = tuple(w.bytes_of(j) for j in range(i, i + size))
            if key not in known:
                known[key] = (size, len(kind.texts))
                kind.texts.append(key)
                kind.items.append([])
                kind.full.append(full[i])
                kind.shingles.append(parts[i : i + size - g + 1])
            at = out[size].items[known[key][1]]
            if not at or at[-1] != item:
                at.append(item)
    return out


@dataclass
class Index:
    """For one window length: the token that each window must share (its rarest shingle), sorted,
    and for each token's run the windows and where in them the token stands."""

    size: int
    g: int
    tokens: np.ndarray
    window: np.ndarray
    offset: np.ndarray
    full: np.ndarray
    texts: list[tuple[bytes, ...]]
    items: list[list[str]]


def build_index(found: dict[int, Windows], df: dict[int, int]) -> list[Index]:
    out = []
    for size, w in found.items():
        token, offset = [], []
        for s in w.shingles:
            order = sorted(range(len(s)), key=lambda i: (df.get(int(s[i]), 0), int(s[i]), i))
            token.append(s[order[0]])
            offset.append(order[0])
        t = np.array(token, np.uint64)
        o = np.argsort(t, kind="stable")
        out.append(
            Index(size, min(SHINGLE, size), t[o], o, np.array(offset)[o],
                  np.array(w.full, np.uint64), w.texts, w.items)
        )
    return out


def _is_in(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Places of ``h`` that ``known`` (sorted) has; a bit table drops most others first."""
    if not len(known) or not len(h):
        return np.zeros(0, np.int64)
    bits = np.zeros(1 << 20, bool)
    bits[known >> np.uint64(44)] = True
    maybe = np.flatnonzero(bits[h >> np.uint64(44)])
    at = np.minimum(np.searchsorted(known, h[maybe]), len(known) - 1)
    return maybe[known[at] == h[maybe]]


def _counter(shingles: dict[int, np.ndarray]):
    """Counts the benchmark's shingles in documents, summed over a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = defaultdict(int)
        for b in batches:
            for s in slices(b.column(0)):
                w = words(s, ALNUM, lower=True)
                for g, known in shingles.items():
                    h = runs(w.hash, g)
                    at = _is_in(h, known)
                    at = at[np.isin(at, whole(w, g))] if len(at) else at
                    for k, n in zip(*np.unique(h[at], return_counts=True), strict=True):
                        seen[int(k)] += int(n)
        keys = signed(np.fromiter(seen, np.uint64, len(seen)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys), pa.array(list(seen.values()), pa.int64())], names=["token", "n"]
        )

    return run


def _hits(w, ix: Index, marks: np.ndarray, items: dict[int, set[str]]) -> None:
    doc = w.doc()
    h, full = runs(w.hash, ix.g), runs(w.hash, ix.size)
    at = _is_in(h, ix.tokens)
    if not len(at):
        return
    lo, hi = np.searchsorted(ix.tokens, h[at], "left"), np.searchsorted(ix.tokens, h[at], "right")
    n = hi - lo
    place = np.repeat(at, n)
    row = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
    start = place - ix.offset[row]
    end = start + ix.size - 1
    ok = (start >= 0) & (end < len(doc))
    start, end, row, place = start[ok], end[ok], row[ok], place[ok]
    d = doc[place]
    ok = (doc[start] == d) & (doc[end] == d)
    start, row = start[ok], row[ok]
    ok = full[start] == ix.full[ix.window[row]]
    for p, k in zip(start[ok].tolist(), ix.window[row[ok]].tolist(), strict=True):
        if all(w.bytes_of(p + j) == x for j, x in enumerate(ix.texts[k])):
            marks[p] += 1
            marks[p + ix.size] -= 1
            items[int(doc[p])].update(ix.items[k])


def _finder(index: list[Index], last: bool):
    """Adds to each row the words hit (one bit each) and the items found; after the last block of
    items, gives what the rows come to instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, masks, lists = [], [], []
            hit_before, items_before = b.column("hit"), b.column("items")
            for s in slices(b.column("text")):
                w = words(s, ALNUM, lower=True)
                marks = np.zeros(len(w.start) + 1, np.int32)
                items: dict[int, set[str]] = defaultdict(set)
                for ix in index:
                    _hits(w, ix, marks, items)
                hit = np.cumsum(marks[:-1]) > 0
                n_words.append(w.counts)
                some = np.flatnonzero(np.add.reduceat(np.append(hit, False), w.first[:-1]) > 0)
                some = set(some[w.counts[some] > 0].tolist())
                for i in range(s.hi - s.lo):
                    old, had = hit_before[s.lo + i].as_py(), items_before[s.lo + i].as_py()
                    if i not in some and old is None:
                        masks.append(None)
                        lists.append(had)
                        continue
                    own = hit[w.first[i] : w.first[i + 1]]
                    if old is not None:
                        own = own | np.unpackbits(np.frombuffer(old, np.uint8))[: len(own)].astype(bool)
                    masks.append(np.packbits(own).tobytes())
                    lists.append(sorted(items[i] | set(had or ())))
            n = np.concatenate(n_words) if n_words else np.zeros(0, np.int64)
            if last:
                yield _digests(b.column("id"), n, masks, lists)
                continue
            cols = dict(zip(b.schema.names, b.columns, strict=True))
            cols |= {
                "hit": pa.array(masks, pa.binary()),
                "items": pa.array(lists, pa.list_(pa.string())),
            }
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return run


def _digests(ids: pa.Array, n_words: np.ndarray, masks: list, lists: list) -> pa.RecordBatch:
    hit = [0 if m is None else int(np.unpackbits(np.frombuffer(m, np.uint8)).sum()) for m in masks]
    items = [x or [] for x in lists]
    digest = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
    return pa.RecordBatch.from_arrays(
        [
            ids,
            pa.array(n_words, pa.int64()),
            pa.array(hit, pa.int64()),
            pa.array([len(x) for x in items], pa.int64()),
            pa.array(digest, pa.string()),
            pa.array([x > 0 for x in hit], pa.bool_()),
        ],
        names=["id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    )


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int):
    """Items in blocks of about ``block_bytes`` characters, one at a time on the driver, and
    whether a block is the last."""
    b = benchmark.select(
        F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")
    ).where("text IS NOT NULL")
    total = b.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for k in range(n):
        part = b if n == 1 else b.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        yield sorted({(x.item or "", x.text) for x in part.collect()}), k == n - 1


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Which words of each document lie inside an occurrence of a benchmark window.

    Words are runs of a-z (A-Z lowered), digits and other than ASCII. An item's windows are all
    ``window`` words in a row; a shorter item is one window, an item without words none. Equal
    windows are one, with all their items. Each window holds six 5-word shingles (a shorter one
    fewer), which a document must all have, so that sharing the rarest is a necessary condition:
    shingles are counted over all documents first, and each window is indexed under its rarest.
    A document's shingles meet that index; the shingle's place gives the window's only possible
    start, whose bounds must lie in the text; then all words are compared.

    Null texts have no words. A null item id is the empty string. Repeated rows are rows of their
    own; an empty benchmark hits nothing; other columns are not read. The benchmark is taken in
    blocks of ``block_bytes``, so what is sent to tasks has a bound; each block adds to the same
    rows, written between blocks. Documents are read twice a block and never shuffled.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    out = rows.select(
        "id", "text", F.lit(None).cast("binary").alias("hit"), F.lit(None).cast("array<string>").alias("items")
    )
    for items, last in _blocks(benchmark, item_col, item_text_col, block_bytes):
        found = item_windows(items, window)
        by_g: dict[int, list[np.ndarray]] = defaultdict(list)
        for size, w in found.items():
            by_g[min(SHINGLE, size)] += w.shingles
        shingles = {g: np.unique(np.concatenate(x)) for g, x in by_g.items()}
        counts: dict[int, int] = {}
        if shingles:
            counted = rows.select("text").mapInArrow(_counter(shingles), "token long, n long")
            sums = counted.groupBy("token").agg(F.sum("n").alias("n")).collect()
            counts = {r.token % (1 << 64): r.n for r in sums}
        schema = f"id {kind}, text string, hit binary, items array<string>"
        if last:
            schema = f"id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
        out = out.mapInArrow(_finder(build_index(found, counts), last), schema)
        if not last:
            out = stage(out, "benchmark-hits")
    return out.withColumnRenamed("id", id_col)
