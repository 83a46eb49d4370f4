"""Removal of passages that occur earlier: suffix trees over prefix groups of suffixes.

A suffix is a place in a text with at least ``window`` words to come. Suffixes are dealt to groups
by a prefix of variable length: from the suffix's first word to the end of the least (by hash) run
of ``gram`` words inside its first ``window`` words. Equal windows have equal prefixes, so they
meet in one group; a group is named by that run, its anchor. An anchor that occurs once holds no
repeat and is dropped after a count. In a group small enough for memory the suffixes are sorted:
the sorted window heads are the subtree down to depth ``window``, and a run of equal heads is one
of its inner nodes at that depth, a repeat; its first leaf by (document, place) stays, the others
are repeats of it. A larger group gets longer prefixes, the whole windows, and only each node's
first leaf is computed, by an aggregate. Neighbouring repeats join to the maximal ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraudspark.llm.common import Words, keyed, runs, signed, slices, small_batches, words
from fraudspark.sources.staging import stage

WINDOW, GRAM, GROUP = 20, 6, 500
#: Windows of one anchor have a bit each in a long; longer windows get longer anchors.
MARKS = 62


def _anchors(w: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of whole windows, each one's anchor, and the hash of all runs of ``gram`` words."""
    g = runs(w.hash, gram)
    n = len(w.start) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), g
    last = np.repeat(w.first[1:], w.counts)[:n]
    start = np.flatnonzero(np.arange(n) + window <= last)
    best, at = g[start].copy(), np.zeros(len(start), np.int64)
    for k in range(1, window - gram + 1):
        other = g[start + k]
        less = other < best
        best[less] = other[less]
        at[less] = k
    return start, start + at, g


def _counts(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices(b.column(0)):
                w = words(s)
                _, anchor, g = _anchors(w, window, gram)
                h, n = np.unique(g[np.unique(anchor)], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(h)), pa.array(n, pa.int64())], names=["h", "n"]
                )

    return run


def _places(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(0).to_numpy()
            for s in slices(b.column(1)):
                w = words(s)
                _, anchor, g = _anchors(w, window, gram)
                anchor = np.unique(anchor)
                doc = w.doc()[anchor]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(signed(g[anchor])),
                        pa.array(keys[s.lo + doc]),
                        pa.array((anchor - w.first[doc]).astype(np.int32)),
                    ],
                    names=["h", "key", "place"],
                )

    return run


def _lists(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and values of a column of lists; null is an empty one."""
    n = np.array(pa.compute.fill_null(pa.compute.list_value_length(col), 0))
    return n, col.flatten().to_numpy(zero_copy_only=False)


def _windows(window: int, gram: int, heavy: bool):
    """Window hashes of the repeated anchors: a row for each anchor, its windows in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column("key").to_numpy()
            n, places = _lists(b.column("heavy" if heavy else "light"))
            row = np.repeat(np.arange(len(n)), n)
            for s in slices(b.column("text")):
                lo, hi = np.searchsorted(row, [s.lo, s.hi])
                if lo == hi:
                    continue
                w = words(s)
                start, anchor, g = _anchors(w, window, gram)
                wanted = np.zeros(len(w.start), bool)
                wanted[w.first[row[lo:hi] - s.lo] + places[lo:hi]] = True
                kept = wanted[anchor]
                start, anchor = start[kept], anchor[kept]
                if not len(start):
                    continue
                full = runs(w.hash, window)[start]
                first = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
                doc = w.doc()[anchor[first]]
                ends = np.append(first, len(start)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(signed(g[anchor[first]])),
                        pa.array(keys[s.lo + doc]),
                        pa.array((start[first] - w.first[doc]).astype(np.int32)),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(signed(full))),
                    ],
                    names=["h", "key", "start", "heads"],
                )

    return run


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorts the suffixes of whole groups (rows come in order of ``h``) and marks those windows,
    one bit each, that are not the first leaf of their node."""

    def solve(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        n, head = _lists(t.column("heads").chunk(0))
        row = np.repeat(np.arange(len(n)), n)
        inner = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        h, key, start = (t.column(c).to_numpy() for c in ("h", "key", "start"))
        order = np.lexsort((start[row] + inner, key[row], head, h[row]))
        a, b = order[:-1], order[1:]
        again = np.append(False, (h[row[a]] == h[row[b]]) & (head[a] == head[b]))
        marked = order[again]
        bits = np.zeros(len(n), np.int64)
        np.bitwise_or.at(bits, row[marked], np.int64(1) << inner[marked])
        some = np.flatnonzero(bits)
        return pa.RecordBatch.from_arrays(
            [pa.array(key[some]), pa.array(start[some]), pa.array(bits[some])],
            names=["key", "start", "bits"],
        )

    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        h = b.column("h").to_numpy()
        cut = int(np.searchsorted(h, h[-1]))
        if cut == 0 and held and held[-1].column("h")[0].as_py() == h[0]:
            held.append(b)
            continue
        if held or cut:
            yield solve(pa.Table.from_batches([*held, b.slice(0, cut)]))
        held = [b.slice(cut)]
    if held:
        yield solve(pa.Table.from_batches(held))


def _rest(window: int, gram: int):
    """Counts and digest of the words that no repeat covers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            n_heavy, heavy = _lists(b.column("heavy"))
            ends = np.cumsum(n_heavy)
            marks = b.column("marks")
            kept_at: dict[int, np.ndarray] = {}
            for s in slices(b.column("text")):
                some = [
                    i for i in range(s.lo, s.hi) if n_heavy[i] or marks[i].is_valid
                ]
                if not some:
                    continue
                w = words(s)
                start, anchor, _ = _anchors(w, window, gram)
                wanted = np.zeros(len(w.start), bool)
                for i in some:
                    wanted[w.first[i - s.lo] + heavy[ends[i] - n_heavy[i] : ends[i]]] = True
                again = np.zeros(len(w.start) + 1, bool)
                again[start[wanted[anchor]]] = True
                for i in some:
                    for m in marks[i].as_py() or ():
                        at = w.first[i - s.lo] + m["start"]
                        if m["bits"] < 0:
                            again[at] = False
                            continue
                        for k in range(m["bits"].bit_length()):
                            if m["bits"] >> k & 1:
                                again[at + k] = True
                cover = np.zeros(len(w.start) + window + 1, np.int32)
                at = np.flatnonzero(again)
                cover[at] += 1
                cover[at + window] -= 1
                gone = np.cumsum(cover)[: len(w.start)] > 0
                for i in some:
                    kept_at[i] = ~gone[w.first[i - s.lo] : w.first[i - s.lo + 1]]
            for i, text in enumerate(b.column("text")):
                ws = (text.as_py() or "").encode().split()  # blanks are 0x20 and 0x09 to 0x0D
                kept = list(compress(ws, kept_at[i].tolist())) if i in kept_at else ws
                out.append((len(ws), len(ws) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            a, r, d = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column("key"), pa.array(a, pa.int64()), pa.array(r, pa.int64()), pa.array(d, pa.string())],
                names=["key", "n_words", "n_removed", "kept_sha256"],
            )

    return run


def repeated_passages(
    docs: DataFrame,
    window: int = WINDOW,
    gram: int = GRAM,
    group: int = GROUP,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Words of each document that no window of ``window`` words covers whose word sequence also
    starts earlier (in a smaller id, or earlier in the same text), judged on the input.

    Words are runs of other than blanks; null has none. Windows are equal when the 64-bit hashes of
    the whole windows and of their anchors (``gram`` words, more for windows over ``MARKS``) agree.
    Rows that repeat an id, or have none, are documents
    of their own, in order of their texts (null first). No rows give no rows; other columns are
    not read.

    Of all suffixes only anchors are shuffled, about one for eight words: once to count them, once
    to find the repeated ones' places; a hot anchor's places are split by the join. Texts are
    shuffled once, by id. Groups of up to ``group`` are sorted in memory; larger ones cost an
    aggregate with map-side combine, so no group ever meets in one task.
    """
    spark = docs.sparkSession
    small_batches(spark)
    gram = max(gram, window - MARKS)
    ids, renamed = keyed(docs, id_col, text_col)
    texts = ids.select("key", "text")
    counts = (
        texts.select("text")
        .mapInArrow(_counts(window, gram), "h long, n long")
        .groupBy("h")
        .agg(F.sum("n").alias("n"))
        .where("n > 1")
    )
    counts = stage(counts, "repeat-counts")  # so that the join below can split a hot anchor
    places = texts.mapInArrow(_places(window, gram), "h long, key long, place int")
    repeated = (
        places.join(counts, "h")
        .groupBy("key")
        .agg(
            F.collect_list(F.when(F.col("n") <= group, F.col("place"))).alias("light"),
            F.collect_list(F.when(F.col("n") > group, F.col("place"))).alias("heavy"),
        )
    )
    repeated = stage(repeated, "repeat-places")
    known = texts.join(repeated, "key", "left")
    schema = "h long, key long, start int, heads array<long>"
    light = (
        known.mapInArrow(_windows(window, gram, False), schema)
        .repartition("h")
        .sortWithinPartitions("h")
        .mapInArrow(_subtrees, "key long, start int, bits long")
    )
    heavy = known.mapInArrow(_windows(window, gram, True), schema)
    firsts = (  # of equal neighbourhoods the first, then of equal windows
        heavy.groupBy("h", "heads")
        .agg(F.min(F.struct("key", "start")).alias("at"))
        .select("h", "at", F.posexplode("heads").alias("i", "head"))
        .groupBy("h", "head")
        .agg(F.min(F.struct(F.col("at.key").alias("key"), (F.col("at.start") + F.col("i")).alias("start"))).alias("at"))
        .select("at.key", "at.start", F.lit(-1).cast("long").alias("bits"))
    )
    marks = light.union(firsts).groupBy("key").agg(F.collect_list(F.struct("start", "bits")).alias("marks"))
    out = known.join(marks, "key", "left").mapInArrow(
        _rest(window, gram), "key long, n_words long, n_removed long, kept_sha256 string"
    )
    if renamed:
        out = out.join(ids.select("key", "id"), "key")
        return out.select(F.col("id").alias(id_col), "n_words", "n_removed", "kept_sha256")
    return out.select(
        F.col("key").cast(dict(docs.dtypes)[id_col]).alias(id_col), "n_words", "n_removed", "kept_sha256"
    )


REPEATS_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS k
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM w WHERE len(w) >= 20)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM s)
      WHERE n > 1),
x AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM r),
p AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS v FROM w),
k AS (SELECT p.doc_id, string_agg(v, ' ' ORDER BY p.p) AS t, count(*) AS n
      FROM p LEFT JOIN x ON p.doc_id = x.doc_id AND p.p = x.p WHERE x.p IS NULL GROUP BY 1)
SELECT w.doc_id, CAST(len(w) AS bigint) AS n_words, CAST(len(w) - coalesce(k.n, 0) AS bigint) AS n_removed,
  sha256(coalesce(k.t, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
"""
