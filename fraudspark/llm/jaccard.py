"""Set similarity join on word shingles with a tree over count vectors.

Each set's tokens are hashed into groups; its counts per group are a point. The sum of the smaller
coordinates of two points bounds the overlap of their sets from above, and the same sum over the
upper corner of a box bounds that of everything in it. Points that may meet at all are those that
share a token among the first few of a fixed order (two sets over the threshold must), so a block
is what shares such a token. A block's points go into a tree of boxes, boxes and then points that
cannot reach the threshold are dropped, and the pairs left are verified on the sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraudspark.llm.common import Slice, keyed, mix64, picked, runs, signed, slices, small_batches, words
from fraudspark.llm.components import components
from fraudspark.sources.staging import stage

SHINGLE, PERCENT, GROUPS = 4, 85, 256
FULL = 255
DOCS = 1 << 12
OFTEN, MOST_OFTEN, COUNTED = 8, 1 << 18, 1 << 20
LEAF = 16
TILE = 512
BLOCK = 1 << 10
#: Rows of a block whose pairs are named and verified apart; larger ones are verified where they are.
SMALL = 48
#: Tokens of the sets that a tile holds, and groups of the finer points there.
TOKENS, FINE = 1 << 20, 4096


def _sets(s: Slice, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Text and token (52 bits of hash) of all distinct shingles, in order of both. A text of fewer
    than ``k`` words has its whole sequence as one."""
    w = words(s, lower=True)
    n = w.counts
    doc = w.doc()
    m = len(doc) - k + 1
    at = np.flatnonzero(doc[: max(m, 0)] == doc[k - 1 :]) if m > 0 else np.zeros(0, np.int64)
    docs, hashes = [doc[at]], [runs(w.hash, k)[at]]
    for size in range(1, k):
        few = np.flatnonzero(n == size)
        if len(few):
            docs.append(few)
            hashes.append(runs(w.hash, size)[w.first[few]])
    d, h = np.concatenate(docs), np.concatenate(hashes)
    if len(docs) > 1:
        order = np.argsort(d, kind="stable")
        d, h = d[order], h[order]
    out = []
    for lo in range(0, len(n), DOCS):  # one number holds the text's and the token's
        a, b = np.searchsorted(d, [lo, lo + DOCS])
        packed = np.sort(((d[a:b] - lo).astype(np.uint64) << np.uint64(52)) | (h[a:b] >> np.uint64(12)))
        packed = packed[np.append(True, packed[1:] != packed[:-1])] if len(packed) else packed
        out.append(((packed >> np.uint64(52)).astype(np.int64) + lo, packed & np.uint64((1 << 52) - 1)))
    return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])


def _need(n: np.ndarray, percent: int) -> np.ndarray:
    """Tokens of a set of ``n`` that any set over the threshold must share."""
    return -(-n * percent // 100)


@dataclass
class Frequent:
    """Frequent tokens in order, and the binary order of magnitude of each one's count."""

    token: np.ndarray
    level: np.ndarray

    @classmethod
    def counted(cls, token: np.ndarray, c: np.ndarray) -> Frequent:
        order = np.argsort(token.view(np.uint64))
        return cls(token.view(np.uint64)[order], np.frexp(c[order].astype(float))[1].astype(np.int8))

    def of(self, h: np.ndarray) -> np.ndarray:
        """Level of each token; 0 if it is not frequent."""
        if not len(self.token):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.token, h), len(self.token) - 1)
        return np.where(self.token[at] == h, self.level[at], 0)


def _prefixes(d: np.ndarray, h: np.ndarray, n: np.ndarray, often: Frequent, percent: int):
    """Places of each set's first tokens: rare ones by hash, then frequent ones by level and hash."""
    ends = np.searchsorted(d, np.arange(len(n) + 1))
    rank = np.arange(len(d)) - np.repeat(ends[:-1], np.diff(ends))
    order = np.arange(len(d))
    level = often.of(h)
    if level.any():
        order = np.argsort(64 * d + level, kind="stable")
    return order[rank < np.repeat(n - _need(n, percent) + 1, np.diff(ends))]


def _points(k: int, groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(0)
            for s in slices(b.column(1)):
                size = s.hi - s.lo
                d, h = _sets(s, k)
                n = np.bincount(d, minlength=size)
                cell = d * groups + (mix64(h) >> np.uint64(40)).astype(np.int64) % groups
                vec = np.minimum(np.bincount(cell, minlength=size * groups), FULL).astype(np.uint8)
                f1, f2 = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
                if len(d):
                    some = np.flatnonzero(n)
                    cuts = np.cumsum(n)[some] - n[some]
                    f1[some] = np.add.reduceat(mix64(h), cuts)
                    f2[some] = np.add.reduceat(mix64(h ^ np.uint64(0x5851F42D4C957F2D)), cuts)
                raw = vec.tobytes()
                width = groups
                yield pa.RecordBatch.from_arrays(
                    [
                        keys.slice(s.lo, size),
                        pa.array(n, pa.int64()),
                        pa.array(signed(f1)),
                        pa.array(signed(f2)),
                        pa.array([raw[i * width : (i + 1) * width] for i in range(size)], pa.binary()),
                    ],
                    names=["key", "n", "f1", "f2", "vec"],
                )

    return run


def _merged(t: list[np.ndarray], c: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    tokens, back = np.unique(np.concatenate(t), return_inverse=True)
    counts = np.bincount(back, np.concatenate(c), len(tokens)).astype(np.int64)
    return tokens[counts >= least], counts[counts >= least]


def _frequent(k: int):
    """Tokens that a task's texts have often, by lossy counting in bounded memory; only the order
    of tokens depends on them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, c, held = [], [], 0
        for b in batches:
            for s in slices(b.column(0)):
                token, count = np.unique(_sets(s, k)[1], return_counts=True)
                t, c, held = [*t, token], [*c, count], held + len(token)
                least = 2
                while held > COUNTED:
                    token, count = _merged(t, c, least)
                    t, c, held, least = [token], [count], len(token), 2 * least
                    if held <= COUNTED // 2:
                        break
        if t:
            token, count = _merged(t, c, 3)
            yield pa.RecordBatch.from_arrays([pa.array(signed(token)), pa.array(count)], names=["token", "c"])

    return run


def _tokens(k: int, percent: int, often: Frequent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices(b.column(0)):
                d, h = _sets(s, k)
                size = s.hi - s.lo
                n = np.bincount(d, minlength=size)
                f1 = np.zeros(size, np.uint64)
                if len(d):
                    some = np.flatnonzero(n)
                    f1[some] = np.add.reduceat(mix64(h), np.cumsum(n)[some] - n[some])
                first = _prefixes(d, h, n, often, percent)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(h[first])), pa.array(signed(f1)[d[first]])], names=["token", "f"]
                )

    return run


def _overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sum of the smaller coordinates, by row."""
    return np.minimum(a, b).sum(axis=-1, dtype=np.int64)


def _reach(most: np.ndarray, total: np.ndarray, percent: int) -> np.ndarray:
    """Whether an overlap of ``most`` of two sets of ``total`` tokens is over the threshold."""
    return (100 + percent) * most >= percent * total


def _vectors(col: pa.Array) -> np.ndarray:
    """Points; a full coordinate may stand for more, and bounds nothing."""
    raw = np.frombuffer(b"".join(col.to_pylist()), np.uint8)
    v = raw.reshape(len(col), -1 if len(col) else 1).astype(np.uint16)
    v[v == FULL] = 1 << 15
    return v


def _bounded(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            most = _overlap(_vectors(b.column("vec_a")), _vectors(b.column("vec_b"))) if b.num_rows else np.zeros(0)
            total = b.column("n_a").to_numpy() + b.column("n_b").to_numpy()
            ok = pa.array(_reach(most, total, percent))
            share = pa.array(most / np.maximum(total, 1))
            yield pa.RecordBatch.from_arrays(
                [b.column("a").filter(ok), b.column("b").filter(ok), share.filter(ok)], names=["a", "b", "share"]
            )

    return run


def tree_join(
    n: np.ndarray, vec: np.ndarray, comp: np.ndarray, percent: int, side: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of points of different components (and sides, if given) whose bound reaches the threshold.

    Points are packed into leaves in order of side, of component (if it could fill a leaf), of size and
    of their largest-spread coordinates, leaves into boxes of ``LEAF``, up to one root. Pairs of boxes
    go down from (root, root) level by level; two boxes of one component or one side go no further.
    """
    wide = np.argsort(-vec.var(axis=0), kind="stable")[:2]
    _, back, many = np.unique(comp, return_inverse=True, return_counts=True)
    group = np.where(many[back] >= LEAF, back, -1)
    sides = np.arange(len(n)) if side is None else side
    first = np.zeros(len(n), np.int64) if side is None else side
    order = np.lexsort((vec[:, wide[1]], vec[:, wide[0]], n.astype(float).round(-1), n, group, first))
    base = n[order], back[order], sides[order]
    levels = [(*base, *base, vec[order])]  # least and most size, component and side; upper corner
    while len(levels[-1][0]) > 1:
        cut = np.arange(0, len(levels[-1][0]), LEAF)
        lows = [np.minimum.reduceat(x, cut) for x in levels[-1][:3]]
        highs = [np.maximum.reduceat(x, cut) for x in levels[-1][3:6]]
        levels.append((*lows, *highs, np.maximum.reduceat(levels[-1][6], cut, axis=0)))
    a = b = np.zeros(1, np.int64)
    for lo, lo_comp, lo_side, hi, hi_comp, hi_side, up in levels[-2::-1]:
        left, right = [], []
        for i in range(0, len(a), 512):  # bounded memory
            kids = np.arange(LEAF)
            x = (a[i : i + 512, None, None] * LEAF + kids[None, :, None] + 0 * kids[None, None, :]).ravel()
            y = (b[i : i + 512, None, None] * LEAF + kids[None, None, :] + 0 * kids[None, :, None]).ravel()
            ok = (x < len(lo)) & (y < len(lo)) & (x <= y)
            x, y = x[ok], y[ok]
            ok = (100 * hi[x] >= percent * lo[y]) & (100 * hi[y] >= percent * lo[x])
            for least, most in ((lo_comp, hi_comp), (lo_side, hi_side)):
                ok &= (np.minimum(least[x], least[y]) != np.maximum(most[x], most[y]))
            x, y = x[ok], y[ok]
            for j in range(0, len(x), 1 << 13):
                p, q = x[j : j + (1 << 13)], y[j : j + (1 << 13)]
                ok = _reach(_overlap(up[p], up[q]), lo[p] + lo[q], percent)
                left.append(p[ok])
                right.append(q[ok])
        a = np.concatenate(left) if left else np.zeros(0, np.int64)
        b = np.concatenate(right) if right else np.zeros(0, np.int64)
        if not len(a):
            break
    if len(levels) == 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return order[a], order[b]


def block_jobs(rows: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """Deals blocks (token, f1, n, comp) out as jobs of at most two tiles: token, x, y, tile, f1.
    Every two rows of a block that differ in component and may be similar by size meet in a job.

    A block of at most ``block`` rows and ``TOKENS`` tokens is one tile. A larger one is cut by classes of size, so that
    sizes two classes apart are never similar; in a class, a component too large for a tile
    has tiles of its own, dealt by hash, and the others share tiles by the hash of the component. A
    job is a pair of tiles (or one, x = y) whose sizes may be similar and that are not of one
    component alone.
    """
    none = F.lit(0).cast("long")
    rows = rows.select("token", "f1", "n", "comp").withColumn("w", F.greatest(F.lit(1 / block), F.col("n") / TOKENS))
    total = rows.groupBy("token").agg(F.sum("w").alias("c"))
    rows = stage(rows.join(total, "token"), "large-members")
    whole = rows.where(F.col("c") <= 1).select(
        "token", none.alias("x"), none.alias("y"), none.alias("tile"), "f1"
    )
    size = F.floor(F.log("n") / (math.log(100 / percent) * (1 + 1e-9))) if percent < 100 else F.col("n")
    hot = stage(rows.where(F.col("c") > 1).withColumn("size", size), "hot-members")
    units = stage(hot.groupBy("token", "size", "comp").agg(F.sum("w").alias("m")), "hot-units")
    few = F.col("m") <= 1
    parts = units.where(few).groupBy("token", "size").agg(F.ceil(F.sum("m")).alias("parts"))
    units = units.join(parts, ["token", "size"], "left").select(
        "token", "size", "comp", few.alias("few"),
        F.when(few, F.col("parts")).otherwise(F.ceil(F.col("m"))).alias("parts"),
    )
    key = F.when(F.col("few"), F.xxhash64("comp")).otherwise(F.xxhash64("f1"))
    own = F.when(F.col("few"), F.lit(-1).cast("long")).otherwise(F.col("comp"))
    tile = F.xxhash64("size", "few", own, F.pmod(key, F.col("parts")))
    hot = stage(hot.join(units, ["token", "size", "comp"]).withColumn("tile", tile), "hot-tiles")
    tiles = hot.groupBy("token", "tile").agg(
        F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("comp").alias("least"), F.max("comp").alias("most")
    )
    tiles = stage(tiles, "tiles")
    at = lambda c: tiles.select("token", *[F.col(x).alias(f"{x}_{c}") for x in ("tile", "lo", "hi", "least", "most")])
    jobs = (
        at("x").join(at("y"), "token")
        .where("tile_x <= tile_y")
        .where((100 * F.col("hi_x") >= percent * F.col("lo_y")) & (100 * F.col("hi_y") >= percent * F.col("lo_x")))
        .where("least(least_x, least_y) <> greatest(most_x, most_y)")
        .select("token", F.col("tile_x").alias("x"), F.col("tile_y").alias("y"))
    )
    jobs = stage(jobs, "tile-jobs")
    need = jobs.withColumn("tile", F.col("x")).union(jobs.where("x <> y").withColumn("tile", F.col("y")))
    return whole.union(hot.join(need, ["token", "tile"]).select("token", "x", "y", "tile", "f1"))


def _cuts(t: pa.Table, keys: tuple[str, ...]) -> Iterator[tuple[int, int]]:
    """Bounds of the jobs of more than one row."""
    at = [t.column(c).to_numpy() for c in keys]
    cuts = np.flatnonzero(np.append(True, np.any([k[1:] != k[:-1] for k in at], axis=0)))
    for lo, hi in zip(cuts, np.append(cuts[1:], t.num_rows), strict=True):
        if hi - lo > 1:
            yield lo, hi


def _pairs_of(keys: tuple[str, ...], solve):
    """Pairs of nodes that ``solve`` gives for each job, each pair once."""

    def solved(t: pa.Table) -> pa.RecordBatch:
        pairs = [solve(t.slice(lo, hi - lo)) for lo, hi in _cuts(t, keys)]
        a, b = (np.concatenate([p[i] for p in pairs]) if pairs else np.zeros(0, np.int64) for i in (0, 1))
        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])

    return solved


def _jobs(keys: tuple[str, ...], solved):
    """Whole jobs, rows of equal keys, some at a time; rows come in order of the keys. ``solved``
    gives what comes of a table of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            at = [b.column(c).to_numpy() for c in keys]
            cut = int(np.argmax(np.all([k == k[-1] for k in at], axis=0)))
            if cut == 0 and held and all(held[-1].column(c)[0].as_py() == k[0] for c, k in zip(keys, at, strict=True)):
                held.append(b)
                continue
            if held or cut:
                yield solved(pa.Table.from_batches([*held, b.slice(0, cut)]))
            held = [b.slice(cut)]
        if held:
            yield solved(pa.Table.from_batches(held))

    return run


def _blocks(percent: int):
    """Pairs over the bound of a small block: linear in its rows, as a block has few."""

    def solve(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        node, n, comp = (t.column(c).to_numpy() for c in ("node", "n", "comp"))
        x, y = tree_join(n, _vectors(t.column("vec").combine_chunks()), comp, percent)
        return node[x], node[y]

    return _jobs(("token",), _pairs_of(("token",), solve))


def _fine(sets: list[np.ndarray]) -> np.ndarray:
    out = np.empty((len(sets), FINE), np.uint16)
    for i, s in enumerate(sets):
        cell = (mix64(s) >> np.uint64(20)).astype(np.int64) % FINE
        out[i] = np.minimum(np.bincount(cell, minlength=FINE), (1 << 16) - 1)
    return out


def joining_links(
    n: np.ndarray, vec: np.ndarray, comp: np.ndarray, sets: list[np.ndarray], percent: int, side: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Verified pairs that join components of a job: one fewer than its rows at most.

    Pairs that the tree leaves are taken by falling bound. Those whose rows are in one component by
    then need no more; the others are bounded by the sets' counts in ``FINE`` groups, and verified.
    """
    x, y = tree_join(n, vec, comp, percent, side)
    _, label = np.unique(comp, return_inverse=True)
    share = np.concatenate(
        [np.zeros(0)]
        + [
            _overlap(vec[x[i : i + 8192]], vec[y[i : i + 8192]]) / (n[x[i : i + 8192]] + n[y[i : i + 8192]])
            for i in range(0, len(x), 8192)
        ]
    )
    order = np.argsort(-share, kind="stable")
    x, y = x[order], y[order]
    fine = _fine(sets) if len(x) else None
    left, right = [], []
    for i in range(0, len(x), 512):
        p, q = x[i : i + 512], y[i : i + 512]
        apart = label[p] != label[q]
        p, q = p[apart], q[apart]
        if not len(p):
            continue
        most = np.minimum(fine[p], fine[q]).sum(axis=1, dtype=np.int64)
        ok = _reach(most, n[p] + n[q], percent)
        for a, b in zip(p[ok].tolist(), q[ok].tolist(), strict=True):
            if label[a] != label[b] and _similar(sets[a], sets[b], percent):
                label[label == label[b]] = label[a]
                left.append(a)
                right.append(b)
    return np.array(left, np.int64), np.array(right, np.int64)


JOB = ("token", "x", "y")


def _side(t: pa.Table) -> np.ndarray | None:
    """Which of its job's two tiles each row is of; none if the job is of one tile."""
    first, second = t.column("x")[0].as_py(), t.column("y")[0].as_py()
    return None if first == second else (t.column("tile").to_numpy() != first).astype(np.int64)


def _bounded_jobs(percent: int):
    """Rows of jobs that are in a pair over the bound: at most as many as came."""

    def solved(t: pa.Table) -> pa.RecordBatch:
        kept = [np.zeros(0, np.int64)]
        for lo, hi in _cuts(t, JOB):
            job = t.slice(lo, hi - lo)
            n, comp = (job.column(c).to_numpy() for c in ("n", "comp"))
            x, y = tree_join(n, _vectors(job.column("vec").combine_chunks()), comp, percent, _side(job))
            kept.append(lo + np.union1d(x, y))
        rows = t.select([*JOB, "tile", "f1"]).take(pa.array(np.concatenate(kept))).combine_chunks()
        return pa.RecordBatch.from_arrays([pa.array(c.to_numpy()) for c in rows.columns], names=rows.column_names)

    return _jobs(JOB, solved)


def _verified_jobs(percent: int):
    """Links of jobs whose rows carry their sets."""

    def solve(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        node, n, comp = (t.column(c).to_numpy() for c in ("node", "n", "comp"))
        sets = [np.frombuffer(v.as_buffer(), np.uint64) for v in t.column("tokens").combine_chunks()]
        vec = _vectors(t.column("vec").combine_chunks())
        a, b = joining_links(n, vec, comp, sets, percent, _side(t))
        return node[a], node[b]

    return _jobs(JOB, _pairs_of(JOB, solve))


def _token_sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices(b.column(1)):
                d, h = _sets(s, k)
                ends = np.searchsorted(d, np.arange(s.hi - s.lo + 1))
                raw = [h[lo:hi].tobytes() for lo, hi in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(s.lo, s.hi - s.lo), pa.array(raw, pa.binary())], names=["node", "tokens"]
                )

    return run


def _block_links(texts: DataFrame, members: DataFrame, of_class: DataFrame, k: int, percent: int, block: int) -> DataFrame:
    """Links of large blocks (token, f1, n, comp), verified in the task that has both sets; a job
    gives fewer links than it has rows. Points go by jobs first, and sets, which are far wider, only
    with the rows that are then in a pair over the bound: most large blocks are chance meetings."""
    jobs = stage(block_jobs(members, percent, block), "block-jobs")
    jobs = stage(
        jobs.join(of_class, "f1")
        .repartition(*JOB)
        .sortWithinPartitions(*JOB)
        .select(*JOB, "tile", "f1", "n", "comp", "vec")
        .mapInArrow(_bounded_jobs(percent), "token long, x long, y long, tile long, f1 long"),
        "bounded-jobs",
    )
    nodes = stage(jobs.select("f1").distinct().join(of_class.select("f1", "node"), "f1").select(F.col("node").alias("key")), "large-nodes")
    sets = stage(picked(texts, nodes, "key", "inner").select("key", "text").mapInArrow(_token_sets(k), "node long, tokens binary"), "large-sets")
    rows = jobs.join(of_class, "f1").join(sets, "node")
    return (
        rows.repartition(*JOB)
        .sortWithinPartitions(*JOB)
        .select(*JOB, "tile", "node", "n", "comp", "vec", "tokens")
        .mapInArrow(_verified_jobs(percent), "a long, b long")
        .select(F.col("a").alias("u"), F.col("b").alias("v"))
    )


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _to_lead(k: int, percent: int):
    """Exact similarity of each text to its partner (rows come in order of tile, a tile's partners
    first). Only the partners of one tile are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, leads = None, {}
        for b in batches:
            links = []
            tiles, keys = b.column("tile").to_pylist(), b.column("key").to_pylist()
            others, texts = b.column("other").to_pylist(), b.column("text")
            for i, at in enumerate(tiles):
                if at != tile:
                    tile, leads = at, {}
                (s,) = slices(texts.slice(i, 1))
                mine = _sets(s, k)[1]
                if others[i] is None:
                    leads[keys[i]] = mine
                elif _similar(mine, leads[others[i]], percent):
                    links.append((keys[i], others[i]))
            u, v = zip(*links, strict=True) if links else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def _lead_links(texts: DataFrame, best: DataFrame, k: int, percent: int) -> DataFrame:
    """Similar pairs of ``best`` (``a`` has one partner ``b``). Each text of ``a`` is shuffled once,
    to a tile of its partner; a partner's text once for each ``TILE`` of those that have it."""
    tiles = F.ceil(F.col("count") / TILE)
    leads = best.groupBy("b").count().select("b", tiles.alias("parts"))
    part = F.pmod(F.xxhash64("a"), F.col("parts"))
    mine = best.join(leads, "b").select(F.col("a").alias("key"), F.col("b").alias("other"), part.alias("part"))
    every = leads.select("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    theirs = every.select(F.col("b").alias("key"), F.lit(None).cast("long").alias("other"), "part")
    wanted = stage(mine.union(theirs), "lead-tiles")
    tile = F.xxhash64(F.coalesce("other", "key"), "part").alias("tile")
    rows = picked(texts, wanted, "key", "inner").select(tile, "key", "other", "text")
    return stage(
        rows.repartition("tile")
        .sortWithinPartitions("tile", F.col("other").isNotNull())
        .mapInArrow(_to_lead(k, percent), "u long, v long"),
        "lead-links",
    )


def _verified(k: int, percent: int):
    """Exact similarity of the pairs of each tile (rows come in order of tile, its texts first)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, sets = None, {}
        for b in batches:
            links = []
            tiles, keys = b.column("tile").to_pylist(), b.column("key").to_pylist()
            others, texts = b.column("other").to_pylist(), b.column("text")
            for i, at in enumerate(tiles):
                if at != tile:
                    tile, sets = at, {}
                if others[i] is None:
                    (s,) = slices(texts.slice(i, 1))
                    sets[keys[i]] = _sets(s, k)[1]
                    continue
                x, y = sets[keys[i]], sets[others[i]]
                if _similar(x, y, percent):
                    links.append((keys[i], others[i]))
            u, v = zip(*links, strict=True) if links else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def _links(texts: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs of keys whose sets are similar. Texts of keys in pairs are picked out first. Pairs are
    dealt to tiles by the hashes of both keys, and a text goes once to each tile that has a pair of
    it, so that a tile holds at most about twice ``TILE`` texts and many pairs share one."""
    keys = stage(pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct(), "pair-keys")
    some = stage(picked(texts, keys, "key", "inner"), "pair-texts")
    side = keys.count() // TILE + 1
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(side))
    tiled = pairs.select((part("a") * side + part("b")).alias("tile"), "a", "b")
    need = tiled.select("tile", F.col("a").alias("key")).union(tiled.select("tile", "b")).distinct()
    rows = need.join(some, "key").select("tile", "key", F.lit(None).cast("long").alias("other"), "text")
    rows = rows.union(tiled.select("tile", "a", "b", F.lit(None).cast("string")))
    return stage(
        rows.repartition("tile")
        .sortWithinPartitions("tile", F.col("other").isNotNull())
        .mapInArrow(_verified(k, percent), "u long, v long"),
        "links",
    )


def similar_documents(
    docs: DataFrame,
    shingle: int = SHINGLE,
    percent: int = PERCENT,
    groups: int = GROUPS,
    id_col: str = "doc_id",
    text_col: str = "text",
    block: int = BLOCK,
) -> DataFrame:
    """Size of each document's shingle set and its component under links of similar sets.

    Words are runs of other than blanks, A-Z lowered; a set holds the distinct runs of ``shingle``
    words (the whole sequence of a shorter text). Sets are linked when their Jaccard similarity is
    ``percent`` per cent or more; empty sets are linked with nothing. ``component_id`` is the
    smallest id reachable by links. Null is the empty text. Rows that repeat an id, or have none,
    are documents of their own; among equal ids the component names that id. No rows give no rows;
    other columns are not read.

    1. Equal sets are one class (two 64-bit sums over the set), named by its smallest id.
    2. Each set's first tokens: as many as it can lack of a similar set, plus one. Their order is
       by hash, with tokens that are frequent all over last, by magnitude. A token that only one class has is
       dropped by an aggregate.
    3. Every class of a block is paired with the block's first class and bounded: linear in the
       block. Each class is verified with the partner of its highest bound first, which is enough
       for most groups of near copies; then the pairs still between components are.
    4. Blocks that are then still in different components go through the tree, which pairs points
       of different components only; tokens with the same classes are one block. In a block of at
       most ``SMALL`` classes, pairs over the bound are named and verified by tiles of texts. A
       larger one carries sets, cut into tiles of ``block`` rows that go by pairs (see
       ``block_jobs``), and gives only the links that join two of its components; its rows go by
       their points first, and only those in a pair over the bound carry a set.
    """
    small_batches(docs.sparkSession)
    ids, renamed = keyed(docs, id_col, text_col)
    texts = ids.select("key", "text")
    points = stage(
        texts.mapInArrow(_points(shingle, groups), "key long, n long, f1 long, f2 long, vec binary"),
        "set-points",
    )
    classes = stage(
        points.where("n > 0").groupBy("n", "f1", "f2").agg(F.min("key").alias("node"), F.first("vec").alias("vec")),
        "set-classes",
    )
    only = texts.select("text")
    rows = (
        only.mapInArrow(_frequent(shingle), "token long, c long")
        .groupBy("token")
        .agg(F.sum("c").alias("c"))
        .where(F.col("c") >= OFTEN)
        .orderBy(F.desc("c"), "token")
        .limit(MOST_OFTEN)  # more would only be taken in the order of the others
        .toArrow()
    )
    often = Frequent.counted(rows.column("token").to_numpy(), rows.column("c").to_numpy())
    tokens = only.mapInArrow(_tokens(shingle, percent, often), "token long, f long")
    shared = stage(
        tokens.groupBy("token")
        .agg(F.min("f").alias("lead"), F.max("f").alias("most"))
        .where("lead <> most")
        .select("token", "lead"),
        "shared-tokens",
    )
    members = stage(tokens.join(shared, "token").distinct(), "block-members")
    of = lambda side: classes.select(
        F.col("f1").alias(f"f_{side}"), F.col("node").alias(side), F.col("n").alias(f"n_{side}"),
        F.col("vec").alias(f"vec_{side}"),
    )
    stars = (
        members.where("f <> lead").select(F.col("f").alias("f_a"), F.col("lead").alias("f_b")).distinct()
        .join(of("a"), "f_a")
        .join(of("b"), "f_b")
        .where((100 * F.col("n_a") >= percent * F.col("n_b")) & (100 * F.col("n_b") >= percent * F.col("n_a")))
        .mapInArrow(_bounded(percent), "a long, b long, share double")
    )
    stars = stage(stars, "star-pairs")
    best = stars.groupBy("a").agg(F.max(F.struct("share", "b")).alias("best")).select("a", "best.b")
    best = stage(best, "best-pairs")
    known = stage(components(_lead_links(texts, best, shingle, percent)), "lead-components")
    side = lambda c: known.select(F.col("node").alias(c), F.col("component").alias(f"comp_{c}"))
    apart = (
        stars.select("a", "b").join(best, ["a", "b"], "left_anti")
        .join(side("a"), "a", "left")
        .join(side("b"), "b", "left")
        .where(F.coalesce("comp_a", "a") != F.coalesce("comp_b", "b"))
        .select("a", "b")
    )
    links = _links(texts, stage(apart, "apart-pairs"), shingle, percent)
    links = known.select(F.col("node").alias("u"), F.col("component").alias("v")).union(links)
    known = stage(components(links), "star-components")
    of_class = classes.join(known, "node", "left").select(
        "f1", "node", "n", "vec", F.coalesce("component", "node").alias("comp")
    )
    of_class = stage(of_class, "class-components")
    placed = members.select("token", F.col("f").alias("f1"))
    mixed = (  # of two classes, one is the first, and their pair is done
        placed.join(of_class.select("f1", "comp"), "f1")
        .groupBy("token")
        .agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("c"))
        .where("x <> y AND c > 2")
        .select("token", "c")
    )
    placed = stage(placed.join(mixed, "token").drop("c"), "mixed-places")
    # tokens that the same classes have are one block
    place = [F.bit_xor(F.xxhash64(F.lit(seed), "f1")).alias(f"s{seed}") for seed in (1, 2)]
    blocks = placed.groupBy("token").agg(F.count("*").alias("c"), *place)
    blocks = blocks.groupBy("c", "s1", "s2").agg(F.min("token").alias("token")).select("token", "c")
    placed = placed.join(stage(blocks, "mixed-blocks"), "token").join(of_class.select("f1", "n", "comp"), "f1")
    placed = stage(placed, "mixed-members")
    rest = (
        placed.where(F.col("c") <= SMALL).select("token", "f1").join(of_class, "f1")
        .repartition("token")
        .sortWithinPartitions("token")
        .select("token", "node", "n", "comp", "vec")
        .mapInArrow(_blocks(percent), "a long, b long")
        .distinct()
    )
    more = _links(texts, stage(rest, "tree-pairs"), shingle, percent)
    large = placed.where(F.col("c") > SMALL).drop("c")
    more = more.union(stage(_block_links(texts, large, of_class, shingle, percent, block), "block-links"))
    links = known.select(F.col("node").alias("u"), F.col("component").alias("v")).union(more)
    final = stage(components(links), "components")
    named = classes.select("n", "f1", "f2", "node").join(final, "node", "left").select(
        "n", "f1", "f2", F.coalesce("component", "node").alias("component")
    )
    out = points.select("key", "n", "f1", "f2").join(named, ["n", "f1", "f2"], "left").select(
        "key", "n", F.coalesce("component", "key").alias("component")
    )
    if renamed:
        back = ids.select("key", "id")
        out = out.join(back, "key").join(
            back.select(F.col("key").alias("component"), F.col("id").alias("component_id")), "component"
        )
        return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
    kind = dict(docs.dtypes)[id_col]
    return out.select(
        F.col("key").cast(kind).alias(id_col),
        F.col("n").alias("n_shingles"),
        F.col("component").cast(kind).alias("component_id"),
    )


def similar_sql(shingle: int = SHINGLE, percent: int = PERCENT) -> str:
    k = shingle
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, k FROM (
    SELECT doc_id, array_to_string(w[i:i + {k - 1}], ' ') AS k
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {k - 1}, 1) + 1)) AS i FROM w WHERE len(w) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
e AS (SELECT u, v FROM (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c2
      FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2)
      JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c2 >= {percent} * (x.n + y.n - c2)),
c AS (SELECT doc_id AS u, doc_id AS v FROM w UNION SELECT c.u, e.v FROM c JOIN e ON c.v = e.u)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT u, min(v) AS component_id FROM c GROUP BY 1) m ON m.u = w.doc_id
"""
