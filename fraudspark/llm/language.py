"""Language of a text by its nearest centroid among TF-IDF vectors of character n-grams."""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fraudspark.llm.common import mix64, slices, small_batches

DIMS = 1 << 12
NGRAMS = (1, 2, 3)
SAMPLE = 400
SAMPLE_BYTES = 20_000
CLUSTERS = 3
FLOOR_SHARE = 0.25
LENGTHS, ENOUGH, LEAST_SHARE, MOST_SHARE = 8, 50, 0.8, 0.9
UNKNOWN = "und"
_SPACE = 0x20

_folds: list[np.ndarray] = []


def _fold() -> np.ndarray:
    """Each code point in lower case if it is a letter, else a blank; 0 ends a text."""
    if not _folds:
        t = np.full(0x110000, _SPACE, np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                t[i] = ord(low) if len(low) == 1 else i
        _folds.append(t)
    return _folds[0]


def _grams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text and dimension of each n-gram of letters and word borders, and letters per text."""
    n = len(at) - 1
    codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    heads = np.cumsum((data & 0xC0) != 0x80)
    upto = np.append(0, heads)[at] if len(data) else np.zeros(n + 1, np.int64)
    doc = np.repeat(np.arange(n), np.diff(upto))
    c = _fold()[codes]
    letter = c != _SPACE
    letters = np.bincount(doc[letter], minlength=n)
    same = np.zeros(len(c), bool)
    same[1:] = doc[1:] == doc[:-1]
    keep = letter.copy()
    keep[1:] |= letter[:-1] & same[1:]  # one blank after each run of letters
    c, d = c[keep].astype(np.uint64), doc[keep]
    docs, dims = [], []
    for g in NGRAMS:
        m = len(c) - g + 1
        if m <= 0:
            continue
        ok = d[:m] == d[g - 1 :]
        h = np.full(m, g, np.uint64)
        for j in range(g):
            h = h * np.uint64(0x110000) + c[j : j + m]
        docs.append(d[:m][ok])
        dims.append((mix64(h[ok]) >> np.uint64(52)).astype(np.int64))
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), letters
    return np.concatenate(docs), np.concatenate(dims), letters


def _counts(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(at) - 1
    d, x, letters = _grams(data, at)
    return np.bincount(d * DIMS + x, minlength=n * DIMS).reshape(n, DIMS).astype(np.float32), letters


@dataclass
class Model:
    """Languages, inverse document frequencies, centroids (unit rows) with the language of each,
    and by language and length class the cosine under which a text is too far from all."""

    langs: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    floor: np.ndarray


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _length(counts: np.ndarray) -> np.ndarray:
    """Length class: powers of four of the n-grams of a text."""
    return np.minimum(np.log2(np.maximum(counts.sum(axis=1), 1)) // 2, LENGTHS - 1).astype(np.int64)


def _floors(near: np.ndarray, own: np.ndarray, length: np.ndarray, junk: np.ndarray, junk_length: np.ndarray) -> np.ndarray:
    """Per language and length class, from the cosines of training texts and of texts with shuffled
    letters: what 99 in 100 shuffled texts stay under, but between ``LEAST_SHARE`` and ``MOST_SHARE``
    of what all but one in a hundred training texts reach. A class with fewer than ``ENOUGH`` texts of
    the language takes those of all languages, or else the floor of the next shorter class."""
    out = np.zeros((own.max() + 1, LENGTHS))
    for k in range(len(out)):
        last = FLOOR_SHARE * float(np.quantile(near[own == k], 0.01))
        for c in range(LENGTHS):
            some = near[(own == k) & (length == c)]
            some = some if len(some) >= ENOUGH else near[length == c]
            if len(some) >= ENOUGH:
                real, bad = float(np.quantile(some, 0.01)), junk[junk_length == c]
                top = float(np.quantile(bad, 0.99)) if len(bad) else 0.0
                last = min(max(top, LEAST_SHARE * real), MOST_SHARE * real)
            out[k, c] = last
    return out


def fit(
    counts: np.ndarray, langs: list[str], clusters: int = CLUSTERS, shuffled: np.ndarray | None = None
) -> Model:
    """Clusters each language's vectors by cosine (seeds far from each other, ten rounds)."""
    names = sorted(set(langs))
    own = np.array([names.index(x) for x in langs])
    idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + 1
    x = _unit(np.log1p(counts) * idf)
    cents, owner, reached = [], [], np.zeros(len(x))
    for k in range(len(names)):
        mine = x[own == k]
        at = [0]
        while len(at) < min(clusters, len(mine)):
            at.append(int(np.argmin((mine @ mine[at].T).max(axis=1))))
        c = mine[at]
        for _ in range(10):
            near = np.argmax(mine @ c.T, axis=1)
            c = _unit(np.stack([mine[near == j].sum(axis=0) if (near == j).any() else c[j] for j in range(len(c))]))
        cents.append(c)
        owner += [k] * len(c)
        reached[own == k] = (mine @ c.T).max(axis=1)
    all_cents = np.concatenate(cents)
    bad = np.zeros((0, DIMS), np.float32) if shuffled is None else shuffled
    junk = (_unit(np.log1p(bad) * idf) @ all_cents.T).max(axis=1)
    floor = _floors(reached, own, _length(counts), junk, _length(bad))
    return Model(names, idf, all_cents, np.array(owner), floor)


def shuffled(text: str) -> str:
    """The text with its letters in a seeded other order; all else stays in place."""
    at = [i for i, c in enumerate(text) if c.isalpha()]
    letters = [text[i] for i in at]
    random.Random(len(text)).shuffle(letters)
    out = list(text)
    for i, c in zip(at, letters, strict=True):
        out[i] = c
    return "".join(out)


def _training(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for s in slices(b.column(1), 250_000):
            counts, letters = _counts(s.data, s.at)
            some = np.flatnonzero(letters > 0)
            rows = [counts[i].tobytes() for i in some]
            junk = []
            for i in some:  # one in four, so that what is collected stays small
                raw = s.data[s.at[i] : s.at[i + 1]].tobytes()
                other = None
                if zlib.crc32(raw) % 4 == 0:
                    data = np.frombuffer(shuffled(raw.decode("utf-8", "replace")).encode(), np.uint8)
                    other = _counts(data, np.array([0, len(data)]))[0][0].tobytes()
                junk.append(other)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).slice(s.lo, s.hi - s.lo).take(pa.array(some)),
                    pa.array(rows, pa.binary()),
                    pa.array(junk, pa.binary()),
                ],
                names=["lang", "counts", "shuffled"],
            )


def train(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    sample: int = SAMPLE,
) -> Model | None:
    """Fits on at most ``sample`` labelled texts of each language, first in a seeded order of the
    checksum of their id: rows whose id's checksum is 0 modulo 5 are never among them. Of a longer text the
    first ``SAMPLE_BYTES`` characters are taken, so that the fit has a bound. None if nothing can be learned."""
    labelled = docs.select(
        docs[lang_col].cast("string").alias("lang"),
        F.substring(docs[text_col].cast("string"), 1, SAMPLE_BYTES).alias("text"),
        F.crc32(docs[id_col].cast("string").cast("binary")).alias("crc"),
    ).where("crc % 5 <> 0 AND octet_length(text) > 0")
    labelled = labelled.where("lang IS NOT NULL")
    counted = labelled.groupBy("lang").count().collect()  # a row for each language
    if not counted:
        return None
    share = F.create_map(*[x for r in counted for x in (F.lit(r.lang), F.lit(min(1.0, 4 * sample / r["count"])))])
    mixed = F.xxhash64("crc").bitwiseAND(F.lit((1 << 30) - 1)) / float(1 << 30)
    first = Window.partitionBy("lang").orderBy(F.xxhash64("crc"), "text")
    rows = (
        labelled.where(mixed <= F.element_at(share, F.col("lang")))
        .withColumn("r", F.row_number().over(first))
        .where(F.col("r") <= sample)
        .select("lang", "text")
        .mapInArrow(_training, "lang string, counts binary, shuffled binary")
        .collect()
    )
    if not rows:
        return None
    rows = sorted(rows, key=lambda r: (r.lang, bytes(r.counts)))
    raw = np.frombuffer(b"".join(bytes(r.counts) for r in rows), np.float32)
    bad = np.frombuffer(b"".join(bytes(r.shuffled) for r in rows if r.shuffled), np.float32)
    return fit(raw.reshape(len(rows), DIMS), [r.lang for r in rows], shuffled=bad.reshape(-1, DIMS))


def _predict(m: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score, rejected = [], [], []
            for s in slices(b.column(1), 250_000):
                n = s.hi - s.lo
                for lo in range(0, n, 256):
                    at = s.at[lo : min(lo + 256, n) + 1]
                    counts, letters = _counts(s.data[at[0] : at[-1]], at - at[0])
                    if m is None:
                        lang += [UNKNOWN] * len(letters)
                        score += [0.0] * len(letters)
                        rejected += (letters == 0).tolist()
                        continue
                    cos = _unit(np.log1p(counts) * m.idf) @ m.centroids.T
                    best = np.argmax(cos, axis=1)
                    top = np.clip(cos[np.arange(len(best)), best], 0, 1)
                    own = m.owner[best]
                    known = letters > 0
                    lang += [m.langs[k] if ok else UNKNOWN for k, ok in zip(own, known, strict=True)]
                    score += np.where(known, top, 0.0).tolist()
                    rejected += (~known | (top < m.floor[own, _length(counts)])).tolist()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                names=["id", "lang_pred", "score", "rejected"],
            )

    return run


def understood(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows that are not rejected, all columns kept."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("id"), docs[text_col].cast("string"))
    kind = dict(rows.dtypes)["id"]
    out = rows.mapInArrow(_predict(model), f"id {kind}, lang_pred string, score double, rejected boolean")
    return out.where("NOT rejected").select("id.*")


def languages(
    docs: DataFrame,
    model: Model | None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Language, cosine and rejection of each whole text.

    Letters are lowered, everything else is a word border; runs of 1 to 3 of them are hashed to
    ``DIMS`` dimensions, damped by the logarithm, weighed by inverse document frequency, and the
    text has the language of the nearest of all centroids. ``rejected``: no letter, or farther
    from that centroid than nearly all training texts of about its length (see ``_floors``).
    ``und`` is for null texts and texts without a letter, or when there is no model. Ties go to
    the first language in order. Repeated rows are rows of their own; no shuffle.
    """
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    out = docs.select(docs[id_col].alias("id"), F.col(text_col).cast("string")).mapInArrow(
        _predict(model), f"id {kind}, lang_pred string, score double, rejected boolean"
    )
    held = F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return out.select(F.col("id").alias(id_col), held.alias("held_out"), "lang_pred", "score", "rejected")
