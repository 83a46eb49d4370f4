"""Encoding, whitening and conversation repair against the library, numpy and a shortest path."""

import hashlib
import heapq
import math
import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from fraudspark.llm import bpe, conversations, whitening
from fraudspark.llm.catalog import QUERIES

BLANKS = " \t\n\x0b\x0c\r"
EMPTY = hashlib.sha256(b"").hexdigest()


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


# encoding


def odd_texts():
    r = random.Random(4)
    signs = "aeiouthrnsl  '\n\t.,é漢ö՘\x85 \x1c​0129Ⅷ²😀"
    out = [None, "", " ", "it's we'll I'M", "<|endoftext|>", "a<|endoftext|> b  <|endoftext", "a" * 9000]
    out += [" " * 3000 + "x", "ab" * 4000, "aaab" * 500, "".join(map(chr, range(0x2000, 0x3300))), "\x00nul"]
    out += ["".join(r.choice(signs) for _ in range(r.randint(0, 200))) for _ in range(300)]
    out += ["".join(chr(r.randint(97, 122)) for _ in range(400)) for _ in range(100)]
    return out + out[3:6]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_round_trip_is_the_librarys(spark, library):
    texts = odd_texts()
    rows = [(i if i % 9 else None, t, "x", "y") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded string").repartition(3)
    got = sorted(map(tuple, bpe.round_trip(df).collect()), key=str)
    want = []
    for i, t, _, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha(back.encode())))
    assert got == sorted(want, key=str)


def test_whole_table_decodes_to_itself(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: r for r in QUERIES["op11_bpe_round_trip"](spark, sf_dir).collect()}
    assert len(got) == docs.count()
    for r in docs.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        g = got[r["doc_id"]]
        assert (g["n_tokens"], g["ids_sha256"]) == (len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)))
        assert g["decoded_sha256"] == sha((r["text"] or "").encode())


def test_encoding_keeps_columns_and_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, extra int")
    assert bpe.bpe_encode(empty).dtypes == [("doc_id", "bigint"), ("text", "binary"), ("extra", "int")]
    assert bpe.round_trip(empty).count() == 0
    ids = spark.createDataFrame([(1, None), (2, b"\xff\xff\x00\x00")], "k int, ids binary")
    assert [r["ids"] for r in bpe.bpe_decode(ids, ids_col="ids").orderBy("k").collect()] == ["", ""]
    with pytest.raises(ValueError):
        bpe.Encoder(public_tokenizers.path("word_bpe_49k.json"))


def test_caches_are_no_limit(monkeypatch, library):
    monkeypatch.setattr(bpe, "CACHE", 3)
    e = bpe.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    for t in odd_texts()[12:60]:
        assert list(struct.unpack(f"<{len(x := e.encode(t)) // 4}I", x)) == library.encode(t, add_special_tokens=False).ids


# whitening


def vectors():
    r = np.random.default_rng(2)
    base = r.normal(size=(60, 6)).round(3)
    rows = [(i, [float(v) for v in base[i]]) for i in range(60)]
    rows += [(100 + i, rows[3][1]) for i in range(80)]  # a hot vector
    rows += [(3, rows[5][1]), (None, rows[6][1]), (None, rows[6][1])]
    bad = [None, [], [1.0] * 5, [1.0, None, 0.0, 0.0, 0.0, 0.0], [math.nan] + [0.0] * 5, [math.inf] + [0.0] * 5]
    return rows, [(900 + i, v) for i, v in enumerate(bad)]


@pytest.mark.parametrize("share", [whitening.HOT_SHARE, 2, 10**9])
def test_whitening_is_numpys(spark, monkeypatch, share):
    monkeypatch.setattr(whitening, "HOT_SHARE", share)
    good, bad = vectors()
    rows = [(i, v, 1, 2, "d") for i, v in good + bad]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int, x int, digest string").repartition(4)
    got = whitening.whiten(df, components=4).collect()
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in good])
    n, s = len(x), x.sum(axis=0)
    z = (n * x - s) / n
    cov = z.T @ z / n
    value = np.linalg.eigvalsh(cov)[::-1]
    per_id = defaultdict(list)
    for i, dev in zip([i for i, _ in good], ((n * x - s) ** 2).sum(axis=1).tolist()):
        per_id[i].append(dev)
    found = defaultdict(list)
    for r in got:
        found[r["vec_id"], r["component"]].append(r["deviation"])
        assert r["n"] == n and r["identity_error"] < 1e-9
        assert r["explained"] == pytest.approx(value[r["component"] - 1] / value.sum(), rel=1e-9)
    assert {k: sorted(v) for k, v in found.items()} == {
        (i, c): sorted(d) for i, d in per_id.items() for c in range(1, 5)
    }
    white = defaultdict(dict)
    for r in got:
        if r["vec_id"] is not None and r["vec_id"] != 3:
            white[r["vec_id"]][r["component"]] = r["whitened"]
    _, vec = np.linalg.eigh(cov)
    vec = vec[:, ::-1]
    for c in range(1, 5):
        mine = np.array([white[i][c] for i, _ in good if i in white])
        theirs = (z @ vec[:, c - 1] / math.sqrt(value[c - 1]))[[k for k, (i, _) in enumerate(good) if i in white]]
        assert np.allclose(mine, theirs, atol=1e-9) or np.allclose(mine, -theirs, atol=1e-9)


def test_whitening_without_variance_or_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).collect()
    assert {(r["vec_id"], r["component"], r["whitened"], r["deviation"]) for r in one} == {
        (i, c, None, 0) for i in (1, 2) for c in (1, 2)
    }
    flat = [(i, [float(i), 2.0 * i]) for i in range(5)]
    got = whitening.whiten(spark.createDataFrame(flat, schema)).collect()
    assert all((r["whitened"] is None) == (r["component"] == 2) for r in got)
    assert got[0]["identity_error"] < 1e-9
    big = whitening.whiten(spark.createDataFrame([(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.0, 5.0])], schema))
    assert {r["deviation"] for r in big.where("component = 1 AND vec_id < 3").collect()} == {None}


def test_whitening_of_a_table(spark, sf_dir):
    got = QUERIES["op12_whitening"](spark, sf_dir)
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    assert got.count() == 32 * rows
    assert got.agg({"identity_error": "max"}).first()[0] < 1e-9


# conversations


def cheapest(rows):
    """Shortest path over rows and last role; of equal cost the ASCII-least letters."""
    symbols, seen, counts = [], set(), [0, 0, 0]
    for role, text in rows:
        end = text.rstrip(BLANKS)
        kind = 0 if not end else 1 if (role, text) in seen else 2 if end[-1] not in ".!?" else 3
        if kind < 3:
            counts[kind] += 1
        seen.add((role, text))
        symbols.append((role[:1] if kind > 1 else "-", 3 if kind == 2 else 0))
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, letters, i, last, out = heapq.heappop(heap)
        if (i, last) in done:
            continue
        done.add((i, last))
        if i == len(rows) and last in ("", "a"):
            return counts, cost, letters, out
        c, name = ("a", "assistant") if last == "u" else ("u", "user")
        heapq.heappush(heap, (cost + 3, letters + "I", i, c, (*out, (name, ""))))
        if i < len(rows):
            (kind, cut), (role, text) = symbols[i], rows[i]
            heapq.heappush(heap, (cost + 4, letters + "D", i + 1, last, out))
            if kind != "-":
                heapq.heappush(heap, (cost + 3 + cut, letters + "R", i + 1, c, (*out, (name, text))))
                if (kind, last) in (("s", ""), ("u", ""), ("u", "s"), ("u", "a"), ("a", "u")):
                    heapq.heappush(heap, (cost + cut, letters + "K", i + 1, kind, (*out, (role, text))))


def brute(table):
    groups = defaultdict(list)
    for conv, turn, role, text in table:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(key.encode()) % 20
        groups[conv]
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        groups[conv] += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = {}
    for conv, rows in groups.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        known = {r[0] for r in rows if r[0] is not None}
        gaps = max(known) - min(known) + 1 - len(known) if known else 0
        said = [r[1:] for r in rows]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(said, said[1:]))
        counts, cost, letters, mended = cheapest(said)
        joined = "\n".join(f"{r}:{t}" for r, t in mended)
        out[conv] = (gaps, *counts, illegal, cost, letters, sha(joined.encode()))
    return out


def talk():
    r = random.Random(6)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None]
    texts = ["Yes.", "No!", "Why?", "cut off", "same", " \t\n", "", None, "é漢."]
    rows = []
    for conv in [*range(60), None]:
        n = r.randint(1, 12)
        rows += [(conv, r.choice([t, t, t + 3, None]), r.choice(roles), r.choice(texts) or None) for t in range(n)]
    rows += [(500, t, ["user", "assistant"][t % 2], f"text {t % 90}.") for t in range(300)]  # a long one
    rows += [(501, 7, "user", "again")] * 40  # one row many times
    rows += [(502, None, "system", "one.")]
    dropped = next(i for i in range(600, 900) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    return [*rows, (dropped, 0, "user", "gone.")], dropped


@pytest.mark.parametrize("settings", [{}, {"chunk_rows": 1}, {"chunk_rows": 7, "block": 3}, {"chunk_chars": 60, "block": 1}])
def test_repair_is_the_cheapest(spark, settings):
    rows, dropped = talk()
    named = [(*r, "k", 0) for r in rows]
    df = spark.createDataFrame(named, "conv_id long, turn long, role string, text string, key string, chunk int")
    got = conversations.repaired_conversations(df.repartition(5), **settings)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    found = {r[0]: tuple(r)[1:] for r in got.collect()}
    assert found == brute(rows)
    assert found[dropped] == (0, 0, 0, 0, 0, 0, "", EMPTY)


def test_repair_of_whole_tables(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r[0]: tuple(r)[1:] for r in QUERIES["op13_conversation_repair"](spark, sf_dir).collect()}
    assert got == brute(rows)


def test_repair_gives_the_messages(spark):
    rows = [("c", 1, "assistant", "Hello."), ("c", 2, "assistant", "Cut"), ("c", 3, "user", "Bye.")]
    df = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    (row,) = conversations.repair(df).collect()
    said = [(m["role"], m["text"]) for m in row["messages"]]
    assert (row["cost"], row["audit"], said) == tuple(cheapest([r[2:] for r in rows])[i] for i in (1, 2)) + (
        list(cheapest([r[2:] for r in rows])[3]),
    )
    assert conversations.repair(df.limit(0)).count() == 0
    assert conversations.repaired_conversations(
        spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    ).count() == 0
