"""The corpus operators against plain Python on small tables with nulls, ties, repeats and long texts."""

import base64
import gzip
import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from urllib.parse import quote

import pytest

import corpus_pipeline
from fraudspark.llm import jaccard, language, licenses, mixing, repeats, secrets
from fraudspark.llm.catalog import ORACLES, QUERIES
from fraudspark.llm.decontaminate import contamination
from fraudspark.llm.hosts import host_rules
from fraudspark.llm.sharding import byte_shards
from fraudspark.llm.tokens import token_counts

BLANK = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, size string, id string"


def words(text):
    return BLANK.findall(text or "")


def texts():
    r = random.Random(5)
    vocab = [f"w{i}" for i in range(300)]
    run = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    passage = run(35)
    base = run(120)
    near = base.split()
    near[60] = "other"
    out = [None, "", " \t\n\x0b\x0c\r ", "one", base, base, base, " ".join(near), run(80) + "\n" + passage]
    out += [passage + " " + run(50), "a " * 400, run(3000), "é漢字 ö" * 30, "x\n" * 70, "\x00nul  em"]
    out += [run(r.randint(1, 90)) + "\n" + run(25) for _ in range(12)]
    return out + [base.upper() + " !", passage, passage]


@pytest.fixture(scope="module")
def docs(spark):
    langs = ["en", "de", None]
    rows = [
        (i * 7 % 101, t, langs[i % 3], None if i % 5 == 0 else f"s{i % 2}", None, "k", "s", "i")
        for i, t in enumerate(texts())
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Null and repeated ids, repeated rows."""
    t = texts()
    rows = [(None, t[4]), (None, t[4]), (None, None), (3, t[7]), (3, t[8]), (3, t[8]), (9, t[9])]
    return spark.createDataFrame([(a, b, "en", "s", 1, "k", "s", "i") for a, b in rows], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_every_operator_on_empty_and_odd_tables(spark, empty, odd):
    bench = spark.createDataFrame([(1, None), (None, "a b"), (2, "")], "item_id long, text string")
    for f in (
        token_counts, repeats.repeated_passages, secrets.secret_spans, host_rules, byte_shards,
        mixing.mix, jaccard.similar_documents, licenses.license_report,
        lambda d: language.languages(d, language.train(d)), lambda d: contamination(d, bench),
    ):
        assert f(empty).count() == 0
        assert f(odd).count() == odd.count()


def test_tokens(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = by_id(token_counts(docs))
    extra = ["it's 'tis don'T  \n x", "<|endoftext|>a<|endoftext|>", "ab" * 9000, " " * 5000, "'" * 700]
    for r in docs.collect():
        want = len(t.encode(r.text or "", add_special_tokens=False).ids)
        row = got[r.doc_id]
        assert (row.n_tokens, row.over_limit) == (want, want > 512)
        assert row.n_bytes == len((r.text or "").encode())
    more = docs.sparkSession.createDataFrame(list(enumerate(extra)), "doc_id long, text string")
    assert {k: r.n_tokens for k, r in by_id(token_counts(more)).items()} == {
        i: len(t.encode(x, add_special_tokens=False).ids) for i, x in enumerate(extra)
    }


@pytest.mark.parametrize("group", [500, 1])
def test_repeats(docs, group):
    """Both ways of a group: sorted in memory, and by aggregates alone."""
    rows = sorted((r.doc_id, words(r.text)) for r in docs.collect())
    seen, want = set(), {}
    for i, w in rows:
        gone = set()
        for a in range(len(w) - 19):
            k = tuple(w[a : a + 20])
            if k in seen:
                gone.update(range(a, a + 20))
            seen.add(k)
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        want[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    got = by_id(repeats.repeated_passages(docs, group=group))
    assert {k: (r.n_words, r.n_removed, r.kept_sha256) for k, r in got.items()} == want


def test_secret_layers(spark):
    plain = "x token = 'abcdef123' y"
    inner = base64.b64encode(b"api_key: hunter2hunter2").decode()
    packed = base64.b64encode(gzip.compress(b"secret=" + b"q" * 30)).decode()
    zipped = base64.b64encode(zlib.compress(b"password=letmein99")).decode()
    cases = [
        plain, f"see {inner} ok", quote(quote("passwd=abcdef1")), "\\u0074oken=abcdefg", packed, zipped,
        "token=abc secret=12345", "AKIA" + "A1" * 8, "f" * 24 + " " + "e" * 23, None, "",
        base64.b64encode(inner.encode()).decode(),
    ]
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = by_id(secrets.secret_spans(df))
    s = plain.index("token")
    assert got[0].spans == f"assign:{s}:{plain.index(' y') - 1}" and got[0].n_assign == 1
    assert got[1].spans.startswith("assign:4:") and got[1].n_assign == 0
    assert got[2].spans == f"assign:0:{len(cases[2])}" and got[3].spans == f"assign:0:{len(cases[3])}"
    assert got[4].spans == f"assign:0:{len(packed)}" and got[5].spans == f"assign:0:{len(zipped)}"
    assert got[6].n_assign == 0 and got[7].n_access == 1 and got[8].n_hex == 1
    assert got[9].spans == got[10].spans == "" and got[11].n_layers == 2 and "assign" in got[11].spans
    assert got[0].base_sha256 == hashlib.sha256(got[0].spans.encode()).hexdigest()


def test_secrets_at_every_place():
    run = base64.b64encode(b"password=letmein99!").decode()
    for text in (f"{run}\n{run}", f"{run} x {quote(run)} {run}", f"{run} %70assword=letmein99! {run}"):
        every = {(s, e) for k, s, e in secrets.layered_spans(text)[1]}
        for m in re.finditer(re.escape(run.rstrip("=")), text):
            assert any(m.start() == s and m.end() - 3 <= e <= m.end() for s, e in every), text
    twice = base64.b64encode(run.encode()).decode()
    every = secrets.layered_spans(f"{twice} and {run} and {twice}")[1]
    assert len(every) == 3 and max(s for _, s, _ in every) == len(twice) + len(run) + 10
    assert secrets.layered_spans("%" + "25" * 1500 + "70assword=abcdef1")[1]


@pytest.mark.parametrize(
    "raw", [x + b"password=letmein99 " + y for x in (b"\xc2\xa0", "\u3000".encode(), b"\xef\xbb\xbf", b"\x0c", b"\x00\xff") for y in (b"", b"\xe2\x80\x8b", b"\xfe")]
)
def test_secrets_in_unclean_bytes(raw):
    assert any(k == "assign" for k, *_ in secrets.layered_spans("see " + base64.b64encode(raw).decode())[1])


@pytest.mark.parametrize("head", ["", "auth/", "x-", "key_", "a/b/", "zz_", "blob/v1-"])
@pytest.mark.parametrize("pack", [bytes, gzip.compress, lambda x: zlib.compress(gzip.compress(x)), lambda x: gzip.compress(gzip.compress(x))])
def test_secrets_in_runs_out_of_step(head, pack):
    run = base64.b64encode(pack(b"password=letmein99")).decode()
    every = secrets.layered_spans(f"{head}{run} .")[1]
    assert any(k == "assign" and s < len(head + run) and e >= len(head + run.rstrip("=")) - 1 for k, s, e in every)


@pytest.mark.parametrize("pack", [bytes, gzip.compress, zlib.compress])
@pytest.mark.parametrize("end", ["\n", "\r\n", "\n  "])
def test_secrets_over_line_ends(pack, end):
    r = random.Random(1)
    plain = " ".join(str(r.random()) for _ in range(2)) + " password=letmein" + "9" * 60 + " " + str(r.random())
    run = base64.b64encode(pack(plain.encode())).decode()
    text = "begin: " + end.join(run[i : i + 76] for i in range(0, len(run), 76)) + "\nend of it"
    assert any(k == "assign" and "\n" in text[s:e] for k, s, e in secrets.layered_spans(text)[1])


def test_host_rules(docs):
    got = by_id(host_rules(docs))
    for r in docs.collect():
        t, w = r.text or "", words(r.text)
        grams = Counter(zip(w, w[1:], w[2:]))
        covered = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if BLANK.search(x)]
        row = got[r.doc_id]
        assert row.n_words == len(w) and row.word_chars == sum(map(len, w))
        assert row.n_repeat_words == len(covered) and row.n_dup_lines == len(lines) - len(set(lines))
        assert row.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (row.base_failed and row.kept)


def test_language(spark):
    r = random.Random(2)
    make = {"aa": "abcdef", "zz": "uvwxyz"}
    rows = [
        (i, " ".join("".join(r.choice(make[k]) for _ in range(5)) for _ in range(30)), k)
        for i, k in enumerate(["aa", "zz"] * 60)
    ] + [(900, None, "aa"), (901, "12 !?", "zz"), (902, "漢字" * 40, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = by_id(language.languages(df, language.train(df)))
    assert all(got[i].lang_pred == k and 0 <= got[i].score <= 1 for i, _, k in rows[:120])
    assert not any(got[i].rejected for i, _, _ in rows[:120])
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[902].rejected
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in rows)


def test_language_rejects_junk(spark):
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 0")
    model = language.train(real)
    got = language.languages(real, model).where("held_out AND lang_pred <> 'und'").collect()
    kept = sum(not r.rejected for r in got) / len(got)
    r = random.Random(6)
    long = [(x.doc_id, language.shuffled(x.text)) for x in real.where("length(text) > 400 AND lang <> 'zh'").limit(100).collect()]
    made = [(i, " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(100))) for i in range(50)]
    made += [(i, base64.b64encode(r.randbytes(900)).decode()) for i in range(50, 100)]
    made += [(i, r.randbytes(400).hex()) for i in range(100, 150)]
    rates = []
    for rows in (long, made):
        out = language.languages(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
        rates.append(sum(x.rejected for x in out) / len(out))
    print(f"kept {kept:.4f} of {len(got)}, rejected {rates}")
    assert kept > 0.97 and min(rates) > 0.9


def test_language_learns_from_long_texts(spark):
    rows = [(i, "abc def " * 4000 if k == "aa" else "uvw xyz " * 9, k) for i, k in enumerate(["aa", "zz"] * 20)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.langs == ["aa", "zz"]


def test_licenses(spark):
    rows = [
        (1, "intro\nReleased under the MIT License.\nbody"), (2, "Licensed under CC BY-NC 4.0."),
        (3, "This work is licensed under the GNU General Public License, version 3."),
        (4, "my driver's license expired"), (5, None), (6, "Licensed under the Apache License, Version 2.0.\nReleased under the MIT License."),
    ]
    got = by_id(licenses.license_report(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [got[i].families for i in range(1, 7)] == ["MIT", "CC-BY-NC", "GPL", "", "", "Apache,MIT"]


def test_shards(docs):
    rows = byte_shards(docs, shards=4).collect()
    text = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    total, at = sum(len(t) + 1 for t in text.values()), 0
    slots = defaultdict(list)
    for r in sorted(rows, key=lambda r: r.doc_id):
        size = len(text[r.doc_id]) + 1
        assert (r.size, r.text_crc32) == (size, zlib.crc32(text[r.doc_id]))
        assert r.shard == (2 * at + size) * 4 // (2 * total)
        at += size
        slots[r.shard].append(r.slot)
    assert all(v == list(range(len(v))) for v in slots.values())


def test_mix(docs):
    rows, again = by_id(mixing.mix(docs)), by_id(mixing.mix(docs.repartition(5)))
    assert rows == again
    source = {r.doc_id: r.source for r in docs.collect()}
    size = Counter()
    for k, r in rows.items():
        size[source[k]] += r["size"]
    names = sorted(size, key=lambda x: (x is None, x or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    left, open_, target = sum(size.values()), set(names), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if unit * weight[s] > 3 * size[s]}
        for s in over or open_:
            target[s] = 3.0 * size[s] if over else unit * weight[s]
        left -= sum(target[s] for s in over)
        open_ = open_ - over if over else set()
    taken = Counter()
    for k, r in rows.items():
        assert r.source_size == size[source[k]] and abs(r.target - target[source[k]]) < 1e-6 * (1 + r.target)
        assert 0 <= r.taken <= 3 * r["size"]
        taken[source[k]] += r.taken
    assert all(abs(taken[s] - target[s]) <= 2 for s in names)


def test_highest_quotients(spark):
    goal = spark.createDataFrame([("a", 53, 53.0), ("b", 24, 24.0), ("c", 23, 23.0)], "source string, source_size long, target double")
    got = mixing.block_quotas(goal.selectExpr("*", "100L AS total"), blocks=10).collect()
    # by hand: 53, 24, 23, 17.7, 10.6, 8, 7.7, 7.6, 5.9, and 53 / 11 = 4.82 before 24 / 5 = 4.80
    assert {r.source: r.quota for r in got} == {"a": 6, "b": 2, "c": 2}
    split = mixing.shard_quotas(mixing.block_quotas(goal.selectExpr("*", "100L AS total"), blocks=10), 4)
    assert {r.source: r.q for r in split.groupBy("source").agg({"quota": "sum"}).toDF("source", "q").collect()} == {"a": 6, "b": 2, "c": 2}


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80)])
def test_similar(docs, k, percent):
    sets = {}
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for r in docs.collect():
        w = words((r.text or "").translate(low))
        sets[r.doc_id] = {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= percent * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    got = by_id(jaccard.similar_documents(docs, k, percent))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == {i: (len(sets[i]), root[i]) for i in sets}


def test_tree_finds_all_pairs():
    import numpy as np

    r = np.random.default_rng(1)
    base = r.integers(0, 6, (12, 32))
    vec = np.concatenate([np.maximum(base + r.integers(-1, 2, base.shape), 0) for _ in range(9)]).astype(np.uint16)
    n = vec.sum(axis=1).astype(np.int64)
    comp = np.arange(len(n))
    a, b = jaccard.tree_join(n, vec, comp, 85)
    want = {
        (i, j) for i in range(len(n)) for j in range(i + 1, len(n))
        if 185 * np.minimum(vec[i], vec[j]).sum() >= 85 * (n[i] + n[j])
    }
    assert want <= {(min(x), max(x)) for x in zip(a.tolist(), b.tolist())}


def test_tree_stops_at_boxes_of_one_component(monkeypatch):
    import numpy as np

    r = np.random.default_rng(3)
    n, work, real = 6000, [0], jaccard._overlap
    vec = np.repeat(r.integers(0, 4, (1, 32)), n, axis=0).astype(np.uint16)
    vec[1::7, 5] += 1
    size = vec.sum(axis=1).astype(np.int64)
    comp = np.zeros(n, np.int64)
    comp[4321] = 9

    def counted(a, b):
        work[0] += len(a)
        return real(a, b)

    monkeypatch.setattr(jaccard, "_overlap", counted)
    a, b = jaccard.tree_join(size, vec, comp, 85)
    assert len(a) == n - 1 and all(4321 in p for p in zip(a.tolist(), b.tolist()))
    assert work[0] < 10 * n
    side = (np.arange(n) >= 4000).astype(np.int64)
    a, b = jaccard.tree_join(size, vec, comp, 85, side)
    assert len(a) == 4000 and all(side[a] != side[b])


def test_large_blocks_go_in_tiles(spark):
    r = random.Random(4)
    rows = [(1, i, r.choice([40, 44, 50, 85, 100]), 7 if i < 120 else i) for i in range(300)]
    rows += [(2, i, 10, i) for i in range(20)]
    size = Counter(t for t, *_ in rows)
    df = spark.createDataFrame([(*x, size[x[0]]) for x in rows], "token long, f1 long, n long, comp long, c long")
    jobs = defaultdict(list)
    for j in jaccard.block_jobs(df, 85, block=30).collect():
        jobs[j.token, j.x, j.y].append((j.f1, j.tile))
    assert max(map(len, jobs.values())) <= 120 and len(jobs) > 20
    met = set()
    for (t, x, y), found in jobs.items():
        met |= {(t, a, b) for a, s in found for b, u in found if a < b and (x == y or s != u)}
    for t, a, n, p in rows:
        for u, b, m, q in rows:
            if t == u and a < b and p != q and 100 * min(n, m) >= 85 * max(n, m):
                assert (t, a, b) in met
    assert not any(all(a < 120 for a, _ in found) for (t, *_), found in jobs.items() if t == 1)


def test_similar_in_small_tiles(docs):
    want = {i: r.component_id for i, r in by_id(jaccard.similar_documents(docs, 4, 85)).items()}
    r = random.Random(8)
    head = " ".join(f"h{i}" for i in range(40))
    rows = [(1000 + i, head + " " + " ".join(r.choice("abcdefg") + str(r.randint(0, 99)) for _ in range(8 + i % 3))) for i in range(60)]
    more = docs.select("doc_id", "text").union(docs.sparkSession.createDataFrame(rows, "doc_id long, text string"))
    got = by_id(jaccard.similar_documents(more, 4, 85, block=3))
    assert {i: got[i].component_id for i in want} == want
    assert {i: x.component_id for i, x in got.items()} == {
        i: x.component_id for i, x in by_id(jaccard.similar_documents(more, 4, 85)).items()
    }


@pytest.mark.parametrize("block_bytes", [8_000_000, 200])
def test_contamination(spark, docs, block_bytes):
    t = [x for x in texts() if x]
    items = [(1, " ".join(words(t[3])[5:30]).upper()), (2, "one"), (11, t[-1]), (5, None), (7, "?!"), (8, t[-1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = lambda x: word.findall((x or "").translate(low))
    wins = defaultdict(set)
    for i, x in items:
        w = split(x)
        n = min(10, len(w))
        for a in range(len(w) - n + 1 if n else 0):
            wins[tuple(w[a : a + n])].add(str(i))
    got = by_id(contamination(docs, bench, block_bytes=block_bytes))
    for r in docs.collect():
        w, hit, found = split(r.text), set(), set()
        for n in {len(x) for x in wins}:
            for a in range(len(w) - n + 1):
                if (k := tuple(w[a : a + n])) in wins:
                    hit.update(range(a, a + n))
                    found |= wins[k]
        row = got[r.doc_id]
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        assert (row.n_words, row.n_hit, row.n_items, row.items_sha256) == (len(w), len(hit), len(found), digest)
        assert row.contaminated == bool(hit)


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for name, f in corpus_pipeline.STAGES:
        before = docs.count()
        docs = corpus_pipeline.stage(f(spark, docs, sf_dir), name)
        if name != "sharded":
            assert docs.columns == columns
        if name in ("language", "near_duplicates", "decontaminated"):
            assert docs.count() <= before and docs.count() == docs.select("doc_id").distinct().count()
    assert docs.select("shard").distinct().count() == 16


def test_pipeline_stages_on_odd_rows(spark, odd, sf_dir):
    docs = odd
    for _, f in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stage(f(spark, docs, sf_dir), "odd")
    docs.count()


def test_names():
    assert {int(re.match(r"op(\d+)_", k)[1]) for k in QUERIES if k.startswith("op")} == set(range(1, 11))
    assert set(ORACLES) <= set(QUERIES)


def thue_morse(n):
    """The two words of ``n`` letters whose sums of powers agree modulo 2^64, whatever the base."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_words_that_powers_confuse(spark):
    x, y = thue_morse(1024)
    rest = " ".join(f"w{i}" for i in range(25))
    df = spark.createDataFrame([(1, f"{x} {rest}"), (2, f"{y} {rest[3:]} z"), (3, x), (4, y)], "doc_id long, text string")
    sets = by_id(jaccard.similar_documents(df.where("doc_id > 2"), 4, 85))
    assert {i: r.component_id for i, r in sets.items()} == {3: 3, 4: 4}
    long_x, long_y = thue_morse(2048)
    run = [f"v{i}" for i in range(25)]
    df = spark.createDataFrame(
        [(1, " ".join([long_x if i % 5 == 0 else w for i, w in enumerate(run)])),
         (2, " ".join([long_y if i % 5 == 0 else w for i, w in enumerate(run)]))], "doc_id long, text string"
    )
    assert by_id(repeats.repeated_passages(df))[2].n_removed == 0


def test_windows_longer_than_the_marks(spark):
    words_ = [f"w{i}" for i in range(300)]
    df = spark.createDataFrame([(1, " ".join(words_)), (2, " ".join(["x", *words_, "y"]))], "doc_id long, text string")
    got = by_id(repeats.repeated_passages(df, window=100))
    assert (got[1].n_removed, got[2].n_removed) == (0, 300)


@pytest.mark.parametrize("small,block", [(48, 1024), (2, 1024), (2, 5), (2, 1)])
def test_families_under_and_over_the_threshold(spark, monkeypatch, small, block):
    """Copies with every tenth or so word changed: many pairs lie just under 0.85, some over."""
    monkeypatch.setattr(jaccard, "SMALL", small)
    r = random.Random(11)
    texts = []
    for _ in range(3):
        base = [f"w{r.randrange(900)}" for _ in range(160)]
        for _ in range(30):
            copy = list(base)
            for i in r.sample(range(160), r.choice([1, 1, 2, 3])):
                copy[i] = f"n{r.randrange(10**6)}"
            texts.append(" ".join(copy))
    sets = [{tuple(w[i : i + 4]) for i in range(len(w) - 3)} for w in map(str.split, texts)]
    comp = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 100 * len(a & b) >= 85 * len(a | b) and comp[i] != comp[j]:
                old, new = max(comp[i], comp[j]), min(comp[i], comp[j])
                comp = [new if c == old else c for c in comp]
    assert 10 < len(set(comp)) < 85
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = by_id(jaccard.similar_documents(df, 4, 85, block=block))
    assert [got[i].component_id for i in range(len(texts))] == comp


def test_sets_go_with_rows_of_a_pair_over_the_bound_only(spark, monkeypatch):
    """120 texts share a passage, which makes large blocks, and are else apart but for one pair."""
    r = random.Random(3)
    passage = " ".join(f"p{i}" for i in range(20))
    texts = [passage + " " + " ".join(f"n{r.randrange(10**6)}" for _ in range(40)) for _ in range(120)]
    texts.append(texts[50] + " other")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = {}

    def counted(table, name, real=jaccard.stage):
        out = real(table, name)
        rows[name] = rows.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(jaccard, "stage", counted)
    monkeypatch.setattr(jaccard, "OFTEN", 10**6)  # else the passage is no block, as all have it
    got = by_id(jaccard.similar_documents(df, 4, 85))
    assert rows["block-jobs"] > 100
    assert rows["large-sets"] <= 4
    assert [got[i].component_id for i in range(121)] == [*range(120), 50]


def test_licences_of_rows_that_share_an_id(spark):
    mit, apache = "Licensed under the MIT License.", "Licensed under the Apache License, Version 2.0."
    rows = [(1, mit), (1, apache), (None, "a plain text"), (None, mit)]
    got = licenses.license_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    of_one = {r.families for r in got if r.doc_id == 1}
    of_none = {r.families for r in got if r.doc_id is None}
    assert len(of_one) == 2 and len(of_none) == 2 and "" in of_none and (of_one & of_none) - {""}


def test_licences_by_paragraph(spark):
    """Bodies without a cue word, wrapped, unknown, denied and joint notices; and the scores of all
    windows by brute force."""
    mit = "Copyright (c) 2020 J\n\n" + licenses.BODIES["MIT"][0].replace(", ", ",\n") + "\n \nend"
    cases = [
        (mit, "MIT"), ("x\n\n# " + licenses.BODIES["BSD"][0].replace(" with", "\n# with"), "BSD"),
        (licenses.BODIES["MIT"][2], "MIT"), ("Released under the\nMIT License", "MIT"),
        ("Eclipse Public License 2.0", "unknown"), ("Unlicense", "unknown"), ("zlib License", "unknown"),
        ("Licensed under the Frobnicate Public License 1.1", "unknown"),
        ("governed by a BSD-style license", "BSD"), ("not licensed under the MIT License", ""),
        ("Apache License, Version 2.0 or the MIT license", "Apache,MIT"),
        ("word " * 300 + "released under the MIT License " + "word " * 500 + "of the Mozilla Public License", "MIT,MPL"),
        ("GNU Lesser General Public License", "LGPL"), ("Mit der Lizenz geht es. The cat sat.", ""), ("", ""), (None, ""),
    ]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    model = licenses.train(docs)
    got = by_id(licenses.license_report(docs, model=model))
    assert [got[i].families for i in range(len(cases))] == [f for _, f in cases]

    weights, number = model.fit.coefficientMatrix.toArray(), {g: j for j, g in enumerate(model.vectors.vocabulary)}
    words_of = lambda t: re.findall("[a-z0-9]+", t.lower())
    grams = lambda w: {" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)}
    parts = lambda w: {g for g in grams(w) if " " in g} or set(w)
    cut = lambda w: [w[i : i + 60] for i in range(0, max(len(w) - 20, 1), 40)] if len(w) > 60 else [w]
    names = [(f, parts(words_of(n))) for f, x in licenses.FAMILIES.items() for n in x]
    names += [
        (f, parts(w))
        for f in licenses.UNNAMED for b in licenses.BODIES[f]
        for s in re.split(r"[.!?]\s+", b) for w in cut(words_of(s))
    ]
    want = {}
    for i, (text, _) in enumerate(cases):
        for p, block in enumerate(re.split(r"\n\s*\n", text or "")):
            for j, sentence in enumerate(re.split(r"[.!?]\s+", block)):
                for window in cut(words_of(sentence)):
                    have = grams(window)
                    raw = model.fit.interceptVector.toArray() + sum(weights[:, number[g]] for g in have if g in number)
                    e = [math.exp(x / model.temperature) for x in raw]
                    if e[model.classes.index("none")] > 0.5 * sum(e):
                        continue
                    for family, x in zip(model.classes, e, strict=True):
                        shared = max([len(t & have) / len(t) for f, t in names if f == family], default=0)
                        if x / sum(e) >= 0.1 and shared >= 0.5:
                            key = (i, p, j, family)
                            old = want.get(key, (0, 0))
                            want[key] = (max(old[0], x / sum(e)), max(old[1], shared))
    found = licenses.license_paragraphs(docs, model=model).collect()
    assert {(r.doc_id, r.paragraph, r.sentence, r.family) for r in found} == set(want)
    for r in found:
        assert (r.probability, r.shared) == pytest.approx(want[r.doc_id, r.paragraph, r.sentence, r.family], abs=1e-9)


def test_secret_scan_is_linear_in_odd_texts():
    """A long run with a line end, chains of escapes and a bomb: each in seconds."""
    r = random.Random(3)
    letters = "ABCDEFabcdef0123456789xyzXYZ+/"
    begun = time.monotonic()
    assert secrets.layered_spans("x\n" + "".join(r.choice(letters) for _ in range(10**6)) + "!\n")[0] is not None
    for chain in ("%" + "25" * 300_000 + "70assword=hunter2secret", "\\" + "u005c" * 100_000 + "u0070assword=hunter2secret"):
        kinds = {k for k, _, _ in secrets.layered_spans(chain)[1]}
        assert "assign" in kinds
    bomb = base64.b64encode(zlib.compress(b"\0" * 100_000_000 + b"password=hunter22", 9)).decode()
    ((kind, start, end),) = secrets.layered_spans(f"q {bomb} q")[1]
    assert (kind, start, end) == ("assign", 2, 2 + len(bomb))
    assert time.monotonic() - begun < 60


def test_runs_over_line_ends():
    """Found by a look at each line, as by a pattern that tries every place."""
    wrapped = re.compile(
        r"[A-Za-z0-9+/_-]{16,}(?:[ \t]*\r?\n[ \t]*[A-Za-z0-9+/_-]+(?=={0,2}[ \t]*(?:\r?\n|\Z)))+"
    )
    r = random.Random(5)
    parts = ["A" * 16, "A", "b", "=", "\n", "\r\n", " ", "\t", "\r", "!", "Q" * 5]
    for _ in range(4000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 14)))
        found = [(int(p[0]), int(p[-1]) + 1) for p, _ in secrets._wrapped(text)]
        assert found == [m.span() for m in wrapped.finditer(text)]
