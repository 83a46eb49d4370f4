"""Token counts of byte-level BPE by a finite-state transducer that is compiled as texts need it.

One deterministic machine reads the bytes of a text, each with the class of its character, and
every transition carries how many tokens more the text has after it. It is made of two parts:

* the splitter, which cuts a text into pieces as the vocabulary's pattern does (contractions,
  optional space with letters, digits or other signs, blanks). Its state is the kind of piece that
  is open and the bytes that cannot be placed yet: the last blank, an apostrophe;
* the merger, which knows the last token of the encoding of each prefix of the open piece. The
  encoding of a longer prefix ends in the one token whose neighbour to the left is compatible with
  it: two tokens are, if encoding their joined bytes gives just these two. Only the prefixes that a
  coming token may still start from are kept, so there are finitely many states.

Texts are cut into chunks. A chunk's map takes an entry state to an exit state and a count. Each
chunk starts from a guess (the state that the bytes just before it lead to), then from every exit
of the chunk before it that its map lacks, until all maps are closed; all (chunk, entry) pairs
advance in step, one byte at a time. The maps compose by pointer jumping, a parallel prefix scan.
"""

from __future__ import annotations

import json
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraudspark.llm.common import Slice, slices, small_batches

CHUNK = 512
WARM = 48
LETTER, DIGIT, OTHER, BLANK, MORE, SPECIAL = range(6)
START, IN_LETTERS, IN_DIGITS, IN_OTHER, IN_BLANKS, QUOTE = range(6)
OPEN = {LETTER: IN_LETTERS, DIGIT: IN_DIGITS, OTHER: IN_OTHER}
#: What may follow an apostrophe in a contraction.
ENDINGS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")
EMPTY = (b"", (((), 0),))
MAX_CELLS = 34_000_000
NEVER = 1 << 60


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if it is printable
    in Latin-1, else the next code point from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Transducer:
    """Transition tables, grown by the states and symbols met. When they are over their size, the
    machine starts over: tables are a cache, never a limit."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda t: bytes(letters[c] for c in t)
        self.special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        own = {t["content"] for t in spec["added_tokens"]}
        self.ids = {raw(t): i for t, i in spec["model"]["vocab"].items() if t not in own}
        self.ranks: dict[tuple[bytes, bytes], int] = {}
        for i, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.ranks[raw(a), raw(b)] = i
        self.bytes_of = {i: t for t, i in self.ids.items()}
        self.heads = {t[:n] for t in self.ids for n in range(len(t))}
        self.split = Tokenizer.from_file(path).pre_tokenizer
        self.parts = {a + b: (a, b, rank) for (a, b), rank in self.ranks.items()}
        self.after: dict[tuple[bytes, bytes], list[int]] = {}
        self.meets: dict[tuple[bytes, bytes], int] = {}
        for (a, b), rank in self.ranks.items():
            self.meets[a, b] = when = max(rank, self.made(b))
            for n in range(len(b) + 1):
                self.after.setdefault((a, b[:n]), []).append(when)
        for times in self.after.values():
            times.sort()
        self.edges: dict[tuple, tuple] = {}
        self.pairs: dict[tuple[tuple, bytes], bool] = {}
        self.classes = np.full(0x110000, 255, np.uint8)
        self.reset()

    def reset(self) -> None:
        self.states: list[tuple] = []
        self.known: dict[tuple, int] = {}
        self.symbols: list[tuple[int, int]] = []
        self.symbol_of = np.full(6 * 256, -1, np.int32)
        self.width, self.height = 64, 1024
        self.next = np.full((self.height, self.width), -1, np.int32)
        self.gain = np.zeros((self.height, self.width), np.int16)
        self.last = np.full(self.height, -1, np.int32)
        self.number((START, b"", EMPTY))

    def number(self, state: tuple) -> int:
        n = self.known.get(state)
        if n is None:
            n = self.known[state] = len(self.states)
            self.states.append(state)
            if n == self.height:
                self.next = np.concatenate([self.next, np.full_like(self.next, -1)])
                self.gain = np.concatenate([self.gain, np.zeros_like(self.gain)])
                self.last = np.concatenate([self.last, np.full_like(self.last, -1)])
                self.height *= 2
            self.last[n] = self.finish(state)
        return n

    # the merger

    def encode(self, piece: bytes) -> list[bytes]:
        """Byte pair merges of a short piece, lowest rank first."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            ranked = [(self.ranks.get(p, 1 << 60), i) for i, p in enumerate(zip(parts, parts[1:]))]
            rank, i = min(ranked)
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def made(self, token: bytes) -> int:
        part = self.parts.get(token)
        return part[2] if part else -1

    def spine(self, token: bytes, side: int) -> tuple:
        """What stands at one border of a token while it is put together, each with the merge that
        takes it up."""
        out, taken = [(token, NEVER)], NEVER
        while part := self.parts.get(token):
            token, taken = part[side], part[2]
            out.append((token, taken))
        return tuple(out)

    def edge(self, spine: tuple, begun: bytes) -> tuple:
        """Of a right border, what could still merge with a token that starts with ``begun``, each
        with the last time at which it does. Nothing else of the last token matters, which keeps
        states few."""
        key = (spine, begun)
        out = self.edges.get(key)
        if out is None:
            left = []
            for x, taken in spine:
                times = self.after.get((x, begun), ())
                when = [*times[: bisect_left(times, taken)][-1:]]
                for n in range(1, len(begun)):
                    t = self.meets.get((x, begun[:n]), NEVER)
                    when += [t] if t < taken else []
                if when:
                    left.append((x, max(when) + 1))
            out = self.edges[key] = tuple(left)
        return out

    def fits(self, edge: tuple, token: bytes) -> bool:
        """Whether a token can stand at a border: no merge across it comes while both of its sides
        exist; of equal merges the left one goes first."""
        ok = self.pairs.get((edge, token))
        if ok is None:
            ok = self.encode(token) == [token]
            for x, x_taken in edge:
                for y, y_taken in self.spine(token, 0):
                    when = self.meets.get((x, y), NEVER)
                    if when < x_taken and max(self.ranks[x, y], self.made(x)) <= y_taken:
                        ok = False
            self.pairs[edge, token] = ok
        return ok

    def feed(self, piece: tuple, more: bytes) -> tuple[tuple, int]:
        """Reads bytes into an open piece. Its state is the longest end of the piece that a longer
        token can start with, and for each place in it where one can, the border to its left and
        the tokens so far, counted from the present place."""
        end, marks = piece
        gained = 0
        for i in range(len(more)):
            end = end + more[i : i + 1]
            n = len(end)
            for k in range(n, 0, -1):
                mark, token = marks[-k], end[n - k :]
                if mark and token in self.ids and self.fits(mark[0], token):
                    step = mark[1] + 1
                    break
            else:
                raise ValueError("a byte without a token")
            gained += step
            j = next((j for j in range(n) if end[j:] in self.heads), n)
            kept = []
            for i_mark, m in enumerate(marks[len(marks) - n + j :], j):
                begun = end[i_mark:]
                ok = m and begun in self.heads
                kept.append((self.edge(m[0], begun), m[1] - step) if ok else None)
            kept.append((self.edge(self.spine(token, 1), b""), 0))
            end, marks = end[j:], tuple(kept)
        return (end, marks), gained

    # the splitter

    def step(self, state: tuple, kind: int, byte: int) -> tuple[tuple, int]:
        mode, held, piece = state
        b = bytes((byte,))
        if kind == SPECIAL:
            return (START, b"", EMPTY), self.finish(state) + 1
        if kind == MORE:  # a further byte of the last character
            if mode == IN_BLANKS:
                return (mode, held + b, piece), 0
            piece, n = self.feed(piece, b)
            return (mode, held, piece), n
        if mode == IN_BLANKS:
            if kind == BLANK:
                piece, n = self.feed(piece, held)
                return (mode, b, piece), n
            piece, n = self.feed(EMPTY, held)
            if held == b" ":
                piece, m = self.feed(piece, b)
                return (OPEN[kind], b"", piece), n + m
            state, m = self.step((START, b"", EMPTY), kind, byte)
            return state, n + m
        if mode == QUOTE:
            text = held + b
            if kind == LETTER and text[1:] in ENDINGS:
                return (START, b"", EMPTY), self.feed(EMPTY, text)[1]
            if kind == LETTER and any(e.startswith(text[1:]) for e in ENDINGS):
                return (mode, text, EMPTY), 0
            piece, n = self.feed(EMPTY, held[:1])
            state = (IN_OTHER, b"", piece)
            for c in held[1:]:
                state, m = self.step(state, LETTER, c)
                n += m
            state, m = self.step(state, kind, byte)
            return state, n + m
        if kind == BLANK:
            return (IN_BLANKS, b, EMPTY), 0
        if mode == OPEN[kind]:
            piece, n = self.feed(piece, b)
            return (mode, b"", piece), n
        if kind == OTHER and b == b"'":
            return (QUOTE, b, EMPTY), 0
        piece, n = self.feed(EMPTY, b)
        return (OPEN[kind], b"", piece), n

    def finish(self, state: tuple) -> int:
        """Tokens that the end of the text adds."""
        mode, held, piece = state
        if mode == QUOTE:
            n = self.feed(EMPTY, held[:1])[1]
            return n + (self.feed(EMPTY, held[1:])[1] if held[1:] else 0)
        return self.feed(piece, held)[1] if held else 0

    # symbols

    def class_of(self, code: int) -> int:
        """A character's class, asked of the library's own splitter."""
        c = chr(code)
        for kind, probe in ((LETTER, "a"), (DIGIT, "1"), (OTHER, "!")):
            if len(self.split.pre_tokenize_str(probe + c)) == 1:
                return kind
        return BLANK

    def read(self, data: np.ndarray) -> np.ndarray:
        """Symbol of each byte."""
        kind = np.full(len(data), MORE, np.uint8)
        head = (data & 0xC0) != 0x80
        codes = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        found = self.classes[codes]
        if (found == 255).any():
            for code in np.unique(codes[found == 255]).tolist():
                self.classes[code] = self.class_of(code)
            found = self.classes[codes]
        kind[head] = found
        return kind.astype(np.int32) * 256 + data

    def ensure(self, cells: np.ndarray) -> np.ndarray:
        """Symbols as columns of the tables."""
        out = self.symbol_of[cells]
        if (out < 0).any():
            for cell in np.unique(cells[out < 0]).tolist():
                self.symbol_of[cell] = len(self.symbols)
                self.symbols.append((cell // 256, cell % 256))
            while len(self.symbols) > self.width:
                self.next = np.concatenate([self.next, np.full_like(self.next, -1)], axis=1)
                self.gain = np.concatenate([self.gain, np.zeros_like(self.gain)], axis=1)
                self.width *= 2
            out = self.symbol_of[cells]
        return out

    def compile(self, states: np.ndarray, columns: np.ndarray) -> None:
        for pair in np.unique(states.astype(np.int64) * self.width + columns).tolist():
            s, c = divmod(pair, self.width)
            if self.next[s, c] < 0:
                to, gain = self.step(self.states[s], *self.symbols[c])
                to = self.number(to)
                self.next[s, c], self.gain[s, c] = to, gain

    def advance(self, rows: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs all ``rows`` (columns of symbols, -1 after the end; longest first) in step."""
        state, count = state.copy(), np.zeros(len(state), np.int64)
        live = (rows >= 0).sum(axis=0)
        upto = np.searchsorted(-live, -np.arange(1, rows.shape[0] + 1), "right")
        for j in range(rows.shape[0]):
            n = upto[j]
            if not n:
                break
            s, c = state[:n], rows[j, :n]
            cell = s * self.width + c
            to = self.next.ravel()[cell]
            if (to < 0).any():
                self.compile(s[to < 0], c[to < 0])
                cell = s * self.width + c
                to = self.next.ravel()[cell]
            count[:n] += self.gain.ravel()[cell]
            state[:n] = to
        return state, count

    # chunk maps

    def _ends(self, s: Slice) -> tuple[np.ndarray, np.ndarray]:
        """The slice's symbols, special strings as one symbol each, and the texts' bounds."""
        if not any(t.encode() in s.data.tobytes() for t in self.special):
            return self.read(s.data), s.at
        parts, at = [], [0]
        for a, b in zip(s.at[:-1], s.at[1:], strict=True):
            raw, pieces, i = s.data[a:b].tobytes(), [], 0
            while True:
                hits = [(raw.find(t.encode(), i), -len(t.encode())) for t in self.special]
                hits = [h for h in hits if h[0] >= 0]
                k, size = min(hits, default=(len(raw), 0))
                pieces.append(self.read(np.frombuffer(raw[i:k], np.uint8)))
                if not hits:
                    break
                pieces.append(np.array([SPECIAL * 256], np.int32))
                i = k - size
            parts += pieces
            at.append(at[-1] + sum(map(len, pieces)))
        return np.concatenate(parts), np.array(at)

    def count(self, s: Slice) -> np.ndarray:
        if self.next.size > MAX_CELLS:
            self.reset()
        symbols, at = self._ends(s)
        symbols = self.ensure(symbols)
        size = np.diff(at)
        n_chunks = -(-size // CHUNK)
        first = np.cumsum(n_chunks) - n_chunks
        total = int(n_chunks.sum())
        out = np.zeros(len(size), np.int64)
        if not total:
            return out
        text = np.repeat(np.arange(len(size)), n_chunks)
        begin = at[text] + (np.arange(total) - first[text]) * CHUNK
        length = np.minimum(CHUNK, at[text + 1] - begin)
        heads = begin == at[text]

        def block(which: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
            place = start[None, :] + np.arange(n.max())[:, None]
            inside = np.arange(n.max())[:, None] < n[None, :]
            return np.where(inside, symbols[np.minimum(place, len(symbols) - 1)], -1)

        entry = np.zeros(total, np.int64)
        later = np.flatnonzero(~heads)
        if len(later):
            warm = np.full(len(later), WARM)
            rows = block(later, begin[later] - WARM, warm)
            entry[later] = self.advance(rows, np.zeros(len(later), np.int64))[0]
        pair_of: dict[tuple[int, int], int] = {}
        chunks, entries = np.arange(total), entry
        all_chunk, all_exit, all_count = [], [], []
        made = 0
        while len(chunks):
            order = np.argsort(-length[chunks], kind="stable")
            chunks, entries = chunks[order], entries[order]
            exits, counts = self.advance(block(chunks, begin[chunks], length[chunks]), entries)
            for k, (c, e) in enumerate(zip(chunks.tolist(), entries.tolist(), strict=True)):
                pair_of[c, e] = made + k
            made += len(chunks)
            all_chunk.append(chunks)
            all_exit.append(exits)
            all_count.append(counts)
            inner = np.flatnonzero((chunks + 1 < total) & ~heads[np.minimum(chunks + 1, total - 1)])
            wanted = set(zip((chunks[inner] + 1).tolist(), exits[inner].tolist(), strict=True))
            lacking = sorted(wanted - pair_of.keys())
            chunks = np.array([c for c, _ in lacking], np.int64)
            entries = np.array([e for _, e in lacking], np.int64)
        chunk, leave = np.concatenate(all_chunk), np.concatenate(all_exit)
        gained = np.concatenate(all_count)
        ends = (chunk + 1 == total) | heads[np.minimum(chunk + 1, total - 1)]
        gained = gained + np.where(ends, self.last[leave], 0)
        onward = np.array(
            [-1 if e else pair_of[c + 1, x] for c, x, e in zip(chunk.tolist(), leave.tolist(), ends.tolist(), strict=True)]
        )
        while (onward >= 0).any():  # maps of 1, 2, 4, ... chunks
            go = np.flatnonzero(onward >= 0)
            to = onward[go]
            gained[go] += gained[to]
            onward[go] = onward[to]
        some = np.flatnonzero(n_chunks > 0)
        out[some] = gained[[pair_of[c, 0] for c in first[some].tolist()]]
        return out


_machines: dict[str, Transducer] = {}


def machine(path: str) -> Transducer:
    """One per worker process; it keeps what it has compiled."""
    if path not in _machines:
        _machines[path] = Transducer(path)
    return _machines[path]


def _counter(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        m = machine(public_tokenizers.path(vocabulary))
        for b in batches:
            counts = [m.count(s) for s in slices(b.column(1))]
            n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            size = pc.fill_null(pc.binary_length(b.column(1)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), size, pa.array(n)], names=["id", "n_bytes", "n_tokens"]
            )

    return run


def token_counts(
    docs: DataFrame,
    vocabulary: str = "byte_bpe_50k.json",
    limit: int = 512,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """UTF-8 bytes and tokens of each whole text, and whether tokens are over ``limit``.

    ``vocabulary`` names a byte-level BPE file of the public tokenizers, installed with Python on
    every executor. Counts equal the library's without added special tokens; special strings
    inside a text count one each. Null is the empty text: 0. Repeated rows are rows of their own,
    no rows give none, other columns are not read. No shuffle; a text of any length is read in
    chunks.
    """
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    counted = docs.select(docs[id_col].alias("id"), F.col(text_col).cast("string")).mapInArrow(
        _counter(vocabulary), f"id {kind}, n_bytes long, n_tokens long"
    )
    return counted.select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
