"""Exact byte-level BPE encoding by backtracking over longest matches, and decoding by offsets.

The encoding of a piece by merges is the one cut into tokens in which each pair of neighbours is
compatible: undoing the merges that made the two, latest first, never meets a pair across their
border that would have been merged before. One Aho-Corasick pass over a piece gives the longest
token that starts at each byte. The encoder takes it if it fits its left neighbour, else the next
shorter token that starts there, and steps back over the neighbour if none fits; a position that
was left by a step back is marked and never tried again, so the work is linear in the piece.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import pairwise
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraudspark.llm.common import small_batches
from fraudspark.llm.tokens import byte_letters

NEVER = 1 << 60
#: Entries of the caches of pieces and of pairs. They are emptied when full.
CACHE = 400_000
LONG_PIECE = 200
#: The pattern by which byte-level vocabularies cut a text into pieces, with its
#: blanks written out.
BLANKS = "\t-\r\x20\x85\xa0  -     　"
PIECES = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
    rf"| ?[^{BLANKS}\p{{L}}\p{{N}}]+|[{BLANKS}]+(?![^{BLANKS}])|[{BLANKS}]+"
)


class Compatible(dict):
    """The pair-compatibility table: whether two tokens stay apart, filled as pairs are met."""

    def __init__(self, joined):
        self.joined = joined

    def __missing__(self, pair: tuple[int, int]) -> bool:
        if len(self) >= CACHE:
            self.clear()
        found = self[pair] = not self.joined(*pair, NEVER)
        return found


class Encoder(dict):
    """Maps a piece to its packed token ids; a dict of the pieces met last."""

    def __init__(self, path: str):
        import ahocorasick
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if (spec["pre_tokenizer"] or {}).get("type") != "ByteLevel" or spec["normalizer"]:
            raise ValueError(f"no plain byte-level vocabulary: {path}")
        letters = byte_letters()
        raw = lambda t: bytes(letters[c] for c in t)
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ids = {raw(t): i for t, i in spec["model"]["vocab"].items() if t not in added}
        self.special = added
        self.at_special = regex.compile(
            "(" + "|".join(regex.escape(t) for t in sorted(added, key=len, reverse=True)) + ")"
        )
        self.library = Tokenizer.from_file(path).pre_tokenizer
        self.split = regex.compile(PIECES).findall
        self.kinds = [regex.compile(k) for k in (r"\p{L}", r"\p{N}", f"[{BLANKS}]")]
        self.known = set(map(chr, range(128)))
        self.odd: set[str] = set()
        self._pairs(spec["model"]["merges"], ids, raw)
        self._prefixes(ids, ahocorasick)
        self._offsets(ids, added)
        self.compatible = Compatible(self._joined)

    def _pairs(self, merges: list, ids: dict[bytes, int], raw) -> None:
        size = max(ids.values()) + 1
        self.made, self.left, self.right = [-1] * size, [-1] * size, [-1] * size
        self.rank: dict[tuple[int, int], int] = {}
        for when, m in enumerate(merges):
            a, b = map(raw, m if isinstance(m, list) else m.split(" "))
            whole = ids[a + b]
            self.rank[ids[a], ids[b]] = when
            if self.made[whole] < 0:
                self.made[whole], self.left[whole], self.right[whole] = when, ids[a], ids[b]

    def _prefixes(self, ids: dict[bytes, int], ahocorasick) -> None:
        """The automaton of all tokens that encode to themselves, and each token's longest proper
        prefix among them."""
        size = max(ids.values()) + 1
        self.length, self.shorter = [0] * size, [-1] * size
        self.tokens = ahocorasick.Automaton()
        own = {}
        for t, i in sorted(ids.items(), key=lambda x: (len(x[0]), x[0])):
            if self.made[i] < 0 and len(t) > 1 or self.made[i] >= 0 and not self._whole(i):
                continue
            own[t] = i
            self.length[i] = len(t)
            self.shorter[i] = next((own[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in own), -1)
            self.tokens.add_word(t.decode("latin-1"), i)
        self.tokens.make_automaton()

    def _whole(self, token: int) -> bool:
        """Whether a token's parts stay apart until its own merge joins them."""
        return not self._joined(self.left[token], self.right[token], self.made[token])

    def _joined(self, a: int, b: int, until: int) -> bool:
        """Whether a merge of rank under ``until`` crosses the border of two tokens. Of equal
        ranks the one further left comes first."""
        until_a = until_b = until
        while True:
            across = self.rank.get((a, b), NEVER)
            if across < until_a and (across <= until_b if until_b != until else across < until):
                return True
            made_a, made_b = self.made[a], self.made[b]
            if made_a < 0 and made_b < 0:
                return False
            if made_a > made_b:
                until_a, a = made_a, self.right[a]
            else:
                until_b, b = made_b, self.left[b]

    def tokens_of(self, data: bytes) -> list[int]:
        """The encoding of a piece: its longest matches in a row while each fits the one before
        it, from the first misfit on by steps back."""
        spelled = data.decode("latin-1")
        out = [i for _, i in self.tokens.iter_long(spelled)]
        fits = self.compatible
        for i, pair in enumerate(pairwise(out), 1):
            if not fits[pair]:
                return self._stepping_back(spelled, out[:i])
        return out

    def _stepping_back(self, spelled: str, out: list[int]) -> list[int]:
        length, shorter, fits = self.length, self.shorter, self.compatible
        n, at = len(spelled), sum(map(length.__getitem__, out))
        longest = [-1] * n
        for end, i in self.tokens.iter(spelled):  # of those that end at one byte, longest first
            longest[end + 1 - length[i]] = i
        open_ = bytearray(b"\1") * (n + 1)
        token = longest[at] if at < n else -1
        while at < n:
            while token >= 0:
                end = at + length[token]
                if open_[end] and (not out or fits[out[-1], token]):
                    break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at = end
                token = longest[at] if at < n else -1
            else:
                open_[at] = 0
                if not out:
                    raise ValueError("the vocabulary lacks a byte")
                token = out.pop()
                at -= length[token]
        return out

    def __missing__(self, piece: str) -> bytes:
        packed = pack(f"<{len(ids := self.tokens_of(piece.encode()))}I", *ids)
        if len(piece) <= LONG_PIECE:
            if len(self) >= CACHE:
                self.clear()
            self[piece] = packed
        return packed

    def _same_kind(self, c: str) -> bool:
        """Whether the library, which may know another edition of Unicode, has the pattern's kind
        for a character."""
        kind = next((i for i, k in enumerate(self.kinds) if k.match(c)), 3)
        if kind == 2:
            return len(self.library.pre_tokenize_str("!" + c)) == 2
        return len(self.library.pre_tokenize_str("a1 !"[kind] + c)) == 1

    def pieces(self, text: str) -> list[str]:
        new = set(text) - self.known
        if new:
            self.odd |= {c for c in new if not self._same_kind(c)}
            self.known |= new
        if self.odd and not self.odd.isdisjoint(text):
            return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]
        return self.split(text)

    def encode(self, text: str) -> bytes:
        """Packed ids, four bytes each, low byte first."""
        if not self.special or self.at_special.search(text) is None:
            return b"".join(map(self.__getitem__, self.pieces(text)))
        out = []
        for i, part in enumerate(self.at_special.split(text)):
            if i % 2:
                out.append(self.special[part].to_bytes(4, "little"))
            else:
                out.extend(map(self.__getitem__, self.pieces(part)))
        return b"".join(out)

    def _offsets(self, ids: dict[bytes, int], added: dict[str, int]) -> None:
        spelled = {i: t for t, i in ids.items()} | {i: t.encode() for t, i in added.items()}
        size = max(spelled) + 1
        self.bounds = np.zeros(size + 1, np.int64)
        self.bounds[1:] = np.cumsum([len(spelled.get(i, b"")) for i in range(size)])
        self.spelling = np.frombuffer(b"".join(spelled.get(i, b"") for i in range(size)), np.uint8)

    def decode(self, packed: bytes, step: int = 1 << 20) -> bytes:
        """The bytes of packed ids; ids that are not in the vocabulary have none."""
        ids, out = np.frombuffer(packed, "<u4"), []
        for lo in range(0, len(ids), step):
            part = ids[lo : lo + step].astype(np.int64)
            part = part[part < len(self.bounds) - 1]
            first, size = self.bounds[part], self.bounds[part + 1] - self.bounds[part]
            begin = np.cumsum(size) - size
            out.append(self.spelling[np.repeat(first - begin, size) + np.arange(size.sum())].tobytes())
        return b"".join(out)


_encoders: dict[str, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    """One per worker process and vocabulary."""
    if vocabulary not in _encoders:
        import public_tokenizers

        _encoders[vocabulary] = Encoder(public_tokenizers.path(vocabulary))
    return _encoders[vocabulary]


def _replaced(batch: pa.RecordBatch, column: str, values: pa.Array) -> pa.RecordBatch:
    at = batch.schema.get_field_index(column)
    return batch.set_column(at, pa.field(column, values.type), values)


def bpe_encode(
    docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", text_col: str = "text"
) -> DataFrame:
    """All columns of ``docs``, with the text replaced by its token ids: four bytes each, low byte
    first (binary).

    Ids equal the library's without begin, end or padding; special strings inside a text are their
    special token. Null is the empty text and has no tokens. A text is encoded whole: the work is
    linear in its length and a row holds its text and ids. Repeated rows stay rows of their own,
    no rows give none. No shuffle. ``vocabulary`` names a byte-level file of the public
    tokenizers, installed with Python on every executor.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary)
        for b in batches:
            texts = pc.fill_null(b.column(text_col), "").to_pylist()
            yield _replaced(b, text_col, pa.array([e.encode(t) for t in texts], pa.binary()))

    docs = docs.withColumn(text_col, docs[text_col].cast("string"))
    return docs.mapInArrow(run, _with_type(docs, text_col, "binary"))


def bpe_decode(
    encoded: DataFrame, vocabulary: str = "byte_bpe_50k.json", ids_col: str = "text"
) -> DataFrame:
    """All columns, with packed ids replaced by the text they spell. Special tokens are spelled
    out; bytes that are no UTF-8 become U+FFFD; null ids are the empty text."""
    small_batches(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary)
        for b in batches:
            packed = b.column(ids_col).to_pylist()
            texts = [e.decode(p or b"").decode("utf-8", "replace") for p in packed]
            yield _replaced(b, ids_col, pa.array(texts, pa.string()))

    return encoded.mapInArrow(run, _with_type(encoded, ids_col, "string"))


def _with_type(df: DataFrame, column: str, kind: str):
    return df.select(
        *[F.lit(None).cast(kind).alias(c) if c == column else df[c] for c in df.columns]
    ).schema


def round_trip(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", id_col: str = "doc_id") -> DataFrame:
    """Tokens of each text, the digest of its ids, and the digest of the text they decode to."""
    rows = docs.select(docs[id_col].alias(id_col), docs["text"].alias("ids"))
    encoded = bpe_encode(rows, vocabulary, "ids").withColumn("decoded", F.col("ids"))
    decoded = bpe_decode(encoded, vocabulary, "decoded")
    return decoded.select(
        id_col,
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
