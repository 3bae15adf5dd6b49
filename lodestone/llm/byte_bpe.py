"""Byte-level BPE by prefix dynamic programming.

A merge list has one encoding of every byte string, and an encoding's every prefix is itself the encoding of its bytes.
So each prefix of a piece has one valid last token: of the vocabulary tokens that end there, the one that is compatible
with the last token of the prefix before it. Two adjacent tokens are compatible when merging their joined bytes gives
just these two. The table of last tokens is found left to right; the encoding is read off it from the end. Appending
bytes extends the table exactly; after an edit it is recomputed from the edit on, until it agrees with the old one.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHE_WORDS, bound_batches, text_or_empty, with_fields

#: Pieces longer than this are encoded without being kept.
CACHE_PIECE_BYTES = 64
#: Pairs of tokens whose compatibility is kept.
CACHE_PAIRS = 150_000
#: Python's \s takes four control characters more than Unicode's White_Space, which the pattern means.
WHITE_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


class PrefixBPE:
    """ranks: token bytes -> id, lower ids merging first; every single byte is a token."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.bytes_of = ranks, {i: b for b, i in ranks.items()}
        self.sizes = {i: len(b) for b, i in ranks.items()}
        self.longest = max(self.sizes.values())
        # finds all tokens that end at a byte, the longest first; it reads bytes as the characters of Latin-1
        self.tokens = ahocorasick.Automaton()
        for t, i in ranks.items():
            self.tokens.add_word(t.decode("latin-1"), (i, len(t)))
        self.tokens.make_automaton()
        pattern = pattern.replace(r"[^\s", f"[^{WHITE_SPACE}").replace(r"\s", f"[{WHITE_SPACE}]").replace(r"\S", f"[^{WHITE_SPACE}]")
        self.pieces = regex.compile(pattern).findall
        self._pairs: dict[int, bool] = {}
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._kept: dict[str, bytes] = {}
        self._kept_before: dict[str, bytes] = {}

    def merged(self, piece: bytes, but: int = -1) -> list[int]:
        """By definition: the adjacent pair of lowest rank merges, the first of equals, until none can; the token `but` is not
        made. Quadratic; only for pieces of a token's bytes."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, at = min((1 << 62 if (r := self.ranks.get(a + b, 1 << 62)) == but else r, i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 62:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one, (token, token) for a single byte; None if merges don't make it."""
        if token not in self._halves:
            raw = self.bytes_of[token]
            parts = self.merged(raw, token)
            self._halves[token] = (token, token) if len(raw) == 1 else tuple(parts) if len(parts) == 2 else None
        return self._halves[token]

    def _apart(self, a: int, b: int) -> bool:
        """Whether merging the joined bytes of a and b gives just these two. Undoes merges next to the border, the last made
        first: none of the pairs that met there may have had a merge that would have come before the next merge of one
        of its sides."""
        bound = 1 << 62
        while True:
            across = self.ranks.get(self.bytes_of[a] + self.bytes_of[b])
            if across is not None and across < bound:
                return False
            (_, inner_a), (inner_b, _) = self.halves(a), self.halves(b)
            if inner_a == a and inner_b == b:
                return True
            # of equal ranks the left merge came first, so the right one is undone first
            if inner_b == b or (inner_a != a and a > b):
                a, bound = inner_a, a
            else:
                b, bound = inner_b, b + 1

    def _compatible(self, a: int, b: int) -> bool:
        ok = self._pairs.get(key := a << 32 | b)
        if ok is None:
            if len(self._pairs) >= CACHE_PAIRS:
                self._pairs.clear()
            ok = self._pairs[key] = self.halves(b) is not None and self._apart(a, b)
        return ok

    def extend(self, piece: bytes, last: list[int], stop: int | None = None) -> list[int]:
        """Extends last, where last[i] is the last token of piece[:i + 1], to stop bytes (all by default)."""
        known, compatible, found = self._pairs.get, self._compatible, len(last)
        begin = max(0, found - self.longest)
        for at, (token, size) in self.tokens.iter(piece[begin:stop].decode("latin-1")):
            if at + begin == found:
                start = found + 1 - size
                if start > 0:
                    ok = known(last[start - 1] << 32 | token)
                    if ok is None:
                        ok = compatible(last[start - 1], token)
                else:
                    ok = start == 0 and self.halves(token)
                if ok:
                    last.append(token)
                    found += 1
        return last

    def read_off(self, last: list[int]) -> list[int]:
        """The encoding that a table of last tokens holds."""
        ids, end, sizes = [], len(last), self.sizes
        while end:
            token = last[end - 1]
            ids.append(token)
            end -= sizes[token]
        ids.reverse()
        return ids

    def edited(self, old: bytes, last: list[int], start: int, end: int, new: bytes) -> tuple[bytes, list[int]]:
        """The piece old with old[start:end] replaced by new, and its table, from old's table. Only the rows from the edit
        up to where `longest` successive rows agree with the old ones are computed: an entry depends on no more."""
        piece, table, tail = old[:start] + new + old[end:], last[:start], len(old) - end
        at, same = start, 0
        while at < len(piece):
            at += 1
            self.extend(piece, table, at)
            was = at - len(piece) + len(old)
            same = same + 1 if at > len(piece) - tail and last[was - 1] == table[-1] else 0
            if same >= self.longest:
                return piece, table + last[was:]
        return piece, table

    def encode_piece(self, piece: bytes) -> list[int]:
        """One match of the pattern. A piece that is a token is that token, though merges may not reach it."""
        if (token := self.ranks.get(piece)) is not None:
            return [token]
        return self.read_off(self.extend(piece, []))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), np.int32).tolist()

    def packed(self, text: str) -> bytes:
        """The ids of a text as 32-bit integers. Pieces are kept in two lots: when the new one is full it becomes the old one, and what is met again
        in the old one goes to the new one, so frequent pieces stay."""
        kept, before, out = self._kept, self._kept_before, []
        for piece in self.pieces(text):
            ids = kept.get(piece)
            if ids is None:
                ids = before.get(piece)
                if ids is None:
                    raw = piece.encode("utf-8", "replace")
                    ids = array("i", self.encode_piece(raw)).tobytes()
                    keep = len(raw) <= CACHE_PIECE_BYTES
                else:
                    keep = True
                if keep:
                    if len(kept) >= CACHE_WORDS // 2:
                        self._kept_before, self._kept = before, kept = kept, {}
                    kept[piece] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_LOADED: dict[tuple[str, str], PrefixBPE] = {}


def tokenizer(path: str, pattern: str) -> PrefixBPE:
    """One for each Python worker. The file is a rank file that every machine has at this path."""
    if (path, pattern) not in _LOADED:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[path, pattern] = PrefixBPE(ranks, pattern)
    return _LOADED[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "token_ids") -> DataFrame:
    """docs with its other columns as they are, and ids_col (array<int>): the ids of the whole text. A null or empty text has none.
    Repeated rows are encoded each, and an empty table gives an empty one. A column of docs that is named ids_col is replaced."""
    bound_batches(docs.sparkSession)
    docs = docs.drop(ids_col)
    schema = with_fields(docs, f"`{ids_col}` array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path, pattern)
        for b in batches:
            packed = [bpe.packed(t or "") for t in b.column(text_col).to_pylist()]
            ends = np.cumsum([0, *map(len, packed)]) // 4
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(packed), np.int32)))
            yield pa.RecordBatch.from_arrays([*b.columns, ids], [*b.schema.names, ids_col])

    return docs.mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, path: str, pattern: str, ids_col: str = "token_ids", bytes_col: str = "decoded") -> DataFrame:
    """encoded with bytes_col (binary): the bytes of its ids; null ids give no bytes. Repeated rows are decoded each, and an empty table gives
    an empty one."""
    bound_batches(encoded.sparkSession)
    encoded = encoded.drop(bytes_col)
    schema = with_fields(encoded, f"`{bytes_col}` binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path, pattern)
        for b in batches:
            ids = b.column(ids_col)
            flat, ends = ids.flatten().to_numpy(zero_copy_only=False), np.cumsum([n or 0 for n in pc.list_value_length(ids).to_pylist()], dtype=np.int64).tolist()
            got = pa.array([bpe.decode(flat[a:z].tolist()) for a, z in zip([0, *ends], ends, strict=False)], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, got], [*b.schema.names, bytes_col])

    return encoded.mapInArrow(run, schema)


def op1_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Every document encoded by byte_bpe_multi_50k and decoded again, as digests."""
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", text_or_empty().alias("text"))
    return digests(decode_documents(encode_documents(docs, path, pattern).drop("text"), path, pattern))


def digests(decoded: DataFrame) -> DataFrame:
    """The columns of op1 from token_ids and decoded."""
    return decoded.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("token_ids", ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
