"""Token ids in compressed shard files, by Re-Pair.

A shard holds whole documents' ids one after the other. Re-Pair replaces frequent pairs of successive symbols by new
symbols (nonterminals) and repeats this on what results until no pair is frequent; here a round takes the more frequent half of
the frequent pairs together, so that it is a few passes over arrays. A shard stores its rules, the length that every
nonterminal expands to, and the last sequence, so any range of ids is read by expanding only the symbols that overlap it.

A shard file is a row of a Parquet table, which any store that Spark reaches can hold. Its payload, little-endian: magic
"LRP2", then uint32 n_ids (symbols below it stand for the ids of the alphabet), n_rules, n_symbols, wide (1: a symbol has 4 bytes,
else 2); then n_ids uint32 (the alphabet), 2 * n_rules symbols (the rules), n_rules uint32 (expansion lengths) and n_symbols
symbols (the sequence).
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, split_words, stored, texts

MAGIC = b"LRP2"
#: Ids in a shard, but for its last document, which is whole.
SHARD_IDS = 1 << 20
#: The least count of a pair that gets a rule (two symbols and a length must pay off).
LEAST_COUNT = 6
#: Words whose ids a worker keeps, some 150 bytes each.
CACHE_WORDS = 1_000_000
#: Signs that may stand before and after plain letters: neither composes or changes with its neighbours, and none begins a special
#: token. Plain letters are ASCII and Latin-1 ones.
BEFORE, AFTER, LETTERS = '"([*#%$&!', '.,!?;:%*#$&)]"|', "^[A-Za-zÀ-ÖØ-öø-ÿ]+$"
#: A round finds its pairs by this many bits of their hash.
SLOT_BITS = 20


def _slots(keys: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        if keys.dtype == np.uint32:
            return (keys * np.uint32(0x9E3779B1)) >> np.uint32(32 - SLOT_BITS)
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)


def _numbered(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids, sorted, and each id as its place among them."""
    if len(ids) and ids.max() < 1 << 22:
        there = np.zeros(int(ids.max()) + 1, bool)
        there[ids] = True
        return np.flatnonzero(there), (np.cumsum(there, dtype=np.uint32) - 1)[ids].astype(np.uint32)
    alphabet, seq = np.unique(ids, return_inverse=True)
    return alphabet, seq.astype(np.uint32)


def _every_other(at: np.ndarray) -> np.ndarray:
    """Of places in a row, which overlap, every other one from the first on: a mask."""
    starts = np.flatnonzero(np.diff(at, prepend=-2) != 1)
    odd = np.zeros(len(at), np.uint8)
    odd[1::2] = 1
    return odd == np.repeat(odd[starts], np.diff(starts, append=len(at)))


def compress(ids: np.ndarray) -> bytes:
    """A shard's payload. Ends when no pair stands LEAST_COUNT times where it could be replaced."""
    alphabet, seq = _numbered(ids)
    symbols, rules = len(alphabet), []
    # places whose pair may be frequent (a pair that isn't becomes so by new symbols only); None: all
    live = None
    while len(seq) > 1:
        half = 16 if symbols <= 1 << 16 else 32
        kind = np.uint32 if half == 16 else np.uint64
        left, right = (seq[:-1], seq[1:]) if live is None else (seq.take(live), seq[1:].take(live))
        keys = left.astype(kind)
        keys <<= kind(half)
        keys |= right
        ordered = np.sort(keys)
        starts = np.flatnonzero(np.diff(ordered, prepend=~ordered[:1]))
        counts = np.diff(starts, append=len(ordered))
        often = np.flatnonzero(counts >= LEAST_COUNT)
        pairs, counts = ordered[starts[often]], counts[often]
        if not len(pairs):
            break
        # one pair a slot, the most frequent; others that share it, or are in the less frequent half, wait for a later round
        slot = np.full(1 << SLOT_BITS, -1, np.int32)
        order = np.argsort(counts, kind="stable")
        slot[_slots(pairs[order])] = order
        pair = slot.take(_slots(keys))
        some = np.flatnonzero(pair >= 0)
        live, pair, keys = some if live is None else live.take(some), pair.take(some), keys.take(some)
        now = np.flatnonzero((pairs.take(pair) == keys) & (counts >= np.median(counts)).take(pair))
        at, pair = live.take(now), pair.take(now)
        free = np.flatnonzero(_every_other(at))
        at, pair = at.take(free), pair.take(free)
        # overlaps may have left a pair with too few places
        pays = np.bincount(pair, minlength=len(pairs)) >= (LEAST_COUNT + 1) // 2
        if not pays.all():
            free = np.flatnonzero(pays.take(pair))
            at, pair = at.take(free), pair.take(free)
        if not len(at):
            break
        rules.append(np.stack([pairs[pays] >> kind(half), pairs[pays] & kind((1 << half) - 1)], 1).astype(np.uint32))
        seq[at] = (symbols - 1 + np.cumsum(pays, dtype=np.uint32)).take(pair)
        symbols += int(pays.sum())
        alive, keep = np.zeros(len(seq), bool), np.ones(len(seq), bool)
        alive[live] = True
        alive[at] = True
        alive[at - (at > 0)] = True
        keep[at + 1] = False
        alive = alive[keep]
        seq = seq[keep]
        live = np.flatnonzero(alive[:-1])
        if not len(live):
            break
    kind, flat = np.dtype("<u4" if symbols > 1 << 16 else "<u2"), np.concatenate(rules) if rules else np.empty((0, 2), np.uint32)
    lengths, done = np.ones(symbols, np.uint32), len(alphabet)
    for rule in rules:
        lengths[done : done + len(rule)] = lengths[rule].sum(1)
        done += len(rule)
    head = struct.pack("<4I", len(alphabet), len(flat), len(seq), kind.itemsize == 4)
    return b"".join([MAGIC, head, alphabet.astype("<u4").tobytes(), flat.astype(kind).tobytes(), lengths[len(alphabet) :].astype("<u4").tobytes(), seq.astype(kind).tobytes()])


def _gathered(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """flat[start : start + length] of each, one after the other, and the lengths."""
    ends = np.cumsum(lengths)
    places = np.repeat(starts - ends + lengths, lengths)
    places += np.arange(len(places))
    return flat.take(places), lengths


class Shard:
    """Reads a payload."""

    def __init__(self, payload: bytes) -> None:
        if payload[:4] != MAGIC:
            raise ValueError("not a shard")
        self.first, n, m, wide = struct.unpack_from("<4I", payload, 4)
        kind, at = np.dtype("<u4" if wide else "<u2"), 20
        self.alphabet = np.frombuffer(payload, "<u4", self.first, at)
        self.rules = np.frombuffer(payload, kind, 2 * n, at := at + 4 * self.first).reshape(n, 2)
        self.lengths = np.frombuffer(payload, "<u4", n, at := at + 2 * n * kind.itemsize)
        self.seq = np.frombuffer(payload, kind, m, at + 4 * n)
        self._flat: np.ndarray | None = None

    def _expand(self, seq: np.ndarray) -> np.ndarray:
        """The ids of symbols: every rule's expansion is made once, then all symbols are looked up together."""
        if self._flat is None:
            own = self.rules.reshape(-1)
            while len(where := np.flatnonzero(own >= self.first)):
                pairs = self.rules[own[where].astype(np.int64) - self.first]
                at = where + np.arange(len(where))
                out = np.repeat(own, np.where(own >= self.first, 2, 1))
                out[at], out[at + 1] = pairs[:, 0], pairs[:, 1]
                own = out
            self._flat = np.concatenate([self.alphabet, self.alphabet[own]])
            self._sizes = np.concatenate([np.ones(self.first, np.int64), self.lengths.astype(np.int64)])
            self._starts = np.cumsum(self._sizes) - self._sizes
        return _gathered(self._flat, self._starts.take(seq), self._sizes.take(seq))[0]

    def _ends(self) -> np.ndarray:
        sizes = np.ones(len(self.seq), np.int64)
        big = self.seq >= self.first
        sizes[big] = self.lengths[self.seq[big].astype(np.int64) - self.first]
        return np.cumsum(sizes)

    def ids(self, start: int = 0, end: int | None = None) -> np.ndarray:
        """ids[start:end]; only the symbols that overlap this range are expanded."""
        if start == 0 and end is None:
            return self._expand(self.seq)
        ends = self._ends()
        end = min(int(ends[-1]) if len(ends) else 0, 1 << 62 if end is None else end)
        if start >= end:
            return np.empty(0, np.uint32)
        a, z = np.searchsorted(ends, start, "right"), np.searchsorted(ends, end, "left") + 1
        before = int(ends[a - 1]) if a else 0
        return self._expand(self.seq[a:z])[start - before : end - before]


def _byte_letters() -> str:
    """The character by which a byte-level vocabulary writes each byte: printable Latin-1 as it is, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return "".join(chr(b if b in own else next(others)) for b in range(256))


#: What a tokenizer's file has to say for the parts of a text to be encoded one by one.
KNOWN = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
KNOWN_MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}


class WordIds:
    """The ids of texts by the tokenizers library, kept by stretches between ASCII white space, and by the parts of a stretch.

    This gives what encoding the whole text gives if the tokenizer drops white space, folds case after composing characters, takes
    runs of letters apart from runs of signs and writes bytes by a byte-level alphabet. Of any file that doesn't say just that (see
    KNOWN) every text goes to the library as a whole. A stretch between ASCII white space that is plain letters between plain signs is made of these three parts, the letters in
    lower case, which go to the library's model; any other stretch goes to the library as it is.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        file = json.loads(self.tokenizer.to_str())
        self.known = all(file.get(k) == v for k, v in KNOWN.items()) and all(file["model"].get(k) == v for k, v in KNOWN_MODEL.items())
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.reset()

    def reset(self) -> None:
        self.at: dict[bytes, int] = {b"": 0}
        self.flat, self.starts, self.lengths, self.used = np.empty(1 << 16, np.uint32), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), 0

    def _add(self, ids: list[bytes], known: int) -> None:
        """The ids of the next words, of which so many are known."""
        flat = np.frombuffer(b"".join(ids), np.uint32)
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        while known + len(ids) > len(self.starts):
            self.starts, self.lengths = np.concatenate([self.starts, self.starts]), np.concatenate([self.lengths, self.lengths])
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, self.flat])
        new = slice(known, known + len(ids))
        self.lengths[new], self.starts[new] = lengths, self.used + np.cumsum(lengths) - lengths
        self.flat[self.used : self.used + len(flat)] = flat
        self.used += len(flat)

    def _numbers(self, words: list[bytes], whole: bool) -> np.ndarray:
        """The words' numbers in the table of ids; new ones go to the library, as a whole or to its model alone."""
        at, known = self.at, len(self.at)
        index = np.fromiter([at.setdefault(w, len(at)) for w in words], np.int64, len(words))
        if len(at) > known and whole:
            new = [w.decode("utf-8", "replace") for w in islice(at, known, None)]
            self._add([array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch(new, add_special_tokens=False)], known)
        elif len(at) > known:
            new = [w.decode("latin-1").translate(self.letters) for w in islice(at, known, None)]
            self._add([array("I", [t.id for t in self.model.tokenize(w)]).tobytes() for w in new], known)
        return index

    def _ids(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words by their numbers, one after the other, and how many each has."""
        return _gathered(self.flat, self.starts.take(numbers), self.lengths.take(numbers))

    def encode(self, column: pa.Array | list[bytes], end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each followed by end, and how many each has."""
        if not self.known:
            found = self.tokenizer.encode_batch([t.decode("utf-8") for t in (column if isinstance(column, list) else texts(column))], add_special_tokens=False)
            sizes = np.array([len(e.ids) for e in found], np.int64)
            flat = np.fromiter((i for e in found for i in e.ids), np.uint32, int(sizes.sum()))
            return np.insert(flat, np.cumsum(sizes), np.uint32(end)), sizes + 1
        if len(self.at) > CACHE_WORDS:
            self.reset()
        split = split_words(column, None)
        raw, stretches = split.distinct, pa.array(split.distinct, pa.binary()).cast(pa.string())
        right = pc.ascii_ltrim(stretches, characters=BEFORE)
        core = pc.ascii_rtrim(right, characters=AFTER)
        plain = pc.match_substring_regex(core, LETTERS)
        n, n_right, n_core = (pc.binary_length(x).to_numpy(zero_copy_only=False) for x in (stretches, right, core))
        # three words of each stretch: the signs before, the letters, the signs after; of one that isn't plain the middle one is all
        words = np.zeros((len(raw), 3), np.int64)
        is_plain = plain.to_numpy(zero_copy_only=False)
        odd, even = np.flatnonzero(~is_plain), np.flatnonzero(is_plain)
        before, after = even[n_right[even] < n[even]], even[n_core[even] < n_right[even]]
        words[odd, 1] = self._numbers(raw[odd].tolist(), True)
        words[even, 1] = self._numbers(pc.utf8_lower(core.filter(plain)).cast(pa.binary()).to_numpy(zero_copy_only=False).tolist(), False)
        words[before, 0] = self._numbers([w[:k] for w, k in zip(raw[before], (n - n_right)[before].tolist(), strict=True)], False)
        words[after, 2] = self._numbers([w[-k:] for w, k in zip(raw[after], (n_right - n_core)[after].tolist(), strict=True)], False)
        ids, lengths = self._ids(words.reshape(-1))
        lengths = lengths.reshape(-1, 3).sum(1)
        flat, sizes = _gathered(ids, (np.cumsum(lengths) - lengths).take(split.codes), lengths.take(split.codes))
        text_ends = np.concatenate(([0], np.cumsum(sizes)))[np.cumsum(split.counts)]
        return np.insert(flat, text_ends, np.uint32(end)), np.diff(text_ends, prepend=0) + 1


_LOADED: dict[str, WordIds] = {}


def write_token_files(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encodes every text, appends end_id to each, and writes shard files in ascending order of ids (nulls first; rows that
    share an id by their texts). Ids may be of any type that sorts. Returns the table that it wrote: part, shard, before (ids of part before
    this shard), n_ids, doc_ids and n_tokens (arrays), payload. A null text has end_id alone; an empty table gives no shards."""
    bound_batches(docs.sparkSession)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    rows, kind = rows.repartitionByRange(n, "id").sortWithinPartitions("id", "t"), rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _LOADED:
            _LOADED[path] = WordIds(path)
        words = _LOADED[path]
        part, shard, before = TaskContext.get().partitionId(), 0, 0
        docs, sizes, ids, waiting = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal shard, before, docs, sizes, ids, waiting
            flat = np.concatenate(ids)
            cells = [[part], [shard], [before], [len(flat)], [docs], [sizes], [compress(flat)]]
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(id_type), pa.list_(pa.int64()), pa.binary())
            shard, before = shard + 1, before + len(flat)
            docs, sizes, ids, waiting = [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], ["part", "shard", "before", "n_ids", "doc_ids", "n_tokens", "payload"])

        for b in batches:
            id_type = b.schema.field(0).type
            flat, counts = words.encode(b.column(1), end_id)
            doc_ids, ends, i = b.column(0).to_pylist(), np.cumsum(counts), 0
            while i < len(counts):
                start = int(ends[i - 1]) if i else 0
                k = min(len(counts), int(np.searchsorted(ends, start + shard_ids - waiting)) + 1)
                docs += doc_ids[i:k]
                sizes += counts[i:k].tolist()
                ids.append(flat[start : ends[k - 1]])
                waiting += int(ends[k - 1]) - start
                i = k
                if waiting >= shard_ids:
                    yield flush()
        if docs:
            yield flush()

    schema = f"part int, shard int, before long, n_ids long, doc_ids array<{kind}>, n_tokens array<long>, payload binary"
    return stored(rows.mapInArrow(run, schema), "token-files")


def read_token_files(files: DataFrame) -> DataFrame:
    """From the shard files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of the ids as
    little-endian unsigned 32-bit integers). The driver sees one number for each part, of which there are as many as
    shuffle partitions."""
    bound_batches(files.sparkSession)
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    starts, at = {}, 0
    for r in totals:
        starts[r.part], at = at, at + r.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            id_type = b.schema.field("doc_ids").type.value_type
            for part, before, docs, sizes, payload in zip(*(b.column(c).to_pylist() for c in ("part", "before", "doc_ids", "n_tokens", "payload")), strict=True):
                ids = Shard(payload).ids().astype("<u4")
                ends = np.cumsum(sizes)
                crc = [zlib.crc32(ids[z - n : z].data) for z, n in zip(ends.tolist(), sizes, strict=True)]
                cells = [pa.array(docs, id_type), pa.array(starts[part] + before + ends - sizes), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(cells, ["doc_id", "start", "n_tokens", "ids_crc32"])

    kind = files.schema["doc_ids"].dataType.elementType.simpleString()
    return files.mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids by word_bpe_49k, from the files that hold them."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return read_token_files(write_token_files(docs, public_tokenizers.path("word_bpe_49k.json"), 2))
