"""Text as column expressions: folding, tokens, snippets, highlighting, chunks, hashes, code excerpts."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Words that documents drop and queries keep.
STOP_WORDS = (
    "a an and are as at be been but by for from has have he her his i in is it its not of on or that the their them there "
    "these they this to was were which will with you your"
).split()

#: Where a text is split into lines: what Unicode and ASCII take for a line's end.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
SPACE = r"[\s\x0b\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def fold_text(text: str) -> str:
    """Compatibility decomposition without combining marks, case-folded: the rule that the tables below are made by."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).casefold()


#: No character from here on decomposes, folds or combines.
LAST_FOLDED = 0x30000
#: Hangul syllables, which are most of the characters that become several: their letters follow from their numbers.
HANGUL, HANGUL_CLASS = range(0xAC00, 0xD7A4), r"\x{ac00}-\x{d7a3}"
INITIALS, VOWELS, FINALS = ("".join(map(chr, x)) for x in (range(0x1100, 0x1113), range(0x1161, 0x1176), range(0x11A8, 0x11C3)))


@cache
def _tables() -> tuple[str, str, list[tuple[str, str]], str]:
    """fold_text works character by character, as the marks that it could reorder all vanish. For translate(): characters and what single
    one each becomes, those that vanish last; for characters that become several (but Hangul), the same for the first of these, for the second of those that
    have one and so on; and a class of all of the latter. These stand in every plan that folds, and the driver keeps plans as text, so they are kept short."""
    single, gone, several = [], [], []
    for code in (*range(0xD800), *range(0xE000, LAST_FOLDED)):
        c = chr(code)
        to = c if code < 0x41 else fold_text(c)
        if to == c or code in HANGUL:
            continue
        (single if len(to) == 1 else several if to else gone).append((c, to))
    longest = max(len(to) for _, to in several)
    by_place = []
    for k in range(longest):
        there = [(c, to[k]) for c, to in several if len(to) > k]
        by_place.append(("".join(c for c, _ in there), "".join(t for _, t in there)))
    runs, codes = [], [ord(c) for c, _ in several]
    for code in codes:
        if runs and runs[-1][1] == code - 1:
            runs[-1][1] = code
        else:
            runs.append([code, code])
    return "".join(c for c, _ in single) + "".join(c for c, _ in gone), "".join(t for _, t in single), by_place, "".join(f"\\x{{{a:x}}}-\\x{{{z:x}}}" for a, z in runs)


def _letters(x: Column) -> Column:
    """A Hangul syllable's letters: an initial, a vowel and perhaps a final."""
    n = F.ascii(x) - HANGUL.start
    at = lambda letters, i: F.substring(F.lit(letters), i.cast("int"), F.lit(1))
    return F.concat(at(INITIALS, F.floor(n / 588) + 1), at(VOWELS, F.floor(n % 588 / 28) + 1), F.when(n % 28 > 0, at(FINALS, n % 28)).otherwise(""))


def fold(c: Column) -> Column:
    """fold_text in JVM code: lower() for ASCII texts, else one translate(); a text that holds a character that becomes several is taken
    character by character first."""
    before, after, by_place, several = _tables()
    # those that are frequent are replaced, so that few texts are taken character by character; and a table tells faster than a pattern of many
    # ranges whether a text has any
    whole, longer = c, by_place[0][0]
    for x in "ß…":
        c = F.replace(c, F.lit(x), F.lit(fold_text(x)))
    has_any = (F.length(F.translate(c, longer, "")) < F.length(c)) | c.rlike(f"[{HANGUL_CLASS}]")
    placed = lambda x, a, b: F.when(F.contains(F.lit(a), x), F.translate(x, a, b)).otherwise("")
    spelled = lambda x: F.when(x.rlike(rf"\A[{HANGUL_CLASS}]"), _letters(x)).when(F.contains(F.lit(longer), x), F.concat(*[placed(x, a, b) for a, b in by_place])).otherwise(x)
    spread = F.array_join(F.transform(F.regexp_extract_all(c, F.lit(f"[{several}{HANGUL_CLASS}]|[^{several}{HANGUL_CLASS}]+"), F.lit(0)), spelled), "")
    return F.when(whole.rlike(r"\A[\x00-\x7f]*\z"), F.lower(whole)).otherwise(F.translate(F.when(has_any, spread).otherwise(c), before, after))


@F.pandas_udf(StringType())
def fold_exact(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """fold_text for any text, in Arrow batches."""
    for s in batches:
        yield s.map(lambda t: None if t is None else fold_text(t))


_WORD = r"[\p{L}\p{N}]"


def words(c: Column) -> Column:
    """All tokens of a text: runs of letters and digits of the folded text. Null has none."""
    return F.regexp_extract_all(F.coalesce(fold(c), F.lit("")), F.lit(f"({_WORD}+)"), F.lit(1))


def tokens(c: Column) -> Column:
    """The tokens that an index holds, repeats included: all but stop words."""
    return F.filter(words(c), lambda t: ~t.isin(*STOP_WORDS))


@cache
def word_ranges(spark: SparkSession) -> str:
    """The characters beyond ASCII that words() takes for letters or digits, as ranges of a Python pattern. The JVM's Unicode tells, as Python's may be another version."""
    code = F.col("id")
    beyond = spark.range(0x80, 0x40000, numPartitions=1).filter(~code.between(0xD800, 0xDFFF)).filter(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32").rlike(_WORD))
    codes = np.array(beyond.agg(F.array_sort(F.collect_list(code))).first()[0])
    edges = np.flatnonzero(np.diff(codes) > 1)
    return "".join(f"\\U{a:08x}-\\U{z:08x}" for a, z in zip(codes[[0, *(edges + 1)]], codes[[*edges, -1]], strict=True))


#: Bytes that may be part of a word before folding (ASCII letters and digits, and all of other characters), and bytes with A-Z lowered.
_MAY_BE_WORD = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
_LOWERED = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def _flat(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of an array's values, and where each value starts and the last ends."""
    at = np.frombuffer(a.buffers()[1], np.int32, len(a) + 1, a.offset * 4) if len(a) else np.zeros(1, np.int32)
    raw = np.frombuffer(a.buffers()[2], np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def _runs(raw: np.ndarray, at: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Runs of bytes that inside holds for, none beyond a row's end (rows start at `at`): each one's row, and the runs with A-Z lowered."""
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = at[(at > 0) & (at < len(raw))]
    first[edges], last[edges - 1] = inside[edges], inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    cuts = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=cuts[1:])
    return np.searchsorted(at, starts, "right") - 1, pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(_LOWERED[raw[inside]])])


def numbered(tokens: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of a batch's arrays of tokens each token's row, its number, and the distinct words, sorted, that the numbers stand for."""
    coded = tokens.flatten().dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary)
    place = np.empty(len(order), np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    lengths = pc.list_value_length(tokens).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.repeat(np.arange(len(lengths)), lengths), place[coded.indices.to_numpy(zero_copy_only=False)], coded.dictionary.take(order)


def numbered_tokens(texts: pa.Array, ranges: str) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """numbered() of the tokens() of a batch's texts. Folding goes character by character and never joins what an ASCII separator parts, so texts are cut at those, and only
    distinct pieces beyond ASCII are folded and split, in one string. ranges: see word_ranges."""
    raw, at = _flat(texts.cast(pa.binary()))
    row, pieces = _runs(raw, at, _MAY_BE_WORD[raw])
    pieces = pieces.dictionary_encode()
    raw, at = _flat(pieces.dictionary)
    plain = np.maximum.reduceat(raw, at[:-1]) < 0x80 if len(raw) else np.zeros(0, bool)
    odd = np.flatnonzero(~plain)
    folded = unicodedata.normalize("NFKD", b"\n".join(pieces.dictionary.take(pa.array(odd)).to_pylist()).decode("utf-8", "replace"))
    for c in set(folded):
        if unicodedata.combining(c):
            folded = folded.replace(c, "")
    split = np.frombuffer(re.sub(f"[^0-9a-z{ranges}\n]+", " ", folded.casefold()).encode(), np.uint8)
    line, words = _runs(split, np.array([0, *(np.flatnonzero(split == 10) + 1), len(split)]), split > 32)
    # the words of each piece, by its number
    piece = np.concatenate((np.flatnonzero(plain), odd[line]))
    words = pa.concat_arrays([pieces.dictionary.filter(pa.array(plain)), words]).cast(pa.string()).dictionary_encode()
    kept = words.dictionary.filter(pc.invert(pc.is_in(words.dictionary, pa.array(STOP_WORDS))))
    kept = kept.take(pc.array_sort_indices(kept))
    number = pc.fill_null(pc.index_in(words.dictionary, kept), -1).to_numpy(zero_copy_only=False)[words.indices.to_numpy()]
    piece, number = piece[number >= 0], number[number >= 0]
    order, sizes = np.argsort(piece, kind="stable"), np.bincount(piece, minlength=len(plain))
    which = pieces.indices.to_numpy()
    n = sizes[which]
    begins = (np.cumsum(sizes) - sizes)[which] - (np.cumsum(n) - n)
    return np.repeat(row, n), number[order][np.repeat(begins, n) + np.arange(n.sum())].astype(np.int64), kept


def leading(c: Column, n: int = 26) -> Column:
    """The first n tokens, stop words included."""
    return F.slice(words(c), 1, max(0, n))


#: The characters of SPACE.
SPACES = "".join(chr(x) for x in (*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))


def strip(c: Column) -> Column:
    """Without white space at both ends. A trim looks at the ends alone, where a pattern is tried at every place of a text."""
    return F.btrim(c, F.lit(SPACES))


def collapsed(c: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))


def title_of(c: Column) -> Column:
    """The first line that isn't blank, of at most 255 characters."""
    lines = F.filter(F.transform(F.split(c, LINE_END), strip), lambda x: x != "")
    return F.substring(F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit("")), 1, 255)


def document_text(title: Column, content: Column) -> Column:
    """What an embedding is made of: title and content, each only if it isn't blank."""
    return F.concat_ws("\n", F.nullif(strip(title), F.lit("")), F.nullif(strip(content), F.lit("")))


def query_terms(query: Column) -> Column:
    """Tokens of a query, stop words kept, repeats included."""
    return words(query)


def lines_of(content: Column) -> Column:
    """The words of each line of a text; what a snippet is taken from."""
    return F.transform(F.split(F.coalesce(fold(content), F.lit("")), LINE_END), lambda x: F.regexp_extract_all(x, F.lit(f"({_WORD}+)"), F.lit(1)))


def with_snippet(rows: DataFrame, lines: str, terms: str, n: int = 26, out: str = "snippet") -> DataFrame:
    """rows with a column out, from the columns lines (see lines_of) and terms (an array): the window around the first query term of the
    first line that has one, up to n // 2 words to either side. Without such a line, or without terms, the first n words. Output is
    folded. Each step is a column of its own, so nothing is computed twice."""
    half, hit, anchor = max(1, n // 2), f"__{out}_hit", f"__{out}_at"
    rows = rows.withColumn(hit, F.try_element_at(F.filter(lines, lambda x: F.arrays_overlap(x, F.col(terms))), F.lit(1)))
    # the first place in the line whose word is a term, from 1
    rows = rows.withColumn(anchor, F.array_position(F.transform(hit, lambda t: F.array_contains(F.col(terms), t)), True).cast("int"))
    start = F.greatest(F.lit(1), F.col(anchor) - half)
    window = F.slice(hit, start, F.col(anchor) + half - start + 1)
    found = F.when(F.col(hit).isNotNull(), F.array_join(window, " ")).otherwise(F.array_join(F.slice(F.flatten(lines), 1, max(0, n)), " "))
    return rows.withColumn(out, found).drop(hit, anchor)


def escape_html(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


#: Two private-use characters stand for the marks while the rest is escaped; a text's own ones are written as pairs meanwhile.
_OPEN, _CLOSE, _PAIR = "\ue000", "\ue001", "\ue002"
_OWN = ((_PAIR, f"{_PAIR}\ue005"), (_OPEN, f"{_PAIR}\ue003"), (_CLOSE, f"{_PAIR}\ue004"))


def _paired(c: Column) -> Column:
    out = c
    for raw, pair in _OWN:
        out = F.replace(out, F.lit(raw), F.lit(pair))
    return F.when(c.rlike(f"[{_OPEN}-{_PAIR}]"), out).otherwise(c)


def _unpaired(c: Column) -> Column:
    out = c
    for raw, pair in reversed(_OWN):
        out = F.replace(out, F.lit(pair), F.lit(raw))
    return F.when(F.contains(c, F.lit(_PAIR)), out).otherwise(c)


def highlight(text: Column, terms: Column) -> Column:
    """text, escaped, with every occurrence of a term in mark tags: the longest term first, in any case, in its own spelling."""
    text = _paired(text)
    quoted = F.transform(F.filter(terms, lambda t: F.trim(t) != ""), lambda t: F.regexp_replace(_paired(F.trim(t)), r"([^\p{L}\p{N}\s])", r"\\$1"))
    longest = F.array_sort(quoted, lambda a, b: F.length(b) - F.length(a))
    pattern = F.concat(F.lit("(?iu)("), F.array_join(longest, "|"), F.lit(")"))
    marked = F.regexp_replace(text, pattern, F.lit(f"{_OPEN}$1{_CLOSE}"))
    plain = escape_html(F.when(F.size(quoted) > 0, marked).otherwise(text))
    tagged = F.replace(F.replace(plain, F.lit(_OPEN), F.lit("<mark>")), F.lit(_CLOSE), F.lit("</mark>"))
    return F.coalesce(_unpaired(tagged), F.lit(""))


def chunks(text: Column, size: int = 1500) -> Column:
    """Pieces of size characters (64 at least), the last may be shorter; an empty text has none."""
    size = max(64, size)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length(text) - 1) / size)).cast("int"))
    return F.when(F.length(text) > 0, F.transform(starts, lambda i: F.substring(text, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


#: How a line of code begins, in any case.
CODE_STARTS = (
    "from import def class return async await const let var function export public private protected static package func fn struct "
    "impl interface echo SELECT INSERT UPDATE DELETE CREATE #include using namespace require"
).split()
FENCE, INLINE = r"(?s)```[^\n`]*\n(.*?)```", r"`([^`\n]{2,160})`"


def bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of c, which is computed once. A column that a lambda function names is computed anew for every element else, and a text that is split for each of its
    lines takes time with their square."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def code_excerpt(content: Column, terms: Column, budget: int = 600) -> Column:
    """The fenced block with the most query terms (of equals the shortest, then the first), else three lines from the code-like line
    with the most (then the first), else up to four inline spans, most terms first; cut to the budget. Empty without code."""
    budget = max(80, budget)
    hits = lambda x: F.size(bound(F.lower(x), lambda low: F.filter(F.array_distinct(terms), lambda t: (t != "") & F.contains(low, t)))).alias("h")
    if_any = lambda c: bound(strip(c), lambda x: F.when(x != "", x))
    pieces = lambda pattern: F.filter(F.transform(F.regexp_extract_all(content, F.lit(pattern), F.lit(1)), strip), lambda x: x != "")
    block = F.array_max(F.transform(pieces(FENCE), lambda x, i: F.struct(hits(x), (-F.length(x)).alias("n"), (-i).alias("i"), x.alias("x"))))["x"]
    starts = rf"(?i)^\s*(?:{'|'.join(CODE_STARTS)})\b"

    def line(lines: Column) -> Column:
        three = lambda i, between: F.array_join(F.slice(lines, i + 1, F.lit(3)), between)
        coded = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(starts), i)), lambda i: i.isNotNull())
        best = F.array_max(F.transform(coded, lambda i: F.struct(hits(three(i, " ")), (-i).alias("i"))))
        return bound(-best["i"], lambda i: if_any(three(i, "\n")))

    spans = F.sort_array(F.transform(pieces(INLINE), lambda x, i: F.struct(hits(x), (-i).alias("i"), x.alias("x"))), asc=False)
    inline = F.array_join(F.transform(F.slice(spans, 1, 4), lambda s: s["x"]), " ")
    return F.substring(F.coalesce(block, bound(F.split(content, LINE_END), line), inline, F.lit("")), 1, budget)
