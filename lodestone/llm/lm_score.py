"""Language-model scores by deleted interpolation.

The probability of a token after a context is a mixture of three estimates: the maximum-likelihood bigram c(context,
token) / c(context), the maximum-likelihood unigram c(token) / N, and the uniform 1 / (V + 1). The mixture's weights depend on
how frequent the context is: contexts fall into buckets by the power of two of their count. The weights are learned by
expectation-maximisation on counts that the estimates haven't seen: a seventh of the ids is held out of the estimates for
this, and joins them afterwards.

All counts cover the whole corpus and are exact up to collisions of hashes, of 61 bits for tokens and of PAIR_BITS for bigrams; see
blocks.py for how they travel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import answer, answered, send_keys, with_blocks
from .common import distinct, mixed, places, split_words, texts

#: crc32 of the id as text, mod FOLDS: TEST is not learned from, FOLD learns the weights.
FOLDS, TEST, FOLD = 7, 2, 5
MAIN_ROLE, FOLD_ROLE, TEST_ROLE = 1, 2, 0
#: Buckets of context counts: 0, 1, 2-3, 4-7, ... and all from 2**(BUCKETS - 2) on.
BUCKETS = 24
#: Bits of a bigram's hash. Among 2**32 distinct bigrams one in a million shares its bits with another.
PAIR_BITS = 52
#: The end of a text, and the context that a text begins in.
END = np.uint64(0xE4D0_F7E8_7000_0001)
#: Learning reads a histogram of the estimates with steps of 1/STEPS in their logarithm; a bin counts by its mean logarithms.
STEPS = 8
EM_ROUNDS, LEAST_WEIGHT = 60, 1e-5


def token_keys(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts one after the other: keys of the tokens (words, A-Z lower-cased, then one end), keys of the bigrams that end
    in them, and the number of tokens of each text. Keys are even hashes, 4 apart: the bits below tell unigrams from
    bigrams and, while counting, hold a role."""
    split = split_words(raw)
    n, words = split.counts + 1, split.hashes()
    tokens = np.insert(words, np.cumsum(n - 1), END)
    before = np.concatenate(([END], tokens[:-1]))
    with np.errstate(over="ignore"):
        pairs = mixed(mixed(before) + tokens)
    return mixed(tokens) & ~np.uint64(7), pairs & ~np.uint64((1 << (64 - PAIR_BITS)) - 1) | np.uint64(4), n


def _block_keys(values: dict[str, list], raw: list[bytes]) -> tuple[np.ndarray, list[np.ndarray]]:
    one, two, n = token_keys(raw)
    role = np.repeat(np.array(values["role"], np.uint64), n)
    every = np.concatenate([one | role, two | role])
    every.sort()
    keys = every & ~np.uint64(3)
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    counts = [np.add.reduceat((every & np.uint64(3)) == r, starts, dtype=np.int64) for r in (MAIN_ROLE, FOLD_ROLE)]
    return keys[starts], counts


def _stats(keys: np.ndarray, sums: list[np.ndarray]) -> list[int]:
    """N and V of the main rows, N and V of all that are learned from."""
    one = (keys & np.uint64(4)) == 0
    main, both = sums[0][one], sums[0][one] + sums[1][one]
    return [int(main.sum()), int((main > 0).sum()), int(both.sum()), int((both > 0).sum())]


def buckets(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.where(context > 0, np.frexp(np.maximum(context, 1).astype(np.float64))[1], 0), BUCKETS - 1)


class _Block:
    """The tokens of a block's texts with the counts that came back for them."""

    def __init__(self, raw: list[bytes], counted: pa.Table, column: str) -> None:
        one, two, self.n = token_keys(raw)
        (count,) = answered(counted, column)
        self.token, self.pair = np.split(count[places(np.concatenate([one, two]))], [len(one)])
        # a text begins in the end's context, which has as many occurrences as there are texts
        ends = np.cumsum(self.n) - 1
        before = np.concatenate(([self.token[-1]], self.token[:-1]))
        before[ends[:-1] + 1] = self.token[-1]
        self.context = before


def learn_weights(rows: list[tuple[int, float | None, float | None, int]], uniform: float) -> np.ndarray:
    """Weights of bigram, unigram and uniform for each bucket, by expectation-maximisation over a histogram with rows (bucket,
    mean log bigram estimate, mean log unigram estimate, tokens); None: the estimate is zero."""
    weights = np.full((BUCKETS, 3), 1 / 3)
    if not rows:
        return weights
    b = np.array([r[0] for r in rows])
    p = np.array([[0.0 if x is None else np.exp(x) for x in r[1:3]] + [uniform] for r in rows])
    n = np.array([r[3] for r in rows], np.float64)
    for _ in range(EM_ROUNDS):
        share = weights[b] * p
        share *= (n / share.sum(1))[:, None]
        got = np.stack([np.bincount(b, share[:, k], BUCKETS) for k in range(3)], 1)
        seen = got.sum(1) > 0
        weights[seen] = np.maximum(got[seen] / got[seen].sum(1)[:, None], LEAST_WEIGHT)
        weights /= weights.sum(1)[:, None]
    return weights


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows whose id is not in TEST. base_score is the add-one unigram's log10 probability, score the mixture's.
    A null text counts as empty and has its end alone; a null id counts as the empty text. Repeated rows count as often as
    they are there. An empty table gives no rows; with nothing to learn from, every token has the uniform probability.
    """
    spark = docs.sparkSession
    fold = F.pmod(F.crc32(F.encode(F.coalesce(F.col("id").cast("string"), F.lit("")), "UTF-8")), F.lit(FOLDS))
    rows = with_blocks(docs, id_col, text_col).select("*", F.when(fold == TEST, TEST_ROLE).when(fold == FOLD, FOLD_ROLE).otherwise(MAIN_ROLE).alias("role"))
    counts = answer(send_keys(rows, ["role"], _block_keys), lambda keys, sums: [sums[0] + sums[1]], _stats, "lm-counts", lambda own: own[1] > 0, lambda keys, sums: [sums[0]])
    stats = counts.filter("block IS NULL").select(*[F.sum(F.col("stats")[k]).alias(f"s{k}") for k in range(4)]).first()
    n_main, v_main, n_all, v_all = (int(x or 0) for x in stats)
    back = counts.filter("block IS NOT NULL")
    kept, held = back.select("block", "part", "counts"), back.select("block", "part", "some").filter("some IS NOT NULL")

    def histogram(_: tuple, texts_of: pa.Table, counted: pa.Table) -> pa.Table:
        names = ["b", "p2", "p1", "n", "s2", "s1"]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.float64())
        if not texts_of.num_rows:
            return pa.Table.from_arrays([pa.array([], k) for k in kinds], names)
        block = _Block(texts(texts_of.column("t")), counted, "some")
        b, pair, context, token = buckets(block.context), block.pair, block.context, block.token
        far = -(1 << 20)
        with np.errstate(divide="ignore"):
            logs = [np.where(x > 0, np.log(x / y), far) for x, y in ((pair, np.maximum(context, 1)), (token, max(n_main, 1)))]
        steps = [np.where(x > far, np.round(STEPS * x), far).astype(np.int64) for x in logs]
        bits = 21
        cells = (b.astype(np.int64) << 2 * bits) | ((steps[0] - far) << bits) | (steps[1] - far)
        at, cells = places(cells), distinct(cells)
        n, sums = np.bincount(at), [pa.array(np.bincount(at, x, len(cells)), kinds[4]) for x in logs]
        cells = [cells >> 2 * bits, ((cells >> bits) & ((1 << bits) - 1)) + far, (cells & ((1 << bits) - 1)) + far]
        return pa.Table.from_arrays([pa.array(cells[0], kinds[0]), *(pa.array(c, kinds[1], mask=c == far) for c in cells[1:]), pa.array(n, kinds[3]), *sums], names)

    # only the held-out texts go here, and the counts of just their keys
    learned = rows.filter(F.col("role") == FOLD_ROLE).select("block", "t").groupBy("block").cogroup(held.groupBy("block")).applyInArrow(histogram, "b int, p2 int, p1 int, n long, s2 double, s1 double") if n_main else None
    mean = lambda p, s: F.when(F.col(p).isNotNull(), F.sum(s) / F.sum("n")).alias(f"m{p}")
    found = [tuple(r) for r in learned.groupBy("b", "p2", "p1").agg(mean("p2", "s2"), mean("p1", "s1"), F.sum("n").alias("n")).select("b", "mp2", "mp1", "n").collect()] if learned is not None else []
    weights = learn_weights(found, 1 / (v_main + 1))
    shared = spark.sparkContext.broadcast((weights, n_all, v_all))
    id_type = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def score(_: tuple, texts_of: pa.Table, counted: pa.Table) -> pa.Table:
        weights, total, vocabulary = shared.value
        role = np.array(texts_of.column("role").to_pylist())
        block = _Block(texts(texts_of.column("t")), counted, "counts")
        starts = np.concatenate(([0], np.cumsum(block.n)[:-1]))
        sums = lambda x: np.add.reduceat(x, starts)
        w = weights[buckets(block.context)]
        p = w[:, 0] * (block.pair / np.maximum(block.context, 1)) + w[:, 1] * (block.token / max(total, 1)) + w[:, 2] / (vocabulary + 1)
        base = np.log10((block.token + 1) / (total + vocabulary + 1))
        cells = [texts_of.column("id").combine_chunks(), pa.array(role == TEST_ROLE), pa.array(block.n), pa.array(sums((block.token > 0).astype(np.int64))), pa.array(np.full(len(role), total)), pa.array(sums(base)), pa.array(sums(np.log10(p)))]
        return pa.Table.from_arrays(cells, names)

    schema = f"`{id_col}` {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return rows.groupBy("block").cogroup(kept.groupBy("block")).applyInArrow(score, schema)


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's scores."""
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
