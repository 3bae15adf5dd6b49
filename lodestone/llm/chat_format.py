r"""Chat formatting by prefix-target expansion.

A turn is formatted as "### role: text</turn>\n". Inside roles and texts a backslash goes before every backslash, # and <
(in roles before every colon too), so no control string can occur there, and dropping one backslash of each pair gives
the text back.

Every assistant turn becomes an example of its own, a row beside the rows of the turns: all turns before it are context, and only
its text is trainable. A conversation of k turns has up to k such contexts, each a prefix of the next. The text is therefore
kept once: a piece for each turn with its place in the conversation's formatted text, and an example as ranges of that text.
example_texts() writes the contexts out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bound_batches

HEAD, MIDDLE, END = "### ", ": ", "</turn>\n"
PIECE = re.compile(r"(?s)### ((?:[^\\:]|\\.)*): ((?:[^\\#<]|\\.)*)</turn>\n")
ESCAPED = re.compile(r"(?s)\\(.)")


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def _escaped(c: Column, also: str = "") -> Column:
    return F.regexp_replace(c, rf"([\\#<{also}])", r"\\$1")


def format_turns(conversations: DataFrame) -> DataFrame:
    """One row per input row: conv_id, index (0-based place in its conversation), role, piece (the formatted turn), and start
    and end (code points: its place in the conversation's formatted text).

    Turns go in the order of turn, then role, then text; nulls come first and count as empty texts and roles. Repeated
    rows are turns of their own, and rows without conv_id are one conversation. Other columns are not read.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    turns = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    turns = turns.withColumn("piece", F.concat(_head(), _escaped(F.col("text")), F.lit(END)))
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    return turns.select(
        "conv_id",
        (F.row_number().over(order) - 1).cast("long").alias("index"),
        "role",
        "piece",
        F.sum(F.length("piece").cast("long")).over(order.rowsBetween(W.unboundedPreceding, 0)).alias("end"),
    ).withColumn("start", F.col("end") - F.length("piece"))


def _head() -> Column:
    return F.concat(F.lit(HEAD), _escaped(F.col("role"), ":"), F.lit(MIDDLE))


def expand(pieces: DataFrame, trained: str = "assistant") -> DataFrame:
    """One row for each turn, and one more for each example: conv_id, index (the turn's, which an example ends with), piece (of turns;
    null in examples), and of examples context_end (the context is the conversation's formatted text up to there: all preceding turns
    and the reply's own head), loss_start and loss_end (the range under the loss mask: that reply's text and nothing else).

    Every turn of the trained role gives an example. A reply with an empty text has an empty range; a reply that comes first has its
    own head as context. An empty table gives an empty one.
    """
    reply = F.col("start") + F.length(_head())
    none = F.lit(None).cast("long")
    turn = F.struct("piece", none.alias("context_end"), none.alias("loss_start"), none.alias("loss_end"))
    example = F.struct(F.lit(None).cast("string").alias("piece"), reply.alias("context_end"), reply.alias("loss_start"), (F.col("end") - len(END)).alias("loss_end"))
    return pieces.select("conv_id", "index", F.inline(F.when(F.col("role") == trained, F.array(turn, example)).otherwise(F.array(turn))))


def _in_order(expanded: DataFrame) -> DataFrame:
    """A conversation's turns in order, each followed by its example."""
    return expanded.select("conv_id", "index", "piece", "context_end", "loss_start", "loss_end").sortWithinPartitions("conv_id", "index", F.col("context_end").asc_nulls_first())


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def example_texts(expanded: DataFrame) -> DataFrame:
    """The examples written out: conv_id, example (the index of the reply), context and target. Reads each conversation
    once, in order; what it writes is the sum of all contexts, which is the square of a conversation's length."""
    bound_batches(expanded.sparkSession)
    kind = expanded.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, before, size = object(), [], 0
        for b in batches:
            for own, index, piece, end, a, z in _streamed([b]):
                if own != conv:
                    conv, before, size = own, [], 0
                if piece is not None:
                    before.append(piece)
                    size += len(piece)
                    continue
                start = size - len(before[-1])
                cells = [[own], [index], ["".join([*before[:-1], before[-1][: end - start]])], [before[-1][a - start : z - start]]]
                kinds = (b.schema.field("conv_id").type, pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], ["conv_id", "example", "context", "target"])

    return _in_order(expanded.repartition("conv_id")).mapInArrow(run, f"conv_id {kind}, example long, context string, target string")


class _Conversation:
    """What is known of a conversation after some of its turns and examples."""

    def __init__(self, conv_id: object) -> None:
        self.id, self.turns, self.chars, self.examples, self.loss_chars, self.last = conv_id, 0, 0, 0, 0, ""
        self.said, self.loss, self.text, self.contexts = (hashlib.sha256() for _ in range(4))

    def turn(self, piece: str) -> None:
        self.text.update(self.last.encode())
        role, text = map(unescape, PIECE.fullmatch(piece).groups())
        self.said.update(f"{role}\n{text}\n".encode())
        self.turns, self.chars, self.last = self.turns + 1, self.chars + len(piece), piece

    def example(self, context_end: int, a: int, z: int) -> None:
        start = self.chars - len(self.last)
        if not start < context_end == a <= z <= self.chars - len(END):
            raise ValueError(f"conversation {self.id}: an example's ranges don't end in its last turn")
        context = self.text.copy()
        context.update(self.last[: context_end - start].encode())
        self.contexts.update(context.hexdigest().encode())
        loss = unescape(self.last[a - start : z - start])
        self.loss.update(loss.encode())
        self.examples, self.loss_chars = self.examples + 1, self.loss_chars + len(loss)

    def row(self) -> tuple:
        return self.id, self.turns, self.said.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.examples, self.contexts.hexdigest()


def read_back(expanded: DataFrame) -> DataFrame:
    """What the formatted conversations hold, parsed from the pieces and the examples' ranges alone, wherever their rows lie (an empty table gives an empty one): conv_id, n_turns,
    turns_sha256, loss_chars, loss_sha256, formatted_chars, n_examples and contexts_sha256 (of the examples' contexts' hexadecimal
    SHA-256 one after the other). Loss and contexts come from the example rows. Conversations stream by in order, so a long one
    takes no memory; as its digests are over its whole text, it is one task's work."""
    bound_batches(expanded.sparkSession)
    kind = expanded.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_examples", "contexts_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        conv: _Conversation | None = None

        def flush(kind: pa.DataType) -> pa.RecordBatch:
            cols = list(zip(*done, strict=True)) or [()] * len(names)
            done.clear()
            kinds = (kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

        for b in batches:
            for own, _, piece, end, a, z in _streamed([b]):
                if conv is None or conv.id != own:
                    if conv:
                        done.append(conv.row())
                    conv = _Conversation(own)
                if piece is not None:
                    conv.turn(piece)
                else:
                    conv.example(end, a, z)
            yield flush(b.schema.field("conv_id").type)
        if conv:
            done.append(conv.row())
            yield flush(b.schema.field("conv_id").type)

    return _in_order(expanded.repartition("conv_id")).mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long, contexts_sha256 string")


#: Control strings in texts, added to what op8 formats; its contract fixes it.
PLANTED = (-7, r"\### Assistant: </turn> ok")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and PLANTED, formatted and read back from the output."""
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame([(PLANTED[0], i, r, PLANTED[1]) for i, r in enumerate(("user", "assistant"))], conversations.schema)
    return read_back(expand(format_turns(conversations.unionByName(planted))))


_ESC = r"regexp_replace({}, '([\\#<{}])', '\\\1', 'g')"
ORACLE = {
    "op8_chat_format": rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT {PLANTED[0]}, i, r, '{PLANTED[1]}' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, r)),
p AS (SELECT *, '{HEAD}' || {_ESC.format("role", ":")} || '{MIDDLE}' AS head, {_ESC.format("text", "")} || '</turn>' || chr(10) AS rest FROM t),
c AS (SELECT *, sha256(coalesce(string_agg(head || rest, '') OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') || head) AS context FROM p)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(head) + length(rest))::BIGINT AS formatted_chars, count(*) FILTER (role = 'assistant') AS n_examples,
  sha256(coalesce(string_agg(context, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS contexts_sha256
FROM c GROUP BY conv_id"""
}
