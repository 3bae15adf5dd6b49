"""Repeated rows, very long secrets, stored examples and other tokenizer files."""

import random
import time
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from lodestone.llm import chat_format, jaccard_join, pii, token_files


def test_one_of_repeated_rows_stays(spark, tmp_path):
    rnd = random.Random(1)
    say = lambda n: " ".join(f"w{rnd.randrange(500)}" for _ in range(n))
    t, u, v = say(60), say(60), say(60)
    near = t.replace(t.split()[30], "other", 1)
    rows = [(1, t), (1, t), (2, u), (3, None), (3, None), (4, near), (4, v), (None, t), (None, v), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.repartition(2).write.parquet(str(tmp_path / "d"))
    for docs in (df, spark.read.parquet(str(tmp_path / "d")), df.union(df)):
        got = sorted(((r.doc_id, r.text) for r in jaccard_join.dedup_near(docs).collect()), key=repr)
        empty = [(3, None), (3, None), (5, "")] * (2 if docs is not df and docs.count() > len(rows) else 1)
        assert got == sorted([(1, t), (2, u), (4, v), *empty], key=repr)


def test_secrets_of_any_length():
    rnd = random.Random(2)
    draw = lambda n, letters: "".join(rnd.choice(letters) for _ in range(n))
    base64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    for n in (300, 5000):
        token, digest = draw(n, base64), draw(n, "0123456789abcdef")
        jwt = f"eyJ{draw(n, base64)}.eyJ{draw(2 * n, base64)}.{draw(n, base64)}"
        for text, value in ((f"token={token} end", token), (f"secret key {digest} end", digest), (f"see x-{jwt}, end", jwt), (f"sk-{token} end", f"sk-{token}")):
            start = text.index(value)
            assert ("secret", start, start + len(value)) in [x[:3] for x in pii.find_spans(text)], (n, text[:20])


@pytest.mark.parametrize("unit", ["eyJ-", "eyJa.", "eyJaaaaaaaaaa.", "sk-", "=a1", "0a", "a.b", "github_pat_", "token="])
def test_time_is_linear(unit):
    def seconds(n):
        text = unit * (n // len(unit))
        started = time.perf_counter()
        pii.find_spans(text)
        return time.perf_counter() - started

    seconds(1000)
    assert seconds(400_000) < 40 * (seconds(40_000) + 0.02)


def test_stored_examples_are_read_back(spark, tmp_path):
    rows = [(c, i, "assistant" if i % 2 else "user", f"t{c} {i}") for c in range(40) for i in range(5)]
    expanded = chat_format.expand(chat_format.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    expanded.orderBy(F.rand(3)).repartition(5).write.parquet(str(tmp_path / "e"))
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(chat_format.read_back(spark.read.parquet(str(tmp_path / "e")))) == key(chat_format.read_back(expanded))
    assert chat_format.read_back(expanded.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_other_tokenizers_and_ids(spark, name):
    from tokenizers import Tokenizer

    rows = [("b", "Hello World, it's a (test)..."), ("a", None), ("c", "  Two\n\nlines  é日本 "), ("aa", "")]
    got = {r.doc_id: r for r in token_files.read_token_files(token_files.write_token_files(spark.createDataFrame(rows, "doc_id string, text string"), P.path(name), 2)).collect()}
    plain, at = Tokenizer.from_file(P.path(name)), 0
    for i, t in sorted(rows):
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
