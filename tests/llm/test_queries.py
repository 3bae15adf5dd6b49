"""The registered queries themselves, column by column, against plain versions on small tables; empty tables; clashing names."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import common, decontaminate, exact_dedup, jaccard_join, lm_score, queries, token_files, url_filter

from test_operators import BPE, P, brute_components, brute_hits, judged, lowered, plain_spans, prose
from test_trie_negatives_repeats import brute_negatives, brute_repeats, brute_trie

SHA = lambda s: hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()
DOCS = "doc_id long, text string, lang string, source string, n_chars int"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """All tables, small, with nulls, empty and long texts, copies and personal data; the folder and the rows."""
    rnd = random.Random(31)
    texts = [prose(rnd, rnd.randint(1, 90), 200) for _ in range(60)]
    texts += [texts[3], texts[4].upper(), texts[5] + " tail", None, "", " \n ", "a@b.co 1.2.3.4 +49 30 1234567 4111 1111 1111 1111 é a@b.co", 'token = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8"', "long " * 9000, "日本 İ <|endoftext|> x"]
    rows = {"documents": [(i * 7, t, "en", f"s{i % 2}", 1) for i, t in enumerate(texts)]}
    rows["benchmark"] = [(0, " ".join(texts[20].split()[:30])), (1, prose(rnd, 30)), (2, "one two"), (3, None)]
    rows["labels"] = [(i * 7, int(i % 5 > 0), 0) for i in range(60)]
    urls = ["http://Example.com/en/x", "https://a.net/es/1", "http://x.org:80/", "http://m.free-bets.example.com?x", None, "no", "http://h/" + "p/" * 3000]
    rows["pages"] = [(i, u, "<p>x</p>") for i, u in enumerate(urls)]
    rows["conversations"] = [(1, 0, "user", "a"), (1, 1, "assistant", "b <c> #\\"), (2, 0, "assistant", None), (1, 2, "assistant", "é")]
    rows["embeddings"] = [(i, [rnd.gauss(0, 0.2) for _ in range(5)], i % 3) for i in range(230)] + [(900, None, 1), (901, [0.1] * 5, None)]
    kinds = {"embeddings": "vec_id long, embedding array<float>, label int", "documents": DOCS, "benchmark": "item_id long, text string", "labels": "doc_id long, quality int, toxic int", "pages": "page_id long, url string, html string", "conversations": "conv_id long, turn long, role string, text string"}
    full, none = (str(tmp_path_factory.mktemp(x)) for x in ("full", "none"))
    for name, kind in kinds.items():
        df = spark.createDataFrame(rows[name], kind)
        df.repartition(2).write.parquet(f"{full}/{name}.parquet")
        df.limit(0).write.parquet(f"{none}/{name}.parquet")
    return full, none, rows


def result(spark, name, folder):
    return queries.QUERIES[name](spark, folder).collect()


def test_op1(spark, tables):
    import tiktoken

    from lodestone.llm import byte_bpe

    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.tokenizer(BPE, P.PATTERN).ranks, special_tokens={})
    want = {i: (len(ids := plain.encode_ordinary(t or "")), SHA(",".join(map(str, ids))), SHA(t or "")) for i, t, *_ in tables[2]["documents"]}
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in result(spark, "op1_byte_bpe", tables[0])} == want


def test_op2(spark, tables):
    got = result(spark, "op2_quality", tables[0])
    assert {r.doc_id for r in got} == {r[0] for r in tables[2]["documents"]} and len(got) == len(tables[2]["documents"])
    least = min(r.sample_key for r in got if r.kept)
    assert all(r.kept == (r.sample_key >= least) for r in got)


def test_op3(spark, tables):
    rows = [(i, lowered(t)) for i, t, *_ in tables[2]["documents"]]
    last, size = {t: i for i, t in sorted(rows)}, Counter(t for _, t in rows)
    want = {i: (last[t], size[t], last[t] == i, SHA(t)) for i, t in rows}
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in result(spark, "op3_exact_dedup", tables[0])} == want


def test_op4(spark, tables):
    rows = [(i, zlib.crc32(str(i).encode()) % 7 == 2, [*(t or "").encode().lower().split(), None]) for i, t, *_ in tables[2]["documents"]]
    seen = Counter(x for _, held, w in rows if not held for x in w)
    want = {i: (held, len(w), sum(seen[x] > 0 for x in w), sum(seen.values())) for i, held, w in rows}
    got = result(spark, "op4_lm_score", tables[0])
    assert {r.doc_id: (r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in got} == want and all(r.score < 0 and r.base_score < 0 for r in got)


def test_op5(spark, tables):
    import numpy as np
    from tokenizers import Tokenizer

    plain, at, want = Tokenizer.from_file(P.path("word_bpe_49k.json")), 0, {}
    for i, t, *_ in sorted(tables[2]["documents"], key=lambda r: r[0]):
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want[i] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in result(spark, "op5_token_files", tables[0])} == want


def test_op6(spark, tables):
    got = result(spark, "op6_jaccard_join", tables[0])
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components([(i, t) for i, t, *_ in tables[2]["documents"]])


def test_op7(spark, tables):
    listed = {u.removeprefix("http://"): "block" for u in url_filter.LISTED_URLS}
    want = {i: judged(u, url_filter.RULES, listed)[:4] for i, u, _ in tables[2]["pages"]}
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in result(spark, "op7_url_filter", tables[0])} == want
    assert want[3][3] == "block" and want[2][3] == "allow"


def test_op8(spark, tables):
    got = {r.conv_id: r for r in result(spark, "op8_chat_format", tables[0])}
    odd = r"\### Assistant: </turn> ok"
    assert set(got) == {1, 2, -7}
    assert (got[-7].n_turns, got[-7].turns_sha256, got[-7].loss_sha256) == (2, SHA(f"user\n{odd}\nassistant\n{odd}\n"), SHA(odd))
    assert (got[1].loss_chars, got[1].loss_sha256, got[1].n_examples) == (len("b <c> #\\é"), SHA("b <c> #\\é"), 2)
    assert (got[2].n_turns, got[2].loss_chars, got[2].turns_sha256) == (1, 0, SHA("assistant\n\n"))


def test_op9(spark, tables):
    for r in result(spark, "op9_pii", tables[0]):
        text = next(t for i, t, *_ in tables[2]["documents"] if i == r.doc_id) or ""
        plain = plain_spans(text)
        count = Counter(k for k, *_ in plain)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(count[k] for k in ("email", "ip", "card", "phone"))
        spans = ",".join(f"{k}:{a}:{z}" for k, a, z in plain)
        assert r.base_sha256 == SHA(spans) and r.spans.startswith(spans)
        assert (r.n_secret == 1) == text.startswith("token") and r.n_spans == sum(map(bool, r.spans.split(",")))


def test_op10(spark, tables):
    for r in result(spark, "op10_decontaminate", tables[0]):
        n, hit, items = brute_hits(next(t for i, t, *_ in tables[2]["documents"] if i == r.doc_id), tables[2]["benchmark"])
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n, hit, len(items), SHA(",".join(items)), hit > 0)


def test_op11(spark, tables):
    rows = [r for r in tables[2]["conversations"]]
    got = sorted((tuple(r) for r in result(spark, "op11_prefix_trie", tables[0])), key=repr)
    assert got == brute_trie(rows)


def test_op12(spark, tables):
    single = lambda v: v and np.array(v, np.float32).astype(float).tolist()
    rows = [(i, single(v), (label + 1) % 10 if label is not None and i % 7 == 0 else label) for i, v, label in tables[2]["embeddings"]]
    got = sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in result(spark, "op12_hard_negatives", tables[0]))
    assert got == brute_negatives(rows, 100) and got


def test_op13(spark, tables):
    want = {i: (n, n - len(kept), len(spans), SHA(kept)) for i, n, spans, kept in brute_repeats([(i, t) for i, t, *_ in tables[2]["documents"]], 50)}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in result(spark, "op13_suffix_dedup", tables[0])}
    assert got == want and sum(x[1] for x in want.values()) > 0


def test_empty_tables(spark, tables):
    import corpus_pipeline

    for name in queries.QUERIES:
        assert [r.conv_id for r in result(spark, name, tables[1])] == [-7] if name.startswith("op8") else not result(spark, name, tables[1]), name
    assert corpus_pipeline.run(spark, tables[1]).count() == 0


def test_clashing_names_keep_their_values(spark, tmp_path):
    """Columns that are named as an operator's own, now or ever, come back as they were."""
    names = "block own_id own_sha kept_id kept_sha gone t n_words found pieces items spans hit_n __hit_n __id __own __file __row __gone q_key noise file at group token".split()
    texts = ["a b c d e f g", "a b c d e f g", "a b c d e f h i j k l m n o", None]
    rows = [(i, t, *(f"{n}{i}" for n in names)) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names)
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "d"))
    docs, was = spark.read.parquet(str(tmp_path / "d")), {r[0]: r for r in rows}
    bench = spark.createDataFrame([(0, "x y z")], "item_id long, text string")
    for kept, ids in ((exact_dedup.exact_dedup(docs), {1, 2, 3}), (jaccard_join.dedup_near(docs), {0, 2, 3}), (decontaminate.decontaminate(docs, bench), {0, 1, 2, 3})):
        assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
        assert {r.doc_id: tuple(r) for r in kept.collect()} == {i: was[i] for i in ids}
    assert lm_score.lm_scores(docs).count() == 4 == jaccard_join.jaccard_components(docs).count()


def test_ids_of_any_type(spark):
    rows = spark.createDataFrame([("x", "a"), ("y", "A"), (None, "a"), ("z", "b"), (None, None)], "doc_id string, text string")
    got = {(r.id, r.text_sha256): (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(rows).collect()}
    assert got["x", SHA("a")] == ("y", 3, False) and got["y", SHA("a")] == ("y", 3, True) and got[None, SHA("a")] == ("y", 3, False)
    assert sorted(r.text for r in exact_dedup.exact_dedup(rows).collect() if r.text) == ["A", "b"]


def test_long_items_are_split(spark, monkeypatch):
    """Words between line ends count as words, and one item may need several rounds."""
    rnd = random.Random(3)
    item = "\n".join(prose(rnd, 300, 10**6).split())
    bench = spark.createDataFrame([(0, item), (1, "x" * 5000 + " y")], "item_id long, text string")
    pairs = decontaminate.benchmark_windows(bench, "item_id", "text")
    monkeypatch.setattr(decontaminate, "WINDOWS_AT_ONCE", 100)
    rounds = [w for w, _ in decontaminate._rounds(pairs)]
    assert len(rounds) == 4 and sum(len(w.words) for w in rounds) == 292 and max(len(w.words) for w in rounds) < 130
    docs = spark.createDataFrame([(1, item.replace("\n", " ")), (2, "x" * 5000 + ", Y"), (3, prose(rnd, 50))], "doc_id long, text string")
    got = {r.doc_id: (r.hit_n, r.hit_items) for r in decontaminate.find_windows(docs, bench).collect()}
    assert got == {1: (300, ["0"]), 2: (2, ["1"]), 3: (0, [])}


def test_grammar_is_whole():
    """Re-Pair ends only when no pair is frequent; long runs shrink to their logarithm."""
    import numpy as np

    ids = np.array([7, 8, 9] * 50_000, np.uint32)
    payload = token_files.compress(ids)
    assert len(payload) < 400 and np.array_equal(token_files.Shard(payload).ids(), ids)
    rnd = random.Random(5)
    words = [[rnd.randrange(30) for _ in range(rnd.randint(1, 6))] for _ in range(80)]
    ids = np.array([x for _ in range(20_000) for x in rnd.choice(words)], np.uint32)
    seq = token_files.Shard(token_files.compress(ids)).seq
    pairs = Counter(zip(seq[:-1].tolist(), seq[1:].tolist(), strict=True))
    assert max(n for (a, b), n in pairs.items() if a != b) < 2 * token_files.LEAST_COUNT


def test_names_and_folders(spark):
    df = spark.range(1).select(F.col("id").alias("a"), F.col("id").alias("B_"))
    assert common.unused(df, "a", "b", "B_", "c") == ["a_", "b", "B__", "c"]
    assert common.unused_prefix(df, "b") == "b__" and common.unused_prefix(df, "x") == "x"
    with common.begun() as outer:
        common.stored(df, "one")
        with common.begun() as inner:
            kept = common.stored(df, "two")
        assert len(inner) == 1 and len(outer) == 2
    common.drop_tables(spark, outer)
    with pytest.raises(Exception, match="(?i)not.exist"):
        kept.collect()
