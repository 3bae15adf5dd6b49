"""The prefix trie, hard negatives and repeated strings against plain versions; nulls, ties, repeated rows, frequent keys, empty tables."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import hard_negatives, prefix_trie, suffix_arrays, suffix_dedup

SHA = lambda b: hashlib.sha256(b).hexdigest()
TURNS = "conv_id long, turn long, role string, text string"


# ---- suffix arrays and repeated strings


def test_suffix_arrays():
    rnd = random.Random(4)
    for _ in range(300):
        texts = [[rnd.randint(1, rnd.choice([1, 2, 3, 250])) for _ in range(rnd.randint(0, 40))] + [0] for _ in range(rnd.randint(1, 5))]
        x, ends = np.array([c for t in texts for c in t]), np.cumsum([len(t) for t in texts])
        got = suffix_arrays.suffix_arrays(x, ends)
        for t, e in zip(texts, ends.tolist(), strict=True):
            assert [i - e + len(t) for i in got[e - len(t) : e].tolist()] == sorted(range(len(t)), key=lambda i: t[i:])


def test_suffix_arrays_of_runs():
    x = np.array([1] * 5000 + [0] + [1, 2] * 2500 + [0])
    got = suffix_arrays.suffix_arrays(x, np.array([5001, 10002]))
    assert got[:5001].tolist() == [5000, *range(4999, -1, -1)] and got[5001] == 10001 and (got[5002:7502] % 2 == 1).all()


def brute_repeats(rows, length):
    """(id, n_bytes, spans, kept) of each row."""
    raw = [(i, (t or "").encode()) for i, t in rows]
    least = {}
    for i, b in raw:
        for a in range(len(b) - length + 1) if i is not None else ():
            w = b[a : a + length]
            least[w] = min(least.get(w, i), i)
    out = []
    for i, b in raw:
        gone = [False] * len(b)
        for a in range(len(b) - length + 1) if i is not None else ():
            if least[b[a : a + length]] < i:
                gone[a : a + length] = [True] * length
        spans = [(a, next((z for z in range(a, len(b)) if not gone[z]), len(b))) for a in range(len(b)) if gone[a] and (a == 0 or not gone[a - 1])]
        out.append((i, len(b), spans, bytes(c for c, g in zip(b, gone, strict=True) if not g)))
    return sorted(out, key=repr)


def repeats(spark, rows, length):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"block": F.lit(1), "t": F.lit("x"), "spans": F.lit(2)}).repartition(3)
    return sorted(((r.doc_id, r.n_bytes, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in suffix_dedup.repeated_spans(df, length=length).collect()), key=repr)


def sayings(rnd, words=300):
    vocabulary = ["".join(rnd.choice("abcdeé日") for _ in range(rnd.randint(1, 7))) for _ in range(words)]
    return lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))


@pytest.mark.parametrize("length", [50, 9])
def test_repeated_spans(spark, length):
    rnd = random.Random(length)
    say = sayings(rnd)
    shared = [say(30) for _ in range(3)]
    rows = []
    for i in range(60):
        parts = [say(rnd.randint(0, 40)), rnd.choice(shared)[rnd.randint(0, 60) :], say(5), rnd.choice(shared)[: rnd.randint(40, 120)]]
        rows.append((rnd.randint(0, 10**6), " ".join(rnd.sample(parts, rnd.randint(1, 4)))))
    rows += [(5, rows[3][1]), (5, rows[3][1]), (None, rows[4][1]), (None, None), (7, None), (8, ""), (-1, "ab" * 400), (9, "ab" * 30 + "x" + "ab" * 300), (10, "a" * 3000), (11, "b" * 48), (12, "b" * 49)]
    assert repeats(spark, rows, length) == brute_repeats(rows, length)


def test_frequent_grams_are_cut_finer(spark):
    """A passage of more than FINE documents, whose surroundings all differ; and one that some of them go on with."""
    rnd = random.Random(8)
    say = sayings(rnd)
    passage, rest = say(25), say(12)
    rows = [(i, f"{say(6)} {passage} {rest if i % 3 == 0 else say(6)}") for i in range(3 * suffix_dedup.FINE)]
    assert repeats(spark, rows, 50) == brute_repeats(rows, 50)


def test_no_texts(spark):
    assert repeats(spark, [], 50) == [] and repeats(spark, [(1, None), (2, "x")], 50) == [(1, 0, [], b""), (2, 1, [], b"x")]


# ---- prefix trie


def brute_trie(rows):
    """The contract's rows, from plain Python."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(t)] for c, t in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(math.fmod(c, 5))
        built[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, t in built.items():
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    save = lambda p: (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0

    def below(p):
        own = [below(c) for c in children[p]]
        return (sum(x[0] for x in own) or 1, save(p) + sum(x[1] for x in own))

    out = []
    for p, m in members.items():
        ends = SHA(",".join(map(str, sorted(c for c in m if len(built[c]) == len(p)))).encode())
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), *below(p), ends))
    return sorted(out, key=repr)


def trie(spark, rows, tmp_path):
    df = spark.createDataFrame(rows, TURNS).withColumns({"at": F.lit("x"), "depth": F.lit(1), "digest": F.lit(2), "n_bytes": F.lit(3)})
    df.repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    return sorted((tuple(r) for r in prefix_trie.op11_prefix_trie(spark, str(tmp_path)).collect()), key=repr)


def test_prefix_trie(spark, tmp_path):
    rnd = random.Random(11)
    rows = [(c, t, rnd.choice(["user", "assistant", None]), rnd.choice(["a", "é", "日本", "", None])) for c in range(-12, 60) for t in range(rnd.choice([1, 2, 3, 12]))]
    rows += [(70, None, "user", "z"), (70, 0, "user", "y"), (71, 0, "user", "x"), (71, 0, "user", "x"), (None, 0, "user", "lost"), (103, 0, "user", "only"), (104, 0, "us", "er:"), (104, 0, "use", "r:")]
    assert trie(spark, rows, tmp_path) == brute_trie(rows)


def test_prefix_trie_of_a_frequent_conversation(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE_IDS", 7)
    rows = [(c, t, "user", f"same {t}") for c in range(200) for t in range(9)] + [(1000, t, "user", f"long {t}") for t in range(300)]
    assert trie(spark, rows, tmp_path) == brute_trie(rows)


def test_prefix_trie_of_nothing(spark, tmp_path):
    assert trie(spark, [], tmp_path) == []


# ---- hard negatives


def brute_negatives(rows, every, k=5):
    seen = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        seen[i] = min(seen.get(i, (label, v)), (label, v))
    whole = {i: (label, [math.floor(256 * x) for x in v]) for i, (label, v) in seen.items()}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for a, (label, v) in whole.items():
        if a % every:
            continue
        scored = sorted((-dot(v, w), i, other) for i, (other, w) in whole.items() if i != a)
        for s, p, _ in [x for x in scored if x[2] == label][:k]:
            found = [x for x in scored if x[2] != label and -80 * s <= -100 * x[0] <= -100 * s][:k]
            out += [(a, p, r, n, -s, -t) for r, (t, n, _) in enumerate(found, 1)]
    return sorted(out)


def negatives(spark, rows, every):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({"id": F.lit("x"), "v": F.lit(1), "block": F.lit(2)}).repartition(3)
    return sorted(tuple(r) for r in hard_negatives.hard_negatives(df, F.col("id") % every == 0).collect())


def test_hard_negatives(spark, monkeypatch):
    """Several blocks and parts; ties, copies, nulls and odd numbers; all results, so recall is 1."""
    for name, n in (("ANCHORS", 8), ("AT_ONCE", 3), ("PART_ROWS", 16), ("PAIRS", 50)):
        monkeypatch.setattr(hard_negatives, name, n)
    rnd = random.Random(2)
    draw = lambda n: [rnd.choice([rnd.gauss(0, 0.2), 0.25]) for _ in range(n)]
    rows = [(i, draw(7), rnd.randint(0, 3)) for i in range(300)]
    rows += [(1000 + i, rows[i][1], (rows[i][2] + 1) % 4) for i in range(40)]
    rows += [(5, draw(7), 0), (rows[9]), (None, draw(7), 1), (2001, None, 1), (2002, draw(7), None), (2003, [*draw(6), None], 1), (2004, [*draw(6), float("nan")], 1), (2005, [float("inf"), *draw(6)], 1), (2006, [], 1), (2007, draw(3), 1), (2008, draw(9), 2)]
    got = negatives(spark, rows, 10)
    assert got == brute_negatives(rows, 10) and len(got) > 300


def test_hard_negatives_broadcast_no_blocks(spark):
    # anchors that are small before they are repeated for every lot
    rows = spark.range(300).selectExpr("id AS vec_id", "id % 3 AS label", "array(float(id % 7), float(id % 5)) AS embedding")
    index = hard_negatives.build_index(hard_negatives.whole_rows(rows, F.col("label"), "vec_id"))
    blocks, n = hard_negatives._blocks_of(hard_negatives.whole_rows(rows, F.col("label")).filter("id % 100 = 0"), index.dims, 256.0, False)
    found = hard_negatives._search(index, blocks, n, 5, True)
    found.collect()
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    wide = np.array([[1 << 40, -3], [5, 1 << 20]])
    assert all((hard_negatives._wide(hard_negatives._narrow(x), 2, 2) == x).all() for x in (wide, wide[1:].repeat(2, 0), wide % 100))


def test_hard_negatives_of_few_rows(spark):
    assert negatives(spark, [], 1) == []
    same = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [-1.0, 0.0], 2)]
    assert negatives(spark, same, 1) == [] == brute_negatives(same, 1)
    rows = [*same, (3, [0.9, 0.5], 2), (4, [0.9, 0.5], 2)]
    assert negatives(spark, rows, 1) == brute_negatives(rows, 1) != []
    with pytest.raises(Exception, match="64 bits"):
        negatives(spark, [(0, [1e12], 1), (1, [1e12], 1)], 1)


def test_bounds_hold():
    """No true score lies outside the bounds that the codes give."""
    rnd = np.random.default_rng(3)
    rows = rnd.integers(-200, 200, (500, 12))
    centres = hard_negatives.fit_centres(rows[:100])
    codes, left = hard_negatives.quantised(rows, centres)
    back = np.concatenate([own[codes[:, j]] for j, own in enumerate(centres)], axis=1)
    gap = np.abs(rows @ rows[:50].T - back @ rows[:50].T)
    assert (gap <= left[:, None] * np.linalg.norm(rows[:50], axis=1) + 1e-6).all()
