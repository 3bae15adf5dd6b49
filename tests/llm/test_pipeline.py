"""The pipeline's stages, each against a plain version on its own input, and the whole."""

import random

import corpus_pipeline

from test_operators import brute_components, brute_hits, lowered, prose


def test_pipeline(spark, tmp_path):
    rnd = random.Random(21)
    good = [prose(rnd, rnd.randint(20, 120), 300) for _ in range(150)]
    bad = [" ".join(w + "!!" for w in prose(rnd, 60, 300).split()) for _ in range(40)]
    near = [good[k] + " tail" for k in range(100, 106)]
    texts = good + bad + good[:10] + [good[3].upper()] + near + [None, ""]
    rows = [(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    bench = [(0, good[60]), (1, prose(rnd, 30))]
    sf = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").repartition(2).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, int(i < 150), 0) for i in range(190)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{sf}/{k}")
        docs = spark.read.parquet(f"{sf}/{k}")
        got = {r.doc_id: r.text for r in docs.collect()}
        assert docs.count() == len(got)
        if name == "quality":
            assert sum(i < 150 for i in got) >= 145 and sum(150 <= i < 190 for i in got) <= 4
        elif name == "exact_dedup":
            best = {}
            for i, t in kept.items():
                best[lowered(t)] = max(best.get(lowered(t), i), i)
            assert set(got) == set(best.values())
        elif name == "near_dedup":
            assert set(got) == {c for _, n, c in brute_components(list(kept.items())) if n} | {i for i, n, _ in brute_components(list(kept.items())) if not n}
        elif name == "decontaminate":
            assert set(got) == {i for i, t in kept.items() if not brute_hits(t, bench)[1]} and len(got) < len(kept)
        else:
            assert docs.columns == [*columns, "token_ids"] and got == kept
        if name != "encode":
            assert docs.columns == columns
        kept = got
    whole = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in whole.collect()} == set(kept) and corpus_pipeline.ORACLE_SQL is None
