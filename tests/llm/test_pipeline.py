"""The pipeline's stages, each against a plain version of its rule on its own input."""

import random

import corpus_pipeline
from pyspark.sql import functions as F

from tests.llm.test_brute_force import DOCS, SPACE_WORD, plain_components, plain_contamination, plain_fingerprint, plain_lines, prose


def make(spark, path):
    rng = random.Random(11)
    items = [(i, prose(rng, 25)) for i in range(6)]
    texts = []
    for i in range(150):
        t = prose(rng, rng.randint(60, 200))
        if i % 10 == 3:
            t = t + items[i % 6][1]
        if i % 12 == 5:
            t = " ".join(w + "***" for w in t.split())
        texts.append(t)
    texts += texts[:20] + [t[:-30] + "end of it" for t in texts[20:40]] + [None, "", " "]
    rows = [(i, t, "en", f"s{i % 3}" if i % 5 else None, None if t is None else len(t), "x", "x", "x", "x") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 150, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return items


def test_stages(spark, tmp_path):
    items = make(spark, tmp_path)
    d = str(tmp_path)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        rows = docs.collect()
        before = [(r["doc_id"], r["text"]) for r in rows]
        out = stage(spark, docs, d)
        out.write.parquet(f"{d}/out{k}")
        out = spark.read.parquet(f"{d}/out{k}")
        after = {r["doc_id"]: r for r in out.collect()}
        if k < 4:
            assert out.columns == columns
            assert out.where((F.length("text") != F.col("n_chars")) & F.col("text").isNotNull()).count() == 0
        if name == "quality classifier":
            assert set(after) <= {i for i, _ in before}
            bad = {i for i, t in before if t and "***" in t}
            assert len(bad & set(after)) <= 0.1 * len(bad)
            assert len(set(after) - bad) >= 0.9 * (len(before) - len(bad))
        elif name == "line dedup":
            want, _ = plain_lines(before, 3, 50)
            assert set(after) == {i for i, (n, gone) in want.items() if not n or n > gone}
        elif name == "near dedup":
            parts = plain_components({i: plain_fingerprint(t) for i, t in before})
            assert set(after) == {i for i, p in parts.items() if i == p}
        elif name == "decontamination":
            want = plain_contamination(before, items)
            assert set(after) == {i for i, x in want.items() if not x[4]}
        else:
            assert set(after) == {i for i, _ in before}
            assert all(r["size"] == len(SPACE_WORD.findall(dict(before)[i] or "")) for i, r in after.items())
            assert sum(r["taken"] for r in after.values()) > 0
        docs = out


def test_empty_tables(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([], DOCS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    assert corpus_pipeline.run(spark, d).count() == 0
