"""Line dedup and near dedup where different texts have no id, or share one."""

import random

import pytest

from provspark.llm import line_dedup, near_dup
from tests.llm.test_line_passages import line


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    shared = [line(rng, 5) for _ in range(3)]
    own = [line(rng, 5) for _ in range(12)]
    texts = [(1, "\n".join(own[:4] + shared)), (None, "\n".join(shared + own[4:7])), (None, "\n".join(own[7:10] + shared)), (None, own[10]), (None, None)]
    return shared, [*texts, (7, own[11]), (7, "\n".join([line(rng, 30), *shared])), (7, line(rng, 40))]


def test_lines_by_text(spark, rows):
    shared, texts = rows
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = [(r["doc_id"], r["text"]) for r in line_dedup.remove_repeated_lines(docs).collect()]
    # the smallest id keeps the shared lines, all others lose them and nothing else
    want = [(i, t if t is None or i == 1 else "\n".join(x for x in t.split("\n") if x not in shared)) for i, t in texts]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_lines_between_null_ids(spark):
    rng = random.Random(9)
    shared = "\n".join(line(rng, 5) for _ in range(3))
    texts = [(None, f"{shared}\n{line(rng, 4)}") for _ in range(4)]
    got = line_dedup.remove_repeated_lines(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert sorted(r["__n_removed"] for r in got) == [0, 3, 3, 3]


def test_near_duplicates_by_component(spark, rows):
    _, texts = rows
    copies = [*texts, *texts[1:3], (9, texts[3][1]), texts[5], (1, texts[7][1])]
    docs = spark.createDataFrame(copies, "doc_id long, text string").repartition(3)
    got = [(r["doc_id"], r["text"]) for r in near_dup.drop_near_duplicates(docs).collect()]
    want = [(9 if t == texts[3][1] else 1 if t == texts[7][1] else i, t) for i, t in texts]
    assert sorted(got, key=str) == sorted(want, key=str)
