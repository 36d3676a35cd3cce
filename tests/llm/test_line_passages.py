"""Line dedup on passages that are shorter than a run of lines but hold enough words."""

import random
from collections import defaultdict

from provspark.llm import line_dedup

RUN, LONG_WORDS = line_dedup.RUN, line_dedup.LONG_WORDS


def plain(texts):
    """{key: deleted lines} by the rule; texts: (key, text) in order of place."""
    seen, gone = set(), defaultdict(set)
    for key, text in texts:
        lines = [x.strip() for x in (text or "").split("\n") if x.strip()]
        for s in range(len(lines)):
            for n in range(1, min(RUN, len(lines) - s) + 1):
                passage = tuple(lines[s : s + n])
                if n == RUN or sum(len(x.split()) for x in passage) >= LONG_WORDS:
                    if passage in seen:
                        gone[key] |= set(range(s, s + n))
                    seen.add(passage)
    return gone


def line(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))


def test_two_lines(spark):
    rng = random.Random(3)
    a, b, short, long = line(rng, 27), line(rng, 27), line(rng, 9), line(rng, 60)
    few = [line(rng, 24), line(rng, 25)]
    texts = [
        (1, "\n".join([a, b, line(rng, 5), short, long, *few])),
        (2, "\n".join([line(rng, 5), a, "", b, line(rng, 6)])),  # in the middle; the third line differs
        (3, "\n".join([line(rng, 5), a, b])),  # at the end of the text
        (4, "\n".join([line(rng, 5), short, long, line(rng, 4)])),
        (5, "\n".join([line(rng, 5), *few, line(rng, 4)])),  # 49 words
        (6, "\n".join([b, a])),
    ]
    got = {r["doc_id"]: r for r in line_dedup.remove_repeated_lines(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert {i: r["__n_removed"] for i, r in got.items()} == {1: 0, 2: 2, 3: 2, 4: 2, 5: 0, 6: 0}
    assert got[2]["text"] == "\n".join([texts[1][1].split("\n")[0], texts[1][1].split("\n")[-1]])


def test_random_passages(spark):
    rng = random.Random(4)
    pool = [line(rng, n) for n in (3, 10, 20, 24, 26, 27, 30, 40, 49, 50, 55) for _ in range(2)]
    texts = [(i, "\n".join(rng.choices(pool, k=rng.randint(1, 8)))) for i in range(60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    want = plain(texts)
    got = {r["doc_id"]: r["__n_removed"] for r in line_dedup.remove_repeated_lines(docs).collect()}
    assert got == {i: len(want[i]) for i, _ in texts}
