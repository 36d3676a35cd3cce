"""Operator 6: benchmark decontamination with a generalised suffix automaton.

The words of all test items form one automaton; each text is streamed through
it, and the length of the longest match that ends at each word tells whether a
window of an item ends there. A window is `window` consecutive words of an
item, or all words of a shorter item. Only runs of words that occur in some
item are streamed, as a match cannot leave them.

Items are split into blocks of at most block_words words (a single longer
item is a block of its own). Each block's automaton is a file that executors
get by SparkContext.addFile. A worker keeps one block's automaton in memory;
with more blocks it takes them in turn for each batch, so memory stays bounded
whatever the size of the benchmark.

Edge cases: null, empty or wordless texts and items have no words and match
nothing; an item without an id hits words like any other but is not counted or
named among the items; repeated items and repeated rows
count once and each; overlapping hits count once; texts are never cut short;
empty tables give zero hits or an empty result. Columns other than those named
are passed on by remove_contamination and ignored by find_contamination.
"""

from __future__ import annotations

import atexit
import os
import pickle
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provspark.llm.common import in_parts

WINDOW = 13
#: Contaminated if hit words are at least one in so many.
ONE_IN = 20
BLOCK_WORDS = 200_000
#: Lower-cases A-Z and turns every ASCII character that is not a word character into a blank.
TO_WORDS = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256))
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(TO_WORDS).split() if text else []


class ItemAutomaton:
    """Suffix automaton of several word sequences, with the items that each window belongs to."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW) -> None:
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        used = [(name, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]) for name, words in items if words]
        for _, ids in used:
            last = 0
            for c in ids:
                last = self._extend(last, c)
        self.shortest = min([window, *(len(ids) for _, ids in used)])
        self._label(used)

    def _extend(self, last: int, c: int) -> int:
        """The state of the prefix that ends with c, which may exist from an earlier item."""
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        new = self._state(self.length[last] + 1, {})
        p = last
        while p != -1 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p == -1:
            self.link[new] = 0
        else:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def _state(self, length: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.link.append(0)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """Part q's strings that are no longer than p's plus one into a state of their own."""
        part = self._state(self.length[p] + 1, dict(self.next[q]))
        self.link[part], self.link[q] = self.link[q], part
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = part
            p = self.link[p]
        return part

    def _label(self, used: list[tuple[str, list[int]]]) -> None:
        owners: dict[int, set[str]] = {}
        whole: dict[int, dict[int, set[str]]] = {}
        for name, ids in used:
            state = 0
            for c in ids:
                state = self.next[state][c]
                v = state
                while v > 0 and name not in owners.setdefault(v, set()):
                    owners[v].add(name)
                    v = self.link[v]
            if len(ids) < self.window:
                while len(ids) <= self.length[self.link[state]]:
                    state = self.link[state]
                whole.setdefault(state, {}).setdefault(len(ids), set()).add(name)
        # of each state: the items of the window that ends its strings
        self.full: list[tuple[str, ...]] = []
        for v in range(len(self.length)):
            u = v
            while u > 0 and self.length[self.link[u]] >= self.window:
                u = self.link[u]
            self.full.append(tuple(owners.get(u, ())) if self.length[u] >= self.window else ())
        # of each state: whole short items that end its strings, own ones and those of shorter suffixes
        own = {v: [(n, tuple(x)) for n, x in d.items()] for v, d in whole.items()}
        self.short: dict[int, list[tuple[int, tuple[str, ...]]]] = {}
        if own:
            for v in sorted(range(1, len(self.length)), key=self.length.__getitem__):
                if found := own.get(v, []) + self.short.get(self.link[v], []):
                    self.short[v] = found

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word spans covered by windows, not merged, and the items of those windows."""
        get = self.vocabulary.get
        ids = np.array([get(w, -1) for w in words], np.int64)
        edges = np.flatnonzero(np.diff(np.concatenate([[False], ids >= 0, [False]]).astype(np.int8)))
        spans, items = [], set()
        for lo, hi in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if hi - lo >= self.shortest:
                self._stream(ids[lo:hi].tolist(), lo, spans, items)
        return spans, items

    def _stream(self, run: list[int], lo: int, spans: list, items: set) -> None:
        state, length = 0, 0
        for i, c in enumerate(run, lo + 1):
            while c not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            state = self.next[state][c]
            length += 1
            if length >= self.window:
                spans.append((i - self.window, i))
                items.update(self.full[state])
            for n, names in self.short.get(state, ()):
                if n <= length:
                    spans.append((i - n, i))
                    items.update(names)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(lo, hi) for lo, hi in out]


def build_blocks(benchmark: DataFrame, window: int, block_words: int, id_col: str, text_col: str) -> list[str]:
    """Files with one automaton each; the driver holds one block's items at a time."""
    folder = tempfile.mkdtemp()  # executors fetch from here for as long as the driver lives
    atexit.register(shutil.rmtree, folder, True)
    names: list[str] = []
    block: list[tuple[str, list[bytes]]] = []

    def flush() -> None:
        name = f"items-{uuid.uuid4().hex}.pickle"
        with open(os.path.join(folder, name), "wb") as f:
            pickle.dump(ItemAutomaton(block, window), f, 5)
        benchmark.sparkSession.sparkContext.addFile(os.path.join(folder, name))
        names.append(name)

    held = 0
    rows = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).where("t is not null")
    for row in rows.toLocalIterator():
        words = words_of(row["t"])
        if block and held + len(words) > block_words:
            flush()
            block, held = [], 0
        block.append((row["i"], words))
        held += len(words)
    flush()
    return names


_held: dict[str, ItemAutomaton] = {}


def automaton(name: str) -> ItemAutomaton:
    if name not in _held:
        with open(SparkFiles.get(name), "rb") as f:
            found = pickle.load(f)
        _held.clear()
        _held[name] = found
    return _held[name]


def scan_batch(names: list[str], texts: list[str | None]) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
    """(number of words, merged spans, items) of each text."""
    split = [words_of(t) for t in texts]
    spans: list[list] = [[] for _ in texts]
    items: list[set] = [set() for _ in texts]
    for name in names:
        a = automaton(name)
        for i, words in enumerate(split):
            s, x = a.scan(words)
            spans[i] += s
            items[i] |= x
    return [(len(w), merged(s), sorted(x - {None})) for w, s, x in zip(split, spans, items, strict=True)]


def _find(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = scan_batch(names, b.column(1).to_pylist())
            cols = [
                pa.array([r[0] for r in rows], pa.int64()),
                pa.array([sum(hi - lo for lo, hi in r[1]) for r in rows], pa.int64()),
                pa.array([len(r[2]) for r in rows], pa.int64()),
                pa.array([r[2] for r in rows], pa.list_(pa.string())),
            ]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", "n_words", "n_hit", "n_items", "items"])

    return run


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    one_in: int = ONE_IN,
    block_words: int = BLOCK_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """One row per document: (doc_id, n_words, n_hit, n_items, items, contaminated)."""
    names = build_blocks(benchmark, window, block_words, item_col, item_text_col)
    kind = dict(docs.dtypes)[id_col]
    found = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        in_parts(_find(names)), f"doc_id {kind}, n_words long, n_hit long, n_items long, items array<string>"
    )
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (one_in * F.col("n_hit") >= F.col("n_words")))


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of spans and what stands between them."""
    raw = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in WORD.finditer(raw.translate(TO_WORDS))]
    out, end = [], 0
    for lo, hi in spans:
        out.append(raw[end : at[lo][0]])
        end = at[hi - 1][1]
    return b"".join([*out, raw[end:]]).decode("utf-8", "surrogatepass")


def _clean(names: list[str], text_at: int, window: int, one_in: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(text_at).to_pylist()
            keep = []
            for i, (n, spans, _) in enumerate(scan_batch(names, texts)):
                hit = sum(hi - lo for lo, hi in spans)
                keep.append(not (hit and one_in * hit >= n))
                if long := [s for s in spans if s[1] - s[0] >= window]:
                    texts[i] = cut(texts[i], long)
            cols = [pa.array(texts, b.column(i).type) if i == text_at else b.column(i) for i in range(b.num_columns)]
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema).filter(pa.array(keep, pa.bool_()))

    return run


def remove_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    one_in: int = ONE_IN,
    block_words: int = BLOCK_WORDS,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """docs without contaminated documents; from others, spans of at least `window` hit words are cut."""
    names = build_blocks(benchmark, window, block_words, item_col, item_text_col)
    return docs.mapInArrow(in_parts(_clean(names, docs.columns.index(text_col), window, one_in)), docs.schema)


#: The counts of find_contamination in DuckDB, by windows as strings.
ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS t FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS t FROM benchmark),
i AS (SELECT item_id, t, len(t) AS n, least(len(t), 13) AS k, unnest(range(1, len(t) - least(len(t), 13) + 2)) AS s FROM b WHERE len(t) > 0),
g AS (SELECT DISTINCT item_id, k, array_to_string(t[s:s + k - 1], ' ') AS win FROM i),
ks AS (SELECT DISTINCT k FROM g),
p AS (SELECT doc_id, k, s, array_to_string(t[s:s + k - 1], ' ') AS win FROM
    (SELECT doc_id, t, k, unnest(range(1, len(t) - k + 2)) AS s FROM w, ks WHERE len(t) >= k)),
m AS (SELECT doc_id, item_id, p.k AS k, s FROM p JOIN g ON p.win = g.win AND p.k = g.k),
h AS (SELECT doc_id, CAST(count(DISTINCT x) AS BIGINT) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS x FROM (SELECT DISTINCT doc_id, k, s FROM m)) GROUP BY doc_id),
o AS (SELECT doc_id, CAST(count(*) AS BIGINT) AS n_items, string_agg(x, ',' ORDER BY x) AS list FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM m WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT w.doc_id AS doc_id, CAST(len(t) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(t) AS contaminated
FROM w LEFT JOIN h ON h.doc_id = w.doc_id LEFT JOIN o ON o.doc_id = w.doc_id
"""
