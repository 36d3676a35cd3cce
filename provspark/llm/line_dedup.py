"""Operator 8: line dedup by winnowing over line hashes.

A text's lines that hold more than white space, trimmed, form its sequence. A
passage is `run` consecutive lines, or fewer, down to one, that hold at least
`long_words` words together. A line is deleted if it lies in a passage that also occurs at an
earlier place: in a document with a smaller id, or earlier in the same one.
Texts that share an id, or have none, are documents of their own and ordered by
a digest of the text.

Winnowing finds them. Of every window of line hashes that may be a passage the
smallest (of equal ones the last) is selected, so two places that share a
passage share a selected line at the same distance from its start. Only
selected positions are sent, one row each, and joined by hash with the hashes
that were selected at two places or more. From a position that is left, the
match is extended both ways, to the ends of the windows that selected it, and
each extension is compared, by a 128-bit digest, with the first place that has
the same one. So a line that is everywhere costs a row for each place and never
a pair of places, and a longer repeated run is the union of its extensions.

Edge cases: a null text has no lines and stays null; blank lines are never
deleted unless they stand between deleted ones; repeated rows with one id and
text are one place, so neither deletes the other; rows with a null id come last; an
empty table gives an empty result; texts are never cut otherwise. Columns
other than id and text are passed on by drop_repeated_lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provspark.llm.common import in_parts, materialize

RUN, LONG_WORDS = 3, 50


def selected(hashes: np.ndarray, run: int) -> list[tuple[int, int]]:
    """(selected line, window start) of each window of run hashes."""
    n = len(hashes) - run + 1
    if n <= 0:
        return []
    windows = np.lib.stride_tricks.sliding_window_view(hashes, run)
    last = run - 1 - np.argmin(windows[:, ::-1], axis=1)
    return [(int(s + k), s) for s, k in enumerate(last)]


def positions(text: str | None, run: int, long_words: int) -> list[tuple[int, int, list[tuple[int, int, bytes]]]]:
    """Selected positions: (hash, line, [(first line, number of lines, digest) of each window that selected it])."""
    if not text:
        return []
    lines = [x for x in (y.strip() for y in text.encode("utf-8", "surrogatepass").split(b"\n")) if x]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, lines), np.uint64, len(lines))
    words = np.cumsum([0, *(len(x.split()) for x in lines)])
    by: dict[int, list[tuple[int, int, bytes]]] = {}
    for n in range(1, run + 1):
        for at, s in selected(hashes, n):
            if n == run or words[s + n] - words[s] >= long_words:
                by.setdefault(at, []).append((s, n, xxhash.xxh3_128_digest(b"\n".join(lines[s : s + n]))))
    return [(int(hashes[at]), at, found) for at, found in by.items()]


def _positions(run: int, long_words: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [positions(t, run, long_words) for t in b.column(2).to_pylist()]
            at = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]), pa.int64())
            rows = [r for x in found for r in x]
            flat = [w for r in rows for w in r[2]]
            line = np.fromiter((r[0] for r in rows), np.uint64, len(rows)).view(np.int64)
            windows = pa.StructArray.from_arrays(
                [pa.array([w[0] for w in flat], pa.int32()), pa.array([w[1] for w in flat], pa.int32()), pa.array([w[2] for w in flat], pa.binary())],
                ["start", "lines", "passage"],
            )
            ends = np.cumsum([0, *(len(r[2]) for r in rows)])
            cols = [pa.array(line, pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), windows)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), *cols], ["doc_id", "tag", "line", "at", "windows"])

    return go


def repeated_passages(docs: DataFrame, run: int = RUN, long_words: int = LONG_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tag, start, lines) of every passage that occurs at an earlier place."""
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("tag"), F.col(text_col).alias("text"))
    out = f"doc_id {kind}, tag long, line long, at int, windows array<struct<start: int, lines: int, passage: binary>>"
    rows = materialize(rows.mapInArrow(in_parts(_positions(run, long_words)), out), "lines")
    # both sides of each join are written tables, so that a hot line or passage can be split
    again = materialize(rows.groupBy("line").agg(F.count("*").alias("n")).where("n > 1").select("line"), "lines")
    extended = rows.join(again, "line", "left_semi").select("doc_id", "tag", F.inline("windows"))
    extended = materialize(extended, "lines")
    # the first place of each passage; nulls come last
    place = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.col("tag").alias("tag"), F.col("start").alias("at"))
    first = extended.groupBy("passage").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("passage", "first")
    first = materialize(first, "lines")
    return extended.join(first, "passage").where(place > F.col("first")).select("doc_id", "tag", "start", "lines")


def strip_lines(text: str, spans: list[tuple[int, int]]) -> tuple[str, int]:
    """The text without the lines of spans (start, lines) and blank lines between them; how many had words."""
    lines = text.split("\n")
    full = [i for i, x in enumerate(lines) if x.strip(" \t\n\x0b\x0c\r")]
    gone = sorted({k for s, n in spans for k in range(s, s + n)})
    drop = set()
    for i, k in enumerate(gone):
        if i and gone[i - 1] == k - 1:
            drop.update(range(full[k - 1], full[k]))
        drop.add(full[k])
    return "\n".join(x for i, x in enumerate(lines) if i not in drop), len(gone)


def _strip(text_at: int, spans_at: int, schema: pa.Schema | None):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, spans = b.column(text_at).to_pylist(), b.column(spans_at).to_pylist()
            counts = []
            for i, found in enumerate(spans):
                n = 0
                if found and texts[i] is not None:
                    texts[i], n = strip_lines(texts[i], [(x["start"], x["lines"]) for x in found])
                counts.append(n)
            cols = [pa.array(texts, b.column(i).type) if i == text_at else b.column(i) for i in range(b.num_columns) if i != spans_at]
            names = [x for i, x in enumerate(b.schema.names) if i != spans_at]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(counts, pa.int64())], [*names, "__n_removed"])

    return go


def remove_repeated_lines(docs: DataFrame, run: int = RUN, long_words: int = LONG_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with repeated lines deleted, plus __n_removed (lines)."""
    found = repeated_passages(docs, run, long_words, id_col, text_col)
    # one list for each document, no longer than run times its lines
    spans = materialize(found.groupBy(F.col("doc_id").alias("__id"), F.col("tag").alias("__tag")).agg(F.collect_set(F.struct("start", "lines")).alias("__spans")), "lines")
    on: Column = F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(text_col) == F.col("__tag"))
    wide = docs.join(spans.hint("shuffle_hash"), on, "left").drop("__id", "__tag")
    text_at = docs.columns.index(text_col)
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + ", __n_removed long"
    return wide.mapInArrow(in_parts(_strip(text_at, len(docs.columns), None)), out)


def drop_repeated_lines(docs: DataFrame, run: int = RUN, long_words: int = LONG_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with repeated lines deleted, without documents of which nothing is left."""
    out = remove_repeated_lines(docs, run, long_words, id_col, text_col)
    emptied = (F.col("__n_removed") > 0) & (F.trim(F.translate(text_col, "\t\n\x0b\x0c\r", "     ")) == "")
    return out.where(~emptied).drop("__n_removed")


#: n_lines, n_removed and the digest of what is left, in DuckDB.
ORACLE = r"""
WITH a AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS raw, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents),
l AS (SELECT doc_id, i, trim(raw, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS x FROM a),
f AS (SELECT doc_id, i, x, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM l WHERE x <> ''),
c AS (SELECT doc_id, k, x, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS c1 FROM f),
v AS (SELECT *, lead(x, 1) OVER q AS x2, lead(x, 2) OVER q AS x3, c1 + lead(c1, 1) OVER q AS c2 FROM c WINDOW q AS (PARTITION BY doc_id ORDER BY k)),
w AS (SELECT doc_id, k, 3 AS n, concat(x, chr(10), x2, chr(10), x3) AS p, x3 AS z FROM v
    UNION ALL SELECT doc_id, k, 2 AS n, concat(x, chr(10), x2) AS p, x2 AS z FROM v WHERE c2 >= 50
    UNION ALL SELECT doc_id, k, 1 AS n, x AS p, x AS z FROM v WHERE c1 >= 50),
m AS (SELECT doc_id, k, n, row_number() OVER (PARTITION BY n, p ORDER BY doc_id, k) AS r FROM w WHERE z IS NOT NULL),
d AS (SELECT DISTINCT doc_id, unnest(range(k, k + n)) AS k FROM m WHERE r > 1),
g AS (SELECT f.doc_id, f.i, f.k, d.k IS NOT NULL AS gone, coalesce(lag(d.k IS NOT NULL) OVER (PARTITION BY f.doc_id ORDER BY f.k), false) AS before FROM f LEFT JOIN d ON d.doc_id = f.doc_id AND d.k = f.k),
o AS (SELECT a.doc_id, a.i, a.raw, g.k, g.gone, first_value(g.gone AND g.before IGNORE NULLS) OVER (PARTITION BY a.doc_id ORDER BY a.i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS between
    FROM a LEFT JOIN g ON g.doc_id = a.doc_id AND g.i = a.i),
s AS (SELECT doc_id, CAST(count(k) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_removed,
    coalesce(string_agg(raw, chr(10) ORDER BY i) FILTER (WHERE NOT (coalesce(gone, false) OR (k IS NULL AND coalesce(between, false)))), '') AS kept FROM o GROUP BY doc_id)
SELECT t.doc_id AS doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents t LEFT JOIN s ON s.doc_id = t.doc_id
"""
