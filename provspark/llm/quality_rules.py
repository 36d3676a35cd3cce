"""Operator 3: quality rules by distribution divergence.

Each text is reduced to counts in one pass: base counts, a histogram of
character classes, and a histogram of common words. The histograms of all
texts that pass the base rules are summed by language to reference
distributions. A text is kept if it passes the base rules and, for at least
one language, the Jensen-Shannon distances (base 2, 0 to 1) of both of its
histograms to the reference stay within limits. A distance counts only where
the text has enough characters or words for it to mean something.

Edge cases: a null text has no words and fails the base rules; a null language
is a language of its own when references are formed; with no reference at all
(no text passes) nothing else is kept either, as every text has failed; texts
are never cut; repeated rows are judged each; an empty table gives an empty
result. Columns other than id, text and language are ignored. Every language
has a reference of its own; the driver gathers one row of sums for each.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provspark.llm.common import in_parts, materialize

# Frequent function words of English, French, German and Spanish.
COMMON_WORDS = (
    "the of and to a in is that it for was with as by be are this on an at or from "
    "le la de et les des en un une du que pour dans par sur avec est au "
    "der die und das den von zu mit sich dem auf für ist im nicht ein eine als auch des "
    "el y los se del las por con su para es al lo como no"
)
WORDS = sorted(set(COMMON_WORDS.split()))
WORD_BIN = {w.encode(): i for i, w in enumerate(WORDS)}
SPACES, SYMBOLS, LOWER, UPPER, DIGIT, POINT, ASCII, WIDE_LOWER, WIDE = range(9)
N_CLASS, N_WORD = 9, len(WORDS) + 1
MIN_CHARS, MIN_WORDS = 200, 200
LIMIT_CLASS, LIMIT_WORD = 0.30, 0.31


def _classes() -> np.ndarray:
    table = np.full(0x2000, WIDE, np.uint8)
    table[:128] = ASCII
    for i in range(0x2000):
        c = chr(i)
        if c in " \t\n\x0b\x0c\r":
            table[i] = SPACES
        elif c in "#*$%&|<>":
            table[i] = SYMBOLS
        elif i < 128 and c.isalpha():
            table[i] = UPPER if c.isupper() else LOWER
        elif i < 128 and c.isdigit():
            table[i] = DIGIT
        elif c in ".,;:!?'\"()-":
            table[i] = POINT
        elif c.isalpha():
            table[i] = UPPER if c.isupper() else WIDE_LOWER
    return table


CLASS_OF = _classes()
A, B, C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def repeated_words(words: list[bytes]) -> int:
    """Words in 3-word windows that occur twice or more in the text, the first included."""
    n = len(words)
    if n < 4:
        return 0
    h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    win = h[:-2] * A + h[1:-1] * B + h[2:] * C
    ordered = np.sort(win)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if not again.size:  # equal windows have equal hashes, so none repeats
        return 0
    at = np.flatnonzero(np.isin(win, again)).tolist()
    seen = Counter((words[i], words[i + 1], words[i + 2]) for i in at)
    hit = np.zeros(n, bool)
    for i in at:
        if seen[words[i], words[i + 1], words[i + 2]] > 1:
            hit[i : i + 3] = True
    return int(hit.sum())


def measure(text: str | None) -> tuple[int, int, int, int, int, np.ndarray]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, histograms)."""
    hist = np.zeros(N_CLASS + N_WORD, np.int32)
    if not text:
        return 0, 0, 0, 0, 0, hist
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    hist[:N_CLASS] = np.bincount(CLASS_OF[np.minimum(code, 0x1FFF)], minlength=N_CLASS)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    low = raw.lower().split()
    found = Counter(filter(WORD_BIN.__contains__, low))
    for w, k in found.items():
        hist[N_CLASS + WORD_BIN[w]] = k
    hist[-1] = len(words) - sum(found.values())
    return len(words), len(text) - int(hist[SPACES]), int(hist[SYMBOLS]), len(lines) - len(set(lines)), repeated_words(words), hist


MEASURED = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [measure(t) for t in b.column(2).to_pylist()]
        cols = [pa.array([r[k] for r in rows], pa.int64()) for k in range(5)]
        flat = np.concatenate([r[5] for r in rows]) if rows else np.zeros(0, np.int32)
        offsets = np.arange(len(rows) + 1, dtype=np.int32) * (N_CLASS + N_WORD)
        hist = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols, hist], ["doc_id", "lang", *MEASURED, "hist"])


def _shares(hist: np.ndarray) -> np.ndarray:
    """Rows of counts to rows of shares: character classes and words each sum to 1."""
    out = hist.astype(float)
    for part in (out[:, :N_CLASS], out[:, N_CLASS:]):
        part /= np.maximum(part.sum(axis=1, keepdims=True), 1)
    return out


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distances of the rows of p to q."""
    m = (p + q) / 2

    def kl(x: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(x > 0, x * np.log2(x / m), 0).sum(axis=1)

    return np.sqrt(np.maximum((kl(p) + kl(np.broadcast_to(q, p.shape))) / 2, 0))


def _sum_by_lang(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str | None, list] = {}
    for b in batches:
        hist = np.asarray(b.column(1).flatten(), np.int64).reshape(len(b), -1)
        for lang, row in zip(b.column(0).to_pylist(), hist, strict=True):
            s = sums.setdefault(lang, [0, np.zeros(hist.shape[1], np.int64)])
            s[0] += 1
            s[1] += row
    for lang, (n, s) in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.array([n], pa.int64()), pa.array([s.tolist()], pa.list_(pa.int64()))], ["lang", "n", "sums"])


def references(measured: DataFrame) -> np.ndarray:
    """A row of shares for each language."""
    passed = measured.where(~F.col("base_failed")).select("lang", "hist").mapInArrow(_sum_by_lang, "lang string, n long, sums array<long>")
    width = N_CLASS + N_WORD
    totals = passed.groupBy("lang").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums"))
    rows = [r["sums"] for r in totals.orderBy(F.desc("n"), "lang").select("sums").collect()]
    return _shares(np.array(rows, float)) if rows else np.zeros((0, width))


def _verdict(refs: np.ndarray, limit_class: float, limit_word: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hist = np.asarray(b.column(b.schema.get_field_index("hist")).flatten()).reshape(len(b), -1) if len(b) else np.zeros((0, N_CLASS + N_WORD))
            p = _shares(hist)
            chars, words = hist[:, :N_CLASS].sum(axis=1), hist[:, N_CLASS:].sum(axis=1)
            ok, best = np.zeros(len(b), bool), np.full((2, len(b)), np.inf)
            for q in refs:
                c = np.where(chars < MIN_CHARS, 0.0, js_distance(p[:, :N_CLASS], q[:N_CLASS]))
                w = np.where(words < MIN_WORDS, 0.0, js_distance(p[:, N_CLASS:], q[N_CLASS:]))
                ok |= (c <= limit_class) & (w <= limit_word)
                nearer = np.maximum(c / limit_class, w / limit_word) < np.maximum(best[0] / limit_class, best[1] / limit_word)
                best[:, nearer] = np.stack([c, w])[:, nearer]
            failed = np.asarray(b.column(b.schema.get_field_index("base_failed")).to_pylist(), bool)
            far = [pa.array([None if np.isinf(x) else float(x) for x in d], pa.float64()) for d in best]
            keep = [b.column(i) for i in range(b.num_columns) if b.schema.names[i] != "hist"]
            names = [n for n in b.schema.names if n != "hist"]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(ok & ~failed), *far], [*names, "kept", "class_distance", "word_distance"])

    return run


def quality_rules(
    docs: DataFrame,
    limit_class: float = LIMIT_CLASS,
    limit_word: float = LIMIT_WORD,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, class_distance, word_distance).

    The distances are those to the language that fits best.
    """
    kind = dict(docs.dtypes)[id_col]
    longs = ", ".join(f"{n} long" for n in MEASURED)
    measured = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    measured = measured.mapInArrow(in_parts(_measure), f"doc_id {kind}, lang string, {longs}, hist array<int>")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    measured = materialize(measured.withColumn("base_failed", failed), "quality")
    refs = references(measured)
    out = f"doc_id {kind}, {longs}, base_failed boolean, kept boolean, class_distance double, word_distance double"
    return measured.select("doc_id", *MEASURED, "base_failed", "hist").mapInArrow(_verdict(refs, limit_class, limit_word), out)

