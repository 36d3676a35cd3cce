"""Operator 10: language ID with language-bitmask n-gram filters.

One table of bit masks holds a Bloom filter for each language, sliced by bits:
an n-gram sets its language's bit in the masks at a few hashed places, and the
AND of the masks at those places gives all languages that contain it. A text's
n-grams are looked up, hits are counted by language, the hits that chance
gives (from the measured fill of each language's slice) are taken off, and the
language with most left is predicted.

Texts are taken as code points, lower-cased; what is not a letter is a blank;
n-grams are 3 and 4 code points long and lie within a word or reach one blank
on either side.

Training takes at most per_lang documents of each language, those with the
smallest id hashes; this bound alone sets how many n-grams there are. Those that
a language has twice or more are learned, all of them and for all languages. An
n-gram belongs to the languages in which its share is at least 1 / ratio of its
largest share. The filter has at least 16 places for each n-gram, and a mask
word of 8 or 64 bits at each place for every so many languages.

Edge cases: a null text or one without letters is `und` with score 0; a text
whose n-grams are all unknown gets the most frequent language with that
language's share as score; ties go to the more frequent language; a training
table without rows gives `und` for all; repeated rows are predicted each; an
empty table gives an empty result; texts are never cut. Columns other than id,
text and language are ignored, and language is only read where training is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provspark.llm.common import in_parts, materialize

PER_LANG = 20_000
#: Least size of the filter, and places for each n-gram.
SLOTS, ROOM, HASHES = 1 << 21, 16, 3
RATIO, LEAST = 4.0, 2
BLANK = np.uint32(32)
STEP, MIX1, MIX2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Lower-case letter of each code point, or a blank."""
    if not _letters:
        table = np.full(0x110000, BLANK, np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                table[i] = ord(low) if len(low) == 1 else i
        _letters.append(table)
    return _letters[0]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def ngrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each n-gram, number of n-grams of each text)."""
    parts = [(" " + (t or "") + " ").encode("utf-32-le", "surrogatepass") for t in texts]
    code = letters()[np.frombuffer(b"".join(parts), np.uint32)]
    owner = np.repeat(np.arange(len(parts)), [len(p) // 4 for p in parts])
    blank = code == BLANK
    # of a run of blanks one stays; texts keep their own first and last
    stay = np.ones(len(code), bool)
    stay[1:] = ~(blank[1:] & blank[:-1] & (owner[1:] == owner[:-1]))
    code, owner, blank = code[stay].astype(np.uint64), owner[stay], blank[stay]
    hashes, owners = [], []
    for n in (3, 4):
        m = len(code) - n + 1
        if m <= 0:
            continue
        ok = owner[:m] == owner[n - 1 :]
        for i in range(1, n - 1):  # a blank may only stand at an end
            ok &= ~blank[i : m + i]
        at = np.flatnonzero(ok)
        h = np.full(len(at), n, np.uint64)
        for i in range(n):
            h = (h + code[at + i]) * STEP
            h ^= h >> np.uint64(29)
        hashes.append(h * MIX1)
        owners.append(owner[at])
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    h, o = np.concatenate(hashes), np.concatenate(owners)
    order = np.argsort(o, kind="stable")
    return h[order], np.bincount(o, minlength=len(texts))


def slots(h: np.ndarray, bits: int) -> list[np.ndarray]:
    """The places of each hash in a filter of 2**bits."""
    out = []
    for _ in range(HASHES):
        h = (h ^ (h >> np.uint64(31))) * MIX2
        out.append((h >> np.uint64(64 - bits)).astype(np.int64))
    return out


@dataclass
class Model:
    langs: list[str]
    prior: list[float]
    #: A row of places for every so many languages.
    masks: np.ndarray
    chance: np.ndarray

    @classmethod
    def build(cls, langs: list[str], prior: list[float], h: np.ndarray, lang: np.ndarray) -> Model:
        """h, lang: an n-gram's hash and the number of a language that has it."""
        kind = np.uint8 if len(langs) <= 8 else np.uint64
        width = 8 * kind().itemsize
        size = max(SLOTS, 1 << (ROOM * len(h)).bit_length())
        masks = np.zeros((-(-len(langs) // width), size), kind)
        for at in slots(h, size.bit_length() - 1):
            np.bitwise_or.at(masks, (lang // width, at), kind(1) << (lang % width).astype(kind))
        fill = np.array([np.count_nonzero(masks[i // width] >> kind(i % width) & kind(1)) / size for i in range(len(langs))])
        return cls(langs, prior, masks, np.minimum(fill**HASHES, 0.99))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        h, counts = ngrams(texts)
        starts = np.cumsum(counts) - counts
        full = counts > 0
        found = np.zeros((len(self.langs), len(texts)))
        if full.any():
            kind, width = self.masks.dtype.type, 8 * self.masks.dtype.itemsize
            places = slots(h, self.masks.shape[1].bit_length() - 1)
            for w, row in enumerate(self.masks):
                mask = np.bitwise_and.reduce([row[at] for at in places])
                for i in range(w * width, min((w + 1) * width, len(self.langs))):
                    found[i, full] = np.add.reduceat((mask >> kind(i % width) & kind(1)).astype(np.int64), starts[full])
        found = np.maximum((found - counts * self.chance[:, None]) / (1 - self.chance[:, None]), 0)
        out = []
        for j, text in enumerate(texts):
            if not self.langs or not has_letter(text):
                out.append(("und", 0.0))
            elif (total := found[:, j].sum()) <= 0:
                out.append((self.langs[0], self.prior[0]))
            else:
                best = int(np.argmax(found[:, j]))
                out.append((self.langs[best], float(found[best, j] / total)))
        return out


def _count(langs: list[str]):
    number = {x: i for i, x in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        waiting = 0

        def settle(parts: list) -> tuple[np.ndarray, np.ndarray]:
            h = np.concatenate([p[0] for p in parts])
            n = np.concatenate([p[1] for p in parts])
            order = np.argsort(h)
            h, n = h[order], n[order]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            return h[first], np.add.reduceat(n, first)

        def flush() -> Iterator[pa.RecordBatch]:
            for i, parts in held.items():
                h, n = settle(parts)
                for k in range(0, len(h), 65536):
                    part = h[k : k + 65536]
                    yield pa.RecordBatch.from_arrays([pa.array(part.view(np.int64)), pa.array(np.full(len(part), i, np.int32)), pa.array(n[k : k + 65536])], ["h", "lang", "n"])

        for b in batches:
            texts, tags = b.column(1).to_pylist(), b.column(0).to_pylist()
            for lang in set(tags):
                if lang not in number:
                    continue
                h, n = np.unique(ngrams([t for t, x in zip(texts, tags, strict=True) if x == lang])[0], return_counts=True)
                if len(h):
                    held.setdefault(number[lang], []).append((h, n.astype(np.int64)))
                    waiting += len(h)
            if waiting > 2_000_000:
                held = {i: [settle(p)] for i, p in held.items()}
                waiting = sum(len(p[0][0]) for p in held.values())
                if waiting > 1_000_000:  # too many different ones to keep: hand them on
                    yield from flush()
                    held, waiting = {}, 0
        yield from flush()

    return run


def is_held_out(doc_id: Column, folds: int = 3, fold: int = 1) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds == fold


def fit(docs: DataFrame, per_lang: int = PER_LANG) -> Model:
    """docs: (doc_id, text, lang), all of it for training."""
    known = docs.where("lang is not null")
    rows = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    langs, sizes = [r["lang"] for r in rows], [r["count"] for r in rows]
    if not langs:
        return Model([], [], np.zeros((0, SLOTS), np.uint8), np.zeros(0))
    # a document is in the sample by a hash of its id; the share is set so that per_lang are expected
    spark = docs.sparkSession
    share = spark.createDataFrame([(lang, min(1.0, per_lang / n)) for lang, n in zip(langs, sizes, strict=True)], "lang string, share double")
    draw = F.pmod(F.xxhash64(F.lit("train"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = known.join(F.broadcast(share), "lang").where(draw < F.col("share")).select("lang", "text")  # a row for each language
    counted = sample.mapInArrow(in_parts(_count(langs)), "h long, lang int, n long").groupBy("h", "lang").agg(F.sum("n").alias("n"))
    counted = materialize(counted.where(F.col("n") >= LEAST), "langid")
    totals = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    near = counted.join(F.broadcast(totals), "lang").select("h", "lang", (F.col("n") / F.col("total")).alias("p"))
    most = near.groupBy("h").agg(F.max("p").alias("most"))
    found = near.join(most, "h").where(F.col("p") * RATIO >= F.col("most")).select("h", "lang").toArrow()
    h = np.asarray(found.column("h").combine_chunks(), np.int64).view(np.uint64)
    lang = np.asarray(found.column("lang").combine_chunks(), np.int64)
    return Model.build(langs, [n / sum(sizes) for n in sizes], h, lang)


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            found = m.predict(b.column(2).to_pylist())
            cols = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify_languages(
    docs: DataFrame,
    per_lang: int = PER_LANG,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """One row per document: (doc_id, held_out, lang_pred, score)."""
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.withColumn("held_out", is_held_out(F.col("doc_id")))
    model = docs.sparkSession.sparkContext.broadcast(fit(rows.where(~F.col("held_out")), per_lang))
    return rows.select("doc_id", "held_out", "text").mapInArrow(in_parts(_predict(model)), f"doc_id {kind}, held_out boolean, lang_pred string, score double")
