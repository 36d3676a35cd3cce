"""Operator 9: near-duplicates by SimHash and Golay-code fuzzy hashing.

A text's fingerprint has bit i set if over half of the hashes of its word
shingles have it. Documents with one fingerprint form a class; links are sought
between distinct fingerprints only. A Scheme says how: shingle length, width,
the most differing bits of a link, and the segments that keys are made of.

* EXACT (op9): 64 bits of 3-word shingles, at most 2 differing bits. Three
  segments of 22, 21 and 21 bits. If two fingerprints differ in at most 2 bits,
  some segment is equal in both and the next one differs in at most 2 bits, so
  the pair shares a key made of the equal segment and one of the Golay indices
  of the next. No link is lost.
* SIMILAR (the pipeline's stage): 128 bits of 5-word shingles, at most 26
  differing bits, which is a cosine of 0.8 or more by the SimHash estimate.
  Four segments of 23 bits; a key is the Golay indices of two of them. With at
  most 8 differing bits two segments at least differ in at most 2 bits each, so
  the key is sure to be shared; beyond that it mostly is (README has recall).

Fingerprints meet by key and are verified by their bit distance. Of a key's
fingerprints only a spanning forest of the links leaves a worker. A key with
more than BUCKET fingerprints is dealt out again in pairs of blocks, so that
one task never holds more than about BUCKET of them; every pair of its
fingerprints meets in some pair of blocks, so no link is lost either way. No
list of a class, of links or of fingerprints reaches the driver.

Edge cases: a text without words (null, empty, blank) has fingerprint zero and
is linked like any other; with fewer words than a shingle the whole sequence is
the only shingle; repeated shingles count each; repeated rows share a class; a
null id belongs to its fingerprint's class but is never its name unless all
ids there are null; drop_near_duplicates keeps one row of each component, also
where ids are null or shared by different texts; an empty table gives an empty
result. Columns other than id and text are ignored by near_duplicates and
passed on by drop_near_duplicates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provspark.llm.common import connected_components, in_parts, materialize
from provspark.llm.golay import neighbour_keys

#: Most fingerprints that a worker compares with each other: at 8,192 of them in
#: one cluster or none, measured at 0.01 to 0.6 s.
BUCKET = 8192
#: Fingerprints whose keys are worked out at once.
DEAL = 2048


def _xxh64(data: bytes) -> bytes:
    return xxhash.xxh64_intdigest(data, 42).to_bytes(8, "little")


@dataclass(frozen=True)
class Scheme:
    shingle: int
    #: 8 or 16 little-endian bytes of a shingle.
    digest: Callable[[bytes], bytes]
    words: int  # of 64 bits
    max_bits: int
    #: (first bit, bits) of each segment.
    cuts: tuple[tuple[int, int], ...]
    #: Keys take segment a as it is and b's Golay indices, or the indices of both.
    pairs: tuple[tuple[int, int], ...]
    equal_first: bool


EXACT = Scheme(3, _xxh64, 1, 2, ((0, 22), (22, 21), (43, 21)), ((0, 1), (1, 2), (2, 0)), True)
SIMILAR = Scheme(5, xxhash.xxh3_128_digest, 2, 26, tuple((23 * i, 23) for i in range(4)), tuple(combinations(range(4), 2)), False)


def fingerprint(text: str | None, scheme: Scheme = EXACT) -> bytes:
    """The fingerprint, as big-endian bytes."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return bytes(8 * scheme.words)
    joined = b" ".join(words)
    if len(words) <= scheme.shingle:
        return scheme.digest(joined)[::-1]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: 1 - scheme.shingle].tolist()
    ends = ends[scheme.shingle - 1 :].tolist()
    n, width = len(starts), 8 * scheme.words
    raw = np.frombuffer(b"".join([scheme.digest(joined[s:e]) for s, e in zip(starts, ends, strict=True)]), np.uint8).reshape(n, width)
    ones = np.zeros(8 * width, np.int64)
    for i in range(0, n, 32768):
        ones += np.unpackbits(raw[i : i + 32768], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n, bitorder="little").tobytes()[::-1]


def as_words(column: pa.Array, scheme: Scheme) -> np.ndarray:
    """A row of 64-bit words for each fingerprint, the lowest first."""
    return np.frombuffer(b"".join(column.to_pylist()), ">u8").reshape(-1, scheme.words)[:, ::-1].astype(np.uint64)


def as_column(fps: np.ndarray) -> pa.Array:
    width = 8 * fps.shape[1]
    offsets = pa.py_buffer(np.arange(len(fps) + 1, dtype=np.int32) * np.int32(width))
    return pa.Array.from_buffers(pa.binary(), len(fps), [None, offsets, pa.py_buffer(fps[:, ::-1].astype(">u8").tobytes())])


def _fingerprints(scheme: Scheme):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = pa.array([fingerprint(t, scheme) for t in b.column(2).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), f], ["doc_id", "tag", "fp"])

    return run


def _segment(fps: np.ndarray, first: int, bits: int) -> np.ndarray:
    word, at = divmod(first, 64)
    out = fps[:, word] >> np.uint64(at)
    if at + bits > 64:
        out = out | (fps[:, word + 1] << np.uint64(64 - at))
    return (out & np.uint64((1 << bits) - 1)).astype(np.int64)


def keys_of(fps: np.ndarray, scheme: Scheme = EXACT) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of fingerprints given as rows of words."""
    parts = [_segment(fps, *cut) for cut in scheme.cuts]
    near = [neighbour_keys(p) for p in parts]
    counts = [np.bincount(row, minlength=len(fps)) for row, _ in near]
    rows, keys = [], []
    for number, (a, b) in enumerate(scheme.pairs):
        row, right = near[b]
        if scheme.equal_first:
            left = parts[a][row]
        else:  # every index of a with every index of b; rows are in order
            begin = np.cumsum(counts[a]) - counts[a]
            k = counts[a][row]
            left_at = np.repeat(begin[row] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
            left, right, row = near[a][1][left_at], np.repeat(right, k), np.repeat(row, k)
        rows.append(row)
        keys.append((np.int64(number) << 40) | (left << 12) | right)
    return np.concatenate(rows), np.concatenate(keys)


def _deal(scheme: Scheme):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = as_words(b.column(0), scheme)
            for i in range(0, len(fps), DEAL):
                part = fps[i : i + DEAL]
                row, key = keys_of(part, scheme)
                yield pa.RecordBatch.from_arrays([pa.array(key), as_column(part[row])], ["key", "fp"])

    return run


def spanning_links(fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (a, b) of links of at most max_bits differing bits that connect all that such links connect."""
    a, b = [], []
    left = np.arange(len(fps))
    stack: list[int] = []
    while len(left):  # grow one component after another
        if not stack:
            stack.append(int(left[0]))
            left = left[1:]
        j = stack.pop()
        near = np.bitwise_count(fps[left] ^ fps[j]).sum(axis=1) <= max_bits
        found = left[near]
        if len(found):
            a.append(np.full(len(found), j))
            b.append(found)
            stack += found.tolist()
            left = left[~near]
    none = np.zeros(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _links(scheme: Scheme, bucket: int | None):
    """Rows (key, fp), sorted by key, to (key, a, b) links; rows of keys with more than `bucket` fingerprints come out as (key, fp, null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: int | None = None
        held: list[pa.Array] = []
        n, crowded = 0, False

        def settle() -> Iterator[pa.RecordBatch]:
            if n > 1 and not crowded:
                fps = as_words(pa.concat_arrays(held), scheme)
                x, y = spanning_links(fps, scheme.max_bits)
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), key)), as_column(fps[x]), as_column(fps[y])], ["key", "a", "b"])

        for b in batches:
            keys = np.asarray(b.column(0), np.int64)
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)] if len(keys) else []
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if keys[lo] != key:
                    yield from settle()
                    key, held, n, crowded = int(keys[lo]), [], 0, False
                held.append(b.column(1).slice(lo, hi - lo))
                n += hi - lo
                if bucket is not None and n > bucket:
                    crowded = True
                if crowded:
                    for part in held:
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), key)), part, pa.nulls(len(part), pa.binary())], ["key", "a", "b"])
                    held = []
        yield from settle()

    return run


def links(fps: DataFrame, scheme: Scheme, bucket: int | None = None) -> DataFrame:
    """(a, b) of fingerprints (fp, distinct): enough links of at most scheme.max_bits bits to connect all that share a key and such a link."""
    out, bucket = "key long, a binary, b binary", bucket or BUCKET
    dealt = fps.select("fp").mapInArrow(_deal(scheme), "key long, fp binary")
    found = materialize(dealt.repartition("key").sortWithinPartitions("key").mapInArrow(_links(scheme, bucket), out), "simhash")
    crowded = found.where("b is null").select("key", F.col("a").alias("fp"))
    # every pair of blocks of a crowded key is a group of its own
    sizes = crowded.groupBy("key").agg(F.ceil(F.count("*") * 2 / bucket).cast("int").alias("n"))
    own = F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")
    blocks = crowded.join(sizes, "key").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    group = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    # groups that collide are compared together, which finds no link that is not one
    again = blocks.select(group.alias("key"), "fp").repartition("key").sortWithinPartitions("key").mapInArrow(_links(scheme, None), out)
    return found.where("b is not null").select("a", "b").union(again.select("a", "b"))


def _components(docs: DataFrame, scheme: Scheme, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, tag, fp) of each row, where tag is a digest of its text, and (fp, component, component_id) of each fingerprint."""
    kind = dict(docs.dtypes)[id_col]
    prints = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("tag"), F.col(text_col).alias("text"))
    prints = materialize(prints.mapInArrow(in_parts(_fingerprints(scheme)), f"doc_id {kind}, tag long, fp binary"), "simhash")
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash")
    parts = connected_components(links(classes, scheme))
    # fingerprints without a link are components of their own
    of = classes.join(parts, F.col("fp") == F.col("node"), "left").select("fp", "first_id", F.coalesce("component", "fp").alias("component"))
    of = materialize(of, "simhash")
    # as a table, so that the join with one hot component can be split
    names = materialize(of.groupBy("component").agg(F.min("first_id").alias("component_id")), "simhash")
    return prints, of.join(names, "component").select("fp", "component", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scheme: Scheme = EXACT) -> DataFrame:
    """One row per document: (doc_id, fingerprint, component_id)."""
    prints, of = _components(docs, scheme, id_col, text_col)
    return prints.join(of, "fp").select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scheme: Scheme = SIMILAR) -> DataFrame:
    """docs with one document of each component only: that of the smallest id, nulls last, and of those the smallest digest."""
    prints, of = _components(docs, scheme, id_col, text_col)
    place = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), "tag")
    kept = prints.join(of, "fp").groupBy("component").agg(F.min(place).alias("first")).select(F.col("first.id").alias("__id"), F.col("first.tag").alias("__tag"))
    on = F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(text_col) == F.col("__tag"))
    out = docs.join(kept.hint("shuffle_hash"), on, "left_semi")
    places, rows = prints.agg(F.count_distinct(F.struct("doc_id", "tag")), F.count("*")).first()
    # rows that repeat an id and its text are copies too; only then a second shuffle is needed
    return out if places == rows else out.dropDuplicates([id_col, text_col])
