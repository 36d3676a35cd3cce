"""Operator 5: removal of repeated byte strings (suffix-array dedup).

A byte is removed if it is covered by a string of `length` bytes that also
starts in a document with a smaller id, judged on the input.

Strings must meet to be compared. Of the hashes of the 16-byte grams of a
string the smallest (of equal ones the last) is its anchor, so equal strings
have equal anchors at equal places. Texts are worked through in batches.

1. Each batch sends one short hash for every anchor, dealt out by hash; hashes
   that occur once can't be part of a repeated string and end there.
2. Strings around anchors that occur again are dealt out by anchor hash, each
   different one once for each batch, with its smallest id. A block of them is
   searched by bwt.least_owner: threshold-bounded backward extension on the
   Burrows-Wheeler transform of the block.
3. Each batch gets back, for each of its strings, the least id at each start.

A document whose whole text also has a smaller id is removed without search,
and does not take part in steps 2 and 3, as the smaller id has the same
strings. What a task gathers of one anchor, passage or group of copies is at
most one entry for each batch of texts, never one for each document.

Ids are integers. Edge cases: a null or empty text has 0 bytes; texts shorter
than `length` lose nothing; repeated rows with one id and text do not remove
each other, and rows of one id with different texts are searched as documents
of one id; a null id counts as larger than every other; texts are never cut;
an empty table gives an empty result. Columns other than id and text are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provspark.llm.bwt import least_owner, sorted_places
from provspark.llm.common import in_parts, materialize

LENGTH, GRAM = 50, 16
BATCH_BYTES = 8 << 20
#: Text bytes for each block of hashes or strings.
BLOCK_BYTES = 4 << 20
NONE = 0xFFFFFFFF
NO_ID = np.iinfo(np.int64).max - 1
PLACE = np.uint64(28)
#: Starts whose anchors are worked out at once.
PIECE = 1 << 15
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def pack(*arrays: np.ndarray, raw: bytes = b"") -> bytes:
    """Arrays and bytes as one compressed value."""
    head = np.array([len(arrays), *(a.nbytes for a in arrays)], "<i8").tobytes()
    kinds = b"".join(a.dtype.str.encode().ljust(4) for a in arrays)
    return zstandard.ZstdCompressor(level=3).compress(head + kinds + b"".join(a.tobytes() for a in arrays) + raw)


def unpack(value: bytes) -> tuple[list[np.ndarray], bytes]:
    data = zstandard.ZstdDecompressor().decompress(value)
    n = int(np.frombuffer(data, "<i8", 1)[0])
    sizes = np.frombuffer(data, "<i8", n, 8).tolist()
    at = 8 * (n + 1)
    kinds = [data[at + 4 * i : at + 4 * i + 4].decode().strip() for i in range(n)]
    at += 4 * n
    out = []
    for size, kind in zip(sizes, kinds, strict=True):
        out.append(np.frombuffer(data[at : at + size], kind))
        at += size
    return out, data[at:]


def _words(data: bytes) -> np.ndarray:
    """The 8 bytes from each place on, as a number."""
    wide = np.frombuffer(data, np.uint8)
    return np.lib.stride_tricks.as_strided(wide[:8].view("<u8"), (len(data) - 7,), (1,))


def _mixed(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    h = low * M1
    h ^= h >> np.uint64(29)
    h ^= high
    h *= M2
    h ^= h >> np.uint64(32)
    h *= M1
    return h


def _least_places(words: np.ndarray, length: int) -> np.ndarray:
    """Of each start: the place of the gram with the smallest hash, the last of equal ones, in its next `length` bytes.

    Worked out in pieces that stay in the processor's cache.
    """
    n, window = len(words) + 8 - length, length - GRAM + 1
    out = np.empty(n, np.int32)
    top = (np.uint64(1) << PLACE) - np.uint64(1)
    for at in range(0, n, PIECE):
        m = min(PIECE, n - at) + window - 1
        h = _mixed(words[at : at + m], words[at + 8 : at + 8 + m])
        key = ((h >> PLACE) << PLACE) | (top - np.arange(m, dtype=np.uint64))
        reach = 1
        while reach * 2 <= window:
            key = np.minimum(key[:-reach], key[reach:])
            reach *= 2
        if reach < window:
            key = np.minimum(key[: len(key) - (window - reach)], key[window - reach :])
        out[at : at + PIECE] = (top - (key & top)).astype(np.int32) + at
    return out


def anchors(texts: list[bytes], length: int = LENGTH) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(buffer, text number, hash, first start, number of starts) of each anchor, in order.

    Starts are places in the buffer, in which byte 255 follows each text.
    """
    data = b"".join(t + b"\xff" for t in texts)
    sizes = np.array([len(t) for t in texts], np.int64)
    none = np.zeros(0, np.int64)
    if not (sizes >= length).any():
        return data, none, none.astype(np.uint64), none, none
    words = _words(data)
    place = _least_places(words, length)
    begin = np.cumsum(sizes + 1) - sizes - 1
    end = begin + sizes - length + 1  # of the starts, of texts that are long enough
    new, inside = np.ones(len(place), bool), np.zeros(len(place) + 1, np.int8)
    new[1:] = place[1:] != place[:-1]
    new[begin[sizes >= length]] = True
    inside[begin[sizes >= length]] = 1
    inside[end[sizes >= length]] = -1
    first = np.flatnonzero(new & np.cumsum(inside[:-1], dtype=np.int8).view(bool))
    owner = np.searchsorted(begin, first, side="right") - 1
    at = place[first]
    return data, owner, _mixed(words[at], words[at + 8]), first, np.minimum(np.append(first[1:], len(place)), end[owner]) - first


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(33)) % np.uint64(n)).astype(np.int64)


def in_batches(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.Table]:
    """Rows gathered until their column holds about `limit` bytes."""
    held, size = [], 0
    for b in batches:
        at, part = 0, b.column(b.schema.get_field_index(column))
        lengths = pc.fill_null(pc.binary_length(part), 0).to_pylist()
        for i, n in enumerate(lengths):
            size += n
            if size >= limit:
                held.append(b.slice(at, i + 1 - at))
                yield pa.Table.from_batches(held)
                held, size, at = [], 0, i + 1
        if at < len(lengths):
            held.append(b.slice(at))
    if held:
        yield pa.Table.from_batches(held)


def in_groups(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[int, pa.Table]]:
    """Runs of equal values of a column in sorted rows."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not len(b):
            continue
        keys = np.asarray(b.column(b.schema.get_field_index(column)))
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if held and keys[lo] != last:
                yield int(last), pa.Table.from_batches(held)
                held = []
            last = keys[lo]
            held.append(b.slice(lo, hi - lo))
    if held:
        yield int(last), pa.Table.from_batches(held)


def rows_of(values: Iterable[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    it = iter(values)
    while part := list(islice(it, 256)):
        a, b, c = zip(*part, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.binary())], ["block", "batch", "value"])


ROWS = "block long, batch long, value binary"
#: Block numbers of rows that are about a batch: -1 lists its documents, -2 places found within it.
ABOUT, WITHIN = -1, -2


def _short_hashes(n_blocks: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_batches(batches, "text", BATCH_BYTES):
            ids = np.asarray(part.column("doc_id").combine_chunks(), np.int64)
            tags = np.asarray(part.column("tag").combine_chunks(), np.int64)
            _, owner, h, _, _ = anchors([(t or "").encode("utf-8", "surrogatepass") for t in part.column("text").to_pylist()], length)
            batch = xxhash.xxh64_intdigest(ids.tobytes() + tags.tobytes()) >> 1
            counts = np.bincount(owner, minlength=len(ids)).astype(np.int64)
            # in order of some of the bits; equal ones that others part are only sent more often
            order, _ = sorted_places((h * M2) >> np.uint64(24), 40)
            same = np.concatenate([[False], h[order][1:] == h[order][:-1]]) if len(h) else np.zeros(0, bool)
            twice = same | np.append(same[1:], False) if len(h) else same
            out = [(ABOUT, batch, pack(ids, tags, counts)), (WITHIN, batch, pack(np.sort(order[twice]).astype(np.uint32)))]
            one = order[~same]  # one for each hash, in order of hash
            place = np.where(twice[~same], NONE, one).astype(np.uint32)
            block = bucket_of(h[one], n_blocks)
            by = np.argsort((block.astype(np.uint64) << np.uint64(32)) | place)
            block, place, short = block[by], place[by], (h[one][by] & np.uint64(NONE)).astype(np.uint32)
            cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)] if len(block) else []
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                out.append((int(block[lo]), batch, pack(short[lo:hi], np.diff(place[lo:hi], prepend=np.uint32(0)))))
            yield from rows_of(out)

    return run


def _repeated_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block: the places of hashes that two batches or more have sent."""
    for block, part in in_groups(batches, "block"):
        if block < 0:
            for b in part.to_batches(max_chunksize=256):
                yield b.select(["block", "batch", "value"])
            continue
        rows = [unpack(v)[0] for v in part.column("value").to_pylist()]
        order, run = sorted_places(np.concatenate([r[0] for r in rows]).astype(np.uint64), 32)
        equal = run[1:] == run[:-1]
        again = np.zeros(len(order), bool)
        again[order[np.append(equal, False) | np.concatenate([[False], equal])]] = True
        out, at = [], 0
        for batch, (short, steps) in zip(part.column("batch").to_pylist(), rows, strict=True):
            place = np.cumsum(steps, dtype=np.uint32)
            found = place[again[at : at + len(short)] & (place != NONE)]
            at += len(short)
            if len(found):
                out.append((WITHIN, batch, pack(found)))
        yield from rows_of(out)


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each batch: the repeated anchors of each document, numbered within it."""
    for _, part in in_groups(batches, "batch"):
        blocks, values = part.column("block").to_pylist(), part.column("value").to_pylist()
        (ids, tags, counts), _ = unpack(next(v for b, v in zip(blocks, values, strict=True) if b == ABOUT))
        found = np.unique(np.concatenate([unpack(v)[0][0] for b, v in zip(blocks, values, strict=True) if b == WITHIN])).astype(np.int64)
        begin = np.cumsum(counts) - counts
        doc = np.searchsorted(begin + counts, found, side="right")
        cuts = [0, *(np.flatnonzero(doc[1:] != doc[:-1]) + 1).tolist(), len(doc)] if len(doc) else []
        docs = [int(doc[lo]) for lo in cuts[:-1]]
        values = [pack((found[lo:hi] - begin[doc[lo]]).astype(np.uint32)) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(ids[docs], pa.int64()), pa.array(tags[docs], pa.int64()), pa.array(values, pa.binary())], ["doc_id", "tag", "places"])


def _compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    z = zstandard.ZstdCompressor(level=3)
    for b in batches:
        texts = [z.compress((t or "").encode("utf-8", "surrogatepass")) for t in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.binary())], ["doc_id", "tag", "z"])


def _strings(n_blocks: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for part in in_batches(batches, "z", BATCH_BYTES // 3):
            ids = np.asarray(part.column("doc_id").combine_chunks(), np.int64)
            tags = np.asarray(part.column("tag").combine_chunks(), np.int64)
            texts = [z.decompress(x) if x else b"" for x in part.column("z").to_pylist()]
            data, owner, h, start, n = anchors(texts, length)
            counts = np.bincount(owner, minlength=len(ids))
            begin = np.cumsum(counts) - counts
            chosen = np.concatenate([unpack(v)[0][0].astype(np.int64) + begin[i] for i, v in enumerate(part.column("places").to_pylist())])
            owner, h, start, n = owner[chosen], h[chosen], start[chosen], n[chosen]
            batch = xxhash.xxh64_intdigest(ids.tobytes() + tags.tobytes()) >> 1
            block = bucket_of(h, n_blocks)
            numbers: dict[bytes, int] = {}
            which = np.fromiter((numbers.setdefault(data[s : s + k], len(numbers)) for s, k in zip(start.tolist(), (n + length - 1).tolist(), strict=True)), np.int64, len(start))
            least = np.full(len(numbers), NO_ID + 1, np.int64)
            np.minimum.at(least, which, ids[owner])
            home = np.zeros(len(numbers), np.int64)
            home[which] = block  # equal strings have equal anchors
            by = np.argsort(home, kind="stable")
            rank = np.empty(len(by), np.int64)
            rank[by] = np.arange(len(by))
            text_at = np.cumsum([0, *(len(t) + 1 for t in texts)])
            yield from rows_of([(ABOUT, batch, pack(ids, tags, owner.astype(np.int32), (start - text_at[owner]).astype(np.int64), rank[which]))])
            strings = list(numbers)
            cuts = [0, *(np.flatnonzero(np.diff(home[by])) + 1).tolist(), len(by)] if len(by) else []
            out = []
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                own = [strings[i] for i in by[lo:hi]]
                sizes = np.array([len(s) for s in own], np.int32)
                out.append((int(home[by[lo]]), batch, pack(np.array([lo], np.int64), sizes, least[by[lo:hi]], raw=b"".join(own))))
            yield from rows_of(out)

    return run


class _Block:
    """The different strings of one block, each with its least owner; what equal strings add is their number."""

    def __init__(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.owners: list[int] = []
        self.rows: list[tuple[int, int, np.ndarray]] = []

    def add(self, batch: int, value: bytes) -> None:
        (first, sizes, ids), raw = unpack(value)
        ends = np.cumsum(sizes)
        numbers, owners, which = self.numbers, self.owners, []
        for lo, hi, i in zip((ends - sizes).tolist(), ends.tolist(), ids.tolist(), strict=True):
            k = numbers.setdefault(raw[lo:hi], len(numbers))
            if k == len(owners):
                owners.append(i)
            elif i < owners[k]:
                owners[k] = i
            which.append(k)
        self.rows.append((batch, int(first[0]), np.array(which, np.int32)))

    def answers(self, length: int) -> Iterator[tuple[int, int, bytes]]:
        """For each batch: the least id at each start of its strings, as runs of one least id, none longer than its string."""
        strings = list(self.numbers)
        starts = np.array([len(s) - length + 1 for s in strings], np.int64)
        least = least_owner(strings, np.array(self.owners, np.int64), starts, length)
        begin = np.cumsum(starts) - starts
        new = np.concatenate([[True], least[1:] != least[:-1]])
        new[begin] = True
        at = np.flatnonzero(new)
        run_size, run_id = np.diff(np.append(at, len(least))), least[at]
        run_begin = np.searchsorted(at, begin)
        run_count = np.diff(np.append(run_begin, len(at)))
        for batch, first, which in self.rows:
            k = run_count[which]
            pick = np.repeat(run_begin[which] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
            yield WITHIN, batch, pack(np.array([first], np.int64), k.astype(np.int32), run_size[pick].astype(np.int32), run_id[pick])


def _search(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by block; strings are taken up as they come, so that equal ones are held once."""
        last, block = ABOUT, _Block()
        for b in batches:
            numbers = np.asarray(b.column(0), np.int64)
            if (about := numbers < 0).any():
                yield b.filter(pa.array(about)).select(["block", "batch", "value"])
            for number, batch, value in zip(numbers[~about].tolist(), *(b.column(i).filter(pa.array(~about)).to_pylist() for i in (1, 2)), strict=True):
                if number != last:
                    if block.rows:
                        yield from rows_of(block.answers(length))
                    last, block = number, _Block()
                block.add(batch, value)
        if block.rows:
            yield from rows_of(block.answers(length))

    return run


def merge(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open intervals, as maximal runs."""
    by = np.argsort(lo, kind="stable")
    lo, top = lo[by], np.maximum.accumulate(hi[by])
    new = np.concatenate([[True], lo[1:] > top[:-1]])
    first = np.flatnonzero(new)
    return lo[first], top[np.append(first[1:], len(lo)) - 1]


def _spans(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each batch: the removed spans of each document."""
        for _, part in in_groups(batches, "batch"):
            blocks, values = part.column("block").to_pylist(), part.column("value").to_pylist()
            (ids, tags, owner, start, which), _ = unpack(next(v for b, v in zip(blocks, values, strict=True) if b == ABOUT))
            total = int(which.max()) + 1 if len(which) else 0
            counts, sizes, least = np.zeros(total, np.int64), {}, {}
            for b, v in zip(blocks, values, strict=True):
                if b == WITHIN:
                    (first, k, size, who), _ = unpack(v)
                    counts[int(first[0]) : int(first[0]) + len(k)] = k
                    sizes[int(first[0])], least[int(first[0])] = size, who
            if not total:
                continue
            keys = sorted(sizes)
            size, who = np.concatenate([sizes[k] for k in keys]).astype(np.int64), np.concatenate([least[k] for k in keys])
            begin = np.cumsum(counts) - counts
            within = np.cumsum(size) - size
            within -= np.repeat(within[np.minimum(begin, len(size) - 1)], counts)  # start of each run in its string
            k = counts[which]
            at = np.repeat(begin[which] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
            doc, base = np.repeat(owner.astype(np.int64), k), np.repeat(start, k)
            gone = who[at] < ids[doc]
            doc, lo = doc[gone], (base + within[at])[gone]
            hi = lo + size[at][gone] + length - 1
            by = np.argsort(doc, kind="stable")
            doc, lo, hi = doc[by], lo[by], hi[by]
            cuts = [0, *(np.flatnonzero(np.diff(doc)) + 1).tolist(), len(doc)] if len(doc) else []
            docs = [int(doc[a]) for a in cuts[:-1]]
            spans = [pack(*merge(lo[a:b], hi[a:b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids[docs], pa.int64()), pa.array(tags[docs], pa.int64()), pa.array(spans, pa.binary())], ["doc_id", "tag", "spans"])

    return run


def cut(text: bytes, spans: bytes | None) -> tuple[bytes, int, int]:
    """(what is left, bytes removed, spans)."""
    if spans is None:
        return text, 0, 0
    lo, hi = unpack(spans)[0]
    keep = [text[a:b] for a, b in zip([0, *hi.tolist()], [*lo.tolist(), len(text)], strict=True)]
    return b"".join(keep), int((hi - lo).sum()), len(lo)


def _finish(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for b in batches:
            found = []
            for x, spans, copy, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                text = z.decompress(x) if x else b""
                found.append((b"", n, 1) if copy else cut(text, spans))
            cols = [
                b.column(4),
                pa.array([f[1] for f in found], pa.int64()),
                pa.array([f[2] for f in found], pa.int64()),
                pa.array([hashlib.sha256(f[0]).hexdigest() for f in found], pa.string()),
            ]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:  # a cut inside a character leaves parts of it, which become U+FFFD
                cols.append(pa.array([f[0].decode("utf-8", "replace") for f in found], pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names)

    return run


def remove_substrings(docs: DataFrame, length: int = LENGTH, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (doc_id, n_bytes, n_removed, n_spans, kept_sha256) and, if asked for, kept_text."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), text.alias("text")).select(
        F.coalesce("__id", F.lit(int(NO_ID))).alias("doc_id"), F.xxhash64("text").alias("tag"), "text", F.col("__id")
    )
    sizes = materialize(rows.select("doc_id", "tag", F.unhex(F.sha2("text", 256)).alias("sha"), F.octet_length("text").cast("long").alias("n_bytes")), "substr")
    total = sizes.agg(F.sum("n_bytes")).first()[0] or 0
    # some for each task, so that none waits for a few large ones
    n_blocks = int(max(total // BLOCK_BYTES, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    # whole copies
    first = sizes.where(F.col("n_bytes") >= length).groupBy("sha").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    first = materialize(first.select("sha", "first"), "substr")  # as a table, so that a join with one hot digest can be split
    copies = sizes.join(first, "sha").where("doc_id > first").select("doc_id", "tag", F.lit(True).alias("copy")).distinct()
    copies = materialize(copies, "substr")

    sent = rows.select("doc_id", "tag", "text").mapInArrow(_short_hashes(n_blocks, length), ROWS)
    by_block = F.when(F.col("block") >= 0, F.col("block")).otherwise(F.col("batch"))
    found = sent.repartition(by_block).sortWithinPartitions("block", "batch").mapInArrow(_repeated_hashes, ROWS)
    places = found.repartition("batch").sortWithinPartitions("batch", "block").mapInArrow(_by_document, "doc_id long, tag long, places binary")
    places = materialize(places.join(copies.drop("copy"), ["doc_id", "tag"], "left_anti"), "substr").dropDuplicates(["doc_id", "tag"])

    packed = rows.select("doc_id", "tag", "text").mapInArrow(in_parts(_compress), "doc_id long, tag long, z binary")
    near = packed.join(places.hint("shuffle_hash"), ["doc_id", "tag"]).sortWithinPartitions("doc_id", "tag")
    strings = near.mapInArrow(_strings(n_blocks, length), ROWS)
    least = strings.repartition(by_block).sortWithinPartitions("block", "batch").mapInArrow(_search(length), ROWS)
    spans = least.repartition("batch").sortWithinPartitions("batch", "block").mapInArrow(_spans(length), "doc_id long, tag long, spans binary")
    spans = materialize(spans, "substr").dropDuplicates(["doc_id", "tag"])

    notes = spans.join(copies, ["doc_id", "tag"], "full_outer")
    every = packed.join(notes.hint("shuffle_hash"), ["doc_id", "tag"], "left")
    n_bytes = sizes.select("doc_id", "tag", "n_bytes").distinct()
    every = every.join(n_bytes.hint("shuffle_hash"), ["doc_id", "tag"])
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept_text string" if with_text else "")
    done = every.select("doc_id", "z", "spans", "copy", "n_bytes").mapInArrow(in_parts(_finish(with_text)), out)
    return done.withColumn("doc_id", F.nullif("doc_id", F.lit(int(NO_ID))))
