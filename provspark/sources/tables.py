"""Binaries as tables: Spark reads the files, Arrow workers decode them.

Every reader starts from files(), which is Spark's binaryFile source, so any
store that Spark reads will do. A file that can't be decoded gives a row in
errors() and no row elsewhere: of each table, a file gives all its rows or, where
a decoder fails, none. binary_id is the path.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from itertools import chain, islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from provspark.functions.origin import origin, registry_crate_dir
from provspark.functions.symbols import STD_BASE, crate_idents, leading_crate_at, looks_like_ident, normal_crate
from provspark.operators.anchors import detect_roots, location_hits, sane_locations
from provspark.operators.joins import asof_containing, range_join
from provspark.operators.type_names import load_constant_pairs, runs, type_names
from provspark.sources import dwarf, elf, x86

SCHEMAS = {
    "binaries": "binary_id string, arch string, is_pie boolean, warnings array<string>",
    "sections": "binary_id string, section_idx int, name string, vaddr long, size long",
    "relocs": "binary_id string, reloc_idx int, offset long, addend long",
    "frames": "binary_id string, fde_idx int, fn_start long, fn_end long",
    "header_starts": "binary_id string, fn_start long",
    "symbols": "binary_id string, pos int, fn_start long, type string, name string",
    "dies": "binary_id string, cu int, off long, low_pc long, decl_file string, ao long",
    "slots": "binary_id string, reloc_idx int, offset long, addend long, stored_len long, line long, col long, content binary",
    "text": "binary_id string, fn_start long, fn_end long, code binary",
    "rodata": "binary_id string, page long, lo long, data binary",
    "fallback": "binary_id string, fn_start long, fn_end long",
    "errors": "binary_id string, error string",
}
#: What decoders raise on bytes that are not what they should be; BadElf is a ValueError.
BAD = (ValueError, IndexError, KeyError, OverflowError, EOFError, RecursionError, struct.error, zlib.error)
#: Longest string that a relocated slot may name.
MAX_STRING = 512
CHUNK = 1 << 16
#: .rodata is dealt out in pages of this size, each with a margin of the next.
PAGE_BITS, MARGIN = 12, 160


def _slots(e: elf.Elf) -> Iterator[tuple]:
    """Relocations that point into .rodata, with the length and numbers that follow the slot, and the text."""
    ro, rel = e.section(".rodata"), e.section(".data.rel.ro")
    if not ro or not rel:
        return
    for i, offset, addend in elf.relocations(e):
        if ro.has(addend) and rel.has(offset):
            n, line, col = (rel.number(offset + k, s) for k, s in ((8, 8), (16, 4), (20, 4)))
            n = n if n is not None and n < 1 << 62 else None
            yield i, offset, addend, n, line, col, ro.at(addend, n) if n is not None and 0 < n < MAX_STRING else None


def _read(what, e: elf.Elf) -> list:
    """A decoder's rows; none where it fails."""
    try:
        return what(e)
    except BAD:
        return []


def _fallback(e: elf.Elf) -> Iterator[tuple[int, int]]:
    """Without frame descriptions: the search table, call targets and the start of .text, each up to the next."""
    s = e.section(".text")
    if s and not _read(elf.frame_ranges, e):
        end = s.vaddr + len(s.data)
        calls = (target for _, _, op, target, _ in x86.decode(s.data, s.vaddr) if op == "call")
        starts = sorted({s.vaddr, *(x for x in chain(_read(elf.header_starts, e), calls) if s.vaddr <= x < end)})
        yield from ((a, b) for a, b in zip(starts, [*starts[1:], end], strict=True) if b > a)


def _rows(kind: str, e: elf.Elf) -> Iterator[tuple]:
    if kind == "binaries":
        yield "x86_64", e.is_pie, e.warnings
    elif kind == "sections":
        yield from ((s.index, s.name, s.vaddr, len(s.data)) for s in e.sections.values())
    elif kind == "relocs":
        yield from elf.relocations(e)
    elif kind == "frames":
        yield from elf.frame_ranges(e)
    elif kind == "header_starts":
        yield from ((x,) for x in elf.header_starts(e))
    elif kind == "symbols":
        yield from ((i, a, t, n) for i, a, t, n in elf.symbols(e))
    elif kind == "dies":
        yield from dwarf.subprograms(e)
    elif kind == "slots":
        yield from _slots(e)
    elif kind == "fallback":
        yield from _fallback(e)
    elif kind == "rodata":
        s = e.section(".rodata")
        for page in range(s.vaddr >> PAGE_BITS, ((s.vaddr + len(s.data) - 1) >> PAGE_BITS) + 1) if s and s.data else ():
            lo = max(page << PAGE_BITS, s.vaddr)
            at = lo - s.vaddr
            end = ((page + 1) << PAGE_BITS) - s.vaddr + MARGIN
            # one byte before, for boundaries, and enough behind to finish what begins on the page
            yield page, lo, (s.data[at - 1 : at] or b"\0") + s.data[at:end] + (b"\0" if end >= len(s.data) else b"")
    elif kind == "text":
        s = e.section(".text")
        if s:
            last: dict[int, int] = {}
            for _, start, end in elf.frame_ranges(e):
                last[start] = end
            for start, end in last.items():
                if s.has(start):
                    yield start, end, s.data[start - s.vaddr : end - s.vaddr]


def _decoder(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _schema(SCHEMAS[kind])
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                try:
                    e = elf.load(content.as_py())
                    if kind == "errors":
                        for other in ("relocs", "frames", "header_starts", "symbols", "dies"):
                            for _ in _rows(other, e):
                                pass
                        continue
                    # made whole before any of it is sent, so that no part of a bad file is
                    found = list(_batches(path, _rows(kind, e), schema))
                except BAD as err:
                    if kind == "errors":
                        yield _batch([(path, f"{type(err).__name__}: {err}")], schema)
                    continue
                yield from found

    return run


def _schema(text: str) -> pa.Schema:
    return pa.schema([(x.split()[0], _ARROW[x.split()[1]]) for x in text.split(", ")])


def _batches(path: str, rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    while part := list(islice(rows, CHUNK)):
        yield _batch([(path, *row) for row in part], schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


_ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<string>": pa.list_(pa.string())}


def files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, content) of files, one row each; Spark bounds the bytes of a batch that a worker gets."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def table(binaries: DataFrame, kind: str) -> DataFrame:
    """One of SCHEMAS, decoded from files()."""
    return binaries.mapInArrow(_decoder(kind), SCHEMAS[kind])


def functions(binaries: DataFrame) -> DataFrame:
    """(binary_id, fn_start, fn_end, map_source); of equal starts the last description stays.

    Binaries without frame descriptions get ranges from the search table, call
    targets and the start of .text; which those are is seen where a file is
    decoded, so no file's bytes are joined.
    """
    frames = table(binaries, "frames").groupBy("binary_id", "fn_start").agg(F.max_by("fn_end", "fde_idx").alias("fn_end"))
    return frames.select("*", F.lit("eh_frame").alias("map_source")).union(table(binaries, "fallback").select("*", F.lit("fallback").alias("map_source")))


INSTRUCTIONS = "binary_id string, fn_start long, ip long, length int, op string, target long, imm long"
_INSTR = _schema(INSTRUCTIONS)


def _emit(path: str, start: int | None, code: bytes, base: int) -> Iterator[tuple]:
    for ip, size, op, target, imm in x86.decode(code, base):
        yield path, start, ip, size, op, target if target is None or 0 <= target < 1 << 63 else None, imm


def _flat_decoder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            try:
                s = elf.load(content.as_py()).section(".text")
            except BAD:
                continue
            if s:
                rows = _emit(path, None, s.data, s.vaddr)
                while part := list(islice(rows, CHUNK)):
                    yield _batch(part, _INSTR)


def _function_decoder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for b in batches:
            for path, start, code in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3), strict=True):
                yield from _emit(path, start, code.as_py(), start)

    # batches are filled across functions, most of which have few rows
    found = rows()
    while part := list(islice(found, CHUNK)):
        yield _batch(part, _INSTR)


def flat_instructions(binaries: DataFrame) -> DataFrame:
    """Interesting instructions of all of .text, without function."""
    return binaries.mapInArrow(_flat_decoder, INSTRUCTIONS)


def instructions(binaries: DataFrame, partitions: int | None = None) -> DataFrame:
    """Interesting instructions of every described function; overlaps are decoded for each.

    Functions are dealt out before they are decoded, so one huge binary is not one task.
    """
    n = partitions or int(binaries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return table(binaries, "text").repartition(n, "binary_id", "fn_start").mapInArrow(_function_decoder, INSTRUCTIONS)


def source_strings(binaries: DataFrame) -> DataFrame:
    """(binary_id, vaddr, content) of embedded .rs paths; the first slot of an address decides, before it is checked."""
    first = table(binaries, "slots").groupBy("binary_id", "addend").agg(F.min_by("content", "reloc_idx").alias("content"))
    return _rust_paths(first).select("binary_id", F.col("addend").alias("vaddr"), "content")


def _rust_paths(rows: DataFrame) -> DataFrame:
    """Rows whose content is UTF-8 and ends in .rs, as text."""
    text = F.col("content").cast("string")
    return rows.where("content IS NOT NULL").where(F.is_valid_utf8(text)).withColumn("content", text).where(F.col("content").endswith(".rs"))


def locations(binaries: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """(binary_id, struct_vaddr, file, file_vaddr, line, col, origin, kind); roots (binary_id, root_crate).

    Each slot gets the text that the first slot of its address has, in one pass over the slots.
    """
    first = F.first("content").over(W.partitionBy("binary_id", "addend").orderBy("reloc_idx"))
    found = sane_locations(_rust_paths(table(binaries, "slots").withColumn("content", first)), ["binary_id"])
    if roots is not None:
        named = roots.where("root_crate IS NOT NULL").groupBy("binary_id").agg(F.collect_set("root_crate").alias("__roots"))
        found = found.join(named, "binary_id", "left")
        o = origin(F.col("file"), F.coalesce("__roots", F.array().cast("array<string>")))
    else:
        o = origin(F.col("file"))
    return found.select("binary_id", "struct_vaddr", "file", "file_vaddr", "line", "col", o.alias("origin"), o["kind"].alias("kind"))


def root_crates(binaries: DataFrame, explicit: list[str] | None = None) -> DataFrame:
    """(binary_id, outcome, root_crate): an explicit list wins, else registry paths decide."""
    ids = binaries.select(F.col("path").alias("binary_id"))
    if explicit:
        return ids.select("binary_id", F.lit("explicit").alias("outcome"), F.explode(F.array(*map(F.lit, explicit))).alias("root_crate"))
    stem = F.regexp_replace(F.element_at(F.split("binary_id", "/"), -1), r"\.[^.]*$", "")
    paths = source_strings(binaries).select("binary_id", stem.alias("stem"), F.col("content").alias("path"))
    return detect_roots(paths.where(registry_crate_dir(F.col("path")).isNotNull()), ["binary_id"]).select("binary_id", "outcome", "root_crate")


def references(code: DataFrame) -> DataFrame:
    """(binary_id, fn_start, ea) of operands relative to the next instruction."""
    return code.where("op IN ('lea', 'ref') AND target IS NOT NULL").select("binary_id", "fn_start", F.col("target").alias("ea"))


def call_edges(code: DataFrame, fns: DataFrame) -> DataFrame:
    """(binary_id, caller, callee) of direct calls to function starts.

    Both sides are shuffled: a planner that goes by the size of the compressed
    binaries takes the functions for a small table and sends them to the driver.
    """
    starts = fns.select("binary_id", F.col("fn_start").alias("callee")).hint("merge")
    edges = code.where("op = 'call'").select("binary_id", F.col("fn_start").alias("caller"), F.col("target").alias("callee")).distinct()
    return edges.join(starts, ["binary_id", "callee"], "left_semi").select("binary_id", "caller", "callee")


def truth_from_debug_info(binaries: DataFrame, fns: DataFrame) -> DataFrame:
    """(binary_id, fn_start, path, kind) of functions that debug info declares."""
    from provspark.functions.origin import origin_for_debug_info

    found = dwarf.resolve_origins(table(binaries, "dies"), ["binary_id"]).withColumnRenamed("decl_file", "path")
    known = found.join(fns.select("binary_id", "fn_start"), ["binary_id", "fn_start"], "left_semi")
    return known.select("binary_id", "fn_start", "path", origin_for_debug_info(F.col("path"))["kind"].alias("kind"))


def analyse(binaries: DataFrame, min_anchors: int = 2, infer_depth: int | None = None, explicit_roots: list[str] | None = None) -> dict[str, DataFrame]:
    """All tables of the standard run: functions, locations, hits, calls, attributed, tiers.

    Decoded tables are written to the shared folder, for each is used several times.
    """
    from provspark.operators.anchors import certain_and_boundary, tier_functions
    from provspark.operators.graph import attribute
    from provspark.session import materialize

    by = ["binary_id"]
    fns = materialize(functions(binaries), "functions")
    locs = materialize(locations(binaries, root_crates(binaries, explicit_roots)), "locations")
    code = materialize(instructions(binaries), "instructions")
    hits = materialize(location_hits(references(code), locs, by), "hits")
    calls = materialize(call_edges(code, fns), "calls")
    marks = certain_and_boundary(hits, by)
    attributed = attribute(fns, marks.where("is_certain"), calls, marks.where("is_boundary"), infer_depth, by)
    tiers = tier_functions(fns, hits, locs, min_anchors, by=by)
    return {"functions": fns, "locations": locs, "hits": hits, "calls": calls, "attributed": attributed, "tiers": tiers}


def slot_idents(binaries: DataFrame) -> DataFrame:
    """(binary_id, target, ident): identifiers that relocated slots name, by slot; the last relocation of a slot counts."""
    text = table(binaries, "slots").where("content IS NOT NULL AND stored_len < 128")
    text = text.groupBy("binary_id", F.col("offset").alias("target")).agg(F.max_by("content", "reloc_idx").alias("c"))
    ident = F.decode("c", "ISO-8859-1")
    return text.select("binary_id", "target", ident.alias("ident")).where(looks_like_ident(F.col("ident")) & ~F.col("ident").endswith(".rs"))


def loaded_idents(pairs: DataFrame, binaries: DataFrame) -> DataFrame:
    """(binary_id, fn_start, ident): pairs (binary_id, fn_start, target, imm) whose imm bytes at target are one whole identifier."""
    pages = table(binaries, "rodata")
    near = pairs.select("binary_id", "fn_start", "target", "imm").distinct().withColumn("page", F.shiftright("target", PAGE_BITS)).join(pages, ["binary_id", "page"])
    # the byte before, the bytes, and the byte behind
    at = (F.col("target") - F.col("lo") + 1).cast("int")
    around = F.decode(F.col("data").substr(at, (F.col("imm") + 2).cast("int")), "ISO-8859-1")
    whole = around.rlike("(?s)^[^A-Za-z0-9_][A-Za-z0-9_]{2,}[^A-Za-z0-9_]$") & (F.length(around) == F.col("imm") + 2)
    found = near.where(F.col("target") >= F.col("lo")).select("binary_id", "fn_start", around.alias("a"), whole.alias("w")).where("w")
    ident = F.expr("substring(a, 2, length(a) - 2)")
    return found.select("binary_id", "fn_start", ident.alias("ident")).where(F.col("ident").rlike("[A-Za-z]") & ~F.col("ident").rlike("^[A-Z_]+$")).distinct()


def swept_crates(binaries: DataFrame) -> DataFrame:
    """Distinct (binary_id, crate): identifiers in .rodata that ``::`` follows."""
    text = F.decode("data", "ISO-8859-1")
    return table(binaries, "rodata").select("binary_id", F.explode(crate_idents(text)).alias("crate")).distinct()


def named_paths(binaries: DataFrame) -> DataFrame:
    """(binary_id, slot, vaddr, kind, crate) of relocated slots that name .rs paths; the first relocation of a slot counts."""
    first = table(binaries, "relocs").groupBy("binary_id", "offset").agg(F.min("reloc_idx").alias("reloc_idx"))
    slots = table(binaries, "slots").where("content IS NOT NULL").join(first, ["binary_id", "offset", "reloc_idx"], "left_semi")
    text = F.col("content").cast("string")
    o = origin(text)
    good = slots.where(F.is_valid_utf8(text) & text.endswith(".rs"))
    return good.select("binary_id", F.col("offset").alias("slot"), F.col("addend").alias("vaddr"), o["kind"].alias("kind"), o["crate"].alias("crate"))


def author_crates(binaries: DataFrame, paths: DataFrame) -> DataFrame:
    """(binary_id, crate): identifiers swept from .rodata that neither the standard library nor a dependency in paths has."""
    deps = paths.where("kind = 'dep'").select("binary_id", normal_crate(F.col("crate")).alias("crate"))
    return swept_crates(binaries).where(~F.col("crate").isin(*STD_BASE, "test")).join(deps, ["binary_id", "crate"], "left_anti")


def bare_anchors(binaries: DataFrame, refs: DataFrame, locs: DataFrame) -> DataFrame:
    """Distinct (binary_id, fn_start, anchor) of references (binary_id, fn_start, ea) that are no locations.

    path: to an author's .rs path, or into a slot that names one and is not a
    location; crate: elsewhere to text that begins with an author's crate.
    """
    paths = named_paths(binaries)
    own = paths.where("kind = 'user'")
    places = locs.where("kind = 'user'").select("binary_id", F.col("struct_vaddr").alias("slot"))
    slots = own.join(places, ["binary_id", "slot"], "left_anti").select("binary_id", "slot", (F.col("slot") + 16).alias("slot_end")).distinct()
    key = ["binary_id", "fn_start", "ea"]
    at_slot = range_join(refs, slots, "ea", "slot", "slot_end", by=["binary_id"], bits=5).select(*key)
    at_path = refs.join(own.select("binary_id", F.col("vaddr").alias("ea")), ["binary_id", "ea"], "left_semi").select(*key)
    by_path = at_slot.union(at_path).distinct()
    rest = refs.select(*key).distinct().join(by_path, key, "left_anti").withColumn("page", F.shiftright("ea", PAGE_BITS))
    near = rest.join(table(binaries, "rodata"), ["binary_id", "page"]).where("ea >= lo")
    # the page's data begin one byte before lo; a margin holds the longest identifier
    here = F.decode(F.col("data").substr((F.col("ea") - F.col("lo") + 2).cast("int"), F.lit(66)), "ISO-8859-1")
    named = near.select("binary_id", "fn_start", leading_crate_at(here).alias("crate")).where("crate IS NOT NULL")
    by_crate = named.join(author_crates(binaries, paths), ["binary_id", "crate"], "left_semi")
    marked = by_path.select("binary_id", "fn_start", F.lit("path").alias("anchor"))
    return marked.union(by_crate.select("binary_id", "fn_start", F.lit("crate").alias("anchor"))).distinct()


def recover_types(binaries: DataFrame, code: DataFrame, fns: DataFrame, attributed: DataFrame) -> DataFrame:
    """(binary_id, struct_name, fields, tier, fn_start) from identifiers that functions load; code is flat_instructions()."""
    by = ["binary_id"]
    inside = runs(code.where("op IN ('lea', 'mov')").select("binary_id", "ip", "op", "imm", "target"), fns, by)
    pairs = load_constant_pairs(inside, by)
    slots = code.where("op IN ('lea', 'ref')").select("binary_id", "ip", "target").join(slot_idents(binaries), ["binary_id", "target"])
    named = asof_containing(slots.select("binary_id", "ip", "ident"), fns.select("binary_id", "fn_start", "fn_end"), "ip", "fn_start", "fn_end", by)
    idents = loaded_idents(pairs, binaries).union(named.select("binary_id", "fn_start", "ident")).distinct()
    return type_names(idents, attributed, by)
