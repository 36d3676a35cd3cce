"""Decoder queries over images made of the driver's tables; their SQL is the tables themselves.

Rows are dealt to binaries by ranges of their keys, so that an image has a
bounded size and the number of images grows with the tables.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provspark.plans.fixtures import sql_with, view
from provspark.plans.sql import SITE_KIND
from provspark.session import materialize_large
from provspark.sources import image as im
from provspark.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
c = F.col
#: Keys for each image.
ORDERS, PARTS = 4096, 512
TEXT, RODATA, DATA, RELA, FRAMES, HEADER = 0x1000, 0x8000000, 0x10000000, 0x20000000, 0x28000000, 0x30000000
#: Bytes between functions, and between strings.
ROOM, SLOT = 4096, 128


def query(name: str, sql: str):
    def add(f: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(lambda table: view(spark, sf_dir, table) if table.startswith("fx_") else spark.read.parquet(f"{sf_dir}/{table}.parquet"))
            return out.select(*[c(n).cast("long").alias(n) if t == "int" else c(n) for n, t in out.dtypes])

        QUERIES[name], ORACLES[name] = run, sql
        return f

    return add


def built(rows: DataFrame, key: str, size: int, make: Callable[[pd.DataFrame], bytes | list[bytes]]) -> DataFrame:
    """(path, content): an image, or several under one path, of the rows of each `size` keys."""

    def one(part: pd.DataFrame) -> pd.DataFrame:
        made = make(part)
        made = made if isinstance(made, list) else [made]
        return pd.DataFrame({"path": [str(int(part["__b"].iloc[0]))] * len(made), "content": made})

    dealt = rows.withColumn("__b", F.floor(c(key) / size).cast("long"))
    return materialize_large(dealt.groupBy("__b").applyInPandas(one, "path string, content binary"), "images")


def numbers(part: pd.DataFrame, *columns: str) -> list[tuple[int, ...]]:
    return list(zip(*(map(int, part[x]) for x in columns), strict=True))


# ---- sections and relocations ------------------------------------------------------------------------------------


def relocation_image(part: pd.DataFrame) -> bytes:
    rows = numbers(part.sort_values("o_orderkey"), "o_orderkey", "o_custkey")
    table = im.relocation_table((DATA + 24 * o, 7 if o % 7 == 3 else 8, RODATA + 8 * k) for o, k in rows)
    return im.image({".text": (TEXT, b"\xc3" * len(rows)), ".rodata": (RODATA, b"x"), ".rela.dyn": (RELA, table + b"xx")})


def relocation_images(fx) -> DataFrame:
    return built(fx("orders").select("o_orderkey", "o_custkey"), "o_orderkey", ORDERS, relocation_image)


ORDERED = f"o AS (SELECT CAST(o_orderkey // {ORDERS} AS VARCHAR) AS binary_id, o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_orderkey // {ORDERS} ORDER BY o_orderkey) - 1 AS i FROM orders)"


@query(
    "image_relocations",
    f'WITH {ORDERED} SELECT binary_id, CAST(i AS BIGINT) AS reloc_idx, CAST({DATA} + 24 * o_orderkey AS BIGINT) AS "offset", CAST({RODATA} + 8 * o_custkey AS BIGINT) AS addend FROM o WHERE o_orderkey % 7 <> 3',
)
def _(fx):
    return tables.table(relocation_images(fx), "relocs")


@query(
    "image_sections",
    f"""WITH {ORDERED}, n AS (SELECT binary_id, count(*) AS n FROM o GROUP BY 1)
    SELECT binary_id, CAST(s AS BIGINT) AS section_idx, ['.text', '.rodata', '.rela.dyn', '.shstrtab'][s] AS name, CAST([{TEXT}, {RODATA}, {RELA}, 0][s] AS BIGINT) AS vaddr,
    CAST([n, 1, 24 * n + 2, 35][s] AS BIGINT) AS size FROM n, range(1, 5) t(s)""",
)
def _(fx):
    return tables.table(relocation_images(fx), "sections")


@query(
    "image_diagnostics",
    f"""WITH {ORDERED} SELECT binary_id, 'x86_64' AS arch, true AS is_pie, '' AS warnings FROM (SELECT DISTINCT binary_id FROM o)
    UNION ALL SELECT 'bad' || CAST(n_nationkey AS VARCHAR), 'BadElf: machine ' || CAST(63 + n_nationkey AS VARCHAR) || ' is not x86-64', NULL, NULL FROM nation""",
)
def _(fx):
    """Good images and images of other machines: the latter give errors only."""

    def other(part: pd.DataFrame) -> bytes:
        return im.image({".text": (TEXT, b"\xc3")}, 63 + int(part["n_nationkey"].iloc[0]))

    bad = built(fx("nation").select("n_nationkey"), "n_nationkey", 1, other).select(F.concat(F.lit("bad"), "path").alias("path"), "content")
    files = relocation_images(fx).union(bad)
    good = tables.table(files, "binaries").select("binary_id", "arch", "is_pie", F.array_join("warnings", ";").alias("warnings"))
    errors = tables.table(files, "errors").select("binary_id", c("error").alias("arch"), F.lit(None).cast("boolean").alias("is_pie"), F.lit(None).cast("string").alias("warnings"))
    return good.union(errors)


# ---- functions and symbols ---------------------------------------------------------------------------------------


def function_image(part: pd.DataFrame) -> bytes:
    """The frame sections lie at a fixed distance from the functions, as their offsets of 4 bytes don't reach every key from one place."""
    part = part.sort_values("p_partkey")
    base = ROOM * int(part["p_partkey"].iloc[0])
    frames, header = base + FRAMES, base + HEADER
    ranges = [(TEXT + ROOM * p, TEXT + ROOM * p + 16 * n) for p, n in numbers(part, "p_partkey", "p_size")]
    names = [(f"_ZN3app{len(str(p)) + 1}f{p}17h0123456789abcdefE", n % 3, 1, TEXT + ROOM * p) for p, n in numbers(part, "p_partkey", "p_size")]
    table, strings = im.symbol_sections(names)
    return im.image(
        {
            ".text": (TEXT, b"\xc3"),
            ".rodata": (RODATA, b"x"),
            ".eh_frame": (frames, im.frame_section(frames, ranges)),
            ".eh_frame_hdr": (header, im.frame_header(header, (a for a, _ in ranges))),
            ".symtab": (0, table),
            ".strtab": (0, strings),
        }
    )


def function_images(fx) -> DataFrame:
    return built(fx("part").select("p_partkey", "p_size"), "p_partkey", PARTS, function_image)


PLACED = f"""p AS (SELECT CAST(p_partkey // {PARTS} AS VARCHAR) AS binary_id, p_partkey, p_size, CAST({TEXT} + {ROOM} * p_partkey AS BIGINT) AS fn_start,
    row_number() OVER (PARTITION BY p_partkey // {PARTS} ORDER BY p_partkey) AS i FROM part)"""


@query("image_frames", f"WITH {PLACED} SELECT binary_id, CAST(i - 1 AS BIGINT) AS fde_idx, fn_start, CAST(fn_start + 16 * p_size AS BIGINT) AS fn_end FROM p")
def _(fx):
    return tables.table(function_images(fx), "frames")


@query("image_header_starts", f"WITH {PLACED} SELECT binary_id, fn_start FROM p")
def _(fx):
    return tables.table(function_images(fx), "header_starts")


@query("image_symbols", f"WITH {PLACED} SELECT binary_id, CAST(i AS BIGINT) AS pos, fn_start, ['t', 'T', 'W'][p_size % 3 + 1] AS type, 'app::f' || CAST(p_partkey AS VARCHAR) AS name FROM p")
def _(fx):
    return tables.table(function_images(fx), "symbols")


@query("image_functions", f"WITH {PLACED} SELECT binary_id, fn_start, CAST(fn_start + 16 * p_size AS BIGINT) AS fn_end, 'eh_frame' AS map_source FROM p")
def _(fx):
    return tables.functions(function_images(fx))


def bare_image(part: pd.DataFrame) -> bytes:
    """Without frame descriptions: the search table, call targets and the start of .text give the ranges."""
    starts = [(k, TEXT + 16 * (k % PARTS) + 64) for (k,) in numbers(part.sort_values("p_partkey"), "p_partkey")]
    listed = [s for k, s in starts if k % 2]
    code = b""
    for k, s in starts:
        if k % 4 == 0:
            code += im.call(TEXT + len(code), s + 16 * PARTS)
    text = code.ljust(32 * PARTS + 64, b"\x90")
    return im.image({".text": (TEXT, text), ".rodata": (RODATA, b"x"), ".eh_frame_hdr": (HEADER, im.frame_header(HEADER, listed))})


@query(
    "image_fallback",
    f"""WITH s AS (SELECT p_partkey // {PARTS} AS b, {TEXT} + 16 * (p_partkey % {PARTS}) + 64 AS fn_start FROM part WHERE p_partkey % 2 = 1
    UNION SELECT p_partkey // {PARTS}, {TEXT} + 16 * (p_partkey % {PARTS}) + 64 + 16 * {PARTS} FROM part WHERE p_partkey % 4 = 0 UNION SELECT DISTINCT p_partkey // {PARTS}, {TEXT} FROM part)
    SELECT CAST(b AS VARCHAR) AS binary_id, CAST(fn_start AS BIGINT) AS fn_start, CAST(coalesce(lead(fn_start) OVER (PARTITION BY b ORDER BY fn_start), {TEXT} + 32 * {PARTS} + 64) AS BIGINT) AS fn_end, 'fallback' AS map_source FROM s""",
)
def _(fx):
    return tables.functions(built(fx("part").select("p_partkey"), "p_partkey", PARTS, bare_image))


# ---- code --------------------------------------------------------------------------------------------------------


#: Rows whose code, 12 bytes each and a return, a function has room for.
FIT = (ROOM - 1) // 12


def code_images_of(part: pd.DataFrame) -> list[bytes]:
    """One image, and more where a function has rows for more code than its room."""
    turn = part.groupby("l_partkey").cumcount() // FIT
    return [code_image(rows) for _, rows in part.groupby(turn)]


def code_image(part: pd.DataFrame) -> bytes:
    """Each function loads the address of a location and calls a function of its binary, for every row; line 7 calls into a function's middle."""
    first = int(part["l_partkey"].iloc[0]) // PARTS * PARTS
    text, ranges = bytearray(b"\x90" * (ROOM * PARTS)), []
    for key, rows in part.groupby("l_partkey"):
        start = TEXT + ROOM * (int(key) - first)
        code = b""
        for o, n, s in sorted(numbers(rows, "l_orderkey", "l_linenumber", "l_suppkey")):
            code += im.load_address(start + len(code), DATA + 24 * o + n)
            code += im.call(start + len(code), TEXT + ROOM * ((20 * s + 3 * n + o) % PARTS) + (n == 7))
        code += b"\xc3"
        text[start - TEXT : start - TEXT + len(code)] = code
        ranges.append((start, start + ROOM))
    return im.image({".text": (TEXT, bytes(text)), ".rodata": (RODATA, b"x"), ".eh_frame": (FRAMES, im.frame_section(FRAMES, ranges))})


def code_images(fx) -> DataFrame:
    return built(fx("lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey"), "l_partkey", PARTS, code_images_of)


CODE = f"""l AS (SELECT CAST(l_partkey // {PARTS} AS VARCHAR) AS binary_id, CAST({TEXT} + {ROOM} * (l_partkey % {PARTS}) AS BIGINT) AS fn_start, CAST({DATA} + 24 * l_orderkey + l_linenumber AS BIGINT) AS ea,
    CAST({TEXT} + {ROOM} * ((20 * l_suppkey + 3 * l_linenumber + l_orderkey) % {PARTS}) AS BIGINT) AS callee, l_linenumber FROM lineitem)"""


@query("image_references", f"WITH {CODE} SELECT DISTINCT binary_id, fn_start, ea FROM l")
def _(fx):
    return tables.references(tables.instructions(code_images(fx))).distinct()


@query("image_call_edges", f"WITH {CODE} SELECT DISTINCT binary_id, fn_start AS caller, callee FROM l WHERE l_linenumber <> 7 AND (binary_id, callee) IN (SELECT (binary_id, fn_start) FROM l)")
def _(fx):
    files = code_images(fx)
    return tables.call_edges(tables.instructions(files), tables.functions(files))


@query("image_flat_code", f"WITH {CODE} SELECT binary_id, op, CAST(count(*) AS BIGINT) AS n FROM l, (VALUES ('lea'), ('call')) v(op) GROUP BY 1, 2")
def _(fx):
    return tables.flat_instructions(code_images(fx)).groupBy("binary_id", "op").agg(F.count("*").alias("n"))


# ---- locations and debug info ------------------------------------------------------------------------------------


def location_image(part: pd.DataFrame) -> bytes:
    part = part.sort_values("sid")
    ro, data, relocs = bytearray(b"\0" * SLOT * ORDERS), bytearray(b"\0" * 24 * ORDERS), []
    for (sid, line, col), path in zip(numbers(part, "sid", "line", "col"), part["path"], strict=True):
        i, raw = sid % ORDERS, path.encode()
        ro[SLOT * i : SLOT * i + len(raw)] = raw
        data[24 * i + 8 : 24 * i + 24] = len(raw).to_bytes(8, "little") + line.to_bytes(4, "little") + col.to_bytes(4, "little")
        relocs.append((DATA + 24 * i, 8, RODATA + SLOT * i))
    return im.image({".text": (TEXT, b"\xc3"), ".rodata": (RODATA, bytes(ro)), ".data.rel.ro": (DATA, bytes(data)), ".rela.dyn": (RELA, im.relocation_table(relocs))})


def location_images(fx) -> DataFrame:
    lines = fx("orders").select(c("o_orderkey").alias("sid"), (c("o_custkey") % 700).alias("line"), (c("o_orderkey") % 80).alias("col"))
    return built(fx("fx_paths").join(lines, "sid"), "sid", ORDERS, location_image)


SITED = f"""{sql_with('fx_paths')}, l AS (SELECT CAST(sid // {ORDERS} AS VARCHAR) AS binary_id, CAST({DATA} + 24 * (sid % {ORDERS}) AS BIGINT) AS struct_vaddr, path AS file,
    CAST({RODATA} + {SLOT} * (sid % {ORDERS}) AS BIGINT) AS file_vaddr, CAST(o_custkey % 700 AS BIGINT) AS line, CAST(o_orderkey % 80 AS BIGINT) AS col FROM fx_paths JOIN orders ON o_orderkey = sid)"""


@query("image_locations", f"{SITED} SELECT binary_id, struct_vaddr, file, file_vaddr, line, col, {SITE_KIND} AS kind FROM l WHERE line > 0")
def _(fx):
    return tables.locations(location_images(fx)).drop("origin")


@query("image_source_strings", f"{SITED} SELECT binary_id, file_vaddr AS vaddr, file AS content FROM l")
def _(fx):
    return tables.source_strings(location_images(fx))


def anchor_image(part: pd.DataFrame) -> bytes:
    """Each function loads a path's or a crate's text, the slot of a path, or the byte behind a text's first."""
    part = part.sort_values("p_partkey")
    ro, data, text = bytearray(SLOT * PARTS), bytearray(24 * PARTS), bytearray(b"\x90" * (16 * PARTS))
    relocs, ranges = [], []
    for key, size in numbers(part, "p_partkey", "p_size"):
        i, start = key % PARTS, TEXT + 16 * (key % PARTS)
        raw = [f"src/m{size}.rs", f"app_{size}::run", "core::fmt::x", "/home/u/.cargo/registry/src/idx/dep-c-1.0.0/src/lib.rs", "dep_c::y::z"][key % 5].encode()
        ro[SLOT * i : SLOT * i + len(raw)] = raw
        if raw.endswith(b".rs"):
            relocs.append((DATA + 24 * i, 8, RODATA + SLOT * i))
            data[24 * i + 8 : 24 * i + 24] = len(raw).to_bytes(8, "little") + (size % 2).to_bytes(4, "little") + (1).to_bytes(4, "little")
        code = im.load_address(start, [RODATA + SLOT * i, DATA + 24 * i, RODATA + SLOT * i + 1][size % 3]) + b"\xc3"
        text[16 * i : 16 * i + len(code)] = code
        ranges.append((start, start + 16))
    return im.image(
        {
            ".text": (TEXT, bytes(text)),
            ".rodata": (RODATA, bytes(ro)),
            ".data.rel.ro": (DATA, bytes(data)),
            ".rela.dyn": (RELA, im.relocation_table(relocs)),
            ".eh_frame": (FRAMES, im.frame_section(FRAMES, ranges)),
        }
    )


@query(
    "image_bare_anchors",
    f"""SELECT CAST(p_partkey // {PARTS} AS VARCHAR) AS binary_id, CAST({TEXT} + 16 * (p_partkey % {PARTS}) AS BIGINT) AS fn_start, CASE p_partkey % 5 WHEN 0 THEN 'path' ELSE 'crate' END AS anchor
    FROM part WHERE (p_partkey % 5 = 0 AND (p_size % 3 = 0 OR p_size % 6 = 4)) OR (p_partkey % 5 = 1 AND p_size % 3 = 0)""",
)
def _(fx):
    files = built(fx("part").select("p_partkey", "p_size"), "p_partkey", PARTS, anchor_image)
    return tables.bare_anchors(files, tables.references(tables.instructions(files)), tables.locations(files))


def debug_image(part: pd.DataFrame) -> bytes:
    rows = [(TEXT + 16 * p, i - 1 if i % 3 else None) for i, (p,) in enumerate(numbers(part.sort_values("p_partkey"), "p_partkey"))]
    info, abbrev = im.debug_sections(rows)
    return im.image({".text": (TEXT, b"\xc3"), ".rodata": (RODATA, b"x"), ".debug_info": (0, info), ".debug_abbrev": (0, abbrev)})


@query(
    "image_debug_entries",
    f"""WITH {PLACED}, q AS (SELECT binary_id, i, CAST({TEXT} + 16 * p_partkey AS BIGINT) AS low_pc, CAST(12 + 9 * (i - 1) + 4 * (i - 1 - (i + 1) // 3) AS BIGINT) AS off FROM p)
    SELECT binary_id, CAST(0 AS BIGINT) AS cu, off, low_pc, CAST(NULL AS VARCHAR) AS decl_file, CASE WHEN (i - 1) % 3 <> 0 THEN lag(off) OVER (PARTITION BY binary_id ORDER BY i) END AS ao FROM q""",
)
def _(fx):
    return tables.table(built(fx("part").select("p_partkey"), "p_partkey", PARTS, debug_image), "dies")
