"""Decoders against binutils on the shared objects of installed packages, and on hand-made bytes."""

import re
import shutil
import struct
import subprocess
import sysconfig
from pathlib import Path

import pytest

from provspark.sources import dwarf, elf, reports, tables, text, x86
from provspark.sources.demangle import demangle
from provspark.sources.sinks import contract_json, markdown

SITE = Path(sysconfig.get_paths()["purelib"])
SMALL = next(iter(SITE.glob("hypothesis/_native*.so")), None)
MEDIUM = next(iter(SITE.glob("tiktoken/_tiktoken*.so")), None)
needs = pytest.mark.skipif(SMALL is None or shutil.which("objdump") is None, reason="no shared object or binutils")


def run(*a):
    return subprocess.run(a, capture_output=True, text=True, check=True).stdout


@needs
def test_relocations_and_frames():
    e = elf.load(SMALL.read_bytes())
    assert len(elf.relocations(e)) == run("readelf", "-rW", SMALL).count("R_X86_64_RELATIVE")
    pc = {(int(a, 16), int(b, 16)) for a, b in re.findall(r"FDE .*pc=([0-9a-f]+)\.\.([0-9a-f]+)", run("readelf", "-W", "--debug-dump=frames", SMALL))}
    assert pc == {(a, b) for _, a, b in elf.frame_ranges(e)}
    assert set(elf.header_starts(e)) == {a for a, _ in pc}


@needs
def test_instruction_lengths():
    s = elf.load(SMALL.read_bytes()).section(".text")
    out = run("objdump", "-d", "-j", ".text", "--no-show-raw-insn", "-w", SMALL)
    assert [a + s.vaddr for a, _ in x86.lengths(s.data)] == [int(x, 16) for x in re.findall(r"^\s*([0-9a-f]+):\t", out, re.M)]
    calls = {(int(a, 16), int(b, 16)) for a, b in re.findall(r"^\s*([0-9a-f]+):\tcall\s+([0-9a-f]+)", out, re.M)}
    assert calls == {(r[0], r[3]) for r in x86.decode(s.data, s.vaddr) if r[2] == "call"}


@needs
def test_symbols():
    e = elf.load(SMALL.read_bytes())
    listed = {int(x.split()[0], 16) for x in run("nm", SMALL).splitlines() if re.match(r"^[0-9a-f]{16} ", x)}
    assert {a for _, a, t, _ in elf.symbols(e) if t not in "uw" or a} >= listed - {0}


@needs
def test_debug_info():
    e = elf.load(SMALL.read_bytes())
    rows = dwarf.subprograms(e)
    starts = {s for _, s, _ in elf.frame_ranges(e)}
    found = {low for _, _, low, path, _ in rows if low and path}
    assert len(found) > 100 and found <= {int(x, 16) for x in re.findall(r"DW_AT_low_pc\s*:\s*(0x[0-9a-f]+)", run("readelf", "--debug-dump=info", SMALL))}
    assert len(found & starts) > 0.9 * len(found)
    assert all(p is None or p.startswith("/") for _, _, _, p, _ in rows)


@pytest.mark.parametrize(
    ("code", "want"),
    [
        (b"\xe8\x01\0\0\0\x90", [(0, 5, "call", 6, None)]),
        (b"\x48\x8d\x05\x10\0\0\0", [(0, 7, "lea", 23, None)]),
        (b"\xc7\x05\x10\0\0\0\x01\0\0\0", [(0, 10, "ref", 26, None)]),
        (b"\xb8\x07\0\0\0", [(0, 5, "mov", None, 7)]),
        (b"\x48\xc7\xc0\xff\xff\xff\xff", [(0, 7, "mov", None, -1)]),
        (b"\x66\xb8\x07\0\x90", [(0, 4, "mov", None, 7)]),
        (b"\xe8\x01", []),
        (b"\x06\xb0\x05", [(1, 2, "mov", None, 5)]),
    ],
)
def test_decode_cases(code, want):
    assert list(x86.decode(code, 0)) == want


def image(sections, machine=62):
    """A small ELF with named sections at their addresses."""
    names = b"\0" + b"".join(n.encode() + b"\0" for n in [*sections, ".shstrtab"])
    body, heads = b"", [b"\0" * 64]
    every = [*((n, a, d) for n, (a, d) in sections.items()), (".shstrtab", 0, names)]
    for n, addr, data in every:
        heads.append(struct.pack("<IIQQQQIIQQ", names.index(b"\0" + n.encode() + b"\0") + 1, 1, 2, addr, 64 + len(body), len(data), 0, 0, 1, 0))
        body += data
    head = b"\x7fELF\2\1\1" + b"\0" * 9 + struct.pack("<HHIQQQIHHHHHH", 3, machine, 1, 0, 0, 64 + len(body), 0, 64, 56, 0, 64, len(heads), len(heads) - 1)
    return head + body + b"".join(heads)


def rela(*rows):
    return b"".join(struct.pack("<QQq", o, t, a) for o, t, a in rows)


def program():
    """One function at 0x1000 that loads a location in src/main.rs and calls 0x1040."""
    lea = b"\x48\x8d\x05" + struct.pack("<i", 0x3000 - 0x1007)
    call = b"\xe8" + struct.pack("<i", 0x1040 - 0x100C)
    text_ = (lea + call + b"\xc3").ljust(0x40, b"\x90") + b"\xc3"
    ro = b"src/main.rs"
    cie = struct.pack("<II", 16, 0) + b"\1zR\0\1\x78\x10\1\x1b" + b"\0" * 3
    fde = b"".join(struct.pack("<IIiI", 16, 20 + 4 + 20 * i, start - (0x4000 + 20 + 20 * i + 8), n) + b"\0" * 4 for i, (start, n) in enumerate([(0x1000, 0x40), (0x1040, 1)]))
    return image(
        {
            ".text": (0x1000, text_),
            ".rodata": (0x2000, ro),
            ".data.rel.ro": (0x3000, struct.pack("<QQII", 0, len(ro), 12, 5)),
            ".rela.dyn": (0x3800, rela((0x3000, 8, 0x2000), (0x3008, 8, -5), (0x3010, 7, 3)) + b"xx"),
            ".eh_frame": (0x4000, cie + fde),
        }
    )


def test_hand_made_image():
    e = elf.load(program())
    assert elf.relocations(e) == [(0, 0x3000, 0x2000)]
    assert [(a, b) for _, a, b in elf.frame_ranges(e)] == [(0x1000, 0x1040), (0x1040, 0x1041)]
    assert e.section(".text").has(0x1000) and not e.section(".text").has(0x1041)
    assert e.section(".rodata").at(0x2000, 99) is None
    for bad in (b"", b"MZ" * 50, b"\x7fELF" + b"\0" * 70, image({}, 40)):
        with pytest.raises(elf.BadElf):
            elf.load(bad)
    assert elf.load(image({".text": (1, b"\xc3"), ".rodata": (9, b"x")})).warnings == ["no .rela.dyn section"]


def test_standard_run(spark, tmp_path):
    for name, data in (("a.bin", program()), ("b.bin", program()), ("bad.bin", b"no"), ("bare.bin", image({".text": (0x1000, b"\xe8\x02\0\0\0\xc3\x90\xc3"), ".rodata": (0x2000, b"x")}))):
        (tmp_path / name).write_bytes(data)
    files = tables.files(spark, str(tmp_path))
    got = tables.analyse(files, min_anchors=1)
    name = lambda r: r["binary_id"].rsplit("/", 1)[-1]
    assert {(name(r), r["fn_start"], r["fn_end"], r["map_source"]) for r in got["functions"].collect()} == {
        *((n, s, e, "eh_frame") for n in ("a.bin", "b.bin") for s, e in ((0x1000, 0x1040), (0x1040, 0x1041))),
        ("bare.bin", 0x1000, 0x1007, "fallback"),
        ("bare.bin", 0x1007, 0x1008, "fallback"),
    }
    assert {(name(r), r["fn_start"], r["tier"], r["anchor_files"][0]) for r in got["tiers"].collect()} == {(n, 0x1000, "strong", "src/main.rs") for n in ("a.bin", "b.bin")}
    kinds = {(name(r), r["fn_start"]): r["attribution"] for r in got["attributed"].collect()}
    assert kinds["a.bin", 0x1000] == "certain" and kinds["a.bin", 0x1040] == "inferred" and kinds["bare.bin", 0x1000] == "library"
    assert [name(r) for r in tables.table(files, "errors").collect()] == ["bad.bin"]
    docs = contract_json(tables.table(files, "binaries").withColumnRenamed("warnings", "w").selectExpr("binary_id", "binary_id AS path", "arch"), got["tiers"]).collect()
    assert '"start":"0x1000"' in next(r["json"] for r in docs if name(r) == "a.bin")
    one = {k: v.where("binary_id LIKE '%a.bin'") for k, v in got.items()}
    assert "src/main.rs: 12:5" in reports.sites_report(one["locations"])
    assert "0x1000 (64 bytes, 1 anchors): src/main.rs" in reports.functions_report(one["attributed"], one["tiers"])
    known = one["functions"].selectExpr("binary_id", "fn_start", "'user' AS kind")
    assert "captured 2 (100.0%)" in reports.validation_report(one["attributed"], known)
    assert markdown(got["calls"].select("caller", "callee").distinct()).count("\n") == 2


@needs
def test_real_binary(spark, tmp_path):
    shutil.copy(MEDIUM or SMALL, tmp_path / "lib.so")  # Spark takes names that begin with _ as hidden
    files = tables.files(spark, str(tmp_path))
    got = tables.analyse(files)
    assert got["functions"].count() > 500
    locs = got["locations"]
    assert locs.count() > 50 and locs.where("line < 1 OR line > 200000 OR file NOT LIKE '%.rs'").count() == 0
    assert {"std", "dep"} <= {r["kind"] for r in locs.select("kind").distinct().collect()}
    assert got["calls"].count() > 500


def test_text_sources(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"crate":"a","n":1}\n\nnot json\n{"crate":"a","n":2}\n{"crate":"b","n":3}\n')
    rows = text.parse_json_lines(text.read_lines(spark, str(tmp_path / "r.jsonl")), "crate STRING, n LONG")
    assert {(r["crate"], r["n"]) for r in text.last_by_key(rows, ["crate"], "pos").collect()} == {("a", 2), ("b", 3)}
    lines = spark.createDataFrame([("# c",), ("bat",), ("fd-find:fd",), ("x:https://h/x:y",), ("",)], "line string")
    assert {tuple(r) for r in text.read_corpus_list(lines).collect()} == {("bat", None, "bat"), ("fd-find", None, "fd"), ("x", "https://h/x", "y")}
    dumps = spark.createDataFrame([("ATTRDUMP\t0x10\tcertain\tTP",), ("ALLFNS\t0x20",), ("x",)], "line string")
    assert [tuple(r) for r in text.read_attribution_dump(dumps).collect()] == [(16, "certain", "TP")]
    assert [r[0] for r in text.read_address_dump(dumps).collect()] == [32]
    built = spark.createDataFrame([("f", "STATUS=ok"), ("f", "PROFILE=release"), ("g", "STATUS=failed")], "file string, line string")
    assert {tuple(r) for r in text.read_build_results(built).collect()} == {("f", "ok", "release"), ("g", "failed", None)}
    report = spark.createDataFrame([("f", "  Certain precision: 91.5%"), ("f", "nothing here")], "file string, line string")
    assert [tuple(r) for r in text.report_figures(report).collect()] == [("f", "certain precision", 91.5)]


def test_landing_stream(spark, tmp_path):
    from provspark.streaming.landing import process_landing

    land, out, state = (str(tmp_path / x) for x in ("land", "out", "state"))
    Path(land).mkdir()

    def go():
        process_landing(spark, land, state, lambda f: tables.table(f, "frames"), out)
        return spark.read.parquet(out).count()

    (Path(land) / "a").write_bytes(program())
    assert go() == 2
    (Path(land) / "copy").write_bytes(program())
    (Path(land) / "c").write_bytes(image({".text": (0x1000, b"\xc3"), ".rodata": (1, b"x")}))
    assert go() == 2


def test_demangle():
    assert demangle("_ZN4core3fmt9Formatter3new17h0123456789abcdefE") == "core::fmt::Formatter::new"
    part = "_$LT$app..T$u20$as$u20$core..fmt..Debug$GT$"
    assert demangle(f"_ZN{len(part)}{part}3fmt17h0123456789abcdefE") == "<app::T as core::fmt::Debug>::fmt"
    assert demangle("main") == "main"
    assert demangle("_RNvC6_123foo3bar") == "123foo::bar"
    assert demangle("_Rx") == "_Rx"


@needs
@pytest.mark.parametrize("path", [SMALL, MEDIUM])
def test_demangle_against_nm(path):
    """Names agree but for the printing of hashes, generics and constants."""
    plain = dict(re.findall(r"^([0-9a-f]{16} \S) (_R\S+)$", run("nm", path), re.M))
    shown = dict(re.findall(r"^([0-9a-f]{16} \S) (.+)$", run("nm", "-C", path), re.M))
    same = [re.sub(r"\[[0-9a-f]+\]", "", shown[k]) == demangle(v) for k, v in plain.items() if shown.get(k) != v]
    assert not same or sum(same) > 0.9 * len(same)


def test_recovered_types(spark, tmp_path):
    names = b"Config::xx\0Settings\0field_one\0ABC\0rt::core::"
    ro = 0x2000
    at = {n: ro + names.index(n) for n in (b"Settings", b"field_one", b"ABC")}
    code, ip = b"", 0x1000
    for n in (b"Settings", b"field_one", b"ABC"):
        code += b"\x48\x8d\x05" + struct.pack("<i", at[n] - (ip + len(code) + 7))
    for n in (8, 9, 3, 5):
        code += b"\xb8" + struct.pack("<I", n)
    slot = struct.pack("<QQ", 0, 6)
    code += b"\x48\x8b\x05" + struct.pack("<i", 0x3000 - (ip + len(code) + 7)) + b"\xc3"
    (tmp_path / "t").write_bytes(image({".text": (ip, code), ".rodata": (ro, names), ".data.rel.ro": (0x3000, slot + b"\0" * 8), ".rela.dyn": (0x3800, rela((0x3000, 8, ro)))}))
    files = tables.files(spark, str(tmp_path))
    fns = spark.createDataFrame([(r["path"], ip, ip + len(code)) for r in files.select("path").collect()], "binary_id string, fn_start long, fn_end long")
    known = fns.selectExpr("binary_id", "fn_start", "'certain' AS attribution")
    got = tables.recover_types(files, tables.flat_instructions(files), fns, known).collect()
    assert [(r["struct_name"], r["fields"], r["tier"]) for r in got] == [("Config", ["field_one"], "user")]
    assert {r["crate"] for r in tables.swept_crates(files).collect()} == {"rt", "core"}


def test_damaged_files_give_errors_only(spark, tmp_path):
    """Cut and changed images never end a run: a file gives rows or an error."""
    import random

    rng = random.Random(3)
    good = program()
    (tmp_path / "good.bin").write_bytes(good)
    (tmp_path / "cut_heads.bin").write_bytes(good[:58] + struct.pack("<H", 8) + good[60:])
    packed = bytearray(image({".text": (1, b"\xc3"), ".rodata": (9, b"\1\0\0\0" + b"\0" * 40)}))
    at = len(packed) - 2 * 64 + 8  # flags of .rodata
    packed[at : at + 8] = struct.pack("<Q", 0x800)
    (tmp_path / "packed.bin").write_bytes(packed)
    for i in range(40):
        raw = bytearray(good[: rng.randint(64, len(good))] if i % 2 else good)
        for _ in range(rng.randint(1, 30)):
            raw[rng.randrange(16, len(raw))] = rng.randrange(256)
        (tmp_path / f"x{i}.bin").write_bytes(raw)
    files = tables.files(spark, str(tmp_path))
    name = lambda r: r["binary_id"].rsplit("/", 1)[-1]
    errors = {name(r) for r in tables.table(files, "errors").collect()}
    assert {"cut_heads.bin", "packed.bin"} <= errors and "good.bin" not in errors
    assert {name(r) for r in tables.table(files, "binaries").collect()} | errors == {p.name for p in tmp_path.iterdir()}
    for kind in tables.SCHEMAS:
        assert tables.table(files, kind).count() >= 0
    assert {name(r) for r in tables.flat_instructions(files).collect()} >= {"good.bin"}
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000"


def test_demangle_lengths_beyond_the_name():
    from provspark.sources.demangle import demangle

    assert demangle("_ZN99999999999999999999aE") == "_ZN99999999999999999999aE"
    assert demangle("_ZN3app9aE") == "_ZN3app9aE"
