"""Debug info: function entries of a file, and resolution of declaring files over tables of entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provspark.sources.elf import Elf, Reader


def resolve_origins(dies: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by.., fn_start, cu, decl_file) of entries (by.., cu, off, low_pc, decl_file, ao).

    An entry's own file counts first, else that of the entry of the same unit
    it is an instance of; of several entries for an address the first unit's.
    """
    by = by or []
    base = dies.where("decl_file IS NOT NULL").select(*by, "cu", F.col("off").alias("ao"), F.col("decl_file").alias("__inherited"))
    full = dies.where("low_pc IS NOT NULL").join(base, [*by, "cu", "ao"], "left").withColumn("__file", F.coalesce("decl_file", "__inherited")).where("__file IS NOT NULL")
    first = full.groupBy(*by, F.col("low_pc").alias("fn_start")).agg(F.min(F.struct("cu", "off", "__file")).alias("r"))
    return first.select(*by, "fn_start", F.col("r.cu").alias("cu"), F.col("r.__file").alias("decl_file"))


# ---- decoding of one file's bytes ---------------------------------------------------------------------------------

SUBPROGRAM, INLINED = 0x2E, (1, 3)
LOW_PC, DECL_FILE, ABSTRACT, STMT_LIST, COMP_DIR, NAME, INLINE, STR_BASE, ADDR_BASE = 0x11, 0x3A, 0x31, 0x10, 0x1B, 0x03, 0x20, 0x72, 0x73


def _abbreviations(data: bytes, at: int, cache: dict) -> dict:
    if at not in cache:
        r, out = Reader(data, at), {}
        while code := r.uleb():
            tag, children, specs = r.uleb(), r.uint(1), []
            while True:
                name, form = r.uleb(), r.uleb()
                const = r.sleb() if form == 0x21 else None
                if not name and not form:
                    break
                specs.append((name, form, const))
            out[code] = (tag, children, specs)
        cache[at] = out
    return cache[at]


class Unit:
    """One unit's header and how its attribute forms are read."""

    def __init__(self, elf: Elf, r: Reader, number: int) -> None:
        self.elf, self.number, self.start = elf, number, r.at
        size = r.uint(4)
        self.wide = 8 if size == 0xFFFFFFFF else 4
        size = r.uint(8) if self.wide == 8 else size
        self.end = r.at + size
        self.version, self.kind = r.uint(2), 1
        if self.version >= 5:
            self.kind, self.address = r.uint(1), r.uint(1)
            self.abbrev = r.uint(self.wide)
            r.take({2: 8 + self.wide, 4: 8, 5: 8, 6: 8 + self.wide}.get(self.kind, 0))
        else:
            self.abbrev, self.address = r.uint(self.wide), r.uint(1)
        self.body = r.at
        self.str_base, self.addr_base = (8 if self.wide == 4 else 16), (8 if self.wide == 4 else 16)

    def _string(self, section: str, at: int) -> str:
        s = self.elf.section(section)
        return Reader(s.data, at).string().decode("utf-8", "replace") if s and at < len(s.data) else ""

    def _indexed(self, section: str, base: int, index: int, size: int) -> int | None:
        s = self.elf.section(section)
        raw = s.data[base + index * size : base + (index + 1) * size] if s else b""
        return int.from_bytes(raw, "little") if len(raw) == size else None

    def value(self, r: Reader, form: int, const: int | None = None):
        """(class, value) of an attribute; classes that nobody asks for are only skipped."""
        w = self.wide
        if form == 0x21:
            return "const", const
        if form == 0x01:
            return "addr", r.uint(self.address)
        if form in (0x0B, 0x05, 0x06, 0x07):
            return "const", r.uint({0x0B: 1, 0x05: 2, 0x06: 4, 0x07: 8}[form])
        if form == 0x0D:
            return "const", r.sleb()
        if form == 0x0F:
            return "const", r.uleb()
        if form in (0x11, 0x12, 0x13, 0x14):
            return "unit", r.uint({0x11: 1, 0x12: 2, 0x13: 4, 0x14: 8}[form])
        if form == 0x15:
            return "unit", r.uleb()
        if form == 0x10:
            return "info", r.uint(self.address if self.version < 3 else w)
        if form == 0x08:
            return "text", r.string().decode("utf-8", "replace")
        if form in (0x0E, 0x1F):
            return "text", self._string(".debug_str" if form == 0x0E else ".debug_line_str", r.uint(w))
        if form in (0x1A, 0x25, 0x26, 0x27, 0x28):
            i = r.uleb() if form == 0x1A else r.uint(form - 0x24)
            at = self._indexed(".debug_str_offsets", self.str_base, i, w)
            return "text", "" if at is None else self._string(".debug_str", at)
        if form in (0x1B, 0x29, 0x2A, 0x2B, 0x2C):
            i = r.uleb() if form == 0x1B else r.uint(form - 0x28)
            return "addr", self._indexed(".debug_addr", self.addr_base, i, self.address)
        if form == 0x17:
            return "offset", r.uint(w)
        if form == 0x19:
            return "flag", 1
        if form == 0x0C:
            return "flag", r.uint(1)
        if form in (0x22, 0x23):
            return "index", r.uleb()
        if form in (0x03, 0x04, 0x0A, 0x09, 0x18):
            n = r.uleb() if form in (0x09, 0x18) else r.uint({0x0A: 1, 0x03: 2, 0x04: 4}[form])
            return "block", r.take(n)
        if form == 0x1E:
            return "block", r.take(16)
        if form in (0x20, 0x1C, 0x1D):
            return "other", r.uint({0x20: 8, 0x1C: 4, 0x1D: w}[form])
        if form == 0x16:
            return self.value(r, r.uleb())
        raise ValueError(f"form {form:#x}")


def _files(unit: Unit, at: int, comp_dir: str) -> dict[int, str]:
    """Full paths of a line program's files by number."""
    s = unit.elf.section(".debug_line")
    if not s or at >= len(s.data):
        return {}
    r = Reader(s.data, at)
    wide = 8 if (size := r.uint(4)) == 0xFFFFFFFF else 4
    size = r.uint(8) if wide == 8 else size
    version = r.uint(2)
    if version >= 5:
        r.take(2)
    r.uint(wide)
    r.take(5 if version >= 4 else 4)
    r.take(max(r.uint(1) - 1, 0))
    reader = Unit.__new__(Unit)
    reader.elf, reader.wide, reader.version, reader.address, reader.str_base, reader.addr_base = unit.elf, wide, version, 8, unit.str_base, unit.addr_base
    folders, files, first = [], [], 1
    if version >= 5:
        first = 0
        for target in (folders, files):
            formats = [(r.uleb(), r.uleb()) for _ in range(r.uint(1))]
            for _ in range(r.uleb()):
                row = {kind: reader.value(r, form)[1] for kind, form in formats}
                target.append((row.get(1, ""), row.get(2, 0)))
        folders = [f for f, _ in folders]
    else:
        folders = [comp_dir]
        while name := r.string():
            folders.append(name.decode("utf-8", "replace"))
        while name := r.string():
            files.append((name.decode("utf-8", "replace"), r.uleb()))
            r.uleb()
            r.uleb()
    out = {}
    for i, (name, folder) in enumerate(files):
        base = folders[folder] if folder < len(folders) else ""
        parts = [name]
        for p in (base, comp_dir):
            if parts[0].startswith("/"):
                break
            if p and not (p == comp_dir and base == comp_dir and len(parts) > 1):
                parts.insert(0, p.rstrip("/"))
        out[i + first] = "/".join(parts)
    return out


def subprograms(elf: Elf) -> list[tuple[int, int, int | None, str | None, int | None]]:
    """(unit, offset, low_pc, declaring path, offset of the abstract entry) of function entries.

    Entries that are inlined only have no address and serve as abstract ones.
    A unit that can't be read ends at the point of the error.
    """
    info, abbrev = elf.section(".debug_info"), elf.section(".debug_abbrev")
    if not info or not abbrev:
        return []
    out, cache, at, number = [], {}, 0, 0
    while at + 12 < len(info.data):
        r = Reader(info.data, at)
        try:
            unit = Unit(elf, r, number)
        except EOFError:
            break
        try:
            _scan_unit(unit, r, _abbreviations(abbrev.data, unit.abbrev, cache), out)
        except (EOFError, ValueError, KeyError, IndexError):
            pass
        at, number = unit.end, number + 1
    return out


def _scan_unit(unit: Unit, r: Reader, abbreviations: dict, out: list) -> None:
    files: dict[int, str] = {}
    comp_dir = ""
    first = True
    while r.at < unit.end:
        offset = r.at
        code = r.uleb()
        if not code:
            continue
        tag, _, specs = abbreviations[code]
        want = first or tag == SUBPROGRAM
        found = {}
        for name, form, const in specs:
            v = unit.value(r, form, const)
            if want:
                found[name] = v
        if first:
            first = False
            if STR_BASE in found:
                unit.str_base = found[STR_BASE][1]
            if ADDR_BASE in found:
                unit.addr_base = found[ADDR_BASE][1]
            comp_dir = found.get(COMP_DIR, ("text", ""))[1] or ""
            if STMT_LIST in found:
                files = _files(unit, found[STMT_LIST][1], comp_dir)
        elif tag == SUBPROGRAM:
            low = found.get(LOW_PC, (None, None))[1]
            if found.get(INLINE, (None, 0))[1] in INLINED or not low or low >= 1 << 63:
                low = None
            where, to = found.get(ABSTRACT, (None, None))
            if where == "unit":
                to += unit.start
            elif where != "info" or not unit.start <= to < unit.end:
                to = None
            path = files.get(found[DECL_FILE][1]) if DECL_FILE in found else None
            out.append((unit.number, offset, low, path, to))
