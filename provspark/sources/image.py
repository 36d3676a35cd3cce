"""Small x86-64 ELF images: what the decoders read, written from plain values.

For fixtures: rows become sections, the decoders of this package read them
back, and the rows are what must come out.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable

SYMTAB, DYN = 2, 3


def image(sections: dict[str, tuple[int, bytes]], machine: int = 62) -> bytes:
    """An image with the named sections (address, bytes), numbered from 1, and program headers for none."""
    names = b"\0" + b"".join(n.encode() + b"\0" for n in [*sections, ".shstrtab"])
    body, heads = b"", [b"\0" * 64]
    for n, (addr, data) in [*sections.items(), (".shstrtab", (0, names))]:
        at = names.index(b"\0" + n.encode() + b"\0") + 1
        heads.append(struct.pack("<IIQQQQIIQQ", at, SYMTAB if n == ".symtab" else 1, 2, addr, 64 + len(body), len(data), 0, 0, 1, 0))
        body += data
    numbers = struct.pack("<HHIQQQIHHHHHH", DYN, machine, 1, 0, 0, 64 + len(body), 0, 64, 56, 0, 64, len(heads), len(heads) - 1)
    return b"\x7fELF\2\1\1" + b"\0" * 9 + numbers + body + b"".join(heads)


def relocation_table(rows: Iterable[tuple[int, int, int]]) -> bytes:
    """(offset, type, addend) rows."""
    return b"".join(struct.pack("<QQq", *row) for row in rows)


def frame_section(vaddr: int, ranges: Iterable[tuple[int, int]]) -> bytes:
    """One common record, and a description of each (start, end), relative to its own place in 4 bytes."""
    out = bytearray(struct.pack("<II", 16, 0) + b"\1zR\0\1\x78\x10\1\x1b" + b"\0" * 3)
    for start, end in ranges:
        at = len(out)
        out += struct.pack("<IIiI", 16, at + 4, start - (vaddr + at + 8), end - start) + b"\0" * 4
    return bytes(out)


def frame_header(vaddr: int, starts: Iterable[int]) -> bytes:
    """A search table of starts relative to the section."""
    rows = [struct.pack("<ii", s - vaddr, 0) for s in starts]
    return bytes([1, 0x1B, 0x03, 0x3B]) + struct.pack("<iI", 0, len(rows)) + b"".join(rows)


def symbol_sections(rows: Iterable[tuple[str, int, int, int]]) -> tuple[bytes, bytes]:
    """.symtab and .strtab of (name, binding, number of its section, address) rows; the first entry is empty."""
    table, names = bytearray(24), bytearray(b"\0")
    for name, binding, home, value in rows:
        table += struct.pack("<IBBHQQ", len(names), binding << 4 | 2, 0, home, value, 1)
        names += name.encode() + b"\0"
    return bytes(table), bytes(names)


def load_address(ip: int, target: int) -> bytes:
    """lea rax, [target]"""
    return b"\x48\x8d\x05" + struct.pack("<i", target - (ip + 7))


def call(ip: int, target: int) -> bytes:
    return b"\xe8" + struct.pack("<i", target - (ip + 5))


def debug_sections(rows: Iterable[tuple[int, int | None]]) -> tuple[bytes, bytes]:
    """.debug_info and .debug_abbrev of one unit with function entries (address, number of the entry it stems from)."""
    abbrev = b"\1\x11\1\0\0" + b"\2\x2e\0\x11\1\0\0" + b"\3\x2e\0\x11\1\x31\x13\0\0" + b"\0"
    body, places = bytearray(b"\1"), []
    for low_pc, origin in rows:
        places.append(11 + len(body))
        body += b"\2" + struct.pack("<Q", low_pc) if origin is None else b"\3" + struct.pack("<QI", low_pc, places[origin])
    body += b"\0"
    return struct.pack("<IHIB", 7 + len(body), 4, 0, 8) + bytes(body), abbrev
