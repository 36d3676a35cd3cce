"""Operator 4: URL filters on a sorted digest array.

A list of rules and block-list entries is turned into one file: sorted 64-bit
xxHash keys, an entry number per key, and the full strings. Executors get the
file by SparkContext.addFile, map it into memory once per worker (workers of a
host share its pages), probe it with vectorised binary search, and compare the
stored string of every hit, so a collision of digests can never decide.

A rule is a host and a path prefix. It fits its host and all subdomains, if
the path of the URL starts with the rule's; the longest rule decides. A URL
that no rule fits is judged by the block list of hosts (entry ``host``, which
also covers subdomains): a hit blocks, anything else is allowed.

Edge cases: a URL that is null or has no ``://`` has an empty host and path
and fits nothing, so it is allowed with a null rule; repeated rows are judged
each; an empty table or an empty list gives the defined result for no hits;
ports and user names are part of the host as it stands. Columns other than id
and URL are ignored.
"""

from __future__ import annotations

import atexit
import os
import shutil
import struct
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULE, HOST = 0, 1
ASCII_LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


def build_index(rules: list[tuple[str, str, str]], block_hosts: list[str], digest=xxhash.xxh64_intdigest) -> bytes:
    """rules: (verdict, host, path). The bytes: header, keys, offsets, kinds, verdicts, strings."""
    entries = [(f"{h}{p}".encode(), RULE, v == "allow", len(p.encode())) for v, h, p in rules]
    entries += [(h.encode(), HOST, False, 0) for h in block_hosts]
    # the kind is part of what is digested, so a host and a rule never share a key by name
    keys = np.array([digest(bytes([k]) + s) for s, k, _, _ in entries], "<u8")
    order = np.argsort(keys, kind="stable")
    entries = [entries[i] for i in order]
    strings = [s for s, _, _, _ in entries]
    offsets = np.cumsum([0, *map(len, strings)]).astype("<i8")
    path = np.array([p for _, _, _, p in entries], "<i8")
    kinds = bytes(k for _, k, _, _ in entries)
    allow = bytes(int(a) for _, _, a, _ in entries)
    return struct.pack("<q", len(entries)) + keys[order].tobytes() + offsets.tobytes() + path.tobytes() + kinds + allow + b"".join(strings)


class DigestArray:
    """A mapped index file."""

    def __init__(self, path: str, digest=xxhash.xxh64_intdigest) -> None:
        raw = np.memmap(path, np.uint8, "r")
        n = self.n = int(raw[:8].view("<i8")[0])
        at = 8
        self.keys = raw[at : at + 8 * n].view("<u8")
        self.offsets = raw[(at := at + 8 * n) : at + 8 * (n + 1)].view("<i8")
        self.path = raw[(at := at + 8 * (n + 1)) : at + 8 * n].view("<i8")
        self.kinds = raw[(at := at + 8 * n) : at + n]
        self.allow = raw[(at := at + n) : at + n]
        self.strings = raw[at + n :]
        self.digest = digest
        self.path_lengths = np.unique(self.path[self.kinds == RULE]).tolist()

    def probe(self, kind: int, candidates: list[bytes]) -> list[int]:
        """The entry of each candidate, or -1."""
        if not self.n or not candidates:
            return [-1] * len(candidates)
        mark = bytes([kind])
        keys = np.array([self.digest(mark + c) for c in candidates], "<u8")
        at = np.searchsorted(self.keys, keys)
        out = [-1] * len(candidates)
        for i in np.flatnonzero(self.keys[np.minimum(at, self.n - 1)] == keys):
            j = int(at[i])
            while j < self.n and self.keys[j] == keys[i]:  # equal digests stand side by side
                if self.kinds[j] == kind and self.strings[self.offsets[j] : self.offsets[j + 1]].tobytes() == candidates[i]:
                    out[i] = j
                    break
                j += 1
        return out


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    for c in "?#":
        rest = rest.split(c, 1)[0]
    host, slash, path = rest.partition("/")
    return host.translate(ASCII_LOWER), slash + path


def suffixes(host: str) -> list[str]:
    """The host and its parent domains."""
    parts = host.split(".")
    return [".".join(parts[i:]) for i in range(len(parts))] if host else []


def judge(index: DigestArray, urls: list[str | None]) -> list[tuple[str, str, str | None, str]]:
    """(host, path, rule, verdict) of each URL."""
    split = [split_url(u) for u in urls]
    owner, candidates, hosts, of = [], [], [], []
    for i, (host, path) in enumerate(split):
        raw = path.encode()
        for s in suffixes(host):
            hosts.append(s.encode())
            of.append(i)
            for n in index.path_lengths:
                if n <= len(raw):
                    owner.append(i)
                    candidates.append(s.encode() + raw[:n])
    best: dict[int, int] = {}
    for i, c, j in zip(owner, candidates, index.probe(RULE, candidates), strict=True):
        if j >= 0 and (i not in best or len(c) > index.offsets[best[i] + 1] - index.offsets[best[i]]):
            best[i] = j
    listed = {i for i, j in zip(of, index.probe(HOST, hosts), strict=True) if j >= 0}
    out = []
    for i, (host, path) in enumerate(split):
        if (j := best.get(i)) is not None:
            rule = index.strings[index.offsets[j] : index.offsets[j + 1]].tobytes().decode()
            out.append((host, path, rule, "allow" if index.allow[j] else "block"))
        else:
            out.append((host, path, None, "block" if i in listed else "allow"))
    return out


_mapped: dict[str, DigestArray] = {}


def _judge(name: str, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _mapped:
            _mapped[name] = DigestArray(SparkFiles.get(name))
        for b in batches:
            rows = judge(_mapped[name], b.column(1).to_pylist())
            cols = [pa.array([r[k] for r in rows], pa.string()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], schema.names)

    return run


def filter_urls(
    pages: DataFrame,
    rules: list[tuple[str, str, str]],
    block_hosts: list[str],
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """One row per page: (page_id, host, path, rule, verdict)."""
    spark = pages.sparkSession
    name = f"urls-{uuid.uuid4().hex}.idx"
    folder = tempfile.mkdtemp()  # the driver serves the file from here for as long as it lives
    atexit.register(shutil.rmtree, folder, True)
    path = os.path.join(folder, name)
    with open(path, "wb") as f:
        f.write(build_index(rules, block_hosts))
    spark.sparkContext.addFile(path)
    kind = dict(pages.dtypes)[id_col]
    names = ["page_id", "host", "path", "rule", "verdict"]
    schema = pa.schema([pa.field(n, pa.string()) for n in names])
    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).mapInArrow(
        _judge(name, schema), f"page_id {kind}, host string, path string, rule string, verdict string"
    )
