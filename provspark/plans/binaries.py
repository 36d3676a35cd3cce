"""Queries over a real shared object, where this environment has one; they have no SQL form.

The driver's tables hold no binaries. These queries decode the native library
of the installed tokenizers package; without it they return no rows.
"""

from __future__ import annotations

import importlib.util
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provspark.sources import tables


def library() -> list[str]:
    spec = importlib.util.find_spec("tokenizers")
    return [f"file://{p}" for p in sorted(Path(spec.origin).parent.glob("[!_]*.so"))[:1]] if spec and spec.origin else []


def files(spark: SparkSession) -> DataFrame:
    found = library()
    return tables.files(spark, found) if found else spark.createDataFrame([], "path string, content binary")


def _decoded(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, _: str) -> DataFrame:
        out = tables.table(files(spark), kind)
        return out.withColumn("binary_id", F.element_at(F.split("binary_id", "/"), -1))

    return run


def elf_functions(spark: SparkSession, _: str) -> DataFrame:
    return tables.functions(files(spark)).drop("binary_id")


def elf_locations(spark: SparkSession, _: str) -> DataFrame:
    return tables.locations(files(spark)).select("struct_vaddr", "file", "line", "col", "kind")


def elf_call_edges(spark: SparkSession, _: str) -> DataFrame:
    f = files(spark)
    return tables.call_edges(tables.instructions(f), tables.functions(f)).drop("binary_id")


def elf_attribution(spark: SparkSession, _: str) -> DataFrame:
    got = tables.analyse(files(spark))
    return got["attributed"].groupBy("attribution").agg(F.count("*").alias("n"))


def elf_types(spark: SparkSession, _: str) -> DataFrame:
    f = files(spark)
    fns, flat = tables.functions(f), tables.flat_instructions(f)
    known = fns.select("binary_id", "fn_start", F.lit("library").alias("attribution"))
    return tables.recover_types(f, flat, fns, known).select("struct_name", F.array_join("fields", "|").alias("fields"), "tier", "fn_start")


QUERIES = {
    "elf_sections": _decoded("sections"),
    "elf_relocations": _decoded("relocs"),
    "elf_frames": _decoded("frames"),
    "elf_symbols": _decoded("symbols"),
    "elf_debug_entries": _decoded("dies"),
    "elf_functions": elf_functions,
    "elf_locations": elf_locations,
    "elf_call_edges": elf_call_edges,
    "elf_attribution": elf_attribution,
    "elf_types": elf_types,
}
