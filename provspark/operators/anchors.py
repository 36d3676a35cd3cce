"""Locations, hits and tiers: which functions hold how many distinct author locations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from provspark.functions.origin import DEP, STD, UNKNOWN, USER
from provspark.operators.joins import asof_within

LOCATION_SIZE = 24


def first_slot_wins(relocs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Of the relocations with one addend the first in file order; before any validation."""
    keys = [*(by or []), "addend"]
    return relocs.groupBy(*keys).agg(F.min_by("offset", "reloc_idx").alias("offset"), F.min("reloc_idx").alias("reloc_idx"))


def rebuild_locations(slots: DataFrame, strings: DataFrame, by: list[str] | None = None) -> DataFrame:
    """slots (by.., offset, addend, stored_len, line, col) that point at a string and hold its length and a sane line."""
    by = by or []
    return sane_locations(slots.join(strings.withColumnRenamed("vaddr", "addend"), [*by, "addend"]), by)


def sane_locations(named: DataFrame, by: list[str] | None = None) -> DataFrame:
    """rebuild_locations() of slots that have the string they point at as content."""
    by = by or []
    valid = (F.col("stored_len") == F.octet_length("content")) & F.col("line").between(1, 200_000)
    return named.where(valid).select(*by, F.col("offset").alias("struct_vaddr"), F.col("content").alias("file"), F.col("addend").alias("file_vaddr"), "line", "col")


def location_hits(refs: DataFrame, locations: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Distinct (by.., fn_start, struct_vaddr, kind) of references (by.., fn_start, ea) into location structs."""
    by = by or []
    starts = locations.select(*by, "struct_vaddr", "kind")
    near = asof_within(refs.select(*by, "fn_start", "ea").distinct(), starts, "ea", "struct_vaddr", LOCATION_SIZE, by)
    return near.select(*by, "fn_start", "struct_vaddr", "kind").distinct()


def certain_and_boundary(hits: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by.., fn_start, is_certain, is_boundary)."""
    return hits.groupBy(*(by or []), "fn_start").agg(F.bool_or(F.col("kind") == USER).alias("is_certain"), F.bool_or(F.col("kind") == DEP).alias("is_boundary"))


def anchor_counts(hits: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by.., fn_start, anchor_count): distinct author locations."""
    return hits.where(F.col("kind") == USER).groupBy(*(by or []), "fn_start").agg(F.count_distinct("struct_vaddr").alias("anchor_count"))


def anchor_files(hits: DataFrame, locations: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by.., fn_start, anchor_count, anchor_files): files sorted and distinct."""
    by = by or []
    named = hits.where(F.col("kind") == USER).join(locations.select(*by, "struct_vaddr", "file"), [*by, "struct_vaddr"])
    return named.groupBy(*by, "fn_start").agg(F.count_distinct("struct_vaddr").alias("anchor_count"), F.sort_array(F.collect_set("file")).alias("anchor_files"))


def tier(count, min_anchors: int = 2):
    return F.when(count >= max(min_anchors, 1), "strong").otherwise("single")


def tier_functions(functions: DataFrame, hits: DataFrame, locations: DataFrame, min_anchors: int = 2, precision: bool = False, by: list[str] | None = None) -> DataFrame:
    """Certain functions with size, tier, anchors and their files; with precision the strong ones only."""
    by = by or []
    out = functions.join(anchor_files(hits, locations, by), [*by, "fn_start"])
    out = out.withColumn("tier", tier(F.col("anchor_count"), min_anchors)).withColumn("size", F.greatest(F.col("fn_end") - F.col("fn_start"), F.lit(0)))
    out = out.where("tier = 'strong'") if precision else out
    return out.select(*by, "fn_start", "fn_end", "size", "tier", "anchor_count", "anchor_files")


def edge_counts(hits: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Distinct locations of each origin for every certain function."""
    counts = [F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in (USER, STD, DEP, UNKNOWN)]
    return hits.groupBy(*(by or []), "fn_start").agg(*counts).where("n_user > 0")


def fallback_ranges(starts: DataFrame, text_end: DataFrame, by: list[str]) -> DataFrame:
    """Function ranges from starts alone: each ends where the next begins, the last at the end of the text."""
    w = W.partitionBy(*by).orderBy("fn_start")
    out = starts.select(*by, "fn_start").distinct().withColumn("__next", F.lead("fn_start").over(w)).join(text_end, by)
    return out.select(*by, "fn_start", F.coalesce("__next", "text_end").alias("fn_end")).where("fn_end > fn_start")


def tally(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows (kind, crate) by origin, and distinct dependency names (not versions)."""
    counts = [F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in (USER, STD, DEP, UNKNOWN)]
    crates = F.count_distinct(F.when(F.col("kind") == DEP, F.col("crate"))).alias("n_dep_crates")
    return rows.groupBy(*(by or [])).agg(*counts, crates)


def detect_roots(paths: DataFrame, by: list[str], stem: str = "stem") -> DataFrame:
    """Root crates of each binary from registry folders (by.., stem, path).

    Exactly one folder with src/main.rs or src/bin/ decides; else exactly one
    name equal to the binary's; else nothing. Folders are counted, so two
    versions of one crate are ambiguous.
    """
    from provspark.functions.origin import crate_name, registry_crate_dir

    main = F.col("path").contains("/src/main.rs") | F.col("path").contains("/src/bin/")
    folders = paths.withColumn("__dir", registry_crate_dir(F.col("path"))).where("__dir is not null")
    folders = folders.groupBy(*by, stem, "__dir").agg(F.bool_or(main).alias("__main")).withColumn("__name", crate_name(F.col("__dir")))
    found = folders.groupBy(*by, stem).agg(
        F.count_if(F.col("__main") & F.col("__name").isNotNull()).alias("__n"),
        F.max(F.when(F.col("__main"), F.col("__name"))).alias("__first"),
        F.bool_or((F.col("__name") == F.col(stem)) & (F.col(stem) != "")).alias("__stem"),
    )
    every = paths.select(*by, stem).distinct().join(found, [*by, stem], "left")
    root = F.when(F.col("__n") == 1, F.col("__first")).when(F.col("__stem"), F.col(stem))
    return every.select(*by, stem, F.when(root.isNotNull(), "detected").otherwise("fallback").alias("outcome"), root.alias("root_crate"))


def install_checks(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by.., assertion, n, verdict) of installed programs, from hits (by.., fn_start, stem, path).

    Without root crates nothing should be certain, with the binary's own crate
    something; detected roots give the third count; the last one is of functions
    that only dependencies' locations mark.
    """
    from provspark.functions.origin import origin

    keys = list(dict.fromkeys([*by, "stem"]))
    plain, rooted = origin(F.col("path"))["kind"], origin(F.col("path"), F.array("stem"))["kind"]
    functions = rows.groupBy(*keys, "fn_start").agg(
        F.bool_or(plain == USER).alias("__plain"), F.bool_or(rooted == USER).alias("__own"), F.bool_or(rooted == DEP).alias("__dep")
    )
    counts = functions.groupBy(*keys).agg(
        F.count_if("__plain").alias("__n_plain"), F.count_if("__own").alias("__n_own"), F.count_if(F.col("__dep") & ~F.col("__own")).alias("__n_dep")
    )
    found = detect_roots(rows.select(*keys, "path").distinct(), [k for k in keys if k != "stem"])
    x = counts.join(found, keys)
    detected = (F.col("outcome") == "detected") & (F.col("root_crate") == F.col("stem"))
    n_plain, n_own, n_dep = F.col("__n_plain"), F.col("__n_own"), F.col("__n_dep")

    def row(name: str, n: Column, verdict: Column) -> Column:
        return F.struct(F.lit(name).alias("assertion"), n.alias("n"), verdict.alias("verdict"))

    checks = F.array(
        row("reproduce", n_plain, F.when(n_plain == 0, "PASS").otherwise("WARN")),
        row("fix", n_own, F.when(n_own > 0, "PASS").otherwise("FAIL")),
        row("auto-detect", F.when(detected, n_own).otherwise(n_plain), F.when(detected, "PASS").otherwise("INFO")),
        row("dep-isolation", n_dep, F.when(n_dep > 0, "PASS").otherwise("WARN")),
    )
    return x.select(*by, F.inline(checks))
