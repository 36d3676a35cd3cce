"""Origin of embedded source paths: author, standard library, dependency or unknown.

All functions take and return Columns; none leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

USER, STD, DEP, UNKNOWN = "user", "std", "dep", "unknown"
ORIGIN_RANK = {USER: 0, STD: 1, DEP: 2, UNKNOWN: 3}

# Folder names of the standard library's layout before 2018.
OLD_STD_LIBS = (
    "libcore",
    "liballoc",
    "libstd",
    "libpanic_abort",
    "libpanic_unwind",
    "libunwind",
    "libbacktrace",
    "libtest",
    "libproc_macro",
    "libcompiler_builtins",
)
OLD_STD_PATTERN = f"(^|/)src/({'|'.join(OLD_STD_LIBS)})/"
REGISTRY_DIR = "cargo/registry/src/[^/]*/([^/]*)"
VENDORED_DIR = r"crates\.io/([^/]*)"
NAME_VERSION = "(?s)^(.*)-([0-9].*)$"


def crate_name(folder: Column) -> Column:
    """Part before the last hyphen that a digit follows; null without one. May be empty."""
    return F.when(folder.rlike("-[0-9]"), F.regexp_extract(folder, NAME_VERSION, 1))


def crate_version(folder: Column) -> Column:
    return F.when(folder.rlike("-[0-9]"), F.regexp_extract(folder, NAME_VERSION, 2))


def registry_crate_dir(path: Column) -> Column:
    """Folder after the index hash in a registry path; null if absent or empty."""
    return F.nullif(F.regexp_extract(path, REGISTRY_DIR, 1), F.lit(""))


def origin(path: Column, root_crates: Column | None = None) -> Column:
    """struct(kind, crate, version) of a path, by the first rule that holds.

    root_crates is an array column; a registry crate that it names is the
    author's own.
    """
    roots = root_crates if root_crates is not None else F.array().cast("array<string>")
    none = F.lit(None).cast("string")

    def of(kind: str, crate: Column = none, version: Column = none) -> Column:
        return F.struct(F.lit(kind).alias("kind"), crate.alias("crate"), version.alias("version"))

    toolchain = F.regexp_extract(path, "^/rust/deps/([^/]*)", 1)
    registry, vendored = F.regexp_extract(path, REGISTRY_DIR, 1), F.regexp_extract(path, VENDORED_DIR, 1)

    def crate_rule(folder: Column) -> Column:
        return F.when(F.array_contains(roots, crate_name(folder)), of(USER)).otherwise(of(DEP, crate_name(folder), crate_version(folder)))

    return (
        F.when(path.startswith("/rustc/") | path.startswith("library/") | path.rlike(OLD_STD_PATTERN), of(STD))
        .when(path.startswith("/rust/deps/") & crate_name(toolchain).isNotNull(), of(DEP, crate_name(toolchain), crate_version(toolchain)))
        .when(crate_name(registry).isNotNull(), crate_rule(registry))
        .when(crate_name(vendored).isNotNull(), crate_rule(vendored))
        .when(~path.startswith("/"), of(USER))
        .when(path.isNotNull(), of(UNKNOWN))
    )


def origin_for_debug_info(path: Column, root_crates: Column | None = None) -> Column:
    """As origin, but an unknown path is the author's: debug info has absolute build folders."""
    o = origin(path, root_crates)
    none = F.lit(None).cast("string")
    return F.when(o["kind"] == UNKNOWN, F.struct(F.lit(USER).alias("kind"), none.alias("crate"), none.alias("version"))).otherwise(o)


def origin_label(o: Column) -> Column:
    """user, std, unknown, dep:name or dep:name@version."""
    version = F.when(F.coalesce(o["version"], F.lit("")) != "", F.concat(F.lit("@"), o["version"])).otherwise(F.lit(""))
    return F.when(o["kind"] == DEP, F.concat(F.lit("dep:"), o["crate"], version)).otherwise(o["kind"])


def origin_rank(kind: Column) -> Column:
    out = F.lit(ORIGIN_RANK[UNKNOWN])
    for name, rank in ORIGIN_RANK.items():
        out = F.when(kind == name, F.lit(rank)).otherwise(out)
    return out


def debug_path(file: Column, directory: Column, comp_dir: Column) -> Column:
    """Full path of a debug-info file entry: absolute as it is, else under its folder, else under the unit's."""

    def under(base: Column, name: Column) -> Column:
        return F.concat(F.rtrim(base, F.lit("/")), F.lit("/"), name)

    inside = F.when(F.coalesce(directory, F.lit("")) == "", file).otherwise(under(directory, file))
    return F.when(inside.startswith("/") | (F.coalesce(comp_dir, F.lit("")) == ""), inside).otherwise(under(comp_dir, inside))
