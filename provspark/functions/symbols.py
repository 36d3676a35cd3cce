"""Demangled symbol names: leading crates, classes and false-positive kinds, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Crates that count as standard library, by variant.
STD_BASE = (
    "std alloc core compiler_builtins rustc_std_workspace_alloc rustc_std_workspace_std rustc_std_workspace_core proc_macro unwind panic_unwind panic_abort"
).split()
STD_WIDE = STD_BASE + "gimli object addr2line miniz_oxide hashbrown rustc_demangle".split()
STD_NAMES = STD_WIDE + (
    "test std_detect libc adler adler2 cfg_if getopts unwinding "
    "u8 u16 u32 u64 u128 usize i8 i16 i32 i64 i128 isize f32 f64 bool char str"
).split()
STD_CRATES = {"base": STD_BASE, "wide": STD_WIDE, "names": STD_NAMES}

LEADING = "^<*([a-zA-Z_][a-zA-Z0-9_]*)(::|<| )"
TRAMPOLINE = "__rust_begin_short_backtrace::<(.+)"
THREAD_LOCAL = "::with::<(.+)"


def _or_null(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def leading_crate(symbol: Column) -> Column:
    """First identifier after opening brackets; null without one."""
    return _or_null(F.regexp_extract(symbol, LEADING, 1))


def _unwrapped(symbol: Column, pattern: str) -> Column:
    return F.coalesce(_or_null(F.regexp_extract(symbol, pattern, 1)), symbol)


def leading_crate_inside(symbol: Column) -> Column:
    """As leading_crate, of what a thread or task trampoline wraps."""
    return leading_crate(_unwrapped(symbol, TRAMPOLINE))


def leading_crate_thread_local(symbol: Column) -> Column:
    """As leading_crate_inside, and of what a thread-local accessor wraps."""
    inside = _unwrapped(symbol, TRAMPOLINE)
    return leading_crate(F.when(inside.contains("LocalKey"), _unwrapped(inside, THREAD_LOCAL)).otherwise(inside))


def leading_crate_strict(symbol: Column) -> Column:
    """Snake-case text before the first ``::`` after reference, tuple and dyn marks; two letters at least."""
    bare = F.regexp_replace(F.regexp_replace(symbol, r"^[<&*( \[]+", ""), "^dyn ", "")
    head = F.when(bare.contains("::"), F.substring_index(F.ltrim(bare), "::", 1))
    return F.when(head.rlike("^[a-z_][a-z0-9_]+$"), head)


def normal_crate(name: Column) -> Column:
    return F.replace(name, F.lit("-"), F.lit("_"))


def _in(crate: Column, names: list[str]) -> Column:
    return crate.isin(names)


def class_of_four(crate: Column, is_dep: Column) -> Column:
    """user, std, dep or unknown of a leading crate."""
    return F.when(crate.isNull(), "unknown").when(_in(crate, STD_BASE), "std").when(is_dep, "dep").otherwise("user")


def class_of_three(crate: Column, is_dep: Column, stem: Column | None = None) -> Column:
    """user, nonuser or unk; a crate named like the binary is the author's."""
    own = (crate == F.replace(stem, F.lit("-"), F.lit("_"))) if stem is not None else F.lit(False)
    return F.when(crate.isNull(), "unk").when(own, "user").when(_in(crate, STD_WIDE) | is_dep, "nonuser").otherwise("user")


def is_author_crate(crate: Column, is_dep: Column) -> Column:
    """Whether a symbol's strict leading crate (null: none) is neither the standard library's nor a dependency's."""
    return crate.isNotNull() & ~_in(crate, [*STD_BASE, "test"]) & ~is_dep


# Where a wrongly attributed function was declared, by the first row all of whose parts its path holds
# (a part with a bar: one of its sides).
FP_CATEGORIES = [
    (["/library/core/src/ops/function.rs"], "FnOnce/Fn/FnMut shim (core/ops/function.rs)"),
    (["/library/core/src/slice/"], "core::slice generic"),
    (["/library/core/src/iter/"], "core::iter generic"),
    (["/library/core/"], "core (other)"),
    (["/library/alloc/"], "alloc generic"),
    (["/library/std/", "once|sync"], "Once/OnceLock/sync init shim"),
    (["/library/std/"], "std generic"),
    (["/rustc/|/library/"], "std/core (other)"),
    (["cargo/registry/src/|/rust/deps/"], "dependency crate"),
]
# Kinds of symbols by the first pattern found; the first one is that of futures and of what wraps them.
FP_KINDS = [
    ("future|poll_fn|PollFn|Pin<|Timeout|async|tokio::.*Future|Map.*Fut", "async-wrapper"),
    ("rayon|ParallelIterator|bridge_producer", "parallel"),
    ("core::iter::adapters|core::slice::sort", "iter/slice"),
]


def first_pattern(x: Column, rows: list[tuple[str, str]], otherwise: str) -> Column:
    """Label of the first row (pattern, label) whose pattern x holds."""
    out = F
    for pattern, label in rows:
        out = out.when(x.rlike(pattern), label)
    return out.otherwise(otherwise)


def fp_category(path: Column) -> Column:
    # lookaheads: all parts must be found, in any order
    rows = [("".join(f"(?=.*(?:{part}))" for part in parts).join(["(?s)^", ""]), label) for parts, label in FP_CATEGORIES]
    return first_pattern(path, rows, "other")


def fp_kind(symbol: Column) -> Column:
    return first_pattern(F.coalesce(symbol, F.lit("")), FP_KINDS, "genuine-dep/other")


def provenance_category(label: Column, path: Column) -> Column:
    """tp, unk, or the kind of library code that a false positive is."""
    has = F.coalesce(path, F.lit("")).contains
    return (
        F.when(label == "TP", "tp")
        .when(label == "UNK", "unk")
        .when(has("core/src/ops/function.rs"), "fnonce_shim")
        .when(has("/registry/") | has("/.cargo/"), "dep")
        .when(has("core/src/"), "core_other")
        .otherwise("lib_generic")
    )


# Fixed patterns of the rules below.
CLOSURE = r"\{closure[#{]|\{anon[#{]"
CALL_SHIM = r" as (core|std)::ops::function::Fn(Once|Mut)?[<> ]"
VTABLE = r"\{shim:vtable"
DERIVED = r" as (core|std)::(clone::Clone|fmt::(Debug|Display)|cmp::(PartialEq|Eq|PartialOrd|Ord)|hash::Hash|default::Default)[>< ]"
SERDE = r" as serde::(ser::Serialize|de::(Deserialize|Visitor))"
TRAIT = r" as ([a-zA-Z_][a-zA-Z0-9_]*)(::|<)"


def disputed_class(symbol: Column, source: Column, user_crate: Column) -> Column:
    """A author's code, B derived code, C a dependency's code, D unclear."""
    src = F.coalesce(source, F.lit(""))
    trait = F.regexp_extract(symbol, TRAIT, 1)
    named = ~src.isin("?", "??:0", "??:?", "") & src.contains(":") & ~src.contains("??")
    return (
        F.when(symbol.rlike(f"{CLOSURE}|{CALL_SHIM}|{VTABLE}"), "A")
        .when(symbol.rlike(f"{DERIVED}|{SERDE}"), "B")
        .when(symbol.rlike("^<*[a-zA-Z_][a-zA-Z0-9_]*::") & ~symbol.contains(" as "), "A")
        .when((trait != "") & ~_in(trait, STD_BASE) & (trait != user_crate), "C")
        .when(src.contains(".cargo/registry") | src.contains(".cargo/git"), "C")
        .when(src.contains("/rustc/") | src.contains("/rust/lib/rustlib") | named, "A")
        .otherwise("D")
    )


# Binaries by category; all others are cli.
CATEGORIES = {
    "async": "miniserve dufs mprocs dog rustscan trip oha bandwhich xh gping".split(),
    "parallel": ["fclones"],
    "framework": ["gitui", "btm"],
    "macro": "starship typos taplo dprint".split(),
    "crypto": ["rage", "ouch"],
}


def binary_category(name: Column) -> Column:
    out = F.lit("cli")
    for category, names in CATEGORIES.items():
        out = F.when(name.isin(names), category).otherwise(out)
    return out


def is_camel_case(s: Column) -> Column:
    return s.rlike("^[A-Z][A-Za-z0-9]{2,}$") & s.rlike("[a-z]")


def is_snake_case(s: Column) -> Column:
    """Upper case after the first letter is accepted."""
    return s.rlike("^[a-z][A-Za-z0-9_]+$")


def looks_like_ident(s: Column) -> Column:
    return s.rlike("^[A-Za-z][A-Za-z0-9_]+$") & ~s.rlike("^[A-Z_]+$")


def has_std_prefix(s: Column) -> Column:
    return s.rlike("^(Mutex|Rw|Arc|Rc|Box).+")


def crate_idents(text: Column) -> Column:
    """All identifiers that ``::`` follows and no identifier byte precedes."""
    return F.regexp_extract_all(text, F.lit("(?<![A-Za-z0-9_])([a-z_][a-z0-9_]{1,63})::"), 1)


def leading_crate_at(text: Column) -> Column:
    """The identifier of 2 to 64 bytes that a text begins with if ``::`` follows it; null without one."""
    return _or_null(F.regexp_extract(text, "^([a-z_][a-z0-9_]{1,63})::", 1))


def verdict_against(value: Column, baseline: Column, low_is_better: bool = False) -> Column:
    """CONFIRMS within two points of a baseline, else IMPROVES or SHIFTS; N/A without either."""
    diff = value - baseline
    better = diff < 0 if low_is_better else diff > 0
    return F.when(value.isNull() | baseline.isNull(), "N/A").when(F.abs(diff) < 2.0, "CONFIRMS").when(better, "IMPROVES").otherwise("SHIFTS")


def gain_verdict(gain: Column, precision: Column) -> Column:
    """What a recall gain is worth at a marginal precision (null: unknown)."""
    return F.when(gain < 1.0, "negligible").when(precision.isNull() | (precision >= 30.0), "acceptable").otherwise("low precision")


def wall_seconds(text: Column) -> Column:
    """h:m:s, m:s or s to seconds."""
    parts = F.transform(F.split(text, ":"), lambda x: x.try_cast("double") if hasattr(x, "try_cast") else x.cast("double"))
    return F.aggregate(parts, F.lit(0.0), lambda a, x: a * 60 + x)


def percent(n: Column, total: Column) -> Column:
    """Share in percent, 0 of nothing."""
    return F.coalesce(100.0 * F.try_divide(n, total), F.lit(0.0))


def hex_address(x: Column) -> Column:
    return F.format_string("0x%x", x)
