"""Path and symbol functions on literal cases."""

import pytest
from pyspark.sql import functions as F

from provspark.functions import origin as org
from provspark.functions import symbols as sym

C = F.col


def values(spark, expr, rows):
    df = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], "i int, " + ", ".join(f"x{k} string" for k in range(len(rows[0]) if isinstance(rows[0], tuple) else 1)))
    return [r["v"] for r in df.select("i", expr.alias("v")).orderBy("i").collect()]


def test_split(spark):
    rows = ["anyhow-1.0.75", "aho-corasick-1.1.4", "noversion", "foo-1.0-2x", "-1", "a-b"]
    assert values(spark, org.crate_name(C("x0")), rows) == ["anyhow", "aho-corasick", None, "foo-1.0", "", None]
    assert values(spark, org.crate_version(C("x0")), rows) == ["1.0.75", "1.1.4", None, "2x", "1", None]


@pytest.mark.parametrize(
    ("path", "label"),
    [
        ("src/main.rs", "user"),
        ("src/lib.rs", "user"),
        ("tests/foo.rs", "user"),
        ("examples/demo.rs", "user"),
        ("build.rs", "user"),
        ("/rustc/abc/library/core/src/fmt/mod.rs", "std"),
        ("library/alloc/src/vec/mod.rs", "std"),
        ("src/libcore/num/mod.rs", "std"),
        ("/x/src/libstd/io.rs", "std"),
        ("xsrc/libstd/io.rs", "user"),
        ("/rust/deps/gimli-0.32.3/src/read.rs", "dep:gimli@0.32.3"),
        ("/rust/deps/gimli/src/read.rs", "unknown"),
        ("/cargo/registry/src/idx-1/aho-corasick-1.1.4/src/lib.rs", "dep:aho-corasick@1.1.4"),
        ("/home/user/.cargo/registry/src/idx/tokio-1.28.0/src/lib.rs", "dep:tokio@1.28.0"),
        ("/cargo/registry/src/idx", "unknown"),
        ("crates.io/aes-0.7.5/src/soft.rs", "dep:aes@0.7.5"),
        ("/v/crates.io/aes-0.7.5", "dep:aes@0.7.5"),
        ("/opt/build/x.rs", "unknown"),
        ("", "user"),
    ],
)
def test_origin(spark, path, label):
    assert values(spark, org.origin_label(org.origin(C("x0"))), [path]) == [label]


def test_promotion(spark):
    roots = F.array(F.lit("bat"), F.lit("fd-find"))
    rows = ["/c/cargo/registry/src/i/bat-0.24.0/src/main.rs", "/c/cargo/registry/src/i/fd-find-10.2.0/src/main.rs", "/c/cargo/registry/src/i/aho-corasick-1.1.4/src/lib.rs", "src/main.rs", "library/core/a.rs", None]
    assert values(spark, org.origin(C("x0"), roots)["kind"], rows) == ["user", "user", "dep", "user", "std", None]


def test_debug_paths(spark):
    rows = [("/a/b.rs", "d", "/c"), ("b.rs", "/d/", "/c"), ("b.rs", "d", "/c"), ("b.rs", None, "/c"), ("b.rs", "d", None)]
    assert values(spark, org.debug_path(C("x0"), C("x1"), C("x2")), rows)[1:] == ["/d/b.rs", "/c/d/b.rs", "/c/b.rs", "d/b.rs"]
    assert values(spark, org.origin_for_debug_info(C("x0"))["kind"], ["/opt/x.rs", "library/a.rs"]) == ["user", "std"]


def test_leading_crates(spark):
    rows = ["<<app::T>::m as core::X>::call", "std::sys::backtrace::__rust_begin_short_backtrace::<app::run>", "<std::thread::LocalKey<T>>::with::<tokio::enter>", "&mut dyn app::io::Sink::write", "_start", "dyn a::b", "main "]
    assert values(spark, sym.leading_crate(C("x0")), rows) == ["app", "std", "std", None, None, "dyn", "main"]
    assert values(spark, sym.leading_crate_inside(C("x0")), rows)[:3] == ["app", "app", "std"]
    assert values(spark, sym.leading_crate_thread_local(C("x0")), rows)[2] == "tokio"
    assert values(spark, sym.leading_crate_strict(C("x0")), ["&mut app::x", "&dyn app::x", "[u8::x", "A::b", "a::b"]) == [None, "app", "u8", None, None]


def test_case_tests(spark):
    assert values(spark, sym.is_camel_case(C("x0")), ["Abc", "AB1", "Ab", "A_bc"]) == [True, False, False, False]
    assert values(spark, sym.is_snake_case(C("x0")), ["ab", "aB", "a", "Ab", "_a"]) == [True, True, False, False, False]
    assert values(spark, sym.looks_like_ident(C("x0")), ["ab", "A_B", "aB", "a", "1a"]) == [True, False, True, False, False]
    assert values(spark, sym.crate_idents(C("x0")), ["use aa::bb::Cc x::y::", "Zaa::b_1::c"]) == [["aa", "bb"], ["b_1"]]


def test_verdicts(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 5.0), (9.0, 5.0), (None, 5.0)], "v double, b double")
    assert [r[0] for r in df.select(sym.verdict_against(C("v"), C("b"))).collect()] == ["CONFIRMS", "SHIFTS", "IMPROVES", "N/A"]
    assert values(spark, sym.wall_seconds(C("x0")), ["1:02:03", "2:03.5", "7"]) == [3723.0, 123.5, 7.0]
