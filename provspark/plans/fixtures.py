"""Views of the driver's tables in the shapes that the operators take, for both engines.

Each view is a select text that runs in Spark and in DuckDB; {str} is the name
of the string type. Views refer to tables and to views above them. Every row of
a table is taken: misses come from addresses that hit nothing.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, str] = {
    # gaps and overlaps: range joins and as-of joins differ
    "fx_functions": "SELECT CAST(4096 + p_partkey * 256 AS BIGINT) AS fn_start, CAST(4096 + p_partkey * 256 + 16 * p_size AS BIGINT) AS fn_end FROM part",
    "fx_paths": """SELECT CAST(o_orderkey AS BIGINT) AS sid, CASE o_orderkey % 8
        WHEN 0 THEN concat('src/m', CAST(o_custkey % 40 AS {str}), '.rs')
        WHEN 1 THEN '/rustc/9ec5d5f32e19/library/core/src/fmt/mod.rs'
        WHEN 2 THEN concat('/home/u/.cargo/registry/src/index.crates.io-1949/dep-c', CAST(o_custkey % 25 AS {str}), '-1.', CAST(o_custkey % 7 AS {str}), '.0/src/lib.rs')
        WHEN 3 THEN concat('crates.io/aes-0.', CAST(o_custkey % 9 AS {str}), '.5/src/soft.rs')
        WHEN 4 THEN 'src/libcore/num/mod.rs'
        WHEN 5 THEN concat('/rust/deps/gimli-0.32.', CAST(o_custkey % 4 AS {str}), '/src/read.rs')
        WHEN 6 THEN '/opt/build/x.rs'
        ELSE concat('crates/core/m', CAST(o_custkey % 30 AS {str}), '.rs') END AS path FROM orders""",
    "fx_sites": """SELECT CAST(1000000 + o_orderkey * 24 + CASE o_orderkey % 10 WHEN 9 THEN 1000000000 ELSE 0 END AS BIGINT) AS struct_vaddr, CASE o_orderkey % 31 WHEN 0 THEN p.path ELSE '/rustc/9ec5d5f32e19/library/alloc/src/raw_vec.rs' END AS file, CAST(1 + o_custkey % 500 AS BIGINT) AS line,
        CAST(1 + o_orderkey % 80 AS BIGINT) AS col FROM orders JOIN fx_paths p ON p.sid = o_orderkey""",
    "fx_refs": "SELECT CAST(4096 + l_partkey * 256 AS BIGINT) AS fn_start, CAST(1000000 + l_orderkey * 24 + (l_linenumber - 1) * 5 AS BIGINT) AS ea FROM lineitem",
    "fx_calls": """SELECT DISTINCT CAST(4096 + l_partkey * 256 AS BIGINT) AS caller,
        CAST(4096 + ((l_suppkey * 20 + l_linenumber * 3 + l_orderkey) % (SELECT count(*) FROM part)) * 256 AS BIGINT) AS callee FROM lineitem""",
    "fx_truth": """SELECT CAST(4096 + p_partkey * 256 + CASE p_partkey % 5 WHEN 4 THEN 1 ELSE 0 END AS BIGINT) AS fn_start, CASE p_partkey % 3 WHEN 0 THEN 'user' WHEN 1 THEN 'std' ELSE 'dep' END AS kind,
        CASE p_partkey % 3 WHEN 0 THEN concat('/build/src/m', CAST(p_size % 9 AS {str}), '.rs') WHEN 1 THEN CASE p_size % 6
            WHEN 0 THEN '/rustc/ab/library/core/src/ops/function.rs' WHEN 1 THEN '/rustc/ab/library/core/src/slice/sort.rs' WHEN 2 THEN '/rustc/ab/library/core/src/iter/map.rs'
            WHEN 3 THEN '/rustc/ab/library/alloc/src/vec.rs' WHEN 4 THEN '/rustc/ab/library/std/src/sync/once.rs' ELSE '/rustc/ab/library/std/src/io.rs' END
        ELSE CASE p_size % 3 WHEN 0 THEN '/home/u/.cargo/registry/src/idx/serde-1.0.1/src/lib.rs' WHEN 1 THEN '/rust/deps/hashbrown-0.14.0/src/map.rs' ELSE '/rustc/ab/library/core/src/num.rs' END END AS path
        FROM part""",
    "fx_symbols": """SELECT CAST(4096 + p_partkey * 256 AS BIGINT) AS fn_start, concat('app-', CAST(p_partkey % 4 AS {str})) AS stem, CASE p_partkey % 12
        WHEN 0 THEN 'core::ptr::drop_in_place<alloc::string::String>' WHEN 1 THEN '<app_1::cli::Args as core::fmt::Debug>::fmt'
        WHEN 2 THEN 'std::sys::backtrace::__rust_begin_short_backtrace::<app_2::worker::run, ()>' WHEN 3 THEN '<std::thread::LocalKey<T>>::with::<tokio::runtime::context::enter>'
        WHEN 4 THEN concat('serde_json::de::from_str', CAST(p_size AS {str})) WHEN 5 THEN '&mut [dyn app_1::io::Sink::write' WHEN 6 THEN '_start'
        WHEN 7 THEN concat('crate_', CAST(p_size % 6 AS {str}), '::main::{{closure#0}}') WHEN 8 THEN '<<app_0::Pool<T> as rayon::iter::ParallelIterator>::drive>::run'
        WHEN 9 THEN '<app_1::Job as core::ops::function::FnOnce<()>>::call_once' WHEN 10 THEN '<app_2::Cfg as serde::de::Deserialize>::deserialize'
        ELSE 'core::iter::adapters::map::map_fold' END AS symbol FROM part""",
    "fx_deps": "SELECT DISTINCT CASE p_size % 3 WHEN 0 THEN 'serde-json' WHEN 1 THEN 'tokio' ELSE 'rayon' END AS crate FROM part",
    "fx_instr": """SELECT CAST(4096 + o_orderkey * 16 AS BIGINT) AS ip, CASE o_orderkey % 5 WHEN 3 THEN 'mov' WHEN 4 THEN 'call' ELSE 'lea' END AS op,
        CAST(o_custkey % 120 AS BIGINT) AS imm, CAST(2000000 + o_custkey * 16 AS BIGINT) AS target FROM orders""",
    "fx_idents": """SELECT CAST(2000000 + p_partkey * 16 AS BIGINT) AS target, CASE p_partkey % 5 WHEN 0 THEN concat('MyType', CAST(p_partkey AS {str}))
        WHEN 1 THEN concat('field_', CAST(p_partkey AS {str})) WHEN 2 THEN 'MutexGuard' WHEN 3 THEN 'PathBuf' ELSE concat('CONST_', CAST(p_partkey AS {str})) END AS ident FROM part""",
    "fx_bench": """SELECT concat('c', CAST(c_custkey % 60 AS {str})) AS crate, CAST(c_custkey AS BIGINT) AS pos, CASE WHEN c_custkey % 60 IN (7, 13) OR c_custkey % 11 = 3 THEN 'build' WHEN c_custkey % 11 = 7 THEN 'timeout' END AS error,
        CAST(598 + (c_custkey * 7919) % 27541 AS BIGINT) AS n_fdes, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE CAST((c_custkey * 37) % 200 AS DOUBLE) / 2 END AS sym_prec,
        CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE CAST((c_custkey * 53) % 201 AS DOUBLE) / 2 END AS dwarf_prec, CAST((c_custkey * 13) % 97 AS DOUBLE) / 2 AS recall,
        CAST((c_custkey * 17) % 41 AS BIGINT) AS n_certain, CAST((c_custkey * 5) % 23 AS BIGINT) AS inf_tp, CAST(23 + (c_custkey * 3) % 71 AS BIGINT) AS inf_n,
        CAST((c_custkey * 11) % 613 AS DOUBLE) / 4 AS wall_sec, CAST(1000000 + c_custkey * 4096 AS BIGINT) AS bin_size FROM customer""",
    "fx_relocs": """SELECT CAST(row_number() OVER (ORDER BY o_orderkey) AS BIGINT) AS reloc_idx, CAST(1000000 + o_orderkey * 24 AS BIGINT) AS addr, CAST(5000000 + o_custkey * 64 AS BIGINT) AS addend,
        CAST(CASE o_orderkey % 6 WHEN 0 THEN 3 ELSE 9 END AS BIGINT) AS stored_len, CAST(CASE o_orderkey % 9 WHEN 0 THEN 0 WHEN 1 THEN 200001 ELSE o_orderkey % 700 + 1 END AS BIGINT) AS line, CAST(o_orderkey % 80 AS BIGINT) AS col FROM orders""",
    "fx_strings": "SELECT CAST(5000000 + c_custkey * 64 + CASE c_custkey % 6 WHEN 5 THEN 8 ELSE 0 END AS BIGINT) AS vaddr, concat('src/', CAST(10 + c_custkey % 90 AS {str}), '.rs') AS content FROM customer",
    "fx_dies": """SELECT CAST(o_custkey % 50 AS BIGINT) AS cu, CAST(o_orderkey AS BIGINT) AS off, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(4096 + (o_orderkey % 400) * 256 AS BIGINT) END AS low_pc,
        CASE WHEN o_orderkey % 4 = 1 THEN NULL ELSE CAST(1 + o_orderkey % 5 AS BIGINT) END AS decl_file, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderkey - o_orderkey % 3 AS BIGINT) END AS ao FROM orders""",
    "fx_dumplines": """SELECT CAST(p_partkey AS BIGINT) AS pos, CASE p_partkey % 4 WHEN 0 THEN concat('TIERDUMP', chr(9), '0x', lower(hex(4096 + p_partkey * 256)), chr(9), CASE WHEN p_size > 25 THEN 'strong' ELSE 'single' END, chr(9), CAST(p_size AS {str}))
        WHEN 1 THEN concat('DEPCRATE', chr(9), 'dep-', CAST(p_size AS {str})) WHEN 2 THEN concat('EDGEDUMP', chr(9), '0x', lower(hex(4096 + p_partkey * 256)), chr(9), 'user=', CAST(p_size % 7 AS {str}), chr(9), 'std=', CAST(p_size % 5 AS {str}))
        ELSE 'some other line' END AS line FROM part""",
}


def sql_with(*names: str) -> str:
    """A WITH clause for DuckDB that defines the named views and all that they need."""
    need: list[str] = []

    def add(name: str) -> None:
        for other in re.findall(r"\bfx_\w+", VIEWS[name]):
            if other != name:
                add(other)
        if name not in need:
            need.append(name)

    for n in names:
        add(n)
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({VIEWS[n].format(str='VARCHAR')})" for n in need)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame over the Parquet tables of sf_dir."""
    text = VIEWS[name].format(str="STRING")
    frames = {}
    for other in dict.fromkeys(re.findall(r"(?:FROM|JOIN)\s+(\w+)", text)):
        frames[other] = view(spark, sf_dir, other) if other in VIEWS else spark.read.parquet(f"{sf_dir}/{other}.parquet")
        text = re.sub(rf"((?:FROM|JOIN)\s+){other}\b", rf"\1{{{other}}}", text)
    text = text.replace("{closure#0}", "{{closure#0}}")
    return spark.sql(text, **frames)
