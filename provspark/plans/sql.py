"""SQL fragments for DuckDB that several queries of the catalogue share."""

from __future__ import annotations

from provspark.functions.symbols import FP_KINDS
from provspark.plans.fixtures import sql_with


def origin_cte(source: str, roots: list[str] | None = None, path: str = "path") -> str:
    """CTEs ending in o: the rows of source with kind, crate and version."""
    listed = ", ".join(f"'{r}'" for r in roots or ["\x01"])

    def name(x: str, part: int) -> str:
        return f"CASE WHEN regexp_matches({x}, '-[0-9]') THEN regexp_extract({x}, '^(.*)-([0-9].*)$', {part}) END"

    return f"""o1 AS (SELECT *, {path} AS pp, regexp_extract({path}, '^/rust/deps/([^/]*)', 1) AS f1, regexp_extract({path}, 'cargo/registry/src/[^/]*/([^/]*)', 1) AS f2,
        regexp_extract({path}, 'crates\\.io/([^/]*)', 1) AS f3 FROM {source}),
    o2 AS (SELECT *, {name('f1', 1)} AS n1, {name('f2', 1)} AS n2, {name('f3', 1)} AS n3, {name('f1', 2)} AS v1, {name('f2', 2)} AS v2, {name('f3', 2)} AS v3 FROM o1),
    o3 AS (SELECT *, CASE WHEN starts_with(pp, '/rustc/') OR starts_with(pp, 'library/') OR regexp_matches(pp, '(^|/)src/lib(core|alloc|std|panic_abort|panic_unwind|unwind|backtrace|test|proc_macro|compiler_builtins)/') THEN 0
        WHEN n1 IS NOT NULL THEN 1 WHEN n2 IS NOT NULL THEN 2 WHEN n3 IS NOT NULL THEN 3 WHEN NOT starts_with(pp, '/') THEN 4 ELSE 5 END AS rule FROM o2),
    o AS (SELECT *, CASE WHEN rule = 0 THEN 'std' WHEN rule = 4 OR (rule = 2 AND n2 IN ({listed})) OR (rule = 3 AND n3 IN ({listed})) THEN 'user' WHEN rule = 5 THEN 'unknown' ELSE 'dep' END AS kind,
        CASE WHEN rule = 1 THEN n1 WHEN rule = 2 AND n2 NOT IN ({listed}) THEN n2 WHEN rule = 3 AND n3 NOT IN ({listed}) THEN n3 END AS crate,
        CASE WHEN rule = 1 THEN v1 WHEN rule = 2 AND n2 NOT IN ({listed}) THEN v2 WHEN rule = 3 AND n3 NOT IN ({listed}) THEN v3 END AS version FROM o3)"""


SITE_KIND = """CASE WHEN file LIKE '/rustc/%' OR file LIKE 'src/libcore/%' THEN 'std' WHEN file LIKE '/rust/deps/%' OR file LIKE '%cargo/registry/src/%' OR file LIKE 'crates.io/%' THEN 'dep' WHEN file NOT LIKE '/%' THEN 'user' ELSE 'unknown' END"""
_HIT_CTE = f"""hits AS (SELECT DISTINCT fn_start, struct_vaddr, {SITE_KIND} AS kind FROM fx_refs ASOF JOIN fx_sites ON ea >= struct_vaddr WHERE ea < struct_vaddr + 24)"""


def hits_with(*names: str) -> str:
    """A WITH clause that ends in hits, with more views if named."""
    return f"{sql_with('fx_refs', 'fx_sites', 'fx_functions', *names)}, {_HIT_CTE}"


HITS = hits_with()

SEEDS = """seeds AS (SELECT DISTINCT fn_start AS node FROM hits WHERE kind = 'user' AND fn_start IN (SELECT fn_start FROM fx_functions)),
    barrier AS (SELECT DISTINCT fn_start AS node FROM hits WHERE kind = 'dep'),
    edges AS (SELECT caller, callee FROM fx_calls)"""
_GRAPH = f"{hits_with('fx_calls', 'fx_truth')}, {SEEDS}"


def _walk(name: str, src: str, dst: str, depth: int | None) -> str:
    enter = f"{dst} IN (SELECT fn_start FROM fx_functions) AND {dst} NOT IN (SELECT node FROM barrier)"
    if depth is None:
        return f"{name}(node) AS (SELECT node FROM seeds UNION SELECT {dst} FROM {name} JOIN edges ON {src} = node WHERE {enter})"
    return f"{name}(node, depth) AS (SELECT node, 0 FROM seeds UNION SELECT {dst}, depth + 1 FROM {name} JOIN edges ON {src} = node WHERE depth < {depth} AND {enter})"


def REACH(depth: int | None, *_: str) -> str:
    return f"{_GRAPH}, {_walk('reach', 'caller', 'callee', depth)}"


def BACKTRACE(depth: int | None, whole: bool = True) -> str:
    walk = _walk("back", "callee", "caller", depth)
    return f"{_GRAPH}, {walk}" if whole else walk


def attribution_sql(depth: int | None) -> str:
    return f"""{REACH(depth)}, known AS (SELECT DISTINCT node FROM reach),
    outside AS (SELECT DISTINCT callee FROM edges WHERE caller NOT IN (SELECT node FROM known)),
    attributed AS (SELECT fn_start, fn_end, CASE WHEN fn_start IN (SELECT node FROM seeds) THEN 'certain' WHEN fn_start NOT IN (SELECT node FROM known) THEN 'library'
        WHEN fn_start IN (SELECT callee FROM outside) THEN 'indeterminate' ELSE 'inferred' END AS attribution FROM fx_functions)"""


LABELLED = """labelled AS (SELECT a.*, CASE WHEN t.kind IS NULL THEN 'UNK' WHEN t.kind = 'user' THEN 'TP' ELSE 'FP' END AS label FROM attributed a LEFT JOIN fx_truth t USING (fn_start))"""

_LEAD = "nullif(regexp_extract({x}, '^<*([a-zA-Z_][a-zA-Z0-9_]*)(::|<| )', 1), '')"
_KIND = "CASE " + " ".join(f"WHEN regexp_matches(symbol, '{pattern}') THEN '{label}'" for pattern, label in FP_KINDS) + " ELSE 'genuine-dep/other' END"
SYMBOL_COLUMNS = f"""s1 AS (SELECT *, coalesce(nullif(regexp_extract(symbol, '__rust_begin_short_backtrace::<(.+)', 1), ''), symbol) AS inner1,
        ltrim(regexp_replace(regexp_replace(symbol, '^[<&*( \\[]+', ''), '^dyn ', '')) AS bare FROM fx_symbols),
    s2 AS (SELECT *, CASE WHEN contains(inner1, 'LocalKey') THEN coalesce(nullif(regexp_extract(inner1, '::with::<(.+)', 1), ''), inner1) ELSE inner1 END AS inner2,
        CASE WHEN contains(bare, '::') THEN split_part(bare, '::', 1) END AS head FROM s1),
    s AS (SELECT *, {_LEAD.format(x='symbol')} AS v1, {_LEAD.format(x='inner1')} AS v2, {_LEAD.format(x='inner2')} AS v3, CASE WHEN regexp_matches(head, '^[a-z_][a-z0-9_]+$') THEN head END AS v4,
        {_KIND} AS kind FROM s2)"""
