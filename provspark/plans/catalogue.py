"""All registered queries of the provenance operators, with their SQL.

A query's function takes (fx, spark, sf_dir), where fx(name) is a view of
fixtures.py or a table. Integers are returned as long, so that both engines
agree on types.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provspark.functions import origin as org
from provspark.functions import symbols as sym
from provspark.operators import anchors, graph, joins, truth, type_names
from provspark.plans.fixtures import VIEWS, sql_with, view
from provspark.plans.sql import (
    BACKTRACE,
    HITS,
    LABELLED,
    REACH,
    SYMBOL_COLUMNS,
    _walk,
    attribution_sql,
    hits_with,
    origin_cte,
)
from provspark.session import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
c = F.col


def query(name: str, sql: str | None = None):
    def add(f: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            def fx(table: str) -> DataFrame:
                return view(spark, sf_dir, table) if table in VIEWS else spark.read.parquet(f"{sf_dir}/{table}.parquet")

            out = f(fx)
            return out.select(*[c(n).cast("long").alias(n) if t in ("int", "smallint", "tinyint") else c(n) for n, t in out.dtypes])

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return f

    return add


# ---- paths and origins -------------------------------------------------------------------------------------------

ROOTS = ["aes", "dep-c3"]


def classified(fx, roots: list[str] | None = None) -> DataFrame:
    array = F.array(*[F.lit(x) for x in roots]) if roots else None
    return fx("fx_paths").select("sid", "path", org.origin(c("path"), array).alias("o"))


PATHS = sql_with("fx_paths")


@query("origin_classify", f"{PATHS}, {origin_cte('fx_paths')} SELECT sid, kind, crate, version FROM o")
def _(fx):
    return classified(fx).select("sid", "o.*")


@query("origin_label", f"{PATHS}, {origin_cte('fx_paths')} SELECT sid, CASE WHEN kind = 'dep' THEN concat('dep:', crate, '@', version) ELSE kind END AS label FROM o")
def _(fx):
    return classified(fx).select("sid", org.origin_label(c("o")).alias("label"))


@query("root_promotion", f"{PATHS}, {origin_cte('fx_paths', ROOTS)} SELECT sid, kind, crate, version FROM o")
def _(fx):
    return classified(fx, ROOTS).select("sid", "o.*")


@query("dwarf_origin", f"{PATHS}, {origin_cte('fx_paths')} SELECT sid, CASE WHEN kind = 'unknown' THEN 'user' ELSE kind END AS kind FROM o")
def _(fx):
    return fx("fx_paths").select("sid", org.origin_for_debug_info(c("path"))["kind"].alias("kind"))


@query(
    "split_crate_version",
    f"""{PATHS}, d AS (SELECT sid, regexp_extract(path, '([^/]*-[^/]*)/src', 1) AS folder FROM fx_paths)
    SELECT sid, CASE WHEN regexp_matches(folder, '-[0-9]') THEN regexp_extract(folder, '^(.*)-([0-9].*)$', 1) END AS crate,
    CASE WHEN regexp_matches(folder, '-[0-9]') THEN regexp_extract(folder, '^(.*)-([0-9].*)$', 2) END AS version FROM d""",
)
def _(fx):
    folder = F.regexp_extract("path", "([^/]*-[^/]*)/src", 1)
    return fx("fx_paths").select("sid", org.crate_name(folder).alias("crate"), org.crate_version(folder).alias("version"))


@query(
    "root_autodetect",
    f"""{PATHS}, p AS (SELECT concat('b', CAST(sid // 16 AS VARCHAR)) AS binary_id, concat('dep-c', CAST(sid // 16 % 25 AS VARCHAR)) AS stem,
        CASE WHEN sid % 7 = 2 THEN replace(path, '/src/lib.rs', '/src/main.rs') ELSE path END AS path FROM fx_paths),
    d AS (SELECT binary_id, stem, regexp_extract(path, 'cargo/registry/src/[^/]*/([^/]+)', 1) AS dir, bool_or(contains(path, '/src/main.rs') OR contains(path, '/src/bin/')) AS m FROM p GROUP BY ALL),
    n AS (SELECT *, regexp_extract(dir, '^(.*)-([0-9].*)$', 1) AS name FROM d WHERE dir <> ''),
    g AS (SELECT binary_id, stem, count(*) FILTER (WHERE m) AS k, max(CASE WHEN m THEN name END) AS one, bool_or(name = stem) AS s FROM n GROUP BY ALL),
    r AS (SELECT e.binary_id, e.stem, CASE WHEN k = 1 THEN one WHEN s THEN e.stem END AS root_crate FROM (SELECT DISTINCT binary_id, stem FROM p) e LEFT JOIN g USING (binary_id, stem))
    SELECT binary_id, stem, CASE WHEN root_crate IS NULL THEN 'fallback' ELSE 'detected' END AS outcome, root_crate FROM r""",
)
def _(fx):
    path = F.when(c("sid") % 7 == 2, F.replace("path", F.lit("/src/lib.rs"), F.lit("/src/main.rs"))).otherwise(c("path"))
    n = F.floor(c("sid") / 16)
    p = fx("fx_paths").select(F.concat(F.lit("b"), n.cast("string")).alias("binary_id"), F.concat(F.lit("dep-c"), (n % 25).cast("string")).alias("stem"), path.alias("path"))
    return anchors.detect_roots(p, ["binary_id"])


TALLY = """CAST(count(*) FILTER (WHERE kind = 'user') AS BIGINT) AS n_user, CAST(count(*) FILTER (WHERE kind = 'std') AS BIGINT) AS n_std,
    CAST(count(*) FILTER (WHERE kind = 'dep') AS BIGINT) AS n_dep, CAST(count(*) FILTER (WHERE kind = 'unknown') AS BIGINT) AS n_unknown,
    CAST(count(DISTINCT CASE WHEN kind = 'dep' THEN crate END) AS BIGINT) AS n_dep_crates"""


@query("string_tally", f"{PATHS}, {origin_cte('fx_paths')} SELECT {TALLY} FROM o")
def _(fx):
    return anchors.tally(classified(fx).select("o.*"))


def sites(fx) -> DataFrame:
    return fx("fx_sites").select("*", org.origin(c("file")).alias("o"))


SITES = sql_with("fx_sites")
SITE_ORIGIN = f"{SITES}, {origin_cte('fx_sites', path='file')}"


@query("location_tally", f"{SITE_ORIGIN} SELECT {TALLY} FROM o")
def _(fx):
    return anchors.tally(sites(fx).select("o.*"))


@query(
    "user_sites_by_file",
    f"{SITE_ORIGIN} SELECT file, CAST(count(*) AS BIGINT) AS n, string_agg(concat(CAST(line AS VARCHAR), ':', CAST(col AS VARCHAR)), ' ' ORDER BY line, col) AS sites FROM o WHERE kind = 'user' GROUP BY file",
)
def _(fx):
    own = sites(fx).where("o.kind = 'user'").groupBy("file").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("line", "col"))).alias("s"))
    shown = F.array_join(F.transform("s", lambda x: F.concat_ws(":", x["line"], x["col"])), " ")
    return own.select("file", "n", shown.alias("sites"))


@query(
    "top_dep_crates",
    f"""{SITE_ORIGIN}, g AS (SELECT concat(crate, '@', version) AS crate, CAST(count(*) AS BIGINT) AS n FROM o WHERE kind = 'dep' GROUP BY 1),
    r AS (SELECT *, row_number() OVER (ORDER BY n DESC, crate) AS rank FROM g)
    SELECT CASE WHEN rank <= 10 THEN crate ELSE '(other)' END AS crate, CAST(sum(n) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS crates FROM r GROUP BY 1""",
)
def _(fx):
    g = sites(fx).where("o.kind = 'dep'").groupBy(F.concat_ws("@", "o.crate", "o.version").alias("crate")).agg(F.count("*").alias("n"))
    top = g.orderBy(F.desc("n"), "crate").limit(10)
    rest = g.join(top.select("crate"), "crate", "left_anti").agg(F.sum("n").alias("n"), F.count("*").alias("crates")).where("crates > 0")
    return top.select("crate", "n", F.lit(1).cast("long").alias("crates")).union(rest.select(F.lit("(other)"), "n", "crates"))


@query("dep_crate_names", f"{SITE_ORIGIN} SELECT DISTINCT replace(crate, '-', '_') AS crate FROM o WHERE kind = 'dep' ORDER BY 1")
def _(fx):
    return sites(fx).where("o.kind = 'dep'").select(sym.normal_crate(c("o.crate")).alias("crate")).distinct().orderBy("crate")


@query(
    "location_order",
    f"""{SITE_ORIGIN} SELECT CAST(CASE kind WHEN 'user' THEN 0 WHEN 'std' THEN 1 WHEN 'dep' THEN 2 ELSE 3 END AS BIGINT) AS origin_rank, crate, version, file, line, col, struct_vaddr FROM o
    ORDER BY origin_rank, crate NULLS FIRST, version NULLS FIRST, file, line, col""",
)
def _(fx):
    rank = org.origin_rank(c("o.kind")).alias("origin_rank")
    return sites(fx).select(rank, "o.crate", "o.version", "file", "line", "col", "struct_vaddr").orderBy("origin_rank", "crate", "version", "file", "line", "col")


# ---- relocations and locations -----------------------------------------------------------------------------------


@query("first_slot_wins", f"{sql_with('fx_relocs')} SELECT addend, arg_min(addr, reloc_idx) AS slot, min(reloc_idx) AS reloc_idx FROM fx_relocs GROUP BY addend")
def _(fx):
    r = fx("fx_relocs").withColumnRenamed("addr", "offset")
    return anchors.first_slot_wins(r).withColumnRenamed("offset", "slot")


@query(
    "location_rebuild",
    f"""{sql_with('fx_relocs', 'fx_strings')} SELECT addr AS struct_vaddr, content AS file, addend AS file_vaddr, line, col FROM fx_relocs JOIN fx_strings ON vaddr = addend
    WHERE stored_len = strlen(content) AND line BETWEEN 1 AND 200000""",
)
def _(fx):
    return anchors.rebuild_locations(fx("fx_relocs").withColumnRenamed("addr", "offset"), fx("fx_strings"))


@query(
    "slots_in_section",
    f"""{sql_with('fx_relocs')}, s(lo, n) AS (VALUES (CAST(1004800 AS BIGINT), CAST(48000 AS BIGINT))), r(lo2, n2) AS (VALUES (CAST(5001024 AS BIGINT), CAST(9000 AS BIGINT)))
    SELECT reloc_idx, addr, addend FROM fx_relocs, s, r WHERE addr >= lo AND addr < lo + n AND addend >= lo2 AND addend < lo2 + n2""",
)
def _(fx):
    x = fx("fx_relocs").select("reloc_idx", "addr", "addend", F.lit("b").alias("binary_id"))
    s = x.sparkSession.createDataFrame([("b", 1_004_800, 48_000, 5_001_024, 9_000)], "binary_id string, lo long, n long, lo2 long, n2 long")
    inside = joins.point_in_bounds(x, F.broadcast(s), "addr", "lo", "n", ["binary_id"])  # one row a binary, made here
    return inside.where("addend >= lo2 AND addend < lo2 + n2").select("reloc_idx", "addr", "addend")


def locations(fx) -> DataFrame:
    return sites(fx).select("struct_vaddr", "file", "line", "col", c("o.kind").alias("kind"))


def hits(fx) -> DataFrame:
    return anchors.location_hits(fx("fx_refs"), locations(fx))


@query("location_hits", f"{HITS} SELECT fn_start, struct_vaddr, kind FROM hits")
def _(fx):
    return hits(fx)


@query("certain_set", f"{HITS} SELECT DISTINCT fn_start FROM hits WHERE kind = 'user'")
def _(fx):
    return anchors.certain_and_boundary(hits(fx)).where("is_certain").select("fn_start")


@query("dep_boundary", f"{HITS} SELECT DISTINCT fn_start FROM hits WHERE kind = 'dep'")
def _(fx):
    return anchors.certain_and_boundary(hits(fx)).where("is_boundary").select("fn_start")


COUNT_CTE = "counts AS (SELECT fn_start, CAST(count(DISTINCT struct_vaddr) AS BIGINT) AS anchor_count FROM hits WHERE kind = 'user' GROUP BY fn_start)"
COUNTS = f"{HITS}, {COUNT_CTE}"


@query("anchor_counts", f"{COUNTS} SELECT * FROM counts")
def _(fx):
    return anchors.anchor_counts(hits(fx))


FILES = f"""{COUNTS}, files AS (SELECT fn_start, string_agg(file, '|' ORDER BY file) AS anchor_files FROM (SELECT DISTINCT fn_start, file FROM hits JOIN fx_sites USING (struct_vaddr) WHERE kind = 'user') GROUP BY fn_start)"""


@query("anchor_files", f"{FILES} SELECT fn_start, anchor_files FROM files")
def _(fx):
    return anchors.anchor_files(hits(fx), locations(fx)).select("fn_start", F.array_join("anchor_files", "|").alias("anchor_files"))


TIERS = f"""{FILES}, tiers AS (SELECT f.fn_start, fn_end, fn_end - f.fn_start AS size, CASE WHEN anchor_count >= 2 THEN 'strong' ELSE 'single' END AS tier, anchor_count, anchor_files
    FROM fx_functions f JOIN counts USING (fn_start) JOIN files USING (fn_start))"""


def tiers(fx, **k) -> DataFrame:
    return anchors.tier_functions(fx("fx_functions"), hits(fx), locations(fx), **k)


@query("tier_functions", f"{TIERS} SELECT * FROM tiers")
def _(fx):
    return tiers(fx).withColumn("anchor_files", F.array_join("anchor_files", "|"))


@query("tier_functions_n3", f"{TIERS} SELECT fn_start, CASE WHEN anchor_count >= 3 THEN 'strong' ELSE 'single' END AS tier FROM tiers")
def _(fx):
    return tiers(fx, min_anchors=3).select("fn_start", "tier")


@query("precision_mode", f"{TIERS} SELECT fn_start, size, anchor_count FROM tiers WHERE tier = 'strong'")
def _(fx):
    return tiers(fx, precision=True).select("fn_start", "size", "anchor_count")


@query(
    "json_contract",
    f"""{TIERS} SELECT fn_start, concat('{{"start":"0x', lower(hex(fn_start)), '","end":"0x', lower(hex(fn_end)), '","size":', CAST(size AS VARCHAR), ',"tier":"', tier, '","anchor_count":',
    CAST(anchor_count AS VARCHAR), ',"anchor_files":["', replace(anchor_files, '|', '","'), '"]}}') AS json FROM tiers""",
)
def _(fx):
    from provspark.sources.sinks import function_record

    return tiers(fx).select("fn_start", F.to_json(function_record()).alias("json"))


EDGE_CTE = """edges AS (SELECT fn_start, CAST(count(*) FILTER (WHERE kind = 'user') AS BIGINT) AS n_user, CAST(count(*) FILTER (WHERE kind = 'std') AS BIGINT) AS n_std,
    CAST(count(*) FILTER (WHERE kind = 'dep') AS BIGINT) AS n_dep, CAST(count(*) FILTER (WHERE kind = 'unknown') AS BIGINT) AS n_unknown FROM hits GROUP BY fn_start HAVING n_user > 0)"""
EDGE_COUNTS = f"{HITS}, {EDGE_CTE}"


@query("edge_provenance", f"{EDGE_COUNTS} SELECT * FROM edges")
def _(fx):
    return anchors.edge_counts(hits(fx))


# ---- ranges ------------------------------------------------------------------------------------------------------

POINTS = sql_with("fx_functions", "fx_instr")


@query("function_asof", f"{POINTS} SELECT ip, fn_start, fn_end FROM fx_instr ASOF JOIN fx_functions ON ip >= fn_start WHERE ip < fn_end")
def _(fx):
    return joins.asof_containing(fx("fx_instr").select("ip"), fx("fx_functions"), "ip", "fn_start", "fn_end")


@query("function_interval", f"{POINTS} SELECT ip, fn_start, fn_end FROM fx_instr JOIN fx_functions ON ip >= fn_start AND ip < fn_end")
def _(fx):
    return joins.range_join(fx("fx_instr").select("ip"), fx("fx_functions"), "ip", "fn_start", "fn_end", bits=9)


@query("bare_slot_hits", f"{SITES}, r AS (SELECT DISTINCT ea FROM ({VIEWS['fx_refs']})) SELECT ea FROM r WHERE EXISTS (SELECT 1 FROM fx_sites WHERE ea >= struct_vaddr AND ea < struct_vaddr + 16)")
def _(fx):
    slots = fx("fx_sites").select("struct_vaddr", (c("struct_vaddr") + 16).alias("slot_end"))
    return joins.range_join(fx("fx_refs").select("ea").distinct(), slots, "ea", "struct_vaddr", "slot_end", bits=5, how="left_semi")


@query(
    "fallback_ranges",
    f"""{sql_with('fx_calls')}, s AS (SELECT callee % 3 AS binary_id, callee AS fn_start FROM fx_calls UNION SELECT b, 4096 FROM (VALUES (0), (1), (2)) t(b)),
    r AS (SELECT binary_id, fn_start, coalesce(lead(fn_start) OVER (PARTITION BY binary_id ORDER BY fn_start), 60000) AS fn_end FROM s) SELECT * FROM r WHERE fn_end > fn_start""",
)
def _(fx):
    calls = fx("fx_calls").select((c("callee") % 3).alias("binary_id"), c("callee").alias("fn_start"))
    base = calls.sparkSession.createDataFrame([(i, 4096) for i in range(3)], "binary_id long, fn_start long")
    end = base.select("binary_id", F.lit(60000).cast("long").alias("text_end"))
    return anchors.fallback_ranges(calls.union(base), end, ["binary_id"])


# ---- call graph --------------------------------------------------------------------------------------------------


@query("call_edges", f"{sql_with('fx_calls', 'fx_functions')} SELECT caller, callee FROM fx_calls WHERE callee IN (SELECT fn_start FROM fx_functions)")
def _(fx):
    return fx("fx_calls").join(fx("fx_functions").select(c("fn_start").alias("callee")), "callee", "left_semi").select("caller", "callee")


@query("reverse_edges", f"{sql_with('fx_calls')} SELECT DISTINCT callee AS caller, caller AS callee FROM fx_calls")
def _(fx):
    return graph.reverse_edges(fx("fx_calls"), "caller", "callee")


def seeds_and_barrier(fx) -> tuple[DataFrame, DataFrame]:
    """Functions with an author location and with a dependency's, from one pass over the hits."""
    marks = materialize(anchors.certain_and_boundary(hits(fx)).where("is_certain OR is_boundary"), "marks")
    return marks.where("is_certain").select("fn_start"), marks.where("is_boundary").select("fn_start")


def attributed(fx, depth: int | None = None) -> DataFrame:
    certain, barrier = seeds_and_barrier(fx)
    return graph.attribute(fx("fx_functions"), certain, fx("fx_calls"), barrier, depth)


for label, depth in (("unbounded", None), ("depth0", 0), ("depth1", 1), ("depth2", 2)):

    @query(f"attribution_{label}", f"{attribution_sql(depth)} SELECT fn_start, fn_end, attribution FROM attributed")
    def _(fx, depth=depth):
        return attributed(fx, depth)


@query("attribution_score", f"{attribution_sql(None)} SELECT attribution, CAST(count(*) AS BIGINT) AS n FROM attributed GROUP BY attribution")
def _(fx):
    return attributed(fx).groupBy("attribution").agg(F.count("*").alias("n"))


def traced(fx, depth: int | None) -> DataFrame:
    certain, barrier = seeds_and_barrier(fx)
    return graph.backtrace(fx("fx_functions"), certain, fx("fx_calls"), barrier, depth)


for label, depth in (("d0", 0), ("d1", 1), ("d2", 2)):

    @query(f"backtrace_{label}", f"{BACKTRACE(depth)} SELECT node AS fn_start, CAST(min(depth) AS BIGINT) AS depth FROM back GROUP BY node HAVING min(depth) > 0")
    def _(fx, depth=depth):
        return traced(fx, depth)


@query("backtrace_inf", f"{BACKTRACE(None)} SELECT node AS fn_start FROM back WHERE node NOT IN (SELECT node FROM seeds)")
def _(fx):
    return traced(fx, None).select("fn_start")


@query(
    "marginal_backtrace",
    f"""{attribution_sql(1)}, {BACKTRACE(2, False)} SELECT DISTINCT node AS fn_start FROM back WHERE node NOT IN (SELECT node FROM seeds)
    AND node NOT IN (SELECT fn_start FROM attributed WHERE attribution IN ('certain', 'inferred'))""",
)
def _(fx):
    known = attributed(fx, 1).where("attribution IN ('certain', 'inferred')")
    return traced(fx, 2).select("fn_start").join(known, "fn_start", "left_anti")


# ---- scores against truth ----------------------------------------------------------------------------------------

METRICS = """CAST(count(*) AS BIGINT) AS predicted, CAST(count(*) FILTER (WHERE label = 'TP') AS BIGINT) AS tp, CAST(count(*) FILTER (WHERE label = 'FP') AS BIGINT) AS fp,
    CAST(count(*) FILTER (WHERE label = 'UNK') AS BIGINT) AS unknown,
    CAST(count(*) FILTER (WHERE label = 'TP') AS DOUBLE) / nullif(count(*) FILTER (WHERE label <> 'UNK'), 0) AS precision,
    CAST(count(*) FILTER (WHERE label = 'TP') AS DOUBLE) / count(*) AS tp_over_predicted"""


@query("bucket_metrics", f"{attribution_sql(None)}, {LABELLED} SELECT attribution, {METRICS} FROM labelled GROUP BY attribution")
def _(fx):
    return truth.bucket_metrics(truth.labelled(attributed(fx), fx("fx_truth")))


PLACED = """t AS (SELECT fn_start, coalesce(attribution, 'library') AS placed FROM (SELECT * FROM fx_truth WHERE kind = 'user') LEFT JOIN attributed USING (fn_start))"""


@query(
    "recall_placement",
    f"""{attribution_sql(1)}, {PLACED} SELECT CAST(count(*) AS BIGINT) AS n_truth, {", ".join(f"CAST(count(*) FILTER (WHERE placed = '{b}') AS BIGINT) AS n_{b}" for b in truth.BUCKETS)},
    CAST(count(*) FILTER (WHERE placed IN ('certain', 'inferred')) AS BIGINT) AS n_captured, CAST(count(*) FILTER (WHERE placed IN ('certain', 'inferred')) AS DOUBLE) / count(*) AS recall FROM t""",
)
def _(fx):
    return truth.recall_placement(attributed(fx, 1), fx("fx_truth"))


@query(
    "backtrace_only_recall",
    f"""{attribution_sql(1)}, {BACKTRACE(1, False)}, b AS (SELECT DISTINCT node AS fn_start FROM back WHERE node NOT IN (SELECT node FROM seeds)),
    m AS (SELECT fn_start, coalesce(kind, 'none') AS kind, fn_start NOT IN (SELECT fn_start FROM attributed WHERE attribution IN ('certain', 'inferred')) AS marginal FROM b LEFT JOIN fx_truth USING (fn_start))
    SELECT CAST(count(*) AS BIGINT) AS predicted, CAST(count(*) FILTER (WHERE kind = 'user') AS BIGINT) AS tp, CAST(count(*) FILTER (WHERE kind = 'user' AND marginal) AS BIGINT) AS backtrace_only FROM m""",
)
def _(fx):
    known = attributed(fx, 1).where("attribution IN ('certain', 'inferred')").select("fn_start", F.lit(True).alias("known"))
    x = truth.labelled(traced(fx, 1).select("fn_start"), fx("fx_truth")).join(known, "fn_start", "left")
    tp = c("label") == "TP"
    return x.agg(F.count("*").alias("predicted"), F.count_if(tp).alias("tp"), F.count_if(tp & c("known").isNull()).alias("backtrace_only"))


SCORED = f"""{hits_with('fx_truth')}, {COUNT_CTE},
    scored AS (SELECT fn_start, anchor_count, CASE WHEN t.kind IS NULL THEN 'UNK' WHEN t.kind = 'user' THEN 'TP' ELSE 'FP' END AS label, coalesce(path, '') AS path,
    CASE fn_start // 256 % 4 WHEN 0 THEN 'async' WHEN 1 THEN 'cli' ELSE 'macro' END AS category, concat('b', CAST((fn_start // 256) % 10 AS VARCHAR)) AS bin FROM counts LEFT JOIN fx_truth t USING (fn_start))"""


def scored(fx) -> DataFrame:
    x = truth.labelled(anchors.anchor_counts(hits(fx)), fx("fx_truth"))
    n = F.floor(c("fn_start") / 256)
    x = x.join(fx("fx_truth").select("fn_start", "path"), "fn_start", "left")
    category = F.when(n % 4 == 0, "async").when(n % 4 == 1, "cli").otherwise("macro")
    return x.select("fn_start", "anchor_count", "label", F.coalesce("path", F.lit("")).alias("path"), category.alias("category"), F.concat(F.lit("b"), (n % 10).cast("string")).alias("bin"))


@query(
    "anchor_ladder",
    f"""{SCORED}, x AS (SELECT min_anchors, CAST(count(*) FILTER (WHERE anchor_count >= min_anchors AND label = 'TP') AS BIGINT) AS tp, CAST(count(*) FILTER (WHERE anchor_count >= min_anchors AND label = 'FP') AS BIGINT) AS fp,
    count(*) FILTER (WHERE label = 'TP') AS base FROM scored, (VALUES (CAST(1 AS BIGINT)), (2), (3)) v(min_anchors) GROUP BY min_anchors)
    SELECT min_anchors, tp, fp, CAST(tp AS DOUBLE) / nullif(tp + fp, 0) AS precision, CAST(tp AS DOUBLE) / nullif(base, 0) AS recall_retained FROM x""",
)
def _(fx):
    return truth.ladder(scored(fx))


@query(
    "precision_rollup",
    f"""{SCORED}, x AS (SELECT category, bin, CAST(grouping(category, bin) AS BIGINT) AS level, CAST(count(*) FILTER (WHERE label = 'TP') AS BIGINT) AS tp, CAST(count(*) FILTER (WHERE label = 'FP') AS BIGINT) AS fp FROM scored GROUP BY ROLLUP (category, bin))
    SELECT *, CAST(tp AS DOUBLE) / nullif(tp + fp, 0) AS precision FROM x""",
)
def _(fx):
    return truth.precision_rollup(scored(fx), ["category", "bin"])


# ---- symbols -----------------------------------------------------------------------------------------------------

SYMBOLS = f"{sql_with('fx_symbols', 'fx_deps')}, {SYMBOL_COLUMNS}"

for version, function in enumerate((sym.leading_crate, sym.leading_crate_inside, sym.leading_crate_thread_local, sym.leading_crate_strict), 1):

    @query(f"leading_crate_v{version}", f"{SYMBOLS} SELECT fn_start, v{version} AS crate FROM s")
    def _(fx, function=function):
        return fx("fx_symbols").select("fn_start", function(c("symbol")).alias("crate"))


def with_deps(fx, crate: Column) -> DataFrame:
    deps = fx("fx_deps").select(sym.normal_crate(c("crate")).alias("crate"), F.lit(True).alias("is_dep"))
    return fx("fx_symbols").select("fn_start", "stem", "symbol", crate.alias("crate")).join(deps, "crate", "left").withColumn("is_dep", F.coalesce("is_dep", F.lit(False)))


DEP_NAMES = "(SELECT replace(crate, '-', '_') FROM fx_deps)"
IN_BASE = ", ".join(f"'{x}'" for x in sym.STD_BASE)
IN_WIDE = ", ".join(f"'{x}'" for x in sym.STD_WIDE)


@query("symbol_class4", f"{SYMBOLS} SELECT fn_start, CASE WHEN v1 IS NULL THEN 'unknown' WHEN v1 IN ({IN_BASE}) THEN 'std' WHEN v1 IN {DEP_NAMES} THEN 'dep' ELSE 'user' END AS class FROM s")
def _(fx):
    return with_deps(fx, sym.leading_crate(c("symbol"))).select("fn_start", sym.class_of_four(c("crate"), c("is_dep")).alias("class"))


@query("symbol_class3", f"{SYMBOLS} SELECT fn_start, CASE WHEN v3 IS NULL THEN 'unk' WHEN v3 = replace(stem, '-', '_') THEN 'user' WHEN v3 IN ({IN_WIDE}) OR v3 IN {DEP_NAMES} THEN 'nonuser' ELSE 'user' END AS class FROM s")
def _(fx):
    return with_deps(fx, sym.leading_crate_thread_local(c("symbol"))).select("fn_start", sym.class_of_three(c("crate"), c("is_dep"), c("stem")).alias("class"))


@query("leading_crate_topk", f"{SYMBOLS} SELECT v2 AS crate, CAST(count(*) AS BIGINT) AS n FROM s WHERE v2 IS NOT NULL GROUP BY 1 ORDER BY n DESC, crate LIMIT 40")
def _(fx):
    x = fx("fx_symbols").select(sym.leading_crate_inside(c("symbol")).alias("crate")).where("crate IS NOT NULL")
    return x.groupBy("crate").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "crate").limit(40)


@query(
    "user_crate_candidates",
    f"{SYMBOLS} SELECT v4 AS crate, CAST(count(*) AS BIGINT) AS n FROM s WHERE v4 IS NOT NULL AND v4 NOT IN ({', '.join(repr(x) for x in sym.STD_NAMES)}) AND v4 NOT IN {DEP_NAMES} GROUP BY 1",
)
def _(fx):
    x = with_deps(fx, sym.leading_crate_strict(c("symbol"))).where("crate IS NOT NULL")
    std = x.sparkSession.createDataFrame([(n,) for n in sym.STD_NAMES], "crate string")
    deps = fx("fx_deps").select(sym.normal_crate(c("crate")).alias("crate"))
    return x.join(std, "crate", "left_anti").join(deps, "crate", "left_anti").groupBy("crate").agg(F.count("*").alias("n"))


@query("fp_kind", f"{SYMBOLS} SELECT kind, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY kind")
def _(fx):
    return fx("fx_symbols").select(sym.fp_kind(c("symbol")).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


SOURCE = "CASE fn_start // 256 % 5 WHEN 0 THEN '??:0' WHEN 1 THEN '/h/.cargo/registry/src/x.rs:3' WHEN 2 THEN '/rustc/ab/core.rs:9' WHEN 3 THEN 'src/main.rs:7' ELSE '' END"


def disputed(fx) -> DataFrame:
    n = F.floor(c("fn_start") / 256) % 5
    source = F.when(n == 0, "??:0").when(n == 1, "/h/.cargo/registry/src/x.rs:3").when(n == 2, "/rustc/ab/core.rs:9").when(n == 3, "src/main.rs:7").otherwise("")
    return fx("fx_symbols").select("fn_start", "stem", sym.disputed_class(c("symbol"), source, F.replace("stem", F.lit("-"), F.lit("_"))).alias("class"))


DISPUTED = f"""{SYMBOLS}, q AS (SELECT fn_start, stem, symbol, {SOURCE} AS src, regexp_extract(symbol, ' as ([a-zA-Z_][a-zA-Z0-9_]*)(::|<)', 1) AS tr FROM s),
    d AS (SELECT fn_start, stem, CASE WHEN regexp_matches(symbol, '\\{{closure[#{{]|\\{{anon[#{{]| as (core|std)::ops::function::Fn(Once|Mut)?[<> ]|\\{{shim:vtable') THEN 'A'
    WHEN regexp_matches(symbol, ' as (core|std)::(clone::Clone|fmt::(Debug|Display)|cmp::(PartialEq|Eq|PartialOrd|Ord)|hash::Hash|default::Default)[>< ]| as serde::(ser::Serialize|de::(Deserialize|Visitor))') THEN 'B'
    WHEN regexp_matches(symbol, '^<*[a-zA-Z_][a-zA-Z0-9_]*::') AND NOT contains(symbol, ' as ') THEN 'A'
    WHEN tr <> '' AND tr NOT IN ({IN_BASE}) AND tr <> replace(stem, '-', '_') THEN 'C'
    WHEN contains(src, '.cargo/registry') OR contains(src, '.cargo/git') THEN 'C' WHEN contains(src, '/rustc/') OR (src NOT IN ('?', '??:0', '') AND contains(src, ':') AND NOT contains(src, '??')) THEN 'A' ELSE 'D' END AS class FROM q)"""


@query("disputed_class", f"{DISPUTED} SELECT fn_start, class FROM d")
def _(fx):
    return disputed(fx).select("fn_start", "class")


@query(
    "disputed_counts",
    f"""{DISPUTED} SELECT stem, {", ".join(f"CAST(count(*) FILTER (WHERE class = '{k}') AS BIGINT) AS {k.lower()}" for k in "ABCD")}, CAST(count(*) FILTER (WHERE class = 'A') AS DOUBLE) / count(*) AS a_share FROM d GROUP BY stem""",
)
def _(fx):
    counts = [F.count_if(c("class") == k).alias(k.lower()) for k in "ABCD"]
    return disputed(fx).groupBy("stem").agg(*counts, truth.ratio(F.count_if(c("class") == "A"), F.count("*")).alias("a_share"))


TIER_SYMBOLS = f"""{TIERS}, {sql_with('fx_symbols', 'fx_deps').removeprefix('WITH RECURSIVE ')}, {SYMBOL_COLUMNS},
    k AS (SELECT fn_start, stem, CASE WHEN v2 IS NULL THEN 'UNK' WHEN v2 IN ({IN_WIDE}) OR v2 IN {DEP_NAMES} THEN 'FP' ELSE 'TP' END AS label FROM s),
    j AS (SELECT fn_start, tier, anchor_count, stem, coalesce(label, 'UNK') AS label FROM tiers LEFT JOIN k USING (fn_start))"""
SYMBOL_SCORE = """CAST(count(*) FILTER (WHERE label = 'TP') AS BIGINT) AS tp, CAST(count(*) FILTER (WHERE label = 'FP') AS BIGINT) AS fp,
    CAST(count(*) FILTER (WHERE label = 'UNK') AS BIGINT) AS unknown, CAST(count(*) FILTER (WHERE label = 'TP') AS DOUBLE) / nullif(count(*) FILTER (WHERE label <> 'UNK'), 0) AS precision"""


def tier_symbols(fx) -> DataFrame:
    """Tiers with the label that a function's symbol gives; functions without a symbol are unknown."""
    crate = with_deps(fx, sym.leading_crate_inside(c("symbol")))
    classes = crate.select("fn_start", "stem", sym.class_of_three(c("crate"), c("is_dep")).alias("class"))
    return truth.symbol_labelled(tiers(fx).drop("fn_end", "anchor_files"), classes)


@query(
    "tier_symbols",
    f"""{TIER_SYMBOLS} SELECT stem, tier, {SYMBOL_SCORE} FROM j GROUP BY stem, tier""",
)
def _(fx):
    return truth.symbol_score(tier_symbols(fx), ["stem", "tier"])


@query(
    "symbol_ladder",
    f"""{TIER_SYMBOLS}, x AS (SELECT min_anchors, CAST(count(*) FILTER (WHERE anchor_count >= min_anchors AND label = 'TP') AS BIGINT) AS tp, CAST(count(*) FILTER (WHERE anchor_count >= min_anchors AND label = 'FP') AS BIGINT) AS fp,
    count(*) FILTER (WHERE label = 'TP') AS base FROM j, (VALUES (CAST(1 AS BIGINT)), (2), (3)) v(min_anchors) GROUP BY min_anchors)
    SELECT min_anchors, tp, fp, CAST(tp AS DOUBLE) / nullif(tp + fp, 0) AS precision, CAST(tp AS DOUBLE) / nullif(base, 0) AS recall_retained FROM x""",
)
def _(fx):
    return truth.ladder(tier_symbols(fx))


# ---- provenance study --------------------------------------------------------------------------------------------

FP_CATEGORY = f"""CASE {
    " ".join("WHEN " + " AND ".join(f"regexp_matches(path, '{part}')" for part in parts) + f" THEN '{label}'" for parts, label in sym.FP_CATEGORIES)
} ELSE 'other' END"""


@query("fp_category", f"{sql_with('fx_truth')} SELECT {FP_CATEGORY} AS category, CAST(count(*) AS BIGINT) AS n FROM fx_truth WHERE kind <> 'user' GROUP BY 1")
def _(fx):
    return fx("fx_truth").where("kind <> 'user'").groupBy(sym.fp_category(c("path")).alias("category")).agg(F.count("*").alias("n"))


SUBCAT = """CASE WHEN label = 'TP' THEN 'tp' WHEN label = 'UNK' THEN 'unk' WHEN contains(path, 'core/src/ops/function.rs') THEN 'fnonce_shim' WHEN contains(path, '/registry/') OR contains(path, '/.cargo/') THEN 'dep'
    WHEN contains(path, 'core/src/') THEN 'core_other' ELSE 'lib_generic' END"""


@query("subcat", f"{SCORED} SELECT fn_start, {SUBCAT} AS category FROM scored")
def _(fx):
    return scored(fx).select("fn_start", sym.provenance_category(c("label"), c("path")).alias("category"))


def studied(fx) -> DataFrame:
    x = scored(fx).select("fn_start", "bin", sym.provenance_category(c("label"), c("path")).alias("category"))
    e = anchors.edge_counts(hits(fx))
    lib = c("n_std") + c("n_dep") + c("n_unknown")
    return x.join(e, "fn_start").select("fn_start", "bin", "category", "n_user", lib.alias("n_lib"), truth.user_fraction(*(c(n) for n in ("n_user", "n_std", "n_dep", "n_unknown"))).alias("uf"))


STUDY = f"""{SCORED}, {EDGE_CTE},
    study AS (SELECT fn_start, bin, {SUBCAT} AS category, n_user, n_std + n_dep + n_unknown AS n_lib, CAST(n_user AS DOUBLE) / (n_user + n_std + n_dep + n_unknown) AS uf FROM scored JOIN edges USING (fn_start))"""


@query(
    "user_fraction_stats",
    f"""{STUDY} SELECT category, CAST(count(*) AS BIGINT) AS n, round(median(uf), 9) AS median, round(quantile_cont(uf, 0.25), 9) AS p25, round(quantile_cont(uf, 0.75), 9) AS p75, min(uf) AS min, max(uf) AS max FROM study GROUP BY category""",
)
def _(fx):
    x = truth.distribution(studied(fx), "uf", ["category"])
    return x.select("category", "n", *[F.round(k, 9).alias(k) for k in ("median", "p25", "p75")], "min", "max")


RULES_SQL = ", ".join(f"('{n}', '{k}', {t})" for n, k, t in truth.RULES)
GRID = f"""kept AS (SELECT *, CASE k WHEN 'n_user' THEN n_user >= t WHEN 'uf' THEN uf >= t ELSE n_user > n_lib END AS keep, category IN ('lib_generic', 'core_other', 'dep') AS bad
    FROM study, (VALUES {RULES_SQL}) v(rule, k, t) WHERE category <> 'unk')"""
GRID_COLUMNS = """CAST(count(*) FILTER (WHERE NOT keep AND bad) AS BIGINT) AS fp_rejected, CAST(count(*) FILTER (WHERE NOT keep AND category = 'fnonce_shim') AS BIGINT) AS shim_rejected,
    CAST(count(*) FILTER (WHERE NOT keep AND category = 'tp') AS BIGINT) AS tp_lost, CAST(count(*) FILTER (WHERE keep AND NOT bad) AS DOUBLE) / nullif(count(*) FILTER (WHERE keep), 0) AS precision_shim_tp,
    CAST(count(*) FILTER (WHERE keep AND category = 'tp') AS DOUBLE) / nullif(count(*) FILTER (WHERE keep), 0) AS precision_shim_fp"""


@query("rule_tradeoff", f"{STUDY}, {GRID} SELECT rule, {GRID_COLUMNS} FROM kept GROUP BY rule")
def _(fx):
    return truth.rule_tradeoff(studied(fx))


@query("rule_precision_by_target", f"{STUDY}, {GRID} SELECT bin, rule, {GRID_COLUMNS} FROM kept GROUP BY bin, rule")
def _(fx):
    return truth.rule_tradeoff(studied(fx), ["bin"])


HEADROOM = f"""{hits_with('fx_truth', 'fx_instr', 'fx_idents')},
    certain AS (SELECT DISTINCT fn_start FROM hits WHERE kind = 'user'), ident AS (SELECT DISTINCT fn_start FROM fx_instr ASOF JOIN fx_functions ON ip >= fn_start WHERE ip < fn_end AND op = 'lea' AND target IN (SELECT target FROM fx_idents WHERE regexp_matches(ident, '^field'))),
    bare AS (SELECT DISTINCT fn_start FROM fx_refs r JOIN fx_sites s ON ea >= struct_vaddr AND ea < struct_vaddr + 16 WHERE regexp_matches(file, '^crates/'))"""


def bare_anchors(fx) -> tuple[DataFrame, DataFrame]:
    lea = joins.asof_containing(fx("fx_instr").where("op = 'lea'").select("ip", "target"), fx("fx_functions"), "ip", "fn_start", "fn_end")
    ident = lea.join(fx("fx_idents").where("ident LIKE 'field%'"), "target", "left_semi").select("fn_start").distinct()
    slots = fx("fx_sites").where("file LIKE 'crates/%'").select("struct_vaddr", (c("struct_vaddr") + 16).alias("slot_end"))
    path = joins.range_join(fx("fx_refs"), slots, "ea", "struct_vaddr", "slot_end", bits=5).select("fn_start").distinct()
    return ident, path


@query(
    "headroom_abc",
    f"""{HEADROOM}, x AS (SELECT fn_start IN (SELECT fn_start FROM certain) AS a, fn_start IN (SELECT fn_start FROM ident) AS i, fn_start IN (SELECT fn_start FROM bare) AS p FROM fx_truth WHERE kind = 'user')
    SELECT CAST(count(*) AS BIGINT) AS n_truth, CAST(count(*) FILTER (WHERE a) AS BIGINT) AS a, CAST(count(*) FILTER (WHERE NOT a AND (i OR p)) AS BIGINT) AS b, CAST(count(*) FILTER (WHERE NOT (a OR i OR p)) AS BIGINT) AS c,
    CAST(count(*) FILTER (WHERE NOT a AND i) AS BIGINT) AS b_ident, CAST(count(*) FILTER (WHERE NOT a AND NOT i AND p) AS BIGINT) AS b_path, CAST(count(*) FILTER (WHERE NOT a AND (i OR p)) AS DOUBLE) / count(*) AS b_ratio FROM x""",
)
def _(fx):
    ident, path = bare_anchors(fx)
    return truth.headroom(fx("fx_truth"), anchors.certain_and_boundary(hits(fx)).where("is_certain"), ident, path)


@query(
    "bare_anchor_precision",
    f"""{HEADROOM}, b AS (SELECT fn_start FROM ident UNION SELECT fn_start FROM bare) SELECT CASE WHEN t.kind IS NULL THEN 'unmapped' WHEN t.kind = 'user' THEN 'user' ELSE {FP_CATEGORY} END AS category,
    CAST(count(*) AS BIGINT) AS n FROM b LEFT JOIN fx_truth t USING (fn_start) GROUP BY 1""",
)
def _(fx):
    ident, path = bare_anchors(fx)
    x = ident.union(path).distinct().join(fx("fx_truth"), "fn_start", "left")
    category = F.when(c("kind").isNull(), "unmapped").when(c("kind") == "user", "user").otherwise(sym.fp_category(c("path")))
    return x.groupBy(category.alias("category")).agg(F.count("*").alias("n"))


@query(
    "bare_anchor_precision_symbols",
    f"""{HEADROOM}, {sql_with('fx_symbols', 'fx_deps').removeprefix('WITH RECURSIVE ')}, {SYMBOL_COLUMNS}, b AS (SELECT fn_start FROM ident UNION SELECT fn_start FROM bare)
    SELECT CASE WHEN s.fn_start IS NULL THEN 'unmapped' WHEN v4 IS NOT NULL AND v4 NOT IN ({IN_BASE}, 'test') AND v4 NOT IN {DEP_NAMES} THEN 'user' ELSE 'nonuser' END AS category,
    CAST(count(*) AS BIGINT) AS n FROM b LEFT JOIN s USING (fn_start) GROUP BY 1""",
)
def _(fx):
    """By symbol names: a function whose symbol names no crate is not the author's."""
    ident, path = bare_anchors(fx)
    named = with_deps(fx, sym.leading_crate_strict(c("symbol"))).select("fn_start", sym.is_author_crate(c("crate"), c("is_dep")).alias("own"))
    category = F.when(c("own").isNull(), "unmapped").when(c("own"), "user").otherwise("nonuser")
    return ident.union(path).distinct().join(named, "fn_start", "left").groupBy(category.alias("category")).agg(F.count("*").alias("n"))


# ---- roots of installed programs ---------------------------------------------------------------------------------

INSTALLED = f"""{hits_with()}, x AS (SELECT fn_start, 'dep-c' || CAST(fn_start // 256 % 30 AS VARCHAR) AS stem, file, kind FROM hits JOIN fx_sites USING (struct_vaddr)),
    y AS (SELECT *, CASE WHEN kind = 'dep' AND regexp_matches(file, '(cargo/registry/src/[^/]*/|crates\\.io/)' || stem || '-[0-9][^-]*/') THEN 'user' ELSE kind END AS rooted FROM x),
    f AS (SELECT stem, fn_start, bool_or(kind = 'user') AS plain, bool_or(rooted = 'user') AS own, bool_or(rooted = 'dep') AND NOT bool_or(rooted = 'user') AS dep_only FROM y GROUP BY ALL),
    d AS (SELECT stem, CASE WHEN bool_or(regexp_matches(file, 'cargo/registry/src/[^/]*/' || stem || '-[0-9]')) THEN 'detected' ELSE 'fallback' END AS outcome FROM x GROUP BY 1),
    g AS (SELECT stem, outcome, count(*) FILTER (WHERE plain) AS n_plain, count(*) FILTER (WHERE own) AS n_rooted, count(*) FILTER (WHERE dep_only) AS n_dep_only FROM f JOIN d USING (stem) GROUP BY 1, 2)"""


@query(
    "install_checks",
    f"""{INSTALLED} SELECT stem, 'reproduce' AS assertion, CAST(n_plain AS BIGINT) AS n, CASE WHEN n_plain = 0 THEN 'PASS' ELSE 'WARN' END AS verdict FROM g
    UNION ALL SELECT stem, 'fix', n_rooted, CASE WHEN n_rooted > 0 THEN 'PASS' ELSE 'FAIL' END FROM g UNION ALL SELECT stem, 'auto-detect', CASE WHEN outcome = 'detected' THEN n_rooted ELSE n_plain END,
    CASE WHEN outcome = 'detected' THEN 'PASS' ELSE 'INFO' END FROM g UNION ALL SELECT stem, 'dep-isolation', n_dep_only, CASE WHEN n_dep_only > 0 THEN 'PASS' ELSE 'WARN' END FROM g""",
)
def _(fx):
    stem = F.concat(F.lit("dep-c"), (F.floor(c("fn_start") / 256) % 30).cast("string"))
    named = hits(fx).select("fn_start", "struct_vaddr").join(fx("fx_sites").select("struct_vaddr", c("file").alias("path")), "struct_vaddr")
    return anchors.install_checks(named.withColumn("stem", stem), ["stem"])


# ---- identifiers and types ---------------------------------------------------------------------------------------

IDENT_TEXT = "concat('use ', replace(replace(url, '://', '::'), '.', '::'), ' x', CAST(page_id AS {str}), '::Foo::bar::baz')"


@query(
    "ident_sweep",
    f"""WITH t AS (SELECT regexp_replace({IDENT_TEXT.format(str='VARCHAR')}, '::', ':: ', 'g') AS t FROM pages), i AS (SELECT unnest(regexp_extract_all(t, '(?:^|[^A-Za-z0-9_])([a-z_][a-z0-9_]{{1,63}})::', 1)) AS ident FROM t)
    SELECT ident, CAST(count(*) AS BIGINT) AS n FROM i GROUP BY ident""",
)
def _(fx):
    text = fx("pages").select(F.expr(IDENT_TEXT.format(str="STRING")).alias("t"))
    return text.select(F.explode(sym.crate_idents(c("t"))).alias("ident")).groupBy("ident").agg(F.count("*").alias("n"))


@query(
    "ident_case_class",
    f"""{sql_with('fx_idents')} SELECT ident, regexp_matches(ident, '^[A-Z][A-Za-z0-9]{{2,}}$') AND regexp_matches(ident, '[a-z]') AS camel, regexp_matches(ident, '^[a-z][A-Za-z0-9_]+$') AS snake,
    regexp_matches(ident, '^[A-Za-z][A-Za-z0-9_]+$') AND NOT regexp_matches(ident, '^[A-Z_]+$') AS ident_like, regexp_matches(ident, '^(Mutex|Rw|Arc|Rc|Box).+') AS std_prefix FROM fx_idents""",
)
def _(fx):
    i = c("ident")
    return fx("fx_idents").select("ident", sym.is_camel_case(i).alias("camel"), sym.is_snake_case(i).alias("snake"), sym.looks_like_ident(i).alias("ident_like"), sym.has_std_prefix(i).alias("std_prefix"))


RUNS = f"""{sql_with('fx_functions', 'fx_instr', 'fx_idents')}, inside AS (SELECT ip, op, imm, target, fn_start FROM fx_instr ASOF JOIN fx_functions ON ip >= fn_start WHERE ip < fn_end),
    ch AS (SELECT *, CASE WHEN lag(fn_start) OVER (ORDER BY ip) <> fn_start THEN 1 ELSE 0 END AS d FROM inside), runs AS (SELECT *, CAST(sum(d) OVER (ORDER BY ip) AS BIGINT) AS run_id FROM ch),
    n AS (SELECT *, count(CASE WHEN op = 'lea' THEN 1 END) OVER (PARTITION BY run_id ORDER BY ip) AS n FROM runs),
    pairs AS (SELECT m.run_id, m.fn_start, m.ip AS mov_ip, m.imm, l.ip AS lea_ip, l.target FROM n m JOIN n l ON l.run_id = m.run_id AND l.op = 'lea' AND l.n <= m.n AND l.n > m.n - 6 WHERE m.op = 'mov' AND m.imm BETWEEN 2 AND 100)"""


def in_runs(fx) -> DataFrame:
    one = F.lit("b").alias("binary_id")
    return type_names.runs(fx("fx_instr").select(one, "*"), fx("fx_functions").select(one, "*"), ["binary_id"])


@query("run_islands", f"{RUNS} SELECT run_id, min(fn_start) AS fn_start, CAST(count(*) AS BIGINT) AS n, min(ip) AS first_ip FROM runs GROUP BY run_id")
def _(fx):
    return in_runs(fx).groupBy("run_id").agg(F.min("fn_start").alias("fn_start"), F.count("*").alias("n"), F.min("ip").alias("first_ip"))


@query("lea_mov_pairs", f"{RUNS} SELECT run_id, fn_start, mov_ip, imm, lea_ip, target FROM pairs")
def _(fx):
    return type_names.load_constant_pairs(in_runs(fx), ["binary_id"]).drop("binary_id")


@query(
    "type_names",
    f"""{RUNS}, i AS (SELECT DISTINCT fn_start, ident FROM pairs JOIN fx_idents USING (target)), k AS (SELECT fn_start, min(CASE WHEN regexp_matches(ident, '^[A-Z][A-Za-z0-9]{{2,}}$') AND regexp_matches(ident, '[a-z]')
    AND ident NOT IN ({', '.join(repr(x) for x in type_names.STD_TYPES)}) THEN ident END) AS struct_name, string_agg(CASE WHEN regexp_matches(ident, '^[a-z][A-Za-z0-9_]+$') THEN ident END, '|' ORDER BY ident) AS fields FROM i GROUP BY fn_start)
    SELECT struct_name, fields, CASE WHEN regexp_matches(struct_name, '^(Mutex|Rw|Arc|Rc|Box).+') THEN 'std' WHEN fn_start % 512 = 0 THEN 'user' ELSE 'non-std' END AS tier, fn_start FROM k WHERE struct_name IS NOT NULL AND fields IS NOT NULL""",
)
def _(fx):
    pairs = type_names.load_constant_pairs(in_runs(fx), ["binary_id"])
    idents = pairs.join(fx("fx_idents"), "target").select("binary_id", "fn_start", "ident").distinct()
    known = fx("fx_functions").select(F.lit("b").alias("binary_id"), "fn_start", F.when(c("fn_start") % 512 == 0, "certain").otherwise("library").alias("attribution"))
    return type_names.type_names(idents, known, ["binary_id"]).select("struct_name", F.array_join("fields", "|").alias("fields"), "tier", "fn_start")


# ---- benchmark results -------------------------------------------------------------------------------------------

LAST = f"{sql_with('fx_bench')}, last AS (SELECT * FROM fx_bench QUALIFY row_number() OVER (PARTITION BY crate ORDER BY pos DESC) = 1)"


def last_results(fx) -> DataFrame:
    x = fx("fx_bench")
    return x.groupBy("crate").agg(F.max_by(F.struct(*[n for n in x.columns if n != "crate"]), "pos").alias("r")).select("crate", "r.*")


@query(
    "jsonl_last_wins",
    """WITH e AS (SELECT event_id, json_extract_string(props, '$.k') AS k, user_id FROM events) SELECT user_id, arg_max(CAST(k AS BIGINT), event_id) AS k, max(event_id) AS pos FROM e WHERE k IS NOT NULL GROUP BY user_id""",
)
def _(fx):
    from provspark.sources.text import last_by_key, parse_json_lines

    lines = fx("events").select(c("event_id").alias("pos"), c("props").alias("line"), "user_id")
    parsed = parse_json_lines(lines, "k LONG").where("k IS NOT NULL")
    return last_by_key(parsed, ["user_id"], "pos").select("user_id", "k", "pos")


@query(
    "bench_summary",
    f"""{LAST} SELECT CAST(count(*) AS BIGINT) AS n, median(n_certain) AS median_certain, median(sym_prec) AS median_sym, avg(sym_prec) AS mean_sym, min(sym_prec) AS min_sym, max(sym_prec) AS max_sym, median(dwarf_prec) AS median_dwarf,
    CAST(CAST(sum(inf_tp) AS BIGINT) AS DOUBLE) / CAST(sum(inf_n) AS BIGINT) AS tp_over_predicted FROM last WHERE error IS NULL""",
)
def _(fx):
    return last_results(fx).where("error IS NULL").agg(
        F.count("*").alias("n"),
        F.median("n_certain").alias("median_certain"),
        F.median("sym_prec").alias("median_sym"),
        F.avg("sym_prec").alias("mean_sym"),
        F.min("sym_prec").alias("min_sym"),
        F.max("sym_prec").alias("max_sym"),
        F.median("dwarf_prec").alias("median_dwarf"),
        truth.ratio(F.sum("inf_tp"), F.sum("inf_n")).alias("tp_over_predicted"),
    )


@query("error_counts", f"{LAST} SELECT error, CAST(count(*) AS BIGINT) AS n FROM last WHERE error IS NOT NULL GROUP BY error ORDER BY n DESC, error")
def _(fx):
    return last_results(fx).where("error IS NOT NULL").groupBy("error").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "error")


@query("pearson_scaling", f"{sql_with('fx_bench')} SELECT CAST(count(*) AS BIGINT) AS n, round(corr(wall_sec, n_fdes), 8) AS r FROM fx_bench WHERE error IS NULL HAVING count(*) >= 3 AND var_pop(n_fdes) > 0")
def _(fx):
    x = fx("fx_bench").where("error IS NULL").agg(F.count("*").alias("n"), F.round(F.corr("wall_sec", c("n_fdes").cast("double")), 8).alias("r"), F.var_pop("n_fdes").alias("v"))
    return x.where("n >= 3 AND v > 0").select("n", "r")


@query("throughput", f"{LAST} SELECT CAST(CAST(sum(bin_size) AS BIGINT) AS DOUBLE) / 1000000.0 / sum(wall_sec) AS mb_per_s, CAST(count(*) AS DOUBLE) * 3600.0 / sum(wall_sec) AS per_hour FROM last WHERE error IS NULL")
def _(fx):
    s = F.sum("wall_sec")
    return last_results(fx).where("error IS NULL").agg((F.sum("bin_size").cast("double") / 1e6 / s).alias("mb_per_s"), (F.count("*").cast("double") * 3600.0 / s).alias("per_hour"))


@query(
    "outliers",
    f"""{LAST}, o AS (SELECT crate, CASE WHEN n_certain = 0 THEN 'zero certain' WHEN sym_prec < 80 THEN 'low symbol precision' WHEN recall < 10 THEN 'low recall' END AS why, CASE WHEN dwarf_prec >= 85 THEN 'primary' ELSE 'secondary' END AS rank FROM last WHERE error IS NULL)
    SELECT * FROM o WHERE why IS NOT NULL""",
)
def _(fx):
    why = F.when(c("n_certain") == 0, "zero certain").when(c("sym_prec") < 80, "low symbol precision").when(c("recall") < 10, "low recall")
    rank = F.when(c("dwarf_prec") >= 85, "primary").otherwise("secondary")
    return last_results(fx).where("error IS NULL").select("crate", why.alias("why"), rank.alias("rank")).where("why IS NOT NULL")


@query(
    "baseline_verdict",
    f"""{LAST} SELECT crate, CASE WHEN sym_prec IS NULL THEN 'N/A' WHEN abs(sym_prec - 60.0) < 2 THEN 'CONFIRMS' WHEN sym_prec > 60 THEN 'IMPROVES' ELSE 'SHIFTS' END AS verdict,
    CASE WHEN recall < 1 THEN 'negligible' WHEN dwarf_prec IS NULL OR dwarf_prec >= 30 THEN 'acceptable' ELSE 'low precision' END AS gain FROM last""",
)
def _(fx):
    return last_results(fx).select("crate", sym.verdict_against(c("sym_prec"), F.lit(60.0)).alias("verdict"), sym.gain_verdict(c("recall"), c("dwarf_prec")).alias("gain"))


@query(
    "upper_vs_true_median",
    f"""{LAST} SELECT pos % 5 AS grp, list_sort(list(sym_prec))[len(list(sym_prec)) // 2 + 1] AS upper_median, median(sym_prec) AS true_median FROM last WHERE sym_prec IS NOT NULL GROUP BY 1""",
)
def _(fx):
    x = last_results(fx).where("sym_prec IS NOT NULL").groupBy((c("pos") % 5).alias("grp"))
    return x.agg(truth.upper_median(c("sym_prec")).alias("upper_median"), F.median("sym_prec").alias("true_median"))


@query(
    "collect_summary",
    f"""{LAST} SELECT CAST(count(*) FILTER (WHERE dwarf_prec >= 99.95) AS BIGINT) AS high, CAST(count(*) FILTER (WHERE dwarf_prec < 99.95) AS BIGINT) AS low, min(recall) AS min_recall, max(recall) AS max_recall, median(recall) AS median_recall FROM last""",
)
def _(fx):
    p = c("dwarf_prec")
    return last_results(fx).agg(F.count_if(p >= 99.95).alias("high"), F.count_if(p < 99.95).alias("low"), F.min("recall").alias("min_recall"), F.max("recall").alias("max_recall"), F.median("recall").alias("median_recall"))


@query(
    "precision_delta",
    f"{LAST} SELECT crate, round(sym_prec - dwarf_prec, 4) AS delta FROM last WHERE sym_prec IS NOT NULL AND dwarf_prec IS NOT NULL ORDER BY delta DESC, crate LIMIT 20",
)
def _(fx):
    x = last_results(fx).where("sym_prec IS NOT NULL AND dwarf_prec IS NOT NULL")
    return x.select("crate", F.round(c("sym_prec") - c("dwarf_prec"), 4).alias("delta")).orderBy(F.desc("delta"), "crate").limit(20)


@query(
    "wall_seconds",
    "SELECT event_id, CAST(event_id % 3 * 3600 + event_id % 60 * 60 + event_id % 59 AS DOUBLE) AS seconds FROM events",
)
def _(fx):
    text = F.concat_ws(":", c("event_id") % 3, c("event_id") % 60, c("event_id") % 59)
    return fx("events").select("event_id", sym.wall_seconds(text).alias("seconds"))


# ---- sweeps: one run, the parameter as a column -------------------------------------------------------------------

#: Depths of the sweeps, with the last level that counts.
DEPTHS = (("1", 1), ("2", 2), ("unlimited", 1 << 30))
BIN = "fn_start // 256 % 10"
TRUTH_BINS = f"""dd(depth) AS (VALUES ('1'), ('2'), ('unlimited')),
    tb AS (SELECT fn_start, kind, {BIN} AS bin FROM fx_truth), users AS (SELECT bin, count(*) AS n FROM tb WHERE kind = 'user' GROUP BY 1)"""


def at_depths(found: DataFrame) -> DataFrame:
    """(fn_start, depth) rows once for each name of a depth that reaches them."""
    names = F.filter(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(k).alias("most")) for n, k in DEPTHS]), lambda x: x["most"] >= c("depth"))
    return found.select("fn_start", F.explode(F.transform(names, lambda x: x["name"])).alias("depth"))


def depth_names(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([(n,) for n, _ in DEPTHS], "depth string")


def share_by_bin(fx, rows: DataFrame, name: str) -> DataFrame:
    """(depth, name): the median over bins of the share of a bin's user functions that are in rows (fn_start, depth)."""
    users = fx("fx_truth").where("kind = 'user'").select("fn_start", (F.floor(c("fn_start") / 256) % 10).alias("bin"))
    base = users.groupBy("bin").agg(F.count("*").alias("n")).withColumn("depth", F.explode(F.array(*[F.lit(n) for n, _ in DEPTHS])))
    hit = rows.join(users, "fn_start").groupBy("depth", "bin").agg(F.count("*").alias("k"))
    return base.join(hit, ["depth", "bin"], "left").groupBy("depth").agg(F.median(F.coalesce("k", F.lit(0)) / c("n")).alias(name))


@query(
    "depth_sweep",
    f"""{REACH(None, 'fx_truth')}, {_walk('near', 'caller', 'callee', 2)}, {TRUTH_BINS},
    r AS (SELECT node, '1' AS depth FROM near WHERE near.depth <= 1 UNION SELECT node, '2' FROM near UNION SELECT node, 'unlimited' FROM reach),
    p AS (SELECT dd.depth, count(x.node) AS predicted, count(*) FILTER (WHERE kind = 'user') AS tp FROM dd LEFT JOIN (SELECT * FROM r WHERE node NOT IN (SELECT node FROM seeds)) x ON x.depth = dd.depth
        LEFT JOIN tb ON fn_start = x.node GROUP BY 1),
    g AS (SELECT dd.depth, users.bin, any_value(n) AS n, count(r.node) AS k FROM dd CROSS JOIN users JOIN tb ON tb.bin = users.bin AND kind = 'user' LEFT JOIN r ON r.node = fn_start AND r.depth = dd.depth GROUP BY 1, 2),
    m AS (SELECT depth, median(CAST(k AS DOUBLE) / n) AS median_recall FROM g GROUP BY 1)
    SELECT depth, CAST(predicted AS BIGINT) AS predicted, CAST(tp AS BIGINT) AS tp, CAST(tp AS DOUBLE) / nullif(predicted, 0) AS tp_over_predicted, median_recall FROM p JOIN m USING (depth)""",
)
def _(fx):
    certain, barrier = seeds_and_barrier(fx)
    edges = fx("fx_calls").select(c("caller").alias("src"), c("callee").alias("dst"))
    node = c("fn_start").alias("node")
    reached = graph.bfs(edges, certain.select(node), barrier.select(node), fx("fx_functions").select(node)).select(c("node").alias("fn_start"), "depth")
    inferred = truth.labelled(at_depths(reached.where("depth > 0")), fx("fx_truth")).groupBy("depth")
    x = inferred.agg(F.count("*").alias("predicted"), F.count_if(c("label") == "TP").alias("tp"))
    x = depth_names(reached).join(x, "depth", "left").fillna(0).join(share_by_bin(fx, at_depths(reached), "median_recall"), "depth")
    return x.select("depth", "predicted", "tp", truth.ratio(c("tp"), c("predicted")).alias("tp_over_predicted"), "median_recall")


@query(
    "backtrace_sweep",
    f"""{attribution_sql(1)}, {BACKTRACE(None, False)}, {_walk('near', 'callee', 'caller', 2)}, {TRUTH_BINS},
    r AS (SELECT node, '1' AS depth FROM near WHERE near.depth <= 1 UNION SELECT node, '2' FROM near UNION SELECT node, 'unlimited' FROM back),
    x AS (SELECT * FROM r WHERE node NOT IN (SELECT node FROM seeds) AND node NOT IN (SELECT fn_start FROM attributed WHERE attribution IN ('certain', 'inferred'))),
    p AS (SELECT dd.depth, count(x.node) AS marginal, count(*) FILTER (WHERE kind = 'user') AS tp, count(*) FILTER (WHERE kind <> 'user') AS fp, count(*) FILTER (WHERE x.node IS NOT NULL AND kind IS NULL) AS unknown
        FROM dd LEFT JOIN x ON x.depth = dd.depth LEFT JOIN tb ON fn_start = x.node GROUP BY 1),
    g AS (SELECT dd.depth, users.bin, any_value(n) AS n, count(x.node) AS k FROM dd CROSS JOIN users JOIN tb ON tb.bin = users.bin AND kind = 'user' LEFT JOIN x ON x.node = fn_start AND x.depth = dd.depth GROUP BY 1, 2),
    m AS (SELECT depth, median(CAST(k AS DOUBLE) / n) AS median_gain FROM g GROUP BY 1)
    SELECT depth, CAST(marginal AS BIGINT) AS marginal, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(unknown AS BIGINT) AS unknown, CAST(tp AS DOUBLE) / nullif(tp + fp, 0) AS precision, median_gain FROM p JOIN m USING (depth)""",
)
def _(fx):
    known = attributed(fx, 1).where("attribution IN ('certain', 'inferred')")
    new = materialize(traced(fx, None).join(known, "fn_start", "left_anti").select("fn_start", "depth"), "marginal")
    rows, label = at_depths(new), c("label")
    x = truth.labelled(rows, fx("fx_truth")).groupBy("depth").agg(
        F.count("*").alias("marginal"), *[F.count_if(label == k).alias(n) for k, n in (("TP", "tp"), ("FP", "fp"), ("UNK", "unknown"))]
    )
    x = depth_names(rows).join(x, "depth", "left").fillna(0).join(share_by_bin(fx, rows, "median_gain"), "depth")
    return x.select("depth", "marginal", "tp", "fp", "unknown", truth.ratio(c("tp"), c("tp") + c("fp")).alias("precision"), "median_gain")


# ---- debug info, symbol tables and dumps --------------------------------------------------------------------------


@query(
    "abstract_origin",
    f"""{sql_with('fx_dies')} SELECT a.low_pc AS fn_start, arg_min(coalesce(a.decl_file, b.decl_file), a.cu * 100000000 + a.off) AS decl_file FROM fx_dies a LEFT JOIN fx_dies b ON b.cu = a.cu AND b.off = a.ao
    WHERE a.low_pc IS NOT NULL AND coalesce(a.decl_file, b.decl_file) IS NOT NULL GROUP BY 1""",
)
def _(fx):
    from provspark.sources.dwarf import resolve_origins

    return resolve_origins(fx("fx_dies")).select("fn_start", "decl_file")


@query(
    "debug_path",
    """WITH t AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN '/abs/f.rs' ELSE 'f.rs' END AS f, CASE page_id % 3 WHEN 0 THEN '/dir/' WHEN 1 THEN 'sub' ELSE NULL END AS d, CASE page_id % 2 WHEN 0 THEN '/comp' END AS cd FROM pages)
    SELECT page_id, CASE WHEN starts_with(f, '/') THEN f WHEN d = '/dir/' THEN concat('/dir/', f) WHEN d IS NULL THEN CASE WHEN cd IS NULL THEN f ELSE concat(cd, '/', f) END ELSE CASE WHEN cd IS NULL THEN concat(d, '/', f) ELSE concat(cd, '/', d, '/', f) END END AS path FROM t""",
)
def _(fx):
    p = c("page_id")
    f = F.when(p % 4 == 0, "/abs/f.rs").otherwise("f.rs")
    d = F.when(p % 3 == 0, "/dir/").when(p % 3 == 1, "sub")
    path = F.when(f.startswith("/"), f).otherwise(org.debug_path(f, d, F.when(p % 2 == 0, "/comp")))
    return fx("pages").select("page_id", path.alias("path"))


NM = """nm AS (SELECT o_orderkey AS pos, concat(lpad(lower(hex(4096 + o_custkey * 256)), 16, '0'), ' ', CASE o_orderkey % 4 WHEN 0 THEN 'T' WHEN 1 THEN 't' WHEN 2 THEN 'D' ELSE 'W' END, ' sym::f', CAST(o_orderkey AS {str}), ' as X') AS line FROM orders)"""


def nm_lines(fx) -> DataFrame:
    return fx("orders").selectExpr("o_orderkey AS pos", NM.format(str="STRING").split(", concat", 1)[1].rsplit(" FROM", 1)[0].join(["concat", ""]))


@query("symbol_last_wins", f"WITH {NM.format(str='VARCHAR')} SELECT CAST(('0x' || substr(line, 1, 16)) AS BIGINT) AS fn_start, arg_max(substr(line, 20), pos) AS name FROM nm GROUP BY 1")
def _(fx):
    from provspark.sources.text import parse_symbol_lines

    return parse_symbol_lines(nm_lines(fx), first=False, types=None).select("fn_start", "name")


@query(
    "symbol_first_wins",
    f"WITH {NM.format(str='VARCHAR')} SELECT CAST(('0x' || substr(line, 1, 16)) AS BIGINT) AS fn_start, arg_min(substr(line, 20), pos) AS name FROM nm WHERE substr(line, 18, 1) IN ('T', 't', 'W', 'w', 'V', 'v') AND CAST(('0x' || substr(line, 1, 16)) AS BIGINT) IN (SELECT 4096 + p_partkey * 256 FROM part) GROUP BY 1",
)
def _(fx):
    from provspark.sources.text import parse_symbol_lines

    return parse_symbol_lines(nm_lines(fx), first=True, types="TtWwVv").join(fx("fx_functions"), "fn_start", "left_semi").select("fn_start", "name")


DUMP = sql_with("fx_dumplines")


@query("tier_dump", f"{DUMP} SELECT CAST(split_part(line, chr(9), 2) AS BIGINT) AS fn_start, split_part(line, chr(9), 3) AS tier, CAST(split_part(line, chr(9), 4) AS BIGINT) AS anchor_count FROM fx_dumplines WHERE starts_with(line, 'TIERDUMP')")
def _(fx):
    from provspark.sources.text import read_tier_dump

    return read_tier_dump(fx("fx_dumplines"))


@query(
    "edge_dump",
    f"{DUMP} SELECT CAST(split_part(line, chr(9), 2) AS BIGINT) AS fn_start, CAST(regexp_extract(line, 'user=([0-9]+)', 1) AS BIGINT) AS n_user, CAST(regexp_extract(line, 'std=([0-9]+)', 1) AS BIGINT) AS n_std FROM fx_dumplines WHERE starts_with(line, 'EDGEDUMP')",
)
def _(fx):
    from provspark.sources.text import read_pair_dump

    kv = read_pair_dump(fx("fx_dumplines"), "EDGEDUMP")
    return kv.select("fn_start", *[F.element_at("pairs", k).cast("long").alias(f"n_{k}") for k in ("user", "std")])


@query("dep_dump", f"{DUMP} SELECT DISTINCT replace(split_part(line, chr(9), 2), '-', '_') AS crate FROM fx_dumplines WHERE starts_with(line, 'DEPCRATE')")
def _(fx):
    from provspark.sources.text import read_dep_dump

    return read_dep_dump(fx("fx_dumplines"))


@query("processed_left", f"{sql_with('fx_bench')} SELECT DISTINCT crate FROM fx_bench WHERE crate NOT IN (SELECT crate FROM fx_bench WHERE error IS NULL)")
def _(fx):
    x = fx("fx_bench")
    return x.select("crate").distinct().join(x.where("error IS NULL"), "crate", "left_anti")


@query("binary_category", f"SELECT n_name, {'CASE ' + ' '.join('WHEN s = ' + repr(n) + ' THEN ' + repr(k) for k, v in sym.CATEGORIES.items() for n in v) + chr(32) + 'ELSE ' + repr('cli') + ' END'} AS category FROM (SELECT n_name, CASE n_nationkey % 4 WHEN 0 THEN 'oha' WHEN 1 THEN 'gitui' WHEN 2 THEN 'rage' ELSE 'bat' END AS s FROM nation)")
def _(fx):
    n = c("n_nationkey") % 4
    stem = F.when(n == 0, "oha").when(n == 1, "gitui").when(n == 2, "rage").otherwise("bat")
    return fx("nation").select("n_name", sym.binary_category(stem).alias("category"))
