"""Recovered type names: identifier loads near small constants, by function run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from provspark.functions.symbols import has_std_prefix, is_camel_case, is_snake_case
from provspark.operators.joins import asof_containing

LOADS = 6


def runs(instructions: DataFrame, functions: DataFrame, by: list[str]) -> DataFrame:
    """Instructions inside functions, plus run_id: it grows when the function changes in address order.

    Those outside every function are dropped and do not end a run.
    """
    inside = asof_containing(instructions, functions.select(*by, "fn_start", "fn_end"), "ip", "fn_start", "fn_end", by)
    w = W.partitionBy(*by).orderBy("ip")
    changed = F.coalesce((F.lag("fn_start").over(w) != F.col("fn_start")).cast("long"), F.lit(0))
    return inside.withColumn("__changed", changed).withColumn("run_id", F.sum("__changed").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("__changed")


def load_constant_pairs(in_runs: DataFrame, by: list[str], loads: int = LOADS) -> DataFrame:
    """Each `mov` of 2 to 100 with the last `loads` `lea`s of its run: (by.., run_id, fn_start, mov_ip, lea_ip, target, imm)."""
    w = W.partitionBy(*by, "run_id").orderBy("ip").rowsBetween(W.unboundedPreceding, 0)
    counted = in_runs.withColumn("__n", F.count(F.when(F.col("op") == "lea", 1)).over(w))
    movs = counted.where((F.col("op") == "mov") & F.col("imm").between(2, 100) & (F.col("__n") > 0))
    movs = movs.select(*by, "run_id", "fn_start", F.col("ip").alias("mov_ip"), "imm", F.explode(F.sequence(F.greatest(F.lit(1), F.col("__n") - (loads - 1)), F.col("__n"))).alias("__n"))
    leas = counted.where("op = 'lea'").select(*by, "run_id", "__n", F.col("ip").alias("lea_ip"), "target")
    return movs.join(leas, [*by, "run_id", "__n"]).drop("__n")


# Names of standard types, which are never taken as the author's.
STD_TYPES = (
    "Option Result Ordering Range RangeFrom RangeTo RangeFull RangeInclusive Pin ManuallyDrop PhantomData Formatter Arguments "
    "DebugStruct DebugTuple DebugList DebugSet DebugMap Error Vec String Box Arc Rc Cow HashMap HashSet BTreeMap BTreeSet LinkedList "
    "VecDeque Mutex RwLock Condvar Thread ThreadId OnceLock Once Path PathBuf OsStr OsString File Stdin Stdout Visitor Expected Context "
).split()


def type_names(idents: DataFrame, attributed: DataFrame, by: list[str], std_types: list[str] | None = None) -> DataFrame:
    """(by.., struct_name, fields, tier, fn_start) from (by.., fn_start, ident).

    A function needs a camel-case name that is no standard type and a
    snake-case one; the first camel-case name in the alphabet is the type.
    """
    known = std_types if std_types is not None else STD_TYPES
    ident = F.col("ident")
    named = idents.groupBy(*by, "fn_start").agg(
        F.min(F.when(is_camel_case(ident) & ~ident.isin(known), ident)).alias("struct_name"),
        F.sort_array(F.collect_set(F.when(is_snake_case(ident), ident))).alias("fields"),
    )
    named = named.where(F.col("struct_name").isNotNull() & (F.size("fields") > 0))
    out = named.join(attributed.select(*by, "fn_start", "attribution"), [*by, "fn_start"], "left")
    tier = F.when(has_std_prefix(F.col("struct_name")) | F.col("struct_name").isin(known), "std").when(F.col("attribution").isin("certain", "inferred"), "user").otherwise("non-std")
    return out.select(*by, "struct_name", "fields", tier.alias("tier"), "fn_start")
