"""Image queries on many and far keys: what bounds their memory, and addresses that 4 bytes don't reach."""

import re
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from provspark.plans import images
from provspark.session import scratch
from provspark.sources import image as im
from provspark.sources import tables, x86


def write(folder, name, **columns):
    kinds = {k: pa.int32() if k in ("p_size", "l_linenumber") else pa.string() if k == "path" else pa.int64() for k in columns}
    pq.write_table(pa.table({k: pa.array(v, kinds[k]) for k, v in columns.items()}), folder / f"{name}.parquet")


def compare(spark, folder, name):
    import duckdb

    con = duckdb.connect()
    for f in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    want = con.execute(images.ORACLES[name])
    columns = [d[0] for d in want.description]
    with scratch():
        got = [tuple(r) for r in images.QUERIES[name](spark, str(folder)).select(*columns).collect()]
    rows = want.fetchall()
    assert rows and sorted(map(str, got)) == sorted(map(str, rows))


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().sparkPlan().toString()


def no_files(spark):
    return spark.createDataFrame([], "path string, content binary")


# F1


def test_call_edges_of_a_function_with_more_code_than_its_room(spark, tmp_path):
    n = 700
    write(tmp_path, "lineitem", l_partkey=[3] * n + [4], l_orderkey=[*range(n), 1], l_linenumber=[1 + i % 7 for i in range(n)] + [2], l_suppkey=[i % 50 for i in range(n)] + [9])
    compare(spark, tmp_path, "image_call_edges")


def test_stored_images_are_read_a_few_at_a_time(spark, tmp_path):
    write(tmp_path, "lineitem", l_partkey=[images.PARTS * i for i in range(20)], l_orderkey=[1] * 20, l_linenumber=[1] * 20, l_suppkey=[1] * 20)
    with scratch():
        files = images.code_images(lambda t: spark.read.parquet(f"{tmp_path}/{t}.parquet")).inputFiles()
        sizes = [m.row_group(i).num_rows for f in files for m in [pq.ParquetFile(re.sub("^file:/+", "/", f)).metadata] for i in range(m.num_row_groups)]
    assert sum(sizes) == 20 and max(sizes) <= 8


def test_functions_move_no_content_and_edges_are_not_broadcast(spark):
    files = no_files(spark)
    assert "Join" not in plan(tables.functions(files))[0]
    assert "SortMergeJoin" in plan(tables.call_edges(tables.instructions(files), tables.functions(files)))[1]


# F2


def test_fillers_are_passed_in_runs(monkeypatch):
    steps, step = [], x86._step
    monkeypatch.setattr(x86, "_step", lambda *a: steps.append(1) or step(*a))
    code = b"\x90" * 5000 + im.call(6000, 7000) + b"\xcc\x90" * 300 + im.load_address(9000, 9100) + b"\x66\x90\xc3" + b"\x90" * 7
    assert [(op, size) for _, size, op, _, _ in x86.decode(code, 1000)] == [("call", 5), ("lea", 7)]
    assert len(steps) == 4
    assert list(x86.decode(b"\x90" * 9 + im.call(9, 0), 0, 0, 9)) == []


# F5


def test_instruction_batches_hold_many_functions():
    code = im.load_address(0, 64)
    source = pa.RecordBatch.from_pydict({"binary_id": ["a"] * 1000, "fn_start": range(1000), "fn_end": range(1000), "code": [code] * 1000})
    found = list(tables._function_decoder(iter([source, source])))
    assert [b.num_rows for b in found] == [2000]


# F3, F4, tests of both


@pytest.mark.parametrize("make", [tables.locations, tables.source_strings])
def test_slots_are_decoded_once_and_not_joined(spark, make):
    text = plan(make(no_files(spark)))[0]
    assert "Join" not in text and text.lower().count("mapinarrow") == 1


def test_first_slot_decides_before_it_is_checked(spark):
    """The first slot of an address has a wrong length, so that its text is none, for the second slot too."""
    ro = b"src/a.rs" + b"src/b.rs"
    slots = [(0x3000, 0x2000, 5), (0x3018, 0x2000, 8), (0x3030, 0x2008, 8), (0x3048, 0x2008, 7)]
    data = b"".join(b"\0" * 8 + n.to_bytes(8, "little") + (9).to_bytes(4, "little") + (1).to_bytes(4, "little") for _, _, n in slots)
    file = im.image({".text": (0x1000, b"\xc3"), ".rodata": (0x2000, ro), ".data.rel.ro": (0x3000, data), ".rela.dyn": (0x4000, im.relocation_table((a, 8, b) for a, b, _ in slots))})
    files = spark.createDataFrame([("a", bytearray(file))], "path string, content binary")
    assert [tuple(r) for r in tables.source_strings(files).collect()] == [("a", 0x2008, "src/b.rs")]
    assert [(r["struct_vaddr"], r["file"], r["line"]) for r in tables.locations(files).collect()] == [(0x3030, "src/b.rs", 9)]


# F6, F7, F8, F9


@pytest.mark.parametrize("name", ["image_frames", "image_functions", "image_header_starts", "image_symbols"])
def test_keys_beyond_four_byte_offsets(spark, tmp_path, name):
    keys = [0, 1, 511, 512, 1_199_999, 300_000_000]
    write(tmp_path, "part", p_partkey=keys, p_size=[1, 2, 3, 4, 5, 6])
    compare(spark, tmp_path, name)
