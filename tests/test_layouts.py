"""Files with unlike layouts: one union, one job over the footers."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outagekit.operators import intervals as iv
from outagekit.operators import quality as dq
from outagekit.sources import io as sio
from outagekit.sources import layouts as L

DAY = dt.datetime(2024, 3, 5, 6, 7, 8)


def test_union_of_raw_processed_and_month_folders(spark, tmp_path):
    typed = spark.createDataFrame([(1, 2.5, DAY, "a", None), (2, None, None, None, True)],
                                  "Id long, v double, t timestamp_ntz, s string, b boolean")
    sio.bronze_as_string(typed).write.parquet(str(tmp_path / "raw"))
    spark.createDataFrame([("x", "no number", "2024-13-45", "z")], "ID string, v string, t string, extra string").write.parquet(
        str(tmp_path / "raw" / "later"))
    sio.write_month_partition(typed.where("Id = 1"), str(tmp_path / "months"), "t")
    typed.selectExpr("cast(Id as int) as id", "cast(v as float) as v").write.parquet(str(tmp_path / "months" / "ano=__HIVE_DEFAULT_PARTITION__"))
    one = str(tmp_path / "one.parquet")
    typed.limit(1).coalesce(1).write.parquet(one)
    part = [f for f in os.listdir(one) if f.endswith(".parquet")][0]
    paths = [str(tmp_path / "raw"), str(tmp_path / "months"), f"{tmp_path}/./months/", f"{one}/{part}", f"file://{one}/{part}"]
    out = L.scan_layouts(spark, paths[:4])
    assert {f.name.lower(): f.dataType.simpleString() for f in out.schema.fields} == {
        "id": "bigint", "v": "double", "t": "timestamp_ntz", "s": "string", "b": "boolean", "extra": "string", "ano": "string", "mes": "string"}
    rows = sorted((tuple(r[c] for c in ("id", "v", "t", "s", "b", "extra", "ano", "mes")) for r in out.toDF(*map(str.lower, out.columns)).collect()), key=repr)
    assert rows == sorted([
        (1, 2.5, DAY, "a", None, None, None, None), (2, None, None, None, True, None, None, None),  # raw
        (None, None, None, None, None, "z", None, None),  # raw, nothing of which is a value
        (1, 2.5, DAY, "a", None, None, "2024", "03"),
        (1, 2.5, None, None, None, None, None, None), (2, None, None, None, None, None, None, None),
        (1, 2.5, DAY, "a", None, None, None, None)], key=repr)
    flat = L.scan_layouts(spark, [str(tmp_path / "raw")], recursive=False)
    assert flat.count() == 2 and "extra" not in flat.columns


def test_what_cannot_be_read_is_an_error(spark, tmp_path):
    (tmp_path / "bad.parquet").write_bytes(b"PAR1 no parquet")
    with pytest.raises(OSError, match="bad.parquet"):
        L.scan_layouts(spark, [str(tmp_path)])
    os.makedirs(tmp_path / "none")
    with pytest.raises(FileNotFoundError):
        L.scan_layouts(spark, [str(tmp_path / "none")])


@pytest.mark.parametrize("types, want", [
    (["int", "bigint"], "bigint"), (["string", "int", "smallint"], "int"), (["decimal(10,2)", "int"], "decimal(21,2)"),
    (["decimal(10,2)", "decimal(12,4)"], "decimal(12,4)"), (["float", "bigint"], "double"), (["date", "timestamp_ntz"], "timestamp_ntz"),
    (["string", "date"], "date"), (["boolean", "int"], "string"), (["string"], "string"), (["void", "int"], "int"), (["void"], "string"),
    (["array<int>", "string"], "array<int>"), (["date", "int", "string"], "string")])
def test_agreed_types(types, want):
    assert L.agreed_type([T._parse_datatype_string(t) for t in types]).simpleString() == want


def _jobs(spark, group: str, run) -> int:
    sc = spark.sparkContext
    sc.setJobGroup(group, group)
    try:
        run()
    finally:
        sc.setJobGroup("", "")
    return len(sc.statusTracker().getJobIdsForGroup(group))


def test_jobs_do_not_grow_with_the_files(spark, tmp_path):
    spec = "NUM_UC_UCI string, NUM_INTRP_INIC_MANOBRA_UCI string, NUM_INTRP_UCI string, DTHR_INICIO_INTRP_UC timestamp_ntz, DATA_HORA_FIM_INTRP timestamp_ntz"
    row = spark.createDataFrame([("A", "m", "1", DAY, DAY)], spec)
    import shutil

    row.coalesce(1).write.parquet(str(tmp_path / "w"))
    row.drop("NUM_UC_UCI").coalesce(1).write.parquet(str(tmp_path / "x"))
    first = {n: [str(f) for f in (tmp_path / n).glob("part*.parquet")][0] for n in "wx"}
    files = [str(tmp_path / f"{n}{i}.parquet") for i in range(40) for n in "wx"]
    for f in files:
        shutil.copy(first[os.path.basename(f)[0]], f)
    contract = T.StructType([T.StructField("NUM_UC_UCI", T.StringType()), T.StructField("NUM_INTRP_UCI", T.LongType())])
    check = lambda n: dq.schema_check_inputs(spark, files[:n], contract).collect()
    marks = lambda n: iv.mark_inputs(spark, files[:n])[1].collect()
    # both above the number of paths from which Spark lists them in a job of its own
    assert _jobs(spark, "c80", lambda: check(80)) <= _jobs(spark, "c70", lambda: check(70)) < 15
    assert _jobs(spark, "m80", lambda: marks(80)) <= _jobs(spark, "m70", lambda: marks(70)) < 25
    got = check(80)
    assert len(got) == 160 and {(r.status, r.arquivo[-12:][0] in "x") for r in got}
    assert {os.path.basename(r.arquivo)[0]: r.status for r in got} == {"w": "ok", "x": "colunas_ausentes"}
    status = marks(80)
    assert len(status) == 80 and all((r.status, r.total) == (("ok", 1) if "/w" in r.arquivo[-14:] else ("colunas_ausentes", 0)) for r in status)


def test_a_scheme_the_workers_cannot_open_is_read_by_spark(spark, tmp_path, monkeypatch):
    spark.range(3).coalesce(1).write.parquet(str(tmp_path / "a.parquet"))

    def unopened():
        def footers(batches):
            import pyarrow as pa

            for b in batches:
                n = b.num_rows
                yield pa.RecordBatch.from_arrays([b.column(0), pa.nulls(n, pa.string()), pa.nulls(n, pa.string())], names=["p", "k", "w"])
        return footers

    monkeypatch.setattr(L, "_footers", unopened)
    found, failed = L.layouts(spark, [str(tmp_path / "a.parquet"), str(tmp_path / "gone.parquet")])
    assert [f.schema.names for f in found] == [["id"]] and [p for p, _ in failed] == [str(tmp_path / "gone.parquet")]


def test_inputs_without_rows_are_tested(spark, tmp_path):
    spark.createDataFrame([], "a string").write.parquet(str(tmp_path / "e.parquet"))
    got = dq.schema_check_inputs(spark, [str(tmp_path / "e.parquet")], T._parse_datatype_string("a int, z int")).collect()
    assert [(r.coluna, r.presente, r.nao_convertiveis, r.status) for r in sorted(got, key=lambda r: r.coluna)] == [
        ("a", True, 0, "colunas_ausentes"), ("z", False, None, "colunas_ausentes")]
    assert dq.schema_check_inputs(spark, [str(tmp_path / "e.parquet")], T._parse_datatype_string("a int")).where(F.col("status") == "ok").count() == 1
