"""Bad CSV records: the good ones are read, the others counted by file."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outagekit.sources import io as sio


def write(tmp_path, name, text):
    path = tmp_path / name
    path.write_bytes(text.encode())
    return str(path)


def report(tagged):
    return {r.arquivo.rsplit("/", 1)[1]: (r.lidos, r.rejeitados, r.exemplo) for r in sio.reject_report(tagged).collect()}


def test_ragged_records_of_text_columns(spark, tmp_path):
    write(tmp_path, "a.csv", 'id,nome,v\n1,um,1.5\n2,dois\n3,"a, b",2.5\n4,x,1,2,3\n\n5,,\n')
    write(tmp_path, "b.csv", "id,nome,v\n6,seis,6\n")
    write(tmp_path, "c.csv", "id,nome,v\n")
    tagged = sio.load_csv_tagged(spark, str(tmp_path))
    good = sio.good_records(tagged)
    assert good.columns == ["id", "nome", "v"]
    assert sorted((r.id, r.nome, r.v) for r in good.collect()) == [
        ("1", "um", "1.5"), ("3", "a, b", "2.5"), ("5", None, None), ("6", "seis", "6")]
    assert report(tagged) == {"a.csv": (3, 2, "2,dois"), "b.csv": (1, 0, None)}


def test_a_record_is_judged_whole_whatever_is_selected(spark, tmp_path):
    tagged = sio.load_csv_tagged(spark, write(tmp_path, "a.csv", "id,nome,v\n1,um,1.5\n2,dois\n3,tres,x,y\n"),
                                 T.StructType.fromDDL("id int, nome string, v double"))
    good = sio.good_records(tagged)
    assert good.select("id").collect() == good.select("id", "nome", "v").select("id").collect()
    assert good.count() == len(good.collect()) == 1


def test_fields_of_the_wrong_type(spark, tmp_path):
    path = write(tmp_path, "t.csv", "id,quando,v\n1,2024-01-01 00:00:00,1.0\nx,2024-01-01 00:00:00,1.0\n2,ontem,1.0\n3,,\n4,2024-01-02 00:00:00,1;0\n")
    tagged = sio.load_csv_tagged(spark, path, T.StructType.fromDDL("id int, quando timestamp_ntz, v double"))
    assert sorted(r.id for r in sio.good_records(tagged).collect()) == [1, 3]
    assert report(tagged)["t.csv"][:2] == (2, 3)


def test_quoted_line_breaks(spark, tmp_path):
    text = 'id,nome\n1,"linha um\nlinha dois"\n2,"diz ""oi"""\n3\n4,fim\n'
    path = write(tmp_path, "q.csv", text)
    tagged = sio.load_csv_tagged(spark, path, line_breaks=True)
    assert {r.id: r.nome for r in sio.good_records(tagged).collect()} == {
        "1": "linha um\nlinha dois", "2": 'diz "oi"', "4": "fim"}
    assert report(tagged)["q.csv"][:2] == (3, 1)


def test_a_quote_never_closed_is_one_bad_record(spark, tmp_path):
    write(tmp_path, "bad.csv", 'id,nome,v\n1,um,1\n2,"dois,2\n3,tres,3\n')
    write(tmp_path, "ok.csv", "id,nome,v\n7,sete,7\n")
    tagged = sio.load_csv_tagged(spark, str(tmp_path), line_breaks=True)
    assert sorted(r.id for r in sio.good_records(tagged).collect()) == ["1", "7"]
    assert report(tagged)["bad.csv"][:2] == (1, 1)
    by_line = sio.load_csv_tagged(spark, str(tmp_path))
    assert sorted(r.id for r in sio.good_records(by_line).collect()) == ["1", "3", "7"]


def test_empty_folder_needs_a_schema(spark, tmp_path):
    path = write(tmp_path, "e.csv", "")
    tagged = sio.load_csv_tagged(spark, path, T.StructType.fromDDL("a int"), header=False)
    assert sio.good_records(tagged).count() == 0 and sio.reject_report(tagged).count() == 0
    with pytest.raises(ValueError):
        sio.load_csv_tagged(spark, path, header=False)


def test_report_is_one_aggregate(spark, tmp_path):
    for i in range(40):
        write(tmp_path, f"f{i}.csv", f"id,v\n{i},1\n{i}\n")
    rep = sio.reject_report(sio.load_csv_tagged(spark, str(tmp_path)))
    assert rep.agg(F.sum("lidos"), F.sum("rejeitados")).first()[:] == (40, 40)
    plan = rep._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan csv") == 1 and plan.count("Exchange hashpartitioning(") == 1
