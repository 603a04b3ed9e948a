import io
import json
import os
import sys

import pytest
from fixtures import ct, dx, sc
from pyspark.sql import functions as F

from lumenframe import cli
from lumenframe.functions import columns as cl
from lumenframe.functions import tsyntax as ts
from lumenframe.operators import pixels as px
from lumenframe.operators import sqlfunctions, tables
from lumenframe.sources import io as sio
from lumenframe.sources import objects as ob
from lumenframe.streaming import ingest


J2K = min(ts.JPEG2000)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("objects")
    for name, o in (("dx.dcm", dx()), ("ct.dcm", ct()), ("sc.dcm", sc())):
        (d / name).write_bytes(ob.write(o))
    (d / "bad.dcm").write_bytes(b"just a few words of text")
    return str(d)


def test_elements_keep_errors(spark, folder):
    e = tables.elements(sio.read_objects(spark, folder).select("path", "content"))
    assert e.where("error_code is not null").select(F.regexp_extract("path", "[^/]+$", 0).alias("p")).collect()[0].p == "bad.dcm"
    got = {r.p: r.v for r in e.where("keyword = 'Modality'").select(F.regexp_extract("path", "[^/]+$", 0).alias("p"), F.col("str_values")[0].alias("v")).collect()}
    assert got == {"dx.dcm": "DX", "ct.dcm": "CT", "sc.dcm": "OT"}
    assert e.where("item_path like '00400275[_]%'").count() == 2
    with pytest.raises(Exception, match="bad|preamble|meta"):
        tables.elements(sio.read_objects(spark, folder), mode="FAILFAST").count()


def test_plans_do_not_shuffle(spark, folder):
    df = sio.read_objects(spark, folder).select("path", "content")
    for x in (tables.elements(df), tables.wide(df, ["Modality"]), tables.frames(df), df.select(tables.transcode(F.col("content"), ts.RLE))):
        assert "Exchange" not in x._jdf.queryExecution().toString()
    pruned = sio.read_objects(spark, folder).where("length > 10").select("path", "length")
    plan = pruned._jdf.queryExecution().toString()
    assert "content" not in plan.split("ReadSchema")[-1] and "PushedFilters: [IsNotNull(length), GreaterThan(length" in plan


def test_frames_renders_and_errors(spark, folder):
    df = sio.read_objects(spark, folder).select(F.regexp_extract("path", "[^/]+$", 0).alias("name"), "content")
    f = tables.frames(df)
    assert {(r.name, r.frame_index) for r in f.where("error_code is null").collect()} == {("dx.dcm", 0), ("ct.dcm", 0), ("ct.dcm", 1), ("sc.dcm", 0)}
    assert sorted((r.name, len(r.content)) for r in sio.raw_objects(f.where("error_code is null"), "name").collect()) == [("ct.dcm", 1024), ("dx.dcm", 2560), ("sc.dcm", 189)]
    r = tables.render(df, options=px.Options(max_size=8), all_frames=True).where("error_code is null")
    assert {(x.name, x.width, x.height) for x in r.collect()} == {("dx.dcm", 8, 6), ("ct.dcm", 8, 8), ("sc.dcm", 6, 8)}
    assert r.where("bytes is null").count() == 0


def test_columns_of_content(spark, folder):
    df = sio.read_objects(spark, folder).select("path", "content").where("path not like '%bad%'")
    j = df.select("path", "content", tables.to_json_doc(F.col("content"), bulk="uri")["value"].alias("doc"))
    back = j.select("path", tables.from_json_doc(F.col("doc"), source=F.col("content"))["value"].alias("content"))
    a, b = (x.groupBy("path").count().count() for x in (tables.elements(df), tables.elements(back)))
    assert a == b == 3
    r = df.select(tables.redact(F.col("content"), ["0,0,4,4"], target=J2K).alias("r"))
    assert {x.r.code for x in r.collect()} == {"UnsupportedTargetTransferSyntax"}
    with pytest.raises(Exception, match="expected KEY=VALUE"):
        tables.override(F.col("content"), ["nope"])


def test_sql_functions(spark, folder):
    sqlfunctions.register(spark)
    sio.read_objects(spark, folder).createOrReplaceTempView("objects")
    n = spark.sql("SELECT count(*) AS n FROM objects, LATERAL dicom_elements(content) e WHERE e.keyword = 'Rows'").first().n
    assert n == 3
    t = spark.sql(f"SELECT dicom_json(dicom_transcode(content, '{ts.IMPLICIT_LE}')) AS d FROM objects WHERE path LIKE '%dx.dcm'").first().d
    assert json.loads(t)["TransferSyntaxUID"] == ts.IMPLICIT_LE


def test_path_list_and_files(spark, folder, tmp_path):
    lines = spark.createDataFrame([(f" {folder}/dx.dcm ",), ("",), (f"{folder}/missing.dcm",)], "value string")
    df = sio.read_path_list(spark, lines)
    assert sorted((r.content is None, r.error_message is None) for r in df.collect()) == [(False, True), (True, False)]
    out = sio.write_files(df.where("content is not null").withColumn("out_path", F.lit(f"{tmp_path}/x/y.dcm"))).collect()
    assert out[0].n_bytes == os.path.getsize(f"{tmp_path}/x/y.dcm") and os.listdir(f"{tmp_path}/x") == ["y.dcm"]
    with pytest.raises(ValueError):
        sio.require_all(df, "error_message")
    with pytest.raises(ValueError):
        sio.write_video()


def test_stream(spark, folder, tmp_path):
    q = ingest.to_parquet(ingest.stream_documents(spark, folder, glob="*.dcm"), f"{tmp_path}/out", f"{tmp_path}/check")
    q.awaitTermination(120)
    rows = spark.read.parquet(f"{tmp_path}/out").collect()
    assert len(rows) == 4 and sum(r.value is not None for r in rows) == 3


def test_column_details(spark):
    r = spark.range(1).select(
        cl.split_multi(F.lit("")).alias("none"), cl.split_multi(F.lit("a\\\\b")).alias("gap"), cl.first_number(F.lit(" 1.5\\x")).alias("x"), cl.first_number(F.lit("1.0d")).alias("d"), cl.normalize_uid(F.lit("1.2 \0")).alias("uid"),
        cl.bulk_uri_part(F.lit("?offset=1&length=x"), "length").alias("bad"), cl.frame_path(F.lit("a.b/c"), F.lit(1)).alias("p"),
        cl.bulk_reference(F.lit(1), F.lit(2), F.lit(bytearray(b"abcd"))).alias("inline"), cl.bulk_reference(F.lit(0), F.lit(33), F.lit(bytearray(40))).alias("far"),
    ).first()
    assert (r.none, r.gap, r.x, r.d, r.uid, r.bad, r.p, r.inline, r.far) == ([], ["a", "", "b"], 1.5, None, "1.2", None, "a.b/c_000001", "YmM=", "?offset=0&length=33")


def test_command_line(folder, tmp_path, capsysbinary, monkeypatch):
    run = lambda *a: cli.main(list(map(str, a)))
    assert run(f"{folder}/dx.dcm") == 0
    assert "BulkDataURI" in json.loads(capsysbinary.readouterr().out)["PixelData"]
    assert run(f"{folder}/dx.dcm", tmp_path / "o.json", "--bulk-data", "inline", "--set", "PatientID=7") == 0
    assert run(tmp_path / "o.json", tmp_path / "o.dcm", "--transfer-syntax", ts.RLE) == 0
    assert ob.parse((tmp_path / "o.dcm").read_bytes()).text(0x00100020) == "7"
    assert run(tmp_path / "o.dcm", "--overwrite", "--remove", "PatientID") == 0
    assert ob.parse((tmp_path / "o.dcm").read_bytes()).text(0x00100020) is None
    assert run(f"{folder}/ct.dcm", tmp_path / "f.png", "--render-all-frames") == 0 and (tmp_path / "f_000002.png").exists()
    assert run("--list-transfer-syntaxes") == 0
    for bad in ((f"{folder}/dx.dcm", tmp_path / "x.json", "--window-center", "3"), (f"{folder}/dx.dcm", tmp_path / "x.dcm", "--overwrite"), (tmp_path / "o.json", tmp_path / "x.png"), (f"{folder}/dx.dcm", tmp_path / "x.mp4"), (f"{folder}/bad.dcm",)):
        assert run(*bad) == 1
    monkeypatch.setattr(sys, "stdin", io.StringIO(f"{folder}/dx.dcm\n\n{folder}/missing.dcm\n"))
    assert run("-I") == 1


def test_elements_of_some_keywords(spark):
    from lumenframe.plans import tables as tb
    from lumenframe.operators import tables

    o = tb.order_objects(spark, "/root/testdata/sf0.001").limit(20)
    names = ["PatientID", "CodeValue", "SelectorFDValue"]
    every = tables.elements(o).where(tables.F.col("keyword").isin(names)).collect()
    assert sorted(map(str, tables.elements(o, keywords=names).collect())) == sorted(map(str, every)) and every


def test_bulk_of_odd_texts(spark, tmp_path):
    import duckdb

    from lumenframe.plans import registry

    texts = [None, "", "a", "x" * 31, "x" * 32, "x" * 33, "é" * 16, "é" * 17, "a\0", "\0" * 40, '"\\\n' * 20, "日本" * 9000, "y" * (1 << 21)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    d.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(f"SELECT doc_id, kind, length, same FROM ({registry.ORACLE_SQL['bulk_inline_or_uri']})").fetchall()
    assert sorted(want) == sorted((r.doc_id, r.kind, r.length, r.same) for r in registry.QUERIES["bulk_inline_or_uri"](spark, str(tmp_path)).collect())


def test_frames_come_in_few_batches(spark):
    import pyarrow as pa

    class Plan:
        columns, schema = ["content"], ()
        select = lambda self, *_: self
        mapInArrow = lambda self, work, _: work

    a = pa.RecordBatch.from_arrays([pa.array([ob.write(sc())] * 50 + [b"bad"], pa.binary())], names=["content"])
    for f in (tables.frames, tables.render, tables.pixel_values):
        got = list(f(Plan())(iter([a])))
        assert sum(b.num_rows for b in got) == 51 and len(got) == 1
    big = pa.RecordBatch.from_arrays([pa.array([ob.write(dx(512, 512))] * 9, pa.binary())], names=["content"])
    assert max(b.nbytes for b in tables.frames(Plan())(iter([big]))) < 4 << 20
