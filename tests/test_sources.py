"""Readers, parsers and sinks on small files."""

import csv
import datetime as dt
import gzip
import io
import random
import tarfile

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from weekwise.operators import joins
from weekwise.sources import alerts, delimited, files, grids, records


def test_delimited_with_any_encoding(spark, tmp_path):
    text = 'Provincias;"Islas ";Tipo de dato;Periodo;Total\n"Las Palmas";"Lanzarote";Dato base;2020SM01;1.234\nSC;Ñandú €;Dato base;2020SM02;\n\n'
    (tmp_path / "utf.csv").write_bytes("﻿".encode() + text.encode())
    (tmp_path / "old.csv").write_bytes(text.encode("cp1252"))
    for name in ("utf.csv", "old.csv"):
        df = files.read_delimited(spark, str(tmp_path / name), ["Islas", "Periodo", "Total"])
        assert df.columns == ["Provincias", "Islas", "Tipo de dato", "Periodo", "Total"]
        assert [(r.Islas, r.Total) for r in df.orderBy("Periodo").collect()] == [("Lanzarote", "1.234"), ("Ñandú €", None)]
    with pytest.raises(ValueError, match="missing columns"):
        files.read_delimited(spark, str(tmp_path / "utf.csv"), ["Nope"])


def test_title_rows(spark, tmp_path):
    (tmp_path / "s.csv").write_text("Station X;;\nFecha;Hora;PM10\n01/01/2020;1;5\n")
    df = files.read_delimited(spark, str(tmp_path / "s.csv"), ["Fecha"], title_rows=1)
    assert [tuple(r) for r in df.collect()] == [("01/01/2020", "1", "5")]


def test_json_array(spark, tmp_path):
    (tmp_path / "w.json").write_text('[{"fecha":"2020-01-01","tmed":"12,3"},{"fecha":"2020-01-02"}]')
    df = files.read_json_records(spark, str(tmp_path / "w.json"), "fecha STRING, tmed STRING")
    assert [tuple(r) for r in df.orderBy("fecha").collect()] == [("2020-01-01", "12,3"), ("2020-01-02", None)]


def test_latest_match_and_rows(spark, tmp_path):
    for name, v in (("m_2016_2020", 1), ("m_2016_2025", 2)):
        spark.createDataFrame([("a", dt.date(2020, 1, 6), v)], "entity string, week_start date, v int").write.parquet(str(tmp_path / name))
    pattern = f"{tmp_path}/m_*"
    assert files.latest_match(spark, pattern).endswith("m_2016_2025")
    assert [r.v for r in files.read_latest_rows(spark, pattern, ["entity", "week_start"]).collect()] == [2]
    with pytest.raises(Exception):
        files.latest_match(spark, f"{tmp_path}/none_*")


def test_idempotent_sink(spark, tmp_path):
    path = str(tmp_path / "ds")
    df = spark.createDataFrame([(2020, "k1", 1), (2021, "k2", 2)], "year_onset int, chunk_key string, v int")
    files.write_partitioned_idempotent(df, path, resume=True)
    files.write_partitioned_idempotent(df.where("chunk_key = 'k1'").withColumn("v", F.lit(9)), path)
    files.write_partitioned_idempotent(df.withColumn("v", F.lit(0)), path, resume=True)
    got = {r.chunk_key: r.v for r in files.read_chunks(spark, path).collect()}
    assert got == {"k1": 9, "k2": 2}


def test_panel_contract_on_read(spark, tmp_path):
    rows = [("a", dt.date(2020, 1, 6), 1.0), ("a", dt.date(2020, 1, 6), 2.0)]
    spark.createDataFrame(rows, "entity string, week_start date, x double").write.parquet(str(tmp_path / "p"))
    with pytest.raises(ValueError, match="duplicates"):
        files.read_panel(spark, str(tmp_path / "p"))


def test_fixed_width(spark):
    good = "0" * 15 + "202001011200" + "x" * 51 + "016000" + "1N1" + "-0053" + "1" + "+0100" + "5"
    missing = "0" * 15 + "202001011300" + "x" * 51 + "999999" + "9N1" + "+9999" + "9" + "+9999" + "9"
    df = spark.createDataFrame([(good,), (missing,), ("short",), ("",)], "value string")
    out = records.parse_fixed_width(df).orderBy("dt_utc").collect()
    assert [(r.vis_m, r.temp_c, r.dewpoint_c, r.vis_qc) for r in out] == [(16000.0, -5.3, 10.0, 1.0), (None, None, None, 9.0)]


def test_station_sheet(spark):
    rows = [("42370", "24", "10", "1,5", "", "z", "q"), ("31/12/2016", "1", "x", None, "3", "z", "q"), ("bad", "2", "1", "1", "1", "z", "q")]
    df = spark.createDataFrame(rows, ["Fecha", "Hora", "PM10", "PM2.5", "Unnamed: 4", "FECHA", "O3"])
    out = records.normalize_station_sheet(df).orderBy("date").collect()
    assert out[0].asDict() == {"date": dt.date(2016, 1, 1), "hour": 24, "PM10": 10.0, "PM2.5": None, "SO2": None, "NO2": None, "O3": None}
    assert out[1]["PM10"] is None and len(out) == 2


XML = """junk<?xml version="1.0"?><alert xmlns="urn:x"><identifier>A1</identifier><sender>s</sender>
<info><event>Polvo en suspensión</event><severity>Moderate</severity><onset>2020-02-22T00:00:00+00:00</onset>
<area><areaDesc>North</areaDesc></area><area><areaDesc>South</areaDesc></area></info>
<info><event>heat warning</event><severity></severity></info></alert>\x00\x00"""


def test_alerts(spark):
    docs = [("a", XML), ("b", "<alert><identifier>B</identifier></alert>"), ("c", "<alert><identifier>"), ("d", "no xml"),
            ("e", "<cap:alert xmlns:cap='u'><cap:identifier>E</cap:identifier><cap:info><cap:event>x</cap:event></cap:info></cap:alert>")]
    out = alerts.flatten_alerts(spark.createDataFrame(docs, "path string, xml string")).orderBy("path", "info_pos").collect()
    assert [(r.path, r.info_pos, r.identifier, r.event, r.areaDesc) for r in out] == [
        ("a", 0, "A1", "Polvo en suspensión", "North | South"), ("a", 1, "A1", "heat warning", ""), ("b", 0, "B", "", ""), ("e", 0, "E", "x", "")]


def test_archives(spark, tmp_path):
    def tar(members):
        buf = io.BytesIO()
        with tarfile.open(fileobj=buf, mode="w") as t:
            for name, data in members.items():
                info = tarfile.TarInfo(name)
                info.size = len(data)
                t.addfile(info, io.BytesIO(data))
        return buf.getvalue()

    inner = gzip.compress(tar({"i1.xml": b"<alert>1</alert>", "i2.xml": "<alert>ñ</alert>".encode("latin-1")}))
    (tmp_path / "x.tar").write_bytes(tar({"day.tar.gz": inner, "plain.xml": b"<alert>2</alert>"}))
    raw = spark.read.format("binaryFile").load(str(tmp_path / "x.tar"))
    got = {r.member: r.xml for r in alerts.unpack_archives(raw).collect()}
    assert got == {"day.tar.gz::i1.xml": "<alert>1</alert>", "day.tar.gz::i2.xml": "<alert>ñ</alert>", "plain.xml": "<alert>2</alert>"}


def test_files_with_titles_and_repeated_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Station X;\nFecha;v\nStation X;\n1;2\n")
    (tmp_path / "b.csv").write_text("Station Y;\nFecha;v\nFecha;v\n3;4\n")
    df = files.read_delimited(spark, str(tmp_path), ["Fecha"], title_rows=1)
    assert sorted((r.Fecha, r.v) for r in df.collect()) == [("1", "2"), ("3", "4"), ("Fecha", "v"), ("Station X", None)]
    (tmp_path / "c.csv").write_text("Station Z;\nv;Fecha\n1;2\n")
    with pytest.raises(ValueError, match="different headers"):
        files.read_delimited(spark, str(tmp_path), title_rows=1)


def test_chunk_that_loses_a_year(spark, tmp_path):
    path = str(tmp_path / "chunks")
    df = spark.createDataFrame([(1, 2023, "k1"), (2, 2024, "k1"), (3, 2024, "k2")], "v int, year_onset int, chunk_key string")
    files.write_partitioned_idempotent(df, path)
    files.write_partitioned_idempotent(spark.createDataFrame([(9, 2024, "k1")], df.schema), path)
    assert sorted((r.v, r.year_onset, r.chunk_key) for r in files.read_chunks(spark, path).collect()) == [(3, 2024, "k2"), (9, 2024, "k1")]
    # a plain reader tells fillers from rows by the stored mark
    assert sorted(r.v for r in spark.read.parquet(path).where("__row").collect()) == [3, 9]
    with pytest.raises(ValueError, match="__row"):
        files.write_partitioned_idempotent(df.withColumn("__row", F.lit(True)), path)


def test_deep_and_broken_archives(spark):
    def tar(members):
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w") as t:
            for name, data in members:
                info = tarfile.TarInfo(name)
                info.size = len(data)
                t.addfile(info, io.BytesIO(data))
        return out.getvalue()

    deep = b"<alert>deep</alert>"
    for level in range(7):
        deep = gzip.compress(tar([(f"l{level}", deep)]))
    bad = tar([("ok.xml", b"fine"), ("bad.gz", gzip.compress(bytes(range(256)) * 9)[:60]), ("last.xml", b"\xa4 caf\xe9")])
    raw = spark.createDataFrame([("d", bytearray(deep)), ("b", bytearray(bad)), ("n", None)], "path string, content binary")
    got = {(r.path, r.member): (r.xml, r.error) for r in alerts.unpack_archives(raw, batch_bytes=10).collect()}
    assert got[("d", "::".join(f"l{k}" for k in range(6, -1, -1)))] == ("<alert>deep</alert>", None)
    assert got[("b", "ok.xml")] == ("fine", None) and got[("b", "last.xml")] == ("€ café", None) and got[("b", "bad.gz")][1]


def test_archives_are_packed_in_small_batches(spark):
    """Each archive has 20 kB at least, whatever its text: those of all rows of a batch at once were most of a task's memory."""
    from queries import contracts

    texts = [f"<alert>{k}</alert>" for k in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array([str(k) for k in range(300)]), pa.array(texts)], ["path", "text"])
    made = list(contracts.packer(1 << 18)(iter([batch, batch])))
    assert sum(b.num_rows for b in made) == 600 and max(b.nbytes for b in made) < 1 << 19
    members = dict(m[:2] for m in alerts._members(made[0].column(1)[1].as_py()))
    assert members == {"inner.tgz::deep.tgz::t.xml": b"<alert>1</alert>", "plain.xml": b"<alert>1</alert>"}
    plan = contracts.nested_archives(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" not in plan and plan.count("MapInArrow") == 2


def test_headers_of_all_pollutants(spark):
    names = ["Fecha", "HORA", "PM10 (µg/m3)", "PM2,5", "Dióxido de azufre", "NO", "NO2", "NOx", "NO3", "Ozono troposférico", "Norte"]
    got = records.normalize_headers(spark.createDataFrame([tuple("x" * len(names))], names)).columns
    assert got == ["date", "hour", "PM10", "PM2.5", "SO2", "NO", "NO2", "NOx", "NO3", "O3", "Norte"]


def test_exact_headers_go_first(spark):
    names = ["fecha", "NO2_validated", "NO2", "PM2.5 flag 5", "pm2_5", "SO2 raw", "SO2-2", "nox", "NOX "]
    got = records.normalize_headers(spark.createDataFrame([tuple("x" * len(names))], names)).columns
    assert got == ["date", "NO2_validated", "NO2", "PM2.5 flag 5", "PM2.5", "SO2", "SO2-2", "nox", "NOx"]


def test_bucketed_feeds_join_without_a_shuffle(spark, tmp_path, monkeypatch):
    weeks = [dt.date(2024, 1, 1) + dt.timedelta(weeks=k) for k in range(40)]
    rows = [(e, w, i * 40 + k) for i, e in enumerate("abc") for k, w in enumerate(weeks)]
    base = spark.createDataFrame(rows, "entity string, week_start date, v int")
    parts = [base.select("entity", "week_start"), *[base.where(f"v % {m} = 0").withColumnRenamed("v", f"v{m}") for m in (2, 3, 5)]]
    tables = [files.write_feed(df, f"feed_{k}_{tmp_path.name}", buckets=4, path=str(tmp_path / f"f{k}")) for k, df in enumerate(parts)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = joins.build_master(tables[0], tables[1:], ["entity", "week_start"])
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") + plan.count("ShuffledHashJoin") == 3 and "Exchange" not in plan
        got = {(r.entity, r.week_start): (r.v2, r.v3, r.v5) for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for k in range(4):
            spark.sql(f"DROP TABLE feed_{k}_{tmp_path.name}")
    assert got == {(e, w): tuple(v if v % m == 0 else None for m in (2, 3, 5)) for e, w, v in rows}
    assert files.write_feed(base.limit(0), f"none_{tmp_path.name}", buckets=4, path=str(tmp_path / "none")).count() == 0


def test_a_box_reads_few_row_groups(spark, tmp_path):
    rng = np.random.default_rng(4)
    at = [(float(a), float(b)) for a, b in zip(rng.uniform(-90, 90, 40_000), rng.uniform(-180, 180, 40_000))]
    odd = [(10.0, 20.0), (12.5, 25.0), (95.0, 20.0), (float("nan"), 20.0), (None, 20.0), (11.0, None), (11.0, 200.0)]
    rows = [(dt.datetime(2024, 1 + i % 2, 5), a, b, i) for i, (a, b) in enumerate(at + odd)] + [(None, 11.0, 21.0, -1)]
    df = spark.createDataFrame(rows, "time timestamp_ntz, latitude double, longitude double, v long")
    path = str(tmp_path / "grid")
    grids.write_grid(df, path, group_bytes=16_384)
    for box in ((10.0, 20.0, 12.5, 25.0), (-90.0, -180.0, 90.0, 180.0), (5.0, 5.0, 5.0, 5.0), (3.0, 0.0, 2.0, 1.0), (-1.0, -1.0, 1.0, 1.0)):
        south, west, north, east = box
        inside = {r[3] for r in rows if r[1] is not None and r[2] is not None and south <= r[1] <= north and west <= r[2] <= east}
        out = grids.read_grid(spark, path, box)
        assert out.columns == df.columns and sorted(r.v for r in out.collect()) == sorted(inside)
        ranges = grids.box_ranges(box)
        assert len(ranges) <= 32 and ranges == sorted(ranges)
    assert grids.read_grid(spark, path).count() == len(rows)
    january = grids.read_grid(spark, path, (10.0, 20.0, 12.5, 25.0), (202401, 202401))
    assert all(r.time.month == 1 for r in january.collect())
    # row groups whose codes meet the box, of all row groups
    ranges, groups = grids.box_ranges((10.0, 20.0, 12.5, 25.0)), []
    for file in tmp_path.glob("grid/*/*.parquet"):
        meta = pq.ParquetFile(file).metadata
        place = meta.schema.names.index(grids.CODE)
        groups += [meta.row_group(g).column(place).statistics for g in range(meta.num_row_groups)]
    met = sum(any(s.min <= b and s.max >= a for a, b in ranges) for s in groups if s.has_min_max)
    assert "GreaterThanOrEqual(grid_code" in january._jdf.queryExecution().toString()  # the ranges reach the scan
    assert len(groups) >= 8 and met <= len(groups) / 4
    with pytest.raises(ValueError, match="grid_code"):
        grids.write_grid(df.withColumn("grid_code", F.lit(1)), path)


def _random_csv(rng, kind):
    """Rows with quoted separators, quotes and line ends, and the bytes of a file that holds them below a title and a header."""
    rows = [[rng.choice(["", "a", "ñandú", "x;y", 'say "so"', "two\nlines", "\n\n", "cr\r\nlf", "z" * rng.randint(1, 60)]) for _ in range(3)] for _ in range(rng.randint(0, 12))]
    out = io.StringIO(newline="")
    csv.writer(out, delimiter=";", quoting=csv.QUOTE_ALL, lineterminator=rng.choice(["\n", "\r\n"])).writerows([["Title", "", ""], ["k", "mid;dle", "v"], *rows])
    data = out.getvalue().encode(kind)
    return [tuple(x or None for x in r) for r in rows], data if rng.random() < 0.5 else data.rstrip(b"\r\n")


@pytest.mark.parametrize(("range_bytes", "block_bytes"), [(7, 5), (64, 16), (1 << 20, 1 << 20)])
def test_quoted_line_breaks_across_ranges(spark, tmp_path, range_bytes, block_bytes, monkeypatch):
    rng, expected = random.Random(range_bytes), []
    for i in range(12):
        rows, data = _random_csv(rng, ["utf-8", "utf-8-sig", "cp1252"][i % 3])
        (tmp_path / f"f {i}.csv").write_bytes(data)
        expected += rows
    (tmp_path / "p.csv.gz").write_bytes(gzip.compress(data))
    (tmp_path / "empty.csv").write_bytes(b"")
    monkeypatch.setattr(files, "read_records", lambda *a: delimited.read_records(*a[:-1], range_bytes, block_bytes))
    df = files.read_delimited(spark, str(tmp_path), ["k", "v"], title_rows=1, multi_line=True)
    assert df.columns == ["k", "mid;dle", "v"]
    order = lambda rows: sorted(rows, key=str)
    assert order(tuple(r) for r in df.collect()) == order(expected + rows)


def test_ranges_of_lines(spark, tmp_path):
    """Line by line a stray quote harms its line only, ranges agree with the whole, and the plan holds no join."""
    rng = random.Random(1)
    lines = [f"{i};{rng.choice(['5 in', 'é', '', 'w' * 40])}{rng.choice(['', chr(34)])}" for i in range(200)]
    (tmp_path / "a.csv").write_bytes("\r\n".join(["k;v", *lines]).encode("latin-1"))
    (tmp_path / "mac.csv").write_bytes("\r".join(["k;v", "900;x", "901;y"]).encode())
    found = []
    for size in (11, 300, 1 << 20):
        df = files.read_delimited(spark, str(tmp_path / "*.csv"), range_bytes=size)
        found.append(sorted((int(r.k), r.v) for r in df.collect()))
    assert found[0] == found[1] == found[2]
    assert [k for k, _ in found[0]] == [*range(200), 900, 901]
    assert df.rdd.getNumPartitions() == 1
    assert "Join" not in df._jdf.queryExecution().toString()
    small = files.read_delimited(spark, str(tmp_path / "a.csv"), range_bytes=300, encoding="latin-1")
    assert small.rdd.getNumPartitions() > 5


def test_encoding_by_file(spark, tmp_path):
    """One byte that only Latin-1 knows decides for its whole file; undefined UTF-8 late in a file does as well."""
    (tmp_path / "a.csv").write_bytes(b"v\n\x80\n" + b"x\n" * 50 + b"\x81\n")
    (tmp_path / "b.csv").write_bytes(b"v\n\xc3\xb1\n" + b"y\n" * 50 + b"\x80\n")
    df = files.read_delimited(spark, str(tmp_path), range_bytes=20)
    assert sorted({r.v for r in df.collect()} - {"x", "y"}) == ["\x80", "\x81", "Ã±", "€"]
