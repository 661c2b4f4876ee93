import sqlite3
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tidegrid.functions import scalars
from tidegrid.sources import contracts, files, sinks


def test_csv(spark, tmp_path):
    path = tmp_path / "prices.csv"
    path.write_text("date,symbol,adjusted_close\n2024-01-02,A,1.5\n2024-01-03,B,\n")
    df = files.read_csv(spark, str(path), "date date, symbol string, adjusted_close double", ["symbol", "adjusted_close"])
    assert rows(df) == [("A", 1.5), ("B", None)] and files.csv_columns(spark, str(path)) == ["date", "symbol", "adjusted_close"]
    path.write_text("date,symbol,adjusted_close\n2024-01-02,A,much\n")
    with pytest.raises(Exception):
        files.read_csv(spark, str(path), "date date, symbol string, adjusted_close double").collect()


def test_lines_json_arrays(spark, tmp_path):
    (tmp_path / "s.txt").write_text(" A \n\nB\n")
    assert rows(files.read_lines(spark, str(tmp_path / "s.txt"))) == [("A",), ("B",)]
    (tmp_path / "m.json").write_text('{"data_kind": "real",\n "n": 3}')
    assert files.read_json_documents(spark, str(tmp_path / "m.json")).first()["data_kind"] == "real"
    np.savez(tmp_path / "a.npz", betti=np.array([[1, 2], [3, 4]]), grid=np.array([0.5]))
    assert rows(files.read_arrays(spark, str(tmp_path / "a.npz")).select("name", "row", "values")) == [("betti", 0, [1.0, 2.0]), ("betti", 1, [3.0, 4.0]), ("grid", 0, [0.5])]


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "e.sqlite")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE m (name TEXT, n INTEGER, x REAL)")
        db.executemany("INSERT INTO m VALUES (?, ?, ?)", [(f"r{i}", i, i / 2) for i in range(25)] + [(None, None, None)])
        db.execute("CREATE TABLE none (a TEXT)")
    got = files.read_sqlite(spark, path, "m", 3)
    assert got.count() == 26 and got.agg(F.sum("x")).first()[0] == 150 and files.read_sqlite(spark, path, "none").count() == 0


def test_publish_export_upsert(spark, tmp_path):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string")
    for _ in range(2):  # again over what is there
        sinks.publish({"a": a, "b": a.limit(1)}, str(tmp_path / "db"), {"config": {"k": 1}})
    assert sinks.published(spark, str(tmp_path / "db")) == ["a", "b"]
    assert rows(spark.read.parquet(str(tmp_path / "db/documents"))) == [("config", '{"k": 1}')]
    sinks.export_csv(spark, str(tmp_path / "db"), "a", str(tmp_path / "a"))
    assert spark.read.option("header", True).csv(str(tmp_path / "a")).count() == 2
    with pytest.raises(ValueError):
        sinks.export_csv(spark, str(tmp_path / "db"), "a; drop", str(tmp_path / "c"))
    assert rows(sinks.upsert(a, spark.createDataFrame([(2, "z"), (3, "w")], "id int, v string"), ["id"])) == [(1, "x"), (2, "z"), (3, "w")]
    assert "| 1 | x |" in sinks.markdown(a)
    (tmp_path / "f.bin").write_bytes(b"abc")
    assert sinks.manifest(spark, str(tmp_path / "f.bin")).first()["sha256"].startswith("ba7816bf")


def test_contracts(spark):
    df = spark.createDataFrame([("A", 1.0), ("A", float("inf")), ("SYN1234", -1.0), ("B", None)], "symbol string, v double")
    good, bad = contracts.quarantine(df, "v")
    assert bad.count() == 2 and good.count() == 4 and good.agg(F.count("v")).first()[0] == 1
    assert rows(contracts.duplicate_keys(df, ["symbol"])) == [("A", 2)]
    assert rows(contracts.violations(df, {"positive": F.col("v") > 0})) == [("positive", 2)]
    with pytest.raises(contracts.ContractError):
        contracts.require_real({"data_kind": "real"}, df)
    with pytest.raises(contracts.ContractError):
        contracts.require_real({}, df.limit(0))
    contracts.require_real({"data_kind": "real"}, df.filter("symbol = 'A'"))
    with pytest.raises(contracts.ContractError):
        contracts.require_columns(df, ["w"])


def test_scalars(spark):
    df = spark.createDataFrame([("<a & 'b'>", 0.0, 1704067200)], "s string, z double, e bigint")
    got = df.select(scalars.escape_html("s"), scalars.normal_cdf("z"), scalars.epoch_to_date("e", "America/New_York").cast("string"), scalars.decompress(scalars.compress("s")).cast("string"), scalars.compress("s")).first()
    assert got[0] == "&lt;a &amp; &#x27;b&#x27;&gt;" and got[1] == 0.5 and got[2] == "2023-12-31" and got[3] == "<a & 'b'>" and zlib.decompress(bytes(got[4])).decode() == "<a & 'b'>"


def test_http_source(spark, tmp_path):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from tidegrid.sources import http

    seen = []

    class Server(BaseHTTPRequestHandler):
        def do_GET(self):
            key = self.path.rsplit("/", 1)[1]
            seen.append(key)
            busy = key == "B" and seen.count("B") == 1
            self.send_response(429 if busy else 404 if key == "gone" else 200)
            self.send_header("Retry-After", "0")
            self.end_headers()
            if not busy and key != "gone":
                self.wfile.write(b'{"v": "' + key.encode() + b'"}')

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        df = http.read_json_http(spark, f"http://127.0.0.1:{server.server_port}/{{key}}", ["A", "B", "gone"], wait=0.01, archive=tmp_path / "kept")
        got = {r["key"]: (r["status"], r["body"]) for r in df.collect()}
    finally:
        server.shutdown()
    assert got == {"A": (200, '{"v": "A"}'), "B": (200, '{"v": "B"}'), "gone": (404, None)}
    assert len(list((tmp_path / "kept").iterdir())) == 2
    assert http.wait_of("900") == 30 and http.wait_of(None) == 2 and http.wait_of("soon") == 2 and http.wait_of("7") == 7


def test_no_local_folder_on_a_cluster():
    from types import SimpleNamespace

    from tidegrid.session import checkpoint_folder

    class Context:
        def __init__(self, master):
            self.master, self.folder = master, None

        def getCheckpointDir(self):
            return self.folder

        def setCheckpointDir(self, folder):
            self.folder = folder

    session = lambda master, **conf: SimpleNamespace(sparkContext=Context(master), conf=SimpleNamespace(get=lambda k, d: conf.get(k, d)))
    assert checkpoint_folder(session("spark://host:1", **{"spark.checkpoint.dir": "/shared"})) == "/shared"
    assert checkpoint_folder(session("local[4]"))
    for master in ("spark://host:1", "yarn", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError):
            checkpoint_folder(session(master))


def test_pages_of_a_key(spark):
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from tidegrid.sources import http

    class Server(BaseHTTPRequestHandler):
        def do_GET(self):
            _, key, page = self.path.split("/")
            broken = key == "B" and page == "2"
            self.send_response(500 if broken else 200)
            self.end_headers()
            if not broken:
                self.wfile.write(json.dumps({"rows": [key + page], "meta": {"next": int(page) + 1 if int(page) < 3 else None}}).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        df = http.read_json_http(spark, f"http://127.0.0.1:{server.server_port}/{{key}}/{{page}}", ["A", "B"], wait=0.01, next="meta.next").cache()
        pages = [(r["key"], r["page"], r["status"]) for r in df.orderBy("key", "page").collect()]
        audit = rows(http.audit(df).select("key", "pages", "status", "whole"))
    finally:
        server.shutdown()
    assert pages == [("A", 1, 200), ("A", 2, 200), ("A", 3, 200), ("B", 1, 200), ("B", 2, 500)]
    assert audit == [("A", 3, 200, True), ("B", 2, 500, False)]
    assert http.next_page("nonsense", "a") is None and http.next_page('{"a": ""}', "a") is None


def test_replace_puts_a_table_back(spark, tmp_path):
    path = tmp_path / "t"
    sinks.replace(spark.range(3), str(path))
    sinks.replace(spark.range(5), str(path))
    assert spark.read.parquet(str(path)).count() == 5 and not (tmp_path / "t.old").exists() and not (tmp_path / "t.new").exists()
    path.rename(tmp_path / "t.old")  # broken off between the renames
    with pytest.raises(Exception):
        sinks.replace(spark.range(2).selectExpr("raise_error('no') as x"), str(path))
    assert spark.read.parquet(str(path)).count() == 5


def test_models_and_release(spark, tmp_path):
    fits = spark.createDataFrame([("a", 2020, "m", 0.5, [1.0, 2.0])], "k string, year int, model string, intercept double, weights array<double>")
    sinks.save_models(fits, {"m": ["f", "g"]}, str(tmp_path / "models"))
    again, groups = sinks.load_models(spark, str(tmp_path / "models"))
    assert rows(again) == rows(fits) and groups == {"m": ["f", "g"]}
    sinks.publish({"t": spark.range(4)}, str(tmp_path / "out"))
    held = sinks.release_manifest(spark, str(tmp_path / "out"), version="1")
    assert held["tables"] == {"t": 4} and held["version"] == "1" and all(len(f["sha256"]) == 64 for f in held["files"]) and any(f["path"].startswith("t/") for f in held["files"])


def test_registry_leaves_out_what_it_names():
    from tidegrid.operators import features

    groups = features.registry(["vix"], ["h1_max", "n_assets", "average_correlation"], ["h1_max_z60"], ["betti_000"], ["momentum_5", "eligible_assets"])
    assert groups == {
        "base": ["vix"], "compact": ["h1_max"], "combined": ["vix", "h1_max"], "dynamic_combined": ["vix", "h1_max", "h1_max_z60"], "full": ["betti_000", "h1_max"],
        "enhanced_base": ["vix", "momentum_5"], "enhanced_combined": ["vix", "momentum_5", "h1_max"],
    }
