"""XML parsing, the search source, CSV export, masking, command line, streaming."""

import csv
import glob

import pytest
from pyspark.sql import functions as F

from docketry.cli import main
from docketry.functions.text import edge_trim, mask_secrets, mask_text, squeeze
from docketry.plans.queries import XML
from docketry.sinks.console import diagnostics, preview
from docketry.sinks.csv import read_csv, write_csv, write_csv_file
from docketry.sources.rest import request_url, search
from docketry.sources.xml_records import (
    MalformedResponse, first_record_tags, parse_records, parse_tree, records_of, response_metadata,
)


def parsed(xml):
    return [r[1:] for r in records_of(parse_tree(xml))]


def test_record_rules():
    rows = parsed(XML)
    assert [(r[0], r[1], r[5]) for r in rows] == [("A bold x", "1020200000001", ""), ("T2", "0020", "deep"), ("", "7", "")]
    both = "<a><item><applicationNumber>2</applicationNumber><ApplicationNumber>1</ApplicationNumber></item></a>"
    assert parsed(both)[0][1] == "2"  # document order decides
    empty_first = "<item><inventionTitle/><InventionName>x</InventionName><applicationNumber>1</applicationNumber></item>"
    assert parsed(empty_first)[0][0] == ""
    nested = "<PatentUtilityInfo><item><applicationNumber>1</applicationNumber></item></PatentUtilityInfo>"
    assert len(parsed(nested)) == 2
    assert parsed("<a/>") == []
    assert first_record_tags(XML) == ["InventionName", "ApplicationNumber"] and first_record_tags("<a/>") == []
    for bad in ("<a>", "", '<!DOCTYPE a [<!ENTITY x "y">]><a>&x;</a>'):
        with pytest.raises(MalformedResponse):
            parse_tree(bad)


def test_parse_rows_and_metadata(spark):
    df = spark.createDataFrame([(1, XML), (2, None), (3, " ")], "id int, body string")
    rows = parse_records(df).orderBy("pos").collect()
    assert [(r.id, r.pos) for r in rows] == [(1, 0), (1, 1), (1, 2)]
    m = response_metadata(df.filter("id = 1")).first()
    assert (m.resultCode, m.resultMsg, m.successYN, m.n_info, m.n_item) == ("00", "", "Y", 2, 2)


def test_search_source(spark, tmp_path, monkeypatch):
    (tmp_path / "ok.xml").write_text(XML, encoding="utf-8")
    (tmp_path / "gone.503.xml").write_text("no xml", encoding="utf-8")
    (tmp_path / "bad.xml").write_text("no xml", encoding="utf-8")
    folder = str(tmp_path)
    assert search(spark, "ok", folder=folder).count() == 3
    assert search(spark, "gone", folder=folder).count() == 0
    status = search(spark, "ok\ngone", folder=folder, form="status").collect()
    assert {(s.word, s.http_status, s.is_xml, s.n_records) for s in status} == {("ok", 200, True, 3), ("gone", 503, False, 0)}
    for word in ("bad", "missing"):
        with pytest.raises(Exception):
            search(spark, word, folder=folder).count()
    for args in (("ok", 0), ("ok", 21), (" ", 5)):
        with pytest.raises(ValueError):
            search(spark, *args, folder=folder)
    monkeypatch.delenv("PATENT_SEARCH_KEY", raising=False)
    with pytest.raises(ValueError):
        search(spark, "ok")
    monkeypatch.setenv("PATENT_SEARCH_KEY", "k")
    monkeypatch.delenv("PATENT_SEARCH_ENDPOINT", raising=False)
    with pytest.raises(ValueError, match="ENDPOINT"):
        search(spark, "ok")
    answer = search(spark, "ok", folder=folder, form="response").first()
    assert (answer.http_status, bytes(answer.body)) == (200, XML.encode())
    url = request_url("w", 5, "k&y", "http://localhost/s")
    assert url.startswith("http://localhost/s?word=w&") and "accessKey=k%26y" in url and "docsCount=5" in url


def test_http_transport(monkeypatch):
    """Answers, HTTP errors and refused connections of a server on this machine."""
    import http.server
    import threading

    from docketry.sources.rest import HttpTransport

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            body = XML.encode()
            self.send_response(503 if "word=bad" in self.path else 200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    monkeypatch.setenv("PATENT_SEARCH_ENDPOINT", f"http://127.0.0.1:{server.server_port}/s")
    assert (HttpTransport().get("ok", 5, "k").status, HttpTransport().get("bad", 5, "k").status) == (200, 503)
    assert HttpTransport().get("bad", 5, "k").body == XML.encode()
    server.shutdown()
    server.server_close()
    with pytest.raises(RuntimeError) as error:
        HttpTransport().get("ok", 5, "secretkey")
    assert "secretkey" not in str(error.value)


def test_csv_bytes(spark, tmp_path):
    names = ["title", "application_number", "applicant", "ipc", "register_status", "abstract"]
    assessed = ["relevance_score", "review_priority", "matched_concepts", "score_reason", "analysis_mode"]
    rows = [('a,"b"', "01", "한글", "H\\", "", " x ", "92.0", "p", "m;n", "r, s", "g"), ("t", None, "", "", "", "", "0.0", "", "", "", "g")]
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names + assessed))
    write_csv(df.withColumn("more", F.lit(1)), str(tmp_path / "out"))
    (file,) = glob.glob(str(tmp_path / "out" / "part-*.csv"))
    expected = tmp_path / "expected.csv"
    with expected.open("w", newline="", encoding="utf-8-sig") as f:
        writer = csv.writer(f)
        writer.writerow(["발명의 명칭", "출원번호", "출원인", "IPC", "등록상태", "초록", *assessed])
        writer.writerows([["" if x is None else x for x in r] for r in rows])
    assert open(file, "rb").read() == expected.read_bytes()
    assert read_csv(spark, str(tmp_path / "out")).count() == 2


def test_one_csv_file(spark, tmp_path):
    fields = ["title", "application_number", "applicant", "ipc", "register_status", "abstract", "relevance_score"]
    df = spark.createDataFrame([tuple("abcdefg")], ", ".join(f"{f} string" for f in fields)).repartition(3)
    path = write_csv_file(df, str(tmp_path / "o"), "r.csv")
    assert path.endswith("/o/r.csv") and not [p for p in (tmp_path / "o").iterdir() if p.is_dir()]
    assert open(path, encoding="utf-8-sig").read() == "발명의 명칭,출원번호,출원인,IPC,등록상태,초록,relevance_score\na,b,c,d,e,f,g\n"
    with pytest.raises(FileExistsError):
        write_csv_file(df, str(tmp_path / "o"), "r.csv")


def test_worker_needs_the_key(monkeypatch):
    from docketry.sources.rest import Query, SearchReader

    for name in ("PATENT_SEARCH_KEY", "PATENT_SEARCH_ENDPOINT"):
        monkeypatch.delenv(name, raising=False)
    with pytest.raises(ValueError, match="executor"):
        list(SearchReader({"word": "w"}, "records").read(Query("w")))


def test_diagnostics():
    lines = diagnostics(503, XML.encode() + b"<!-- accessKey=abc -->", "1020200000001")
    assert lines[:4] == ["[DEBUG] HTTP status: 503", "[DEBUG] resultCode: 00", "[DEBUG] resultMsg: ", "[DEBUG] successYN: Y"]
    assert lines[4:7] == ["[DEBUG] <PatentUtilityInfo> nodes: 2", "[DEBUG] <item> nodes: 2", "[DEBUG] Tags of the first record: InventionName, ApplicationNumber"]
    text = "\n".join(lines)
    assert "1020200000001" not in text and "accessKey=[REDACTED]" in text and preview(b"x" * 2000) == "x" * 1200
    assert preview(b"key=1 ab\xff", "ab") == "key=1 [REDACTED]\ufffd"


def test_masking(spark):
    text = "u?accessKey = abc&x=1 serviceKey:zz <t>"
    assert mask_text(text) == "u?accessKey = [REDACTED]&x=1 serviceKey:[REDACTED] <t>"
    df = spark.createDataFrame([(text + " secret",)], "t string")
    assert df.select(mask_secrets(F.col("t"), "secret")).first()[0] == mask_text(text + " secret", "secret")
    assert mask_text("no secret", "secret", mark="[가림]") == "no [가림]"


def test_white_space(spark):
    df = spark.createDataFrame([("　 a\x1c b \n",), (None,)], "t string")
    assert [r[0] for r in df.select(squeeze(F.col("t"))).collect()] == ["a b", ""]
    assert df.select(edge_trim(F.col("t"))).first()[0] == "a\x1c b"


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "w.xml").write_text(XML, encoding="utf-8")
    (tmp_path / "none.xml").write_text("<a/>", encoding="utf-8")
    common = ["--technology", "배터리", "--folder", str(tmp_path), "--output", str(tmp_path / "o")]
    assert main(["w", *common, "--debug"]) == 0
    out = capsys.readouterr().out
    assert "1. A bold x | 1020200000001" in out and "Search: w\nScored against: 배터리\nRecords: 3" in out
    assert "[DEBUG] HTTP status: 200" in out and len(list((tmp_path / "o").glob("ranked_????????_??????.csv"))) == 1
    assert main(["w", "--technology", " ", "--folder", str(tmp_path)]) == 1 and "required" in capsys.readouterr().err
    assert main(["none", *common]) == 1 and main(["w", *common, "--count", "0"]) == 1


def test_streaming(spark, tmp_path):
    from docketry.operators.history import ENTRY_FIELDS
    from docketry.streaming.watch import distinct_deliveries, score_stream, watch_changes

    log = spark.createDataFrame(
        [(1, "1", "t", "관련 있음", "", "2026", "공개", "a", "i", 1.0, "p")],
        "ord long, " + ", ".join(f"{f} {'double' if f.startswith('relevance') else 'string'}" for f in ENTRY_FIELDS),
    )
    log.write.parquet(str(tmp_path / "log"))
    fields = "ord long, title string, application_number string, applicant string, ipc string, register_status string, abstract string"
    data = spark.createDataFrame([(1, "배터리", "1", "a", "i", "등록", ""), (2, "x", "2", "a", "i", "등록", "")], fields)
    data.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(data.schema).parquet(str(tmp_path / "in"))
    run = watch_changes(score_stream(stream, "배터리"), str(tmp_path / "log"), str(tmp_path / "out"), str(tmp_path / "cp"))
    run.trigger(availableNow=True).start().awaitTermination()
    assert [r.ord for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [1]

    events = spark.createDataFrame([("s", "1", "2026-01-01"), ("s", "1", "2026-01-02"), ("s", "2", "2026-01-02")], "source string, applicationNumber string, d string")
    events.select("source", "applicationNumber", F.col("d").cast("timestamp").alias("received_at")).write.parquet(str(tmp_path / "ev"))
    deliveries = spark.readStream.schema("source string, applicationNumber string, received_at timestamp").parquet(str(tmp_path / "ev"))
    q = distinct_deliveries(deliveries).writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("seen").count() == 2
