"""Plugged-in sources, the chat service, streams and the entry point."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from quire.operators import blocks as B
from quire.sources import external as X
from quire.streaming import ingest


def test_pdfs_go_through_a_parser(spark, tmp_path):
    (tmp_path / "my paper (1).pdf").write_bytes(b"one")
    (tmp_path / "notes.txt").write_bytes(b"two")

    def parser(content):
        span = {"text": content.decode(), "font": "F", "size": 10.0, "flags": 16, "color": 0}
        return [{"page_index": 0, "type": 0, "number": 0, "bbox": {"x0": 0.0, "y0": 0.0, "x1": 90.0, "y1": 10.0}, "spans": [span], "page_width": 595.0, "page_height": 842.0}]

    got = B.extract(X.read_pdfs(spark, str(tmp_path), parser)).collect()
    assert [(r.doc_id, r.text, r.style.is_bold) for r in got] == [("my_paper__1_", "one", True)]

    with pytest.raises(ValueError, match="no PDF"):
        X.read_pdfs(spark, str(tmp_path), parser, only_pdfs=True)
    with pytest.raises(Exception):
        X.read_pdfs(spark, str(tmp_path / "nowhere"), parser).collect()

    def broken(content):
        raise RuntimeError("no")

    with pytest.raises(Exception, match="can't parse"):
        X.read_pdfs(spark, str(tmp_path), broken).collect()


def test_images_of_pages_and_figures(spark):
    pages = spark.createDataFrame([("d", 3, bytearray(b"pdf"))], "doc_id string, page_index int, content binary")
    got = X.rasterise(pages, lambda content, page, zoom: content + f"-{page}-{zoom:.2f}".encode(), dpi=144.0).first()
    assert (bytes(got.image), got.scale) == (b"pdf-3-2.00", 0.5)
    figures = spark.createDataFrame([("d", 3, "f", (1.0, 2.0, 3.0, 4.0), bytearray(b"pdf"))], "doc_id string, page_index int, block_id string, bbox struct<x0:double,y0:double,x1:double,y1:double>, content binary")
    got = X.crop_figures(figures, lambda content, page, zoom, box: repr(box).encode(), dpi=72.0).first()
    assert (got.block_id, bytes(got.image), got.scale) == ("f", b"(1.0, 2.0, 3.0, 4.0)", 1.0)


def test_words_of_images(spark):
    pages = spark.createDataFrame([("d", 0, bytearray(b"x"), 0.5)], "doc_id string, page_index int, image binary, scale double")
    reader = lambda image: [{"block_num": 1, "text": t, "conf": c, "left": 10.0 * k, "top": 0.0, "width": 8.0, "height": 4.0} for k, (t, c) in enumerate([("a", 90.0), (" ", 90.0), ("b", -1.0), ("c", 70.0)])]
    got = B.group_ocr_words(X.recognise(pages, reader)).first()
    assert (got.text, got.confidence, got.bbox.x1, got.bbox.y1) == ("a c", 80.0, 19.0, 2.0)


def test_labels(spark):
    df = spark.createDataFrame([("Formula",), ("x",)], "label string")
    assert [r[0] for r in df.select(X.map_classes(F.col("label"), X.ELEVEN_CLASSES)).collect()] == ["equation", "unknown"]
    assert X.numbered_classes()["9"] == "paragraph"


def test_chat_service():
    calls = []

    class Handler(BaseHTTPRequestHandler):
        def _say(self, code, *bodies):
            self.send_response(code)
            self.end_headers()
            self.wfile.write(b"\n".join(json.dumps(b).encode() for b in bodies))

        def do_GET(self):
            self._say(200, {"models": [{"name": "small:8b"}]})

        def do_POST(self):
            calls.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            if calls[-1]["stream"]:
                return self._say(200, *({"message": {"content": x}} for x in ("hel", "", "lo")), {"done": True})
            self._say(500 if len(calls) == 1 else 200, {"message": {"content": "hello"}})

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    chat = X.ChatService(url, "small", pause=0.01)
    assert chat.healthy() and not X.ChatService(url, "other").healthy()
    assert chat("rules", "prompt") == "hello" and len(calls) == 2
    assert [m["role"] for m in calls[0]["messages"]] == ["system", "user"]
    assert list(chat.stream("rules", "prompt", temperature=0.8)) == ["hel", "lo"] and calls[-1]["options"] == {"temperature": 0.8}
    assert chat("rules", "prompt", temperature=0.5) and calls[-1]["options"] == {"temperature": 0.5} and chat.temperature == 0.1
    server.shutdown()
    server.server_close()
    assert not chat.healthy()


def test_documents_arrive(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    box = {"x0": 50.0, "y0": 300.0, "x1": 200.0, "y1": 320.0}
    for name in ("a", "b"):
        doc = {"doc_id": name, "pages": [{"page_index": 0, "width": 595.0, "height": 842.0, "text_blocks": [{"block_id": name, "text": "Table 1. x", "bbox": box, "page_index": 0}], "figure_blocks": []}]}
        (source / f"{name}.json").write_text(json.dumps(doc))
        ingest.layout_stream(spark, str(source), str(target), str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(str(target)).select("doc_id", "region_class").collect()
    assert sorted(tuple(r) for r in got) == [("a", "caption"), ("b", "caption")]


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
