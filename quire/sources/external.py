"""Sources and services that need something outside this repository, as plain functions to plug in.

PDF parsing, OCR and detectors take a function; the chat service is reached over HTTP with the standard
library. None of them runs without what it is given.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.scalar import area
from ..operators.blocks import doc_id_of, figure_id, is_pdf

# What detectors call their classes.
FIVE_CLASSES = {"0": "paragraph", "1": "title", "2": "list", "3": "table", "4": "figure"}
ELEVEN_CLASSES = {
    "caption": "caption", "footnote": "footer", "formula": "equation", "list-item": "list", "page-footer": "footer", "page-header": "header",
    "picture": "figure", "section-header": "title", "table": "table", "text": "paragraph", "title": "title",
}


def numbered_classes() -> dict[str, str]:
    """The eleven classes by their place in alphabetical order."""
    return {str(k): c for k, c in enumerate(ELEVEN_CLASSES.values())}


def map_classes(label: Column, classes: dict[str, str]) -> Column:
    """A detector's label as a region class, ``unknown`` for others."""
    table = F.create_map(*(F.lit(x) for kv in classes.items() for x in kv))
    return F.coalesce(table[F.lower(label.cast("string"))], F.lit("unknown"))


RAW_BLOCK = "doc_id string, page_index int, type int, number int, bbox struct<x0:double,y0:double,x1:double,y1:double>, spans array<struct<text:string,font:string,size:double,flags:int,color:int>>, page_width double, page_height double"


def read_pdfs(spark: SparkSession, path: str, parser: Callable[[bytes], list[dict]], only_pdfs: bool = False) -> DataFrame:
    """Raw page blocks of PDF files; ``parser`` gives a dict for each block of one file's bytes.

    A path that isn't there is an error. Other files are left out, or are an error too with ``only_pdfs``. A
    file that can't be parsed ends the job with its name.
    """
    files = spark.read.format("binaryFile").load(path)
    if only_pdfs:
        other = files.where(~is_pdf(F.col("path"))).select("path").head()
        if other:
            raise ValueError(f"no PDF: {other.path}")
    files = files.where(is_pdf(F.col("path"))).select(doc_id_of(F.col("path")).alias("doc_id"), "path", "content")
    schema = spark.createDataFrame([], RAW_BLOCK).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kind = to_arrow_schema(schema)
        for batch in batches:
            for doc, name, content in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    rows = [{"doc_id": doc, **b} for b in parser(content)]
                except Exception as e:
                    raise ValueError(f"can't parse {name}") from e
                yield pa.RecordBatch.from_pylist(rows, kind)

    return files.mapInArrow(run, RAW_BLOCK)


def rasterise(pages: DataFrame, renderer: Callable[[bytes, int, float], bytes], dpi: float = 200.0) -> DataFrame:
    """Adds image (PNG bytes) and scale (points of a pixel) to pages: doc_id, page_index, content (a file's bytes).

    ``renderer`` takes the bytes, the page's number and the pixels of a point.
    """
    return _images(pages.select("doc_id", "page_index", "content"), lambda row: renderer(row["content"], row["page_index"], dpi / 72.0), 72.0 / dpi)


def crop_figures(figures: DataFrame, cropper: Callable[[bytes, int, float, tuple[float, float, float, float]], bytes], dpi: float = 150.0) -> DataFrame:
    """(doc_id, page_index, block_id, image, scale) of figures: doc_id, page_index, block_id, bbox, content."""
    return _images(figures.select("doc_id", "page_index", "block_id", "bbox", "content"), lambda row: cropper(row["content"], row["page_index"], dpi / 72.0, tuple(row["bbox"][k] for k in ("x0", "y0", "x1", "y1"))), 72.0 / dpi)


def _images(rows: DataFrame, draw: Callable[[dict], bytes], scale: float) -> DataFrame:
    names = [c for c in rows.columns if c not in ("content", "bbox")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            images = [draw(row) for row in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(images, pa.binary()), pa.array([scale] * len(batch))], names=[*names, "image", "scale"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in names) + ", image binary, scale double")


#: Points of area from which a form object counts as a figure.
MIN_FORM_AREA = 2000.0


def form_figures(objects: DataFrame) -> DataFrame:
    """(doc_id, page_index, seq, block_id, bbox) of form objects whose dictionary has a large enough /BBox.

    objects: doc_id, page_index, seq, dictionary (the object's text). Others, and boxes of fewer than four
    numbers, are left out.
    """
    inside = F.regexp_extract(F.coalesce("dictionary", F.lit("")), r"/BBox\s*\[([^\]]*)\]", 1)
    numbers = F.filter(F.transform(F.split(F.trim(inside), r"\s+"), lambda x: x.try_cast("double")), lambda x: x.isNotNull())
    out = objects.withColumn("_n", numbers).where(F.size("_n") >= 4)
    box = F.struct(*(F.element_at("_n", k + 1).alias(c) for k, c in enumerate(("x0", "y0", "x1", "y1"))))
    out = out.withColumn("bbox", box).where(area(F.col("bbox")) >= MIN_FORM_AREA)
    return out.select("doc_id", "page_index", "seq", figure_id(F.col("doc_id"), "xobj", F.col("page_index"), F.col("seq")).alias("block_id"), "bbox")


def recognise(pages: DataFrame, reader: Callable[[bytes], list[dict]]) -> DataFrame:
    """Words of page images for group_ocr_words(); pages: doc_id, page_index, image, scale."""
    kind = "doc_id string, page_index int, block_num int, word_no int, text string, conf double, left double, top double, width double, height double, scale double"
    names = [x.split()[0] for x in kind.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{"doc_id": d, "page_index": p, "scale": s, "word_no": k, **w} for d, p, image, s in zip(*(c.to_pylist() for c in batch.columns)) for k, w in enumerate(reader(image))]
            types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), *[pa.float64()] * 6]
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(names, types)], names=names)

    return pages.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("page_index").cast("int").alias("page_index"), "image", F.col("scale").cast("double").alias("scale")).mapInArrow(run, kind)


class ChatService:
    """A generator for prompt.generate(): a chat model behind HTTP."""

    def __init__(self, url: str, model: str, temperature: float = 0.1, timeout: float = 120.0, attempts: int = 2, pause: float = 1.5):
        self.url, self.model, self.temperature = url.rstrip("/"), model, temperature
        self.timeout, self.attempts, self.pause = timeout, attempts, pause

    def _call(self, path: str, body: dict | None = None, timeout: float | None = None) -> dict:
        data = None if body is None else json.dumps(body).encode()
        request = urllib.request.Request(self.url + path, data, {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=timeout or self.timeout) as answer:
            return json.load(answer)

    def healthy(self) -> bool:
        """Whether the service answers and knows the model (by its name before the colon)."""
        try:
            known = [m.get("name", "") for m in self._call("/api/tags", timeout=5).get("models", [])]
        except (OSError, ValueError):
            return False
        return any(self.model.split(":")[0] in name for name in known)

    def _body(self, rules: str, prompt: str, temperature: float | None, stream: bool) -> dict:
        heat = self.temperature if temperature is None else temperature
        return {"model": self.model, "stream": stream, "options": {"temperature": heat}, "messages": [{"role": "system", "content": rules}, {"role": "user", "content": prompt}]}

    def __call__(self, rules: str, prompt: str, temperature: float | None = None) -> str:
        """The whole answer; a temperature given here holds for this call alone."""
        body = self._body(rules, prompt, temperature, False)
        for attempt in range(1, self.attempts + 1):
            try:
                return self._call("/api/chat", body)["message"]["content"]
            except (OSError, ValueError, KeyError, urllib.error.URLError):
                if attempt == self.attempts:
                    raise
                time.sleep(self.pause * attempt)
        raise AssertionError

    def stream(self, rules: str, prompt: str, temperature: float | None = None) -> Iterator[str]:
        """The answer piece by piece, as the service sends it: one JSON object in each line."""
        data = json.dumps(self._body(rules, prompt, temperature, True)).encode()
        request = urllib.request.Request(self.url + "/api/chat", data, {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            for line in answer:
                if line.strip():
                    said = json.loads(line)
                    piece = said.get("message", {}).get("content", "")
                    if piece:
                        yield piece
                    if said.get("done"):
                        return
