"""Image candidates in PDF documents, as a table: one document in, none to 24 images out."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a document, images of it, pixels of an image, candidates that are tried, and characters of a text.
MOST_BYTES, MOST_IMAGES, MOST_PIXELS, MOST_TRIED, MOST_TEXT = 20 << 20, 24, 4_000_000, 8, 4096

_OBJECT = re.compile(rb"\d+\s+\d+\s+obj(.*?)endobj", re.S)
_BODY = re.compile(rb"stream\r?\n?(.*?)endstream", re.S)
_NUMBERS = {k: re.compile(rb"/" + k.encode() + rb"\s+(\d+)") for k in ("Width", "Height", "BitsPerComponent", "Predictor")}
_SCHEMA = "doc_id long, image int, width int, height int, channels int, pixels binary"


def is_pdf(content):
    """Whether bytes begin as a PDF does, and go on."""
    return (F.substring(content, 1, 5) == F.lit(b"%PDF-")) & (F.octet_length(content) > 5)


def unfiltered(data: bytes, width: int, channels: int) -> bytes:
    """The pixels of PNG-filtered rows; a cut-off last row is left out."""
    row = width * channels
    lines = np.frombuffer(data, np.uint8)[: len(data) // (row + 1) * (row + 1)].reshape(-1, row + 1)
    out = np.zeros((len(lines) + 1, row), dtype=np.uint8)
    for k, line in enumerate(lines, 1):
        kind, raw, up = line[0], line[1:].astype(np.int64), out[k - 1].astype(np.int64)
        if kind == 2:
            raw = raw + up
        elif kind == 1:  # sums along the row, channel by channel
            raw = np.cumsum(raw.reshape(-1, channels), axis=0).reshape(-1)
        elif kind in (3, 4):
            left, corner, done = np.zeros(channels, np.int64), np.zeros(channels, np.int64), np.empty(row, np.int64)
            for x in range(0, row, channels):
                above = up[x : x + channels]
                if kind == 3:
                    guess = (left + above) // 2
                else:
                    far = np.abs(np.stack((above - corner, left - corner, left + above - 2 * corner)))
                    guess = np.choose(np.argmin(far, axis=0), (left, above, corner))
                left = done[x : x + channels] = (raw[x : x + channels] + guess) & 255
                corner = above
            raw = done
        out[k] = raw & 255
    return out[1:].tobytes()


def images_of(content: bytes) -> Iterator[tuple[int, int, int, bytes]]:
    """(width, height, channels, pixels) of the readable 8-bit gray and RGB images, in order."""
    found = 0
    for match in _OBJECT.finditer(content):
        block, body = match[1], _BODY.search(match[1])
        head = block[: body.start()] if body else block
        channels = 3 if b"/DeviceRGB" in head else 1 if b"/DeviceGray" in head else 0
        n = {k: int(m[1]) if (m := p.search(head)) else 0 for k, p in _NUMBERS.items()}
        if found == MOST_IMAGES or not body or not re.search(rb"/Subtype\s*/Image", head) or b"/FlateDecode" not in head:
            continue
        if not channels or n["BitsPerComponent"] != 8 or not 0 < n["Width"] * n["Height"] <= MOST_PIXELS:
            continue
        try:
            pixels = zlib.decompressobj().decompress(body[1])
        except zlib.error:
            continue
        if n["Predictor"] >= 10:
            pixels = unfiltered(pixels, n["Width"], channels)
        if len(pixels) >= n["Width"] * n["Height"] * channels:
            found += 1
            yield n["Width"], n["Height"], channels, pixels


def _extract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for doc_id, content in zip(frame.doc_id, frame.content):
            rows = [(doc_id, k, *image) for k, image in enumerate(images_of(bytes(content)))]
            yield pd.DataFrame(rows, columns=["doc_id", "image", "width", "height", "channels", "pixels"])


def extract_images(documents: DataFrame) -> DataFrame:
    """doc_id, image, width, height, channels, pixels of documents (doc_id, content)."""
    readable = documents.where(is_pdf(F.col("content")) & (F.octet_length("content") <= MOST_BYTES))
    return readable.select("doc_id", "content").mapInPandas(_extract, _SCHEMA)


def candidates(images: DataFrame) -> DataFrame:
    """Each document's images that are tried, with pos: the squarest first, then the smallest."""
    order = [F.abs(F.col("width") / F.col("height") - 1), F.col("width") * F.col("height"), F.col("image")]
    return images.withColumn("pos", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order))).where(F.col("pos") <= MOST_TRIED)


def rgba(pixels: bytes, channels: int) -> bytes:
    """Gray or RGB pixels with all four channels."""
    some = np.frombuffer(pixels, np.uint8).reshape(-1, channels)
    return np.concatenate((np.broadcast_to(some, (len(some), 3)), np.full((len(some), 1), 255, np.uint8)), axis=1).tobytes()


class _Attempts:
    """A table function of a document's bytes: a row for each candidate that is tried, up to the first whose code can be read."""

    decode: Callable[[bytes, int, int], str | None]

    def eval(self, content: bytes):
        if content is None or not content.startswith(b"%PDF-") or len(content) <= 5 or len(content) > MOST_BYTES:
            return
        found = enumerate(images_of(content))
        ranked = sorted(found, key=lambda x: (abs(x[1][0] / x[1][1] - 1), x[1][0] * x[1][1], x[0]))[:MOST_TRIED]
        for pos, (image, (width, height, channels, pixels)) in enumerate(ranked, 1):
            try:
                text = self.decode(rgba(pixels[: width * height * channels], channels), width, height)
            except Exception as e:  # a decoder that fails ends the search, and the document stays without a text
                yield pos, image, None, f"{type(e).__name__}: {e}"[:200]
                return
            text = (text or "").strip()[:MOST_TEXT] if isinstance(text, str) else ""
            yield pos, image, text or None, None
            if text:
                return


_ATTEMPT = T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("image", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("error", T.StringType())])


def attempts(documents: DataFrame, decode: Callable[[bytes, int, int], str | None]) -> DataFrame:
    """documents with pos, image, text and error of each candidate that is tried: the squarest first, then the smallest, up to the first that has a text.

    decode(rgba, width, height) reads the code of an image, or gives None. The images are made inside the table function, one document at a time, and never leave it.
    """
    kind = type("Attempts", (_Attempts,), {"decode": staticmethod(decode)})
    return documents.lateralJoin(F.udtf(kind, returnType=_ATTEMPT)(F.col("content").outer()))


def first_texts(documents: DataFrame, decode: Callable[[bytes, int, int], str | None], key: str = "doc_id") -> DataFrame:
    """key, tried (candidates), image and text of the first that was read, and error, for each document; a document without any has nulls.

    documents: key and content. A key that several documents have counts once, with the first success of all.
    """
    rows = attempts(documents.select(key, "content"), decode)
    read = rows.groupBy(key).agg(F.count("*").alias("tried"), F.min_by(F.struct("image", "text"), F.when(F.col("text").isNotNull(), F.col("pos"))).alias("first"), F.max("error").alias("error"))
    rows = documents.select(key).distinct().join(read, key, "left")
    read_at = F.col("first.text").isNotNull()
    return rows.select(key, F.coalesce("tried", F.lit(0)).alias("tried"), F.when(read_at, F.col("first.image")).alias("image"), F.col("first.text").alias("text"), "error")
