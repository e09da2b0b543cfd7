"""Interleaved document sequences: pages of text and media become ordered segments, media resolved by digest.

A page is HTML. Parsing it gives segments in reading order: text, or a reference to a media payload by its
SHA-256 (`<img src="sha256:...">`) with its caption (figcaption, else alt). A media store holds each payload
once under its digest, in a lossless stored form: an 8-bit grey image (binary PGM) of fixed width. A join on
the digest resolves references; what is read back from the stored bytes (features, lengths, digests) goes
through the join, and the bytes only where asked for, so that large payloads need not be shuffled.
"""

from __future__ import annotations

import hashlib
import html
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few_rows, small_batches

WIDTH = 192
TAIL = 16
PREFIX = "sha256:"
SEGMENTS = "array<struct<position:int,kind:string,text:string,digest:string,caption:string>>"
_SEGMENT = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))
MEDIA = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
_MEDIA = pa.schema([("digest", pa.string()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])
_HIDDEN = frozenset({"script", "style", "template", "noscript"})


class _Reader(HTMLParser):
    """Text and media references in order; a figure's caption goes to the media in that figure."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.segments: list[dict] = []
        self.text: list[str] = []
        self.caption: list[str] | None = None
        self.figure: list[dict] | None = None
        self.hidden = 0

    def flush(self) -> None:
        text = "".join(self.text)
        self.text.clear()
        if text.strip():
            self.segments.append({"position": len(self.segments), "kind": "text", "text": text, "digest": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        if tag in _HIDDEN:
            self.hidden += 1
        elif tag == "figure":
            self.flush()
            self.figure = []
        elif tag == "figcaption":
            self.caption = []
        elif tag in ("img", "audio", "video"):
            known = dict(attrs)
            if (known.get("src") or "").startswith(PREFIX):
                self.flush()
                media = {"position": len(self.segments), "kind": "media", "text": None, "digest": known["src"][len(PREFIX) :].lower(), "caption": known.get("alt")}
                self.segments.append(media)
                if self.figure is not None:
                    self.figure.append(media)
        elif tag in ("p", "div", "h1", "h2", "h3", "li", "article", "section"):
            self.flush()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in _HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption" and self.caption is not None:
            for media in self.figure or ():
                media["caption"] = "".join(self.caption)
            self.caption = None
        elif tag == "figure":
            self.figure = self.caption = None
        elif tag in ("p", "div", "h1", "h2", "h3", "li", "article", "section"):
            self.flush()

    def handle_data(self, data):
        if not self.hidden:
            (self.text if self.caption is None else self.caption).append(data)


def parse(page: str | None) -> list[dict]:
    """The segments of a page; none for a null or empty page."""
    reader = _Reader()
    reader.feed(page or "")
    reader.close()
    reader.flush()
    return reader.segments


def padded(data: bytes, width: int = WIDTH) -> bytes:
    """data with spaces up to a positive multiple of width."""
    return data + b" " * (-len(data) % width if data else width)


def store(payload: bytes, width: int = WIDTH) -> bytes:
    """The stored form: a binary PGM of 8-bit samples, one row for each width bytes."""
    return b"P5\n%d %d\n255\n" % (width, len(payload) // width) + payload


def read_back(stored: bytes) -> bytes:
    """The samples of a stored form, by its own header."""
    kind, size, top, samples = stored.split(b"\n", 3)
    width, height = map(int, size.split())
    if kind != b"P5" or top != b"255" or len(samples) != width * height:
        raise ValueError("not a stored grey image")
    return samples


def features(samples: bytes, width: int = WIDTH) -> str:
    """Height, mean, deviation, share of each of eight bands, mean step between neighbours: of all samples."""
    counts = np.bincount(np.frombuffer(samples, np.uint8), minlength=256)
    n, at = len(samples), np.arange(256)
    mean = float(counts @ at) / n
    deviation = max(0.0, float(counts @ (at * at)) / n - mean * mean) ** 0.5
    x = np.frombuffer(samples, np.uint8).astype(np.int16)
    step = float(np.abs(np.diff(x)).sum(dtype=np.int64)) / max(1, n - 1)
    bands = counts.reshape(8, 32).sum(axis=1) / n
    return f"h={n // width};mean={mean:.4f};sd={deviation:.4f};step={step:.4f};bands=" + ",".join(f"{b:.4f}" for b in bands)


def describe(payload: bytes) -> tuple:
    """What the media store tells of one payload, after storing it and reading the stored bytes back."""
    stored = store(payload)
    back = read_back(stored)
    digest = hashlib.sha256(back).hexdigest()
    return digest, len(back), digest, zlib.crc32(back[-TAIL:]), len(stored), hashlib.sha256(stored).hexdigest(), features(back)


def media_store(payloads: DataFrame, payload_col: str = "payload", keep_bytes: bool = False) -> DataFrame:
    """One row for each distinct payload: its digest and what describe() gives, and with keep_bytes its stored form.

    Null payloads have no row. Copies are merged before the shuffle and after it.
    """
    out = pa.schema([*_MEDIA, *([("stored", pa.binary())] if keep_bytes else [])])

    def run(batches):
        for batch in few_rows(batches):
            seen: dict[str, tuple] = {}
            for p in batch.column(0).to_pylist():
                if p is not None:
                    row = describe(p)
                    seen.setdefault(row[0], (*row, store(p)) if keep_bytes else row)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in seen.values()], f.type) for k, f in enumerate(out)], schema=out)

    payloads = small_batches(payloads)
    rows = payloads.select(payloads[payload_col].cast("binary")).mapInArrow(run, MEDIA + ", stored binary" * keep_bytes)
    return rows.groupBy("digest").agg(*(F.first(c).alias(c) for c in rows.columns if c != "digest"))


def sequences(pages: DataFrame, id_col: str, page_col: str) -> DataFrame:
    """id, segments (array of struct position, kind, text, digest, caption), one row for each page."""
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in few_rows(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([parse(p) for p in batch.column(1).to_pylist()], _SEGMENT)], names=["id", "segments"])

    pages = small_batches(pages)
    return pages.select(pages[id_col].alias("id"), pages[page_col].cast("string").alias("page")).mapInArrow(run, f"id {kind}, segments {SEGMENTS}")


def references(pages: DataFrame) -> DataFrame:
    """id, position, digest, caption: the media references of sequences, in rows."""
    return pages.select("id", F.explode(F.filter("segments", lambda s: s["kind"] == "media")).alias("s")).select("id", "s.position", "s.digest", "s.caption")


def resolve(refs: DataFrame, media: DataFrame) -> DataFrame:
    """References with the columns of the media they name; unresolved ones keep nulls.

    The key is the digest's bytes, not its text by which media was grouped: both sides are then dealt anew
    and a digest that very many documents share can be split among tasks.
    """
    m = media.withColumn("_key", F.unhex("digest")).drop("digest")
    return refs.withColumn("_key", F.unhex("digest")).join(m.hint("merge"), "_key", "left").drop("_key")


def page_of(text: str) -> tuple[str, str, int]:
    """A document as a page: its text, then its payload as a figure. Also the payload's digest and the text's bytes."""
    data = text.encode()
    digest = hashlib.sha256(padded(data)).hexdigest()
    return f'<article><p>{html.escape(text, quote=False)}</p><figure><img src="{PREFIX}{digest}" width="{WIDTH}"><figcaption>{len(data)}</figcaption></figure></article>', digest, len(data)


def document_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each document: doc_id, n_bytes and what the media store tells of its payload.

    The payload is the whole text in UTF-8, padded with spaces to a positive multiple of 192 (a null text is
    empty). Each document becomes a page, the page is parsed to segments, its reference is resolved in the
    store of all payloads. Copies share one stored payload; repeated rows and null ids stay; an empty table
    gives an empty result; other columns are not read.
    """
    docs = small_batches(docs)
    base = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))

    def pages(batches):
        for batch in few_rows(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([page_of(t)[0] for t in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "page"])

    def payloads(batches):
        for batch in few_rows(batches):
            yield pa.RecordBatch.from_arrays([pa.array([padded(t.encode()) for t in batch.column(0).to_pylist()], pa.binary())], names=["payload"])

    refs = references(sequences(base.mapInArrow(pages, "doc_id long, page string"), "doc_id", "page"))
    media = media_store(base.select("text").mapInArrow(payloads, "payload binary"))
    return resolve(refs, media).select(F.col("id").alias("doc_id"), F.col("caption").cast("long").alias("n_bytes"), "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
