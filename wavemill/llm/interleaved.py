"""Interleaved document sequences: ordered text and media-reference structs from HTML, payloads resolved by digest.

`parse_pages` reads HTML into one row per part: its position in the page, its kind (text or media), the text, the
reference of a media element and its caption (the figure's figcaption, or else the alt text). `attach_media` joins the
media parts with a payload table by digest; parts without a known payload keep their place with null payload columns.

Media are stored as 8-bit RGB PNG images of 64 pixels a row (192 bytes), which is lossless; `encode_png` and
`decode_png` are the whole codec, and decoding checks the format's own checksums.

`op9` makes every document a page: the text's lines as paragraphs, and halfway among them a figure whose image holds the
text's bytes. Images are written to the shared folder and read back; pages are made and parsed in passing, as text is
stored once already. Joined by digest, each figure keeps its place among the paragraphs (`position`, and `paragraphs`
that stand before it in its page) and its caption. Rows with an equal text share one digest: features are reduced to one
row per digest before the join, and a batch stores a repeated image once.

Defined results: a null text counts as empty; a very long text is one payload, handled alone; an empty payload is 192 blanks; broken or null HTML gives the parts found;
repeated rows give repeated parts; a media element without a reference is a part with a null digest; extra columns are
ignored, whatever their names; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, raw_text, read_table, small_batches
from .tokens import text_list

UNIT, LEVEL = 192, 1
SCHEME = "media:"
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_BLOCKS = frozenset("address article aside blockquote br dd div dl dt figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())
_SILENT = frozenset(("script", "style", "template", "noscript", "head"))
_MEDIA = frozenset(("img", "video", "audio", "embed", "object"))


def pad(text: bytes) -> bytes:
    return text + b" " * (-len(text) % UNIT if text else UNIT)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(payload: bytes) -> bytes:
    """An RGB image with one row per UNIT bytes."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    plain = np.zeros((len(rows), UNIT + 1), np.uint8)
    plain[:, 1:] = rows
    head = struct.pack(">IIBBBBB", UNIT // 3, len(rows), 8, 2, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(plain.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def decode_png(image: bytes) -> bytes:
    """The samples of an image written by encode_png; ValueError if it is damaged."""
    if image[:8] != _SIGNATURE:
        raise ValueError("not a PNG image")
    at, parts = 8, {}
    while at < len(image):
        (n,) = struct.unpack_from(">I", image, at)
        kind, body = image[at + 4 : at + 8], image[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", image, at + 8 + n)[0]:
            raise ValueError("damaged PNG chunk")
        parts.setdefault(kind, []).append(body)
        at += 12 + n
    width, height, depth, colour = struct.unpack(">IIBB", parts[b"IHDR"][0][:10])
    rows = np.frombuffer(zlib.decompress(b"".join(parts[b"IDAT"])), np.uint8).reshape(height, 3 * width + 1)
    if (depth, colour) != (8, 2) or rows[:, 0].any():
        raise ValueError("not an unfiltered RGB image")
    return rows[:, 1:].tobytes()


class _Parts(HTMLParser):
    """Parts of one page, in order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[dict] = []
        self.text: list[str] = []
        self.caption: list[str] | None = None
        self.silent = 0
        self.figures: list[int] = []

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            self.parts.append({"kind": "text", "text": text, "ref": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        if tag in _SILENT:
            self.silent += 1
        if tag in _BLOCKS:
            self.flush()
        if tag == "figure":
            self.figures.append(len(self.parts))
        if tag == "figcaption":
            self.flush()
            self.caption = []
        if tag in _MEDIA:
            self.flush()
            given = dict(attrs)
            self.parts.append({"kind": "media", "text": None, "ref": given.get("src") or given.get("data"), "caption": given.get("alt")})

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _MEDIA:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in _SILENT:
            self.silent = max(0, self.silent - 1)
        if tag == "figcaption" and self.caption is not None:
            caption, self.caption = " ".join("".join(self.caption).split()), None
            begin = self.figures[-1] if self.figures else len(self.parts)
            for part in self.parts[begin:]:
                if part["kind"] == "media":
                    part["caption"] = caption
        if tag == "figure" and self.figures:
            self.figures.pop()
        if tag in _BLOCKS:
            self.flush()

    def handle_data(self, data):
        if self.caption is not None:
            self.caption.append(data)
        elif not self.silent:
            self.text.append(data)


def parse_html(html: str | None) -> list[dict]:
    parser = _Parts()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return parser.parts


def parse_pages(pages: DataFrame, key: str = "page_id", kinds: tuple[str, ...] = ("text", "media")) -> DataFrame:
    """key, position, paragraphs, kind, text, ref, digest (of a `media:` reference) and caption: a row per part of the
    pages' html that is of one of the kinds; positions count all parts, paragraphs the text parts before."""
    names = ("position", "paragraphs", "kind", "text", "ref", "digest", "caption")

    def run(batches):
        for batch in small_batches(batches, "html"):
            found, at = [], []
            for k, html in enumerate(batch.column(1).to_pylist()):
                before = 0
                for i, p in enumerate(parse_html(html)):
                    if p["kind"] in kinds:
                        ref = p["ref"] or ""
                        found.append(p | {"position": i, "paragraphs": before, "digest": ref[len(SCHEME) :] if ref.startswith(SCHEME) else None})
                        at.append(k)
                    before += p["kind"] == "text"
            columns = [pa.array([p[n] for p in found], pa.int32() if n in names[:2] else pa.string()) for n in names]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), *columns], names=[key, *names])

    kept = ", ".join(f"{n} {'int' if n in names[:2] else 'string'}" for n in names)
    return pages.select(key, "html").mapInArrow(run, f"{key} {pages.schema[key].dataType.simpleString()}, {kept}")


def media_features(store: DataFrame) -> DataFrame:
    """A row per digest of store(digest, media), from the stored bytes read back."""

    def run(batches):
        for batch in batches:
            rows = []
            for digest, image in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                payload = decode_png(image)
                samples = np.frombuffer(payload, np.uint8)
                cuts = np.arange(64) * len(samples) // 64
                sums = np.add.reduceat(samples, cuts, dtype=np.int64) / np.diff(np.r_[cuts, len(samples)])
                bright = int("".join("1" if s > samples.mean() else "0" for s in sums), 2)
                levels = np.bincount(samples >> 4, minlength=16) * 255 // len(samples)
                rows.append((digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(image), hashlib.sha256(image).hexdigest(), f"{bright:016x}-{levels.astype(np.uint8).tobytes().hex()}"))
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = zip(*rows, strict=True) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=_FEATURES)

    read = store.where("media is not null").select("digest", "media").mapInArrow(run, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return read.groupBy("digest").agg(*(F.min(c).alias(c) for c in _FEATURES[1:]))


_FEATURES = ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def attach_media(parts: DataFrame, payloads: DataFrame) -> DataFrame:
    """Parts with the payload table's columns; a payload that very many parts show is a skewed join that Spark splits."""
    known = payloads.withColumnRenamed("digest", "__digest")
    return parts.join(known, F.col("digest") == F.col("__digest"), "left").drop("__digest")


def text_media(docs: DataFrame) -> DataFrame:
    """digest and media: the image of each text (once for equal texts of a batch)."""

    def run(batches):
        for batch in small_batches(batches):
            found = {}
            for text in text_list(*raw_text(batch.column(0))):
                payload = pad(text)
                digest = hashlib.sha256(payload).hexdigest()
                if digest not in found:
                    found[digest] = encode_png(payload)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(found.values(), pa.binary())], names=["digest", "media"])

    return docs.select("text").mapInArrow(run, "digest string, media binary")


def text_page(text: bytes) -> str:
    """The lines of a text as paragraphs, with a figure of the whole text halfway."""
    payload = pad(text)
    lines = [f"<p>{escape(x)}</p>" for x in text.decode().split("\n")]
    figure = f'<figure><img src="{SCHEME}{hashlib.sha256(payload).hexdigest()}" width="{UNIT // 3}" height="{len(payload) // UNIT}" alt=""><figcaption>{len(text)} bytes</figcaption></figure>'
    half = len(lines) // 2
    return "".join(["<article>", *lines[:half], figure, *lines[half:], "</article>"])


def text_pages(docs: DataFrame) -> DataFrame:
    """doc_id and html: the page of each text."""

    def run(batches):
        for batch in small_batches(batches):
            html = [text_page(text) for text in text_list(*raw_text(batch.column(1)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(html, pa.string())], names=["doc_id", "html"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, html string")


def op9_interleaved(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    store = materialise(text_media(docs), "media", codec="uncompressed")
    figures = parse_pages(text_pages(docs), "doc_id", kinds=("media",))
    # written apart, so that the join has plain inputs and a digest of very many documents can be split
    rows = attach_media(figures, materialise(media_features(store), "features"))
    n_bytes = F.split("caption", " ")[0].cast("long").alias("n_bytes")
    return rows.select("doc_id", n_bytes, *_FEATURES[1:], "position", "paragraphs", "caption")
