"""Media columns as interleaved document sequences (operator 2).

HTML becomes an ordered array of structs, text and media references in reading
order; a media reference holds its position, the digest it points at and its caption
(``figcaption`` before or after it in its figure, else ``alt``, else ``title``).
Payloads live in a content-addressed store, a written table of ``(digest, media)``;
references meet their payloads, or features of them, by an equi-join on the digest that
deals a digest of many references over several tasks.

A payload of 8-bit samples is stored as a grayscale PNG of ``WIDTH`` columns, which
keeps every byte.  A task writes each digest once; equal rows of several tasks meet
in an aggregate over the small features, so payloads are never shuffled and a text
held by a third of all documents costs one row a task.

The query shows every document as a page: its first line, a figure whose payload is
the whole text, then its other lines.

Defined cases: null HTML and a page without content give an empty sequence; a caption
outside a figure is text; a caption, ``noscript`` or ``template`` that is never closed
ends at the next block or is read as if it were not there, so nothing after it is lost;
of several addresses of one element (``src``, ``data-src``, ``data``, the first of
``srcset``) the first counts; a reference whose digest the store lacks keeps its place
with null payload columns; a null text is an empty payload (576 bytes of 255); repeated
rows give equal rows; null ids pass through; other columns are never read; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, keyed, numbered, place, salted_join, spread, table, written

WIDTH = 576
SCHEME = "sha256:"
ITEM = "struct<position:int,kind:string,text:string,digest:string,caption:string>"
_SKIP = {"script", "style", "template", "noscript"}
_MEDIA = {"img", "video", "audio", "source", "embed", "object"}
_ADDRESS = ("src", "data-src", "data", "srcset", "data-srcset")
_BLOCKS = {"p", "div", "section", "article", "li", "ul", "ol", "table", "tr", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6", "br", "hr", "pre", "blockquote", "figure", "figcaption", "nav", "header", "footer", "main", "aside", "title", "body", "html"}
_SPACE = re.compile(r"\s+")


class _Sequence(HTMLParser):
    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.html, self.lower = html, None
        self.items: list[dict] = []
        self.words: list[str] = []
        self.skip: list[str] = []
        self.figure: list[dict] | None = None
        self.caption: list[str] | None = None
        self.said: str | None = None
        self.closed = True
        self.feed(html)
        self.close()
        self.end_figure()
        self.flush()

    def closes(self, tag: str) -> bool:
        """Whether an end tag follows before the next start of the same kind."""
        if self.lower is None:
            self.lower = self.html.lower()
            self.lines = [0, *(m.end() for m in re.finditer("\n", self.html))]
        line, at = self.getpos()
        at += self.lines[line - 1] + 1
        end, again = self.lower.find(f"</{tag}", at), self.lower.find(f"<{tag}", at)
        return end >= 0 and (again < 0 or end < again)

    def flush(self) -> None:
        text = _SPACE.sub(" ", "".join(self.words)).strip()
        self.words = []
        if text:
            self.items.append({"position": len(self.items), "kind": "text", "text": text, "digest": None, "caption": None})

    def end_caption(self) -> None:
        if self.caption is not None:
            self.said = _SPACE.sub(" ", " ".join(x for x in (self.said or "", "".join(self.caption)) if x)).strip() or None
            self.caption = None

    def end_figure(self) -> None:
        self.end_caption()
        if self.figure is not None:
            for item in self.figure:
                item["caption"] = self.said or item["caption"]
            if self.said and not self.figure:  # a figure without media keeps its caption as text
                self.words.append(self.said)
                self.flush()
        self.figure, self.said = None, None

    def handle_starttag(self, tag, attrs):
        if tag in ("noscript", "template"):
            if self.closes(tag):
                self.skip.append(tag)
        elif tag in _SKIP:
            self.skip.append(tag)
        if self.caption is not None and not self.closed and (tag in _BLOCKS or tag in _MEDIA):
            self.end_caption()
        if tag == "figure":
            self.end_figure()
        if tag in _BLOCKS or tag in _MEDIA:
            if self.caption is None:
                self.flush()
            else:
                self.caption.append(" ")
        if tag == "figure":
            self.figure = []
        if tag == "figcaption" and self.figure is not None and not self.skip:
            self.end_caption()
            self.caption, self.closed = [], self.closes(tag)
        a = dict(attrs)
        src = next((x for x in (a.get(k) for k in _ADDRESS) if x), None)
        if tag in _MEDIA and src and not self.skip:
            if "src" not in a and "data-src" not in a and "data" not in a:
                src = src.strip().split(",")[0].split()[0] if src.strip(", ") else ""
            item = {"position": len(self.items), "kind": "media", "text": None, "digest": reference(src), "caption": a.get("alt") or a.get("title") or None}
            self.items.append(item)
            if self.figure is not None:
                self.figure.append(item)

    def handle_endtag(self, tag):
        if tag in self.skip:
            self.skip.remove(tag)
        if tag == "figcaption":
            self.end_caption()
        if tag in _BLOCKS and self.caption is None:
            self.flush()
        if tag == "figure":
            self.end_figure()

    def handle_data(self, data):
        if not self.skip:
            (self.words if self.caption is None else self.caption).append(data)


def reference(src: str) -> str:
    """The digest a ``sha256:`` address names, else the digest of the address itself."""
    return src[len(SCHEME) :] if src.startswith(SCHEME) else hashlib.sha256(src.encode("utf-8", "surrogatepass")).hexdigest()


def sequence(html: str | None) -> list[dict]:
    return _Sequence(html or "").items


def sequences(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``(id, items)``: the ordered structs of each page."""
    kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([column(b, "id"), pa.array([sequence(t.as_py()) for t in column(b, "text")], kind)], names=["id", "items"])

    return keyed(pages, id_col, html_col).mapInArrow(fn, f"id long, items array<{ITEM}>")


def references(seqs: DataFrame) -> DataFrame:
    """``(id, n_items, texts_sha256, position, digest, caption)`` of the media references; the digest of the text items goes along."""
    texts = F.transform(F.filter("items", lambda x: x["kind"] == "text"), lambda x: x["text"])
    rows = seqs.select("id", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws("\n", texts).cast("binary"), 256).alias("texts_sha256"), F.explode(F.filter("items", lambda x: x["kind"] == "media")).alias("m"))
    return rows.select("id", "n_items", "texts_sha256", "m.position", "m.digest", "m.caption")


def resolve(refs: DataFrame, store: DataFrame) -> DataFrame:
    """References with the columns of their payload, by an equi-join on the digest; unknown digests keep nulls."""
    return salted_join(refs, store, "digest", ["id", "position"])


# -- stored payloads ------------------------------------------------------


def padded(raw: bytes) -> bytes:
    return raw + b"\xff" * (-len(raw) % WIDTH or (0 if raw else WIDTH))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(payload: bytes) -> bytes:
    """8-bit grayscale, no filter, one row of ``WIDTH`` samples after another."""
    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), dtype=np.uint8)
    rows[:, 1:] = np.frombuffer(payload, dtype=np.uint8).reshape(-1, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + _chunk(b"IEND", b"")


def decode_png(media: bytes) -> bytes:
    at, data, width = 8, [], WIDTH
    while at < len(media):
        n, kind = struct.unpack(">I4s", media[at : at + 8])
        body = media[at + 8 : at + 8 + n]
        if struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + body):
            raise ValueError("a chunk's checksum differs")
        if kind == b"IHDR":
            width = struct.unpack(">I", body[:4])[0]
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    return np.frombuffer(zlib.decompress(b"".join(data)), dtype=np.uint8).reshape(-1, width + 1)[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Rows, mean, deviation, 16-bin histogram in thousandths, and an 8 by 8 average hash of the samples."""
    x = np.frombuffer(payload, dtype=np.uint8).reshape(-1, WIDTH)
    counts = np.bincount(x.reshape(-1), minlength=256)
    n, levels = x.size, np.arange(256)
    total = int(counts @ levels)
    var = int(counts @ levels**2) / n - (total / n) ** 2
    share = (counts.reshape(16, 16).sum(axis=1) * 1000 + n // 2) // n
    columns = x.reshape(len(x), 8, WIDTH // 8).sum(axis=2, dtype=np.int64)
    bands = np.add.reduceat(columns, np.minimum(np.arange(8) * len(x) // 8, len(x) - 1), axis=0)
    size = np.maximum(np.diff(np.append(np.arange(8) * len(x) // 8, len(x))), 1) * (WIDTH // 8)
    bits = bands * n > total * size[:, None]
    return f"{len(x)}|{total / n:.4f}|{max(var, 0.0) ** 0.5:.4f}|{','.join(map(str, share))}|{np.packbits(bits).tobytes().hex()}"


def store_texts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The written store of the texts' payloads: ``(digest, n_bytes, media)``; the digest is that of the UTF-8 text."""
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in batches:
            digest, size, media = [], [], []
            for t in column(b, "text"):
                raw = (t.as_py() or "").encode("utf-8", "surrogatepass")
                d = hashlib.sha256(raw)
                if d.digest() not in seen:
                    seen.add(d.digest())
                    digest.append(d.hexdigest())
                    size.append(len(raw))
                    media.append(encode_png(padded(raw)))
            yield pa.RecordBatch.from_arrays([pa.array(digest, pa.string()), pa.array(size, pa.int64()), pa.array(media, pa.binary())], names=["digest", "n_bytes", "media"])

    return written(spread(numbered(docs).select(F.col(place(docs, text_col)).cast("string").alias("text"))).mapInArrow(fn, "digest string, n_bytes long, media binary"), "media")


MEASURED = "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def measured(store: DataFrame) -> DataFrame:
    """The stored bytes read back: one row a digest."""
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for m in column(b, "media"):
                media = m.as_py()
                p = decode_png(media)
                rows.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(p)))
            cols = [*zip(*rows, strict=True)] or [[]] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([column(b, "digest"), column(b, "n_bytes"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[x.split()[0] for x in MEASURED.split(", ")])

    each = store.mapInArrow(fn, MEASURED)
    rest = [x.split()[0] for x in MEASURED.split(", ")][1:]
    return each.groupBy("digest").agg(F.min(F.struct(*rest)).alias("m")).select("digest", "m.*")


def page_of(text: F.Column, id_: F.Column) -> F.Column:
    """A document as HTML: its first line, a figure whose payload is the text, its other lines."""
    text = F.coalesce(text, F.lit(""))
    safe = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    lines = F.split(safe, "\n", 2)
    rest = F.coalesce(F.concat(F.lit("<p>"), F.replace(F.try_element_at(lines, F.lit(2)), F.lit("\n"), F.lit("</p><p>")), F.lit("</p>")), F.lit(""))
    figure = F.concat(F.lit(f'<figure><img src="{SCHEME}'), F.sha2(text.cast("binary"), 256), F.lit('"><figcaption>text of document '), F.coalesce(id_.cast("string"), F.lit("unknown")), F.lit("</figcaption></figure>"))
    return F.concat(F.lit("<p>"), lines[0], F.lit("</p>"), figure, rest)


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document as a page around a figure of its text; the figure's payload is stored, joined by digest and measured."""
    d = numbered(docs)
    pages = d.select(F.col(place(docs, id_col)).alias("id"), page_of(F.col(place(docs, text_col)).cast("string"), F.col(place(docs, id_col))).alias("html"))
    refs = written(references(sequences(pages, "id", "html")), "refs")
    found = resolve(refs, measured(store_texts(docs, text_col)))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption", "n_items", "texts_sha256")


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media(table(spark, sf_dir, "documents"))
