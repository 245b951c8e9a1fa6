"""Media columns: interleaved sequences of text and media references, with payloads resolved by digest."""

from __future__ import annotations

import hashlib
import html
import io
import re
import wave
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, ship

#: Payloads are filled up with zero bytes to a positive multiple of this.
UNIT = 64
#: Samples a second written into the header of a stored payload.
RATE = 8000
#: How a sequence refers to a payload: this, then its SHA-256.
SCHEME = "sha256:"
ITEMS = "array<struct<position:int,kind:string,text:string,digest:string,caption:string>>"
_TAG = re.compile(r"<!--.*?-->|<(script|style)\b[^>]*>.*?</\1\s*>|<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>", re.S | re.I)
_ATTRIBUTE = re.compile(r"""([\w-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_MEDIA = {"img", "audio", "video", "source"}
#: Start tags, and ends of figures and what is around them, that end a caption with words in it.
_NEXT = {"article", "body", "div", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "html", "li", "main", "ol", "p", "section", "table", "ul"} | _MEDIA
_OUTER = {"article", "body", "figure", "html", "main", "section"}
_INLINE = {"a", "b", "i", "em", "strong", "span", "u", "s", "sub", "sup", "small", "code", "mark"}


def interleave(page: str | None) -> list[dict]:
    """Text blocks and media references of a page, in order, positions from 0.

    A reference's digest is that of a ``sha256:`` address, else null; its caption is the figure's, or its alt text. A
    caption that isn't closed ends with its figure, or where the next block starts; no text is lost to it."""
    items: list[dict] = []
    text, at, figure, caption, ahead = [], 0, [], None, ""

    def add(words: str) -> None:
        if words:
            items.append({"position": len(items), "kind": "text", "text": words, "digest": None, "caption": None})

    def flush() -> None:
        words = " ".join(html.unescape("".join(text)).split())
        text.clear()
        add(words)

    def captioned() -> None:
        nonlocal caption, ahead
        words = " ".join(html.unescape("".join(caption or [])).split())
        for item in figure:
            item["caption"] = words or item["caption"]
        if not figure:  # its media may follow
            add(ahead)
            ahead = words
        caption = None

    page = page or ""
    for m in [*_TAG.finditer(page), None]:
        run = page[at : m.start() if m else len(page)]
        at = m.end() if m else at
        (caption if caption is not None else text).append(run)
        tag = (m[3] or "").lower() if m else ""
        if m and (not tag or tag in _INLINE):
            continue
        if tag == "figcaption" and not m[2]:
            flush()
            if caption is not None:
                captioned()
            caption = []
            continue
        if caption is not None:
            if tag == "figcaption" or not m or (tag in _OUTER if m[2] else tag in _NEXT and "".join(caption).strip()):
                captioned()
            else:
                caption.append(" ")
        if tag == "figcaption":
            continue
        if caption is None:
            flush()
        if tag in _OUTER or not m:
            add(ahead)  # a caption of nothing is text
            figure, ahead = [], ""
        if tag in _MEDIA and not m[2]:
            given = {k.lower(): html.unescape(a or b or c) for k, a, b, c in _ATTRIBUTE.findall(m[4])}
            if src := given.get("src"):
                digest = src[len(SCHEME) :] if src.startswith(SCHEME) else None
                items.append({"position": len(items), "kind": "media", "text": src, "digest": digest, "caption": ahead or given.get("alt")})
                figure.append(items[-1])
                ahead = ""
    return items


def payload(text: str | None) -> bytes:
    """UTF-8 of a text (null: empty), filled with zero bytes to a positive multiple of ``UNIT``."""
    raw = (text or "").encode()
    return raw + bytes(max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def store(data: bytes) -> bytes:
    """The payload as 8-bit mono samples in a WAV container."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(data)
    return out.getvalue()


def read_back(stored: bytes) -> bytes:
    with wave.open(io.BytesIO(stored), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("expected 8-bit mono samples")
        return w.readframes(w.getnframes())


def feature(samples: bytes) -> str:
    """Samples, mean and energy around the centre in 1/1000, crossings of the centre, and an 8-bin histogram."""
    import numpy as np

    x = np.frombuffer(samples, dtype=np.uint8)
    counts = np.bincount(x, minlength=256).astype(np.int64)
    values, n = np.arange(256, dtype=np.int64) - 128, len(x)
    total, square = int((counts * values).sum()), int((counts * values * values).sum())
    high = x >= 128
    crossings = int(np.count_nonzero(high[1:] != high[:-1]))
    bins = counts.reshape(8, 32).sum(axis=1)
    return f"n={n};mean={total * 1000 // n};energy={square * 1000 // n};crossings={crossings};hist={','.join(map(str, bins))}"


def media_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to doc_id, page, digest, n_bytes, media: each text stored as media, and a page that shows it."""
    ship(docs.sparkSession)

    def stored(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at in range(0, len(part), 256):
                few = part.iloc[at : at + 256]
                rows = []
                for name, text in zip(few["doc_id"], few["text"], strict=True):
                    text = text if isinstance(text, str) else ""
                    data = payload(text)
                    digest = hashlib.sha256(data).hexdigest()
                    n = len(text.encode())
                    page = f'<article><p>Document {name}</p><figure><img src="{SCHEME}{digest}" alt="samples"><figcaption>{n} bytes</figcaption></figure></article>'
                    rows.append((name, page, digest, n, store(data)))
                yield pd.DataFrame(rows, columns=["doc_id", "page", "digest", "n_bytes", "media"])

    ids = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), "text")
    return ids.mapInPandas(stored, "doc_id string, page string, digest string, n_bytes long, media binary")


def sequences(pages: DataFrame) -> DataFrame:
    """Adds ``items``, the interleaved sequence of the column ``page`` (null or empty: no items)."""
    ship(pages.sparkSession)

    @F.pandas_udf(ITEMS)
    def parsed(page: pd.Series) -> pd.Series:
        return page.map(lambda x: interleave(x if isinstance(x, str) else None))

    return pages.withColumn("items", parsed("page"))


def described(media: DataFrame) -> DataFrame:
    """(digest, media) to one row a digest: what is read back from the stored bytes. Copies are dropped before the shuffle's end."""
    ship(media.sparkSession)
    schema = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for digest, stored in zip(part["digest"], part["media"], strict=True):
                data = read_back(stored)
                rows.append((digest, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-UNIT:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(data)))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")])

    rows = media.select("digest", "media").mapInPandas(read, schema)
    return rows.groupBy("digest").agg(*[F.first(c).alias(c) for c in rows.columns[1:]])


def resolve(pages: DataFrame, payloads: DataFrame, keys: list[str]) -> DataFrame:
    """Pages with ``items`` to one row a media reference that has a digest, with its payload's columns.

    Keys, position and caption stay with the reference; a digest that no payload has leaves its columns null."""
    references = pages.select(*keys, F.explode("items").alias("_i")).where("_i.digest IS NOT NULL")
    flat = references.select(*keys, F.col("_i.position").alias("position"), F.col("_i.caption").alias("caption"), F.col("_i.digest").alias("digest"))
    return flat.join(payloads, "digest", "left")


def media_features(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to doc_id, n_bytes, payload and stored sizes, digests and features, one row for each row.

    Each text is stored losslessly as 8-bit samples and shown on a page by its digest. The table of stored media is
    written to the shared folder and read back; pages are parsed into sequences and their references joined to what
    was read, by digest, so equal texts get equal values. Null and empty texts are 64 zero bytes; null and repeated
    ids and other columns pass; an empty table gives no rows."""
    rows = cut(media_rows(docs), "media")
    payloads = cut(described(rows), "payloads")
    found = resolve(sequences(rows.select("doc_id", "n_bytes", "page")), payloads, ["doc_id", "n_bytes"])
    columns = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption"]
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), *columns)
