"""Packing token sequences: bounded-space best fit within a partition, then merging of what is left over."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, ship

PIECES = "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, partition long, open boolean"
#: Entries of a task's table of encoded words; when full it starts anew.
REMEMBERED = 300_000
#: Words whose lower case and parts don't depend on Unicode tables, and the parts.
PLAIN_TEXT = re.compile("[\\t\\n\\r\x20-\x7eÀ-ÖØ-öø-ÿ]*")
PLAIN = re.compile("[\x21-\x7eÀ-ÖØ-öø-ÿ]+")
PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9\\s]+")
ASCII_SPACE = re.compile("[ \t\n\r]+")
#: Leftover windows that are merged together: a group holds at most so many, whatever the corpus.
MERGED_TOGETHER = 512
#: Sequence ids: the partition (or group of leftovers) times this, plus a counter.
STRIDE = 1 << 32


class WordEncoder:
    """A ``tokenizers`` BPE file whose pre-tokenizer drops white space, applied to remembered parts of texts.

    A text of ASCII and Latin-1 letters is lower-cased and cut as the file's pre-tokenizer does; parts are encoded once.
    In other texts, words that hold other characters are left to the library whole, for white space is never part of a
    token. A text that holds an added token is encoded as a whole."""

    def __init__(self, path: str):
        import json

        import numpy as np
        from tokenizers import Tokenizer

        self.np, self.tokenizer = np, Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.added = [x["content"] for x in json.load(f)["added_tokens"]]
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        self.ends[[i for x, i in self.tokenizer.get_vocab().items() if x.endswith("</w>")]] = True
        self.seen: dict[str, bytes] = {}

    def _bytes(self, texts: list[str]) -> list[bytes]:
        return [self.np.asarray(self.tokenizer.encode(x, add_special_tokens=False).ids, dtype="<u4").tobytes() for x in texts]

    def _split(self, parts: list[str]) -> list[bytes]:
        """The ids of each part, encoded together: white space sets parts apart, and a token that ends a word ends each."""
        ids = self.np.asarray(self.tokenizer.encode_batch_fast([" ".join(parts)], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = (4 * (self.np.flatnonzero(self.ends[ids]) + 1)).tolist()
        if len(ends) != len(parts):
            return self._bytes(parts)
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *ends], ends)]

    def __call__(self, text: str) -> bytes:
        """The ids of ``text``, little-endian, four bytes each."""
        if any(x in text for x in self.added):
            return self._bytes([text])[0]
        if PLAIN_TEXT.fullmatch(text):
            parts = PARTS.findall(text.lower())
        else:
            parts = [y for x in ASCII_SPACE.split(text) for y in (PARTS.findall(x.lower()) if PLAIN.fullmatch(x) else [x])]
        seen = self.seen
        new = [x for x in set(parts) if x not in seen]
        if new:
            if len(seen) + len(new) > REMEMBERED:
                seen.clear()
                new = list(set(parts))
            plain = [x for x in new if PLAIN.fullmatch(x)]
            for at in range(0, len(plain), 2000):
                few = plain[at : at + 2000]
                seen.update(zip(few, self._split(few), strict=True))
            if len(plain) < len(new):
                rest = [x for x in new if x not in seen]
                seen.update(zip(rest, self._bytes(rest), strict=True))
        return b"".join(map(seen.__getitem__, parts))


class Windows:
    """A fixed number of open windows. ``place`` takes a piece and gives the windows that it closes."""

    def __init__(self, size: int, open_windows: int):
        self.size, self.most, self.open = size, open_windows, []

    def place(self, piece: tuple) -> list[list]:
        """piece: (name, start, ids as bytes, tokens of the document). Best fit; if none fits and all windows are
        taken, the fullest is topped up with the piece's head and emitted, and the rest is placed."""
        done, (name, start, ids, tokens) = [], piece
        while ids:
            n = len(ids) // 4
            if n >= self.size:
                done.append([(name, start, ids[: 4 * self.size], tokens)])
                start, ids = start + self.size, ids[4 * self.size :]
                continue
            fits = [w for w in self.open if self.size - w[0] >= n]
            if fits:
                window = max(fits, key=lambda w: w[0])
            elif len(self.open) < self.most:
                window = [0, []]
                self.open.append(window)
            else:
                window = max(self.open, key=lambda w: w[0])
                n = self.size - window[0]
            window[0] += n
            window[1].append((name, start, ids[: 4 * n], tokens))
            start, ids = start + n, ids[4 * n :]
            if window[0] == self.size:
                self.open.remove(window)
                done.append(window[1])
        return done

    def close(self) -> tuple[list[list], list]:
        """Pour the emptier windows into the fuller ones: full sequences, and at most one that isn't full."""
        windows, self.open, done = sorted(self.open, key=lambda w: -w[0]), [], []
        self.most = 1
        for w in windows:
            for piece in w[1]:
                done += self.place(piece)
        return done, self.open[0][1] if self.open else []


def _rows(sequence: list, sequence_id: int, partition: int, left: bool) -> Iterator[tuple]:
    offset = 0
    for name, start, ids, tokens in sequence:
        n = len(ids) // 4
        yield name, start, n, zlib.crc32(ids), tokens, sequence_id, offset, partition, left
        offset += n


def merge_leftovers(frame: pd.DataFrame, size: int, group: int) -> pd.DataFrame:
    """Whole leftover windows, longest first, each to the fullest sequence that has room for it."""
    lengths = frame.groupby("partition")["length"].sum().sort_values(ascending=False, kind="stable")
    bins: list[list[int]] = []  # [filled, sequence]
    place: dict[int, tuple[int, int]] = {}
    for partition, n in lengths.items():
        fits = [b for b in bins if size - b[0] >= n]
        if not fits:
            bins.append([0, len(bins)])
        b = max(fits, key=lambda x: (x[0], -x[1])) if fits else bins[-1]
        place[partition] = (-1 - group * STRIDE - b[1], b[0])
        b[0] += int(n)
    out = frame.copy()
    out["sequence_id"] = [place[p][0] for p in frame["partition"]]
    out["offset"] = [o + place[p][1] for o, p in zip(frame["offset"], frame["partition"], strict=True)]
    return out


def pack(docs: DataFrame, tokenizer: str, size: int = 4096, end_id: int = 2, open_windows: int = 32) -> DataFrame:
    """Pack documents (doc_id, text) into sequences of at most ``size`` ids of the ``tokenizers`` file ``tokenizer``.

    A document is its ids, then ``end_id``; null and empty texts are ``end_id`` alone. Each partition of the input
    keeps ``open_windows`` windows; a piece that fills a window exactly or tops up the fullest one is cut, so emitted
    windows are full. What a partition has left at its end is one window; these meet in groups of
    ``MERGED_TOGETHER`` partitions and are merged best fit. Returns doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, one row a piece. Rows with equal or null ids are packed as documents of their own; other
    columns are ignored; an empty table gives no rows. Sequence ids of merged leftovers are negative."""
    ship(docs.sparkSession)

    def packed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        encode, windows, partition = WordEncoder(tokenizer), Windows(size, open_windows), TaskContext.get().partitionId()
        end, made, columns = end_id.to_bytes(4, "little"), 0, [x.split()[0] for x in PIECES.split(", ")]
        for part in parts:
            rows: list[tuple] = []
            for name, text in zip(part["doc_id"], part["text"], strict=True):
                ids = (encode(text) if isinstance(text, str) else b"") + end
                for sequence in windows.place((name, 0, ids, len(ids) // 4)):
                    rows += _rows(sequence, partition * STRIDE + made, partition, False)
                    made += 1
            yield pd.DataFrame(rows, columns=columns)
        done, left = windows.close()
        rows = []
        for sequence in done:
            rows += _rows(sequence, partition * STRIDE + made, partition, False)
            made += 1
        rows += _rows(left, partition * STRIDE + made, partition, True)
        yield pd.DataFrame(rows, columns=columns)

    def merged(frame: pd.DataFrame) -> pd.DataFrame:
        return merge_leftovers(frame, size, int(frame["partition"].iloc[0]) // MERGED_TOGETHER)

    ids = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), "text")
    pieces = cut(ids.mapInPandas(packed, PIECES), "pieces")
    left = pieces.where("open").groupBy(F.floor(F.col("partition") / MERGED_TOGETHER)).applyInPandas(merged, PIECES)
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return pieces.where("NOT open").union(left).select(F.col("doc_id").cast("long").alias("doc_id"), *names)
