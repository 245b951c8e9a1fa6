"""Byte-level BPE by longest matches and backtracking, and back to bytes."""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ship

#: Entries of a worker's young table of encoded matches, and of its table of compared neighbours.
REMEMBERED, COMPARED = 200_000, 500_000
#: Longer matches aren't remembered.
LONGEST = 64
#: Texts of more characters are cut into matches so many at a time; a batch of results ends past so many ids.
LONG_TEXT, MATCHES, IDS = 1 << 20, 1 << 16, 1 << 20
#: Stands for no rank; greater than any.
NO_RANK = 1 << 62


class ByteMerges:
    """The byte-pair merges of a rank file, without merging.

    Bytes are characters of Latin-1, so that an Aho-Corasick automaton finds all tokens of a match in one pass. A
    sequence of tokens is the merges' result exactly if each token comes out of its own bytes, and each two neighbours
    out of theirs: the first merge across a boundary would also come first between the two tokens alone. So the longest
    token goes at each place, a shorter one where neighbours don't agree, and back where none does. A prefix has one
    result only, so a place that failed once fails always; each place is entered once, the work is linear."""

    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick

        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the ranks have no token for bytes {missing}")
        self.ranks = {token.decode("latin-1"): rank for token, rank in ranks.items()}
        self.text = {rank: token for token, rank in self.ranks.items()}
        self.base = max(self.text) + 1
        whole = [t for t, rank in self.ranks.items() if self.merged(t) == [rank]]
        self.length = {self.ranks[t]: len(t) for t in whole}
        self.automaton = ahocorasick.Automaton()
        for t in whole:
            self.automaton.add_word(t, self.ranks[t])
        self.automaton.make_automaton()
        #: The longest token that a token starts with, itself left out; -1 if there is none.
        self.shorter = {}
        for t in whole:
            starts = (self.ranks.get(t[:n], -1) for n in range(len(t) - 1, 0, -1))
            self.shorter[self.ranks[t]] = next((x for x in starts if x in self.length), -1)
        self.agreed: dict[int, bool] = {}
        #: Encoded matches: a full young table becomes the old one, from which matches that come again move back.
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def merged(self, text: str) -> list[int]:
        """The merges themselves: lowest rank first, leftmost among equals. Only for a token or two."""
        get, parts = self.ranks.get, list(text)
        found = [get(a + b, NO_RANK) for a, b in zip(parts, parts[1:])]
        while found and (rank := min(found)) != NO_RANK:
            at = found.index(rank)
            parts[at] += parts.pop(at + 1)
            del found[at]
            if at:
                found[at - 1] = get(parts[at - 1] + parts[at], NO_RANK)
            if at < len(found):
                found[at] = get(parts[at] + parts[at + 1], NO_RANK)
        return [get(x, -1) for x in parts]

    def agree(self, a: int, b: int) -> bool:
        """Whether the merges leave these two neighbours apart."""
        if len(self.agreed) >= COMPARED:
            self.agreed.clear()
        found = self.agreed[a * self.base + b] = self.merged(self.text[a] + self.text[b]) == [a, b]
        return found

    def match(self, text: str) -> tuple[int, ...]:
        """Ids of one match of the pattern, given as Latin-1."""
        if text in self.ranks:
            return (self.ranks[text],)
        n, base, length, shorter, agreed = len(text), self.base, self.length, self.shorter, self.agreed
        ids, last, at = [], -1, 0
        for end, token in self.automaton.iter_long(text):  # the longest at each place, until two neighbours don't agree
            if last >= 0:
                apart = agreed.get(last * base + token)
                if not (self.agree(last, token) if apart is None else apart):
                    break
            ids.append(token)
            last, at = token, end + 1
        if at == n:
            return tuple(ids)
        longest = array("i", bytes(4 * n))
        for end, token in self.automaton.iter(text):  # ends go up, so the last token noted at a start is the longest
            longest[end - length[token] + 1] = token
        failed, token = bytearray(n + 1), longest[at]
        while at < n:
            last = ids[-1] if ids else -1
            while token >= 0:
                if not failed[at + length[token]]:
                    apart = last < 0 or agreed.get(last * base + token)
                    if self.agree(last, token) if apart is None else apart:
                        break
                token = shorter[token]
            if token >= 0:
                ids.append(token)
                at += length[token]
                token = longest[at] if at < n else -1
            else:
                failed[at] = 1
                ids.pop()
                at -= length[last]
                token = shorter[last]
        return tuple(ids)

    def encode(self, matches: list[str]) -> bytes:
        """Ids of a text's matches, each four bytes in the machine's order."""
        young, old, long = self.young, self.old, {}
        new = set(matches).difference(young)
        if len(young) + len(new) > REMEMBERED and young:
            self.old, self.young = old, young = young, {}
            new = set(matches)
        for x in new:
            ids = old.get(x)
            if ids is None:
                ids = array("i", self.match(x.encode().decode("latin-1"))).tobytes()
            if len(x) <= LONGEST:
                young[x] = ids
            else:
                long[x] = ids
        if long:
            return b"".join([long[x] if x in long else young[x] for x in matches])
        return b"".join(map(young.__getitem__, matches))


def read_ranks(path: str) -> dict[bytes, int]:
    """Token and rank of each line of a rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


@lru_cache(maxsize=4)
def _merges(path: str) -> ByteMerges:
    return ByteMerges(read_ranks(path))


@lru_cache(maxsize=4)
def _bytes(path: str) -> dict[int, bytes]:
    return {rank: token for token, rank in read_ranks(path).items()}


def _matches(pattern, text: str) -> Iterator[list[str]]:
    if len(text) <= LONG_TEXT:
        yield pattern.findall(text)
        return
    found = pattern.finditer(text)
    while part := [m.group() for m in islice(found, MATCHES)]:
        yield part


def encode(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """(doc_id, text) to doc_id, ids: the ids of whole texts by the rank file at path ``ranks``, matches of ``pattern`` one by one.

    As the library's encode_ordinary: strings that look like special tokens are ordinary text. Null and empty texts
    have no ids. One row for each row, ids null or repeated included; other columns are ignored; an empty table gives
    none. A worker holds a batch of texts and at most some ``IDS`` ids besides the longest text's; matches of any
    length take linear time."""
    ship(docs.sparkSession)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        cut, merges = regex.compile(pattern), _merges(ranks)
        for batch in batches:
            ids, ends, first = [], [0], 0
            for at, text in enumerate(batch.column("text")):
                found = [merges.encode(matches) for matches in _matches(cut, text.as_py() or "")]
                ids += found
                ends.append(ends[-1] + sum(map(len, found)) // 4)
                if ends[-1] >= IDS or at + 1 == batch.num_rows:
                    whole = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(b"".join(ids))])
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), whole)
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id")[first : at + 1], lists], names=["doc_id", "ids"])
                    ids, ends, first = [], [0], at + 1

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(encoded, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks: str) -> DataFrame:
    """(doc_id, ids) to doc_id, ids, bytes: what the ids stand for. Null ids: no bytes. An id without a token is an error."""
    ship(encoded.sparkSession)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = _bytes(ranks).__getitem__
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                joined = [b"".join(map(token, x.values.to_numpy(zero_copy_only=False).tolist())) if x.is_valid else b"" for x in part.column("ids")]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(joined, pa.binary())], names=["doc_id", "ids", "bytes"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(decoded, "doc_id long, ids array<int>, bytes binary")
