"""Token counts by heap-and-linked-list byte-pair merging: symbols less merges, without any identifier."""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ship

#: What the vocabulary writes for a space.
SPACE = "▁"
#: Segments that no merge crosses: spaces, then what follows them. Sentences are cut where spaces begin.
SEGMENT = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
#: Entries of a task's table of counted segments; when full it starts anew.
REMEMBERED = 200_000


class Pairs(dict):
    """Rank of the piece that two adjacent symbols make, by ``left * base + right``; -1 if there is none."""

    def __init__(self, pieces: list[str]):
        super().__init__()
        self.pieces, self.rank, self.base = pieces, {x: r for r, x in enumerate(pieces)}, len(pieces) + 1

    def __missing__(self, key: int) -> int:
        a, b = divmod(key, self.base)
        if a >= len(self.pieces) or b >= len(self.pieces):
            return -1
        if len(self) >= REMEMBERED:
            self.clear()
        self[key] = rank = self.rank.get(self.pieces[a] + self.pieces[b], -1)
        return rank


class PieceMerges:
    """Merge ranks of a sentencepiece BPE model with byte fallback, identity normaliser and a space put in front.

    A symbol is known by its piece's rank, and so is the piece that a merge makes."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = [i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        pieces = [model.id_to_piece(i) for i in sorted(normal, key=lambda i: (-model.get_score(i), i))]
        if any(SPACE in x.lstrip(SPACE) for x in pieces):
            raise ValueError("a piece goes on after a space inside it; segments can't be merged one by one")
        self.pairs, self.seen = Pairs(pieces), {}
        #: Neighbours that some piece holds side by side. No merge crosses any other boundary.
        self.neighbours = {x[i : i + 2] for x in pieces for i in range(len(x) - 1)}
        self.parts: dict[str, int] = {}

    def merges(self, part: str) -> int:
        """Tokens of a part: a heap of adjacent pairs by rank, then place, over a linked list of symbols."""
        pairs, rank, base, n = self.pairs, self.pairs.rank, self.pairs.base, len(part)
        ids = [rank.get(c, base - 1) for c in part]
        # a symbol outside the vocabulary falls back to its bytes
        tokens = n if base - 1 not in ids else sum(1 if c in rank else len(c.encode()) for c in part)
        heap = [r * n + i for i in range(n - 1) if (r := pairs[ids[i] * base + ids[i + 1]]) >= 0]
        heapify(heap)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        while heap:
            r, i = divmod(heappop(heap), n)
            j = right[i]
            if j >= n or ids[i] < 0 or pairs[ids[i] * base + ids[j]] != r:
                continue  # one of the two has merged elsewhere since
            ids[i], ids[j] = r, -1
            right[i] = k = right[j]
            tokens -= 1
            if k < n:
                left[k] = i
                if (s := pairs[r * base + ids[k]]) >= 0:
                    heappush(heap, s * n + i)
            h = left[i]
            if h >= 0 and (s := pairs[ids[h] * base + r]) >= 0:
                heappush(heap, s * n + h)
        return tokens

    def segment(self, segment: str) -> int:
        """Tokens of a segment, part by part; parts end where no piece has the two neighbours side by side."""
        total, start, parts, neighbours = 0, 0, self.parts, self.neighbours
        cuts = [i for i, pair in enumerate(zip(segment, segment[1:]), 1) if pair[0] + pair[1] not in neighbours]
        for end in [*cuts, len(segment)]:
            part = segment[start:end]
            start = end
            if len(part) == 1:
                total += 1 if part in self.pairs.rank else len(part.encode())
                continue
            n = parts.get(part)
            if n is None:
                if len(parts) >= REMEMBERED:
                    parts.clear()
                parts[part] = n = self.merges(part)
            total += n
        return total

    def count(self, text: str) -> int:
        if not text:
            return 0
        segments, seen = SEGMENT.findall(SPACE + text.replace(" ", SPACE)), self.seen
        new = [x for x in set(segments) if x not in seen]
        if new:
            if len(seen) + len(new) > REMEMBERED:
                seen.clear()
                new = set(segments)
            seen.update((x, self.segment(x)) for x in new)
        return sum(map(seen.__getitem__, segments))


def token_counts(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """(doc_id, text) to doc_id, n_bytes, n_tokens, over_limit by the sentencepiece BPE model at path ``model``.

    Counts are of whole texts, as the library's encode() without begin or end tokens; strings that look like special
    tokens are ordinary text. Null and empty texts have 0 bytes and 0 tokens; one row for each row, ids null or
    repeated included; other columns are ignored. A task keeps at most ``REMEMBERED`` segments (and those of the
    text at hand); the work on a segment grows as n log n."""
    ship(docs.sparkSession)

    def counted(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        merges = PieceMerges(model)
        for part in parts:
            texts = [x if isinstance(x, str) else "" for x in part["text"]]
            yield pd.DataFrame({"doc_id": part["doc_id"], "n_bytes": [len(x.encode()) for x in texts], "n_tokens": [merges.count(x) for x in texts]})

    out = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), "text").mapInPandas(counted, "doc_id string, n_bytes long, n_tokens long")
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
