"""Line dedup: MinHash of character shingles, banding, exact Jaccard, union-find; one line of a component stays.

DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, may_hold, word_count
from tessera.llm.linking import link, with_leaders

#: Bands of rows. Lines of similarity 0.8 share no band with probability 3e-4.
BANDS, ROWS = 8, 2
#: Lines of fewer words are left alone unless a call says otherwise; op2_lines and the pipeline take ``ALL``.
LEAST_WORDS = 5
#: Every line that isn't blank takes part.
ALL = 1
#: Characters of a shingle. One starts at every character that has as many from it on.
SHINGLE = 16
#: Shingles that a row of the signatures' input stands for.
STRIDE = 16
#: Longs of a bitmap of shingles. Bits that differ between two bitmaps are no more than the shingles that differ.
LONGS = 16
#: Bytes of a character.
_WIDE = 4


def _characters(line: Column) -> Column:
    """The line in lower case, four bytes a character, so that any run of characters is cut out at once."""
    return F.encode(F.lower(line), "UTF-32")


def _last(characters: Column) -> Column:
    """Where the last shingle starts; a shorter line has one shingle, at 1."""
    return F.greatest(F.lit(1), F.octet_length(characters) - (_WIDE * SHINGLE - 1))


def _shingle(characters: Column, at: Column) -> Column:
    return F.xxhash64(F.substring(characters, at, F.lit(_WIDE * SHINGLE)))


def shingles(line: Column) -> Column:
    """The set of the line's shingles, as hashes: all runs of ``SHINGLE`` characters, or the whole of a shorter line."""
    make = lambda x: F.array_distinct(F.transform(F.sequence(F.lit(1), _last(x), F.lit(_WIDE)), lambda p: _shingle(x, p)))
    return F.transform(F.array(_characters(line)), make)[0]


def _alike(a: Column, b: Column, percent: int) -> Column:
    """Is the Jaccard similarity of two sets ``percent`` or more? Either is computed once."""
    return F.exists(F.array(F.struct(a.alias("a"), b.alias("b"))), lambda x: (100 + percent) * F.size(F.array_intersect(x["a"], x["b"])) >= percent * (F.size(x["a"]) + F.size(x["b"])))


def occurrences(docs: DataFrame, least_words: int) -> DataFrame:
    """(doc_id, r1, r2, text) to one row a line that counts: occ (its rank: null ids last, id, row, position), h1, h2, line."""
    lines = docs.select("doc_id", "r1", "r2", F.posexplode(F.split("text", "\n")).alias("pos", "raw")).withColumn("line", F.trim("raw"))
    lines = lines.where(F.length("line") >= 2 * least_words - 1)
    lines = lines.where(word_count(F.col("line")) >= least_words) if least_words > 1 else lines.where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    occ = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "r1", "r2", "pos")
    return lines.select(occ.alias("occ"), F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), "line")


def _signatures(lines: DataFrame) -> DataFrame:
    """One row a distinct line: h1, h2, its copies, and ``BANDS * ROWS`` minima of its shingles' hashes.

    Each minimum is under a hash of its own, so that bands fail apart: the mixed hash of a shingle changed by a
    constant. A row stands for ``STRIDE`` shingles (past the line's end for the last again); copies fall together in the partial sums."""
    wide = lines.select("h1", "h2", _characters(F.col("line")).alias("c"))
    wide = wide.select("h1", "h2", "c", _last(F.col("c")).alias("last"))
    rows = wide.select("h1", "h2", F.explode(F.sequence(F.lit(1), F.col("last"), F.lit(_WIDE * STRIDE))).alias("p"), "c", "last")
    made = [_shingle(F.col("c"), F.least(F.col("p") + _WIDE * k, F.col("last"))).alias(f"x{k}") for k in range(STRIDE)]
    rows = rows.select("h1", "h2", (F.col("p") == 1).alias("start"), *made)
    salts = [(i * 0x9E3779B97F4A7C15 + (1 << 63)) % (1 << 64) - (1 << 63) for i in range(1, BANDS * ROWS + 1)]
    minima = [F.min(F.least(*[F.xxhash64(F.col(f"x{k}").bitwiseXOR(F.lit(salt))) for k in range(STRIDE)])).alias(f"m{i}") for i, salt in enumerate(salts)]
    return rows.groupBy("h1", "h2").agg(*minima, F.count(F.when(F.col("start"), 1)).alias("copies"))


def _bitmaps(texts: DataFrame) -> DataFrame:
    """(node, line) to node, places (where a shingle starts) and ``LONGS`` longs: a bit for each shingle, by its hash."""
    wide = texts.select("node", _characters(F.col("line")).alias("c"))
    wide = wide.select("node", "c", _last(F.col("c")).alias("last"))
    h = wide.select("node", "c", F.explode(F.sequence(F.lit(1), F.col("last"), F.lit(_WIDE))).alias("p")).select("node", _shingle(F.col("c"), F.col("p")).alias("h"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("h").bitwiseAND(F.lit(63)).cast("int"))
    word = F.shiftright("h", 6).bitwiseAND(F.lit(LONGS - 1))
    return h.groupBy("node").agg(F.count("*").cast("int").alias("places"), *[F.bit_or(F.when(word == i, bit).otherwise(F.lit(0).cast("long"))).alias(f"w{i}") for i in range(LONGS)])


#: Columns of a bitmap.
_WORDS = [f"w{i}" for i in range(LONGS)]


def _likely(x, y, percent: int) -> Column:
    """False only for pairs that are no link: at most 100 - ``percent`` shingles of 100 + ``percent`` in both sets may differ.

    Sets have at most as many shingles as the line has places, and differ in at least as many as their bitmaps in bits."""
    apart = sum((F.bit_count(x(w).bitwiseXOR(y(w))) for w in _WORDS[1:]), F.bit_count(x("w0").bitwiseXOR(y("w0"))))
    return (100 + percent) * apart <= (100 - percent) * (x("places") + y("places"))


def _confirm(texts: DataFrame, bits: DataFrame, percent: int):
    """Confirms pairs on the full sets. Bitmaps rule out most before any line is moved; lines are, for sets are many times their size."""
    ends = lambda df, names: df.select(*[F.col(c).alias(n) for c, n in names.items()])
    sketch = lambda n, end: ends(bits, {"node": end, "places": f"{n}places"} | {w: f"{n}{w}" for w in _WORDS})

    def confirm(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sketch("a", "u"), "u").join(sketch("b", "v"), "v")
        near = both.where(_likely(lambda c: F.col(f"a{c}"), lambda c: F.col(f"b{c}"), percent)).select("u", "v")
        full = near.join(ends(texts, {"node": "u", "line": "a"}), "u").join(ends(texts, {"node": "v", "line": "b"}), "v")
        return full.where(_alike(shingles(F.col("a")), shingles(F.col("b")), percent)).select("u", "v")

    return confirm


def _confirm_blocks(texts: DataFrame, bits: DataFrame, keys: DataFrame, percent: int):
    """Confirms the pairs of blocks within the join, so that only links between components leave it.

    A pair is compared in the first bucket that both have, and in no other. Bitmaps rule out most pairs, and none that
    is a link; the others' full sets are compared."""

    def confirm(blocks: DataFrame) -> DataFrame:
        known = texts.join(blocks.select("node").distinct(), "node", "left_semi").join(bits, "node").join(keys, "node")
        full = cut(blocks.join(known, "node").select("bucket", "i", "j", "guest", "comp", "line", "k", "places", *_WORDS), "blocks")
        at = ["bucket", "i", "j"]
        # sets are made past the shuffle, where the two blocks meet
        full = full.repartition(*at).withColumn("s", shingles(F.col("line")))
        guests = full.where("guest").select(*at, F.col("comp").alias("u"), F.col("s").alias("a"), F.col("k").alias("p"), "places", *_WORDS).alias("x")
        hosts = full.where("NOT guest").select(*at, F.col("comp").alias("v"), F.col("s").alias("b"), F.col("k").alias("q"), "places", *_WORDS).alias("y")
        x, y = lambda c: F.col(f"x.{c}"), lambda c: F.col(f"y.{c}")
        first = F.coalesce(*[F.when(F.col("p")[i] == F.col("q")[i], F.col("p")[i]) for i in range(BANDS)])
        alike = (100 + percent) * F.size(F.array_intersect("a", "b")) >= percent * (F.size("a") + F.size("b"))
        found = guests.join(hosts, [x(k) == y(k) for k in at] + [(F.col("u") != F.col("v")) & (x("bucket") == first) & _likely(x, y, percent) & alike])
        return found.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()

    return confirm


def dropped_lines(docs: DataFrame, percent: int = 80, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, r1, r2, text) to (r1, r2, drop): positions of the lines that go, for the rows that lose any."""
    lines = occurrences(docs, least_words)
    nodes = _signatures(lines)
    # of near copies the line with most copies is likely what the others come from: it gets the least node and leads
    weight = 255 - F.least(F.lit(255), F.floor(8 * F.log2("copies"))).cast("long")
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id().bitwiseOR(F.shiftleft(weight, 55))), "nodes")
    bands = F.array(*[F.xxhash64(F.lit(i), *[f"m{i * ROWS + j}" for j in range(ROWS)]) for i in range(BANDS)])
    held = with_leaders(nodes.select("node", F.explode(bands).alias("bucket")).select("bucket", "node"))
    used = cut(nodes.select("node", "h1", "h2").join(held.select("node").distinct(), "node"), "used")
    there = may_hold(used, "h1")
    if there is not None:
        texts = lines.where(there).select("h1", "h2", "line").join(used, ["h1", "h2"])
        texts = cut(texts.groupBy("h1", "h2").agg(F.first("node").alias("node"), F.first("line").alias("line")).select("node", "line"), "texts")
        bits = cut(_bitmaps(texts), "bitmaps")
        linked = link(held, _confirm(texts, bits, percent), _confirm_blocks(texts, bits, nodes.select("node", bands.alias("k")), percent))
        named = nodes.join(linked, "node", "left").where("copies > 1 OR component IS NOT NULL")
    else:
        named = nodes.where("copies > 1").withColumn("component", F.lit(None).cast("long"))
    named = cut(named.select("h1", "h2", F.coalesce("component", "node").alias("component")), "named")
    there = may_hold(named, "h1")
    if there is None:
        return docs.select("r1", "r2", F.array(F.lit(0)).alias("drop")).where("false")
    members = cut(lines.where(there).select("h1", "h2", "occ").join(named, ["h1", "h2"]).select("component", "occ"), "members")
    first = cut(members.groupBy("component").agg(F.min("occ").alias("first")), "first")  # so that a large component is split in the join
    gone = members.join(first, "component").where(~F.col("occ").eqNullSafe(F.col("first")))
    return cut(gone.groupBy(F.col("occ.r1").alias("r1"), F.col("occ.r2").alias("r2")).agg(F.collect_set("occ.pos").alias("drop")), "drops")


def deduplicated_lines(docs: DataFrame, percent: int = 80, least_words: int = LEAST_WORDS) -> DataFrame:
    """Documents (doc_id, text, ...) without lines that repeat, exactly or nearly, an earlier one; columns stay.

    Lines of ``least_words`` words or more are compared, without white space at their ends, by the Jaccard similarity
    of their shingles: links are ``percent`` or more, confirmed on the full sets of candidates that share a band. Of a
    component the first line stays, by doc_id (null last), then hash of the row, then position; so of equal lines
    (ties) the first one does. Rows that repeat, with the same id and text, count as one document and get the same
    text. A null text stays null, a text that loses all lines is empty, blank and shorter lines stay; texts and lines of
    any length are read whole; columns of other names pass as they are; an empty table gives no rows."""
    names = docs.columns
    wide = docs.withColumns({"_t_r1": F.xxhash64("doc_id", "text"), "_t_r2": F.xxhash64(F.lit(1), "text", "doc_id")})
    drops = dropped_lines(wide.select("doc_id", F.col("_t_r1").alias("r1"), F.col("_t_r2").alias("r2"), "text"), percent, least_words)
    drops = drops.toDF("_t_r1", "_t_r2", "_t_drop")
    there = may_hold(drops, "_t_r1")
    if there is None:
        return docs
    hit = wide.where(there).join(drops, ["_t_r1", "_t_r2"], "left")
    kept = lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("_t_drop")), lambda i: F.get(x, i)), "\n")
    text = F.when(F.col("_t_drop").isNull(), F.col("text")).otherwise(F.transform(F.array(F.split("text", "\n")), kept)[0])
    out = [text.alias(c) if c == "text" else F.col(f"`{c}`") for c in names]
    return wide.where(~there).select(*[F.col(f"`{c}`") for c in names]).union(hit.select(*out))


def line_dedup(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_lines, n_dropped and text of each document after line dedup; null texts have no lines."""
    before = docs.select("doc_id", "text", F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long").alias("n_lines"))
    after = deduplicated_lines(before, least_words=least_words)
    left = F.when(F.col("text").isNull() | ((F.col("text") == "") & (F.col("n_lines") > 0)), 0).otherwise(F.size(F.split("text", "\n")))
    return after.select("doc_id", "n_lines", (F.col("n_lines") - left).alias("n_dropped"), "text")
