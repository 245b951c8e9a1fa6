"""Merkle manifests, vector codes and byte-level BPE against brute force and the library, on untidy rows."""

import hashlib
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import bytebpe, codes, merkle, queries

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- Merkle -------------------------------------------------------------------------------------------------------------


def leaf_of(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], row[1])))


def tree_of(leaves):
    """Root, and each leaf's list of (place, others of the run), by loops."""
    proofs, groups, level = [[] for _ in leaves], [[i] for i in range(len(leaves))], list(leaves)
    while len(level) > 1:
        above, merged = [], []
        for at in range(0, len(level), 16):
            run = level[at : at + 16]
            for k in range(len(run)):
                for i in groups[at + k]:
                    proofs[i].append((k, run[:k] + run[k + 1 :]))
            above.append(sha("".join(run)))
            merged.append([i for g in groups[at : at + 16] for i in g])
        level, groups = above, merged
    return level[0], proofs


def test_manifest_against_loops(spark):
    rows = [(i, f"Text {i} é" * (i % 5), "en", "many", i) for i in range(300)] + [(i, None, None, None, None) for i in range(17)] + [(1, "One", "de", "lone", 3)]
    rows += [(5, "same", "en", "copies", 4)] * 20 + [(None, "No id", "en", "copies", 5), (7, "", "en", "éa", 0), (8, "x" * 300_000, "en", "Z", 1)]
    docs = spark.createDataFrame(rows, DOC).withColumns({"tree": F.lit(1), "idx": F.lit(2), "n": F.lit("n"), "digest": F.lit("d"), "proof": F.lit(0), "again": F.lit("kept")})
    manifest = merkle.build(docs.repartition(7), carry=("again",))
    got = merkle.proofs(manifest).collect()
    per = {}
    for row in rows:
        per.setdefault(row[3], []).append(row)
    names = sorted(per, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: sorted((leaf_of(r), r[0]) for r in per[s]) for s in names}
    trees = {s: [x for x, _ in sorted(t, key=lambda x: (x[1] is not None, x[1] or 0, x[0]))] for s, t in trees.items()}
    built = {s: tree_of(t) for s, t in trees.items()}
    root, over = tree_of([built[s][0] for s in names])
    want = sorted((leaf, built[s][0], root, proof + above) for s, above in zip(names, over) for leaf, proof in zip(trees[s], built[s][1]))
    assert sorted((r.leaf, r.subroot, r.root, [(x.place, x.siblings) for x in r.proof]) for r in got) == want
    assert manifest.root() == root and {r.carried.again for r in got} == {"kept"}


def test_folding_tells_changed_rows(spark):
    docs = spark.createDataFrame([(i, "Text" if i % 3 else "text", "en", "a" if i % 2 else "b", 4) for i in range(50)], DOC)
    manifest = merkle.build(docs.withColumn("other", merkle.leaf_digest(text=F.lower("text"))), carry=("other",))
    got = merkle.proofs(manifest).select("doc_id", (merkle.folded(F.col("carried.other"), F.col("proof")) == F.col("root")).alias("same")).collect()
    assert {r.doc_id for r in got if r.same} == set(range(0, 50, 3))


def test_manifest_of_one_row_and_of_none(spark):
    one = merkle.proofs(merkle.build(spark.createDataFrame([(1, "t", "en", "a", 1)], DOC))).first()
    assert one.leaf == one.subroot == one.root and one.proof == []
    none = merkle.build(spark.createDataFrame([], DOC))
    assert none.root() is None and merkle.proofs(none).isEmpty()


# --- vector codes -------------------------------------------------------------------------------------------------------


def lloyd(rows, parts=8, entries=16, rounds=6):
    """Every part in every round; rows (vec_id, vector) in order."""
    width = max(1, -(-max(len(v) for _, v in rows) // parts))
    whole = np.zeros((len(rows), parts * width), dtype=object)
    for i, (_, v) in enumerate(rows):
        whole[i, : len(v)] = [int(np.floor(np.float64(x) * 4096)) for x in v]
    whole = whole.reshape(len(rows), parts, width)
    book = [[list(whole[i, p]) for i in range(min(entries, len(rows)))] for p in range(parts)]
    for turn in range(rounds + 1):
        near = [[min((sum((a - b) ** 2 for a, b in zip(whole[i, p], e)), k) for k, e in enumerate(book[p])) for p in range(parts)] for i in range(len(rows))]
        if turn == rounds:
            return ["".join(f"{k:02x}" for _, k in x) for x in near], [sum(d for d, _ in x) for x in near], book
        for p in range(parts):
            for k in range(len(book[p])):
                mine = [whole[i, p] for i in range(len(rows)) if near[i][p][1] == k]
                if mine:
                    book[p][k] = [sum(c) // len(mine) for c in zip(*mine)]


@pytest.mark.parametrize("dim,n", [(16, 120), (8, 9), (11, 40), (0, 3)])
def test_codes_against_loops(spark, dim, n):
    rnd = random.Random(dim)
    rows = [(i * 3, [float(np.float32(rnd.gauss(0, 0.3))) for _ in range(dim)], rnd.choice([None, 1, 1, 1, 2])) for i in range(n)]
    rows += [(900 + i, rows[i][1], 5) for i in range(min(3, n))]  # ties
    rows += [(990, rows[0][1][: dim // 2], 1)] if dim else []
    bad = [(1, None, 1), (4, [0.1] * max(1, dim - 1) + [None], 1), (7, [float("nan")] * max(1, dim), 2), (10, [float("inf")] * max(1, dim), None)]
    vectors = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, label int").withColumns({"v": F.lit("v"), "code": F.lit(1), "was": F.lit(2), "part": F.lit(3)})
    found = codes.compress(vectors.repartition(5))
    want_codes, want_errors, book = lloyd([(i, v) for i, v, _ in rows])
    got = {r.vec_id: (bytes(r.code).hex(), r.error, r.label_error) for r in codes.with_label_error(found.codes).collect()}
    of = {}
    for (_, _, label), e in zip(rows, want_errors):
        of[label] = of.get(label, 0) + e
    assert got == {i: (c, e, of[label]) for (i, _, label), c, e in zip(rows, want_codes, want_errors)}
    assert found.codebooks.tolist() == book
    back = {r.vec_id: r.v for r in codes.decompressed(found.codes, found.table(spark), 8).collect()}
    assert back[0] == [x for p in range(8) for x in book[p][int(got[0][0][2 * p : 2 * p + 2], 16)]]


def test_codes_of_nothing_and_of_great_components(spark):
    kind = "vec_id long, embedding array<double>, label int"
    assert codes.with_label_error(codes.compress(spark.createDataFrame([], kind)).codes).isEmpty()
    rows = [(i, [float(i)] * 7 + [1e300 if i % 2 else -1e300], 0) for i in range(4)] + [(None, [0.0] * 8, 0)]
    got = codes.compress(spark.createDataFrame(rows, kind))
    assert got.codes.count() == 5 and got.codes.where("error <> 0").count() == 0
    assert got.codebooks[7].ravel().tolist()[:2] == [-codes.GREATEST, codes.GREATEST]


def test_labels_beside_a_hot_one(spark):
    rows = [(i, 7 if i % 3 else None if i % 2 else i, i, b"") for i in range(3000)]
    got = codes.with_label_error(spark.createDataFrame(rows, "vec_id long, label int, error long, code binary")).collect()
    of = {}
    for _, label, e, _ in rows:
        of[label] = of.get(label, 0) + e
    assert {r.vec_id: r.label_error for r in got} == {i: of[label] for i, label, _, _ in rows}


# --- byte-level BPE -----------------------------------------------------------------------------------------------------

ODD = ["", " ", "\n\n  \t x", "don't we'll", "Grüße 漢語 \U0001f600 　\x1c\x85", "<|endoftext|> id", "a" * 9000, "1234567890" * 50, "\x00\x01", "é" * 40, "naïve" * 300]


def test_ids_equal_the_library(spark, folder):
    import public_tokenizers
    import tiktoken

    ranks = queries.vocabulary("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bytebpe.read_ranks(ranks), special_tokens={})
    rnd = random.Random(4)
    texts = ODD + ["".join(rnd.choice("abcdefghiß 漢é\n12' ") for _ in range(rnd.randint(1, 200))) for _ in range(300)]
    texts += ["word, " * 300_000]  # past LONG_TEXT
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (3, "again"), (3, "again"), (-1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"ids": F.lit(1), "bytes": F.lit("b")})
    got = bytebpe.decode(bytebpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks).collect()
    want = sorted((-9 if i is None else i, library.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows)
    assert sorted((-9 if r.doc_id is None else r.doc_id, r.ids, bytes(r.bytes)) for r in got) == want
    assert bytebpe.encode(docs.where("false"), ranks, public_tokenizers.PATTERN).isEmpty()


def test_ranks_whose_tokens_dont_all_come_out_of_merges():
    import tiktoken

    rnd = random.Random(9)
    for turn in range(20):  # made-up ranks, in any order, with tokens that no merge reaches
        words = {bytes(rnd.choice(b"abc") for _ in range(rnd.randint(2, 5))) for _ in range(25)}
        ranks = {t: r for r, t in enumerate([*map(lambda b: bytes([b]), range(256)), *rnd.sample(sorted(words), len(words))])}
        merges, library = bytebpe.ByteMerges(ranks), tiktoken.Encoding("own", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
        for _ in range(200):
            text = "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 30)))
            assert list(merges.match(text)) == library.encode_ordinary(text), (turn, text)


def test_matches_are_forgotten_and_found_again(monkeypatch):
    monkeypatch.setattr(bytebpe, "REMEMBERED", 5)
    monkeypatch.setattr(bytebpe, "COMPARED", 3)
    merges = bytebpe.ByteMerges(bytebpe.read_ranks(queries.vocabulary("byte_bpe_50k.tiktoken")))
    words = ["alpha", "beta", "gamma", "delta", "x" * 80, "epsilon", "zeta"]
    first = merges.encode(words)
    assert merges.encode(words[3:]) and merges.encode(words) == first
    assert first == b"".join(merges.encode([w]) for w in words)


def test_missing_byte_is_an_error():
    with pytest.raises(ValueError):
        bytebpe.ByteMerges({b"a": 0})


@pytest.mark.parametrize("name", ["op11_merkle", "op12_codes"])
def test_query_equals_sql(spark, folder, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    want = con.execute(queries.oracle_sql()[name])
    columns = [x[0] for x in want.description]
    assert sorted(tuple(r[c] for c in columns) for r in queries.queries()[name](spark, folder).collect()) == sorted(want.fetchall())
