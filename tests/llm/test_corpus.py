"""Corpus operators against brute force, round trips and edge cases, on small tables."""

import collections
import hashlib
import html as htmllib
import io
import random
import re
import wave
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import components, html, licenses, lines, linking, media, minhash, mixing, packing, quality, queries, tokens, vectors

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs_of(spark, rows, schema=DOC):
    return spark.createDataFrame(rows, schema)


def edge_rows():
    """Nulls in every column, empty, blank and long texts, ties, repeated rows."""
    long = " ".join(f"word{i % 977}" for i in range(20000))
    rows = [(1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \n\t ", None, "a", None), (4, "one", "en", None, 3), (5, long, "en", "a", len(long)), (5, long, "en", "a", len(long)), (None, "a text without an id, five words", "en", "b", 30), (None, None, None, None, None), (6, "one two three four five six", "en", "b", 20), (7, "one two three four five six", "en", "b", 20), (7, "other words under the same id here", "en", "b", 20)]
    return rows


def clash(df):
    """Extra columns with names that operators use inside."""
    names = ["size", "start", "bucket", "node", "u", "v", "component", "key", "rank", "th", "path", "items", "digest", "partition"]
    return df.select("*", *[F.lit("x").alias(n) for n in names if n not in df.columns])


def rand_docs(seed, n, words=40):
    rng = random.Random(seed)
    vocab = [f"{a}{b}" for a in "bcdfgh" for b in ("ar", "el", "in", "os", "um", "yt", "ea")]
    out = []
    for i in range(n):
        if out and rng.random() < 0.4:
            w = rng.choice(out)[1].split(" ")
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            out.append((i, " ".join(w)))
        else:
            out.append((i, " ".join(rng.choice(vocab) for _ in range(rng.randint(1, words)))))
    return [(i, t, "en", f"s{i % 3}", len(t)) for i, t in out]


def groups(pairs, nodes):
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


# --- components and linking


def test_components_of_chains_stars_and_loops(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(1, i) for i in range(2, 40)]
    random.Random(3).shuffle(chain)
    got = components.components(spark.createDataFrame([*chain, *star, (7, 7), (1, 2)], "u long, v long")).collect()
    want = groups([*chain, *star], {x for e in [*chain, *star] for x in e})
    assert {r.node: r.component for r in got} == want and len(got) == len(want)
    assert components.components(spark.createDataFrame([], "u long, v long")).isEmpty()


def test_link_loses_no_pair_of_a_bucket(spark):
    # one bucket; links only between neighbours in value, so few members link with the leader
    nodes = list(range(0, 60, 2)) + [101, 102, 205]
    buckets = spark.createDataFrame([(0, x) for x in nodes], "bucket long, node long")
    near = lambda p: p.where("abs(u - v) <= 2")

    def blocks(b):
        hosts = b.where("NOT guest").toDF("bucket", "i", "j", "v", "q", "g")
        met = b.where("guest").toDF("bucket", "i", "j", "u", "p", "g").join(hosts, ["bucket", "i", "j"]).where("p <> q AND abs(u - v) <= 2")
        return met.selectExpr("least(p, q) AS u", "greatest(p, q) AS v").distinct()

    held = linking.with_leaders(linking.scored(buckets))
    got = linking.link(held, near, blocks).collect()
    want = groups([(a, b) for a in nodes for b in nodes if abs(a - b) <= 2], nodes)
    assert {r.node: r.component for r in got} == {k: v for k, v in want.items() if k != 205}


# --- 1 mixing


def brute_mix(rows, weights=(5, 2, 1)):
    size = [len(WORD.findall(t or "")) for _, t, _, _, _ in rows]
    names = sorted({r[3] for r in rows if r[3] is not None}) + ([None] if any(r[3] is None for r in rows) else [])
    total = {s: sum(n for n, r in zip(size, rows) if r[3] == s) for s in names}
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    level, capped = 0.0, set()
    while True:
        free = [s for s in names if s not in capped]
        level = (sum(total.values()) - sum(3 * total[s] for s in capped)) / max(1, sum(weight[s] for s in free))
        new = {s for s in free if level * weight[s] > 3 * total[s]}
        if not new:
            break
        capped |= new
    return {s: min(3 * total[s], level * weight[s]) for s in names}, total


def test_mix_meets_its_targets(spark):
    rows = rand_docs(1, 300) + edge_rows()
    out = mixing.mix(clash(docs_of(spark, rows)), block_words=64)
    got = out.collect()
    target, total = brute_mix(rows)
    assert len(got) == len(rows)
    assert sorted(r["size"] for r in got) == sorted(len(WORD.findall(t or "")) for _, t, _, _, _ in rows)
    assert all(0 <= r.taken <= 3 * r["size"] for r in got)
    assert sum(r.taken for r in got) == pytest.approx(sum(target.values()), abs=3)
    assert {round(r.target, 6) for r in got} == {round(x, 6) for x in target.values()}
    for t in {r.target for r in got}:
        taken = sum(r.taken for r in got if r.target == t)
        assert abs(taken - t * sum(1 for x in target.values() if x == t)) <= 1.5
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix(docs_of(spark, rows), block_words=64).collect()), key=repr)


def test_mixed_documents_repeat_whole_rows(spark):
    rows = rand_docs(2, 60)
    got = mixing.mixed_documents(clash(docs_of(spark, rows)))
    assert got.columns == clash(docs_of(spark, rows)).columns
    taken = {r.doc_id: int(r.taken / r["size"] + 0.5) for r in mixing.mix(docs_of(spark, rows)).collect()}
    assert dict(collections.Counter(r.doc_id for r in got.collect())) == {k: v for k, v in taken.items() if v}
    assert mixing.mix(docs_of(spark, [])).isEmpty()


# --- 2 lines


def brute_lines(rows):
    nodes, occ = {}, []
    for i, t in sorted((r[0], r[1]) for r in rows if r[1]):
        for p, line in enumerate(t.split("\n")):
            line = line.strip(" ")
            if len(WORD.findall(line)) >= 5:
                occ.append((i, p, nodes.setdefault(line, len(nodes))))
    sets = [{x.lower()[i : i + 16] for i in range(max(1, len(x) - 15))} for x in nodes]
    label = groups([(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])], range(len(sets)))
    seen, drop = set(), collections.Counter()
    for i, _, n in occ:
        drop[i] += label[n] in seen
        seen.add(label[n])
    return drop


def test_line_dedup_block_by_block(spark, monkeypatch):
    monkeypatch.setattr(linking, "SMALL", 1)
    monkeypatch.setattr(linking, "BLOCK", 4)
    test_line_dedup(spark)


def test_line_dedup(spark):
    rng = random.Random(5)
    pool = [t for _, t, *_ in rand_docs(6, 80)]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 6))), "en", "a", 1) for i in range(60)]
    got = {r.doc_id: r.n_dropped for r in lines.line_dedup(docs_of(spark, rows)).collect()}
    want = brute_lines(rows)
    assert got == {r[0]: want[r[0]] for r in rows}


def test_line_dedup_edges(spark):
    df = clash(docs_of(spark, [*edge_rows(), (8, "first of its kind on earth\nshort\nfirst of its kind on earth\n\n", "en", "a", 1)]))
    got = lines.deduplicated_lines(df)
    assert got.columns == df.columns
    text = {(r.doc_id, r.text) for r in got.collect()}
    assert (8, "first of its kind on earth\nshort\n\n") in text and (1, None) in text and (2, "") in text and (7, "") in text and (4, "one") in text
    assert got.count() == df.count()
    assert lines.deduplicated_lines(docs_of(spark, [])).isEmpty()


# --- 3 licences


def test_licences_and_inheritance(spark):
    rows = [("a/LICENSE", "Released under the MIT License."), ("a/b/x.py", "print(1)"), ("a/b/LICENSE.txt", "Licensed under CC BY-NC 4.0."), ("a/b/c/d.py", None), ("q/z.py", "hello"), (None, "x"), ("a/y.py", "code here\nLicensed under the Apache License, Version 2.0.\nmore code and more words here to be long"), ("a/y.py", ""), ("", "")]
    got = [tuple(r)[:4] for r in licenses.scan(clash(spark.createDataFrame(rows, "path string, text string"))).collect()]
    assert len(got) == len(rows)
    assert set(got) >= {("a/b/x.py", "CC-BY-NC-4.0", 1.0, "inherited"), ("a/b/c/d.py", "CC-BY-NC-4.0", 1.0, "inherited"), ("a/y.py", "Apache-2.0", 1.0, "own"), ("a/y.py", "MIT", 1.0, "inherited"), ("q/z.py", None, None, "none"), (None, None, None, "none")}
    assert licenses.scan(spark.createDataFrame([], "path string, text string")).isEmpty()


def test_licence_cosines_against_brute_force(spark):
    w = licenses.Weights(licenses.TEMPLATES)
    rng = random.Random(4)
    vocab = sorted(w.idf) + ["other", "words", "zebra"]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(3, 9))) for _ in range(60)] + [t.replace("License", "licence") for _, t in licenses.TEMPLATES]
    got = {r.path: (r.licence, r.similarity) for r in licenses.scan(spark.createDataFrame([(f"d{i}/f", t) for i, t in enumerate(texts)], "path string, text string"), share=9.0).collect()}
    by = collections.defaultdict(dict)
    for i, name, term, x in w.rows:
        by[i, name][term] = x
    for i, t in enumerate(texts):
        best = (0.0, None)
        for seg in re.split(r"\n|(?<=[.!?])\s+(?=[A-Z])", t):
            v = {x: n * w.idf.get(x, w.other) for x, n in collections.Counter(licenses._terms(seg)).items()}
            norm = sum(x * x for x in v.values()) ** 0.5
            for (_, name), u in by.items():
                s = round(sum(v.get(x, 0) * y for x, y in u.items()) / norm, 6) if norm else 0
                if s > best[0]:
                    best = (s, name)
        want = best if best[0] >= 0.75 else (None, None)
        assert got[f"d{i}/f"][1] == (want[0] if want[0] else None) or abs(got[f"d{i}/f"][1] - want[0]) < 2e-6


# --- 4 near-duplicates


def shingle_sets(rows, w):
    out = []
    for r in rows:
        words = (r[1] or "").encode().lower().split()
        out.append({tuple(words[i : i + w]) for i in range(len(words) - w + 1)} if len(words) >= w else ({tuple(words)} if words else set()))
    return out


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, width, percent):
    rows = rand_docs(7, 150, 60)
    sets = shingle_sets(rows, width)
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = groups(pairs, range(len(rows)))
    got = minhash.near_duplicates(clash(docs_of(spark, rows)), width, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(sets[i]), want[i], want[i] == i) for i in range(len(rows))}
    kept = minhash.deduplicated(docs_of(spark, rows), width, percent)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_near_duplicate_edges(spark):
    rows = edge_rows()
    df = clash(docs_of(spark, rows))
    got = minhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    by = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=repr)
    assert (6, 4, 6, True) in by and (7, 4, 6, False) in by and (7, 5, 7, True) in by and (1, 0, 1, True) in by
    assert [x for x in by if x[0] is None and x[1]] == [(None, 5, None, True)]
    kept = minhash.deduplicated(df)
    assert kept.columns == df.columns and sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == sorted([(False, x) for x in (1, 2, 3, 4, 5, 6, 7)] + [(True, 0)] * 2)
    assert minhash.near_duplicates(docs_of(spark, [])).isEmpty()


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    for size in (3, 50, 3000):
        a = rng.integers(0, 2**63, size, dtype=np.uint64)
        b = a.copy()
        b[: max(1, size // 5)] = rng.integers(0, 2**63, max(1, size // 5), dtype=np.uint64)
        x, y = minhash.fast_sketch(a, 2000), minhash.fast_sketch(b, 2000)
        true = (size - max(1, size // 5)) / (size + max(1, size // 5))
        assert np.isfinite(x).all() and abs((x == y).mean() - true) < 0.06


# --- 5 token counts


def test_token_counts(spark):
    import sentencepiece

    path = queries.vocabulary("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(9)
    texts = ["".join(rng.choice("ab é\n\t  ▁<s>unk</s>AЖ中́\x00\xa0　'1٣|ß\U0001F600") for _ in range(rng.randint(0, 40))) for _ in range(300)] + ["a" * 5000, " " * 50, "<s></s><unk>", "the " * 3000]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)] + [(None, None, None, None, None)]
    got = sorted(((r.doc_id is None, r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.token_counts(clash(docs_of(spark, rows)), path).collect()), key=repr)
    want = []
    for i, t, *_ in rows:
        n = len(library.encode(t or ""))
        want.append((i is None, i, len((t or "").encode()), n, n > 4096))
    assert got == sorted(want, key=repr)


# --- 6 html


def page(main, extra=""):
    return f'<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">Home, sweet, home, of, all</a></li></ul></nav><div class="ad">Buy, now, many, things, at, once, and, more, of, them.</div>{main}{extra}<footer>&copy; all, rights</footer></body></html>'


CASES = [
    (page("<article><h1>Title &amp; more</h1><p><b>One,\n two.<br><p>Three&nbsp;four.</p></article>"), "Title & more One, two. Three four."),
    (page("<article><p>Just one.</p></article>"), "Just one."),
    (page('<div id="content"><p>Long enough text, with commas, in it, to be the article.</p><p>And more.</p></div>', '<aside>Side, bar, text</aside><form>Name, mail</form>'), "Long enough text, with commas, in it, to be the article. And more."),
    (page('<article><p>Body text here, fine.</p><section class="comments"><p>First, I, think, so, very, much, yes.</p></section></article>'), "Body text here, fine."),
    (page('<div class="cookie-notice">We use cookies, many, of, them, here</div><main><p>Real text, yes.</p></main>'), "Real text, yes."),
    ("<p>&lt;b&gt; is bold</p>", "<b> is bold"),
    ("", ""),
    (None, ""),
    ("<script>only(code)</script>", ""),
]


def test_html_cases(spark):
    rows = [(i, f"http://h/{i}", h) for i, (h, _) in enumerate(CASES)]
    got = {r.page_id: (r.text, r.n_chars) for r in html.extract(clash(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()}
    assert got == {i: (t, len(t)) for i, (_, t) in enumerate(CASES)}


def test_html_of_the_pages(spark, folder):
    rows = spark.read.parquet(f"{folder}/pages.parquet").collect()
    got = {r.page_id: r.text for r in html.extract(spark.read.parquet(f"{folder}/pages.parquet")).collect()}
    for r in rows:
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(htmllib.unescape(re.sub("<br>", " ", re.sub("</?b>", "", b))).split()) for b in re.split("</?(?:p|h1)>", inner)]
        assert got[r.page_id] == " ".join(b for b in blocks if b)


KEPT = "<p>Many words of a first paragraph, with commas, to score well, on and on.</p><p>And a second one, with more words, after it.</p>"


@pytest.mark.parametrize(
    "inner, text",
    [
        ('<ul><li><a href="/1">A long title of the first reference, 2019</a></li><li><a href="/2">The title of another one, 2020</a></li></ul>', "A long title of the first reference, 2019 The title of another one, 2020"),
        ('<p class="story-content share">Shared prose.</p>', "Shared prose."),
        ('<div class="social-history"><p>Of the town.</p></div>', "Of the town."),
        ('<div class="share-buttons"><a href="/t">Tell</a></div><div class="notice">Note</div><div id="respond"><p>Reply, here</p></div>', ""),
    ],
)
def test_html_of_marked_parts_inside_an_article(inner, text):
    first = "Many words of a first paragraph, with commas, to score well, on and on. And a second one, with more words, after it."
    assert html.main_text(page(f"<article>{KEPT}{inner}</article>")) == f"{first} {text}".strip()


def test_html_keeps_short_parts_beside_the_best():
    got = html.main_text(page(f'<div class="wrapper"><h1>Head</h1><div>{KEPT * 6}</div><div><p>Short end.</p></div><p>Bye.</p></div>'))
    assert got.startswith("Head Many words") and got.endswith("Short end. Bye.")


def test_html_survives_broken_markup():
    assert html.main_text("<div>" * 20000 + "deep, text") == "deep, text"
    assert html.main_text("<p>a, b <b>c <i>d</p><!-- open") == "a, b c d"
    assert isinstance(html.main_text("<" * 5000 + ">"), str)


# --- 7 vectors


def test_vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 16))
    rows = []
    for i in range(400):
        x = base[rng.integers(40)] + rng.normal(scale=rng.choice([0.01, 0.15, 1.0]), size=16)
        rows.append((i, [float(np.float32(v)) for v in x * rng.choice([1, 3])], int(rng.integers(2))))
    rows += [(i + 400, rows[3][1], rows[3][2]) for i in range(50)]
    bad = [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [1.0] * 15 + [None], 1), (904, rows[3][1], None), (905, [], 1), (906, [1.0, 2.0], 1), (907, [2.0, 4.0], 1), (None, rows[3][1], rows[3][2])]
    df = clash(spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, label int"))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(df).collect()}
    good = [r for r in rows + bad if r[0] is not None and r[2] is not None and r[0] not in (900, 901, 902, 903, 905)]
    pairs = []
    for a in range(len(good)):
        for b in range(a):
            x, y = np.array(good[a][1]), np.array(good[b][1])
            if len(x) == len(y) and good[a][2] == good[b][2] and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                pairs.append((good[a][0], good[b][0]))
    want, count = groups(pairs, [r[0] for r in rows + bad if r[0] is not None]), collections.Counter(x for p in pairs for x in p)
    for b in {r[0] for r in rows if r[1] == rows[3][1] and r[2] == rows[3][2]} | {x for p in pairs if 3 in p for x in p}:
        count[b] += 1  # the row without an id
    assert {k: v for k, v in got.items() if k is not None} == {k: (count[k], want[k], want[k] == k) for k in want}
    assert got[None][1] == want[3] and not got[None][2]
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).isEmpty()


# --- 8 packing


def test_packing(spark):
    from tokenizers import Tokenizer

    path = queries.vocabulary("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = [(1000 + r[0], *r[1:]) for r in rand_docs(11, 120)] + edge_rows() + [(500, "Don't stop, it's 42 — “fine” <|endoftext|> ÀÉß naïve Ж中 é", "en", "a", 1)]
    df = clash(docs_of(spark, rows).repartition(3))
    got = packing.pack(df, path, size=256).collect()
    ids = [np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4") for _, t, *_ in rows]
    assert sum(r.length for r in got) == sum(map(len, ids))
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at and n > 0
            at += n
        assert at <= 256
    assert sum(sum(n for _, n in p) < 256 for p in sequences.values()) <= 3
    for (i, _, *_), x in zip(rows, ids):
        if i in (5, 7, None):
            continue  # ids that repeat
        pieces = sorted((r.start, r.length, r.ids_crc32) for r in got if r.doc_id == i)
        assert [p[0] for p in pieces] == [sum(q[1] for q in pieces[:k]) for k in range(len(pieces))]
        assert all(zlib.crc32(x[s : s + n].tobytes()) == c for s, n, c in pieces) and {r.doc_tokens for r in got if r.doc_id == i} == {len(x)}
    assert packing.pack(docs_of(spark, []), path).isEmpty()


# --- 9 quality


def test_quality_accuracy(spark, folder):
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    held = labels.where("doc_id % 3 = 0")
    got = quality.score(clash(docs), labels.where("doc_id % 3 <> 0")).join(held, "doc_id").collect()
    good = [r for r in got if r.quality == 1]
    assert sum(r.keep for r in good) == len(good) and sum(r.keep == (r.quality == 1) for r in got) >= 0.9 * len(got)


def brute_scores(docs, labels, rounds, given, order):
    """The exchange over all documents at once, by plain NumPy; rows are (doc_id, text, lang, source, n_chars)."""
    known = {}
    f32 = lambda x: x.astype(np.float32).astype(float)
    x = {r[0]: (f32(quality.text_features(r[1], known)), f32(quality.meta_features(r[2], r[3], r[4]))) for r in docs}
    ids = sorted((i for i in labels if i in x), key=lambda i: order[i])
    by = [[i for i in ids if labels[i] == c] for c in (0, 1)]
    fold = {i: k % 4 for part in by for k, i in enumerate(part)}
    ids = sorted(ids, key=lambda i: (by[labels[i]].index(i), labels[i]))
    pick = lambda folds: [i for i in ids if fold[i] in folds]
    taught, taken = ([], []), (set(ids), set(ids))
    for turn in range(rounds + 1):
        views = []
        for v in (0, 1):
            rows = [(x[i][v], labels[i]) for i in pick((0, 1))] + [(x[i][v], c) for i, c in taught[v]]
            held = pick((2,))
            views.append(quality.View(np.array([f for f, _ in rows]), np.array([c for _, c in rows], float), np.array([x[i][v] for i in held]), np.array([labels[i] for i in held], float), quality.spreads(len(ids))[v]))
        if turn == rounds:
            break
        told = []
        for v in (0, 1):
            for c in (1, 0):
                p = {i: 1 / (1 + np.exp(-views[v].logit(f[v][None])[0])) for i, f in x.items() if i not in taken[v]}
                sure = {i: q if c else 1 - q for i, q in p.items()}
                told += [(v, c, i) for i in sorted((i for i in sure if sure[i] >= quality.CONFIDENT), key=lambda i: (-sure[i], order[i]))[:given]]
        for v, c, i in told:
            taken[v].add(i)
            taught[1 - v].append((i, c))
    last = pick((3,))
    model = quality.CoTrained(views, np.array([x[i][0] for i in last]), np.array([x[i][1] for i in last]), np.array([labels[i] for i in last], float))
    return {i: float(model(f[0][None], f[1][None])[2][0]) for i, f in x.items()}


def test_quality_against_brute_force(spark, folder):
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    rows = docs.select("doc_id", "text", "lang", "source", "n_chars", F.xxhash64("doc_id").alias("h")).collect()
    given = {r.doc_id: r.quality for r in labels.collect() if r.quality in (0, 1)}
    want = brute_scores([r[:5] for r in rows], given, 2, 10, {r.doc_id: (r.h, str(r.doc_id)) for r in rows})
    got = {r.doc_id: r.score for r in quality.score(docs, labels, rounds=2, given=10).collect()}
    assert set(got) == set(want) and max(abs(got[i] - want[i]) for i in got) < 0.02


def test_quality_edges(spark, folder):
    docs, labels = docs_of(spark, edge_rows()), spark.read.parquet(f"{folder}/labels.parquet")
    none = quality.score(clash(docs), labels.where("false"))
    assert none.count() == len(edge_rows()) and none.where("score = 1 AND keep").count() == len(edge_rows())
    real = spark.read.parquet(f"{folder}/documents.parquet")
    out = quality.score(real.union(docs.withColumn("doc_id", F.col("doc_id") + 100000)), labels)
    assert out.where("doc_id >= 100000 OR doc_id IS NULL").count() == len(edge_rows())
    assert quality.accepted(clash(real), labels).columns == clash(real).columns


# --- 10 media


def test_media_round_trip(spark):
    rows = edge_rows() + rand_docs(12, 20)
    got = media.media_features(clash(docs_of(spark, rows))).collect()
    assert len(got) == len(rows)
    want = collections.Counter()
    for i, t, *_ in rows:
        raw = (t or "").encode()
        data = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setparams((1, 1, 8000, 0, "NONE", "not compressed"))
            w.writeframes(data)
        want[i, len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(out.getvalue()), hashlib.sha256(out.getvalue()).hexdigest()] += 1
    assert collections.Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) for r in got) == want
    assert len({(r.payload_sha256, r.feature) for r in got}) == len({r.payload_sha256 for r in got})


def test_interleaved_positions_and_captions():
    items = media.interleave('<p>One</p><figure><img src="sha256:ab" alt="x"><figcaption>Cap &amp; tion</figcaption></figure><p>Two <b>bold</b></p><img src="/y.png" alt="alt"><script>p</script>')
    assert [(x["position"], x["kind"], x["text"], x["digest"], x["caption"]) for x in items] == [(0, "text", "One", None, None), (1, "media", "sha256:ab", "ab", "Cap & tion"), (2, "text", "Two bold", None, None), (3, "media", "/y.png", None, "alt")]
    figures = media.interleave(
        '<article><p>First</p><figure><img alt="a > b" src="sha256:01"><figcaption>One &amp; <b>only</b></figcaption></figure>Between'
        "<figure><figcaption>Ahead</figcaption><img src='sha256:02'></figure><img src=sha256:03 alt=bare>"
        '<figure><img src="sha256:04"><img src="sha256:05"><figcaption>Both<p>After</p></figure><p>Last</p><figcaption>Loose</article>'
    )
    assert [x["position"] for x in figures] == list(range(len(figures)))
    assert [(x["text"], x["caption"]) if x["kind"] == "media" else x["text"] for x in figures] == [
        "First", ("sha256:01", "One & only"), "Between", ("sha256:02", "Ahead"), ("sha256:03", "bare"), ("sha256:04", "Both"), ("sha256:05", "Both"), "After", "Last", "Loose"]
    open_caption = media.interleave('<img src="sha256:01"><figcaption>Cap<p>one</p><p>two</p> end')
    assert [x["text"] for x in open_caption] == ["sha256:01", "one", "two", "end"] and open_caption[0]["caption"] == "Cap"
    assert media.interleave(None) == [] and media.interleave("") == []


# --- pipeline


def test_pipeline_stages(spark, folder):
    import corpus_pipeline

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names, rows = docs.columns, []
    for at, (_, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, docs, folder)
        from tessera.llm.common import cut

        after = cut(after)
        if at < 4:
            assert after.columns == names
        rows.append(after.count())
        if at == 0:
            scores = quality.score(docs, spark.read.parquet(f"{folder}/labels.parquet"))
            assert rows[0] == scores.where("keep").count() < docs.count()
        if at == 2:
            sets = shingle_sets([(r.doc_id, r.text) for r in after.collect()], 5)
            for a in range(len(sets)):
                assert not any(sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) for b in range(a))
        docs = after
    assert rows[2] <= rows[1] == rows[0]
    assert corpus_pipeline.run(spark, folder).agg(F.sum("length")).first()[0] == docs.agg(F.sum("length")).first()[0]
