"""Line dedup over whole lines: shingles made here from the text, long words, scripts without spaces."""

import collections
import random

from pyspark.sql import functions as F

from tessera.llm import lines

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], DOC)


def grams(line, n=16):
    line = line.lower()
    return {line[i : i + n] for i in range(max(1, len(line) - n + 1))}


def brute(texts, least_words):
    nodes, occ = {}, []
    for i, t in enumerate(texts):
        occ += [(i, nodes.setdefault(x.strip(" "), len(nodes))) for x in t.split("\n") if len(x.split()) >= least_words]
    sets, label = [grams(x) for x in nodes], list(range(len(nodes)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                label[max(p, q)] = min(p, q)
    seen, drop = set(), collections.Counter()
    for i, n in occ:
        drop[i] += find(n) in seen
        seen.add(find(n))
    return {i: drop[i] for i in range(len(texts))}


def test_shingles_start_at_every_character(spark):
    texts = ["short", "exactly 16 chars", "Seventeen chars!!", "see https://data.example.org/2019/Report.pdf", "carriage\rreturn and more text past it", "emoji 😀😀 between the 𝔴ords of 😀 a line 😀", "数据集发布于二零一九年并附有完整的渔业报告和附件说明"]
    made = lambda xs: {r.text: set(r.s) for r in docs_of(spark, xs).select("text", lines.shingles(F.col("text")).alias("s")).collect()}
    one = made(sorted({g for t in texts for g in grams(t)}))  # a run of 16 characters or a short line is one shingle
    assert all(len(x) == 1 for x in one.values())
    assert made(texts) == {t: set.union(*[one[g] for g in grams(t)]) for t in texts}


def test_lines_that_differ_within_long_words_stay(spark):
    digest = "0123456789abcdef"
    texts = ["see the full data set at https://data.example.org/2019/report-on-fisheries.pdf", "see the full data set at https://data.example.org/2024/minutes-of-council.pdf", f"sha256 of the file is {digest}{'1f' * 24}", f"sha256 of the file is {digest}{'7b' * 24}"]
    got = {r.doc_id: r.n_dropped for r in lines.line_dedup(docs_of(spark, texts)).collect()}
    assert got == dict.fromkeys(range(4), 0)


def near_texts(seed, n):
    """Lines of words of all lengths, with spaces or none, and copies changed anywhere in them."""
    rng, pool = random.Random(seed), []
    for _ in range(n):
        if pool and rng.random() < 0.5:
            x = list(rng.choice(pool))
            for _ in range(rng.randint(1, 2)):
                x[rng.randrange(len(x))] = rng.choice("xyz")
            pool.append("".join(x))
        else:
            pool.append(" ".join("".join(rng.choice("abcdefgh漢字😀") for _ in range(rng.choice([2, 5, 60]))) for _ in range(rng.randint(5, 9))))
    return ["\n".join(rng.choice(pool) for _ in range(rng.randint(1, 4))) for _ in range(60)]


def test_lines_against_brute_force(spark):
    texts = near_texts(1, 60)
    got = {r.doc_id: r.n_dropped for r in lines.line_dedup(docs_of(spark, texts)).collect()}
    assert got == brute(texts, lines.LEAST_WORDS) and sum(got.values()) > 50


def test_lines_against_brute_force_block_by_block(spark, monkeypatch):
    from tessera.llm import linking

    monkeypatch.setattr(linking, "SMALL", 1)
    monkeypatch.setattr(linking, "BLOCK", 4)
    test_lines_against_brute_force(spark)


def test_recall_of_bands_at_the_threshold(spark):
    # pairs of similarity 0.8: the second line goes on for as many shingles as the first lacks
    rng, rows, trials = random.Random(9), [], 5000
    for common, more in ((4, 1), (8, 2), (16, 4)):
        for i in range(trials):
            line = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(common + more + 15))
            assert len(grams(line)) == common + more
            rows += [(common * trials + i, 0, line[: common + 15]), (common * trials + i, 1, line)]
    signed = lines._signatures(spark.createDataFrame(rows, "h1 long, h2 long, line string")).collect()
    minima = {(r.h1, r.h2): [r[f"m{i}"] for i in range(lines.BANDS * lines.ROWS)] for r in signed}
    for common in (4, 8, 16):
        lost = 0
        for i in range(common * trials, common * trials + trials):
            a, b = minima[i, 0], minima[i, 1]
            lost += not any(a[k : k + lines.ROWS] == b[k : k + lines.ROWS] for k in range(0, len(a), lines.ROWS))
        assert lost / trials <= 0.0015, (common, lost)  # 0.0003 expected


def test_short_lines_and_scripts_without_spaces_take_part(spark, tmp_path):
    import corpus_pipeline
    from tessera.llm import queries

    clause = "数据集发布于二零一九年并附有完整的渔业报告和附件说明以及更多的内容和表格与图示一览"
    texts = [f"Subscribe to our newsletter\n\n{clause}\n-", f"first\nSubscribe to our newsletter\n\n{clause}。", "second\n \t\n-\nsubscribe to our newsletter"]
    docs = docs_of(spark, texts)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = {0: texts[0], 1: "first\n", 2: "second\n \t"}
    assert {r.doc_id: r.text for r in queries.op2_lines(spark, str(tmp_path)).collect()} == want
    assert {r.doc_id: r.text for r in corpus_pipeline.new_lines(spark, docs, "").collect()} == want
    some = near_texts(2, 50) + texts
    assert {r.doc_id: r.n_dropped for r in lines.line_dedup(docs_of(spark, some), least_words=lines.ALL).collect()} == brute(some, lines.ALL)
