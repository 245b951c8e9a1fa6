"""Empty tables, missing and repeated ids, exact thresholds, and the pipeline's stages on untidy rows."""

import pytest
from pyspark.sql import functions as F

from tessera.llm import html, media, minhash, quality, queries, tokens

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame(rows, DOC)


def test_empty_tables_give_no_rows(spark, folder):
    none, labels = docs_of(spark, []), spark.read.parquet(f"{folder}/labels.parquet")
    assert tokens.token_counts(none, queries.vocabulary("piece_bpe_32k.model")).isEmpty()
    assert quality.score(none, labels).isEmpty() and media.media_features(none).isEmpty()
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).isEmpty()


def test_pages_without_id_and_with_equal_ids_stay_apart(spark):
    long = "<article>" + "<p>A paragraph, with commas, and words.</p>" * 3000 + "</article>"
    rows = [(None, None, "<p>One, two.</p>"), (1, "u", "<p>Three.</p>"), (1, "u", "<p>Three.</p>"), (2, "v", None), (3, "w", long)]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id or 0, r.text[:9], r.n_chars) for r in got) == [(0, "One, two.", 9), (1, "Three.", 6), (1, "Three.", 6), (2, "", 0), (3, "A paragra", 3000 * 37 - 1)]


def test_links_start_at_exactly_the_threshold(spark):
    word = lambda tag, n: [f"{tag}{i}" for i in range(n)]
    first = word("w", 87)  # 85 shingles of three words
    rows = [(1, " ".join(first)), (2, " ".join(first + word("x", 15))), (3, " ".join(first + word("y", 16)))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs_of(spark, [(i, t, "en", "a", 1) for i, t in rows])).collect()}
    assert got == {1: (85, 1), 2: (100, 1), 3: (101, 3)}


@pytest.mark.parametrize("at", range(5))
def test_stages_take_untidy_rows(spark, folder, at):
    import corpus_pipeline

    rows = [(1, None, "en", "a", None), (2, "", None, None, 0), (None, "one two three four five six seven", "en", "a", 7), (3, "same words here and there again", "de", "b", 5), (3, "same words here and there again", "de", "b", 5), (4, "x" * 200_000, "en", "a", 1)]
    docs = docs_of(spark, rows).withColumns({"node": F.lit(1), "bucket": F.lit("b"), "_t_id": F.lit(2), "size": F.lit(3)})
    name, stage = corpus_pipeline.STAGES[at]
    out = stage(spark, docs, folder)
    assert out.count() > 0
    if at < 4:
        assert out.columns == docs.columns
    assert stage(spark, docs.where("false"), folder).isEmpty()
