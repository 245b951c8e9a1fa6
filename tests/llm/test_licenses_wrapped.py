"""Licences as they stand in files: wrapped lines, comment marks, whole files."""

import textwrap

from tessera.llm import licenses

MIT = next(t for _, t in licenses.FULL)
GPL = next(t for n, t in licenses.FULL if n == "GPL-3.0")


def wrapped(text, width=78, mark=""):
    return "\n".join(mark + x for x in textwrap.wrap(text, width))


def test_wrapped_licences_are_found(spark):
    at = MIT.index("The above")
    rest = MIT.index("THE SOFTWARE IS")
    rows = [
        ("mit/LICENSE", "MIT License\n\nCopyright (c) 2020 Some One\n\n" + "\n\n".join(map(wrapped, (MIT[:at], MIT[at:rest], MIT[rest:]))) + "\n"),
        ("mit/a.py", "print(1)"),
        ("template/x", "code\n\n" + wrapped(licenses.TEMPLATES[1][1], 70) + "\n\nmore code"),
        ("gpl/b.py", wrapped(GPL[: GPL.index("This program is dist")], 70, "# ") + "\n#\n" + wrapped(GPL[GPL.index("This program is dist") :], 70, "# ") + "\nimport os\nprint(os.name)\n" * 40),
        ("none/c.py", "the software is a program\nwith a general license of its own\n" * 3),
    ]
    got = {r.path: (r.licence, r.origin) for r in licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {"mit/LICENSE": ("MIT", "own"), "mit/a.py": ("MIT", "inherited"), "template/x": ("MIT", "own"), "gpl/b.py": ("GPL-3.0", "own"), "none/c.py": (None, "none")}


def test_documents_keep_their_ids(spark):
    docs = spark.createDataFrame([(1, "a", "en", MIT), (None, None, "en", "x"), (3, "a", "en", None)], "doc_id long, source string, lang string, text string")
    got = {(r.doc_id, r.source, r.licence) for r in licenses.document_licences(docs).collect()}
    assert got == {(1, "a", "MIT"), (None, None, None), (3, "a", "MIT")}


def test_terms_are_counted_where_their_segments_are(spark):
    """Terms of segments were shuffled four times: distinct rows, counts, norms and products."""
    rows = spark.createDataFrame([(1, 0, "Licensed under CC BY 4.0."), (1, 0, "Licensed under CC BY 4.0."), (2, -1, "Nothing to say.")], "key long, segment int, text string")
    found = licenses._cosines(spark, rows, licenses.Weights(licenses.TEMPLATES, licenses.FULL), 0.75)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(key") == 1
    assert [(x.key, x.segment, x.licence, x.words) for x in found.collect()] == [(1, 0, "CC-BY-4.0", 5)]
