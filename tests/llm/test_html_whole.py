"""Main text of pages whose articles have headings, a short intro and sections of unequal length."""

import pytest

from tessera.llm import html

LONG = "<p>" + "Many words of a long paragraph, with commas, to score well, on and on, and more words after them.</p><p>".join([""] * 21) + "The end.</p>"
SHORT = "<p>One paragraph, of eight points, alone, in its section, at the end, of it all, and done, here.</p>"
PARTS = f"<h1>Title</h1><p>Short intro.</p><section><h2>First</h2>{LONG}</section><section><h2>Second</h2>{SHORT}</section>"
OTHER = '<nav><a href="/">Home</a></nav><aside>Side, bar, text</aside>'


@pytest.mark.parametrize("around", ["<body><article>%s</article></body>", "<body><main>%s</main></body>", "<body><main><article><div>%s</div></article></main></body>", "<body><div><div>%s</div></div></body>", "<body>%s</body>"])
def test_unequal_sections_are_kept_whole(around):
    got = html.main_text(f"<html>{around % (OTHER + PARTS)}<footer>All rights</footer></html>")
    assert got.startswith("Title Short intro. First Many words") and got.endswith("The end. Second One paragraph, of eight points, alone, in its section, at the end, of it all, and done, here.")
    assert got.count("Many words") == 20 and "Home" not in got and "Side" not in got and "rights" not in got


STORY = "<h1>Title</h1>" + "".join(f"<p>Paragraph {i}, of the story, with commas, and enough words to count as prose, as it should.</p>" for i in range(6))
TOLD = "Title " + " ".join(f"Paragraph {i}, of the story, with commas, and enough words to count as prose, as it should." for i in range(6))
LAYOUTS = [
    "<body class='has-sidebar'><div class='layout-sidebar-right'><article>%s</article></div></body>",
    "<body><div class='no-comments'><div class='with-sidebar' id='page'>%s</div></div></body>",
    "<body><div class='cookie-recipe'>%s</div></body>",
    "<body><div class='sponsor-history'>%s</div></body>",
    "<body><div id='comment-on-law'>%s</div></body>",
    "<body><form id='aspnetForm'><div>%s</div></form></body>",
    "<body><div class='modal-open'><main>%s</main></div></body>",
    "<body><div class='popup'>%s</div></body>",
    "<body><div class='sidebar-left-layout'><section>%s</section></div></body>",
]
BESIDE = [
    "<section class='reader-responses'><p>I, for one, liked it, a lot, and I say so, here, at length.</p></section>",
    "<div class='related-articles'><p>Other, story, with, commas, of another day, and more.</p></div>",
    "<div class='cookie-banner'><p>We use cookies, on this site, as, you, know, by now.</p></div>",
    "<div id='comments' class='comments-area'><article class='comment'><p>A comment, with, commas, and words, many of them, yes.</p></article></div>",
    "<div class='newsletter-signup'><p>Sign up, now, for our letter, sent each week, to you.</p></div>",
    "<div class='share-buttons'><p>Share, this, with, everyone, you know, today.</p></div>",
    "<div class='post-sidebar'><p>Side, words, with commas, of no use, to the reader.</p></div>",
    "<form class='search'><p>Search, the site, for words, and more, of them.</p></form>",
]


@pytest.mark.parametrize("layout", LAYOUTS)
def test_no_class_loses_an_article(layout):
    assert html.main_text(f"<html>{layout % STORY}<footer>All rights</footer></html>") == TOLD


@pytest.mark.parametrize("beside", BESIDE)
@pytest.mark.parametrize("layout", ["<body><article>%s%s</article></body>", "<body><main><article>%s</article>%s</main></body>", "<body><div class='content'>%s%s</div></body>", "<body class='single'><div id='page'><div class='entry-content'>%s</div>%s</div></body>"])
def test_what_stands_beside_goes(layout, beside):
    assert html.main_text(f"<html>{layout % (STORY, beside)}</html>") == TOLD


def test_paragraphs_with_telling_names_stay():
    body = STORY + "<p class='sponsor-history'>The sponsor, of old, gave, what was needed, in full.</p><div id='comment-on-law'><p>The law, as it stands, says, what it says, in full.</p></div>"
    assert html.main_text(f"<body><article>{body}</article></body>").endswith("gave, what was needed, in full. The law, as it stands, says, what it says, in full.")


def test_only_pages_without_text_are_empty(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet").collect()
    assert all(html.main_text(r.html) for r in pages)
    assert html.main_text("<body><div class='comments'><p>Only a comment, nothing else, on the page, at all.</p></div></body>") == "Only a comment, nothing else, on the page, at all."
