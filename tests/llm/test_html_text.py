"""Extraction against page templates, and its cost on hostile pages."""

import itertools
import time
import tracemalloc

import pytest
from sparkloom.llm import html_text

SHELLS = [  # article body goes to {}
    "<html><head><title>T</title><style>p {{}}</style></head><body><nav><ul><li><a href=/>Home</a></ul></nav>{}<footer>(c) us</footer></body></html>",
    "<body><div class='site-header'><a href=/>Home</a> <a href=/x>More</a></div><div class=row><div class='sidebar'><p>Side text that goes on and on for a while.</p></div><div class='post-content'>{}</div></div><script>var a = '<p>no</p>';</script></body>",
    "<body><main><article>{}</article><section class=comments><p>Great post, I liked all of it very much indeed!</p></section></main><aside>Ads</aside></body>",
    "<table><tr><td class=nav><a href=1>One</a><a href=2>Two</a></td><td class=story>{}</td></tr></table>",
]
BODIES = [
    ["A headline", "First paragraph with some words, and a comma.", "Second one is here."],
    ["Only one paragraph of text, long enough to be chosen over all else on the page."],
    ["x < y & z", "\u00e9t\u00e9 \u2014 caf\u00e9", "last   words\n of it"],
]


@pytest.mark.parametrize("shell, body", itertools.product(range(len(SHELLS)), range(len(BODIES))))
def test_generated_pages(spark, shell, body):
    import html

    parts = "".join(f"<p>{html.escape(t)}</p>" for t in BODIES[body])
    page = html_text.Page(SHELLS[shell].format(parts))
    assert page.text(*page.chosen([])) == "\n".join(" ".join(t.split()) for t in BODIES[body])


HOSTILE = {
    "nested": "<div>" * 200_000 + "text",
    "nested with text": "<div>a " * 140_000,
    "open tags": "<a " * 350_000,
    "open quotes": "<a x=\"" * 170_000,
    "open declarations": "<!x" * 330_000,
    "inline": "<b>" * 330_000 + "<p>one</p>" * 10,
    "long attribute": "<a " + "x" * 1_000_000 + ">",
    "closing": "</div>" * 170_000,
    "items": "<ul><li>" * 120_000 + "x",
    "siblings": "<div><div class=x>ab</div>" * 40_000,
    "comments": "<!-- " * 200_000,
}


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_pages_take_linear_time(name):
    source = HOSTILE[name]

    def seconds(text: str) -> float:
        began = time.process_time()
        page = html_text.Page(text)
        page.text(*page.chosen([page.path[i] for i in list(page.score)[:3]]))
        return time.process_time() - began

    assert seconds(source) < 15  # half a minute and more, or gigabytes, where paths are kept whole
    tracemalloc.start()
    html_text.Page(source[: len(source) // 4])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6


def test_comment_and_script_that_nothing_closes():
    assert [t for t, _, _ in html_text.Page("<p>a</p><!-- <p>b</p> c").blocks] == ["a"]
    assert [t for t, _, _ in html_text.Page("<p>a</p><script> <p>b</p> c").blocks] == ["a"]
    assert [t for t, _, _ in html_text.Page("<p>a</p>1 <2 and 3").blocks] == ["a", "1 <2 and 3"]
