"""Nothing that HTML shows is swallowed by elements that end on their own."""

import pytest

from plexar.llm.html_extract import blocks_of


@pytest.mark.parametrize(("html", "want"), [
    ("<html><head><title>x</title><body><article><p>one</p></article>", ["one"]), ("<head><title>x</title><meta a=1><p>one", ["one"]), ("<head><style>a{}</style> text", ["text"]),
    ("<head><title>x</head><body><p>one", ["one"]), ("<head><title>x</title><script>var a;</script></head><p>one", ["one"]),
    ("<p>one <svg width=1 /> two</p><p>three", ["one two", "three"]), ("<p>a <math/> b</p>", ["a b"]), ("<svg><svg/><text>no</text></svg><p>one", ["one"]),
    ("<p>one</p><![foo[ x ]]><p>two</p>", ["one", "two"]), ("<article><p>so <math><mi>x</mi><mspace/><mo>=</mo><mn>1</mn></math> holds</p></article>", ["so x=1 holds"]),
])
def test_blocks(html, want):
    assert [b.text for b in blocks_of(html)] == want
