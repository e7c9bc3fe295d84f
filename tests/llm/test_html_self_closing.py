"""Self-closing elements whose content is skipped."""

from __future__ import annotations

from engram.llm import html_extract


def test_self_closing_svg_and_math_swallow_nothing():
    for tag in ("<svg class=x/>", "<svg/>", "<math />", "<SVG href='/a/>b' />"):
        assert html_extract.extract(f"<p>one two three</p>{tag}<p>four five six</p>", {}) == "one two three\nfour five six"
    assert html_extract.extract("<p>one two three</p><svg a='/'><text>no</text></svg><p>four five six</p>", {}) == "one two three\nfour five six"
