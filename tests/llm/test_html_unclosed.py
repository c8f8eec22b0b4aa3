"""Pages whose embedded elements have no closing tag."""

from __future__ import annotations

import pytest

from quarry.llm.html_extract import main_text, text_blocks


def said(page: str) -> str:
    return " | ".join(b.text for b in text_blocks(page))


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<body><p>one</p><embed src=a.swf><p>two</p><div>three</div></body>", "one | two | three"),
        ("<body><div>one <object data=x>inner</div><p>two</p></body>", "one | two"),
        ("<body><div><div>a</div><select><option>x<div>y</div></div><p>two</p></body>", "a | two"),
        ("<body><div>one<select><option>x</div><p>two</p><select><option>y</select><p>three</p></body>", "one | two | three"),
        ("<body><div>one<iframe src=x></iframe> more</div><p>two</p></body>", "one more | two"),
        ("<body><svg><title>t</title><g></svg><p>two</p></body>", "two"),
        ("<body><p>one</p><script>var x = '</div>'; <p>two</p></body>", "one"),
        ("one <video src=x> two", "one two"),
        ("<body><p>one</p><object data=x><p>two</p><div>three</div>", "one | two | three"),
        ("<html><body><p>one</p><object data=x><p>two</p></body></html>", "one | two"),
        ("<body><p>one</p><noscript><p>two</p><p>three</p>", "one | two | three"),
    ],
)
def test_silent_elements_end(page, want):
    assert said(page) == want


def test_teasers_are_not_the_main_part():
    """Five teasers that are articles, and the text in a plain element: the text is returned, the teasers are not."""
    long = " ".join(["word"] * 60) + "."
    teasers = "".join(f"<article><h2><a href={k}>Read this {k}</a></h2><p>A few words of it.</p></article>" for k in range(5))
    for page in (f"<body>{teasers}<div><h1>Title</h1><p>{long}</p><p>{long}</p><p>{long}</p></div></body>", f"<body><div><h1>Title</h1><p>{long}</p><p>{long}</p><p>{long}</p></div>{teasers}"):
        text = main_text(page)[0]
        assert text.count(long) == 3 and "A few words" not in text and "Read this" not in text


def test_one_long_article_among_teasers_stays():
    long = " ".join(["word"] * 60) + "."
    teasers = "".join(f"<article><p>A few words of {k}.</p></article>" for k in range(5))
    page = f"<body><article><h1>Title</h1><p>{long}</p><p>{long}</p></article><div class=comments><p>{long}</p><p>{long}</p><p>{long}</p></div><aside>{teasers}</aside></body>"
    assert main_text(page)[0] == f"Title\n{long}\n{long}"
