"""Pages that keep a reader busy: nothing may take time with the square of their length."""

import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from twinarm.llm import html_text

#: The same tokens by one expression that looks for the end of a tag from every "<".
PLAIN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*|[^>]*)>"
    r"|<[!?/][^>]*>",
    re.S,
)
PIECES = ["<", ">", '"', "'", "/", "-", "=", " ", "x", "<a ", "<p>", "</p", "<!--", "-->", "<!", "<?", "</", "<b c='", '<i d=">']


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=25))
def test_tokens_are_those_of_the_plain_expression(pieces):
    page = "".join(pieces)
    want = [(m.start(), m.end(), m["close"] or "", (m["tag"] or "").lower(), m["attrs"] or "") for m in PLAIN.finditer(page)]
    tokens, got, at = html_text._Tokens(page), [], 0
    while token := tokens.next(at):
        got.append(token)
        at = token[1]
    assert got == want


@pytest.mark.parametrize("piece", ["<a ", '<a "', '<a ">" ', "<a '\"", "<b>", "<b></i>", "</i>", "<!", "<", "<!-- ", "<p><b>", "<a<a", "</"])
def test_long_pages_take_little_time(piece):
    article = "<article><p>The text itself.</p></article>"
    began = time.perf_counter()
    found = html_text.blocks(article + piece * 60_000)
    assert time.perf_counter() - began < 10
    assert found[0].text == "The text itself."


def test_a_tag_ends_outside_quotes_where_it_can():
    texts = [b.text for b in html_text.blocks("<p title='a > b'>one</p><p title='c>two</p><p>three")]
    assert texts == ["one", "two", "three"]
