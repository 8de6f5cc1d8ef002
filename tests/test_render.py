"""Markdown as HTML."""

import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkmill.functions.render import to_html


@pytest.mark.parametrize(
    "text, want",
    [
        (None, ""),
        ("# A *b* #\n\ntext", "<h1>A <em>b</em></h1>\n<p>text</p>"),
        ("Title\n===\nSub\n---", "<h1>Title</h1>\n<h2>Sub</h2>"),
        ("a **b *c* d** `x<y` ~~z~~ snake_case_name", "<p>a <strong>b <em>c</em> d</strong> <code>x&lt;y</code> <s>z</s> snake_case_name</p>"),
        ("- a\n- b\n  - c\n- d", "<ul>\n<li>a</li>\n<li>b\n<ul>\n<li>c</li>\n</ul></li>\n<li>d</li>\n</ul>"),
        ("3. a\n4. b", '<ol start="3">\n<li>a</li>\n<li>b</li>\n</ol>'),
        ("- a\n\n- b", "<ul>\n<li><p>a</p></li>\n<li><p>b</p></li>\n</ul>"),
        ("> a\n> > b", "<blockquote>\n<p>a</p>\n<blockquote>\n<p>b</p>\n</blockquote>\n</blockquote>"),
        ("```py x\n<b>\n```", '<pre><code class="language-py">&lt;b&gt;\n</code></pre>'),
        ("| a | b |\n|---|--:|\n| 1 \\| 2 | 3 |", '<table>\n<thead>\n<tr><th>a</th><th style="text-align:right">b</th></tr>\n</thead>\n<tbody>\n<tr><td>1 | 2</td><td style="text-align:right">3</td></tr>\n</tbody>\n</table>'),
        ("[a *b*](http://x/_y_ \"t\") ![i](p.png)", '<p><a href="http://x/_y_" title="t">a <em>b</em></a> <img src="p.png" alt="i"></p>'),
        ("[![i](p.png)](/q)", '<p><a href="/q"><img src="p.png" alt="i"></a></p>'),
        ("see http://x/a_b_c.", '<p>see <a href="http://x/a_b_c">http://x/a_b_c</a>.</p>'),
        ("a  \nb\n\n***", "<p>a<br>\nb</p>\n<hr>"),
        ("[x](\x01javascript:alert)", "<p>[x](\x01javascript:alert)</p>"),
        ("[x](javascript:alert) \\*no\\*", "<p>[x](javascript:alert) *no*</p>"),
    ],
)
def test_blocks_and_marks(text, want):
    assert to_html(text) == want


_TAG = re.compile(r"</?(?:h[1-6]|p|em|strong|s|code|pre|ul|ol|li|blockquote|table|thead|tbody|tr|th|td|hr|br|a|img)(?: (?:href|src|alt|title|class|start|style)=\"[^\"<>]*\")*>")
_line = st.one_of(st.text(alphabet="ab<>\"'&#|-`~*_[]()!\\: \t1.é\0", max_size=16), st.sampled_from(["```", "<script>alert(1)</script>", "[a](javascript:b)", "![x\"](y)", "> - 1. a", "|---|"]))


@settings(max_examples=200, deadline=None, derandomize=True)
@given(st.lists(_line, max_size=10).map("\n".join))
def test_no_html_of_the_input_survives(text):
    html = to_html(text)
    assert "<" not in _TAG.sub("", html) and "\0" not in html
    assert 'href="javascript' not in html


@pytest.mark.parametrize("piece", [">", "- ", "*a ", "`", "[", "[a](", "| a ", "  ", "_", "# ", "http://x "])
def test_long_lines_take_no_long_time(piece):
    start = time.monotonic()
    to_html(piece * 20_000)
    to_html((piece + "\n") * 5_000)
    assert time.monotonic() - start < 8
