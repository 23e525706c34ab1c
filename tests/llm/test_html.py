"""Extraction: worked pages, generated trees against a plain renderer, and time in proportion to the page."""

import random
import time

import pytest

from assaylake.llm import html_text


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("<p>One<p>Two <b>bold</b><br>line", "One\n\nTwo bold\nline"),
        ("<title>t</title><script>x</script><style>y</style><p hidden>n</p><div style='Display : None'>n</div>a<!-- c -->b", "ab"),
        ("<ul><li>a<li>b<ol start=3><li>c<li>d</ol></ul>e", "- a\n- b\n  3. c\n  4. d\n\ne"),
        ("<table><tr><td>k<td>long value<tr><th>key2<td>v</table>", "k     long value\nkey2  v"),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td colspan=2>wide one<td>z</table>", "a         b\n          c\nwide one     z"),
        ("<div>a</div><div>b</div><h1>T</h1>c", "a\nb\n\nT\n\nc"),
        ("<pre> x\n  y</pre>&amp;&lt;", " x\n  y\n\n&<"),
        ("<pre>\n\nx</pre>", "\nx"),
        ("<details><summary>s</summary>gone</details><q>w</q>", 's\n"w"'),
        ("a <![foo[ x > b </p> <unknown>c", "a b\n\nc"),
        ("<td>loose</td></table></ul><li>x", "loose\n- x"),
        ("<div>" * 3000 + "deep", "deep"),
        ("<div style='visibility:hidden'>no <i style='visibility: visible'>yes</i> no<input type=submit value=no></div>", "yes"),
        ("<span style='visibility:hidden'>a<b style='display:none'>b</b></span>c", "c"),
        ("<input type=submit value=Go> <input type=reset> <input value=typed><input type=hidden value=h><button>B</button>", "Go Reset B"),
        ("<math><mi>x</mi><mo>=</mo><annotation>tex</annotation></math> <svg><title>t</title><text>label</text></svg>", "x= label"),
        ("a < b <3 </ x>&lt;p&gt; &copy <a title='>'>t</a><textarea>\n&lt;u></textarea>", "a < b <3 <p> © t<u>"),
        ("<img alt=no>x<!-- > --><!-->y<!--->z<? a>w<a", "xyzw"),
        ("<script>if (a</b>c) '</p>'</script >v<noscript><p>no</noscript>", "v"),
    ],
)
def test_html(html, text):
    assert html_text.html_to_text(html) == text


def test_html_column(spark, no_docs):
    pages = spark.createDataFrame([(1, "<p>a", "old"), (2, None, "old"), (1, "<p>a", None)], "page_id int, `raw.html` string, text string")
    assert sorted(r.text for r in html_text.extract_text(pages, "raw.html").collect()) == ["", "a", "a"]
    assert html_text.extract_text(no_docs, "text", "t").count() == 0


INLINE, BLOCK = ("b", "i", "span"), ("div", "section", "p", "ul")


def made(rnd, depth, block):
    """A random tree (tag, style, children); inline elements hold inline ones only, lists hold items."""
    kids = []
    for _ in range(rnd.randrange(1, 4)):
        kind = rnd.random()
        if kind < 0.4 or depth == 0:
            kids.append(" ".join(f"w{rnd.randrange(99)}" for _ in range(rnd.randrange(1, 4))))
        elif kind < 0.6 or not block:
            kids.append((rnd.choice(INLINE), style(rnd), made(rnd, depth - 1, False)))
        else:
            tag = rnd.choice(BLOCK)
            inner = [("li", style(rnd), made(rnd, depth - 1, True)) for _ in range(rnd.randrange(1, 4))] if tag == "ul" else made(rnd, depth - 1, tag != "p")
            kids.append((tag, style(rnd), inner))
    return kids


def style(rnd):
    return rnd.choice(["", "", "", "", "display:none", "visibility:hidden", "visibility:visible"])


def page(kids):
    return "".join(k if isinstance(k, str) else f"<{k[0]} style='{k[1]}'>{page(k[2])}</{k[0]}>" for k in kids)


def plain(kids, visible=True, in_list=False):
    """The lines of a tree, by plain recursion: None stands for a blank line that is due between lines."""
    lines, text = [], []

    def end():
        if line := " ".join("".join(text).split()):
            lines.append(line)
        text.clear()

    def walk(kids, visible, in_list):
        for k in kids:
            if isinstance(k, str):
                text.append(k if visible else "")
                continue
            tag, css, inner = k
            if css == "display:none":
                continue
            seen = {"visibility:hidden": False, "visibility:visible": True}.get(css, visible)
            if tag in INLINE:
                walk(inner, seen, in_list)
                continue
            end()
            gap = tag == "p" or (tag == "ul" and not in_list)
            lines.extend([None] * gap)
            if tag == "li":
                own = tidy(plain(inner, seen, True))
                lines.extend(("  " if i else "- ") + x if x else "" for i, x in enumerate(own))
            else:
                walk(inner, seen, in_list or tag == "ul")
                end()
            lines.extend([None] * gap)

    walk(kids, visible, in_list)
    end()
    return lines


def tidy(lines):
    out, due = [], False
    for x in lines:
        if x is None:
            due = bool(out)
        else:
            out += [""] * due + [x]
            due = False
    return out


def test_generated_trees_equal_a_plain_renderer():
    rnd = random.Random(8)
    for _ in range(400):
        tree = made(rnd, 4, True)
        assert html_text.html_to_text(page(tree)) == "\n".join(tidy(plain(tree))), page(tree)


@pytest.mark.parametrize("html", ["<div>" * 100_000, "<a " * 100_000, "<p><button>" + "<div>" * 50_000, "<ul><li>x" * 10_000, "<table><tr><td>a" * 5_000, "<a b='\"" * 50_000, "<table>" + "<tr><td rowspan=999 colspan=1000>a<td>b" * 3_000, "<table><tr><td>" + "w" * 50_000 + "<tr><td>x<td>y" * 10_000])
def test_broken_pages_take_linear_time(html):
    began = time.process_time()
    assert len(html_text.html_to_text(html)) < 40 * len(html)
    assert time.process_time() - began < 8
