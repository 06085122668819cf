import random
from html.parser import HTMLParser

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm.html_layout import render
from quillon.llm.queries import QUERIES


def test_blocks_inline_and_space():
    assert render("<p>Hello <b>wor</b>ld<p>Second&nbsp;para<div>x</div>y") == "Hello world\n\nSecond para\n\nx\ny"
    assert render("a<br>b<br/>c") == "a\nb\nc"
    assert render("<pre>a\n  b</pre>z") == "a\n  b\n\nz"


def test_lists():
    assert render("<ul><li>one<li>two<ol start=3><li>a<li value=7>b</ol></ul>") == "- one\n- two\n  3. a\n  7. b"
    assert render("<ol reversed><li>x<li>y</ol>") == "2. x\n1. y"


def test_tables_line_up():
    html = "<table><tr><th>Name<th>Qty<tr><td>apple<td>3<tr><td rowspan=2>pear long<td>10</tr><tr><td>11</table>"
    assert render(html) == "Name       Qty\napple      3\npear long  10\n           11"
    assert render("<table><tr><td colspan=2>wide cell here<td>z<tr><td>a<td>b<td>c</table>").splitlines()[1] == "a  b  c"


def test_visibility():
    html = "<head><title>t</title></head><p hidden>a<p style='display: none'>b</p><p style='visibility:hidden'>c<i style='visibility:visible'>d</i></p><script>e</script><noscript>f</noscript><template>g</template><dialog>h</dialog><dialog open>i</dialog>"
    assert render(html).split() == ["d", "i"]


def test_malformed():
    assert render(None) == render("") == ""
    assert render("<p class=it's>don't</p><a href=\"x>y\">ok</a>") == "don't\n\nok"
    assert render("a < b & c &lt; d") == "a < b & c < d"
    assert render("a<!-- b <b>c") == "a"
    assert render("</div></table>x<td>y") == "xy"
    assert "deep" in render("<div>" * 5000 + "deep")
    assert render("<table><tr><td><table><tr><td>in</table>out</table>") == "in\n\nout"
    assert len(render("<p>" + "long " * 200_000)) == 999_999


@given(st.text(alphabet="<>/=\"' abdiptrhuol!-&;#\n", max_size=120))
@settings(max_examples=300, deadline=None)
def test_any_input_gives_text(html):
    assert isinstance(render(html), str)


class Words(HTMLParser):
    """Brute force: the words of a page whose only hidden matter is script, style and title."""

    INLINE = {"b", "a", "i", "em", "strong", "span"}

    def __init__(self):
        super().__init__()
        self.out, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style", "title")
        self.out.append("" if tag in self.INLINE else " ")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style", "title")
        self.out.append("" if tag in self.INLINE else " ")

    def handle_data(self, data):
        self.out.append("" if self.skip else data)


def words_of(html):
    p = Words()
    p.feed(html or "")
    return [w for w in "".join(p.out).split() if w != "-"]


def test_query_holds_all_words(spark, tables):
    rows = [(1, "u", "<ul><li>a<li>b</ul><p>c <b>d</b>e"), (2, None, None), (3, "", ""), (4, "x", "<h1>T</h1>" + "<p>para text</p>" * 500), (4, "x", "dup")]
    d = tables("pages", rows, "page_id long, url string, html string")
    out = [(r["page_id"], [w for w in r["text"].split() if w != "-"], r["n_chars"] == len(r["text"])) for r in QUERIES["op1_layout_text"](spark, d).collect()]
    assert sorted(out) == sorted((i, words_of(h), True) for i, _, h in rows)


def test_text_of_formulas_drawings_and_maps():
    math = "<p>As <math><semantics><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow><annotation>x=2tex</annotation></semantics></math> shows"
    assert render(math) == "As x=2 shows"
    assert render("a<math display=block><mi>E</mi></math>b") == "a\nE\nb"
    svg = "<p>See <svg><title>no</title><desc>no</desc><defs><text>no</text></defs>no<path d='M0'/><g><text>left <tspan>label</tspan></text><rect/><text>right</text></g></svg>here"
    assert render(svg) == "See left label right here"
    assert render("<svg><style/><text>a</text><text display='none'>b</text><foreignObject><p>c</p></foreignObject></svg>d") == "a\n\nc\n\nd"
    assert render("x <map name=m><area href=#>links: <a href=#>one</a></map> y") == "x links: one y"


def test_cells_keep_their_lines():
    assert render("<table><tr><td><h1>Title</h1><p>Para one</p><ul><li>a<li>b</ul><td>side</table>") == "Title\n\nPara one\n\n- a\n- b\n\nside"
    assert render("<table><tr><td>a<br>b<td>c<tr><td>dddd<td>e<br>f</table>") == "a     c\nb\ndddd  e\n      f"
    assert render("<table><tr><td><p>one</p><td><div>two</div></table>") == "one  two"


def test_style_sheets():
    page = """<style>/* .x{display:none} */ .h{display:none} @media print{.p{display:none}} @media screen { #q.z , p.w{visibility:hidden} } .h.s{display:block} div .d{display:none}</style>
      <style media=print>.x{display:none}</style><div class=h>no</div><div class="h s">a</div><p class="p x">b</p><p class=w>no<i style='visibility: visible'>c</i></p><b id=q class=z>no</b> <i class=d>d</i> <i style='display:block' class=h>e</i>"""
    assert render(page).split() == ["a", "b", "c", "d", "e"]
    assert render("<style>.h{display:none</style><p class=h>gone</p>x") == "x"


def _block(rng, depth=0):
    """A random block: its HTML, and its lines as the layout is documented, found without the renderer."""
    text = lambda: " ".join(rng.choice(["alpha", "be", "gamma", "d"]) for _ in range(rng.randrange(1, 5)))
    kind = rng.choice(["p", "h", "ul", "ol", "pre", "grid", "quote", "hidden"] + (["layout"] if depth == 0 else []))
    if kind in ("p", "h"):
        t, tag = text(), "p" if kind == "p" else f"h{rng.randrange(1, 7)}"
        return f"<{tag}> {t.replace(' ', '  ')}<!-- x -->\n</{tag}>", [t]
    if kind in ("ul", "ol"):
        items, start = [text() for _ in range(rng.randrange(1, 4))], rng.randrange(1, 9)
        html = f"<{kind} start={start}>" + "".join(f"<li>{x}" for x in items) + f"</{kind}>"
        return html, [(f"{start + i}. " if kind == "ol" else "- ") + x for i, x in enumerate(items)]
    if kind == "pre":
        return "<pre>a\n   b</pre>", ["a", "   b"]
    if kind == "quote":
        t = text()
        return f"<blockquote>{t}</blockquote>", ["  " + t]
    if kind == "hidden":
        return rng.choice([f"<p hidden>{text()}</p>", f"<div class=off>{text()}</div>", f"<script>{text()}</script>"]), []
    if kind == "grid":
        wide = rng.randrange(1, 4)
        rows = [[text() for _ in range(wide)] for _ in range(rng.randrange(1, 4))]
        size = [max(len(r[c]) for r in rows) for c in range(wide)]
        html = "<table>" + "".join("<tr>" + "".join(f"<td>{x}" for x in r) for r in rows) + "</table>"
        return html, ["  ".join(x.ljust(n) for x, n in zip(r, size)).rstrip() for r in rows]
    inner = [_block(rng, 1) for _ in range(3)] + [("<p>x</p><p>y</p>", ["x", "", "y"])]
    return "<table><tr><td>" + "".join(h for h, _ in inner) + "</table>", _joined([x for _, x in inner])


def _joined(blocks):
    out = []
    for lines in blocks:
        if lines:
            out += ([""] if out else []) + lines
    return out


@pytest.mark.parametrize("seed", range(200))
def test_generated_pages_against_their_models(seed):
    rng = random.Random(seed)
    blocks = [_block(rng) for _ in range(rng.randrange(1, 8))]
    html = "<html><head><style>.off{display:none}</style><title>t</title></head><body>" + "".join(h for h, _ in blocks) + "</body></html>"
    want = "\n".join(_joined([x for _, x in blocks]))
    assert render(html) == want.strip("\n")
