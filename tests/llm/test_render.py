from hypothesis import given, settings
from hypothesis import strategies as st

from hitlens.llm.render import visible_text


def test_blocks_and_implied_ends():
    page = "<title>t</title><h1>Head</h1><p>One <b>two</b>\n three<p>Next<br>line<div>in</div>after"
    assert visible_text(page) == "Head\n\nOne two three\n\nNext\nline\n\nin\nafter"


def test_hidden():
    page = (
        "<head><title>x</title><style>p{}</style></head><script>var a='</p><b>';</script><p hidden>a</p>"
        "<p style='DISPLAY: none'>b</p><noscript>c</noscript><template><p>d</p></template><!-- e --><p>shown</p>"
        "<input type=hidden value=f><img alt='picture'>"
    )
    assert visible_text(page) == "shown\n\npicture"


def test_lists():
    page = "<ul><li>a<li>b<ol start=3><li>c</li><li>d</ol><li>e</ul>tail"
    assert visible_text(page) == "  - a\n  - b\n    3. c\n    4. d\n  - e\n\ntail"


def test_tables_are_aligned():
    page = "<table><tr><th>Name<th>N<tr><td>long name<td>1<tr><td colspan=2>wide</table>"
    assert visible_text(page) == "Name      | N\nlong name | 1\nwide"


def test_preformatted_and_entities():
    assert visible_text("<pre>a  b\n  c &lt;d&gt;</pre>&copy;&nbsp;x &amp;amp;") == "a  b\n  c <d>\n\n© x &amp;"


def test_broken_markup():
    assert visible_text("a < b <a href=\"x>y</a> z") .startswith("a < b")
    assert visible_text("</p></div>x</td>") == "x"
    assert visible_text("<p>open <b>never closed") == "open never closed"
    assert visible_text("") == ""


def test_deep_nesting():
    assert visible_text("<div>" * 50_000 + "x" + "</div>" * 50_000) == "x"
    assert visible_text("<table><tr><td>" * 40 + "x") == "x"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<li>", "<ul>", "</ul>", "<td>", "<table>", "</table>", "<tr>", "<b>", "</b>", "<br>", "word ", "<pre>", "</pre>", "<", "&amp;", '"', "<a b='"]), max_size=60).map("".join))
def test_no_visible_word_is_lost(page):
    # A mark right before a letter opens a tag.
    if "<a" not in page and "<word" not in page:
        assert visible_text(page).count("word") == page.count("word")


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/!-abp\"'= &;\n", max_size=200))
def test_never_fails(page):
    assert isinstance(visible_text(page), str)


numerals = st.one_of(st.text(alphabet="-0123456789²٣½ x", max_size=6), st.just("9" * 5000), st.just("-" + "1" * 9))


@settings(max_examples=200, deadline=None)
@given(numerals, numerals, numerals)
def test_any_attribute_value_is_read(start, value, span):
    page = f'<ol start="{start}"><li value="{value}">a<li>b</ol><table><tr><td colspan="{span}" rowspan="{span}">c<td>d</table>'
    text = visible_text(page)
    assert [word for word in "abcd" if word in text] == list("abcd")


def test_numbers_of_lists():
    text = visible_text('<ol start="--3"><li>a<li value=-2>b<li>c<li value="²">d</ol>')
    assert [line.strip() for line in text.split("\n")] == ["1. a", "-2. b", "-1. c", "0. d"]
    assert visible_text('<ol start=7><li>a</ol><ol start="²"><li>b</ol>').split() == ["7.", "a", "1.", "b"]


def test_formulas_drawings_and_maps():
    page = (
        "<p>If <math><mi>a</mi><mo>=</mo><mfrac><mn>1</mn><mn>2</mn></mfrac><annotation>latex</annotation></math> then"
        "<svg><title>t</title><desc>d</desc><defs><text>unused</text></defs><path d='M0'/><text>left</text><text>right</text>"
        "<defs/><text>end</text></svg><map name=m><a href=x>inline</a></map>"
    )
    assert visible_text(page) == "If a= 1 2 then\nleft\nright\nend\ninline"
    assert visible_text("<svg><title>x</svg><p>shown") == visible_text("<svg><defs><p>shown") == "shown"
    assert visible_text("<desc>a</desc> <svg><foreignObject><div>b<p>c</foreignObject></svg>d").split() == ["a", "b", "c", "d"]


TAGS = "<math> </math> <mi> </mi> <mfrac> </mfrac> <svg> </svg> <text> </text> <g/> <map> </map> <p> </p> <td> <table>".split()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([*TAGS, "</table>", "<b>", "word "]), max_size=60).map("".join))
def test_no_visible_word_is_lost_in_formulas(page):
    assert visible_text(page).count("word") == page.count("word")
