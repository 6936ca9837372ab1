import html
import itertools
import os
import re
from collections import Counter

import numpy as np
import pytest

from trailmill.llm import html_extract as H
from trailmill.llm.synthetic_pages import is_content, labelled_page


@pytest.fixture(scope="module")
def extractor():
    return H.Extractor(H.fitted())


def test_held_out_pages(extractor):
    rng = np.random.default_rng(4711)
    hit = wrong = missed = 0
    for _ in range(150):
        source = labelled_page(rng)
        want = Counter(x for x in H.blocks(H.parse(source)).split("\n") if is_content(x))
        got = Counter(x for x in extractor.texts([source])[0].split("\n") if x)
        hit += sum(len(x) * n for x, n in (want & got).items())
        wrong += sum(len(x) * n for x, n in (got - want).items())
        missed += sum(len(x) * n for x, n in (want - got).items())
    assert hit / (hit + wrong) > 0.97 and hit / (hit + missed) > 0.97


PAGE = """<html><head><title>t</title><script>var x="</p><article>no</article>";</script><style>p{}</style></head><body>
<div class="cookie-banner">We use cookies &amp; more.<button>OK</button></div><nav><ul><li><a href=/>Home</a><li><a href=/a>About us</a></ul></nav>
<article><h1>The  main\n title</h1><p>First &lt;paragraph&gt; with <b>bold</b> text, long enough to count as a sentence.<p>Second one<br>after a break; it also holds some more words to read.
<div class="ad">Buy this now, cheap offer</div><p>Third paragraph &#233;t&eacute; closes the story with a final sentence.</article>
<section id="comments"><h2>Comments</h2><div class="comment"><p>I disagree with all of this.</p></div></section>
<aside class="sidebar"><h3>Related</h3><ul><li><a href=/b>Another story</a></li></ul></aside><footer>&copy; 2024 Example</footer>"""


def test_a_page_by_hand(extractor):
    assert extractor.texts([PAGE])[0] == "The main title\nFirst <paragraph> with bold text, long enough to count as a sentence.\nSecond one after a break; it also holds some more words to read.\nThird paragraph été closes the story with a final sentence."


def worth(page, score, weight, state, switch):
    """The worth of a labelling (K, D, M by element), or None if it contradicts itself; by its definition, not by recursion."""
    total = 0.0
    for k, x in enumerate(state):
        if k and state[page.parent[k]] != "M" and x != state[page.parent[k]]:
            return None
        if x == "M" and not page.kids[k]:
            return None
        gain = 0.0 if page.hidden[k] else score[k] * weight[k]
        total += (-1e6 if page.hidden[k] else gain) if x == "K" else -gain if x == "D" else abs(gain) - switch
    return total


def test_decoding_is_the_best_labelling():
    rng = np.random.default_rng(3)
    for _ in range(120):
        page, n = H.Page(), int(rng.integers(1, 7))
        for k in range(n):
            page.open(-1 if not k else int(rng.integers(0, k)), "div", 0, k > 0 and rng.random() < 0.15)
        score, weight = rng.normal(0, 2, n).tolist(), rng.uniform(0.2, 2, n).tolist()
        switch = float(rng.choice([0.0, 0.5, 3.0]))
        found = ["DKMM"[x] for x in H.states(page, score, weight, switch)]
        best = max(w for x in itertools.product("KDM", repeat=n) if (w := worth(page, score, weight, x, switch)) is not None)
        assert abs(worth(page, score, weight, found, switch) - best) < 1e-9


def test_nothing_hidden_or_dropped_is_kept(extractor):
    copy = PAGE.replace("<article>", '<div style="display:none"><article><h1>Hidden title</h1><p>A hidden paragraph that reads like any other paragraph of the story, with commas, and a stop.</article></div><article>', 1)
    assert extractor.texts([copy])[0] == extractor.texts([PAGE])[0]
    rng = np.random.default_rng(1)
    page = H.parse(copy)
    for _ in range(20):
        kept = H.decoded(page, rng.normal(0, 3, len(page.parent)).tolist(), [1.0] * len(page.parent))
        assert not any(kept[k] for k in range(len(kept)) if any(page.tag[j] in H.DROPPED or page.hidden[j] for j in chain(page, k)))


def chain(page, k):
    while k >= 0:
        yield k
        k = page.parent[k]


def test_pages_without_structure_are_their_text(extractor):
    assert extractor.texts(["no markup at all"])[0] == "no markup at all"
    assert extractor.texts(["<p>One short line.</p>"])[0] == "One short line."
    assert extractor.texts(["<html><head><title>x</title></head><body>Plain &amp; simple<br>text</body></html>"])[0] == "Plain & simple text"


LINE = "The ferry left the harbour at dawn, and the few people who had come to see it go stood in the rain until its lights were gone behind the point."
NAV, FOOT = '<nav><ul><li><a href="/">Home</a></li><li><a href="/a">About us</a></li></ul></nav>', "<footer><p>Copyright by the publisher. All rights reserved.</p></footer>"


@pytest.mark.parametrize(
    ("source", "text"),
    [
        (f"<html><body><article><p>{LINE}</p></article></body></html>", LINE),
        (f"<html><body>{NAV}<main><h1>A short story</h1><p>{LINE}</p></main>{FOOT}</body></html>", f"A short story\n{LINE}"),
        (f"<html><body>{NAV}<div><h2>A short story</h2><p>{LINE}</p></div>{FOOT}</body></html>", f"A short story\n{LINE}"),
        (f"<body>{NAV}<article><header><h1>Title</h1></header><p>It ends here.</p><aside>Read more</aside><div class='comments'>Nice!</div></article>{FOOT}", "Title\nIt ends here."),
        (f"<body><div class='sidebar'>{NAV}<p>Ad</p></div><p>Short.</p><form><p>Name</p><input></form>{FOOT}", "Short."),
        (f"<body>{NAV}{FOOT}</body>", ""),
    ],
)
def test_short_texts_are_not_lost(extractor, source, text):
    """What is left where the trees keep nothing; what they keep of such a page holds the paragraph too."""
    got = extractor.texts([source])[0]
    assert got == text or text and text.split("\n")[-1] in got.split("\n") and "Home" not in got and "Copyright" not in got
    page = H.parse(source)
    assert H.blocks(page, H.decoded(page, [-3.0] * len(page.parent), [1.0] * len(page.parent))) == text


def test_a_wrapper_named_like_an_edge_hides_nothing(extractor):
    page = H.parse(f"<body><div class='site top'><ul><li>x</li></ul><p>{LINE}</p>{FOOT}</div></body>")
    assert H.blocks(page, H.decoded(page, [-3.0] * len(page.parent), [1.0] * len(page.parent))) == f"x\n{LINE}"


def test_quotes_inside_unquoted_values(extractor):
    assert extractor.texts(["<p class=it's>It is here.</p><p id=a\"b>And here.</p>"])[0] == "It is here.\nAnd here."
    assert H.parse("<p title='a > b' class = \"c > d\">x</p>").runs == [(1, "x")]


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001/pages.parquet"), reason="no tables")
def test_articles_of_the_pages_table(extractor):
    """Recall and precision by lines against the text of <article>, less what a reader would not call its text."""
    import pyarrow.parquet as pq

    sources = [s for s in pq.read_table("/root/testdata/sf0.001/pages.parquet").column("html").to_pylist() if s and s.count("<article") == 1]
    hit = missed = wrong = 0
    for source, got in zip(sources, extractor.texts(sources), strict=True):
        inner = re.search(r"<article[^>]*>(.*?)</article>", source, re.DOTALL)[1]
        lines = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.findall(r"<(?:p|h[1-6]|li|blockquote|pre)\b[^>]*>(.*?)(?=</?(?:p|h[1-6]|li|blockquote|pre)\b|\Z)", inner, re.DOTALL)]
        want, have = Counter(x for x in lines if x), Counter(x for x in got.split("\n") if x)
        hit += sum(len(x) * n for x, n in (want & have).items())
        missed += sum(len(x) * n for x, n in (want - have).items())
        wrong += sum(len(x) * n for x, n in (have - want).items())
    assert sources and hit / (hit + missed) > 0.98 and hit / (hit + wrong) > 0.9


def test_odd_pages(spark, extractor):
    odd = [None, "", "<", "<p", "no markup at all", "<!-- never closed <p>x</p>", "<script>alert(1)", "<p>" * 3000 + "deep" + "</p>" * 10, "<div>" * 1500 + "x", "<a href='" + "q" * 50_000, PAGE, PAGE]
    frame = spark.createDataFrame([(i, "u", h, 1) for i, h in enumerate(odd)], "page_id long, url string, html string, text int")
    out = {r.page_id: r.text for r in H.extracted(frame.drop("text"), H.fitted()).collect()}
    assert len(out) == len(odd) and out[0] == out[1] == "" and out[10] == out[11] == extractor.texts([PAGE])[0]
    assert H.extracted(frame.limit(0), H.fitted()).count() == 0
