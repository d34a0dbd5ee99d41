"""Main text: theme markup, comment regions, inline elements, brute-force runs and odd rows."""

import random

import pytest

from loomdoc.llm import html_main as H

BODY = " ".join(f"word{i}" for i in range(80))
LABELLED = [f'<html><head><title>T</title></head><body><nav><ul><li><a href="/">Home {k}</a></li></ul></nav><div class="ad">Buy now {k}</div><div class="zone-x">Cheap stuff {k} for all of you</div><article><h1>Head</h1><p>{BODY}</p><ul><li>one</li></ul></article><footer>Foot</footer></body></html>' for k in range(60)]


def fitted():
    counts = H.Counter()
    for page in LABELLED:
        counts.update(H.label_counts(page))
    return H.learned(counts)


MODELS = {"learned": fitted(), "priors": H.learned({})}


@pytest.mark.parametrize("model", MODELS)
@pytest.mark.parametrize(
    "around",
    [
        ('<article class="post hentry category-legal tag-search">', "</article>"),
        ('<article class="article share-enabled">', "</article>"),
        ('<article class="share">', "</article>"),
        ('<main class="site-main has-sidebar">', "</main>"),
        ('<div class="content sidebar-right">', "</div>"),
        ('<form id="aspnetForm"><div class="content">', "</div></form>"),
        ('<div id="xyz">', "</div>"),
        ("", ""),
    ],
)
def test_theme_markup_keeps_the_article(model, around):
    page = f'<html><head><title>T</title></head><body><nav><a href="/">Home</a> <a>About</a></nav>{around[0]}<p>{BODY}</p>{around[1]}<footer>some foot words</footer></body></html>'
    assert H.main_text(page, MODELS[model]) == BODY


@pytest.mark.parametrize("model", MODELS)
@pytest.mark.parametrize("own", ["article", 'div class="content"', 'div id="xyz"'])
def test_comments_go_even_as_articles(model, own):
    page = f'<{own}><h1>Head</h1><p>{BODY}</p></{own.split()[0]}><div class="comments"><article class="comment"><div class="content">I like it so very much, thanks to all</div></article></div>'
    assert H.main_text(page, MODELS[model]) == f"Head {BODY}"
    inside = f'<article><h1>Head</h1><p>{BODY}</p><div id="comments"><article><p>I like it so very much</p></article></div></article>'
    assert H.main_text(inside, MODELS[model]) == f"Head {BODY}"


@pytest.mark.parametrize("model", MODELS)
def test_parts_of_an_article(model):
    page = '<article><p>Let <math><mi>x</mi><mo>=</mo><mn>3</mn></math> be, <button>press</button> fo<b>r</b> more.<script>var no="<p>no</p>"</script></p><form><label>Your mail</label></form><aside>Else</aside><header>Top</header><ul class="menu"><li>Menu</li></ul><ul><li>One<li>Two</ul><table><tr><td>a<td>b</table></article><p>Unmarked words stay outside</p>'
    assert H.main_text(page, MODELS[model]) == "Let x=3 be, press for more. One Two a b"


def test_any_feature_can_become_negative():
    page = f'<div id="q"><p>{BODY}</p></div><div class="zone-x">Cheap stuff for all of you</div>'
    assert MODELS["learned"][".zone-x"] < -1
    assert H.main_text(page, MODELS["learned"]) == BODY


def test_best_run_equals_brute_force():
    rng = random.Random(4)
    for _ in range(400):
        x = [rng.choice([-3.0, -1.0, -0.5, 0.0, 0.5, 1.0, 2.0]) for _ in range(rng.randrange(0, 12))]
        a, b = H.best_run(x)
        sums = [sum(x[i:j]) for i in range(len(x)) for j in range(i + 1, len(x) + 1)]
        assert sum(x[a:b]) == max([0, *sums])


def test_runs_of_whole_pages_equal_brute_force():
    rng = random.Random(8)
    names = ["div", "p", 'div class="ad"', 'div class="content"', "nav", "article", "b", "li", 'div class="zone-x"']
    for _ in range(150):
        page = ""
        for _ in range(rng.randrange(1, 9)):
            n = rng.choice(names)
            page += f"<{n}>" + " ".join(rng.choice("abcdef") for _ in range(rng.randrange(0, 5))) + (f"</{n.split()[0]}>" if rng.random() < 0.8 else "")
        events = H.scored(page, MODELS["learned"])
        gains = [e[3] for e in events]
        best = max([0.0, *(sum(gains[i:j]) for i in range(len(gains)) for j in range(i + 1, len(gains) + 1))])
        a, b = H.best_run(gains)
        assert abs(sum(gains[a:b]) - best) < 1e-9
        kept = [w for kind, v, s, _ in events[a:b] if kind == "text" and s > 0 for w in v.split()]
        assert H.main_text(page, MODELS["learned"]).replace(" ", "") == "".join(kept)


def test_odd_rows(spark):
    long = "<div><p>" + "w " * 200_000 + "</p></div>"
    page = LABELLED[0]
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<nav>menu</nav>"), (None, "u", "<p>Plain &amp; simple</p>"), (5, "u", page), (5, "u", page), (6, "u", long), (7, "u", "no markup < at all"), (8, "u", "<p>open <b>never <!-- closed")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = [(r.page_id, r.text, r.n_chars) for r in H.extract(df).collect()]
    want = [(1, ""), (2, ""), (3, ""), (None, "Plain & simple"), (5, f"Head {BODY} one"), (5, f"Head {BODY} one"), (6, " ".join(["w"] * 200_000)), (7, "no markup < at all"), (8, "open never")]
    assert sorted(got, key=str) == sorted([(i, t, len(t)) for i, t in want], key=str)
    none = H.extract(df.limit(0))
    assert none.columns == ["page_id", "url", "text", "n_chars"] and none.count() == 0
