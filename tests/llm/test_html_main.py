"""Main text: known articles in pages of many shapes, and template classes against plain vectors."""

import random
from collections import defaultdict

import pytest

from strikeline.llm import html_main as h

PARTS = ["A &amp; B  first\n line", "Second &eacute;<b>bold</b>er <a href='x'>link</a> end", "Third&nbsp;one<br>after"]
TEXT = "Title\n\nA & B first line\n\nSecond ébolder link end\n\nThird one after"
BODY = "<h1>Title</h1>" + "".join(f"<p>{p}</p>" for p in PARTS)


@pytest.mark.parametrize(
    "page",
    [
        f"<html><body><nav><ul><li>menu</ul></nav><article>{BODY}</article><footer>foot</footer></body></html>",
        f"<body class='has-sidebar'><header><h2>Site</h2></header><main>{BODY}</main><aside>side <p>more</aside>",
        f"<div id=page><div class='menu'>m</div><div class='post-content'>{BODY}<div class='ad'>buy</div><form>q<input></form></div><div class='comments'><article class='comment'>no</article></div></div>",
        f"<article>{BODY.replace('</p>', '')}<section id='comments'><h3>Comments</h3><p>x</section></article>",
        f"<div>{BODY}</div><div class='cookie-notice'>accept</div><script>if(a<b)'</p>'</script><style>p{{}}</style><!-- <p>no -->",
        f"<main>{BODY}<p hidden>no</p><p style='display: none'>no</p><noscript>no</noscript><button>no</button></main>",
        f"<div class='sidebar-layout'><article>{BODY}</article></div>",
        f"<article><header>{BODY[: BODY.index('<p>')]}</header>{BODY[BODY.index('<p>') :]}",
    ],
)
def test_articles(page):
    assert h.extract(page, set()) == TEXT


@pytest.mark.parametrize("page", ["", "<", "<a", "</p>", "<!--", "<script>", "<p a='", "&#0;&bogus;<", "<![CDATA[x]]>", "<p><p><p>", "<" * 3000, "<a b=\"'>" * 500])
def test_broken_pages_do_not_crash(page):
    h.extract(page, set())
    h.extract(page + "<article>ok</article>", set())


@pytest.mark.parametrize("name", sorted(h.RAW))
def test_unclosed_raw_elements(name):
    page = f"<article><p>before</p><{name} width=1><p>behind</p></article>"
    assert h.extract(page, set()) == ("before" if name in h.OPEN_RAW else "before\n\nbehind")
    assert h.extract(f"<article><p>before</p><{name}>no</{name}><p>behind</p></article>", set()) == "before\n\nbehind"


def test_math_text_stays():
    page = "<article><p>so <math><semantics><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow><annotation encoding='tex'>x=2</annotation></semantics></math> holds</p></article>"
    assert h.extract(page, set()) == "so x=2 holds"


def test_many_unclosed_elements():
    assert h.extract("<article>" + "<video><p>x" * 20_000, set()).count("x") == 20_000


def test_time_grows_with_the_page():
    assert len(h.extract("<div><p>x" * 20_000, set())) > 20_000


def site(spark, pages):
    return spark.createDataFrame(pages, "page_id long, url string, html string, host string")


def test_template_texts_are_dropped(spark):
    rng = random.Random(0)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(4))
    pages, want = [], {}
    for i in range(12):
        own = [" ".join(word() for _ in range(8)) for _ in range(3)]
        pages.append((i, f"https://one.example/{i}", "<article><p>Read more of us</p>" + "".join(f"<p>{t}</p>" for t in own) + "<p>Subscribe now</p></article>", "x"))
        want[i] = "\n\n".join(own)
    pages += [(100 + i, "https://two.example/x", "<article><p>Same page</p></article>", "x") for i in range(9)]  # copies are one page
    pages += [(200, None, None, "x"), (201, "::bad[", "<p>alone</p>", "x"), (0, "https://one.example/0", pages[0][2], "x")]
    want |= {100 + i: "Same page" for i in range(9)} | {200: "", 201: "alone"}
    found = h.main_text(site(spark, pages)).collect()
    assert len(found) == len(pages)
    assert all(r.text == want[r.page_id] for r in found)


def test_copies_of_an_article_stay(spark):
    rng = random.Random(2)
    text = lambda: " ".join("".join(rng.choice("abcdef") for _ in range(5)) for _ in range(8))
    article = [text() for _ in range(20)]
    pages, want = [], {}

    def add(host, noise, said, furniture=()):
        i = len(pages)
        pages.append((i, f"https://{host}.example/{i}", f"<!-- ad {i} --><script>track({i})</script><div class='ad'>{noise}</div><article>" + "".join(f"<p>{t}</p>" for t in [*said, *furniture]) + "</article>", "x"))
        want[i] = "\n\n".join(said)

    for i in range(9):
        add("copies", "", article)  # equal but for script and comment
        add("adverts", text(), article)  # and other adverts
        add("edited", "", [*article[:i], text(), *article[i + 1 :]])  # one paragraph changed
        add("shortened", "", article[:i] + article[i + 1 :])  # one paragraph missing
        add("mixed", "", [*article[:i], text(), *article[i + 1 :]], ["Read more"])
    for _ in range(6):
        add("mixed", "", [text() for _ in range(3)], ["Read more"])
    found = {r.page_id: r.text for r in h.main_text(site(spark, pages)).collect()}
    assert found == want


def test_join_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(h, "BROADCAST_TOKENS", -1)
    test_template_texts_are_dropped(spark)


def test_classes_have_equal_vectors(spark):
    rng = random.Random(1)
    pages = [(i, f"http://h/{i}", "<div class=a><p>head</p>" + f"<p>u{i}</p>" * rng.randint(1, 3) + "<div><p>x</p></div>" * rng.randint(1, 2) + "</div>", "") for i in range(20)]
    vectors = defaultdict(dict)
    for i, _, page, _ in pages:
        for element, text in h.parse(page):
            for t in {h.token(element.key), h.token(element.key, text)}:
                pass
            for t in (h.token(element.key), h.token(element.key, text)):
                vectors[t][i] = vectors[t].get(i, 0) + 1
    groups = defaultdict(set)
    for t, v in vectors.items():
        groups[tuple(sorted(v.items()))].add(t)
    want = {frozenset(g) for v, g in groups.items() if len(v) >= h.LEAST and len(v) >= h.SUPPORT * 20}
    found = h.classes(h.page_tokens(site(spark, pages))).collect()
    assert {frozenset(r.tokens) for r in found} == want
    assert sum(r.parent is None for r in found) >= 1


def test_empty_table(spark):
    assert h.main_text(site(spark, [])).collect() == []


def test_deep_pages_take_little_memory():
    import tracemalloc

    page = "<article>" + "<div><p>x" * 100_000
    tracemalloc.start()
    assert h.extract(page, set()).count("x") == 100_000
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()


def words(rng, n):
    return " ".join("".join(rng.choice("abcdef") for _ in range(5)) for _ in range(n))


def test_menus_without_a_name_are_found_by_their_host(spark):
    """Links that vary by page, in elements whose names say nothing, on pages that mark no article."""
    rng = random.Random(5)
    pages, want = [], {}
    for i in range(10):
        text = [words(rng, 30) for _ in range(3)]
        links = "".join(f"<li><a href='/{k}'>{words(rng, 2)}</a> &amp;</li>" for k in range(4))
        said = f"<p>{text[0]} <a href='/x'>{text[1]}</a> {text[2]}</p>"  # prose with a link, elsewhere without
        pages.append((i, f"https://plain.example/{i}", f"<div class=x7><h1>{words(rng, 3)}</h1>{said if i == 0 else ''.join(f'<p>{t}</p>' for t in text)}</div><div class=x9><ul>{links}</ul></div>", "x"))
        title = pages[-1][2].split("<h1>")[1].split("</h1>")[0]
        want[i] = "\n\n".join([title, " ".join(text)] if i == 0 else [title, *text])
        # a host of links alone keeps them, as does one whose links outweigh its other text
        pages.append((100 + i, f"https://index.example/{i}", f"<ul>{links}</ul>", "x"))
        alone = [t.split("<")[0] + " &" for t in links.split("'>")[1:]]
        want[100 + i] = "\n\n".join(alone)
        pages.append((200 + i, f"https://hub.example/{i}", f"<p>{words(rng, 2)} {i}</p><ul>{links}</ul>", "x"))
        want[200 + i] = "\n\n".join([pages[-1][2].split("</p>")[0][3:], *alone])
    pages.append((300, "https://plain.example/links", f"<div class=x9><ul>{links}</ul></div>", "x"))  # nothing else: kept
    want[300] = "\n\n".join(alone)
    pages.append((301, "https://few.example/", pages[0][2], "x"))  # too few pages to tell
    found = {r.page_id: r.text for r in h.main_text(site(spark, pages)).collect()}
    assert found.pop(301) == h.extract(pages[0][2], set()) != want[0]
    assert found == want


def test_links_inside_a_marked_article_stay(spark):
    rng = random.Random(6)
    pages, want = [], {}
    for i in range(8):
        links = [words(rng, 2) for _ in range(4)]
        text = words(rng, 30)
        pages.append((i, f"https://refs.example/{i}", f"<article><p>{text}</p><ul>{''.join(f'<li><a>{t}</a></li>' for t in links)}</ul></article>", "x"))
        want[i] = "\n\n".join([text, *links])
    assert {r.page_id: r.text for r in h.main_text(site(spark, pages)).collect()} == want


def test_links_between_the_paragraphs_of_an_unmarked_article_stay(spark):
    """The class of the paragraphs lies around the list; the list behind them is a menu as before."""
    rng = random.Random(7)
    pages, want = [], {}
    for i in range(10):
        paragraphs = [words(rng, 25) for _ in range(3 + i % 4)]
        links = [words(rng, 2) for _ in range(2 + i % 3)]
        menu = "".join(f"<li><a>{words(rng, 2)}</a></li>" for _ in range(4 + i % 2))
        listed = f"<ul>{''.join(f'<li><a>{t}</a></li>' for t in links)}</ul>"
        pages.append((i, f"https://lists.example/{i}", f"<div class=x7><p>{paragraphs[0]}</p>{listed}{''.join(f'<p>{t}</p>' for t in paragraphs[1:])}</div><div class=x9><ul>{menu}</ul></div>", "x"))
        want[i] = "\n\n".join([paragraphs[0], *links, *paragraphs[1:]])
    assert {r.page_id: r.text for r in h.main_text(site(spark, pages)).collect()} == want


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_pages_against_a_plain_reading(spark, sf):
    """Every page here marks its article; between the marks only block tags end a block."""
    import html
    import re

    def plain(page):
        inside = re.search(r"<article>(.*?)</article>", page, re.DOTALL)[1]
        blocks = re.split(r"</?(?:h1|p)\b[^>]*>", inside)
        said = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", b.replace("<br>", " "))).split()) for b in blocks]
        return "\n\n".join(b for b in said if b)

    pages = spark.read.parquet(f"/root/testdata/{sf}/pages.parquet")
    want = {r.page_id: plain(r.html) for r in pages.collect()}
    assert {r.page_id: r.text for r in h.main_text(pages).collect()} == want
