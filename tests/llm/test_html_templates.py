"""HTML extraction where only the alignment of a host's pages can tell content from boilerplate."""

from siftrow.llm.html import content_blocks, extract_main_text, merge, parse, read_tree, template_of, tree_of, written


def texts_of(spark, pages):
    rows = [(i, "http://h.example/", page) for i, page in enumerate(pages)]
    return [r.text for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()]


def test_the_template_decides_inside_and_outside_of_articles(spark):
    page = (
        '<body><div class="masthead">All about rivers</div><article class="card"><div class="box">Read us daily</div><p>teaser {0}</p></article>'
        '<div class="story">Loose words<h2>Heading {0}</h2><p>body one {0}</p><p>body two {0}</p></div><div class="box">Read us daily</div></body>'
    )
    got = texts_of(spark, [page.format(i) for i in range(6)])
    assert got == [f"teaser {i}\nHeading {i}\nbody one {i}\nbody two {i}" for i in range(6)]


def test_a_lone_page_and_equal_pages_keep_all_but_service(spark):
    page = "<body><nav>menu</nav><article>quote</article><div><p>body</p></div></body>"
    assert texts_of(spark, [page]) == ["quote\nbody"]
    assert texts_of(spark, [page] * 3) == ["quote\nbody"] * 3


def test_odd_and_empty_pages_leave_a_host_its_template(spark):
    page = '<body><div class="top">{1}</div><div class="story"><p>story {0}</p></div><div class="end">Written by hand</div></body>'
    pages = [page.format(i, "Rivers Lakes Seas") for i in range(300)]
    odd = ["", None, "<<", "<body><h1>404</h1></body>", '<body><table><tr><td>other layout</td></tr></table></body>', page.format("odd", "Rivers Lakes Seas Ponds")]
    got = texts_of(spark, pages[:150] + odd + pages[150:])
    assert got[:150] + got[156:] == [f"story {i}" for i in range(300)]
    # What is not the template's text stays.
    assert got[150:152] == ["", ""] and got[153:156] == ["404", "other layout", "Rivers Lakes Seas Ponds\nstory odd"]


def test_copies_of_a_page_are_not_a_template(spark):
    page = '<body><div class="top">Rivers</div><div class="story"><p>story {}</p></div></body>'
    assert texts_of(spark, [page.format(min(i, 2)) for i in range(20)]) == [f"story {min(i, 2)}" for i in range(20)]


def test_a_leading_text_is_found_among_many():
    pages = ['<div class="top">{}</div><p>story {}</p>'.format(f"own {i}" if i % 10 == 0 else "same", i) for i in range(1000)]
    trees = [tree_of(parse(p)) for p in pages]
    while len(trees) > 1:
        trees = [merge(*trees[i : i + 2]) if i + 1 < len(trees) else trees[i] for i in range(0, len(trees), 2)]
    template = read_tree(written(template_of(read_tree(written(trees[0])))))
    assert [content_blocks(parse(pages[i]), template) for i in (0, 1)] == [["own 0", "story 0"], ["story 1"]]


def test_templates_reach_any_depth_and_through_inline_and_unknown_elements(spark):
    inner = '<div class="top">Rivers</div><a href="/"><div class="story"><p>story {0}</p></div><div class="box">Join us</div></a><x-note>Mind the gap</x-note>'
    for depth in (20, 1500):
        page = "<div>" * depth + inner + "</div>" * depth
        assert texts_of(spark, [page.format(i) for i in range(4)]) == [f"story {i}" for i in range(4)]
    page = "<x-page>" * 20 + inner + "</x-page>" * 20
    assert texts_of(spark, [page.format(i) for i in range(4)]) == [f"story {i}" for i in range(4)]


VARYING = (
    '<body><div class="ka"><a href="/x{0}">Rivers {0}</a> <a href="/y{0}">Lakes {0}</a></div><div class="kb">Buy {0} now</div>'
    '<div class="kc"><h1>Heading {0}</h1><div class="la"><p>A long paragraph about the water of the river number {0} and its banks.</p>'
    '<p class="notice">A second long paragraph of the same story {0}, with <a href="#">one link</a> in it.</p></div>'
    '<div class="lb"><a href="/{0}a">More {0}</a><a href="/{0}b">Even more {0}</a></div></div><div class="kd">Written {0}</div></body>'
)
STORY = (
    "Heading {0}\nA long paragraph about the water of the river number {0} and its banks.\n"
    "A second long paragraph of the same story {0}, with one link in it."
)


def test_menus_and_adverts_that_vary_go_without_telling_names(spark):
    assert texts_of(spark, [VARYING.format(i) for i in range(8)]) == [STORY.format(i) for i in range(8)]
    # Also from the figures of one page.
    assert texts_of(spark, [VARYING.format(5)]) == [STORY.format(5)]


def test_articles_are_found_with_all_lists_of_names_switched_off(spark, monkeypatch):
    import re

    from siftrow.llm import html

    for name in ("SERVICE_TAGS", "SERVICE_ROLES", "SERVICE_NAMES", "MAIN_TAGS"):
        monkeypatch.setattr(html, name, frozenset())
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    trees = {}
    for page in pages:
        host, tree = page.url.split("/")[2], tree_of(parse(page.html))
        trees[host] = merge(trees[host], tree) if host in trees else tree
    templates = {host: template_of(tree) for host, tree in trees.items()}
    same = 0
    for page in pages:
        article = re.search(r"<article>(.*?)</article>", page.html, re.S)[1]
        same += content_blocks(parse(page.html), templates[page.url.split("/")[2]]) == html._blocks(html.outline(parse(article))[0], [])
    assert same >= 0.98 * len(pages)


def test_the_query_s_articles_are_whole(spark):
    import re

    from siftrow.llm import html
    from siftrow.llm.queries.documents import op7_html_extraction

    pages = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    for row in op7_html_extraction(spark, "/root/testdata/sf0.001").collect():
        article = re.search(r"<article>(.*?)</article>", pages[row.page_id], re.S)[1]
        assert row.text == "\n".join(html._blocks(html.outline(parse(article))[0], []))


def test_words_in_names_inside_an_article_drop_nothing(spark):
    page = (
        "<body><nav><a>menu {0}</a></nav><article><header><h1>Title {0}</h1></header><p class='comment-policy-study'>First part of the text {0}.</p>"
        "<section id='related-work'><p>Second part of the text {0}, of some length.</p></section><p>Where <math><mi>x</mi></math> is {0}.</p>"
        "<div class='share'>Share {0}</div></article><div class='comments'><p>I liked the text number {0} a lot, thanks for it all.</p></div></body>"
    )
    want = "Title {0}\nFirst part of the text {0}.\nSecond part of the text {0}, of some length.\nWhere x is {0}."
    assert texts_of(spark, [page.format(i) for i in range(5)]) == [want.format(i) for i in range(5)]


def test_hosts_beyond_the_bound_are_joined_with_the_same_result(spark, monkeypatch):
    from siftrow.llm import html

    pages = [VARYING.format(i) for i in range(12)]
    monkeypatch.setattr(html, "SENT_CHARS", 0)
    assert texts_of(spark, pages) == [STORY.format(i) for i in range(12)]


def test_matching_is_the_best_over_random_trees():
    import random
    from functools import lru_cache

    from siftrow.llm.html import matching

    rng = random.Random(2)

    def tree(depth):
        return [rng.choice("ab"), 1, None, [tree(depth - 1) for _ in range(rng.randint(0, 3))] if depth else []]

    def shape(node):
        return node[0], tuple(map(shape, node[3]))

    @lru_cache(None)
    def best(x, y):
        """Every way to leave a first tree out or to map the first trees to each other."""
        if not x or not y:
            return 0
        skip = max(best(x[1:], y), best(x, y[1:]))
        return max(skip, 1 + best(x[0][1], y[0][1]) + best(x[1:], y[1:])) if x[0][0] == y[0][0] else skip

    for _ in range(300):
        a, b = ([tree(2) for _ in range(rng.randint(0, 4))] for _ in "ab")
        most, pairs = matching(a, b)
        assert most == best(tuple(map(shape, a)), tuple(map(shape, b)))
        assert all(p < q and i < j for (p, i), (q, j) in zip(pairs, pairs[1:])) and all(a[i][0] == b[j][0] for i, j in pairs)
