"""Template deduction on generated hosts whose class names say nothing, with known main text."""

import random

from strandwise.llm import html_template as T

WORDS = "river stone cloud paper green house seven light under winter garden market quiet letter moving little yellow window people summer answer behind corner doctor engine".split()


def sentence(rng, low=6, high=14):
    return " ".join(rng.choice(WORDS) for _ in range(rng.randint(low, high))).capitalize() + "."


def host(seed, pages=30):
    """Pages as (url, html, main text): a header, a menu, a side column with changing links, a sign-up box within the article's column, a long footer."""
    rng = random.Random(seed)
    names = iter(rng.sample([a + b for a in ("qu", "ze", "bo", "ka", "vi", "lo") for b in ("rix", "tam", "pel", "dun", "mos")], 12))
    top, menu, wrap, column, inner, box, side, foot, meta, body = (next(names) for _ in range(10))
    tagline, promo, legal, sign_up = sentence(rng), sentence(rng, 20, 30), " ".join(sentence(rng) for _ in range(8)), sentence(rng, 8, 12)
    links = "".join(f"<li><a href='/{w}'>{w}</a></li>" for w in rng.sample(WORDS, 6))
    out = []
    for i in range(pages):
        title, parts = sentence(rng, 3, 6), [sentence(rng) for _ in range(rng.choice((1, 1, 2, 5, 9)))]
        items = [sentence(rng, 2, 4) for _ in range(rng.choice((0, 0, 3)))]
        related = "".join(f"<li><a href='/{rng.random()}'>{sentence(rng, 3, 7)}</a></li>" for _ in range(5))
        blocks = [f"<h1>{title}</h1>", *[f"<p>{p}</p>" for p in parts]]
        blocks.insert(2, f"<div class='{box}'><p>{sign_up}</p></div>")
        blocks += ["<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"] if items else []
        html = (
            f"<html><head><title>{title}</title></head><body><div class='{top}'>{tagline}</div><div class='{menu}'><ul>{links}</ul></div>"
            f"<div class='{wrap}'><div class='{column}'><div class='{inner}'>{''.join(blocks)}</div></div><div class='{side}'><p>{promo}</p><ul>{related}</ul></div></div><div class='{foot}'><p>{legal}</p></div></body></html>"
        )
        out.append((f"http://h{seed}.example/{i}", html, "\n".join([title, *parts, *items])))
    return out


def test_text_of_hosts_without_telling_names(spark):
    rows = [r for seed in range(12) for r in host(seed)]
    frame = spark.createDataFrame([(i, u, h) for i, (u, h, _) in enumerate(rows)], "page_id long, url string, html string")
    found = {r.page_id: r.text for r in T.extract(frame).collect()}
    right = sum(found[i] == text for i, (_, _, text) in enumerate(rows))
    assert right / len(rows) >= 0.98


def test_the_template_decides():
    """Without a template the same pages give other text: the footer of short articles, and the box within the article."""
    empty = {"richest": "", "links": [], "words": []}
    rows = [r for seed in range(12) for r in host(seed)]
    alone = sum(T.main_text(h, empty) == text for _, h, text in rows)
    assert alone / len(rows) < 0.1


def test_names_with_other_words_hide_nothing(spark):
    pages = [
        '<body><nav>Home</nav><article id="search-for-meaning"><p>Long words of the article.</p></article><div class="box"><p>A box beside it with a good deal more text than there is in the article itself.</p></div></body>',
        '<body><article><p>The day began.</p><p class="share-price">It rose to nine.</p><p>It ended.</p></article></body>',
        '<body><article><p>The day began.</p><div class="legal">The court agreed.</div><p>It ended.</p></article></body>',
    ]
    rows = [(i, f"http://{i}.example/", p) for i, p in enumerate(pages)]
    found = {r.page_id: r.text for r in T.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == {0: "Long words of the article.", 1: "The day began.\nIt rose to nine.\nIt ended.", 2: "The day began.\nThe court agreed.\nIt ended."}


def test_repeated_rows_empty_table_and_clashing_names(spark):
    page = "<body><article><p>One text of this page.</p></article></body>"
    schema = "page_id long, url string, html string, host string, template string, text string, token string"
    rows = [(1, "http://a.example/", page, "x", "x", "x", "x")] * 3 + [(None, "odd url", page, None, None, None, None), (2, "http://a.example/2", "", "", "", "", "")]
    frame = spark.createDataFrame(rows, schema)
    found = sorted((r.page_id or 0, r.text, r.n_chars) for r in T.extract(frame).collect())
    assert found == [(0, "One text of this page.", 22), *[(1, "One text of this page.", 22)] * 3, (2, "", 0)]
    assert T.extract(frame.limit(0)).count() == 0
    long = "<body><article>" + "<div>" * 3000 + "<p>Deep.</p>" + "</div>" * 3000 + "<p>" + "word " * 200_000 + "</p></article></body>"
    deep = spark.createDataFrame([(1, "http://b.example/", long, "", "", "", "")], schema)
    assert T.extract(deep).first().text == "Deep.\n" + ("word " * 200_000).strip()
