import random
import time

import numpy as np
import pytest
from llm.llm_helpers import words

from trackuse.llm import html_blocks as hb
from trackuse.llm import html_extraction as hx


def page(rng, paragraphs=4):
    body = "".join(f"<p>{words(rng, rng.randrange(3, 40))} &amp; <b>so</b>\n on</p>" for _ in range(paragraphs))
    links = "".join(f"<li><a href=x>{words(rng, 1)}</a></li>" for _ in range(5))
    return (
        f"<!DOCTYPE html><html><head><title>{words(rng, 4)}</title><script>if (a<b) '<p>no</p>'</script></head><body>"
        f"<nav><ul>{links}</ul></nav><!-- <p>no</p> --><div class=ad>{words(rng, 9)}</div>"
        f"<article><h1>{words(rng, 6)}</h1>{body}</article><footer>&copy; {words(rng, 5)}</footer></body></html>"
    )


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(70)
    return spark.createDataFrame([(i, f"u{i}", page(rng)) for i in range(80)], "page_id long, url string, html string")


@pytest.fixture(scope="module")
def model(pages):
    return hx.train(pages)


def extract(model, text):
    found = hb.blocks(text)
    return [b.text for b, label in zip(found, model.decode([b.features for b in found]), strict=True) if label]


def test_whole_table(pages):
    import re

    pages = pages.select("page_id", "url", "html", hx.F.lit("own").alias("text"), hx.F.lit("own").alias("seed"))
    for r in hx.main_texts(pages).join(pages.select("page_id", "html"), "page_id").collect():
        body = re.search("<article>(.*)</article>", r.html, re.S)[1].replace("&amp;", "&")
        parts = [" ".join(re.sub("<[^>]*>", "", p).split()) for p in re.split("</?(?:p|h1)>", body)]
        assert r.text == "\n\n".join(p for p in parts if p)


def test_other_layouts(model):
    rng = random.Random(71)
    wrong = total = 0
    for seed in range(60):
        for layout in hx.layouts(page(rng), seed)[1:]:
            found = hb.blocks(layout)
            labels = model.decode([b.features for b in found])
            wrong += sum(int(b.main) != x for b, x in zip(found, labels, strict=True))
            total += len(found)
    assert wrong < 0.01 * total


def test_hand_written_page(model):
    text = (
        "<body><header class='site-header'><h1>Site</h1></header><div id=main><div class='post-content'><h2>Title here</h2>"
        "<p>First para of some text.<p>Second with <i>markup</i>&nbsp;and<br>break.<div class=advert>Buy now</div>"
        "<blockquote>Quoted words of somebody.</blockquote></div><div class=comments><p>Nice post!</p></div>"
        "<form><label>Name</label></form></div><aside><p>Related</p></aside><footer>&copy; 2020</footer>"
    )
    assert extract(model, text) == ["Title here", "First para of some text.", "Second with markup and break.", "Quoted words of somebody."]


def test_broken_markup_never_fails(model):
    rng = random.Random(72)
    bits = ["<p>", "</p", "<", ">", "&", "&#x;", "<!--", "-->", "<script>", "</script>", "<a href='", '"', "text", "</div></div>", "<li>", "\x00", "é😀"]
    for _ in range(300):
        hb.blocks("".join(rng.choice(bits) for _ in range(rng.randrange(30))))
    assert [b.text for b in hb.blocks("a < b <p>c")] == ["a < b", "c"] and hb.blocks("<script>never closed") == []
    assert len(hb.blocks("<div>" * 3_000 + "deep")) == 1


def test_viterbi_and_marginals_against_all_sequences():
    from itertools import product

    rng = np.random.default_rng(73)
    crf = hx.Crf(rng.normal(size=(2, 1 << hb.FEATURE_BITS)), rng.normal(size=(2, 2)))
    features = [[int(x) for x in rng.integers(0, 1 << hb.FEATURE_BITS, 3)] for _ in range(7)]
    scores = crf.emissions(features)
    total = {y: sum(scores[i, l] for i, l in enumerate(y)) + sum(crf.steps[a, b] for a, b in zip(y, y[1:])) for y in product((0, 1), repeat=7)}
    assert tuple(crf.decode(features)) == max(total, key=total.get)
    z = sum(np.exp(s) for s in total.values())
    one, two = crf.marginals(features)
    for i in range(7):
        assert np.isclose(one[i, 1], sum(np.exp(s) for y, s in total.items() if y[i]) / z)
    assert np.isclose(two[2, 1, 0], sum(np.exp(s) for y, s in total.items() if y[2] and not y[3]) / z)


def test_null_empty_and_repeated_pages_and_none(spark, pages):
    rows = [(1, "u", None), (2, None, ""), (None, "v", "plain words only"), (None, "v", "plain words only")]
    odd = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = hx.main_texts(odd.unionByName(pages)).where("url is null or url in ('u', 'v')")
    assert sorted(r.text is None for r in found.collect()) == [False] * 4 and found.where("page_id < 3 and text = ''").count() == 2
    assert hx.main_texts(odd).where("text <> ''").count() == 0 and hx.main_texts(pages.limit(0)).count() == 0


@pytest.mark.parametrize(
    "piece", ["<a ", "<a \"", "'\"<", "<div>", "<div>x", "<span>y ", "</b><i>", "<!-", "<a href='x\">", "<p class=\"a\" title='>'>t"]
)
def test_a_megabyte_of_broken_markup_takes_linear_time(piece):
    page = piece * (1_000_000 // len(piece))
    start = time.process_time()
    hb.blocks(page)
    assert time.process_time() - start < 30  # quadratic ways take many minutes


def test_quotes_and_ends_of_tags():
    read = lambda page: [b.text for b in hb.blocks(page)]
    assert read("<p title='a > b'>one</p><p title=\"x'>\">two</p>") == ["one", "two"]
    assert read('<p "x>one</p><p>two "quoted"</p>') == ["one", 'two "quoted"']
    assert read('<p title="x>one</p><p>two') == ["one", "two"]
    assert read("a < b <p>c<noscript>d</noscript></p><!-- e") == ["a < b", "cd"]
    assert read("one <p") == ["one <p"] and read("one<!-- <p>two</p>") == ["one"]
    assert hb.blocks("<div data-main='1'><p>in</p><div data-main='0'>out</div>again</div>after")[0].main
