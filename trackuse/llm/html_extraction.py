"""The main text of web pages: a linear-chain conditional random field over their text blocks.

It is trained on pages that say themselves where their article is, in their own layout and
in others: the same page with other containers and headings, and with side bars, notices, forms and
reader comments made of sentences of that page, so that the wording alone tells nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from trackuse.llm.html_blocks import FEATURE_BITS, blocks

MAX_PAGES = 300
ROUNDS = 12
# Names that layouts give to the article and to what is not part of it.
MAIN_NAMES = "content post entry story main-content article-body post-content text page-content body-text".split()
OTHER = {
    "menu": "menu navbar navigation breadcrumbs nav-list toc pagination",
    "header": "header masthead site-header top-bar banner",
    "footer": "footer site-footer copyright bottom colophon",
    "side": "sidebar widget related recommended side-column most-read tags share social author-box",
    "notice": "notice cookie-banner alert newsletter popup consent gdpr subscribe disclaimer",
    "ad": "ad ads advert advertisement sponsor sponsored promo promoted",
    "form": "form search login signup contact-form comment-form",
    "comment": "comments comment comment-list discussion replies reply responses reader-comments disqus",
}


def layouts(page: str, seed: int) -> list[str]:
    """The page with its article marked, and three other layouts; nothing if it has no single article."""
    body = re.search(r"(?is)<article\b[^>]*>(.*?)</article\s*>", page)
    if not body or len(re.findall(r"(?i)<article\b", page)) != 1:
        return []
    pick = np.random.default_rng(seed)
    words = re.findall(r"[^\s<>&]+", re.sub(r"(?s)<[^>]*>", " ", body[1]))[:400] or ["text"]

    def some(most: int) -> str:
        start = int(pick.integers(0, len(words)))
        return " ".join(words[start : start + int(pick.integers(1, most))])

    def other(kind: str) -> str:
        names = OTHER[kind].split()
        name = names[int(pick.integers(0, len(names)))]
        rows = "".join(f"<p>{some(40)}</p>" for _ in range(int(pick.integers(1, 4))))
        links = "".join(f"<li><a href='#'>{some(3)}</a></li>" for _ in range(int(pick.integers(2, 7))))
        tags = {
            "menu": [f"<nav>{links}</nav>", f"<div class='{name}'><ul>{links}</ul></div>"],
            "header": [f"<header><p>{some(8)}</p>{links}</header>", f"<div id='{name}'><h1>{some(6)}</h1></div>"],
            "footer": [f"<footer>{rows}</footer>", f"<div class='{name}'>&copy; {some(9)}</div>"],
            "side": [f"<aside>{rows}<ul>{links}</ul></aside>", f"<div class='{name}'><h3>{some(4)}</h3>{rows}</div>", f"<section class='{name}'><ul>{links}</ul></section>"],
            "notice": [f"<div class='{name}'>{rows}</div>", f"<div role='alert' id='{name}'>{some(20)}</div>", f"<dialog>{rows}</dialog>"],
            "ad": [f"<div class='{name}'>{some(15)}</div>", f"<aside class='{name}'><a href='#'>{some(9)}</a></aside>", f"<p class='{name}'>{some(12)}</p>"],
            "form": [f"<form><label>{some(3)}</label><input><button>{some(2)}</button><select><option>{some(2)}</option></select></form>", f"<form class='{name}'><p>{some(12)}</p><textarea>{some(3)}</textarea></form>"],
            "comment": [f"<section class='{name}'><h2>{some(3)}</h2>{rows}</section>", f"<div id='{name}'><div class='comment'>{rows}</div></div>", f"<ol class='{name}'><li>{some(40)}</li><li><p>{some(30)}</p></li></ol>"],
        }[kind]
        return f"<div data-main=0>{tags[int(pick.integers(0, len(tags)))]}</div>"

    def varied(part: str, form: int) -> str:
        """A part of the article under a heading, or as a quotation, a list or a figure."""
        return [f"<h2>{some(6)}</h2>{part}", f"<blockquote>{part}</blockquote>", f"<ul><li>{some(9)}</li><li>{some(5)}</li></ul>{part}", f"<figure><figcaption>{some(8)}</figcaption></figure>{part}"][form]

    marked = page[: body.start()] + f"<article><div data-main=1>{body[1]}</div></article>" + page[body.end() :]
    found = [re.sub("(?i)<body", "<body data-main=0", marked)]
    kinds = list(OTHER)
    parts = re.split(r"(?i)(?=<p\b)", body[1])
    for _ in range(3):
        forms = [part if k >= 0.4 else varied(part, int(k * 10)) for part, k in zip(parts, pick.random(len(parts)), strict=True)]
        article = "".join(forms) if pick.random() < 0.5 else re.sub(r"(?i)(</?)h1\b", r"\1h2", "".join(forms))
        name = MAIN_NAMES[int(pick.integers(0, len(MAIN_NAMES)))]
        before = "".join(other(kinds[int(k)]) for k in pick.integers(0, len(kinds), 3))
        within = "".join(other(k) for k in ("side", "notice", "ad", "form", "comment", "footer", "header") if pick.random() < 0.4)
        after = "".join(other(kinds[int(k)]) for k in pick.integers(0, len(kinds), 3))
        place = article.rfind("<p>", 0, int(pick.integers(0, len(article) + 1))) if pick.random() < 0.5 else -1
        inner = article + within if place < 0 else article[:place] + within + article[place:]
        outer = [("<article>", "</article>"), ("<main>", "</main>"), (f"<div class='{name}'>", "</div>"), (f"<section id='{name}'>", "</section>")]
        start, end = outer[int(pick.integers(0, len(outer)))]
        found.append(f"<html><body data-main=0>{before}{start}<div data-main=1>{inner}</div>{end}{after}</body></html>")
    return found


class Crf:
    """Two labels; ``weights[label, bucket]`` and ``steps[from, to]``."""

    def __init__(self, weights: np.ndarray, steps: np.ndarray) -> None:
        self.weights, self.steps = weights, steps

    def emissions(self, features: list[list[int]]) -> np.ndarray:
        return np.array([self.weights[:, f].sum(axis=1) for f in features])

    def decode(self, features: list[list[int]]) -> list[int]:
        """The best sequence of labels by Viterbi; of equal ones the one with label 0 first."""
        if not features:
            return []
        scores = self.emissions(features).tolist()
        (aa, ab), (ba, bb) = self.steps.tolist()
        a, b = scores[0]
        back = []
        for x, y in scores[1:]:
            from_a, from_b = a + ab < b + bb, a + aa < b + ba
            back.append((int(from_b), int(from_a)))
            a, b = max(a + aa, b + ba) + x, max(a + ab, b + bb) + y
        label = int(b > a)
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]

    def marginals(self, features: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of labels and of pairs of neighbouring labels, by forward and backward sums."""
        scores = self.emissions(features)
        n = len(scores)
        ahead, behind = scores.copy(), np.zeros((n, 2))
        for i in range(1, n):
            ahead[i] += np.logaddexp.reduce(ahead[i - 1][:, None] + self.steps, axis=0)
        for i in range(n - 2, -1, -1):
            behind[i] = np.logaddexp.reduce(self.steps + (scores[i + 1] + behind[i + 1])[None, :], axis=1)
        total = np.logaddexp.reduce(ahead[-1])
        pairs = ahead[:-1, :, None] + self.steps[None] + (scores[1:] + behind[1:])[:, None, :]
        return np.exp(ahead + behind - total), np.exp(pairs - total)


def fit(pages: list[tuple[list[list[int]], list[int]]], rounds: int = ROUNDS, rate: float = 0.3, decay: float = 1e-4) -> Crf:
    """Maximum likelihood with adaptive steps, one page at a time in the given order."""
    crf = Crf(np.zeros((2, 1 << FEATURE_BITS)), np.zeros((2, 2)))
    seen, seen_steps = np.full_like(crf.weights, 1e-6), np.full((2, 2), 1e-6)
    for _ in range(rounds):
        for features, labels in pages:
            one, two = crf.marginals(features)
            one[np.arange(len(labels)), labels] -= 1
            sizes = [len(f) for f in features]
            flat = np.concatenate([np.asarray(f) for f in features])
            used, inverse = np.unique(flat, return_inverse=True)
            each = np.repeat(one, sizes, axis=0)
            for label in (0, 1):
                step = np.bincount(inverse, each[:, label]) + decay * crf.weights[label, used]
                seen[label, used] += step**2
                crf.weights[label, used] -= rate * step / np.sqrt(seen[label, used])
            steps = two.sum(axis=0) + decay * crf.steps
            np.subtract.at(steps, (labels[:-1], labels[1:]), 1)
            seen_steps += steps**2
            crf.steps -= rate * steps / np.sqrt(seen_steps)
    return crf


def _labelled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for seed, page in zip(batch["seed"], batch["html"], strict=True):
            for k, layout in enumerate(layouts(page, abs(int(seed)))):
                found = blocks(layout)[:2_000]
                out.append((int(seed), k, [b.features for b in found], [int(b.main) for b in found]))
        yield pd.DataFrame(out, columns=["seed", "k", "features", "labels"])


def train(pages: DataFrame, html_col: str = "html", max_pages: int = MAX_PAGES) -> Crf:
    """Fit on at most ``max_pages`` pages with one article element, chosen by the hash of the page.

    Each gives four layouts; of the training pages, not of others, blocks after the
    2,000th are left out. Without such a page nothing is extracted.
    """
    column = F.col(html_col)
    has_article = F.lower(column).contains("<article") & (F.length(column) < 1_000_000)
    chosen = pages.where(has_article).select(F.xxhash64(column).alias("seed"), column.alias("html"))
    keys = chosen.select("seed").distinct().orderBy("seed").limit(max_pages)
    rows = chosen.join(F.broadcast(keys), "seed").groupBy("seed").agg(F.min("html").alias("html"))  # bounded by max_pages
    sample = rows.mapInPandas(_labelled, "seed long, k int, features array<array<int>>, labels array<int>").toArrow().to_pandas()
    sample = sample[sample["labels"].map(len) > 0].sort_values(["k", "seed"])
    return fit([([list(f) for f in fs], list(ls)) for fs, ls in zip(sample["features"], sample["labels"], strict=True)])


def text_of(crf: Crf):
    """A column function: the main text of pages, blocks joined by an empty line."""

    @F.pandas_udf(StringType())
    def text(pages: pd.Series) -> pd.Series:
        out = []
        for page in pages:
            found = blocks(page)
            labels = crf.decode([b.features for b in found])
            out.append("\n\n".join(b.text for b, label in zip(found, labels, strict=True) if label))
        return pd.Series(out, dtype="object")

    return text


def main_texts(pages: DataFrame) -> DataFrame:
    """``page_id, url, text`` of every row; a null or empty page has an empty text, repeated rows stay."""
    return pages.select("page_id", "url", text_of(train(pages))("html").alias("text"))
