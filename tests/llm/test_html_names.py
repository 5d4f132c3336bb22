"""Class names that only look like furniture, points against a walk to the root, and time on deep pages."""

import random
import time

import pytest

from landlens.llm import html_extract as H

TEXT = "A long enough sentence of the article, with a comma, that reads on for a while and says a thing or two."


@pytest.mark.parametrize("name", ["side-effects", "share-price", "tags-of-war", "ad-hoc", "cookie-recipe", "comment-on-policy", "response-times"])
@pytest.mark.parametrize("tag", ["section", "div"])
def test_text_of_the_article_stays_whatever_its_name(name, tag):
    page = f"<html><body><article><h1>Head</h1><p>{TEXT}</p><{tag} class='{name}'><p>Kept {TEXT}</p></{tag}></article></body></html>"
    assert H.main_text(page) == f"Head\n{TEXT}\nKept {TEXT}"


@pytest.mark.parametrize("name", ["comments", "comment-list", "user-comments", "reader-comments", "ad", "ad-slot", "ads top", "sidebar", "share-buttons", "social", "related-posts", "newsletter-signup", "cookie-notice", "tags", "replies", "navbar", "promo-box"])
@pytest.mark.parametrize("inside", [True, False])
def test_furniture_goes(name, inside):
    box = f"<div class='{name}'><p>Gone {TEXT}</p></div>"
    page = f"<html><body><article><h1>Head</h1><p>{TEXT}</p>{box if inside else ''}</article>{'' if inside else box}</body></html>"
    assert H.main_text(page) == f"Head\n{TEXT}"


def walked(nodes):
    """Each paragraph's points carried to every ancestor in turn."""
    score = {n: float(n.bonus) for n in nodes}
    for n in nodes:
        paragraph = n.name in ("p", "pre", "blockquote", "li", "dd", "td")
        texts = [x for x in n.items if isinstance(x, str)]
        if not (paragraph or (n.name in H.CONTAINERS and any(len(x.strip()) >= 25 for x in texts))) or n.n_text < 25:
            continue
        points = (1 + "".join(texts).count(",") + min(3.0, n.n_text / 100)) * (1 - n.link_density)
        up, level = (n.parent if paragraph else n), 0
        while up is not None:
            score[up] += points if up.name in H.SEMANTIC or level == 0 else points / 2 / 3 ** (level - 1)
            up, level = up.parent, level + 1
    return score


def test_points_equal_a_walk_to_the_root():
    rng = random.Random(2)
    for _ in range(60):
        page, stack = [], []
        for _ in range(80):
            if stack and rng.random() < 0.45:
                page.append(f"</{stack.pop()}>")
            else:
                stack.append(rng.choice(["div", "section", "article", "main", "p", "a", "blockquote", "ul", "li", "td"]))
                page.append(f"<{stack[-1]}>" + rng.choice(["", "short", TEXT, TEXT * 3]))
        nodes = H.in_order(H.parse("".join(page)))
        H.measure(nodes)
        want = walked(nodes)
        H.pass_points(nodes)
        assert all(n.score == pytest.approx(want[n], abs=1e-9) for n in nodes)


def test_deep_nesting_with_text_takes_linear_time():
    n = 100_000
    began = time.time()
    text = H.main_text(f"<div><p>{TEXT}</p>" * n + "</div>" * n)
    assert TEXT in text and time.time() - began < 30
    began = time.time()
    H.main_text("<div><a href='#'>one</a><a href='#'>two</a><a href='#'>three</a>" * 20_000)
    assert time.time() - began < 20
