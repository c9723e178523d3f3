"""Names of elements, hidden parts, titles and legal lines, and generated pages whose text is known."""

import random
import time

import pytest

from contractscope.llm import pages

LONG = "Long text of the page, with words. " * 9


@pytest.mark.parametrize("name", ["market-share", "related-work", "social-policy", "noticeable", "bannerman", "adverse", "menuhin", "cookie-recipes", "share-of-voice"])
def test_names_that_tell_what_a_text_is_about(name):
    assert not pages.names_chrome(name)
    assert pages.main_text(f"<article><h1>T</h1><div class='{name}'><p>{LONG}</p></div></article>") == "T\n\n" + LONG.strip()


@pytest.mark.parametrize("name", ["comment-list", "comments-area", "siteFooter", "ad_slot_2", "mpu", "share-buttons", "related-posts", "widget-area", "x cookie-notice y", "SocialLinks"])
def test_names_of_what_is_no_article(name):
    assert pages.names_chrome(name)
    assert pages.main_text(f"<article><h1>T</h1><p>{LONG}</p><div class='{name}'><p>{LONG}</p></div></article>") == "T\n\n" + LONG.strip()


def test_title_in_a_named_header_stays():
    assert pages.main_text(f"<div class='page-header'><p>Site</p><h1>Real title</h1><p>Tag line</p></div><p>{LONG}</p><p>{LONG}</p>") == "\n\n".join(["Real title", LONG.strip(), LONG.strip()])
    assert pages.main_text(f"<article><div class='article-header'><h1>Title</h1><p>By A.</p></div><p>{LONG}</p></article>").startswith("Title\n\nBy A.")


def test_hidden_legal_and_data_named_parts_go():
    page = f"<p>{LONG}</p><div style='color:red; display: none'>{LONG}X</div><div aria-hidden=true>{LONG}Y</div><div hidden>{LONG}V</div><div data-component='comment-list'>{LONG}Z</div><p>{LONG}</p><div class='bottom'>Copyright 2020 Site</div>"
    assert pages.main_text(page) == LONG.strip() + "\n\n" + LONG.strip()


def test_many_unclosed_comments_take_no_time():
    began = time.perf_counter()
    assert pages.main_text(f"<p>{LONG}</p><!-- a --><p>{LONG}</p>" + "<!--" * 50_000) == LONG.strip() + "\n\n" + LONG.strip()
    assert time.perf_counter() - began < 1
    assert pages.main_text(f"<p>{LONG}</p><!-- open <p>no</p>") == LONG.strip()


@pytest.mark.parametrize("seed", range(6))
def test_generated_pages(seed):
    """A page of known paragraphs between menus, adverts, comments and scripts, with and without an article element."""
    rng = random.Random(seed)
    words = lambda n: " ".join(rng.choice(["river", "market", "share", "policy", "comment", "the", "of", "&amp;"]) for _ in range(n))
    plain = lambda t: t.replace("&amp;", "&")
    blocks = [words(rng.randint(25, 120)) for _ in range(rng.randint(3, 8))]
    junk = lambda: rng.choice([f"<div class='ad-banner'>{words(30)}</div>", f"<aside>{words(40)}</aside>", f"<script>var x='{words(9)}';</script>", f"<div id='newsletter'><form>{words(5)}<input></form></div>", f"<ul class='social-links'><li><a href=x>{words(1)}</a></ul>"])
    body = "".join(f"<p>{b}</p>{junk() if rng.random() < 0.5 else ''}" for b in blocks)
    body = f"<article>{body}</article>" if seed % 2 else f"<div class='content'>{body}</div>"
    page = f"<html><head><title>{words(4)}</title><style>p{{}}</style></head><body><nav><ul>{''.join(f'<li><a href=x>{words(1)}</a></li>' for _ in range(6))}</ul></nav>{body}<div class='comments'><p>{words(60)}</p></div><footer>&copy; {words(6)}</footer></body></html>"
    assert pages.main_text(page) == "\n\n".join(plain(b) for b in blocks)
