"""Names of wrappers and articles that speak of something else than themselves."""

from __future__ import annotations

import pytest

from tessera.llm.htmltext import main_text, read_page


def text(source):
    return main_text(read_page(source)[0])


@pytest.mark.parametrize("name", ["has-sidebar", "no-sidebar", "page-with-nav", "hasSidebar comments-open", "related-wrapper"])
def test_wrapper_of_the_article(name):
    assert text(f"<body><nav>N</nav><p>Tagline</p><div class='{name}'><article><p>Said</p><div class='ad-slot'>Buy</div></article></div></body>") == "Said"
    if name != "related-wrapper":
        assert text(f"<body><nav>N</nav><div class='{name}'><p>Said</p><div class='left-sidebar'>Side</div></div></body>") == "Said"


@pytest.mark.parametrize("name", ["post category-social", "comments-open", "comments"])
def test_article_itself(name):
    assert text(f"<article class='{name}'><p>Said</p></article>") == "Said" == text(f"<main id='{name}'><p>Said</p></main>")


def test_nothing_left_falls_back():
    assert text("<body><nav>N</nav><div class='widget'><p>Said</p><form>F</form></div></body>") == "Said"
    assert text("<body><nav>N</nav><div class='widget'>W<article>Said</article></div></body>") == "Said"
    assert text("<body><nav>N</nav><footer>F</footer></body>") == ""
