"""Pages unlike the given ones: what holds the article, what hides, and broken markup."""

import time

import pytest

from gridlake.llm import html

LONG = " ".join(f"word{i}" for i in range(60))


@pytest.mark.parametrize("page,want", [
    (f"<body><article><p data-x=don't>First {LONG}.</p><p>Then it's {LONG}.</p></article></body>", f"First {LONG}.\nThen it's {LONG}."),
    (f"<body><form id=aspnet><p>{LONG}</p><p>More {LONG}</p></form></body>", f"{LONG}\nMore {LONG}"),
    ("<body><h1>Boats</h1><p>Seven boats came in.</p><p>All were red.</p></body>", "Boats\nSeven boats came in.\nAll were red."),
    (f"<article><p>{LONG}</p><form><p>Your name and your mail, please</p></form></article>", LONG),
    (f"<article><p>{LONG}</p><div class=adbox><p>Buy this now for less</p></div></article>", LONG),
    (f"<article><p>{LONG}</p><div class=feedback><p>Was this of any help to you?</p></div></article>", LONG),
    (f"<article><p>{LONG}</p><div class=reader-responses><p>I did not like it at all.</p></div></article>", LONG),
    (f"<article><p>{LONG}</p><p hidden>Nobody sees this line here.</p><p>{LONG} z</p></article>", f"{LONG}\n{LONG} z"),
    (f"<article><p>{LONG}</p><div style='color:red; display: none'><p>Nor this one.</p></div></article>", LONG),
    (f"<article><p class=hidden-gem title='hidden'>{LONG}</p></article>", LONG),
    (f"<article><p>{LONG} <a href=x title=\">\">5 > 4</a> end</p></article>", f"{LONG} 5 > 4 end"),
    (f"<article><p>{LONG}</p><p>1 < 2 and <3</p></article>", f"{LONG}\n1 < 2 and <3"),
    (f"<article><p a=\"never closed>{LONG}</p></article>", LONG),
    (f"<article><p>{LONG}</p></article><p", LONG),
    (f"<article><p title=\"a hidden thing\" alt='x display: none'>{LONG}</p></article>", LONG),
    ("", ""), ("<", "<"), ("<p", ""), ("</", "</"),
])
def test_pages(page, want):
    assert html.main_text(page) == want


@pytest.mark.parametrize("unit", ['<a "', "<a x='", "<div>", "</p>", "<div class=ad>", "<main>", "<!--", "<a x=\">\" ", "<", "&", "<b ", "=", "<p a=b", "<![CDATA["])
def test_time_in_proportion_to_the_page(unit):
    began = time.time()
    html.main_text("<div>" * 20_000 + unit * (400_000 // len(unit)) + "</q></x>" * 20_000)
    assert time.time() - began < 10
