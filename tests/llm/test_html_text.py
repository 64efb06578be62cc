import random

import pytest

from tidewell.llm import html_text as ht

LONG = "This is the story of a town by the sea and of the people who were there when it was built, " * 3
POLISH = "Miasteczko nad morzem powstało dawno temu, gdy rybacy przybyli tutaj ze swoimi rodzinami oraz łodziami. " * 3
POLISH = POLISH.strip()
CHINESE = "这个小镇位于海边，很久以前由渔民和他们的家人建立，后来成为一个繁荣的港口。" * 5
MIDDLE = (LONG + LONG)[:194].strip() + '.'
CASES = {
    "article without its surroundings": (f"<html><head><title>T</title><style>p{{}}</style></head><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><div class=\"ad\">Buy this now.</div><article><h1>A &amp; B</h1><p>{LONG}</p><p>End.</p></article><footer>&copy; all</footer>", f"A & B\n{LONG.strip()}\nEnd."),
    "no article element": (f"<body><div><a href=x>Home</a> <a href=y>News</a></div><div><p>{LONG}</p><p>So it was.</p><p>{LONG}</p></div><div class='sidebar'>{LONG}</div>", f"{LONG.strip()}\nSo it was.\n{LONG.strip()}"),
    "comments, forms and notices in the article": (f"<article><p>{LONG}</p><div id='comments'><p>{LONG}</p></div><form><p>{LONG}</p></form><div role='alert'>Hey you there</div></article>", LONG.strip()),
    "script with markup in a string": (f"<article><script>var t='</p>';</script><p>{LONG}</p></article>", LONG.strip()),
    "unclosed tags": (f"<article><p><b>Short one.<br><p>{LONG}", f"Short one.\n{LONG.strip()}"),
    "references and white space": ("<article><p>a &lt;b&gt;\n\n  c&nbsp;d &eacute; &#233; x&amp y</p></article>", "a <b> c d é é x& y"),
    "unclosed comment": (f"<article><p>{LONG}</p><!-- <p>{LONG}", LONG.strip()),
    "less-than sign in a text": ("<article><p>it is so that 1 < 2 and 3 > 2 here</p></article>", "it is so that 1 < 2 and 3 > 2 here"),
    "hidden": (f"<article><p>{LONG}</p><p style='display:none'>{LONG}</p><div hidden>{LONG}</div></article>", LONG.strip()),
    "no end of the head": (f"<html><head><title>T</title><meta charset=x><body><article><p>{LONG}</p></article>", LONG.strip()),
    "a button that does not end": (f"<article><button>Menu<p>{LONG}</p><button>x</button><p>End of it all.</p></article>", f"{LONG.strip()}\nEnd of it all."),
    "a picture that does not end": (f"<article><svg><g>x<svg></svg><p>{LONG}</p></article>", LONG.strip()),
    "pictures within pictures": (f"<article><svg>a<svg>b</svg>c</svg><p>{LONG}</p></article>", LONG.strip()),
    "Polish": (f"<div><a href=x>Start</a> <a href=y>Wpisy</a></div><div><p>{POLISH}</p><p>I tyle.</p><p>{POLISH}</p></div>", f"{POLISH}\nI tyle.\n{POLISH}"),
    "Chinese": (f"<div><a href=x>首页</a></div><div><p>{CHINESE}</p><p>{CHINESE}</p></div>", f"{CHINESE}\n{CHINESE}"),
    "names of an article": (f'<article class="post comments-open has-share-buttons"><p>{LONG}</p></article>', LONG.strip()),
    "names around a main element": (f'<div class="content-sidebar-wrap"><main><p>{LONG}</p></main><div class="sidebar"><p>{LONG}</p></div></div>', LONG.strip()),
    "names around an article": (f'<div id="page-with-sidebar"><article><p>{LONG}</p></article></div>', LONG.strip()),
    "a form around everything": (f'<form id="aspnetForm"><input><main><p>{LONG}</p><form><p>{LONG}</p></form></main></form>', LONG.strip()),
    "hidden in a title or a class": (f'<article title="The hidden truth" class="prose hidden md:block"><p>{LONG}</p></article>', LONG.strip()),
    "short paragraphs": ("<div>" + "".join(f"<p>{t}</p>" for t in (MIDDLE, MIDDLE, MIDDLE, "It was so.")) + "</div>", "\n".join([MIDDLE] * 3 + ["It was so."])),
    "a main element of a heading": (f"<main><h1>Of the town</h1></main><div><p>{LONG}</p></div>", f"Of the town\n{LONG.strip()}"),
    "spans in a hidden span": (f"<article><p>{LONG}</p><p><span style='display: none'>a <span>b</span> not to be seen by anyone here at all</span></p></article>", LONG.strip()),
    "comments that are articles": (f"<article><p>{LONG}</p></article><ol class='comment-list'><li><article><p>{LONG}</p></article></li></ol><article class='comment-body'><p>{LONG}</p></article>", LONG.strip()),
    "share buttons in the article": (f"<article><p>{LONG}</p><div class='post-share-buttons'><p>Share this on all of the networks</p></div><p>So it ended.</p></article>", f"{LONG.strip()}\nSo it ended."),
    "prose under a doubtful name": (f"<article><div class='story-notice-text'><p>{LONG}</p></div></article>", LONG.strip()),
    "only names speak against it": (f"<div class='widget'><article><p>{LONG}</p></article></div>", LONG.strip()),
    "shown though it has the attribute": (f"<article hidden=false aria-hidden='false'><p>{LONG}</p></article>", LONG.strip()),
    "nothing": ("", ""),
    "only a menu": ("<nav><a href=x>x</a></nav>", ""),
}


@pytest.mark.parametrize("name", CASES)
def test_pages(name):
    page, text = CASES[name]
    assert ht.main_text(page) == text


WRAPPERS = ("<div class='{} content'>", "<div id='{}'>", "<section class='page {}'>", "<div><div class='{}'>", "<form id='{}'>")


def test_articles_are_found_under_any_wrapper():
    """Pages of random parts in wrappers with random names, of which many hold a hint among other words: whole articles, and nothing else."""
    rng, whole = random.Random(3), 0
    for _ in range(300):
        words = [rng.choice(["content", "layout", "x9", "with", "col"]), rng.choice(sorted(ht.HINTS)), rng.choice(["of", "has", "post", "theme"])]
        rng.shuffle(words)
        wrapper = rng.choice(WRAPPERS).format("-".join(words))
        tag = rng.choice(["article", "main", "div role=main", "article class='entry " + "-".join(words) + "'"])
        told = [LONG.strip(), "A short one.", MIDDLE, rng.choice(["It was so.", LONG.strip()])]
        rng.shuffle(told)
        page = f"<body><nav><a href=/>Home</a></nav>{wrapper}<{tag}>{''.join(f'<p>{t}</p>' for t in told)}</{tag.split()[0]}><div class='comments'><p>{LONG}</p></div></div></div></section></form><footer>(c) the town</footer>"
        whole += ht.main_text(page) == "\n".join(told)
    assert whole == 300


def test_long_pages_take_linear_time():
    assert ht.main_text("<p " * 30_000) == ""
    assert len(ht.main_text("<article>" + "<p>" + "word of the day " * 200_000)) > 3_000_000
    assert ht.main_text("<div>" * 50_000 + "x") == ""


def test_rows(spark):
    rows = [(1, "u", CASES["unclosed tags"][0], 5), (2, None, None, 6), (None, "v", "", 7), (1, "u", CASES["unclosed tags"][0], 5)]
    found = ht.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text long"))
    assert found.count() == 4 and [r["n_chars"] for r in found.where("page_id = 2").collect()] == [0]
    assert ht.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
