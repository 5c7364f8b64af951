import html
import re
import time

from graphloom.llm.html import extract, main_text

PROSE = "This is a sentence of the story, long enough to count, with commas, and more words than a menu has."


def test_article_page():
    page = f"""<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{{}}</style><script>var a = "</p><p>no</p>";</script></head>
    <body class="has-sidebar"><header><h1>Site name</h1><nav><a href=/>Home</a></nav></header><div class="cookie-notice">We use cookies, really, a lot of them, accept please.</div>
    <div id="wrap"><div class="sidebar"><p>{PROSE}</p></div><article><header><h1>Head &lt;1&gt;</h1></header><p><b>One&nbsp;&amp;  two
    three<br><p>{PROSE}</p><div class="ad">Buy, buy, buy this thing now, it is cheap.</div><p>Short.</p><form><input value=x>Sign up, now, here.</form>
    <blockquote>Quoted &eacute;&#233;&#x1F600;</blockquote><ul><li>a<li>b</ul>
    <section class="comments"><p>{PROSE} {PROSE}</p></section></article></div><aside>{PROSE}</aside><footer>&copy; me, you, them</footer></body></html>"""
    assert main_text(page) == "\n".join(["Head <1>", "One & two three", PROSE, "Short.", "Quoted éé😀", "a", "b"])


def test_scoring_without_semantic_elements():
    menu = "".join(f'<li><a href="/{i}">Menu entry number {i}, with text, and commas</a></li>' for i in range(20))
    page = f"<html><body><div><ul>{menu}</ul></div><div><div><h1>Title</h1><p>{PROSE}</p><p>{PROSE}</p><p>ok</p></div><div><p>{PROSE}</p></div></div></body></html>"
    assert main_text(page) == "\n".join(["Title", PROSE, PROSE, "ok", PROSE])


def test_classes_inside_the_article():
    inner = f'<div class="social-history"><p>{PROSE}</p></div><p class="related">{PROSE}</p><div class="related"><a href=x>Another story</a></div>'
    assert main_text(f"<body><article><p>{PROSE}</p>{inner}</article></body>") == "\n".join([PROSE] * 3)
    page = f"<body><header><h1>Site</h1></header><div><header><h1>Title</h1></header><p>{PROSE}</p><p>{PROSE}</p></div></body>"
    assert main_text(page) == "\n".join(["Title", PROSE, PROSE])


def test_scores_decide_inside_main():
    menu = "".join(f'<li><a href="/{i}">Another story number {i}, with a long title, and commas</a></li>' for i in range(9))
    page = f"<body><main><ul>{menu}</ul><section><h2>One</h2><p>{PROSE}</p></section><section><h2>Two</h2><p>Short.</p><ul><li>a<li>b</ul></section></main></body>"
    assert main_text(page) == "\n".join(["One", PROSE, "Two", "Short.", "a", "b"])
    assert main_text(f"<body><ul>{menu}</ul><div><p>Short.</p><p>Text.</p></div></body>") == "Short.\nText."
    parts = f"<body><div id=a><ul>{menu}</ul></div><div><div><p>{PROSE}</p><p>{PROSE}</p></div><ul><li>one</li><li>two</li></ul></div></body>"
    assert main_text(parts) == "\n".join([PROSE, PROSE, "one", "two"])


def test_sections_without_article_or_main():
    section = f"<div class=c><div><h2>S</h2><p>{PROSE}</p></div></div>"
    assert main_text(f"<body>{section * 6}</body>") == "\n".join(["S", PROSE] * 6)
    long = f"<p>{PROSE}</p>" * 10
    assert main_text(f"<body><div class=body>{long}</div><div class=body><p>Short closing words.</p></div></body>").endswith(f"{PROSE}\nShort closing words.")
    assert main_text(f"<body><div class=post><div class=p1><p>{PROSE}</p><p>{PROSE}</p></div><div class=p2>Short tail, end.</div></div></body>") == "\n".join([PROSE, PROSE, "Short tail, end."])
    assert main_text(f"<body><h1>Title</h1><div><div><p>{PROSE}</p><p>{PROSE}</p></div></div></body>") == "\n".join(["Title", PROSE, PROSE])
    menu = "".join(f'<li><a href="/{i}">Another story number {i}, with a long title, and commas</a></li>' for i in range(9))
    page = f"<body><div id=a><ul>{menu}</ul></div><div class=w><div class=w>{section * 3}</div><div class=ad>{PROSE}</div></div><div id=b><h3>More</h3><ul>{menu}</ul></div></body>"
    assert main_text(page) == "\n".join(["S", PROSE] * 3)


def test_names_that_only_sound_like_layout():
    for part in ("<section id=promotion>{}</section>", "<div class=login-guide>{}</div>", "<p class=notice-of-motion>{}</p>", "<p class=login>{}</p>"):
        assert main_text(f"<body><article><p>{PROSE}</p>{part.format(PROSE)}</article></body>") == f"{PROSE}\n{PROSE}"
    for part in ("<div class=ad-box>{}</div>", "<div class='cookie-notice'>{}</div>", "<p class=ad>{}</p>", "<div class=newsletter-signup>{}</div>", "<div id=sidebar>{}</div>"):
        assert main_text(f"<body><article><p>{PROSE}</p>{part.format(PROSE)}</article></body>") == PROSE


def test_lists_of_sources_and_buttons_in_sentences():
    sources = "".join(f'<li><a href="/{i}">Author {i}, a work, a year</a></li>' for i in range(5))
    assert main_text(f"<body><article><p>{PROSE}</p><h2>References</h2><ol>{sources}</ol></article></body>").split("\n")[1:] == ["References"] + [f"Author {i}, a work, a year" for i in range(5)]
    assert main_text(f"<body><article><section><h2>References</h2><ol>{sources}</ol></section><p>{PROSE}</p></article></body>").count("Author") == 5
    assert main_text(f"<body><article><p>{PROSE} press <button type=x>OK</button> now <svg><title>no</title><path d=1 /></svg>too</p></article></body>") == f"{PROSE} press now too"
    assert main_text(f"<body><article><p>x <button>never closed<p>{PROSE}</p></article></body>").startswith("x")


def test_generated_pages_without_semantic_elements(spark):
    """The same pages with their article cut into unnamed sections, beside the menu and the advert."""
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()
    wrong = 0
    for (page,) in rows:
        want = main_text(page)
        wrong += main_text(re.sub(r"<article>(.*?)</article>", r"<div><div class=part>\1</div></div>", page, flags=re.S)) != want
        halves = re.sub(r"<article>(.*?</p>)(.*?)</article>", r"<div><div class=part>\1</div><div class=part>\2</div></div>", page, flags=re.S)
        wrong += main_text(halves) != want
    assert wrong == 0, wrong


def test_long_pages_take_linear_time():
    began = time.process_time()
    for unit in ("<ul>", "<a ", "<li>", "<p><ul>", "<span class=ad>", "</p>", "<table><td>", "<!-", "<p><button>", "<article>", "<header><h1>", "</span>", "<dd>"):
        main_text(unit * (400_000 // len(unit)) + PROSE)
    assert time.process_time() - began < 60
    assert main_text(f"<p>{PROSE}</p> x <!-- never > closed <p>y") == f"{PROSE}\nx"
    assert main_text(f"<p>{PROSE}</p> x <a never closed") == f"{PROSE}\nx <a never closed"
    assert main_text("a <!-- b") == "a"


def test_defined_cases():
    assert main_text(None) == main_text("") == main_text("<html><body><nav>x</nav></body></html>") == ""
    assert main_text("just  text\n\nhere") == "just text here"
    assert main_text("<p>a<p>b</div></p>c<!-- x --> d < e <b>f") == "a\nb\nc d < e f"
    assert main_text('<p title="a>b">x</p><p title="oops>y</p>')  # an odd quote
    assert main_text("<div>" * 3000 + "deep") == "deep"
    assert main_text("<script>never closed <p>x") == ""


def test_table_rows_and_columns(spark):
    d = spark.createDataFrame([(1, "u", f"<p>{PROSE}</p>", "z"), (1, "u", f"<p>{PROSE}</p>", "z"), (2, None, None, "z"), (None, "v", "", "z")], "page_id long, url string, html string, text string")
    got = sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in extract(d).collect())
    assert got == [("1", PROSE, len(PROSE)), ("1", PROSE, len(PROSE)), ("2", "", 0), ("None", "", 0)]
    assert extract(d.where("false")).collect() == []


def test_generated_pages(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()
    for (page,) in rows:
        body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        want = [" ".join(html.unescape(x).split()) for x in re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", body.replace("<br>", " ")))]
        assert main_text(page) == "\n".join(x for x in want if x)
