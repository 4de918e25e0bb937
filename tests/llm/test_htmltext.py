from tidemark.llm import htmltext as h


def _one(page):
    model = h.default_model()
    return h.extract(page, model, h.Paths(model))


def test_labelled_pages_not_trained_on():
    model = h.default_model()
    paths, wrong, total = h.Paths(model), 0, 0
    for seed in range(10_000, 10_150):
        page, labels = h.labelled_page(seed)
        found = h.blocks(page, paths)
        assert len(found) == len(labels)
        got = model.decode([b[1] + model.of(h.text_features(b, k, len(found))) for k, b in enumerate(found)])
        wrong, total = wrong + sum(a != b for a, b in zip(got, labels)), total + len(labels)
    assert wrong / total < 0.02


def test_viterbi_equals_all_labellings():
    from itertools import product

    model = h.default_model()
    for scores in ([0.3], [1.0, -2.0, 0.5], [-0.4, 0.9, 0.8, -3.0, 2.0, 0.1]):
        def value(labels, scores=scores):
            return labels[0] * model.first + sum(s for s, x in zip(scores, labels) if x) + sum(model.pairs[a][b] for a, b in zip(labels, labels[1:]))

        assert abs(value(model.decode(scores)) - max(map(value, product((0, 1), repeat=len(scores))))) < 1e-9


PAGE = """<!doctype html><html><head><title>T</title><script>var a="<p>no</p>";</script></head><body>
<header><p>Site name here</p></header><nav><ul><li><a href="/">Home</a><li><a href="/b">B</a></ul></nav>
<div class="cookie-notice"><p>We use cookies on this site.</p><button>Accept</button></div>
<article><h1>A   title &amp; more</h1><!-- <p>hidden</p> --><p>First&nbsp;paragraph, with <b>bold</b> and<br>a break &lt;here&gt; of some length.
<p>Second one &eacute;t&eacute; goes on &#8212; for a while, too.</p><div class="ad">Buy things today</div><p>Third paragraph ends the text of it.</p></article>
<section class="comments"><h2>Comments</h2><div class="comment"><p>I liked this text very much, thanks for it.</p></div></section>
<aside>Related: other texts</aside><form><label>Mail</label><input name=m></form><footer>&copy; 2020 Someone</footer></body></html>"""


def test_page():
    assert _one(PAGE) == "A title & more\n\nFirst paragraph, with bold and a break <here> of some length.\n\nSecond one été goes on — for a while, too.\n\nThird paragraph ends the text of it."


def test_broken_markup_never_raises():
    for page in ["", "<", "<p", "</p></div>", "<!-- open", "<script>x", "<div " * 3000, "<p>" * 3000 + "x", "text only, without any tag at all", "<a href='x>unclosed", "&#x110000; &bogus; &#0;", "<![CDATA[ x ]]>", "<table><tr><td>a<td>b", "\x00<b>\x01"]:
        assert isinstance(_one(page), str)


def test_rows(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", ""), (3, "w", "<article>" + "<p>Words of a sentence that is long enough.</p>" * 5000 + "</article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("value", h.F.lit(1)).withColumn("text", h.F.lit("clash"))
    got = h.extract_text(pages).collect()
    assert sorted(len(r.text) for r in got)[:2] == [0, 0] and len(got) == 5
    assert next(r.text for r in got if r.page_id == 3).count("\n\n") == 4999
    assert len({r.text for r in got if r.page_id == 1}) == 1
    assert h.extract_text(pages.limit(0)).count() == 0


def test_media_in_an_article():
    """Self-closing and unclosed media lose no text behind them; closed ones only their own."""
    before = "<p>Second one &eacute;t&eacute;"
    whole = _one(PAGE)
    assert PAGE.count(before) == 1
    for name in ("iframe", "object", "canvas", "audio", "video", "svg"):
        for media in (f"<{name} src=x />", f"<{name} src='a>b'>", f"<{name}>", f"<{name.upper()} src=x>fallback</{name}>", f"<{name}><{name}>in</{name}>fallback</{name}>"):
            assert _one(PAGE.replace(before, media + before)) == whole, media
            late = f"<{name} src=y>fallback</{name}>"  # unrelated, and closed
            assert _one(PAGE.replace(before, media + before).replace("<p>Third", late + "<p>Third")) == whole, media


def test_formulas_are_text():
    formula = "<math><mrow><mi>a</mi><mo>+</mo><mi>b</mi></mrow></math>"
    assert _one(PAGE.replace("Second one", f"Second {formula} one")) == _one(PAGE).replace("Second one", "Second a+b one")


HAND = [  # labelled by hand, in layouts that the generator doesn't make
    ("<body><div><h1>Tide tables</h1><p>The harbour office prints new tables every spring, and the pilots keep the old ones.</p><p>Nobody throws them away, since the margins are full of notes.</p></div><div><h3>Comments</h3><div><div>Ana</div><p>My father kept forty years of them in a drawer.</p></div><div><div>Ole</div><p>Ours burned with the boathouse, a great pity.</p></div></div></body>",
     "Tide tables\n\nThe harbour office prints new tables every spring, and the pilots keep the old ones.\n\nNobody throws them away, since the margins are full of notes."),
    ("<html><body><main><article><h1>Bread</h1><p>Mix flour, water and salt, and leave the dough alone for a night.</p><h2>Baking</h2><p>The oven should be as hot as it gets, with a stone in it.</p></article></main><footer><p>Terms and privacy</p></footer></body></html>",
     "Bread\n\nMix flour, water and salt, and leave the dough alone for a night.\n\nBaking\n\nThe oven should be as hot as it gets, with a stone in it."),
    ("<body><nav><a href=/>Home</a> <a href=/x>News</a></nav><article><h1>Lights out</h1><p>The old lighthouse went dark on Sunday after more than a hundred years of work.</p><p>A keeper will stay, to mind the garden and the goats.</p></article><section><h2>12 comments</h2><p>I will miss it when I sail home at night.</p><p>So will I, and my brother too.</p></section></body>",
     "Lights out\n\nThe old lighthouse went dark on Sunday after more than a hundred years of work.\n\nA keeper will stay, to mind the garden and the goats."),
]


def test_pages_labelled_by_hand():
    for page, text in HAND:
        assert _one(page) == text


HOSTILE = (
    lambda n: '<a "' * n, lambda n: "<a \"'" * n + ">", lambda n: "<p title='" * n + "x", lambda n: "<!" * n, lambda n: "<noscript>" * n, lambda n: "<template><p>x" * n, lambda n: "".join(f'<div class="c{k}">' for k in range(n)) + "text",
    lambda n: "<p>x" * n, lambda n: "</x>" * n, lambda n: "<iframe src='" * n, lambda n: "<dt><ul>" + "<foo>" * n + "<dt></dt>" * n, lambda n: "<head>" * n, lambda n: "<![CDATA[" * n, lambda n: "<table><tr>" + "<foo><td>" * n, lambda n: "<h2>3 comments</h2>" * n,
)


def test_hostile_pages_take_linear_time():
    """By the ratio of two sizes, one four times the other: quadratic time would be sixteen times as long."""
    import time

    def took(page):
        began = time.process_time()
        assert isinstance(_one(page), str)
        return time.process_time() - began

    for k, page in enumerate(HOSTILE):
        few, many = page(6_000), page(24_000)
        assert min(took(many) for _ in range(2)) < 8 * max(min(took(few) for _ in range(2)), 0.03), k


PROSE = "The ferry leaves at noon, and it comes back before dark."
PLAIN = [
    (f"<article><h1>River speed</h1><p>{PROSE}</p><h2>Discussion</h2><p>{PROSE}</p><h2>Conclusion</h2><p>{PROSE}</p></article>", f"River speed\n\n{PROSE}\n\nDiscussion\n\n{PROSE}\n\nConclusion\n\n{PROSE}"),
    (f"<article><h1>Survey</h1><p>{PROSE}</p><section><h2>Responses</h2><p>{PROSE}</p></section><section><h2>Conclusion</h2><p>{PROSE}</p></section></article>", f"Survey\n\n{PROSE}\n\nResponses\n\n{PROSE}\n\nConclusion\n\n{PROSE}"),
    (f"<article><h1>Comments</h1><p>{PROSE}</p><p>{PROSE}</p></article>", f"Comments\n\n{PROSE}\n\n{PROSE}"),
    (f"<body><p>{PROSE}</p><p>{PROSE}</p></body>", f"{PROSE}\n\n{PROSE}"),
    (f"<div class=content>{PROSE}</div>", PROSE),
    (f"<div>{PROSE}<br>{PROSE}</div>", f"{PROSE} {PROSE}"),
    (f"<center><font size=2><p>{PROSE}</p></font></center>", PROSE),
    (f"<main><article><p>{PROSE}</p><div class=comment-count>3</div></article></main>", PROSE),
    (f"<body><article><h1>Ferry</h1><p>{PROSE}</p><![CDATA[ mark > <p>{PROSE}</p></article></body>", f"Ferry\n\n{PROSE}\n\n{PROSE}"),
    ("<body><nav><a href=/>Home</a></nav><form><p>Tell us your name, please.</p><input></form></body>", ""),
]


def test_plain_layouts_lose_no_article():
    for page, text in PLAIN:
        assert _one(page) == text, page
