from pyspark.sql import functions as F

from vitrine.operators import accessibility as A, checks as C, pages as P, social as SO, structured as SD

HEAD = """<html lang="en"><head><title>Acme</title><meta property="og:title" content="Acme"><meta property="og:image" content="/a.png">
<meta name="twitter:card" content="summary"><script async src="https://www.googletagmanager.com/gtag/js?id=G-ABC1234567"></script>
<script>fbq('init', '1234567890');</script><script src="https://consent.cookiebot.com/uc.js"></script>
<script type="application/ld+json">{"@context":"https://schema.org","@graph":[{"@type":"LocalBusiness","name":"Acme"},
{"@type":"FAQPage","mainEntity":[{"@type":"Question","name":"Hidden one?","acceptedAnswer":{"text":"yes"}},{"@type":"Question","name":"No answer?"}]},
{"@type":"Review","author":"A","reviewRating":5,"itemReviewed":{"@id":"#nothing"},"citation":{"@type":"Article"}}]}</script></head><body><p>Hello</p></body></html>"""


def test_structured_data_tags_and_previews(page):
    pages = page({"https://acme.test/": HEAD}, "lines", "social_meta", "canonical_url", "script_srcs", "inline_script")
    issues = {(i.code, i.type, i.property) for i in SD.with_issues(pages).first().issues}
    assert {("missing_required", "LocalBusiness", "address"), ("incomplete_question", "Question", None), ("faq_not_visible", "Question", None),
            ("unresolved_reference", None, None)} <= issues
    assert not any(t == "Article" for _, t, _ in issues)
    tools = {t.tool: t.ids for t in C.detect_tools(pages).first().tools}
    assert tools == {"Google tag (gtag.js)": ["G-ABC1234567"], "Meta Pixel": ["1234567890"], "Cookiebot": []}
    found = {(i.code, i.tag) for i in C.preview_issues(pages).first().preview_issues}
    assert {("image_not_absolute_https", "og:image"), ("missing", "og:description")} <= found and ("missing", "twitter:card") not in found


def test_hidden_text_and_resolved_links(page):
    html = """<body><nav><a href="/a?utm_source=x&b=1#t">One</a></nav><div style="display: none">secret <a href="/no">No</a></div><p hidden>gone</p>
<h1>Title <br>two</h1><template>tpl</template><a href="mailto:x@acme.test?subject=1">Mail</a><a href="javascript:void(0)">js</a></body>"""
    row = page({"https://Acme.test:443/dir/": html}, "lines", "links", "headings", "emails").first()
    assert row.lines == ["One", "Title", "two", "Mailjs"]
    assert [x.url for x in row.links] == ["https://acme.test/a?b=1", "mailto:x@acme.test?subject=1"]
    assert [(h.level, h.text) for h in row.headings] == [(1, "Title two")] and row.emails == ["x@acme.test"]


BAD = """<html><body>
<img src="a.png"><input type="text"><button></button><a href="/x"></a><iframe src="/f"></iframe></body></html>"""
NAMED = """<html lang="en"><head><title>T</title></head><body><span id="n">Name</span><img alt="" src="a"><label for="i">L</label><input id="i"><label>W <select></select></label>
<input aria-labelledby="n"><button><img alt="Go"></button><a href="/x" title="t"></a><iframe title="f"></iframe><input type="submit"><input type="hidden"></body></html>"""
REFS = """<html lang="en"><head></head><body><svg><title>Icon</title></svg><input aria-labelledby="nope"><input type="submit" value=""></body></html>"""
HIDDEN = """<html lang="en"><head><title>T</title></head><body><button><span hidden>Close</span></button><div aria-hidden="true"><img src="x"></div></body></html>"""


def test_accessibility_rules(page):
    pages = page({"https://a.test/bad": BAD, "https://a.test/named": NAMED, "https://a.test/refs": REFS, "https://a.test/hidden": HIDDEN}, "lines")
    elements = A.accessibility_elements(pages, ["site"])
    found = {}
    for r in A.accessibility_findings(elements).collect():
        found.setdefault(r.url.rsplit("/", 1)[1], []).append((r.rule, r.line))
    assert {rule for rule, _ in found["bad"]} == {"page-title", "html-lang", "image-alternative", "control-name", "button-name", "link-name", "frame-name"}
    assert ("image-alternative", 2) in found["bad"] and "named" not in found
    assert sorted(rule for rule, _ in found["refs"]) == ["control-name", "control-name", "page-title"]
    assert found["hidden"] == [("button-name", 1)]


def test_accessibility_exclusions(page):
    pages = page({"https://a.test/": NAMED}, "lines")
    out = pages.withColumn("error", F.lit("HTTP 500"))
    summary = A.accessibility_summary(out, A.accessibility_elements(out, ["site"]), ["site"]).first()
    assert (summary.pages_checked, summary.pages_excluded, summary.status) == (0, 1, "UNKNOWN")


PROOF = ("lines", "headings", "web_links", "script_sources", "json_types", "quotation_candidates", "label", "trustpilot_widgets")
QUOTE = "They rebuilt our website in three weeks and bookings doubled soon after."


def proof(page, body, url="https://acme.test/x"):
    return SO.proof_signals(page({url: f"<html><body>{body}</body></html>"}, *PROOF))


def kinds(page, body, **kw):
    return [s.kind for s in proof(page, body, **kw).first().signals]


def test_social_proof_found(page):
    assert kinds(page, f"<h2>What our clients say</h2><p>“{QUOTE}”</p><p>Jane Doe, founder</p>") == ["testimonial_section", "attributed_quote"]
    body = '<a href="https://g.page/r/x/review">Leave a review</a><a href="/t">Share your story</a><p>Refer a friend today.</p>'
    rows = proof(page, body)
    assert SO.proof_summary(rows, ["site"]).first().status == "WARNING"
    assert [s.kind for s in rows.first().signals] == ["review_link", "testimonial_ask", "referral_ask"]
    assert SO.proof_summary(proof(page, "<p>Hello</p>"), ["site"]).first().status == "FAIL"


def test_social_proof_not_found(page):
    assert kinds(page, '<a href="/reviews">Reviews</a>') == []
    assert kinds(page, "<h2>Investigations, not testimonials.</h2><p>A federal referral</p>") == []
    assert kinds(page, f"<h2>Our Approach</h2><p>“{QUOTE}”</p><p>more prose in lower case</p>") == []
    assert kinds(page, f"<p>“{QUOTE[:-1]},” J. Chem. Eng., 86: 622</p>") == []


def test_long_unclosed_quote_is_quick(page):
    import time

    start = time.time()
    assert kinds(page, "<p>“" + "a" * 80_000 + "</p>") == []
    assert time.time() - start < 30


def test_examples_are_capped_and_clipped(spark, page):
    many = page({f"https://acme.test/{i}": f"<p>“{'word ' * 60}end.”</p><p>Jane Doe, founder</p>" for i in range(15)}, *PROOF)
    rows = SO.proof_examples(SO.proof_signals(many), ["site"]).collect()
    assert len(rows) == 10 and max(len(r.example) for r in rows) == 200


def test_other_companies_review_pages_do_not_count(page):
    pages = page({"https://acme.test/": '<a href="https://www.trustpilot.com/review/beta.test">B</a>', "https://acme.test/p": '<a href="https://www.trustpilot.com/review/www.acme.test">A</a>'}, "web_links")
    assert [(r.platform, r.profile) for r in SO.review_profiles(pages, ["site"]).collect()] == [("Trustpilot", "https://www.trustpilot.com/review/www.acme.test")]


def test_font_families(spark):
    css = "@font-face{font-family:'Lato'} :root{--f: Inter, serif} p{font-family: var(--f) !important} b{font-family:var(--x)}"
    assert spark.createDataFrame([(css,)], "c string").select(C.font_families(F.col("c")).alias("f")).first().f == ["Inter", "Lato", "serif", "var(--x)"]


def test_duplicate_canonicals_keep_the_first_claim(spark):
    rows = spark.createDataFrame([("s", 1, "https://a.test/x", "https://a.test/c"), ("s", 2, "https://a.test/y", "https://a.test/c"), ("s", 3, "https://a.test/z", "https://other.test/")],
                                 "site string, page_no int, url string, canonical_url string")
    assert {r.page_no: r.duplicate_of for r in P.duplicate_canonicals(rows, ["site"], "page_no").collect()} == {1: None, 2: "https://a.test/c", 3: None}


def test_postal_addresses(page):
    html = '<script type="application/ld+json">{"@type":"Store","address":{"@type":"PostalAddress","@context":"x","postalCode":"N1H 1G5","streetAddress":12}}</script>'
    row = SD.postal_addresses(page({"https://a.test/": html}, "lines"), ["site"]).first()
    assert row.address == {"@type": "PostalAddress", "postalCode": "N1H 1G5", "streetAddress": "12"}


def test_names_of_many_controls_and_links_take_one_sweep(page):
    import time

    from vitrine.operators import accessibility as A
    from vitrine.sources.html import _dom

    n = 10_000
    body = "".join(f'<label for="c{i}">n</label><input id="c{i}"><a href="/{i}"><b><img src="x" alt="{"" if i % 2 else "a"}"></b></a>' for i in range(n))
    html = f'<html lang="en"><head><title>t</title></head><body>{body}<label>held <input></label><label> <input></label><span id="s">s</span><i id="s"></i><input aria-labelledby="s"></body></html>'
    start = time.process_time()
    _dom(html, "https://s.test/")
    parsed = time.process_time() - start
    pages = page({"https://s.test/": html}, "title")
    start = time.time()
    found = {(r["rule"], r["missing"]): r["count"] for r in A.accessibility_elements(pages, ["site"]).groupBy("rule", "missing").count().collect()}
    # Every image has an alt attribute; every second link has a name inside; two inputs have none: an empty label's and the one whose id is last an empty element's.
    assert found["link-name", True] == n // 2 and found["link-name", False] == n // 2 and found["control-name", True] == 2 and found["control-name", False] == n + 1
    assert time.time() - start < 10 + 4 * parsed
