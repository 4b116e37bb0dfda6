"""Captured pages as a crawl would store them, derived from ``pages``.

The given pages have no meta tags, structured data, scripts, forms or response headers, so those are written into each
page's HTML by page number. The checks then read them back from the HTML; the SQL works from the page number alone.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.urls import host
from ..operators import checks as C, pages as P, social as SO, structured as SD
from ..sources.html import parse_html

QUOTE = "They rebuilt our website in three weeks and bookings doubled soon after."


def _by(k, n, **cases):
    """Text by ``k % n``: ``m0="..."`` is the text for remainder 0."""
    out = F.lit("")
    for name, text in cases.items():
        out = F.when(k % n == int(name[1:]), text).otherwise(out)
    return out


def _ld(text):
    return f'<script type="application/ld+json">{text}</script>'


def _head(k, url):
    num = lambda c: c.cast("string")
    return F.concat(
        _by(k, 3, m1=f'<meta name="description" content="{"d" * 40}">', m2=F.when(k % 2 == 0, f'<meta name="description" content="{"d" * 170}">').otherwise(
            f'<meta name="Description" content="{"d" * 100}">')),
        _by(k, 4, m1=F.concat(F.lit('<link rel="canonical" href="/c/'), num(F.floor(k / 10)), F.lit('">')), m2=F.concat(F.lit('<link rel="canonical" href="'), url, F.lit('">')),
            m3='<link rel="CANONICAL" href="https://elsewhere.example.org/x/">'),
        _by(k, 11, m0='<meta name="robots" content="noindex,follow">'), _by(k, 13, m0='<meta name="googlebot" content="none">'),
        F.when(k % 5 == 0, "").otherwise(F.when(k % 6 == 0, f'<meta property="og:title" content="{"t" * 95}">').otherwise('<meta property="og:title" content="Page">')),
        _by(k, 2, m0=F.when(k % 8 == 0, f'<meta property="og:description" content="{"e" * 210}">').otherwise('<meta property="og:description" content="about">')),
        _by(k, 3, m0=F.concat(F.lit('<meta property="og:image" content="https://img.example.com/'), num(k % 7), F.lit('.png">')), m1='<meta property="og:image" content="/img/1.png">'),
        _by(k, 9, m0='<meta property="og:image:width" content="1200"><meta property="og:image:height" content="630">'),
        _by(k, 4, m1='<meta property="og:url" content="https://other.example.com/">', m2=F.concat(F.lit('<meta property="og:url" content="'), url, F.lit('">'))),
        _by(k, 2, m1='<meta property="og:type" content="website">'), _by(k, 10, m0='<meta name="twitter:card" content="summary">'),
        _by(k, 6,
            m1=F.concat(F.lit(_ld('{"@context":"https://schema.org","@type":"Dentist","@id":"#biz","name":"Biz @","telephone":"+1 (512) 555-0100","url":"https://biz.test",'
                                  '"sameAs":["https://www.linkedin.com/company/biz","https://biz.example.net/about"]}'))),
            m2=_ld('{"@context":"https://schema.org","@graph":[{"@type":"Organization","@id":"#org","name":"Org","url":"u","logo":"l","sameAs":"https://github.com/org"},'
                   '{"@type":["Person","Organization"],"name":"Jane Doe","worksFor":{"@id":"#org"},"knows":{"@id":"#nobody"}},{"@type":"WebSite","@id":"#org","name":"Other"}]}'),
            m3=_ld('{"@context":"https://schema.org","@type":"FAQPage","mainEntity":[{"@type":"Question","name":"Unseen question?","acceptedAnswer":{"text":"Yes"}},'
                   '{"@type":"Question","name":"No answer?"},{"@type":"Question","name":"Call us","acceptedAnswer":{"@type":"Answer","text":"Now"}}]}'),
            m4=_ld('{"@context": broken'),
            m5=_ld('[{"@type":"Product","name":"P"},{"@type":"Review","author":"Ann","reviewBody":"Good","reviewRating":{"ratingValue":5}}]')
            + _ld('{"@type":"BreadcrumbList","itemListElement":[{"@type":"ListItem","position":1,"item":{"name":"x"}},{"@type":"ListItem","name":"y"}]}')),
        _by(k, 5, m1=F.concat(F.lit('<script async src="https://www.googletagmanager.com/gtag/js?id=G-ABC100000'), num(k % 3), F.lit('"></script>')),
            m2=F.concat(F.lit("<script>(function(w){load('https://www.googletagmanager.com/gtm.js')})(window,'GTM-AB100"), num(k % 4),
                        F.lit("');\nfbq('init', '12345670"), num(k % 2), F.lit("');</script>")),
            m3='<script src="https://consent.cookiebot.com/uc.js"></script>', m4="<script>var h={hjid:98765};s.src='https://static.hotjar.com/c/hotjar-'+h.hjid;</script>"),
        _by(k, 4, m1='<link rel="stylesheet" href="https://fonts.googleapis.com/css?family=Roboto:400|Open+Sans"><link rel="alternate" type="application/rss+xml" href="/feed">',
            m2='<link rel="stylesheet" href="/site.css"><link rel="icon" href="/i.ico">', m3='<link rel="stylesheet" href="https://use.typekit.net/abc.css">'),
        _by(k, 6, m0="<style>:root{--f: 'Inter', serif} p{font-family: var(--f) !important} b{font-family:Georgia}</style>"),
        _by(k, 11, m2='<script src="https://widget.trustpilot.com/x.js"></script>'))


def _body(k):
    return F.concat(
        _by(k, 3, m0='<img src="/i.png">', m1='<img alt="" src="/i.png">', m2='<img src="http://img.example.com/x.png" alt="x">'),
        _by(k, 4, m0='<input type="text" id="q">', m1='<label for="q">Name</label><input id="q">', m2='<label>Mail <input type="email"></label>',
            m3='<input type="submit" value=""><input type="hidden"><select aria-label="s"></select>'),
        _by(k, 5, m0="<button></button>", m1='<button><img alt="Go" src="/g.png"></button><button>Book now</button>'),
        _by(k, 7, m0='<iframe src="https://www.youtube.com/embed/x"></iframe>', m1='<iframe title="v" src="https://www.youtube.com/embed/x"></iframe>'),
        _by(k, 8, m0='<a href="/e"></a>', m1='<div hidden><a href="/h"></a><p>Unseen text</p></div>'),
        _by(k, 3, m1=F.concat(F.lit('<p><a href="https://www.linkedin.com/company/acme'), (k % 2).cast("string"), F.lit('/">LinkedIn</a></p>'))),
        _by(k, 9, m0='<p><a href="https://x.com/share?u=1">Share</a></p>'),
        _by(k, 5, m2="<h2>What our clients say</h2>", m3=f"<p>“{QUOTE}”</p><p>Jane Doe, founder</p>"),
        _by(k, 7, m3='<p><a href="https://g.page/r/abc/review">Leave a review</a></p>', m4='<p><a href="https://www.yelp.com/biz/acme">Find us</a></p>'),
        _by(k, 11, m1="<p>Refer a friend and save.</p>", m3="<p>No referral program needed.</p>"),
        _by(k, 4, m1='<p><a href="tel:+1 (512) 555-0100">Call us</a></p>', m2='<p><a href="mailto:info@acme.test?subject=x">Mail</a> or write to sales@acme.test.</p>'))


def captured(t):
    """Raw captured pages: site, page_no, url, html and what the response said."""
    k, url = F.col("page_id"), F.col("url")
    # Quotation marks of the invented text go, so that the quotes on a page are the ones written into it.
    plain = F.replace(F.col("html"), F.lit("&quot;"), F.lit(""))
    html = F.replace(F.replace(plain, F.lit("</head>"), F.concat(_head(k, url), F.lit("</head>"))), F.lit("<footer>"), F.concat(_body(k), F.lit("<footer>")))
    pairs = [("content-type", F.lit("text/html"), F.lit(True)), ("strict-transport-security", F.lit("max-age=1"), k % 2 == 0),
             ("content-security-policy", F.when(k % 6 == 0, "frame-ancestors 'none'").otherwise("default-src 'self'"), k % 3 == 0),
             ("x-content-type-options", F.lit("nosniff"), k % 5 != 0), ("referrer-policy", F.lit("no-referrer"), k % 7 == 0),
             ("x-frame-options", F.lit("DENY"), k % 4 == 0), ("set-cookie", F.when(k % 8 == 0, "a=1; Secure; HttpOnly").otherwise("a=1; samesite=lax"), k % 4 == 0),
             ("x-robots-tag", F.lit("NOINDEX"), k % 17 == 0)]
    headers = F.map_from_entries(F.array_compact(F.array(*[F.when(c, F.struct(F.lit(n), v)) for n, v, c in pairs])))
    # The given table is one block of one file; dealt by page it is as many tasks as any other input.
    return t.pages.repartition("page_id").select(
        host(url).alias("site"), k.alias("page_no"), url.alias("url"), html.alias("html"), headers.alias("headers"), (k % 4).cast("int").alias("depth"),
        F.when(k % 19 == 0, 503).otherwise(200).alias("status"), F.when(k % 19 == 0, "HTTP 503").alias("error"), (k % 23 == 0).alias("truncated"))


def records(t, *names):
    """Page records of the captured pages with the named columns and those the checks add."""
    return records_of(captured(t), *names)


def records_of(pages, *names):
    found = P.page_record(parse_html(pages), *names)
    return found.withColumn("extraction_status", F.lit("EXTRACTED")).withColumn("duplicate_of", F.lit(None).cast("string"))


def with_tools(t, found=None):
    """``found``: records that have the columns already, for those who read them more than once."""
    return C.detect_tools((records(t, "script_srcs", "inline_script") if found is None else found).select("site", "page_no", "url", "script_srcs", "inline_script"))


def with_issues(t, found=None):
    return SD.with_issues((records(t, "lines") if found is None else found).select("site", "page_no", "url", "dom", "lines"))


def with_signals(t):
    found = records(t, "lines", "headings", "web_links", "script_sources", "json_types", "quotation_candidates", "label", "trustpilot_widgets")
    return SO.proof_signals(found.withColumn("review_count", SD.review_count()))
