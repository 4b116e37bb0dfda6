from pyspark.sql import functions as F

from vitrine.functions.identity import company_key, identity_check, is_target
from vitrine.operators import citations as CI, visibility as V

ANSWER = ("site string, answer_id int, prompt string, error string, "
          "companies array<struct<name:string,website:string,city:string,position:double,sentiment:double>>")


def answers(spark):
    def c(name, position, sentiment, website=None):
        return (name, website, None, position, sentiment)

    return spark.createDataFrame([
        ("a", 1, "q", None, [c("HubSpot", 1.0, .5, "hubspot.com"), c("Acme Dental", 2.0, .8), c("Beta", 3.0, 0.0)]),
        ("a", 2, "q", None, [c("Beta", 1.0, 0.0), c("ACME", 2.0, .2, "www.acme.test")]),
        ("a", 3, "r", None, [c("HubSpot", 1.0, .1, "https://www.hubspot.com/"), c("Beta", 2.0, 0.0), c("Beta", 3.0, 0.0)]),
        ("a", 4, "r", "rate limited", None)], ANSWER)


def profiles(spark):
    return spark.createDataFrame([("a", "acme.test", ["Acme Dental"], [])], "site string, domain string, names array<string>, cities array<string>")


def test_leaderboard(spark):
    mentions = V.answer_positions(answers(spark), profiles(spark), ["site"])
    board = V.leaderboard(mentions, ["site"])
    ranked = V.leaderboard_rank(board, ["site"]).orderBy("rank").collect()
    assert [(r.company_key, r.mentions, r.avg_position) for r in ranked] == [("beta", 3, 2.0), ("hubspot.com", 2, 1.0), ("acme.test", 2, 2.0)]
    acme = next(r for r in ranked if r.is_target)
    assert (acme.company_key, acme.company, acme.mentions, acme.avg_position) == ("acme.test", "Acme Dental", 2, 2.0)
    rank = V.target_rank(board, ["site"]).first()
    assert (rank["rank"], rank.companies) == (3, 3)
    rates = V.mention_rates(answers(spark), mentions, ["site"]).first()
    assert (rates.answers_total, rates.answers_scored, rates.mention_rate, rates.share_of_voice) == (4, 3, 0.667, 0.286)


def test_sentiment(spark):
    mentions = V.answer_positions(answers(spark), profiles(spark), ["site"])
    branded = spark.createDataFrame([("a", .9)], "site string, sentiment double")
    found = {r.branch: (r.score, r.n, r.low, r.high) for r in V.sentiment(mentions, branded, ["site"]).collect()}
    assert found == {"unbranded": (50, 2, 20, 80), "branded": (90, 1, 90, 90), "overall": (63, 3, 20, 90)}


def test_nothing_scored_is_null(spark):
    none = answers(spark).filter("answer_id = 4")
    mentions = V.answer_positions(none, profiles(spark), ["site"])
    row = V.mention_rates(none, mentions, ["site"]).first()
    assert row.mention_rate is None and row.share_of_voice is None and row.answers_total == 1


def test_missing_position_sorts_last_and_sentiment_is_clamped(spark):
    rows = spark.createDataFrame([("a", 1, "q", None, [("Late", None, None, None, 1.7), ("First", "[n/a]", None, 4.0, float("nan")), (None, None, None, 1.0, 0.0)])], ANSWER)
    got = {r.company_key: (r.position, r.sentiment) for r in V.answer_positions(rows, profiles(spark), ["site"]).collect()}
    assert got == {"first": (1, None), "late": (2, 1.0)}


def test_company_key_and_target(spark):
    rows = spark.createDataFrame([("HubSpot", "https://www.HubSpot.com/pricing", None), ("  Beta Co ", None, None), ("Acme", "acme.com", None),
                                  ("Acme Dental", "acmedental.com", None), ("Acme Dental", None, "Denver"), ("Acme Dental", None, "Austin, TX")],
                                 "name string, website string, city string")
    key = company_key(F.col("name"), F.col("website"))
    target = is_target(key, F.col("name"), F.lit("acme.test"), F.array(F.lit("Acme Dental")), F.col("city"), F.array(F.lit("Austin")))
    assert [(r.k, r.t) for r in rows.select(key.alias("k"), target.alias("t")).collect()] == [
        ("hubspot.com", False), ("beta co", False), ("acme.com", False), ("acmedental.com", False), ("acme dental", False), ("acme dental", True)]


def test_identity_verdicts(spark):
    cases = [("https://www.acme.test", "Austin", None, "a dentist", ["website"]), ("acme.test", "Round Rock, TX", None, None, ["website", "city"]),
             (None, "Denver", None, None, []), ("acmedental.com", None, None, None, []), (None, None, "303-555-0100", None, []), (None, None, "call us", None, [])]
    rows = spark.createDataFrame(cases, "website string, city string, phone string, category string, given array<string>")
    profile = {"domain": F.lit("acme.test"), "profiles": F.array().cast("array<string>"), "cities": F.array(F.lit("Round Rock"), F.lit("Austin")),
               "phones": F.array(F.lit("5125550100")), "categories": F.array(F.lit("Dentist"))}
    got = rows.select(identity_check({c: F.col(c) for c in ("website", "city", "phone", "category")}, profile, F.col("given")).alias("c")).select("c.*").collect()
    assert [r.verdict for r in got] == ["confirmed", "unconfirmed", "mismatch", "mismatch", "mismatch", "unconfirmed"]
    assert (got[0].agree, got[0].echoed) == (["city", "category"], ["website"])


def test_citation_gap(spark):
    urls = ["https://yelp.test/best?utm_source=x", "https://yelp.test/best#top", "https://acme.test/about", "https://news.test/a", "https://dir.test/list",
            "https://linkedin.com/in/janedoe/", "https://blocked.test/x", "https://down.test/x", "https://pdf.test/r.pdf", "javascript:alert(1)"]
    rows = spark.createDataFrame([("a", 1, "q", [(u, "T") for u in urls if "#top" not in u]), ("a", 2, "r", [(urls[1], "T")])],
                                 "site string, answer_id int, prompt string, sources array<struct<url:string,title:string>>")
    profile = spark.createDataFrame([("a", "acme.test", ["Acme Dental"], ["Jane Doe"], ["https://www.linkedin.com/in/janedoe"])],
                                    "site string, domain string, names array<string>, people array<string>, profiles array<string>")
    bodies = spark.createDataFrame([
        ("https://yelp.test/best", True, 200, "text/html", "Best dentists", ["https://www.acme.test/"]), ("https://news.test/a", True, 200, "", "We met Acme Dental.", []),
        ("https://dir.test/list", True, 200, "text/plain", "Acme Dentals", []), ("https://blocked.test/x", False, None, None, None, None),
        ("https://pdf.test/r.pdf", True, 200, "application/pdf", "", [])],
        "url string, allowed boolean, status int, content_type string, text string, links array<string>")
    cited = V.cited_pages(rows, ["site"])
    yelp = cited.filter("url = 'https://yelp.test/best'").first()
    assert (yelp.answers, yelp.citations, yelp.prompts) == (2, 2, ["q", "r"])
    checked = CI.citation_check(cited, bodies, profile, ["site"])
    assert {r.domain: (r.status, r.match) for r in checked.collect() if r.status == "mentioned"} == {"yelp.test": ("mentioned", "strong"), "news.test": ("mentioned", "name_only")}
    s = CI.citation_gap_summary(checked, ["site"]).first()
    assert (s.cited_pages, s.owned, s.third_party, s.mentioned, s.not_mentioned, s.unreachable, s.blocked_by_robots, s.unreadable, s.mentioned_name_only, s.status) == (
        8, 2, 6, 2, 1, 1, 1, 1, 1, "PARTIAL")
    by_domain = {r.domain: r.mentioned for r in CI.citation_gap_domains(checked, ["site"]).collect()}
    assert (by_domain["yelp.test"], by_domain["dir.test"], by_domain["down.test"]) == (True, False, None)


def test_citation_limit_keeps_the_rest_as_not_checked(spark):
    rows = spark.createDataFrame([("a", 1, "q", [(f"https://p{i}.test/", "T") for i in range(50)])], "site string, answer_id int, prompt string, sources array<struct<url:string,title:string>>")
    profile = spark.createDataFrame([("a", "acme.test", [], [], [])], "site string, domain string, names array<string>, people array<string>, profiles array<string>")
    bodies = spark.createDataFrame([], "url string, allowed boolean, status int, content_type string, text string, links array<string>")
    counts = {r.status: r["count"] for r in CI.citation_check(V.cited_pages(rows, ["site"]), bodies, profile, ["site"], 40).groupBy("status").count().collect()}
    assert counts == {"unreachable": 40, "not_checked": 10}
    assert CI.citation_check(V.cited_pages(rows, ["site"]), bodies, profile, ["site"]).filter("status = 'unreachable'").count() == 50


def test_quotes_are_found_on_any_page_of_their_site(spark):
    import random

    from vitrine.operators import evidence as E

    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 4)))
    pages = [(f"s{i % 2}", i, f"https://x.test/{i}", rng.choice([" ", "\n  "]).join(word() for _ in range(rng.randint(0, 30)))) for i in range(60)] + [("s0", 60, "https://x.test/60", None)]
    claims = []
    for i in range(200):
        site, _, _, text = rng.choice(pages[:60])
        start = rng.randint(0, max(0, len(text) - 1))
        claims.append((rng.choice([site, site, "s1", "s2"]), i, rng.choice([text[start:start + rng.randint(1, 25)], "ab  B c", None, ""]), "https://x.test/1?q=2"))
    squashed = lambda t: " ".join((t or "").lower().split())
    where = lambda site, q: next((u for s, _, u, t in pages if q and s == site and q in squashed(t)), None)
    p = spark.createDataFrame(pages, "site string, place int, url string, visible_text string")
    c = spark.createDataFrame(claims, "site string, claim_id int, quote string, url string")
    got = {r["claim_id"]: (r["url"], r["verified"]) for r in E.attribute_quotes_everywhere(c, p, ["site"]).collect()}
    assert len(got) == 200 and sum(v for _, v in got.values()) > 60
    for site, i, quote, url in claims:
        found = where(site, squashed(quote))
        assert got[i][1] == (found is not None) and (found is None or got[i][0] == found)
    assert E.quoted_on(c.limit(0), p, ["site"]).count() == 0
