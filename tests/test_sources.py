from datetime import date

import pytest
from pyspark.sql import functions as F, types as T

from vitrine.operators import calendar as C, evidence as E, frontier as W, identity as I, registry
from vitrine.sources import capture as S

K = ["site"]


def test_prospects_csv(spark, tmp_path):
    (tmp_path / "p.csv").write_bytes("﻿domain,name\nacme.test,A\n,B\nacme.test,C\n".encode())
    rows = S.read_prospects(spark, str(tmp_path / "p.csv")).orderBy("row_no").collect()
    assert [(r.row_no, r.domain, r.status) for r in rows] == [(1, "acme.test", "PENDING"), (2, None, "ERROR"), (3, "acme.test", "PENDING")]
    with pytest.raises(ValueError):
        S.read_prospects(spark, str(tmp_path / "p.csv"), "site")


def test_prompt_file(spark, tmp_path):
    (tmp_path / "q.txt").write_text("# no\n\n Cost? \nTime?\n")
    assert {r.value for r in S.read_prompts(spark, str(tmp_path / "q.txt")).collect()} == {"Cost?", "Time?"}
    (tmp_path / "e.txt").write_text("#\n\n")
    with pytest.raises(ValueError):
        S.read_prompts(spark, str(tmp_path / "e.txt"))


def test_tolerant_json(spark, tmp_path):
    (tmp_path / "good.json").write_text('{"status": "PASS"}')
    (tmp_path / "bad.json").write_text('{"status": ')
    expected = spark.createDataFrame([("good.json",), ("bad.json",), ("none.json",)], "file string")
    got = {r.file: r.state for r in S.read_bundle_json(spark, expected, str(tmp_path), T.StructType([T.StructField("status", T.StringType())])).collect()}
    assert got == {"good.json": "ok", "bad.json": "unreadable", "none.json": "not collected"}


def test_bundle_round_trip_and_tampering(spark, tmp_path):
    folder = str(tmp_path / "bundle")
    pages = spark.createDataFrame([("a", "r1", "x"), ("b", "r1", "y")], "site string, run_id string, text string")
    manifest = S.write_bundle({"pages": pages}, "file:" + folder)
    assert manifest.count() == 2 and manifest.filter("length(sha256) = 64").count() == 2
    with pytest.raises(Exception):
        S.write_bundle({"pages": pages}, "file:" + folder)
    files = S.stored_files(spark, [f"file:{folder}/pages"]).select(F.regexp_extract("path", "bundle/(.*)$", 1).alias("path"), "content")
    assert S.verify(manifest, files).isEmpty()
    first = manifest.orderBy("path").first().path
    spoiled = files.withColumn("content", F.when(F.col("path") == first, F.lit(b"no")).otherwise(F.col("content")))
    assert [(r.path, r.problem) for r in S.verify(manifest, spoiled).collect()] == [(first, "modified")]
    assert {r.problem for r in S.verify(manifest, files.limit(0)).collect()} == {"missing"}


def test_robots_and_sitemaps(spark):
    text = "User-agent: *\nDisallow: /blocked\n\nUser-agent: GPTBot\nDisallow: /\n"
    robots = spark.createDataFrame([("a", 200, text), ("b", 404, ""), ("c", 503, "")], "site string, status int, text string")
    urls = spark.createDataFrame([(s, f"https://{s}.test{p}") for s in "abc" for p in ("/", "/blocked/x")], "site string, url string")
    got = {(r.site, r.bot, r.url[14:]): r.allowed for r in W.robots_access(urls, robots, K, ["GPTBot", "ClaudeBot"]).collect()}
    assert (got["a", "GPTBot", "/"], got["a", "ClaudeBot", "/"], got["a", "ClaudeBot", "/blocked/x"]) == (False, True, False)
    assert got["b", "GPTBot", "/"] is True and got["c", "GPTBot", "/"] is None
    seeds = spark.createDataFrame([("a", 0, "https://a.test/sitemap.xml", "https://a.test")], "site string, pos int, url string, scope string")
    bodies = spark.createDataFrame([("https://a.test/sitemap.xml", 200, "<sitemapindex><sitemap><loc>https://a.test/sitemap.xml</loc></sitemap><sitemap><loc>https://a.test/s.xml</loc></sitemap></sitemapindex>"),
                                    ("https://a.test/s.xml", 200, "<urlset><url><loc>https://a.test/p</loc></url><url><loc>https://a.test/p#x</loc></url></urlset>")], "url string, status int, body string")
    pages, docs = W.sitemap_locs(seeds, bodies, K)
    assert [r.url for r in pages.collect()] == ["https://a.test/p"] and docs.count() == 2


def test_crawl_order_limits_and_canonicals(spark):
    root = "https://a.test"
    graph = {"/": ["/about", "/login", "https://else.test/", "/alias", "/real"], "/about": ["/deep"], "/deep": ["/deeper"], "/alias": [], "/real": [], "/seed": ["/about"], "/deeper": []}
    links = spark.createDataFrame([("a", root + s, i, u if u.startswith("http") else root + u) for s, out in graph.items() for i, u in enumerate(out)], "site string, source string, pos bigint, target string")
    pages = spark.createDataFrame([("a", root + u, root + "/real" if u == "/alias" else None, True) for u in graph], "site string, url string, canonical_url string, allowed boolean")
    starts = spark.createDataFrame([("a", root + "/", root)], "site string, url string, scope string")
    seeds = spark.createDataFrame([("a", root + "/seed", 0)], "site string, url string, pos int")
    got = {r.url.removeprefix(root): (r.depth, r.page_number, r.reason) for r in W.crawl_frontier(starts, seeds, pages, links, K, max_depth=2).collect()}
    assert got == {"/": (0, 1, None), "/seed": (1, 2, None), "/about": (1, 3, None), "/login": (1, None, "excluded_path_or_query"), "/alias": (1, 4, None),
                   "/real": (1, None, "duplicate_canonical"), "/deep": (2, 5, None)}
    few = {r.url.removeprefix(root): (r.page_number, r.reason) for r in W.crawl_frontier(starts, seeds, pages, links, K, max_depth=2, max_pages=2).collect()}
    assert few["/seed"] == (2, None) and few["/about"] == (None, "page_limit")


def test_titles_and_dates(spark):
    names = ["Rye bread basics guide", "Sourdough Starter Guide", "Guide to sourdough starter!", "Rye bread basics", "Sourdough starter guide today", "Why crumb matters"]
    titles = spark.createDataFrame([("s", i, n, i == 0) for i, n in enumerate(names)], "site string, pos bigint, title string, existing boolean")
    kept = C.near_duplicate_titles(titles, K).orderBy("pos").collect()
    assert [r.title for r in kept] == ["Sourdough Starter Guide", "Why crumb matters"]
    plan = spark.createDataFrame([("a", 1, None), ("a", 2, None), ("b", 1, date(2026, 10, 15))], "site string, n int, last_date date")
    got = [r.publish_on for r in C.schedule(plan, F.to_date(F.lit("2026-10-05"))).orderBy("site", "n").collect()]
    assert got == [date(2026, 10, 6), date(2026, 10, 9), date(2026, 10, 18)]


def test_titles_match_the_one_by_one_pass(spark):
    import itertools
    import random

    pick = random.Random(7)
    names = [" ".join(pick.sample("ab cd ef gh ij kl mn".split(), pick.randint(1, 5))) for _ in range(80)]
    words = lambda n: set(n.split())
    kept = []
    for name in names:
        if not any(words(name) == words(k) or len(words(name) & words(k)) / len(words(name) | words(k)) >= 0.7 for k in kept):
            kept.append(name)
    titles = spark.createDataFrame([("s", i, n, False) for i, n in enumerate(names)], "site string, pos bigint, title string, existing boolean")
    assert [r.title for r in C.near_duplicate_titles(titles, K).orderBy("pos").collect()] == kept
    assert list(itertools.islice(kept, 1)) == names[:1]


def test_identity_profile_and_listing(page, spark):
    html = """<script type="application/ld+json">{"@context":"https://schema.org","@graph":[{"@type":"Dentist","name":"Acme Dental","alternateName":["Acme"],"telephone":"+1 (512) 555-0100",
"address":{"@type":"PostalAddress","addressLocality":"Austin"}},{"@type":"WebSite","name":"Not a business"}]}</script>"""
    values = I.json_ld_values(page({"https://acme.test/": html}, "lines"), K).select("site", "kind", "value", F.lit(1).alias("source_rank"), F.col("at.pos").cast("int").alias("at"))
    user = spark.createDataFrame([("s", "names", "Acme Dental Group", 0, 0), ("s", "names", "acme dental", 2, 0), ("s", "cities", "Round Rock", 0, 0)], "site string, kind string, value string, source_rank int, at int")
    row = I.profile_arrays(I.identity_profile(values.unionByName(user), K), K, ["names", "cities", "phones", "categories"]).first()
    assert (row.names, row.cities, row.phones, row.categories) == (["Acme Dental Group", "Acme Dental", "Acme"], ["Round Rock", "Austin"], ["5125550100"], ["Dentist"])
    places = spark.createDataFrame([("s", 0, "namesake", "https://other.test", "303-555-0000", None), ("s", 1, "ours", None, "(512) 555-0100", None)],
                                   "site string, pos int, place_id string, website string, phone string, phone_intl string")
    own = spark.createDataFrame([("s", "acme.test", ["5125550100"])], "site string, domain string, phones array<string>")
    got = I.listing_match(places, own, K).first()
    assert (got.place_id, got.matched_by, got.found) == ("ours", "phone", True)


def test_people_merge_by_containment(page):
    def person(name, **more):
        import json

        return f'<script type="application/ld+json">{json.dumps({"@context": "https://schema.org", "@type": "Person", "name": name, **more})}</script>'

    pages = page({"https://a.test/1": person("Dr. Jane Smith, DDS", jobTitle="Dentist"), "https://a.test/2": person("Jane Q Smith", sameAs=["https://x.test/j"]),
                  "https://a.test/3": person("Bob Smith"), **{f"https://a.test/{i}": person("Jane Smith", sameAs=["https://x.test/j", "https://y.test/j", "none"]) for i in range(4, 9)}}, "lines")
    people, places = E.schema_people(pages, K)
    got = {r.name: (r.pages, r.same_as, r.fields) for r in people.collect()}
    assert got == {"Dr. Jane Smith, DDS": (7, 2, ["jobTitle", "sameAs"]), "Bob Smith": (1, 0, [])}
    assert places.count() == 8


def test_dimensions_report_missing_inputs(spark):
    people = spark.createDataFrame([], "site string, profile_url string, dedicated_page boolean, person_schema boolean, same_as boolean, credentials boolean")
    results, status = registry.collect({"people": people})
    assert list(results) == ["practitioners"] and status["citation_gap"] == "UNKNOWN: needs ai_search, captured, profiles"


def test_robots_paths_compare_without_percent_encoding(spark):
    robots = spark.createDataFrame([("s", 200, "User-agent: *\nDisallow: /caf%C3%A9\nDisallow: /a b\nDisallow: /c+d\n")], "site string, status int, text string")
    urls = [("/café", False), ("/caf%c3%a9", False), ("/a%20b", False), ("/c+d", False), ("/c d", True), ("/cafe", True), ("/100%", True)]
    asked = spark.createDataFrame([("s", f"https://s.test{u}") for u, _ in urls], "site string, url string")
    got = {r.url: r.allowed for r in W.robots_access(asked, robots, K, ["GPTBot"]).collect()}
    assert got == {f"https://s.test{u}": allowed for u, allowed in urls}


def test_sitemaps_are_read_as_xml(spark):
    body = "<urlset xmlns='x'><url><loc><![CDATA[https://s.test/a?x=1&y=2]]></loc></url><!-- <loc>https://s.test/no</loc> --><url><loc>https://s.test/b?x=1&#38;y=2</loc></url></urlset><!-- end -->"
    chain = [(f"https://s.test/{i}.xml", 200, f"<sitemapindex><sitemap><loc>https://s.test/{i + 1}.xml</loc></sitemap></sitemapindex>", False, True) for i in range(25)]
    many = "<urlset>" + "".join(f"<url><loc>https://s.test/p{i}</loc></url>" for i in range(12_000)) + "</urlset>"
    rows = [*chain, ("https://s.test/25.xml", 200, body, False, True), ("https://s.test/many.xml", 200, many, False, True), ("https://s.test/cut.xml", 200, body, True, True), ("https://s.test/no.xml", 200, body, False, False)]
    responses = spark.createDataFrame(rows, "url string, status int, body string, truncated boolean, allowed boolean")
    seeds = spark.createDataFrame([("s", i, f"https://s.test/{n}.xml", "https://s.test") for i, n in enumerate(["0", "many", "cut", "no"])], "site string, pos int, url string, scope string")
    pages, documents = W.sitemap_locs(seeds, responses, K)
    assert pages.count() == 12_002 and documents.count() == 29 and documents.filter("parse_error").count() == 0
    limited, marked = W.sitemap_locs(seeds, responses, K, max_sitemaps=3, max_urls=10_000)
    assert limited.count() == 10_000 and marked.count() == 3 and marked.filter("url_limit_reached").count() == 1


def test_first_n_beyond_the_map_side_limit(spark):
    from vitrine.operators.ranking import first_n

    rows = spark.range(5000).selectExpr("id % 2 as site", "id")
    assert first_n(rows, K, [F.col("id")], 1500).groupBy("site").count().collect()[0]["count"] == 1500
    assert first_n(rows, K, [F.col("id")], None).filter("position = 2500").count() == 2


def test_content_is_a_folder_per_run(spark, tmp_path):
    pages = spark.createDataFrame([("s", 1, "home", "Hi", "u1", "text"), ("s", 2, "blog", None, "u2", "more"), ("r", 3, "blog", "", "u3", "x"), ("s", 4, "blog", "B", "u4", "y")],
                                  "site string, page_no bigint, label string, title string, url string, visible_text string")
    S.write_content(pages, f"file:{tmp_path}/content", K)
    rows = spark.read.parquet(f"file:{tmp_path}/content").collect()
    assert sorted((r.site, r.file) for r in rows) == [("r", "blog"), ("s", "blog"), ("s", "blog-0004"), ("s", "home")]
    assert [r.value for r in rows if r.file == "home"] == ["# Hi\n\nSource: u1\n\ntext\n"]


def test_responses_keep_their_declared_schema(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"url": "https://s.test/", "status": 200, "body": "<p>x</p>", "unknown": 1}\n{"url": "https://s.test/b", "status": "no"}\n')
    rows = S.read_responses(spark, f"file:{tmp_path}/r.json", "json")
    assert set(rows.columns) == set(S.RESPONSES.fieldNames()) and sorted((r.url, r.status) for r in rows.collect()) == [("https://s.test/", 200), ("https://s.test/b", None)]
