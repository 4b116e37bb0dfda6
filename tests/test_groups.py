import pytest
from pyspark.sql import functions as F

from vitrine.operators import copy_scores as K, lines as L, ranking as R, visibility as V
from vitrine.sources import capture as S

KEYS = ["site"]


@pytest.fixture
def no_choice(spark):
    """Spark does not send a side to every task by itself, as where it cannot know that the side is small."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for name in names:
        spark.conf.set(name, "-1")
    yield
    for name in names:
        spark.conf.unset(name)


def tasks(rows):
    return rows.select(F.spark_partition_id().alias("p")).distinct().count()


def one_site(spark, n=40):
    body = F.concat(F.lit("Home\npage number "), "id", F.lit(" has its own line\nthe last one"))
    rows = spark.range(0, n, 1, 4).select(F.lit("s").alias("site"), F.col("id").alias("page_no"), F.lit("a").alias("label"), body.alias("visible_text"))
    return rows.withColumn("lines", F.split("visible_text", "\n"))


def test_pages_of_one_site_are_read_and_scored_in_several_tasks(spark, no_choice):
    pages = one_site(spark)
    bodies = L.page_bodies(pages, KEYS)
    assert tasks(bodies) > 1 and bodies.filter("chrome_lines_removed = 2").count() == 40
    scored = K.score_pages(pages, KEYS)
    assert tasks(scored) > 1 and scored.count() == 40
    assert {(r.line, r.pages) for r in L.chrome_lines(pages, KEYS).collect()} == {("Home", 40), ("the last one", 40)}


def test_answers_of_one_site_meet_its_profile_in_several_tasks(spark, no_choice):
    company = F.struct(F.lit("Acme").alias("name"), F.lit(None).cast("string").alias("website"), F.lit(None).cast("string").alias("city"),
                       F.lit(1.0).alias("position"), F.lit(0.5).alias("sentiment"))
    answers = spark.range(0, 40, 1, 4).select(F.lit("s").alias("site"), F.col("id").alias("answer_id"), F.lit("q").alias("prompt"), F.lit(None).cast("string").alias("error"),
                                              F.array(company).alias("companies"))
    profile = spark.createDataFrame([("s", "acme.test", ["Acme"], [])], "site string, domain string, names array<string>, cities array<string>")
    mentions = V.answer_positions(answers, profile, KEYS)
    assert tasks(mentions) > 1 and mentions.filter("is_target").count() == 40
    rank = V.target_rank(V.leaderboard(mentions, KEYS), KEYS).first()
    assert (rank["rank"], rank["companies"]) == (1, 1)


def test_digest_of_one_site_is_made_in_several_tasks(spark, no_choice):
    pages = one_site(spark).select("site", "page_no", F.lit("h").alias("head"), F.col("visible_text").alias("body"))
    reports = spark.createDataFrame([("s", 1, "r")], "site string, pos int, text string")
    parts = S.corpus_digest(reports, pages, KEYS)
    assert parts.count() == 41 and tasks(parts.filter("part = 'page'")) > 1


@pytest.mark.parametrize("few", [10_000, 0])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_rows_beside_their_group_equal_a_join(spark, monkeypatch, few, how):
    monkeypatch.setattr(R, "FEW_GROUPS", few)
    rows = spark.createDataFrame([(None if i % 5 == 0 else f"s{i % 4}", i // 2, {"k": i}) for i in range(60)], "site string, n int, extra map<string,int>")
    groups = spark.createDataFrame([("s1", 1), ("s2", 2), ("s2", 3), ("s9", 4), (None, 5)], "site string, v int")
    got, want = R.beside(rows, groups, KEYS, how), rows.join(groups, KEYS, how)
    assert got.columns == want.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_pages_are_parsed_once_for_all_lists(spark, tmp_path, monkeypatch):
    from vitrine.plans import derived as D
    from vitrine.plans.registry import RUN
    import vitrine.plans.worklists  # noqa: F401

    spark.createDataFrame([(i, f"https://h{i % 2}.test/{i}", "<html><head></head><body><p>x</p><footer></footer></body></html>") for i in range(6)],
                          "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(1, 0, "user", "why?")], "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(1, 1, "Ann")], "c_custkey bigint, c_nationkey bigint, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(1, "N")], "n_nationkey bigint, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    parses, parse = [], D.parse_html
    monkeypatch.setattr(D, "parse_html", lambda pages: parses.append(1) or parse(pages))
    assert RUN["work_item_lists"](spark, str(tmp_path)).count() > 0 and len(parses) == 1


def test_only_pairs_that_a_quote_asks_for_are_kept(spark, monkeypatch):
    from vitrine.operators import evidence as E

    kept, cut = [], E.cut
    monkeypatch.setattr(E, "cut", lambda rows: kept.append(rows) or cut(rows))
    pages = spark.createDataFrame([("s", i, f"https://s.test/{i}", " ".join(f"w{i}x{j}" for j in range(100))) for i in range(10)], "site string, place int, url string, visible_text string")
    claims = spark.createDataFrame([("s", "x3 w4x4 w4x5 W4X6  w4")], "site string, quote string")
    assert [(r.place, r.url) for r in E.quoted_on(claims, pages, ["site"]).collect()] == [(4, "https://s.test/4")]
    assert [rows.count() for rows in kept if "gram" in rows.columns] == [2]
