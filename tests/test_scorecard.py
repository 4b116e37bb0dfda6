from vitrine.operators import dashboard as B, scorecard as S

K = ["site"]
IMPACT = "struct<headline:string,loss_type:string,who:string,mechanism:string,magnitude:string>"


def setup(spark):
    pool = spark.createDataFrame([("a", "F1", "FAIL", ("Lost", "leads", "w", "m", "high")), ("a", "F2", "PASS", None), ("a", "G1", "fail", ("Gone", "trust", "w", "m", "low")),
                                  ("a", "G2", "WARNING", None)], f"site string, finding_id string, severity string, impact {IMPACT}")
    claims = spark.createDataFrame([("a", "google_business", "G1"), ("a", "google_business", "G2"), ("a", "google_business", "unknown")], "site string, area string, finding_id string")
    verdicts = spark.createDataFrame([("a", "technical_marketing", "PASS"), ("a", "technical_marketing", "WARNING"), ("a", "copy", "PASS"), ("a", "meta_ads", "UNKNOWN")],
                                     "site string, area string, verdict string")
    return pool, claims, verdicts


def test_scores_goal_and_split(spark):
    pool, claims, verdicts = setup(spark)
    areas = S.area_scores(S.resolve_findings(claims, pool, K), verdicts, K)
    rows = {r.area: r for r in areas.collect()}
    assert {a: r.score for a, r in rows.items()} == {"website": 50, "google_business": 25, "technical_marketing": 75, "copy": 100, "meta_ads": None}
    assert (rows["google_business"].fail, rows["google_business"].warning) == (1, 1)
    overall = S.overall_and_goal(areas, spark.createDataFrame([("a", 2000, 10)], "site string, ltv bigint, customers bigint"), K)
    o = overall.first()
    assert (o.overall, o.goal, o.at_risk, o.monthly) == (62, 20000, 7600, 633)
    split = {r.area: r.at_risk for r in S.value_at_risk_split(areas, overall, K).collect()}
    assert split == {"website": 2533, "google_business": 3800, "technical_marketing": 1267, "copy": 0, "meta_ads": None}


def test_no_money_without_a_goal(spark):
    pool, claims, verdicts = setup(spark)
    areas = S.area_scores(S.resolve_findings(claims, pool, K), verdicts, K)
    o = S.overall_and_goal(areas, spark.createDataFrame([("a", None, 10)], "site string, ltv bigint, customers bigint"), K).first()
    assert (o.goal, o.at_risk) == (None, None)


def test_ranked_findings_fall_back_to_magnitude(spark):
    pool, _, _ = setup(spark)
    ranked = spark.createDataFrame([("a", ["gone"])], "site string, ranked array<string>")
    assert [r.finding_id for r in S.rank_findings(pool, ranked, K).orderBy("place").collect()] == ["F1", "G1"]
    ranked = spark.createDataFrame([("a", ["G1", "F1"])], "site string, ranked array<string>")
    assert [r.finding_id for r in S.rank_findings(pool, ranked, K).orderBy("place").collect()] == ["G1", "F1"]


def test_work_items_need_evidence(spark):
    lists = {"seo": spark.createDataFrame([("a",), ("a",)], "site string"), "questions": spark.createDataFrame([], "site string")}
    findings = spark.createDataFrame([("a", "questions", "F1"), ("a", "security-headers", "F2")], "site string, slug string, finding_id string")
    tasks = B.work_items(lists, findings, K)
    assert {r.slug for r in tasks.collect()} == {"seo", "security-headers"}
    ranked = spark.createDataFrame([("a", "F2", 1)], "site string, finding_id string, place int")
    assert [r.slug for r in B.ordered_tasks(tasks, findings, ranked, K).collect()] == ["security-headers", "seo"]
    assert B.work_items({"seo": lists["questions"]}, findings.limit(0), K).isEmpty()
