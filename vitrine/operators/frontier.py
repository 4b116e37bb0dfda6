"""Robots rules, sitemaps and the breadth-first order of a captured crawl."""

from __future__ import annotations

from functools import reduce
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed_values as fixed
from ..functions.scalars import first_where, let
from ..functions.urls import crawlable, normalize_url, origin, path, query
from ..session import cut
from .ranking import first_n, positions


# ---- robots ------------------------------------------------------------------------------------------------------
def robots_rules(robots: DataFrame, keys: list[str]) -> DataFrame:
    """Declared rules as rows ``(keys, group, agent, at, kind, value)``; ``robots``: keys, text (one bounded file per site).

    A group starts at a user-agent line that follows anything but another one; an empty line ends a group.
    """
    raw = robots.select(*keys, F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("at", "raw"))
    line = F.trim(F.regexp_replace("raw", "#.*$", ""))
    field = F.lower(F.trim(F.split_part(line, F.lit(":"), F.lit(1))))
    kind = F.when(F.col("raw") == "", "blank").when(~line.contains(":"), None).when(field == "user-agent", "agent").when(
        field.isin("allow", "disallow", "crawl-delay"), field)
    value = F.trim(F.regexp_replace(line, "^[^:]*:", ""))
    lines = raw.select(*keys, "at", kind.alias("kind"), value.alias("value")).filter(F.col("kind").isNotNull())
    order = Window.partitionBy(*keys).orderBy("at")
    starts = (F.col("kind") == "agent") & ~F.coalesce(F.lag("kind").over(order) == "agent", F.lit(False))
    edge = F.last(F.when(F.col("kind").isin("agent", "blank"), F.col("kind")), ignorenulls=True).over(order)
    placed = lines.withColumn("group", F.sum(starts.cast("int")).over(order)).withColumn("_edge", edge)
    inside = placed.filter((F.col("kind") != "blank") & (F.col("_edge") == "agent"))
    agents = inside.filter(F.col("kind") == "agent").select(*keys, "group", F.lower("value").alias("agent"))
    rules = inside.filter(F.col("kind") != "agent").select(*keys, "group", "at", "kind", "value")
    return agents.join(rules, [*keys, "group"]).select(*keys, "group", "agent", "at", "kind", "value")


def agent_policies(rules: DataFrame, keys: list[str], agents: list[str]) -> DataFrame:
    """Per site and agent the ordered path rules of the group that applies: its own before ``*``, the first one of each."""
    wanted = F.explode(F.array(*map(F.lit, agents))).alias("bot")
    groups = rules.select(*keys, "group", "agent").distinct().select(*keys, "group", "agent", wanted)
    applies = F.when(F.col("agent") == "*", 1).when(F.lower("bot").contains(F.col("agent")), 0)
    best = groups.withColumn("_rank", applies).filter(F.col("_rank").isNotNull()).groupBy(*keys, "bot").agg(F.min(F.struct("_rank", "group")).alias("b"))
    chosen = best.select(*keys, "bot", F.col("b.group").alias("group"))
    lines = rules.filter(F.col("kind") != "crawl-delay").select(*keys, "group", F.struct("at", "kind", "value").alias("rule")).distinct()
    return chosen.join(lines, [*keys, "group"]).groupBy(*keys, "bot").agg(F.array_sort(F.collect_list("rule")).alias("rules"))


def decoded(text: Column) -> Column:
    """Percent-encoding undone, so that ``/caf%C3%A9``, ``/caf%c3%a9`` and ``/café`` are one path; kept as it is where it is broken."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def rule_allows(url: Column, rules: Column) -> Column:
    """The first rule whose path starts the URL's decides; none allows. Both are compared without percent-encoding."""
    target = let(F.concat(path(url), F.when(query(url) != "", F.concat(F.lit("?"), query(url))).otherwise("")), lambda p: F.when(p == "", "/").otherwise(decoded(p)))

    def decide(where: Column) -> Column:
        hit = F.get(F.filter(rules, lambda r: (r["value"] == "*") | F.startswith(where, decoded(r["value"]))), 0)
        return F.when(hit.isNull(), True).otherwise((hit["kind"] == "allow") | (hit["value"] == ""))

    return let(target, decide)


def robots_access(urls: DataFrame, robots: DataFrame, keys: list[str], agents: list[str] | None = None) -> DataFrame:
    """Whether each agent may fetch each URL. ``robots``: keys, status, text. A missing file (404, 410) allows all, an
    unavailable one leaves it unknown. The agent list is constant, so this is a fan-out, not a join of two tables."""
    bots = agents or fixed.AI_AGENTS
    usable = robots.filter(F.col("status").between(200, 299))
    policy = agent_policies(robots_rules(usable, keys), keys, bots)
    states = robots.select(*keys, F.when(F.col("status").between(200, 299), "available").when(F.col("status").isin(404, 410), "missing").otherwise("unknown").alias("_state"))
    asked = urls.join(states, keys, "left").select(*keys, "url", "_state", F.explode(F.array(*map(F.lit, bots))).alias("bot"))
    joined = asked.join(policy, [*keys, "bot"], "left")
    allowed = F.when(F.col("_state") == "missing", True).when(F.col("_state") == "available", F.coalesce(rule_allows(F.col("url"), F.col("rules")), F.lit(True)))
    rows = joined.select(*keys, "url", "bot", allowed.alias("allowed"))
    return rows.withColumn("status", F.when(F.col("allowed").isNull(), "UNKNOWN").when(F.col("allowed"), "PASS").otherwise("FAIL"))


def bot_access_summary(access: DataFrame, keys: list[str]) -> DataFrame:
    yes = F.coalesce("allowed", F.lit(False))
    return access.groupBy(*keys, "bot").agg(F.count_if(yes).alias("allowed"), F.count_if(~yes).alias("blocked"))


def access_targets(starts: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    return starts.select(*keys, "url").unionByName(pages.select(*keys, "url")).dropDuplicates([*keys, "url"])


# ---- sitemaps ----------------------------------------------------------------------------------------------------
_SITEMAP = "type string, found array<string>, broken boolean"


def read_sitemap(bodies: pd.Series) -> pd.DataFrame:
    """Root kind and the text of every ``loc`` of sitemap documents; ``broken`` where the XML is, or is something else."""
    rows = []
    for body in bodies:
        try:
            root = ElementTree.fromstring(body or "")
            kind = root.tag.rsplit("}", 1)[-1]
            if kind not in ("sitemapindex", "urlset"):
                raise ValueError(kind)
            rows.append((kind, [e.text.strip() for e in root.iter() if isinstance(e.tag, str) and e.tag.rsplit("}", 1)[-1] == "loc" and e.text], False))
        except (ElementTree.ParseError, ValueError):
            rows.append((None, [], True))
    return pd.DataFrame(rows, columns=["type", "found", "broken"])


def sitemap_locs(seeds: DataFrame, responses: DataFrame, keys: list[str], max_sitemaps: int | None = None,
                 max_urls: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Pages listed by the sitemaps of each site, and the sitemap documents read.

    ``seeds``: keys, pos, url, scope (the site's origin). ``responses``: url, status, body and, where known, ``truncated`` and
    ``allowed`` (by robots): a document that is cut off or refused is not read. Index documents lead to more documents: one
    round per level until none is new, none read twice. With ``max_sitemaps`` a site's first documents are read, with
    ``max_urls`` its first pages kept; ``url_limit_reached`` marks documents that list more.
    """
    usable = F.col("status") == 200
    for name, good in (("truncated", False), ("allowed", True)):
        if name in responses.columns:
            usable = usable & F.coalesce(F.col(name), F.lit(good)).eqNullSafe(good)
    docs = responses.select(F.col("url").alias("doc"), "status", F.when(usable, F.col("body")).alias("body"), usable.alias("usable"))
    parse, order = F.pandas_udf(read_sitemap, _SITEMAP), [F.col("level"), F.col("parent"), F.col("at"), F.col("doc")]
    place = F.struct(F.lit(0).alias("level"), F.lit(0).cast("bigint").alias("parent"), F.col("pos").cast("bigint").alias("at"))
    queue = seeds.filter(origin(F.col("url")) == F.col("scope")).groupBy(*keys, "scope", F.col("url").alias("doc")).agg(F.min(place).alias("p")).select(*keys, "scope", "doc", "p.*")
    queue = cut(first_n(queue, keys, order, max_sitemaps, "number").withColumn("number", F.col("number").cast("bigint")))
    read, level = [], 0
    while not queue.isEmpty():
        level += 1
        met = queue.join(docs, "doc", "left").withColumn("x", F.when(F.coalesce("usable", F.lit(False)), parse("body")))
        locs = F.filter(F.transform("x.found", normalize_url), lambda u: u.isNotNull())
        parsed = met.select(*keys, "scope", "doc", "level", "parent", "at", "number", "status", F.col("x.type").alias("type"),
                            F.coalesce(locs, F.array().cast("array<string>")).alias("locs"), F.coalesce("x.broken", F.lit(False)).alias("parse_error"))
        over = F.lit(False) if max_urls is None else F.size("locs") > max_urls
        read.append(cut(parsed.withColumn("url_limit_reached", over)))
        seen = reduce(DataFrame.unionByName, [r.select(*keys, "doc") for r in read])
        children = read[-1].filter(F.col("type") == "sitemapindex").select(*keys, "scope", F.col("number").alias("parent"), F.posexplode("locs").alias("at", "doc"))
        fresh = children.filter(origin(F.col("doc")) == F.col("scope")).join(seen, [*keys, "doc"], "left_anti").groupBy(*keys, "scope", "doc").agg(
            F.min(F.struct(F.lit(level).alias("level"), F.col("parent").cast("bigint").alias("parent"), F.col("at").cast("bigint").alias("at"))).alias("p")).select(*keys, "scope", "doc", "p.*")
        taken = seen.groupBy(*keys).agg(F.count("*").alias("_taken"))
        ranked = first_n(fresh, keys, order, max_sitemaps, "number").join(taken, keys, "left").withColumn("number", F.col("number") + F.coalesce("_taken", F.lit(0)))
        queue = cut((ranked if max_sitemaps is None else ranked.filter(F.col("number") <= max_sitemaps)).drop("_taken"), replaces=queue)
    if not read:
        nothing = queue.select(*keys, "doc", "number", F.lit(None).cast("int").alias("status"), F.lit(None).cast("string").alias("type"), F.lit(0).alias("locs"),
                               F.lit(False).alias("parse_error"), F.lit(False).alias("url_limit_reached"))
        return queue.select(*keys, F.col("doc").alias("url"), F.col("number").alias("place")), nothing
    documents = reduce(DataFrame.unionByName, read)
    listed = documents.filter(F.col("type") == "urlset").select(*keys, "scope", "number", F.posexplode("locs").alias("at", "url")).filter(origin(F.col("url")) == F.col("scope"))
    pages = first_n(listed.groupBy(*keys, "url").agg(F.min(F.struct("number", "at")).alias("first")), keys, [F.col("first"), F.col("url")], max_urls, "place")
    return pages.select(*keys, "url", "place"), documents.select(*keys, "doc", "number", "status", "type", F.size("locs").alias("locs"), "parse_error", "url_limit_reached")


# ---- crawl order -------------------------------------------------------------------------------------------------
def skip_reason(max_depth: int) -> Column:
    """Why a queued URL is not fetched, the first reason that holds; needs depth, url, scope, claimed and allowed."""
    return first_where([
        (F.col("depth") > max_depth, "depth_limit"), (origin(F.col("url")) != F.col("scope"), "external_origin"),
        (~crawlable(F.col("url")), "excluded_path_or_query"), (F.col("claimed"), "duplicate_canonical"),
        (F.col("allowed").eqNullSafe(False), "robots_disallowed"), (F.col("allowed").isNull(), "robots_unknown")])


def edge_frontier(level: DataFrame, links: DataFrame, queued: DataFrame, keys: list[str]) -> DataFrame:
    """New same-origin targets of this level's pages, each at its first mention."""
    met = level.select(*keys, "scope", "seq", F.col("url").alias("source")).join(links, [*keys, "source"])
    inside = met.filter(origin(F.col("target")) == F.col("scope"))
    first = inside.groupBy(*keys, "scope", F.col("target").alias("url")).agg(F.min(F.struct("seq", "pos")).alias("p"))
    return first.join(queued, [*keys, "url"], "left_anti").select(*keys, "scope", "url", F.col("p.seq").alias("parent_seq"), "p.pos")


def crawl_frontier(starts: DataFrame, seeds: DataFrame, pages: DataFrame, links: DataFrame, keys: list[str], max_depth: int = 3,
                   max_pages: int = 50, max_urls: int | None = None) -> DataFrame:
    """Breadth-first order over a captured link graph: page number and depth, or the reason a URL was left out.

    ``starts``: keys, url, scope. ``seeds``: keys, url, pos (sitemap pages, depth 1). ``pages``: keys, url, canonical_url,
    allowed. ``links``: keys, source, pos, target. One round per depth; a site keeps at most ``max_pages`` pages and, where
    set, ``max_urls`` queued URLs; what a limit leaves out comes back with the reason ``page_limit`` or ``queue_limit``. Each
    round's rows are written before the next one reads them.
    """
    first = starts.select(*keys, "scope", "url", F.lit(0).alias("depth"), F.lit(0).cast("bigint").alias("parent_seq"), F.lit(0).cast("bigint").alias("pos"))
    extra = seeds.join(starts.select(*keys, "scope", F.col("url").alias("_start")), keys).filter(F.col("url") != F.col("_start")).groupBy(
        *keys, "scope", "url").agg(F.min("pos").alias("pos")).select(*keys, "scope", "url", F.lit(1).alias("depth"), F.lit(-1).cast("bigint").alias("parent_seq"), F.col("pos").cast("bigint").alias("pos"))
    seeded = cut(extra)
    queue, done, left_out = cut(first), [], []
    facts = pages.select(*keys, "url", "canonical_url", "allowed")
    for depth in range(max_depth + 2):
        before = reduce(DataFrame.unionByName, done) if done else None
        offset = (before.groupBy(*keys).agg(F.max("seq").alias("_seq"), F.max("page_number").alias("_pages")) if before is not None
                  else starts.select(*keys, F.lit(0).cast("bigint").alias("_seq"), F.lit(0).cast("bigint").alias("_pages")))
        placed = positions(queue, keys, [F.col("parent_seq"), F.col("pos"), F.col("url")], "_n").join(facts, [*keys, "url"], "left")
        placed = placed.join(offset, keys, "left").withColumn("seq", F.coalesce("_seq", F.lit(0)) + F.col("_n")).withColumn("_pages", F.coalesce("_pages", F.lit(0)))
        placed = cut(placed.withColumn("canonical_url", F.when(origin(F.col("canonical_url")) == F.col("scope"), F.col("canonical_url"))))
        earlier = before.filter(F.col("page_number").isNotNull() & F.col("canonical_url").isNotNull()).select(
            *keys, F.col("canonical_url").alias("url"), "seq") if before is not None else None
        level = cut(_settle(placed, earlier, keys, max_depth))
        done.append(level)
        fetched = level.filter(F.col("page_number") <= max_pages)
        if depth >= max_depth:
            break
        queued = reduce(DataFrame.unionByName, [d.select(*keys, "url") for d in done] + ([seeded.select(*keys, "url")] if depth == 0 else []))
        fresh = edge_frontier(fetched, links, queued, keys).withColumn("depth", F.lit(depth + 1))
        if depth == 0:
            fresh = fresh.unionByName(seeded)
        if max_urls is not None:
            room = queued.groupBy(*keys).agg(F.count("*").alias("_queued"))
            ranked = cut(first_n(fresh, keys, [F.col("parent_seq"), F.col("pos"), F.col("url")], None, "_n").join(room, keys, "left"))
            fits = (F.col("_n") + F.coalesce("_queued", F.lit(0)) <= max_urls) | (F.col("parent_seq") == -1)
            left_out.append(ranked.filter(~fits).select(*keys, "url", "depth"))
            fresh = ranked.filter(fits).drop("_n", "_queued")
        queue = cut(fresh)
        if queue.isEmpty():
            break
    every = reduce(DataFrame.unionByName, done)
    over = F.col("page_number") > max_pages
    # Once a site has its pages, whatever is still queued was never looked at.
    last = every.filter(F.col("page_number") == max_pages).select(*keys, F.col("seq").alias("_last"))
    joined = every.join(last, keys, "left")
    late = F.coalesce(F.col("seq") > F.col("_last"), F.lit(False))
    judged = joined.select(*keys, "url", "depth", F.when(~over & ~late, F.col("page_number")).alias("page_number"), F.when(over | late, "page_limit").otherwise(F.col("reason")).alias("reason"))
    # A URL that found no room at one depth may have found some at a later one.
    for dropped in left_out:
        unseen = dropped.dropDuplicates([*keys, "url"]).join(judged.select(*keys, "url"), [*keys, "url"], "left_anti")
        judged = judged.unionByName(unseen.select(*keys, "url", "depth", F.lit(None).cast("bigint").alias("page_number"), F.lit("queue_limit").alias("reason")))
    return judged


def _settle(placed: DataFrame, earlier: DataFrame | None, keys: list[str], max_depth: int) -> DataFrame:
    """Reasons and page numbers of one level. A page's canonical keeps later URLs out, unless that page is itself kept
    out; the rounds end when no verdict changes. A claim only reaches later URLs, so verdicts settle from the front."""
    claimed_before = None
    if earlier is not None:
        claimed_before = earlier.select(*keys, "url").distinct().withColumn("_before", F.lit(True))
    rows = placed.join(claimed_before, [*keys, "url"], "left") if claimed_before is not None else placed.withColumn("_before", F.lit(None).cast("boolean"))
    state = rows.withColumn("claimed", F.coalesce("_before", F.lit(False)))
    stable = False
    while not stable:
        state = cut(state)
        kept = state.withColumn("reason", skip_reason(max_depth)).filter(F.col("reason").isNull() & F.col("canonical_url").isNotNull() & (F.col("canonical_url") != F.col("url")))
        claims = kept.groupBy(*keys, F.col("canonical_url").alias("url")).agg(F.min("seq").alias("_claim"))
        nxt = state.join(claims, [*keys, "url"], "left").withColumn("_new", F.coalesce("_before", F.lit(False)) | F.coalesce(F.col("_claim") < F.col("seq"), F.lit(False)))
        changed = nxt.filter(F.col("_new") != F.col("claimed"))
        stable = changed.isEmpty()
        state = nxt.withColumn("claimed", F.col("_new")).drop("_new", "_claim")
    judged = state.withColumn("reason", skip_reason(max_depth))
    numbered = positions(judged.filter(F.col("reason").isNull()), keys, [F.col("seq")], "_page").withColumn("page_number", F.col("_page") + F.col("_pages"))
    columns = [*keys, "scope", "url", "depth", "seq", "canonical_url", "reason", "page_number"]
    return numbered.select(columns).unionByName(judged.filter(F.col("reason").isNotNull()).withColumn("page_number", F.lit(None).cast("bigint")).select(columns))
