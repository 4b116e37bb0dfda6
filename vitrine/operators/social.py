"""Social profiles a site links to, and the social proof its pages show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed_values as fixed
from ..functions.scalars import clip, lookup, strip
from ..functions.urls import hostname, normalize_url, path, without_www
from .ranking import first_n
from .structured import OBJECTS, text_of

FLAGS = "(?iU)"


def social_network(url: Column) -> Column:
    """Network of a profile URL by the domain its host belongs to."""
    domains = "|".join(d.replace(".", r"\.") for d in fixed.NETWORKS)
    return lookup(F.regexp_extract(hostname(url), rf"(?:^|\.)({domains})$", 1), fixed.NETWORKS)


def is_profile(url: Column) -> Column:
    """Not a share button or a single post."""
    pieces = F.split(F.lower(path(url)), "/")
    return ~F.arrays_overlap(pieces, F.array(*map(F.lit, fixed.NOT_A_PROFILE)))


def _same_as() -> Column:
    """``sameAs`` values of the page's own entities."""
    own = F.filter(OBJECTS, lambda o: o["is_entity"] & F.map_contains_key(o["props"], "sameAs"))
    values = F.transform(own, lambda o: F.coalesce(
        F.filter(F.transform(F.from_json(o["props"]["sameAs"], "array<string>"), lambda v: v), lambda v: v.isNotNull()),
        F.array(text_of(o["props"]["sameAs"]))))
    return F.filter(F.flatten(values), lambda v: v.isNotNull() & (v != ""))


def profile_evidence(pages: DataFrame, known: DataFrame | None, keys: list[str]) -> DataFrame:
    """``(keys, url, network, source, method)``: every place that points at a profile, each once."""
    def rows(values: Column, method: str) -> Column:
        return F.transform(values, lambda v: F.struct(v.alias("url"), F.lit(method).alias("method")))

    shared = F.transform(F.filter("metas", lambda m: m["key"].isin("og:see_also", "og:url")), lambda m: m["value"])
    every = F.concat(rows(F.transform("web_links", lambda n: n["url"]), "website-link"), rows(_same_as(), "JSON-LD sameAs"), rows(shared, "OpenGraph"))
    found = pages.select(*keys, F.col("url").alias("source"), (F.col("depth") == 0).alias("home"), F.explode(F.array_distinct(every)).alias("e")).select(
        *keys, "source", "home", normalize_url(F.col("e.url")).alias("url"), "e.method")
    if known is not None:
        found = found.unionByName(known.select(*keys, F.lit("user").alias("source"), F.lit(False).alias("home"),
                                               normalize_url(F.col("url")).alias("url"), F.lit("user-supplied").alias("method")))
    network = F.coalesce(social_network(F.col("url")), F.when(F.col("method").isin("JSON-LD sameAs", "user-supplied"), "other"))
    usable = found.filter(F.col("url").isNotNull()).withColumn("network", network).filter(F.col("network").isNotNull() & is_profile(F.col("url")))
    return usable.groupBy(*keys, "url", "network", "source", "method").agg(F.max("home").alias("home"))


def owner_profiles(evidence: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """Profiles that are the owner's: named in data or tags, linked from the start page, or linked site-wide."""
    totals = pages.groupBy(*keys).agg(F.count("*").alias("_pages"))
    confidence = lookup(F.col("method"), fixed.PROFILE_CONFIDENCE)
    found = evidence.groupBy(*keys, "network", "url").agg(
        F.max(confidence).alias("confidence"), F.count("*").alias("evidence"),
        F.bool_or((F.col("method") != "website-link") | F.col("home")).alias("_vouched"))
    wide = F.col("evidence") >= F.greatest(F.lit(2.0), F.col("_pages") / 3)
    return found.join(totals, keys).filter(F.col("_vouched") | wide).drop("_vouched", "_pages")


def profile_list(profiles: DataFrame, keys: list[str]) -> DataFrame:
    return profiles.select(*keys, "network", "url", F.concat(F.rint(F.col("confidence") * 100).cast("int"), F.lit("%")).alias("confidence"), "evidence")


# ---- social proof ------------------------------------------------------------------------------------------------
def _matches(text: Column, name: str) -> Column:
    return text.rlike(FLAGS + fixed.PROOF_PATTERNS[name])


def _is_name(text: Column) -> Column:
    return text.rlike(rf"(?U)^(?:{fixed.PROOF_PATTERNS['name']})$")


def _sourced_from(pattern: str):
    return lambda source: source.rlike(f"(?i){pattern}")


def _signal(kind: str, example: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), example.cast("string").alias("example"))


def _first(values: Column, test) -> Column:
    return F.get(F.filter(values, test), 0)


def _quoted_line() -> Column:
    """The first line whose quotation stands next to something that reads like a person's name."""
    quote = rf"(?s)^(.*?){fixed.PROOF_PATTERNS['quote']}(.*)$"
    labels = F.concat(F.transform("web_links", lambda n: F.lower(F.trim(n["text"]))), F.transform("headings", lambda h: F.lower(F.trim(h["text"]))))

    def vouches(text: Column) -> Column:
        said = strip(text)
        return F.length(said).between(1, 60) & ~F.array_contains(labels, F.lower(said)) & ~said.rlike(r"\d|:$") & _is_name(said)

    def attributed(line: Column, i: Column) -> Column:
        inner = F.regexp_extract(line, quote, 2)
        near = F.array(F.regexp_extract(line, quote, 1), F.regexp_extract(line, quote, 3),
                       F.when(i > 0, F.get("lines", i - 1)).otherwise(""), F.coalesce(F.get("lines", i + 1), F.lit("")))
        return F.when((inner != "") & ~strip(inner).endswith(","), F.exists(near, vouches)).otherwise(False)

    return F.get(F.filter("lines", attributed), 0)


def proof_signals(pages: DataFrame) -> DataFrame:
    """Adds ``signals ARRAY<STRUCT<kind, example>>``. Needs lines, headings, web_links, script_sources, json_types,
    quotation_candidates, label, trustpilot_widgets and review_count."""
    typed = F.array_sort(F.array_intersect("json_types", F.array(F.lit("AggregateRating"), F.lit("Review"))))
    reviewed = (F.size(typed) > 0) | (F.col("review_count") > 0)
    heads = F.transform("headings", lambda h: h["text"])
    menu = F.transform("web_links", lambda n: F.lower(F.trim(n["text"])))
    short = F.filter("lines", lambda x: (F.length(x) <= 40) & ~F.array_contains(menu, F.lower(x)))
    section = _first(F.concat(heads, short), lambda h: _matches(F.regexp_replace(h, "^[ .:]+|[ .:]+$", ""), "section") & ~_matches(h, "negated"))
    quoted = _quoted_line()
    candidate = _first(F.col("quotation_candidates"), lambda q: (F.coalesce(q["cite"], F.lit("")) != "") | _is_name(F.trim(F.element_at(F.split(q["text"], "\n"), -1))))
    widgets = [F.when(F.exists("script_sources", _sourced_from(pattern))
                      | (F.col("trustpilot_widgets") > 0 if name == "Trustpilot" else F.lit(False)), _signal("review_widget", F.lit(name)))
               for name, pattern in fixed.REVIEW_WIDGETS]
    spoken = F.split(F.array_join(F.filter("lines", lambda x: F.lower(x).contains("trustpilot")), "\n"), r"(?<=[.!?])\s+|\n")
    rating = _first(spoken, lambda s: F.lower(s).contains("trustpilot") & _matches(s, "rating"))
    said = F.filter("web_links", lambda n: _matches(n["url"], "review_href") | _matches(n["text"], "review_text"))
    asked = F.filter("web_links", lambda n: _matches(n["text"], "testimonial_ask"))
    asks = F.concat(F.transform("web_links", lambda n: n["text"]), heads, F.col("lines"))
    referral = _first(asks, lambda s: _matches(s, "referral") & ~_matches(s, "negated"))
    single = [
        F.when(reviewed, _signal("json_ld_reviews", F.concat(F.lit("JSON-LD "), F.when(F.size(typed) > 0, F.array_join(typed, ", ")).otherwise("Review")))),
        F.when(section.isNotNull() | (F.col("label") == "testimonial"), _signal("testimonial_section", F.coalesce(section, F.lit("testimonial page")))),
        F.when(quoted.isNotNull(), _signal("attributed_quote", quoted)),
        F.when(candidate.isNotNull(), _signal("attributed_quote", candidate["text"])), *widgets,
        F.when(rating.isNotNull(), _signal("rating_text", F.regexp_replace(rating, r"\.+$", "")))]
    links = F.concat(F.transform(said, lambda n: _signal("review_link", F.coalesce(F.nullif(n["text"], F.lit("")), n["url"]))),
                     F.transform(asked, lambda n: _signal("testimonial_ask", n["text"])))
    return pages.withColumn("signals", F.concat(F.array_compact(F.array(*single)), links,
                                                F.array_compact(F.array(F.when(referral.isNotNull(), _signal("referral_ask", referral))))))


def signals_union(pages: DataFrame, keys: list[str]) -> DataFrame:
    return pages.select(*keys, "page_no", "url", F.posexplode("signals").alias("pos", "s")).select(*keys, "page_no", "url", "pos", "s.kind", "s.example")


def proof_counts(pages: DataFrame, keys: list[str]) -> DataFrame:
    kinds = F.array_distinct(F.transform("signals", lambda s: s["kind"]))
    return pages.select(*keys, F.explode(kinds).alias("kind")).groupBy(*keys, "kind").agg(F.count("*").alias("pages"))


def proof_summary(pages: DataFrame, keys: list[str]) -> DataFrame:
    """PASS when a site both shows proof and asks for it, WARNING for one, FAIL for neither."""
    shown = F.exists("signals", lambda s: s["kind"].isin(fixed.PROOF_KINDS))
    asked = F.exists("signals", lambda s: s["kind"].isin(fixed.ASK_KINDS))
    found = pages.groupBy(*keys).agg(F.count("*").alias("pages_checked"), F.count_if(shown).alias("pages_with_proof"),
                                     F.bool_or(shown).alias("has_proof"), F.bool_or(asked).alias("has_ask"))
    return found.withColumn("status", F.when(F.col("has_proof") & F.col("has_ask"), "PASS").when(F.col("has_proof") | F.col("has_ask"), "WARNING").otherwise("FAIL"))


def proof_examples(pages: DataFrame, keys: list[str], limit: int | None = fixed.EXAMPLES) -> DataFrame:
    """The first examples of a site, one per kind and page, clipped."""
    firsts = F.filter("signals", lambda s, i: F.array_position(F.transform("signals", lambda x: x["kind"]), s["kind"]) == i + 1)
    rows = pages.select(*keys, "page_no", "url", F.posexplode(firsts).alias("pos", "s")).select(
        *keys, "page_no", "url", "pos", "s.kind", clip(F.col("s.example"), fixed.EXAMPLE_MAX).alias("example"))
    return first_n(rows, keys, [F.col("page_no"), F.col("pos")], limit, "place")


def review_profiles(pages: DataFrame, keys: list[str]) -> DataFrame:
    """The first profile per review platform; a Trustpilot page counts only when it is about a crawled host."""
    hosts = pages.select(*keys, without_www(hostname(F.col("url"))).alias("about")).distinct()
    platform = F.array_compact(F.array(*[F.when(F.col("l.url").rlike(f"(?i){p}"), F.lit(n)) for n, p in fixed.REVIEW_PROFILES]))
    links = pages.select(*keys, "page_no", F.posexplode("web_links").alias("pos", "l")).withColumn("platforms", platform).filter(F.size("platforms") > 0)
    links = links.select(*keys, "page_no", "pos", F.col("l.url").alias("profile"), F.explode("platforms").alias("platform"))
    elsewhere = F.lower("profile").contains("trustpilot.com/")
    about = without_www(F.lower(F.regexp_extract("profile", r"(?i)trustpilot\.com/(?:review|evaluate)/([^/?#]+)", 1)))
    own = links.filter(elsewhere).withColumn("about", about).join(hosts, [*keys, "about"], "left_semi").drop("about")
    first = F.min_by("profile", F.struct("page_no", "pos"))
    return links.filter(~elsewhere).unionByName(own).groupBy(*keys, "platform").agg(first.alias("profile"))


def google_reviews(found: Column, reviews: Column, status: Column) -> Column:
    """Whether Google's part of social proof is bad; NULL when the listing was not checked."""
    return F.when(status.isNull() | (status == "UNKNOWN"), None).otherwise(~F.coalesce(found, F.lit(False)) | (F.coalesce(reviews, F.lit(0)) == 0))

