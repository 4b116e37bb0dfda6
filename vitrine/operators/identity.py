"""Identity profile of a site, its Google listing, and how the two agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed_values as fixed
from ..functions.identity import same_name
from ..functions.scalars import blank, clean, digits, let, n_words, squeeze, strip, titlecase_split
from ..functions.urls import host
from .structured import OBJECTS, text_of

SOURCE_ORDER = {"user": 0, "json-ld": 1, "tel": 2, "site-read": 3, "discovered": 4}


def json_ld_values(pages: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, kind, value, page_no, pos)`` that a site's business entities state: names, cities, phones, categories."""
    org = F.filter(OBJECTS, lambda o: o["is_entity"] & (
        F.arrays_overlap(o["types"], F.array(*map(F.lit, fixed.ORG_TYPES)))
        | ((F.size(o["types"]) > 0) & F.map_contains_key(o["props"], "name") & F.map_contains_key(o["props"], "address"))))
    rows = pages.select(*keys, "page_no", F.col(OBJECTS).alias("all"), F.explode(org).alias("o"))

    def many(json: Column) -> Column:
        return let(json, lambda j: F.coalesce(F.from_json(j, "array<string>"), F.array(text_of(j))))

    def tag(kind: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    props = F.col("o.props")
    names = F.concat(*[F.coalesce(many(props[n]), F.array().cast("array<string>")) for n in ("name", "alternateName", "legalName")])
    places = F.filter("all", lambda a: (a["block"] == F.col("o.block")) & (a["parent"] == F.col("o.seq")) & (a["key"] == "address"))
    cities = F.transform(places, lambda a: text_of(F.try_element_at(a["props"], F.lit("addressLocality"))))
    phones = F.transform(F.coalesce(many(props["telephone"]), F.array().cast("array<string>")), digits)
    kinds = F.transform(F.filter(F.col("o.types"), lambda k: ~k.isin(fixed.GENERIC_TYPES)), titlecase_split)
    every = F.concat(tag("cities", cities), tag("names", names), tag("phones", phones), tag("categories", kinds))
    return rows.select(*keys, "page_no", F.col("o.seq").alias("seq"), F.posexplode(every).alias("pos", "v")).select(
        *keys, "v.kind", "v.value", F.struct("page_no", "seq", "pos").alias("at"))


def identity_profile(values: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct values per kind, the first spelling kept. ``values``: keys, kind, value, source_rank, at (orderable)."""
    usable = values.filter(~blank(F.col("value"))).withColumn("value", strip(F.col("value")))
    order = F.struct("source_rank", "at")
    return usable.groupBy(*keys, "kind", F.lower("value").alias("_low")).agg(
        F.min_by("value", order).alias("value"), F.min(order).alias("first")).drop("_low")


def profile_arrays(profile: DataFrame, keys: list[str], kinds: list[str]) -> DataFrame:
    """One row per site with an ordered list per kind: the form checks compare against."""
    lists = [F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("first", "value")))), lambda x: x["value"]).alias(k) for k in kinds]
    return profile.groupBy(*keys).agg(*lists)


def suggest_profile(sites: DataFrame, latest: DataFrame, fields: list[str]) -> DataFrame:
    """Blank fields of a site filled from its latest identity profile."""
    found = latest.select("site", *[F.col(f).alias(f"_{f}") for f in fields])
    filled = [F.coalesce(F.nullif(strip(F.col(f)), F.lit("")), F.col(f"_{f}")).alias(f) for f in fields]
    return sites.join(found, "site", "left").select("site", *filled)


# ---- listing -----------------------------------------------------------------------------------------------------
def matched_by(website: Column, phones: list[Column], domain: Column, known: Column) -> Column:
    listed = F.filter(F.array(*[digits(p) for p in phones]), lambda p: p != "")
    return F.when(host(website) == domain, "website").when(F.arrays_overlap(listed, known), "phone")


def listing_match(places: DataFrame, profiles: DataFrame, keys: list[str]) -> DataFrame:
    """The first candidate of a site's search that is tied to it by website, else phone; namesakes never match.

    ``places``: keys, pos, place_id, website, phone, phone_intl. ``profiles``: keys, domain, phones[].
    """
    joined = places.join(profiles.select(*keys, "domain", "phones"), keys).withColumn(
        "matched_by", matched_by(F.col("website"), [F.col("phone"), F.col("phone_intl")], F.col("domain"), F.col("phones")))
    best = joined.groupBy(*keys).agg(F.count("*").alias("candidates"), F.min_by(
        F.when(F.col("matched_by").isNotNull(), F.struct("place_id", "matched_by")), F.when(F.col("matched_by").isNotNull(), F.col("pos"))).alias("m"))
    return best.select(*keys, "candidates", "m.place_id", "m.matched_by", F.col("m").isNotNull().alias("found"))


def listing_compare(listings: DataFrame, profiles: DataFrame, keys: list[str]) -> DataFrame:
    """One row per fact: what the listing says, what the site says, and match, variant, differs or NULL."""
    joined = listings.join(profiles.select(*keys, "domain", "names", "phones", "categories", "site_text"), keys)
    phone = digits(F.coalesce(F.nullif("phone", F.lit("")), "phone_intl"))
    verdict = lambda ok: F.when(ok, "match").when(~ok, "differs")
    number = F.concat(F.lit(r"(?<![0-9])\Q"), "street_number", F.lit(r"\E(?![0-9])"))
    facts = [
        ("name", F.col("name"), F.get("names", 0), same_name(F.col("name"), F.col("names"))),
        ("phone", F.col("phone"), F.nullif(F.array_join("phones", ", "), F.lit("")),
         verdict(F.when((phone != "") & (F.size("phones") > 0), F.array_contains("phones", phone)))),
        ("website", F.col("website"), F.col("domain"), verdict(F.when(F.coalesce("website", F.lit("")) != "", F.coalesce(host(F.col("website")), F.lit("")) == F.col("domain")))),
        ("postal_code", F.col("postal_code"), F.lit(None).cast("string"), verdict(squeeze(F.col("site_text")).contains(squeeze(F.col("postal_code"))))),
        ("street_number", F.col("street_number"), F.lit(None).cast("string"), verdict(F.regexp_like("site_text", number))),
        ("category", F.col("category"), F.nullif(F.array_join("categories", ", "), F.lit("")), F.lit(None).cast("string"))]
    rows = F.array(*[F.struct(F.lit(f).alias("field"), g.alias("listing"), s.alias("site_value"), a.alias("agrees")) for f, g, s, a in facts])
    return joined.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*")


EDITABLE = ["title", "phone", "website", "description"]


def profile_field_mismatch(locations: DataFrame, profiles: DataFrame, keys: list[str]) -> DataFrame:
    """Editable listing fields the site's profile states differently."""
    want = profiles.select(*keys, *[F.coalesce(f, F.lit("")).alias(f"_{f}") for f in EDITABLE])
    joined = locations.select(*keys, *[F.coalesce(f, F.lit("")).alias(f) for f in EDITABLE]).join(want, keys)
    last_ten = lambda c: F.right(F.regexp_replace(c, r"\D", ""), F.lit(10))
    shape = {"phone": last_ten, "website": lambda c: F.coalesce(host(c), F.lit(""))}
    norm = lambda f, c: shape.get(f, lambda x: F.lower(clean(x)))(c)
    rows = F.array_compact(F.array(*[F.when((strip(F.col(f"_{f}")) != "") & (norm(f, F.col(f)) != norm(f, F.col(f"_{f}"))), F.struct(
        F.lit(f).alias("field"), F.col(f).alias("current"), F.col(f"_{f}").alias("proposed"))) for f in EDITABLE]))
    return joined.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*")


def location_match(website: Column, phone: Column, own_website: Column, own_phone: Column) -> Column:
    same_host = host(website).isNotNull() & (host(website) == host(own_website))
    return F.coalesce(same_host, F.lit(False)) | ((digits(phone) != "") & (digits(phone) == digits(own_phone)))


def review_stats(reviews: DataFrame, keys: list[str], detailed: int = 20) -> DataFrame:
    """Sample size, latest and oldest review and how many are detailed. Reviewer names are not among the columns."""
    return reviews.groupBy(*keys).agg(
        F.count("*").alias("sample"), F.max("published").alias("sample_latest"), F.min("published").alias("sample_oldest"),
        F.count_if(n_words(F.col("text")) >= detailed).alias("sample_detailed"))
