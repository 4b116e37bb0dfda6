"""Who a company is: keys, targets, cities, phones and the verdict on stated facts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .scalars import blank, digits, squeeze, strip, whole_word
from .urls import belongs_to, host


def company_key(name: Column, website: Column) -> Column:
    """Website host when usable, else the lower-case name."""
    return F.coalesce(F.nullif(host(website), F.lit("")), F.lower(strip(name)))


def same_city(city: Column, cities: Column) -> Column:
    """Whether the city is one of the site's; NULL when either side names none."""
    low = F.lower(city)
    return F.when(~blank(city) & (F.size(cities) > 0), F.exists(cities, lambda c: whole_word(low, F.lower(c), "[a-z]", "")))


def is_target(key: Column, name: Column, domain: Column, names: Column, city: Column, cities: Column) -> Column:
    """A stated website decides; otherwise the name must be the site's and not placed in another city."""
    spelled = F.replace(key, F.lit(" "), F.lit(""))
    known = F.concat(F.array(F.split_part(domain, F.lit("."), F.lit(1))),
                     F.transform(names, lambda n: F.replace(F.lower(n), F.lit(" "), F.lit(""))))
    by_name = ((key == domain) | ((spelled != "") & F.array_contains(known, spelled))) & F.coalesce(same_city(city, cities), F.lit(True))
    return F.when(key != F.lower(strip(name)), key == domain).otherwise(by_name)


def rating(value: Column) -> Column:
    """Sentiment clamped to -1..1; NaN is no rating."""
    number = F.nanvl(value.cast("double"), F.lit(None).cast("double"))
    return F.when(number.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), number)))


def same_name(listed: Column, names: Column) -> Column:
    """``match``, ``variant`` (one contains the other), ``differs``, or NULL when either side is missing."""
    mine = squeeze(listed)
    have = F.filter(F.transform(names, squeeze), lambda n: n != "")
    return F.when(blank(listed) | (F.size(names) == 0), None).when(
        F.exists(F.transform(names, squeeze), lambda n: n == mine), "match").when(
        F.exists(have, lambda n: mine.contains(n) | n.contains(mine)), "variant").otherwise("differs")


def fact_results(stated: dict[str, Column], profile: dict[str, Column]) -> dict[str, Column]:
    """Each stated fact against the profile: agrees, differs, or NULL when it cannot be compared."""
    site = F.nullif(host(stated["website"]), F.lit(""))
    owned = F.concat(F.array(profile["domain"]), F.transform(profile["profiles"], host))
    phone, category = digits(stated["phone"]), F.lower(stated["category"])
    return {
        "website": F.when(site.isNotNull(), F.array_contains(owned, site) | belongs_to(site, profile["domain"])),
        "city": same_city(stated["city"], profile["cities"]),
        "phone": F.when((phone != "") & (F.size(profile["phones"]) > 0), F.array_contains(profile["phones"], phone)),
        "category": F.when(category.isNotNull() & F.exists(profile["categories"], lambda c: category.contains(F.lower(c))), F.lit(True)),
    }


def identity_check(stated: dict[str, Column], profile: dict[str, Column], given: Column) -> Column:
    """``verdict``, ``agree``, ``echoed``, ``conflict``. Facts the prompt gave away prove nothing when repeated."""
    results = fact_results(stated, profile)

    def facts(wanted: bool) -> Column:
        return F.array_compact(F.array(*[F.when(ok.eqNullSafe(wanted), F.lit(fact)) for fact, ok in results.items()]))

    agree, conflict = facts(True), facts(False)
    independent = F.array_except(agree, given)
    verdict = F.when(F.size(conflict) > 0, "mismatch").when(F.size(independent) > 0, "confirmed").otherwise("unconfirmed")
    return F.struct(verdict.alias("verdict"), independent.alias("agree"), F.array_intersect(agree, given).alias("echoed"), conflict.alias("conflict"))
