"""Structured data: objects of embedded JSON-LD, their issues, and entities across a site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed_values as fixed

OBJECTS = "dom.objects"


def text_of(json: Column) -> Column:
    """A JSON value as text: strings without their quotes, NULL for null."""
    return F.get_json_object(F.concat(F.lit("["), json, F.lit("]")), "$[0]")


def empty(json: Column) -> Column:
    return json.isNull() | json.isin("null", '""', "[]", "{}")


def prop(obj: Column, name: str | Column) -> Column:
    return F.try_element_at(obj["props"], F.lit(name) if isinstance(name, str) else name)


def is_a(obj: Column, name: str) -> Column:
    return F.array_contains(obj["types"], name)


def _any_of(obj: Column, names: list[str]) -> Column:
    return F.arrays_overlap(obj["types"], F.array(*map(F.lit, names)))


def jsonld_objects(pages: DataFrame, keys: list[str]) -> DataFrame:
    """Every object of every document, depth first, with the object it sits in."""
    return pages.select(*keys, "url", F.explode(OBJECTS).alias("o")).select(*keys, "url", "o.*")


def _issue(severity: str, kind: Column, code: str, property_: Column | None = None) -> Column:
    return F.struct(F.lit(severity).alias("severity"), kind.cast("string").alias("type"), F.lit(code).alias("code"),
                    (F.lit(None) if property_ is None else property_).cast("string").alias("property"))


def _rules() -> Column:
    rows = [F.struct(F.lit(kind).alias("type"), F.lit(name).alias("prop"), F.lit(severity).alias("severity"), F.lit(code).alias("code"))
            for kind, (required, recommended) in fixed.TYPE_RULES.items()
            for names, severity, code in ((required, "error", "missing_required"), (recommended, "warning", "missing_recommended")) for name in names]
    return F.array(*rows)


def _property_issues() -> Column:
    """Missing properties of the objects a page is responsible for: documents, graph members and identified objects."""
    owned = F.filter(OBJECTS, lambda o: o["is_node"] | F.map_contains_key(o["props"], "@id"))

    def applies(o: Column, rule: Column) -> Column:
        local = _any_of(o, fixed.LOCAL_BUSINESS)
        named = F.array_contains(o["types"], rule["type"]) & ~((rule["type"] == "Organization") & local)
        return named | ((rule["type"] == "LocalBusiness") & local) | ((rule["type"] == "Article") & _any_of(o, fixed.ARTICLE))

    return F.flatten(F.transform(owned, lambda o: F.transform(
        F.filter(_rules(), lambda r: applies(o, r) & empty(prop(o, r["prop"]))),
        lambda r: F.struct(r["severity"].alias("severity"), r["type"].alias("type"), r["code"].alias("code"), r["prop"].alias("property")))))


def _spoken(text: Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(text, r"(?U)\W+", " ")))


def _question_issues() -> Column:
    answer = lambda o: F.get_json_object(prop(o, "acceptedAnswer"), "$.text")
    incomplete = lambda o: empty(prop(o, "name")) | answer(o).isNull() | answer(o).isin("", "[]", "{}")
    page = _spoken(F.array_join("lines", "\n"))
    unseen = lambda o: (F.size("lines") > 0) & ~page.contains(_spoken(text_of(prop(o, "name"))))
    questions = F.filter(OBJECTS, lambda o: is_a(o, "Question"))
    kind = F.lit("Question")
    return F.filter(F.transform(questions, lambda o: F.when(incomplete(o), _issue("error", kind, "incomplete_question")).when(
        unseen(o), _issue("warning", kind, "faq_not_visible"))), lambda i: i.isNotNull())


def _defined(obj: Column) -> Column:
    return F.map_contains_key(obj["props"], "@id") & (F.cardinality(obj["props"]) > 1)


def unresolved_refs() -> Column:
    """Ids that are only referred to and defined nowhere on the page."""
    ids = F.transform(F.filter(OBJECTS, _defined), lambda o: prop(o, "@id"))
    refs = F.filter(OBJECTS, lambda o: F.map_contains_key(o["props"], "@id") & (F.cardinality(o["props"]) == 1))
    return F.filter(F.transform(refs, lambda o: prop(o, "@id")), lambda r: ~F.array_contains(ids, r))


def _names() -> Column:
    """Distinct ``(id, name)`` of the page's definitions."""
    named = F.filter(OBJECTS, lambda o: _defined(o) & ~empty(prop(o, "name")))
    return F.array_distinct(F.transform(named, lambda o: F.struct(text_of(prop(o, "@id")).alias("id"), text_of(prop(o, "name")).alias("name"))))


def conflicting_ids() -> Column:
    """Ids defined on the page under more than one name."""
    ids = F.transform(_names(), lambda n: n["id"])
    return F.filter(F.array_distinct(ids), lambda i: F.size(F.filter(ids, lambda j: j == i)) > 1)


def with_issues(pages: DataFrame) -> DataFrame:
    """Adds ``issues ARRAY<STRUCT<severity, type, code, property>>`` to pages with ``dom`` and ``lines``."""
    none = F.lit(None).cast("string")
    contexts = F.filter(OBJECTS, lambda o: (o["depth"] == 0) & ~F.coalesce(prop(o, "@context").contains("schema.org"), F.lit(False)))
    items = F.filter(OBJECTS, lambda o: is_a(o, "ListItem") & (empty(prop(o, "position")) | (
        empty(prop(o, "name")) & ~F.coalesce(prop(o, "item").startswith("{"), F.lit(False)))))
    mixed = F.filter(OBJECTS, lambda o: is_a(o, "Person") & is_a(o, "Organization"))
    return pages.withColumn("issues", F.concat(
        F.transform(contexts, lambda o: _issue("error", none, "missing_context")), _property_issues(), _question_issues(),
        F.transform(items, lambda o: _issue("error", F.lit("BreadcrumbList"), "incomplete_list_item")),
        F.transform(mixed, lambda o: _issue("warning", F.lit("Organization"), "person_organization_conflation")),
        F.transform(unresolved_refs(), lambda r: _issue("warning", none, "unresolved_reference")),
        F.transform(conflicting_ids(), lambda i: _issue("error", none, "conflicting_id"))))


def issue_summary(pages: DataFrame, keys: list[str]) -> DataFrame:
    """Pages affected, not occurrences, per kind of issue."""
    return pages.select(*keys, F.explode(F.array_distinct("issues")).alias("i")).groupBy(
        *keys, "i.severity", "i.code", "i.type", "i.property").agg(F.count("*").alias("pages"))


def schema_type_counts(pages: DataFrame, keys: list[str]) -> DataFrame:
    return pages.select(*keys, F.explode("json_types").alias("type")).groupBy(*keys, "type").agg(F.count("*").alias("pages"))


def schema_coverage(pages: DataFrame, keys: list[str]) -> DataFrame:
    return pages.groupBy(*keys).agg(F.count("*").alias("pages_checked"), F.count_if(F.col("dom.json_documents") > 0).alias("pages_with_json_ld"),
                                    F.count_if(F.col("dom.json_errors") > 0).alias("pages_with_syntax_errors"))


def site_entities(pages: DataFrame, keys: list[str]) -> DataFrame:
    """Per ``@id`` of a site: pages defining it, distinct names, and whether the names conflict."""
    ids = F.array_distinct(F.transform(F.filter(OBJECTS, _defined), lambda o: text_of(prop(o, "@id"))))
    pages_per_id = pages.select(*keys, F.explode(ids).alias("id")).groupBy(*keys, "id").agg(F.count("*").alias("pages"))
    names = entity_names(pages, keys).groupBy(*keys, "id").agg(F.count("*").alias("names"), F.min("name").alias("first_name"))
    return pages_per_id.join(names, [*keys, "id"], "left").na.fill(0, ["names"]).withColumn("conflict", F.col("names") > 1)


def entity_names(pages: DataFrame, keys: list[str]) -> DataFrame:
    return pages.select(*keys, F.explode(_names()).alias("n")).groupBy(*keys, "n.id", "n.name").agg(F.count("*").alias("pages"))


def faqs(pages: DataFrame, keys: list[str]) -> DataFrame:
    found = F.filter(OBJECTS, lambda o: is_a(o, "Question"))
    return pages.select(*keys, "url", F.explode(found).alias("o")).select(
        *keys, "url", text_of(F.col("o.props")["name"]).alias("question"), F.get_json_object(F.col("o.props")["acceptedAnswer"], "$.text").alias("answer"))


def review_count() -> Column:
    return F.size(F.filter(OBJECTS, lambda o: is_a(o, "Review")))


def testimonials(pages: DataFrame, keys: list[str]) -> DataFrame:
    found = F.filter(OBJECTS, lambda o: is_a(o, "Review"))
    return pages.select(*keys, "url", F.explode(found).alias("o")).select(
        *keys, "url", text_of(F.col("o.props")["reviewBody"]).alias("text"), text_of(F.col("o.props")["author"]).alias("author"))


def postal_addresses(pages: DataFrame, keys: list[str]) -> DataFrame:
    """Structured addresses of a page: every property but the context, as text."""
    found = F.filter(OBJECTS, lambda o: is_a(o, "PostalAddress"))
    fields = F.map_filter(F.col("o.props"), lambda k, _: k != "@context")
    return pages.select(*keys, "url", F.explode(found).alias("o")).select(*keys, "url", F.transform_values(fields, lambda _, v: text_of(v)).alias("address"))


def company_names(pages: DataFrame, keys: list[str]) -> DataFrame:
    """Names a site's own business entities state, with the pages stating each."""
    own = F.filter(OBJECTS, lambda o: o["is_entity"] & _any_of(o, fixed.ORG_TYPES) & ~empty(prop(o, "name")))
    return pages.select(*keys, F.explode(F.transform(own, lambda o: text_of(prop(o, "name")))).alias("name")).groupBy(
        *keys, "name").agg(F.count("*").alias("pages"))
