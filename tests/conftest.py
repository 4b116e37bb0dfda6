import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from vitrine.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session("tests", "local[4]", shuffle_partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def page(spark):
    """Page records of literal HTML: ``page({url: html})``."""
    from pyspark.sql import functions as F

    from vitrine.operators import pages as P, structured
    from vitrine.sources.html import parse_html

    def make(pages, *columns):
        rows = [("s", i, url, html) for i, (url, html) in enumerate(pages.items())]
        df = spark.createDataFrame(rows, "site string, page_no bigint, url string, html string")
        found = P.page_record(parse_html(df), *columns)
        return found.withColumn("error", F.lit(None).cast("string")).withColumn("truncated", F.lit(False)).withColumn(
            "duplicate_of", F.lit(None).cast("string")).withColumn("depth", F.lit(0)).withColumn("review_count", structured.review_count())

    return make
