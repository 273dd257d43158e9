import pytest
from phonolith.operators import search
from phonolith.operators.paging import page_at
from phonolith.plans.adapters import catalog
from phonolith.schema import SearchQuery, SortDirection, SortField
from pyspark.sql import functions as F


@pytest.mark.parametrize("sort", [SortField.NAME, SortField.DURATION, SortField.RELEVANCE])
def test_pages_are_those_of_the_whole_sort(spark, sort):
    q = SearchQuery("the" if sort is SortField.RELEVANCE else "", sort_by=sort, sort_dir=SortDirection.ASC)
    found, order = search.lexical_candidates(catalog(spark, "/root/testdata/sf0.001"), q), search.lexical_order(q)
    whole = [r["id"] for r in found.orderBy(*order).collect()]
    for offset, limit in ((0, 5), (57, 23), (len(whole) - 3, 10), (len(whole), 4), (10**6, 5), (3, 0)):
        assert [r["id"] for r in page_at(found, order, offset, limit).collect()] == whole[offset : offset + limit]


def test_page_10_000(spark):
    rows = spark.range(600_000).select("id", F.format_string("name %d", F.col("id") * 7919 % 5000).alias("filename"))
    order = [F.col("filename").asc(), F.col("id").asc()]
    page = page_at(rows, order, 500_000, 50)
    names = sorted((f"name {i * 7919 % 5000}", i) for i in range(600_000))[500_000:500_050]
    assert [(r["filename"], r["id"]) for r in page.collect()] == names
