from pyspark.sql import functions as F

from marquee.plans import catalog
from marquee.plans.views import Views


def test_misspelt_requests_have_similar_titles(spark):
    v = Views(spark, "/root/testdata/sf0.001")
    v.__dict__["movies"] = v.movies.where("movieId = 1").withColumn(
        "title", F.expr("concat(substr(title, 1, 3), substr(title, 5))")
    )
    assert {r.request_id for r in catalog.similar(v).collect()} == {1}
