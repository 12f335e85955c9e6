"""Places where an engine query once did less than its whole job."""

from pyspark.sql import functions as F

from crestline.plans import calibrate
from crestline.queries import engine

DATA = "/root/testdata/sf0.001"


def test_cv_cutpoint_of_every_stream(spark):
    """Each key's cut is that of its own rows alone, with blocks over its own length."""
    rows = [(k, i, float((i * 37 + k * 11) % 101), (i * 37 + k * 11) % 101 > 40 + 10 * k + i * 20 // n) for k, n in enumerate((50, 333, 5000)) for i in range(n)]
    df = spark.createDataFrame(rows, "k int, bar long, f double, y boolean")
    got = {r["k"]: (r["threshold"], r["score"]) for r in calibrate.cv_cutpoint(df, "f", "y", keys=["k"]).collect()}
    for k, n in enumerate((50, 333, 5000)):
        one = calibrate.cv_cutpoint(df.where(F.col("k") == k), "f", "y", n_rows=n).first()
        assert got[k] == (one["threshold"], one["score"])
    streams = engine.queries()["cv_cutpoint"](spark, DATA)
    assert streams.select("stream_id").distinct().count() == streams.count() == 5
