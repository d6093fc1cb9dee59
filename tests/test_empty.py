"""Empty pools pass through every plan."""

from pyspark.sql import functions as F

from poolgrade.catalog.base import pool
from poolgrade.operators.ranks import rank_columns
from poolgrade.plans.families import rate_families
from poolgrade.plans.fullbacks import rate_fullbacks
from poolgrade.session import settle_counted

FOLDER = "/root/testdata/sf0.001"


def test_empty_frames_are_counted(spark):
    empty = spark.range(5).where("id > 9").join(spark.range(3), "id")
    assert settle_counted(empty)[1] == 0
    assert settle_counted(spark.range(5).where(F.lit(False)))[1] == 0


def test_empty_pool(spark):
    people = pool(spark, FOLDER).where(F.lit(False))
    assert rank_columns(people, ["family"], "player_id", {"p": ("passes", "dense")}).count() == 0
    assert rate_fullbacks(people).count() == 0
    assert rate_families(people).count() == 0
