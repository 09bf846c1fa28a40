"""Registered queries without SQL run on the whole cube."""

from compare import SMALL

from skycube.queries import QUERIES
from skycube.sources import views


def test_patch_fits_of_every_channel(spark):
    channels = {r.freq_idx for r in views.cells(spark, SMALL).select("freq_idx").distinct().collect()}
    assert len(channels) > 1
    assert {r.freq_idx for r in QUERIES["e4_patch_fit"](spark, SMALL).select("freq_idx").distinct().collect()} == channels
