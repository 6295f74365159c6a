"""Sholl profiles up to the reference's default end."""

from arborium.plans import catalog

SF = "/root/testdata/sf0.001"


def test_profile_goes_on_beyond_100(spark):
    whole = {(r.neuron_id, r.radius): r.crossings for r in catalog.QUERIES["sholl_whole"](spark, SF).collect()}
    cut = {(r.neuron_id, r.radius): r.crossings for r in catalog.QUERIES["sholl"](spark, SF).collect()}
    assert {k: n for k, n in whole.items() if k[1] <= 100} == cut
    assert max(r for _, r in whole) > 100
