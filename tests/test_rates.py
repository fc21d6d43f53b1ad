"""The rates of record operations have the counts that they should."""

from __future__ import annotations

import os

import pytest

from lorekeep.plans.rates import record_rates

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the generated tables are not here")
def test_rates(spark):
    got = record_rates(spark, FOLDER)
    assert got["memory_get_hit_rate"] == 0.5 and got["link_lookup_hit_rate"] == 0.5 and got["link_lookup_average_results"] == 1.5
    assert got["text_search_average_results"] >= 1 and got["walk_average_nodes"] > 1
    assert all(v > 0 for k, v in got.items() if k.endswith("per_sec"))
