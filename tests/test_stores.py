"""Profiles kept in a folder and read back."""

from strandwise.operators import profiles
from strandwise.plans import fixtures
from strandwise.sources import stores


def test_overall_profile(spark, small, tmp_path):
    reads = fixtures.simulated(spark, small)
    made = profiles.OverallProfile.learned(fixtures.planted(spark, small), reads)
    path = f"file://{tmp_path}/overall"
    assert not stores.exists(spark, path)
    stores.save_profile(made, path)
    assert stores.exists(spark, path)
    back = stores.load_profile(spark, path)
    rows = [{(r.read_id, r.orig_pos, r.type): r.score for r in p.read_scores(reads.orderBy("read_id").limit(20)).collect()} for p in (made, back)]
    assert rows[0] == rows[1] and len(rows[0]) > 0
