"""The engine from reads, genome and alignments to metrics, on the smallest tables."""

from strandwise import engine
from strandwise.plans import fixtures


def test_whole_run(spark, small, tmp_path):
    tables = [lambda s, f=f: f(s, small) for f in (fixtures.simulated, fixtures.genome, fixtures.alignments)]
    dataset = engine.Dataset("small", f"file://{tmp_path}", *tables)
    seen = []
    work = engine.Engine(spark, dataset, engine.Settings(k=11, longest=13, observers=[lambda reads, found: seen.append(1) or found.groupBy("type").count()]))
    found = {r.category: r for r in work.evaluate().collect()}
    assert set(found) == {"deletions", "insertions", "substitutions", "total"}
    assert found["total"].gain > 0 and found["total"].specificity > 0.9
    corrected = work.correct_reads()
    assert corrected.count() == work.reads.count() and "corrected" in corrected.columns
    assert [o.count() > 0 for o in work.observed()] == [True] and seen == [1]
    again = engine.Engine(spark, dataset, work.settings)
    assert again.corrections.exceptAll(work.corrections).count() == 0
