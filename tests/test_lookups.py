"""Lookups of entities with many spans give what the join with all of them gives."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tidewell.operators import lookups

DAY = datetime.date(2024, 1, 1)


@pytest.fixture(scope="module")
def facts_and_spans(spark):
    rng = random.Random(6)
    day = lambda n: DAY + datetime.timedelta(days=n)
    spans = []
    for k in range(160):
        begin = rng.randint(0, 60)
        spans.append((rng.choice([1, 1, 1, 2, 3, 4]), k, None if k % 17 == 0 else day(begin), rng.choice([None, day(begin), day(begin + rng.randint(0, 30))])))
    facts = [(rng.choice([1, 1, 2, 3, 4, 9]), day(rng.randint(-3, 95)), rng.choice([None, rng.randint(0, 170)])) for _ in range(300)]
    facts += facts[:20]
    return spark.createDataFrame(facts, "who int, at date, wanted int"), spark.createDataFrame(spans, "who int, stay int, began date, ended date")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("limit", [0, 40])
def test_many_spans(facts_and_spans, monkeypatch, limit):
    facts, spans = facts_and_spans
    begun = spans.filter("began IS NOT NULL")
    want = [rows(lookups.containing(facts, begun, "who", "at", "began", "ended", "stay", smallest)) for smallest in (False, True)]
    steps = [rows(lookups.resolved(facts, spans, "who", "at", "began", "ended", "stay", wanted)) for wanted in ("wanted", None)]
    assert len(steps[0]) == 320 and {r[-1] for r in steps[0]} >= {1, 2, 3, None}
    monkeypatch.setattr(lookups, "SPANS_AT_ONCE", limit)
    assert [rows(lookups.containing(facts, begun, "who", "at", "began", "ended", "stay", smallest)) for smallest in (False, True)] == want
    assert [rows(lookups.resolved(facts, spans, "who", "at", "began", "ended", "stay", wanted)) for wanted in ("wanted", None)] == steps


def test_few_spans_take_no_row_for_each_pair(facts_and_spans, capsys):
    """Facts stay one row each: nothing is aggregated or sorted by the facts' columns, of which there would be a row for each span."""
    facts, spans = facts_and_spans
    facts, spans = facts.filter("who > 1"), spans.filter("who > 1 AND stay IS NOT NULL")
    for found in (lookups.containing(facts, spans, "who", "at", "began", "ended", "stay"), lookups.resolved(facts, spans, "who", "at", "began", "ended", "stay", "wanted")):
        found.explain()
        plan = capsys.readouterr().out
        assert "SortAggregate" not in plan and ", at#" not in "".join(x for x in plan.splitlines() if "Aggregate" in x)
    repeated = lookups.resolved(facts.unionAll(facts), spans, "who", "at", "began", "ended", "stay", "wanted")
    once = rows(lookups.resolved(facts, spans, "who", "at", "began", "ended", "stay", "wanted"))
    assert rows(repeated) == sorted(once * 2, key=str)


def test_places_without_a_single_partition(spark, capsys):
    from tidewell.operators.places import placed

    placed(spark.range(100).repartition(4), [F.desc("id")]).explain()
    assert "SinglePartition" not in capsys.readouterr().out
