"""The stored index: additions, changed files, pruning, and expected hits."""

import re

import pytest

from tidewell.operators.textindex import TextIndex


@pytest.fixture
def notes(spark, tmp_path):
    def add(name, rows):
        spark.createDataFrame(rows, "id long, text string").coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "in" / name))

    return add, lambda: spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "in")), TextIndex(spark, str(tmp_path / "index"), "id", "long", "text")


def ids(found):
    return sorted(r["id"] for r in found.collect())


def test_search(spark, notes):
    add, source, index = notes
    assert ids(index.search("pressao")) == []
    add("a", [(1, "Paciente refere dor torácica intensa"), (2, "Sem dor. Pressão arterial estável"), (3, None), (4, "")])
    assert index.refresh(source()) == 1 and index.refresh(source()) == 0
    assert ids(index.search("DOR")) == [1, 2] and ids(index.search("dor pressão")) == [2] and ids(index.search("pressoes dor")) == []
    assert ids(index.search("  ")) == ids(index.search("de para com")) == []


def test_additions_changes_and_compaction(spark, notes):
    add, source, index = notes
    add("a", [(1, "dor dor"), (2, "febre")])
    add("b", [(3, "dor febre")])
    assert index.refresh(source()) == 2
    first = index._live()
    add("c", [(4, "febre e dor")])
    assert index.refresh(source()) == 1 and set(first) < set(index._live())  # what was there stays as it is
    assert ids(index.search("dor")) == [1, 3, 4]
    before = sorted(map(tuple, index.search("dor febre").collect()))
    index.compact()
    assert len(index._live()) == 1 and sorted(map(tuple, index.search("dor febre").collect())) == before
    add("b", [(3, "tosse")])
    index.refresh(source())
    assert ids(index.search("dor")) == [1, 4] and ids(index.search("tosse")) == [3]


def test_reads_only_the_ranges_of_its_tokens(spark, notes, capsys):
    add, source, index = notes
    add("a", [(k, " ".join(f"w{j}" for j in range(k, k + 40))) for k in range(200)])
    index.refresh(source())
    found = index.search("w50")
    found.explain("formatted")
    plan = capsys.readouterr().out
    assert re.search(r"PartitionFilters: .*range#\d+", plan) and re.search(r"PushedFilters: .*EqualTo\(token,w50\)", plan), plan
    assert ids(found) == list(range(11, 51))


def test_one_shuffle_and_rows_that_repeat_a_key(spark, notes, monkeypatch):
    """A row's tokens are counted in the row, before the one shuffle; postings of rows with one key and length are one."""
    add, source, index = notes
    add("a", [(1, "dor febre dor"), (1, "dor febre dor"), (2, "febre"), (3, None)])
    plans, write = [], index._written

    def seen(postings, *more, **named):
        plans.append(postings._jdf.queryExecution().executedPlan().toString())
        return write(postings, *more, **named)

    monkeypatch.setattr(index, "_written", seen)
    index.refresh(source())
    assert len(plans) == 1 and "Exchange" not in plans[0]
    held = sorted((r["token"], r["id"], r["n"], r["length"]) for r in index._postings(index._live()).collect())
    assert held == [("dor", 1, 4, 3), ("febre", 1, 2, 3), ("febre", 2, 1, 1)]
