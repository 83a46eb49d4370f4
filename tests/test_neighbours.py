"""Nearest vectors: blocks against numpy, recall of the index, hot lists, ties."""

import numpy as np
import pytest

from fraudspark.operators import neighbours as NB
from fraudspark.plans.catalog import QUERIES


def frame(spark, x, first=0):
    rows = [(first + i, [float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id long, v array<double>")


def brute(asked, bank, k, skip_self):
    out = {}
    for i, q in asked:
        sims = [(-np.round(float(np.dot(q, b)), 9), j) for j, b in bank if not (skip_self and i == j)]
        out[i] = [j for _, j in sorted(sims)[:k]]
    return out


def listed(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["id"], r["place"])):
        out.setdefault(r["id"], []).append(r["neighbour"])
    return out


def unit(x):
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


@pytest.fixture(scope="module")
def clusters():
    r = np.random.default_rng(7)
    centres = r.normal(size=(12, 8)) * 4
    x = centres[r.integers(0, 12, 700)] + r.normal(size=(700, 8))
    x[300:520] = x[300]  # a third are one vector
    x[600] = 0
    return x


@pytest.mark.parametrize("block,part", [(2048, 32768), (7, 50), (1, 300)])
def test_blocks_are_exact(spark, monkeypatch, clusters, block, part):
    monkeypatch.setattr(NB, "BLOCK", block)
    monkeypatch.setattr(NB, "PART", part)
    bank = NB.unit_vectors(frame(spark, clusters).repartition(5), "id", "v")
    rows = list(enumerate(unit(clusters)))
    for skip in (True, False):
        got = listed(NB.exact_neighbours(bank.where("id % 50 = 0"), bank, 6, skip))
        assert got == brute(rows[::50], rows, 6, skip)


@pytest.mark.parametrize("part", [32768, 40])
def test_index_reads_every_row(spark, monkeypatch, clusters, part):
    monkeypatch.setattr(NB, "PART", part)
    monkeypatch.setattr(NB, "BLOCK", 16)
    bank = NB.unit_vectors(frame(spark, clusters), "id", "v")
    index = NB.build_index(bank, lists=15, sample=200)
    assert index.blocks.selectExpr("explode(ids) AS i").distinct().count() == 700
    asked = bank.where("id % 50 = 0")
    rows = list(enumerate(unit(clusters)))
    assert listed(NB.indexed_neighbours(index, asked, 6, 15, True)) == brute(rows[::50], rows, 6, True)
    few = NB.indexed_neighbours(index, asked, 6, 4, True)
    assert NB.recall(few, NB.exact_neighbours(asked, bank, 6, True)) >= 0.9


@pytest.mark.parametrize("size", ["sf0.001", "sf0.1"])
def test_recall_on_the_tables(spark, sf_dir, size):
    folder = sf_dir.replace("sf0.001", size)
    truth = QUERIES["similar_vectors"](spark, folder).withColumnRenamed("vec_id", "id").cache()
    found = QUERIES["similar_vectors_indexed"](spark, folder).withColumnRenamed("vec_id", "id")
    assert truth.count() > 0 and NB.recall(found, truth) >= 0.9


def test_odd_rows(spark):
    schema = "id long, v array<float>"
    rows = [(1, None), (2, []), (3, [1.0, float("nan")]), (4, [None, 1.0]), (5, [0.0, 0.0]), (6, [3.0, 4.0]), (7, [3.0, 4.0]), (8, [1.0])]
    bank = NB.unit_vectors(spark.createDataFrame(rows, schema), "id", "v")
    assert listed(NB.exact_neighbours(bank.where("id IN (5, 6)"), bank.where("id < 8"), 9)) == {5: [5, 6, 7], 6: [6, 7, 5]}
    # vectors of another length are no neighbours
    assert listed(NB.exact_neighbours(bank.where("id = 8"), bank.where("id < 8"), 2)) == {}
    empty = bank.limit(0)
    assert NB.exact_neighbours(bank.where("id < 8"), empty, 3).count() == 0
    index = NB.build_index(empty)
    assert NB.indexed_neighbours(index, bank, 3, 2).count() == 0 and NB.probes_for(NB.build_index(bank.where("id < 8")), 2) >= 1
    for bad in (0, -1):
        with pytest.raises(ValueError):
            NB.exact_neighbours(bank, bank, bad)
