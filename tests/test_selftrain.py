import numpy as np
import pytest
from frames import rows
from pyspark.sql import functions as F

from deskwise.operators import curation as cu
from deskwise.operators.selftrain import SelfTraining
from deskwise.plans import evaluation


@pytest.fixture(scope="module")
def sides(spark):
    rng = np.random.default_rng(0)
    centres = np.eye(3)
    data = [(k, f"c{k % 3}", centres[k % 3] + 0.3 * rng.normal(size=3)) for k in range(120)]
    data = [(i, label, (v / np.linalg.norm(v)).tolist()) for i, label, v in data]
    frame = spark.createDataFrame(data, "id long, label string, vector array<float>")
    return frame.where("id < 12"), frame.where("id >= 12").drop("label"), {i: label for i, label, _ in data}


def test_rounds_quotas_and_the_fixed_point(spark, sides, tmp_path):
    seeds, pool, truth = sides
    job = SelfTraining(str(tmp_path / "a"), quota=10, least=0.5, max_rounds=50)
    found = job.run(seeds, pool)
    got = found.collect()
    assert len({r.id for r in got}) == len(got) and all(r.confidence >= 0.5 for r in got)
    assert found.groupBy("round", "label").count().where("count > 10").count() == 0
    assert len(job.done(spark)) < 50 and job.done(spark)[max(job.done(spark))] == 0
    assert np.mean([truth[r.id] == r.label for r in got]) > 0.9 and len(got) > 50
    few = SelfTraining(str(tmp_path / "b"), quota=10, least=0.5, max_rounds=2).run(seeds, pool)
    assert rows(few, "id") == rows(found.where("round <= 2"), "id")
    assert SelfTraining(str(tmp_path / "c"), least=1.1).run(seeds, pool).count() == 0


def test_a_broken_round_is_repeated(spark, sides, tmp_path, monkeypatch):
    seeds, pool, _ = sides
    whole = rows(SelfTraining(str(tmp_path / "whole"), 10, 0.5, 3).run(seeds, pool), "id")
    job, calls = SelfTraining(str(tmp_path / "broken"), 10, 0.5, 3), []
    first_rows = cu.first_rows

    def dies(*args):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return first_rows(*args)

    monkeypatch.setattr(cu, "first_rows", dies)
    with pytest.raises(RuntimeError):
        job.run(seeds, pool)
    assert list(job.done(spark)) == [1]
    spark.range(3).write.parquet(str(tmp_path / "broken" / "accepted" / "round=2"))  # written in part, never finished
    assert rows(job.run(seeds, pool), "id") == whole and len(calls) == 4


def test_methods_side_by_side(spark):
    words = {"a": "parcel late courier", "b": "refund money bank", "c": "login password account"}
    data = [(k, "abc"[k % 3 if k % 7 else 0], k) for k in range(60)]
    rng = np.random.default_rng(1)
    vector = {"a": [1.0, 0, 0], "b": [0, 1.0, 0], "c": [0, 0, 1.0]}
    frame = spark.createDataFrame(
        [(k, y, f"{words[y]} number {k}", (np.array(vector[y]) + 0.01 * rng.normal(size=3)).tolist()) for k, y, _ in data],
        "id long, intent string, message string, v array<double>",
    )
    from deskwise.operators import models

    frame = models.to_vector(frame, "v")
    got = evaluation.compare_methods(frame.where("id < 45"), frame.where("id >= 45"), "intent", "message", "features")
    found = {r.method: r for r in got.collect()}
    share = frame.where("id >= 45").agg(F.avg((F.col("intent") == "a").cast("int"))).first()[0]
    assert found["majority"].accuracy == pytest.approx(share) and found["majority"].macro_f1 < 0.4
    assert found["tfidf"].accuracy == found["vectors"].accuracy == found["vectors"].macro_f1 == 1
    assert found["majority"].lift_pp == pytest.approx(100 * (1 - share)) and {r.n_rows for r in found.values()} == {15}
