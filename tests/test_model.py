import random

import pytest

from linkwright.operators.model import PairClassifier, auc


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(0)
    rows = []
    for i in range(600):
        y = int(rng.random() < 0.3)
        rows.append((y, y * 0.5 + rng.random() * 0.7, rng.random()))
    df = spark.createDataFrame(rows, "label int, a double, b double")
    return df.filter("b < 0.8"), df.filter("b >= 0.8")


def test_train_score_save(spark, data, tmp_path):
    train, val = data
    m = PairClassifier(["a", "b"], maxIter=8, maxDepth=3, minInstancesPerNode=5).fit(train, val)
    assert auc(m.score(val)) > 0.8
    assert m.importances(train).first()["feature"] == "a"
    m.save(str(tmp_path / "m"))
    assert auc(PairClassifier.load(str(tmp_path / "m")).score(val)) == pytest.approx(auc(m.score(val)))


def test_errors(data):
    train, _ = data
    with pytest.raises(RuntimeError):
        PairClassifier(["a"]).score(train)
    with pytest.raises(ValueError):
        PairClassifier(["a", "zz"]).fit(train)
    with pytest.raises(ValueError):
        PairClassifier(["a"]).fit(train.filter("label = 1"))
