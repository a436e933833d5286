import itertools
import random

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import metrics as m


def frame(spark, preds, targets):
    return spark.createDataFrame([(i, p, y) for i, (p, y) in enumerate(zip(preds, targets, strict=True))], ["o", "p", "y"])


def value(df):
    return df.first()[0]


def test_macro_f1(spark):
    assert value(m.macro_f1(frame(spark, list("abca"), list("abcb")), "p", "y")) == pytest.approx(0.7778, abs=1e-4)
    assert value(m.macro_f1(frame(spark, ["b"] * 100, ["a"] + ["b"] * 99), "p", "y")) < 0.6
    assert value(m.macro_f1(frame(spark, ["x"], ["x"]).limit(0), "p", "y")) == 0.0


def test_averages_and_unused_ids(spark):
    df = frame(spark, [0, 3, 3], [0, 3, 0])
    dense = m.counts(df, "p", "y", dense=True)
    assert {r.label for r in dense.collect()} == {0, 1, 2, 3}
    assert m.averaged(dense).first().recall == pytest.approx((0.5 + 1) / 4)
    assert m.averaged(dense, zero=1.0).first().recall == pytest.approx((0.5 + 1 + 2) / 4)
    assert m.averaged(m.counts(df, "p", "y"), "micro").first().f1 == pytest.approx(2 / 3)
    assert m.averaged(m.counts(frame(spark, [1, 0], [1, 1]), "p", "y"), "binary").first().recall == 0.5
    with pytest.raises(ValueError):
        m.averaged(dense, "median")
    multi = spark.createDataFrame([(["a", "b"], ["a"]), (["c"], ["b"])], "p array<string>, y array<string>")
    assert {r.label: (r.tp, r.fp, r.fn) for r in m.counts_multi(multi, "p", "y").collect()} == {"a": (1, 0, 0), "b": (0, 1, 1), "c": (0, 1, 0)}
    assert value(m.accuracy(multi, "p", "y")) == 0.0


def test_average_precision(spark):
    rows = [(o, c, s, y) for o, (scores, ys) in enumerate([([0.9, 0.5], [1, 0]), ([0.1, 0.3], [0, 0])]) for c, (s, y) in enumerate(zip(scores, ys, strict=True))]
    df = spark.createDataFrame(rows, "o int, label int, s double, y int")
    assert value(m.average_precision(df, "label", "s", "y", "o")) == 0.5
    assert value(m.average_precision(df, "label", "s", "y", "o", "micro")) == 1.0


def dense_map(preds, targets):
    labels = sorted({x for s in [*preds, *targets] for x in s})
    total = 0.0
    for label in labels:
        order = sorted(range(len(preds)), key=lambda i: (label not in preds[i], i))
        tp, s, pos = 0, 0.0, sum(label in y for y in targets)
        for rank, i in enumerate(order, 1):
            if label in targets[i]:
                tp += 1
                s += tp / rank
        total += s / pos if pos else 0.0
    return total / len(labels) if labels else 0.0


def test_sparse_map_equals_the_dense_one(spark):
    rng = random.Random(1)
    for n in (1, 5, 40):
        preds, targets = ([[x for x in "abcdef" if rng.random() < 0.3] for _ in range(n)] for _ in range(2))
        df = spark.createDataFrame([(i, p, y) for i, (p, y) in enumerate(zip(preds, targets, strict=True))], "o int, p array<string>, y array<string>")
        assert value(m.dataset_map(df, "p", "y", "o")) == pytest.approx(dense_map(preds, targets))


def test_cider(spark):
    assert value(m.cider(frame(spark, ["a b"], ["a b"]), "o", "p", "y")) == 0.0
    same = frame(spark, ["a b c d e", "f g h i j"], ["a b c d e", "f g h i j"])
    assert value(m.cider(same, "o", "p", "y")) == pytest.approx(10.0)
    assert value(m.spider(same, "o", "p", "y")) == pytest.approx(0.5)
    assert value(m.cider(frame(spark, ["", "x"], ["a b", "c d"]), "o", "p", "y")) == 0.0


def test_sample_scores(spark):
    def score(processed, raw, kind, text, items, task):
        df = spark.createDataFrame([(processed, raw, kind, text, items, task)], "p string, r string, k string, t string, i array<string>, task string")
        return df.select(m.score_sample(*(F.col(c) for c in ("p", "r", "k", "t", "i", "task")))).first()[0]

    assert score("a", "", "text", "a cat", None, "caption task") == {}
    assert set(score(" dog  x", "", "text", "dog x", None, "detection").values()) == {1.0}
    assert set(score("x", "", "text", " ", None, None).values()) == {0.0}
    assert score("", "b", "list", None, ["a", "b"], "classification") == {"accuracy": 1.0, "top1_accuracy": 1.0}
    got = score("zebra", "", "list", None, ["a", "b"], "detection")
    assert got["average_precision"] == pytest.approx(0.667, abs=1e-3) and got["f1"] == 0.0
    assert score("", "", "list", None, [], None) == {} and score("a", "", "object", None, None, None) == {}


def test_means_skip_what_is_missing(spark):
    df = spark.createDataFrame([("t", {"a": 1.0}), (None, {"a": 0.0, "b": 1.0}), ("t", None)], "task string, s map<string,double>")
    assert {tuple(r) for r in m.score_means(df, "s").collect()} == {("a", 0.5), ("b", 1.0)}
    assert {tuple(r) for r in m.score_means(df, "s", "task").collect()} == {("t", "a", 1.0), ("default", "a", 0.0), ("default", "b", 1.0)}
    assert m.dataset_metric(df, "qa", "s", "s", "task") is None
    with pytest.raises(ValueError):
        m.metric(m.METRICS["accuracy"])
    assert len(list(itertools.chain(m.METRICS))) >= 8
