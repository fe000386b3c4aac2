"""Comparing features by hand, choice on the validation split, kept models, two-file prediction, log readers."""

import hashlib
import json
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from pairwright.functions import scores as S
from pairwright.operators import classify, compare, history, metrics


def prints(tokens, gram=5, window=4):
    h = [int(hashlib.md5(" ".join(tokens[i:i + gram]).encode()).hexdigest()[:15], 16) for i in range(max(len(tokens) - gram, 0) + 1)]
    return sorted({min(h[i:i + window]) for i in range(max(len(h) - window, 0) + 1)}) if tokens else []


def test_winnow_by_hand(spark):
    rng = random.Random(2)
    lists = [[rng.choice("abc") for _ in range(n)] for n in (0, 1, 4, 5, 6, 8, 9, 30, 200)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lists)], "i int, t array<string>")
    got = {r.i: r.p for r in df.select("i", compare.winnow(F.col("t")).alias("p")).collect()}
    assert got == {i: prints(t) for i, t in enumerate(lists)}


def test_shared_run_shares_a_print(spark):
    run = [f"r{i}" for i in range(compare.GRAM + compare.WINDOW - 1)]
    a, b = ["x"] * 7 + run + ["y"] * 3, ["p", "q"] + run + ["z"] * 9
    row = compare.fingerprint_features(spark.createDataFrame([(a, b)], "tokens1 array<string>, tokens2 array<string>")).first()
    assert row.prints_shared >= 1 and row.prints_jaccard == row.prints_shared / (len(prints(a)) + len(prints(b)) - row.prints_shared)


def test_cosine_by_hand(spark):
    pairs = [(["a", "b", "b"], ["b", "c"]), (["a"], ["a"]), ([], ["a"]), (["d"], ["e", "e"])]
    df = spark.createDataFrame(pairs, "tokens1 array<string>, tokens2 array<string>").coalesce(1)
    got = [(r.idf_cosine, float(sum(r.bucket_diff.toArray()))) for r in compare.bucket_features(df, compare.fit_weights(df)).collect()]
    texts = [t for p in pairs for t in p]
    idf = {t: math.log((len(texts) + 1) / (sum(t in x for x in texts) + 1)) for t in "abcde"}  # no two of these share a bucket
    for (a, b), (cosine, diff) in zip(pairs, got, strict=True):
        wa, wb = ({t: x.count(t) * idf[t] for t in "abcde"} for x in (a, b))
        size = math.sqrt(sum(v * v for v in wa.values())) * math.sqrt(sum(v * v for v in wb.values()))
        assert cosine == pytest.approx(sum(wa[t] * wb[t] for t in "abcde") / size if size else 0.0)
        assert diff == pytest.approx(sum(abs(wa[t] - wb[t]) for t in "abcde"))


@pytest.fixture(scope="module")
def clones(spark, sf):
    """Each document with a changed copy of itself (clone) or with another's (no clone), in three splits."""
    docs = [r.text.split() for r in spark.read.parquet(f"{sf}/documents.parquet").filter("text is not null").orderBy("doc_id").collect()]
    docs, rng, rows = [d[:120] for d in docs if len(d) > 30], random.Random(3), []
    for i, d in enumerate(docs):
        same = i % 2 == 0
        other = list(d if same else docs[(i * 7 + 1) % len(docs)])
        if same:  # moved parts, renamed words
            cut = rng.randrange(len(other))
            other = [w if rng.random() > 0.15 else f"v{rng.randrange(9)}" for w in other[cut:] + other[:cut]]
        rows.append((" ".join(d), " ".join(other), str(int(same)), ("train", "train", "val", "test")[i // 2 % 4]))
    return spark.createDataFrame(rows, "code1 string, code2 string, label string, split string").cache()


def f1(model, rows):
    judged = classify.predict(model, rows).select(F.col("label").cast("int").alias("label"), "predicted")
    return metrics.binary_metrics(judged).first().f1


def test_choice_on_validation(spark, clones, tmpdir_path):
    train, val, test = (clones.filter(F.col("split") == s) for s in ("train", "val", "test"))
    grid = [{"regParam": 50.0, "elasticNetParam": 1.0}, {"regParam": 0.01, "elasticNetParam": 0.0}, {"regParam": 0.01, "elasticNetParam": 0.0}]
    model, log = classify.select(train, val, grid=grid, metric="f1", num_features=256)
    log = {r.step: r for r in log.collect()}
    assert set(log) == {0, 1, 2} and [log[i].regParam for i in range(3)] == [50.0, 0.01, 0.01]
    assert log[0].f1 < log[1].f1 == log[2].f1 and f1(model, val) == log[1].f1  # the kept one is the best one
    assert model.classifier.getRegParam() == 0.01

    # held out: features that compare the sides against those that only list them
    sides = classify.fit(train, num_features=256, scalars=("jaccard", "length_ratio", "exact_equal"), vectors=("tf1", "tf2"))
    print("held-out F1: comparing", f1(model, test), "side by side", f1(sides, test))
    assert f1(model, test) >= f1(sides, test)

    path = os.path.join(tmpdir_path, "model")
    classify.save(model, path)
    back = classify.load(path)
    cols = ["code1", "code2", "predicted", "confidence", "class_name"]
    want = sorted(tuple(r) for r in classify.predict(model, test).select(*cols).collect())
    assert sorted(tuple(r) for r in classify.predict(back, test).select(*cols).collect()) == want

    # the same pair as two files, and as rows of a path table
    root = os.path.join(tmpdir_path, "code")
    os.makedirs(root)
    for k, name in ((0, "a.txt"), (1, "b [1].txt")):
        with open(os.path.join(root, name), "w") as f:
            f.write(want[0][k])
    row = classify.predict_files(back, f"{root}/a.txt", f"{root}/b [1].txt").first()
    assert (row.predicted, row.class_name) == (want[0][2], want[0][4]) and row.confidence == pytest.approx(want[0][3])
    same = classify.predict_files(back, f"{root}/a.txt", f"{root}/a.txt").first()
    table = spark.createDataFrame([(1, "a.txt", "b [1].txt"), (2, "a.txt", "a.txt"), (3, "a.txt", "none.txt")], "n int, path1 string, path2 string")
    rows = {r.n: r for r in classify.predict_paths(back, table, root).collect()}
    assert rows[1].confidence == pytest.approx(row.confidence) and rows[2].confidence == pytest.approx(same.confidence) and rows[3].code2 == ""
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        classify.predict_files(back, f"{root}/a.txt", f"{root}/none.txt").collect()

    # parts that do not belong together, and folders that hold no model
    with pytest.raises(ValueError):
        classify.load(root)
    about = {"format": classify.FORMAT, "num_features": 128, "scalars": list(model.scalars), "vectors": list(model.vectors)}
    spark.createDataFrame([(json.dumps(about),)], "value string").write.mode("overwrite").text(f"{path}/about")
    with pytest.raises(ValueError, match="features"):
        classify.load(path)
    spark.createDataFrame([(json.dumps({**about, "format": 9}),)], "value string").write.mode("overwrite").text(f"{path}/about")
    with pytest.raises(ValueError, match="format"):
        classify.load(path)


def test_class_names(spark):
    assert spark.range(1).select(S.class_name(F.lit(1)).alias("c")).first().c == "CLONE"


RECORDS = [{"loss": 0.7, "learning_rate": 2e-6, "epoch": 0.0}, {"eval_accuracy": 0.5, "eval_f1": 0.25, "note": "x"}, {"loss": 0.6}, {},
           {"eval_accuracy": 0.75, "eval_f1": None}, {"train_runtime": 12, "loss": 1e-300}]


def test_ragged_logs(spark, tmpdir_path):
    folder = os.path.join(tmpdir_path, "logs")
    os.makedirs(folder)
    for k, part in enumerate((RECORDS[:2], RECORDS[2:3], RECORDS[3:])):
        with open(os.path.join(folder, f"log-{k}.jsonl"), "w") as f:
            f.write("\n\n".join(json.dumps(r) for r in part) + "\n")
    with open(os.path.join(tmpdir_path, "state.json"), "w") as f:
        json.dump({"best": 1, "log_history": RECORDS}, f, indent=1)
    want = sorted((i, k, float(v)) for i, r in enumerate(RECORDS) for k, v in r.items() if isinstance(v, int | float))
    for log in (history.read_records(spark, folder + "/*.jsonl"), history.read_trainer_state(spark, os.path.join(tmpdir_path, "state.json"))):
        assert sorted(tuple(r) for r in log.collect()) == want
        series = history.metric_series(log, history.REFERENCE_SELECTION, history.REFERENCE_X_OF)
        got = sorted(tuple(r) for r in series.select("metric", "x", "y").collect())
        assert got == sorted([("loss", 0, 0.7), ("loss", 2, 0.6), ("loss", 5, 1e-300), ("learning_rate", 0, 2e-6), ("eval_accuracy", 1, 0.5),
                              ("eval_accuracy", 4, 0.75), ("eval_f1", 1, 0.25)])


def test_model_input_is_spread_and_features_are_gathered(spark, monkeypatch):
    """Heavy work per text runs in the session's number of parts, an iteration over few rows in one."""
    from pairwright.plans import classify_plans
    pairs = spark.createDataFrame([(i, f"int a{i} = {i} ;", f"int b = {i % 3} ;", str(i % 2), "train") for i in range(200)],
                                  "row_pos long, code1 string, code2 string, label string, split string").coalesce(1)
    monkeypatch.setattr(classify_plans, "_model_splits", lambda spark, d: pairs)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    data = classify_plans._model_input(spark, "unused")
    assert sorted(map(tuple, data.collect())) == sorted(map(tuple, pairs.collect()))
    assert data.select(F.input_file_name()).distinct().count() > parts // 2 > 0
    weights = classify.fit_weights(classify.token_budget(data))
    few = classify._labelled(data, "label", weights, 64)
    assert few.count() == 200 and few.rdd.getNumPartitions() == 1
    monkeypatch.setattr(classify, "TASK_ROWS", 1)
    assert classify._labelled(data, "label", weights, 64).rdd.getNumPartitions() > 1
