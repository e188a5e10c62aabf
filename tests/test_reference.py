"""Cleaning, matching, splitting, merging, metrics, sources and flows on literal edge rows and shipped figures."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from pointprep import cli, ml
from pointprep.functions import text as T
from pointprep.operators import dedup, match, merge, metrics, profile, split, vocab
from pointprep.plans import ingest, queries, training
from pointprep.sources import profiles, tables
from pointprep.streaming import ingest as streaming


def one(spark, f, *values):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", f(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


def test_scalars(spark):
    assert one(spark, T.remove_spaces, "ZN TEMP\t1") == ["ZNTEMP\t1"]
    assert one(spark, T.normalize, "Zone-Temp__SP:1", "A B", "") == ["zone temp sp 1", "a b", ""]
    assert one(spark, T.camel_split, "zoneCO2Alarm", "currentPhaseAMax", "zoneVOCHiSp") == ["zone co2alarm", "current phase amax", "zone vochi sp"]
    assert one(spark, T.strip_suffix, "X:LOC15:present-value", "Y:PRESENT-VALUE", "a:present-value:b") == ["X:LOC15", "Y", "a:present-value:b"]
    assert one(spark, T.strip, "\t a b \n", "\x1ca") == ["a b", "a"] and one(spark, T.dedup_key, " Foo\n") == ["foo"]
    assert one(spark, T.tokens, "", "a  b") == [[], ["a", "b"]]
    assert one(spark, T.na_to_null, "NA", "x", "") == [None, "x", None]
    assert one(spark, T.base_name, "a/b/c", "d") == ["c", "d"]
    r = spark.createDataFrame([([1.0, 3.0, 3.0],)], "a array<double>").select(T.argmax(F.col("a")), T.softmax_max(F.col("a"))).first()
    assert r[0] == 1 and abs(r[1] - 1 / (2 + 2.718281828459045 ** -2)) < 1e-9


def test_percent_rounds_as_printf(spark):
    d = spark.createDataFrame([(a, n) for n in (1, 3, 7, 8, 40, 200, 2000, 1999) for a in range(0, n + 1, max(1, n // 60))] + [(0, 0)], "a long, n long")
    for r in d.select("a", "n", T.percent(F.col("a"), F.col("n")).alias("p")).collect():
        assert r.p == (f"{100.0 * r.a / r.n:.1f}%" if r.n else None)


def test_strict_records(spark, tmp_path):
    good = '{"text": "a", "label": "x", "label_id": 1}\n'
    for name, text, fails in (("a", good * 2, False), ("b", good + "\n" + good, True), ("c", good + "{not json\n", True)):
        (tmp_path / name).write_text(text)
        read = tables.read_jsonl(spark, str(tmp_path / name), strict=True)
        if fails:
            with pytest.raises(Exception):
                read.collect()
        else:
            assert read.collect() == [("a", "x", 1)] * 2
    assert tables.read_jsonl(spark, str(tmp_path / "b")).count() == 2


LABELS = ["zoneTempSp", "zoneTempMinSP", "zoneTempMinSp", "returnTemp", "zoneTemp", "current", "energy", "comp", "currentPhaseA", "dischargeTemp"]


def names(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "pos int, clean_name string")


@pytest.fixture(scope="module")
def labels(spark):
    return vocab.vocabulary(spark.createDataFrame([(x,) for x in LABELS] + [(None,)], "label string"), "label")


def test_cascade(spark, labels):
    asked = {
        "zone temp sp": ("zoneTempSp", 1.0), "ZONE_TEMP_SP": ("zoneTempSp", 1.0), "zone temp min sp": ("zoneTempMinSp", 1.0), "RETURN AIR TEMP": ("returnTemp", 0.85), "return zone temp": ("zoneTemp", 0.85),
        "current draw": ("current", 0.6), "energy total": ("energy", 0.6), "foo comp": ("comp", 0.5), "comp comp": ("comp", 0.7), "foo bar baz comp": (None, 0.0), "MBOX PARAM": (None, 0.0), "mixed temp": (None, 0.0), "phase a current": ("currentPhaseA", 0.85), "": (None, 0.0),
    }
    r = {x.clean_name: (x.label, x.confidence) for x in match.cascade(names(spark, *asked, None), labels).collect()}
    assert r == {**asked, None: (None, 0.0)}
    strict = {x.clean_name: x.label for x in match.cascade(names(spark, *asked), labels, min_confidence=0.6).collect()}
    assert strict["foo comp"] is None and strict["comp comp"] == "comp"


def brute_additive(name, labels):
    words, best = name.split(), (0, None)
    for label in sorted(labels):
        low, score = label.lower(), 0.0
        for w in words:
            score += w in low
            score += sum(0.5 for k, parts in vocab.KEYWORDS.items() if k in w for p in parts if p.lower() in low)
        if words and score / len(words) > best[0]:
            best = (score / len(words), label)
    return (best[1], min(best[0], 0.9)) if best[0] >= 0.5 else (None, 0.0)


def test_additive(spark, labels):
    asked = ["zn temperature", "current current amps", "phase a", "x", "t", "press sts", "zone zone", "discharge air temp"]
    r = {x.clean_name: (x.label, x.confidence) for x in match.additive(names(spark, *asked, "zone temp sp"), labels).collect()}
    assert r.pop("zone temp sp") == ("zoneTempSp", 1.0)
    assert r == {n: brute_additive(n, LABELS) for n in asked}


def test_first_wins_and_merge(spark):
    d = names(spark, "Foo", "foo ", "FOO", "bar", None)
    for k in (1, 7):
        assert sorted((x.pos for x in dedup.first_wins(d.repartition(k), "clean_name", ["pos"]).collect())) == [0, 3, 4]
    t = lambda *v: spark.createDataFrame([(f"k{x}", x) for x in v], "key string, text string")
    out = merge.merge(t("a", "A "), t("b"), t(*[f"n{i}" for i in range(19)], "B"), "key")
    assert out.groupBy("split").count().orderBy("split").collect() == [("train", 20), ("validation", 2)]
    assert merge.merge(t("a"), t("b"), t(" A", "B "), "key") is None


def test_splits(spark):
    d = spark.range(2186).select(F.col("id"), F.concat(F.lit("c"), F.pmod(F.col("id") * F.col("id"), F.lit(7))).alias("label"))
    r = split.three_way(d, "label", "id")
    n = {x.split: x["count"] for x in r.groupBy("split").count().collect()}
    assert n == {"test": 219, "validation": 219, "train": 1748} and r.select("id").distinct().count() == 2186
    assert sorted(r.collect()) == sorted(split.three_way(d.repartition(7), "label", "id").collect())
    share = {x.label: x for x in d.groupBy("label").count().collect()}
    for x in split.two_way(d, "label", "id").where("split = 'test'").groupBy("label").count().collect():
        assert abs(x["count"] - 438 * share[x.label]["count"] / 2186) < 1
    with pytest.raises(ValueError):
        split.two_way(d.withColumn("label", F.when(F.col("id") > 0, F.col("label"))), "label", "id")
    with pytest.raises(ValueError):
        split.two_way(d.where("id < 3"), "label", "id")


def test_metrics(spark):
    # The two published runs: five rows of five classes, one class predicted throughout, and two classes.
    five = ["a", "b", "c", "d", "e"]
    for predicted, accuracy, f1 in ((["a"] * 5, 0.2, 0.0667), (["b", "b", "c", "c", "c"], 0.4, 0.2333)):
        s = metrics.summary(spark.createDataFrame(list(zip(five, predicted)), "a string, p string"), "a", "p").first()
        assert abs(s.accuracy - accuracy) < 1e-9 and abs(s.f1_micro - accuracy) < 1e-9
        assert abs(s.f1_weighted - f1) < 1e-4 and abs(s.f1_macro - f1) < 1e-4
    rows = metrics.report(spark.createDataFrame([("a", "z"), ("a", "a")], "a string, p string"), "a", "p").collect()
    assert {r.label: (r.precision, r.recall, r.support) for r in rows}["z"] == (0.0, 0.0, 0) and len(rows) == 4
    e = spark.createDataFrame([(1, 0.1), (2, 0.5), (3, 0.5), (4, 0.2), (5, 0.3), (6, 0.9)], "epoch int, f1_weighted double")
    r = {x.epoch: x for x in metrics.best_checkpoint(e).collect()}
    assert [k for k, x in r.items() if x.best] == [2] and [k for k, x in r.items() if x.stopped] == [6] and {k for k, x in r.items() if x.kept} == {2, 5}
    p = metrics.predictions(spark.createDataFrame([("t", 0, [0.0, 2.0, 1.0]), ("u", 5, [1.0, 0.0, 9.0])], "text string, label_id int, logits array<double>"), spark.createDataFrame([("x", 0), ("y", 1)], "label string, label_id int")).orderBy("text").collect()
    assert (p[0].actual_label, p[0].predicted_label, p[0].correct) == ("x", "y", False) and (p[1].actual_label, p[1].predicted_label) == ("unknown_5", "unknown_2")


YAML = """
name: dev
deviceResources:
  - name: "A:1:present-value"
    properties: {valueType: Float32}
  - name: ""
  - {name: B, properties: {}}
"""


def test_profiles(spark, tmp_path, labels):
    (tmp_path / "sub dir").mkdir()
    (tmp_path / "sub dir" / "a (1).yml").write_text(YAML)
    (tmp_path / "b.yaml").write_text("deviceResources:\n  - name: zone temp sp:present-value\n")
    (tmp_path / "bad1.yml").write_text("# no document\n")
    (tmp_path / "bad2.yml").write_text("deviceResources: null\n")
    (tmp_path / "bad3.yml").write_text("deviceResources:\n  - name: ok\n  - name: 5\n")
    files = profiles.scan(spark, str(tmp_path))
    r = profiles.points(files, str(tmp_path)).orderBy("file_rank", "path", "pos").collect()
    assert [(x.clean_name, x.profile_name, x.source_file, x.value_type) for x in r] == [("A:1", "dev", "sub dir/a (1).yml", "Float32"), ("B", "dev", "sub dir/a (1).yml", "unknown"), ("zone temp sp", "unknown", "b.yaml", "unknown")]
    assert profiles.errors(files).count() == 3
    points = profiles.points(files, str(tmp_path))
    assert [(x.text, x.label) for x in ingest.generate(points, labels, ["file_rank", "path", "pos"]).collect()] == [("zone temp sp", "zoneTempSp")]
    e = {x.text: (x.target, x.confidence) for x in ingest.extract(points, labels).collect()}
    assert e["zone temp sp"] == ("zoneTempSp", 1.0) and ingest.extract(points, None).where("target <> ''").count() == 0
    streaming.ingest(spark, str(tmp_path), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5
    mapping = tmp_path / "mapping.json"
    mapping.write_text(json.dumps({"label2id": {x: i for i, x in enumerate(sorted(LABELS))}, "id2label": {str(i): x for i, x in enumerate(sorted(LABELS))}, "num_labels": len(LABELS)}, indent=1))
    assert tables.read_mapping(spark, str(mapping)).count() == len(LABELS)
    cli.run(spark, cli.parser().parse_args(["generate", "-p", str(tmp_path), "-l", str(mapping), "-o", str(tmp_path / "gen")]))
    assert tables.read_jsonl(spark, str(tmp_path / "gen")).collect() == [("zone temp sp", "zoneTempSp", sorted(LABELS).index("zoneTempSp"))]
    for command in ("analyze", "report-unmatched", "extract"):
        cli.run(spark, cli.parser().parse_args([command, "-p", str(tmp_path), "-l", str(mapping), *(["-o", str(tmp_path / command)] if command != "analyze" else [])]))
    assert spark.read.csv(str(tmp_path / "report-unmatched"), header=True).count() == 2


def test_csv_flow(spark, tmp_path):
    src = tmp_path / "train.csv"
    src.write_text("text,target\n" + "".join(f"pt {i},label{i % 3}\n" for i in range(60)) + "N A,label1\n   ,label2\n\"q,\"\"x\",label0\n")
    cli.run(spark, cli.parser().parse_args(["clean", str(src), str(tmp_path / "clean")]))
    again = tables.read_csv(spark, str(tmp_path / "clean"))
    assert again.where("text is null").count() == 2 and again.where("text = 'q,\"x'").count() == 1
    assert profile.complete(again).count() == 61
    cli.run(spark, cli.parser().parse_args(["convert", str(tmp_path / "clean"), str(tmp_path / "out")]))
    s = tables.read_summary(spark, str(tmp_path / "out/dataset_summary.json")).first()
    assert (s.total_samples, s.num_classes, s.test_samples, s.validation_samples) == (61, 3, 7, 6) and sum(s.class_distribution.values()) == 61
    assert tables.read_mapping(spark, str(tmp_path / "out/label_mapping.json")).count() == 3
    assert cli.main(["tags", str(tmp_path / "missing.csv")]) == 1


def test_command_line_prints_all(spark, tmp_path, capsys):
    src = tmp_path / "train.csv"
    src.write_text("text,target\n" + "".join(f"pt {i},label{i % 1200:04d}\n" for i in range(1500)))
    cli.run(spark, cli.parser().parse_args(["tags", str(src)]))
    out = capsys.readouterr().out.splitlines()
    assert out[:1] + out[-2:] == ["label0000: 2", "label1199: 1", "total: 1200 targets, 1500 rows"] and len(out) == 1201
    found = tmp_path / "profiles"
    found.mkdir()
    for i in range(105):
        (found / f"bad{i}.yml").write_text("deviceResources: null\n")
    (found / "good.yml").write_text("deviceResources:\n" + "".join(f"  - name: qqq{i:02d}\n" for i in range(25)))
    mapping = tmp_path / "mapping.json"
    mapping.write_text(json.dumps({"label2id": {"zoneTempSp": 0}, "id2label": {"0": "zoneTempSp"}, "num_labels": 1}, indent=1))
    for command, more in (("analyze", []), ("extract", ["-o", str(tmp_path / "out")])):
        cli.run(spark, cli.parser().parse_args([command, "-p", str(found), "-l", str(mapping), *more]))
        said = capsys.readouterr()
        assert said.err.count("warning: ") == 105
        names = [x for x in said.out.splitlines() if x.startswith("  ")]
        assert "unmatched: 25 names" in said.out and names == [f"  - qqq{i:02d}" for i in range(20)] + ["  ... and 5 more"]


def test_model(spark):
    rows = spark.createDataFrame([("alpha beta", 0), ("omega psi", 1), ("alpha", 0), ("omega", 1)], "text string, label_id int")
    out = metrics.predictions(ml.logits(ml.fit(rows), rows), spark.createDataFrame([("a", 0), ("b", 1)], "label string, label_id int"))
    assert out.where("correct").count() == 4
    assert ml.model_name("roberta-base") != "roberta-base" and ml.model_name("x/y") == "x/y" and ml.effective_batch(8, 2) == 16


def test_settings(tmp_path):
    (tmp_path / "c.yml").write_text('model: "deberta-v3-small"\nepochs: 12\nlearning_rate: "2e-5"\nweight_decay: "0.01"\npush_to_hub: "false"\ngpu: b200\n')
    s = training.settings(str(tmp_path / "c.yml"), epochs=3)
    assert (s.epochs, s.learning_rate, s.weight_decay, s.push_to_hub, s.gpu, s.batch_size, s.max_seq_length) == (3, 2e-5, 0.01, False, "T4", 2, 25)
    assert s.model.endswith("/deberta-v3-small") and training.accelerator("a100-40gb") == "A100-40GB"
    (tmp_path / "d.yml").write_text("epoch: 3\n")
    with pytest.raises(ValueError):
        training.settings(str(tmp_path / "d.yml"))


def test_finetune(spark, tmp_path, capsys):
    from pyspark.ml import PipelineModel

    words = {"alpha": 0, "omega": 1, "sigma": 2}
    for name, k in (("train", 8), ("validation", 2)):
        (tmp_path / f"{name}.jsonl").write_text("".join(json.dumps({"text": f"{w} point {i}", "label": w, "label_id": y}) + "\n" for w, y in words.items() for i in range(k)))
    args = ["finetune", "--train", str(tmp_path / "train.jsonl"), "--validation", str(tmp_path / "validation.jsonl"), "--output", str(tmp_path / "out"), "--epochs", "6", "--weight-decay", "0.001", "--model", "roberta-base", "--push-to-hub"]
    cli.run(spark, cli.parser().parse_args(args))
    said = capsys.readouterr().out
    # Right from the first epochs on, so three without a gain end the run before the sixth.
    assert "Final Accuracy: 1.0000" in said and "epoch 6" not in said and "not supported" in said
    report = next((tmp_path / "out").glob("*_roberta-base.txt")).read_text()
    text, raw = report.split("Raw JSON:\n")
    document = json.loads(raw)
    assert document == json.loads((tmp_path / "out/results.json").read_text()) and "Accuracy: 6/6 (100.00%)" in text and text.count("✓ Input: ") == 6
    assert len(document["validation_inference"]["predictions"]) == 6 and document["eval_metrics"]["f1_macro"] == 1.0 and document["config"]["effective_batch_size"] == 16 and document["model_params"]["total"] > 3
    assert "  weight_decay: 0.001\n" in text and "  accuracy: 1.0000\n" in text
    again = PipelineModel.load(str(tmp_path / "out/final_model"))
    assert ml.logits(again, tables.read_jsonl(spark, str(tmp_path / "validation.jsonl"))).count() == 6


def test_merge_and_extract_say_what_they_do(spark, tmp_path, capsys):
    rows = lambda *texts: "".join(json.dumps({"text": t, "label": f"l{len(t) % 17:02d}", "label_id": 0}) + "\n" for t in texts)
    (tmp_path / "t").write_text(rows("Aa", "b"))
    (tmp_path / "v").write_text(rows("c"))
    (tmp_path / "p").write_text(rows("aa ", "C", "new", "NEW ", *("x" * i for i in range(2, 40))))
    cli.run(spark, cli.parser().parse_args(["merge", "-t", str(tmp_path / "t"), "-v", str(tmp_path / "v"), "-p", str(tmp_path / "p"), "-o", str(tmp_path / "out")]))
    said = capsys.readouterr().out
    assert "duplicates removed: 3\nnew unique entries: 39\ntrain: 38 rows\nvalidation: 4 rows" in said and said.count("\n  l") == 15 and "... and 2 more labels" in said
    (tmp_path / "y").mkdir()
    (tmp_path / "y/a.yml").write_text("deviceResources:\n" + "".join(f"  - name: qqq{i % 25:02d}\n" for i in range(60)))
    for mapping in ("absent.json", "empty.json"):
        (tmp_path / "empty.json").write_text("{}")
        cli.run(spark, cli.parser().parse_args(["extract", "-p", str(tmp_path / "y"), "-l", str(tmp_path / mapping), "-o", str(tmp_path / "o")]))
        assert "unmatched" not in capsys.readouterr().out and spark.read.csv(str(tmp_path / "o"), header=True).count() == 60
    (tmp_path / "m.json").write_text(json.dumps({"label2id": {"zoneTempSp": 0}}))
    cli.run(spark, cli.parser().parse_args(["extract", "-p", str(tmp_path / "y"), "-l", str(tmp_path / "m.json"), "-o", str(tmp_path / "o")]))
    said = capsys.readouterr().out
    assert "resources: 60\nmatched: 0 (0.0%)\nunmatched: 60 (100.0%)\nunmatched: 25 names" in said and "... and 40 more" in said
    with pytest.raises(ValueError):
        tables.read_mapping(spark, str(tmp_path / "empty.json"))


def test_splits_of_repeated_keys(spark):
    d = spark.range(1000).select(F.lit("one").alias("label"), (F.col("id") % 3).alias("k"))
    n = {x.split: x["count"] for x in split.three_way(d, "label", "k").groupBy("split").count().collect()}
    assert n == {"test": 100, "validation": 100, "train": 800}
    p = split.prefix(spark.range(5000), "id", 0.37)
    order = sorted(range(5000), key=lambda i: (hashlib.md5(f"42:{i}".encode()).hexdigest(), i))
    assert {x.id for x in p.where("split = 'validation'").collect()} == set(order[: int(5000 * 0.37)])


def test_matcher_and_ratios(spark, labels):
    m = match.LabelMatcher(labels)
    rows = names(spark, "zone temp sp", "RETURN AIR TEMP", "nothing")
    assert [x.label for x in m.match(rows).orderBy("pos").collect()] == ["zoneTempSp", "returnTemp", None]
    assert m.score(rows).where("label = 'zoneTempSp'").count() == 1
    d = spark.range(400).select(F.col("id").alias("key"), F.concat(F.lit("pt "), "id").alias("text"), F.concat(F.lit("l"), F.col("id") % 4).alias("target"))
    out, _ = ingest.prepare(d, "key", train=0.5, val=0.25, test=0.25)
    assert {x.split: x["count"] for x in out.groupBy("split").count().collect()} == {"train": 200, "validation": 100, "test": 100}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_are_their_sql(spark, small, name):
    import duckdb

    db = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        db.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    try:
        ours = __spark_entry__.queries()[name](spark, small)
        columns = sorted(ours.columns)
        shown = lambda v: None if v is None else f"{v:.5f}" if isinstance(v, float) else str(v)
        a = sorted(repr([shown(r[c]) for c in columns]) for r in ours.collect())
        b = sorted(repr([shown(v) for v in r]) for r in db.execute(f"select {', '.join(columns)} from ({queries.SQL[name]})").fetchall())
    except ValueError as e:  # the smallest tables can be too small to split
        pytest.skip(str(e))
    assert a == b
