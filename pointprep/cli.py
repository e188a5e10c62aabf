"""Command line: ``python -m pointprep.cli COMMAND ...``."""

from __future__ import annotations

import argparse
import sys
from dataclasses import fields

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointprep.operators import dedup, match, merge, profile, split, vocab
from pointprep.plans import ingest, training
from pointprep.sources import profiles, tables


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pointprep")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *options: tuple) -> None:
        c = sub.add_parser(name)
        for flags, settings in options:
            c.add_argument(*flags, **settings)

    src, out = (["input"], {}), (["output"], {})
    command("clean", src, out)
    command("tags", src)
    command("split", src, (["train_output"], {}), (["valid_output"], {}), (["--test-size"], {"type": float, "default": 0.2}), (["--seed"], {"type": int, "default": 42}))
    shares = [([f"--{name}-ratio"], {"type": float, "default": x}) for name, x in (("train", 0.8), ("val", 0.1), ("test", 0.1))]
    command("convert", src, out, (["--seed"], {"type": int, "default": 42}), *shares)
    scan = [(["-p", "--profiles-dir"], {"required": True}), (["-l", "--label-mapping"], {"required": True}), (["-c", "--min-confidence"], {"type": float, "default": ingest.PIPELINE_CONFIDENCE})]
    command("analyze", *scan)
    command("generate", *scan, (["-o", "--output"], {"default": "data/from_profiles.jsonl"}))
    command("report-unmatched", *scan, (["-o", "--output"], {"default": "unmatched_points_report.csv"}))
    command("extract", scan[0], (["-l", "--label-mapping"], {}), (["-o", "--output"], {"default": "extracted_points.csv"}), (["-c", "--min-confidence"], {"type": float, "default": ingest.EXTRACT_CONFIDENCE}), (["--jsonl"], {"action": "store_true"}))
    command("merge", (["-t", "--train"], {"required": True}), (["-v", "--validation"], {"required": True}), (["-p", "--profiles"], {"required": True}), (["-o", "--output"], {"default": "data/"}), (["--val-ratio"], {"type": float, "default": 0.1}), (["--seed"], {"type": int, "default": 42}))
    kinds = {"int": int, "float": float, "bool": str}
    options = [([f"--{f.name.replace('_', '-')}"], {"type": kinds.get(f.type, str), **({"nargs": "?", "const": "true"} if f.type == "bool" else {})}) for f in fields(training.Settings)]
    command("finetune", *options, (["--config"], {}), (["--train"], {"default": "data/train.jsonl"}), (["--validation"], {"default": "data/validation.jsonl"}), (["--output"], {"default": "output"}))
    return p


def print_unmatched(rows: DataFrame, name: str, k: int = 20, distinct: bool = True) -> None:
    """The first ``k`` distinct names of unmatched ``rows`` in order and how many more there are: names, or rows if not ``distinct``."""
    known = rows.where(F.col(name).isNotNull()).select(name)
    names = known.distinct()
    n = names.count()
    if n:
        print(f"unmatched: {n} names")
    for (x,) in names.orderBy(name).limit(k).collect():
        print(f"  - {x}")
    more = (n if distinct else known.count()) - k
    if more > 0:
        print(f"  ... and {more} more")


def print_counts(counts: DataFrame, k: int = 15) -> None:
    """The ``k`` most common of (label, n, first_pos), and how many labels there are besides."""
    for r in counts.limit(k).collect():
        print(f"  {r['label']}: {r['n']}")
    if (more := counts.count() - k) > 0:
        print(f"  ... and {more} more labels")


def run(spark: SparkSession, a: argparse.Namespace) -> None:
    keyed = lambda df: df.withColumn("key", F.xxhash64(*df.columns)) if "key" not in df.columns else df
    if a.command == "clean":
        tables.write_csv(profile.clean_strings(tables.read_csv(spark, a.input, na=False)), a.output)
    elif a.command == "tags":
        labels, total = 0, 0
        for label, n in profile.label_distribution(tables.read_csv(spark, a.input), "target").toLocalIterator():
            print(f"{label}: {n}")
            labels, total = labels + 1, total + n
        print(f"total: {labels} targets, {total} rows")
    elif a.command == "split":
        both = split.two_way(keyed(tables.read_csv(spark, a.input)), "target", "key", a.test_size, a.seed)
        for name, path in (("train", a.train_output), ("test", a.valid_output)):
            tables.write_csv(both.where(F.col("split") == name).select("text", "target"), path)
    elif a.command == "convert":
        source = keyed(tables.read_csv(spark, a.input))
        rows, labels = ingest.prepare(source, "key", a.seed, a.train_ratio, a.val_ratio, a.test_ratio)
        if removed := profile.removal_summary(source).first()["n_removed"]:
            print(f"removed {removed} rows with empty values")
        for name in ("train", "validation", "test"):
            tables.write_jsonl(rows.where(F.col("split") == name), f"{a.output}/{name}.jsonl")
        tables.write_document(vocab.mapping_row(labels), f"{a.output}/label_mapping.json")
        tables.write_document(profile.dataset_summary(rows), f"{a.output}/dataset_summary.json")
    elif a.command == "merge":
        train, val, new = (tables.read_jsonl(spark, x) for x in (a.train, a.validation, a.profiles))
        train, val, new = (keyed(x) for x in (train, val, new))
        n = merge.counters(train, val, new, "key").first()
        print(f"duplicates removed: {n['n_duplicates']}\nnew unique entries: {n['n_unique']}")
        out = merge.merge(train, val, new, "key", a.val_ratio, a.seed)
        if out is None:
            print("nothing new")
            return
        sizes = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
        print(f"train: {sizes.get('train', 0)} rows\nvalidation: {sizes.get('validation', 0)} rows\nlabels of new entries:")
        fresh = dedup.new_entries(train.select("text").union(val.select("text")), new, "text", ["key"])
        print_counts(profile.class_counts(fresh, "label", "key"))
        for name in ("train", "validation"):
            tables.write_jsonl(merge.shuffled(out.where(F.col("split") == name), "key", a.seed), f"{a.output}/{name}.jsonl")
    elif a.command == "finetune":
        s = training.settings(a.config, **{f.name: getattr(a, f.name) for f in fields(training.Settings)})
        training.finetune(spark, tables.read_jsonl(spark, a.train, strict=True), tables.read_jsonl(spark, a.validation, strict=True), s, a.output)
    else:
        files = profiles.scan(spark, a.profiles_dir)
        for path, error in profiles.errors(files).toLocalIterator():
            print(f"warning: {path}: {error}", file=sys.stderr)
        points = profiles.points(files, a.profiles_dir)
        order = ["file_rank", "path", "pos"]
        if a.command == "extract":
            # A mapping that is not there, or has no labels, means no matching.
            there = a.label_mapping and tables.exists(spark, a.label_mapping)
            labels = tables.read_mapping(spark, a.label_mapping, required=False) if there else None
            found = ingest.extract(points, labels, a.min_confidence)
            tables.write_extract(found, a.output)
            if labels is not None:
                n = profile.match_summary(found.withColumn("label", F.nullif("target", F.lit(""))), "text").first()
                print(f"resources: {n['total']}\nmatched: {n['matched']} ({n['matched_pct']})\nunmatched: {n['unmatched']} ({n['unmatched_pct']})")
                print_unmatched(found.where("target = ''"), "text", distinct=False)
            if a.jsonl and labels is not None:
                tables.write_jsonl(ingest.extract_records(found, labels, a.min_confidence), a.output.removesuffix(".csv") + ".jsonl")
            return
        labels = tables.read_mapping(spark, a.label_mapping)
        if a.command == "generate":
            tables.write_jsonl(ingest.generate(points, labels, order, a.min_confidence), a.output)
            return
        matched = match.cascade(points, labels, min_confidence=a.min_confidence)
        if a.command == "analyze":
            profile.match_summary(matched).show(truncate=False)
            profile.top_labels(matched.withColumn("at", F.struct(*order)), "label", "at").show(truncate=False)
            print_unmatched(matched.where("label is null"), "clean_name")
        else:
            tables.write_csv(profile.unmatched_report(matched.withColumn("at", F.struct(*order)), order="at"), a.output, one_file=True)


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    try:
        run(SparkSession.builder.appName("pointprep").getOrCreate(), a)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        print(f"error: no such file: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
