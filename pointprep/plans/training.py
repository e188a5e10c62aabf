"""Fit and evaluation of a classifier: settings, epochs with early stop, results document and report.

The classifier of ``pointprep.ml`` stands for a pretrained transformer. An epoch is a fit of ``ROUNDS`` more optimiser rounds; weight
decay is its regularisation. Settings that have no counterpart there are read, kept in the results and otherwise without effect.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, fields

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from pointprep import ml
from pointprep.operators import metrics

ROUNDS = 5
#: Names of accelerators that a run may ask for, and the one that stands for all others.
ACCELERATORS = ["T4", "L4", "A10G", "A100", "A100-40GB", "A100-80GB", "H100"]


@dataclass
class Settings:
    """Options of a run; the defaults are fixed values."""

    model: str = "microsoft/deberta-v3-base"
    gpu: str = "T4"
    epochs: int = 9
    batch_size: int = 2
    learning_rate: float = 1e-5
    max_seq_length: int = 25
    optimizer: str = "adamw_torch"
    scheduler: str = "linear"
    gradient_accumulation: int = 8
    mixed_precision: str = "fp16"
    weight_decay: float = 0.075
    warmup_ratio: float = 0.1
    push_to_hub: bool = False
    hf_repo: str | None = None


def typed(name: str, value: object) -> object:
    """``value`` in the type of the setting: configuration files quote some of their numbers."""
    kind = next(f.type for f in fields(Settings) if f.name == name)
    if value is None:
        return None
    if kind == "bool":
        return value if isinstance(value, bool) else str(value).strip().lower() in ("true", "yes", "1")
    return {"int": int, "float": float}.get(kind, str)(value)


def settings(path: str | None = None, **given: object) -> Settings:
    """Defaults, then the YAML file at ``path``, then what is ``given`` and not None. Unknown names in the file are an error."""
    found: dict = {}
    if path:
        import yaml

        with open(path) as f:
            found = yaml.safe_load(f) or {}
        unknown = set(found) - {f.name for f in fields(Settings)}
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    merged = found | {k: v for k, v in given.items() if v is not None}
    out = Settings(**{k: typed(k, v) for k, v in merged.items()})
    out.model, out.gpu = ml.model_name(out.model), accelerator(out.gpu)
    return out


def accelerator(name: str) -> str:
    """The name in capitals; an unknown one falls back to the first."""
    return name.upper() if name.upper() in ACCELERATORS else ACCELERATORS[0]


def train(rows: DataFrame, validation: DataFrame, s: Settings, patience: int = 3, say: Callable[[str], None] = print) -> tuple[PipelineModel, DataFrame]:
    """(best model, epochs with best, stopped and kept): stops after ``patience`` epochs without a gain in weighted F1."""
    spark, done, models = rows.sparkSession, [], {}
    rows, validation = rows.cache(), validation.cache()
    for epoch in range(1, s.epochs + 1):
        models[epoch] = ml.fit(rows, rounds=ROUNDS * epoch, decay=s.weight_decay)
        scored = metrics.predictions(ml.logits(models[epoch], validation), mapping_of(rows, validation))
        m = metrics.summary(scored, "actual_id", "predicted_id").first()
        done.append((epoch, float(m["f1_weighted"] or 0.0), float(m["accuracy"] or 0.0)))
        say(f"epoch {epoch}: accuracy {done[-1][2]:.4f}, F1 (weighted) {done[-1][1]:.4f}")
        told = metrics.best_checkpoint(spark.createDataFrame(done, "epoch int, f1_weighted double, accuracy double"), patience=patience)
        kept = {r["epoch"] for r in told.where("kept").collect()}
        models = {k: v for k, v in models.items() if k in kept}
        best = max(done, key=lambda x: (x[1], -x[0]))[0]
        if epoch - best >= patience:
            break
    rows.unpersist()
    return models[best], told


def mapping_of(*tables: DataFrame) -> DataFrame:
    """(label, label_id) as the training records have them."""
    out = tables[0].select("label", "label_id")
    for t in tables[1:]:
        out = out.union(t.select("label", "label_id"))
    return out.where("label is not null and label_id is not null").distinct()


def results(model: PipelineModel, rows: DataFrame, validation: DataFrame, epochs: DataFrame, s: Settings, seconds: float, when: str) -> tuple[dict, DataFrame]:
    """(results without predictions, prediction rows)."""
    found = metrics.predictions(ml.logits(model, validation), mapping_of(rows, validation))
    m = metrics.summary(found, "actual_id", "predicted_id").first().asDict()
    n, n_train, ran = validation.count(), rows.count(), epochs.where("not stopped").count()
    right = found.where("correct").count()
    total = ml.parameters(model)
    document = {
        "timestamp": when,
        "model": s.model,
        "model_params": {"total": total, "trainable": total},
        "config": {k: v for k, v in asdict(s).items() if k not in ("model", "gpu", "push_to_hub", "hf_repo")} | {"effective_batch_size": ml.effective_batch(s.batch_size, s.gradient_accumulation), "train_samples": n_train, "val_samples": n},
        "train_metrics": {"runtime_seconds": seconds, "samples_per_second": n_train * ran / max(seconds, 1e-9), "epochs_completed": float(ran)},
        "eval_metrics": {k: m[k] for k in ("accuracy", "f1_weighted", "f1_macro", "f1_micro")},
        "validation_inference": {"accuracy": right / n if n else 0.0, "correct": right, "total": n},
        "gpu": "CPU",
        "huggingface_url": None,
    }
    return document, found


def write_report(document: dict, predictions: DataFrame, path: str) -> None:
    """The results as text, then as JSON. Predictions are written as they arrive, never held at once. Headings and marks are fixed values."""
    line, short = "=" * 60, document["model"].split("/")[-1]
    shown = lambda v: f"{v:.4f}" if isinstance(v, float) else str(v)
    inference = document["validation_inference"]
    rows = lambda: predictions.orderBy("text", "actual_id").toLocalIterator()
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        params = document["model_params"]
        f.write(f"{line}\n{short} Fine-tuning Results\n{line}\n\nTimestamp: {document['timestamp']}\nModel: {document['model']}\nGPU: {document['gpu']}\nParameters: {params['total']:,} total, {params['trainable']:,} trainable\n")
        for title, part in (("Configuration", "config"), ("Training Metrics", "train_metrics"), ("Evaluation Metrics", "eval_metrics")):
            values = document[part].items()
            f.write(f"\n{title}:\n" + "".join(f"  {k}: {v if part == 'config' else shown(v)}\n" for k, v in values if part == "config" or v is not None))
        f.write(f"\n{line}\nValidation Inference Results\n{line}\nAccuracy: {inference['correct']}/{inference['total']} ({inference['accuracy']:.2%})\n\nPredictions:\n{'-' * 60}\n")
        for r in rows():
            f.write(f"{'✓' if r.correct else '✗'} Input: '{r.text}'\n   Predicted: {r.predicted_label} (confidence: {r.confidence:.2%})\n   Actual:    {r.actual_label}\n\n")
        f.write(f"{line}\nRaw JSON:\n")
        write_json(document, rows(), f)


def write_json(document: dict, rows, f) -> None:
    """``document`` with the predictions inside validation_inference, indented by two."""
    head, mark = json.loads(json.dumps(document, default=str)), "@predictions@"
    head["validation_inference"]["predictions"] = mark
    before, after = json.dumps(head, indent=2).split(f'"{mark}"')
    f.write(before + "[")
    some = False
    for r in rows:
        f.write(("," if some else "") + "\n" + "\n".join("      " + x for x in json.dumps(r.asDict(), indent=2, default=str).split("\n")))
        some = True
    f.write(("\n    ]" if some else "]") + after)


def finetune(spark: SparkSession, rows: DataFrame, validation: DataFrame, s: Settings, out: str, now: float | None = None, say: Callable[[str], None] = print) -> str:
    """Fits, evaluates, saves the model under ``out``/final_model and results under ``out``; gives the report's path."""
    began = time.time()
    say(f"Model: {s.model}\nGPU: {s.gpu}\nEpochs: {s.epochs}\nBatch size: {s.batch_size} (effective: {ml.effective_batch(s.batch_size, s.gradient_accumulation)})")
    model, epochs = train(rows, validation, s, say=say)
    stamp = time.localtime(now if now is not None else time.time())
    document, found = results(model, rows, validation, epochs, s, time.time() - began, time.strftime("%Y-%m-%dT%H:%M:%S", stamp))
    report = f"{out}/{time.strftime('%Y%m%d_%H%M%S', stamp)}_{s.model.split('/')[-1]}.txt"
    write_report(document, found, report)
    with open(f"{out}/results.json", "w", encoding="utf-8") as f:
        write_json(document, found.orderBy("text", "actual_id").toLocalIterator(), f)
    model.write().overwrite().save(f"{out}/final_model")
    if s.push_to_hub:
        say("upload to a hub is not supported; the model is saved locally")
    m = document["eval_metrics"]
    say(f"Final F1 (weighted): {m['f1_weighted']:.4f}\nFinal F1 (macro): {m['f1_macro']:.4f}\nFinal Accuracy: {m['accuracy']:.4f}\nResults saved to: {report}")
    return report
