"""The pipeline against a plain version of each stage, and the entry without this subpackage."""

import math
import os
import re
import shutil
import subprocess
import sys

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from pointprep.llm import pii, quality, simhash, wfst
from pointprep.llm.common import cut

from .test_operators import base, brute_groups

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="module")
def stages(spark, small):
    """Rows before the first and after each stage."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, small))
        out.append(docs.collect())
    return out


def test_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "SimHash near-dedup", "PII", "mixing", "SentencePiece"]
    for rows in stages[1:-1]:
        assert rows[0].__fields__ == stages[0][0].__fields__


SYMBOLS = bytes(range(33, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127))


def plain_features(text):
    raw = (text or "").encode()
    words, lines = raw.split(), raw.split(b"\n")
    n, size = len(words), len(raw)
    if not n:
        return [1.0, 1.0] + [0.0] * 10
    odd = sum(c in SYMBOLS and c not in b".,;:'\"?()-/" for c in raw)
    spread = math.log(len(set(words))) / math.log(n) if n > 1 else 1.0
    return [1.0, 0.0, min(1.0, odd / n), min(4.0, odd / n), sum(65 <= c <= 90 for c in raw) / size, min(1.0, raw.count(b"!") / n), min(1.0, raw.count(b"|") / n), sum(a == b for a, b in zip(words, words[1:])) / n,
            spread, min(1.0, math.log1p(n) / 10), 1 - len(set(lines)) / len(lines), min(40.0, size / n) / 40]


def test_features(spark):
    texts = [None, "", " \n\x0b\x0c\r\t ", "one", "A b A  b\nA b A  b\n", "!!! || [x]^_`{}~\\ #$%&*+<=>@ .,;:'\"?()-/", "é\u00a0ü \u2028 x x x", "w " * 5000, "漢字かな🙂 🙂"]
    d = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", quality.features(F.col("t")).alias("x"))
    for r in d.collect():
        assert np.allclose(r.x, plain_features(texts[r.i]), rtol=0, atol=1e-12), texts[r.i]


def test_quality_stage(spark, stages, small):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    rows = stages[0]
    x = np.array([plain_features(r.text) for r in rows])
    known = np.array([r.doc_id in labels for r in rows])
    y = np.array([labels.get(r.doc_id, 0) for r in rows], float)
    logit = np.clip(x @ quality.logistic(x[known], y[known]), -12, 12)
    value = np.where(known, y, 1 / (1 + np.exp(-logit)))
    mean = value.mean()

    def spread(groups, prior):
        s = sum(len(g) * (value[g].mean() - m) ** 2 for g, m in zip(groups, prior, strict=True))
        noise = sum(m * (1 - m) for m in prior)
        room = sum(len(g) * m * (1 - m) for g, m in zip(groups, prior, strict=True))
        return 1e4 if s <= noise else min(1e4, max(1.0, 1 / ((s - noise) / max(room - noise, 1e-9)) - 1))

    hosts = sorted({r.source for r in rows})
    by_host = [[i for i, r in enumerate(rows) if r.source == h] for h in hosts]
    a = spread(by_host, [mean] * len(hosts))
    host = {h: (value[g].sum() + a * mean) / (len(g) + a) for h, g in zip(hosts, by_host, strict=True)}
    paths = sorted({(r.source, r.lang) for r in rows})
    by_path = [[i for i, r in enumerate(rows) if (r.source, r.lang) == p] for p in paths]
    b = spread(by_path, [host[p[0]] for p in paths])
    path = {p: (value[g].sum() + b * host[p[0]]) / (len(g) + b) for p, g in zip(paths, by_path, strict=True)}
    odds = lambda p: math.log(max(p, 1e-6) / max(1 - p, 1e-6))
    want = {r.doc_id for r, z in zip(rows, logit, strict=True) if z + odds(path[r.source, r.lang]) - odds(mean) >= 0}
    assert {r.doc_id for r in stages[1]} == want


def test_dedup_stage(stages):
    """Groups by the exact similarity of all pairs; the smallest doc_id of each stays."""
    rows = sorted(stages[1], key=lambda r: r.doc_id)
    sets = [set(simhash.shingle_hashes(r.text, 5, xxhash.xxh64_intdigest).tolist()) for r in rows]
    like = lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    assert {r.doc_id for r in stages[2]} == {rows[k].doc_id for k in brute_groups(len(rows), like)}


def test_private_stage(spark, stages):
    """Base spans by the plain search, secrets by their words; each span gives way to its kind in brackets."""
    before = {r.doc_id: r.text for r in stages[2]}
    assert {r.doc_id for r in stages[3]} == set(before)
    secret = re.compile("[A-Za-z0-9+/_-]{20,}")
    word = re.compile(rf"(?i)(?<![^\W\d_])(?:{pii.CONTEXT['secret']})(?![^\W\d_])")
    for r in stages[3]:
        t = before[r.doc_id]
        spans = [(int(a), pii.KINDS.index(k), int(b)) for k, a, b in (s.split(":") for s in base(t).split(",") if s)]
        found = list(secret.finditer(t))
        for m in found:
            near = t[max(0, m.start() - pii.NEAR) : m.start()], t[m.end() : m.end() + pii.NEAR]
            if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]) and any(map(word.search, near)):
                spans.append((m.start(), pii.KINDS.index("secret"), m.end()))
        out, at = "", 0
        for a, k, b in sorted(spans):
            if a >= at:
                out += t[at:a] + f"[{pii.KINDS[k].upper()}]"
            at = max(at, b)
        want = out + t[at:]
        assert r.text == want or re.search(pii.PATTERNS["iban"], want)
        assert r.n_chars == len(r.text)


def test_mixture_and_tokens(stages):
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=wfst.MODEL)
    before = {r.doc_id: r for r in stages[3]}
    count = {}
    for r in stages[4]:
        assert r == before[r.doc_id]
        count[r.doc_id] = count.get(r.doc_id, 0) + 1
    assert max(count.values()) <= 2
    size = lambda r: len(r.text.split())
    total, taken = sum(map(size, before.values())), sum(size(before[i]) * n for i, n in count.items())
    assert abs(taken - 1.5 * total) <= 0.02 * total
    assert sorted(r.doc_id for r in stages[5]) == sorted(r.doc_id for r in stages[4])
    for r in stages[5]:
        assert r.ids == sp.encode(before[r.doc_id].text)


def test_run_gives_the_last_stage(spark, small, stages):
    # Its checkpoints go as the stages end; only those behind the rows returned stay.
    assert sorted((r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, small).collect()) == sorted((r.doc_id, r.n_tokens) for r in stages[-1])


def test_entry_without_this_subpackage(tmp_path):
    shutil.copytree(f"{REPO}/pointprep", tmp_path / "pointprep", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{REPO}/__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert len(e.queries()) == len(e.oracle_sql()) > 25; import pointprep.cli, pointprep.ml, pointprep.streaming.ingest"], cwd=tmp_path, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
