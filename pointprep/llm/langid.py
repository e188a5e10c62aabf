"""Language of every word by a linear-chain conditional random field, for code-switched text.

Words are maximal runs of letters and their marks. A word's emission scores are sums of weights of its affixes,
character n-grams, shape and, as lexicon, itself; transitions between languages are learned with
them, by gradient ascent on the conditional likelihood with exact word and pair posteriors. Whole training texts are cut into
stretches and stretches of different documents are put in one sequence, so that switches occur in it; lines found in several
training rows are quoted passages, say nothing of their rows' languages and are left out of training, unless a row has no other.
Inference is exact forward-backward over the whole text: blocks of words are multiplied out side by
side, then joined in order, so cost is linear in words.
"""

from __future__ import annotations

import re
import sys
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_python

#: Training rows in all, shared out evenly over the languages (at least one each): those with the smallest seeded hashes of their ids.
MAX_ROWS = 1200
#: Words of a step of training, fewer where there are many languages.
STEP = 8192
BINS = 1 << 15
BLOCK = 32
SEED = 11
#: Words whose scores a worker keeps, and numbers held at a time by forward-backward, whatever the number of languages.
CACHE, HELD = 150_000, 8_000_000


def mark_ranges() -> str:
    """Marks that belong to the letter before them, and joiners, as ranges of a character class."""
    marks = [c for c in range(0x300, sys.maxunicode + 1) if unicodedata.category(chr(c))[0] == "M"] + [0x200C, 0x200D]
    out, marks = [], sorted(marks)
    for c in marks:
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in out)


WORD = re.compile(rf"[^\W\d_]+(?:[{mark_ranges()}]+[^\W\d_]*)*")


#: Words of texts below the first mark.
PLAIN, FAR = re.compile(r"[^\W\d_]+"), re.compile("[\u0300-\U0010ffff]")


def words_of(text: str) -> list[str]:
    """Runs of letters and marks; number signs such as fractions count as letters beside one, alone they are no word."""
    if text.isascii():
        return PLAIN.findall(text)
    return [w for w in (WORD if FAR.search(text) else PLAIN).findall(text) if w.isascii() or any(map(str.isalpha, w))]


def places_of(text: str) -> list[tuple[int, int]]:
    """(start, end) in code points of each of ``words_of``."""
    return [m.span() for m in WORD.finditer(text) if m[0].isascii() or any(map(str.isalpha, m[0]))]


def feature_bins(words: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashed features as groups of (bin, index of the word): n-grams of two and three, affixes of one to three, the word.

    Each group is ordered by word and has every word.
    """
    low = [w.lower() for w in words]
    codes = np.frombuffer("".join(f"<{w}>" for w in low).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, low), np.int64, len(low)) + 2
    owner = np.repeat(np.arange(len(low)), sizes)
    begin = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
    end = begin + sizes - 1

    def bins(kind: int, *parts: np.ndarray) -> np.ndarray:
        h = np.full(len(parts[0]), kind * 0x9E3779B97F4A7C15 & (1 << 64) - 1, np.uint64)
        for x in parts:
            h = (h ^ x) * np.uint64(0xFF51AFD7ED558CCD)
            h ^= h >> np.uint64(33)
        return (h & np.uint64(BINS - 1)).astype(np.int64)

    out = []
    for k in (2, 3):
        inside = owner[: len(codes) - k + 1] == owner[k - 1 :]
        out.append((bins(k, *(codes[i : len(codes) - k + 1 + i] for i in range(k)))[inside], owner[: len(codes) - k + 1][inside]))
    every = np.arange(len(low))
    for k in (1, 2, 3):
        out.append((bins(10 + k, *(codes[np.minimum(begin + 1 + i, end)] for i in range(k))), every))
        out.append((bins(20 + k, *(codes[np.maximum(end - 1 - i, begin)] for i in range(k))), every))
    whole = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in low), np.uint64, len(low))
    out.append((bins(30, whole), every))
    out.append((bins(40, np.minimum(sizes, 14).astype(np.uint64)), every))
    return out


def emitted(groups: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray) -> np.ndarray:
    total = np.zeros((groups[-1][1][-1] + 1, weights.shape[1]))
    for bins, owner in groups:
        if len(bins) == len(total):
            total += weights[bins]
        else:
            total += np.add.reduceat(weights[bins], np.searchsorted(owner, np.arange(len(total))), axis=0)
    return total


def emissions(words: list[str], weights: np.ndarray) -> np.ndarray:
    """Scores (words, languages)."""
    return emitted(feature_bins(words), weights)


def unit(x: np.ndarray, axis) -> np.ndarray:
    return x / np.maximum(x.sum(axis, keepdims=True), 1e-300)


def messages(scores: np.ndarray, starts: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(forward, backward, emission) of each word (words, languages), each up to a factor a word.

    ``starts`` are the places where sequences begin. Forward counts the word itself, backward what
    follows it. Every sequence is padded to whole blocks with neutral words behind its end; blocks advance
    together, one word a step, and as many at a time as ``HELD`` allows.
    """
    n, k = scores.shape
    ends = np.append(starts[1:], n)
    blocks = -(-(ends - starts) // BLOCK)
    first = np.concatenate(([0], np.cumsum(blocks)[:-1]))
    total = int(blocks.sum())
    where = np.arange(n) - np.repeat(starts, ends - starts) + np.repeat(first * BLOCK, ends - starts)
    e = np.ones((total * BLOCK, k))
    e[where] = np.exp(scores - scores.max(1, keepdims=True))
    real = np.zeros(total * BLOCK, bool)
    real[where] = True
    e, real = e.reshape(total, BLOCK, k), real.reshape(total, BLOCK)
    t = np.exp(trans - trans.max())
    head = np.zeros(total, bool)
    head[first] = True
    size = max(1, HELD // (k * k))
    ranges = [(a, min(total, a + size)) for a in range(0, total, size)]

    def products(a: int, b: int) -> np.ndarray:
        """prod[x, i, j]: from the state before block x to its last word."""
        prod = np.broadcast_to(np.eye(k), (b - a, k, k)).copy()
        for s in range(BLOCK):
            step = (prod.reshape(-1, k) @ t).reshape(b - a, k, k)
            if s == 0:
                step[head[a:b]] = 1.0 / k  # no transition into the first word
            step *= e[a:b, s, None, :]
            prod = np.where(real[a:b, s, None, None], step, prod)
            prod /= np.maximum(prod.max((1, 2), keepdims=True), 1e-300)
        return prod

    into, after, prod = np.empty((total, k)), np.empty((total, k)), None
    even, heads = np.full(k, 1.0 / k), head.tolist()
    msg = even
    for a, b in ranges:
        prod = products(a, b)
        for x in range(a, b):
            if heads[x]:
                msg = even
            into[x] = msg
            msg = unit(msg @ prod[x - a], 0)
    for a, b in reversed(ranges):
        prod = products(a, b) if len(ranges) > 1 else prod
        for x in range(b - 1, a - 1, -1):
            if x == total - 1 or heads[x + 1]:
                msg = even
            after[x] = msg
            msg = unit(prod[x - a] @ msg, 0)

    alpha, beta = np.empty_like(e), np.empty_like(e)
    now = into
    for s in range(BLOCK):
        step = now @ t
        if s == 0:
            step[head] = 1.0 / k
        now = np.where(real[:, s, None], unit(step * e[:, s], 1), now)
        alpha[:, s] = now
    now = after
    for s in range(BLOCK - 1, -1, -1):
        beta[:, s] = now
        now = np.where(real[:, s, None], unit((now * e[:, s]) @ t.T, 1), now)
    return alpha.reshape(-1, k)[where], beta.reshape(-1, k)[where], e.reshape(-1, k)[where]


def marginals(scores: np.ndarray, starts: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Posterior (words, languages) by forward-backward."""
    alpha, beta, _ = messages(scores, starts, trans)
    return unit(alpha * beta, 1)


def expected(scores: np.ndarray, starts: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(posterior of each word, expected number of each transition): a pair of neighbours has forward, transition, emission and backward."""
    alpha, beta, e = messages(scores, starts, trans)
    inner = np.ones(len(scores), bool)
    inner[starts] = False
    at = np.nonzero(inner)[0]
    t = np.exp(trans - trans.max())
    a, b = alpha[at - 1], e[at] * beta[at]
    norm = np.maximum(((a @ t) * b).sum(1), 1e-300)
    return unit(alpha * beta, 1), (a / norm[:, None]).T @ b * t


def gradient(words: list[str], y: np.ndarray, starts: np.ndarray, weights: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient of the conditional log-likelihood of the labels ``y`` of ``words`` in weights and transitions."""
    k = len(trans)
    own: dict[str, int] = {}
    which = np.array([own.setdefault(w, len(own)) for w in words])
    groups = feature_bins(list(own))
    p, pairs = expected(emitted(groups, weights)[which], starts, trans)
    gap = np.eye(k)[y] - p
    by_word = np.stack([np.bincount(which, gap[:, j], len(own)) for j in range(k)], 1)
    grad = np.stack([sum(np.bincount(b, by_word[o, j], BINS) for b, o in groups) for j in range(k)], 1)
    inner = np.ones(len(y), bool)
    inner[starts] = False
    at = np.nonzero(inner)[0]
    true = np.zeros((k, k))
    np.add.at(true, (y[at - 1], y[at]), 1)
    return grad, true - pairs


def train(texts: list[str], langs: list[str], rounds: int = 3) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, emission weights, transition scores) by gradient ascent in steps of about ``STEP`` words, ``rounds`` times over all."""
    rng = np.random.default_rng(SEED)
    names = sorted(set(langs))
    k = len(names)
    weights, trans = np.zeros((BINS, k)), np.zeros((k, k))
    rows_with = Counter(line for text in texts for line in set(text.split("\n")))
    # Words are held once; texts are numbers of words.
    place: dict[str, int] = {}
    stretches = []
    for text, lang in zip(texts, langs, strict=True):
        own = [line for line in text.split("\n") if rows_with[line] == 1]
        words = np.array([place.setdefault(w, len(place)) for w in words_of("\n".join(own or [text]))], np.int32)
        at = 0
        while at < len(words):
            size = int(rng.integers(4, 40))
            stretches.append((names.index(lang), words[at : at + size]))
            at += size
    if not stretches or k < 2:
        return names, weights, trans
    known = list(place)
    order = rng.permutation(len(stretches))
    steps, held, i = [[]], 0, 0
    while i < len(order):  # one to four stretches make a sequence
        size = int(rng.integers(1, 5))
        steps[-1].append([stretches[j] for j in order[i : i + size]])
        held += sum(len(x) for _, x in steps[-1][-1])
        i += size
        if held >= min(STEP, HELD // (8 * k)) and i < len(order):
            steps.append([])
            held = 0
    share = 1 / len(steps)
    square, square_t = np.full((BINS, k), 1e-6), np.full((k, k), 1e-6)
    for _ in range(max(rounds, -(-30 // len(steps)))):
        for s in rng.permutation(len(steps)).tolist():
            sequences = steps[s]
            words = [known[w] for x in sequences for _, part in x for w in part.tolist()]
            y = np.repeat([lang for x in sequences for lang, _ in x], [len(part) for x in sequences for _, part in x])
            starts = np.concatenate(([0], np.cumsum([sum(len(part) for _, part in x) for x in sequences])[:-1])).astype(np.int64)
            grad, grad_t = gradient(words, y, starts, weights, trans)
            grad -= 0.05 * share * weights
            grad_t -= 0.05 * share * trans
            square += grad**2
            square_t += grad_t**2
            weights += 0.3 * grad / np.sqrt(square)
            trans += 0.3 * grad_t / np.sqrt(square_t)
    return names, weights, trans


def learned(docs: DataFrame, max_rows: int = MAX_ROWS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Model from whole texts of rows whose crc32(doc_id as text) mod 4 is not 2; languages and counts come from all of them."""
    rows = docs.where("lang is not null and text is not null and doc_id is not null").where(~held_out())
    h = F.xxhash64(F.lit(SEED), "doc_id")
    counts = {r[0]: r[1] for r in rows.groupBy(F.col("lang").cast("string")).count().collect()}
    if not counts:
        return [], np.zeros((BINS, 0)), np.zeros((0, 0))
    each = max(1, max_rows // len(counts))
    # Of each language the rows below a hash level that lets about 1.3 times as many through as wanted.
    level = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, (1.3 * each + 10) / n))])
    below = F.pmod(h, F.lit(1 << 30)) / float(1 << 30) < F.element_at(level, F.col("lang").cast("string"))
    few = rows.where(below).select(F.col("text").cast("string"), F.col("lang").cast("string"), "doc_id", h.alias("h")).collect()
    few.sort(key=lambda r: (r.lang, r.h, str(r.doc_id), r.text))
    seen: Counter = Counter()
    kept = [r for r in few if (seen.update([r.lang]) or seen[r.lang]) <= each]
    return train([r.text for r in kept], [r.lang for r in kept])


def held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def identify(docs: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, n_words, n_switched) of every row.

    lang_pred is the language with the largest sum of word posteriors, score its share of them;
    ties go to the smaller name. Texts that are null or without a letter get ``und`` and score 0, as do all if
    nothing can be learned. n_switched counts words labelled with another language. Rows with a null
    doc_id are predicted and not held out.
    """
    return labelled(docs, max_rows, False)


def language_spans(docs: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """(doc_id, spans) of every row: runs of words of one language by the posteriors that ``identify`` sums.

    A span is (start, end, lang, score): code points from its first word to the end of its last, and the mean
    posterior of its words. Every word is in one span; texts without a word have none, as do all if nothing can be learned.
    """
    return labelled(docs, max_rows, True).select("doc_id", "spans")


def labelled(docs: DataFrame, max_rows: int, spans: bool) -> DataFrame:
    """The columns of ``identify``, and ``spans`` if wanted, from one pass."""
    names, weights, trans = learned(docs, max_rows)
    model = docs.sparkSession.sparkContext.broadcast((names, weights.astype(np.float32), trans))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, weights, trans = model.value
        k = len(names)
        place: dict[str, int] = {}
        cache = min(CACHE, HELD // max(1, k))
        table = np.empty((cache + cache // 2, k))
        most = min(100_000, 4 * HELD // max(1, k * k))

        def part(ids: pa.Array, held: pa.Array, texts: list[list[str]], places: list[list[tuple[int, int]]]) -> pa.RecordBatch:
            sizes = np.array([len(t) for t in texts])
            best, score = np.full(len(texts), -1), np.zeros(len(texts))
            switched = np.zeros(len(texts), np.int64)
            runs: list[list[dict]] = [[] for _ in texts]
            some = np.nonzero(sizes)[0]
            if len(some) and k:
                if len(place) > cache:
                    place.clear()
                words = [w for t in texts for w in t]
                new = list({w: 0 for w in words if w not in place})
                far = len(place) + len(new) > len(table)
                if far:  # one batch with more new words than the table holds
                    own = {w: i for i, w in enumerate(dict.fromkeys(words))}
                    scores = emissions(list(own), weights)[np.fromiter(map(own.__getitem__, words), np.int64, len(words))]
                else:
                    if new:
                        table[len(place) : len(place) + len(new)] = emissions(new, weights)
                        place.update(zip(new, range(len(place), len(place) + len(new)), strict=True))
                    scores = table[np.fromiter(map(place.__getitem__, words), np.int64, len(words))]
                starts = np.concatenate(([0], np.cumsum(sizes[some])[:-1]))
                p = marginals(scores, starts, trans)
                sums = np.add.reduceat(p, starts, axis=0)
                best[some] = np.round(sums, 9).argmax(1)
                score[some] = np.clip(sums.max(1) / sizes[some], 0, 1)
                switched[some] = np.add.reduceat((p.argmax(1) != np.repeat(best[some], sizes[some])).astype(np.int64), starts)
                if spans:
                    own = p.argmax(1)
                    for t, at in zip(some.tolist(), starts.tolist(), strict=True):
                        q = own[at : at + sizes[t]]
                        edges = [0, *(np.nonzero(q[1:] != q[:-1])[0] + 1).tolist(), len(q)]
                        for a, b in zip(edges, edges[1:], strict=False):
                            runs[t].append({"start": places[t][a][0], "end": places[t][b - 1][1], "lang": names[q[a]], "score": float(np.clip(p[at + a : at + b, q[a]].mean(), 0, 1))})
            label = pa.array([names[b] if b >= 0 else "und" for b in best.tolist()])
            out = {"doc_id": ids, "held_out": held, "lang_pred": label, "score": pa.array(score), "n_words": pa.array(sizes.astype(np.int64)), "n_switched": pa.array(switched)}
            if spans:
                out["spans"] = pa.array(runs, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string()), ("score", pa.float64())])))
            return pa.RecordBatch.from_arrays(list(out.values()), list(out))

        for batch in batches:
            at = 0
            while at < batch.num_rows:  # at most some 100,000 words at a time, or one text
                texts, held = [], 0
                while at + len(texts) < batch.num_rows and held < most:
                    texts.append(words_of(batch.column(2)[at + len(texts)].as_py() or ""))
                    held += len(texts[-1])
                cut = batch.slice(at, len(texts))
                yield part(cut.column(0), cut.column(1), texts, [places_of(x or "") for x in cut.column(2).to_pylist()] if spans else [])
                at += len(texts)

    kept = docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), F.col("text").cast("string"))
    return in_python(kept, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double, n_words long, n_switched long" + (", spans array<struct<start:long,end:long,lang:string,score:double>>" if spans else ""))
