"""SentencePiece encoding and decoding as shortest paths of weighted finite-state transducers.

Compiled from a model file: the normaliser (dummy prefix, blanks to U+2581), a lexicon transducer
from characters to pieces, byte fallback with arcs from a character without a piece to those of its bytes, and arc weights in the tropical
semiring (minimum, sum). Encoding composes the input with the normaliser, the result with lexicon and fallback, takes the shortest path and reads its output side.

* Unigram models: a piece weighs minus its score.
* BPE models: scores order merges and are no path weights. There the transducer has a state for each
  last piece, and the arc from piece a to piece b weighs 0 if merging a+b gives exactly (a, b) and
  infinity otherwise. A segmentation is the result of merging if and only if all neighbouring pairs
  are, so one path of weight 0 is left, and at each position one state. Pair weights are computed when met.

Places that no piece crosses split the input; both sides have shortest paths of their own, which are
kept for recurring words. Decoding is the inverse transducer: pieces to bytes, U+2581 to blank, dummy prefix off.
"""

from __future__ import annotations

import re
import struct
import sys
import types
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_python

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
KEPT = 150_000
INF = float("inf")
#: The state before the first arc.
START = -1
WIDE = 1 << 32


def fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = {1: 8, 5: 4}[kind] if kind in (1, 5) else varint()
            yield tag >> 3, raw[at : at + n]
            at += n


class Model:
    """Pieces, their kinds and scores, and the normaliser's settings of a model file."""

    def __init__(self, raw: bytes):
        self.pieces, self.scores, self.kinds = [], [], []
        self.kind, self.dummy, self.squeeze, self.escape, charsmap = UNIGRAM, True, True, True, b""
        for number, value in fields(raw):
            if number == 1:
                piece = dict(fields(value))
                self.pieces.append(piece.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                self.kind = dict(fields(value)).get(3, UNIGRAM)
            elif number == 3:
                norm = dict(fields(value))
                self.dummy, self.squeeze, self.escape = bool(norm.get(3, 1)), bool(norm.get(4, 1)), bool(norm.get(5, 1))
                charsmap = norm.get(2, b"")
        if charsmap or not self.escape or self.kind not in (UNIGRAM, BPE) or USER in self.kinds:
            raise ValueError("character maps, unescaped blanks, user-defined symbols and word or character models are not supported")


class Normaliser:
    """Transducer from text to normalised characters.

    States: at the start, inside a word, in a gap whose mark is still to be written. An arc has what it writes before its
    character, whether it copies that, and its end; characters other than blanks share their arcs, so a run of them is one step.
    """

    RUNS = re.compile("( )|([^ ]+)")

    def __init__(self, m: Model):
        mark = BLANK if m.dummy else ""
        if m.squeeze:  # blanks wait until a character follows: those at both ends write nothing
            self.arcs = {("start", False): (mark, True, "word"), ("start", True): ("", False, "start"), ("word", False): ("", True, "word"), ("word", True): ("", False, "gap"), ("gap", False): (BLANK, True, "word"), ("gap", True): ("", False, "gap")}
        else:
            self.arcs = {("start", False): (mark, True, "word"), ("start", True): (mark + BLANK, False, "word"), ("word", False): ("", True, "word"), ("word", True): (BLANK, False, "word")}
        # From the state inside words the second kind leaves on no arc: there one replacement takes all arcs on blanks.
        self.stays = not m.squeeze

    def compose(self, text: str) -> str:
        """The output side of ``text`` composed with the machine: it is functional, so that is one chain of characters."""
        out, state, at = [], "start", 0
        while at < len(text):
            if self.stays and state == "word":
                out.append(text[at:].replace(" ", self.arcs["word", True][0]))
                break
            blank, run = self.RUNS.match(text, at).groups()
            before, copied, state = self.arcs[state, blank is not None]
            out += (before, run if copied else "")
            at += len(blank or run)
        return "".join(out)


class Codec:
    """Compiled transducers of a model.

    Arcs are numbered: ``names`` is the input side of each, ``outputs`` the ids on its output side as little-endian 32-bit integers, ``weights`` its
    weight. The first are the pieces; byte fallback adds, when it is met, an arc for a character that is no piece, from the character to the pieces of its bytes.
    """

    def __init__(self, model: Model):
        self.m = model
        self.normaliser = Normaliser(model)
        self.lexicon = {p: i for i, (p, k) in enumerate(zip(model.pieces, model.kinds, strict=True)) if k == NORMAL}
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(model.pieces, model.kinds, strict=True)) if k == BYTE}
        self.unknown = next((i for i, k in enumerate(model.kinds) if k == UNKNOWN), 0)
        self.rank = {p: model.scores[i] for p, i in self.lexicon.items()}.get
        self.worst = 10.0 - min(model.scores, default=0.0)
        self.names = list(model.pieces)
        self.outputs = [struct.pack("<i", i) for i in range(len(model.pieces))]
        self.weights = [-x for x in model.scores]
        self.fallback: dict[str, int] = {}
        # Each node of the trie is (arc that ends here or None, nodes by character).
        self.trie: dict = {}
        for p, i in self.lexicon.items():
            nodes = self.trie
            for c in p[:-1]:
                nodes = nodes.setdefault(c, [None, {}])[1]
            nodes.setdefault(p[-1], [None, {}])[0] = i
        self.longest = max(map(len, self.lexicon), default=1)
        inner = [p for p in self.lexicon if len(p) > 1]
        chars = {c for p in inner for c in p}
        # A blank inside a piece behind another character would make words cross; then a text is one unit.
        crossing = any(BLANK in p.lstrip(BLANK) for p in inner)
        joined = "".join(re.escape(c) for c in sorted(chars - {BLANK}))
        self.units = re.compile("(?s).+" if crossing or not joined else f"(?s){BLANK}*[{joined}]+|{BLANK}+|.")
        self.out = [self.surface(i) for i in range(len(model.pieces))]
        self.pairs: dict[int, bool] = {}
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def surface(self, i: int) -> bytes:
        kind, piece = self.m.kinds[i], self.m.pieces[i]
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        if kind == CONTROL:
            return b""
        if kind == UNKNOWN:
            return " ⁇ ".encode()
        return piece.replace(BLANK, " ").encode()

    def byte_arc(self, c: str) -> int:
        """The arc of a character that is no piece: its bytes' pieces, or the unknown piece where the model has none."""
        arc = self.fallback.get(c)
        if arc is None:
            ids = [self.bytes[b] for b in c.encode("utf-8", "surrogatepass")] if self.bytes else [self.unknown]
            arc = self.fallback[c] = len(self.names)
            self.names.append(c)
            self.outputs.append(struct.pack(f"<{len(ids)}i", *ids))
            self.weights.append(self.worst)
        return arc

    def merged(self, text: str) -> list[str]:
        """Pieces of a short string by merging: the best-scored neighbours first, the left of equals."""
        parts, rank = list(text), self.rank
        scores = [rank(a + b, -INF) for a, b in zip(parts, parts[1:], strict=False)]
        while scores:
            best = max(scores)
            if best == -INF:
                break
            i = scores.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del scores[i]
            if i:
                scores[i - 1] = rank(parts[i - 1] + parts[i], -INF)
            if i < len(scores):
                scores[i] = rank(parts[i] + parts[i + 1], -INF)
        return parts

    def joins(self, a: int, b: int) -> bool:
        """Whether the arc b has weight 0 behind the arc a (BPE); START stands for the beginning."""
        x, y = self.names[a] if a != START else "", self.names[b]
        if len(self.pairs) > 2 * KEPT:
            self.pairs.clear()
        found = self.pairs[a * WIDE + b] = self.merged(x + y) == ([x, y] if x else [y])
        return found

    def path(self, unit: str) -> list[int]:
        """Arcs on the shortest path over a unit."""
        last = self.zero_path(unit) if self.m.kind == BPE else self.least_path(unit)
        out, at, names = [], len(unit), self.names
        while at:
            out.append(last[at])
            at -= len(names[last[at]])
        return out[::-1]

    def zero_path(self, unit: str) -> list:
        """Arcs into positions on the path of weight 0.

        Weights are 0 or infinite, so the search follows any arc of weight 0, longest first, and takes up
        shorter ones where that ends. A position is reached by one arc only, and so entered once.
        """
        n, trie, fits_of, joins, longest = len(unit), self.trie, self.pairs.get, self.joins, self.longest
        last: list[int | None] = [None] * (n + 1)
        left: list[tuple[int, list[int], list[int]]] = []  # places that the search may come back to
        i, before = 0, START
        while i < n:
            arcs, ends, nodes, j = [], [], trie, i
            for c in unit[i : i + longest]:
                node = nodes.get(c)
                if node is None:
                    if j > i:
                        break
                    node = (None, None)
                arc, nodes = node
                if arc is None and j == i:
                    arc = self.byte_arc(c)
                j += 1
                if arc is not None:
                    arcs.append(arc)
                    ends.append(j)
                if not nodes:
                    break
            while True:
                if not arcs:
                    before, arcs, ends = left.pop()
                    continue
                arc, j = arcs.pop(), ends.pop()
                if last[j] is None:
                    fits = fits_of(before * WIDE + arc)
                    if joins(before, arc) if fits is None else fits:
                        break
            if arcs:
                left.append((before, arcs, ends))
            last[j] = before = arc
            i = j
        return last

    def least_path(self, unit: str) -> list:
        """As ``zero_path``, for weights of minus the pieces' scores."""
        n, trie, weights = len(unit), self.trie, self.weights
        last: list[int | None] = [None] * (n + 1)
        cost = [0.0] + [INF] * n
        for i in range(n):
            nodes, j, here = trie, i, cost[i]
            for c in unit[i : i + self.longest]:
                node = nodes.get(c)
                if node is None:
                    break
                arc, nodes = node
                j += 1
                if arc is not None and here + weights[arc] < cost[j]:
                    cost[j], last[j] = here + weights[arc], arc
            if here + self.worst < cost[i + 1] and unit[i] not in self.lexicon:
                cost[i + 1], last[i + 1] = here + self.worst, self.byte_arc(unit[i])
        return last

    def unit(self, unit: str) -> bytes:
        found = self.older.get(unit)
        if found is None:
            outputs = self.outputs
            found = b"".join([outputs[arc] for arc in self.path(unit)])
        if len(unit) <= 64:
            if len(self.kept) > KEPT:  # what was met since the last time stays for one more
                self.older, self.kept = self.kept, {}
            self.kept[unit] = found
        return found

    def encode_bytes(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit integers."""
        kept, make = self.kept, self.unit
        return b"".join([kept.get(u) or make(u) for u in self.units.findall(self.normaliser.compose(text))])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<i4").tolist()

    def decode(self, ids: list[int]) -> str:
        raw = b"".join(map(self.out.__getitem__, ids)).decode("utf-8", "replace")
        return raw[1:] if self.m.dummy and raw.startswith(" ") else raw


def in_process(raw: bytes) -> Codec:
    """The codec of a model, compiled once in a worker process: later tasks find it, and the units it has met, again.

    Functions travel by value with globals of their own, so it is kept in a module that they share.
    """
    shared = sys.modules.setdefault("_pointprep_codecs", types.ModuleType("_pointprep_codecs"))
    key = f"c{zlib.crc32(raw)}_{len(raw)}"
    if not hasattr(shared, key):
        setattr(shared, key, Codec(Model(raw)))
    return getattr(shared, key)


def compiled(path: str = MODEL) -> Codec:
    with open(path, "rb") as f:
        return Codec(Model(f.read()))


def model_bytes(docs: DataFrame, path: str) -> bytes:
    """The model file, through Spark's reader: it may lie in any store that Spark reads. A few hundred KB."""
    try:
        with open(path, "rb") as f:
            return f.read()
    except OSError:
        return bytes(docs.sparkSession.read.format("binaryFile").load(path).select("content").first()[0])


def encode(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """``docs`` columns doc_id, and ids (array<int>), n_tokens, decoded (string) of every row.

    A null text has null ids and decoded and 0 tokens; an empty one no ids. ``decoded`` is what the
    inverse transducer gives for ids; it equals the text for models without squeezed blanks.
    """
    raw = docs.sparkSession.sparkContext.broadcast(model_bytes(docs, path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = in_process(raw.value)
        for batch in batches:
            at = 0
            while at < batch.num_rows:  # some 4 MB of text at a time, or one text
                texts, held = [], 0
                while at + len(texts) < batch.num_rows and held < 4_000_000:
                    texts.append(batch.column(1)[at + len(texts)].as_py())
                    held += len(texts[-1] or "")
                part = batch.slice(at, len(texts))
                at += len(texts)
                coded = [None if t is None else np.frombuffer(codec.encode_bytes(t), "<i4") for t in texts]
                sizes = np.array([0 if c is None else len(c) for c in coded])
                offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32), mask=np.array([c is None for c in coded] + [False]))
                some = [c for c in coded if c is not None]
                ids = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(some) if some else np.empty(0, np.int32), pa.int32()))
                decoded = pa.array([None if c is None else codec.decode(c.tolist()) for c in coded], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), ids, pa.array(sizes.astype(np.int64)), decoded], ["doc_id", "ids", "n_tokens", "decoded"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_python(docs.select("doc_id", F.col("text").cast("string")), run, f"doc_id {kind}, ids array<int>, n_tokens long, decoded string")


def report(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256) of every row: the ids and the SHA-256 of the decoded text, null for a null text."""
    return encode(docs, path).select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))
