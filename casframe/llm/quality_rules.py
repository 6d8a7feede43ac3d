"""Quality rules: gradient-boosted trees over document statistics.

A histogram learner in numpy grows small trees on a bounded sample of labelled
rows; chosen features may only lower the probability of being kept.  The
trees are flattened into node arrays, which score a batch of documents level by
level.  Scoring is one narrow pass, without a shuffle.

Defined cases: a null or empty text has no words, so the base rule rejects
it; rows with a null doc_id are judged like any other; repeated rows get
the same verdict each; columns that clash with a result column are replaced by it.
Without labelled rows of both kinds the model keeps what the base rule keeps.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casframe.llm.common import SPACES, bounded_sample, slices, text_bytes

#: Labelled rows, about, that the classifier is fitted on where there are more.
MAX_TRAINING_ROWS = 6_000
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = b"#*$%&|<>"
#: Probability of good quality from which a document is kept.
THRESHOLD = 0.5

#: Name and direction: -1 may only lower the probability of good quality, 0 is free.
FEATURES = (
    ("log_words", 0),
    ("mean_word_chars", 0),
    ("symbol_ratio", -1),
    ("dup_line_ratio", -1),
    ("repeat_ratio", -1),
    ("upper_ratio", -1),
    ("exclaim_ratio", -1),
    ("digit_ratio", 0),
    ("unique_ratio", 0),
    ("top_word_share", -1),
    ("lines_per_word", 0),
)
DIRECTIONS = tuple(d for _, d in FEATURES)

_CONTINUATION = bytes(range(0x80, 0xC0))
_NOT_CHARS = SPACES + _CONTINUATION
_UPPER = bytes(range(0x41, 0x5B))
_DIGITS = bytes(range(0x30, 0x3A))


def repeated_words(ids: np.ndarray, distinct: int) -> int:
    """How many words stand in a 3-word window that occurs twice or more."""
    n = len(ids)
    if n < 4:
        return 0
    _, pairs = np.unique(ids[:-1] * distinct + ids[1:], return_inverse=True)
    _, windows, counts = np.unique(pairs[:-1] * distinct + ids[2:], return_inverse=True, return_counts=True)
    again = counts[windows] > 1
    if not again.any():
        return 0
    held = np.zeros(n, bool)
    held[:-2] |= again
    held[1:-1] |= again
    held[2:] |= again
    return int(held.sum())


def statistics(text: bytes | None) -> tuple[list[int], list[float]]:
    """The base counts (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) and the features."""
    text = text or b""
    words = text.split()
    n = len(words)
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    repeats = repeated_words(ids, len(seen))
    chars = len(text.translate(None, _NOT_CHARS))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    dup = len(lines) - len(set(lines))
    some, letters = max(n, 1), max(chars, 1)
    top = int(np.bincount(ids).max()) if n else 0
    return [n, chars, symbols, dup, repeats], [
        float(np.log1p(n)),
        chars / some,
        symbols / letters,
        dup / max(len(lines), 1),
        repeats / some,
        (len(text) - len(text.translate(None, _UPPER))) / letters,
        text.count(b"!") / some,
        (len(text) - len(text.translate(None, _DIGITS))) / letters,
        len(seen) / some,
        top / some,
        len(lines) / some,
    ]


@dataclass
class Forest:
    """Trees flattened one after another: a leaf has feature -1, and its value."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    bias: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row; every row walks down every tree at once."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        while True:
            f = self.feature[at]
            inner = f >= 0
            if not inner.any():
                return self.bias + self.value[at].sum(axis=1)
            low = x[rows, np.where(inner, f, 0)] <= self.threshold[at]
            at = np.where(inner, np.where(low, self.left[at], self.right[at]), at)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.margin(x)))


def fit(
    x: np.ndarray,
    y: np.ndarray,
    directions: tuple[int, ...] = DIRECTIONS,
    trees: int = 60,
    depth: int = 3,
    rate: float = 0.15,
    bins: int = 64,
    l2: float = 1.0,
    least_rows: int = 5,
) -> Forest:
    """Boosted trees under logistic loss.

    A split on a constrained feature must order its children's values as the
    feature asks, and the subtrees stay on their side of the midpoint, so that each
    tree, and so the sum, is monotone.
    """
    n, k = x.shape
    mean = float(np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3))
    bias = float(np.log(mean / (1 - mean)))
    nodes: list[list[float]] = []
    roots: list[int] = []
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for j in range(k)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(k)], axis=1) if n else np.zeros((0, k), int)
    margin = np.full(n, bias)

    def weight(g: np.ndarray | float, h: np.ndarray | float, low: float, high: float):
        return np.clip(-g / (h + l2), low, high)

    def gain(g, h, w):
        return -(g * w + 0.5 * (h + l2) * w * w)

    def grow(rows: np.ndarray, left_depth: int, low: float, high: float) -> int:
        own = len(nodes)
        g, h = grad[rows], hess[rows]
        w = float(weight(g.sum(), h.sum(), low, high))
        nodes.append([-1, 0.0, -1, -1, rate * w])
        best, base = None, float(gain(g.sum(), h.sum(), w)) + 1e-6
        if left_depth and len(rows) >= 2 * least_rows:
            for j in range(k):
                m = len(edges[j])
                if not m:
                    continue
                b = binned[rows, j]
                gl = np.bincount(b, g, m + 1).cumsum()[:m]
                hl = np.bincount(b, h, m + 1).cumsum()[:m]
                cl = np.bincount(b, minlength=m + 1).cumsum()[:m]
                gr, hr = g.sum() - gl, h.sum() - hl
                wl, wr = weight(gl, hl, low, high), weight(gr, hr, low, high)
                ok = (cl >= least_rows) & (len(rows) - cl >= least_rows) & (directions[j] * (wr - wl) >= 0)
                total = np.where(ok, gain(gl, hl, wl) + gain(gr, hr, wr), -np.inf)
                i = int(total.argmax())
                if total[i] > base:
                    base, best = float(total[i]), (j, i, float(wl[i]), float(wr[i]))
        if best:
            j, i, wl, wr = best
            middle, lows, highs = (wl + wr) / 2, [low, low], [high, high]
            if directions[j] > 0:
                highs[0], lows[1] = middle, middle
            elif directions[j] < 0:
                lows[0], highs[1] = middle, middle
            below = binned[rows, j] <= i
            nodes[own][0], nodes[own][1] = j, float(edges[j][i])
            nodes[own][2] = grow(rows[below], left_depth - 1, lows[0], highs[0])
            nodes[own][3] = grow(rows[~below], left_depth - 1, lows[1], highs[1])
        return own

    def forest() -> Forest:
        a = np.array(nodes, dtype=float).reshape(-1, 5)
        return Forest(np.array(roots, int), a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4], bias)

    if n and 0 < y.sum() < n:
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            grad, hess = p - y, p * (1 - p)
            first = len(nodes)
            roots.append(grow(np.arange(n), depth, -4.0, 4.0))
            one = np.array(nodes[first:], dtype=float)
            shift = Forest(np.array([0]), one[:, 0].astype(int), one[:, 1], one[:, 2].astype(int) - first, one[:, 3].astype(int) - first, one[:, 4], 0.0)
            margin = margin + shift.margin(x)
    return forest()


_RESULT = (
    ("n_words", T.LongType(), pa.int64()),
    ("word_chars", T.LongType(), pa.int64()),
    ("n_symbols", T.LongType(), pa.int64()),
    ("n_dup_lines", T.LongType(), pa.int64()),
    ("n_repeat_words", T.LongType(), pa.int64()),
    ("base_failed", T.BooleanType(), pa.bool_()),
    ("kept", T.BooleanType(), pa.bool_()),
    ("quality_probability", T.DoubleType(), pa.float64()),
)


def training_sample(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of about max_rows labelled documents at most."""
    ids = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("__quality"))
    ids = bounded_sample(ids, max_rows)
    rows = docs.select("doc_id", text_bytes().alias("__text")).join(F.broadcast(ids), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [statistics(t)[1] for _, part in slices(b.column(1)) for t in part]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.list_(pa.float64())), b.column(2)], names=["doc_id", "x", "y"])

    got = rows.select("doc_id", "__text", F.col("__quality").cast("long")).mapInArrow(run, "doc_id long, x array<double>, y long").toArrow()
    if not got.num_rows:
        return np.zeros((0, len(FEATURES))), np.zeros(0)
    x, y = np.array(got["x"].to_pylist()), (np.array(got["y"]) > 0).astype(float)
    order = np.lexsort([*x.T, np.array(got["doc_id"])])  # rows come in any order, and the trees must not depend on it
    return x[order], y[order]


def judge(docs: DataFrame, forest: Forest, columns: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """The given columns of every row, with the base counts and the verdict, in one narrow pass."""
    carried = [c for c in columns if c not in {r[0] for r in _RESULT}]
    rows = docs.select(*(F.col(f"`{c}`") for c in carried), text_bytes().alias("__text"))
    schema = T.StructType([*rows.schema.fields[:-1], *(T.StructField(n, t) for n, t, _ in _RESULT)])
    shared = docs.sparkSession.sparkContext.broadcast(forest)  # a few thousand nodes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            for start, part in slices(b.column(b.num_columns - 1)):
                got = [statistics(t) for t in part]
                base = np.array([x[0] for x in got], np.int64).reshape(-1, 5)
                p = model.probability(np.array([x[1] for x in got]).reshape(-1, len(FEATURES)))
                failed = (base[:, 0] < MIN_WORDS) | (100 * base[:, 4] > MAX_REPEAT_PERCENT * base[:, 0])
                out = [*base.T, failed, ~failed & (p >= threshold), p]
                own = b.slice(start, len(part))
                yield pa.RecordBatch.from_arrays(
                    [*(own.column(i) for i in range(len(carried))), *(pa.array(v, t) for v, (_, _, t) in zip(out, _RESULT, strict=True))],
                    names=[f.name for f in schema],
                )

    return rows.mapInArrow(run, schema)


def quality_rules(docs: DataFrame, labels: DataFrame, columns: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Judge every document by trees fitted on the labelled ones."""
    return judge(docs, fit(*training_sample(docs, labels)), columns or ["doc_id"], threshold)
