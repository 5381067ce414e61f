"""Quality rules: gradient-boosted trees over document statistics, as numpy node arrays.

Every text gets counts (words, symbols, repeated lines and passages) and shares made from them.
A fixed rule on the counts rejects what no model needs to see; the rest is judged by boosted
trees learned from a bounded labelled sample. On chosen statistics the trees are monotonic: a text
with more symbols, repeated lines or repeated passages, all else equal, never scores higher. All
trees lie in one set of flat arrays (feature, threshold, left, right, value), and a batch of texts
walks through all of them at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.common import Words, bounded_sample, per_text

SYMBOLS = "#*$%&|<>"
WINDOW = 5  # words of a passage that counts as repeated
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Statistics the trees see, and how the score may move as one grows: never up (-1), or freely (0).
STATISTICS = {
    "log_words": 0, "word_length": 0, "symbols_per_word": -1, "dup_line_share": -1, "repeat_share": -1, "stutter_share": -1,
    "distinct_share": 0, "capital_share": 0, "exclamations_per_word": -1, "letterless_share": -1, "digit_share": 0, "mark_share": 0,
    "ended_line_share": 0, "words_per_line": 0,
}
_BLANK = " \t\n\x0b\x0c\r"
_MARKED = np.zeros(128, dtype=bool)
_MARKED[[ord(c) for c in SYMBOLS]] = True


def _kinds() -> dict[str, np.ndarray]:
    letter, capital, digit, solid = (np.zeros(0x110000, dtype=bool) for _ in range(4))
    for i in range(0x20000):
        c = chr(i)
        letter[i], capital[i], digit[i], solid[i] = c.isalpha(), c.isupper(), c.isdigit(), not c.isspace()
    solid[0x20000:] = letter[0x20000:] = True
    return {"letter": letter, "capital": capital, "digit": digit, "mark": solid & ~letter & ~digit}


_KINDS = _kinds()


def _repeated(ids: np.ndarray, text_of: np.ndarray) -> np.ndarray:
    """For each word, whether it lies in a window of ``WINDOW`` words that its text holds twice or more.

    Windows get exact numbers by numbering pairs of numbers: two words, four words, five words.
    """
    n = len(ids)
    if n < WINDOW:
        return np.zeros(n, dtype=bool)

    def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1]

    two = paired(ids[:-1], ids[1:])
    five = paired(paired(two[:-2], two[2:])[:-1], ids[4:])
    starts = np.flatnonzero(text_of[: n - 4] == text_of[4:])
    if not len(starts):
        return np.zeros(n, dtype=bool)
    _, group, size = np.unique(five[starts] * (int(text_of[-1]) + 1) + text_of[starts], return_inverse=True, return_counts=True)
    edges = np.zeros(n + 1, dtype=np.int64)
    again = starts[size[group] > 1]
    np.add.at(edges, again, 1)
    np.add.at(edges, again + WINDOW, -1)
    return np.cumsum(edges[:-1]) > 0


def _lines(text: str) -> tuple[int, int, int]:
    """Lines with a word, those of them equal to an earlier one, and those that end a sentence."""
    seen, repeated, ended = set(), 0, 0
    lines = [line for line in text.split("\n") if line.strip(_BLANK)]
    for line in lines:
        repeated += line in seen
        seen.add(line)
        ended += line.rstrip(_BLANK)[-1] in ".!?…\"'”’»"
    return len(lines), repeated, ended


def statistics(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers (``COUNTS``) and shares (``STATISTICS``) of every text, one row each; they do not depend on the other texts."""
    n = len(texts)
    words = Words(texts, "ascii-spaced")
    of, per, points = words.text_of, words.per_text, words.points
    text_of_char = np.repeat(np.arange(n), np.diff(np.concatenate(([0], words.text_ends))))
    ids = np.unique(words.hashes(), return_inverse=True)[1].astype(np.int64)
    lines = np.array([_lines(t) for t in texts], dtype=np.int64).reshape(n, 3)

    def chars(flags: np.ndarray) -> np.ndarray:
        return np.bincount(text_of_char[flags], minlength=n)

    plain = points < 128
    marked = np.zeros(len(points), dtype=bool)
    marked[plain] = _MARKED[points[plain]]
    letter = _KINDS["letter"][points]
    letters_to = np.concatenate(([0], np.cumsum(letter)))
    counts = np.zeros((n, len(COUNTS)), dtype=np.int64)
    counts[:, 0] = per
    counts[:, 1] = np.bincount(of, words.lengths, n)
    counts[:, 2] = chars(marked)
    counts[:, 3] = lines[:, 1]
    counts[:, 4] = np.bincount(of[_repeated(ids, of)], minlength=n)

    total, size, rows = np.maximum(per, 1), np.maximum(counts[:, 1], 1), np.maximum(lines[:, 0], 1)
    stutter = np.flatnonzero((ids[1:] == ids[:-1]) & (of[1:] == of[:-1])) if len(ids) else np.empty(0, int)
    distinct = np.unique(of * (int(ids.max(initial=0)) + 1) + ids) // (int(ids.max(initial=0)) + 1)
    letterless = letters_to[words.ends] == letters_to[words.starts]
    shares = np.stack([
        np.log1p(per), counts[:, 1] / total, counts[:, 2] / total, lines[:, 1] / rows, counts[:, 4] / total,
        np.bincount(of[stutter], minlength=n) / total, np.bincount(distinct, minlength=n) / total,
        chars(_KINDS["capital"][points]) / np.maximum(chars(letter), 1), chars((points == 33) | (points == 63)) / total,
        np.bincount(of[letterless], minlength=n) / total, chars(_KINDS["digit"][points]) / size, chars(_KINDS["mark"][points]) / size,
        lines[:, 2] / rows, per / rows], axis=1)
    return counts, shares


def base_failed(counts: np.ndarray) -> np.ndarray:
    """Whether a text is too short or more than a fifth of it repeated passages."""
    return (counts[:, 0] < 10) | (100 * counts[:, 4] > 20 * counts[:, 0])


@dataclass
class FlatTrees:
    """All nodes of all trees, one after another; a leaf leads to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray, block: int = 4096) -> np.ndarray:
        """Log-odds of each row: every row stands at one node of every tree, and all step down together."""
        out = np.full(len(x), self.base)
        for start in range(0, len(x), block):
            part = x[start : start + block]
            rows, at = np.arange(len(part))[:, None], np.broadcast_to(self.roots, (len(part), len(self.roots)))
            for _ in range(self.depth):
                at = np.where(part[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            out[start : start + block] += self.value[at].sum(axis=1)
        return out


def grow(
    x: np.ndarray, y: np.ndarray, w: np.ndarray, directions: list[int], rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 64,
    penalty: float = 1.0, least_weight: float = 2.0,
) -> FlatTrees:
    """Logistic boosted trees on binned statistics, each monotonic where ``directions`` says so.

    A split on a directed feature is taken only if its sides' values stand the right way round, and
    what grows below either side is held on its side of their middle; so every tree, and the
    sum of all, keeps the direction everywhere, not only on the learned rows.
    """
    values = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1))) for c in x.T]
    edges = [(v[1:] + v[:-1]) / 2 for v in values]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)  # a bin ends with its edge
    width, n_features = bins + 1, x.shape[1]
    valid = np.arange(width)[None, :] < np.array([len(e) for e in edges])[:, None]
    direction = np.array(directions)[:, None]
    share = np.clip((w * y).sum() / w.sum(), 1e-6, 1 - 1e-6)
    base = float(np.log(share / (1 - share)))
    margin = np.full(len(y), base)
    nodes: list[list[float]] = []  # feature, threshold, left, right, value
    roots = []

    def best(g, h, low, high):
        return np.clip(-g / (h + penalty), low, high)

    def gain(g, h, v):
        return -(2 * g * v + (h + penalty) * v * v)

    def add(rows, gradient, hessian, level, low, high) -> int:
        here = len(nodes)
        whole_g, whole_h = gradient[rows].sum(), hessian[rows].sum()
        value = float(best(whole_g, whole_h, low, high))
        nodes.append([0, np.inf, here, here, rate * value])
        if level < depth:
            slot = (np.arange(n_features) * width + binned[rows]).ravel()
            g, h = (np.bincount(slot, np.repeat(v[rows], n_features), n_features * width).reshape(n_features, width).cumsum(axis=1) for v in (gradient, hessian))
            below, above = best(g, h, low, high), best(whole_g - g, whole_h - h, low, high)
            better = gain(g, h, below) + gain(whole_g - g, whole_h - h, above) - gain(whole_g, whole_h, value)
            better[~valid | (h < least_weight) | (whole_h - h < least_weight) | (direction * (above - below) < 0)] = 0
            f, cut = divmod(int(better.argmax()), width)
            if better[f, cut] > 1e-6:
                goes = binned[rows, f] <= cut
                bounds = [(low, high), (low, high)]
                if directions[f]:
                    middle = float(below[f, cut] + above[f, cut]) / 2
                    bounds = [(low, middle), (middle, high)] if directions[f] > 0 else [(middle, high), (low, middle)]
                left = add(rows[goes], gradient, hessian, level + 1, *bounds[0])
                right = add(rows[~goes], gradient, hessian, level + 1, *bounds[1])
                nodes[here] = [f, edges[f][cut], left, right, 0.0]
                return here
        margin[rows] += rate * value
        return here

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        roots.append(add(np.arange(len(y)), w * (p - y), w * p * (1 - p), 0, -np.inf, np.inf))
    table = np.array(nodes, dtype=float).reshape(-1, 5)
    return FlatTrees(
        table[:, 0].astype(np.int32), table[:, 1], table[:, 2].astype(np.int32), table[:, 3].astype(np.int32), table[:, 4],
        np.array(roots, dtype=np.int32), depth, base)


def train(
    docs: DataFrame, labels: DataFrame, per_label: int = 2000, key: str = "doc_id", text: str = "text", label: str = "quality",
) -> FlatTrees:
    """Trees from about ``per_label`` labelled documents of each label, never more than twice that on average (a documented bound).

    Texts stay on the executors: their statistics are computed there, and one row of them per
    sampled key comes back. Of rows that repeat a key, in either frame, the least statistics and the
    least label count; null keys and labels are left out. Without rows of both labels the trees are
    empty and all texts score the label's share (1 without any).
    """
    known = labels.select(F.col(key).alias("k"), F.col(label).alias("label")).dropna().groupBy("k").agg(F.min("label").alias("label"))
    chosen = bounded_sample(known, "label", "k", per_label)
    met = docs.select(F.col(key).alias("k"), F.col(text).alias("text")).join(F.broadcast(chosen), "k")
    rows = per_text(met, "text", [("x", T.ArrayType(T.DoubleType()))], lambda texts: [statistics(texts)[1].tolist()])
    rows = rows.groupBy("k", "label", "weight").agg(F.min("x").alias("x")).collect()
    rows.sort(key=lambda r: str(r.k))
    x, y, w = np.array([r.x for r in rows]), np.array([float(r.label) for r in rows]), np.array([r.weight for r in rows])
    if len(set(y)) < 2:
        share = float(y[0]) if len(y) else 1.0
        empty = np.empty(0, np.int32)
        return FlatTrees(empty, np.empty(0), empty, empty, np.empty(0), empty, 0, 40.0 if share > 0.5 else -40.0)
    return grow(x, y, w / w.mean(), list(STATISTICS.values()))


def judge(docs: DataFrame, trees: FlatTrees, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The columns of ``docs`` without the text, and the five counts, base_failed, score and kept.

    ``score`` is the trees' probability of good text; ``kept`` is false if ``base_failed``, else
    whether the score reaches ``threshold``. A null text counts as empty, and so fails the base
    rule. Whole texts are read, of any length; repeated rows give repeated results, an empty
    table none. Columns of ``docs`` named like a result are replaced by it.
    """
    sent = docs.sparkSession.sparkContext.broadcast(trees)  # a few hundred nodes

    def compute(texts):
        counts, shares = statistics(texts)
        score = 1 / (1 + np.exp(-sent.value.margin(shares)))
        failed = base_failed(counts)
        return [*np.ascontiguousarray(counts.T), failed, score, ~failed & (score >= threshold)]

    added = [(c, T.LongType()) for c in COUNTS] + [("base_failed", T.BooleanType()), ("score", T.DoubleType()), ("kept", T.BooleanType())]
    results = {name for name, _ in added}
    return per_text(docs.select(*[c for c in docs.columns if c == text or c.lower() not in results]), text, added, compute)


def quality_rules(docs: DataFrame, labels: DataFrame, per_label: int = 2000) -> DataFrame:
    """Counts and verdict of every document, by trees that learn from the labels."""
    return judge(docs.select("doc_id", "text"), train(docs, labels, per_label))
