"""Toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a text: densities of an insult lexicon and of words that the sample shows to be
toxic, how close insults stand to second-person words, capitals, punctuation and its repeats,
words with symbols between their letters, and insults found after such disguise is undone. All
are counted over the whole text; trees and calibration learn from a bounded labelled sample.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.common import Words, labelled_texts, packed, per_text, unpacked

# Insults, and second-person words, in English, German, French and Spanish.
INSULTS = (
    "idiot idiots moron morons stupid dumb fool imbecile loser losers scum trash garbage filth worthless pathetic disgusting clown clowns "
    "jerk creep pig swine vermin dumbass asshole bastard bitch fuck fucking shit bullshit crap cunt dick damn hate ugly freak retard whore slut "
    "dummkopf idioten trottel depp arschloch scheisse scheiße abschaum wertlos ekelhaft verlierer müll "
    "imbécile connard connasse salaud merde ordure crétin débile abruti racaille "
    "idiota idiotas imbécil estúpido estúpida basura asqueroso asquerosa payaso inútil mierda cabrón pendejo escoria").split()
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine deiner ihr euch tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split()
DISGUISES = str.maketrans("0134578@$!|+", "oieastbasilt")
FEATURES = (
    "log_words insult_density log_insults learned_density log_learned nearness second_person_density capitals capital_words exclamations "
    "punctuation repeated_punctuation symbols_inside undisguised digits").split()


def _hashed(words: list[str]) -> np.ndarray:
    return np.sort(Words([" ".join(words)], "letters").hashes())


def _listed(hashes: np.ndarray, listing: np.ndarray) -> np.ndarray:
    if not len(listing):
        return np.zeros(len(hashes), dtype=bool)
    at = np.minimum(np.searchsorted(listing, hashes), len(listing) - 1)
    return listing[at] == hashes


def _undisguised(token: str) -> bool:
    """Whether a word with symbols or digits between its letters is an insult once they are read as letters or dropped."""
    token = token.strip(".,;:!?\"'()[]{}<>#%&$*").lower()
    plain = token.translate(DISGUISES)
    forms = {plain, "".join(c for c in plain if c.isalpha()), "".join(c for c in token if c.isalpha())}
    return bool(forms & _INSULTS) or ("*" in token and any(
        len(w) == len(token) and len(w) > 3 and all(a in ("*", b) for a, b in zip(token, w)) for w in INSULTS))


_INSULTS = frozenset(INSULTS)
_SPELLED = re.compile("|".join(sorted(INSULTS, key=len, reverse=True)))
_INSULT_HASHES, _SECOND_HASHES = _hashed(INSULTS), _hashed(SECOND_PERSON)


def _mean(of: np.ndarray, flags: np.ndarray, count: int, per: np.ndarray) -> np.ndarray:
    return np.bincount(of[flags], minlength=count) / np.maximum(per, 1)


def features(texts: list[str], learned: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """One row of dense features per text; ``learned``: sorted hashes of words with weights."""
    n = len(texts)
    shown = Words(texts, "letters")
    points, words = shown.points, shown
    folded = _FOLD[points] if len(points) else points
    hashes = shown.hashes(folded)
    of, per = words.text_of, words.per_text
    text_of_char = np.repeat(np.arange(n), np.diff(np.concatenate(([0], words.text_ends))))
    chars = np.bincount(text_of_char, minlength=n) - 1
    insult, second = _listed(hashes, _INSULT_HASHES), _listed(hashes, _SECOND_HASHES)
    out = np.zeros((n, len(FEATURES)))
    insults = np.bincount(of[insult], minlength=n)
    out[:, 0], out[:, 1], out[:, 2] = np.log1p(per), insults / np.maximum(per, 1), np.log1p(insults)
    if len(learned) and len(hashes):
        at = np.minimum(np.searchsorted(learned, hashes), len(learned) - 1)
        known = learned[at] == hashes
        out[:, 3] = np.bincount(of[known], weights[at[known]], n) / np.maximum(per, 1)
        out[:, 4] = np.log1p(np.bincount(of[known], minlength=n))
    # nearness: the largest 1 / (1 + words between) of an insult and a second-person word of its text
    place, persons = np.flatnonzero(insult), np.flatnonzero(second)
    if len(place) and len(persons):
        right = np.searchsorted(persons, place)
        near = np.zeros(len(place))
        for other in (np.clip(right, 0, len(persons) - 1), np.clip(right - 1, 0, len(persons) - 1)):
            other = persons[other]
            near = np.maximum(near, np.where(of[other] == of[place], 1 / (1 + np.abs(other - place)), 0))
        np.maximum.at(out[:, 5], of[place], near)
    out[:, 6] = _mean(of, second, n, per)
    capital = words.mask & (folded != points)
    letters = np.bincount(text_of_char[words.mask], minlength=n)
    out[:, 7] = np.bincount(text_of_char[capital], minlength=n) / np.maximum(letters, 1)
    if len(words.starts):
        sums = np.concatenate(([0], np.cumsum(capital)))
        out[:, 8] = _mean(of, (sums[words.ends] - sums[words.starts] == words.lengths) & (words.lengths > 1), n, per)
    space = _SPACE[points]
    digit = (points >= 48) & (points <= 57)
    mark = ~(words.mask | space | digit)
    out[:, 9] = np.bincount(text_of_char[(points == 33) | (points == 63)], minlength=n) / np.maximum(chars, 1)
    out[:, 10] = np.bincount(text_of_char[mark], minlength=n) / np.maximum(chars, 1)
    again = np.append(False, mark[1:] & (points[1:] == points[:-1]))
    out[:, 11] = np.bincount(text_of_char[again], minlength=n) / np.maximum(chars, 1)
    letter, solid = np.append(words.mask, [False] * 4), ~np.append(space, [True] * 4)
    ahead = letter[2:-2] | (solid[2:-2] & letter[3:-1]) | (solid[2:-2] & solid[3:-1] & letter[4:])  # up to three symbols on
    odd = np.flatnonzero((mark | digit)[1:] & words.mask[:-1] & ahead[: len(points) - 1]) + 1
    out[:, 12] = np.bincount(text_of_char[odd], minlength=n) / np.maximum(per, 1)
    starts = np.concatenate(([0], words.text_ends[:-1]))
    blanks = np.flatnonzero(space)  # tokens lie between white space of any kind; a text's end is one
    odd = odd[(points[odd] != 39) & (points[odd] != 8217)]
    after = np.unique(np.searchsorted(blanks, odd))
    for low, high in zip(np.where(after > 0, blanks[after - 1] + 1, 0), blanks[after]):
        text = text_of_char[low]
        out[text, 13] += _undisguised(texts[text][low - starts[text] : high - starts[text]])
    single = np.flatnonzero(words.lengths == 1)
    for run in np.split(single, np.flatnonzero((np.diff(single) != 1) | (np.diff(of[single]) != 0)) + 1) if len(single) > 2 else ():
        if len(run) > 2:  # letters that stand apart: i d i o t
            out[of[run[0]], 13] += len(_SPELLED.findall("".join(map(chr, folded[words.starts[run]]))))
    out[:, 13] = np.log1p(out[:, 13])
    out[:, 14] = np.bincount(text_of_char[digit], minlength=n) / np.maximum(chars, 1)
    return out


def _fold_table() -> np.ndarray:
    table = np.arange(0x110000, dtype=np.uint32)
    for i in range(0x10000):
        c = chr(i)
        if c.isupper() and len(c.lower()) == 1:
            table[i] = ord(c.lower())
    return table


_FOLD = _fold_table()
_SPACE = np.zeros(0x110000, dtype=bool)
_SPACE[[i for i in range(0x10000) if chr(i).isspace()]] = True


@dataclass
class BoostedTrees:
    """Additive logistic trees on binned features, grown level by level."""

    rounds: int = 60
    depth: int = 2
    rate: float = 0.2
    bins: int = 32
    least_weight: float = 2.0
    penalty: float = 1.0
    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> BoostedTrees:
        steps = np.linspace(0, 1, self.bins + 1)
        values = [np.unique(np.append(np.quantile(c, steps), np.quantile(c[c > 0], steps[::4]) if (c > 0).any() else [])) for c in x.T]
        self.edges = [(v[1:] + v[:-1]) / 2 for v in values]  # halfway between neighbouring quantiles
        b, width = self._binned(x), self.bins + 16
        share = np.clip((w * y).sum() / w.sum(), 1e-6, 1 - 1e-6)
        self.base = float(np.log(share / (1 - share)))
        margin, n = np.full(len(y), self.base), x.shape[1]
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            gradient, hessian = w * (p - y), w * p * (1 - p)
            nodes = (1 << self.depth) - 1
            split, cut, value = np.full(nodes, -1), np.zeros(nodes, dtype=int), np.zeros(2 * nodes + 1)
            at = np.zeros(len(y), dtype=int)
            for level in range(self.depth):
                first, many = (1 << level) - 1, 1 << level
                index = ((at - first)[:, None] * n + np.arange(n)) * width + b
                g, h = (np.bincount(index.ravel(), np.repeat(v, n), many * n * width).reshape(many, n, width).cumsum(axis=2) for v in (gradient, hessian))
                whole_g, whole_h = g[:, :, -1:], h[:, :, -1:]
                gain = g**2 / (h + self.penalty) + (whole_g - g) ** 2 / (whole_h - h + self.penalty) - whole_g**2 / (whole_h + self.penalty)
                gain[(h < self.least_weight) | (whole_h - h < self.least_weight)] = 0
                for k in range(many):
                    best = int(gain[k].argmax())
                    if gain[k].flat[best] > 1e-6:
                        split[first + k], cut[first + k] = divmod(best, width)
                chosen = split[at]
                right = (chosen >= 0) & (b[np.arange(len(y)), np.maximum(chosen, 0)] > cut[at])
                at = 2 * at + 1 + right
            sums, weights = (np.bincount(at, v, len(value)) for v in (gradient, hessian))
            value = -self.rate * sums / (weights + self.penalty)
            self.trees.append((split, cut, value))
            margin = margin + value[at]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        b, out, rows = self._binned(x), np.full(len(x), self.base), np.arange(len(x))
        for split, cut, value in self.trees:
            at = np.zeros(len(x), dtype=int)
            for _ in range(self.depth):
                chosen = split[at]
                at = 2 * at + 1 + ((chosen >= 0) & (b[rows, np.maximum(chosen, 0)] > cut[at]))
            out += value[at]
        return out


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing function of x that fits y best (pool adjacent violators)."""
    x, at = np.unique(x, return_inverse=True)
    weight = np.bincount(at, w)
    blocks: list[list[float]] = []  # weight, mean, lowest x, highest x
    for a, v, m in zip(x, np.bincount(at, w * y) / weight, weight):
        blocks.append([m, v, a, a])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            m2, v2, _, high = blocks.pop()
            last = blocks[-1]
            last[1] = (last[0] * last[1] + m2 * v2) / (last[0] + m2)
            last[0], last[3] = last[0] + m2, high
    knots = [(p, b[1]) for b in blocks for p in ((b[2], b[3]) if b[3] > b[2] else (b[2],))]
    return np.array([k[0] for k in knots]), np.array([k[1] for k in knots])


@dataclass
class Toxicity:
    learned: np.ndarray
    weights: np.ndarray
    trees: BoostedTrees | None
    knots: tuple[np.ndarray, np.ndarray]
    share: float

    def score(self, texts: list[str]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.share)
        return np.clip(np.interp(self.trees.margin(features(texts, self.learned, self.weights)), *self.knots), 0, 1)


def _learned_words(texts: list[str], y: np.ndarray, least: int = 8, ratio: float = 10.0, most: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and weights of words that toxic texts hold far more often than others."""
    words = Words(texts, "letters")
    hashes = words.hashes(_FOLD[words.points])
    pairs = np.unique(np.stack([hashes, words.text_of.astype(np.uint64)]), axis=1)
    unique, word = np.unique(pairs[0], return_inverse=True)
    toxic = y[pairs[1].astype(int)] == 1
    bad, good = np.bincount(word[toxic], minlength=len(unique)), np.bincount(word[~toxic], minlength=len(unique))
    odds = ((bad + 0.5) / max(1, (y == 1).sum())) / ((good + 0.5) / max(1, (y == 0).sum()))
    chosen = np.flatnonzero((bad >= least) & (odds >= ratio))
    chosen = np.sort(chosen[np.argsort(-odds[chosen], kind="stable")][:most])
    return unique[chosen], np.log(odds[chosen])


def fit(samples: list[tuple[str, int, float]], seed: int = 3) -> Toxicity:
    """Learns from (text, 0 or 1, weight), in memory: hand in a bounded sample.

    A third of it gives the learned words, the rest the trees. The calibration is fitted to
    margins of trees that did not see the text: the rest is cut into five, and each part is
    judged by trees grown on the others. A sample of one label gives its share as every score.
    """
    y = np.array([v for _, v, _ in samples], dtype=int)
    w = np.array([m for *_, m in samples], dtype=float)
    none = np.empty(0, np.uint64), np.empty(0)
    if len(set(y)) < 2:
        return Toxicity(*none, None, none, float(y[0]) if len(y) else 0.0)
    texts = [t for t, *_ in samples]
    part = np.empty(len(texts), dtype=int)
    for v in (0, 1):  # labels are spread evenly over the parts, and the trees see either
        of = np.random.default_rng(seed + v).permutation(np.flatnonzero(y == v))
        part[of] = np.append(7, np.arange(1, len(of)) % 8)[: len(of)]
    chosen = part < 3
    learned = _learned_words([t for t, c in zip(texts, chosen) if c], y[chosen]) if chosen.any() else none
    rest = np.flatnonzero(~chosen)
    x = np.concatenate([features([texts[i] for i in rest[at : at + 200]], *learned) for at in range(0, len(rest), 200)])
    part, y, w = part[rest], y[rest], w[rest] / w.mean()
    margin = np.empty(len(y))
    for fold in range(3, 8):
        held = part == fold
        if held.any():
            grown = ~held if len(set(y[~held])) == 2 else np.ones(len(y), dtype=bool)
            margin[held] = BoostedTrees().fit(x[grown], y[grown], w[grown]).margin(x[held])
    return Toxicity(*learned, BoostedTrees().fit(x, y, w), isotonic(margin, y, w), 0.0)


def train(docs: DataFrame, labels: DataFrame, per_label: int = 2000, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Toxicity:
    """A model from about ``per_label`` labelled documents of each label (a documented bound)."""
    return fit(labelled_texts(docs, labels, label, key, text, per_label))


def judge(docs: DataFrame, model: Toxicity, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Adds ``score`` and ``predicted`` to the columns of ``docs`` and takes the text away.

    Null texts count as empty and are scored like them. Repeated rows give repeated results.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def compute(texts):
        score = held.value.score(texts)
        return [score, (score >= threshold).astype(np.int32)]

    return per_text(docs, text, [("score", T.DoubleType()), ("predicted", T.IntegerType())], compute)


def toxicity(docs: DataFrame, labels: DataFrame, held_out: Column, per_label: int = 2000) -> DataFrame:
    """Scores of all documents by a model that learns from the labels not held out."""
    model = train(docs, labels.where(~held_out), per_label)
    return judge(docs.select("doc_id", "text", held_out.alias("held_out")), model)


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that are not judged toxic, by a model learned from the labels.

    All columns come back as they were, whatever their names. Null texts count as empty; repeated
    rows are judged alike, an empty table stays empty.
    """
    judged = judge(packed(docs, "text").withColumn("copy", F.col("text")), train(docs, labels), "copy", threshold)
    return unpacked(judged.where("predicted = 0"), docs.columns, "text")
