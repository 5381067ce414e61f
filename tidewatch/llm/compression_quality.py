"""Quality by compression: how many bytes a dictionary of good text saves on a text beyond one of bad text.

Two zstandard dictionaries are built from labelled text. A whole text is compressed block by
block with each, so that a long text cannot train the compressor on itself; the difference of
the summed sizes over the text's own size is its evidence. Per byte of text, a text that repeats
has a difference near zero, below that of prose, as either dictionary leaves little of it. A
logistic fit of the label on this difference alone, on labelled text that neither dictionary saw,
turns it into a probability, which never falls as the difference grows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.common import labelled_texts, per_text

BLOCK = 512
SAMPLE = 1024  # bytes of a piece that a dictionary is trained on
DICTIONARY_BYTES = 110 * 1024
LEVEL = 3


@dataclass(frozen=True)
class Quality:
    good: bytes
    bad: bytes
    line: tuple[float, float] | None  # log-odds at difference 0, and their rise with it
    share: float


@lru_cache(maxsize=4)
def _compressors(good: bytes, bad: bytes):
    options = dict(level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
    made = []
    for content in (good, bad):
        dictionary = zstandard.ZstdCompressionDict(content)
        dictionary.precompute_compress(level=LEVEL)
        made.append(zstandard.ZstdCompressor(dict_data=dictionary, **{k: v for k, v in options.items() if k != "level"}, level=LEVEL))
    return made


def evidence(texts: list[str], good: bytes, bad: bytes) -> np.ndarray:
    """Size with the bad dictionary less that with the good one, per byte of each text; 0 for an empty one."""
    with_good, with_bad = (c.compress for c in _compressors(good, bad))
    out = np.zeros(len(texts))
    for i, text in enumerate(texts):
        raw = text.encode("utf-8", "surrogatepass")
        if raw:
            saved = 0
            for at in range(0, len(raw), BLOCK):
                block = raw[at : at + BLOCK]
                saved += len(with_bad(block)) - len(with_good(block))
            out[i] = saved / len(raw)
    return out


def _dictionary(texts: list[str]) -> bytes:
    """A dictionary of labelled text; plain content where there is too little to train one."""
    samples = [raw[at : at + SAMPLE] for raw in (t.encode("utf-8", "surrogatepass") for t in texts) for at in range(0, len(raw), SAMPLE)]
    samples = [s for s in samples if len(s) >= 64]
    if sum(map(len, samples)) >= 4 * DICTIONARY_BYTES:
        try:
            return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=512, d=8).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(samples)[-DICTIONARY_BYTES:] or b"\0" * 8


def fit(samples: list[tuple[str, int, float]], seed: int = 11) -> Quality:
    """Learns from (text, 0 or 1, weight), in memory: hand in a bounded sample.

    Half of the sample makes the dictionaries, the other half the calibration. With one label
    only, its share is every score.
    """
    y = np.array([v for _, v, _ in samples], dtype=float)
    w = np.array([m for *_, m in samples], dtype=float)
    if len(set(y)) < 2:
        return Quality(b"", b"", None, float(y[0]) if len(y) else 0.5)
    half = np.random.default_rng(seed).permutation(len(samples)) % 2 == 0
    for v in (0.0, 1.0):  # either half sees either label
        of = np.flatnonzero(y == v)
        half[of[0]] = True
        if len(of) > 1:
            half[of[1]] = False
    good, bad = (_dictionary([t for (t, v, _), h in zip(samples, half) if h and v == label]) for label in (1, 0))
    rest = ~half if len(set(y[~half])) == 2 else half
    found = evidence([t for (t, *_), r in zip(samples, rest) if r], good, bad)
    return Quality(good, bad, _logistic(found, y[rest], w[rest] / w[rest].mean()), 0.0)


def _logistic(d: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Intercept and slope (not below 0) of a lightly penalised logistic fit, by Newton steps that are halved until the loss falls."""
    scale = max(float(d.std()), 1e-9)
    x, beta, ridge = np.stack([np.ones(len(d)), d / scale], axis=1), np.zeros(2), np.array([1e-3, 0.05])

    def loss(b):
        m = x @ b
        return (w * (np.logaddexp(0, m) - y * m)).sum() + (ridge * b * b).sum() / 2

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (w * (p - y)) + ridge * beta)
        while loss(beta - step) > loss(beta) and np.abs(step).max() > 1e-8:
            step = step / 2
        beta = beta - step
        if np.abs(step).max() < 1e-7:
            break
    if beta[1] < 0:  # the difference says nothing here: its share of good text stands for all
        share = float(np.clip((w * y).sum() / w.sum(), 1e-6, 1 - 1e-6))
        return float(np.log(share / (1 - share))), 0.0
    return float(beta[0]), float(beta[1] / scale)


def score(texts: list[str], model: Quality) -> np.ndarray:
    if model.line is None:
        return np.full(len(texts), model.share)
    return 1 / (1 + np.exp(-np.clip(model.line[0] + model.line[1] * evidence(texts, model.good, model.bad), -30, 30)))


def train(docs: DataFrame, labels: DataFrame, per_label: int = 2000, key: str = "doc_id", text: str = "text", label: str = "quality") -> Quality:
    """A model from about ``per_label`` labelled documents of each label (a documented bound)."""
    return fit(labelled_texts(docs, labels, label, key, text, per_label))


def judge(docs: DataFrame, model: Quality, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """Adds ``score`` and ``predicted`` to the columns of ``docs`` and takes the text away.

    Null texts count as empty and are scored like them. Repeated rows give repeated results.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def compute(texts):
        found = score(texts, held.value)
        return [found, (found >= threshold).astype(np.int32)]

    return per_text(docs, text, [("score", T.DoubleType()), ("predicted", T.IntegerType())], compute)


def quality(docs: DataFrame, labels: DataFrame, held_out: Column, per_label: int = 2000) -> DataFrame:
    """Scores of all documents by a model that learns from the labels not held out."""
    model = train(docs, labels.where(~held_out), per_label)
    return judge(docs.select("doc_id", "text", held_out.alias("held_out")), model)
