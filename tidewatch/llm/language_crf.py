"""Language of every word of a text by a linear-chain conditional random field.

A word's label scores come from hashed character n-grams (those that touch a word's border are
its affixes) and from lexicon memberships; learned transitions tie neighbouring words. Label
probabilities come from forward-backward over the whole text. The model learns from a bounded
sample of labelled documents: runs of their words are spliced into code-switched sequences, so
that transitions between languages are seen in training.

All documents of a batch form one chain, in which a document's first word does not depend on
the word before it. The chain is cut into equal chunks: what each chunk does to a state is one
small matrix, computed for all chunks at once, and chaining the matrices gives every chunk its
exact entry state. Long texts thus cost what short ones do, and nothing is cut off.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.common import BASE, Words, bounded_sample, mixed, packed, per_text, slices, unpacked

UNKNOWN = "und"
BUCKETS = 1 << 16
ORDERS = (1, 2, 3, 4)
CHUNK = 96


@dataclass
class Crf:
    labels: list[str]
    weights: np.ndarray  # (buckets + labels + 1) x labels: n-grams, lexicons, bias
    transitions: np.ndarray
    start: np.ndarray
    lexicon: np.ndarray  # sorted word hashes
    lexicon_label: np.ndarray

    def emissions(self, features: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        index, offsets = features
        if not len(offsets):
            return np.empty((0, len(self.labels)), dtype=np.float32)
        return np.add.reduceat(self.weights[index], offsets, axis=0)


def _word_features(words: Words, chosen: np.ndarray, hashes: np.ndarray, lexicon: np.ndarray, lexicon_label: np.ndarray, n_labels: int):
    """Feature indices of the chosen words, word by word, and where each word's begin."""
    lengths = words.lengths[chosen] + 2
    ends = np.cumsum(lengths)
    begins = ends - lengths
    word = np.repeat(np.arange(len(chosen)), lengths)
    place = np.arange(ends[-1] if len(ends) else 0) - begins[word]
    source = np.clip(words.starts[chosen][word] + place - 1, 0, len(words.points) - 1)
    chars = words.points[source].astype(np.uint64)
    chars[place == 0], chars[place == lengths[word] - 1] = 2, 3  # marks of a word's begin and end
    left = lengths[word] - place
    found, owner = [], []
    gram = np.zeros(len(chars), dtype=np.uint64)
    for n in ORDERS:
        shifted = chars[n - 1 :]
        gram = gram[: len(shifted)] * BASE + shifted + np.uint64(n)
        whole = (left[: len(shifted)] >= n) & ((place[: len(shifted)] > 0) | (n > 1))
        found.append((mixed(gram[whole]) % np.uint64(BUCKETS)).astype(np.int64))
        owner.append(word[: len(shifted)][whole])
    everyone = np.arange(len(chosen))
    if len(lexicon):
        at = np.minimum(np.searchsorted(lexicon, hashes), len(lexicon) - 1)
        listed = lexicon[at] == hashes
        found.append(BUCKETS + lexicon_label[at[listed]])
        owner.append(everyone[listed])
    found.append(np.full(len(chosen), BUCKETS + n_labels))
    owner.append(everyone)
    index, owner = np.concatenate(found), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    index, owner = index[order], owner[order]
    return index, np.searchsorted(owner, everyone)


def _posterior(emit: np.ndarray, begins: np.ndarray, transitions: np.ndarray, start: np.ndarray, with_pairs: bool = False):
    """Label probabilities of each word of the chain; on request also the expected transition counts."""
    n, k = emit.shape
    steps = min(CHUNK, max(1, n))
    chunks = -(-n // steps)
    b = np.ones((chunks * steps, k))
    b[:n] = np.exp(emit - emit.max(axis=1, keepdims=True))
    reset = np.zeros(chunks * steps, dtype=bool)
    reset[:n], reset[0], reset[n:] = begins, True, True
    b, reset = b.reshape(chunks, steps, k).transpose(1, 0, 2), reset.reshape(chunks, steps).T
    a, first = np.exp(transitions), np.exp(start)

    def forward(state, t):  # state: chunks x rows x labels
        state = np.where(reset[t][:, None, None], state.sum(axis=2, keepdims=True) * first, state @ a) * b[t][:, None, :]
        return state / state.sum(axis=(1, 2), keepdims=True)

    def backward(after, t):  # after: chunks x labels, of word t times its own score
        return np.where(reset[t][:, None], (after @ first)[:, None], after @ a.T)

    effect = np.broadcast_to(np.eye(k), (chunks, k, k))
    for t in range(steps):
        effect = forward(effect, t)
    enter, leave = np.empty((chunks, 1, k)), np.ones((chunks, k))
    state = np.full(k, 1 / k)
    for c in range(chunks):
        enter[c, 0] = state
        state = state @ effect[c]
        state = state / state.sum()
    for c in range(chunks - 1, 0, -1):
        state = effect[c] @ leave[c]
        leave[c - 1] = state / state.sum()
    alpha, state = np.empty((steps, chunks, k)), enter
    for t in range(steps):
        state = forward(state, t)
        alpha[t] = state[:, 0]
    gamma, beta = np.empty((steps, chunks, k)), leave
    pairs = np.zeros((k, k))
    for t in range(steps - 1, -1, -1):
        gamma[t] = alpha[t] * beta
        gamma[t] /= gamma[t].sum(axis=1, keepdims=True)
        weighted = beta * b[t]
        if with_pairs:
            before = alpha[t - 1] if t else enter[:, 0]
            joint = before[:, :, None] * a * weighted[:, None, :]
            joint /= joint.sum(axis=(1, 2), keepdims=True)
            real = ~reset[t] & (np.arange(chunks) * steps + t < n)
            pairs += joint[real].sum(axis=0)
        beta = backward(weighted, t)
        beta = beta / beta.sum(axis=1, keepdims=True)
    gamma = gamma.transpose(1, 0, 2).reshape(chunks * steps, k)[:n]
    return (gamma, pairs) if with_pairs else gamma


def fit(samples: list[tuple[str, str]], epochs: int = 4, rate: float = 0.3, run_words: int = 12, seed: int = 5) -> Crf:
    """Learns from (text, language) pairs, in memory: hand in a bounded sample."""
    labels = sorted({lang for _, lang in samples})
    code = {lang: i for i, lang in enumerate(labels)}
    k = len(labels)
    words = Words([(t or "").lower() for t, _ in samples], "letters")
    hashes = words.hashes()
    doc_label = np.array([code[lang] for _, lang in samples], dtype=np.int64)
    label = doc_label[words.text_of]
    crf = Crf(labels, np.zeros((BUCKETS + k + 1, k), np.float32), np.zeros((k, k)), np.zeros(k), np.empty(0, np.uint64), np.empty(0, np.int64))
    if k < 2 or not len(hashes):
        return crf
    # the lexicon: words that at least three sampled documents of one language hold, and hardly any other
    unique, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    in_doc = np.unique(np.stack([inverse, words.text_of]), axis=1)
    spread = np.zeros((len(unique), k))
    np.add.at(spread, (in_doc[0], doc_label[in_doc[1]]), 1)
    listed = (spread.max(axis=1) >= 3) & (spread.max(axis=1) >= 0.9 * spread.sum(axis=1))
    crf.lexicon, crf.lexicon_label = unique[listed], spread[listed].argmax(axis=1)
    index, offsets = _word_features(words, first, unique, crf.lexicon, crf.lexicon_label, k)
    sizes = np.diff(np.append(offsets, len(index)))
    # splice: runs of neighbouring words of one document, in random order
    rng = np.random.default_rng(seed)
    cut = (rng.random(len(hashes)) < 1 / run_words) | np.append(True, words.text_of[1:] != words.text_of[:-1])
    run = np.cumsum(cut) - 1
    order = np.argsort(rng.permutation(run[-1] + 1)[run], kind="stable")
    squares, pair_squares = np.full_like(crf.weights, 1e-6), np.full((k, k), 1e-6)
    batch = 20_000
    for _ in range(epochs):
        for at in range(0, len(order), batch):
            chosen = order[at : at + batch]
            used, slot = np.unique(inverse[chosen], return_inverse=True)
            feature = np.concatenate([index[offsets[u] : offsets[u] + sizes[u]] for u in used])
            starts = np.cumsum(sizes[used]) - sizes[used]
            emit = np.add.reduceat(crf.weights[feature], starts, axis=0)
            begins = np.zeros(len(chosen), dtype=bool)
            begins[0] = True
            gamma, pairs = _posterior(emit[slot], begins, crf.transitions, crf.start, with_pairs=True)
            gamma[np.arange(len(chosen)), label[chosen]] -= 1
            by_word = np.zeros((len(used), k))
            np.add.at(by_word, slot, gamma)
            spread_out = np.repeat(by_word, sizes[used], axis=0)
            gradient = np.stack([np.bincount(feature, spread_out[:, j], len(crf.weights)) for j in range(k)], axis=1) / len(chosen)
            gradient += 1e-6 * crf.weights
            squares += gradient**2
            crf.weights -= (rate * gradient / np.sqrt(squares)).astype(np.float32)
            seen = np.zeros((k, k))
            np.add.at(seen, (label[chosen[:-1]], label[chosen[1:]]), 1)
            step = (pairs - seen) / len(chosen)
            pair_squares += step**2
            crf.transitions -= rate * step / np.sqrt(pair_squares)
    return crf


def word_probabilities(crf: Crf, texts: list[str]) -> tuple[Words, np.ndarray]:
    """The words of the texts and the probabilities of their labels."""
    words = Words([t.lower() for t in texts], "letters")
    unique, first, inverse = np.unique(words.hashes(), return_index=True, return_inverse=True)
    if not len(unique):
        return words, np.empty((0, len(crf.labels)))
    scores = crf.emissions(_word_features(words, first, unique, crf.lexicon, crf.lexicon_label, len(crf.labels)))
    begins = np.append(True, words.text_of[1:] != words.text_of[:-1])
    return words, _posterior(scores[inverse], begins, crf.transitions, crf.start)


def train(docs: DataFrame, per_language: int = 120, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Crf:
    """A model from about ``per_language`` documents of each language, at most twice that (a documented bound).

    Rows with a null text or language are left out. Without any labelled text there is no
    label, and every prediction is ``und``.
    """
    named = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l")).where("t IS NOT NULL")
    rows = bounded_sample(named, "l", "k", per_language).select("k", "t", "l").collect()
    return fit([(r.t, r.l) for r in sorted(rows, key=lambda r: (str(r.k), r.t, r.l))])


def identify(docs: DataFrame, crf: Crf, text: str = "text") -> DataFrame:
    """Adds ``lang_pred`` and ``score`` to the columns of ``docs`` and takes the text away.

    The score is the mean probability of the language over the words of the whole text; the
    language with the highest mean is predicted, the first by code point in a tie. A null text,
    or one without a letter, is ``und`` with score 0. Repeated rows give repeated results.
    """
    model = docs.sparkSession.sparkContext.broadcast(crf)
    names = np.array([*crf.labels, UNKNOWN], dtype=object)

    def compute(texts):
        crf = model.value
        if not crf.labels:
            return [np.full(len(texts), UNKNOWN, dtype=object), np.zeros(len(texts))]
        words, gamma = word_probabilities(crf, texts)
        mean = np.stack([np.bincount(words.text_of, gamma[:, j], len(texts)) for j in range(len(crf.labels))], axis=1)
        mean = mean / np.maximum(words.per_text, 1)[:, None]
        best, empty = mean.argmax(axis=1), words.per_text == 0
        return [names[np.where(empty, len(crf.labels), best)], np.where(empty, 0.0, np.clip(mean.max(axis=1), 0, 1))]

    return per_text(docs, text, [("lang_pred", T.StringType()), ("score", T.DoubleType())], compute)


def language_spans(docs: DataFrame, crf: Crf, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Runs of words of one language: (key, start, end, lang, probability), positions in characters.

    Positions are those of the lower-case text. Texts without a letter give no row.
    """
    model = docs.sparkSession.sparkContext.broadcast(crf)
    frame = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    schema = T.StructType([
        frame.schema["doc_id"], T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
        T.StructField("lang", T.StringType()), T.StructField("probability", T.DoubleType()),
    ])

    def run(batches):
        for batch, texts in slices(batches, "text"):
            crf = model.value
            if not crf.labels:
                continue
            words, gamma = word_probabilities(crf, texts)
            best = gamma.argmax(axis=1)
            new = np.append(True, (best[1:] != best[:-1]) | (words.text_of[1:] != words.text_of[:-1]))[: len(best)]
            at = np.flatnonzero(new)
            last = np.append(at[1:], len(best))[: len(at)] - 1
            shift = np.concatenate(([0], words.text_ends[:-1]))[words.text_of[at]]
            mean = np.add.reduceat(gamma.max(axis=1), at) / (last - at + 1) if len(at) else np.empty(0)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(words.text_of[at])), pa.array(words.starts[at] - shift), pa.array(words.ends[last] - shift),
                pa.array([crf.labels[i] for i in best[at]], pa.string()), pa.array(mean, pa.float64()),
            ], names=schema.names)

    return frame.mapInArrow(run, schema)


def accepted(docs: DataFrame, least_score: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text has one main language; null, letterless and evenly mixed texts go.

    Learns from the rows' own language labels. All columns come back as they were, whatever their
    names; repeated rows are judged alike and an empty table stays empty.
    """
    crf = train(docs)
    judged = identify(packed(docs, "text").withColumn("copy", F.col("text")), crf, "copy")
    return unpacked(judged.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least_score)), docs.columns, "text")


def main_language(spark: SparkSession, docs: DataFrame, held_out) -> DataFrame:
    """Predictions for all rows by a model that learns from the rows not held out."""
    crf = train(docs.where(~held_out))
    return identify(docs.select("doc_id", "text", held_out.alias("held_out")), crf)
