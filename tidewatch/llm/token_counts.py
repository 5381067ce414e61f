"""Token counts at every prefix of a text, by dynamic programming over the prefixes of its words.

The tokenizer is a byte-pair encoder with word ends: text is lower-cased, cut into words, and
every word is merged on its own. Two facts make one pass over prefixes enough:

* The encoding of ``w[:i]`` ends in the one token ``t`` for which the last token of
  ``w[:i - len(t)]`` and ``t`` stay two tokens when they are encoded together. So the count at
  ``i`` is the count at ``i - len(t)`` plus one.
* A text cut inside a word ends there, so its last token carries the word-end mark; the tokens
  before it do not. The count of every cut is thus one more than an unmarked count.

Counts of prefixes are stored, so truncation and budget questions need no second encoding.
"""

from __future__ import annotations

import json
import unicodedata
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.common import slices

END = "</w>"
CACHED_WORDS = 600_000
DEEPEST = 64
#: Below this code point, letters and digits are listed and case folding is that of the library.
PLAIN = 0x100
#: White space for ``str.split`` but not for the tokenizer.
SEPARATORS = "\x1c\x1d\x1e\x1f"


def _byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself if printable in Latin-1, else the next free code point."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


def _sizes_by_end(tokens: set[str]) -> dict[str, list[int]]:
    """For the last two symbols of a word, and the last one, the lengths of tokens that may end it, longest first."""
    sizes: dict[str, set[int]] = {}
    for t in tokens:
        sizes.setdefault(t[-2:], set()).add(len(t))
    for end in list(sizes):
        sizes[end].update(sizes.get(end[-1], ()))
    return {end: sorted(found, reverse=True) for end, found in sizes.items()}


class PrefixCounter:
    """Exact counts for one tokenizer file; one is kept in each Python worker."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        specials = [t["content"] for t in model["added_tokens"]]
        vocabulary = model["model"]["vocab"]
        self.ranks = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["model"]["merges"])}
        self.inner = {t for t in vocabulary if not t.endswith(END)}
        self.final = {t.removesuffix(END) for t in vocabulary if t.endswith(END)}
        self.inner_sizes, self.final_sizes = map(_sizes_by_end, (self.inner, self.final))
        self.library = Tokenizer.from_file(path)
        self.symbols = _byte_symbols()
        letters = "".join(chr(i) for i in range(PLAIN) if unicodedata.category(chr(i))[0] == "L")
        digits = "".join(chr(i) for i in range(PLAIN) if unicodedata.category(chr(i))[0] == "N")
        rest = re.escape(letters + digits)
        self.words = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{re.escape(letters)}]+|[{re.escape(digits)}]|[^\s{rest}]+")
        self.special = re.compile("|".join(re.escape(s) for s in sorted(specials, key=len, reverse=True))) if specials else None
        self.pairs: dict[tuple[str, str, bool], bool] = {}
        self.states: dict[str, tuple[int, str]] = {"": (0, "")}
        self.chunks: dict[str, int] = {}

    # -- the encoder, used only to compare two neighbouring tokens ---------------------------
    def _merged(self, parts: list[str]) -> list[str]:
        while len(parts) > 1:
            rank, at = min((self.ranks.get(p, 1 << 30), i) for i, p in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 30:
                break
            pair, out, i = (parts[at], parts[at + 1]), [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def _stay_apart(self, left: str, right: str, last: bool) -> bool:
        key = (left, right, last)
        known = self.pairs.get(key)
        if known is None:
            symbols = list(left + right)
            if last:
                symbols[-1] += END
            known = self.pairs[key] = self._merged(symbols) == [left, right + END if last else right]
        return known

    @staticmethod
    def _odd(text: str) -> bool:
        """Whether the library has to normalise and cut the text."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return True
        return any(c in text for c in SEPARATORS)

    # -- prefixes ---------------------------------------------------------------------------
    def _state(self, word: str) -> tuple[int, str]:
        """Count and last token of the word as the unmarked beginning of a longer one."""
        known = self.states.get(word)
        if known is None:
            if len(self.states) > 2 * CACHED_WORDS:
                self.states = {"": (0, "")}
            for end in range(DEEPEST, len(word), DEEPEST):  # so that no recursion gets deep
                self._state(word[:end])
            known = self.states[word] = self._step(word, self.inner_sizes, False)
        return known

    def _step(self, word: str, sizes: dict[str, list[int]], last: bool) -> tuple[int, str]:
        tokens, end = self.final if last else self.inner, len(word)
        for size in sizes.get(word[-2:], ()) or sizes[word[-1]]:
            token = word[end - size :]
            if size <= end and token in tokens:
                count, before = self._state(word[: end - size])
                if not before or self._stay_apart(before, token, last):
                    return count + 1, token
        raise ValueError(f"no token ends {word!r}")

    def _marked(self, symbols: str) -> int:
        """Tokens of a whole word."""
        return self._step(symbols, self.final_sizes, True)[0]

    def _as_symbols(self, word: str) -> str:
        return word if word.isascii() and word.isalpha() else "".join(self.symbols[b] for b in word.encode("utf-8", "surrogatepass"))

    def _chunk(self, chunk: str) -> int:
        """Tokens of a lower-case run without white space."""
        known = self.chunks.get(chunk)
        if known is None:
            if len(self.chunks) > CACHED_WORDS:
                self.chunks.clear()
            known = self.chunks[chunk] = sum(self._marked(self._as_symbols(w)) for w in self.words.findall(chunk))
        return known

    def _cut(self, part: str) -> list[tuple[int, int, str]] | None:
        """Words of a part without special tokens, as (start, end, normal form); None if normalising moves characters."""
        if not self._odd(part):
            lower = part.lower()
            return [(*m.span(), m.group()) for m in self.words.finditer(lower)] if len(lower) == len(part) else None
        normal = self.library.normalizer.normalize_str(part)
        if len(normal) != len(part) or any(len(self.library.normalizer.normalize_str(c)) != 1 for c in part):
            return None
        return [(a, b, normal[a:b]) for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def count(self, text: str) -> int:
        """Tokens of the whole text."""
        total = 0
        for at, part in enumerate(self.special.split(text) if self.special and "<" in text else [text]):
            total += at > 0
            if not self._odd(part):
                known = self.chunks
                for chunk in part.lower().split():
                    n = known.get(chunk)
                    total += self._chunk(chunk) if n is None else n
            else:
                normal = self.library.normalizer.normalize_str(part)
                total += sum(self._marked(p) for p, _ in self.library.pre_tokenizer.pre_tokenize_str(normal))
        return total

    def prefix_counts(self, text: str) -> np.ndarray:
        """Token counts of ``text[:i]`` for every ``i`` from 0 to its length.

        A prefix that ends inside a special string has the count of what stands before that string.
        """
        counts = np.zeros(len(text) + 1, dtype=np.int64)
        at = before = 0
        borders = [m.span() for m in self.special.finditer(text)] if self.special else []
        for start, end in [*borders, (len(text), len(text))]:
            for chunk in re.finditer(r"\S+", text[at:start]):
                a, b = at + chunk.start(), at + chunk.end()
                counts[a : b + 1] = before
                words = self._cut(chunk.group())
                if words is None:
                    for i in range(a + 1, b + 1):
                        counts[i] = before + self.count(text[a:i])
                for s, e, word in words or ():
                    base = counts[a + s]
                    for i in range(1, e - s + 1):
                        cut = [word[0], word[1:i]] if word[0] == "'" and 1 < i < e - s and word[1].isalpha() else [word[:i]]
                        counts[a + s + i] = base + sum(self._marked(self._as_symbols(w)) for w in cut)
                    counts[a + e : b + 1] = counts[a + e]
                before = counts[b]
                counts[b:] = before
            if end > start:
                before += 1
                counts[end:] = before
            at = end
        return counts


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """The worker's counter of a tokenizer file."""
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, tokenizer: str, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Bytes and tokens of every whole text and whether it is over a limit.

    Null texts count as empty: no byte, no token. Every row gives one row, repeated rows
    included; other columns of ``docs`` are not read. ``tokenizer`` is a file that every
    executor has, as installed packages are.
    """
    frame = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    schema = T.StructType([
        frame.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()),
        T.StructField("over_limit", T.BooleanType()),
    ])

    def run(batches):
        count = counter(tokenizer).count
        for batch, texts in slices(batches, "text"):
            tokens = np.fromiter(map(count, texts), dtype=np.int64, count=len(texts))
            n_bytes = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(tokens), pa.array(tokens > limit)], names=schema.names
            )

    return frame.mapInArrow(run, schema)


def truncations(docs: DataFrame, tokenizer: str, budgets: list[int], key: str = "doc_id", text: str = "text") -> DataFrame:
    """For every text and budget, the longest prefix (characters) within the budget and its tokens.

    Counts of prefixes never fall as prefixes of whole words grow, but may fall inside a word;
    the longest prefix within the budget is taken over all prefixes. One pass of prefix counts
    answers all budgets. Null texts count as empty.
    """
    frame = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    schema = T.StructType([
        frame.schema["doc_id"], T.StructField("budget", T.LongType()), T.StructField("n_chars", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
    ])

    def run(batches):
        prefixes = counter(tokenizer).prefix_counts
        for batch, texts in slices(batches, "text"):
            ids, rows = batch.column(0).to_pylist(), []
            for doc, body in zip(ids, texts):
                counts = prefixes(body)
                least = np.minimum.accumulate(counts[::-1])[::-1]
                for budget in budgets:
                    cut = bisect_right(least, budget) - 1
                    rows.append((doc, budget, cut, int(counts[cut]) if cut >= 0 else 0))
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema=pa.schema(
                [batch.schema.field(0), ("budget", pa.int64()), ("n_chars", pa.int64()), ("n_tokens", pa.int64())]))

    return frame.mapInArrow(run, schema)
