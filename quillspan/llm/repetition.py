"""Repetition inside a single document: rule statistics, scored by an isolation forest.

Rule statistics are the shares of words that lie in a run of one word and of three words that also starts at an
earlier word of the document. An isolation forest is fitted on them, on a bounded sample of rows labelled by the rule
of six words; short mean path lengths single out anomalous documents. One pass over all whole texts computes the
statistics, scores them, and counts runs of six words in the documents that the forest singles out, and in no others
unless all are asked for.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUNS = (1, 3)  # cheap statistics that the forest knows
RULE = 6  # words in a run of the rule itself
SHARE = 0.3
SAMPLE_ROWS = 4000
_BYTES_AT_ONCE = 4_000_000
_STATS = "doc_id bigint, n_words bigint, share_1 double, share_3 double, share_6 double"


def _mixed(a: np.ndarray) -> np.ndarray:
    a = (a ^ (a >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return a ^ (a >> np.uint64(32))


def _grams(words: np.ndarray, docs: np.ndarray) -> Iterator[np.ndarray]:
    """64-bit hashes of the runs of 1 and 3 words from each position, and of ``RULE`` words, different in each document."""
    odd = np.uint64(0x9E3779B97F4A7C15)
    one = _mixed((words + (docs.astype(np.uint64) << np.uint64(32))) * odd)
    yield one
    three = _mixed((one[:-2] * odd + one[1:-1]) * odd + one[2:])
    yield three
    yield _mixed(three[:-3] * odd + three[3:])


def _repeated(gram: np.ndarray, docs: np.ndarray, run: int, n_docs: int) -> np.ndarray:
    """Of each document how many words lie in a run of ``run`` words that starts earlier, too."""
    if run > 1:
        starts = np.nonzero(docs[: len(gram)] == docs[run - 1 :])[0]
        gram = gram[starts]
    again = np.nonzero(pd.Series(gram).duplicated().to_numpy())[0]
    if run > 1:
        again = starts[again]
    covered = np.zeros(len(docs), dtype=bool)
    for k in range(run):
        covered[again + k] = True
    return np.bincount(docs[covered], minlength=n_docs)


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all words in lower case, and the number of the text each is in."""
    low = pc.utf8_lower(pc.fill_null(texts, ""))
    plain = pc.string_is_ascii(low)
    spaced = pc.replace_substring_regex(pc.if_else(plain, "", low), pattern=r"[^\p{L}\p{N}]+", replacement=" ")
    low = pc.if_else(plain, low, spaced)  # now every byte beyond ASCII is part of a word
    offsets = np.frombuffer(low.buffers()[1], dtype=np.int32)[low.offset : low.offset + len(low) + 1]
    text = np.frombuffer(low.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    kind = np.zeros(256, dtype=bool)
    kind[128:] = True
    kind[np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", dtype=np.uint8)] = True
    inside = kind[text]
    # A word begins where the byte before is none of a word, or of another text.
    before = np.zeros(len(text), dtype=bool)
    before[1:] = inside[:-1]
    firsts = offsets[:-1] - offsets[0]
    before[firsts[firsts < len(text)]] = False
    begins = np.nonzero(inside & ~before)[0]
    kept = np.cumsum(inside) - inside
    bounds = np.append(kept[begins], inside.sum()).astype(np.int32)
    words = pa.StringArray.from_buffers(len(begins), pa.py_buffer(bounds), pa.py_buffer(text[inside]))
    docs = np.searchsorted(firsts, begins, side="right") - 1
    return words.dictionary_encode().indices.to_numpy().astype(np.uint64), docs


def _exact(words: list[int], run: int) -> float:
    seen: set[tuple[int, ...]] = set()
    covered = bytearray(len(words))
    for k in range(len(words) - run + 1):
        gram = tuple(words[k : k + run])
        if gram in seen:
            covered[k : k + run] = b"\1" * run
        seen.add(gram)
    return sum(covered) / len(words)


class Statistics:
    """Word counts and the share for each of ``RUNS``; a null or wordless text has 0 words and shares of 0."""

    def __init__(self, texts: pa.Array) -> None:
        self.n = len(texts)
        self.words, self.docs = _words(texts)
        self.count = np.bincount(self.docs, minlength=self.n)
        self.shares = np.zeros((self.n, len(RUNS)))
        for j, (run, gram) in enumerate(zip(RUNS, _grams(self.words, self.docs))):
            self.shares[:, j] = _repeated(gram, self.docs, run, self.n) / np.maximum(self.count, 1)

    def rule(self, chosen: np.ndarray) -> np.ndarray:
        """The share of words in repeated runs of ``RULE`` words of the chosen texts; NaN for the others.

        Runs are compared by 64-bit hashes, which may only raise a share: texts at ``SHARE`` or more are counted again
        word by word.
        """
        out = np.full(self.n, np.nan)
        inside = chosen[self.docs]
        words, docs = self.words[inside], self.docs[inside]
        *_, gram = _grams(words, docs)
        out[chosen] = (_repeated(gram, docs, RULE, self.n) / np.maximum(self.count, 1))[chosen]
        begin = np.concatenate(([0], np.cumsum(self.count)))
        for d in np.nonzero(out >= SHARE)[0]:
            out[d] = _exact(self.words[begin[d] : begin[d + 1]].tolist(), RULE)
        return out


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of bounded bytes; a text larger than that is a part of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes) // _BYTES_AT_ONCE
    at = [0, *(np.nonzero(np.diff(part))[0] + 1), len(sizes)]
    for a, b in zip(at, at[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def _average_path(n: float) -> float:
    """Mean path length of an unsuccessful search in a binary tree of n points."""
    return 0.0 if n <= 1 else 1.0 if n <= 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


@dataclass
class Forest:
    feature: np.ndarray  # tree x node; -1 is a leaf
    split: np.ndarray
    left: np.ndarray
    right: np.ndarray
    path: np.ndarray
    usual: float  # mean path length in a sample of this size
    threshold: float = 0.0  # calibrated on the labelled rows
    bound: float = 0.0  # no row with all statistics of SHARE or more can score less

    @classmethod
    def fit(cls, rows: np.ndarray, *, trees: int = 64, sample: int = 256, seed: int = 7) -> Forest:
        rng = np.random.default_rng(seed)
        size = min(sample, len(rows))
        depth = max(1, math.ceil(math.log2(max(size, 2))))
        nodes = 2 ** (depth + 1) - 1
        made = cls(np.full((trees, nodes), -1), np.zeros((trees, nodes)), np.zeros((trees, nodes), int), np.zeros((trees, nodes), int), np.zeros((trees, nodes)), _average_path(size) or 1.0)
        for t in range(trees):
            made._grow(t, rows[rng.choice(len(rows), size, replace=False)], rng, depth)
        return made

    def _grow(self, t: int, rows: np.ndarray, rng: np.random.Generator, most: int) -> None:
        free, stack = 1, [(0, rows, 0)]
        while stack:
            k, part, depth = stack.pop()
            low, high = (part.min(0), part.max(0)) if len(part) else (np.zeros(1), np.zeros(1))
            can = np.nonzero(high > low)[0]
            if depth >= most or len(part) <= 1 or not len(can):
                self.path[t, k] = depth + _average_path(len(part))
                continue
            f = rng.choice(can)
            s = rng.uniform(low[f], high[f])
            self.feature[t, k], self.split[t, k], self.left[t, k], self.right[t, k] = f, s, free, free + 1
            below = part[:, f] < s
            stack += [(free, part[below], depth + 1), (free + 1, part[~below], depth + 1)]
            free += 2

    def score(self, rows: np.ndarray) -> np.ndarray:
        """2 ** -(mean path / usual path): towards 1 for rows that are isolated early."""
        total = np.zeros(len(rows))
        for t in range(len(self.feature)):
            at = np.zeros(len(rows), dtype=int)
            while True:
                f = self.feature[t, at]
                inner = np.nonzero(f >= 0)[0]
                if not len(inner):
                    break
                k = at[inner]
                at[inner] = np.where(rows[inner, f[inner]] < self.split[t, k], self.left[t, k], self.right[t, k])
            total += self.path[t, at]
        return 2.0 ** (-total / len(self.feature) / self.usual)

    def least_score(self, low: np.ndarray) -> float:
        """A score that no row with statistics of at least ``low`` falls below: each tree's longest path there."""
        total = 0.0
        for t in range(len(self.feature)):
            longest, stack = 0.0, [0]
            while stack:
                k = stack.pop()
                f = self.feature[t, k]
                if f < 0:
                    longest = max(longest, self.path[t, k])
                    continue
                stack.append(self.right[t, k])
                if low[f] < self.split[t, k]:
                    stack.append(self.left[t, k])
            total += longest
        return 2.0 ** (-total / len(self.feature) / self.usual)

    def calibrate(self, rows: np.ndarray, positive: np.ndarray) -> None:
        """Threshold: the score with the best F1 on the labelled rows; without positives the lossless bound."""
        self.bound = self.least_score(np.full(rows.shape[1], SHARE)) - 1e-9
        self.threshold = self.bound
        if not positive.any():
            return
        order = np.argsort(-(scores := self.score(rows)), kind="stable")
        hits = np.cumsum(positive[order])
        f1 = 2 * hits / (np.arange(1, len(rows) + 1) + positive.sum())
        self.threshold = float(scores[order][int(np.argmax(f1))])


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _pieces(batch):
            stats = Statistics(part.column(1))
            yield pa.RecordBatch.from_arrays([*map(pa.array, stats.shares.T), pa.array(stats.rule(np.ones(stats.n, dtype=bool)))], names=["share_1", "share_3", "share_6"])


def fit(docs: DataFrame, *, sample_rows: int = SAMPLE_ROWS) -> Forest | None:
    """The forest for ``docs`` (doc_id, text); None for an empty table.

    Fitted and calibrated on about ``sample_rows`` rows chosen by a hash of their id (twice that at most), which are
    labelled by the rule of six words; the sample's size does not grow with the table. The forest may be kept and
    given to ``repetition`` again, which then reads the texts once.
    """
    share = sample_rows / max(docs.count(), 1)
    chosen = docs if share >= 1 else docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = np.array([[r.share_1, r.share_3, r.share_6] for r in chosen.mapInArrow(_sampled, "share_1 double, share_3 double, share_6 double").limit(2 * sample_rows).collect()])
    if not len(rows):
        return None
    forest = Forest.fit(rows[:, :2])
    forest.calibrate(rows[:, :2], rows[:, 2] >= SHARE)
    return forest


def repetition(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS, forest: Forest | None = None, exact: bool = True) -> DataFrame:
    """One row per document: doc_id, n_words, share_1, share_3, share_6, score, anomalous, candidate.

    ``share_6`` is the repeated share of the whole text: of every document, or without ``exact`` of candidates only and
    null for the others. ``candidate``: the score reaches the bound that no document with a repeated share of
    ``SHARE`` or more can miss, for its shares of shorter runs are as large. ``anomalous``: the score reaches the
    threshold calibrated on labelled rows. Null, empty and wordless texts have shares of 0. Equal rows stay rows of
    their own; an empty table gives an empty result; columns besides the two named are ignored.
    """
    rows = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    forest = forest or fit(rows, sample_rows=sample_rows)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _pieces(batch):
                stats = Statistics(part.column(1))
                score = forest.score(stats.shares) if forest else np.zeros(stats.n)
                candidate = score >= (forest.bound if forest else 1)
                rule = stats.rule(np.ones(stats.n, dtype=bool) if exact else candidate)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(stats.count), *map(pa.array, stats.shares.T), pa.array(rule, from_pandas=True), pa.array(score), pa.array(score >= (forest.threshold if forest else 1)), pa.array(candidate)],
                    names=["doc_id", "n_words", "share_1", "share_3", "share_6", "score", "anomalous", "candidate"],
                )

    return rows.mapInArrow(judge, _STATS + ", score double, anomalous boolean, candidate boolean")


def repetitive(docs: DataFrame, **options) -> DataFrame:
    """Ids of the documents whose repeated share is ``SHARE`` or more: the forest chooses, the rule counts what it chose."""
    return repetition(docs, exact=False, **options).where(F.col("candidate") & (F.col("share_6") >= SHARE)).select("doc_id").distinct()
