"""Line-sequence labelling: a linear-chain conditional random field marks lines as content or boilerplate.

Each line has one value for each of a few bucketed features (length, symbols, capitals, ending, repetition ...). The
field has a weight for every feature value and label, and for every pair of labels in a row; Viterbi decoding gives
the best labels of a whole text, and a document is kept if content lines hold at least a given share of its words.

The field is trained here on a bounded sample of documents, with partial labels: a line that a plain rule is sure
about (a sentence of ordinary words; a line of symbols, bars, shouting or notices) has that label, all other lines
are hidden, and the gradient is the difference of expected features with and without the known labels. Training
takes the sample's features, not its texts; decoding is one pass over whole texts that moves no row.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.llm.common import table

CONTENT, BOILERPLATE, HIDDEN = 0, 1, -1

#: The most documents that the field is trained on (those with the smallest hash), each as a whole, and the most lines of all
#: of them: documents that would exceed it are passed over, but one is taken in any case.
TRAIN_ROWS, TRAIN_LINES = 2000, 500_000

#: Lines of a sequence that is trained on; longer texts are several sequences.
PIECE = 2000

#: Cells (lines times sequences) of a padded batch.
CELLS = 200_000

#: A line is a notice if it holds more than one notice word in so many words.
NOTICE_WORDS = 200

#: The least share of a document's words in content lines.
LEAST_CONTENT = 0.5

SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\v\f\r"

#: Words of notices that frame a text rather than belong to it.
NOTICES = ("cookie", "copyright", "all rights reserved", "terms of", "privacy", "subscribe", "click here", "sign up", "log in", "licensed under", "http")

_UPPER, _LETTERS, _DIGITS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", b"0123456789"
_SYMBOL_BYTES = SYMBOLS.encode()

#: Upper ends of the buckets of each numeric feature.
_BUCKETS = {
    "words": (1, 3, 6, 12, 25, 60),
    "word_bytes": (2.5, 4.0, 6.0, 9.0, 14.0),
    "symbols": (0.0, 0.1, 0.3, 0.8),
    "capitals": (0.05, 0.15, 0.35, 0.6),
    "digits": (0.0, 0.05, 0.2),
    "shouts": (0.0, 0.1, 0.5),
}
#: How many values each feature has; the last four: ending, repeated before, notice word, place in the text.
SIZES = (*(len(b) + 1 for b in _BUCKETS.values()), 3, 2, 2, 3)
STARTS = np.concatenate([[0], np.cumsum(SIZES)[:-1]])
N_VALUES = int(sum(SIZES))


def line_features(lines: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature values, one row for each line; words of each line; labels of the lines that a rule is sure about)."""
    n = len(lines)
    raw = np.zeros((len(_BUCKETS), n))
    last, again, notice = np.zeros(n, int), np.zeros(n, int), np.zeros(n, int)
    seen: set[str] = set()
    bars = np.zeros(n)
    for i, line in enumerate(lines):
        b = line.encode("utf-8", "surrogatepass")
        words = len(b.split())
        size = len(b) or 1
        letters = size - len(b.translate(None, _LETTERS))
        raw[:, i] = (
            words,
            size / max(1, words),
            (len(b) - len(b.translate(None, _SYMBOL_BYTES))) / max(1, words),
            (len(b) - len(b.translate(None, _UPPER))) / max(1, letters),
            (len(b) - len(b.translate(None, _DIGITS))) / size,
            b.count(b"!") / max(1, words),
        )
        tail = b.rstrip()[-1:]
        last[i] = 0 if tail in (b".", b"?") else 1 if tail in (b",", b";", b":") else 2
        if words:
            again[i] = line in seen
            seen.add(line)
        low = line.lower()
        notice[i] = NOTICE_WORDS * sum(map(low.count, NOTICES)) > words
        bars[i] = b.count(b"|")
    place = np.ones(n, int)
    if n:
        place[0], place[-1] = 0, 2
    cols = [np.searchsorted(np.array(ends), raw[k], side="left") for k, ends in enumerate(_BUCKETS.values())]
    values = np.stack([*cols, last, again, notice, place], axis=1) + STARTS if n else np.zeros((0, len(SIZES)), int)
    words, symbols, capitals, shouts = raw[0], raw[2], raw[3], raw[5]
    junk = (symbols >= 0.3) | (bars >= 3) | ((capitals >= 0.6) & (words >= 2) & (shouts > 0)) | (shouts >= 0.5)
    plain = (words >= 6) & (symbols == 0) & (capitals < 0.35) & (shouts == 0) & (last < 2) & (notice == 0)
    labels = np.where(junk, BOILERPLATE, np.where(plain, CONTENT, HIDDEN))
    return values, words.astype(np.int64), labels


@dataclass(frozen=True)
class Field:
    """Weights: of each feature value and label, of label pairs, and of the first label."""

    emit: np.ndarray
    step: np.ndarray
    first: np.ndarray


def _padded(seqs: Sequence[np.ndarray], fill) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(s) for s in seqs])
    out = np.full((len(seqs), int(sizes.max(initial=0)), *seqs[0].shape[1:]), fill)
    for i, s in enumerate(seqs):
        out[i, : len(s)] = s
    return out, sizes


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def _expected(scores: np.ndarray, sizes: np.ndarray, step: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over padded sequences: P(label) of each line, and expected counts of label pairs."""
    b, t, _ = scores.shape
    alpha, beta = np.zeros_like(scores), np.zeros_like(scores)
    alpha[:, 0] = first + scores[:, 0]
    for i in range(1, t):
        on = (i < sizes)[:, None]
        alpha[:, i] = np.where(on, _lse(alpha[:, i - 1, :, None] + step, 1) + scores[:, i], alpha[:, i - 1])
    for i in range(t - 2, -1, -1):
        on = (i + 1 < sizes)[:, None]
        beta[:, i] = np.where(on, _lse(step + (scores[:, i + 1] + beta[:, i + 1])[:, None, :], 2), 0.0)
    total = _lse(alpha[np.arange(b), np.maximum(sizes - 1, 0)], 1)
    marginal = np.exp(alpha + beta - total[:, None, None])
    pairs = np.zeros((2, 2))
    for i in range(1, t):
        on = i < sizes
        if on.any():
            p = alpha[on, i - 1, :, None] + step + (scores[on, i] + beta[on, i])[:, None, :] - total[on, None, None]
            pairs += np.exp(p).sum(axis=0)
    return marginal, pairs


def train(samples: Sequence[tuple[np.ndarray, np.ndarray]], epochs: int = 12, rate: float = 0.3, l2: float = 1e-3, batch: int = 100) -> Field:
    """The field that makes the known labels of the samples (feature values, labels) likely; all zero without any."""
    emit, step, first = np.zeros((N_VALUES, 2)), np.zeros((2, 2)), np.zeros(2)
    grown = [np.full_like(x, 1e-2) for x in (emit, step, first)]
    pieces = ((v[k : k + PIECE], y[k : k + PIECE]) for v, y in samples for k in range(0, len(v), PIECE))
    kept = sorted((s for s in pieces if (s[1] != HIDDEN).any()), key=lambda s: len(s[0]))
    for _ in range(epochs):
        for part in (kept[at : at + batch] for at in range(0, len(kept), batch)):
            values, sizes = _padded([v for v, _ in part], 0)
            labels, _ = _padded([y for _, y in part], HIDDEN)
            scores = emit[values].sum(axis=2)
            known = np.where((labels[..., None] != HIDDEN) & (labels[..., None] != np.arange(2)), -1e3, 0.0)
            free, free_pairs = _expected(scores, sizes, step, first)
            held, held_pairs = _expected(scores + known, sizes, step, first)
            inside = (np.arange(values.shape[1]) < sizes[:, None])[..., None]
            gap = (held - free) * inside / len(part)
            g_emit = np.zeros_like(emit)
            np.add.at(g_emit, values, gap[:, :, None, :])
            for w, g, s in zip((emit, step, first), (g_emit - l2 * emit, (held_pairs - free_pairs) / len(part) - l2 * step, gap[:, 0].sum(axis=0) - l2 * first), grown, strict=True):
                s += g * g
                w += rate * g / np.sqrt(s)
    return Field(emit, step, first)


def viterbi(field: Field, seqs: Sequence[np.ndarray]) -> list[np.ndarray]:
    """The best labels of each sequence of feature values; of two equal paths, the one with content."""
    out: list[np.ndarray] = [np.zeros(0, int)] * len(seqs)
    order = sorted((i for i in range(len(seqs)) if len(seqs[i])), key=lambda i: -len(seqs[i]))
    at = 0
    while at < len(order):
        part = order[at : at + max(1, min(256, CELLS // len(seqs[order[at]])))]
        at += len(part)
        n = np.array([len(seqs[i]) for i in part])
        scores = [field.emit[seqs[i]].sum(axis=1) for i in part]
        t = int(n[0])
        best = np.zeros((len(part), 2))
        back = np.zeros((t, len(part), 2), np.int8)
        for k in range(t):
            on = int(np.searchsorted(-n, -k, side="left"))  # sequences with more than k lines come first
            here = np.stack([s[k] for s in scores[:on]])
            if k == 0:
                best[:on] = field.first + here
            else:
                paths = best[:on, :, None] + field.step
                back[k, :on] = paths.argmax(axis=1)
                best[:on] = paths.max(axis=1) + here
        for row, i in enumerate(part):
            path = np.zeros(n[row], int)
            path[-1] = int(best[row].argmax())
            for k in range(n[row] - 1, 0, -1):
                path[k - 1] = back[k, row, path[k]]
            out[i] = path
    return out


def repeated_words(words: Sequence[bytes], window: int = 5) -> int:
    """Words that lie in a window of `window` words found twice or more in the text, the first included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.uint64, len(words))
    h = np.zeros(n, np.uint64)
    for k in range(window):
        h = h * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n] + np.uint64(1)
        h ^= h >> np.uint64(29)
    order = np.sort(h)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(h, twice))
    exact = Counter(tuple(ids[i : i + window].tolist()) for i in at)
    covered = np.zeros(len(words), bool)
    for i in at:
        if exact[tuple(ids[i : i + window].tolist())] > 1:
            covered[i : i + window] = True
    return int(covered.sum())


def base_counts(text: str, lines: Sequence[str]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    words = text.encode("utf-8", "surrogatepass").split()
    seen: set[str] = set()
    dup = 0
    for line in lines:
        if line in seen:
            dup += 1
        elif line.strip(WHITE):
            seen.add(line)
    return len(words), len(text) - sum(map(text.count, WHITE)), sum(map(text.count, SYMBOLS)), dup, repeated_words(words)


def sampled(docs: DataFrame, train_rows: int = TRAIN_ROWS, train_lines: int = TRAIN_LINES) -> DataFrame:
    """h and text of at most train_rows documents with at most train_lines lines, those with the smallest hash h of doc_id
    and text; one document in any case."""
    hashed = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("doc_id", "text").alias("h"))
    last = hashed.select("h").orderBy("h").limit(train_rows).agg(F.max("h")).first()[0]
    picked = hashed.filter(F.col("h") <= F.lit(last))
    sizes = picked.groupBy("h").agg(F.min(F.regexp_count("text", F.lit("\n")) + 1).alias("n")).orderBy("h").collect()  # at most train_rows
    chosen, left = [], train_lines
    for r in sizes:
        if r["n"] <= left:
            chosen.append(r["h"])
            left -= r["n"]
    if not chosen and sizes:
        chosen = [min(sizes, key=lambda r: (r["n"], r["h"]))["h"]]
    wanted = F.broadcast(docs.sparkSession.createDataFrame([(h,) for h in chosen], "h long"))
    return picked.join(wanted, "h").dropDuplicates(["h"])


def fit(docs: DataFrame, train_rows: int = TRAIN_ROWS, train_lines: int = TRAIN_LINES) -> Field:
    """The field trained on the sampled() documents, each as a whole."""
    picked = sampled(docs, train_rows, train_lines)

    def to_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [line_features(t.split("\n")) for t in pdf["text"]]
            yield pd.DataFrame({"h": pdf["h"], "vals": [v.ravel().astype(np.int32) for v, _, _ in found], "labels": [y.astype(np.int32) for _, _, y in found]})

    rows = picked.mapInPandas(to_lines, "h long, vals array<int>, labels array<int>").toPandas().sort_values("h")
    return train([(np.asarray(v, int).reshape(-1, len(SIZES)), np.asarray(y, int)) for v, y in zip(rows["vals"], rows["labels"], strict=True)])


COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_content_lines long, content_words long, line_labels array<byte>"


def labelled(docs: DataFrame, field: Field) -> DataFrame:
    """docs with the counts of each text, the label of each line (0 content, 1 boilerplate), and what content lines hold.

    A null text is one empty line. Columns of docs with the names of new ones are replaced.
    """
    at = docs.sparkSession.sparkContext.broadcast(field)
    names = [c.split()[0] for c in COLUMNS.split(", ")]

    @F.pandas_udf("struct<" + ", ".join(c.replace(" ", ": ", 1) for c in COLUMNS.split(", ")) + ">")
    def of(texts: pd.Series) -> pd.DataFrame:
        rows = []
        texts = [t or "" for t in texts]
        for start in range(0, len(texts), 512):
            lines = [t.split("\n") for t in texts[start : start + 512]]
            feats = [line_features(x) for x in lines]
            paths = viterbi(at.value, [f[0] for f in feats])
            for text, ls, (_, words, _), path in zip(texts[start : start + 512], lines, feats, paths, strict=True):
                good = path == CONTENT
                rows.append((*base_counts(text, ls), len(ls), int((good & (words > 0)).sum()), int(words[good].sum()), path.astype(np.int8)))
        return pd.DataFrame(rows, columns=names)

    kept = [c for c in docs.columns if c.lower() not in names]
    return docs.select(*kept, of(F.col("text")).alias("_lines")).select(*kept, "_lines.*")


def judged(docs: DataFrame, field: Field, least_content: float = LEAST_CONTENT) -> DataFrame:
    """labelled() with base_failed and kept: enough words, few repeated ones, and a large enough share in content lines."""
    bad = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = labelled(docs, field).withColumn("base_failed", bad)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("content_words") >= least_content * F.col("n_words")))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = judged(docs, fit(docs))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_content_lines", "content_words")


QUERIES = {"op6_quality_rules": op6_quality_rules}
ORACLES: dict[str, str] = {}
