"""Quality scores by logistic regression over hashed word n-grams, trained by FTRL.

A text's pieces are its runs of word characters and its runs of other visible characters; a feature is the hash of a
piece or of two pieces in a row, with the value log(1 + count), scaled to unit length for each text. The model is
fitted on at most `train_rows` labelled documents (those with the smallest hash of doc_id), which are turned into
features on the executors; scoring is one pass over all texts, a sparse dot product each, and moves no row.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.llm.common import table, written
from vellumine.llm.ftrl import Linear, train

#: Features are hashed to 2**HASH_BITS numbers.
HASH_BITS = 18

#: The most labelled documents that the model is fitted on.
TRAIN_ROWS = 8000

_PIECE = re.compile(r"\w+|[^\w\s]+").findall
_MEMO: dict[str, bytes] = {}


def _hashes(word: str) -> bytes:
    return np.array([zlib.crc32(p.encode("utf-8", "surrogatepass")) for p in _PIECE(word)], "<u4").tobytes()


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers of a text, ascending, and their values; none for an empty text."""
    words = text.split()
    if len(_MEMO) > 300_000:
        _MEMO.clear()
    for w in set(words).difference(_MEMO):
        _MEMO[w] = _hashes(w)
    one = np.frombuffer(b"".join(map(_MEMO.__getitem__, words)), "<u4").astype(np.uint64)
    if not len(one):
        return np.zeros(0, np.int64), np.zeros(0)
    two = (one[:-1] * np.uint64(0x9E3779B1) + one[1:]) * np.uint64(0xD6E8FEB86659FD93)
    shift = np.uint64(64 - HASH_BITS)
    at = np.concatenate([(one * np.uint64(0x9E3779B97F4A7C15)) >> shift, two >> shift])
    ids, counts = np.unique(at, return_counts=True)
    values = np.log1p(counts)
    return ids.astype(np.int64), values / np.sqrt(values @ values)


def in_fold(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of doc_id as text leaves this remainder; false for a null doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def labelled_sample(labels: DataFrame, label: str, folds: int, held_out: int, rows: int) -> DataFrame:
    """doc_id and label of at most `rows` labelled documents outside the held-out fold, those with the smallest hash.

    A document labelled several times has the mean of its labels; null labels and null doc_ids are left out.
    """
    fit = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~in_fold(F.col("doc_id"), folds, held_out))
    one = fit.groupBy("doc_id").agg(F.avg(label).alias("label"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def one_text_each(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """doc_id, label and text of the sampled documents, one row for each: of several texts the one with the smallest hash.

    A repeated doc_id is reduced on the map side, so what goes on is bounded by the sample, however many rows share an id.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(sample, "doc_id")
    return texts.groupBy("doc_id").agg(F.first("label").alias("label"), F.min_by("text", F.struct(F.xxhash64("text"), F.length("text"))).alias("text"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 4, held_out: int = 2, train_rows: int = TRAIN_ROWS) -> Linear:
    """The model fitted on the labelled documents outside the held-out fold."""
    sample = written(labelled_sample(labels, label, folds, held_out, train_rows), "quality-sample")

    def to_features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [features(t) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "label": pdf["label"], "ids": [i.astype(np.int32) for i, _ in found], "vals": [v.astype(np.float32) for _, v in found]})

    rows = one_text_each(docs, sample).mapInPandas(to_features, "doc_id long, label double, ids array<int>, vals array<float>").toArrow().combine_chunks()
    labels_, doc_ids = rows["label"].to_numpy(), rows["doc_id"].to_pylist()
    share = float(labels_.mean()) if len(labels_) else 0.5
    rare = min(4.0, max(1.0, (share / max(1e-9, 1 - share)) ** 0.5))
    column = lambda c: (rows[c].chunk(0).offsets.to_numpy(), rows[c].chunk(0).values.to_numpy()) if len(labels_) else (np.zeros(1, int), np.zeros(0))
    (ends, ids), (_, values) = column("ids"), column("vals")
    order = np.argsort([zlib.crc32(str(d).encode()) for d in doc_ids], kind="stable") if len(labels_) else []
    data = [(ids[ends[k] : ends[k + 1]], values[ends[k] : ends[k + 1]], labels_[k], rare if labels_[k] < 0.5 else 1.0) for k in order]
    return train(data, 1 << HASH_BITS, alpha=0.3, l1=0.02)


def score(docs: DataFrame, model: Linear, threshold: float = 0.7) -> DataFrame:
    """docs with score (from 0 to 1) and predicted (1 where score >= threshold).

    Null and empty texts have the score of the bias alone. Columns score and predicted of docs are replaced.
    """
    at = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        m = at.value
        margins = np.full(len(texts), m.bias)
        for k, t in enumerate(texts):
            if t:
                ids, values = features(t)
                margins[k] += float(m.weights[ids] @ values)
        return pd.Series(m.score(margins))

    kept = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    return docs.select(*kept, of(F.col("text")).alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", in_fold(F.col("doc_id"), 4, 2).alias("held_out"), "score", "predicted")


QUERIES = {"op7_quality_classifier": op7_quality_classifier}
ORACLES: dict[str, str] = {}
