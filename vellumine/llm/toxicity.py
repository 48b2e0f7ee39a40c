"""Toxicity scores by weak supervision.

1. Voters. Lexicons of words and of word beginnings are gathered from a bounded sample of labelled documents: a term
   belongs to one if it is far more frequent in toxic documents than in others, and each lexicon is chosen to cover as
   many of the toxic documents as it can; a general list of insults is one more lexicon, and patterns (several hits,
   dense hits, an insult set off by symbols or in capitals) are the last voters. A voter says yes or no on a document.
2. Label model. Spark counts the vote patterns over all documents (at most 2**VOTERS rows). A generative model of the
   hidden label is fitted to these counts by expectation maximisation: each voter's accuracy on either class, where a
   voter may also depend on one other voter; those dependencies are the tree of greatest conditional mutual
   information (correlations of voters), found anew in every round. Its posterior is the label of a pattern.
3. Classifier. A linear model over hashed words and word beginnings is trained on the posterior labels of a bounded
   sample of documents by FTRL, and scores every whole text.

Labels are learnt from outside the held-out fold only; lang, source and doc_id are inputs of no score.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.llm.common import column_name, table, written
from vellumine.llm.ftrl import Linear, train
from vellumine.llm.quality_classifier import in_fold, labelled_sample, one_text_each

#: A general list of insults, for corpora without labels.
INSULTS = tuple("idiot moron stupid dumb loser scum trash garbage pathetic worthless disgusting clown fool jerk creep vermin filth imbecile".split())

#: Lexicons that are gathered from labelled documents; with the general list and three patterns: the number of voters.
LEXICONS = 5
VOTERS = LEXICONS + 4

#: The most labelled documents for the lexicons; the most documents of either kind for the classifier.
LABELLED_ROWS, TRAIN_ROWS = 8000, 4000

HASH_BITS = 19

#: Lengths of the word beginnings that are terms, the mark that sets them apart from words, and the mark of a term that
#: a document has twice or more.
STARTS, MARK, TWICE = (4, 5, 6, 7, 8), "*", "+"

_LETTERS = re.compile(r"[^\W\d_]+").findall
_SET_OFF = re.compile(r"[#*$%&!@]")


def terms(word: str) -> list[str]:
    """The terms of one word as it stands between white space: its letter runs in lower case, and their beginnings."""
    out = []
    for w in _LETTERS(word):
        w = w.lower()
        out.append(w)
        out += [w[:k] + MARK for k in STARTS if len(w) > k]
    return out


def document_terms(text: str) -> set[str]:
    """The terms of a text, and with the mark TWICE those that it has twice or more."""
    n = Counter(t for w in text.split() for t in terms(w))
    return n.keys() | {t + TWICE for t, k in n.items() if k >= 2}


def lexicons(known: DataFrame, many: int = LEXICONS) -> list[frozenset[str]]:
    """Disjoint lexicons from labelled texts (text, label), each covering the toxic ones greedily with terms rare elsewhere.

    A term needs 3 toxic documents or more (2 in samples of fewer than 50) and a rate there of 20 times that elsewhere.
    Terms are counted on the executors; the driver gets the frequent terms of the sample's toxic documents.
    """

    def of_toxic(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = sorted(document_terms(text))
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(found), pa.int64()), pa.array(found, pa.string())], ["key", "term"])

    key = F.xxhash64("text").alias("key")
    toxic = known.filter("label > 0.5").select(key, "text").dropDuplicates(["key"])
    pairs = written(toxic.mapInArrow(of_toxic, "key long, term string"), "toxic-terms")
    n_toxic, n_other = toxic.count(), known.filter("label <= 0.5").count()
    least = 3 if n_toxic >= 50 else 2
    counts = pairs.groupBy("term").agg(F.count("*").alias("n")).filter(F.col("n") >= least).toPandas()
    frequent = known.sparkSession.sparkContext.broadcast(frozenset(counts["term"]))

    def of_other(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                n.update(document_terms(text) & frequent.value)
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["term", "n"])

    elsewhere = known.filter("label <= 0.5").select("text").mapInArrow(of_other, "term string, n long")
    other = {r["term"]: r["n"] for r in elsewhere.groupBy("term").agg(F.sum("n").alias("n")).collect()}
    good = [t for t, n in zip(counts["term"], counts["n"], strict=True) if n * max(1, n_other) >= 20 * (other.get(t, 0) + 0.5) * n_toxic]
    rows = pairs.join(known.sparkSession.createDataFrame([(t,) for t in good], "term string"), "term").toPandas()
    holders = {t: set(keys) for t, keys in rows.groupby("term")["key"]}
    out = []
    for _ in range(many):
        left, chosen = set(rows["key"]), []
        while left and holders:
            best = max(holders, key=lambda t: (len(holders[t] & left), -other.get(t, 0), t))
            if len(holders[best] & left) < least:
                break
            left -= holders[best]
            chosen.append(best)
            del holders[best]
        out.append(frozenset(chosen))
    return out


@dataclass(frozen=True)
class Voters:
    """The lexicons, the general list last."""

    lists: tuple[frozenset[str], ...]

    @cached_property
    def known(self) -> frozenset[str]:
        return frozenset(t.removesuffix(TWICE) for x in self.lists for t in x)

    def lookup(self, word: str) -> tuple[tuple[str, ...], bool]:
        """The terms of this word that a lexicon holds, and whether symbols or capitals set the word off."""
        held = tuple(t for t in terms(word) if t in self.known)
        return held, bool(held) and bool(_SET_OFF.search(word) or (len(word) > 2 and word.isupper()))

    def votes(self, text: str, memo: dict[str, tuple[tuple[str, ...], bool]]) -> int:
        """The votes on a text, one bit for each voter: the lexicons, then set-off, several and dense hits."""
        words = text.split()
        if len(memo) > 200_000:
            memo.clear()
        for w in set(words).difference(memo):
            memo[w] = self.lookup(w)
        found = [x for x in map(memo.__getitem__, words) if x[0]]
        n = Counter(t for held, _ in found for t in held)
        has = n.keys() | {t + TWICE for t, k in n.items() if k >= 2}
        bits = sum(1 << i for i, x in enumerate(self.lists) if not x.isdisjoint(has))
        hits = len(found) if bits else 0
        k = len(self.lists)
        return bits | (hits > 0 and any(off for _, off in found)) << k | (hits >= 3) << (k + 1) | (hits * 150 >= max(1, len(words)) and hits > 1) << (k + 2)


@dataclass
class LabelModel:
    """P(label) and P(vote | label, parent's vote) of each voter; a voter without a parent is its own."""

    prior: float
    parents: list[int]
    tables: np.ndarray  # voter, label, parent's vote

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(label = 1) of each row of votes (0 or 1 for each voter)."""
        logs = np.tile(np.log([1 - self.prior, self.prior]), (len(votes), 1))
        for j, p in enumerate(self.parents):
            seen = votes[:, p] if p != j else np.zeros(len(votes), int)
            for y in (0, 1):
                q = self.tables[j, y, seen]
                logs[:, y] += np.log(np.where(votes[:, j] == 1, q, 1 - q))
        return 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -50, 50)))


def _tree(votes: np.ndarray, counts: np.ndarray, post: np.ndarray) -> list[int]:
    """Each voter's parent in the tree of greatest mutual information given the label; itself at the root or below 0.001 nats."""
    m = votes.shape[1]
    info = np.zeros((m, m))
    total = counts.sum()
    for y in (0, 1):
        w = counts * (post if y else 1 - post)
        size = w.sum() + 1e-9
        for i in range(m):
            for j in range(i):
                for a in (0, 1):
                    for b in (0, 1):
                        joint = w[(votes[:, i] == a) & (votes[:, j] == b)].sum() / size
                        if joint > 0:
                            info[i, j] += size / total * joint * np.log(joint / ((w[votes[:, i] == a].sum() / size) * (w[votes[:, j] == b].sum() / size)))
                info[j, i] = info[i, j]
    parents, inside = list(range(m)), [0]
    while len(inside) < m:
        j, p = max(((j, p) for j in range(m) if j not in inside for p in inside), key=lambda x: info[x[0], x[1]])
        parents[j] = p if info[j, p] > 1e-3 else j
        inside.append(j)
    return parents


def fit_label_model(votes: np.ndarray, counts: np.ndarray, rounds: int = 50) -> LabelModel:
    """Expectation maximisation over vote patterns (one row each) and how many documents have them.

    It starts from a third of the voters' agreement as the label; conditional tables are smoothed by one observation,
    and a voter is held to be likelier to say yes on class 1 than on class 0, which fixes which class is which.
    """
    m = votes.shape[1]
    post = np.where(votes.mean(axis=1) >= 1 / 3, 0.95, 0.02)
    model = LabelModel(0.1, list(range(m)), np.full((m, 2, 2), 0.5))
    for k in range(rounds):
        parents = _tree(votes, counts, post) if k % 5 == 0 else model.parents
        tables = np.zeros((m, 2, 2))
        for j, p in enumerate(parents):
            for y in (0, 1):
                w = counts * (post if y else 1 - post)
                for a in (0, 1):
                    here = w if p == j else w * (votes[:, p] == a)
                    base = (w @ votes[:, j] + 0.5) / (w.sum() + 1)
                    tables[j, y, a] = (here @ votes[:, j] + base) / (here.sum() + 1)
            tables[j, 1] = np.maximum(tables[j, 1], tables[j, 0])
        prior = float(np.clip((counts @ post + 1) / (counts.sum() + 2), 1e-4, 0.5))
        model = LabelModel(prior, parents, np.clip(tables, 1e-4, 1 - 1e-4))
        new = model.posterior(votes)
        done = np.abs(new - post).max() < 1e-5
        post = new
        if done:
            break
    return model


_FEATURES: dict[str, bytes] = {}


def feature_ids(text: str) -> np.ndarray:
    """Distinct hashed terms of a text, ascending; a term that occurs twice or more has a second number."""
    words = text.split()
    if len(_FEATURES) > 200_000:
        _FEATURES.clear()
    for w in set(words).difference(_FEATURES):
        _FEATURES[w] = np.array([zlib.crc32(t.encode("utf-8", "surrogatepass")) >> (33 - HASH_BITS) for t in terms(w)], "<u4").tobytes()
    ids, n = np.unique(np.frombuffer(b"".join(map(_FEATURES.__getitem__, words)), "<u4"), return_counts=True)
    return np.concatenate([ids, ids[n >= 2] + (1 << (HASH_BITS - 1))]).astype(np.int64)


@dataclass(frozen=True)
class Model:
    """All that was fitted: the voters, the label model and the classifier."""

    voters: Voters
    labels: LabelModel
    linear: Linear


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, held_out: int = 0) -> Model:
    """Fits voters, label model and classifier. Without toxic labels the general list and the patterns alone vote."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sample = written(labelled_sample(labels, label, folds, held_out, LABELLED_ROWS), "toxic-sample")
    known = written(one_text_each(docs, sample).select("text", "label"), "toxic-known")
    voters = Voters((*lexicons(known), frozenset(INSULTS)))
    at = docs.sparkSession.sparkContext.broadcast(voters)

    @F.pandas_udf("int")
    def cast(texts: pd.Series) -> pd.Series:
        memo = _VOTES.setdefault(at.value.lists, {})
        return pd.Series([at.value.votes(t, memo) for t in texts], dtype="int32")

    voted = written(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), cast("text").alias("votes")), "toxic-votes")
    patterns = voted.groupBy("votes").agg(F.count("*").alias("n")).toPandas()
    codes = patterns["votes"].to_numpy(np.int64)
    bits = (codes[:, None] >> np.arange(VOTERS)) & 1
    model = fit_label_model(bits, patterns["n"].to_numpy(float)) if len(patterns) else LabelModel(0.1, list(range(VOTERS)), np.full((VOTERS, 2, 2), 0.5))
    post = model.posterior(bits) if len(patterns) else np.zeros(0)

    posterior = docs.sparkSession.createDataFrame(list(zip(codes.tolist(), post.tolist(), strict=True)), "votes int, posterior double")
    # at most 2**VOTERS rows are broadcast; copies of a row are one, so that they neither fill the sample nor reach the driver
    judged = voted.filter("doc_id is not null").distinct().join(F.broadcast(posterior), "votes")
    pick = lambda d: d.orderBy(F.xxhash64("doc_id", F.lit("train")), "doc_id").limit(TRAIN_ROWS).select("doc_id", "text_hash", "posterior")
    chosen = written(pick(judged.filter("posterior > 0.5")).unionByName(pick(judged.filter("posterior <= 0.5"))).distinct(), "toxic-train")

    def to_ids(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "posterior": pdf["posterior"], "ids": [feature_ids(t).astype(np.int32) for t in pdf["text"]]})

    texts = docs.withColumn("text_hash", F.xxhash64("text")).join(chosen, ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash"])
    found = texts.select("doc_id", "posterior", "text").mapInPandas(to_ids, "doc_id long, posterior double, ids array<int>").toArrow().combine_chunks()
    labels_, data = found["posterior"].to_numpy(), []
    if len(labels_):
        column = found["ids"].chunk(0)
        ends, ids = column.offsets.to_numpy(), column.values.to_numpy()
        ones = np.ones(int(np.diff(ends).max(initial=0)))
        for k in np.argsort([zlib.crc32(str(d).encode()) for d in found["doc_id"].to_pylist()], kind="stable"):
            data.append((ids[ends[k] : ends[k + 1]], ones[: ends[k + 1] - ends[k]], float(labels_[k]), 1.0))
    return Model(voters, model, train(data, 1 << HASH_BITS, epochs=4, alpha=0.3, l1=1.0))


_VOTES: dict[tuple, dict[str, tuple]] = {}


def _scores(docs: DataFrame, model: Model, text: str = "text"):
    at = docs.sparkSession.sparkContext.broadcast(model.linear)

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        m = at.value
        return pd.Series(m.score(np.array([m.bias + (float(m.weights[feature_ids(t)].sum()) if t else 0.0) for t in texts])))

    return of(F.col(text))


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """docs with score (from 0 to 1) and predicted (1 where score >= threshold).

    Null and empty texts have the score of the bias alone. Columns score and predicted of docs are replaced.
    """
    kept = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    return docs.select(*kept, _scores(docs, model).alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents whose score is below the threshold, by a model fitted on them and the labels; with all their columns."""
    model, own = fit(docs, labels), column_name(docs, "toxic_score")
    return docs.withColumn(own, _scores(docs, model)).filter(F.col(own) < threshold).drop(own)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", in_fold(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted")


QUERIES = {"op10_toxicity": op10_toxicity}
ORACLES: dict[str, str] = {}
