"""Operator 2: toxicity by a factorization machine over hashed terms.

The score of a text is sigmoid(b + sum w_i + sum_{i<j} <v_i, v_j>) over the hashes of its distinct words and stems. The
products of the factors v let pairs of words count (an insult near a named group) beyond what each word adds.

The machine is fitted on a bounded sample of labelled rows (SAMPLE, chosen by a hash of the id) and keeps weights
only for terms that go with the label beyond chance, FEATURES at most; so the model has a bounded size. Every row is
scored, over its whole text.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenelake.llm.common import documents, id_and_text, texts_of

#: Labelled rows that the machine is fitted on, at most; texts of more bytes than SAMPLE_BYTES are not among them.
SAMPLE = 12_000
SAMPLE_BYTES = 40_000
MIN_DOCS = 3
#: G squared that a term must reach against the label to have a weight: one in a thousand by chance.
EVIDENCE = 10.83
STEM = 5
FEATURES = 1 << 17
FACTORS = 4
EPOCHS = 12
THRESHOLD = 0.7

#: Every ASCII character but letters parts words.
_LETTERS = {x: " " for x in range(128) if not chr(x).isalpha()}


def terms(text: bytes) -> set[int]:
    """Hashes of the distinct lower-cased words, and of the stems (first STEM letters) of the longer ones."""
    words = set(text.decode("utf-8", "replace").lower().translate(_LETTERS).split())
    stems = {w[:STEM] + "*" for w in words if len(w) > STEM}
    return set(map(crc32, map(str.encode, words | stems)))


class Machine:
    def __init__(self, hashes: np.ndarray, bias: float, linear: np.ndarray, factors: np.ndarray):
        self.hashes, self.bias, self.linear, self.factors = hashes, bias, linear, factors

    def __getstate__(self) -> tuple:
        return self.hashes, self.bias, self.linear, self.factors

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)

    @property
    def index(self) -> dict[int, int]:
        if not hasattr(self, "_index"):
            self._index = {int(h): i for i, h in enumerate(self.hashes)}
        return self._index

    def score(self, text: bytes) -> float:
        index = self.index
        own = [i for h in terms(text) if (i := index.get(h)) is not None]
        own.sort()  # sums in one order: equal texts have equal scores
        z = self.bias
        if own:
            v = self.factors[own]
            total = v.sum(axis=0)
            z += float(self.linear[own].sum() + 0.5 * (total @ total - (v * v).sum()))
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def _evidence(docs: np.ndarray, ones: np.ndarray, n: int, n_ones: float) -> np.ndarray:
    """The log-likelihood ratio (G squared) of each term against the label, from its documents and those of label 1."""
    out = np.zeros(len(docs))
    for observed, row, column in ((ones, docs, n_ones), (docs - ones, docs, n - n_ones), (n_ones - ones, n - docs, n_ones), (n - docs - n_ones + ones, n - docs, n - n_ones)):
        expected = row * column / n
        out += 2 * observed * np.log(np.maximum(observed, 1e-300) / np.maximum(expected, 1e-300))
    return out


def fit(rows: list[tuple[bytes, int]], seed: int = 7) -> Machine:
    """rows: text and label 0 or 1."""
    return fit_terms([np.array(sorted(terms(x)), np.int64) for x, _ in rows], [y for _, y in rows], seed)


def fit_terms(found: list[np.ndarray], marks: list[int], seed: int = 7) -> Machine:
    """Hashes of each text's terms, and labels 0 or 1. Without texts of both labels the machine gives the share of ones to every text."""
    labels, rows = np.array(marks, np.float64), found
    share = float(np.clip(labels.mean() if len(rows) else 0.0, 1e-4, 1 - 1e-4))
    bias = float(np.log(share / (1 - share)))
    if not len(rows) or labels.min() == labels.max():
        return Machine(np.zeros(0, np.int64), bias, np.zeros(0), np.zeros((0, FACTORS)))
    every, place, docs = np.unique(np.concatenate(found), return_inverse=True, return_counts=True)
    ones = np.bincount(place, np.repeat(labels, [len(x) for x in found]), len(every))
    strength = _evidence(docs, ones, len(rows), labels.sum())
    keep = (docs >= MIN_DOCS) & (strength >= EVIDENCE)
    if keep.sum() > FEATURES:
        keep &= strength > np.sort(strength)[-FEATURES]
    hashes = every[keep]
    row_of = [np.searchsorted(hashes, x[np.isin(x, hashes)]) for x in found]
    starts = np.concatenate([[0], np.cumsum([len(x) for x in row_of])])
    columns = np.concatenate(row_of)
    random = np.random.default_rng(seed)
    n = len(hashes)
    w, v = np.zeros(n), random.normal(0, 0.01, (n, FACTORS))
    gw, gv, gb = np.full(n, 1e-6), np.full((n, FACTORS), 1e-6), 1e-6
    for epoch in range(EPOCHS):
        order = random.permutation(len(rows))
        for at in range(0, len(order), 64):
            part = order[at : at + 64]
            sizes = starts[part + 1] - starts[part]
            owner = np.repeat(np.arange(len(part)), sizes)
            own = np.concatenate([columns[starts[i] : starts[i + 1]] for i in part])
            total = np.stack([np.bincount(owner, v[own, f], len(part)) for f in range(FACTORS)], axis=1)
            square = np.bincount(owner, (v[own] ** 2).sum(axis=1), len(part))
            z = bias + np.bincount(owner, w[own], len(part)) + 0.5 * ((total**2).sum(axis=1) - square)
            error = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels[part]
            # gradients by word, with a pull to zero; steps by AdaGrad
            words, at_word = np.unique(own, return_inverse=True)
            dw = np.bincount(at_word, error[owner]) + 0.002 * w[words]
            dv = np.stack([np.bincount(at_word, error[owner] * (total[owner, f] - v[own, f])) for f in range(FACTORS)], axis=1) + 0.05 * v[words]
            gw[words] += dw**2
            gv[words] += dv**2
            gb += error.sum() ** 2
            w[words] -= 0.3 * dw / np.sqrt(gw[words])
            v[words] -= 0.02 * dv / np.sqrt(gv[words])
            bias -= 0.1 * error.sum() / np.sqrt(gb)
    return Machine(hashes, float(bias), w, v)


def train(docs: DataFrame, labels: DataFrame, fold_of: int = 3, held_out: int = 1, sample: int = SAMPLE) -> Machine:
    """Fits on labelled texts outside the held-out fold (crc32 of the id as text, modulo fold_of).

    Null labels and ids are no labels. Of several labels of one id the greatest holds; of several texts of one id the
    first by hash. The texts of the sample become term hashes on the executors; only those reach the driver.
    """
    marked = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1) and id is not null")
    marked = marked.where(F.crc32(F.col("id").cast("string")) % fold_of != held_out).groupBy("id").agg(F.max("toxic").alias("toxic"))
    marked = marked.orderBy(F.xxhash64("id"), "id").limit(sample)
    own = id_and_text(docs).where(F.coalesce(F.octet_length("text"), F.lit(0)) <= SAMPLE_BYTES).join(F.broadcast(marked), F.col("doc_id") == F.col("id"))  # sample rows at most
    own = own.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def count(batches):
        for b in batches:
            found = [np.array(sorted(terms(x)), np.uint32).tobytes() for x in texts_of(b)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), pa.array(found, pa.binary())], names=["doc_id", "toxic", "terms"])

    rows = sorted(own.mapInArrow(count, "doc_id long, toxic int, terms binary").collect(), key=lambda r: r.doc_id)
    return fit_terms([np.frombuffer(r.terms, np.uint32).astype(np.int64) for r in rows], [r.toxic for r in rows])


def score_toxicity(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, score: one row for each row of docs, for the whole text.

    Null and empty texts get the score of a text without words. Ids may be null or repeated; equal texts have
    equal scores. An empty table gives an empty result. Only doc_id and text are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # FEATURES x (FACTORS + 2) numbers at most

    def score(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([shared.value.score(x) for x in texts_of(b)], pa.float64())], names=["doc_id", "score"])

    return id_and_text(docs).mapInArrow(score, "doc_id long, score double")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = score_toxicity(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
