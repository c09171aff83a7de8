"""Quality scores by nearest-neighbour voting in a latent-semantic space.

Terms of a text are its hashed words and the hashed shapes of its words (letter case, digits, symbols, in runs), with counts
of words that repeat the one before or an earlier one.  Root counts, weighted by inverse document frequency, are projected on
the leading right singular vectors of a bounded labelled sample.  The sample's vectors go to every task; the cosines of each
block of documents with all of them are computed exactly, and the labels of the nearest vote by similarity.
"""
from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lamella.llm.common import small_batches

SHAPES, WORDS, COUNTS = 1024, 1024, 4
TERMS = SHAPES + WORDS + COUNTS
#: Longest run of white-space-free text that is one word; longer ones are several.
WORD_PART = re.compile(r"\S{1,64}")
_RUNS = [(re.compile(p), r) for p, r in ((r"[^\W\d_]+", None), (r"\d+", "0"))]


def shape(word: str) -> str:
    """Runs of upper-case, capitalised, lower-case letters become A, Aa, a; digits 0; a repeated symbol doubles at most."""
    def letters(m):
        s = m[0]
        return "a" if s.islower() else "A" if s.isupper() and len(s) > 1 else "Aa"
    w = _RUNS[0][0].sub(letters, word)
    w = _RUNS[1][0].sub("0", w)
    return re.sub(r"([^\w])\1+", r"\1\1", w)


class Terms(dict):
    """word -> (shape's term, word's term) in one number; forgotten beyond ``limit`` words."""
    limit = 200_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        t = self[word] = (zlib.crc32(shape(word).encode()) % SHAPES) << 16 | (SHAPES + zlib.crc32(word.lower().encode()) % WORDS)
        return t


def term_counts(text: str | None, terms: Terms) -> np.ndarray:
    """Counts of all ``TERMS`` over the whole text; zeros for a text without words."""
    words = WORD_PART.findall(text or "")
    out = np.zeros(TERMS, np.float32)
    n = len(words)
    if not n:
        return out
    t = np.fromiter(map(terms.__getitem__, words), np.int64, n)
    out[:SHAPES + WORDS] = np.bincount(np.concatenate([t >> 16, t & 0xFFFF]), minlength=SHAPES + WORDS)
    again = int((t[1:] == t[:-1]).sum())
    lines = [x for x in text.split("\n") if x.strip()]
    out[SHAPES + WORDS:] = (4 * again, 2 * (n - len(set(words))), 4 * (len(lines) - len(set(lines))), 1)
    return out


@dataclass(frozen=True)
class Model:
    """What every task gets: ``(TERMS + sample) x dims`` numbers, bounded by the sample's bound."""
    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    weight: np.ndarray
    prior: float
    k: int
    power: float

    def embed(self, counts: np.ndarray) -> np.ndarray:
        x = np.sqrt(counts) * self.idf
        z = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)) @ self.axes
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def score(self, counts: np.ndarray) -> np.ndarray:
        """Similarity-weighted share of label 1 among the ``k`` nearest; the sample's share where nothing is similar."""
        cos = self.embed(counts.astype(np.float32)) @ self.vectors.T
        k = min(self.k, cos.shape[1])
        near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
        w = np.maximum(np.take_along_axis(cos, near, 1), 0.0).astype(np.float64) ** self.power * self.weight[near]
        total = w.sum(1)
        return np.where(total > 1e-12, (w * self.labels[near]).sum(1) / np.maximum(total, 1e-12), self.prior)


def fit(counts: np.ndarray, labels: np.ndarray, share: float, dims: int = 64, k: int = 25, power: float = 8.0) -> Model:
    """From the sample's counts and labels; ``share`` of label 1 among all labelled rows sets how much each class weighs."""
    idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))).astype(np.float32) + np.float32(0.1)
    idf[SHAPES:SHAPES + WORDS] *= np.float32(0.3)
    x = np.sqrt(counts) * idf
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    w, v = np.linalg.eigh((x.T @ x).astype(np.float64))
    axes = np.ascontiguousarray(v[:, ::-1][:, :dims]).astype(np.float32)
    own = max(labels.mean(), 1e-9), max(1 - labels.mean(), 1e-9)
    weight = np.where(labels > 0, share / own[0], (1 - share) / own[1])
    m = Model(idf, axes, np.empty((0, 0)), labels.astype(np.float64), weight, share, k, power)
    return Model(idf, axes, m.embed(counts), m.labels, weight, share, k, power)


def held_out(id_col: str = "doc_id"):
    """Rows that no label is learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = 3000, **kw) -> Model | None:
    """A model from at most ``per_class`` labelled rows of each class, those with the smallest hashes of their ids, none held
    out. None if no row of either class is left. Class shares count all labelled rows that are not held out."""
    small_batches(docs.sparkSession)
    lab = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("id").isNotNull())
    lab = lab.where(~held_out("id")).groupBy("id").agg(F.max("y").alias("y"))
    share = lab.agg(F.avg("y")).first()[0]
    picked = None
    for y in (0, 1):
        own = lab.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(per_class)
        picked = own if picked is None else picked.unionByName(own)
    chosen = docs.select(docs[f"`{id_col}`"].alias("id"), docs[f"`{text_col}`"].alias("text")).join(F.broadcast(picked), "id")  # at most 2 x per_class rows

    def run(batches):
        terms = Terms()
        for b in batches:
            got = [term_counts(t.as_py(), terms) for t in b.column("text")]
            at = [np.flatnonzero(c) for c in got]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("y"), pa.array([a.astype(np.int32) for a in at], pa.list_(pa.int32())),
                                              pa.array([c[a] for c, a in zip(got, at)], pa.list_(pa.float32()))], ["id", "y", "at", "n"])

    kind = chosen.schema["id"].dataType.simpleString()
    # rows that repeat an id: one of them, the same on every run
    rows = (chosen.mapInArrow(run, f"id {kind}, y int, at array<int>, n array<float>").groupBy("id").agg(F.max(F.struct("y", "at", "n")).alias("r"))
            .select("id", "r.*").orderBy("id").collect())
    if not rows:
        return None
    x = np.zeros((len(rows), TERMS), np.float32)
    for i, r in enumerate(rows):
        x[i, r["at"]] = r["n"]
    return fit(x, np.array([r["y"] for r in rows], np.float64), share, **kw)


def scored(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """``id_col, score, predicted`` for each row of ``docs``; a score is of the whole text alone.

    Null, empty and blank texts get the share of label 1 in training; without a model every score is 0.5.
    """
    small_batches(docs.sparkSession)
    given = docs.select(docs[f"`{id_col}`"].alias("id"), docs[f"`{text_col}`"].alias("text"))

    def run(batches):
        terms = Terms()
        for b in batches:
            if not b.num_rows:
                continue
            c = np.stack([term_counts(t.as_py(), terms) for t in b.column("text")])
            s = np.full(len(c), 0.5) if model is None else model.score(c)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(s, pa.float64())], ["id", "score"])

    kind = given.schema["id"].dataType.simpleString()
    d = given.mapInArrow(run, f"id {kind}, score double")
    return d.select(F.col("id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
