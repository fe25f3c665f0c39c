"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies are counted over every training document. The weights are learnt with
follow-the-regularised-leader and elastic-net penalties from a bounded sample of labelled
documents of every language; a temperature is then fitted on other
training documents. Prediction runs over all whole texts where they lie, without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, join_sized

#: Hash buckets of n-grams.
DIMENSIONS = 1 << 14
#: Bounds of the labelled sample, a fifth of which is for calibration: documents of one language,
#: documents of all (though FEWEST of each language always), bytes of their n-gram counts.
PER_LANGUAGE, SAMPLE, FEWEST = 700, 20_000, 10
SAMPLE_BYTES = 256 << 20
UNDETERMINED = "und"

_LETTER = re.compile(r"[^\W\d_]")
#: One odd multiplier for each place of an n-gram.
_PLACES = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)
_SHIFT = np.uint32(32 - 14)


def ngram_counts(text: str) -> np.ndarray:
    """Counts of the hashed 1- to 3-grams of the lower-cased text."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    counts = np.zeros(DIMENSIONS, np.int64)
    grams = np.zeros(len(points), np.uint32)
    for n in range(3):
        if len(points) <= n:
            break
        grams = grams[: len(points) - n] + points[n:] * _PLACES[n]
        mixed = (grams ^ (grams >> np.uint32(15))) * np.uint32(0x2C1B3C6D + 2 * n)
        counts += np.bincount(mixed >> _SHIFT, minlength=DIMENSIONS)
    return counts


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def features(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(counts)
        values = (1 + np.log(counts[at])) * self.idf[at]
        norm = np.sqrt((values**2).sum())
        return at, values / norm if norm else values

    def probabilities(self, at: np.ndarray, values: np.ndarray) -> np.ndarray:
        scores = (values @ self.weights[at] + self.bias) / self.temperature
        scores = np.exp(scores - scores.max())
        return scores / scores.sum()

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not _LETTER.search(text):
            return UNDETERMINED, 0.0
        p = self.probabilities(*self.features(ngram_counts(text)))
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def _train(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, alpha: float, beta: float, l1: float, l2: float, epochs: int) -> tuple[np.ndarray, np.ndarray]:
    """Follow-the-regularised-leader with one learning rate for each coordinate."""
    z, n = np.zeros((DIMENSIONS + 1, classes)), np.zeros((DIMENSIONS + 1, classes))

    def weights(zs: np.ndarray, ns: np.ndarray) -> np.ndarray:
        shrunk = np.sign(zs) * np.maximum(np.abs(zs) - l1, 0)
        return -shrunk / ((beta + np.sqrt(ns)) / alpha + l2)

    for _ in range(epochs):
        for at, values, label in rows:
            own, x = np.append(at, DIMENSIONS), np.append(values, 1.0)
            zs, ns = z[own], n[own]
            w = weights(zs, ns)
            scores = x @ w
            p = np.exp(scores - scores.max())
            p /= p.sum()
            p[label] -= 1
            g = np.outer(x, p)
            squared = ns + g * g
            z[own] = zs + g - (np.sqrt(squared) - np.sqrt(ns)) / alpha * w
            n[own] = squared
    w = weights(z, n)
    return w[:DIMENSIONS].astype(np.float32), w[DIMENSIONS].astype(np.float32)


def held_out(doc_id: Column) -> Column:
    """True for documents that must not be learnt from; a null doc_id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3, epochs: int = 3) -> Model:
    """The model of the documents that aren't held out and have a text and a language."""
    learn = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "text", "lang")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total = np.zeros(DIMENSIONS, np.int64), 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                seen += ngram_counts(text) > 0
                total += 1
        at = np.flatnonzero(seen)
        yield pa.record_batch({"bucket": pa.array(np.append(at, DIMENSIONS)), "n": pa.array(np.append(seen[at], total))})

    counted = learn.select("text").mapInArrow(frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    found = {r["bucket"]: r["n"] for r in counted}  # as many rows as there are buckets at most
    total, frequency = found.pop(DIMENSIONS, 0), np.zeros(DIMENSIONS)
    frequency[list(found)] = list(found.values())
    idf = np.log((1 + total) / (1 + frequency)) + 1

    shares = checkpointed(learn.groupBy("lang").agg(F.count("*").alias("labelled")))
    classes = max(1, shares.count())
    own = max(FEWEST, min(per_language, SAMPLE // classes))
    # The text counts too, so that rows without a doc_id are drawn each for itself.
    draw = F.pmod(F.xxhash64(F.lit("langid"), "doc_id", "text"), F.lit(1 << 40)) / float(1 << 40)
    drawn = join_sized(learn, shares, ["lang"]).withColumn("draw", draw).where(F.col("draw") * F.col("labelled") < 2.0 * own)
    order = Window.partitionBy("lang").orderBy("draw", "doc_id", F.xxhash64("text"))
    sample = drawn.withColumn("place", F.row_number().over(order)).where(F.col("place") <= own).select("lang", "place", "draw", "text")

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buckets, counts = [], []
            for text in batch.column("text").to_pylist():
                dense = ngram_counts(text)  # one at a time; the buckets that it has are few
                at = np.flatnonzero(dense)
                buckets.append(at.astype("<u2").tobytes())
                counts.append(dense[at].astype("<i4").tobytes())
            yield pa.record_batch({
                "lang": batch.column("lang"), "place": batch.column("place"), "draw": batch.column("draw"),
                "buckets": pa.array(buckets, pa.binary()), "counts": pa.array(counts, pa.binary()),
            })

    counted = checkpointed(sample.mapInArrow(sparse, "lang string, place int, draw double, buckets binary, counts binary"))
    so_far = F.sum(F.length("buckets") + F.length("counts")).over(Window.partitionBy("lang").orderBy("place"))
    within = (F.col("so_far") <= SAMPLE_BYTES // classes) | (F.col("place") <= FEWEST)
    rows = counted.withColumn("so_far", so_far).where(within).drop("so_far").collect()  # bounded by SAMPLE and SAMPLE_BYTES
    languages = sorted({r["lang"] for r in rows})
    model = Model(languages, idf, np.zeros((DIMENSIONS, len(languages)), np.float32), np.zeros(len(languages), np.float32), 1.0)
    fitted, calibrating = [], []
    for r in sorted(rows, key=lambda r: (r["draw"], r["lang"], r["place"])):
        counts = np.zeros(DIMENSIONS, np.int64)
        counts[np.frombuffer(r["buckets"], "<u2")] = np.frombuffer(r["counts"], "<i4")
        (calibrating if r["place"] % 5 == 0 else fitted).append((*model.features(counts), languages.index(r["lang"])))
    if languages:
        model.weights, model.bias = _train(fitted, len(languages), alpha, beta, l1, l2, epochs)
    if calibrating:
        logits = np.array([v @ model.weights[a] + model.bias for a, v, _ in calibrating])
        labels = np.array([y for *_, y in calibrating])

        def loss(temperature: float) -> float:
            s = logits / temperature
            s = s - s.max(axis=1, keepdims=True)
            return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(s)), labels]).mean())

        model.temperature = min(np.geomspace(0.05, 20, 121), key=loss)
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` with lang_pred and score, which replace columns of these names.

    ``und`` with score 0 stands for null texts, texts without any letter, and for every text
    where nothing could be learnt. Repeated rows get equal predictions; of languages that are
    equally likely the first by name counts.
    """
    kept = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one row of DIMENSIONS weights for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.predict(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=[*batch.schema.names, "lang_pred", "score"],
            )

    added = T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return kept.mapInArrow(run, added)


def identified(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document.

    Only text and language of documents that aren't held out are learnt from; the prediction
    sees the text alone. An empty table gives an empty result.
    """
    own = docs.select(F.col("doc_id"), F.col("text").cast("string"), F.col("lang").cast("string"))
    return predict(own.select("doc_id", "text"), fit(own, per_language)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score"
    )


def recognised(docs: DataFrame, least: float = 0.4, per_language: int = PER_LANGUAGE) -> DataFrame:
    """The documents whose language is recognised: any but ``und``, with a score of ``least`` or more. All columns stay.

    Null ids stay, repeated rows stay or go together, an empty table gives an empty result.
    """
    model = fit(docs.select("doc_id", F.col("text").cast("string"), F.col("lang").cast("string")), per_language)
    columns = docs.columns
    judged = predict(docs.select(F.struct(*columns).alias("row"), F.col("text").cast("string").alias("text")), model)
    return judged.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least)).select("row.*")
