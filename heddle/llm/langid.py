"""Operator 4: language identification with averaged hashed subword embeddings.

A text's features are the counts of its byte n-grams within words, hashed into buckets. The buckets'
embeddings, averaged by these counts, feed a linear softmax; both are trained by stochastic gradient
descent in numpy, in one task, on a bounded sample of labelled rows. A held-back part of the sample
calibrates the temperature of the scores and the score below which a prediction is rejected.
"""

from __future__ import annotations

import pickle
import random
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_bucket, map_texts, read_table, released

#: Rows that the classifier is fitted on at most. Half of them are dealt to the languages evenly, so a rare
#: language is learned whatever its share of the corpus.
SAMPLE_ROWS = 6_000
BUCKETS, DIMENSIONS, GRAMS, EPOCHS, RATE, BATCH, SEED = 1 << 12, 16, (2, 3, 4), 6, 2.0, 64, 7
#: Short stretches of each sampled text, in words, that are trained on beside the whole text.
STRETCHES = (1, 2, 4, 8, 20)
#: Share of right calibration rows that the rejection threshold may reject.
REJECTED_SHARE = 0.002
UNKNOWN = "und"

_MULTIPLIERS = np.array([2654435761, 2246822519, 3266489917, 668265263], np.uint32)
_SPACE = bytes(32 if c < 128 and not chr(c).isalpha() else c for c in range(256))
#: Bytes that are hashed at a time.
CHUNK = 1 << 20


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def features(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """Counts of the hashed byte n-grams of the lower-cased words, borders of words included."""
    data = b" " + b" ".join(text.lower().encode().translate(_SPACE).split()) + b" "
    counts = np.zeros(buckets, np.int64)
    longest = max(GRAMS)
    for at in range(0, max(1, len(data) - 1), CHUNK):
        part = np.frombuffer(data[at : at + CHUNK + longest - 1], np.uint8)
        inner = part != 32
        wide = part.astype(np.uint32)
        for n in GRAMS:
            size = min(len(part) - n + 1, CHUNK)
            if size <= 0:
                continue
            hashed = np.full(size, n * 374761393 & 0xFFFFFFFF, np.uint32)
            for k in range(n):
                hashed ^= wide[k : k + size] * _MULTIPLIERS[k]
                hashed *= np.uint32(2246822519)
                hashed ^= hashed >> np.uint32(15)
            if n > 2:  # an n-gram may begin or end with a border but not span one
                good = inner[1 : 1 + size].copy()
                for k in range(2, n - 1):
                    good &= inner[k : k + size]
                hashed = hashed[good]
            counts += np.bincount(hashed % np.uint32(buckets), minlength=buckets)
    return counts


@dataclass
class LanguageModel:
    """Languages, a score table of buckets by languages (embeddings times weights), bias, temperature, threshold."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float

    def scores(self, counts: np.ndarray) -> np.ndarray:
        logits = (counts @ self.table / max(1, counts.sum()) + self.bias) / self.temperature
        weights = np.exp(logits - logits.max())
        return weights / weights.sum()

    def predict(self, data: bytes | None) -> tuple[str, float, bool]:
        """Language, score, and whether it is rejected. Without text or letters: und, 0, rejected."""
        text = data.decode() if data else ""
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0, True
        p = self.scores(features(text, len(self.table)))
        best = int(p.argmax())
        return self.languages[best], float(p[best]), bool(p[best] < self.threshold)


def _shares(labelled: DataFrame, lang: str, rows: int) -> list[tuple[str, float]]:
    """The share of each language's rows that is sampled: half of `rows` is dealt evenly, half by frequency.

    At most rows / 2 languages, the most frequent ones, are learned; that bounds what comes to the driver.
    """
    name = F.col(f"`{lang}`").cast("string").alias("lang")
    found = labelled.groupBy(name).agg(F.count("*").alias("n")).where("lang is not null").orderBy(F.desc("n"), "lang").limit(max(1, rows // 2)).collect()
    total = sum(r.n for r in found)
    return [(r.lang, min(1.0, max(rows // (2 * len(found)), rows * r.n / (2 * total)) / r.n)) for r in found]


def _packed(text: str) -> bytes:
    """Feature counts of a text and of some stretches of it, each as its size, its indices and its counts."""
    if not has_letter(text):
        return b""
    words, chance = text.split(), random.Random(len(text))
    parts = [text]
    for n in STRETCHES:
        if len(words) > n:
            at = chance.randrange(len(words) - n + 1)
            parts.append(" ".join(words[at : at + n]))
    out = []
    for part in parts:
        if has_letter(part):
            counts = features(part)
            index = np.nonzero(counts)[0]
            out += [np.uint32(len(index)).tobytes(), index.astype("<u2").tobytes(), counts[index].astype("<f4").tobytes()]
    return b"".join(out)


def _unpacked(data: bytes) -> list[tuple[np.ndarray, np.ndarray]]:
    out, at = [], 0
    while at < len(data):
        n = int(np.frombuffer(data, "<u4", 1, at)[0])
        out.append((np.frombuffer(data, "<u2", n, at + 4), np.frombuffer(data, "<f4", n, at + 4 + 2 * n)))
        at += 4 + 6 * n
    return out


def _sample(labelled: DataFrame, key: str, text: str, lang: str, rows: int) -> DataFrame:
    """(lang, f) of at most `rows` rows, in an order that a hash of key and text fixes.

    Rows are chosen and turned into counts where they are; a row's counts are bounded by the buckets
    whatever its text's length, and nothing else leaves its task.
    """
    shares = labelled.sparkSession.createDataFrame(_shares(labelled, lang, rows), "lang string, share double")
    place = F.xxhash64(F.col(f"`{key}`").cast("string"), F.col(f"`{text}`")) / F.lit(2.0**64) + 0.5
    hashed = labelled.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").alias("text"), place.alias("place"))
    # rows / 2 short rows at most.
    chosen = hashed.join(F.broadcast(shares), "lang").where("place <= share").select("lang", "text", (F.col("place") / F.col("share")).alias("place"))
    counted = map_texts(chosen, "text", ["place", "lang"], [("f", T.BinaryType())], lambda: lambda data: (_packed(data.decode() if data else ""),))
    # Repeated rows share a place and could pass the bound.
    return counted.where(F.octet_length("f") > 0).orderBy("place", "lang", "f").limit(rows).select("lang", "f")


def train(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Fits a model to at most `rows` rows with a label, in one task. Without any, the model knows no language.

    Null and empty labels: rows with a null label teach nothing, an empty one is a label like any other.
    Texts that are null or have no letter teach nothing. Repeated rows are sampled each for itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = [(name.as_py(), _unpacked(f.as_py())) for b in batches for name, f in zip(b.column(0), b.column(1), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(sample))], pa.binary())], names=["model"])

    found = _sample(labelled, key, text, lang, rows).mapInArrow(released(run), "model binary").collect()
    # An empty sample may have no task at all.
    return pickle.loads(found[0].model) if found else fit([])


def fit(sample: list[tuple[str, list[tuple[np.ndarray, np.ndarray]]]]) -> LanguageModel:
    """The model of sampled rows (label, features of the text and of its stretches); the second, seventh, ... row of each language calibrate."""
    languages = sorted({lang for lang, _ in sample})
    empty = LanguageModel(languages, np.zeros((BUCKETS, len(languages)), np.float32), np.zeros(len(languages), np.float32), 1.0, 0.0)
    if len(languages) < 2:
        return empty
    seen: Counter[str] = Counter()
    taught, hold = [], []
    for lang, parts in sample:
        (hold if seen[lang] % 5 == 1 else taught).append((lang, parts))
        seen[lang] += 1
    code = {lang: i for i, lang in enumerate(languages)}
    texts = [part for _, parts in taught for part in parts]
    labels = np.array([code[lang] for lang, parts in taught for _ in parts])
    chance = np.random.default_rng(SEED)
    e = chance.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    w, b = np.zeros((DIMENSIONS, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    share = np.bincount(labels, minlength=len(languages)) / len(labels)
    weight = (1 / np.maximum(share, 1e-9)) ** 0.5
    weight = (weight / (weight * share).sum()).astype(np.float32)
    steps, step = EPOCHS * -(-len(texts) // BATCH), 0
    x = np.zeros((BATCH, BUCKETS), np.float32)
    for _ in range(EPOCHS):
        order = chance.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            rows_ = order[at : at + BATCH]
            x[:] = 0
            for k, r in enumerate(rows_):
                index, count = texts[r]
                x[k, index] = count / count.sum()
            m, y = len(rows_), labels[rows_]
            v = x[:m] @ e
            logits = v @ w + b
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(m), y] -= 1
            p *= weight[y][:, None] / m
            rate = RATE * (1 - step / steps)
            used = np.unique(np.concatenate([texts[r][0] for r in rows_]))
            dv = p @ w.T
            w -= rate * (v.T @ p)
            b -= rate * p.sum(0)
            # Averages touch each bucket lightly, so embeddings take larger steps.
            e[used] -= rate * 20 * (x[:m, used].T @ dv)
            step += 1
    model = LanguageModel(languages, (e @ w).astype(np.float32), b, 1.0, 0.0)
    if hold:
        _calibrate(model, [(code[lang], p) for lang, parts in hold for p in parts], [(code[lang], parts[0]) for lang, parts in hold])
    return model


def _calibrate(model: LanguageModel, parts: list, whole: list) -> None:
    """Temperature: least log loss on stretches and whole texts. Threshold: the score that all but a small share of the right whole texts reach, and never more than even odds."""

    def logits(rows: list) -> np.ndarray:
        return np.array([c @ model.table[i] / c.sum() + model.bias for _, (i, c) in rows])

    z, y = logits(parts), np.array([k for k, _ in parts])

    def loss(t: float) -> float:
        a = z / t
        a = a - a.max(1, keepdims=True)
        return float((np.log(np.exp(a).sum(1)) - a[np.arange(len(y)), y]).mean())

    model.temperature = min((float(t) for t in np.geomspace(0.1, 10, 60)), key=loss)
    a = logits(whole) / model.temperature
    p = np.exp(a - a.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    right = np.sort(p.max(1)[p.argmax(1) == np.array([k for k, _ in whole])])
    if len(right):
        model.threshold = min(0.5, float(right[int(len(right) * REJECTED_SHARE)]))


def predict(docs: DataFrame, model: LanguageModel, keep: list[str], text: str = "text") -> DataFrame:
    """`keep`, lang_pred, score (0 to 1) and rejected of every whole text.

    lang_pred is a learned language, or und where the text is null or has no letter (score 0, rejected);
    und for all rows if no language was learned. rejected also marks scores under the calibrated
    threshold. Rows that repeat give repeated results.
    """
    # Languages and table come from a bounded sample, so the broadcast is bounded too.
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [("lang_pred", T.StringType()), ("score", T.DoubleType()), ("rejected", T.BooleanType())]
    return map_texts(docs, text, keep, fields, lambda: shared.value.predict)


def _learn(documents: DataFrame) -> LanguageModel:
    """Learns from rows with a language whose crc32 of the key isn't 2 modulo 4; rows with a null key teach nothing."""
    return train(documents.where((crc_bucket("doc_id", 4) != 2) & F.col("lang").isNotNull()))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole document; a null key is not held out."""
    documents = read_table(spark, sf_dir, "documents")
    held = documents.select("doc_id", "text", F.coalesce(crc_bucket("doc_id", 4) == 2, F.lit(False)).alias("held_out"))
    return predict(held, _learn(documents), ["doc_id", "held_out"])


def keep_known(docs: DataFrame) -> DataFrame:
    """The rows, in their own columns, whose language is not rejected."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    own = docs.toDF(*names)
    found = predict(own, _learn(docs), names, names[docs.columns.index("text")])
    return found.where(~F.col("rejected")).select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])
