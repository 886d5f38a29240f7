"""Language identification by error-correcting output codes.

Each language has a codeword; for each bit of it a linear classifier over hashed character n-grams tells the languages
with a 1 from those with a 0. A text's n-grams are counted whole and in slabs, so its length bounds nothing. Decoding
is loss-weighted: the logistic loss of every bit against a codeword counts as much as the classifier was right for that
language on texts kept back from its training; the nearest codeword wins, and where the second is almost as near the text is
flagged as ambiguous.

Languages and their counts come from all learnable rows; the classifiers are fitted on at most ``PER_LANGUAGE`` texts of each
language (fewer where there are over eight, ``SAMPLE`` in all, but never fewer than ``LEAST`` each), drawn by a hash of doc_id and text, and on short
runs of words from them, so that short texts are known as well.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; so is every text where no row can be learned from (no
language, or a null doc_id, which has no fold); with one language each text with a letter gets it, with score 1; rows that repeat a
doc_id are predicted each by its text; equal distances go to the language first in order; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import frugal
from tessera.llm.toxicity import is_held_out

PER_LANGUAGE, SAMPLE, LEAST = 1000, 8000, 20
BUCKET_BITS, LONGEST, SLAB = 16, 3, 1 << 18
EPOCHS, RATE, SCALE, TRIES = 6, 0.5, 20.0, 200
#: A table of this many languages at most, a row each, is broadcast.
FEW = 10_000
#: Below this difference between the shares of the first and the second language a text is ambiguous.
CLOSE = 0.2
UNKNOWN = "und"
_WORDS = regex.compile(r"\p{L}+")
_MULTIPLIER = np.uint32(0x9E3779B1)


def codewords(n: int) -> np.ndarray:
    """A row of signs for each of ``n`` languages: every split of the languages for up to five, else the best of random codes."""
    if n < 2:
        return np.zeros((n, 0), np.int8)
    if n <= 5:
        return np.array([[1 if not row or not (split >> (row - 1)) & 1 else -1 for split in range(1, 1 << (n - 1))] for row in range(n)], np.int8)
    rng, bits = np.random.default_rng(n), math.ceil(10 * math.log2(n))
    best, widest = None, -1
    for _ in range(TRIES if n <= 200 else 5):
        code = rng.choice(np.array([-1, 1], np.int8), (n, bits))
        apart = (bits - code.astype(np.int32) @ code.T.astype(np.int32)) // 2
        np.fill_diagonal(apart, bits)
        if (least := int(apart.min())) > widest and (np.abs(code.astype(np.int32).sum(axis=0)) < n).all():
            best, widest = code, least
    return best


def buckets(text: str) -> Iterator[np.ndarray]:
    """The bucket of each character n-gram of the text's lower-cased letter runs, a slab at a time; nothing without a letter."""
    held, size = [], 0
    for word in _WORDS.finditer(text):
        # A run longer than a slab is cut; only n-grams over the cuts are lost.
        run = word.group().lower()
        for at in range(0, len(run), SLAB):
            held.append(run[at : at + SLAB])
            size += len(held[-1]) + 1
            if size >= SLAB:
                yield _hashed(held)
                held, size = [], 0
    if held:
        yield _hashed(held)


def _hashed(words: list[str]) -> np.ndarray:
    points = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le", "surrogatepass"), "<u4")
    found, gram = [], np.zeros(len(points), np.uint32)
    for n in range(LONGEST):
        gram = (gram[: len(points) - n] * np.uint32(31_337) + points[n:] + np.uint32(n)) * _MULTIPLIER
        found.append(gram >> np.uint32(32 - BUCKET_BITS))
    return np.concatenate(found)


def shares(text: str) -> tuple[np.ndarray, np.ndarray] | None:
    """The buckets that a text hits and the share of its n-grams in each; None without a letter."""
    counts = None
    for some in buckets(text):
        now = np.bincount(some, minlength=1 << BUCKET_BITS)
        counts = now if counts is None else counts + now
    if counts is None:
        return None
    at = np.flatnonzero(counts)
    return at.astype(np.int32), (counts[at] / counts.sum()).astype(np.float32)


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # buckets by bits
    bias: np.ndarray
    trust: np.ndarray  # languages by bits, each row with sum 1

    def margins(self, text: str) -> np.ndarray | None:
        total, n = np.zeros(self.code.shape[1], np.float64), 0
        for some in buckets(text):
            if len(some) > len(self.weights):
                total += np.bincount(some, minlength=len(self.weights)) @ self.weights
            else:
                total += self.weights[some].sum(axis=0, dtype=np.float64)
            n += len(some)
        return total / n * SCALE + self.bias if n else None

    def decode(self, margins: np.ndarray) -> np.ndarray:
        """The share of each language, from its loss-weighted distance."""
        loss = np.logaddexp(0.0, -self.code * margins)
        distance = (self.trust * loss).sum(axis=1)
        near = np.exp(distance.min() - distance)
        return near / near.sum()

    def predict(self, text: str | None) -> tuple[str, float, bool, str | None]:
        """Language, score, whether another is almost as near, and which."""
        if text is None or not self.languages:
            return UNKNOWN, 0.0, False, None
        if len(self.languages) == 1:
            return (self.languages[0], 1.0, False, None) if _WORDS.search(text) else (UNKNOWN, 0.0, False, None)
        margins = self.margins(text)
        if margins is None:
            return UNKNOWN, 0.0, False, None
        share = self.decode(margins)
        first, second = np.argsort(-share, kind="stable")[:2].tolist()
        close = bool(share[first] - share[second] < CLOSE)
        return self.languages[first], float(share[first]), close, self.languages[second] if close else None


def train(rows: list[tuple[int, bool, np.ndarray, np.ndarray]], languages: list[str], seed: int = 7) -> Model:
    """``rows``: language's number, kept back or not, buckets, shares."""
    code = codewords(len(languages))
    bits, size = code.shape[1], 1 << BUCKET_BITS
    model = Model(languages, code, np.zeros((size, bits), np.float32), np.zeros(bits), np.full(code.shape, 1 / max(1, bits)))
    if not bits:
        return model
    taught = [r for r in rows if not r[1]] or rows
    counts = np.bincount([r[0] for r in taught], minlength=len(languages))
    weight = (len(taught) / np.maximum(counts, 1) / len(languages)).astype(np.float32)
    rng, seen = np.random.default_rng(seed), np.full((size, bits), 1e-6, np.float32)
    seen_bias = np.full(bits, 1e-6)
    for _ in range(EPOCHS):
        shuffled = rng.permutation(len(taught))
        for at in range(0, len(taught), 64):
            some = [taught[k] for k in shuffled[at : at + 64]]
            x = np.zeros((len(some), size), np.float32)
            for k, (_, _, where, share) in enumerate(some):
                x[k, where] = share * SCALE
            kinds = [r[0] for r in some]
            signs = code[kinds].astype(np.float32)
            margin = x @ model.weights + model.bias.astype(np.float32)
            push = -signs / (1 + np.exp(np.clip(signs * margin, -30, 30))) * weight[kinds, None] / len(some)
            step, step_bias = x.T @ push, push.sum(axis=0)
            seen += step * step
            seen_bias += step_bias * step_bias
            model.weights -= RATE * step / np.sqrt(seen)
            model.bias -= RATE * step_bias / np.sqrt(seen_bias)
    right, tested = np.ones(code.shape), np.full((len(languages), 1), 2.0)  # one right and one wrong answer before any is seen
    for kind, back, where, share in rows:
        if back or len(taught) == len(rows):
            margin = (model.weights[where] * share[:, None]).sum(axis=0) * SCALE + model.bias
            right[kind] += code[kind] * margin > 0
            tested[kind] += 1
    model.trust = right / tested
    model.trust /= model.trust.sum(axis=1, keepdims=True)
    return model


def _samples(numbers: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["language", "place", "back", "buckets", "shares"]
        types = [pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.binary()]
        for batch in batches:
            rows = []
            for lang, place, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "place", "text")), strict=True):
                words = [m.group() for m in _WORDS.finditer(text)]
                starts = [(abs(place) >> shift) % max(1, len(words) - n + 1) for n, shift in ((3, 3), (8, 17))]
                for piece in (text, *(" ".join(words[s : s + n]) for s, n in zip(starts, (3, 8), strict=True))):
                    if (found := shares(piece)) is not None:
                        rows.append((numbers[lang], place, place % 5 == 0, *(x.tobytes() for x in found)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names)

    return run


def fit(docs: DataFrame) -> Model:
    """A model of all languages among the learnable rows of ``docs`` (doc_id, text, lang)."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("doc_id is not null and text is not null and lang is not null").where(~is_held_out(F.col("doc_id")))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # a row a language
    languages = sorted(counts)
    if len(languages) < 2:
        return train([], languages)
    # About 1.2 times the sample is drawn by a threshold on a hash, so nothing is sorted or moved; the rest is cut off below.
    most = max(LEAST, min(PER_LANGUAGE, SAMPLE // len(languages)))
    limits = docs.sparkSession.createDataFrame([(k, min(1.0, (1.2 * most + 30) / n)) for k, n in counts.items()], "lang string, part double")
    if len(counts) <= FEW:
        limits = F.broadcast(limits)
    drawn = known.withColumn("place", F.xxhash64("doc_id", "text")).join(limits, "lang").where(F.pmod("place", F.lit(1 << 20)) < F.col("part") * (1 << 20)).select("lang", "place", "text")
    found = drawn.mapInArrow(frugal(_samples({k: i for i, k in enumerate(languages)})), "language int, place long, back boolean, buckets binary, shares binary").collect()
    rows, places = [], [set() for _ in languages]
    for kind, place, back, where, share in sorted(found):
        if place in places[kind] or len(places[kind]) < most:
            places[kind].add(place)
            rows.append((kind, back, np.frombuffer(where, np.int32), np.frombuffer(share, np.float32)))
    return train(rows, languages)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous, runner_up of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sent.value.predict(text.as_py()) for text in batch.column("text")]
            columns = list(zip(*found, strict=True)) if found else [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.float64(), pa.bool_(), pa.string()), strict=True))], ["doc_id", "lang_pred", "score", "ambiguous", "runner_up"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = rows.mapInArrow(frugal(run), "doc_id long, lang_pred string, score double, ambiguous boolean, runner_up string")
    return found.select("doc_id", F.coalesce(is_held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous", "runner_up")


def identify(docs: DataFrame) -> DataFrame:
    return predict(docs, fit(docs))
