"""Toxicity of whole texts: the network of ``gru`` scores every window of 16 words, eight words apart, so that windows
overlap; a text's score is that of its worst window, calibrated.

Labels mark documents, not windows, so training is multiple-instance: at first the windows of a toxic document that hold
words or word parts typical of toxic documents stand for it, later those that the network itself finds worst; harmless
documents give random windows and the ones that look worst. The sample is bounded: up to ``TOXIC_SAMPLE`` toxic and
``CLEAN_SAMPLE`` other labelled rows with texts of up to ``SAMPLE_CHARS`` characters, picked by a hash of doc_id, and only
rows whose crc32(doc_id as text) mod 5 is not 0. Scores never see labels, language, source or doc_id.

Defined cases: a null or empty text, or one without words, has the score of a text without any sign (the least);
repeated rows get equal scores; without labelled rows of both kinds every score is 0; an empty table gives an empty result;
other columns are ignored; texts and letter runs of any length are scored whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import as_documents, frugal, give_back
from tessera.llm.gru import LONGEST, Network, sigmoid, spell

WINDOW, STRIDE = 16, 8
TOXIC_SAMPLE, CLEAN_SAMPLE, SAMPLE_CHARS = 1500, 3000, 6000
#: Words whose inputs a task keeps, and windows it runs at once.
KEPT_WORDS, RUN_WINDOWS = 150_000, 2048
SLICE_TEXTS = 250
_WORD = re.compile(r"[^\W_]+")


def tokens(text: str) -> list[str]:
    """Words; one with more letters than ``spell`` reads is cut into overlapping pieces, the last of which ends with it."""
    words = _WORD.findall(text.lower())
    if max(map(len, words), default=0) <= 2 * LONGEST:
        return words
    return [w[at : at + 2 * LONGEST] for w in words for at in ([*range(0, len(w) - 2 * LONGEST, LONGEST), len(w) - 2 * LONGEST] if len(w) > 2 * LONGEST else (0,))]


def window_starts(n: int) -> np.ndarray:
    """Starts of the overlapping windows over n words; the last one ends with the text."""
    if n <= WINDOW:
        return np.zeros(1 if n else 0, np.int64)
    starts = np.arange(0, n - WINDOW, STRIDE)
    return np.append(starts, n - WINDOW)


def cut(ids: np.ndarray) -> np.ndarray:
    """(windows, WINDOW) of word ids; a shorter text is repeated to fill its one window."""
    if 0 < len(ids) < WINDOW:
        ids = np.resize(ids, WINDOW)
    return ids[window_starts(len(ids))[:, None] + np.arange(WINDOW)]


def _parts(word: str) -> set[str]:
    return {word, *(f"^{word[:k]}" for k in (4, 5, 6) if len(word) > k), *(f"{word[-k:]}$" for k in (4, 5, 6) if len(word) > k)}


def _evidence(names: list[str], docs: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """For each word the strongest log-odds, over documents, of itself or one of its ends."""
    def held(words: np.ndarray) -> set[str]:
        return set().union(*(_parts(names[w]) for w in np.unique(words).tolist()))

    n_toxic, n_clean = int(labels.sum()), int((labels == 0).sum())
    toxic, clean = Counter(), Counter()
    for words, label in zip(docs, labels.tolist(), strict=True):
        if label:
            toxic.update(held(words))
    toxic = {p: a for p, a in toxic.items() if a >= 3}  # the others are not counted, which keeps the driver's memory small
    for words, label in zip(docs, labels.tolist(), strict=True):
        if not label:
            clean.update(toxic.keys() & held(words))
    odds = {p: np.log((a + 0.5) / (n_toxic + 1)) - np.log((clean[p] + 0.5) / (n_clean + 1)) for p, a in toxic.items()}
    return np.array([max((odds.get(p, 0.0) for p in _parts(w)), default=0.0) for w in names], np.float32)


class Model:
    """The trained network and its calibration; what tasks need to score."""

    def __init__(self, network: Network, slope: float, shift: float):
        self.network, self.slope, self.shift = network, slope, shift

    def reset(self) -> None:
        self.known: dict[str, int] = {}
        self.given = np.zeros((1024, self.network.inputs(np.zeros((1, self.network.p["left"].shape[0]), np.float32)).shape[1]), np.float32)

    def ids(self, words: list[str]) -> np.ndarray:
        """Word numbers; inputs of new words are computed and kept."""
        if not hasattr(self, "known"):
            self.reset()
        known = self.known
        new = list({w for w in words if w not in known})
        if len(known) + len(new) > KEPT_WORDS and known:
            self.reset()
            return self.ids(words)
        for at in range(0, len(new), 8192):
            some = new[at : at + 8192]
            inputs = self.network.inputs(self.network.words(spell(some))[0])
            need = len(known) + len(some)
            if need > len(self.given):
                self.given = np.concatenate([self.given, np.zeros((max(need, 2 * len(self.given)) - len(self.given), self.given.shape[1]), np.float32)])
            self.given[len(known) : need] = inputs
            known.update(zip(some, range(len(known), need), strict=True))
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def logits(self, windows: np.ndarray) -> np.ndarray:
        if not len(windows):
            return np.zeros(0, np.float32)
        return np.concatenate([self.network.windows(self.given, windows[at : at + RUN_WINDOWS])[0] for at in range(0, len(windows), RUN_WINDOWS)])

    def worst(self, texts: list[list[str]]) -> np.ndarray:
        """The worst window's logit of each text, -inf without words. Texts are run together in slabs."""
        out, at = np.full(len(texts), -np.inf, np.float32), 0
        while at < len(texts):
            stop, size = at, 0
            while stop < len(texts) and (stop == at or size + len(texts[stop]) < 100_000):
                size += len(texts[stop])
                stop += 1
            ids = self.ids([w for words in texts[at:stop] for w in words])
            ends = np.cumsum([len(w) for w in texts[at:stop]])
            cuts = [cut(ids[b - len(w) : b]) for w, b in zip(texts[at:stop], ends.tolist(), strict=True)]
            counts = np.array([len(c) for c in cuts])
            logits = self.logits(np.concatenate(cuts))
            full = np.flatnonzero(counts)
            if len(full):
                out[at + full] = np.maximum.reduceat(logits, (np.cumsum(counts) - counts)[full])
            at = stop
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        # A slice at a time: the words of a whole Arrow batch would take more memory than its texts by far.
        slices = [self.worst([tokens(t) for t in texts[at : at + SLICE_TEXTS]]) for at in range(0, len(texts), SLICE_TEXTS)]
        worst = np.concatenate(slices) if slices else np.zeros(0, np.float32)
        return sigmoid(np.clip(self.slope * np.maximum(worst, -30).astype(np.float64) + self.shift, -30, 30))


def _calibrate(worst: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a weighted logistic fit of labels to the worst windows' logits, by Newton steps."""
    x = np.column_stack([np.maximum(worst, -30).astype(np.float64), np.ones(len(worst))])
    beta = np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (weights * (p * (1 - p)))[:, None]).T @ x + np.diag([0.05, 0.05])
        beta = beta + np.linalg.solve(hessian, x.T @ (weights * (labels - p)) - np.array([0.05, 0.05]) * (beta - np.array([1.0, 0.0])))
    return (float(beta[0]), float(beta[1])) if beta[0] > 0.05 else (1.0, 0.0)


def train(texts: list[str], labels: np.ndarray, share: float, epochs: tuple[int, int] = (3, 2), seed: int = 5) -> Model | None:
    """Fit on labelled texts; ``share`` is the part of toxic documents among all labelled ones, for the calibration."""
    order = sorted(range(len(texts)), key=lambda k: (texts[k], labels[k]))
    texts, labels = [texts[k] for k in order], labels[order]
    if labels.min(initial=1) == labels.max(initial=0):
        return None
    seen: dict[str, int] = {}
    docs = [np.array([seen.setdefault(w, len(seen)) for w in tokens(t)], np.int32) for t in texts]  # words as numbers: strings would take ten times the memory
    names = sorted(seen)
    place = np.empty(len(names), np.int32)
    place[[seen[w] for w in names]] = np.arange(len(names))
    docs = [place[words] for words in docs]
    signs = _evidence(names, docs, labels)
    cuts = [cut(words) for words in docs]
    rng, network = np.random.default_rng(seed), Network(seed)
    spelled = spell(names)
    worst = [signs[c].max(axis=1) for c in cuts]
    floor = 1.5
    for phase, rounds in enumerate(epochs):
        for epoch in range(rounds):
            if phase and epoch % 2 == 0:
                given = np.concatenate([network.inputs(network.words(tuple(s[..., at : at + 8192] for s in spelled))[0]) for at in range(0, len(names), 8192)])
                probe = Model(network, 1, 0)
                probe.given = given
                worst, floor = [probe.logits(c) for c in cuts], -np.inf
            picked, target = [], []
            for windows, signal, label in zip(cuts, worst, labels.tolist(), strict=True):
                if not len(windows):
                    continue
                top = np.argsort(-signal, kind="stable")[: 2 - label]
                if label:
                    top = top[signal[top] > floor]
                else:
                    top = np.append(top, rng.integers(0, len(windows), 2))
                picked.append(windows[top])
                target.append(np.full(len(top), label, np.float32))
            windows, y = np.concatenate(picked), np.concatenate(target)
            weight = np.where(y == 1, max(1.0, 0.3 * (y == 0).sum() / max(1, (y == 1).sum())), 1.0).astype(np.float32)
            shuffled = rng.permutation(len(windows))
            size = 256 if len(windows) > 4000 else 64
            for at in range(0, len(windows), size):
                some = shuffled[at : at + size]
                used, ids = np.unique(windows[some], return_inverse=True)
                network.learn(tuple(s[..., used] for s in spelled), ids.reshape(-1, WINDOW), y[some], weight[some], 0.01 if not phase else 0.004)
    model = Model(network, 1.0, 0.0)
    found = np.concatenate([model.worst([tokens(t) for t in texts[at : at + SLICE_TEXTS]]) for at in range(0, len(texts), SLICE_TEXTS)])
    model.reset()
    toxic = labels == 1
    weights = np.where(toxic, share / max(1, toxic.sum()), (1 - share) / max(1, (~toxic).sum())) * len(labels)
    model.slope, model.shift = _calibrate(found, labels.astype(np.float64), weights)
    return model


def is_held_out(doc_id):
    return F.crc32(doc_id.cast("string")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """A model from the bounded sample of labelled rows outside the held-out fold."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1) and doc_id is not null").where(~is_held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    # Twice the sample's ids are drawn, since some texts are too long; ids, not texts, are what is sorted and sent around.
    drawn = [known.where(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * size) for kind, size in ((1, TOXIC_SAMPLE), (0, CLEAN_SAMPLE))]
    texts = as_documents(docs).where(F.length("text") <= SAMPLE_CHARS).join(F.broadcast(drawn[0].unionByName(drawn[1])), "doc_id").toPandas()
    texts = texts.sort_values(["toxic", "doc_id", "text"]).groupby("toxic", group_keys=False)[["text", "toxic"]].apply(lambda g: g.head(TOXIC_SAMPLE if g["toxic"].iloc[0] else CLEAN_SAMPLE)) if len(texts) else texts
    if not len(texts):
        return None
    model = train(texts["text"].tolist(), texts["toxic"].to_numpy(np.int64), counts.get(1, 0) / max(1, sum(counts.values())))
    give_back()
    return model


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            scores = sent.value.scores(texts) if sent.value is not None else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    scored = as_documents(docs).mapInArrow(frugal(run, lambda: sent.value is not None and sent.value.reset()), "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(is_held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))


def keep_clean(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that the model does not call toxic; a null text counts as empty."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if sent.value is not None and batch.num_rows:
                scores = sent.value.scores([t or "" for t in batch.column(text_col).to_pylist()])
                batch = batch.filter(pa.array(scores < 0.5))
            yield batch

    return docs.mapInArrow(frugal(run, lambda: sent.value is not None and sent.value.reset()), docs.schema)
