"""Language ID: averaged embeddings of hashed subwords under a linear softmax, with calibrated rejection.

Features of a text are the hashes of its 1-, 3- and 4-byte subwords (lower case, runs of marks as one
blank), each with a row of a table of embeddings; the text is their average. The model is trained in
numpy by stochastic gradient descent with back-propagation into the embeddings. As average and softmax
layer are both linear, applying it needs only the table times the layer, one number a language.

Rejection: garbled texts (random letters and digits, random signs) made from a share of the training
texts are a class of their own. Evidence counts: a text of few features keeps its scores close to even,
and is rejected only if it has none. A held-out part of the sample gives the temperature of the softmax.
A text in a language that isn't known may still be taken for one that is, so that its confidence tells
little; but its best score before the softmax is below what is usual for that language. How far below,
times the evidence, is calibrated on the held-out texts so that the wanted share of them is rejected;
as that is less than one text of them, it is read off the tail above the upper tenth.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treeframe.llm import text as tx
from treeframe.llm.store import written

#: most labelled documents the model is fitted on, shared alike by the labels: a bound on the driver's
#: work, whatever the corpus
SAMPLE = 3000
#: width of an embedding, rows of the table, share of held-out clean texts that may be rejected
WIDTH, ROWS, REJECTED = 16, 1 << 15, 0.0005
_GRAMS = (1, 3, 4)
#: fewest steps of the training
LEAST_STEPS = 280
#: features at which the scores of a text count half
_EVIDENCE = 64
_CHUNK = 1 << 19
_BLANKED = np.arange(256, dtype=np.uint8)
_BLANKED[:128][tx.MARK[:128]] = 32


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows of the table, for each document the number of its first)."""
    low = _BLANKED[tx.folded(data)]
    if not len(low):
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    keep = np.ones(len(low), bool)
    fresh = np.zeros(len(low) + 1, bool)
    fresh[offsets] = True
    keep[1:] = (low[1:] != 32) | (low[:-1] != 32) | fresh[1 : len(low)]
    # nothing is left of a text that is nothing but marks
    said = np.r_[0, np.cumsum(low != 32)][offsets]
    keep &= np.repeat(np.diff(said) > 0, np.diff(offsets))
    low = low[keep].astype(np.uint32)
    offsets = np.r_[0, np.cumsum(keep)][offsets]
    n = len(low)
    out, own = [], []
    rows = np.diff(offsets)
    for size in _GRAMS:
        if n < size:
            continue
        h = low[: n - size + 1].copy()
        for k in range(1, size):
            h = (h << np.uint32(8)) | low[k : n - size + 1 + k]
        h = ((h + np.uint32(size)) * np.uint32(2654435769)) >> np.uint32(32 - ROWS.bit_length() + 1)
        count = np.maximum(rows - size + 1, 0)
        has = count > 0
        at = tx.ragged(offsets[:-1][has], count[has]) if size > 1 else slice(None)
        out.append(h[at])
        own.append(count)
    if not out:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    # features of a document side by side
    total = np.sum(own, axis=0)
    first = np.r_[0, np.cumsum(total)]
    flat = np.empty(first[-1], np.int64)
    base = first[:-1].copy()
    for h, count in zip(out, own):
        flat[tx.ragged(base, count)] = h
        base += count
    return flat, first


def _sums(table: np.ndarray, flat: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each document the sum of its features' rows."""
    out = np.zeros((len(first) - 1, table.shape[1]), table.dtype)
    has = np.flatnonzero(np.diff(first))
    if len(has):
        out[has] = np.add.reduceat(table[flat], first[has], axis=0)
    return out


def _narrow(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The features of texts in 2 bytes each, made a few texts at a time."""
    flat, counts = [np.zeros(0, np.uint16)], []
    data, offsets = _packed(texts)
    for i, j in tx.pieces(offsets, _CHUNK):
        f, first = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        flat.append(f.astype(np.uint16))
        counts.append(np.diff(first))
    return np.concatenate(flat), np.r_[0, np.cumsum(np.concatenate(counts))]


@dataclass
class Model:
    languages: list[str]  # the last class, without a name, is garbled text
    scores: np.ndarray  # the table of embeddings times the layer
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.0
    usual: np.ndarray | None = None  # of each language, the best score of a text in it
    below: float = np.inf  # the most that a text's may be below, as a share, times the evidence

    def shortfall(self, logits: np.ndarray, count: np.ndarray, best: np.ndarray) -> np.ndarray:
        """By how much the best score is below the usual, as a share of it, times the evidence."""
        if self.usual is None:
            return np.zeros(len(best))
        return count**2 / (count**2 + _EVIDENCE**2) - logits[np.arange(len(best)), best] / self.usual[best]

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        flat, first = features(data, offsets)
        count = np.diff(first)
        logits = _sums(self.scores, flat, first) / np.maximum(count, 1)[:, None] + self.bias
        return logits * (count**2 / (count**2 + _EVIDENCE**2))[:, None], count

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language, its probability, accepted) of each document; -1 and 0 for one without features."""
        logits, count = self.logits(data, offsets)
        p = self.probabilities(logits)
        if not self.languages:
            return np.full(len(p), -1), np.zeros(len(p)), np.zeros(len(p), bool)
        best = p[:, :-1].argmax(1)
        sure = p[np.arange(len(p)), best]
        known = self.shortfall(logits, count, best) <= self.below
        best[count == 0], sure[count == 0] = -1, 0
        return best, sure, (sure >= self.least) & known & (count > 0)


def garbled(texts: list[str], rng: np.random.Generator) -> list[str]:
    """Of each text, one of which nothing but the length is kept."""
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz0123456789   "))
    signs = np.array([chr(x) for x in (*range(32, 127), *range(0x400, 0x450), *range(0x4E00, 0x4E60))])
    return ["".join(rng.choice(signs if i % 2 else letters, len(t))) for i, t in enumerate(texts)]


def _packed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(r) for r in raw])].astype(np.int64)


def fit(texts: list[str], labels: list[str], rejected: float = REJECTED, epochs: int = 3, rate: float = 0.5, seed: int = 0) -> Model:
    """The model of some labelled texts. One in four is held out for the calibration."""
    languages = sorted(set(labels))
    rng = np.random.default_rng(seed)
    if not languages:
        return Model([], np.zeros((ROWS, 1), np.float32), np.zeros(1, np.float32))
    order = rng.permutation(len(texts))
    texts, y = [texts[i] for i in order], np.array([languages.index(labels[i]) for i in order])
    hold = max(1, len(texts) // 4)
    held, texts, held_y, y = texts[:hold], texts[hold:] or texts[:hold], y[:hold], y[hold:] if len(y) > hold else y[:hold]
    bad = garbled(texts[: max(3, len(texts) // len(languages))], rng)
    flat, first = _narrow(texts + bad)
    y = np.r_[y, np.full(len(bad), len(languages))]
    classes = len(languages) + 1
    table = rng.uniform(-1 / WIDTH, 1 / WIDTH, (ROWS, WIDTH)).astype(np.float32)
    layer, bias = np.zeros((WIDTH, classes), np.float32), np.zeros(classes, np.float32)
    n, batch = len(y), 32
    # a small sample is passed more often, as it takes some hundred steps for the classes to part
    epochs = max(epochs, -(-LEAST_STEPS * batch // n))
    steps, done = epochs * -(-n // batch), 0
    for _ in range(epochs):
        shuffled = rng.permutation(n)
        for a in range(0, n, batch):
            rows = shuffled[a : a + batch]
            size = np.diff(first)[rows]
            own = flat[tx.ragged(first[:-1][rows], size)].astype(np.int64)
            # share of each feature in each text of the batch
            seen = np.bincount(own * len(rows) + np.repeat(np.arange(len(rows)), size), minlength=ROWS * len(rows))
            share = seen.reshape(ROWS, len(rows)).astype(np.float32) / np.maximum(size, 1)
            mean = share.T @ table
            z = mean @ layer + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            step = np.float32(rate * (1 - done / steps))
            back = p @ layer.T
            layer -= step * (mean.T @ p)
            bias -= step * 0.01 * p.sum(0)
            table -= step * (share @ back)
            done += 1
    model = Model(languages, (table @ layer).astype(np.float32), bias)
    data, offsets = _packed(held)
    parts = [model.logits(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in tx.pieces(offsets, _CHUNK)]
    logits, count = (np.concatenate(x) for x in zip(*parts))
    logits, held_y, count = logits[count > 0], held_y[count > 0], count[count > 0]
    if len(held_y):
        rest = np.arange(len(held_y))
        # not below a quarter, where separable texts would make every letter decisive
        tries = np.geomspace(0.25, 5, 30)
        loss = []
        for model.temperature in tries:
            loss.append(-np.log(np.maximum(model.probabilities(logits)[rest, held_y], 1e-12)).mean())
        model.temperature = float(tries[int(np.argmin(loss))])
        sure = np.sort(model.probabilities(logits)[:, :-1].max(1))
        # half the wanted quantile, and less than even scores give
        model.least = float(min(0.5 / classes, sure[int(rejected * len(sure))] * 0.5))
        _calibrate(model, logits, count, rejected)
    return model


def _calibrate(model: Model, logits: np.ndarray, count: np.ndarray, rejected: float) -> None:
    """Sets what is usual, and how far below it a text may be, from held-out texts."""
    weight = count**2 / (count**2 + _EVIDENCE**2)
    best = logits[:, :-1].argmax(1)
    score = logits[np.arange(len(best)), best] / weight
    enough = weight > 0.5
    if not enough.any() or np.median(score[enough]) <= 0 or not 0 < rejected < 1:
        return
    usual = np.full(len(model.languages), np.median(score[enough]))
    for c in range(len(usual)):
        own = score[enough & (best == c)]
        if len(own) and np.median(own) > 0:
            usual[c] = np.median(own)
    model.usual = usual
    short = model.shortfall(logits, count, best)
    # an exponential tail
    upper = max(0.1, rejected)
    start = np.quantile(short, 1 - upper)
    over = short[short > start] - start
    model.below = float(max(0, start) + (over.mean() * np.log(upper / rejected) if len(over) else np.inf))


def labelled_sample(docs: DataFrame, label: str, sample: int, seed: int = 3) -> tuple[list[str], list[str]]:
    """At most `sample` documents with text and label, wherever they are, and of no label more than its share.

    A label has the distinct texts that are least by a hash; copies of a text are one. Labels of which there
    are few give all they have, and the others share what is left alike; a sample of as many as there are
    labels, at least, has them all.
    """
    rows = docs.select("text", F.col(label).alias("label")).where(F.col("label").isNotNull() & (F.length("text") > 0))
    hashed = rows.select("label", F.xxhash64("text", F.lit(seed)).alias("h"))
    # only hashes are moved: of each label the least ones, and first those of each task
    least = written(hashed.mapInArrow(_least(sample), hashed.schema).distinct(), "sample")
    ranked = least.withColumn("k", F.row_number().over(Window.partitionBy("label").orderBy("h"))).where(F.col("k") <= sample)
    found = sorted((r.n, r.label) for r in ranked.groupBy("label").agg(F.max("k").alias("n")).collect())
    quota, left = {}, sample
    for i, (n, name) in enumerate(found):
        quota[name] = min(n, -(-left // (len(found) - i)) if left else 0)
        left -= quota[name]
    if not quota:
        return [], []
    quotas = docs.sparkSession.createDataFrame(list(quota.items()), rows.select("label", F.lit(0).cast("int").alias("quota")).schema)
    wanted = ranked.join(quotas, "label").where("k <= quota").select("label", "h")
    with_hash = rows.withColumn("h", F.xxhash64("text", F.lit(seed)))
    chosen = with_hash.join(F.broadcast(wanted), ["label", "h"]).groupBy("label", "h").agg(F.min("text").alias("text")).orderBy("label", "h").collect()
    return [r.text for r in chosen], [r.label for r in chosen]


def _least(most: int):
    """Of a task's rows (label, h), for each label the distinct ones that are least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[object, np.ndarray] = {}
        schema = None
        for batch in batches:
            schema = batch.schema
            codes = batch.column(0).dictionary_encode()
            own, h = codes.indices.to_numpy(zero_copy_only=False), batch.column(1).to_numpy()
            for c, name in enumerate(codes.dictionary.to_pylist()):
                new = h[own == c]
                have = kept.get(name)
                kept[name] = np.unique(new if have is None else np.r_[have, new])[:most]
        for name, h in kept.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(h), schema.field(0).type), pa.array(h, schema.field(1).type)], schema=schema)

    return run


def _predicted(sent, columns: list[str], results: list[str], only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = sent.value
        names = np.array([*model.languages, None], object)
        for batch in batches:
            data, offsets, _ = tx.string_bytes(batch.column("text"))
            parts = [model.predict(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in tx.pieces(offsets, _CHUNK)]
            best, sure, accepted = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool))
            if only:
                keep = pa.array(accepted)
                yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in columns], columns)
            else:
                out = [pa.array(names[best], pa.string()), pa.array(sure.astype(np.float64)), pa.array(accepted)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *out], [*columns, *results])

    return run


def language_model(docs: DataFrame, label: str = "lang", sample: int = SAMPLE, rejected: float = REJECTED) -> Model:
    """Fitted on at most `sample` documents that have a label."""
    return fit(*labelled_sample(docs, label, sample), rejected)


def identify(docs: DataFrame, model: Model | None = None, label: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """doc_id, language, confidence, accepted, for every document, over its whole text.

    Null and empty texts, and texts of nothing but marks, aren't accepted: confidence 0, and language null.
    Without any labelled document, no language is known and nothing accepted.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model or language_model(docs, label, sample))
    have = docs.select("doc_id", "text")
    kind = have.schema["doc_id"].dataType.simpleString()
    results = ["language", "confidence", "accepted"]
    return have.mapInArrow(_predicted(sent, ["doc_id"], results, False), f"doc_id {kind}, language string, confidence double, accepted boolean")


def accepted(docs: DataFrame, model: Model | None = None, label: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """The documents, with all columns, that aren't rejected."""
    sent = docs.sparkSession.sparkContext.broadcast(model or language_model(docs, label, sample))
    return docs.mapInArrow(_predicted(sent, docs.columns, [], True), docs.schema)
