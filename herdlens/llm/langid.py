"""Language identification: averaged hashed subword embeddings with a linear softmax, trained by SGD in NumPy.

A text's subwords are its byte n-grams of 2, 3 and 4 bytes, A-Z lower-cased, with every run of ASCII characters that
are not letters as one space. Each n-gram has a hashed bucket, each bucket an embedding; a text is the mean of its
n-grams' embeddings, and a linear layer with softmax gives the languages' probabilities. After training, buckets times
layer is one table of scores, and predicting is a gather and a mean.

A temperature fitted on labelled rows kept out of training calibrates the probabilities. A text is rejected if its
language is less likely than not, or below the lowest probability down to which at most `max_error` of the calibration
rows that are accepted are wrong.

Texts of the sample become n-gram counts in tasks; the driver gets those of a bounded number of rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .textarrays import _LOWER, blocks, text_buffers

ORDERS = (2, 3, 4)
BUCKETS = 1 << 16
DIMENSIONS = 16
EPOCHS = 4
RATE = 2.0
SEED = 7
#: Bound of the training sample: rows a language and rows in all, shared among the languages when they are many (on
#: average; twice that and a row a language are never exceeded). Rows are whole texts.
ROWS_PER_LANGUAGE = 600
ROWS_IN_ALL = 16 * ROWS_PER_LANGUAGE
#: Bound of the different n-grams of all sampled texts, which are 8 bytes each at the driver: each language's rows end
#: with the one that reaches its equal share. A text has at most 196,608.
GRAMS_IN_ALL = 24_000_000
#: Share of the accepted calibration rows that may be wrong, and the probability below which a text is always rejected.
MAX_ERROR, LEAST_SURE = 0.01, 0.5
UNDETERMINED = "und"

_SQUASH = _LOWER.copy()
_SQUASH[:128][~((np.arange(128) >= 97) & (np.arange(128) <= 122) | (np.arange(128) >= 65) & (np.arange(128) <= 90))] = 32
_MULTIPLIER = np.uint32(0x9E3779B1)


def subwords(data: np.ndarray, offsets: np.ndarray):
    """For each order: bucket numbers (of that order) of all texts in a row, and each text's bounds."""
    offsets = offsets - offsets[0]
    n = np.diff(offsets)
    padded = np.full(len(data) + 2 * len(n), 32, np.uint8)
    padded[np.arange(len(data)) + np.repeat(2 * np.arange(len(n)) + 1, n)] = _SQUASH[data]
    at = offsets + 2 * np.arange(len(offsets))
    space = padded == 32
    keep = np.ones(len(padded), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    keep[at[:-1]] = True
    at = np.concatenate([[0], np.cumsum(keep)])[at]
    x = padded[keep].astype(np.uint32)
    for order in ORDERS:
        if len(x) < order:
            yield np.empty(0, np.int64), np.zeros(len(at), np.int64)
            continue
        gram = x[: len(x) - order + 1].copy()
        for j in range(1, order):
            gram = (gram << np.uint32(8)) | x[j : len(x) - order + 1 + j]
        bucket = gram if order == 2 else (gram * _MULTIPLIER) >> np.uint32(16)
        inside = np.ones(len(gram), bool)
        for j in range(1, order):
            cut = at[1:] - j
            cut = cut[(cut >= 0) & (cut < len(inside))]
            inside[cut] = False
        yield bucket[inside], np.concatenate([[0], np.cumsum(inside)])[np.minimum(at, len(inside))]


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # (orders, languages, buckets); with a layer (orders, dimensions, buckets)
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0
    #: of the calibration rows: how many are accepted, and how many of those are wrong
    accepted: float = 1.0
    error: float = 0.0
    #: (dimensions, languages): of many languages the embeddings are kept apart from the layer, so size doesn't grow
    layer: np.ndarray | None = None

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        total, count = np.zeros((len(offsets) - 1, self.table.shape[1])), np.zeros(len(offsets) - 1)
        for k, (buckets, bounds) in enumerate(subwords(data, offsets)):
            n = np.diff(bounds)
            some = np.flatnonzero(n)
            if len(some):
                starts = bounds[:-1][some]
                for c in range(self.table.shape[1]):
                    total[some, c] += np.add.reduceat(self.table[k, c][buckets], starts)
                count += n
        mean = total / np.maximum(count, 1)[:, None]
        return (mean if self.layer is None else mean @ self.layer) + self.bias

    def probabilities(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return softmax(self.logits(data, offsets) / self.temperature)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def gram_counts(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its different n-grams, as order times BUCKETS plus bucket, and how often each occurs."""
    grams = [np.split(x + k * BUCKETS, bounds[1:-1]) for k, (x, bounds) in enumerate(subwords(data, offsets))]
    return [np.unique(np.concatenate(x), return_counts=True) for x in zip(*grams)]


def _counted(batches):
    for batch in batches:
        data, offsets = text_buffers(batch.column("text"))
        for a, b in blocks(offsets):
            rows = gram_counts(data[offsets[a] : offsets[b]], offsets[a : b + 1])
            columns = [pa.array([r[i].astype(np.int32) for r in rows], pa.list_(pa.int32())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("lang").slice(a, b - a), batch.column("h").slice(a, b - a), *columns], ["lang", "h", "grams", "counts"])


def train(sample: list[tuple[np.ndarray, np.ndarray]], labels: list[str], max_error: float = MAX_ERROR, least_sure: float = LEAST_SURE) -> Model | None:
    """The model fitted on four fifths of the rows (n-grams, counts), calibrated on the others. None without rows."""
    if not sample:
        return None
    random = np.random.default_rng(SEED)
    languages = sorted(set(labels))
    number = {x: i for i, x in enumerate(languages)}
    y = np.array([number[x] for x in labels])
    rows = [(np.asarray(i, np.int32), (np.asarray(c) / max(1, np.sum(c)))[:, None].astype(np.float32)) for i, c in sample]
    order = random.permutation(len(rows))
    cut = len(rows) - len(rows) // 5
    fit, held = order[:cut], order[cut:] if len(rows) >= 5 else order
    # a language that chance left out is learnt from the first of its rows
    alone = held[np.unique(y[held], return_index=True)[1]]
    fit = np.concatenate([fit, alone[~np.isin(y[alone], y[fit])]])
    emb = random.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (len(ORDERS) * BUCKETS, DIMENSIONS)).astype(np.float32)
    layer, bias = np.zeros((DIMENSIONS, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    steps, done = EPOCHS * len(fit), 0
    for _ in range(EPOCHS):
        for r in random.permutation(fit):
            index, share = rows[r]
            rate = np.float32(RATE * (1 - done / steps))
            done += 1
            if not len(index):
                continue
            own = emb[index]
            mean = (own * share).sum(0)
            error = softmax(mean @ layer + bias)
            error[y[r]] -= 1
            back = layer @ error
            layer -= rate * np.outer(mean, error)
            bias -= np.float32(0.05) * rate * error
            # a row's share is small: embeddings take the step of the mean, spread over its subwords
            emb[index] = own - rate * len(index) ** 0.5 * share * back
    many = len(languages) > DIMENSIONS
    flat = emb if many else emb @ layer
    table = np.ascontiguousarray(flat.reshape(len(ORDERS), BUCKETS, -1).transpose(0, 2, 1)).astype(np.float32)
    model = Model(languages, table, bias.astype(float), layer=layer.astype(float) if many else None)
    means = np.array([(flat[rows[i][0]] * rows[i][1]).sum(0, dtype=float) for i in held])
    logits, gold = (means @ model.layer if many else means) + model.bias, y[held]
    loss = lambda t: -np.log(softmax(logits / t)[np.arange(len(gold)), gold] + 1e-12).mean()
    model.temperature = float(min(np.geomspace(0.5, 20, 61), key=loss))
    p = softmax(logits / model.temperature)
    sure = np.argsort(-p.max(1), kind="stable")
    wrong = np.cumsum((p.argmax(1) != gold)[sure]) / np.arange(1, len(sure) + 1)
    fine = np.flatnonzero(wrong <= max_error)
    last = int(fine[-1]) if len(fine) else -1
    # with all rows accepted nothing speaks against lower probabilities
    lowest = 0.0 if last + 1 == len(sure) else float(p.max(1)[sure[last]]) if last >= 0 else 1.0
    model.threshold = max(lowest, least_sure)
    taken = p.max(1) >= model.threshold
    model.accepted, model.error = float(taken.mean()), float((p.argmax(1) != gold)[taken].mean()) if taken.any() else 0.0
    return model


def learn(docs: DataFrame, usable: Column, rows: int = ROWS_PER_LANGUAGE) -> Model | None:
    """Trains on a bounded sample of the rows where `usable` holds and text and lang are not null.

    Different texts of a language are drawn by a hash of language and text, at a rate for each language, so rare
    languages are as well covered as common ones, copies count once, and neither doc_ids nor the order of rows play a
    part. Every language is learnt: when they are many, each has fewer rows, one at least. The bounds hold at any input
    size; with very long texts GRAMS_IN_ALL is the one that binds, and fewer rows are taken.
    """
    labelled = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    labelled = labelled.withColumn("h", F.xxhash64(F.lit("sample"), F.col("lang"), F.col("text")))
    chance = F.shiftrightunsigned("h", 32) / F.lit(2.0**32)
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n"), F.min(chance).alias("least")).orderBy("lang").collect()
    if not counts:
        return None
    rows = min(rows, max(1, ROWS_IN_ALL // len(counts)))
    rates = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, rows / r["n"]), r["least"]) for r in counts], "lang string, rate double, least double")
    drawn = labelled.join(F.broadcast(rates), "lang").where((chance < F.col("rate")) | (chance == F.col("least"))).groupBy("lang", "h").agg(F.first("text").alias("text"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    bounded = drawn.withColumn("place", place).where(F.col("place") <= 2 * rows + 1).select("lang", "h", "text")
    counted = bounded.mapInArrow(_counted, "lang string, h long, grams array<int>, counts array<int>")
    before = F.sum(F.size("grams")).over(Window.partitionBy("lang").orderBy("h").rowsBetween(Window.unboundedPreceding, -1))
    counted = counted.withColumn("before", before).where(F.coalesce("before", F.lit(0)) < GRAMS_IN_ALL // len(counts)).drop("before")
    sample = counted.toArrow().to_batches()
    found = [(lang, h, grams.values.to_numpy(), counts.values.to_numpy()) for b in sample for lang, h, grams, counts in zip(b.column("lang").to_pylist(), b.column("h").to_pylist(), b.column("grams"), b.column("counts"))]
    found.sort(key=lambda r: r[:2])
    return train([r[2:] for r in found], [r[0] for r in found])


def _has_letter(raw: np.ndarray) -> bool:
    low = _LOWER[raw]
    if ((low >= 97) & (low <= 122)).any():
        return True
    return bool((raw >= 128).any()) and any(c.isalpha() for c in raw.tobytes().decode())


def _predict(shared):
    def run(batches):
        model = shared.value
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            names, scores = [], []
            for a, b in blocks(offsets):
                letters = np.array([_has_letter(data[offsets[i] : offsets[i + 1]]) for i in range(a, b)])
                if model is None:
                    best, score = np.zeros(b - a, int), np.zeros(b - a)
                else:
                    p = model.probabilities(data[offsets[a] : offsets[b]], offsets[a : b + 1])
                    best, score = p.argmax(1), p.max(1)
                known = letters & (model is not None)
                names += [model.languages[i] if k else UNDETERMINED for i, k in zip(best, known)]
                scores.append(np.where(known, score, 0.0))
            score = np.concatenate(scores) if scores else np.empty(0)
            rejected = pa.array([n == UNDETERMINED or s < model.threshold for n, s in zip(names, score)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score), rejected], [batch.schema.names[0], "lang_pred", "score", "rejected"])

    return run


def predict(docs: DataFrame, model: Model | None, id_column: str = "doc_id") -> DataFrame:
    """id, lang_pred, score and rejected for each row of docs.

    Null texts and texts without a letter are `und` with score 0 and rejected, as all are without a model; others have
    a learned language and its calibrated probability, and are rejected below the model's threshold. Repeated rows get
    equal results, an empty table none; columns but the id and text play no part.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[id_column]
    return docs.select(id_column, "text").mapInArrow(_predict(spark.sparkContext.broadcast(model)), f"`{id_column}` {kind}, lang_pred string, score double, rejected boolean")


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of doc_id as text leaves remainder 2 when divided by 4; null is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def filter_languages(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs without the rows that are rejected, with the predicted language as lang, in one pass.

    Only texts go to Python, and a language and a decision come back; all other columns are unchanged. A table without
    lang gets none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def told(texts: pa.Array) -> pa.Array:
        model = shared.value
        data, offsets = text_buffers(texts)
        names, stay = [None] * len(texts), [False] * len(texts)
        for a, b in blocks(offsets) if model is not None else ():
            p = model.probabilities(data[offsets[a] : offsets[b]], offsets[a : b + 1])
            for i, best, sure in zip(range(a, b), p.argmax(1), p.max(1) >= model.threshold):
                names[i], stay[i] = model.languages[best], bool(sure) and _has_letter(data[offsets[i] : offsets[i + 1]])
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(stay, pa.bool_())], ["lang", "keep"])

    # not deterministic as far as the optimizer knows: it must not be worked out twice, for the filter and for lang
    tell = F.arrow_udf(told, "struct<lang: string, keep: boolean>").asNondeterministic()
    name = "told"
    while name in docs.columns:
        name += "_"
    kept = docs.withColumn(name, tell("text")).where(F.col(f"{name}.keep"))
    return kept.select(*[F.col(f"{name}.lang").alias(c) if c == "lang" else F.col(f"`{c}`") for c in docs.columns])
