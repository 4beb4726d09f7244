"""Language identification by averaged hashed subword embeddings and a linear softmax.

A word stands for itself and its character n-grams, each hashed to a row of an embedding table; a text is the average
over all of them. A linear layer and a softmax give the language. Embeddings and layer are trained together by
stochastic gradient descent in numpy, on a bounded sample of labelled texts: at most ``per_language`` whole texts of
each language, chosen by a hash of their id. A part of the sample is kept out of training; on it the softmax is
calibrated by one temperature, and the score under which a prediction counts as rejected is set so that a share
``reject`` of right predictions would be rejected.

As the model is linear, what a word adds to the logits is one short vector. A worker computes it once per word and
remembers it, up to a bound, so scoring a text costs one lookup per word; the result is that of the whole text.

A text that is null or has no letter gets ``und``, score 0, and is rejected. Rows are independent: there is no shuffle
beyond counting labels. Without any labelled text every row gets ``und``. A long word takes part with all its n-grams.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textwarden.llm.worker_memory import remembered

UNDETERMINED = "und"
LETTERS = re.compile(r"[^\W\d_]+")
BUCKETS = 1 << 15
GRAMS = (2, 3, 4)
# A worker forgets its words when it holds so many.
WORDS = 250_000


def _features(word: str, buckets: int) -> list[int]:
    """Buckets of the word and its n-grams, with marks for its start and end."""
    marked = f"<{word}>"
    raw = [marked, *(marked[i : i + n] for n in GRAMS for i in range(len(marked) - n + 1))]
    return [xxhash.xxh32_intdigest(x) % buckets for x in raw]


def words_of(text: str) -> Counter:
    return Counter(LETTERS.findall(text.lower()))


@dataclass
class LanguageModel:
    languages: list[str]
    # What each bucket adds to the logits, before division by the number of features.
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, rows: list[tuple[np.ndarray, int]]) -> np.ndarray:
        return np.array([total / max(n, 1) for total, n in rows]) + self.bias


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train(
    texts: list[str],
    labels: list[str],
    dimensions: int = 16,
    epochs: int = 8,
    rate: float = 0.5,
    kept_out: float = 0.2,
    reject: float = 0.001,
    buckets: int = BUCKETS,
    seed: int = 7,
) -> LanguageModel:
    """Stochastic gradient descent over shuffled pieces of the texts, one small batch after the other."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    code = {x: i for i, x in enumerate(languages)}
    memory: dict[str, np.ndarray] = {}

    def bag(words: list[str]) -> np.ndarray:
        for w in words:
            if w not in memory:
                memory[w] = np.array(_features(w, buckets), np.int64)
        return np.concatenate([memory[w] for w in words])

    order = rng.permutation(len(texts))
    split = [LETTERS.findall(texts[i].lower()) for i in order]
    wanted = np.array([code[labels[i]] for i in order])
    held = int(len(order) * kept_out)
    # Texts differ in length a thousandfold. They are cut into pieces of 40 words for training, all of them used, so
    # that a step sees about as much of each language.
    pieces = [
        (words[a : a + 40], y)
        for words, y in zip(split[held:], wanted[held:], strict=True)
        for a in range(0, len(words), 40)
    ]
    share = np.bincount([y for _, y in pieces], minlength=len(languages)) if pieces else np.ones(len(languages))
    weight = share.sum() / (len(languages) * np.maximum(share, 1))
    embedding = rng.normal(0, 0.1, (buckets, dimensions)).astype(np.float32)
    layer = np.zeros((dimensions, len(languages)), np.float32)
    bias = np.zeros(len(languages), np.float32)
    batch, steps, step = 32, max(1, epochs * -(-len(pieces) // 32)), 0
    for _ in range(epochs if len(languages) > 1 else 0):
        turn = rng.permutation(len(pieces))
        for at in range(0, len(turn), batch):
            chosen = [pieces[i] for i in turn[at : at + batch]]
            bags = [bag(w) for w, _ in chosen]
            y = np.array([t for _, t in chosen])
            sizes = np.array([len(b) for b in bags])
            flat, owner = np.concatenate(bags), np.repeat(np.arange(len(bags)), sizes)
            hidden = np.add.reduceat(embedding[flat], np.cumsum(sizes) - sizes) / sizes[:, None]
            error = softmax(hidden @ layer + bias)
            error[np.arange(len(y)), y] -= 1
            error *= (weight[y] / len(y))[:, None].astype(np.float32)
            pace = rate * (1 - step / steps) + 1e-3
            back = (error @ layer.T) / sizes[:, None]
            layer -= pace * hidden.T @ error
            bias -= pace * error.sum(0)
            np.subtract.at(embedding, flat, (pace * 10 * back)[owner].astype(np.float32))
            step += 1
    model = LanguageModel(languages, (embedding @ layer).astype(np.float64), bias.astype(np.float64))
    scorer = Scorer(model)
    rows = [scorer.total(Counter(words)) for words in split[:held]]
    known = [i for i, (_, n) in enumerate(rows) if n]
    if known:
        _calibrate(model, model.logits([rows[i] for i in known]), wanted[:held][known], reject)
    return model


def _calibrate(model: LanguageModel, logits: np.ndarray, wanted: np.ndarray, reject: float) -> None:
    """The temperature with the best likelihood of the texts kept out, and the score below which to reject."""
    temperatures = np.geomspace(0.05, 20, 200)
    losses = [-np.log(softmax(logits / t)[np.arange(len(wanted)), wanted] + 1e-300).mean() for t in temperatures]
    model.temperature = float(temperatures[int(np.argmin(losses))])
    chances = softmax(logits / model.temperature)
    right = chances.argmax(1) == wanted
    if right.any():
        model.threshold = min(float(np.quantile(chances.max(1)[right], reject)), 0.5)


class Scorer:
    """A model with the words that a worker has met."""

    def __init__(self, model: LanguageModel) -> None:
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.words: dict[str, int] = {}
        self.vectors = np.zeros((1024, len(self.model.languages) + 1))

    def _add(self, word: str) -> int:
        at = self.words[word] = len(self.words)
        if at == len(self.vectors):
            self.vectors = np.concatenate([self.vectors, np.zeros_like(self.vectors)])
        features = _features(word, len(self.model.weights))
        self.vectors[at, :-1] = self.model.weights[features].sum(0)
        self.vectors[at, -1] = len(features)
        return at

    def total(self, words: Counter) -> tuple[np.ndarray, int]:
        """Sum over all features of a text, and their number."""
        known, add = self.words.get, self._add
        at = [add(w) if (i := known(w)) is None else i for w in words]
        if not at:
            return np.zeros(len(self.model.languages)), 0
        found = np.fromiter(words.values(), np.float64, len(at)) @ self.vectors[at]
        return found[:-1], int(found[-1])

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether the prediction is rejected."""
        if len(self.words) > WORDS:
            self._forget()
        model = self.model
        counted = [words_of(t or "") for t in texts]
        rows = [self.total(words) for words in counted]
        # Signs like a raised two count as parts of words, but are no letters.
        empty = np.array([not any(c.isalpha() for w in words for c in w) for words in counted])
        if not model.languages:
            empty[:] = True
            chances = np.ones((len(texts), 1))
        else:
            chances = softmax(model.logits(rows) / model.temperature)
        best, score = chances.argmax(1), np.where(empty, 0.0, chances.max(1))
        names = [UNDETERMINED if e else model.languages[b] for e, b in zip(empty, best, strict=True)]
        return names, score, empty | (score < model.threshold)


def _scorer(pickled: bytes) -> Scorer:
    return remembered(("langid", pickled), lambda: Scorer(pickle.loads(pickled)))


def labelled_sample(labelled: DataFrame, id_col: str, text_col: str, label_col: str, per_language: int) -> DataFrame:
    """``text, label`` of about ``per_language`` rows of each language at most, by a hash of the id."""
    counts = {r[0]: r[1] for r in labelled.groupBy(labelled[label_col]).count().collect() if r[0] is not None}
    if not counts:
        return labelled.select(labelled[text_col].alias("text"), labelled[label_col].alias("label")).limit(0)
    share: Column = F.lit(0.0)
    for language, n in counts.items():
        share = F.when(labelled[label_col] == language, F.lit(min(1.0, per_language / n))).otherwise(share)
    point = F.pmod(F.xxhash64(labelled[id_col].cast("string"), F.lit("langid")), F.lit(1 << 30)) / float(1 << 30)
    return labelled.where(point < share).select(labelled[text_col].alias("text"), labelled[label_col].alias("label"))


def fit(
    labelled: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "lang",
    per_language: int = 300,
    **options,
) -> LanguageModel:
    """Train on the driver with a bounded sample of the labelled rows."""
    usable = labelled.where(labelled[label_col].isNotNull() & labelled[text_col].isNotNull())
    rows = labelled_sample(usable, id_col, text_col, label_col, per_language).collect()
    rows.sort(key=lambda r: (r["label"], r["text"]))
    return train([r["text"] for r in rows], [r["label"] for r in rows], **options)


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` and ``lang_pred, score, rejected``, which take the place of columns of that name."""
    pickled = pickle.dumps(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(pickled)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                names, score, rejected = scorer.predict(batch["__text"].to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(names), pa.array(score), pa.array(rejected)],
                    names=[*batch.schema.names, "__lang", "__score", "__rejected"],
                )

    # The text travels once, under a name of its own, as do the results.
    passed = docs.select(
        *[docs[c] for c in docs.columns if c != text_col], docs[text_col].cast("string").alias("__text")
    )
    more = [("__lang", T.StringType()), ("__score", T.DoubleType()), ("__rejected", T.BooleanType())]
    schema = T.StructType([*passed.schema.fields, *(T.StructField(name, kind) for name, kind in more)])
    found = passed.mapInArrow(run, schema)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    return found.select(
        *[found["__text"].alias(text_col) if c == text_col else found[c] for c in kept],
        found["__lang"].alias("lang_pred"),
        found["__score"].alias("score"),
        found["__rejected"].alias("rejected"),
    )


def held_out(id_col: Column, folds: int, fold: int) -> Column:
    """Whether the CRC-32 of the id as text falls into a fold. A null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds == fold
