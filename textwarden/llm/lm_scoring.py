"""Log-likelihood of whole documents under a gated recurrent language model, beside that of smoothed word counts.

Counts of all words of all training documents are one table; the base score is

    sum over tokens of log10((c + 0.1) / (N + 0.1 * (V + 1)))

The recurrent model (``gru``) knows the ``VOCABULARY`` most frequent words, the end of a document, and one symbol for all
other words. Another word's probability is that of the symbol times the word's base probability among all words the
model does not know, so every word has one and the whole is a distribution. Frequencies of classes and words come from
the counts of the whole corpus. The weights are fitted on all training documents: they are dealt into shares of about
``SHARE`` by a hash, every share goes on from the same start (a fit of about ``TRAINING`` documents), and the weights of
all shares are averaged, each by its number of tokens.

A task reads its documents with the most frequent words in memory, ``KNOWN`` at most (a fixed bound), and writes each
as numbers of the model's symbols, for the fit and the scores. Rarer words are sent to the count table, one row per
document and word, and their sums are added to the document; they are rare, so no key of that join is hot but a word
missing from all training documents, which the skew-join rule splits. Null texts count as empty and have the end token
alone.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textwarden.llm import gru
from textwarden.llm.columns import whole_text
from textwarden.llm.worker_memory import remembered
from textwarden.sources.scratch import materialise

SMOOTHING = 0.1
KNOWN = 65_536
VOCABULARY = 2_048
TRAINING = 1_500
# Training documents of a share, on average, and what is fitted to them: streams side by side, but windows enough.
SHARE = 4_096
STREAMS = 512
LEAST_WINDOWS = 64
RATE = 0.02
# Weights that are averaged in one row, and documents read or scored side by side.
BLOCK = 4_096
TOGETHER = 2_048


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """A-Z in lower case, cut at ASCII blanks: all words, and how many each text has."""
    trimmed = pc.ascii_trim_whitespace(pc.ascii_lower(texts))
    split = pc.ascii_split_whitespace(trimmed)
    # A text without words is cut into one empty piece.
    pieces = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    pieces[pc.equal(trimmed, "").to_numpy(zero_copy_only=False)] = 0
    words = split.flatten()
    return words.filter(pc.not_equal(words, "")), pieces


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = pc.value_counts(words_of(batch["text"])[0])
        yield pa.RecordBatch.from_arrays(found.flatten(), names=["word", "c"])


def word_counts(texts: DataFrame) -> DataFrame:
    """``word, c`` over a column ``text``; a table."""
    counted = texts.select("text").mapInArrow(_counted, "word string, c long")
    return materialise(counted.groupBy("word").agg(F.sum("c").alias("c")), "lm-counts")


def most_frequent(counts: DataFrame, at_most: int) -> DataFrame:
    """The most frequent words, as many as fit whole steps of frequency (16 to a doubling) below ``at_most``.

    The steps are counted first, a thousand at most, so no task picks or sends a share of its own.
    """
    step = F.floor(F.log2("c") * 16).cast("int")
    found = sorted(counts.groupBy(step.alias("step")).count().collect(), reverse=True)
    taken, least = 0, None
    for row in found:
        taken += row["count"]
        if taken > at_most:
            break
        least = row["step"]
    return counts.where(F.lit(False) if least is None else step >= least)


@dataclass
class Scorer:
    """What a task needs: the most frequent words with their base scores, and the recurrent model.

    Words of the model are numbered by rank; then come the end and the symbol for other words, where their frequencies
    put them: ``symbol_of`` maps ranks, the end and the rest to the model's numbers.
    """

    words: list[str]
    base: np.ndarray
    end_base: float
    symbol_of: np.ndarray
    end: int
    other: int
    other_mass: float
    model: gru.Gru | None = None

    def prepare(self) -> None:
        self.listed = pa.array(self.words, pa.string())

    def numbers(self, words: pa.Array) -> np.ndarray:
        """Rank of each word; one beyond the last for rarer ones."""
        found = pc.fill_null(pc.index_in(words, value_set=self.listed), len(self.words))
        return found.to_numpy(zero_copy_only=False)

    def symbols(self, numbers: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The model's numbers of the words of texts of these lengths, each text with its end."""
        ends = np.cumsum(lengths + 1) - 1
        out = np.empty(len(numbers) + len(lengths), SYMBOL)
        inside = np.ones(len(out), bool)
        inside[ends] = False
        out[inside] = self.symbol_of[numbers]
        out[ends] = self.end
        return out

    def read(self, texts: pa.Array) -> tuple[pa.Array, ...]:
        """Per text: tokens, known tokens and base score without the rare words, what the words that the model does not
        know add to its score, the model's symbols, and the rare words with their numbers."""
        words, lengths = words_of(texts)
        numbers = self.numbers(words)
        n, owner = len(lengths), np.repeat(np.arange(len(lengths)), lengths)
        summed = partial(np.bincount, minlength=n)
        base = np.append(self.base, 0.0)[numbers]
        # A word the model does not know: its base probability among those.
        unseen = self.symbol_of[numbers] == self.other
        inside = summed(owner[unseen], base[unseen]) - summed(owner[unseen]) * np.log10(self.other_mass)
        rare = numbers == len(self.words)
        coded = words.filter(pa.array(rare)).dictionary_encode()
        codes = max(1, len(coded.dictionary))
        pairs, often = np.unique(owner[rare] * codes + coded.indices.to_numpy(), return_counts=True)
        ends = pa.array(np.searchsorted(pairs, np.arange(n + 1) * codes), pa.int32())
        symbols = self.symbols(numbers, lengths)
        bounds = (np.cumsum([0, *(lengths + 1)]) * symbols.itemsize).astype(np.int32)
        return (
            pa.array(lengths + 1),
            pa.array(lengths - summed(owner[rare])),
            pa.array(summed(owner, base) + self.end_base),
            pa.array(inside),
            pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(bounds), pa.py_buffer(symbols)]),
            pa.ListArray.from_arrays(ends, coded.dictionary.take(pa.array(pairs % codes))),
            pa.ListArray.from_arrays(ends, pa.array(often)),
        )


# How symbols are written.
SYMBOL = np.dtype("<u2")


def documents_of(written: pa.Array) -> list[np.ndarray]:
    """The model's numbers of documents written as symbols."""
    return [np.frombuffer(x, SYMBOL).astype(np.int64) for x in written.to_pylist()]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, TOGETHER):
            yield batch.slice(at, TOGETHER)


def _scorer(content: bytes) -> Scorer:
    def made() -> Scorer:
        scorer = pickle.loads(content)
        scorer.prepare()
        return scorer

    return remembered(("lm", content), made)


def fit(counts: DataFrame, documents: int, total: int, distinct: int, sample: list[str]) -> Scorer:
    """A scorer from the count table: ``total`` tokens with ends, ``distinct`` with the end."""
    top = sorted(most_frequent(counts, KNOWN).collect(), key=lambda r: (-r["c"], r["word"]))
    words, c = [r["word"] for r in top], np.array([r["c"] for r in top], np.float64)
    denominator = total + SMOOTHING * (distinct + 1)
    base = np.log10((c + SMOOTHING) / denominator)
    end_base = float(np.log10((documents + SMOOTHING) / denominator))
    inside = min(VOCABULARY, len(words))
    inner = c[:inside]
    other = max(total - documents - inner.sum(), 0.0)
    # The model's words by falling frequency, the end and the other words among them.
    frequencies = np.concatenate([inner, [documents, other]])
    order = np.argsort(-frequencies, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    symbol_of = np.full(len(words) + 1, place[inside + 1])
    symbol_of[:inside] = place[:inside]
    mass = 1 - (10 ** base[:inside]).sum() - 10**end_base
    scorer = Scorer(words, base, end_base, symbol_of, int(place[inside]), int(place[inside + 1]), max(float(mass), 1e-12))
    scorer.prepare()
    scorer.model = gru.train(documents_of(scorer.read(pa.array(sample, pa.string()))[4]), frequencies[order], scorer.end)
    del scorer.listed
    return scorer


def fit_all(start: DataFrame, scorer: Scorer, content: bytes) -> gru.Gru:
    """The model fitted on from the scorer's by every row of ``share, symbols``, and averaged over the shares."""

    def fitted(key: tuple, rows: pa.Table) -> pa.Table:
        known, share = _scorer(content), key[0].as_py()
        # In an order of their own, so that the fit does not depend on how rows were dealt out.
        documents = documents_of(rows["symbols"].take(pc.sort_indices(rows["symbols"])))
        tokens = sum(map(len, documents))
        streams = max(1, min(STREAMS, tokens // (gru.WINDOW * LEAST_WINDOWS)))
        model = gru.with_weights(known.model, gru.flat(known.model))
        gru.improve(model, documents, known.end, 1, RATE, np.random.default_rng(share), streams)
        weights = gru.flat(model)
        blocks = [weights[at : at + BLOCK].tobytes() for at in range(0, len(weights), BLOCK)]
        n = len(blocks)
        columns = [pa.array(range(n), pa.int32()), pa.array([share] * n, pa.int64()), pa.array([tokens] * n, pa.int64())]
        return pa.Table.from_arrays([*columns, pa.array(blocks, pa.binary())], names=["block", "share", "tokens", "weights"])

    dtype = gru.flat(scorer.model).dtype

    def averaged(key: tuple, rows: pa.Table) -> pa.Table:
        total, weight = 0.0, 0
        for at in pc.sort_indices(rows["share"]).to_pylist():
            tokens = rows["tokens"][at].as_py()
            total = total + np.frombuffer(rows["weights"][at].as_py(), dtype).astype(np.float64) * tokens
            weight += tokens
        weights = (total / weight).astype(dtype).tobytes()
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "weights": pa.array([weights], pa.binary())})

    shares = start.groupBy("share").applyInArrow(fitted, "block int, share long, tokens long, weights binary")
    rows = shares.groupBy("block").applyInArrow(averaged, "block int, weights binary").collect()
    if not rows:
        return scorer.model
    weights = np.frombuffer(b"".join(r["weights"] for r in sorted(rows, key=lambda r: r["block"])), dtype)
    return gru.with_weights(scorer.model, weights)


def score_documents(
    docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", training_documents: int = TRAINING
) -> DataFrame:
    """One row per document: ``doc_id, n_tokens, n_known, train_tokens, base_score, score``.

    ``training`` says of a row of ``docs`` whether counts and model may learn from it.
    """
    text = whole_text(docs, text_col)
    texts = docs.where(training).select(docs[id_col].cast("string").alias("name"), text.alias("text"))
    documents = texts.count()
    counts = word_counts(texts)
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    total, distinct = total + documents, distinct + (documents > 0)
    point = F.pmod(F.xxhash64("name", F.lit("lm")), F.lit(1 << 30)) / float(1 << 30)
    chosen = texts.where(point < min(1.0, training_documents / max(documents, 1))).select("text").collect()
    scorer = fit(counts, documents, total, distinct, sorted(r["text"] for r in chosen))
    content = pickle.dumps(scorer)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _scorer(content)
        for batch in _cut(batches):
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["name"], batch["learnt"], *known.read(batch["text"])], names=names
            )

    schema = (
        "doc_id long, name string, learnt boolean, n_tokens long, n_known long, base_score double, score double, "
        "symbols binary, rare array<string>, often array<long>"
    )
    names = [part.split()[0] for part in schema.split(", ")]
    whole = docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        docs[id_col].cast("string").alias("name"),
        F.coalesce(training, F.lit(False)).alias("learnt"),
        text.alias("text"),
    )
    numbered = materialise(
        whole.mapInArrow(read, schema).withColumn("row", F.monotonically_increasing_id()), "lm-symbols"
    )
    share = F.pmod(F.xxhash64("name", "symbols"), F.lit(max(1, documents // SHARE))).alias("share")
    scorer.model = fit_all(numbered.where("learnt").select(share, "symbols"), scorer, content)
    trained = pickle.dumps(scorer)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _scorer(trained)
        for batch in _cut(batches):
            found = known.model.score(documents_of(batch["symbols"]), known.end) / np.log(10)
            columns = [batch[n] for n in (*kept, "row")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(batch["score"].to_numpy() + found)], names=[*kept, "row", "score"]
            )

    kept = ["doc_id", "n_tokens", "n_known", "base_score"]
    scored = materialise(
        numbered.select(*kept, "row", "score", "symbols").mapInArrow(
            score, "doc_id long, n_tokens long, n_known long, base_score double, row long, score double"
        ),
        "lm-scores",
    )
    rare = numbered.select("row", F.inline(F.arrays_zip("rare", "often"))).withColumnRenamed("rare", "word")
    chance = F.log10((F.coalesce("c", F.lit(0)) + SMOOTHING) / F.lit(total + SMOOTHING * (distinct + 1)))
    sums = (
        rare.join(counts, "word", "left")
        .groupBy("row")
        .agg(
            F.sum(F.col("often") * chance).alias("more"),
            F.sum(F.when(F.col("c") > 0, F.col("often")).otherwise(0)).alias("found"),
        )
    )
    more = F.coalesce("more", F.lit(0.0))
    # The end is a token too, known if there was any training document.
    found = F.coalesce("found", F.lit(0)) + F.lit(int(documents > 0))
    return scored.join(sums, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + found).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base_score") + more).alias("base_score"),
        (F.col("score") + more).alias("score"),
    )
