"""Phrase collocations: frequent phrases of 2 to 5 words, scored by their weakest cut.

Texts are lower-cased (A-Z), split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and the pieces at blanks and tabs into
words; everything is counted per ``lang`` (null: ``und``). Counting goes level by level, Apriori-safe: a phrase of
``m`` words can occur ``MIN_COUNT`` times only if both its phrases of ``m - 1`` words do, so the candidates of a level
are the frequent phrases of the level before, each followed by a frequent word. Words are counted by Spark; each further
level broadcasts a double-array trie of the frequent phrases of ``m - 1`` words (``base[s] + code = t`` and
``check[t] = s``; the first code is the language). Every task advances the states of all text positions of a batch at
once in numpy, one word a step, from each position and from the one after it: where both reach a frequent phrase, the
occurrence of the candidate (prefix state, last word) is counted (``np.unique`` of the keys), and Spark sums the counts
over the tasks. No candidate list is ever formed, and a trie holds at most (word occurrences) / ``MIN_COUNT`` phrases,
as each needs that many occurrences; its size is logged.

A candidate (2 to 5 words, ``a = f >= MIN_COUNT``) is cut after ``k`` words into parts counted ``l`` and ``r``; the
score ``floor(1000 a n / (l r))`` of the lowest cut counts (ties: smallest ``k``), computed exactly in 38-digit decimals.
A candidate is dropped when a candidate one word longer that contains it occurs as often (``f(longer) >= a``; a longer
container further out implies one a word longer). Each language's first ``TOP`` by score, ``a`` (both descending) and
phrase (ascending, UTF-8 bytes) are returned.

Defined cases: null text counts as empty; an empty table or one without frequent phrases gives no rows; rows are
counted as often as they occur (repeats included); extra columns are not read.
"""

from __future__ import annotations

import logging
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textwarden.sources.scratch import materialise

MIN_COUNT = 100
LONGEST = 5
TOP = 2000
# Word positions counted at once in a task.
CHUNK = 1 << 20
# Texts encoded before their ids are handed on.
ENCODED_ROWS = 2_048
PIECE = "[.,;:!?\x0a-\x0d]"
BLANKS = "[\x20\x09]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_log = logging.getLogger(__name__)


def double_array(paths: list[list[int]]) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """``base, check`` of a trie of the code sequences ``paths``, and the state each path ends in.

    The trie is laid out level by level. Nodes with several children come first, the widest before others, at the first
    place that is free for all of them; those with one child then fill the slots that are free, in one go.
    """
    if not paths:
        return np.zeros(1, np.int64), np.array([0] + [-1] * 15, np.int64), []
    lengths = np.array([len(p) for p in paths])
    filled = np.full((len(paths), lengths.max()), -1, np.int64)
    for i, path in enumerate(paths):
        filled[i, : len(path)] = path
    highest = int(filled.max())
    base, check = np.zeros(16, np.int64), np.full(16, -1, np.int64)
    check[0] = 0
    states = np.zeros(len(paths), np.int64)

    def room(size: int) -> None:
        nonlocal base, check
        if size > len(check):
            more = size - len(check) + len(check) // 2
            base = np.concatenate([base, np.zeros(more, np.int64)])
            check = np.concatenate([check, np.full(more, -1, np.int64)])

    def place(codes: np.ndarray, lowest: int) -> int:
        """The first base from ``lowest`` on whose slots are free, tried many at a time."""
        tried = 32
        while True:
            room(lowest + tried + int(codes[-1]) + 1)
            free = np.arange(lowest, lowest + tried)
            for code in codes:
                free = free[check[free + code] < 0]
                if not len(free):
                    break
            if len(free):
                return int(free[0])
            lowest += tried
            tried = min(2 * tried, 65_536)

    for level in range(filled.shape[1]):
        here = np.flatnonzero(lengths > level)
        edges, edge_of = np.unique(states[here] * (highest + 1) + filled[here, level], return_inverse=True)
        nodes, codes = edges // (highest + 1), edges % (highest + 1)
        first = np.flatnonzero(np.diff(nodes, prepend=-1))
        width = np.diff(np.append(first, len(nodes)))
        lowest: dict[int, int] = {}
        for at in first[np.argsort(-width, kind="stable")][: int((width > 1).sum())]:
            own = codes[at : np.searchsorted(nodes, nodes[at], side="right")]
            # Bases below one that did not fit a node as wide are not tried again.
            found = place(own, lowest.get(len(own), 1))
            lowest[len(own)] = found
            base[nodes[at]] = found
            check[found + own] = nodes[at]
        single = first[width == 1]
        if len(single):
            # Beyond the highest code, so that every base is positive.
            room(highest + 2 + int((check >= 0).sum()) + len(single))
            free = highest + 1 + np.flatnonzero(check[highest + 1 :] < 0)[: len(single)]
            base[nodes[single]] = free - codes[single]
            check[free] = nodes[single]
        states[here] = (base[nodes] + codes)[edge_of]
    return base, check, states.tolist()


def advance(base: np.ndarray, check: np.ndarray, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The next state of every position at once; -1 where the trie has no such edge (or the state is dead)."""
    alive = (states >= 0) & (codes >= 0)
    t = np.where(alive, base[np.maximum(states, 0)] + np.maximum(codes, 0), 0)
    t = np.where(t < len(check), t, 0)
    ok = alive & (check[t] == states) & (t > 0)
    return np.where(ok, t, -1)


def pieces(text: str | None) -> list[list[str]]:
    lowered = (text or "").translate(str.maketrans(UPPER, LOWER))
    return [[w for w in re.split(BLANKS, p) if w] for p in re.split(PIECE, lowered)]


def _kinds() -> tuple[bytes, np.ndarray]:
    """Bytes in lower case, and per byte 0 inside a word, 1 for a blank, 2 between pieces."""
    kinds = np.zeros(256, np.uint8)
    kinds[[0x20, 0x09]] = 1
    kinds[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
    return bytes(range(256)).lower(), kinds


def words_in(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All words of the texts, the places they take among words and ends of pieces, and where each text ends there."""
    lower, kinds = _kinds()
    texts = pa.concat_arrays([texts]) if texts.offset else texts
    bounds = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1)
    lowered = (texts.buffers()[2] or pa.py_buffer(b"")).to_pybytes()[bounds[0] : bounds[-1]].translate(lower)
    bounds = bounds - bounds[0]
    letters = np.frombuffer(lowered, np.uint8)
    kind = kinds[letters]
    inside = kind == 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    at_text = bounds[:-1][bounds[:-1] < len(kind)]
    begins[at_text] = inside[at_text]
    items = np.flatnonzero(begins | (kind == 2))
    # Every text ends its last piece.
    ends = np.searchsorted(items, bounds[1:]) + np.arange(1, len(bounds))
    item_at = np.ones(len(items) + len(texts), bool)
    item_at[ends - 1] = False
    places = np.flatnonzero(item_at)[begins[items]]
    starts = np.flatnonzero(begins[inside])
    offsets = np.append(starts, int(inside.sum())).astype(np.int32)
    data = pa.py_buffer(letters[inside])
    return pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(offsets), data]), places, ends


def _encoder(words: dict[tuple[str, str], int], langs: dict[str, int]):
    """Each text as the ids of its words (-1: not frequent) with -1 after every piece, and its language's code."""
    known: dict[str, tuple[list[str], list[int]]] = {}
    for (lang, word), i in words.items():
        listed, ids = known.setdefault(lang, ([], []))
        listed.append(word)
        ids.append(i)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = {k: (pa.array(w, pa.string()), np.array([*i, -1], np.int32)) for k, (w, i) in known.items()}
        none = pa.array([], pa.string()), np.array([-1], np.int32)
        for whole in batches:
            whole = whole.sort_by("lang")
            for at in range(0, whole.num_rows, ENCODED_ROWS):
                batch = whole.slice(at, ENCODED_ROWS)
                # Runs of one language.
                runs = pc.run_end_encode(batch["lang"])
                first = 0
                for lang, last in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
                    listed, ids = lists.get(lang, none)
                    found, places, ends = words_in(pc.fill_null(batch["text"].slice(first, last - first), ""))
                    encoded = np.full(int(ends[-1]), -1, np.int32)
                    at_word = pc.fill_null(pc.index_in(found, value_set=listed), len(listed))
                    encoded[places] = ids[at_word.to_numpy(zero_copy_only=False)]
                    lists_of = pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), pa.array(encoded))
                    code = pa.array([langs.get(lang, -1)] * (last - first), pa.int32())
                    yield pa.RecordBatch.from_arrays([code, lists_of], names=["code", "ids"])
                    first = last

    return run


def _extensions(base, check, m: int, vocabulary: int):
    """Counts of ``(state, word)``: a frequent phrase of ``m - 1`` words (its trie state) followed by a word, where
    the last ``m - 1`` words are a frequent phrase too (Apriori-safe), at every position of a chunk at once."""

    def counted(codes: np.ndarray, starts: np.ndarray) -> pa.RecordBatch | None:
        size = len(starts)
        codes = np.concatenate([codes, np.full(m, -1, dtype=np.int64)])
        prefix, suffix = starts.copy(), starts.copy()
        for j in range(m - 1):
            prefix = advance(base, check, prefix, codes[j : j + size])
            suffix = advance(base, check, suffix, codes[j + 1 : j + 1 + size])
        ok = (prefix >= 0) & (suffix >= 0)
        keys, counts = np.unique(prefix[ok] * vocabulary + codes[m - 1 : m - 1 + size][ok], return_counts=True)
        if not len(keys):
            return None
        return pa.RecordBatch.from_pydict(
            {"state": pa.array(keys // vocabulary), "word": pa.array(keys % vocabulary), "f": pa.array(counts.astype(np.int64))}
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            lists = batch.column("ids")
            offsets = lists.offsets.to_numpy()
            values = lists.values
            roots = advance(base, check, np.zeros(batch.num_rows, dtype=np.int64), batch.column("code").to_numpy(zero_copy_only=False).astype(np.int64))
            # Rows are taken in runs of about CHUNK positions; every row ends with a separator, so runs join no words.
            first = 0
            while first < batch.num_rows:
                last = int(np.searchsorted(offsets, offsets[first] + CHUNK, side="right")) - 1
                last = min(max(last, first + 1), batch.num_rows)
                lo, hi = offsets[first], offsets[last]
                starts = np.repeat(roots[first:last], np.diff(offsets[first : last + 1]))
                # Only this run's ids are copied out of the batch.
                chunk = values.slice(int(lo), int(hi - lo)).to_numpy(zero_copy_only=False).astype(np.int64) if hi > lo else None
                found = counted(chunk, starts) if hi > lo else None
                if found is not None:
                    yield found
                first = last

    return run


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT,
                 longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of every language's first ``top`` collocations."""
    spark = docs.sparkSession
    # Read twice, for the words and for the ids; a copy would take the size of the table.
    texts = docs.select(
        F.coalesce(docs[lang_col].cast("string"), F.lit("und")).alias("lang"), docs[text_col].cast("string").alias("text")
    )
    lowered = F.translate(F.coalesce(F.col("text"), F.lit("")), UPPER, LOWER)
    word = texts.select("lang", F.explode(F.split(lowered, PIECE)).alias("piece")).select(
        "lang", F.explode(F.split("piece", BLANKS)).alias("w")
    ).where(F.col("w") != "")
    singles = materialise(word.groupBy("lang", "w").agg(F.count("*").alias("f")), "collocations-words")
    totals = singles.groupBy("lang").agg(F.sum("f").cast("long").alias("n"))
    frequent = {1: singles.where(F.col("f") >= min_count).select("lang", F.array("w").alias("words"), "f")}
    vocabulary = frequent[1].select("lang", F.col("words")[0].alias("w")).collect()
    words = {(r.lang, r.w): i for i, r in enumerate(vocabulary)}
    langs = {lang: i for i, lang in enumerate(sorted({r.lang for r in vocabulary}))}
    encoded = materialise(texts.mapInArrow(_encoder(words, langs), "code int, ids array<int>"), "collocations-ids")
    lexicon = spark.createDataFrame([(i, r.w) for i, r in enumerate(vocabulary)], "word long, w string")
    for m in range(2, longest + 1):
        known = frequent[m - 1].select("lang", "words").collect()
        if not known:
            break
        paths = [[langs[k.lang]] + [words[(k.lang, w)] for w in k.words] for k in known]
        base, check, ends = double_array(paths)
        _log.info("level %d: trie of %d phrases, %d slots", m, len(known), len(check))
        counted = encoded.mapInArrow(_extensions(base, check, m, max(len(vocabulary), 1)), "state long, word long, f long")
        summed = counted.groupBy("state", "word").agg(F.sum("f").alias("f")).where(F.col("f") >= min_count)
        named = spark.createDataFrame(
            [(e, k.lang, k.words) for e, k in zip(ends, known)], "state long, lang string, words array<string>"
        )
        frequent[m] = materialise(
            summed.join(named, "state").join(lexicon, "word")
            .select("lang", F.concat("words", F.array("w")).alias("words"), "f"),
            f"collocations-{m}",
        )
    every = None
    for m, table in frequent.items():
        every = table if every is None else every.unionByName(table)
    counts = materialise(every.select("lang", F.array_join("words", " ").alias("phrase"), "words", "f"), "collocations-f")
    phrases = counts.where(F.size("words") >= 2)
    cuts = phrases.select(
        "lang", "phrase", "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k")
    )
    part = counts.select("lang", "phrase", "f")
    left = part.withColumnRenamed("phrase", "left").withColumnRenamed("f", "l")
    right = part.withColumnRenamed("phrase", "right").withColumnRenamed("f", "r")
    scored = (
        cuts.withColumn("left", F.array_join(F.slice("words", 1, F.col("k")), " "))
        .withColumn("right", F.array_join(F.slice("words", F.col("k") + 1, F.size("words")), " "))
        .join(left, ["lang", "left"])
        .join(right, ["lang", "right"])
        .join(totals, "lang")
    )
    big = "decimal(38,0)"
    scored = scored.withColumn("score", F.expr(f"cast(cast(1000 as {big}) * a * n as {big}) div cast(cast(l as {big}) * r as {big})").cast("long"))
    best = scored.groupBy("lang", "phrase", "words", "a", "n").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut")
    )
    inside = phrases.select(
        "lang", F.col("f").alias("outer"), F.explode(F.array(F.slice("words", 2, F.size("words")), F.slice("words", 1, F.size("words") - 1))).alias("sub")
    ).select("lang", F.array_join("sub", " ").alias("phrase"), "outer")
    covered = best.join(inside, ["lang", "phrase"]).where(F.col("outer") >= F.col("a")).select("lang", "phrase").distinct()
    kept = best.join(covered, ["lang", "phrase"], "left_anti")
    order = Window.partitionBy("lang").orderBy(F.col("cut.score").desc(), F.col("a").desc(), F.col("phrase").cast("binary"))
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select(
        "lang",
        F.col("rank").cast("long").alias("rank"),
        "phrase",
        F.col("a").cast("long").alias("a"),
        F.col("cut.l").cast("long").alias("l"),
        F.col("cut.r").cast("long").alias("r"),
        F.col("n").cast("long").alias("n"),
        F.col("cut.score").cast("long").alias("score"),
    )
