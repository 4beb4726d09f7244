"""Personal data: fixed formats, and more found by bootstrapped context patterns.

Seeds are the matches of the fixed formats. The word in front of a seed is a lexical pattern for its kind. Other tokens
that could be identifiers (they hold ``@`` or four digits, and overlap no seed) are instances without a kind. Patterns
and instances form a graph, which is scored in rounds:

* a pattern's confidence for a kind is the sum of its instances' scores for that kind over its number of distinct
  instances plus ``SMOOTHING``;
* an instance scores 1 for the kind it is a seed of; without a kind, ``1 - product(1 - confidence)`` over its patterns.

Patterns with ``min_seeds`` different seeds of a kind and a confidence of ``min_confidence`` or more then discover the
unknown identifiers behind them. Seeds always stay.

Everything is DataFrame expressions. The text is read once; what is kept of it is a narrow table of spans and
contexts. Edges are distinct before they are shuffled, sums are combined before they are shuffled, and joins with a
frequent word are with one row per word, so the skew-join rule can split them. Null texts count as empty; repeated
rows get the same spans; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textwarden.functions.sql import let, lit
from textwarden.llm.columns import narrowed
from textwarden.llm.spans import NO_SPANS, in_order, spans_of
from textwarden.sources.scratch import materialise

# The kinds and formats asked for. The written forms below match the same spans without trying again from
# the middle of a run, so that a long run costs no more than its length.
KINDS = ("email", "ip", "card", "phone")
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?+[0-9]){11,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTET = "^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})$"

TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
# Characters in front of a span that may hold the word of a pattern.
CONTEXT = 64
ROUNDS = 3
SMOOTHING = 2.0

UNKNOWN = -1


def _digits(value: str) -> str:
    return f"regexp_replace({value}, '[^0-9]', '')"


def base_spans(text: str) -> str:
    """All spans of the fixed formats, in order."""
    card = f"length({_digits('s.value')}) <= 19 AND luhn_check({_digits('s.value')})"
    phone = f"length({_digits('s.value')}) BETWEEN 9 AND 15"
    ip = f"forall(split(s.value, '[.]'), x -> rlike(x, {lit(OCTET)}))"
    return in_order(
        [
            spans_of(text, EMAIL, 0, f"contains({text}, '@')"),
            spans_of(text, IP, 1, keep=ip),
            spans_of(text, CARD, 2, keep=card),
            spans_of(text, PHONE, 3, f"contains({text}, '+')", keep=phone),
        ]
    )


def _word_before(text: str, start: str) -> str:
    """The last word in front of an offset, in lower case with digits as 0; empty at the start of the text."""
    window = f"substr({text}, greatest({start} - {CONTEXT}, 0) + 1, least({start}, {CONTEXT}))"
    return f"regexp_replace(lower(regexp_extract({window}, {lit(r'(\S+)\s*$')}, 1)), '[0-9]', '0')"


def _instances(text: str, spans: str) -> str:
    """Spans with their pattern's word and their value's hash."""
    value = f"lower(substr({text}, s.start + 1, s.end - s.start))"
    return (
        f"transform({spans}, s -> struct(s.start AS start, s.kind AS kind, s.end AS end, "
        f"{_word_before(text, 's.start')} AS word, xxhash64({value}) AS instance))"
    )


def _candidates(text: str, base: str) -> str:
    """Tokens that may be identifiers and overlap no base span, without the punctuation around them."""
    token = f"substr({text}, s.start + 1, s.end - s.start)"
    core = f"regexp_extract({token}, {lit(r'[0-9A-Za-z+](?:.*[0-9A-Za-z])?')}, 0)"
    cut = f"s.start + instr({token}, {core}) - 1"
    trimmed = f"transform({spans_of(text, TOKEN, UNKNOWN)}, s -> struct({cut} AS start, s.kind AS kind, {cut} + length({core}) AS end))"
    shaped = f"(contains({token}, '@') OR length({_digits(token)}) >= 4)"
    return f"filter({trimmed}, s -> {shaped} AND NOT exists({base}, b -> b.start < s.end AND s.start < b.end))"


def _contexts(texts: DataFrame) -> DataFrame:
    """``row, doc_id, base, found``: base spans, and base spans and candidates with their contexts. A table, so that
    the row numbers stay as they are."""
    based = texts.withColumn("base", F.expr(base_spans("text")))
    both = f"concat(base, {_candidates('text', 'base')})"
    return materialise(
        based.select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            "base",
            F.expr(let("both", both, _instances("text", "both"))).alias("found"),
        ),
        "pii-contexts",
    )


def _score(edges: DataFrame, rounds: int) -> DataFrame:
    """``word, kind, seeds, confidence`` of the patterns, from ``word, instance, kind`` (distinct)."""
    kinds = range(len(KINDS))
    seeds = edges.groupBy("word").agg(
        F.count("*").alias("instances"), *[F.sum((F.col("kind") == k).cast("long")).alias(f"seeds{k}") for k in kinds]
    )
    # Words in front of no seed say nothing of a kind.
    seeds = materialise(seeds.where(" + ".join(f"seeds{k}" for k in kinds) + " > 0"), "pii-patterns")
    unknown = materialise(
        edges.where(F.col("kind") == UNKNOWN).join(seeds.select("word"), "word", "left_semi").select("word", "instance"),
        "pii-unknown",
    )

    def confidences(gained: DataFrame | None) -> DataFrame:
        joined = seeds if gained is None else seeds.join(gained, "word", "left")
        total = [
            F.col(f"seeds{k}") + (F.lit(0.0) if gained is None else F.coalesce(f"gain{k}", F.lit(0.0))) for k in kinds
        ]
        return joined.select(
            "word",
            *[f"seeds{k}" for k in kinds],
            *[(total[k] / (F.col("instances") + SMOOTHING)).alias(f"conf{k}") for k in kinds],
        )

    found = confidences(None)
    for _ in range(rounds):
        told = unknown.join(found, "word")
        scores = told.groupBy("instance").agg(
            *[(1 - F.exp(F.sum(F.log1p(-F.col(f"conf{k}"))))).alias(f"score{k}") for k in kinds]
        )
        gained = (
            unknown.join(scores, "instance").groupBy("word").agg(*[F.sum(f"score{k}").alias(f"gain{k}") for k in kinds])
        )
        found = materialise(confidences(gained), "pii-confidence")
    each = F.array(
        *[F.struct(F.lit(k).alias("kind"), F.col(f"seeds{k}").alias("seeds"), F.col(f"conf{k}").alias("confidence")) for k in kinds]
    )
    return found.select("word", F.inline(each))


def find_pii(
    docs: DataFrame,
    min_seeds: int = 5,
    min_confidence: float = 0.8,
    rounds: int = ROUNDS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: ``doc_id, base_spans, spans``, both as ``SPAN_TYPE``, in order."""
    rows = _contexts(narrowed(docs, id_col, text_col))
    found = rows.where("size(found) > 0").select("row", F.inline("found"))
    edges = found.where("word <> ''").select("word", "instance", "kind").distinct()
    patterns = _score(edges, rounds).where((F.col("seeds") >= min_seeds) & (F.col("confidence") >= min_confidence))
    # A word that points to two kinds goes with the more certain one, then with the first.
    chosen = patterns.groupBy("word").agg(
        F.max_by("kind", F.struct("confidence", -F.col("kind"))).alias("pattern_kind")
    )
    discovered = (
        found.where(F.col("kind") == UNKNOWN)
        .join(chosen, "word")
        .groupBy("row")
        .agg(F.collect_list(F.struct("start", F.col("pattern_kind").alias("kind"), "end")).alias("more"))
    )
    more = f"coalesce(more, {NO_SPANS})"
    return rows.join(discovered, "row", "left").selectExpr(
        "doc_id", "base AS base_spans", f"{in_order(['base', more])} AS spans"
    )
