"""Secret scans through a trigram index.

From every rule's regex a Boolean query over trigrams is derived: an OR of ANDs that every matching text meets. The
index has, for the trigrams that occur in queries, the keys of the documents that hold them. Postings of a conjunction
are intersected, those of a rule united, and only these candidates are verified with the regex itself. Rules without a
mandatory trigram are tried on every text.

Trigrams are compared in lower case, so that one index serves rules that ignore case and rules that do not; the key is
a hash of the row. Both only ever add candidates, which the verification turns down.

Documents are read twice and never shuffled while the candidates fit ``BROADCAST_BYTES`` (their number is counted
first); beyond that, documents and candidates are joined by key. Null texts count as empty, rows that are equal in
every respect share a key, and an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from re import _constants as op
from re import _parser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textwarden.functions.sql import ident, lit
from textwarden.llm.columns import narrowed, whole_text
from textwarden.llm.spans import in_order, spans_of
from textwarden.sources.scratch import materialise

BROADCAST_BYTES = 32 << 20
# What a candidate takes in a broadcast hash table, rounded up.
CANDIDATE_BYTES = 64
# Sets of strings and conjunctions are kept up to this size when a query is derived; beyond it, it gets weaker.
LARGEST = 64


@dataclass(frozen=True)
class Rule:
    """``value`` is the capture group that must have ``at_least`` characters; failing matches are dropped."""

    kind: str
    regex: str
    value: int = 0
    at_least: int = 0


# The kinds and patterns asked for. For access keys and hex runs the least length stands in the pattern:
# a run that is too short has no longer one inside, so the same spans match, and short runs are never marked.
BASE_RULES = (
    Rule(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{24,}"),
)

# Formats that issuers of keys document.
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)

RULES = BASE_RULES + MORE_RULES

# An OR of ANDs; None stands for any text.
Query = frozenset[frozenset[str]] | None


def _either(queries: Sequence[Query]) -> Query:
    if any(q is None for q in queries):
        return None
    every = frozenset().union(*queries)
    # A conjunction that asks for more than another adds nothing.
    return frozenset(a for a in every if not any(b < a for b in every))


def _both(a: Query, b: Query) -> Query:
    if a is None or b is None:
        return b if a is None else a
    if len(a) * len(b) > LARGEST:
        return min(a, b, key=len)
    return _either([frozenset(x | y for x in a for y in b)])


def _of_strings(strings: frozenset[str]) -> Query:
    grams = [frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings]
    return _either([frozenset([g]) if g else None for g in grams])


def _strings_or_query(tree) -> tuple[frozenset[str] | None, Query]:
    """The strings that a regex part stands for, if they are few, else what its matches must hold."""
    query: Query = None
    strings, exact = frozenset([""]), True
    for kind, value in tree:
        own, needs = _node(kind, value)
        if own is not None and len(strings) * len(own) <= LARGEST:
            strings = frozenset(a + b for a in strings for b in own)
            continue
        exact = False
        query = _both(query, _of_strings(strings))
        strings = own if own is not None else frozenset([""])
        query = _both(query, needs)
    if exact:
        return strings, None
    return None, _both(query, _of_strings(strings))


def _node(kind, value) -> tuple[frozenset[str] | None, Query]:
    if kind is op.LITERAL:
        return frozenset([chr(value).lower()]), None
    if kind is op.IN:
        few = [chr(v).lower() for k, v in value if k is op.LITERAL]
        return (frozenset(few), None) if len(few) == len(value) <= 8 else (None, None)
    if kind is op.SUBPATTERN:
        return _strings_or_query(list(value[3]))
    if kind is op.BRANCH:
        parts = [_strings_or_query(list(part)) for part in value[1]]
        if all(strings is not None for strings, _ in parts):
            return frozenset().union(*(strings for strings, _ in parts)), None
        return None, _either([_of_strings(s) if s is not None else q for s, q in parts])
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
        least, most, inner = value
        strings, query = _strings_or_query(list(inner))
        if least == 0:
            return (strings | {""}, None) if most == 1 and strings is not None else (None, None)
        if strings is not None and least == most and len(strings) ** least <= LARGEST:
            made = frozenset([""])
            for _ in range(least):
                made = frozenset(a + b for a in made for b in strings)
            return made, None
        return None, _of_strings(strings) if strings is not None else query
    if kind is op.AT:
        return frozenset([""]), None
    return None, None


def trigram_query(regex: str) -> Query:
    """What every text with a match holds, in lower case; None if nothing is certain."""
    strings, query = _strings_or_query(list(_parser.parse(regex)))
    return _of_strings(strings) if strings is not None else query


def trigram_index(docs: DataFrame, trigrams: Sequence[str]) -> DataFrame:
    """``gram, key``: for each of the trigrams the documents ``doc_id, text`` that hold it; a table."""
    lowered = docs.select(F.xxhash64("doc_id", "text").alias("key"), F.lower("text").alias("lowered"))
    held = F.array_compact(
        F.array(*[F.when(F.contains("lowered", F.lit(g)), F.lit(i)) for i, g in enumerate(trigrams)])
    )
    return materialise(lowered.select(F.explode(held).alias("gram"), "key"), "trigram-index")


def candidates(index: DataFrame, trigrams: Sequence[str], queries: Sequence[Query]) -> DataFrame:
    """``key, rules``: for every document that may match, the rules it may match as bits."""
    number = {g: i for i, g in enumerate(trigrams)}
    wanted = [
        (number[g], rule, conjunction, len(grams))
        for rule, query in enumerate(queries)
        if query is not None
        for conjunction, grams in enumerate(sorted(query, key=sorted))
        for g in sorted(grams)
    ]
    rows = ", ".join(map(str, wanted))
    asked = index.sparkSession.sql(f"SELECT * FROM VALUES {rows} AS t(gram, rule, conjunction, needed)")
    met = (
        index.join(F.broadcast(asked), "gram")
        .groupBy("key", "rule", "conjunction", "needed")
        .agg(F.count_distinct("gram").alias("found"))
        .where("found = needed")
    )
    return met.groupBy("key").agg(F.expr("bit_or(shiftleft(1L, rule))").alias("rules"))


def scan_secrets(
    docs: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text", spans_col: str = "spans"
) -> DataFrame:
    """The columns of ``docs`` and the spans as ``SPAN_TYPE``, by start, then in the order of the rules, whose places in
    ``rules`` are the kinds."""
    text = f"coalesce({ident(text_col)}, '')"
    kept = [docs[c] for c in docs.columns if c != spans_col]
    queries = [trigram_query(r.regex) for r in rules]
    trigrams = sorted({g for q in queries if q is not None for conjunction in q for g in conjunction})
    if not trigrams:
        return docs.select(*kept, F.expr(_spans(text, rules, queries)).alias(spans_col))
    index = trigram_index(narrowed(docs, id_col, text_col), trigrams)
    found = materialise(candidates(index, trigrams, queries), "trigram-candidates").withColumnRenamed("key", "__key")
    if found.count() * CANDIDATE_BYTES <= BROADCAST_BYTES:
        found = F.broadcast(found)
    key = F.xxhash64(docs[id_col].cast("long"), whole_text(docs, text_col))
    joined = docs.select(*kept, key.alias("__key")).join(found.withColumnRenamed("rules", "__rules"), "__key", "left")
    return joined.select(
        *[joined[c] for c in docs.columns if c != spans_col], F.expr(_spans(text, rules, queries)).alias(spans_col)
    )


def _spans(text: str, rules: Sequence[Rule], queries: Sequence[Query]) -> str:
    each = [
        spans_of(
            text,
            r.regex,
            i,
            "true" if q is None else f"coalesce(__rules & {1 << i}L, 0) <> 0",
            r.value,
            f"length(s.value) >= {r.at_least}" if r.at_least else "true",
        )
        for i, (r, q) in enumerate(zip(rules, queries, strict=True))
    ]
    return in_order(each)


def redacted(text: str, spans: str, mark: str = "[SECRET]") -> str:
    """``text`` with every span replaced, overlapping spans by one mark."""
    # A span replaces the text from where the spans before it have reached.
    step = (
        f"(acc, s) -> if(s.end <= acc.reached, acc, struct(concat(acc.out, if(s.start >= acc.reached, "
        f"concat(substr({text}, acc.reached + 1, s.start - acc.reached), {lit(mark)}), '')) AS out, s.end AS reached))"
    )
    whole = f"acc -> concat(acc.out, substr({text}, acc.reached + 1))"
    made = f"aggregate({spans}, struct('' AS out, 0 AS reached), {step}, {whole})"
    return f"if(size({spans}) = 0, {text}, {made})"
