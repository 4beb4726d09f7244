"""Pattern and policy catalogs: built-in rows, custom rows read from JSON, and their DataFrame form.

Catalogs are small data (tens of rows) that shape the expressions, so they live on the driver and are inlined
as literals; the tables they are applied to never are.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# What a policy has if its entry does not say.
DEFAULT_CATEGORY = "general"
DEFAULT_MESSAGE = "Policy violation detected"

SEVERITIES = ("critical", "high", "medium", "low")
ACTIONS = ("allow", "warn", "block", "redact")

_FLAGS = {True: "(?iUd)", False: "(?id)"}


@dataclass(frozen=True)
class Pattern:
    type: str
    name: str
    severity: str
    pattern: str
    description: str = ""
    extended: bool = False
    value_group: int = 0
    validator: str = ""
    # Lower-case literals of which every match has at least one, and whether it has a run of digits; texts
    # without them are spared the regex. Both may be left out.
    hints: tuple[str, ...] = ()
    digits: bool = False
    # Regex for the character every match begins with, if there are few. It is tried before the pattern, whose
    # word boundary costs more.
    first: str = ""

    def __post_init__(self) -> None:
        if self.severity not in SEVERITIES:
            raise ValueError(f"pattern {self.type!r}: unknown severity {self.severity!r}")
        if self.validator not in ("", "luhn"):
            raise ValueError(f"pattern {self.type!r}: unknown validator {self.validator!r}")

    def regex(self, unicode: bool = True) -> str:
        return java_regex((f"(?={self.first})" if self.first else "") + self.pattern, unicode)


@dataclass(frozen=True)
class Policy:
    name: str
    category: str = DEFAULT_CATEGORY
    action: str = "warn"
    severity: str = "medium"
    message: str = DEFAULT_MESSAGE
    keywords: tuple[str, ...] = ()
    regex_patterns: tuple[str, ...] = ()
    extended: bool = False
    # For each regex the lower-case literals of which every match has at least one; may be left out.
    regex_hints: tuple[tuple[str, ...], ...] = ()

    def __post_init__(self) -> None:
        if self.action not in ACTIONS:
            raise ValueError(f"policy {self.name!r}: unknown action {self.action!r}")
        if self.severity not in SEVERITIES:
            raise ValueError(f"policy {self.name!r}: unknown severity {self.severity!r}")


def java_regex(pattern: str, unicode: bool = True) -> str:
    """A case-insensitive Python regex in Java syntax, with ``.`` stopping at newlines only."""
    translated = pattern.replace("(?P<", "(?<").replace("\\Z", "\\z")
    translated = re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", translated)
    # Java does not take letters like the Kelvin sign for members of A-Z, but for members of a-z.
    # Java reads "[" and "&&" in a class as operators, and has no repetition without a lower bound.
    parts = re.split(r"(\\.|\[\^?\]?(?:\\.|[^\]\\])*\])", translated)
    for i, part in enumerate(parts):
        if part.startswith("["):
            inner = re.sub(r"(\\.)|\[", lambda m: m[1] or r"\[", part[1:-1]).replace("&&", r"&\&")
            # Java does not take letters like the Kelvin sign for members of A-Z, but for members of a-z.
            parts[i] = f"[{inner}]".replace("A-Z", "A-Za-z")
        elif not part.startswith("\\"):
            parts[i] = re.sub(r"\{,(\d+)\}", r"{0,\1}", part)
    return _FLAGS[unicode] + "".join(parts)


# ---------------------------------------------------------------------------------------------------------
# Patterns, names, severities, keywords and messages which decide the results.
# ---------------------------------------------------------------------------------------------------------

BUILTIN_PATTERNS: tuple[Pattern, ...] = (
    Pattern("ssn", "Social Security Number", "high", r"\b\d{3}-\d{2}-\d{4}\b", "US Social Security Number", hints=("-",), digits=True, first=r"\d"),
    Pattern("email", "Email Address", "medium", r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b", "Email addresses", hints=("@",)),
    Pattern("phone_us", "Phone Number (US)", "medium", r"\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b", "US phone numbers", digits=True, first=r"[+(\d]"),
    Pattern("credit_card", "Credit Card Number", "high", r"\b(?:\d{4}[-\s]?){3}\d{4}\b", "Credit card numbers", validator="luhn", digits=True, first=r"\d"),
    Pattern("ip_address", "IP Address", "low", r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b", "IPv4 addresses", digits=True, first=r"\d"),
    Pattern("aws_key", "AWS Access Key", "critical", r"\b(?:AKIA|ABIA|ACCA|ASIA)[A-Z0-9]{16}\b", "AWS access key IDs", first="a"),
    Pattern("api_key_generic", "API Key", "high", r"""\b(?:api[_-]?key|apikey|api[_-]?token)["\s:=]+["'`]?([a-zA-Z0-9_\-]{20,})["'`]?\b""", "Generic API keys", value_group=1, hints=("api",), first="a"),
    Pattern("github_token", "GitHub Token", "critical", r"\b(?:ghp|gho|ghu|ghs|ghr)_[a-zA-Z0-9]{36}\b", "GitHub personal access tokens", hints=("_",), first="g"),
    Pattern("slack_token", "Slack Token", "high", r"\bxox[baprs]-[a-zA-Z0-9-]+\b", "Slack API tokens", hints=("xox",), first="x"),
    Pattern("private_key", "Private Key", "critical", r"-----BEGIN (?:RSA |EC )?PRIVATE KEY-----", "Private cryptographic keys", hints=("-----",)),
    Pattern("passport", "Passport Number", "high", r"\b[A-Z]{1,2}\d{6,9}\b", "Passport numbers", extended=True, digits=True),
    Pattern("drivers_license", "Driver License", "medium", r"\b[A-Z]{1,2}\d{5,8}\b", "Driver license numbers", extended=True, digits=True),
    Pattern("iban", "IBAN", "high", r"\b[A-Z]{2}\d{2}[A-Z0-9]{4}\d{7}[A-Z0-9]{0,16}\b", "International Bank Account Number", extended=True, digits=True),
    Pattern("bitcoin_address", "Bitcoin Address", "medium", r"\b[13][a-km-zA-HJ-NP-Z1-9]{25,34}\b", "Bitcoin wallet addresses", extended=True, hints=("1", "3"), first="[13]"),
    Pattern("ethereum_address", "Ethereum Address", "medium", r"\b0x[a-fA-F0-9]{40}\b", "Ethereum wallet addresses", extended=True, hints=("0x",), first="0"),
)

BUILTIN_POLICIES: tuple[Policy, ...] = (
    Policy(
        "medical_advice", "medical", "block", "high",
        "Medical advice detected. Please consult a licensed healthcare professional.",
        ("medical advice", "diagnosis", "diagnose", "prescribe", "prescription", "treatment plan", "medication",
         "dosage", "symptoms indicate", "medical opinion", "health advice"),
        (r"\b(?:what|which) (?:medication|medicine|drug)s?\b",
         r"\b(?:should i|do i need to) (?:take|see a doctor)\b",
         r"\bdiagnos(?:is|e) (?:my|these) symptoms?\b"),
        regex_hints=(("medication", "medicine", "drug"), ("should i ", "do i need to "), ("diagnos",)),
    ),
    Policy(
        "legal_advice", "legal", "block", "high",
        "Legal advice detected. Please consult a qualified attorney.",
        ("legal advice", "legal counsel", "lawsuit", "sue", "legal action", "legal rights", "attorney", "lawyer",
         "legal opinion", "contract review"),
        (r"\b(?:can|should) i sue\b", r"\bis this (?:legal|illegal)\b", r"\bwhat are my legal (?:rights|options)\b"),
        regex_hints=((" i sue",), ("is this ",), ("what are my legal ",)),
    ),
    Policy(
        "financial_advice", "financial", "warn", "medium",
        "Financial advice detected. Please consult a licensed financial advisor.",
        ("investment advice", "stock tips", "financial planning", "buy this stock", "invest in", "trading strategy",
         "portfolio advice", "retirement planning", "tax advice"),
        (r"\b(?:should i|when to) (?:buy|sell) (?:stock|crypto)\b",
         r"\b(?:best|good) investment (?:strategy|opportunity)\b"),
        regex_hints=(("should i ", "when to "), (" investment ",)),
    ),
    Policy(
        "harmful_content", "safety", "block", "critical",
        "Content policy violation. This type of content is not allowed.",
        ("self harm", "suicide", "hurt myself", "end my life", "harmful", "dangerous activity"),
        (r"\bhow to (?:make|build|create) (?:bomb|weapon|explosive)\b",
         r"\b(?:ways to|how to) (?:harm|hurt|injure)\b"),
        regex_hints=(("how to ",), ("ways to ", "how to ")),
    ),
    Policy(
        "internal_data", "confidential", "warn", "medium",
        "Potentially confidential information detected.",
        ("confidential", "internal only", "do not share", "proprietary", "trade secret", "company confidential",
         "restricted"),
        (r"\b(?:internal|confidential) (?:document|information|data)\b",
         r"\bdo not (?:share|distribute|disclose)\b"),
        regex_hints=(("internal ", "confidential "), ("do not ",)),
    ),
    Policy(
        "competitive_intel", "business", "warn", "low",
        "Competitive intelligence query detected.",
        ("competitor analysis", "competitor pricing", "steal customers", "poach employees", "competitor secrets"),
        extended=True,
    ),
    Policy(
        "personal_info_request", "privacy", "warn", "medium",
        "Request for personal information detected.",
        ("home address", "personal phone", "family members", "social security", "date of birth",
         "mothers maiden name"),
        extended=True,
    ),
    Policy(
        "code_injection", "security", "block", "high",
        "Potential code injection detected.",
        (),
        (r"<script[^>]*>.*?</script>",
         r"(?:SELECT|INSERT|UPDATE|DELETE|DROP|CREATE|ALTER).*(?:FROM|INTO|TABLE)",
         r"(?:\$\{|\{\{)[^}]+(?:\}|\}\})"),
        extended=True,
        regex_hints=(("<script",), ("select", "insert", "update", "delete", "drop", "create", "alter"), ("${", "{{")),
    ),
)

# ---------------------------------------------------------------------------------------------------------
# End of fixed values.
# ---------------------------------------------------------------------------------------------------------


def active_patterns(extended: bool = False, custom: Iterable[Pattern] = ()) -> tuple[Pattern, ...]:
    """Built-in patterns with ``custom`` ones merged over them by type; a replaced one keeps its place."""
    chosen = {p.type: p for p in BUILTIN_PATTERNS if extended or not p.extended}
    chosen.update({p.type: p for p in custom})
    return tuple(chosen.values())


def active_policies(extended: bool = False, custom: Iterable[Policy] = ()) -> tuple[Policy, ...]:
    """Built-in policies with ``custom`` ones merged over them by name; a replaced one keeps its place."""
    chosen = {p.name: p for p in BUILTIN_POLICIES if extended or not p.extended}
    chosen.update({p.name: p for p in custom})
    return tuple(chosen.values())


PATTERN_CATALOG_SCHEMA = T.StructType(
    [
        T.StructField("ordinal", T.IntegerType(), False),
        T.StructField("type", T.StringType(), False),
        T.StructField("pattern", T.StringType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("severity", T.StringType(), False),
        T.StructField("description", T.StringType()),
        T.StructField("extended", T.BooleanType(), False),
        T.StructField("value_group", T.IntegerType(), False),
    ]
)

POLICY_CATALOG_SCHEMA = T.StructType(
    [
        T.StructField("ordinal", T.IntegerType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("category", T.StringType(), False),
        T.StructField("keywords", T.ArrayType(T.StringType(), False), False),
        T.StructField("regex_patterns", T.ArrayType(T.StringType(), False), False),
        T.StructField("action", T.StringType(), False),
        T.StructField("message", T.StringType(), False),
        T.StructField("severity", T.StringType(), False),
        T.StructField("extended", T.BooleanType(), False),
    ]
)


def pattern_catalog(spark: SparkSession, extended: bool = False, custom: Iterable[Pattern] = ()) -> DataFrame:
    """The active patterns, one row each."""
    rows = [dict(asdict(p), ordinal=i) for i, p in enumerate(active_patterns(extended, custom))]
    names = PATTERN_CATALOG_SCHEMA.fieldNames()
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], PATTERN_CATALOG_SCHEMA)


def policy_catalog(spark: SparkSession, extended: bool = False, custom: Iterable[Policy] = ()) -> DataFrame:
    """The active policies, one row each; the action is a string."""
    rows = [dict(asdict(p), ordinal=i) for i, p in enumerate(active_policies(extended, custom))]
    names = POLICY_CATALOG_SCHEMA.fieldNames()
    return spark.createDataFrame(
        [tuple(list(v) if isinstance(v, tuple) else v for v in (r[n] for n in names)) for r in rows],
        POLICY_CATALOG_SCHEMA,
    )


def load_patterns(spark: SparkSession, path: str) -> tuple[Pattern, ...]:
    """Custom patterns from a JSON object keyed by pattern type; absent fields take the defaults."""
    found = tuple(
        Pattern(
            type=key,
            name=given.pop("name", key),
            severity=given.pop("severity", "medium"),
            pattern=given.pop("pattern", ""),
            **given,
        )
        for key, given in _read_keyed(spark, path, PATTERN_FIELDS)
    )
    check_patterns(spark, found)
    return found


def load_policies(spark: SparkSession, path: str) -> tuple[Policy, ...]:
    """Custom policies from a JSON object keyed by policy name; absent fields take the defaults."""
    found = tuple(Policy(key, **given) for key, given in _read_keyed(spark, path, POLICY_FIELDS))
    check_policies(spark, found)
    return found


PATTERN_FIELDS = {
    "pattern": str, "name": str, "severity": str, "description": str, "value_group": int, "validator": str,
}
POLICY_FIELDS = {
    "category": str, "keywords": list, "regex_patterns": list, "action": str, "message": str, "severity": str,
}


def _read_keyed(spark: SparkSession, path: str, fields: dict[str, type]) -> list[tuple[str, dict]]:
    """Entries of a catalog file, which is one JSON object of named objects and has the size of a settings file.

    Anything else is an error: a catalog that is read as empty would let everything pass.
    """
    texts = [r[0] for r in spark.read.text(path, wholetext=True).collect()]
    if len(texts) != 1 or not texts[0].strip():
        raise ValueError(f"{path}: expected one file with a JSON object")
    try:
        content = json.loads(texts[0])
    except ValueError as error:
        raise ValueError(f"{path}: not valid JSON: {error}") from error
    if not isinstance(content, dict):
        raise ValueError(f"{path}: expected a JSON object keyed by name")
    return [(key, _checked_entry(path, key, entry, fields)) for key, entry in content.items()]


def _checked_entry(path: str, key: str, entry, fields: dict[str, type]) -> dict:
    if not isinstance(entry, dict):
        raise ValueError(f"{path}: {key!r} is not an object")
    if unknown := [f for f in entry if f not in fields]:
        raise ValueError(f"{path}: {key!r} has unknown fields {unknown}; entries stand at the top of the file")
    given = {}
    for name, value in entry.items():
        if value is None:
            continue
        right = isinstance(value, fields[name]) and not isinstance(value, bool)
        if not right or isinstance(value, list) and not all(isinstance(v, str) for v in value):
            raise ValueError(f"{path}: {name!r} of {key!r} has the wrong type")
        given[name] = tuple(value) if isinstance(value, list) else value
    return given


def check_patterns(spark: SparkSession, patterns: Iterable[Pattern]) -> None:
    """Raise for patterns that could never match or cannot be compiled, from a file or built in code."""
    for p in patterns:
        if not p.pattern:
            raise ValueError(f"pattern {p.type!r} has no regex")
        check_regex(spark, f"pattern {p.type!r}", p.pattern)


def check_policies(spark: SparkSession, policies: Iterable[Policy]) -> None:
    """Raise for policies without a rule and for regexes that cannot be compiled, from a file or built in code."""
    for p in policies:
        if not p.keywords and not p.regex_patterns:
            raise ValueError(f"policy {p.name!r} has neither keywords nor regexes")
        for regex in p.regex_patterns:
            check_regex(spark, f"policy {p.name!r}", regex)


def check_regex(spark: SparkSession, owner: str, pattern: str) -> None:
    """Reject a regex that Spark cannot compile, naming the catalog entry it belongs to."""
    try:
        spark._jvm.java.util.regex.Pattern.compile(java_regex(pattern))
    except Exception as error:
        raise ValueError(f"{owner}: invalid regex {pattern!r}") from error
