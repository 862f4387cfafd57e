"""Pattern scans as native column expressions: count, name and redact matches in sequence."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Prompt-injection families and their patterns (case-insensitive), in scan order.
INJECTION_PATTERNS: list[tuple[str, str]] = [
    ("ignore_instructions", r"ignore\s+(previous|above|prior|all)\s+instructions?"),
    ("you_are_now", r"\byou\s+are\s+now\s+(a|an)\b"),
    ("act_as", r"\b(act|behave|pretend|roleplay)\s+as\s+(if\s+you\s+(are|were)|a|an)\b"),
    ("reveal_prompt",
     r"\b(reveal|show|print|display|output)\s+(your\s+)?(system\s+prompt|instructions|prompt|context)"),
    ("override",
     r"\b(forget|disregard|ignore|override)\s+(everything|all|your\s+(previous|prior|above))"),
    ("jailbreak_delimiters", r"(\[INST\]|\[\/INST\]|<\|im_start\|>|<\|im_end\|>|<\|endoftext\|>)"),
    ("jailbreak_keywords", r"\b(jailbreak|DAN\s+mode|developer\s+mode|prompt\s+injection)\b"),
]

# Upper-case words of which a text must hold one to match the family at all.
INJECTION_WORDS: dict[str, tuple[str, ...]] = {
    "ignore_instructions": ("IGNORE",),
    "you_are_now": ("NOW",),
    "act_as": ("ACT", "BEHAVE", "PRETEND", "ROLEPLAY"),
    "reveal_prompt": ("PROMPT", "INSTRUCTIONS", "CONTEXT"),
    "override": ("FORGET", "DISREGARD", "IGNORE", "OVERRIDE"),
    "jailbreak_delimiters": ("INST]", "<|"),
    "jailbreak_keywords": ("JAILBREAK", "MODE", "INJECTION"),
}

# Personal-data patterns.
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
IPV4 = (r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}"
        r"(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b")
CARD = r"\b[0-9]{13,16}\b"
PHONE_INTERNATIONAL = r"\+[1-9][0-9]{7,14}\b"
PHONE_US = r"(?<![0-9])\(?[0-9]{3}\)?[-.\s][0-9]{3}[-.\s][0-9]{4}(?![0-9])"
USER_ID = (r"(?:user_id|userId|customer_id)=[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}"
           r"-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}")

# \b and \s follow Unicode, as log text is multilingual; digits stay ASCII.
UNICODE = "(?U)"
UNICODE_IGNORE_CASE = "(?iU)"


@dataclass(frozen=True)
class Rule:
    """One redaction step.

    ``hint(text, upper)``: a cheap test that every text with a match passes.
    ``keep``: on a single match, spares those that only look sensitive.
    """

    name: str
    pattern: str
    token: str
    hint: Callable[[Column, Column], Column]
    keep: Callable[[Column], Column] | None = None


def is_private_ip(ip: Column) -> Column:
    """Loopback and RFC 1918 ranges; link-local and everything else counts as public."""
    octets = F.transform(F.split(ip, r"\."), lambda o: o.cast("int"))
    a, b = F.get(octets, F.lit(0)), F.get(octets, F.lit(1))
    return (a.isin(127, 10) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)))


def luhn_valid(digits: Column) -> Column:
    """Luhn checksum over a digit string."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda d: F.try_to_number(d, F.lit("9")).cast("int"))

    def term(d: Column, i: Column) -> Column:
        doubled = d * 2
        return F.when(i % 2 == 0, d).when(doubled > 9, doubled - 9).otherwise(doubled)

    total = F.aggregate(F.transform(values, term), F.lit(0), lambda acc, x: acc + x)
    return total % 10 == 0


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def _words(words: tuple[str, ...]) -> Callable[[Column, Column], Column]:
    # Two letters fold to ASCII ones in a case-insensitive match but not in upper case.
    return lambda text, upper: _any([F.contains(upper, F.lit(w)) for w in (*words, "\u212a", "\u0130")])


def _has(part: str) -> Callable[[Column, Column], Column]:
    return lambda text, upper: F.contains(text, F.lit(part))


def _like(pattern: str) -> Callable[[Column, Column], Column]:
    return lambda text, upper: text.rlike(pattern)


def injection_rules() -> list[Rule]:
    return [Rule(name, UNICODE_IGNORE_CASE + pattern, f"[INJECTION_REDACTED_{name}]", _words(INJECTION_WORDS[name]))
            for name, pattern in INJECTION_PATTERNS]


def pii_rules(kinds: tuple[str, ...] | None = None) -> list[Rule]:
    rules = [
        Rule("email", UNICODE + EMAIL, "[REDACTED_EMAIL]", _has("@")),
        Rule("ipv4", UNICODE + IPV4, "[REDACTED_IP]", _like(r"[0-9]\.[0-9]"), keep=is_private_ip),
        Rule("credit_card", UNICODE + CARD, "[REDACTED_CC]", _like("[0-9]{13}"), keep=lambda m: ~luhn_valid(m)),
        Rule("phone_international", UNICODE + PHONE_INTERNATIONAL, "[REDACTED_PHONE]", _has("+")),
        Rule("phone_us", UNICODE + PHONE_US, "[REDACTED_PHONE]", _like(r"(?s)[0-9]{3}\)?.[0-9]{3}.[0-9]{4}")),
        Rule("user_id_context", UNICODE_IGNORE_CASE + USER_ID, "[REDACTED_USER_ID]", _has("=")),
    ]
    return [r for r in rules if kinds is None or r.name in kinds]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, computing ``value`` once however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _step(rule: Rule) -> Callable[[Column], Column]:
    """State (text, counts) after one rule."""
    token = F.lit(rule.token)

    def state(s: Column, text: Column, n: Column) -> Column:
        return F.struct(text.alias("text"), F.concat(s["counts"], F.array(n)).alias("counts"))

    def plain(s: Column) -> Column:
        return state(s, F.regexp_replace(s["text"], rule.pattern, rule.token),
                     F.regexp_count(s["text"], F.lit(rule.pattern)))

    def conditional(s: Column) -> Column:
        found = F.transform(F.regexp_extract_all(s["text"], F.lit(rule.pattern), F.lit(0)),
                            lambda m: F.when(rule.keep(m), m).otherwise(token))

        def rebuilt(marks: Column) -> Column:
            # Text between matches, each piece followed by its match or the token.
            pieces = F.zip_with(F.split(s["text"], rule.pattern, -1), marks,
                                lambda t, m: F.concat(t, F.coalesce(m, F.lit(""))))
            return state(s, F.array_join(pieces, ""), F.size(F.filter(marks, lambda m: m == token)))

        return _let(found, rebuilt)

    return plain if rule.keep is None else conditional


def redact(df: DataFrame, text_col: str, rules: list[Rule], *, out_text: str, out_names: str,
           out_count: str) -> DataFrame:
    """Apply ``rules`` in order, each on the previous rule's output.

    Rows that no pattern touches (nearly all) pay for cheap tests and no rewriting; if nothing
    matches the raw text, no step can change it. The steps are nested lets, so the expression grows
    linearly with the rules.
    """
    none = F.array_repeat(F.lit(0), len(rules))

    def decide(text: Column, upper: Column) -> Column:
        hit = _any([r.hint(text, upper) & text.rlike(r.pattern) for r in rules])
        chain = F.struct(text.alias("text"), F.array().cast("array<int>").alias("counts"))
        for rule in rules:
            chain = _let(chain, _step(rule))
        return F.when(hit, chain).otherwise(F.struct(text.alias("text"), none.alias("counts")))

    folded = any(r.name in INJECTION_WORDS for r in rules)
    result = _let(F.col(text_col), lambda text: _let(F.upper(text), lambda up: decide(text, up)) if folded
                  else decide(text, text))
    # The counts are an argument, not part of the lambda: inside, Spark could re-run the scan per name.
    names = F.array_compact(F.zip_with(F.array(*[F.lit(r.name) for r in rules]), F.col("_redacted.counts"),
                                       lambda name, n: F.when(n > 0, name)))
    total = F.aggregate("_redacted.counts", F.lit(0), lambda acc, n: acc + n)
    return (df.withColumn("_redacted", result)
            .withColumns({out_text: F.col("_redacted.text"), out_names: names, out_count: total})
            .drop("_redacted"))
