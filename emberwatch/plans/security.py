"""Registered queries of group B, with their oracles.

The oracle side uses RE2: look-arounds and Unicode word borders are spelled out with captured
neighbours, and card numbers are checked digit by digit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch.functions.redaction import EMAIL, INJECTION_PATTERNS, IPV4, PHONE_INTERNATIONAL, USER_ID
from emberwatch.functions.text import iso
from emberwatch.operators import security as op
from emberwatch.operators.ingest import log_validate
from emberwatch.plans.fixtures import Tables, with_views
from emberwatch.plans.ingest import _PARSED, parsed


def _scan_out(df: DataFrame, prefix: str) -> DataFrame:
    return df.select("log_id", F.sha2(f"{prefix}_text", 256).alias("text_hash"),
                     F.array_join(f"{prefix}_names", ",").alias("names"), F.col(f"{prefix}_count").alias("n"))


def calls(t: Tables) -> DataFrame:
    return t.conversations.select(
        F.format_string("call-%d-%d", "conv_id", "turn").alias("call_id"),
        (F.col("conv_id") % 5).cast("string").alias("tenant_id"), F.lit("rca").alias("service"),
        F.col("text").alias("input_text"), F.concat("role", F.lit(": "), "text").alias("output_text"))


QUERIES = {
    "injection_scan": lambda t: _scan_out(op.injection_scan(t.scan), "injection"),
    "pii_email": lambda t: _scan_out(op.pii_simple(t.scan, "message", ("email",)), "pii"),
    "pii_phone": lambda t: _scan_out(op.pii_simple(t.scan, "message", ("phone_international", "phone_us")), "pii"),
    "pii_user_id": lambda t: _scan_out(op.pii_simple(t.scan, "message", ("user_id_context",)), "pii"),
    "pii_public_ip": lambda t: _scan_out(op.pii_public_ip(t.scan), "pii"),
    "pii_credit_card": lambda t: _scan_out(op.pii_credit_card(t.scan), "pii"),
    "pii_scan": lambda t: _scan_out(op.pii_scan(t.scan), "pii"),
    "security_clean": lambda t: op.security_clean(t.scan).select(
        "log_id", F.sha2("message", 256).alias("text_hash"), "injection_attempted",
        F.array_join("pii_fields_redacted", ",").alias("pii_fields_redacted")),
    "security_events": lambda t: op.security_events(op.security_scan(t.scan)).select(
        "event_id", "service", F.coalesce("tenant_id", F.lit("-")).alias("tenant_id"), "event_type", "details",
        "original_message_hash", iso(F.col("logged_at")).alias("logged_at")),
    "parse_error_events": lambda t: op.parse_errors(log_validate(parsed(t))[1]).select(
        "event_id", "tenant_id", "service", "event_type", "details", "original_message_hash", iso(F.col("logged_at")).alias("logged_at")),
    "audit_hash": lambda t: op.audit_hash(calls(t)),
    "pii_by_field": lambda t: op.pii_by_field(op.security_scan(t.scan)),
    "injection_by_service": lambda t: op.injection_by_service(op.injection_scan(t.scan)),
}


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _chain(source: str, rules: list[tuple[str, str, str]], tag: str) -> tuple[str, str]:
    """CTEs that apply (name, count expression, new text expression) steps; returns (ctes, last)."""
    ctes, prev = [], source
    for i, (name, count, text) in enumerate(rules):
        cur = f"{tag}{i}"
        ctes.append(f"{cur} AS (SELECT * EXCLUDE (txt), {count} AS n_{tag}_{name}, {text} AS txt FROM {prev})")
        prev = cur
    return ",\n".join(ctes), prev


def _sum(rules, tag):
    return " + ".join(f"n_{tag}_{r[0]}" for r in rules)


def _names(rules, tag):
    return ("array_to_string(list_filter([" + ", ".join(f"CASE WHEN n_{tag}_{r[0]} > 0 THEN '{r[0]}' END" for r in rules)
            + "], lambda x: x IS NOT NULL), ',')")


def _simple(name: str, pattern: str, token: str, flags: str = "") -> tuple[str, str, str]:
    p = _lit(flags + pattern)
    return name, f"len(regexp_extract_all(txt, {p}))", f"regexp_replace(txt, {p}, {_lit(token)}, 'g')"


def _pieces(name: str, pattern: str, token: str, keep: str) -> tuple[str, str, str]:
    """Replace only matches for which ``keep`` (an SQL test on x) is false."""
    p = _lit(pattern)
    found = f"regexp_extract_all(txt, {p})"
    count = f"len(list_filter({found}, lambda x: NOT ({keep})))"
    between = f"string_split_regex(txt, {p})"
    put = f"list_transform({found}, lambda x: CASE WHEN {keep} THEN x ELSE {_lit(token)} END)"
    text = (f"array_to_string(list_transform(list_zip({between}, {put}), "
            f"lambda z: coalesce(z[1], '') || coalesce(z[2], '')), '')")
    return name, count, text


_PRIVATE = ("CAST(split_part(x, '.', 1) AS INT) IN (127, 10) "
            "OR (CAST(split_part(x, '.', 1) AS INT) = 172 AND CAST(split_part(x, '.', 2) AS INT) BETWEEN 16 AND 31) "
            "OR (CAST(split_part(x, '.', 1) AS INT) = 192 AND CAST(split_part(x, '.', 2) AS INT) = 168)")
_DOUBLED = "[0, 2, 4, 6, 8, 1, 3, 5, 7, 9]"
_LUHN = (f"list_sum(list_transform(range(1, len(x) + 1), lambda i: CASE WHEN (len(x) - i) % 2 = 0 "
         f"THEN CAST(substr(x, i, 1) AS INT) ELSE {_DOUBLED}[CAST(substr(x, i, 1) AS INT) + 1] END)) % 10 = 0")
_US = r"(^|[^0-9])\(?[0-9]{3}\)?[-.\s][0-9]{3}[-.\s][0-9]{4}($|[^0-9])"
_RULES = {
    "email": _simple("email", EMAIL, "[REDACTED_EMAIL]"),
    "ipv4": _pieces("ipv4", IPV4, "[REDACTED_IP]", _PRIVATE),
    "credit_card": _pieces("credit_card", r"\b[0-9]{13,16}\b", "[REDACTED_CC]", f"NOT ({_LUHN})"),
    "phone_international": _simple("phone_international", PHONE_INTERNATIONAL, "[REDACTED_PHONE]"),
    "phone_us": ("phone_us", f"len(regexp_extract_all(txt, {_lit(_US)}))",
                 f"regexp_replace(txt, {_lit(_US)}, '\\1[REDACTED_PHONE]\\2', 'g')"),
    "user_id_context": _simple("user_id_context", USER_ID, "[REDACTED_USER_ID]", "(?i)"),
}
_PII = list(_RULES.values())
_INJ = [_simple(n, p, f"[INJECTION_REDACTED_{n}]", "(?i)") for n, p in INJECTION_PATTERNS]
_SRC = "src AS (SELECT *, message AS txt FROM scan_v)"


def _scan_sql(rules, tag="p"):
    ctes, last = _chain("src", rules, tag)
    return (f"WITH {_SRC}, {ctes} SELECT log_id, sha256(txt) AS text_hash, {_names(rules, tag)} AS names, "
            f"{_sum(rules, tag)} AS n FROM {last}")


_ctes_i, _last_i = _chain("src", _INJ, "i")
_ctes_p, _last_p = _chain(_last_i, _PII, "p")
_FULL = f"WITH {_SRC}, {_ctes_i}, {_ctes_p}"
#: The log table with redacted messages, as ``clean``.
CLEAN = (f"src AS (SELECT *, message AS txt FROM logs_v), {_ctes_i}, {_ctes_p}, "
         f"clean AS (SELECT * EXCLUDE (message, txt), txt AS message FROM {_last_p})")
_JSON_LIST = "'[' || CASE WHEN {0} = '' THEN '' ELSE '\"' || replace({0}, ',', '\",\"') || '\"' END || ']'"

ORACLES = {
    "injection_scan": _scan_sql(_INJ, "i"),
    "pii_email": _scan_sql([_RULES["email"]]),
    "pii_phone": _scan_sql([_RULES["phone_international"], _RULES["phone_us"]]),
    "pii_user_id": _scan_sql([_RULES["user_id_context"]]),
    "pii_public_ip": _scan_sql([_RULES["ipv4"]]),
    "pii_credit_card": _scan_sql([_RULES["credit_card"]]),
    "pii_scan": _scan_sql(_PII),
    "security_clean": f"""{_FULL} SELECT log_id, sha256(txt) AS text_hash, ({_sum(_INJ, 'i')}) > 0 AS injection_attempted,
        {_names(_PII, 'p')} AS pii_fields_redacted FROM {_last_p}""",
    "security_events": f"""{_FULL}, ev AS (
        SELECT log_id, service, coalesce(tenant_id, '-') AS tenant_id, message, ts, 'injection' AS event_type,
               {_names(_INJ, 'i')} AS names, {_sum(_INJ, 'i')} AS n FROM {_last_p}
        UNION ALL SELECT log_id, service, coalesce(tenant_id, '-'), message, ts, 'pii', {_names(_PII, 'p')}, {_sum(_PII, 'p')}
        FROM {_last_p})
      SELECT 'sec-' || substr(sha256(log_id || '|' || event_type), 1, 32) AS event_id, service, tenant_id, event_type,
             CASE event_type WHEN 'injection'
               THEN '{{"matched_patterns":' || {_JSON_LIST.format('names')} || ',"match_count":' || n || '}}'
               ELSE '{{"fields_redacted":' || {_JSON_LIST.format('names')} || ',"redaction_count":' || n || '}}' END AS details,
             sha256(message) AS original_message_hash, ISO(ts) AS logged_at
      FROM ev WHERE n > 0""",
    "parse_error_events": f"""WITH {_PARSED} SELECT 'sec-' || substr(sha256(raw_id || '|parse_error'), 1, 32) AS event_id,
        'unknown' AS tenant_id, 'security-scan' AS service, 'parse_error' AS event_type,
        '{{"error":"' || reason || '"}}' AS details, sha256(value) AS original_message_hash, ISO(received_at) AS logged_at
      FROM checked WHERE reason IS NOT NULL""",
    "audit_hash": """SELECT 'call-' || conv_id || '-' || turn AS call_id, CAST(conv_id % 5 AS VARCHAR) AS tenant_id,
        'rca' AS service, sha256(text) AS input_hash, sha256(role || ': ' || text) AS output_hash FROM conversations""",
    "pii_by_field": f"""{_FULL}, per_message AS (
        SELECT coalesce(tenant_id, 'unknown') AS tenant_id, unnest(string_split({_names(_PII, 'p')}, ',')) AS field_type
        FROM {_last_p} WHERE {_sum(_PII, 'p')} > 0)
      SELECT tenant_id, field_type, count(*) AS messages FROM per_message GROUP BY ALL""",
    "injection_by_service": f"""WITH {_SRC}, {_ctes_i} SELECT service, coalesce(tenant_id, 'unknown') AS tenant_id,
        count(*) AS attempts FROM {_last_i} WHERE {_sum(_INJ, 'i')} > 0 GROUP BY ALL""",
}
ORACLES = {name: with_views(sql) for name, sql in ORACLES.items()}
