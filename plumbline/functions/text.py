"""Text functions: entropy, identifier tokens, line numbers, redaction, identities, path patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words and numbers of a part of an identifier.
HUMPS = r"[A-Z]+(?=[A-Z][a-z]|\d|$)|[A-Z]?[a-z]+|\d+"


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    n = F.length(text)
    repeated = F.regexp_extract_all(F.array_join(F.sort_array(F.split(text, "")), ""), F.lit(r"(?s)(.)\1+"), F.lit(0))
    start, share = F.struct(F.lit(0.0).alias("bits"), F.lit(0).alias("n")), lambda c: F.length(c) / n
    add = lambda a, c: F.struct((a["bits"] - share(c) * F.log2(share(c))).alias("bits"), (a["n"] + F.length(c)).alias("n"))
    # characters that occur once all have the same share
    return F.when(n > 0, F.aggregate(repeated, start, add, lambda a: a["bits"] + (n - a["n"]) * (F.log2(n) / n))).otherwise(0.0)


def identifier_tokens(name: Column) -> Column:
    """Lower-case parts of an identifier: split at underscores, humps and numbers."""
    parts = F.filter(F.split(F.trim(F.regexp_replace(name, "^[_ ]+|[_ ]+$", "")), "_+"), lambda p: p != "")
    humps = lambda p: F.regexp_extract_all(p, F.lit(HUMPS), F.lit(0))
    return F.flatten(F.transform(parts, lambda p: F.transform(F.when(F.size(humps(p)) > 0, humps(p)).otherwise(F.array(p)), F.lower)))


def line_of(source: Column, offset: Column) -> Column:
    """One-based line of a zero-based character offset."""
    before = F.substring(source, F.lit(1), offset)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def redacted(secret: Column) -> Column:
    return F.concat(F.lit("<redacted:"), F.octet_length(secret).cast("string"), F.lit(" chars>"))


def json_string(text: Column) -> Column:
    """A JSON string in ASCII with escaped slashes; null prints as null."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for plain, escaped in (('"', '\\"'), ("/", "\\/"), ("\b", "\\b"), ("\f", "\\f"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(plain), F.lit(escaped))
    units = F.encode(out, "UTF-16BE")
    wide = F.regexp_replace(F.lower(F.hex(units)), "(.{4})", r"\\u$1")
    ascii_ = F.regexp_replace(wide, r"\\u00([2-7][0-9a-f])", "<$1>")
    plain_text = F.when(~out.rlike(r"[^\x20-\x7E]"), out).otherwise(F.decode(F.unhex(F.lit("")), "UTF-8"))
    mixed = F.array_join(F.transform(F.regexp_extract_all(ascii_, F.lit(r"<..>|\\u[0-9a-f]{4}"), F.lit(0)), lambda x: F.when(x.startswith("<"), F.decode(F.unhex(F.substring(x, 2, 2)), "UTF-8")).otherwise(x)), "")
    body = F.when(~out.rlike(r"[^\x20-\x7E]"), plain_text).otherwise(mixed)
    return F.coalesce(F.concat(F.lit('"'), body, F.lit('"')), F.lit("null"))


def _number(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("null"))


def _digest(pairs: list[tuple[str, Column]]) -> Column:
    fields = [F.concat(F.lit(f'"{name}":'), value) for name, value in pairs]
    return F.substring(F.sha2(F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}")), 256), 1, 16)


def fingerprint() -> Column:
    """Identity of a finding at its place."""
    text = [("ruleId", json_string(F.col("rule_id"))), ("file", json_string(F.col("file")))]
    place = [("line", _number(F.col("line"))), ("endLine", _number(F.col("end_line"))), ("column", _number(F.col("column")))]
    return _digest([*text, *place, ("symbol", json_string(F.col("symbol"))), ("message", json_string(F.col("message")))])


def stable_identity() -> Column:
    """Identity of a finding wherever it moves in its file; without a symbol the key is left out."""
    base = [("ruleId", json_string(F.col("rule_id"))), ("file", json_string(F.col("file")))]
    message = ("message", json_string(F.col("message")))
    return F.when(F.col("symbol").isNull(), _digest([*base, message])).otherwise(_digest([*base, ("symbol", json_string(F.col("symbol"))), message]))


def path_regex(pattern: str) -> str:
    """A glob pattern as an anchored regular expression (Java and RE2 syntax)."""
    pattern = pattern.replace("\\", "/").strip("/")
    out = "".join({"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(x) or re.sub(r"([.^$|()\[\]{}+\\#-])", r"\\\1", x) for x in re.findall(r"\*\*|\*|\?|[^*?]+", pattern))
    folder = re.sub(r"([.^$|()\[\]{}+\\*?#-])", r"\\\1", pattern.removesuffix("/**")) if pattern.endswith("/**") else None
    literal = re.sub(r"([.^$|()\[\]{}+\\*?#-])", r"\\\1", pattern)
    return "^(" + "|".join(filter(None, [out, f"{literal}(/.*)?", folder and f"{folder}(/.*)?"])) + ")$"


def matches_path(path: Column, patterns: list[str]) -> Column:
    """The first pattern that a path matches, or null."""
    path = F.regexp_replace(path, "^/+|/+$", "")
    out = F.lit(None).cast("string")
    for pattern in reversed(patterns):
        out = F.when(path.rlike(path_regex(pattern)), pattern).otherwise(out)
    return out
