"""Report lines as columns, and writers that leave the formatting to Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import fingerprint, stable_identity
from plumbline.sources.files import BASELINE_VERSION


def _escaped(text: Column, characters: str) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return text


def github_lines(findings: DataFrame) -> DataFrame:
    """file, ord and one annotation line per finding."""
    level = F.when(F.col("severity") == "error", "error").when(F.col("severity") == "warning", "warning").otherwise("notice")
    place = F.concat(F.lit(" file="), _escaped(F.col("file"), "%\r\n:,"), F.coalesce(F.concat(F.lit(",line="), F.col("line").cast("string")), F.lit("")))
    return findings.select("ord", F.concat(F.lit("::"), level, place, F.lit(",title="), F.col("rule_id"), F.lit("::"), _escaped(F.col("message"), "%\r\n")).alias("text"))


def sarif_results(findings: DataFrame) -> DataFrame:
    """ord and one SARIF result object per finding, as JSON."""
    level = F.when(F.col("severity") == "advisory", "note").otherwise(F.col("severity"))
    region = F.struct(F.col("line").alias("startLine"), F.col("end_line").alias("endLine"), F.col("column").alias("startColumn"))
    location = F.array(F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), F.when(F.col("line").isNotNull(), region).alias("region")).alias("physicalLocation")))
    result = F.struct(F.col("rule_id").alias("ruleId"), level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"), location.alias("locations"), F.struct(fingerprint().alias("fingerprint"), stable_identity().alias("stableIdentity")).alias("partialFingerprints"))
    return findings.select("ord", F.to_json(result).alias("result"))


def markdown_rows(findings: DataFrame) -> DataFrame:
    """ord and a table row per finding."""
    cell = lambda c: F.replace(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    return findings.select("ord", F.concat(F.lit("| "), F.concat_ws(" | ", cell(F.col("severity")), cell(F.col("file")), cell(F.col("line")), cell(F.col("rule_id")), cell(F.col("message"))), F.lit(" |")).alias("text"))


def text_lines(findings: DataFrame) -> DataFrame:
    """ord and a terminal line per finding."""
    return findings.select("ord", F.concat(F.col("file"), F.lit(":"), F.coalesce(F.col("line").cast("string"), F.lit("-")), F.lit("  "), F.rpad("severity", 8, " "), F.lit("  "), F.col("rule_id"), F.lit("  "), F.col("message")).alias("text"))


def html_rows(findings: DataFrame) -> DataFrame:
    """ord and a table row per finding, escaped."""
    def cell(c: Column) -> Column:
        out = F.coalesce(c.cast("string"), F.lit(""))
        for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            out = F.replace(out, F.lit(plain), F.lit(escaped))
        return F.concat(F.lit("<td>"), out, F.lit("</td>"))

    return findings.select("ord", F.concat(F.lit("<tr>"), *[cell(F.col(c)) for c in ("severity", "file", "line", "rule_id", "message")], F.lit("</tr>")).alias("text"))


def write_lines(lines: DataFrame, path: str) -> None:
    """Text files in the order of production, by range partitions."""
    lines.repartitionByRange("ord").sortWithinPartitions("ord").select("text").write.text(path)


def write_json(findings: DataFrame, path: str) -> None:
    findings.write.json(path)


def write_baseline(groups: DataFrame, path: str) -> None:
    """Accepted groups (file, rule_id, message, accepted) as JSON lines, sorted; each line is a baseline of one group."""
    group = F.struct("file", F.col("rule_id").alias("ruleId"), "message", F.col("accepted").alias("count"))
    groups.orderBy("file", "rule_id", "message").select(F.lit(BASELINE_VERSION).alias("schemaVersion"), F.array(group).alias("groups")).write.json(path)


def append_history(entries: DataFrame, path: str) -> None:
    """Add entries (timestamp, score, grade, scope, findings) to a history folder."""
    entries.select("timestamp", "score", "grade", "scope", "findings").write.mode("append").json(path)
