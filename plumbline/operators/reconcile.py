"""Dedupe, baselines, branch comparison and new-only identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

GROUP = ("file", "rule_id", "message")
# fixed values: which of several naming rules reports an identifier
NAMING_PRIORITY = (
    "naming.class-file-mismatch", "naming.confusing-name", "naming.negative-boolean", "naming.boolean-prefix", "naming.identifier-quality",
    "naming.hungarian-notation", "naming.suffix-hungarian", "naming.short-variable", "naming.abbreviation-allowlist",
)
EXACT = ("rule_id", "file", "line", "end_line", "column", "symbol", "message", "m_complexity", "m_lines", "preview")


def _zero(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(0))


def exact_dedupe(findings: DataFrame) -> DataFrame:
    """One row of those that agree in all but severity; the first produced wins."""
    rest = [c for c in findings.columns if c not in EXACT]
    first = findings.groupBy(*EXACT).agg(F.min_by(F.struct(*rest), "ord").alias("f"))
    return first.select(*[F.col(c) if c in EXACT else F.col(f"f.{c}") for c in findings.columns])


def naming_dedupe(findings: DataFrame) -> DataFrame:
    """Of naming findings on one identifier at one place, the rule of highest priority stays."""
    priority = F.array_position(F.array(*map(F.lit, NAMING_PRIORITY)), F.col("rule_id"))
    named = (priority > 0) & F.col("symbol").isNotNull()
    keys = {"_f": F.col("file"), "_l": _zero("line"), "_c": _zero("column"), "_s": F.lower("symbol")}
    best = findings.where(named).groupBy(*[v.alias(k) for k, v in keys.items()]).agg(F.min_by("ord", F.struct(priority, "ord")).alias("_best"))
    same = named & (keys["_f"] == F.col("_f")) & (keys["_l"] == F.col("_l")) & (keys["_c"] == F.col("_c")) & (keys["_s"] == F.col("_s"))
    out = findings.join(best, same, "left").where(F.col("_best").isNull() | (F.col("_best") == F.col("ord")))
    return out.select(*findings.columns)


def in_order(findings: DataFrame) -> DataFrame:
    """The order of reports."""
    return findings.orderBy("file", _zero("line"), "rule_id", "message", "ord")


def baseline_groups(findings: DataFrame) -> DataFrame:
    """Accepted findings: file, rule_id, message, accepted."""
    return findings.groupBy(*GROUP).agg(F.count("*").alias("accepted"))


def apply_baseline(findings: DataFrame, accepted: DataFrame) -> DataFrame:
    """findings with ``is_new``: of each group the first accepted ones by line and column are known."""
    w = Window.partitionBy(*GROUP).orderBy(_zero("line"), _zero("column"), "ord")
    ranked = findings.withColumn("_rank", F.row_number().over(w))
    known = accepted.select(*[F.col(c).alias(f"_{c}") for c in GROUP], "accepted")
    same = [F.col(c) == F.col(f"_{c}") for c in GROUP]
    return ranked.join(known, same, "left").select(*findings.columns, (F.col("_rank") > F.coalesce("accepted", F.lit(0))).alias("is_new"))


def baseline_absent(findings: DataFrame, accepted: DataFrame, partial: bool = False) -> DataFrame:
    """Accepted findings that are gone: file, rule_id, message, resolved; none for a partial scan."""
    live = findings.groupBy(*[F.col(c).alias(f"_{c}") for c in GROUP]).agg(F.count("*").alias("live"))
    gone = accepted.join(live, [F.col(c) == F.col(f"_{c}") for c in GROUP], "left").withColumn("resolved", F.col("accepted") - F.coalesce("live", F.lit(0)))
    return gone.where((F.col("resolved") > 0) & F.lit(not partial)).select(*GROUP, "resolved")


def review(current: DataFrame, base: DataFrame) -> DataFrame:
    """Counted comparison of two branches: file, rule_id, symbol, message, n_current, n_base, introduced, removed, unchanged."""
    keys = [F.col("file"), F.col("rule_id"), F.coalesce("symbol", F.lit("")).alias("symbol"), F.col("message")]
    tagged = current.select(*keys, F.lit(1).alias("c"), F.lit(0).alias("b")).unionByName(base.select(*keys, F.lit(0).alias("c"), F.lit(1).alias("b")))
    counts = tagged.groupBy("file", "rule_id", "symbol", "message").agg(F.sum("c").alias("n_current"), F.sum("b").alias("n_base"))
    return counts.select("*", F.greatest(F.lit(0), F.col("n_current") - F.col("n_base")).alias("introduced"), F.greatest(F.lit(0), F.col("n_base") - F.col("n_current")).alias("removed"), F.least("n_current", "n_base").alias("unchanged"))


def review_rows(rows: DataFrame, other: DataFrame) -> DataFrame:
    """Rows beyond those that the other side pairs with, in order of production."""
    keys = ["file", "rule_id", "_symbol", "message"]
    rows_ = rows.withColumn("_symbol", F.coalesce("symbol", F.lit("")))
    ranked = rows_.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy("ord")))
    there = other.withColumn("_symbol", F.coalesce("symbol", F.lit(""))).groupBy(*[F.col(k).alias(f"o{k}") for k in keys]).agg(F.count("*").alias("_n"))
    out = ranked.join(there, [F.col(k) == F.col(f"o{k}") for k in keys], "left").where(F.col("_rank") > F.coalesce("_n", F.lit(0)))
    return out.select(*rows.columns)


def rule_delta(compared: DataFrame) -> DataFrame:
    """Net change per rule; rules without a change are left out."""
    return compared.groupBy("rule_id").agg(F.sum("introduced").alias("introduced"), F.sum("removed").alias("removed")).withColumn("net", F.col("introduced") - F.col("removed")).where("net <> 0")


def scope_class() -> Column:
    """Whether a finding is about a project, a file, a symbol or a line."""
    whole_file = F.col("rule_id").isin("size.file-length", "docs.todo-density", "docs.missing-file-phpdoc")
    return F.when(whole_file, "file").when(F.col("line").isNull(), "project").when(F.col("symbol").isNotNull(), "symbol").otherwise("line")


def hook_identity(findings: DataFrame) -> DataFrame:
    """findings with scope, identity (free of numbers and lines) and ordinal among equal identities."""
    plain = F.regexp_replace("message", r"\d+(?:\.\d+)?", "{n}")
    base = F.sha2(F.concat_ws("\x1f", scope_class(), "rule_id", "file", F.coalesce("symbol", F.lit("")), plain), 256)
    most = F.lit((1 << 31) - 1)
    w = Window.partitionBy("_base").orderBy(F.coalesce("line", most), F.coalesce("column", most), "ord")
    out = findings.withColumn("scope", scope_class()).withColumn("_base", F.substring(base, 1, 16)).withColumn("ordinal", F.row_number().over(w) - 1)
    return out.withColumn("identity", F.concat("_base", F.lit(":"), F.col("ordinal").cast("string"))).drop("_base")


def new_only(current: DataFrame, base: DataFrame) -> DataFrame:
    """Findings whose identity the base does not have."""
    return hook_identity(current).join(hook_identity(base).select("identity").distinct(), "identity", "left_anti")
