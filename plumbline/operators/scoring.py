"""Counts, penalties, scores and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.scores import SEVERITY_RANK, clamped, letter, penalty
from plumbline.schema import SEVERITIES, STATIC_PILLARS

# fixed values: rules whose findings at one place share the greatest penalty among them
CORRELATED = ("complexity.cognitive", "complexity.cyclomatic", "complexity.nesting-depth", "size.method-length", "size.parameter-count")
BUCKETS = (("1-5", 1, 5), ("6-10", 6, 10), ("11-15", 11, 15), ("16-20", 16, 20), ("21+", 21, None))
PILLAR_FACTOR, FILE_FACTOR = 4, 5


def _counts():
    return [F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES]


def severity_totals(findings: DataFrame) -> DataFrame:
    return findings.agg(F.count("*").alias("total"), *_counts())


def rule_counts(findings: DataFrame, top: int | None = None) -> DataFrame:
    """Findings per rule, most first; ``top`` rules of them."""
    out = findings.groupBy("rule_id", "pillar").agg(F.count("*").alias("total"), *_counts())
    return out if top is None else out.orderBy(F.desc("total"), "rule_id").limit(top)


def penalties(findings: DataFrame) -> DataFrame:
    """findings with their penalty; correlated findings at one place share the greatest.

    The cluster is aggregated and joined back, so that a place with very many
    findings is never sorted in one task.
    """
    base = findings.withColumn("base_penalty", penalty(F.col("severity"), F.col("confidence")))
    in_cluster = F.col("rule_id").isin(*CORRELATED)
    keys = {"_file": F.col("file"), "_symbol": F.coalesce("symbol", F.lit("")), "_line": F.coalesce("line", F.lit(0))}
    clusters = base.where(in_cluster).groupBy(*[v.alias(k) for k, v in keys.items()]).agg(F.max("base_penalty").alias("_most"), F.count("*").alias("_n")).where("_n > 1")
    shared = base.join(clusters, (F.col("file") == F.col("_file")) & (keys["_symbol"] == F.col("_symbol")) & (keys["_line"] == F.col("_line")) & in_cluster, "left")
    return shared.select(*base.columns, F.when(F.col("_n").isNotNull(), F.col("_most") / F.col("_n")).otherwise(F.col("base_penalty")).alias("penalty"))


def pillar_scores(findings: DataFrame) -> DataFrame:
    """Score of every static pillar and of each other pillar that has findings."""
    spark = findings.sparkSession
    sums = penalties(findings).groupBy("pillar").agg(F.count("*").alias("n"), F.sum("penalty").alias("points"))
    known = spark.createDataFrame([(p,) for p in STATIC_PILLARS], "known string")
    both = sums.join(known, F.col("pillar") == F.col("known"), "full_outer")
    score = clamped(100 - PILLAR_FACTOR * F.coalesce("points", F.lit(0.0)))
    return both.select(F.coalesce("pillar", "known").alias("pillar"), F.coalesce("n", F.lit(0)).alias("findings"), F.round(PILLAR_FACTOR * F.coalesce("points", F.lit(0.0)), 2).alias("penalty"), score.alias("score"), letter(score).alias("grade"))


def composite(pillars: DataFrame) -> DataFrame:
    """The mean of the pillars' scores; 100 without pillars."""
    mean = clamped(F.coalesce(F.avg("score"), F.lit(100.0)))
    return pillars.agg(mean.alias("score")).select("score", letter(F.col("score")).alias("grade"))


def file_scores(findings: DataFrame, mutation: DataFrame | None = None, top: int | None = 10) -> DataFrame:
    """Worst files first: score ascending, findings descending, path."""
    metric = lambda rules, column: F.max(F.when(F.col("rule_id").isin(*rules), F.col(column)))
    out = penalties(findings).groupBy("file").agg(
        F.count("*").alias("findings"), F.sum("penalty").alias("points"), *_counts(),
        metric(["complexity.cyclomatic"], "m_complexity").alias("max_cyclomatic"), metric(["complexity.cognitive"], "m_complexity").alias("max_cognitive"),
        metric(["size.file-length", "size.class-length", "size.method-length"], "m_lines").alias("max_lines"),
    )
    if mutation is not None:
        out = out.join(mutation.select(F.col("file").alias("_file"), "msi"), F.col("file") == F.col("_file"), "full_outer").withColumn("file", F.coalesce("file", "_file")).drop("_file")
    else:
        out = out.withColumn("msi", F.lit(None).cast("double"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("findings", *SEVERITIES)]
    score = clamped(100 - FILE_FACTOR * F.coalesce("points", F.lit(0.0)))
    out = out.select("file", *zero, score.alias("score"), letter(score).alias("grade"), "max_cyclomatic", "max_cognitive", "max_lines", "msi")
    return out if top is None else out.orderBy("score", F.desc("findings"), "file").limit(top)


def complexity_histogram(findings: DataFrame) -> DataFrame:
    """Cyclomatic findings by complexity; every bucket is present."""
    rows = findings.where("rule_id = 'complexity.cyclomatic'")
    tests = [(name, (F.col("m_complexity") >= low) & (F.lit(True) if high is None else F.col("m_complexity") <= high)) for name, low, high in BUCKETS]
    counts = rows.agg(F.array(*[F.struct(F.lit(name).alias("bucket"), F.count_if(test).alias("n")) for name, test in tests]).alias("b"))
    return counts.select(F.inline("b"))


def gate(findings: DataFrame, new: DataFrame | None, caps: dict[str, int], new_caps: dict[str, int] | None = None) -> DataFrame:
    """The first cap that is exceeded: scope, kind, found, cap; no row if none.

    New findings are judged first; in each scope error, warning, advisory, total.
    """
    order = ("error", "warning", "advisory", "total")
    scopes = [("new", new, new_caps or {})] * (new is not None) + [("all", findings, caps)]
    out = None
    for i, (scope, rows, limits) in enumerate(scopes):
        counts = severity_totals(rows)
        trips = counts.select(F.inline(F.array(*[F.struct(F.lit(i * 10 + j).alias("place"), F.lit(scope).alias("scope"), F.lit(kind).alias("kind"), F.col(kind).alias("found"), F.lit(limits[kind]).cast("long").alias("cap")) for j, kind in enumerate(order) if kind in limits])))
        out = trips if out is None else out.unionByName(trips)
    return out.where("found > cap").agg(F.min_by(F.struct("scope", "kind", "found", "cap"), "place").alias("t")).where("t is not null").select("t.*")


def display_filter(findings: DataFrame, min_severity: str = "advisory", pillars=(), without_pillars=(), rules=(), without_rules=()) -> DataFrame:
    """What a report shows; gates look at unfiltered findings."""
    shown = [s for s in SEVERITIES if SEVERITY_RANK[s] >= SEVERITY_RANK[min_severity]]
    out = findings.where(F.col("severity").isin(*shown))
    for column, included, excluded in (("pillar", pillars, without_pillars), ("rule_id", rules, without_rules)):
        if included:
            out = out.where(F.col(column).isin(*included))
        if excluded:
            out = out.where(~F.col(column).isin(*excluded))
    return out


def unscored(findings: DataFrame, rules_without_score: DataFrame) -> DataFrame:
    """Findings whose rule counts in scores."""
    return findings.join(rules_without_score.select("rule_id").distinct(), "rule_id", "left_anti")


def without_previews(findings: DataFrame, allowed: DataFrame) -> DataFrame:
    """Drop sensitive-data findings whose preview is allowed."""
    return findings.join(allowed.select(F.col("preview").alias("_allowed")).distinct(), (F.col("pillar") == "sensitive-data") & (F.col("preview") == F.col("_allowed")), "left_anti")


def new_findings(findings: DataFrame, new: DataFrame | None, fallback: str = "none") -> DataFrame:
    """What a gate takes as new: the rows named by ``new`` (ord); without a comparison none, or all if ``fallback`` is "all"."""
    if new is None:
        return findings if fallback == "all" else findings.limit(0)
    return findings.join(new.select(F.col("ord").alias("_ord")), F.col("ord") == F.col("_ord"), "left_semi")


def score_delta(current: DataFrame, base: DataFrame) -> DataFrame:
    """Composite and pillar scores of two sets of findings: pillar (null for the composite), base, current, delta."""
    def scores(findings: DataFrame, name: str) -> DataFrame:
        pillars = pillar_scores(findings)
        whole = composite(pillars).select(F.lit(None).cast("string").alias("pillar"), F.col("score").alias(name))
        return pillars.select("pillar", F.col("score").alias(name)).unionByName(whole)

    now, then = scores(current, "current"), scores(base, "base").withColumnRenamed("pillar", "_pillar")
    both = now.join(then, F.col("pillar").eqNullSafe(F.col("_pillar")), "full_outer")  # a row per pillar
    both = both.select(F.coalesce("pillar", "_pillar").alias("pillar"), F.coalesce("base", F.lit(100.0)).alias("base"), F.coalesce("current", F.lit(100.0)).alias("current"))
    return both.withColumn("delta", F.round(F.col("current") - F.col("base"), 2))


def in_scope(findings: DataFrame, project_rules: list[str], requested: DataFrame) -> DataFrame:
    """Findings of rules that look at a whole project, only where they lie in a requested file; all others."""
    wanted = requested.select(F.col("file").alias("_file")).distinct()
    whole = F.col("rule_id").isin(*project_rules)
    return findings.where(~whole).unionByName(findings.where(whole).join(wanted, F.col("file") == F.col("_file"), "left_semi"))


def top_first(findings: DataFrame, by: list[str], k: int) -> DataFrame:
    """The k findings of each group with the greatest base penalty, then first."""
    w = Window.partitionBy(*by).orderBy(F.desc(penalty(F.col("severity"), F.col("confidence"))), "ord")
    return findings.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
