"""Rules on package manifests, test-runner settings and workflow files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MANIFEST = "struct<require:map<string,string>,`require-dev`:map<string,string>,repositories:array<struct<type:string,url:string>>,scripts:map<string,string>>"
# fixed values: repository kinds, install-time events and risky command parts
VCS = ("vcs", "git", "svn", "hg", "fossil", "perforce")
INSTALL_EVENTS = ("pre-install-cmd", "post-install-cmd", "pre-update-cmd", "post-update-cmd", "pre-autoload-dump", "post-autoload-dump", "post-root-package-install", "post-create-project-cmd", "pre-package-install", "post-package-install", "pre-package-update", "post-package-update")
RISKY_COMMAND = r"(?i)\bcurl\b|\bwget\b|\|\s*(?:ba)?sh\b|php\s+-r|\beval\b|`|base64\s+-d"


def manifests(units: DataFrame) -> DataFrame:
    """file and parsed manifest of units named composer.json."""
    return units.where(F.col("file").rlike(r"(^|/)composer\.json$")).select("file", F.from_json("source", MANIFEST).alias("m")).where("m is not null")


def unpinned(units: DataFrame) -> DataFrame:
    """Requirements whose constraint has an open alternative: file, package, constraint."""
    rows = manifests(units).select("file", F.explode(F.map_entries(F.map_concat(F.coalesce("m.require", F.create_map().cast("map<string,string>")), F.coalesce(F.map_filter("m.require-dev", lambda k, v: ~F.map_contains_key(F.coalesce("m.require", F.create_map().cast("map<string,string>")), k)), F.create_map().cast("map<string,string>"))))).alias("e"))
    rows = rows.select("file", F.col("e.key").alias("package"), F.col("e.value").alias("constraint"))
    parts = F.transform(F.split("constraint", r"\|\|?"), F.trim)
    is_open = lambda a: (a == "") | a.contains("*") | a.startswith("dev-") | a.contains("@dev") | (a.startswith(">") & ~a.contains("<"))
    return rows.where(F.exists(parts, is_open))


def repositories(units: DataFrame, kinds) -> DataFrame:
    """Repositories of some kinds: file, kind, url."""
    return manifests(units).select("file", F.explode("m.repositories").alias("r")).select("file", F.lower("r.type").alias("kind"), F.col("r.url").alias("url")).where(F.col("kind").isin(*kinds))


def risky_scripts(units: DataFrame) -> DataFrame:
    """Install-time scripts that run risky commands: file, event, command."""
    rows = manifests(units).select("file", F.explode(F.map_entries("m.scripts")).alias("e")).select("file", F.col("e.key").alias("event"), F.col("e.value").alias("command"))
    return rows.where(F.col("event").isin(*INSTALL_EVENTS) & F.col("command").rlike(RISKY_COMMAND))


# fixed values: the strictness flags of a test runner
STRICT_FLAGS = ("failOnRisky", "failOnWarning", "beStrictAboutTestsThatDoNotTestAnything", "beStrictAboutOutputDuringTests", "beStrictAboutChangesToGlobalState")


def test_runner_flags(units: DataFrame, flags=STRICT_FLAGS) -> DataFrame:
    """Strictness flags that a test-runner file does not set to true: file, flag."""
    rows = units.where(F.col("file").rlike(r"(^|/)phpunit\.xml(\.dist)?$"))
    each = F.array(*[F.struct(F.lit(f).alias("flag"), F.coalesce(F.lower(F.xpath_string("source", F.lit(f"/phpunit/@{f}"))) == "true", F.lit(False)).alias("is_set")) for f in flags])
    return rows.select("file", F.inline(each)).where("not is_set").select("file", "flag")


def test_runner_gaps(units: DataFrame) -> DataFrame:
    """What a test-runner file leaves open: file, rule_id."""
    rows = units.where(F.col("file").rlike(r"(^|/)phpunit\.xml(\.dist)?$"))
    fatal = F.lower(F.xpath_string("source", F.lit("/phpunit/@failOnDeprecation"))) == "true"
    covered = F.xpath_boolean("source", F.lit("/phpunit/source | /phpunit/filter/whitelist"))
    gaps = F.array_compact(F.array(F.when(~F.coalesce(fatal, F.lit(False)), "test-quality.phpunit-deprecations-not-fatal"), F.when(~F.coalesce(covered, F.lit(False)), "test-quality.phpunit-coverage-source-missing")))
    return rows.select("file", F.explode(gaps).alias("rule_id"))


def risky_workflows(units: DataFrame) -> DataFrame:
    """Risky lines of workflow files: file, line, problem.

    The indent at which the last run block began carries forward line by line, and
    ends at the first line that is indented no deeper.
    """
    rows = units.where(F.col("file").rlike(r"(^|/)\.github/workflows/[^/]+\.ya?ml$"))
    lines = rows.select("file", F.posexplode(F.split("source", "\r?\n")).alias("at", "text")).withColumn("line", F.col("at") + 1)
    w = Window.partitionBy("file").orderBy("line")
    indent = F.length(F.regexp_extract("text", r"^(\s*(?:-\s+)?)", 1))
    begins = F.col("text").rlike(r"^\s*(?:-\s+)?run:\s*[|>]?")
    lines = lines.withColumn("indent", indent).withColumn("run_line", F.last(F.when(begins, F.col("line")), ignorenulls=True).over(w)).withColumn("run_indent", F.last(F.when(begins, F.col("indent")), ignorenulls=True).over(w))
    left = F.max(F.when((F.trim("text") != "") & ~begins & (F.col("indent") <= F.col("run_indent")), 1).otherwise(0)).over(Window.partitionBy("file", "run_line").orderBy("line"))
    lines = lines.withColumn("in_run", F.col("run_line").isNotNull() & (begins | (left == 0)))
    t = F.col("text")
    problems = F.array_compact(F.array(
        F.when(t.rlike(r"^\s*(?:-\s+|on:\s*\[?.*)?pull_request_target\b"), "pull_request_target"),
        F.when(t.rlike(r"\buses:\s*[^\s@]+@(?:main|master|HEAD|latest)\b") | t.rlike(r"\buses:\s*[\w.-]+/[^\s@]+\s*$"), "floating action"),
        F.when(t.rlike(r"\bpermissions:\s*write-all\b"), "write-all permissions"),
        F.when(F.col("in_run") & t.rlike(r"\$\{\{\s*github\.event\."), "event data in a run block"),
    ))
    return lines.select("file", "line", F.explode(problems).alias("problem"))
