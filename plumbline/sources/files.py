"""File sources: units from folders, ignore decisions, and the JSON side inputs."""

from __future__ import annotations

import os

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.text import matches_path
from plumbline.sources.staging import staged

# fixed values: what counts as text, and what is skipped by default
TEXT_EXTENSIONS = ("conf", "config", "env", "ini", "json", "md", "neon", "sh", "toml", "xml", "yaml", "yml")
TEXT_NAMES = (".editorconfig", ".gitattributes", ".gitignore")
IGNORED_FOLDERS = (
    ".fleet", ".git", ".hg", ".idea", ".phpunit.cache", ".svn", ".vscode",
    "build", "cache", "coverage", "dist", "generated", "node_modules", "tmp", "var/cache", "vendor",
)
GENERATED_NAMES = ("bun.lockb", "composer.lock", "npm-shrinkwrap.json", "package-lock.json", "pnpm-lock.yaml", "yarn.lock")


def file_type(path: Column) -> Column:
    """php, text or null."""
    name, extension = F.regexp_extract(path, r"([^/]*)$", 1), F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(extension == "php", "php").when(extension.isin(*TEXT_EXTENSIONS) | name.isin(*TEXT_NAMES) | name.startswith(".env"), "text")


def ignore_decision(path: Column, patterns: list[str] = (), include_ignored: bool = False) -> Column:
    """Why a path is skipped (struct source, pattern), or null: settings first, then default folders, then lock files."""
    configured = matches_path(path, list(patterns))
    folder = F.lit(None).cast("string")
    for name in reversed(IGNORED_FOLDERS):
        folder = F.when(F.concat(F.lit("/"), path).contains(f"/{name}/"), name).otherwise(folder)
    lock = F.regexp_extract(path, r"([^/]*)$", 1)
    reason = lambda source, pattern: F.struct(F.lit(source).alias("source"), pattern.alias("pattern"))
    out = F.when(configured.isNotNull(), reason("config", configured))
    return out if include_ignored else out.when(folder.isNotNull(), reason("default", folder)).when(lock.isin(*GENERATED_NAMES), reason("generated", lock))


def discover(spark: SparkSession, root: str, patterns: list[str] = (), include_ignored: bool = False) -> DataFrame:
    """Units below a folder of any Hadoop file system: file (relative), type, source.

    Spark's listing leaves out names that begin with a dot or an underscore; name
    such files in ``root`` itself to read them.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = "file:" + root if root.startswith("/") else root.replace("file://", "file:")
    relative = F.regexp_replace(F.substring(F.col("path"), len(base.rstrip("/")) + 1, 1 << 20), "^/+", "")
    files = raw.withColumn("file", relative).withColumn("type", file_type(F.col("file")))
    files = files.where("type is not null").where(ignore_decision(F.col("file"), patterns, include_ignored).isNull())
    return files.select("file", "type", F.decode("content", "UTF-8").alias("source"))


def _listed(root: str):
    """Entries directly below each folder: folder, path (relative), canonical, is_folder, size; folders that cannot be listed give none."""
    names = ["path", "canonical", "is_folder", "size"]

    def run(batches):
        system, base = fs.FileSystem.from_uri(root)
        local = isinstance(system, fs.LocalFileSystem)
        for batch in batches:
            for folder in batch.column("path").to_pylist():
                try:
                    entries = system.get_file_info(fs.FileSelector(f"{base.rstrip('/')}/{folder}".rstrip("/") or "/"))
                except OSError:  # gone, or not ours to see
                    continue
                rows = [(f"{folder}/{e.base_name}".lstrip("/"), os.path.realpath(e.path) if local else e.path, e.type == fs.FileType.Directory, e.size or 0) for e in entries]
                if rows:
                    kinds = (pa.string(), pa.string(), pa.bool_(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


def walk(spark: SparkSession, root: str, patterns: list[str] = (), include_ignored: bool = False, most_levels: int = 200) -> tuple[DataFrame, DataFrame]:
    """Files below a folder (path, canonical, size), and what was ignored (path, source, pattern), level by level.

    The folders of a level are listed by tasks; those that are ignored are recorded and
    not entered, so nothing below them is listed. A folder or file that is reached twice by
    links counts once, under its first path by name.
    """
    frontier = spark.createDataFrame([("",)], "path string")
    files = ignored = None
    system, base = fs.FileSystem.from_uri(root)
    seen = spark.createDataFrame([(os.path.realpath(base) if isinstance(system, fs.LocalFileSystem) else base.rstrip("/"),)], "canonical string")
    for level in range(most_levels):
        found = staged(frontier.repartition(max(1, spark.sparkContext.defaultParallelism)).mapInArrow(_listed(root), "path string, canonical string, is_folder boolean, size long"), f"walk-{level}")
        decision = ignore_decision(F.when(F.col("is_folder"), F.concat("path", F.lit("/_"))).otherwise(F.col("path")), patterns, include_ignored)
        found = found.withColumn("ignored", decision)
        out = found.where("ignored is not null").select("path", "ignored.source", "ignored.pattern")
        new = found.where("ignored is null").groupBy("canonical", "is_folder").agg(F.min("path").alias("path"), F.first("size").alias("size"))
        folders = new.where("is_folder").join(seen, "canonical", "left_anti")
        folders = staged(folders.select("canonical", "path"), f"walk-folders-{level}")
        seen = seen.unionByName(folders.select("canonical"))
        own = new.where("not is_folder").select("path", "canonical", "size")
        files, ignored = (own, out) if files is None else (files.unionByName(own), ignored.unionByName(out))
        if folders.isEmpty():
            break
        frontier = folders.select("path")
    else:
        raise ValueError(f"folders nest deeper than {most_levels}")
    return files.groupBy("canonical").agg(F.min("path").alias("path"), F.first("size").alias("size")).select("path", "canonical", "size"), ignored


def _contents(root: str):
    def run(batches):
        system, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            for path, kind in zip(batch.column("path").to_pylist(), batch.column("type").to_pylist(), strict=True):
                with system.open_input_stream(f"{base.rstrip('/')}/{path}") as stream:
                    text = stream.read().decode("utf-8", "replace")
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([kind]), pa.array([text])], ["file", "type", "source"])

    return run


def read_tree(spark: SparkSession, root: str, patterns: list[str] = (), include_ignored: bool = False) -> tuple[DataFrame, DataFrame]:
    """Units (file, type, source) of the text and code files that walk finds, names with a leading dot included, and what was ignored."""
    files, ignored = walk(spark, root, patterns, include_ignored)
    typed = files.withColumn("type", file_type(F.col("path"))).where("type is not null").select("path", "type")
    parts = max(1, spark.sparkContext.defaultParallelism)
    return typed.repartition(parts).mapInArrow(_contents(root), "file string, type string, source string"), ignored


def missing_paths(requested: DataFrame, units: DataFrame) -> DataFrame:
    """Requested paths below which there is no file."""
    parts = F.split("file", "/")
    known = units.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("path")).distinct()
    return requested.select(F.rtrim(F.col("path"), F.lit("/")).alias("path")).join(known, "path", "left_anti")


BASELINE_VERSION = "plumbline.baseline.v2"


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """file, rule_id, message, accepted of a baseline; another version, a malformed or a repeated group is an error.

    A baseline is one JSON document with all groups, or what ``write_baseline`` makes:
    a folder of JSON lines, each a document with one group.
    """
    head = spark.read.text(path).where("value <> ''").first()
    in_lines = head is not None and head[0].startswith("{") and head[0].rstrip().endswith("}")
    raw = spark.read.schema("schemaVersion string, groups array<struct<file:string,ruleId:string,message:string,count:bigint>>").json(path, multiLine=not in_lines, mode="FAILFAST")
    rows = raw.select(F.when(F.col("schemaVersion") == BASELINE_VERSION, F.col("groups")).otherwise(F.raise_error(F.lit("the baseline has another version; write it again"))).alias("groups")).select(F.inline("groups"))
    right = F.coalesce((F.col("count") >= 1) & F.col("file").isNotNull() & F.col("ruleId").isNotNull() & F.col("message").isNotNull(), F.lit(False))
    rows = rows.select("file", F.col("ruleId").alias("rule_id"), "message", F.when(right, F.col("count")).otherwise(F.raise_error(F.lit("malformed baseline group")).cast("long")).alias("accepted"))
    return rows.groupBy("file", "rule_id", "message").agg(F.when(F.count("*") == 1, F.max("accepted")).otherwise(F.raise_error(F.lit("repeated baseline group")).cast("long")).alias("accepted"))


# fixed values: sections of a mutation report and the status of their mutants
SECTIONS = {"escaped": "escaped", "timeouted": "timed out", "killed": "killed", "killedByStaticAnalysis": "killed by SA", "errored": "error", "syntaxErrors": "syntax error", "uncovered": "not covered", "ignored": "ignored"}


def read_mutants(spark: SparkSession, path: str) -> DataFrame:
    """file, line, mutator, status of a mutation report, or of a folder of reports that are one line each."""
    head = spark.read.text(path).where("value <> ''").first()
    in_lines = head is not None and head[0].startswith("{") and head[0].rstrip().endswith("}")
    mutant = "array<struct<mutator:struct<mutatorName:string,originalFilePath:string,originalStartLine:int>>>"
    raw = spark.read.schema(", ".join(f"{s} {mutant}" for s in SECTIONS)).json(path, multiLine=not in_lines, mode="FAILFAST")

    def rows(section: str, status: str) -> Column:
        place = lambda m: F.struct(m["mutator"]["originalFilePath"].alias("file"), m["mutator"]["originalStartLine"].alias("line"), m["mutator"]["mutatorName"].alias("mutator"), F.lit(status).alias("status"))
        return F.transform(F.coalesce(section, F.array().cast(mutant)), place)

    each = F.flatten(F.array(*[rows(section, status) for section, status in SECTIONS.items()]))
    return raw.select(F.inline(each))


HISTORY = "timestamp string, score double, grade string, scope string, findings long"


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Score history: a JSON array of flat entries, or the folder that ``append_history`` adds to; none where there is no file, or only blank ones. Other text is an error."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    head = spark.read.text(path).where("trim(value) <> ''").first() if system.exists(at) else None
    if head is None:
        return spark.createDataFrame([], HISTORY)
    return spark.read.schema(HISTORY).json(path, multiLine=not head[0].startswith("{"), mode="FAILFAST")


def cache_key(run_digest: str) -> Column:
    """Names the run's settings, the path and the content of a unit."""
    return F.sha2(F.concat_ws("\x00", F.lit(run_digest), "file", F.sha2("source", 256)), 256)


def cache_entries(units: DataFrame, findings: DataFrame, run_digest: str, used: Column) -> DataFrame:
    """What a run adds to the cache: cache_key, file, used, n_findings and one row per finding (finding; null for a unit without any)."""
    rows = findings.select(F.col("file").alias("_file"), F.struct(*[c for c in findings.columns if c != "file"]).alias("finding"))
    keyed = units.select(cache_key(run_digest).alias("cache_key"), "file", used.alias("used"))
    return keyed.join(rows, F.col("file") == F.col("_file"), "left").drop("_file")


def evicted(cache: DataFrame, capacity: int = 32768) -> DataFrame:
    """The cache without the entries that were used longest ago, beyond ``capacity`` keys."""
    keys = cache.groupBy(F.col("cache_key").alias("_key")).agg(F.max("used").alias("_used"))
    return cache.join(keys.orderBy(F.desc("_used"), "_key").limit(capacity).select("_key"), F.col("cache_key") == F.col("_key"), "left_semi")


def not_cached(units: DataFrame, cache: DataFrame, run_digest: str) -> tuple[DataFrame, DataFrame]:
    """Units whose findings are not in the cache, and the cached findings of the others."""
    keyed = units.withColumn("cache_key", cache_key(run_digest))
    return keyed.join(cache.select("cache_key").distinct(), "cache_key", "left_anti"), cache.join(keyed.select("cache_key").distinct(), "cache_key", "left_semi")
