"""Changed regions: interval overlap, innermost enclosing interval, and unified diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# fixed values: rules that judge a file, and rules that are parked on one line
FILE_AGGREGATES = ("docs.todo-density", "size.file-length")
ANCHORED = ("docs.todo-density", "size.average-method-length", "size.class-length", "size.file-length", "size.property-count", "size.public-method-count")
#: Lines of a bucket of the interval joins.
BUCKET = 64


def touching(rows: DataFrame, ranges: DataFrame, start: Column, end: Column, key: str = "ord", bucket: int = BUCKET) -> DataFrame:
    """Keys of rows whose span overlaps a range of the same file.

    Spans and ranges are cut into buckets of lines, so that the join is an
    equi-join on (file, bucket) however long a file is.
    """
    cut = lambda a, b: F.explode(F.sequence(F.floor(a / bucket), F.floor(b / bucket)))
    spans = rows.select(key, "file", start.alias("_a"), end.alias("_b")).where("_a <= _b").withColumn("_bucket", cut(F.col("_a"), F.col("_b")))
    cuts = ranges.select(F.col("file").alias("_file"), F.col("start").alias("_start"), F.col("end").alias("_end")).where("_start <= _end").withColumn("_cut", cut(F.col("_start"), F.col("_end")))
    same = (F.col("file") == F.col("_file")) & (F.col("_bucket") == F.col("_cut")) & (F.col("_start") <= F.col("_b")) & (F.col("_end") >= F.col("_a"))
    return spans.join(cuts, same, "left_semi").select(key).distinct()


def enclosing(findings: DataFrame, declarations: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """ord, e_start, e_end of the smallest declaration around each finding; the first by start of equal ones."""
    spans = findings.where("line is not null").select("ord", "file", "line", F.coalesce("end_line", "line").alias("_to"), F.floor(F.col("line") / bucket).alias("_bucket"))
    cuts = declarations.select(F.col("file").alias("_file"), F.col("start").alias("_start"), F.col("end").alias("_end"), F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor(F.col("end") / bucket))).alias("_cut"))
    inside = (F.col("file") == F.col("_file")) & (F.col("_bucket") == F.col("_cut")) & (F.col("_start") <= F.col("line")) & (F.col("_end") >= F.col("_to"))
    found = spans.join(cuts, inside).groupBy("ord").agg(F.min(F.struct((F.col("_end") - F.col("_start")).alias("size"), "_start", "_end")).alias("d"))
    return found.select("ord", F.col("d._start").alias("e_start"), F.col("d._end").alias("e_end"))


def changed_region(findings: DataFrame, changed_files: DataFrame, ranges: DataFrame, declarations: DataFrame | None, scope: str) -> DataFrame:
    """findings with ``kept`` under scope symbol, hunk or file.

    In order: a file that did not change is out; a finding without a line, or in a
    file without ranges, stays; a whole-file rule stays in file scope; a parked rule
    stays only if its line changed; then its own span, and in symbol scope the
    innermost declaration around it, must overlap a range.
    """
    known = changed_files.select(F.col("file").alias("_file"), F.lit(True).alias("changed"), F.lit(False).alias("ranged"))
    known = known.unionByName(ranges.select(F.col("file").alias("_file"), F.lit(False).alias("changed"), F.lit(True).alias("ranged")))
    known = known.groupBy("_file").agg(F.max("changed").alias("_changed"), F.max("ranged").alias("_ranged"))
    line, to = F.col("line"), F.coalesce("end_line", "line")
    spans = [F.struct(F.lit("own").alias("kind"), line.alias("a"), to.alias("b")), F.struct(F.lit("anchor").alias("kind"), line.alias("a"), line.alias("b"))]
    placed = findings.where("line is not null").select("ord", "file", "line", "end_line")
    if scope == "symbol" and declarations is not None:
        around = enclosing(findings, declarations).withColumnRenamed("ord", "_around")
        placed = placed.join(around, F.col("ord") == F.col("_around"), "left")
        spans.append(F.when(F.col("e_start").isNotNull(), F.struct(F.lit("around").alias("kind"), F.col("e_start").alias("a"), F.col("e_end").alias("b"))))
    # all spans of a finding meet the ranges in one join by (file, line bucket)
    cuts = lambda a, b: F.explode(F.sequence(F.floor(a / BUCKET), F.floor(b / BUCKET)))
    each = placed.select("ord", "file", F.inline(F.array_compact(F.array(*spans))))
    each = each.where("a <= b").select("ord", "file", "kind", "a", "b", cuts(F.col("a"), F.col("b")).alias("cut"))
    changed = ranges.where("start <= end").select(F.col("file").alias("_file"), F.col("start").alias("_start"), F.col("end").alias("_end"), cuts(F.col("start"), F.col("end")).alias("_cut"))
    hit = each.join(changed, (F.col("file") == F.col("_file")) & (F.col("cut") == F.col("_cut")) & (F.col("_start") <= F.col("b")) & (F.col("_end") >= F.col("a")))
    hit = hit.groupBy(F.col("ord").alias("_ord")).agg(*[F.max(F.col("kind") == k).alias(f"_{k}") for k in ("own", "anchor", "around")])
    out = findings.join(known, F.col("file") == F.col("_file"), "left").join(hit, F.col("ord") == F.col("_ord"), "left")
    is_ = lambda name: F.coalesce(F.col(f"_{name}"), F.lit(False))
    kept = (
        F.when(~is_("changed"), False).when(line.isNull() | ~is_("ranged"), True)
        .when(F.lit(scope == "file") & F.col("rule_id").isin(*FILE_AGGREGATES), True)
        .when(F.lit(scope != "file") & F.col("rule_id").isin(*ANCHORED), is_("anchor"))
        .otherwise(is_("own") | is_("around"))
    )
    return out.select(*findings.columns, kept.alias("kept"))


def under_paths(files: DataFrame, requested: DataFrame) -> DataFrame:
    """Files that equal a requested path or lie under one: each file is joined by its ancestors."""
    parts = F.split("file", "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    hits = files.select("file", F.explode(ancestors).alias("_at")).join(requested.select(F.rtrim(F.col("path"), F.lit("/")).alias("_at")).distinct(), "_at", "left_semi")
    return hits.select("file").distinct()


#: Where the sections of a patch and the hunks of a section begin; lines end with \n only.
SECTION, HUNK = r"(?dm)(?=^diff --git )", r"(?dm)(?=^@@ -\d+(?:,\d+)? \+\d+(?:,\d+)? @@)"


def _hunk_ranges(hunk: Column, file: Column, new: Column) -> Column:
    """(file, start, end) of the runs of new lines of a hunk; of one that only deletes, the line at which it does."""
    at = lambda p: F.regexp_extract(hunk, p, 1).try_cast("int").cast("long")
    start, length = at(r"^@@ -\d+(?:,\d+)? \+(\d+)"), F.coalesce(at(r"^@@ -\d+(?:,\d+)? \+\d+,(\d+)"), F.lit(1))
    # a character for each line that the new file has
    marks = F.array_join(F.regexp_extract_all(hunk, F.lit("(?dm)^[+ ]"), F.lit(0)), "")
    runs = F.regexp_extract_all(marks, F.lit(r" +|\++"), F.lit(0))
    state = F.struct(start.alias("next"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("found"))
    step = lambda s, run: F.struct((s["next"] + F.length(run)).alias("next"), F.when(run.startswith("+"), F.concat(s["found"], F.array(F.struct(s["next"].alias("start"), (s["next"] + F.length(run) - 1).alias("end"))))).otherwise(s["found"]).alias("found"))
    found = F.aggregate(runs, state, step, lambda s: s["found"])
    here = F.greatest(F.lit(1).cast("long"), start)
    emptied = F.when((length == 0) & (new != "/dev/null"), F.array(F.struct(here.alias("start"), here.alias("end")))).otherwise(F.array().cast("array<struct<start:bigint,end:bigint>>"))
    return F.transform(F.concat(found, emptied), lambda r: F.struct(file.alias("file"), r["start"].alias("start"), r["end"].alias("end")))


def parse_unified_diff(patches: DataFrame) -> DataFrame:
    """Changed ranges of unified diffs (patch_id, text): patch_id, file, start, end; null ranges for a file that only changed.

    A patch is cut into sections, a section into its header and hunks. In a header the
    last names of the old and the new file count, and each that stood there was named.
    Ranges of one file that touch are merged in order of their lines.
    """
    text = F.replace(F.col("text"), F.lit("\r\n"), F.lit("\n"))
    sections = patches.select("patch_id", F.explode(F.split(text, SECTION)).alias("section"))
    sections = sections.select("patch_id", "section", F.split("section", HUNK).alias("pieces"))
    header = F.when(F.col("pieces")[0].rlike("^" + HUNK), "").otherwise(F.col("pieces")[0])
    path = lambda line: F.regexp_replace(F.regexp_replace(F.substring(line, 5, 1 << 20), r"\t.*$", ""), '^"?[ab]/(.*?)"?$', "$1")
    known = lambda old, new: F.when(new.isNotNull() & (new != "/dev/null"), new).otherwise(F.when(old != "/dev/null", old))
    none = F.lit(None).cast("string")
    state = F.struct(none.alias("old"), none.alias("new"), F.array().cast("array<string>").alias("files"))

    def read(s: Column, line: Column) -> Column:
        old, new = F.when(line.startswith("-"), path(line)).otherwise(s["old"]), F.when(line.startswith("+"), path(line)).otherwise(s["new"])
        file = known(old, new)
        seen = file.isNull() | F.array_contains(s["files"], F.coalesce(file, F.lit("")))
        return F.struct(old.alias("old"), new.alias("new"), F.when(seen, s["files"]).otherwise(F.concat(s["files"], F.array(file))).alias("files"))

    named = F.aggregate(F.regexp_extract_all(header, F.lit(r"(?dm)^(?:--- |\+\+\+ ).*$"), F.lit(0)), state, read)
    sections = sections.withColumn("names", named).withColumn("file", known(F.col("names.old"), F.col("names.new")))
    renamed = F.transform(F.regexp_extract_all("section", F.lit("(?dm)^rename (?:from|to) .*$"), F.lit(0)), lambda x: F.regexp_replace(x, '^rename (from|to) "?(.*?)"?$', "$2"))
    bare = F.transform(F.concat("names.files", renamed), lambda f: F.struct(f.alias("file"), F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("end")))
    hunks = F.when(F.col("section").startswith("diff --git "), F.slice("pieces", 2, F.size("pieces"))).otherwise(F.array().cast("array<string>"))
    ranges = F.flatten(F.transform(hunks, lambda h: _hunk_ranges(h, F.col("file"), F.col("names.new"))))
    rows = sections.select("patch_id", F.inline(F.concat(ranges, bare)))
    # rows without a range come last: they join the last range of their file, or stay alone
    w = Window.partitionBy("patch_id", "file").orderBy(F.col("start").asc_nulls_last(), "end")
    reached = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_apart", (F.col("start").isNotNull() & (reached.isNull() | (F.col("start") > reached + 1))).cast("int"))
    rows = rows.withColumn("_island", F.sum("_apart").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return rows.groupBy("patch_id", "file", "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def explicit_ranges(spec: DataFrame) -> DataFrame:
    """file, start, end of range lists such as 3-3,8-10 (file, spec); anything else is an error."""
    each = spec.select("file", F.explode(F.split("spec", ",")).alias("r")).select("file", "r", F.regexp_extract("r", r"^(\d+)(?:-(\d+))?$", 1).alias("a"), F.regexp_extract("r", r"^(\d+)(?:-(\d+))?$", 2).alias("b"))
    start = F.col("a").try_cast("int")
    end = F.coalesce(F.col("b").try_cast("int"), start)
    right = F.coalesce((start >= 1) & (end >= start), F.lit(False))
    return each.select("file", F.when(right, start).otherwise(F.raise_error(F.concat(F.lit("not a line range: "), "r")).cast("int")).alias("start"), end.alias("end"))
