"""Rules that compare a declaration with the comment block above it and with its body.

Every line carries the first line of the comment block that it lies in, and every
declaration that of the block above it, so that blocks meet declarations by an
equi-join. Lines of bodies meet declarations by file and bucket of lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.rules.code import _report, bucket, code_lines, cut, declarations, measured, members
from plumbline.sources.staging import staged

# fixed values: words that negate a boolean name, and calls that the rules look for
NEGATIONS = ("no", "not", "non", "disable", "skip", "dont", "cant", "wont")
DEBUG_SETTING = r"""\bini_set\s*\(\s*['"](?:display_errors|display_startup_errors)['"]\s*,\s*(?:true|[1-9]\d*|['"](?:1|on|true|yes|stdout|stderr)['"])"""
UNVERIFIED = r"(?i)\bCURLOPT_SSL_VERIFY(?:PEER|HOST)\s*(?:,|=>)\s*(?:false|0|null|''|\"\")"
REFLECTION = r"\bnew\s+\\?Reflection(?:Method|Class|Property)\b|->setAccessible\s*\(\s*true|\bClosure::bind\b"
MIN_SETUP_LINES = 8


def comment_blocks(lines: DataFrame) -> DataFrame:
    """lines with ``block`` (first line of the comment block that they lie in, or null) and ``block_above`` (of the block that ended last)."""
    w = Window.partitionBy("file").orderBy("line")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    opened = F.last(F.when(F.col("raw").contains("/**"), F.col("line")), ignorenulls=True).over(w)
    closed_before = F.last(F.when(F.col("raw").contains("*/"), F.col("line")), ignorenulls=True).over(before)
    out = lines.withColumn("opened", opened).withColumn("block", F.when(F.col("opened") > F.coalesce(closed_before, F.lit(0)), F.col("opened")).when(F.col("opened") == F.col("line"), F.col("line")))
    return out.withColumn("block_above", F.last(F.when(F.col("raw").contains("*/"), F.col("opened")), ignorenulls=True).over(before)).drop("opened")


def parameters(header: Column) -> Column:
    """(name, type) of the parameters of a callable's header."""
    inside = F.regexp_replace(F.regexp_extract(header, r"\bfunction\s+&?\s*\w+\s*\(((?:[^()]++|\([^()]*+\))*+)", 1), r"\([^()]*\)", "")
    each = F.filter(F.split(inside, ","), lambda p: p.contains("$"))
    return F.transform(each, lambda p: F.struct(F.regexp_extract(p, r"\$(\w+)", 1).alias("name"), F.trim(F.regexp_extract(p, r"^([^$&.]*)", 1)).alias("type")))


def scope_findings(units: DataFrame, lines: DataFrame | None = None, decls: DataFrame | None = None) -> DataFrame:
    """file, line, rule_id, symbol, value of the documentation, parameter and test-scope rules on code units."""
    lines = lines or staged(comment_blocks(code_lines(units.select("file", "source"))), "scope-lines")
    decls = decls or staged(measured(lines, declarations(lines)), "scope-declarations")
    callables = decls.where("kind in ('method', 'function')").withColumn("parameters", parameters(F.col("header")))
    out = [_report(lines, {
        "security.debug-mode-enabled": (F.col("raw").rlike(DEBUG_SETTING) & F.col("code").contains("ini_set"), None),
        "security.disabled-ssl-verification": (F.col("raw").rlike(UNVERIFIED) & F.col("code").contains("CURLOPT_SSL_VERIFY"), None),
        "security.unsafe-unserialize": (F.col("code").rlike(r"(?<![>:\w$\\])unserialize\s*\(\s*(?!['\"])") & ~F.col("raw").contains("allowed_classes"), None),
    }, "line", None)]

    # documented callables and what their blocks say
    at = lines.select(F.col("file").alias("_file"), F.col("line").alias("_line"), "block_above")
    documented = callables.where("documented").join(at, (F.col("file") == F.col("_file")) & (F.col("start") == F.col("_line"))).drop("_file", "_line")
    said = F.trim(F.regexp_replace(F.regexp_replace("raw", r"\*/\s*$", ""), r"^\s*/?\*+\s?", ""))
    notes = lines.where("block is not null").select(F.col("file").alias("_file"), F.col("block").alias("_block"), said.alias("said")).where("said <> ''")
    tag = F.regexp_extract("said", r"^@(\w+)", 1)
    bare = F.col("said").rlike(r"^@param\s+\S+\s+(?:&|\.\.\.)?\$\w+$|^@return\s+\S+$")
    blocks = notes.groupBy("_file", "_block").agg(
        F.count_if(tag != "").alias("tags"), F.count_if((tag == "") | ~bare).alias("prose"), F.max(F.col("said").contains("@return")).alias("returns"), F.max(F.col("said").contains("@throws")).alias("throws"),
        F.max(F.col("said").rlike(r"^@return\s+\S+$")).alias("bare_return"), F.max(F.col("said").contains("@dataProvider")).alias("provides"),
        F.collect_set(F.when(tag == "param", F.regexp_extract("said", r"\$(\w+)", 1))).alias("described"),
    )
    body = lines.select(F.col("file").alias("_f"), bucket("line").alias("_at"), F.col("line").alias("_l"), F.col("code").alias("_code"))
    inside = (F.col("file") == F.col("_f")) & (F.col("_cut") == F.col("_at")) & (F.col("_l") >= F.col("start")) & (F.col("_l") <= F.col("end"))
    acts = cut(callables).join(body, inside).groupBy(F.col("file").alias("_f2"), F.col("start").alias("_s2"), F.col("name").alias("_n2")).agg(
        F.max(F.col("_code").rlike(r"\bthrow\b")).alias("does_throw"), F.max(F.col("_code").rlike(r"\breturn\s+[^;\s]")).alias("gives"),
        F.flatten(F.collect_list(F.when(F.col("_l") > F.col("start"), F.regexp_extract_all("_code", F.lit(r"\$(\w+)"), F.lit(1))).otherwise(F.regexp_extract_all(F.regexp_extract("_code", r"\{(.*)", 1), F.lit(r"\$(\w+)"), F.lit(1))))).alias("reads"),
    )
    same = (F.col("file") == F.col("_f2")) & (F.col("start") == F.col("_s2")) & (F.col("name") == F.col("_n2"))
    told = documented.join(blocks, (F.col("file") == F.col("_file")) & (F.col("block_above") == F.col("_block"))).join(acts, same)
    special, result = F.col("name").isin("__construct", "__destruct"), F.regexp_extract("header", r"\)\s*:\s*\??\s*([\w\\|]+)", 1)
    out.append(_report(told, {
        "docs.bare-phpdoc-tags": ((F.col("tags") > 0) & (F.col("prose") == 0), None),
        "docs.missing-return-tag": (~F.col("returns") & ~special, None),
        "docs.missing-throws-tag": (F.col("does_throw") & ~F.col("throws") & (F.col("visibility") == "public"), None),
        "docs.return-comment": (F.col("bare_return") & ~special & ~result.isin("void", "never") & ((result != "") | F.col("gives")), None),
        "test-quality.data-provider-annotation": (F.col("provides") & F.col("name").rlike("^test"), None),
    }))
    each = told.where("tags > 0").select("file", "start", "described", F.transform("parameters", lambda p: p["name"]).alias("names"))
    missing = each.select("file", "start", F.explode(F.array_except("names", "described")).alias("name"))
    stale = each.select("file", "start", F.explode(F.array_except("described", "names")).alias("name"))
    contract = told.where("size(described) > 0 or returns or throws").select(F.col("file").alias("_file"), F.col("start").alias("_start")).distinct()
    out.append(_report(missing.join(contract, (F.col("file") == F.col("_file")) & (F.col("start") == F.col("_start")), "left_semi"), {"docs.missing-param-tag": (F.lit(True), None)}))
    out.append(_report(stale.where("name <> ''"), {"docs.stale-param-tag": (F.lit(True), None)}))

    # parameters: negated booleans, and those that no line of the body reads
    given = callables.select("file", "start", F.inline("parameters"))
    word = F.lower(F.regexp_extract("name", r"^_*([A-Z]?[a-z]+|[A-Z]+(?![a-z]))", 1))
    out.append(_report(given.where(F.col("type").rlike(r"^\??bool$")), {"naming.negative-boolean": (word.isin(*NEGATIONS), None)}))
    heirs = members(decls).join(lines.select(F.col("file").alias("_file"), F.col("line").alias("_line"), F.col("code").alias("_head")), (F.col("file") == F.col("_file")) & (F.col("class_start") == F.col("_line")))
    heirs = heirs.where((F.col("visibility") != "private") & F.col("_head").rlike(r"\b(?:extends|implements)\b") | F.col("class_kind").isin("interface")).select(F.col("file").alias("_file"), F.col("start").alias("_start"))
    own = callables.where(~F.col("bodyless") & (~F.col("name").startswith("__") | (F.col("name") == "__construct"))).join(heirs, (F.col("file") == F.col("_file")) & (F.col("start") == F.col("_start")), "left_anti").join(acts, same)
    unread = own.select("file", "start", F.explode(F.array_except(F.transform("parameters", lambda p: p["name"]), "reads")).alias("name"))
    out.append(_report(unread, {"waste.unused-parameter": (F.lit(True), None)}))

    # test scopes
    in_tests = members(decls).where(F.col("class_name").rlike("Tests?$"))
    tests = in_tests.where(F.col("name").rlike("^test"))
    steps = cut(tests).join(body, inside & (F.col("_l") > F.col("start")) & (F.col("_l") < F.col("end")))
    same_literal = r"assert(?:Same|Equals|Not(?:Same|Equals))\s*\(\s*(\d+|true|false|null|'_*'|\$\w+(?:->\w+)*)\s*,\s*\1\s*[,)]"
    out.append(_report(steps, {"test-quality.private-reflection": (F.col("_code").rlike(REFLECTION), None), "test-quality.trivial-assertion": (F.col("_code").rlike(same_literal) & ~F.col("_code").rlike(r"'_+'"), None)}, "_l"))
    expected = steps.groupBy("file", "start", "name").agg(F.max(F.col("_code").rlike(r"->expectException\s*\(")).alias("kind"), F.max(F.col("_code").rlike(r"->expectException(?:Message\w*|Code|Object)\s*\(")).alias("more"))
    out.append(_report(expected, {"test-quality.exception-type-only": (F.col("kind") & ~F.col("more"), None)}))
    sizes = in_tests.groupBy("file", "class_name").agg(F.max(F.when(F.col("name") == "setUp", F.struct((F.col("m_solid") - 2).alias("n"), F.col("start")))).alias("setup"), F.avg(F.when(F.col("name").rlike("^test"), F.col("m_solid") - 2)).alias("mean"))
    bloated = sizes.select("file", F.col("setup.start").alias("start"), F.lit("setUp").alias("name"), F.col("setup.n").alias("n"), "mean").where("n is not null")
    out.append(_report(bloated, {"test-quality.setup-bloat": ((F.col("n") >= MIN_SETUP_LINES) & (F.col("n") > F.col("mean")), F.col("n"))}))
    found = out[0]
    for rows in out[1:]:
        found = found.unionByName(rows)
    return found
