"""Rules of one's own beside the built-in ones, shared facts, project rules and observed counts."""

from pyspark.sql import functions as F

from plumbline.plans import catalogue, protocol
from plumbline.rules import text

UNITS = "file string, type string, source string"
OWN = {"own.rule": ("own", "warning", "low")}


def units(spark):
    long = "<?php\nfunction f() {\n" + "$a = 1;\n" * 101 + "}\n"
    return spark.createDataFrame([("a.php", "php", long), ("b.php", "php", "<?php\nclass A { }\nclass B { }\n"), ("c.md", "text", "class A\nghp_" + "a1" * 18)], UNITS)


def test_own_plan_runs_beside_the_others_and_shares_their_facts(spark):
    made = []

    def plan(facts):
        rows = facts["segments"]
        made.append(facts.made)
        return rows.where("kind = 'function'").select("file", "line", F.lit("own.rule").alias("rule_id"), F.lit(7).alias("value"))

    own = protocol.RuleSet("own", OWN, plan, "segments")
    found = catalogue.analyse(units(spark), catalogue.Selection(rules=("own.rule", "size.method-length", "sensitive-data.api-key-pattern")), more=(own,)).collect()
    assert sorted((r["file"], r["rule_id"], r["line"], r["value"], r["pillar"], r["severity"]) for r in found) == [
        ("a.php", "own.rule", 2, 7, "own", "warning"), ("a.php", "size.method-length", 2, 101, "size", "error"), ("c.md", "sensitive-data.api-key-pattern", 2, None, "sensitive-data", "warning"),
    ]
    assert "segments" in made[0] and "lines" not in made[0]  # made for the rule before, and nothing that no selected rule needs


def test_python_function_as_a_rule(spark):
    def function(file, source):
        for i, line in enumerate((source or "").split("\n"), 1):
            if "class" in line:
                yield i, "own.rule", line.split()[1], len(line)

    own = protocol.row_rule("own", OWN, function, "type = 'php'")
    found = catalogue.analyse(units(spark), catalogue.Selection(pillars=("own",)), more=(own,)).collect()
    assert sorted((r["file"], r["line"], r["symbol"], r["value"]) for r in found) == [("b.php", 2, "A", 11), ("b.php", 3, "B", 11)]


def test_project_rule_sees_all_files(spark):
    more = units(spark).unionByName(spark.createDataFrame([("d.php", "php", "<?php\nclass A { }\n")], UNITS))
    accumulate = {"n": F.count_distinct("file"), "first": F.min(F.struct("file", F.col("start").alias("line")))}
    own = protocol.project_rule("own", OWN, "declarations", ("name",), accumulate, lambda rows: rows.where("n > 1").select("first.file", "first.line", F.lit("own.rule").alias("rule_id"), F.col("name").alias("symbol"), F.col("n").alias("value")))
    found = catalogue.analyse(more, catalogue.Selection(pillars=("own",)), more=(own,)).collect()
    assert [(r["file"], r["line"], r["symbol"], r["value"]) for r in found] == [("b.php", 2, "A", 2)]


def test_rows_and_findings_are_counted_on_the_way(spark):
    own = protocol.RuleSet("own", OWN, lambda f: f["units"].where("type = 'text'").select("file", F.lit(1).alias("line"), F.lit("own.rule").alias("rule_id")))
    found, seen = catalogue.analyse_observed(units(spark), catalogue.Selection(rules=("own.rule", "docs.todo-density")), more=(own,))
    assert found.count() == 1 and set(seen) == {"own", "whole texts"}
    assert [x.get["rows"] for x in seen["own"]] == [3, 1]
    assert [x.get["rows"] for x in seen["whole texts"]] == [3, 0]


def test_every_rule_has_a_definition_and_texts_alone_make_no_facts(spark):
    known = catalogue.all_rules()
    assert len(known) > 80 and known["complexity.cognitive"] == ("complexity", "error", "high") and known["waste.unused-import"][0] == "dead-code"
    found = catalogue.analyse(units(spark).where("type = 'text'")).collect()
    assert {r["rule_id"] for r in found} == {"sensitive-data.api-key-pattern"}


def test_whole_texts(spark):
    rules = {"size.file-length", "docs.todo-density"}
    ten, eleven = "x\n" + "todo " * 10, "x\n" + "FIXME\n" * 11
    code = "<?php\n$todo = 'TODO';\n/* TODO */ $a = 1; // hack\n# XXX\n" + "// fixme todo\n\n" * 5
    rows = [("ten", "text", ten), ("eleven", "text", eleven), ("code", "php", code), ("none", "text", None), ("one", "php", "<?php\n" + "// todo\n" * 8 + "$x = 1;\n" * 3)]
    found = text.whole_texts(spark.createDataFrame(rows, UNITS), rules, max_lines=3).collect()
    assert sorted((r["file"], r["rule_id"], r["line"], r["value"]) for r in found) == [
        ("code", "docs.todo-density", 3, 13), ("eleven", "docs.todo-density", 2, 11), ("eleven", "size.file-length", 1, 12), ("one", "size.file-length", 1, 4),
    ]
