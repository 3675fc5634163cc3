"""Statements, blocks, metrics and flow on hand-counted texts."""

import re

import pytest

from plumbline.operators import asof
from plumbline.rules import flow, statements

UNITS = "file string, source string"
#: Body of a function, its cognitive score by hand.
SHAPES = [
    ("return 1;", 0),
    ("if ($a) { return 1; }", 1),
    ("if ($a) { return 1; } else { return 2; }", 2),
    ("if ($a) { } elseif ($b) { } else if ($c) { } else { }", 4),
    ("if ($a) { if ($b) { return 1; } }", 3),
    ("foreach ($a as $b) { while ($c) { if ($d) { } } }", 6),
    ("for ($i = 0; $i < 3; $i++) { $b = 1; }", 1),
    ("do { $a--; } while ($a && $b);", 2),
    ("switch ($a) { case 1: if ($b) { } break; default: return 2; }", 3),
    ("try { if ($a) { } } catch (E $e) { if ($b) { } } finally { if ($c) { } }", 5),
    ("if ($a && $b && $c) { }", 2),
    ("if ($a && $b || $c && $d) { }", 4),
    ("$x = $a ? 1 : 2;", 1),
    ("if ($a) { $x = $b ? 1 : 2; }", 3),
    ("while (true) { foreach ($a as $b) { continue 2; } }", 4),
    ("goto end; end: return 1;", 1),
    ("$f = function () { if ($a) { return 1; } };", 2),
    ("$x = match (true) { $a => 1, default => 2 };", 1),
    ("if ($a) return 1; elseif ($b) return 2; else return 3;", 3),
    ("$x = $a ?? $b; $y = $c?->d; // if ($e) { if ($f) {", 0),
    ("$s = 'if ($a) { '; $t = \"while ({$b}) {\"; return $s;", 0),
]


@pytest.fixture(scope="module")
def shaped(spark):
    texts = [(f"f{i}.php", f"<?php\nclass C {{\n    public function m(?int $v): ?int {{\n{body}\n    }}\n}}\n") for i, (body, _) in enumerate(SHAPES)]
    return {r["file"]: r for r in statements.function_metrics(statements.segments(spark.createDataFrame(texts, UNITS))).collect()}


@pytest.mark.parametrize("i", range(len(SHAPES)))
def test_cognitive_score_by_hand(shaped, i):
    assert shaped[f"f{i}.php"]["cognitive"] == SHAPES[i][1]


def found(spark, *bodies, rule=None):
    rows = statements.statement_findings(spark.createDataFrame([(f"{i}", x) for i, x in enumerate(bodies)], UNITS)).collect()
    return sorted((r["file"], r["rule_id"], r["line"], r["value"], r["flat"]) for r in rows if rule is None or r["rule_id"] == rule)


def test_flat_guards_are_marked(spark):
    guard, nested = "if ($a) { return 1; }\n", "if ($a) { if ($b) { return 1; } }\n"
    texts = [f"<?php function f($a) {{\n{guard * 21}return 2;\n}}", f"<?php function f($a) {{\n{guard * 20}{nested}return 2;\n}}", f"<?php function f($a) {{\n{'if ($a) { $b = 1; }' * 21}\n}}", f"<?php function f($a) {{\n{guard * 20}\n}}"]
    assert found(spark, *texts, rule="complexity.cognitive") == [("0", "complexity.cognitive", 1, 21, True), ("1", "complexity.cognitive", 1, 23, False), ("2", "complexity.cognitive", 1, 21, False)]


def test_dead_code_and_pairs_by_block(spark):
    texts = [
        "<?php\nfunction f() {\nif ($a) {\nreturn 1;\n$b = 2;\n$c = 3;\n}\nthrow new E();\n$d = 4;\n}",  # one a block
        "<?php\nfunction f() {\nswitch ($a) {\ncase 1: return 1;\ncase 2: return 2;\n$b = 1;\n}\nif ($a) return 1;\n$b = 2;\n}",  # a label ends what came before
        "<?php\nreturn 1;\n$a = 2;",  # not in a callable
        "<?php\nfunction f() {\n$g = function () {\nexit;\n$b = 1;\n};\n}",
    ]
    assert [x[0::2][:2] for x in found(spark, *texts, rule="waste.unreachable-code")] == [("0", 5), ("0", 9), ("1", 6), ("3", 5)]
    texts = ["<?php function f() { $a = g(); return $a; }", "<?php function f() { $a = g(); return $b; }", "<?php function f() { $a .= g(); return $a; }", "<?php function f() { $b = 1; $a = g(); return $a; }", "<?php function f() { $a = g(); if ($a) { } return $a; }"]
    assert [x[0] for x in found(spark, *texts, rule="waste.redundant-variable")] == ["0"]
    texts = ["<?php function f() { switch ($a) { case 1: return 1; case 2: return 2; case 3: return 3; } }", "<?php function f() { switch ($a) { case 1: case 2: return 2; case 3: return 3; case 4: return 4; } }", "<?php function f() { switch ($a) { case 1: return 1; case 2: return 2; } }", "<?php function f() { switch ($a) { case 1: if ($b) { return 1; } case 2: return 2; case 3: return 3; } }"]
    assert [x[0] for x in found(spark, *texts, rule="modernisation.match-expression-candidate")] == ["0"]


def test_shapes_group_renamed_variables_but_not_another_order(spark):
    method = lambda name, body: f"public function {name}() {{ {body} }}\n"
    one, two, other = "$a = new X(1); $this->assertSame(1, $a->b());", "$zz = new X('q');\n $this->assertSame('r', $zz->b());", "$this->assertSame(1, $a->b()); $a = new X(1);"
    unit = lambda *bodies: "<?php class T {\n" + "".join(method(f"test{i}", b) for i, b in enumerate(bodies)) + "}"
    provided = unit(one, two, one).replace("public function test1", "/** @dataProvider rows */ public function test1")
    rule = "test-quality.repeated-structure-missing-data-provider"
    assert [x[0::3] for x in found(spark, unit(one, two, one), unit(one, two, other), provided, unit(*["$a = 1;"] * 3), rule=rule)] == [("0", 3)]


def test_metrics_of_a_large_method(spark):
    body = "".join(f"$v{i} = $w{i} + f($x{i}, {i});\n" for i in range(200))
    rows = {x[1]: x[3] for x in found(spark, f"<?php\nfunction f() {{\n{body}}}")}
    # per line: =, +, call of a function; two variables and one more, a number
    import math

    n = 200 * (3 + 4)
    assert rows["complexity.halstead-volume"] == math.floor(n * math.log2(3 + 600 + 1))
    assert rows["size.method-length"] == 200


def test_segments_of_odd_texts(spark):
    texts = [None, "", "\n\n", "}}}{", "<?php function f( {", "x" * 100_000, "<?php\n/* { */ $a = ';{'; # }\n$b = \"{$c;}\";"]
    rows = statements.segments(spark.createDataFrame([(str(i), x) for i, x in enumerate(texts)], UNITS)).collect()
    assert [(r["line"], r["depth"]) for r in sorted(rows, key=lambda r: r["seq"]) if r["file"] == "6"] == [(2, 0), (3, 0)]
    assert not [r for r in rows if r["file"] in ("0", "1", "2")]
    assert statements.callables(statements.segments(spark.createDataFrame([("a", texts[4])], UNITS))).count() == 0


def test_a_file_of_many_lines(spark):
    """Work grows with the lines: each segment meets its block by windows, not by pairs."""
    body = "if ($a) { $b = 1; }\n" * 30_000
    rows = statements.function_metrics(statements.segments(spark.createDataFrame([("big.php", f"<?php\nfunction f($a) {{\n{body}}}\n")], UNITS))).collect()
    assert [(r["statement_lines"], r["cognitive"], r["end_line"]) for r in rows] == [(30_000, 30_000, 30_003)]


FLOWS = [
    ("$a = $_GET['a']; header($a);", ["header-injection"]),
    ("$a = $_GET['a']; $a = 'x'; header($a);", []),
    ("$a = $_GET['a']; $a .= 'x'; header($a);", ["header-injection"]),
    ("$a = 'x'; $a .= $_GET['a']; header($a);", ["header-injection"]),
    ("header($a); $a = $_GET['a'];", []),
    ("$a = $_GET['a']; $b = trim($a); $c = $b; header($c);", ["header-injection"]),
    ("$a = $_ENV['a']; header($a);", []),
    ("$a = '$_GET'; header($a); header('$a');", []),
    ("$a = $_GET['a']; header(\"X: $a\");", ["header-injection"]),
    ("$a = $_GET['a']; $f = function () { header($a); };", []),
    ("$a = $_GET['a']; $this->header($a); Foo::header($a);", []),
    ("$a = htmlspecialchars($_GET['a']); echo $a;", []),
    ("$a = $_GET['a']; echo (int) $a; print htmlentities($a); echo $a;", ["reflected-xss"]),
    ("rename('a', $_POST['b']); copy($_POST['c'], 'd');", ["path-traversal-file-access"]),
    ("fopen($a, $_GET['mode']);", []),
    ("file_get_contents('https://x/' . $_GET['a']);", ["request-controlled-url"]),
    ("$c->request('GET', 'https://x/' . $_GET['a']); $c->get($_GET['a']);", ["request-controlled-url"]),
    ("exec($a); exec('ls ' . $a);", ["process-command-construction"]),
    ("new Process([$_GET['a']]);", ["process-command-construction"]),
    ("$x = new XMLReader(); $x->open($_GET['a']); $y->open($_GET['a']);", ["unsafe-xml-loading"]),
    ("$x = new XMLReader(); $x = new Other(); $x->open($_GET['a']);", []),
    ("simplexml_load_string($_POST['x'], 'S', LIBXML_NONET);", []),
    ("compact($_GET['a']);", ["extract-compact-user-input"]),
    ("$q = 'SELECT a FROM b WHERE c = ' . $d; $db->query($q); $q = 'none';", ["sql-concatenation"]),
    ("$q = \"SELECT {$wpdb->prefix}a\"; $db->query($q); $db->query('SELECT 1'); $db->query('hello ' . $a);", []),
    ("$p = 'a.php'; include $p; require __DIR__ . '/b.php'; require_once BASE . 'c.php';", []),
    ("$p = 'a.php'; $p = $x; include $p;", ["variable-include"]),
]


def test_flow_by_hand(spark):
    texts = [(f"{i:02d}", f"<?php\nfunction f($d) {{ {body} }}") for i, (body, _) in enumerate(FLOWS)]
    rows = flow.flow_findings(spark.createDataFrame(texts, UNITS)).collect()
    held = {f"{i:02d}": [] for i in range(len(FLOWS))}
    for r in rows:
        held[r["file"]].append(r["rule_id"].removeprefix("security."))
    assert {k: sorted(v) for k, v in held.items()} == {f"{i:02d}": sorted(x) for i, (_, x) in enumerate(FLOWS)}


def test_file_scope_follows_variables_to_output_only(spark):
    rows = flow.flow_findings(spark.createDataFrame([("a", "<?php\n$a = $_GET['a'];\nheader($a);\necho $a;\nheader($_GET['b']);")], UNITS)).collect()
    assert sorted((r["line"], r["rule_id"]) for r in rows) == [(4, "security.reflected-xss"), (5, "security.header-injection")]


def test_last_before_by_key_and_place(spark):
    uses = spark.createDataFrame([(1, "a", 5), (2, "a", 1), (3, "b", 9), (4, None, 3)], "id int, k string, at int")
    values = spark.createDataFrame([("a", 1, "x"), ("a", 4, "y"), ("a", 4, "z"), ("a", 5, "late"), (None, 2, "n")], "k string, at int, v string")
    assert {r["id"]: r["v"] for r in asof.last_before(uses, values, ("k",), "at", ("v",)).collect()} == {1: "z", 2: None, 3: None, 4: "n"}


def test_segments_are_dealt_out_once(spark):
    """What groups or orders the written segments by file takes them from their bucket."""
    units = spark.createDataFrame([(f"{i}.php", "<?php\nclass A {\n function f($a) { if ($a) { return 1; } return 2; }\n}\n") for i in range(20)], UNITS)
    rows = statements.staged_segments(units)
    plans = [found._jdf.queryExecution().executedPlan().toString() for found in (statements.function_metrics(rows), statements.callables(rows), statements.statement_findings(units))]
    assert all("Window" in plan for plan in plans[:2]) and not any("Exchange hashpartitioning(file#" in plan for plan in plans[:2])
    assert not re.search(r"Exchange hashpartitioning\(file#\d+, \d+\)", plans[2])
    assert rows.count() == statements.segments(units).count()
    assert sorted(map(str, rows.collect())) == sorted(map(str, statements.segments(units).collect()))
    assert rows.sparkSession.catalog.listTables() == []
