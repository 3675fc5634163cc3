"""Folder walk, settings, hierarchy edges and replayed streams."""

import json
import os

import pytest
from pyspark.sql import functions as F

from plumbline.plans import catalogue, settings
from plumbline.rules import hierarchy, statements
from plumbline.sources import files
from plumbline.streaming import incremental


def tree(tmp_path):
    for path in ("a.php", "b/c.md", "b/d/e.php", "b/d/.env", "vendor/x/y.php", "b/node_modules/z.json", "skip/s.md", "b/composer.lock", "b/image.png", ".git/config.ini"):
        at = tmp_path / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(f"text of {path}")
    os.symlink(tmp_path / "b", tmp_path / "again")
    os.symlink(tmp_path, tmp_path / "b" / "circle")
    return f"file://{tmp_path}"


def test_walk_prunes_before_it_enters(spark, tmp_path, monkeypatch):
    root = tree(tmp_path)
    listed = []
    keep = files.staged
    monkeypatch.setattr(files, "staged", lambda df, label: (out := keep(df, label), listed.append(out) if label.count("-") == 1 else None)[0])
    found, ignored = files.walk(spark, root, ["skip/**"])
    paths = {r["path"] for r in found.collect()}
    assert {p.replace("again/", "b/", 1) for p in paths} == {"a.php", "b/c.md", "b/d/e.php", "b/d/.env", "b/image.png"} and len(paths) == 5
    assert {(r["path"].replace("again/", "b/", 1), r["source"]) for r in ignored.collect()} == {("vendor", "default"), ("b/node_modules", "default"), ("skip", "config"), (".git", "default"), ("b/composer.lock", "generated")}
    entries = {r["path"] for one in listed for r in one.collect()}
    assert entries and not [p for p in entries if p.startswith(("vendor/", "skip/", ".git/")) or "node_modules/" in p]
    whole, _ = files.walk(spark, root, ["skip/**"], include_ignored=True)
    assert "vendor/x/y.php" in {r["path"] for r in whole.collect()} and whole.where("path like 'skip%'").count() == 0


def test_tree_as_units(spark, tmp_path):
    units, _ = files.read_tree(spark, tree(tmp_path))
    rows = {r["file"].replace("again/", "b/", 1): (r["type"], r["source"].split()[-1]) for r in units.collect()}
    assert set(rows) == {"a.php", "b/c.md", "b/d/e.php", "b/d/.env", "skip/s.md"} and rows["b/d/.env"] == ("text", "b/d/.env")
    with pytest.raises(Exception):  # noqa: B017
        files.walk(spark, "nowhere://x")
    nothing, _ = files.walk(spark, f"file://{tmp_path}/absent")
    assert nothing.count() == 0


def test_layers_extend_presets_and_each_other(spark, tmp_path):
    layers = {"base.json": {"extends": "strict", "rules": {"complexity.cognitive": {"severity": "warning"}, "size.class-length": False}}, "own.json": {"extends": ["base.json"], "rules": {"size.method-length": {"threshold": 7}, "size.metod-length": {}}}}
    for name, layer in layers.items():
        (tmp_path / name).write_text(json.dumps(layer))
    found = settings.read(spark, f"file://{tmp_path}/own.json")
    assert found.limits == {"size.method-length": 7, "complexity.cognitive": 15, "complexity.cyclomatic": 10} and found.severities == {"complexity.cognitive": "warning"}
    assert found.selection.disabled == {"size.class-length"} and len(found.warnings) == 1 and "size.method-length" in found.warnings[0]
    units = spark.createDataFrame([("a.php", "php", "<?php\nfunction f() {\n" + "$a = 1;\n" * 8 + "}\n")], "file string, type string, source string")
    rule = {"size.method-length"}
    run = lambda **o: [(r["rule_id"], r["value"]) for r in catalogue.analyse(units, catalogue.Selection(rules=tuple(rule)), **o).collect()]
    assert run() == [] and run(limits=found.limits) == [("size.method-length", 8)]


@pytest.mark.parametrize(("layer", "message"), [
    ({"rules": {"size.method-length": {"treshold": 1}}}, "no option"), ({"rules": {"size.method-length": {"threshold": "1"}}}, "cannot be"), ({"rules": {"size.method-length": {"threshold": True}}}, "cannot be"),
    ({"rules": {"size.method-length": {"enabled": 1}}}, "cannot be"), ({"rules": {"waste.unused-import": {"threshold": 1}}}, "no option"), ({"rules": {"size.method-length": {"severity": "fatal"}}}, "one of"),
    ({"pillars": ["no"]}, "unknown pillar"), ({"other": 1}, "unknown key"), ({"rules": []}, "map"), ({"rules": {"size.method-length": {"threshold": -1}}}, "negative"),
])
def test_wrong_settings_are_errors(layer, message):
    with pytest.raises(settings.SettingsError, match=message):
        settings.parse(layer)


def test_chains_of_layers_are_bounded():
    with pytest.raises(settings.SettingsError, match="themselves"):
        settings.resolve("a", {"a": {"extends": "b"}, "b": {"extends": ["a"]}}.__getitem__)
    chain = {str(i): {"extends": str(i + 1), "rules": {"r": {"x": i}}} for i in range(9)} | {"4": {"rules": {"r": {"y": 4}}}}
    assert settings.resolve("0", chain.__getitem__) == {"rules": {"r": {"x": 0, "y": 4}}}
    with pytest.raises(settings.SettingsError, match="more than 5"):
        settings.resolve("0", (chain | {"4": {"extends": "5"}}).__getitem__)


def test_classes_of_odd_files(spark):
    texts = [("one", "<?php class A extends B { function f($a) { return g($a); } }"), ("two", "<?php class B { function f($a) { return g($a); } }"), ("self", "<?php class A extends A { }"), ("none", None), ("deep", "<?php " + "".join(f"class C{i} extends C{i + 1} {{ }} " for i in range(12)) + "class C12 { }")]
    rows = statements.segments(spark.createDataFrame(texts, "file string, source string"))
    found = hierarchy.ancestors(rows)
    assert [tuple(r) for r in found.where("file = 'self'").collect()] == [("self", "A", "A", 1)]  # parents of other files are not known
    assert found.where("file in ('one', 'two')").count() == 0
    assert found.where("file = 'deep'").count() == 12 * 13 // 2 and found.where("file = 'deep'").agg(F.max("distance")).first()[0] == 12
    assert sorted((r["file"], r["symbol"]) for r in hierarchy.one_line_methods(rows).collect()) == [("one", "f"), ("two", "f")]


def test_a_replayed_batch_adds_nothing(spark, tmp_path):
    out, write = f"file://{tmp_path}/once", None
    write = incremental.commit_new(out)
    batch = lambda *keys: spark.createDataFrame([(k, "x") for k in keys], "fingerprint string, v string")
    write(batch("a", "b", "a"), 0)
    write(batch("b", "c"), 1)
    write(batch("b", "c"), 1)
    write(batch("a", "b"), 0)
    write(batch(), 2)
    assert sorted(r["fingerprint"] for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_no_history_counts_as_none(spark, tmp_path):
    (tmp_path / "empty.json").write_text("")
    (tmp_path / "blank.json").write_text("\n \n")
    (tmp_path / "broken.json").write_text("[{")
    for name in ("absent.json", "empty.json", "blank.json"):
        found = files.read_history(spark, f"file://{tmp_path}/{name}")
        assert found.count() == 0 and "score" in found.columns
    with pytest.raises(Exception):  # noqa: B017
        files.read_history(spark, f"file://{tmp_path}/broken.json").collect()


def test_severity_past_high_and_low_limits(spark):
    from plumbline.functions.scores import threshold_severity

    rows = spark.createDataFrame([(v,) for v in (5, 20, 21, 40, 41)], "v int").select(threshold_severity(F.col("v"), 20, 40).alias("high"), threshold_severity(F.col("v"), 40, 20, low=True).alias("low")).collect()
    assert [r["high"] for r in rows] == [None, None, "warning", "warning", "error"]
    assert [r["low"] for r in rows] == ["error", "warning", "warning", None, None]
