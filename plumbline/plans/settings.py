"""Settings of rules: presets and files that extend each other, checked before a plan is made.

A layer is a mapping with ``extends`` (names of layers) and ``rules``: rule -> options.
Layers below come first; maps are laid over each other key by key, lists and plain values
are replaced. An option that a rule does not have, or of another type, is an error; a rule
that is not known is a warning with the names nearest to it.
"""

from __future__ import annotations

import difflib
import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from plumbline.plans.catalogue import Selection, all_rules
from plumbline.rules.code import LIMITS
from plumbline.rules.statements import METRIC_LIMITS

MOST_LAYERS = 5
SEVERITIES = ("advisory", "warning", "error")
PRESETS: dict[str, dict] = {
    "all": {},
    "strict": {"rules": {"size.method-length": {"threshold": 50}, "complexity.cognitive": {"threshold": 15}, "complexity.cyclomatic": {"threshold": 10}}},
    "security-only": {"pillars": ["security", "sensitive-data"]},
}


class SettingsError(ValueError):
    """Settings that cannot be meant."""


@dataclass(frozen=True)
class Settings:
    selection: Selection
    limits: dict[str, float]
    severities: dict[str, str]
    warnings: tuple[str, ...] = field(default=())


def overlay(below: Mapping, above: Mapping) -> dict:
    """above laid over below."""
    out = dict(below)
    for key, value in above.items():
        out[key] = overlay(out[key], value) if isinstance(value, Mapping) and isinstance(out.get(key), Mapping) else value
    return out


def resolve(name: str, load: Callable[[str], Mapping], above: tuple[str, ...] = ()) -> dict:
    """A layer with all that it extends below it, the last named on top."""
    if name in above:
        raise SettingsError("settings extend themselves: " + " -> ".join((*above, name)))
    if len(above) >= MOST_LAYERS:
        raise SettingsError(f"more than {MOST_LAYERS} layers: " + " -> ".join((*above, name)))
    layer = load(name)
    if not isinstance(layer, Mapping):
        raise SettingsError(f"{name} is no mapping")
    extended = layer.get("extends", [])
    extended = [extended] if isinstance(extended, str) else extended
    if not isinstance(extended, list) or not all(isinstance(x, str) for x in extended):
        raise SettingsError(f"extends of {name} names layers")
    out: dict = {}
    for other in extended:
        out = overlay(out, resolve(other, load, (*above, name)))
    return overlay(out, {k: v for k, v in layer.items() if k != "extends"})


def _typed(rule: str, option: str, value, limited: bool):
    kinds = {"enabled": bool, "severity": str, **({"threshold": (int, float)} if limited else {})}
    if option not in kinds:
        raise SettingsError(f"{rule} has no option {option}; it has {', '.join(sorted(kinds))}")
    if not isinstance(value, kinds[option]) or isinstance(value, bool) != (option == "enabled"):
        raise SettingsError(f"{option} of {rule} cannot be {value!r}")
    if option == "severity" and value not in SEVERITIES:
        raise SettingsError(f"severity of {rule} is one of {', '.join(SEVERITIES)}")
    if option == "threshold" and not value >= 0:
        raise SettingsError(f"threshold of {rule} is not negative")
    return value


def parse(values: Mapping) -> Settings:
    """Checked settings of resolved layers: pillars, rules."""
    known, limited = all_rules(), {**LIMITS, **METRIC_LIMITS}
    for key in values.keys() - {"pillars", "rules"}:
        raise SettingsError(f"unknown key {key}")
    pillars, rules = values.get("pillars", []), values.get("rules", {})
    if not isinstance(pillars, list) or not isinstance(rules, Mapping):
        raise SettingsError("pillars is a list and rules a map")
    for pillar in pillars:
        if pillar not in {v[0] for v in known.values()}:
            raise SettingsError(f"unknown pillar {pillar}")
    off, limits, severities, warnings = set(), {}, {}, []
    for rule, options in rules.items():
        if rule not in known:
            near = difflib.get_close_matches(rule, known, 3)
            warnings.append(f"unknown rule {rule}" + (f"; did you mean {', '.join(near)}?" if near else ""))
            continue
        if isinstance(options, bool):
            options = {"enabled": options}
        if not isinstance(options, Mapping):
            raise SettingsError(f"options of {rule} are a map or true or false")
        checked = {o: _typed(rule, o, v, rule in limited) for o, v in options.items()}
        if not checked.get("enabled", True):
            off.add(rule)
        limits |= {rule: checked["threshold"]} if "threshold" in checked else {}
        severities |= {rule: checked["severity"]} if "severity" in checked else {}
    return Settings(Selection(pillars=tuple(pillars), disabled=frozenset(off)), limits, severities, tuple(warnings))


def read(spark: SparkSession, path: str) -> Settings:
    """Settings of a JSON file, which may extend presets and files beside it."""
    folder = path.rsplit("/", 1)[0] if "/" in path else "."

    def load(name: str) -> Mapping:
        if name in PRESETS:
            return PRESETS[name]
        at = name if "/" in name else f"{folder}/{name}"
        try:
            return json.loads(spark.read.text(at, wholetext=True).first()[0])
        except json.JSONDecodeError as wrong:
            raise SettingsError(f"{at}: {wrong}") from wrong

    return parse(resolve(path, load))
