"""Settings and rule files: load, merge, check and compile, on the driver."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.rules import Rule

# What settings may be, by section.
RANGES = {"speed": (0.5, 2.0), "pitch": (0.5, 2.0)}
CHOICES = {"sample_rate": (16000, 22050, 44100, 48000), "format": ("wav", "mp3"), "text_format": ("plain", "ssml", "json"), "engine": ("kokoro", "elevenlabs", "hume")}
SECTIONS = {
    "tts": {"engine": "engine", "speed": "speed", "pitch": "pitch", "sample_rate": "sample_rate", "output_format": "format"},
    "output": {"text_format": "text_format"},
    "chapters": {"min_words_per_chapter": "min_words", "max_words_per_chunk": "max_words"},
    "processing": {"max_parallel_jobs": "max_jobs"},
}


def merged(base: dict, custom: dict) -> dict:
    """custom over base; dictionaries merge, anything else replaces."""
    out = dict(base)
    for key, value in custom.items():
        out[key] = merged(out[key], value) if isinstance(out.get(key), dict) and isinstance(value, dict) else value
    return out


def problems(settings: dict) -> list[str]:
    found = [f"{k} must be between {a} and {b}" for k, (a, b) in RANGES.items() if k in settings and not a <= settings[k] <= b]
    found += [f"{k} must be one of {v}" for k, v in CHOICES.items() if k in settings and settings[k] not in v]
    low, high = settings.get("min_words", 1), settings.get("max_words", 5000)
    found += (["min_words must be at least 1"] if low < 1 else []) + (["max_words is below min_words"] if high < low else [])
    return found + (["max_jobs must be at least 1"] if settings.get("max_jobs", 1) < 1 else [])


def _unless(allowed: Column, name: str) -> Column:
    return F.when(~allowed, name)


def invalid(columns: Mapping[str, Column]) -> Column:
    """problems() for rows of settings: the names of those that aren't allowed, in the order of SECTIONS. columns has the names that problems() knows; nulls are allowed."""
    own = {name: path for keys in SECTIONS.values() for path, name in keys.items()}
    order = [name for keys in SECTIONS.values() for name in keys.values()]
    found = []
    for name in sorted(columns, key=order.index):
        c = columns[name]
        if name in RANGES:
            found.append(_unless(c.between(*RANGES[name]), own[name]))
        elif name in CHOICES:
            found.append(_unless(c.isin(*CHOICES[name]), own[name]))
        elif name == "max_words":
            found.append(_unless(c >= columns["min_words"], own[name]))
        else:
            found.append(_unless(c >= 1, own[name]))
    return F.array_compact(F.array(*found))


def flat(settings: Mapping) -> dict:
    """The values that problems() knows, out of their sections."""
    return {name: settings[s][k] for s, keys in SECTIONS.items() for k, name in keys.items() if k in (settings.get(s) or {})}


def read(path: str) -> dict:
    """A YAML or JSON file as a dictionary, empty files included. A missing file raises FileNotFoundError, a broken one ValueError."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        import yaml
    except ModuleNotFoundError:  # JSON is YAML too
        return (json.loads(text) if text.strip() else None) or {}
    try:
        return yaml.safe_load(text) or {}
    except yaml.YAMLError as e:
        raise ValueError(f"{path}: {e}") from e


def load(default: str, custom: str | None = None) -> dict:
    """The default settings with the custom file's over them; settings that aren't allowed raise ValueError with all problems."""
    settings = merged(read(default), read(custom) if custom else {})
    if found := problems(flat(settings)):
        raise ValueError("; ".join(found))
    return settings


def spark_pattern(pattern: str) -> str:
    """A rule file's pattern in the subset that rules are written in: digits and white space of all scripts."""
    out, within, k = [], False, 0
    while k < len(pattern):
        two = pattern[k : k + 2]
        if two in (r"\d", r"\s"):
            inner = r"\p{Nd}" if two == r"\d" else "<S>"
            out.append(inner if within or two == r"\d" else f"[{inner}]")
            k += 2
        elif two[0] == "\\":
            out.append(two)
            k += 2
        else:
            within = two[0] == "[" or (within and two[0] != "]")
            out.append(two[0])
            k += 1
    return "".join(out)


def compiled(rules: Mapping) -> tuple[dict[str, list[Rule]], list[str]]:
    """Rules of each group (remove, transform, chapters) and the problems of those that can't be; a bad rule is left out, the others stay.

    A rule is multiline only if it says so; chapter patterns always are, and ignore case.
    """
    groups: dict[str, list[Rule]] = {}
    found: list[str] = []
    cleaning = rules.get("cleaning_rules") or {}
    listed = [(group, r, r.get("name", "unnamed"), bool(r.get("multiline", False)), False) for group in ("remove", "transform") for r in cleaning.get(group) or ()]
    listed += [("chapters", {"pattern": p}, p, True, True) for p in (rules.get("chapter_detection") or {}).get("patterns") or ()]
    for group, rule, name, multiline, ignore_case in listed:
        try:
            re.compile(rule["pattern"])
            groups.setdefault(group, []).append(Rule(spark_pattern(rule["pattern"]), rule.get("replacement", ""), multiline, ignore_case=ignore_case))
        except (re.error, KeyError, TypeError) as e:
            found.append(f"Pattern {name}: {e}")
    characters = cleaning.get("tts_replacements") or {}
    if characters:
        groups["characters"] = [Rule(a, b, literal=True) for a, b in characters.items()]
    return groups, found
