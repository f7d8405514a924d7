"""Rulesets: TOML to typed rules, validation, strict and lenient loading."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field
from typing import Any

from ..errors import RulesetError
from .dialect import UnsupportedPattern, compiled

TARGETS = {"secret": "secret", "match": "match", "line": "line"}


@dataclass(frozen=True)
class Allowlist:
    """Suppresses findings: any criterion (or) or all declared ones (and)."""

    regexes: tuple[str, ...] = ()
    paths: tuple[str, ...] = ()
    stopwords: tuple[str, ...] = ()
    target: str = "secret"
    all_of: bool = False
    description: str = ""
    id: str = ""
    target_rules: tuple[str, ...] = ()


@dataclass(frozen=True)
class Rule:
    id: str
    regex: str | None = None
    description: str = ""
    keywords: tuple[str, ...] = ()
    entropy: float | None = None
    path: str | None = None
    secret_group: int | None = None
    allowlists: tuple[Allowlist, ...] = ()
    ord: int = 0


@dataclass
class Ruleset:
    rules: list[Rule]
    allowlists: list[Allowlist] = field(default_factory=list)
    issues: list[str] = field(default_factory=list)

    @property
    def keyworded(self) -> list[Rule]:
        return [r for r in self.rules if r.regex is not None and r.keywords]

    @property
    def unkeyworded(self) -> list[Rule]:
        return [r for r in self.rules if r.regex is not None and not r.keywords]

    @property
    def path_only(self) -> list[Rule]:
        return [r for r in self.rules if r.regex is None and r.path is not None]

    def keyword_index(self) -> dict[str, list[int]]:
        """Lower-case keyword to positions among the keyworded rules."""
        index: dict[str, list[int]] = {}
        for i, r in enumerate(self.keyworded):
            for k in dict.fromkeys(ascii_lower(k) for k in r.keywords):
                index.setdefault(k, []).append(i)
        return index


def ascii_lower(s: str) -> str:
    return s.translate({c: c + 32 for c in range(65, 91)})


def parse(toml: str) -> dict[str, Any]:
    try:
        return tomllib.loads(toml)
    except tomllib.TOMLDecodeError as e:
        raise RulesetError(f"invalid TOML: {e}") from e


def _patterns(patterns: list, what: str, issues: list[str]) -> tuple[str, ...]:
    kept = []
    for p in patterns:
        try:
            compiled(p)
            kept.append(p)
        except UnsupportedPattern as e:
            issues.append(f"{what}: {e}")
    return tuple(kept)


def _allowlist(raw: dict, what: str, issues: list[str]) -> Allowlist:
    condition = str(raw.get("condition", "OR")).lower()
    target = str(raw.get("regexTarget", "secret")).lower()
    if condition not in ("or", "and", "||", "&&"):
        raise RulesetError(f"{what}: unknown condition {condition}")
    if target not in TARGETS:
        raise RulesetError(f"{what}: unknown regexTarget {target}")
    return Allowlist(
        _patterns(raw.get("regexes", []), f"{what} regex", issues),
        _patterns(raw.get("paths", []), f"{what} path", issues),
        tuple(w.lower() for w in raw.get("stopwords", [])),
        TARGETS[target],
        condition in ("and", "&&"),
        raw.get("description", ""),
        raw.get("id", ""),
        tuple(raw.get("targetRules", [])),
    )


def from_config(config: dict[str, Any]) -> Ruleset:
    """Lenient: what can't be used is left out and reported."""
    issues: list[str] = []
    rules: list[Rule] = []
    for n, raw in enumerate(config.get("rules", [])):
        name = raw.get("id", "")
        pattern, group, path = raw.get("regex"), raw.get("secretGroup"), raw.get("path")
        if pattern is not None:
            try:
                groups = compiled(pattern).groups
            except UnsupportedPattern as e:
                issues.append(f"rule {name}: {e}")
                continue
            if group is not None and not 0 <= group <= groups:
                issues.append(f"rule {name}: secretGroup {group} is out of range")
                group = None
        if path is not None:
            try:
                compiled(path)
            except UnsupportedPattern as e:
                issues.append(f"rule {name}: path: {e}")
                path = None
        lists = raw.get("allowlists", []) + ([raw["allowlist"]] if "allowlist" in raw else [])
        entropy = raw.get("entropy")
        rules.append(
            Rule(name, pattern, raw.get("description", ""), tuple(raw.get("keywords", [])), None if entropy is None else float(entropy), path, group or None, tuple(_allowlist(a, f"rule {name} allowlist", issues) for a in lists), n)
        )
    lists = config.get("allowlists", []) + ([config["allowlist"]] if "allowlist" in config else [])
    return Ruleset(rules, [_allowlist(a, "global allowlist", issues) for a in lists], issues)


def validate(config: dict[str, Any]) -> list[str]:
    """Everything that is wrong with a ruleset; an empty ruleset is valid."""
    found: list[str] = []
    seen: set[str] = set()
    for n, raw in enumerate(config.get("rules", [])):
        name = raw.get("id", "")
        if not str(name).strip():
            found.append(f"rule {n}: empty id")
        elif name in seen:
            found.append(f"rule {name}: duplicate id")
        seen.add(name)
        if raw.get("regex") is None and raw.get("path") is None:
            found.append(f"rule {name}: neither regex nor path")
        if any(not str(k).strip() for k in raw.get("keywords", [])):
            found.append(f"rule {name}: blank keyword")
    try:
        found += [i for i in from_config(config).issues if "secretGroup" not in i]
    except RulesetError as e:
        found.append(str(e))
    return found


def load(toml: str, strict: bool = True) -> Ruleset:
    """A ruleset from TOML; strict raises on anything that lenient loading would leave out."""
    config = parse(toml)
    rules = from_config(config)
    problems = [*dict.fromkeys([*validate(config), *rules.issues])] if strict else []
    if problems:
        raise RulesetError("; ".join(problems))
    return rules
