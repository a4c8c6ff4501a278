"""Paradigms from YAML or JSON files: loading, checking, and what is filled in by rule."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from typing import Any

from corpusloom.operators.gaps import Paradigm

# What a paradigm must have, and how many types and relations it may have.
REQUIRED = ("paradigm_id", "name", "description", "types", "relations", "relation_map")
TYPES, RELATIONS = (2, 8), (2, 6)
TYPE_KEY, RELATION_KEY = re.compile("[a-z_]+"), re.compile("[A-Z_]+")


def read_paradigms(path: str) -> dict[str, dict[str, Any]]:
    """Configurations by id from a YAML (or JSON) file of a few kilobytes, read by the driver.

    The file maps ids to configurations, by itself or under "paradigms".
    """
    with open(path, encoding="utf-8") as f:
        raw = f.read()
    if path.endswith(".json"):
        data = json.loads(raw)
    else:
        import yaml

        data = yaml.safe_load(raw)
    data = (data or {}).get("paradigms", data or {})
    return {str(k): {"paradigm_id": str(k)} | v for k, v in data.items()}


def transitions(config: Mapping[str, Any]) -> dict[tuple[str, str], str]:
    """Relations by (source type, target type); of several between two types the last counts."""
    out: dict[tuple[str, str], str] = {}
    for source, relations in (config.get("relation_map") or {}).items():
        for relation, targets in relations.items():
            out.update(dict.fromkeys(((source, t) for t in targets), relation))
    return out


def _keys(kind: str, items: Any, most: tuple[int, int], key: re.Pattern[str], length: int) -> list[str]:
    if not isinstance(items, Mapping):
        return [f"{kind} must be a mapping"]
    out = [] if most[0] <= len(items) <= most[1] else [f"{kind}: {len(items)} is not between {most[0]} and {most[1]}"]
    for k, label in items.items():
        if not (isinstance(k, str) and key.fullmatch(k)):
            out.append(f"{kind}: key {k!r} is not of the form {key.pattern}")
        if not (isinstance(label, str) and label.strip()):
            out.append(f"{kind}: {k!r} has no label")
        elif len(label) > length:
            out.append(f"{kind}: the label of {k!r} is longer than {length}")
    return out


def type_cycle(relation_map: Mapping[str, Mapping[str, list[str]]]) -> list[str]:
    """Types of a cycle between different types, in order; empty if there is none."""
    after = {s: sorted({t for ts in rel.values() for t in ts if t != s}) for s, rel in relation_map.items()}
    done: set[str] = set()

    def walk(path: list[str]) -> list[str]:
        for t in after.get(path[-1], ()):
            if t in path:
                return [*path[path.index(t) :], t]
            if t not in done and (found := walk([*path, t])):
                return found
        done.add(path[-1])
        return []

    for s in after:
        if s not in done and (found := walk([s])):
            return found
    return []


def checked(config: Mapping[str, Any], existing: frozenset[str] = frozenset()) -> tuple[list[str], dict[str, Any]]:
    """(errors, filled in) of a configuration; nothing is filled in where there are errors.

    Filled in are parent_rules (the types that may stand above each) and, where it is absent,
    ideal_chain (the types in order).
    """
    missing = [f for f in REQUIRED if config.get(f) is None]
    if missing:
        return [f"{f} is missing" for f in missing], {}
    errors = []
    own = config["paradigm_id"]
    if not (isinstance(own, str) and TYPE_KEY.fullmatch(own)):
        errors.append(f"paradigm_id {own!r} is not of the form {TYPE_KEY.pattern}")
    elif own in existing:
        errors.append(f"paradigm_id {own!r} is taken")
    types, relations, rmap = config["types"], config["relations"], config["relation_map"]
    errors += _keys("types", types, TYPES, TYPE_KEY, 50) + _keys("relations", relations, RELATIONS, RELATION_KEY, 20)
    if not isinstance(rmap, Mapping):
        errors.append("relation_map must be a mapping")
    elif isinstance(types, Mapping) and isinstance(relations, Mapping):
        for source, rel in rmap.items():
            if source not in types:
                errors.append(f"relation_map: {source!r} is no type")
            elif not isinstance(rel, Mapping):
                errors.append(f"relation_map: {source!r} must be a mapping")
            else:
                for r, targets in rel.items():
                    if r not in relations:
                        errors.append(f"relation_map: {r!r} is no relation")
                    if not isinstance(targets, list):
                        errors.append(f"relation_map: {source!r} {r!r} must be a list")
                    else:
                        errors += [f"relation_map: {t!r} is no type" for t in targets if t not in types]
        if not errors and not config.get("cyclic") and (ring := type_cycle(rmap)):
            errors.append("types form a cycle: " + " > ".join(ring))
    if errors:
        return errors, {}
    rules = {t: sorted({s for (s, to) in transitions(config) if to == t and s != t}) for t in types}
    return [], {"parent_rules": rules} | ({} if config.get("ideal_chain") else {"ideal_chain": list(types)})


def paradigm(config: Mapping[str, Any]) -> Paradigm:
    """The paradigm of a configuration; ValueError if its chain or cycle can't be one."""
    cyclic = bool(config.get("cyclic"))
    field = "cycle_pattern" if cyclic else "ideal_chain"
    chain = tuple(str(t).strip() for t in config.get(field) or config.get("types") or ())
    if len(chain) < 2 or any(not t for t in chain):
        raise ValueError(f"{field} needs two types or more")
    if not cyclic and len(set(chain)) != len(chain):
        raise ValueError("ideal_chain holds a type twice")
    if "root_types" in config:
        roots = tuple(config["root_types"] or ())
    else:
        roots = () if cyclic else tuple(t for t, above in (config.get("parent_rules") or {}).items() if isinstance(above, list) and not above)
    return Paradigm(str(config.get("paradigm_id", "")), chain, transitions(config), roots, cyclic)
