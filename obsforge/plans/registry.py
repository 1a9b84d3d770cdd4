"""Registries of semantic conventions: groups of attributes, entities and metrics, resolved to flat tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..errors import InvalidInput


@dataclass
class Registry:
    """Attributes, entities and metrics by name, each as a dict; entities and metrics list their attributes with roles and levels."""

    namespace: str
    attributes: dict[str, dict] = field(default_factory=dict)
    entities: dict[str, dict] = field(default_factory=dict)
    metrics: dict[str, dict] = field(default_factory=dict)

    def attribute_frame(self, spark: SparkSession) -> DataFrame:
        """``name``, ``type``, ``brief``, ``stability``, ``deprecated`` and ``members`` (of an enumeration)."""
        rows = [(k, a["type"], a.get("brief", ""), a.get("stability"), a.get("deprecated") is not None, a.get("members", [])) for k, a in sorted(self.attributes.items())]
        return spark.createDataFrame(rows, "name string, type string, brief string, stability string, deprecated boolean, members array<string>")

    def entity_frame(self, spark: SparkSession) -> DataFrame:
        """``entity``, ``attribute``, ``role`` (identifying or descriptive) and ``level``, inherited ones included."""
        rows = [(n, a["key"], a["role"], a["level"]) for n, e in sorted(self.entities.items()) for a in e["attributes"]]
        return spark.createDataFrame(rows, "entity string, attribute string, role string, level string")

    def metric_frame(self, spark: SparkSession) -> DataFrame:
        """``metric``, ``instrument``, ``unit``, ``attributes`` and ``entities``."""
        rows = [(n, m.get("instrument", ""), m.get("unit", ""), [a["key"] for a in m["attributes"]], m.get("entities", [])) for n, m in sorted(self.metrics.items())]
        return spark.createDataFrame(rows, "metric string, instrument string, unit string, attributes array<string>, entities array<string>")


def _type(spec: dict) -> tuple[str, list[str]]:
    kind = spec.get("type")
    if isinstance(kind, dict):
        return "enum", [str(m["value"]) for m in kind.get("members", [])]
    return kind, []


def _level(spec: dict) -> str | None:
    level = spec.get("requirement_level")
    return next(iter(level)) if isinstance(level, dict) else level


def resolve(doc: dict, depends: Sequence[Registry] = ()) -> Registry:
    """A registry document as flat tables, or an error that tells all that is wrong with it.

    ``doc`` has ``namespace`` and ``groups``, each with ``id``, ``type`` (``attribute_group``,
    ``entity``, ``metric``) and ``attributes``: definitions (``id``) or references (``ref``), which take
    what they do not say from the definition, here or in the registries it depends on, in order.
    A group that ``extends`` another has its attributes too; its own come first.
    """
    groups, wrong = {}, []
    for g in doc.get("groups", []):
        if not g.get("id") or g["id"] in groups:
            wrong.append(f"group {g.get('id')!r} without an id, or twice")
        else:
            groups[g["id"]] = g
    out = Registry(doc.get("namespace", ""))
    for g in groups.values():
        for a in g.get("attributes", []):
            if "id" in a:
                kind, members = _type(a)
                if a["id"] in out.attributes or not kind:
                    wrong.append(f"attribute {a['id']!r} twice, or without a type")
                else:
                    out.attributes[a["id"]] = {"type": kind, "members": members, "brief": a.get("brief", ""), "stability": a.get("stability"), "deprecated": a.get("deprecated"), "group": g["id"]}
    by_name = {g.get("name"): i for i, g in groups.items() if g.get("type") == "entity"}

    def chain(group: dict) -> list[dict]:
        """A group and those that it extends, one after the other."""
        found, at = [], group
        while at is not None and at not in found:
            found.append(at)
            above = at.get("extends")
            nxt = groups.get(above) or groups.get(by_name.get(above, ""))
            if above and nxt is None:
                wrong.append(f"group {at['id']!r} extends {above!r}, which is not there")
            at = nxt if above else None
        if at is not None:
            wrong.append(f"group {group['id']!r} extends itself")
        return found

    def definition(key: str) -> dict | None:
        return out.attributes.get(key) or next((r.attributes[key] for r in depends if key in r.attributes), None)

    def members(group: dict) -> list[dict]:
        found: dict[str, dict] = {}
        for g in chain(group):
            for a in g.get("attributes", []):
                key = a.get("id") or a.get("ref")
                if definition(key or "") is None:
                    wrong.append(f"group {g['id']!r} refers to {key!r}, which nothing defines")
                else:
                    found.setdefault(key, {"key": key, "role": a.get("role", "descriptive"), "level": _level(a)})
        return list(found.values())

    for g in groups.values():
        attributes = members(g)
        if g.get("type") == "entity":
            if not any(a["role"] == "identifying" for a in attributes):
                wrong.append(f"entity {g.get('name')!r} has nothing that identifies it")
            out.entities[g.get("name") or g["id"]] = {"attributes": attributes, "brief": g.get("brief", ""), "extends": g.get("extends")}
        elif g.get("type") == "metric":
            out.metrics[g.get("metric_name") or g["id"]] = {"attributes": attributes, "instrument": g.get("instrument", ""), "unit": g.get("unit", ""), "entities": list(g.get("entity_associations", []))}
    known = {*out.entities, *(e for r in depends for e in r.entities)}
    for name, m in out.metrics.items():
        wrong += [f"metric {name!r} describes {e!r}, which is no entity" for e in m["entities"] if e not in known]
    if wrong:
        raise InvalidInput("; ".join(dict.fromkeys(wrong)))
    return out


def metrics_of(registry: Registry, entity: str) -> list[str]:
    return sorted(n for n, m in registry.metrics.items() if entity in m["entities"])


def roles_of(registry: Registry, attribute: str) -> list[tuple[str, str]]:
    """The entities that an attribute plays a role in."""
    return sorted((n, a["role"]) for n, e in registry.entities.items() for a in e["attributes"] if a["key"] == attribute)
