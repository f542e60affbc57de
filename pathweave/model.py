"""Entity-relationship models: what a query's names mean.

An entity has elements: scalars, structures (stored flat as ``a_b``), calculated ones, associations to other entities. A managed association has
foreign-key columns ``assoc_key``; an unmanaged one has an ``on`` condition. All of this is metadata; rows come from DataFrames.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any


class ModelError(ValueError):
    """A query or model names something that isn't there or may not be used that way."""


@dataclass
class Element:
    name: str
    type: str | None = None
    key: bool = False
    not_null: bool = False
    calc: str | None = None
    virtual: bool = False
    enum: dict[str, Any] | None = None
    elements: dict[str, Element] | None = None
    target: str | None = None
    many: bool = False
    keys: dict[str, str] | None = None  # target key -> suffix of the foreign-key column
    on: str | None = None
    composition: bool = False
    localized: bool = False
    searchable: bool | None = None
    default: Any = None
    on_insert: str | None = None
    on_update: str | None = None
    hidden: bool = False  # made by a query and not part of "*"
    ranking: str | None = None  # HIGH, MEDIUM or LOW: its weight in a search by score

    @property
    def is_assoc(self) -> bool:
        return self.target is not None


@dataclass
class Entity:
    name: str
    elements: dict[str, Element] = field(default_factory=dict)
    source: Callable | None = None  # (engine) -> DataFrame
    query: str | None = None
    params: dict[str, str] = field(default_factory=dict)
    texts: str | None = None
    valid: tuple[str, str] | None = None
    persisted: bool = True  # False: its rows are elsewhere; columns that need them are left out

    def keys(self) -> list[str]:
        """Physical names of the key columns; an association in the key stands for its foreign keys."""
        out = []
        for e in self.elements.values():
            if e.key:
                out += self.fk_columns(e) if e.is_assoc else [n for n, _ in self.leaves(e, e.name)]
        return out

    @staticmethod
    def fk_columns(e: Element, prefix: str = "") -> list[str]:
        return [f"{prefix}{e.name}_{s}" for s in (e.keys or {}).values()]

    def leaves(self, e: Element, path: str):
        """(physical name, element) of what an element stores."""
        if e.elements is not None:
            for c in e.elements.values():
                yield from self.leaves(c, f"{path}_{c.name}")
        elif e.is_assoc:
            for s in (e.keys or {}).values():
                yield f"{path}_{s}", Element(f"{path}_{s}")
        elif not e.virtual:
            yield path, e

    def flat(self) -> dict[str, Element]:
        """Columns of ``*``: no virtual elements, no unmanaged associations, no large binaries."""
        out: dict[str, Element] = {}
        for e in self.elements.values():
            if e.virtual or e.hidden or e.type == "LargeBinary" or (e.is_assoc and not e.keys):
                continue
            out.update(self.leaves(e, e.name))
        return out


class Model:
    """Entities by name."""

    def __init__(self, entities: Mapping[str, Entity] | None = None):
        self.entities = dict(entities or {})

    def entity(self, name: str) -> Entity:
        if name not in self.entities:
            raise ModelError(f'"{name}" not found in the definitions of the model')
        return self.entities[name]

    @staticmethod
    def from_dict(spec: Mapping[str, Mapping]) -> Model:
        """{entity: {"elements": {name: type or settings}, "source": ..., "query": ..., "params": ..., "texts": ...}}.

        A managed association is ``{"target": E}`` with ``keys`` (target key -> suffix) taken from E's key by default.
        """

        def element(name: str, x: Any) -> Element:
            if isinstance(x, str):
                return Element(name, x)
            x = dict(x)
            inner = x.pop("elements", None)
            keys = x.pop("keys", None)
            e = Element(name, **x)
            if inner is not None:
                e.elements = {k: element(k, v) for k, v in inner.items()}
            if keys is not None:
                e.keys = {k: k for k in keys} if not isinstance(keys, Mapping) else dict(keys)
            return e

        m = Model()
        for name, s in spec.items():
            rest = {k: v for k, v in s.items() if k != "elements"}
            m.entities[name] = Entity(name, {k: element(k, v) for k, v in s.get("elements", {}).items()}, **rest)

        def finish(e: Element) -> None:
            if e.is_assoc and not e.keys and e.on is None:
                e.keys = {k: k for k in m.entity(e.target).keys()}
            for c in (e.elements or {}).values():
                finish(c)

        for ent in m.entities.values():
            for e in ent.elements.values():
                finish(e)
        return m
