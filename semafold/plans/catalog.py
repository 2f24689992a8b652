"""Asking for meanings: models say which semantic type each column has, and a request for types becomes joins.

A catalog holds models (tables with typed columns), lookups (models that are keyed by @Id types) and inheritance
between types. `find` gives rows of a model from every source of it; `project` gives each output field by its type. A type that
the rows do not carry is looked up: the shortest chain of lookups, each keyed by types already at hand or computed from
them, becomes left joins. All of it happens on names, before anything runs; what runs is one lazy DataFrame for Catalyst to plan.

One rule for ambiguity: a type that several columns have, and none of them exactly, is not at hand. It can't be projected,
tested or used as a key. A field without an answer is null of the type's kind, or an error if the projection is strict.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semafold.functions.signatures import Function
from semafold.operators.joins import lookup, union_sources
from semafold.operators.logic import COMPARE

Criterion = tuple[str, str, object]


class Unanswered(LookupError):
    """A required type that nothing at hand or in the catalog answers."""


@dataclass(frozen=True)
class Model:
    """types: column -> semantic type. key: the @Id type, or several that a lookup needs together. unique: the key has one row;
    otherwise the first match answers, by `order` or else by all columns. operators: those that its source can filter by."""

    name: str
    frame: DataFrame
    types: dict[str, str]
    key: str | tuple[str, ...] | None = None
    order: tuple[str, ...] = ()
    unique: bool = False
    operators: frozenset[str] = frozenset(COMPARE)

    @property
    def keys(self) -> tuple[str, ...]:
        return () if self.key is None else (self.key,) if isinstance(self.key, str) else self.key

    def column(self, type_: str) -> str | None:
        found = [c for c, t in self.types.items() if t == type_]
        return found[0] if len(found) == 1 else None

    @property
    def lookups(self) -> bool:
        return bool(self.keys) and all(self.column(k) for k in self.keys)


@dataclass
class Catalog:
    models: list[Model] = field(default_factory=list)
    parents: dict[str, str] = field(default_factory=dict)
    computed: dict[str, tuple[tuple[str, ...], Callable[..., Column]]] = field(default_factory=dict)
    closed: set[str] = field(default_factory=set)
    formats: dict[str, str] = field(default_factory=dict)

    def add(self, *models: Model) -> Catalog:
        self.models += models
        return self

    def inherits(self, child: str, parent: str) -> Catalog:
        self.parents[child] = parent
        return self

    def expression(self, type_: str, needs: tuple[str, ...], of: Callable[..., Column]) -> Catalog:
        """A type that is computed from others wherever it is asked for, or needed as a key, and not at hand."""
        self.computed[type_] = (needs, of)
        return self

    def function(self, f: Function) -> Catalog:
        """A type that a declared function gives wherever what it takes is at hand."""
        return self.expression(f.gives, f.takes, f)

    def close(self, type_: str) -> Catalog:
        """Objects of a closed type come from a source as they are; they are never built from parts."""
        self.closed.add(type_)
        return self

    def declare_format(self, type_: str, format_: str) -> Catalog:
        self.formats[type_] = format_
        return self

    def lineage(self, type_: str) -> Iterable[str]:
        """A type and its supertypes, nearest first."""
        while type_ is not None:
            yield type_
            type_ = self.parents.get(type_)

    def is_a(self, child: str, parent: str) -> bool:
        return parent in self.lineage(child)

    def format_of(self, type_: str) -> str | None:
        """The format that a type or its nearest supertype declares."""
        return next((self.formats[t] for t in self.lineage(type_) if t in self.formats), None)

    def null(self, type_: str) -> Column:
        """Null of the kind that columns of the type have; a string if none has it."""
        kind = next((m.frame.schema[c].dataType for m in self.models for c, t in m.types.items() if self.is_a(t, type_)), None)
        return F.lit(None).cast(kind or "string")

    def find(self, name: str, first_source: bool = False, where: Iterable[Criterion] = ()) -> Rows:
        """Rows of every source of a model or of its subtypes; of the first one only if first_source.

        where: criteria (type, operator, value). A source answers if it has every type they name and its source can filter
        by every operator; columns that only some of the answering sources have are null in the others."""
        where = list(where)
        sources = [m for m in self.models if self.is_a(m.name, name)]
        able = [m for m in sources if all(op in m.operators and Rows(self, m.frame, m.types).at_hand(t) for t, op, _ in where)]
        if not able:
            raise KeyError(f"no source of {name}" + (f" that can filter by {[t for t, _, _ in where]}" if sources else ""))
        rows = []
        for m in able[:1] if first_source else able:
            found = Rows(self, m.frame, dict(m.types))
            for criterion in where:
                found = found.where(*criterion)
            rows.append(found)
        if len(rows) == 1:
            return rows[0]
        frames = []
        for r in rows:
            own = {t: c for t in dict.fromkeys(r.types.values()) if (c := r.one(t))}
            frames.append(r.frame.select(*[F.col(c).alias(t) for t, c in own.items()]))
        return Rows(self, union_sources(frames), {t: t for f in frames for t in f.columns})

    def reachable(self, types: set[str]) -> set[str]:
        """Types that lookups and expressions lead to from those at hand."""
        found, grew = set(types), True
        while grew:
            more = {t for m in self.models if m.lookups and all(any(self.is_a(x, k) for x in found) for k in m.keys) for t in m.types.values()}
            more |= {t for t, (needs, _) in self.computed.items() if set(needs) <= found}
            grew = not more <= found
            found |= more
        return found


@dataclass
class Rows:
    """A frame whose columns have semantic types."""

    catalog: Catalog
    frame: DataFrame
    types: dict[str, str]

    def columns(self, type_: str) -> list[str]:
        exact = [c for c, t in self.types.items() if t == type_]
        return exact or [c for c, t in self.types.items() if self.catalog.is_a(t, type_)]

    def one(self, type_: str) -> str | None:
        """The one column of a type; none if there are several."""
        found = self.columns(type_)
        return found[0] if len(found) == 1 else None

    def at_hand(self, type_: str) -> bool:
        """Whether a column has the type, or an expression of what is at hand gives it."""
        if self.columns(type_):
            return self.one(type_) is not None
        return type_ in self.catalog.computed and all(self.at_hand(t) for t in self.catalog.computed[type_][0])

    def where(self, type_: str, op: str, value: object) -> Rows:
        """Criteria by type; no or several columns of the type are an error."""
        if not self.at_hand(type_):
            raise ValueError(f"{type_} is not one column here: {self.columns(type_)}")
        column = self.column(type_)
        test = {"==": column == F.lit(value), "!=": column != F.lit(value)}[op] if op in ("==", "!=") and value is not None else COMPARE[op](column, F.lit(value))
        return Rows(self.catalog, self.frame.filter(test), self.types)

    def filter(self, test: Column) -> Rows:
        return Rows(self.catalog, self.frame.filter(test), self.types)

    def given(self, **facts: tuple[str, object]) -> Rows:
        """Facts (name -> type, value) that every row sees."""
        frame = self.frame.withColumns({name: F.lit(value) for name, (_, value) in facts.items()})
        return Rows(self.catalog, frame, self.types | {name: type_ for name, (type_, _) in facts.items()})

    def request(self, name: str, type_: str, fields: dict[str, str]) -> Rows:
        """With an object of facts, such as a lookup's parameter, whose fields are found by their types."""
        rows = self
        for t in fields.values():
            rows = rows.enrich(t)
        return Rows(rows.catalog, rows.frame.withColumn(name, F.struct(*[rows.column(t).alias(k) for k, t in fields.items()])), rows.types | {name: type_})

    def enrich(self, type_: str) -> Rows:
        """With a column of the type, by the shortest chain of lookups; as it is if there is none."""
        if self.columns(type_):
            return self
        if type_ in self.catalog.computed:
            rows = self
            for need in self.catalog.computed[type_][0]:
                rows = rows.enrich(need)
            return rows
        queue, seen = deque([(self.types, ())]), set()
        while queue:
            types, path = queue.popleft()
            for m in self.catalog.models:
                if not m.lookups or m.name in path or not all(Rows(self.catalog, self.frame, types).at_hand(k) for k in m.keys):
                    continue
                steps = (*path, m)
                if any(self.catalog.is_a(t, type_) for t in m.types.values()):
                    rows = self
                    for step in steps:
                        rows = rows._join(step)
                    return rows
                names = frozenset(x.name for x in steps)
                if names not in seen:
                    seen.add(names)
                    queue.append((types | {f"{m.name}__{c}": t for c, t in m.types.items() if t not in types.values()}, steps))
        return self

    def _join(self, m: Model) -> Rows:
        """Rows stay: the first match answers unless the key is known to have one row."""
        keys = {k: m.column(k) for k in m.keys}
        brought = {c: t for c, t in m.types.items() if c not in keys.values() and t not in self.types.values()}
        names = {c: f"{m.name}__{c}" for c in brought}
        left, on, made = self.frame, {}, []
        for k, c in keys.items():
            own = self.one(k)
            if own is None:  # computed from what is at hand
                own = f"{m.name}__by_{len(made)}"
                made.append(own)
                left = left.withColumn(own, self.column(k))
            on[own] = c
        spare = [c for c in m.order if c not in (*keys.values(), *brought)]
        right = m.frame.select(*[F.col(c) for c in keys.values()], *[F.col(c).alias(n) for c, n in names.items()], *spare)
        first = [names.get(c, c) for c in m.order] or [c for c in names.values() if not m.unique and not right.schema[c].dataType.simpleString().startswith("map")]
        frame = lookup(left, right, on, first or None if not m.unique or m.order else None)
        return Rows(self.catalog, frame.drop(*spare, *made), self.types | {names[c]: t for c, t in brought.items()})

    def column(self, type_: str) -> Column:
        """The one column of a type; its expression if the type has one; null of its kind if there are several or none."""
        found = self.one(type_)
        if found is not None:
            return F.col(found)
        if self.at_hand(type_):
            needs, of = self.catalog.computed[type_]
            return of(*[self.column(t) for t in needs])
        return self.catalog.null(type_)

    def build(self, model: str) -> Column:
        """An object of a model from what is at hand; null if the model's type is closed."""
        fields = next(m.types for m in self.catalog.models if m.name == model)
        built = F.struct(*[self.column(t).alias(c) for c, t in fields.items()])
        return F.when(F.lit(model not in self.catalog.closed), built)

    def project(self, fields: dict, strict: bool = False) -> DataFrame:
        """Output field -> type, a function of the rows that gives a Column, or a nested dict for a child object.

        strict: a field whose type has no answer raises Unanswered; otherwise it is null."""

        def wanted(spec: dict) -> list[str]:
            return [t for v in spec.values() for t in (wanted(v) if isinstance(v, dict) else [v] if isinstance(v, str) else [])]

        rows = self
        for type_ in wanted(fields):
            rows = rows.enrich(type_)
        missing = [t for t in wanted(fields) if not rows.at_hand(t)]
        if strict and missing:
            raise Unanswered(f"no answer for {missing}")

        def built(spec: dict) -> list[Column]:
            return [(F.struct(*built(v)) if isinstance(v, dict) else v(rows) if callable(v) else rows.column(v)).alias(k) for k, v in spec.items()]

        return rows.frame.select(*built(fields))
