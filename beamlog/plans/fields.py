"""Field descriptors: built-in ones, aliases, and a registry of reviewed ones."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace

STRING, INTEGER, FLOAT, DURATION, BOOLEAN, TIME = "string", "integer", "float", "duration", "boolean", "time"
NUMERIC = (INTEGER, FLOAT, DURATION)


@dataclass(frozen=True)
class Descriptor:
    name: str
    type: str = STRING
    sensitivity: str = "sensitive"
    cardinality: str = "high"
    index: str = "none"
    unit: str = ""
    retention: str = "raw"
    known: bool = True
    column: str = ""  # where a table stores the field's typed values, if it does

    def problem(self) -> str | None:
        """Why a reviewed descriptor is not acceptable, if it is not."""
        if self.type not in (STRING, *NUMERIC, BOOLEAN, TIME):
            return f"unknown type {self.type}"
        if self.sensitivity not in ("public", "internal", "sensitive") or self.cardinality not in ("low", "medium", "high"):
            return "unknown sensitivity or cardinality"
        if self.index not in ("none", "exact", "range") or self.retention not in ("raw", "metric", "evidence"):
            return "unknown index or retention"
        return "a high-cardinality field cannot have an exact index" if self.index == "exact" and self.cardinality == "high" else None


# Short names users may write.
ALIASES = {
    "service": "service.id",
    "project": "project.id",
    "environment": "environment.id",
    "route": "http.route",
    "status": "http.status_code",
    "duration": "duration_ns",
}

# Fields stored in columns of their own. All other fields are attributes.
CORE = {
    "service.id": "service_id",
    "project.id": "project_id",
    "environment.id": "environment_id",
    "source.id": "source_id",
    "stream.id": "stream_id",
    "timestamp": "timestamp",
    "name": "name",
    "severity": "severity",
    "body": "body",
    "value": "value",
    "trace_id": "trace_id",
    "span_id": "span_id",
    "correlation_id": "correlation_id",
}

_internal = lambda name, kind, cardinality, index, unit="": Descriptor(name, kind, "internal", cardinality, index, unit)

# Built-in descriptors of every signal, and those of metrics alone.
BUILT_IN = {d.name: d for d in (
    _internal("service.id", STRING, "low", "exact"),
    _internal("project.id", STRING, "low", "exact"),
    _internal("environment.id", STRING, "low", "exact"),
    _internal("timestamp", TIME, "high", "range", "s"),
    _internal("name", STRING, "medium", "exact"),
    _internal("severity", STRING, "low", "exact"),
    _internal("value", FLOAT, "high", "range"),
    _internal("http.route", STRING, "medium", "exact"),
    Descriptor("http.status_code", INTEGER, "public", "low", "exact"),
    _internal("duration_ns", DURATION, "high", "range", "ns"),
    _internal("trace_id", STRING, "high", "range"),
    _internal("span_id", STRING, "high", "range"),
    _internal("correlation_id", STRING, "high", "range"),
    Descriptor("body", STRING, "sensitive", "high", "none"),
)}
METRIC_LOW = ("state", "period", "direction", "unit")
METRIC_MEDIUM = ("interface", "filesystem", "process", "cgroup")
METRIC_ONLY = {n: Descriptor(n, STRING, "internal", "low" if n in METRIC_LOW else "medium", "exact", retention="metric") for n in (*METRIC_LOW, *METRIC_MEDIUM)}
METRIC_DIMENSIONS = (*METRIC_ONLY, "http.route", "http.status_code")


def canonical(name: str) -> str:
    return ALIASES.get(name, name)


@dataclass(frozen=True)
class Registry:
    """Reviewed descriptors by (signal, field); built-in ones always win, unlisted fields are sensitive strings."""

    reviewed: dict[tuple[str, str], Descriptor] = field(default_factory=dict)
    version: int = 1
    rejected: frozenset[tuple[str, str]] = frozenset()
    columns: dict[tuple[str, str], str] = field(default_factory=dict)

    def describe(self, signal: str, name: str) -> Descriptor:
        found = self._describe(signal, canonical(name))
        column = self.columns.get((signal, found.name), "")
        return replace(found, column=column) if column else found

    def held_by(self, columns: Iterable[str]) -> Registry:
        """The registry for a table with these columns: other stored ones are read from the attributes."""
        have = set(columns)
        return replace(self, columns={k: c for k, c in self.columns.items() if c in have})

    def indexed(self) -> list[tuple[str, Descriptor]]:
        """Reviewed fields that ask for an index, with their signals."""
        return [(signal, d) for (signal, _), d in sorted(self.reviewed.items()) if d.index != "none"]

    def _describe(self, signal: str, name: str) -> Descriptor:
        if signal == "metrics" and name in METRIC_ONLY:
            return METRIC_ONLY[name]
        if name in BUILT_IN:
            d = BUILT_IN[name]
            return Descriptor(d.name, d.type, d.sensitivity, d.cardinality, d.index, d.unit, "metric") if signal == "metrics" and name in METRIC_DIMENSIONS else d
        return self.reviewed.get((signal, name), Descriptor(name, known=False))

    def activate(self, signal: str, descriptors: Iterable[Descriptor]) -> Registry:
        """The next version, with all descriptors so far and the given ones."""
        for d in descriptors:
            if problem := d.problem():
                raise ValueError(f"{d.name}: {problem}")
        fresh = {(signal, d.name): d for d in descriptors}
        return Registry(self.reviewed | fresh, self.version + 1, self.rejected - set(fresh), self.columns)

    def reject(self, signal: str, names: Iterable[str]) -> Registry:
        """The same version with proposals turned down: they are not proposed again, and their fields stay unreviewed."""
        turned = {(signal, canonical(n)) for n in names}
        if known := sorted(n for s, n in turned if (s, n) in self.reviewed or n in BUILT_IN):
            raise ValueError(f"in use, not a proposal: {', '.join(known)}")
        return Registry(self.reviewed, self.version, self.rejected | turned, self.columns)

    def rollup_dimensions(self) -> list[Descriptor]:
        """Metric attributes that rollups keep: known, of metric retention, neither sensitive nor of high cardinality."""
        names = [*METRIC_DIMENSIONS, *[n for s, n in self.reviewed if s == "metrics"]]
        every = [self.describe("metrics", n) for n in names]
        return [d for d in every if d.known and d.retention == "metric" and d.sensitivity != "sensitive" and d.cardinality != "high"]
