"""A flow: named operators whose ports are wired to each other.

An operator is a function of DataFrames. Wiring one output to several inputs
hands them the same DataFrame; wiring several outputs to one port unites their
rows. A flow only composes DataFrames; Spark plans and runs them.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.merges import interleave

_WIDER = ("tinyint", "smallint", "int", "bigint", "float", "double")


@dataclass(frozen=True)
class PortSchema:
    """Fields of a port. An exact one can't be extended; rows may still have more columns."""

    fields: Mapping[str, str]
    exact: bool = False

    def extend(self, more: Mapping[str, str]) -> PortSchema:
        if more and self.exact:
            raise ValueError("an exact schema can't be extended")
        if twice := set(more) & set(self.fields):
            raise ValueError(f"fields are there already: {sorted(twice)}")
        return PortSchema({**self.fields, **more}, self.exact)

    def accepts(self, other: PortSchema) -> bool:
        """Whether all own fields are in ``other`` with the same or a narrower type."""
        return all(n in other.fields and _fits(other.fields[n], k) for n, k in self.fields.items())

    @staticmethod
    def of(df: DataFrame) -> PortSchema:
        return PortSchema({f.name: f.dataType.simpleString() for f in df.schema})


def _fits(given: str, wanted: str) -> bool:
    return given == wanted or given in _WIDER and wanted in _WIDER and _WIDER.index(given) <= _WIDER.index(wanted)


@dataclass
class _Operator:
    make: Callable[..., DataFrame | Sequence[DataFrame]]
    inputs: list[PortSchema | None]
    outputs: list[PortSchema | None]
    partition_by: tuple[str, ...] = ()
    wired: list[list[tuple[str, int]]] = field(default_factory=list)


class Flow:
    def __init__(self) -> None:
        self._operators: dict[str, _Operator] = {}
        self._built = False

    def add(self, name: str, make: Callable[..., DataFrame | Sequence[DataFrame]], inputs: int | Sequence[PortSchema | None] = 1, outputs: int | Sequence[PortSchema | None] = 1, partition_by: Sequence[str] = ()) -> Flow:
        """``make`` takes a DataFrame for each input port, and returns one, or a sequence with one for each output port.

        Fields of ``partition_by`` must be in the schema of every input port that has one, with the same type.
        """
        if self._built:
            raise ValueError("the flow is built already")
        if not name or name in self._operators:
            raise ValueError(f"there is an operator {name!r} already" if name else "an operator needs a name")
        ports = lambda p: [None] * p if isinstance(p, int) else list(p)
        op = _Operator(make, ports(inputs), ports(outputs), tuple(partition_by))
        if partition_by and not op.inputs:
            raise ValueError("a source can't be partitioned by fields")
        for key in partition_by:
            kinds = {s.fields.get(key) for s in op.inputs if s is not None}
            if None in kinds or len(kinds) > 1:
                raise ValueError(f"{key!r} must be in all input ports with one type")
        op.wired = [[] for _ in op.inputs]
        self._operators[name] = op
        return self

    def connect(self, source: str, target: str, from_port: int = 0, to_port: int = 0) -> Flow:
        if self._built:
            raise ValueError("the flow is built already")
        for name in (source, target):
            if name not in self._operators:
                raise ValueError(f"there is no operator {name!r}")
        a, b = self._operators[source], self._operators[target]
        if not 0 <= from_port < len(a.outputs) or not 0 <= to_port < len(b.inputs):
            raise ValueError("there is no such port")
        if source == target or target in self._upstream(source):
            raise ValueError(f"{source!r} to {target!r} closes a cycle")
        given, wanted = a.outputs[from_port], b.inputs[to_port]
        if given is not None and wanted is not None and not wanted.accepts(given):
            raise ValueError(f"what {source!r} has doesn't fit {target!r}")
        if (source, from_port) not in b.wired[to_port]:
            b.wired[to_port].append((source, from_port))
        return self

    def _upstream(self, name: str) -> set[str]:
        found, todo = set(), [name]
        while todo:
            for port in self._operators[todo.pop()].wired:
                for source, _ in port:
                    if source not in found:
                        found.add(source)
                        todo.append(source)
        return found

    def build(self) -> Flow:
        """Check that the operators are one connected graph and that each one with inputs has some wired."""
        if not self._operators:
            raise ValueError("the flow has no operators")
        for name, op in self._operators.items():
            if op.inputs and not any(op.wired):
                raise ValueError(f"no input of {name!r} is connected")
        near: dict[str, set[str]] = {n: set() for n in self._operators}
        for name, op in self._operators.items():
            for source, _ in (x for port in op.wired for x in port):
                near[name].add(source)
                near[source].add(name)
        seen, todo = set(), [next(iter(near))]
        while todo:
            if (at := todo.pop()) not in seen:
                seen.add(at)
                todo += near[at]
        if len(seen) < len(near):
            raise ValueError(f"not connected with the rest: {sorted(set(near) - seen)}")
        self._built = True
        return self

    def sources(self) -> list[str]:
        return [n for n, op in self._operators.items() if not op.inputs]

    def connections(self) -> list[tuple[str, int, str, int]]:
        return [(s, p, n, k) for n, op in self._operators.items() for k, port in enumerate(op.wired) for s, p in port]

    def inbound(self, name: str) -> list[tuple[str, int, str, int]]:
        return [c for c in self.connections() if c[2] == name]

    def outbound(self, name: str) -> list[tuple[str, int, str, int]]:
        return [c for c in self.connections() if c[0] == name]

    def run(self) -> dict[str, list[DataFrame]]:
        """The DataFrames of every operator's output ports, by operator."""
        if not self._built:
            self.build()
        done: dict[str, list[DataFrame]] = {}

        def make(name: str) -> list[DataFrame]:
            if name not in done:
                op = self._operators[name]
                ports = [interleave(*(make(s)[p] for s, p in port)) if port else None for port in op.wired]
                made = op.make(*ports)
                done[name] = [made] if isinstance(made, DataFrame) else list(made)
                if len(done[name]) != len(op.outputs):
                    raise ValueError(f"{name!r} made {len(done[name])} outputs, not {len(op.outputs)}")
                for df, schema in zip(done[name], op.outputs, strict=True):
                    if schema is not None and not schema.accepts(PortSchema.of(df)):
                        raise ValueError(f"what {name!r} made lacks fields of its schema")
            return done[name]

        for name in self._operators:
            make(name)
        return done


def fields(df: DataFrame, schema: PortSchema) -> DataFrame:
    """Only the declared columns, in the order of their names."""
    return df.select(*(F.col(n).cast(T.StructType.fromDDL(f"x {schema.fields[n]}")["x"].dataType).alias(n) for n in sorted(schema.fields)))
