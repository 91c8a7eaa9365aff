"""Models: recipes that write tables, and the order in which what depends on a table is built again."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from tidewater.plans import ops
from tidewater.plans.compiler import compile_chain
from tidewater.sources.store import Store


class Cycle(ValueError):
    pass


@dataclass(frozen=True)
class Model:
    name: str
    source: str
    input: str
    recipe: ops.Recipe


@dataclass
class Built:
    name: str
    rows: int
    version: int
    seconds: float


@dataclass
class Models:
    """Models of one source; a model's output table has its name."""

    store: Store
    known: dict[str, Model] = field(default_factory=dict)
    log: list[Built] = field(default_factory=list)

    def add(self, model: Model) -> None:
        """Refuses a model that would read its own output, directly or through others."""
        at = model.input
        while at in self.known:
            if at == model.name:
                break
            at = self.known[at].input
        if at == model.name:
            raise Cycle(f"{model.name} would depend on itself")
        self.known[model.name] = model

    def dependents(self, table: str) -> list[str]:
        """Every model downstream of a table, each after its input."""
        order, front = [], [table]
        while front:
            at = front.pop(0)
            below = sorted(m.name for m in self.known.values() if m.input == at)
            order += below
            front += below
        return order

    def build(self, name: str, order_by: str | None = None) -> Built:
        m, began = self.known[name], time.time()
        df = self.store.read(m.source, m.input)
        if df is None:
            raise KeyError(f"{m.source}/{m.input}")
        out = compile_chain(df, m.recipe, order_by)
        version = self.store.replace(out, m.source, m.name)
        self.log.append(Built(name, self.store.read(m.source, m.name).count(), version.version, time.time() - began))
        return self.log[-1]

    def refresh(self, table: str) -> list[Built]:
        """Builds what depends on a table that changed, in order."""
        return [self.build(n) for n in self.dependents(table)]
