"""The fluent query: part, state, quantity, value and region selectors over element states.

    Query(states_table).parts(Parts.by_id(1)).states(States.last()).quantities("von_mises").where(...).run()

Nothing is read before an action; a later call of one setter replaces an earlier one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .select import Parts, Predicate, Quantities, States, default_names


class Query:
    """Defaults: all parts, the last state, the common quantities, no filter."""

    def __init__(self, data: DataFrame, parts: DataFrame | None = None, entity: str = "element") -> None:
        self._data, self._table, self._entity = data, parts, entity
        self._parts: Predicate = Parts.all()
        self._states: States.Choice = States.last()
        self._quantities = Quantities(["common"])
        self._where: list[Predicate | Callable[[DataFrame], DataFrame]] = []
        self._region: Predicate | None = None

    def parts(self, chosen: Predicate) -> Query:
        self._parts = chosen
        return self

    def states(self, *choices: States.Choice) -> Query:
        self._states = choices[0] if len(choices) == 1 else States.any_of(*choices)
        return self

    def quantities(self, *names: str) -> Query:
        self._quantities = Quantities(names)
        return self

    def where(self, *filters: Predicate | Callable[[DataFrame], DataFrame]) -> Query:
        """Filters on the quantities: predicates, or functions of the table for those on its statistics."""
        self._where = list(filters)
        return self

    def within(self, region: Predicate) -> Query:
        self._region = region
        return self

    def validate(self) -> list[str]:
        """What is wrong with the query, without reading rows."""
        out = [] if self._quantities.names else ["no quantity is selected"]
        return out + [f"the table has no column {c}" for c in ("element_id", "part_id", "state_idx", "time") if c not in self._data.columns]

    def run(self) -> DataFrame:
        """entity, element_id, part_id, state_idx, time and the quantities of the rows that pass."""
        parts = self._table if self._table is not None else default_names(self._data)
        known = self._data.select("state_idx", "time").distinct()
        rows = self._data.join(self._parts.apply(parts).select("part_id").distinct(), "part_id", "left_semi").join(self._states(known).select("state_idx").distinct(), "state_idx", "left_semi")
        rows = rows if self._region is None else self._region.apply(rows)
        out = rows.select(F.lit(self._entity).alias("entity"), "element_id", "part_id", "state_idx", "time", *self._quantities.columns())
        for f in self._where:
            out = f.apply(out) if isinstance(f, Predicate) else f(out)
        return out
