"""What a result looks like: fields, aggregation, units, precision and form, as one specification."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .compare import UNITS
from .results import aggregate

KEYS = ("element_id", "part_id", "state_idx", "time")


@dataclass(frozen=True)
class OutputSpec:
    """Immutable; every setter gives a new one. Fields without an aggregation of their own take ``aggregation``; with none at all rows stay as they are."""

    fields: tuple[str, ...] = ()
    aggregation: str | None = None
    by_field: dict[str, str] = field(default_factory=dict)
    units: dict[str, tuple[str, str]] = field(default_factory=dict)  # field -> (unit of the data, unit wanted)
    precision: int | None = 6
    form: str = "csv"
    delimiter: str = ","
    header: bool = True
    metadata: dict[str, str] = field(default_factory=dict)

    def with_fields(self, *names: str) -> OutputSpec:
        return replace(self, fields=tuple(dict.fromkeys(names)))

    def with_aggregation(self, kind: str | None, *names: str) -> OutputSpec:
        """The aggregation of the named fields, or of all."""
        return replace(self, by_field={**self.by_field, **dict.fromkeys(names, kind)}) if names else replace(self, aggregation=kind)

    def with_unit(self, name: str, source: str, target: str) -> OutputSpec:
        return replace(self, units={**self.units, name: (source, target)})

    def with_precision(self, digits: int | None) -> OutputSpec:
        return replace(self, precision=digits)

    def as_form(self, form: str, delimiter: str = ",", header: bool = True) -> OutputSpec:
        return replace(self, form=form.lower(), delimiter=delimiter, header=header)

    def validate(self, columns: Sequence[str]) -> list[str]:
        """What is wrong with it for a table of these columns."""
        out = [f"no field {f!r}" for f in self.fields if f not in columns]
        out += [f"no unit {u!r}" for pair in self.units.values() for u in pair if u not in UNITS]
        return out + ([] if self.form in ("csv", "json", "parquet") else [f"no form {self.form!r}"])

    def apply(self, df: DataFrame) -> DataFrame:
        """The chosen fields, in their units, aggregated by element and part where an aggregation is set, rounded."""
        names = self.fields or tuple(c for c in df.columns if c not in KEYS)
        rows = df.withColumns({f: F.col(f) * (UNITS[a] / UNITS[b]) for f, (a, b) in self.units.items() if f in names})
        kinds = {f: self.by_field.get(f, self.aggregation) for f in names}
        if any(kinds.values()):
            rows = rows.groupBy("element_id", "part_id").agg(*(aggregate(f, k or "last").alias(f) for f, k in kinds.items()))
        else:
            rows = rows.select(*(k for k in KEYS if k in df.columns), *names)
        if self.precision is not None:
            rows = rows.withColumns({f: F.round(f, self.precision) for f in names if rows.schema[f].dataType.simpleString() == "double"})
        return rows

    def write(self, df: DataFrame, path: str) -> None:
        """``apply`` and write in the form; metadata, if any, goes beside as JSON."""
        out = self.apply(df).write.mode("overwrite")
        if self.form == "csv":
            out.option("header", self.header).option("sep", self.delimiter).csv(path)
        else:
            getattr(out, self.form)(path)
        if self.metadata:
            df.sparkSession.createDataFrame(sorted(self.metadata.items()), "key string, value string").coalesce(1).write.mode("overwrite").json(f"{path}.metadata")
