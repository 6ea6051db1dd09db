"""Names for helper columns that clash with none of the caller's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


def free(columns: list[str], *wanted: str) -> list[str]:
    """``__name`` for each wanted one, longer where a column has it, whatever its case."""
    taken = {c.lower() for c in columns}
    out = []
    for w in wanted:
        name = f"__{w}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(df: DataFrame) -> list[Column]:
    """All columns, whatever their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def widened(docs: DataFrame, run, added: list[StructField]) -> DataFrame:
    """``docs`` through an Arrow function that appends columns. The function
    sees columns by place, so it does not matter what their names hold."""
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    out = plain.mapInArrow(run, StructType([*plain.schema.fields, *(StructField(f"d{i}", f.dataType) for i, f in enumerate(added))]))
    return out.toDF(*docs.columns, *(f.name for f in added))
