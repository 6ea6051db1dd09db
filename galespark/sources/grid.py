"""Long decoded grid rows to one wide row per cell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galespark.functions.units import by_unit
from galespark.session import broadcast_if_small, cut

RUN = ["model_name", "init_time", "time_step"]

# fixed values: parameter name, level -> field
FIELDS = {
    ("prmsl", 0): "mslp",
    ("u", 850): "u",
    ("v", 850): "v",
    ("gh", 250): "gh250",
    ("gh", 850): "gh850",
    ("u", 925): "u925",
    ("v", 925): "v925",
    ("u", 10): "u10",
    ("v", 10): "v10",
}
# fixed value: computed from the wind where a file lacks it
OPTIONAL = {("absv", 850): "vort850"}
MAX_ODD = 100_000  # rejected steps in a broadcast


def select_fields(long: DataFrame, fields: dict = FIELDS, optional: dict = OPTIONAL) -> DataFrame:
    """Pick the wanted parameters, bring units together and lay them side by
    side. A step that lacks a field or whose fields differ in shape is rejected
    whole; an optional field may be missing, and is NULL then."""
    names = list(dict.fromkeys([*fields.values(), *optional.values()]))
    field = F.lit(None).cast("int")
    for (name, level), out in (fields | optional).items():
        field = F.when((F.col("param") == name) & (F.col("level") == level), names.index(out)).otherwise(field)
    wanted = (
        long.withColumn("field", field)
        .filter(F.col("field").isNotNull())
        .select(*RUN, "x", "y", "field", by_unit(F.col("value"), F.col("unit")).alias("value"))
    )
    # the fields of a cell fold to one row on the map side, with the rows that each has there
    cells = cut(
        wanted.groupBy(*RUN, "x", "y").agg(
            *[F.max(F.when(F.col("field") == i, F.col("value"))).alias(n) for i, n in enumerate(names)],
            *[F.count_if(F.col("field") == i).alias(f"rows_{n}") for i, n in enumerate(names)],
        )
    )
    # rows per field, a missing one as NULL; only the odd steps go on to the join
    shape = cells.groupBy(*RUN).agg(*[F.nullif(F.sum(f"rows_{n}"), F.lit(0)).alias(n) for n in names])
    needed = F.lit(False)
    for n in dict.fromkeys(fields.values()):
        needed = needed | F.col(n).isNull()
    odd = cut(shape.filter((F.least(*names) != F.greatest(*names)) | needed).select(*RUN))
    return cells.join(broadcast_if_small(odd, MAX_ODD), RUN, "left_anti").select(*RUN, "x", "y", *names)
