"""Official bulletins: free text inside the <pre> block of a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galespark.functions.units import KMH_TO_KT
from galespark.sources.dims import literal_map

# fixed values: zone abbreviation -> zone name
ZONES = {
    "CDT": "US/Central", "EDT": "US/Eastern", "MDT": "US/Mountain", "PDT": "US/Pacific",
    "CST": "US/Central", "EST": "US/Eastern", "MST": "US/Mountain", "PST": "US/Pacific",
    "AST": "America/Puerto_Rico", "CVT": "Atlantic/Cape_Verde",
}

# fixed values: kinds of storm in a headline
KINDS = [
    "Hurricane", "Tropical Storm", "Tropical Depression", "Subtropical Storm", "Subtropical Depression", "Storm", "Depression",
    "Post-Tropical Cyclone", "Potential Tropical Cyclone",
]
# a headline: kind, name, then what the bulletin is
HEADLINE = r"(?m)\b(" + "|".join(KINDS) + r") +(\w+)\b[^\n]*\b"
TITLE = HEADLINE + "Advisory Number\\b"
UPDATE = HEADLINE + "Update\\b"

# fixed values: words of the bulletin layout
OFFICES = ["NWS National Hurricane Center Miami FL", "NWS Central Pacific Hurricane Center Honolulu HI"]
HALVES = ["AM", "PM"]
SUMMARY = "SUMMARY OF"
PLACE, WIND, MOTION, PRESSURE = "LOCATION", "MAXIMUM SUSTAINED WINDS", "PRESENT MOVEMENT", "MINIMUM CENTRAL PRESSURE"
DOTS = "..."  # between a label and its values


def read_advisories(spark: SparkSession, path: str) -> DataFrame:
    """One row per bulletin file below ``path``, all storms in one read."""
    return parse_advisories(spark.read.text(path, wholetext=True)).dropDuplicates()


def local_to_utc(clock: Column, am_pm: Column, zone: Column, day: Column) -> Column:
    """'1000', 'PM', 'CDT', '2024-Oct-5' -> UTC timestamp; NULL for an unknown zone."""
    hour = F.substring(clock, F.lit(1), F.length(clock) - 2).try_cast("int") % 12
    hour24 = hour + F.when(am_pm == "PM", 12).otherwise(0)
    stamp = F.concat(day, F.lit(" "), F.lpad(hour24.cast("string"), 2, "0"), F.right(clock, F.lit(2)))
    local = F.try_to_timestamp(stamp, F.lit("yyyy-MMM-d HHmm"))
    return F.to_utc_timestamp(local, literal_map(ZONES)[zone])


def words(line: Column) -> Column:
    return F.split(F.trim(line), " +")


def is_moment(line: Column) -> Column:
    """'1000 PM CDT Sat Oct 05 2024': clock, half of the day, zone, weekday, month, day, year."""
    w = words(line)
    return (F.size(w) >= 7) & F.get(w, F.lit(1)).isin(HALVES) & F.get(w, F.lit(0)).try_cast("int").isNotNull() & F.get(w, F.lit(6)).try_cast("int").isNotNull()


def is_summary(line: Column) -> Column:
    """'SUMMARY OF 1000 PM CDT...': the line that opens the block of facts."""
    w = words(F.split_part(line, F.lit(DOTS), F.lit(1)))
    named = F.startswith(F.trim(line), F.lit(SUMMARY + " ")) & F.get(w, F.lit(3)).isin(HALVES)
    return named & F.get(w, F.lit(2)).try_cast("int").isNotNull() & F.get(w, F.lit(4)).isin(*ZONES)


def first(lines: Column, test) -> Column:
    return F.get(F.filter(lines, test), F.lit(0))


def fact(lines: Column, label: str) -> Column:
    """Values of the first line with a label: what stands between its dots."""
    line = first(lines, lambda x: F.startswith(F.trim(x), F.lit(label + DOTS)))
    parts = F.split(F.trim(line), r"\.\.\.")
    return F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))


def amount(values: Column, unit: str) -> Column:
    """The number before a unit, in the first value that has it."""
    held = words(first(values, lambda v: F.array_contains(words(v), unit)))
    at = F.array_position(held, unit).cast("int")
    return F.when(at > 1, F.get(held, at - 2)).try_cast("double")


def degrees(text: Column, against: str) -> Column:
    """'16.3N' or '76.5W': the letter tells the sign."""
    size = F.substring(text, F.lit(1), F.length(text) - 1).try_cast("double")
    return F.when(F.right(text, F.lit(1)) == against, -size).otherwise(size)


def parse_advisories(pages: DataFrame, column: str = "value", compat: bool = True) -> DataFrame:
    """Bulletins read line by line: the moment, the office's line, and the facts
    under the summary's head up to an empty line.

    ``compat`` gives the kind of storm as one word where the bulletin is an
    advisory ("Storm") and in full where it is an update ("Tropical Storm")."""
    blocks = F.regexp_extract_all(F.col(column), F.lit(r"(?is)<pre[^>]*>(.*?)</pre>"), F.lit(1))
    text = pages.select("*", F.explode(F.array(first(blocks, lambda b: F.exists(F.split(b, "\n"), is_summary)))).alias("text"))
    text = text.filter(F.col("text").isNotNull()).withColumn("lines", F.split("text", "\n"))
    head = F.array_position(F.transform("lines", is_summary), True).cast("int")
    after = F.slice("lines", head + 1, F.size("lines"))
    blank = F.array_position(F.transform(after, lambda x: F.trim(x) == ""), True).cast("int")
    text = text.withColumn("facts", F.when(blank > 0, F.slice(after, F.lit(1), F.greatest(blank - 1, F.lit(0)))).otherwise(after))
    text = text.withColumns({"moment": words(first(F.col("lines"), is_moment)), "place": words(F.get(fact(F.col("facts"), PLACE), F.lit(0)))})
    text = text.withColumns({"motion": fact(F.col("facts"), MOTION), "wind": fact(F.col("facts"), WIND), "pressure": fact(F.col("facts"), PRESSURE)})
    office = first(F.col("lines"), lambda x: F.exists(F.array(*map(F.lit, OFFICES)), lambda o: F.startswith(F.trim(x), F.concat(o, F.lit(" ")))))

    def part(pattern: str, group: int) -> Column:
        return F.nullif(F.regexp_extract("text", pattern, group), F.lit(""))

    at_title, at_update = F.regexp_instr("text", F.lit(TITLE)), F.regexp_instr("text", F.lit(UPDATE))
    is_title = (at_title > 0) & ((at_update == 0) | (at_title <= at_update))
    m = lambda i: F.get("moment", F.lit(i))
    return text.select(
        F.element_at(words(office), -1).alias("atcf_id"),
        F.when(is_title, part(TITLE, 2)).otherwise(part(UPDATE, 2)).alias("storm_name"),
        F.when(is_title, F.substring_index(part(TITLE, 1), " ", -1) if compat else part(TITLE, 1))
        .otherwise(part(UPDATE, 1)).alias("init_storm_type"),
        local_to_utc(m(0), m(1), m(2), F.concat_ws("-", m(6), m(4), m(5).try_cast("int").cast("string"))).alias("advisory_time"),
        is_title.alias("advisory"),
        degrees(F.get("place", F.lit(0)), "S").alias("lat"),
        degrees(F.get("place", F.lit(1)), "W").alias("lon"),
        (amount(F.col("wind"), "KM/H") * KMH_TO_KT).alias("vmax_kt"),
        amount(F.col("pressure"), "MB").alias("mslp_hpa"),
        F.get(words(F.get("motion", F.lit(0))), F.lit(0)).alias("storm_direction"),
        amount(F.col("motion"), "DEGREES").alias("heading"),
        (amount(F.col("motion"), "KM/H") * KMH_TO_KT).alias("speed_kt"),
    )
