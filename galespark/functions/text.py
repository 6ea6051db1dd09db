"""Text and label helpers as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from galespark.sources.dims import MODELS, literal_map

# fixed values: channel names of the co-registration string
CHANNELS = ["6G", "7G", "10G", "18G", "23G", "36G"]


# layout of a wind product's file name
WIND_FILE = r"^\w\w(\d{8})[^_]*?(\w)_(as|ds)\b"


def coefficient_map(text: Column) -> Column:
    """'6G-1.518,7G--1.4' -> {6G: 1.518, 7G: -1.4}; the first dash separates."""
    entries = F.transform(
        F.split(text, ","),
        lambda e: F.struct(
            F.regexp_extract(e, r"^(\d+G)-(.*)$", 1).alias("channel"),
            F.regexp_extract(e, r"^(\d+G)-(.*)$", 2).try_cast("double").alias("value"),
        ),
    )
    return F.map_from_entries(F.filter(entries, lambda e: e["channel"].isin(CHANNELS)))


def step_text(model: Column, step: Column) -> Column:
    """Forecast step as the model's file names write it."""
    out = step.cast("string")
    for name, _, _, width in MODELS:
        if width:
            text = F.when(F.length(step.cast("string")) < width, F.lpad(step.cast("string"), width, "0")).otherwise(step.cast("string"))
            out = F.when(model == name, text).otherwise(out)
    return out


def last_step(model: Column) -> Column:
    return literal_map({m: last for m, _, last, _ in MODELS})[model]


def wind_product_title(name: Column) -> Column:
    """Title of a wind product from its file name: two letters, the day, the
    platform's letter before the first underscore, the orbit's direction after it."""

    def named(group: int, words: dict[str, str]) -> Column:
        return F.coalesce(literal_map(words)[F.regexp_extract(name, WIND_FILE, group)], F.lit("Unknown"))

    platform, way = named(2, {"B": "METOP B", "C": "METOP C"}), named(3, {"as": "Ascending", "ds": "Descending"})
    return F.concat_ws(" ", platform, way, F.regexp_extract(name, WIND_FILE, 1))


def pass_label(satellite: Column, ascending: Column) -> Column:
    return F.concat_ws(" ", satellite, F.when(ascending, "Ascending").otherwise("Descending"))


def pass_folder(model: Column, init: Column) -> Column:
    return F.regexp_replace(F.concat_ws("_", model, F.date_format(init, "yyyy-MM-dd HH:mm")), r"[: ]", "-")


def pass_file(satellite: Column, ascending: Column, valid: Column) -> Column:
    return F.format_string(
        "%s_%s_%s.png", F.date_format(valid, "yyyyMMddHHmm"), satellite, F.when(ascending, "A").otherwise("D")
    )
