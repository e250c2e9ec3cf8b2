"""Keys, names and display strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Naming patterns of the data.
BATCH_STAMP = r"^auto_grown_(\d{17})_region_\d+$"
BATCH_DAY = r"^auto_grown_(\d{8})"
REGION_SUFFIX = r"_region_\d+$"
LINEAGE_STEM = r"^(auto_grown_\d+|auto_trace_\d+|auto_grown_w\d+)"
SELECTION_MARK = "_sel_"
REVERSE_MARK = "reverse"
PIXEL_SIZE = r"_(\d+(?:\.\d+)?)um_"
MODEL_SIDE = r"ps(\d+)"
MODEL_SIDE_PAIR = r"ps\d+_(\d+)_(\d+)"
MODEL_SIDE_EMA = r"betti_ema_(\d+)_forward"
MODEL_SCALE = r"scale(\d+)"
SHORT_NAME = r"_2um$"


def _or_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def coordinate_key(patch: Column, x: Column, y: Column, z: Column) -> Column:
    """``patch|x,y,z`` at one decimal, for coordinates already rounded to 0.1."""
    return F.concat_ws("|", patch.cast("string"), F.format_string("%.1f,%.1f,%.1f", x, y, z))


def batch_id(name: Column) -> Column:
    """17-digit batch stamp of a name, NULL for other names."""
    return _or_null(F.regexp_extract(name, BATCH_STAMP, 1))


def batch_day(name: Column) -> Column:
    """Day (YYYYMMDD) of the batch stamp; ``legacy`` for names without one."""
    return F.coalesce(_or_null(F.regexp_extract(name, BATCH_DAY, 1)), F.lit("legacy"))


def stamp_to_date(stamp: Column) -> Column:
    return F.concat_ws("-", F.substring(stamp, 1, 4), F.substring(stamp, 5, 2), F.substring(stamp, 7, 2))


def lineage(name: Column, source: Column | None = None) -> Column:
    """Last path part of the recorded source; without one, the name without its region suffix."""
    own = F.regexp_replace(name, REGION_SUFFIX, "")
    if source is None:
        return own
    return F.coalesce(_or_null(F.regexp_extract(source, r"([^/]+)/?$", 1)), own)


def lineage_stem(name: Column) -> Column:
    """Growth stem of a name; where the pattern does not apply, the name up to its selection mark."""
    return F.coalesce(_or_null(F.regexp_extract(name, LINEAGE_STEM, 1)), parent_stem(name))


def same_lineage(a: Column, b: Column) -> Column:
    """Do two surfaces stem from one growth?  Such relatives are left out where surfaces meet others."""
    return lineage_stem(a) == lineage_stem(b)


def parent_stem(name: Column) -> Column:
    return F.substring_index(name, SELECTION_MARK, 1)


def is_reverse(path: Column) -> Column:
    return F.substring_index(path, "/", -1).contains(REVERSE_MARK)


def short_name(segment: Column) -> Column:
    return F.regexp_replace(segment, SHORT_NAME, "")


def pixel_size(volume: Column) -> Column:
    """Pixel size in micrometres written in a volume name, NULL if there is none."""
    return _or_null(F.regexp_extract(volume, PIXEL_SIZE, 1)).cast("double")


def model_footprint(name: Column) -> tuple[Column, Column]:
    """(largest side in pixels, input downsampling) that a prediction file name states."""
    one = F.regexp_extract_all(name, F.lit(MODEL_SIDE), F.lit(1))
    left = F.regexp_extract_all(name, F.lit(MODEL_SIDE_PAIR), F.lit(1))
    right = F.regexp_extract_all(name, F.lit(MODEL_SIDE_PAIR), F.lit(2))
    ema = F.regexp_extract_all(name, F.lit(MODEL_SIDE_EMA), F.lit(1))
    sides = F.transform(F.concat(one, left, right, ema), lambda v: v.cast("long"))
    scale = _or_null(F.regexp_extract(name, MODEL_SCALE, 1)).cast("int")
    down = F.coalesce(F.pow(F.lit(2.0), scale), F.lit(1.0)).cast("long")
    return F.coalesce(F.array_max(sides), F.lit(0).cast("long")), down


# ---------------------------------------------------------------- display
def percent(v: Column) -> Column:
    return F.when(v.isNull(), "n/a").otherwise(F.format_string("%.0f%%", 100 * v))


def fixed(v: Column, digits: int = 2) -> Column:
    return F.when(v.isNull(), "n/a").otherwise(F.format_string(f"%.{digits}f", v))


def interval(lo: Column, hi: Column, digits: int = 2) -> Column:
    shown = F.format_string(f"[%.{digits}f, %.{digits}f]", lo, hi)
    return F.when(lo.isNull() | hi.isNull(), "n/a").otherwise(shown)


def percent_interval(lo: Column, hi: Column) -> Column:
    return F.concat(F.lit("["), percent(lo), F.lit(", "), percent(hi), F.lit("]"))


def scope_badge(limited: Column) -> Column:
    return F.when(limited, "Limited scope").otherwise("Full")
