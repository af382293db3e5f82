"""Line dedup by distinct-site spread, in DataFrame functions only.

Per line hash, a HyperLogLog sketch of the sites that hold the line is built
map-side and merged by aggregation. Lines whose estimate is far above
``min_sites`` are boilerplate, those far below are not, and lines within
``band`` of it get an exact distinct count. A boilerplate line goes from every
document but the first that holds it (smallest id, then line number), so that
one copy of a text that is itself spread over many sites stays.

Lines are cut at ``\\n`` and compared without the white space around them; blank
lines always stay. Defined results: a null text stays null and has no lines; a
null site is a site of its own; repeated rows share their fate (both are first
if they are the same row); a null id goes before others; an empty table gives
an empty result; all other columns of the input come out as they were, and
columns of the input may have any name that does not start with ``_ld_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import written

SALTS = 16


def _hashes(text: Column) -> tuple[Column, Column]:
    """Two hashes of 64 bits with unlike seeds."""
    return F.xxhash64(text), F.xxhash64(F.lit(7), text)


def boilerplate(lines: DataFrame, min_sites: int, band: float) -> DataFrame:
    """(_ld_a, _ld_b, _ld_first) of lines on ``min_sites`` sites or more; _ld_first is the first (id, line) place."""
    key = ["_ld_a", "_ld_b"]
    seen = lines.groupBy(*key).agg(F.hll_sketch_agg("_ld_site", 12).alias("_ld_sketch"), F.min("_ld_place").alias("_ld_first"))
    seen = seen.withColumn("_ld_sites", F.hll_sketch_estimate("_ld_sketch")).drop("_ld_sketch")
    seen = written(seen.where(F.col("_ld_sites") >= min_sites * (1 - band)), "spread-lines")
    near = F.col("_ld_sites") <= min_sites * (1 + band)
    pairs = lines.select(*key, "_ld_site").distinct()
    exact = pairs.join(seen.where(near).select(*key), key, "left_semi").groupBy(*key).agg(F.count("_ld_site").alias("_ld_sites"))
    exact = exact.where(F.col("_ld_sites") >= min_sites).select(*key).join(seen, key)
    return seen.where(~near).select(*key, "_ld_first").unionByName(exact.select(*key, "_ld_first"))


def dedup_lines(docs: DataFrame, min_sites: int = 10, band: float = 0.25, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """``docs`` with boilerplate lines gone from the text, and with its number of lines and of removed lines as _ld_lines and _ld_removed (long)."""
    row_a, row_b = F.xxhash64(id_col, text_col), F.xxhash64(F.lit(7), text_col, id_col)
    site = F.when(F.col(site_col).isNull(), F.lit(-1).cast("long")).otherwise(F.xxhash64(site_col))
    exploded = docs.where(F.col(text_col).isNotNull()).select(
        row_a.alias("_ld_row_a"), row_b.alias("_ld_row_b"), site.alias("_ld_site"), F.col(id_col).alias("_ld_id"), F.posexplode(F.split(text_col, "\n")).alias("_ld_no", "_ld_line")
    )
    line = F.btrim("_ld_line", F.lit(" \t\n\x0b\x0c\r"))
    a, b = _hashes(F.col("_ld_line"))
    lines = exploded.withColumn("_ld_line", line).where("_ld_line <> ''").select(
        "_ld_row_a", "_ld_row_b", "_ld_site", a.alias("_ld_a"), b.alias("_ld_b"), "_ld_no", F.struct(F.col("_ld_id").alias("i"), F.col("_ld_no").alias("n")).alias("_ld_place")
    )
    lines = written(lines, "lines")
    found = boilerplate(lines, min_sites, band)
    # A line may be in a third of all rows: its (one) row of the found side is spread over salts.
    found = found.withColumn("_ld_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = lines.withColumn("_ld_salt", F.pmod("_ld_row_a", F.lit(SALTS)).cast("int"))
    hit = salted.join(found, ["_ld_a", "_ld_b", "_ld_salt"]).where("not (_ld_place <=> _ld_first)")
    cut = hit.groupBy("_ld_row_a", "_ld_row_b").agg(F.collect_set("_ld_no").alias("_ld_cut"))
    out = docs.withColumn("_ld_row_a", row_a).withColumn("_ld_row_b", row_b).join(cut, ["_ld_row_a", "_ld_row_b"], "left")
    parts = F.split(text_col, "\n")
    # In time linear in the lines: the numbers that stay are a difference of sets, and the lines are cut once.
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), "_ld_cut")
    left = F.get(F.transform(F.array(parts), lambda p: F.array_join(F.transform(stay, lambda i: F.get(p, i)), "\n")), 0)
    return out.select(
        *[F.when(F.col("_ld_cut").isNull(), F.col(text_col)).otherwise(left).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns],
        F.when(F.col(text_col).isNull(), 0).otherwise(F.size(parts)).cast("long").alias("_ld_lines"),
        F.when(F.col("_ld_cut").isNull(), 0).otherwise(F.size("_ld_cut")).cast("long").alias("_ld_removed"),
    )
