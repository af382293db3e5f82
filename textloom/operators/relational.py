"""Set, incremental, aggregate and report operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_wins(parts: list[DataFrame], key: str, order: list[str]) -> DataFrame:
    """Union of all parts; of rows with one key the first stays: by part, then by ``order``."""
    rows = reduce(DataFrame.unionByName, [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)])
    w = Window.partitionBy(key).orderBy("_part", *order)
    return rows.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank", "_part")


def distinct_in_order(rows: DataFrame, value: str, place: str) -> DataFrame:
    """(value, place): each distinct value with its first place."""
    return rows.groupBy(value).agg(F.min(place).alias(place))


def round_robin(rows: DataFrame, group: str, place: str, group_order: str) -> DataFrame:
    """``rows`` with ``turn``, the rank in the group; ordered by (turn, group_order) they interleave the groups."""
    return rows.withColumn("turn", F.row_number().over(Window.partitionBy(group).orderBy(place))).orderBy("turn", group_order)


def collected_key(url: Column) -> Column:
    return F.substring(F.md5(url.cast("binary")), 1, 10)


def not_collected(urls: DataFrame, seen: DataFrame, url: str = "url", key: str = "key") -> DataFrame:
    return urls.withColumn(key, collected_key(F.col(url))).join(seen, key, "left_anti")


def cache_key(chunk_id: Column, text: Column) -> Column:
    """Of an embedding: changes with the text, not only with the id."""
    return F.sha2(F.concat_ws("\n", chunk_id.cast("string"), text).cast("binary"), 256)


def missing(current: DataFrame, cached: DataFrame, key: str) -> DataFrame:
    return current.join(cached.select(key), key, "left_anti")


def merged_cache(current: DataFrame, cached: DataFrame, key: str, encode) -> DataFrame:
    """The cache of ``current``: rows still wanted, and ``encode`` of those missing."""
    return cached.join(current.select(key), key, "left_semi").unionByName(encode(missing(current, cached, key)))


def confusion(cases: DataFrame, actual: str, detected: str, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, tn and the measures made from them, zero where undefined; per group of ``by``."""
    a, d = F.col(actual), F.col(detected)
    n = lambda c: F.coalesce(F.count_if(c), F.lit(0))
    m = cases.groupBy(*(by or [])).agg(n(a & d).alias("tp"), n(~a & d).alias("fp"), n(a & ~d).alias("fn"), n(~a & ~d).alias("tn"))
    share = lambda x, y: F.coalesce(F.try_divide(x, y), F.lit(0.0))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    m = m.withColumn("precision", share(tp, tp + fp)).withColumn("recall", share(tp, tp + fn)).withColumn("specificity", share(tn, tn + fp)).withColumn("fpr", share(fp, fp + tn))
    return m.withColumn("f1", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).withColumn("accuracy", share(tp + tn, tp + fp + fn + tn))


def suite_flag(flagged: Column, overall: Column) -> Column:
    return (flagged > 0) & (overall > 0.05)


def measured_flag(overall: Column, matches: Column) -> Column:
    return (overall >= 0.30) | (matches > 0)


def comparison_flag(score: Column) -> Column:
    return score > 0.30


def file_source(stem: Column) -> Column:
    """The source that a corpus file's name tells."""
    news = F.coalesce(F.nullif(F.get(F.split(stem, "_", 3), 1), F.lit("")), F.lit(""))
    return (
        F.when(stem.startswith("news_"), F.concat(F.lit("news."), news))
        .when(stem.startswith("arxiv__"), "arxiv")
        .when(stem.startswith("openalex_"), "openalex")
        .when(stem.startswith("crossref"), "crossref")
        .when(stem.startswith("local__"), "local")
        .when(stem.startswith("cc_") | stem.contains("commoncrawl"), "commoncrawl")
        .otherwise("other")
    )


def share_by(rows: DataFrame, key: str) -> DataFrame:
    """(key, n, percent), most frequent first."""
    by = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return by.withColumn("percent", 100 * F.col("n") / F.sum("n").over(Window.partitionBy())).orderBy(F.desc("n"), key)


def document_scores(docs: DataFrame, paras: DataFrame, matches: DataFrame, doc_id: str) -> DataFrame:
    """(doc_id, total_paragraphs, flagged_paragraphs, overall_score): the mean score of flagged paragraphs, 0 if there are none."""
    totals = paras.groupBy(doc_id).agg(F.count(F.lit(1)).alias("total_paragraphs"))
    found = matches.groupBy(doc_id).agg(F.count(F.lit(1)).alias("flagged_paragraphs"), F.avg("score").alias("overall_score"))
    out = docs.select(doc_id).join(totals, doc_id, "left").join(found, doc_id, "left")
    return out.select(doc_id, F.coalesce("total_paragraphs", F.lit(0)).alias("total_paragraphs"), F.coalesce("flagged_paragraphs", F.lit(0)).alias("flagged_paragraphs"), F.coalesce("overall_score", F.lit(0.0)).alias("overall_score"))


def top_matches(matches: DataFrame, per_doc: int, doc_id: str, tie: list[str]) -> DataFrame:
    """The ``per_doc`` best matches of each document, best first (rank from 1)."""
    w = Window.partitionBy(doc_id).orderBy(F.desc("score"), *tie)
    return matches.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_doc)


def _band(x: Column, high: float, middle: float, names: tuple[str, str, str], closed: bool = False) -> Column:
    over = (lambda v: x >= v) if closed else (lambda v: x > v)
    return F.when(over(high), names[0]).when(over(middle), names[1]).otherwise(names[2])


def risk_label(score: Column) -> Column:
    return _band(score, 0.30, 0.10, ("TINGGI", "SEDANG", "RENDAH"))


def risk_class(score: Column) -> Column:
    return _band(score, 0.30, 0.10, ("high", "med", "low"))


def match_class(score: Column) -> Column:
    return _band(score, 0.70, 0.40, ("high", "med", "low"))


def ai_class(percent: Column) -> Column:
    return _band(percent, 60, 30, ("ai-high", "ai-med", "ai-low"))


def report_document_band(percent: Column) -> Column:
    return _band(percent, 50, 20, ("hi", "mid", "lo"), True)


def report_match_band(percent: Column) -> Column:
    return _band(percent, 70, 40, ("hi", "mid", "lo"), True)


# Names of months in reports.
MONTHS = ["Januari", "Februari", "Maret", "April", "Mei", "Juni", "Juli", "Agustus", "September", "Oktober", "November", "Desember"]


def indonesian_time(ts: Column) -> Column:
    month = F.get(F.array(*[F.lit(m) for m in MONTHS]), F.month(ts) - 1)
    return F.concat(F.dayofmonth(ts).cast("string"), F.lit(" "), month, F.lit(" "), F.year(ts).cast("string"), F.lit(", "), F.date_format(ts, "HH:mm"))


def time_ago(ts: Column, now: Column) -> Column:
    micros = lambda x: F.unix_micros(x.cast("timestamp"))
    s = F.floor((micros(now) - micros(ts)) / 1e6)
    part = lambda n, unit: F.concat(F.floor(s / n).cast("string"), F.lit(f" {unit} lalu"))
    return F.when(s < 60, part(1, "detik")).when(s < 3600, part(60, "menit")).when(s < 86400, part(3600, "jam")).otherwise(part(86400, "hari"))


def session_ok(sid: Column) -> Column:
    return F.coalesce(sid.rlike(r"^[\p{L}\p{N}_-]{16,128}\z"), F.lit(False))


def session_prefix(sid: Column) -> Column:
    return F.substring(F.regexp_replace(sid, r"[^\p{L}\p{N}]", ""), 1, 8)


def recent_reports(reports: DataFrame, session: str, limit: int) -> DataFrame:
    """The newest reports of a session that have a name and paragraphs."""
    real = (F.coalesce("document_name", F.lit("")).isin("", "?") == F.lit(False)) & (F.coalesce("total_paragraphs", F.lit(0)) > 0)
    return reports.where((F.col("session") == session) & real).orderBy(F.desc("finished_at"), "report_id").limit(limit)


def find_report(reports: DataFrame, report_id, session: str) -> DataFrame:
    return reports.where((F.col("report_id") == report_id) & (F.col("session") == session))


# Orders in which history is listed.
HISTORY_ORDERS = {"newest": ("finished_at", True), "oldest": ("finished_at", False), "highest": ("overall_score", True), "lowest": ("overall_score", False)}


def history(reports: DataFrame, search: str = "", band: str = "all", order: str = "newest") -> DataFrame:
    out = reports.where(F.contains(F.lower("document_name"), F.lit(search.lower()))) if search else reports
    if band in ("low", "med", "high"):
        out = out.where(risk_class(F.col("overall_score")) == band)
    elif band == "ai":
        out = out.where(F.col("ai_percent") > 60)
    column, down = HISTORY_ORDERS[order]
    return out.orderBy(F.desc(column) if down else F.asc(column), "report_id")


def retention(files: DataFrame, now_ms: Column, days: int, name: str = "name") -> DataFrame:
    """``files`` with ``expired``: the time in the name is over ``days`` days before now. Nothing is deleted."""
    stamp = F.regexp_extract(name, r"^(\d+)_", 1)
    return files.withColumn("expired", F.coalesce((F.nullif(stamp, F.lit("")).cast("long") < now_ms - days * 86_400_000), F.lit(False)))
