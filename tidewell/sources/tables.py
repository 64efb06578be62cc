"""Scans of the header-driven, all-text tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.functions import text as tx


def normalized_name(name: str) -> str:
    import re

    return re.sub("[^a-z0-9]+", "_", name.strip().lower()).strip("_")


def scan(raw: DataFrame) -> DataFrame:  # SC1
    """Columns under normalised names, blanks as null, without all-blank rows. Blank or repeated names are an error."""
    names = [normalized_name(c) for c in raw.columns]
    if "" in names or len({*names}) < len(names):
        raise ValueError(f"blank or repeated header: {raw.columns}")
    return raw.select(*(tx.blank_to_null(F.col(f"`{c}`").cast("string")).alias(n) for c, n in zip(raw.columns, names, strict=True))).dropna(how="all")


def read_csv(spark: SparkSession, path: str) -> DataFrame:  # SC1
    return scan(spark.read.csv(path, header=True, enforceSchema=False))


def sources(rows: DataFrame, active_only: bool = True, strict: bool = True) -> DataFrame:  # SC2
    """Typed registry rows; `codes` says what is wrong, and with strict any code is an error. Rows that hold nothing but
    check boxes are skipped; a repeated id is a code of each of its rows."""
    get = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    boxes = {"active", "primary_source", "discovery_only"}
    rest = [c for c in rows.columns if c not in boxes]
    kept = rows.dropna(how="all", subset=rest) if rest else rows
    typed = kept.select(
        get("source_id").alias("source_id"),
        tx.section_of(get("section")).alias("section"),
        F.coalesce(get("source_name"), get("organization")).alias("source_name"),
        get("url").alias("url"),
        tx.parser_lane(get("method"), get("parser")).alias("parser_lane"),
        tx.cadence_minutes(get("cadence")).alias("cadence_minutes"),
        tx.source_tier(get("source_tier"), tx.parse_bool(get("primary_source"), False), tx.parse_bool(get("discovery_only"), False)).alias("source_tier"),
        F.upper(F.coalesce(get("priority"), F.lit("P2"))).alias("priority"),
        tx.parse_bool(get("active"), True).alias("active"),
        tx.parse_list(get("allowed_domains"), True).alias("allowed_domains"),
        tx.parse_bool(get("primary_source"), False).alias("primary_source"),
        tx.parse_bool(get("discovery_only"), False).alias("discovery_only"),
        F.coalesce(tx.optional_int(get("max_items")), F.lit(25)).alias("max_items"),
        F.coalesce(tx.optional_int(get("max_pages")), F.lit(3)).alias("max_pages"),
        F.coalesce(tx.optional_int(get("max_bytes")), F.lit(1_000_000)).alias("max_bytes"),
        get("parser_version").alias("parser_version"),
        F.count("*").over(Window.partitionBy(get("source_id"))).alias("_times"),
    )
    codes = tx.codes(
        (F.col("source_id").isNull(), "SOURCE_ID_MISSING"),
        (F.col("_times") > 1, "SOURCE_ID_REPEATED"),
        (F.col("section").isNull(), "SECTION_UNKNOWN"),
        (F.col("parser_lane").isNull(), "LANE_UNKNOWN"),
        (F.col("source_tier").isNull(), "TIER_UNKNOWN"),
        (F.col("url").isNull() | ~F.startswith(F.col("url"), F.lit("https://")) | F.col("url").rlike(r"[\\\x00-\x1f]"), "URL_NOT_HTTPS"),
        (F.size("allowed_domains") == 0, "NO_ALLOWED_DOMAINS"),
        (F.col("primary_source") & F.col("discovery_only"), "PRIMARY_AND_DISCOVERY"),
        (~F.col("max_items").between(1, 100), "MAX_ITEMS_OUT_OF_RANGE"),
        (~F.col("max_pages").between(1, 10), "MAX_PAGES_OUT_OF_RANGE"),
        (~F.col("max_bytes").between(1, 5_000_000), "MAX_BYTES_OUT_OF_RANGE"),
    )
    out = typed.withColumn("codes", codes).drop("_times")
    if strict:
        message = F.concat(F.lit("invalid source "), F.coalesce("source_id", F.lit("?")), F.lit(": "), F.array_join("codes", ","))
        out = out.withColumn("codes", F.when(F.size("codes") > 0, F.raise_error(message).cast("array<string>")).otherwise(F.col("codes")))
    return out.where("active") if active_only else out


BOOLEAN_SETTINGS, INTEGER_SETTINGS, REAL_SETTINGS = ("test_mode", "send_enabled"), ("send_hour", "max_recipients", "quarantine_hours", "quarantine_after"), ("coverage_threshold",)


def settings(rows: DataFrame) -> DataFrame:  # SC3
    """One row a setting with the value under its type. Errors: a repeated name, a name that suggests a secret."""
    named = rows.withColumn("setting", tx.normalize_key(F.col("setting"))).where("setting <> ''")
    times = F.count("*").over(Window.partitionBy("setting"))
    guard = F.when(F.col("setting").rlike("secret|token|password|api_key|credential"), F.raise_error(F.concat(F.lit("secret in settings: "), F.col("setting")))).when(times > 1, F.raise_error(F.concat(F.lit("repeated setting: "), F.col("setting")))).otherwise(F.lit(0))
    checked = named.withColumn("_ok", guard.cast("int")).where("_ok = 0")
    return checked.select(
        "setting",
        F.col("value").alias("text_value"),
        F.when(F.col("setting").isin(*BOOLEAN_SETTINGS), tx.parse_bool(F.col("value"))).alias("bool_value"),
        F.when(F.col("setting").isin(*INTEGER_SETTINGS), tx.optional_int(F.col("value"))).alias("int_value"),
        F.when(F.col("setting").isin(*REAL_SETTINGS), F.col("value").try_cast("double")).alias("real_value"),
        F.when(F.endswith("setting", F.lit("_at")), tx.parse_cell_time(F.col("value"))).alias("time_value"),
    )


def watchlist(rows: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:  # SC4
    """Columns from the first filled alias; rows stay unless `active` is false."""
    get = lambda names: tx.first_filled(*(F.col(n) for n in names if n in rows.columns), F.lit(None).cast("string"))
    typed = rows.select(*(get(names).alias(c) for c, names in aliases.items() if c != "active"), tx.parse_bool(get(aliases.get("active", ["active"])), True).alias("active"))
    return typed.where(F.coalesce("active", F.lit(True)))


def recipients(rows: DataFrame, exclude: list[str], most: int, seq: str) -> DataFrame:  # SC5, A15
    """Every row with its class, the first that holds of INACTIVE, EXCLUDED, INVALID, DUPLICATE, OVER_CAP and ACCEPTED."""
    email = tx.normalize_email(F.col("email"))
    typed = rows.withColumn("_e", email).withColumn("_raw", F.lower(F.trim("email"))).withColumn("_on", tx.parse_bool(F.col("active"), True))
    early = F.when(~F.coalesce("_on", F.lit(False)), "INACTIVE").when(F.col("_raw").isin(*[x.strip().lower() for x in exclude]), "EXCLUDED").when(F.col("_e").isNull(), "INVALID")
    typed = typed.withColumn("_c", early)
    nth = F.row_number().over(Window.partitionBy("_c", "_e").orderBy(seq))
    typed = typed.withColumn("_c", F.when(F.col("_c").isNull() & (nth > 1), "DUPLICATE").otherwise(F.col("_c")))
    place = F.row_number().over(Window.partitionBy("_c").orderBy(seq))
    typed = typed.withColumn("class", F.when(F.col("_c").isNotNull(), F.col("_c")).when(place > most, "OVER_CAP").otherwise("ACCEPTED"))
    return typed.select(F.col("_e").alias("email"), "class", seq)


def health(rows: DataFrame, run_prefixes: list[str]) -> DataFrame:  # SC6
    """Receipts of runs with one of the prefixes; the prefix filter comes before any parsing."""
    mine: Column = F.lit(False)
    for p in run_prefixes:
        mine = mine | F.startswith("run_id", F.lit(p))
    return rows.where(mine).select(
        "source_id", "source_job_key", "run_id", "status", "parser_version", "failure_stage",
        tx.parse_cell_time(F.col("checked_at")).alias("checked_at"),
        tx.parse_cell_time(F.col("updated_at")).alias("updated_at"),
        F.coalesce(tx.optional_int(F.col("item_count")), F.lit(0)).alias("item_count"),
        F.coalesce(tx.optional_int(F.col("consecutive_failures")), F.lit(0)).alias("consecutive_failures"),
        tx.parse_list(F.col("reason_codes")).alias("reason_codes"),
    )
