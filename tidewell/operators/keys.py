"""Operators on keyed rows: latest, best, first, known, published, merged. `seq` is the order of ingestion.

All windows partition by a key and keep one row, so Spark limits each group before the shuffle; history sides are plain
joins that adaptive execution broadcasts when they turn out small.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import text as tx

#: Entities of several rows up to which their ids go to all executors; more of them are joined by a shuffle.
FEW = 100_000


def _top(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def latest(df: DataFrame, keys: list[str], version: str, seq: str) -> DataFrame:  # W1
    """The row of greatest version for each key; of equals the one read first."""
    return _top(df, keys, [F.desc(version), F.asc(seq)])


def last_read(df: DataFrame, keys: list[str], seq: str) -> DataFrame:  # W6
    return _top(df, keys, [F.desc(seq)])


def best(df: DataFrame, keys: list[str], order: list[Column], seq: str) -> DataFrame:  # W2
    """The first row by the given order; of equals the one read first."""
    return _top(df, keys, [*order, F.asc(seq)])


def first(df: DataFrame, keys: list[str], seq: str) -> DataFrame:  # W3
    return _top(df, keys, [F.asc(seq)])


def best_in_place(df: DataFrame, key: str, score: str, seq: str, most: int | None = None) -> DataFrame:  # W4
    """The best row of each key with `place`, where the key first appeared; the first `most` of them by place."""
    seen = df.withColumn("place", F.min(seq).over(Window.partitionBy(key)))
    kept = _top(seen, [key], [F.desc(score), F.asc(seq)])
    return kept if most is None else kept.orderBy("place").limit(most)


def newest(df: DataFrame, ts: str, seq: str) -> DataFrame:  # W5
    """The one newest row; null instants count as the oldest."""
    return df.orderBy(F.desc_nulls_last(ts), F.desc(seq)).limit(1)


def unknown(df: DataFrame, known_ids: DataFrame, known_hashes: DataFrame, id_column: str, hash_column: str) -> DataFrame:  # J3
    """Rows whose id is not among the known ids and whose hash is not among the known hashes: two anti joins, no OR."""
    return df.join(known_ids.select(id_column).distinct(), id_column, "left_anti").join(known_hashes.select(hash_column).distinct(), hash_column, "left_anti").select(df.columns)


def unpublished(df: DataFrame, history: DataFrame, kinds: dict[str, list[str]]) -> DataFrame:  # J4
    """Rows none of whose keys was published. kinds: a column of df, and the columns of history that hold such keys;
    blanks on either side match nothing."""
    for column, sources in kinds.items():
        values = reduce(DataFrame.unionByName, [history.select(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")).alias("_v")) for c in sources])
        df = df.join(values.where(F.col("_v").isNotNull()).distinct(), F.nullif(F.trim(F.col(column).cast("string")), F.lit("")) == F.col("_v"), "left_anti")
    return df


def key_index(parts: list[DataFrame]) -> DataFrame:  # A10, U2
    return reduce(DataFrame.unionByName, parts).distinct()


def retryable(index: DataFrame, policy_version: str, include_needs_primary: bool) -> DataFrame:  # ST8
    """The entries of an index (stage, reasons, policy_version) that suppress a candidate: drops of this policy version
    or newer ones never come back; rows that only need a primary source come back if so asked; errors always do."""
    dropped = F.array_contains("reasons", "EVIDENCE_DROP") & (F.col("policy_version") == policy_version)
    waiting = F.array_contains("reasons", "NEEDS_PRIMARY_SOURCE") & F.lit(not include_needs_primary)
    return index.where((F.col("stage") == "evidence_guard") & (dropped | waiting))


def merge(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:  # SK1
    """Whole-row replacement by key, else append. Columns that the target lacks are dropped, those that the source lacks
    become null. Errors: a key column missing, a blank key, or a key twice in the source."""
    missing = [k for k in keys if k not in target.columns or k not in source.columns]
    if missing:
        raise ValueError(f"missing key columns: {missing}")
    count = F.count("*").over(Window.partitionBy(*keys))
    blank = reduce(lambda a, b: a | b, [F.col(k).isNull() | (F.trim(F.col(k).cast("string")) == "") for k in keys])
    guard = F.when(blank, F.raise_error(F.lit("blank key value"))).when(count > 1, F.raise_error(F.lit("duplicate key in batch"))).otherwise(F.lit(0))
    checked = source.withColumn("_ok", guard.cast("int")).where("_ok = 0").drop("_ok")
    shaped = checked.select(*((F.col(c).cast(t) if c in source.columns else F.lit(None).cast(t)).alias(c) for c, t in target.dtypes))
    return target.join(shaped.select(*keys), keys, "left_anti").select(target.columns).unionByName(shaped)


def compare_and_set(target: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:  # SK11
    """Changes (key, expected_<c>, new_<c>) applied only if every row still holds what is expected; otherwise an error."""
    named = F.col("_m").isNotNull()
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"expected_{c}")) for c in columns])
    joined = target.join(changes.withColumn("_m", F.lit(1)), key, "left")
    new = lambda c: F.when(~named, F.col(c)).when(same, F.col(f"new_{c}")).otherwise(F.raise_error(F.concat(F.lit("row changed: "), F.col(key).cast("string"))).cast(target.schema[c].dataType))
    return joined.select(*(new(c).alias(c) if c in columns else F.col(c) for c in target.columns))


def append_absent(target: DataFrame, source: DataFrame, key: str, id_column: str, prefix: str, seq: str) -> DataFrame:  # SK12, A19
    """Rows of the source whose key the target lacks, with the next ids <prefix><n>, of three digits at least, in order of seq. Only these rows,
    which are few, are numbered in one place."""
    top = target.agg(F.coalesce(F.max(F.regexp_extract(id_column, rf"^{prefix}(\d+)$", 1).try_cast("int")), F.lit(0)).alias("_top"))
    fresh = first(source.join(target.select(key), key, "left_anti"), [key], seq)
    numbered = fresh.withColumn("_n", F.row_number().over(Window.orderBy(seq))).crossJoin(F.broadcast(top))  # one row
    number = (F.col("_top") + F.col("_n")).cast("string")
    return numbered.withColumn(id_column, F.concat(F.lit(prefix), F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number))).drop("_n", "_top")


def labels_once(df: DataFrame, entity: str, arrays: list[str], key) -> DataFrame:  # W13
    """The labels of some array columns in order, each once by its key: rows (entity, n, label). An entity of one row is settled within it,
    by sorting its labels; only entities of several rows, which are counted first, meet by a shuffle."""
    rows = df.select(entity, F.concat(*(F.coalesce(F.col(a), F.array().cast("array<string>")) for a in arrays)).alias("_all"))
    several = rows.groupBy(entity).agg(F.count("*").alias("_rows")).where("_rows > 1").select(F.col(entity).alias("_entity"))
    n_several = several.count()
    met = (F.broadcast(several) if n_several <= FEW else several, F.col(entity).eqNullSafe(F.col("_entity")))
    alone = rows.join(*met, "left_anti") if n_several else rows
    keyed = F.sort_array(F.transform("_all", lambda x, k: F.struct(key(x).alias("key"), k.alias("pos"), x.alias("label"))))
    new = lambda s: F.filter(s, lambda x, k: (x["key"] != "") & ((k == 0) | ~x["key"].eqNullSafe(F.get(s, k - 1)["key"])))
    once = F.sort_array(F.transform(tx.let(keyed, new), lambda x: F.struct(x["pos"], x["label"])))
    # An outer explode, as Spark would put the size of an inner one's array, made a second time, into a filter before it.
    out = alone.select(entity, F.posexplode_outer(once).alias("n", "_x")).where("n is not null").select(entity, (F.col("n") + 1).alias("n"), F.col("_x.label").alias("label"))
    if not n_several:
        return out
    listed = rows.join(*met, "left_semi").select(entity, F.posexplode("_all").alias("pos", "label")).withColumn("_k", key(F.col("label")))
    kept = first(listed.where(F.col("_k") != ""), [entity, "_k"], "pos")
    return out.unionByName(kept.select(entity, F.row_number().over(Window.partitionBy(entity).orderBy("pos")).alias("n"), "label"))
