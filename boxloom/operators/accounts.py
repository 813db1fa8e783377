"""Licences, storage, jobs and their audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .scan import running


def valid_uses(attempts: DataFrame) -> DataFrame:
    """The uses of each code that count, in order: the code is not revoked, has not expired at that moment,
    and fewer uses than ``allowed`` came before (dates or timestamps; what ends at the moment of use has expired).  Columns revoked, expires_on and allowed are the code's.
    """
    good = attempts.where(~F.coalesce("revoked", F.lit(False)) & (F.col("expires_on").isNull() | (F.col("expires_on") > F.col("redeemed_on"))))
    used = running(good, ["code_id"], F.date_trunc("month", "redeemed_on"), ["redeemed_on", "redemption_id"], {"use": ("count", F.lit(1))})
    return used.where("use <= allowed")


def stacked_expiry(redemptions: DataFrame) -> DataFrame:
    """Expiry after each redemption: it adds to the later of now and the running expiry.

    With S the running sum of days, E_t = S_t + max over i <= t of (day_i - S_(i-1)).
    """
    at = [["user_id"], F.date_trunc("month", "redeemed_on"), ["redeemed_on", "redemption_id"]]
    r = running(redemptions, *at, {"sum": ("sum", F.col("duration_days"))})
    lead = F.datediff("redeemed_on", F.lit("1970-01-01")) - (F.col("sum") - F.col("duration_days"))
    r = running(r, *at, {"best": ("max", lead)})
    return r.select("redemption_id", "user_id", F.date_add(F.lit("1970-01-01").cast("date"), (F.col("sum") + F.col("best")).cast("int")).alias("expires_on"))


def storage(assets: DataFrame, incoming: DataFrame | None = None, quota: int = 10 * 1024**3) -> DataFrame:
    """used per owner, and whether it goes over the quota with the ``incoming`` (owner_id, byte_size)."""
    used = F.coalesce(F.sum(F.when(F.col("status") != "deleted", F.col("byte_size"))), F.lit(0))
    per = assets.groupBy("owner_id").agg(used.alias("used"))
    if incoming is not None:
        more = incoming.groupBy("owner_id").agg(F.sum("byte_size").alias("more"))
        per = per.join(more, "owner_id", "full").na.fill(0, ["used", "more"])
    return per.withColumn("over_quota", F.col("used") + (F.col("more") if incoming is not None else 0) > quota)


def expired(assets: DataFrame, today: str) -> DataFrame:
    """Assets marked deleted, uploads begun before yesterday, and assets kept long enough."""
    day = F.lit(today).cast("date")
    return assets.where((F.col("status") == "deleted") | ((F.col("status") == "uploading") & (F.col("created_on") < F.date_sub(day, 1))) | (F.col("retained_until") < day))


def unreferenced(assets: DataFrame, pages: DataFrame, results: DataFrame, today: str) -> DataFrame:
    """Expired assets that no page names as its source or rendered image and that no job gave as its result."""
    paths = pages.select(F.explode(F.array("source_image_path", "rendered_image_path")).alias("storage_key")).where("storage_key is not null").distinct()
    given = results.select("asset_id").where("asset_id is not null").distinct()
    return expired(assets, today).join(paths, "storage_key", "left_anti").join(given, "asset_id", "left_anti")


def purge_totals(assets: DataFrame, pages: DataFrame, results: DataFrame, today: str, dry_run: bool = False) -> DataFrame:
    """purged and bytes; both are zero in a dry run, which removes nothing."""
    gone = unreferenced(assets, pages, results, today).where(F.lit(not dry_run))
    return gone.agg(F.count("*").alias("purged"), F.coalesce(F.sum("byte_size"), F.lit(0)).alias("bytes"))


def first_per_key(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row per key; rows with a null in the key never collapse."""
    nulls = F.coalesce(*[F.when(F.col(k).isNull(), True) for k in key], F.lit(False))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("__rank", rank).where((F.col("__rank") == 1) | nulls).drop("__rank")


def sequenced(events: DataFrame, key: str, order: list[str], bucket: Column) -> DataFrame:
    """Adds seq, from 0 within the key; ``bucket`` parts a key's rows and never falls in their order."""
    return running(events, [key], bucket, order, {"seq": ("count", F.lit(1))}).withColumn("seq", F.col("seq") - 1)


def counters(users: DataFrame, sessions: DataFrame, codes: DataFrame, now: str) -> DataFrame:
    """One row: users, sessions that have not expired, codes."""
    n = users.agg(F.countDistinct("user_id").alias("n")).select(F.lit("users").alias("k"), "n")
    n = n.union(sessions.agg(F.count_if(F.col("expires_at") > F.lit(now).cast("timestamp_ntz"))).select(F.lit("sessions"), "*"))
    n = n.union(codes.agg(F.countDistinct("code_id")).select(F.lit("codes"), "*"))
    return n.agg(*[F.max(F.when(F.col("k") == k, F.col("n"))).alias(k) for k in ("users", "sessions", "codes")])


def duplicate_keys(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    return child.join(parent.select(key).distinct(), key, "left_anti")
