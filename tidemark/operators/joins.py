"""Joins between users, items, events and their feature tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import skew
from tidemark.functions import timefn as tf
from tidemark.session import AS_OF


def with_features(entities: DataFrame, features: DataFrame, key: str) -> DataFrame:
    """Left 1:1 join of users or items with their feature rows."""
    return entities.join(features, key, "left")


def active_known_users(events: DataFrame, users: DataFrame, as_of: str = AS_OF, days: int = 7) -> DataFrame:
    """Distinct active users that exist in the user table."""
    active = events.filter(tf.since("event_time", as_of, days=days)).select("user_id").distinct()
    return active.join(users.select("user_id"), "user_id", "left_semi").agg(F.count(F.lit(1)).alias("active_users"))


def similar_by_attribute(items: DataFrame, events: DataFrame, k: int = 10) -> DataFrame:
    """Per item the k most used active items of the same category or the same type.

    Only the best 2k + 2 items of each category and type can appear in any list (the item
    itself and items shared by both lists drop out), so every item joins two short lists
    instead of all items of its group.
    """
    uses = events.groupBy("item_id").agg(F.count(F.lit(1)).alias("uses"))
    ranked = items.filter("is_active").select("item_id", "category", "item_type").join(uses, "item_id", "left")
    ranked = ranked.withColumn("uses", F.coalesce("uses", F.lit(0)))
    short = None
    for attr in ("category", "item_type"):
        heads = skew.rank_rows(ranked.filter(F.col(attr).isNotNull()), [attr], [F.desc("uses"), F.asc("item_id")], k + 1, "_r")
        lists = heads.groupBy(attr).agg(F.collect_list(F.struct(F.col("item_id").alias("other_id"), "uses")).alias("l"))
        part = items.select("item_id", attr).join(lists, attr).select("item_id", F.explode("l").alias("e")).select("item_id", "e.*")
        short = part if short is None else short.unionByName(part)
    pairs = short.filter(F.col("item_id") != F.col("other_id")).distinct()
    return skew.rank_rows(pairs, ["item_id"], [F.desc("uses"), F.asc("other_id")], k)


def candidates(users: DataFrame, items: DataFrame, seen: DataFrame, k: int) -> DataFrame:
    """Up to k unseen active items per user, lowest ids first.

    Items get a global place; a user needs at most the first k + (seen items) places, which
    are matched by an equi-join on the place.
    """
    from tidemark.functions.stage import global_places, maybe_broadcast, stage

    places = stage(global_places(items.filter("is_active").select("item_id"), [F.asc("item_id")]), "candidate-places")
    size = places.count()
    known = seen.select("user_id", "item_id").distinct()
    held = known.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    need = users.select("user_id").join(held, "user_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    upto = F.least(F.col("n") + k, F.lit(size))
    spots = need.select("user_id", F.explode(F.sequence(F.lit(1), upto.cast("long"))).alias("place"))
    fresh = spots.join(maybe_broadcast(places), "place").join(known, ["user_id", "item_id"], "left_anti")
    return skew.rank_rows(fresh, ["user_id"], [F.asc("item_id")], k).select("user_id", "item_id", "rank")
