"""Access control: user views, topic patterns, verdicts and delivery checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stallkeeper.functions.scalar import classify

READ, WRITE, READ_WRITE, SUBSCRIBE = 1, 2, 3, 4


def active_users(users: DataFrame) -> DataFrame:
    return users.filter("is_active").select("username", F.col("password_hash").alias("password"))


def superusers(users: DataFrame) -> DataFrame:
    return users.filter("is_active").select("username", F.col("is_admin").alias("is_superuser"))


def superuser_count(requests: DataFrame, users: DataFrame) -> DataFrame:
    """Number of active superuser rows per requested user name."""
    flags = superusers(users).groupBy("username").agg(F.count_if("is_superuser").alias("superusers"))
    return requests.join(flags, "username", "left").fillna({"superusers": 0})


def user_rules(users: DataFrame, user_acls: DataFrame) -> DataFrame:
    active = users.filter("is_active").select(F.col("id").alias("user_id"), "username")
    return active.join(user_acls, "user_id").select("username", F.col("topic_pattern").alias("topic"), F.col("access_type").alias("rw"))


def device_rules(users: DataFrame, devices: DataFrame, device_acls: DataFrame) -> DataFrame:
    active = users.filter("is_active").select(F.col("id").alias("user_id"), "username")
    owned = devices.filter("is_active").select(F.col("id").alias("device_id"), "user_id")
    rules = active.join(owned, "user_id").join(device_acls, "device_id")
    return rules.select("username", F.col("topic_pattern").alias("topic"), F.col("access_type").alias("rw"))


def all_rules(users: DataFrame, devices: DataFrame, user_acls: DataFrame, device_acls: DataFrame) -> DataFrame:
    return user_rules(users, user_acls).unionByName(device_rules(users, devices, device_acls))


def topic_matches(topic: Column, pattern: Column) -> Column:
    """`+` is one level, a last `#` is the parent and everything below. Levels are compared as text, not as a regex."""
    t, p = F.split(topic, "/", -1), F.split(pattern, "/", -1)
    open_end = F.element_at(p, -1) == "#"
    n = F.size(p) - F.when(open_end, 1).otherwise(0)
    sizes = F.when(open_end, F.size(t) >= n).otherwise(F.size(t) == n)
    same = F.zip_with(F.slice(p, F.lit(1), n), F.slice(t, F.lit(1), n), lambda a, b: (a == "+") | (a == b))
    return sizes & F.forall(same, lambda x: F.coalesce(x, F.lit(False)))


def pattern_shape(pattern: Column) -> Column:
    """The pattern with every plain level as x: which levels are wild, how many there are, whether the end is open."""
    p = F.split(pattern, "/", -1)
    marks = F.transform(p, lambda level, i: F.when(level == "+", "+").when((level == "#") & (i == F.size(p) - 1), "#").otherwise("x"))
    return F.array_join(marks, "/")


def pattern_of(topic: Column, shape: Column) -> Column:
    """The only pattern of this shape that matches the topic; NULL when the depths differ."""
    t, s = F.split(topic, "/", -1), F.split(shape, "/", -1)
    open_end = F.element_at(s, -1) == "#"
    n = F.size(s) - F.when(open_end, 1).otherwise(0)
    fits = F.when(open_end, F.size(t) >= n).otherwise(F.size(t) == n)
    levels = F.zip_with(F.slice(s, F.lit(1), n), F.slice(t, F.lit(1), n), lambda a, b: F.when(a == "+", a).otherwise(b))
    tail = F.when(open_end, F.array(F.lit("#"))).otherwise(F.array().cast("array<string>"))
    return F.when(fits, F.array_join(F.concat(levels, tail), "/"))


def match_rules(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules of the same user whose pattern matches the request's topic, as hash joins.

    A topic is not tested against every rule of its user. Each distinct shape among the user's patterns turns the topic
    into one candidate pattern, which is looked up by equality, so work grows with shapes (a handful), not with rules.
    """
    shapes = rules.select("username", pattern_shape(F.col("topic")).alias("shape")).distinct()
    candidates = (
        requests.join(shapes, "username")
        .withColumn("pattern", pattern_of(F.col("topic"), F.col("shape")))
        .filter("pattern IS NOT NULL")
        .drop("shape")
    )
    named = rules.select("username", F.col("topic").alias("pattern"), F.col("rw").alias("granted"))
    return candidates.join(named, ["username", "pattern"])


def decide(requests: DataFrame, users: DataFrame, rules: DataFrame, superuser_bypass: bool = False, exact_code: bool = False) -> DataFrame:
    """Verdict per request (username, topic, rw): unknown_user, superuser, allowed or denied.

    Each distinct (user, topic, code) is decided once and joined back. exact_code grants only an equal code; otherwise
    the read-write code grants any request.
    """
    asked = ["username", "topic", "rw"]
    matched = match_rules(requests.select(*asked).distinct(), rules)
    grant = F.col("granted") == F.col("rw")
    if not exact_code:
        grant = grant | (F.col("granted") == READ_WRITE)
    granted = matched.filter(grant).select(*asked).distinct().withColumn("granted", F.lit(True))
    known = superusers(users).groupBy("username").agg(F.bool_or("is_superuser").alias("is_superuser"))
    joined = requests.join(known, "username", "left").join(granted, asked, "left")
    verdict = F.when(F.col("is_superuser").isNull(), "unknown_user")
    if superuser_bypass:
        verdict = verdict.when(F.col("is_superuser"), "superuser")
    verdict = verdict.when(F.col("granted"), "allowed").otherwise("denied")
    return joined.select(*requests.columns, verdict.alias("verdict"))


def delivery_report(expected: DataFrame, seen: DataFrame) -> DataFrame:
    """Outcome per test id: OK, MISSING, LEAK, BLOCKED_OK, or UNPLANNED when no test announced it."""
    arrived = seen.select("test_id").distinct().withColumn("arrived", F.lit(True))
    both = expected.select("test_id", "expected_delivery").join(arrived, "test_id", "full_outer").fillna({"arrived": False})
    outcome = (
        F.when(F.col("expected_delivery").isNull(), "UNPLANNED")
        .when(F.col("expected_delivery"), F.when(F.col("arrived"), "OK").otherwise("MISSING"))
        .otherwise(F.when(F.col("arrived"), "LEAK").otherwise("BLOCKED_OK"))
    )
    return both.withColumn("outcome", outcome)


def run_summary(results: DataFrame) -> DataFrame:
    """Totals of a test run: connected, failed, and what should be delivered or blocked among the connected."""
    connected = F.col("connected")
    return results.agg(
        F.count("*").alias("tests"),
        F.count_if(connected).alias("connected"),
        F.count_if(~connected).alias("failed"),
        F.count_if(connected & F.col("expected_delivery")).alias("should_deliver"),
        F.count_if(connected & ~F.col("expected_delivery")).alias("should_block"),
    )


def classify_messages(messages: DataFrame) -> DataFrame:
    return messages.withColumn("delivery_class", classify(F.col("payload")))
