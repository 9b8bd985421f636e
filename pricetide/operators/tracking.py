"""Tracking commands folded into the state tables.

Commands have columns `key`, `action`, `ts`, `seq`; state tables have `key` and `enabled`. A command's outcome follows
from the action before it on the same key and from whether the key was known, so no command is replayed one by one.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetide import fixed
from pricetide.functions import ids, text

ORDER = ("ts", "seq")


def keyword_commands(raw: DataFrame) -> DataFrame:
    """The trimmed name as key, null where it is refused."""
    return raw.withColumn("key", text.keyword_name(F.col("raw_key")))


def _worked_out(rows: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are worked out once a row, for all steps that use them.

    Spark copies the expression behind a column into filters and keys, but not through a generator; this one makes one
    row of each.
    """
    return rows.select("*", F.inline(F.array(F.struct(*(value.alias(name) for name, value in columns.items())))))


def url_commands(raw: DataFrame) -> DataFrame:
    """Track names a url, untrack an id; the key is the canonical url either way."""
    untrack = F.col("action") == "untrack"
    decoded = _worked_out(raw, url=F.when(untrack, ids.url_of_product_id(F.col("raw_key"))).otherwise(F.col("raw_key")))
    return _worked_out(decoded, key=ids.canonical_product_url(F.col("url")), bad_id=untrack & F.col("url").isNull()).drop("url")


def favorite_commands(raw: DataFrame) -> DataFrame:
    """Both name an id. The key is the url as it stands in the id; adding also needs it to be a product url."""
    decoded = _worked_out(raw, url=ids.url_of_product_id(F.col("raw_key")))
    named = _worked_out(decoded, canonical=ids.canonical_product_url(F.col("url")))
    accepted = F.when((F.col("action") == "remove") | F.col("canonical").isNotNull(), F.col("url"))
    return named.withColumns({"key": accepted, "bad_id": F.col("url").isNull()}).drop("url")


# Commands of a key that one task orders at a time.
SPAN_ROWS = 50_000


def _spans(named: DataFrame, rows: int) -> DataFrame:
    """Adds `span` (an hour) and `part`: equal parts of the time that a key's commands of the hour take up, so many that
    `rows` of them fall into each if they come evenly; commands of one instant stay together. Only the hours that need
    parts are joined, not all of them."""
    spread = named.withColumn("span", F.date_trunc("hour", "ts"))
    at = F.unix_micros("ts")
    crowded = spread.groupBy("key", "span").agg(
        F.ceil(F.count(F.lit(1)) / rows).alias("parts"), F.min(at).alias("first"), F.max(at).alias("last")).filter("parts > 1")
    part = F.floor((at - F.col("first")) / (F.col("last") - F.col("first") + 1) * F.col("parts"))
    return spread.join(crowded, ["key", "span"], "left").withColumn("part", F.coalesce(part, F.lit(0))).drop("parts", "first", "last")


def _with_prior(commands: DataFrame, state: DataFrame, on: str, rows: int) -> DataFrame:
    """Adds `prior_action`, `prior_on` (some `on` action came before) and the stored row as `stored`.

    A window over a whole key would put a key with a third of all commands into one task. So commands are ordered
    within spans of time, each span is summed up in one row, and only those rows are ordered per key. Both start from
    one shuffle by span. Refused commands, whose key is null, need none of this and are added at the end.
    """
    span = ["key", "span", "part"]
    named = _spans(commands.filter(F.col("key").isNotNull()), rows).repartition(*span)
    inside = Window.partitionBy(*span).orderBy(*ORDER)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    is_on = F.col("action") == on
    ordered = named.withColumns({"lag": F.lag("action").over(inside), "seen": F.bool_or(is_on).over(before)})

    sums = named.groupBy(*span).agg(F.max_by("action", F.struct(*ORDER)).alias("last"), F.bool_or(is_on).alias("any"))
    across = Window.partitionBy("key").orderBy("span", "part")
    carried = (
        sums.select(
            *span,
            F.lag("last").over(across).alias("carried_action"),
            F.bool_or("any").over(across.rowsBetween(Window.unboundedPreceding, -1)).alias("carried_on"),
        )
        .join(state.select("key", F.struct("*").alias("stored")), "key", "left")
    )
    judged = ordered.join(carried, span).withColumns(
        {
            "prior_action": F.coalesce("lag", "carried_action"),
            "prior_on": F.coalesce("seen", F.lit(False)) | F.coalesce("carried_on", F.lit(False)),
        }
    )
    refused = commands.filter(F.col("key").isNull())
    return judged.select(*commands.columns, "prior_action", "prior_on", "stored").unionByName(refused, allowMissingColumns=True)


def tracking_outcomes(commands: DataFrame, state: DataFrame, codes: dict[str, str], rows: int = SPAN_ROWS) -> DataFrame:
    """Every command with `outcome` and, where it was refused, `error_code` and `error_class`.

    `codes` names the errors for `invalid`, `conflict` and `not_found`.
    """
    judged = _with_prior(commands, state, "track", rows)
    known = F.col("stored").isNotNull() | F.col("prior_on")
    tracked = (
        F.when(F.col("prior_action") == "track", True)
        .when(F.col("prior_action") == "untrack", False)
        .otherwise(F.coalesce("stored.enabled", F.lit(True)))
    )
    outcome = (
        F.when(F.col("key").isNull(), "invalid")
        .when((F.col("action") == "untrack") & known, "untracked")
        .when(F.col("action") == "untrack", "not_found")
        .when(~known, "created")
        .when(tracked, "conflict")
        .otherwise("reenabled")
    )
    judged = judged.select(*commands.columns, outcome.alias("outcome"))
    error = F.lit(None).cast("string")
    for kind, code in codes.items():
        error = F.when(F.col("outcome") == kind, F.lit(code)).otherwise(error)
    if "bad_id" in commands.columns:
        error = F.when(F.col("bad_id"), F.lit("INVALID_PRODUCT_ID")).otherwise(error)
    return with_error_class(judged.withColumn("error_code", error))


def with_error_class(outcomes: DataFrame) -> DataFrame:
    """The class and the status that go with an error code."""
    pairs = [F.lit(part) for pair in fixed.ERROR_CLASSES.items() for part in pair]
    statuses = [F.lit(part) for pair in fixed.STATUS_BY_CLASS.items() for part in pair]
    error_class = F.try_element_at(F.create_map(*pairs), F.col("error_code"))
    return outcomes.withColumn("error_class", error_class).withColumn(
        "status", F.try_element_at(F.create_map(*statuses), F.col("error_class"))
    )


KEYWORD_CODES = {
    "invalid": "INVALID_KEYWORD_NAME", "conflict": "KEYWORD_ALREADY_TRACKED", "not_found": "KEYWORD_NOT_FOUND",
}
URL_CODES = {
    "invalid": "INVALID_PRODUCT_URL", "conflict": "PRODUCT_URL_ALREADY_TRACKED", "not_found": "PRODUCT_URL_NOT_FOUND",
}


def tracking_state(commands: DataFrame, state: DataFrame) -> DataFrame:
    """The table after all commands. Rows are switched off, never deleted.

    Only the last action of a key and whether it was ever tracked matter, so this is one aggregation.
    """
    is_untrack = F.col("action") == "untrack"
    done = commands.filter(F.col("key").isNotNull()).groupBy("key").agg(
        (F.max_by("action", F.struct(*ORDER)) == "track").alias("on"),
        F.bool_or(~is_untrack).alias("ever_on"),
        F.bool_or(is_untrack).alias("ever_off"),
    )
    stored = state.select("key", "enabled", F.lit(True).alias("known"))
    known = F.coalesce("known", F.lit(False))
    untouched = F.col("on").isNull() | (known & ~F.col("ever_off") & F.coalesce("enabled", F.lit(True)))
    return (
        stored.join(done, "key", "full")
        .filter(known | F.col("ever_on"))
        .select("key", F.when(untouched, F.col("enabled")).otherwise(F.col("on")).alias("enabled"))
    )


def favorite_outcomes(commands: DataFrame, state: DataFrame, rows: int = SPAN_ROWS) -> DataFrame:
    """Adding and removing never fail on a good id; `added` marks the commands that made a favourite.

    `state` has `key` and `addedAt`.
    """
    judged = _with_prior(commands, state, "add", rows)
    listed = F.coalesce(F.col("prior_action") == "add", F.col("stored").isNotNull())
    outcome = (
        F.when(F.col("key").isNull(), "invalid").when(F.col("action") == "remove", "removed").when(listed, "already_favorite").otherwise("added")
    )
    judged = judged.select(*commands.columns, outcome.alias("outcome"))
    error = F.when(
        F.col("outcome") == "invalid",
        F.when(F.col("bad_id"), "INVALID_PRODUCT_ID").otherwise("INVALID_PRODUCT_URL"),
    )
    return with_error_class(judged.withColumn("error_code", error))


def favorite_state(commands: DataFrame, state: DataFrame) -> DataFrame:
    """The favourites after all commands, each with the time it was added first since it was last removed.

    What was added before a key's last removal does not matter, so this needs that removal, the last action, and the
    first addition after the removal: two aggregations, and a join that Spark can split.
    """
    order = F.struct(*ORDER)
    named = commands.filter(F.col("key").isNotNull()).select("key", "action", *ORDER)
    done = named.groupBy("key").agg(
        (F.max_by("action", order) == "add").alias("on"),
        F.max(F.when(F.col("action") == "remove", order)).alias("removed"),
    )
    removed = done.filter("on").select("key", "removed")
    fresh = named.filter(F.col("action") == "add").join(removed, "key").filter(F.col("removed").isNull() | (order > F.col("removed")))
    added = fresh.groupBy("key").agg(F.min("ts").alias("added_ts"))
    return (
        state.join(done.join(added, "key", "left"), "key", "full")
        .filter(F.coalesce("on", F.lit(True)))
        # A favourite that was stored and not removed since keeps its time.
        .select("key", F.coalesce(F.when(F.col("removed").isNull(), F.col("addedAt")), "added_ts", "addedAt").alias("addedAt"))
    )


def tracking_from_favorites(commands: DataFrame) -> DataFrame:
    """T5: adding a favourite also tracks its canonical url; being tracked already is no error here."""
    return commands.filter((F.col("action") == "add") & F.col("key").isNotNull()).select(
        F.col("canonical").alias("key"), F.lit("track").alias("action"), *ORDER
    )


def seeded(keywords: DataFrame, defaults: DataFrame) -> DataFrame:
    """The defaults, switched on, if the table is empty; else the table as it is."""
    fresh = defaults.select("keyword", F.lit(True).alias("enabled")).where(~keywords.exists())
    return keywords.select("keyword", "enabled").unionByName(fresh)
