"""Q8: tracking commands applied to the stored tables."""

import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide.operators import tracking
from pricetide.sources.tables import Tables


class Outcomes(NamedTuple):
    """What became of each command, judged against the tables as they were before. Written down before these change."""

    keywords: DataFrame | None
    urls: DataFrame | None
    favorites: DataFrame | None


def _keyed(table: DataFrame, name: str) -> DataFrame:
    return table.withColumnRenamed(name, "key")


def apply_commands(
    tables: Tables, keywords: DataFrame | None = None, urls: DataFrame | None = None, favorites: DataFrame | None = None,
) -> Outcomes:
    """Fold raw commands (raw_key, action, ts, seq) into `keywords`, `tracked_urls` and `favorites`.

    Adding a favourite tracks its url as well, at its own place among the url commands by (ts, seq). Only tables that
    commands go to are written, each as a new version; applying the same commands again leaves the tables as they are.
    Commands are decoded once and kept in a folder of their own until all tables are written.
    """
    run, judged = uuid.uuid4().hex, {}

    def judge(name: str, outcomes: DataFrame) -> None:
        judged[name] = tables.stage(f"outcomes-{name}-{run}", lambda: outcomes)

    def decoded(name: str, commands: DataFrame) -> DataFrame:
        return tables.stage(f"commands-{name}-{run}", lambda: commands)

    if keywords is not None:
        commands, state = decoded("keywords", tracking.keyword_commands(keywords)), _keyed(tables.read("keywords"), "keyword")
        judge("keywords", tracking.tracking_outcomes(commands, state, tracking.KEYWORD_CODES))
        tables.replace("keywords", _keyed_back(tracking.tracking_state(commands, state), "keyword"))

    added = None
    if favorites is not None:
        commands, state = decoded("favorites", tracking.favorite_commands(favorites)), _keyed(tables.read("favorites"), "url")
        judge("favorites", tracking.favorite_outcomes(commands, state))
        tables.replace("favorites", _keyed_back(tracking.favorite_state(commands, state), "url"))
        added = tracking.tracking_from_favorites(commands).withColumn("implied", F.lit(True))
    if urls is not None or added is not None:
        named = None if urls is None else decoded("urls", tracking.url_commands(urls)).withColumn("implied", F.lit(False))
        both = added if named is None else named if added is None else named.unionByName(added, allowMissingColumns=True)
        state = _keyed(tables.read("tracked_urls"), "url")
        if named is not None:
            judge("urls", tracking.tracking_outcomes(both, state, tracking.URL_CODES).filter(~F.col("implied")).drop("implied"))
        tables.replace("tracked_urls", _keyed_back(tracking.tracking_state(both, state), "url"))
    for name in Outcomes._fields:
        files, path = tables._path("staged", f"commands-{name}-{run}")
        files.delete(path, True)
    return Outcomes(*(judged.get(name) for name in Outcomes._fields))


def _keyed_back(state: DataFrame, name: str) -> DataFrame:
    return state.withColumnRenamed("key", name)
