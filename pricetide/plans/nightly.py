"""Q9-Q11: the nightly job over the stored tables."""

from pyspark.sql import Column, DataFrame

from pricetide.operators.history import price_history
from pricetide.operators.scoring import deal_scores_of_histories
from pricetide.session import sized_shuffles
from pricetide.sources.tables import Tables


def refine(tables: Tables, as_of: Column) -> int:
    """Q9: rebuild the histories of all products with snapshots; returns their number. No snapshots, no write."""
    items = tables.items()
    if items.isEmpty():
        return 0
    with sized_shuffles(tables.spark, tables.size("items_raw")):
        return tables.save_history(price_history(items, as_of))


def refine_changed(tables: Tables, changed: DataFrame, as_of: Column) -> int:
    """Q9 for the products named in `changed` only. A history depends on its own product's rows alone."""
    items = tables.items().join(changed.select("url"), "url", "left_semi")
    return tables.save_history(price_history(items, as_of))


def score(tables: Tables, as_of: Column) -> int:
    """Q10: score from the stored histories, which may hold products without recent snapshots."""
    return tables.save_scores(deal_scores_of_histories(tables.read("price_history"), as_of))


def refine_and_score(tables: Tables, as_of: Column) -> tuple[int, int]:
    """Q11."""
    return refine(tables, as_of), score(tables, as_of)
