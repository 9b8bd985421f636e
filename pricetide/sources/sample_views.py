"""Price-tracking tables derived from the given benchmark tables.

The given data has no prices of tracked products, so visits are read out of `events`, a second price series out of
`lineitem`, people's lists out of `customer` and `orders`, and product pages are the given `pages` with a product
block set in. Every row of the source goes in.
"""

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetide import fixed, schema
from pricetide.functions.ids import product_id
from pricetide.operators.history import history_entries, price_history
from pricetide.operators.scoring import deal_scores
from pricetide.operators.snapshots import daily_snapshots
from pricetide.session import prepare


def product_url(number: Column) -> Column:
    return F.concat(F.lit(fixed.PRODUCT_URL_PREFIX), F.lit("U"), F.lpad(number.cast("string"), 9, "0"), F.lit("/"))


def _text(column: str) -> Column:
    return F.col(column).cast("string")


def visits(rows: DataFrame) -> DataFrame:
    """Snapshot log from rows shaped like `events`; works on streams too."""
    # Parsed in a step of its own: the columns below use it several times.
    rows = rows.withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    k, value, kind = F.col("k"), F.col("value"), F.col("event_type")
    images = [
        F.concat(F.lit("https://img.example/images/I/u"), _text("user_id"), F.lit("._AC_US40_.jpg")),
        F.concat(F.lit("https://img.example/images/I/u"), _text("user_id"), F.lit(".jpg")),
    ]
    return rows.select(
        product_url(F.col("user_id")).alias("url"),
        F.when(k == 0, "").when(k < 99, F.concat(F.lit("Product "), _text("user_id"))).alias("title"),
        F.when(kind != "error", F.struct(value.alias("amount"), F.lit("EUR").alias("currency"))).alias("price"),
        F.when(kind == "purchase", F.struct((value * 1.25).alias("amount"), F.lit("EUR").alias("currency"))).alias(
            "crossedOutPrice"
        ),
        F.when(kind == "view", F.struct((value / 3).alias("amount"), F.lit("L").alias("unit"))).alias("unitPrice"),
        F.when(kind == "click", F.concat(F.lit("in "), (k % 5).cast("string"), F.lit(" days"))).alias("deliveryDate"),
        F.array(*images).alias("images"),
        F.lit("amazon").alias("shop"),
        F.when(k % 10 != 9, F.concat(F.lit("kw"), (k % 7).cast("string"))).alias("keyword"),
        F.col("ts").cast("timestamp").alias("scrapedAt"),
        F.col("event_id").alias("seq"),
    )


def once(build):
    """Build a view once per `SampleViews`, so that a query that uses it twice shares it."""

    @functools.wraps(build)
    def built(self, *args):
        key = (build.__name__, *args)
        if key not in self.built:
            self.built[key] = build(self, *args)
        return self.built[key]

    return built


class SampleViews:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark = prepare(spark)
        self.folder = folder
        self.built = {}

    @once
    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @once
    def items_log(self) -> DataFrame:
        return visits(self.table("events"))

    @once
    def items(self) -> DataFrame:
        return daily_snapshots(self.items_log())

    @once
    def as_of(self) -> Column:
        """The newest visit's time stands for now."""
        return self.table("events").agg(F.max("ts").cast("timestamp")).scalar()

    @once
    def history(self) -> DataFrame:
        return price_history(self.items(), self.as_of())

    @once
    def entries(self) -> DataFrame:
        """The long form of the histories is what the items hold; no array needs building for it."""
        return self.items().select("url", "day", "price", "crossedOutPrice", "unitPrice", "scrapedAt")

    def stored_entries(self) -> DataFrame:
        return history_entries(self.history())

    @once
    def scores(self) -> DataFrame:
        return deal_scores(self.entries(), self.as_of())

    @once
    def supplier_entries(self) -> DataFrame:
        """The second series: what one unit cost at each supplier on each day."""
        log = self.table("lineitem").select(
            F.concat(F.lit("supplier/"), _text("l_suppkey")).alias("url"),
            F.struct(
                (F.col("l_extendedprice") / F.col("l_quantity")).alias("amount"), F.lit("EUR").alias("currency")
            ).alias("price"),
            F.col("l_shipdate").cast("timestamp").alias("scrapedAt"),
            (F.col("l_orderkey") * 1000 + F.col("l_linenumber")).alias("seq"),
        )
        return daily_snapshots(log)

    @once
    def keywords(self) -> DataFrame:
        """Those of the items and one nobody has searched for; on, off or not said by their number."""
        seen = self.items_log().filter(F.col("keyword").isNotNull()).select("keyword").distinct()
        number = F.substring("keyword", 3, 1).cast("int")
        return seen.select("keyword", F.when(number != 5, number % 3 != 0).alias("enabled")).unionByName(
            self.spark.range(1).select(F.lit("kw_unseen").alias("keyword"), F.lit(True).alias("enabled"))
        )

    def tracked_urls(self) -> DataFrame:
        return self.table("customer").select(
            product_url(F.col("c_custkey")).alias("url"),
            F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_acctbal") > 0).alias("enabled"),
        )

    def favorites(self) -> DataFrame:
        buyers = self.table("customer").filter(F.col("c_mktsegment") == "BUILDING")
        first = self.table("orders").groupBy("o_custkey").agg(F.min("o_orderdate").cast("timestamp").alias("addedAt"))
        return buyers.join(first, buyers["c_custkey"] == first["o_custkey"]).select(
            product_url(F.col("c_custkey")).alias("url"), "addedAt"
        )

    def _commands(self, raw_key: Column, action: Column) -> DataFrame:
        return (
            self.table("events")
            .select(
                F.get_json_object("props", "$.k").cast("int").alias("k"),
                F.col("user_id").alias("number"),
                "event_type",
                F.col("ts").cast("timestamp").alias("ts"),
                F.col("event_id").alias("seq"),
            )
            .select(raw_key.alias("raw_key"), action.alias("action"), "ts", "seq")
            .filter(F.col("action").isNotNull())
        )

    def keyword_commands(self) -> DataFrame:
        k = F.col("k")
        raw = (
            F.when(k == 50, F.lit("  "))
            .when(k >= 90, F.concat(F.lit("kw_new"), (k % 13).cast("string")))
            .otherwise(F.concat(F.lit("  kw"), (k % 7).cast("string"), F.lit(" ")))
        )
        action = F.when(F.col("event_type") == "signup", "track").when(F.col("event_type") == "error", "untrack")
        return self._commands(raw, action)

    def url_commands(self) -> DataFrame:
        k, url = F.col("k"), product_url(F.col("number"))
        code = F.lower(F.regexp_extract(url, fixed.PRODUCT_LINK, 1))
        spelled = (
            F.when(k % 10 == 7, F.concat(F.lit("https://www.amazon.de/dp/"), code))
            .when(k % 10 == 8, F.concat(F.lit("https://AMAZON.fr/Some Title/dp/"), code, F.lit("?ref=x")))
            .otherwise(url)
        )
        track = F.col("event_type") == "click"
        raw = F.when(track, spelled).when(k == 33, F.lit("not/an/id")).otherwise(product_id(url))
        return self._commands(raw, F.when(track, "track").when(F.col("event_type") == "purchase", "untrack"))

    def favorite_commands(self) -> DataFrame:
        k, url = F.col("k"), product_url(F.col("number"))
        raw = (
            F.when(k == 44, F.lit("###"))
            .when(k == 45, product_id(F.lit("https://www.amazon.de/dp/B000000000")))
            .otherwise(product_id(url))
        )
        kind = F.col("event_type")
        return self._commands(raw, F.when(kind == "view", "add").when((kind == "error") & (k % 2 == 0), "remove"))

    def fetch_log(self) -> DataFrame:
        """Where each visit ended up: mostly at its product, now and then at the front page or a block page."""
        events = self.table("events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
        k, url = F.col("k"), product_url(F.col("user_id"))
        final = (
            F.when(k % 20 == 3, F.lit("https://www.amazon.fr/"))
            .when(k % 20 == 7, F.lit("https://www.amazon.fr/errors/validateCaptcha?x=1"))
            .otherwise(F.concat(url, F.lit("?th=1")))
        )
        return events.select(url.alias("url"), final.alias("final_url"), F.col("event_id").alias("seq"))

    def product_pages(self) -> DataFrame:
        """The given pages, each with a product block whose contents follow from the page's number."""
        n = F.col("page_id")
        whole, cents = _text("page_id"), F.lpad((n % 100).cast("string"), 2, "0")
        price = (
            F.when(n % 5 == 0, F.concat(F.lit("€"), whole, F.lit("."), cents))
            .when(n % 5 == 1, F.concat(F.lit("1 "), F.lpad((n % 1000).cast("string"), 3, "0"), F.lit(","), cents, F.lit(" €")))
            .when(n % 5 == 2, F.concat(F.lit("$"), whole, F.lit("."), cents))
            .when(n % 5 == 3, F.concat(whole, F.lit(" €")))
            .otherwise(F.concat(whole, F.lit(","), cents, F.lit("&nbsp;€")))
        )
        price_box = F.when(n % 2 == 0, fixed.PRICE_CLASS).otherwise(fixed.PRICE_FALLBACK_CLASS)
        other = F.lpad(((n * 7) % 1000000).cast("string"), 9, "0")
        block = F.concat(
            F.lit('<div><h1><span id="productTitle"> '), F.when(n % 11 == 10, "").otherwise(F.concat(F.lit("Page "), whole)),
            F.lit('\n</span></h1><div class="row '), price_box, F.lit(' big"><span class="a-offscreen"> '), price,
            F.lit('</span></div><div class="srpPriceBlockAUI"><b><span class="a-offscreen">'), whole, F.lit(",99 €</span></b></div>"),
            F.lit('<div>(<span class="apex-priceperunit-value">'), whole, F.lit(",18 €</span>  /\n"), F.when(n % 3 == 0, "l").otherwise("kg"), F.lit(")</div>"),
            F.lit('<div id="delivery-message">  Delivered \n in <b>'), (n % 4).cast("string"), F.lit(" days</b></div>"),
            F.lit('<div id="altImages"><img src="https://img.example/images/I/p'), whole, F.lit('._AC_US40_.jpg"><ul><li><img src="https://img.example/images/I/p'), whole,
            F.lit('.jpg"></li><li><img src=""></li></ul></div>'),
            F.lit('<div id="twister"><ul><li data-asin="P'), F.lpad(whole, 9, "0"), F.lit('"></li><li data-asin="P'), other,
            F.lit('"></li><li data-dp-url="/x/dp/P'), other, F.lit('/ref=1"></li><li data-dp-url="/dp/Q'), F.lpad(whole, 9, "0"), F.lit('/"></li></ul></div></div>'),
        )
        url = F.concat(F.lit("https://www.amazon.fr/dp/P"), F.lpad(whole, 9, "0"), F.lit("/"))
        return self.table("pages").select(
            url.alias("url"),
            F.when(n % 13 == 0, F.lit("https://www.amazon.fr/")).otherwise(url).alias("final_url"),
            F.replace("html", F.lit("<body>"), F.concat(F.lit("<body>"), block)).alias("html"),
            F.when(n % 4 != 0, F.concat(F.lit("kw"), (n % 7).cast("string"))).alias("keyword"),
            F.timestamp_seconds(F.lit(1704067200) + n * 60).alias("fetched_at"),
        )

    def search_pages(self) -> DataFrame:
        """The given pages with a list of search results set in."""
        n, whole = F.col("page_id"), F.lpad(_text("page_id"), 9, "0")
        block = F.concat(
            F.lit('<div data-component-type="s-search-result"><a class="a-link-normal s-line" href="/Name/dp/R'), whole, F.lit('/ref=sr_1?x=1">one</a></div>'),
            F.lit('<div data-component-type="s-search-result"><h2><a class="a-link-normal" href="https://www.amazon.fr/dp/r'), whole, F.lit('/">two</a></h2>'),
            F.lit('<a class="a-link-normal" href="/gp/help">help</a><a class="other" href="/dp/X'), whole, F.lit('">no</a></div>'),
            F.lit('<a class="a-link-normal" href="/dp/Y'), whole, F.lit('">outside</a>'),
            F.when(n % 3 != 0, F.concat(F.lit('<a class="s-pagination-item s-pagination-next" href="/s?k=a&amp;page='), (n % 6 + 2).cast("string"), F.lit('">next</a>'))).otherwise(""),
        )
        return self.table("pages").select(
            F.replace("html", F.lit("<body>"), F.concat(F.lit("<body>"), block)).alias("html"),
            F.concat(F.lit("kw"), (n % 7).cast("string")).alias("keyword"),
            (n % 6 + 1).cast("int").alias("page"),
        )
