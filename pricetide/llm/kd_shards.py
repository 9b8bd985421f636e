"""K-d tree partitioning: split at weighted medians along the widest dimension until leaves reach the target bytes."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide.llm.common import stored, with_slots

GRID = 2**30
BUCKETS = 4096
# Nodes whose cuts are searched for in one pass.
OPEN = 4096
# Groups of equal texts of more than this share of a shard are dealt out in parts of that share.
LARGE_CLASS, LARGE_PART = 0.1, 1 / 64


@dataclass
class Cut:
    """A search for the point that has `wanted` of a node's weight before it, along (key, second key)."""

    node: int
    dim: int
    wanted: float
    level: int = 0  # 0: along the key, 1: along the second key, among the rows at `key`
    low: int = 0
    high: int = 2**62
    before: float = 0.0
    key: int = 0
    done: bool = False


def text_order(text: Column) -> Column:
    """A number that orders strings by their first six bytes."""
    head = F.substring(F.rpad(F.coalesce(text, F.lit("")), 6, " ").cast("binary"), 1, 6)
    return F.conv(F.hex(head), 16, 10).cast("double")


def kd_shards(
    rows: DataFrame, dims: dict[str, Column], weight: Column, tie: Column, ident: Column, leaves: int | None = None,
    target: int | None = None, tolerance: float = 1e-4,
) -> DataFrame:
    """The rows with a column `shard`, 0 to leaves - 1.

    `leaves` or `target` (weight per leaf) says how far to split. A node with n leaves is cut along the dimension that
    is widest there (as a share of its width over all rows), at the point with n // 2 of n parts of its weight before
    it. Rows that lie at the same place go by a hash of `tie`, then by a hash of `ident`: rows of equal `tie` stay
    together unless a cut passes through them. A cut is as exact as one row, or `tolerance` of the node's weight.

    Null dimensions lie below all others. Rows equal in everything, `ident` included, can't be told apart and go to the
    same side. An empty table stays empty.

    The driver sees one row per node, and histograms: at most BUCKETS * 64 sums per pass, which looks at OPEN nodes at most.
    """
    spark = rows.sparkSession
    names = list(dims)
    held = rows.withColumns({f"__x{i}": dims[d].cast("double") for i, d in enumerate(names)})
    held = held.withColumns({
        "__w": weight.cast("long"),
        "__tie": F.xxhash64(tie).bitwiseAND(2**32 - 1),
        "__second": F.shiftrightunsigned(F.xxhash64(ident), 2),
    })
    held = stored(held)
    ends = held.agg(F.sum("__w").alias("w"), *[f(f"__x{i}").alias(f"{n}{i}") for i in range(len(names)) for n, f in (("a", F.min), ("b", F.max))]).first()
    if not ends.w:
        return held.select(*rows.columns, F.lit(0).alias("shard"))
    leaves = leaves or max(1, -(-ends.w // target))

    def place(i: int) -> Column:
        low, high = ends[f"a{i}"], ends[f"b{i}"]
        width = (high - low) if high is not None and high > low else 1.0
        return F.coalesce(((F.col(f"__x{i}") - F.lit(low or 0.0)) / width * (GRID - 2)).cast("long") + 1, F.lit(0))

    held = held.withColumns({f"__c{i}": place(i) for i in range(len(names))}).withColumn("__node", F.lit(0))
    held = held.select(*rows.columns, "__w", "__tie", "__second", "__node", *[f"__c{i}" for i in range(len(names))])
    parts = {0: (0, leaves)}  # node: its first leaf and its number of leaves
    while any(n > 1 for _, n in parts.values()):
        open_nodes = [k for k, (_, n) in parts.items() if n > 1]
        some = held.filter(F.col("__node").isin(open_nodes)) if len(open_nodes) <= 64 else held
        spans = some.groupBy("__node").agg(
            F.sum("__w").alias("w"), *[f(f"__c{i}").alias(f"{n}{i}") for i in range(len(names)) for n, f in (("a", F.min), ("b", F.max))]).collect()
        spans = [r for r in spans if parts[r["__node"]][1] > 1]
        cuts = []
        for r in spans:
            widest = max(range(len(names)), key=lambda i: r[f"b{i}"] - r[f"a{i}"])
            n = parts[r["__node"]][1]
            cuts.append(Cut(r["__node"], widest, r.w * (n // 2) / n))
        sized = {r["__node"]: r.w for r in spans}
        while not all(c.done for c in cuts):
            cuts = _pass(spark, held, cuts, sized, tolerance)
        held, parts = _split(spark, held, cuts, parts)
        held = stored(held)
    first = spark.createDataFrame([(k, a) for k, (a, _) in parts.items()], "__leaf int, shard int")
    joined = held.join(F.broadcast(first), held["__node"] == first["__leaf"])
    return joined.select(*[held[c] for c in rows.columns], "shard")


def _cut_frame(spark, cuts: list[Cut]) -> DataFrame:
    values = [(c.node, c.dim, c.level, c.low, c.high, c.key) for c in cuts]
    return spark.createDataFrame(values, "__n int, dim int, level int, low long, high long, at long")


def _keyed(held: DataFrame, cuts: DataFrame) -> DataFrame:
    """Rows of the nodes being cut, with their key: place along the node's dimension, then the hash of the tie column."""
    dims = [c for c in held.columns if c.startswith("__c")]
    place = F.element_at(F.array(*dims), F.col("dim") + 1)
    joined = held.join(F.broadcast(cuts), held["__node"] == cuts["__n"])
    return joined.withColumn("__key", F.shiftleft(place, 32).bitwiseOR(F.col("__tie")))


def _pass(spark, held: DataFrame, cuts: list[Cut], sized: dict[int, int], tolerance: float) -> list[Cut]:
    """Narrow every open search to one bucket of its range."""
    todo = [c for c in cuts if not c.done][:OPEN]
    looked_at = {c.node for c in todo}
    buckets = BUCKETS * 64 // max(64, len(todo))
    rows = _keyed(held, _cut_frame(spark, todo))
    value = F.when(F.col("level") == 0, F.col("__key")).otherwise(F.col("__second"))
    rows = rows.filter((F.col("level") == 0) | (F.col("__key") == F.col("at"))).withColumn("__v", value)
    rows = rows.filter((F.col("__v") >= F.col("low")) & (F.col("__v") < F.col("high")))
    width = F.greatest(F.lit(1), F.ceil((F.col("high") - F.col("low")) / buckets))
    sums = rows.groupBy("__node", F.expr("0L").alias("zero"), F.floor((F.col("__v") - F.col("low")) / width).alias("bucket")).agg(
        F.sum("__w").alias("w"), F.min("__v").alias("a"), F.max("__v").alias("b")).collect()
    by_node: dict[int, list] = {}
    for r in sums:
        by_node.setdefault(r["__node"], []).append((r.a, r.b, r.w))
    out = []
    for c in cuts:
        if c.done or c.node not in looked_at:
            out.append(c)
            continue
        before = c.before
        for a, b, w in sorted(by_node[c.node]):
            if before + w >= c.wanted:
                break
            before += w
        near = tolerance * sized[c.node]
        if before + w - c.wanted <= near:  # cut behind the bucket
            out.append(replace(c, low=b + 1, high=b + 1, done=True))
        elif c.wanted - before <= near:  # cut before it
            out.append(replace(c, low=a, high=a, done=True))
        elif a < b:
            out.append(replace(c, low=a, high=b + 1, before=before))
        elif c.level == 0:  # all in one place: go on along the second key
            out.append(replace(c, level=1, low=0, high=2**62, before=before, key=a))
        else:  # rows with one identity: the nearer side
            behind = before + w - c.wanted < c.wanted - before
            out.append(replace(c, low=b + 1 if behind else a, done=True))
    return out


def _split(spark, held: DataFrame, cuts: list[Cut], parts: dict[int, tuple[int, int]]):
    """Send the rows of every cut node to its two children."""
    fresh = max(parts) + 1
    children, out = [], {k: v for k, v in parts.items() if v[1] <= 1}
    for c in cuts:
        first, n = parts[c.node]
        children.append((c.node, fresh, fresh + 1))
        out[fresh], out[fresh + 1] = (first, n // 2), (first + n // 2, n - n // 2)
        fresh += 2
    frame = _cut_frame(spark, cuts).join(spark.createDataFrame(children, "__m int, left int, right int"), F.col("__n") == F.col("__m"))
    dims = [c for c in held.columns if c.startswith("__c")]
    joined = held.join(F.broadcast(frame), held["__node"] == frame["__n"], "left")
    key = F.shiftleft(F.element_at(F.array(*dims), F.col("dim") + 1), 32).bitwiseOR(F.col("__tie"))
    left = F.when(F.col("level") == 0, key < F.col("low")).otherwise(
        (key < F.col("at")) | ((key == F.col("at")) & (F.col("__second") < F.col("low"))))
    node = F.when(F.col("__n").isNull(), F.col("__node")).when(left, F.col("left")).otherwise(F.col("right"))
    return joined.withColumn("__new", node).select(*[F.col("__new").alias("__node") if c == "__node" else held[c] for c in held.columns]), out


def document_shards(docs: DataFrame, leaves: int | None = None, target: int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every document; `size`: UTF-8 bytes of the text, plus 1.

    What is cut are classes of equal texts, each at the smallest id, language and source that it has, so that they stay
    whole; but a class of more than LARGE_CLASS of a shard is dealt by a hash of the id into parts of LARGE_PART of one.
    Dimensions: logarithm of the size, language, source and id. A null text has size 1 and the checksum of an empty one;
    null ids are kept and ordered first.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = stored(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("hash"), F.col("lang").alias("lang"), F.col("source").alias("source")))
    equal = ["hash", "text_crc32", "size"]
    total = sized.agg(F.sum("size")).first()[0] or 0
    shard = total / leaves if leaves else target
    large = sized.groupBy(*equal).agg(F.sum("size").alias("w")).filter(F.col("w") > LARGE_CLASS * shard)
    large = large.select(*equal, F.ceil(F.col("w") / (LARGE_PART * shard)).alias("parts"))
    # There are fewer than ten per shard.
    dealt = sized.join(F.broadcast(large), equal, "left").withColumn(
        "part", F.coalesce(F.pmod(F.xxhash64("doc_id", F.lit(6)), "parts"), F.lit(0)).cast("int"))
    dealt = stored(dealt.select("doc_id", *equal, "lang", "source", "part"))
    classes = dealt.groupBy(*equal, "part").agg(
        F.sum("size").alias("w"), F.min("doc_id").alias("first"), F.min("lang").alias("lang"), F.min("source").alias("source"))
    dims = {"size": F.log2(F.col("size")), "lang": text_order(F.col("lang")), "source": text_order(F.col("source")), "id": F.col("first")}
    cut = kd_shards(classes, dims, F.col("w"), F.struct("hash", "text_crc32"), F.struct(*equal, "part"), leaves, target)
    placed = dealt.select("doc_id", *equal, "part").join(cut.select(*equal, "part", "shard"), [*equal, "part"])
    placed = placed.select("doc_id", "size", "text_crc32", "shard").withColumn("shuffled", F.xxhash64("text_crc32", "doc_id"))
    return with_slots(placed, "shard", ["shuffled", "doc_id"], "slot").drop("shuffled")
