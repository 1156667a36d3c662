"""Random order over shards by a two-pass external shuffle, in built-in functions only.

First pass: a seeded hash of the key gives each record its shard, a second one its bucket; a
shard has as many buckets as its share of the bytes needs at ``bucket_bytes`` each. Second pass:
each bucket is put into Fisher-Yates order in memory (``shuffle`` with a seed), and its records get
consecutive slots after those of the buckets before it.

The law is ``key``: a record goes to the shard whose seeded hash with its key is the largest, so
the key and the number of shards decide, and one more shard takes records only into itself.

Defined results: a null key is a key like others, a null text has no bytes, copies and repeated
rows each get a slot of their own, an empty table gives an empty result. Records of one key are
scattered over the buckets of its shard by their text, and repeated rows of one key and text that are
more than a bucket's bytes are spread evenly, so no bucket grows with one key. Columns
of the input are carried in one struct and keep their names; they may be of any type, those without an
order (maps, variants) being compared by what they hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from altcredit.llm.common import pieces_of, utf8_bytes

#: What a row counts for besides its text.
ROW_BYTES = 64


def shard_of(key: Column, shards: int, seed: int) -> Column:
    """The shard with the largest seeded hash; ties go to the lower one."""
    draws = [F.struct(F.xxhash64(F.lit(seed), F.lit(s), key).alias("h"), F.lit(-s).alias("s")) for s in range(shards)]
    return (-F.greatest(*draws)["s"]).cast("int")


def grown_shard_of(key: Column, shard: Column, shards: int, seed: int) -> Column:
    """The shard when there is one more."""
    draw = lambda s: F.xxhash64(F.lit(seed), s, key)
    return F.when(draw(F.lit(shards)) > draw(shard), F.lit(shards)).otherwise(shard).cast("int")


def ordered_form(value: Column, kind: T.DataType) -> Column:
    """A value that can be ordered and grouped by, equal where the given ones hold the same."""
    if isinstance(kind, T.VariantType):
        return F.to_json(value)
    if isinstance(kind, T.MapType):
        return F.sort_array(F.transform(F.map_entries(value), lambda e: F.struct(ordered_form(e["key"], kind.keyType).alias("key"), ordered_form(e["value"], kind.valueType).alias("value"))))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: ordered_form(x, kind.elementType))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[ordered_form(value.getField(f.name), f.dataType).alias(f.name) for f in kind]))
    return value


def has_order(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(has_order(f.dataType) for f in kind)
    return has_order(kind.elementType) if isinstance(kind, T.ArrayType) else not isinstance(kind, T.MapType | T.VariantType)


def shuffled_shards(
    docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text", seed: int = 11, bucket_bytes: int = 16 << 20
) -> DataFrame:
    """The rows of ``docs`` as struct ``row``, with ``shard``, ``grown_shard``, ``bucket`` and ``slot``."""
    shard = shard_of(F.col(f"`{key}`"), shards, seed).alias("shard")
    scatter = F.xxhash64(F.lit(seed + 1), F.col(f"`{key}`"), F.col(f"`{text}`")).alias("scatter")
    weight = utf8_bytes(f"`{text}`") + ROW_BYTES
    sizes = docs.groupBy(shard, scatter).agg(F.count("*").alias("n"), F.sum(weight).alias("size"))
    repeated = (F.col("n") > 1) & (F.col("size") > bucket_bytes)
    # One row a shard.
    found = sizes.groupBy("shard").agg(F.sum("size").alias("size"), F.max(repeated).alias("repeated")).collect()
    size = {r["shard"]: r["size"] for r in found}
    buckets = F.array(*[F.lit(pieces_of(size.get(s, 0), bucket_bytes)) for s in range(shards)])[F.col("shard")]
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    plain = has_order(docs.schema)
    # What rows are ordered and told apart by: they themselves, if their types have an order.
    form = F.col("row") if plain else ordered_form(F.col("row"), docs.schema)
    bucket = F.pmod("scatter", buckets).cast("int").alias("bucket")
    placed = docs.select(shard, scatter, row).select("shard", "scatter", bucket, "row", *([] if plain else [form.alias("form")]))
    by = "row" if plain else "form"
    if any(r["repeated"] for r in found):
        # No more rows than buckets.
        heavy = F.broadcast(sizes.where(repeated).select("scatter", F.ceil(F.col("size") / bucket_bytes).alias("parts")))
        one = [] if plain else [F.first("row").alias("row")]
        copies = placed.join(heavy, "scatter").groupBy("shard", "scatter", "bucket", by, "parts").agg(F.count("*").alias("n"), *one)
        # Equal rows in as many slices as there are buckets for them, each slice read by a task of its own.
        slices = copies.withColumn("of", F.least("parts", "n")).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("of") - 1)).alias("slice"))
        to = F.pmod(F.col("bucket") + F.pmod(F.xxhash64(by) + F.col("slice"), "parts"), buckets).cast("int").alias("bucket")
        number = (F.floor(F.col("n") / F.col("of")) + (F.col("slice") < F.col("n") % F.col("of")).cast("int")).alias("number")
        spread = slices.select("shard", "scatter", to, *placed.columns[3:], number).repartition("shard", "bucket", "scatter")
        again = spread.select(*placed.columns, F.explode(F.sequence(F.lit(1).cast("long"), "number"))).drop("col")
        placed = placed.join(heavy, "scatter", "left_anti").select(*placed.columns).unionByName(again)
    h = F.xxhash64(F.lit(seed + 2), F.col(f"row.`{key}`"), F.col(f"row.`{text}`"))
    dealt = placed.select("shard", "bucket", F.struct(h.alias("h"), by).alias("record"), "row")
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = (
        dealt.groupBy("shard", "bucket").count()
        .select("shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    )
    # Sorted before the draw, so that a task that runs again gives the same order.
    records = F.sort_array(F.collect_list("record")) if plain else _sorted_rows()
    filled = (
        dealt.groupBy("shard", "bucket").agg(records.alias("records"))
        .join(first, ["shard", "bucket"])
        .sortWithinPartitions("shard", "bucket")
    )
    drawn = filled.select("shard", "bucket", "first", F.posexplode(F.shuffle("records", seed=seed)).alias("at", "record"))
    return drawn.select(
        F.col("record.row").alias("row"),
        "shard",
        grown_shard_of(F.col(f"record.row.`{key}`"), F.col("shard"), shards, seed).alias("grown_shard"),
        "bucket",
        (F.col("first") + F.col("at")).alias("slot"),
    )


def _sorted_rows() -> Column:
    """The rows of a bucket as records, by their forms; rows of equal forms hold the same."""
    forms, rows = F.collect_list("record"), F.collect_list("row")
    order = F.sort_array(F.transform(forms, lambda x, i: F.struct(x.alias("form"), i.alias("at"))))
    return F.transform(order, lambda x: F.struct(F.get(rows, x["at"]).alias("row")))


def write_shards(shuffled: DataFrame, path: str) -> None:
    """One folder a shard, records in slot order within each file, files in bucket order."""
    rows = shuffled.repartition("shard", "bucket").sortWithinPartitions("shard", "bucket", "slot")
    rows.write.partitionBy("shard").mode("overwrite").parquet(path)
