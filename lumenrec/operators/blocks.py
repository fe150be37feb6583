"""Texts to token blocks for language-model training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..sources.tables import stored


def tokens(text: Column) -> Column:
    """Words of a text: a stand-in for a model's tokenizer, which is any function from text to array."""
    return F.filter(F.split(text, r"[ \t\r\n\f\x0B]+"), lambda w: w != "")


def numbered(df: DataFrame, order: str, rows: int) -> DataFrame:
    """df with batch: rows rows in a row, by order, a column of any type that can be ordered. Counts per range of order give each range its offset, so no task sees all rows."""
    if isinstance(df.schema[order].dataType, NumericType):  # a null comes first
        parts = df.withColumn("_part", F.coalesce(F.floor(F.col(order) / (rows * 64)).cast("bigint"), F.lit(-(1 << 62))))
    else:
        parts = stored(df.repartitionByRange(order).withColumn("_part", F.spark_partition_id().cast("bigint")), "ranges")
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_size"))
    before = sizes.withColumn("_shard", F.floor(F.col("_part") / 4096))
    shards = before.groupBy("_shard").agg(F.sum("_size").alias("_sum"))
    shards = shards.withColumn("_base", F.coalesce(F.sum("_sum").over(Window.orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    within = F.coalesce(F.sum("_size").over(Window.partitionBy("_shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = before.withColumn("_within", within).join(shards, "_shard").select("_part", (F.col("_base") + F.col("_within")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1
    return parts.withColumn("_place", place).join(before, "_part").withColumn("batch", F.floor((F.col("_before") + F.col("_place")) / rows).cast("bigint")).drop("_part", "_place", "_before")


def group_texts(df: DataFrame, order: str, token_list: Column, block: int = 128, rows: int = 1000) -> DataFrame:
    """batch, block, input_ids, labels: the tokens of each batch of rows, end to end in order, in blocks of block; the rest of a batch is dropped.

    Rows are shuffled as they are and cut into tokens where their batch meets, as lists of tokens take several times the room.
    """
    each = numbered(df.select(F.col(order).alias("_o"), F.struct("*").alias("_row")), "_o", rows)
    each = each.select("_o", F.col("batch").alias("_batch"), "_row").repartition("_batch").select("_o", "_batch", "_row.*")
    joined = each.select("_o", F.col("_batch").alias("batch"), token_list.alias("_t")).groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("_o", "_t"))).alias("_all"))
    joined = joined.select("batch", F.flatten(F.transform("_all", lambda x: x["_t"])).alias("_ids")).withColumn("_n", F.floor(F.size("_ids") / block).cast("int")).where("_n > 0")
    cut = joined.select("batch", "_ids", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("block"))
    return cut.select("batch", "block", F.slice("_ids", F.col("block") * block + 1, block).alias("input_ids")).withColumn("labels", F.col("input_ids"))


def hash_split(df: DataFrame, key: str, test_tenths: int = 1) -> DataFrame:
    """df with split: test for about so many tenths of the keys, by their MD5, and train for the rest; the same for ever."""
    tenth = F.pmod(F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("bigint"), F.lit(10))
    return df.withColumn("split", F.when(tenth < test_tenths, "test").otherwise("train"))


def mask_tokens(df: DataFrame, column: str = "input_ids", share: float = 0.15, seed: int = 0, mask: str = "[MASK]") -> DataFrame:
    """df with masked: each token replaced by mask with probability share, by the MD5 of its place and text, so reruns agree."""

    def drawn(x, k):
        place = F.concat_ws(" ", F.lit(str(seed)), F.col("batch").cast("string"), F.col("block").cast("string"), k.cast("string"), x)
        return F.pmod(F.conv(F.substring(F.md5(place), 1, 8), 16, 10).cast("bigint"), F.lit(1_000_000)) < int(share * 1_000_000)

    return df.withColumn("masked", F.transform(column, lambda x, k: F.when(drawn(x, k), F.lit(mask)).otherwise(x)))


def _share(*parts: Column) -> Column:
    """A number of 60 bits by the MD5 of parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(" ", *[p.cast("string") for p in parts])), 1, 15), 16, 10).cast("bigint")


def token_spans(df: DataFrame, column: str = "input_ids") -> DataFrame:
    """token, lo, hi: the tokens of all lists in the order of their MD5, each with the numbers from lo to below hi, as many as it occurs.

    Counts of 65,536 ranges of hashes come first, so no task sees all tokens.
    """
    counts = df.select(F.explode(column).alias("token")).groupBy("token").agg(F.count("*").alias("_n"))
    counts = stored(counts.withColumn("_h", F.md5("token")).withColumn("_range", F.substring("_h", 1, 4)), "token-counts")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = counts.groupBy("_range").agg(F.sum("_n").alias("_of")).select("_range", F.coalesce(F.sum("_of").over(before), F.lit(0)).alias("_before"))
    within = F.sum("_n").over(Window.partitionBy("_range").orderBy("_h", "token").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    spans = counts.withColumn("_upto", within).join(ranges, "_range")
    return spans.select("token", (F.col("_before") + F.col("_upto") - F.col("_n")).alias("lo"), (F.col("_before") + F.col("_upto")).alias("hi"))


def collate(df: DataFrame, column: str = "input_ids", share: float = 0.15, seed: int = 0, mask: str = "[MASK]", spans: DataFrame | None = None) -> DataFrame:
    """batch, block, input_ids, labels of blocks (batch, block, the tokens) as a model is trained on them.

    A share of the tokens is asked for: labels hold those, and null where nothing is asked. Of these, eight of ten are
    replaced by mask, one by a token drawn from all of the corpus as often as it occurs (spans, of df itself unless it is
    given), and one stays. All draws are by MD5 of seed and place, so reruns agree. A drawn token is found by the piece of
    the counts' range that its number falls in: an equi-join, however often a token occurs.
    """
    place = lambda k, what: _share(F.lit(f"{seed} {what}"), F.col("batch"), F.col("block"), k)
    asked = lambda k: F.pmod(place(k, "ask"), F.lit(1_000_000)) < int(share * 1_000_000)
    kinds = F.transform("_t", lambda x, k: F.when(asked(k), F.pmod(place(k, "kind"), F.lit(10)).cast("tinyint")))
    rows = stored(df.select("batch", "block", F.col(column).alias("_t")).withColumn("_kinds", kinds), "asked-tokens")
    spans = stored(token_spans(rows, "_t") if spans is None else spans, "token-spans")
    tokens, total = spans.agg(F.count("*"), F.coalesce(F.max("hi"), F.lit(1))).first()
    width = max(1, total // max(1, tokens))
    drawn = rows.select("batch", "block", F.posexplode("_kinds").alias("k", "_kind")).where("_kind = 8").drop("_kind")
    drawn = drawn.withColumn("_r", F.pmod(place(F.col("k"), "draw"), F.lit(total))).withColumn("_piece", F.floor(F.col("_r") / width))
    pieces = spans.withColumn("_piece", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))))
    found = drawn.join(pieces, "_piece").where("_r >= lo AND _r < hi").groupBy("batch", "block").agg(F.map_from_entries(F.collect_list(F.struct("k", "token"))).alias("_new"))
    both = rows.join(found, ["batch", "block"], "left")
    kind = lambda k: F.get("_kinds", k)
    changed = F.transform("_t", lambda x, k: F.when(kind(k) < 8, F.lit(mask)).when(kind(k) == 8, F.element_at("_new", k)).otherwise(x))
    return both.select("batch", "block", changed.alias("input_ids"), F.transform("_t", lambda x, k: F.when(kind(k).isNotNull(), x)).alias("labels"))
