"""Exact duplicates by deterministic block naming, in DataFrame operations only.

A text is cut into blocks of a fixed number of code points. Equal blocks get the same integer name: the rank of the
block among the sorted blocks of its bucket, joined with the bucket's number. Neighbouring names are then named in pairs,
and the pairs of those names, until each document has one name. Two documents have the same number of blocks and the
same last name only if their texts are equal: names are ranks of content, not hashes, so they do not collide.

Naming needs equal values in one place. Hashes are used only to route values there. A value that makes up a large part
of all rows would fill one bucket; such values (at most ``1 / HOT_SHARE`` of them) are found first, reduced to their
distinct content before any shuffle, named by sorting those few, and joined back by broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fleetfit.llm.common import stored, text_of

BLOCK_CHARS = 4096
HOT_SHARE = 0.002
HOT_ROWS = 200
ROWS_PER_BUCKET = 20_000
#: Bits of a name kept for the rank inside its bucket.
RANK_BITS = 40


def name_values(rows: DataFrame, value: list[str], name: str, keep: list[Column | str]) -> DataFrame:
    """``keep`` and an integer ``name`` that is equal exactly where the columns ``value`` are equal.

    Deterministic for the same rows: ranks of sorted content. Null is a value like any other.
    """
    spark = rows.sparkSession
    hashed = rows.withColumn("_h", F.xxhash64(*value))
    per_hash = hashed.groupBy("_h").agg(F.count(F.lit(1)).alias("n"))
    total = rows.count()
    least = max(HOT_ROWS, int(total * HOT_SHARE))
    # Each of them holds more than ``least`` rows, so there are at most 1 / HOT_SHARE.
    hot = [r["_h"] for r in per_hash.where(F.col("n") > least).select("_h").collect()]
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // ROWS_PER_BUCKET)
    is_hot = F.col("_h").isin(hot) if hot else F.lit(False)
    in_bucket = Window.partitionBy("_bucket").orderBy(*value)
    usual = (
        hashed.where(~is_hot)
        .withColumn("_bucket", F.pmod("_h", F.lit(buckets)))
        .withColumn("_rank", F.dense_rank().over(in_bucket).cast("long"))
        .select(*keep, (F.shiftleft("_bucket", RANK_BITS) + F.col("_rank")).alias(name))
    )
    if not hot:
        return usual
    few = Window.orderBy(*value)
    named = (
        hashed.where(is_hot)
        .groupBy(*value)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*[F.col(v).alias(f"_{v}") for v in value], (-F.row_number().over(few)).cast("long").alias(name))
    )
    same = [F.col(v).eqNullSafe(F.col(f"_{v}")) for v in value]
    hots = hashed.where(is_hot).join(F.broadcast(named), same, "inner").select(*keep, name)
    return usual.unionByName(hots)


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per distinct (id, text): ``_id``, ``text_sha256``, ``copies`` (how often the row is repeated),
    ``n_blocks`` and ``identity``; (n_blocks, identity) is equal exactly for equal texts.

    The digest only keeps rows of a repeated id apart; it takes no part in finding equal texts.
    """
    text = text_of(text_col)
    blocks = F.regexp_extract_all(text, F.lit("(?s).{1,%d}+" % block_chars), F.lit(0))
    cut = docs.select(
        F.col(id_col).alias("_id"),
        F.sha2(text.cast("binary"), 256).alias("text_sha256"),
        F.when(F.length(text) == 0, F.array(F.lit(""))).otherwise(blocks).alias("_blocks"),
    ).select("_id", "text_sha256", F.size("_blocks").alias("n_blocks"), F.posexplode("_blocks").alias("pos", "block"))
    document = ["_id", "text_sha256", "n_blocks"]
    names = stored(name_values(cut, ["block"], "name", [*document, "pos"]), "block-names")
    # A row that is repeated with its id has the same names at the same places: once is enough.
    names = stored(
        names.groupBy(*document, "pos").agg(F.min("name").alias("name"), F.count(F.lit(1)).alias("copies")), "block-names"
    )
    done, width = [names.where("n_blocks = 1").select(*document, "copies", F.col("name").alias("identity"))], 1
    longest = names.agg(F.max("n_blocks")).first()[0] or 1
    rest = names.where("n_blocks > 1")
    while width < longest:
        width *= 2
        half = F.floor(F.col("pos") / 2)
        pairs = rest.groupBy(*document, half.alias("pos")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"),
            F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))).alias("right"),
            F.max("copies").alias("copies"),
        )
        # Levels of different lengths do not mix: n_blocks is part of the identity, so names may repeat between levels.
        rest = stored(name_values(stored(pairs, "pairs"), ["left", "right"], "name", [*document, "pos", "copies"]), "pair-names")
        done.append(
            rest.where((F.col("n_blocks") <= width) & (F.col("n_blocks") > width // 2)).select(
                *document, "copies", F.col("name").alias("identity")
            )
        )
        rest = rest.where(F.col("n_blocks") > width)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per row of ``docs``: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    A null text equals the empty text. The largest id of a group stays; a null id only where the group has no other.
    Rows repeated with the same id and text count in ``group_size``, and one of them is kept. Extra columns are ignored;
    an empty table gives an empty result.
    """
    rows = stored(identities(docs, id_col, text_col, block_chars), "identities")
    groups = stored(
        rows.groupBy("n_blocks", "identity").agg(F.max("_id").alias("keep_id"), F.sum("copies").alias("group_size")), "groups"
    )
    # Both sides are stored tables, so that the join can split a hot group.
    joined = rows.join(groups, ["n_blocks", "identity"])
    every = joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return every.select(
        F.col("_id").alias(id_col),
        "keep_id",
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("_id").eqNullSafe(F.col("keep_id")) & (F.col("_copy") == 1)).alias("kept"),
        "text_sha256",
    )


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all columns."""
    kept = exact_duplicates(docs).where("kept").select(F.col("doc_id").alias("_kept_id"), F.col("text_sha256").alias("_kept_sha"))
    keyed = docs.withColumn("_row_sha", F.sha2(text_of().cast("binary"), 256))
    same = keyed["doc_id"].eqNullSafe(kept["_kept_id"]) & (keyed["_row_sha"] == kept["_kept_sha"])
    first = Window.partitionBy("doc_id", "_row_sha").orderBy(F.lit(1))
    rows = keyed.join(kept, same, "left_semi").withColumn("_row_no", F.row_number().over(first))
    return rows.where("_row_no = 1").select(*docs.columns)
