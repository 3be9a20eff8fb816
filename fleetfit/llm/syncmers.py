"""Document fingerprints from closed syncmers, in DataFrame operations only.

The units are words; in stretches without white space over 32 code points, or with a character of a script that is written
without spaces, every character is a unit (called a word below). Every run of ``INNER`` words has a hash; a run of
``OUTER`` words is an anchor if the smallest of the hashes inside it is the first or the last. Whether a run is chosen
depends on nothing but its own words, so two texts choose the same anchors in a shared passage wherever it stands, and
every stretch of ``2 * (OUTER - INNER)`` or more further words holds one. A fingerprint is the anchors in text order.
In a text of fewer than ``SHORT`` words, which might have no anchor, all runs of ``INNER`` words are anchors too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fleetfit.llm.common import let, stored, text_of

OUTER, INNER = 10, 3
SHORT = OUTER + 2 * (OUTER - INNER)
SPACES = r"\x20\x09-\x0D"
#: Thai and Lao, Burmese, Khmer, kana, Chinese characters.
UNSPACED = r"\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u9FFF\uF900-\uFAFF\x{20000}-\x{3FFFF}"
UNIT = rf"(?<![^{SPACES}])[^{SPACES}{UNSPACED}]{{1,32}}+(?![^{SPACES}])|[^{SPACES}]"
MASK = 0xFFFFFFFF


def anchors(text: Column) -> Column:
    """Array of (pos, hash) in text order: first word of the anchor and 32 bits of its hash.

    A text of fewer words than an inner run has, or without an anchor, has one for its whole content; an empty one none.
    """
    inner = OUTER - INNER  # hashes of inner runs start at i .. i + inner
    covering = [*range(0, inner, INNER), inner]  # inner runs that together hold every word of an anchor

    def of_hashes(g: Column) -> Column:
        def chosen(i: Column) -> Column:
            inside = F.least(*[g[i + j] for j in range(1, inner)])
            return inside >= F.least(g[i], g[i + inner])

        places = F.filter(F.sequence(F.lit(0), F.size(g) - inner - 1), chosen)
        return F.transform(
            places,
            lambda i: F.struct(
                i.alias("pos"), F.xxhash64(*[g[i + j] for j in covering]).bitwiseAND(F.lit(MASK)).alias("hash")
            ),
        )

    def of_words(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(w) - INNER), lambda i: F.xxhash64(*[w[i + j] for j in range(INNER)]))
        def of_runs(g: Column) -> Column:
            low = F.transform(g, lambda h, i: F.struct(i.alias("pos"), h.bitwiseAND(F.lit(MASK)).alias("hash")))
            return F.when(F.size(w) >= SHORT, of_hashes(g)).when(F.size(w) < OUTER, low).otherwise(F.array_sort(F.concat(of_hashes(g), low)))

        return F.when(F.size(w) >= INNER, let(runs, of_runs))

    def whole(t: Column) -> Column:
        return F.array(F.struct(F.lit(0).alias("pos"), F.xxhash64(t).bitwiseAND(F.lit(MASK)).alias("hash")))

    def of_text(t: Column) -> Column:
        found = let(F.regexp_extract_all(t, F.lit(UNIT), F.lit(0)), of_words)
        none = F.array().cast("array<struct<pos:int,hash:bigint>>")
        return F.when(t == "", none).otherwise(let(found, lambda a: F.when(F.size(a) > 0, a).otherwise(whole(t))))

    return let(text, of_text)


def fingerprint(found: Column) -> Column:
    """Anchors as text: eight hex digits each, joined by a space."""
    return F.array_join(F.transform(found, lambda a: F.lpad(F.lower(F.hex(a["hash"])), 8, "0")), " ")


def hashes(found: Column) -> Column:
    """The anchors' hashes as 32-bit integers."""
    return F.transform(found["hash"], lambda h: F.shiftright(F.shiftleft(h, 32), 32).cast("int"))


def likeness(x: Column, y: Column) -> Column:
    """Shared part of the distinct hashes of both, 0 to 1; two texts without anchors are alike."""
    every = F.size(F.array_union(x, y))
    return F.when(every == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / every)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``anchors``, ``fingerprint``. A null text counts as empty."""
    found = docs.select(F.col(id_col), anchors(text_of(text_col)).alias("anchors"))
    return found.select(id_col, "anchors", fingerprint(F.col("anchors")).alias("fingerprint"))


def successors(keys: DataFrame) -> DataFrame:
    """``keys`` (distinct ``id``, ``h``, and ``n``) in ascending order, each with the key of its successor as ``next_id``
    and ``next_h``; after the last comes the first. Sorted in ranges; only the first key of each range is compared across."""
    ranged = keys.repartitionByRange("id", "h").withColumn("part", F.spark_partition_id())
    ranged = stored(ranged, "key-ranges")
    here = Window.partitionBy("part").orderBy("id", "h")
    key = F.struct("id", "h")
    firsts = ranged.groupBy("part").agg(F.min(key).alias("first"))
    # One row per range, whatever the number of documents.
    order = Window.orderBy("part")
    start = F.first("first").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    firsts = firsts.select("part", F.coalesce(F.lead("first").over(order), start).alias("after"))
    led = ranged.withColumn("lead", F.lead(key).over(here)).join(firsts, "part")
    following = F.coalesce("lead", "after")
    return led.select("id", "h", "n", following["id"].alias("next_id"), following["h"].alias("next_h"))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, ``text``, ``n_chars``, ``donor`` (the beginning of the next document, as long as a
    quarter of the text or all of it) and ``next_hashes``, those of its anchors.

    Ascending ids, null first; documents that share an id are ordered by a hash of their text, and rows that repeat
    both count as one document in that order. A sole document is its own successor.
    """
    text = text_of(text_col)
    # Ids as text, so that a null one is a key like any other and both joins below share one exchange of the texts.
    key = F.coalesce(F.concat(F.lit("="), F.col("id").cast("string")), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).select(key.alias("k"), F.xxhash64("text").alias("h"), "text")
    keys = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), F.length(text).cast("long").alias("n")).distinct()
    links = stored(successors(keys), "successors")
    after = F.coalesce(F.concat(F.lit("="), F.col("next_id").cast("string")), F.lit(""))
    give = links.select(
        "id", key.alias("to"), F.col("h").alias("to_h"), F.floor(F.col("n") / 4).cast("int").alias("quarter"), after.alias("next"), "next_h"
    )
    # What a document passes on: no more of its text than is asked for, and its anchors' hashes.
    given = rows.join(give, (F.col("k") == F.col("next")) & (F.col("h") == F.col("next_h"))).select(
        "id", "to", "to_h", F.left("text", "quarter").alias("donor"), hashes(anchors(F.col("text"))).alias("next_hashes")
    )
    given = given.dropDuplicates(["to", "to_h"])  # the successor may be a repeated row
    met = rows.join(given, (F.col("k") == F.col("to")) & (F.col("h") == F.col("to_h")))
    return met.select(F.col("id").alias(id_col), "text", F.length("text").cast("long").alias("n_chars"), "donor", "next_hashes")


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """How the fingerprint of each text compares with that of the text after its last quarter was replaced by the
    beginning of the next document, and with that of the next document."""
    rows = with_next(docs, id_col, text_col)
    kept = (F.col("n_chars") - F.floor(F.col("n_chars") / 4)).cast("int")
    rows = rows.withColumn("edited", F.concat(F.left("text", kept), "donor"))
    rows = rows.select(
        id_col,
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        anchors(F.col("text")).alias("a"),
        anchors(F.col("edited")).alias("e"),
        "next_hashes",
    )
    return rows.select(
        id_col,
        "n_chars",
        "edited_sha256",
        fingerprint(F.col("a")).alias("fingerprint"),
        fingerprint(F.col("e")).alias("edited_fingerprint"),
        likeness(hashes(F.col("a")), hashes(F.col("e"))).alias("near_edited"),
        likeness(hashes(F.col("a")), F.col("next_hashes")).alias("near_next"),
    )
