"""Document fingerprints from closed syncmers, with DataFrame functions only.

A text is a sequence of words: runs between blanks, where a character of a script that is written without blanks
(Han, kana, Thai, Lao, Khmer, Burmese) is a word of its own. A window of K words is an anchor if the least hash among
its inner runs of S words lies at its first or last run. Whether a window is an anchor depends on its own words alone,
so the same passage gives the same anchors in any text, and anchors with their positions align two texts. The
fingerprint holds the 32-bit hashes of all anchors in the order of the text; the likeness of two fingerprints is the
share of their distinct anchors that both hold. `in_place_edited` counts the distinct anchors that stand at the same
position in a text and its edited one.

Defined cases: a null text is an empty one, with an empty fingerprint; two empty fingerprints are alike (1.0),
an empty and another are not (0.0); a text without any anchor has one, its whole word sequence; a text is one value
of a row, however long, and is shuffled once; rows of equal doc_id follow one another by the hash of their texts;
repeated rows have one place in that order and get a row each; a null doc_id comes first; a single document is its own
next one; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliolens.llm.common import BLOCK, block_numbers, documents, id_text, numbers_in_block, stored

K, S = 5, 2
_ALONE = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
WORD = rf"[{_ALONE}]|[^\x20\x09-\x0D{_ALONE}]+"
_LOW = 0xFFFFFFFF


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once: within lambdas an expression would be computed for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _windows(words: Column) -> Column:
    """The windows that are anchors, as in `placed`."""

    def windows(h: Column) -> Column:
        inner = F.transform(h, lambda x, i: F.xxhash64(*[F.get(h, i + j) for j in range(S)]))

        def chosen(m: Column) -> Column:
            def anchor(x: Column, i: Column) -> Column:
                runs = [F.get(m, i + j) for j in range(K - S + 1)]
                closed = (i <= F.size(m) - K) & (F.least(runs[0], runs[-1]) <= F.least(*runs[1:-1]))
                return F.when(closed, F.shiftleft(i.cast("long"), 32).bitwiseOR(F.xxhash64(x, *[F.get(h, i + j) for j in range(1, K)]).bitwiseAND(F.lit(_LOW))))

            return F.filter(F.transform(h, anchor), lambda a: a.isNotNull())

        return let(inner, chosen)

    return let(F.transform(words, lambda w: F.xxhash64(w)), windows)


def placed(text: Column) -> Column:
    """The anchors of a text in their order, each as one long: the number of its first word times 2^32, plus its hash."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))

    def of(w: Column) -> Column:
        whole = F.array(F.xxhash64(F.array_join(w, " ")).bitwiseAND(F.lit(_LOW)))
        return let(_windows(w), lambda a: F.when((F.size(a) > 0) | (F.size(w) == 0), a).otherwise(whole))

    return let(words, of)


def anchors(text: Column) -> Column:
    """array of (pos, hash): the anchors of a text by the number of their first word."""
    return F.transform(placed(text), lambda x: F.struct(F.shiftright(x, 32).cast("int").alias("pos"), x.bitwiseAND(F.lit(_LOW)).alias("hash")))


def hashes(placed_anchors: Column) -> Column:
    return F.transform(placed_anchors, lambda x: x.bitwiseAND(F.lit(_LOW)))


def likeness(a: Column, b: Column) -> Column:
    """The share of the distinct anchors of both that either holds."""
    both = F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), (F.size(a) == F.size(b)).cast("double")).otherwise(both)


def as_text(placed_anchors: Column) -> Column:
    """The hashes as eight hexadecimal digits each, one after another."""
    return F.lower(F.array_join(F.transform(placed_anchors, lambda x: F.substring(F.hex(x.bitwiseAND(F.lit(_LOW)) + F.lit(1 << 32)), 2, 8)), ""))


NO_ID = -(2**63)


def keyed(docs: DataFrame) -> DataFrame:
    """k1, k2: a key without nulls, in whose order equal doc_ids are told apart by their texts."""
    none = F.col("doc_id").isNull()
    return id_text(docs).select("doc_id", "text", F.coalesce("doc_id", F.lit(NO_ID)).alias("k1"), F.xxhash64("text", none).alias("k2"))


def doc_id_of(k1: Column, k2: Column, text: Column) -> Column:
    """The doc_id of a key: null where the second part says that there was none."""
    return F.when((k1 != NO_ID) | (k2 != F.xxhash64(text, F.lit(True))), k1)


def packed(print_: Column) -> Column:
    """32-bit hashes as 32-bit integers, in the same order, for the way between tasks."""
    return F.transform(print_, lambda x: (x - 2**31).cast("int"))


def unpacked(print_: Column) -> Column:
    return F.transform(print_, lambda x: x.cast("long") + 2**31)


def next_keys(keys: DataFrame) -> DataFrame:
    """(k1, k2, half, p1, p2): document k comes next after document p, half of whose characters are half.

    keys: distinct (doc_id, k1, k2, n_chars) laid out in ranges of ids. Each range is ordered by itself, and its last
    row gets the first of the next range from a table with a row for each range.
    """
    order = ["doc_id", "k2"]
    here = F.struct("doc_id", "k2", "k1")
    firsts = keys.groupBy("range").agg(F.min(here).alias("first"))
    over = Window.orderBy("range")
    firsts = firsts.select("range", F.coalesce(F.lead("first").over(over), F.first("first").over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("then"))
    follow = F.lead(here).over(Window.partitionBy("range").orderBy(*order))
    rows = keys.withColumn("next", follow).join(F.broadcast(firsts), "range").withColumn("next", F.coalesce("next", "then"))
    return stored(rows.select(F.col("next.k1").alias("n1"), F.col("next.k2").alias("n2"), F.floor(F.col("n_chars") / 2).cast("int").alias("half"), F.col("k1").alias("p1"), F.col("k2").alias("p2")), "next")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    rows = keyed(docs)
    keys = rows.groupBy("doc_id", "k1", "k2", F.char_length("text").alias("n_chars")).agg(F.count(F.lit(1)).alias("times"))
    keys = stored(keys.repartitionByRange("doc_id", "k2").withColumn("range", F.spark_partition_id()), "ranges")
    links = next_keys(keys)
    # Both uses of texts keep the same columns, so that the texts are shuffled once.
    texts = rows.groupBy("k1", "k2").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("times")).where("times > 0")
    tails = texts.join(links, (F.col("k1") == F.col("n1")) & (F.col("k2") == F.col("n2"))).select("p1", "p2", "half", F.substring("text", F.lit(1), F.col("half")).alias("tail"), packed(F.array_distinct(hashes(placed(F.col("text"))))).alias("next_print"))
    both = texts.join(tails, (F.col("k1") == F.col("p1")) & (F.col("k2") == F.col("p2")))
    edited = F.concat(F.substring("text", F.lit(1), F.char_length("text") - F.col("half")), "tail")
    prints = both.select(
        doc_id_of(F.col("k1"), F.col("k2"), F.col("text")).alias("doc_id"), "times", F.char_length("text").cast("long").alias("n_chars"), edited.alias("edited"), placed(F.col("text")).alias("at"), unpacked(F.col("next_print")).alias("next_print")
    )
    prints = prints.select("doc_id", "times", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "at", placed(F.col("edited")).alias("edited_at"), "next_print")
    prints = prints.withColumns({"print": hashes(F.col("at")), "edited_print": hashes(F.col("edited_at"))})
    out = prints.select(
        "doc_id",
        "times",
        "n_chars",
        "edited_sha256",
        as_text(F.col("at")).alias("fingerprint"),
        as_text(F.col("edited_at")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        likeness(F.col("print"), F.col("next_print")).alias("near_next"),
        F.size(F.array_intersect("at", "edited_at")).cast("long").alias("in_place_edited"),
    )
    out = out.withColumn("block", F.explode(block_numbers(F.col("times"))))
    if (keys.agg(F.max("times")).first()[0] or 0) > BLOCK:  # the copies of one row are written by many tasks
        out = out.repartition("fingerprint", "block")
    return out.withColumn("time", F.explode(numbers_in_block(F.col("block"), F.col("times")))).drop("time", "times", "block")


def op2_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(documents(spark, sf_dir))
