"""SimHash near-duplicates with pigeonring filtering.

Fingerprints are 64 majority bits over the hashes of word shingles. Equal fingerprints are one class; links
are sought between classes. The 64 bits form a ring of segments. If two fingerprints differ in at most d bits,
some chain of consecutive segments exists all of whose beginnings differ within their proportional budget: l
segments in at most l * d / segments bits. The first segments of such a chain are therefore equal, which is
the join key; the longer beginnings prune the pairs before all bits are compared.

Buckets of more than `SMALL` classes are not paired: each member is written out with every one-bit change of
the bits outside the key. Two members differ in at most two bits if and only if they share such a variant, and
at most 65 fingerprints share one, so this exact way stays linear however large the bucket (d = 2; for other d
larger buckets are paired).

Defined cases: a null or empty text has fingerprint zero and is linked like any other; a text of fewer words
than a shingle is one shingle; texts are hashed whole, their bits counted in parts; a bit set in exactly half the
shingles (a tie) is 0; repeated rows and equal doc_ids get a row each; null doc_ids never name a
component unless all of its rows have none; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliolens.llm.common import bytes_of, documents, id_text, per_batch, rows_to_batch, small_batches, stored
from foliolens.llm.graph import components

BITS = 64
SEGMENTS = 7
#: Classes in a bucket that are still compared pair by pair.
SMALL = 64
SEED = 42


def shingle_hashes(data: bytes, words: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of each shingle: lower case A-Z, words between blanks, joined by one space."""
    found = data.lower().split()
    if not found:
        return np.empty(0, dtype=np.uint64)
    joined, digest = b" ".join(found), xxhash.xxh64_intdigest
    n = len(found) - words + 1
    if n <= 1:
        return np.array([digest(joined, seed)], dtype=np.uint64)
    lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[:n].tolist()
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)), dtype=np.uint64, count=n)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half the hashes."""
    counts = np.zeros(BITS, dtype=np.int64)
    for k in range(0, len(hashes), 1 << 14):
        part = hashes[k : k + (1 << 14)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([majority(shingle_hashes(x, words)) for x in bytes_of(batch.column("text"))], dtype=np.uint64)
        return rows_to_batch(schema, [batch.column("doc_id"), fps.view(np.int64)])

    return id_text(docs).mapInArrow(per_batch(run), "doc_id long, fp long")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _turned(fp: Column, k: int) -> Column:
    """The ring turned so that bit k comes first."""
    return fp if not k else F.shiftrightunsigned(fp, k).bitwiseOR(F.shiftleft(fp, BITS - k))


def links(classes: DataFrame, differ: int, segments: int = SEGMENTS, small: int = SMALL) -> DataFrame:
    """Edges (u, v) that join all pairs of distinct fp within `differ` bits to one component each; every edge is such a pair."""
    edge = [BITS * i // segments for i in range(segments + 1)]
    sizes = [b - a for a, b in zip(edge, edge[1:], strict=False)]
    equal = max(n for n in range(segments) if n * differ < segments)  # segments at a chain's beginning that must not differ
    fp = F.col("fp")

    def begin(i: int, n: int) -> int:
        return sum(sizes[(i + j) % segments] for j in range(n))

    starts = [F.struct(F.lit(i).alias("chain"), _turned(fp, edge[i]).bitwiseAND(F.lit(_signed((1 << begin(i, equal)) - 1))).alias("key")) for i in range(segments)]
    keyed = classes.select("fp", F.explode(F.array(*starts)).alias("s")).select("fp", "s.chain", "s.key")
    buckets = keyed.groupBy("chain", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    keyed = stored(keyed.join(buckets, ["chain", "key"]), "chains")

    few = keyed.where(F.col("n") <= small) if differ == 2 else keyed
    a, b = few.select("chain", "key", F.col("fp").alias("u")), few.select(F.col("chain").alias("c"), F.col("key").alias("k"), F.col("fp").alias("v"))
    x = F.col("u").bitwiseXOR(F.col("v"))
    budget = F.lit(False)
    for i in range(segments):
        t = _turned(x, edge[i])
        chain = F.col("chain") == i
        for n in range(equal + 1, segments):
            chain = chain & (F.bit_count(t.bitwiseAND(F.lit(_signed((1 << begin(i, n)) - 1)))) <= n * differ // segments)
        budget = budget | chain
    pairs = a.join(b, (F.col("chain") == F.col("c")) & (F.col("key") == F.col("k")) & (F.col("u") < F.col("v")) & budget & (F.bit_count(x) <= differ)).select("u", "v")
    if differ != 2:
        return pairs.distinct()
    flips = F.lit([0, *(_signed(1 << j) for j in range(BITS))])
    varied = keyed.where(F.col("n") > small).select("fp", F.explode(F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m))).alias("variant")).distinct()
    balls = varied.groupBy("variant").agg(F.min("fp").alias("u"), F.collect_set("fp").alias("all")).where(F.size("all") > 1)  # at most 65 in each
    return pairs.unionByName(balls.select("u", F.explode("all").alias("v")).where("u <> v")).distinct()


def labelled(prints: DataFrame, differ: int) -> DataFrame:
    """(fp, component_id) of each distinct fingerprint: the smallest doc_id that links reach."""
    classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    roots = components(links(classes.select("fp"), differ)).select(F.col("node").alias("fp"), "root")
    linked = stored(classes.join(roots, "fp"), "linked")
    lowest = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    found = linked.join(lowest, "root").select("fp", "component_id")
    alone = classes.join(roots, "fp", "left_anti").select("fp", F.col("first").alias("component_id"))
    return stored(found.unionByName(alone), "labels")


def simhash_groups(docs: DataFrame, words: int = 3, differ: int = 2) -> DataFrame:
    """doc_id, fp, component_id of every row."""
    prints = stored(fingerprints(docs, words), "fingerprints")
    return prints.join(labelled(prints, differ), "fp").select("doc_id", "fp", "component_id")


def op6_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_groups(documents(spark, sf_dir))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
