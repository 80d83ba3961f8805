"""Near duplicates by HyperMinHash over five-word shingles.

A register keeps, of the least hash of its own hash function, the count of leading zeros and the next
ten bits. Registers are banded: documents with an equal band are candidates. Of a candidate pair the
Jaccard similarity is estimated from the share of equal registers, corrected for registers that are
equal by chance; pairs that may reach the threshold are confirmed on their full shingle sets.

Documents with the same set are one node from the start, so copies never meet each other. Buckets of more
than `FULL` documents come from passages that many documents share, or from large groups of near copies.
Their documents are bucketed anew by an exact prefix filter: in an order from rare to frequent shingles two
documents that are linked share one of their first quarter of shingles. What they share is rare, so a common
passage brings nobody together, and no pair is dropped.

A bucket's members are first compared with its least document only. Members that are connected by then
need no comparison with each other; just pairs from different components are compared in a second step. So
a group of copies costs its size, not its square, and no link between different texts is lost but those
that banding misses: with 72 bands of 6 registers one in a million at the threshold itself, fewer above.
Components come from alternating large-star and small-star steps; each step is written to the shared
folder.

Defined results: a null or empty text, or one without words, has no shingle, is linked with nothing and
is kept; rows that repeat a doc_id are one document, and get a row each; a row with a null doc_id is
linked with nothing, has a null component and is kept; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.llm import common

WORDS = 5
BANDS, ROWS = 72, 6
REGISTERS = BANDS * ROWS
MANTISSA = 10
PERCENT = 75
#: Band buckets with more documents than this are split by the prefix filter.
FULL = 16
#: Estimates this many standard deviations below the threshold are dropped.
DEVIATIONS = 5.0
#: Up to this many ids a join's small side is broadcast; beyond it both sides are shuffled.
BROADCAST_IDS = 1_000_000

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_random = np.random.default_rng(20240101)
MULTIPLY = _random.integers(0, 2**64, REGISTERS, dtype=np.uint64) | np.uint64(1)
ADD = _random.integers(0, 2**64, REGISTERS, dtype=np.uint64)
BAND_MULTIPLY = _random.integers(0, 2**64, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)
PRIME = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: bytes) -> list[bytes]:
    """split() divides at the six ASCII spaces just as the words are defined."""
    return text.translate(LOWER).split()


def shingles(words: list[bytes]) -> set[bytes]:
    """The set itself, each shingle as its words joined by a space; for comparing pairs."""
    if not words:
        return set()
    return {b" ".join(words[i : i + WORDS]) for i in range(max(1, len(words) - WORDS + 1))}


def shingle_hashes(words: list[bytes]) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles, sorted."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    known = {w: xxhash.xxh3_64_intdigest(w) for w in set(words)}
    h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    width = min(WORDS, len(words))
    n = len(words) - width + 1
    out = np.full(n, width, dtype=np.uint64)
    for k in range(width):
        out = mix(out * PRIME + h[k : k + n])
    return np.unique(out)


def registers(hashes: np.ndarray) -> np.ndarray:
    """Leading zeros and mantissa of every register's least hash, in 16 bits."""
    least = np.full(REGISTERS, ~np.uint64(0))
    for at in range(0, len(hashes), 4096):
        block = hashes[at : at + 4096]
        for k in range(0, REGISTERS, 48):
            part = slice(k, k + 48)
            found = (block[None, :] * MULTIPLY[part, None] + ADD[part, None]).min(axis=1)
            least[part] = np.minimum(least[part], found)
    bits = np.frexp((least >> np.uint64(11)).astype(np.float64))[1]
    zeros = np.where(bits > 0, 53 - bits, 53).astype(np.uint64)
    mantissa = (least << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA)
    return ((zeros << np.uint64(MANTISSA)) | mantissa).astype(np.uint16)


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """64-bit keys of the bands of one or more sketches."""
    parts = sketch.reshape(-1, BANDS, ROWS).astype(np.uint64) + np.uint64(1)
    keys = np.arange(BANDS, dtype=np.uint64) * PRIME
    for k in range(ROWS):
        keys = mix(keys * PRIME + parts[:, :, k] * BAND_MULTIPLY[:, k])
    return keys


@functools.lru_cache(maxsize=4096)
def _chance(n_step: int, m_step: int) -> float:
    """Share of registers that two disjoint sets of about 2^(step/2) shingles have equal by chance."""
    low = np.concatenate([2.0 ** -(k + 1) * (1 + np.arange(2**MANTISSA) / 2**MANTISSA) for k in range(40)])
    width = np.repeat(2.0 ** -(np.arange(40) + 1) / 2**MANTISSA, 2**MANTISSA)
    in_cell = lambda n: np.exp(n * np.log1p(-low)) - np.exp(n * np.log1p(-np.minimum(low + width, 1 - 1e-16)))
    return float((in_cell(2 ** (n_step / 2)) * in_cell(2 ** (m_step / 2))).sum())


def estimate(a: np.ndarray, b: np.ndarray, n: int, m: int) -> float:
    """Jaccard similarity from the share of equal registers, less those equal by chance."""
    chance = _chance(round(2 * np.log2(max(n, 1))), round(2 * np.log2(max(m, 1))))
    return float((np.mean(a == b) - chance) / (1 - chance))


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        common.give_back()
        n, digest, sketch = [], [], []
        for text in common.texts(batch.column(1)):
            hashes = shingle_hashes(words_of(text))
            n.append(len(hashes))
            digest.append(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest() if len(hashes) else None)
            sketch.append(registers(hashes).tobytes() if len(hashes) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sketch, pa.binary())],
            names=["doc_id", "n_shingles", "digest", "sketch"],
        )


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each shingle hash of a document, with the number of its first quarter: how many rows its prefix has."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            found = [shingle_hashes(words_of(x)) for x in common.texts(part.column(1))]
            sizes = np.array([len(h) for h in found], dtype=np.int64)
            own = np.array([int.from_bytes(hashlib.blake2b(h.tobytes(), digest_size=8).digest(), "little", signed=True) for h in found], dtype=np.int64)
            prefix = sizes - (PERCENT * sizes + 99) // 100 + 1
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(pa.array(np.repeat(np.arange(len(sizes)), sizes))),
                    pa.array(np.repeat(own, sizes)),
                    pa.array(np.repeat(sizes, sizes)),
                    pa.array(np.repeat(prefix, sizes)),
                    pa.array(np.concatenate([*found, np.zeros(0, dtype=np.uint64)]).view(np.int64)),
                ],
                names=["doc_id", "own", "size", "prefix", "key"],
            )


@common.vector_udf(pa.list_(pa.int64()))
def _keys(sketch: pa.Array) -> pa.Array:
    flat = np.frombuffer(b"".join(sketch.to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS)
    keys = band_keys(flat).view(np.int64) if len(flat) else np.zeros((0, BANDS), dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel()))


@common.vector_udf(pa.bool_())
def _may_reach(one: pa.Array, other: pa.Array, n: pa.Array, m: pa.Array) -> pa.Array:
    share = PERCENT / 100
    least = share - DEVIATIONS * (share * (1 - share) / REGISTERS) ** 0.5
    out = []
    for a, b, x, y in zip(one.to_pylist(), other.to_pylist(), n.to_pylist(), m.to_pylist(), strict=True):
        # Sets of too different sizes can't reach it, whatever the estimate.
        near = 100 * min(x, y) >= PERCENT * max(x, y)
        out.append(near and estimate(np.frombuffer(a, np.uint16), np.frombuffer(b, np.uint16), x, y) >= least)
    return pa.array(out, pa.bool_())


def linked(a: set[bytes], b: set[bytes]) -> bool:
    both = len(a & b)
    return bool(a) and bool(b) and 100 * both >= PERCENT * (len(a) + len(b) - both)


@common.vector_udf(pa.bool_())
def _confirmed(one: pa.Array, other: pa.Array) -> pa.Array:
    out, held, of = [], set(), None
    for a, b in zip(common.texts(one), common.texts(other), strict=True):
        if a != of:
            held, of = shingles(words_of(a)), a
        out.append(linked(held, shingles(words_of(b))))
    return pa.array(out, pa.bool_())


def only(rows: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """rows with (left_semi) or without (left_anti) the doc_ids of ids, which are broadcast if they're few by count."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return rows.join(F.broadcast(ids) if few else ids, "doc_id", how)


def _confirm(pairs: DataFrame, sketches: DataFrame, texts: DataFrame) -> DataFrame:
    """Of the pairs (a, b), written down, those that are linked. b, which meets fewer partners, is joined first."""
    side = lambda t, c, *cols: t.select(F.col("doc_id").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in cols])
    likely = (
        pairs.join(side(sketches, "b", "sketch", "n_shingles"), "b")
        .join(side(sketches, "a", "sketch", "n_shingles"), "a")
        .where(_may_reach("sketch_a", "sketch_b", "n_shingles_a", "n_shingles_b"))
        .select("a", "b")
    )
    likely = common.materialize(likely.distinct())
    found = (
        likely.join(side(texts, "b", "text"), "b")
        .join(side(texts, "a", "text"), "a")
        .where(_confirmed("text_a", "text_b"))
        .select("a", "b")
    )
    return common.materialize(found.distinct())


def components(links: DataFrame) -> DataFrame:
    """doc_id and component (the least doc_id reachable) of every doc_id in links but the components' own."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges, before = common.materialize(edges), None
    while True:
        sign = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if sign == before or not sign["n"]:
            return edges.select(F.col("u").alias("doc_id"), F.col("v").alias("component"))
        before = sign
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = common.materialize(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = common.materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())


def find_groups(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of documents."""
    id_type = documents.schema["doc_id"].dataType.simpleString()
    given = documents.select("doc_id", "text")
    sketched = common.materialize(given.mapInArrow(_sketched, f"doc_id {id_type}, n_shingles long, digest binary, sketch binary"))
    known = sketched.where("doc_id IS NOT NULL AND digest IS NOT NULL")
    sets = common.materialize(known.groupBy("digest").agg(F.min("doc_id").alias("node")))
    nodes = known.join(sets.select("digest", F.col("node").alias("doc_id")), ["digest", "doc_id"], "left_semi")

    bands = nodes.select("doc_id", F.explode(_keys("sketch")).alias("key"))
    found = common.materialize(_members(bands))
    ids = common.materialize(found.select("doc_id").distinct())
    texts = common.materialize(only(given, ids))
    hot = common.materialize(found.where(F.col("n") > FULL).select("doc_id").distinct())
    # Of two documents of full buckets the prefix filter says all; a smaller bucket compares pairs with one that isn't of them.
    members = _flagged(_flagged(found.where(F.col("n") <= FULL).select("key", "doc_id", "center"), hot, "doc_id", "full"), hot, "center", "center_full")
    split = _by_prefix(only(texts, hot), id_type).withColumns({"full": F.lit(False), "center_full": F.lit(False)}).drop("n")
    members = common.materialize(members.unionByName(split, allowMissingColumns=True))
    ranked = [F.col(c) for c in ("size", "rank", "center_size", "center_rank")]
    sketches = only(known.select("doc_id", "sketch", "n_shingles"), ids)
    star = members.where("doc_id <> center AND NOT (full AND center_full)").where(_room(*ranked)).select(F.col("center").alias("a"), F.col("doc_id").alias("b")).distinct()
    links = _confirm(star, sketches, texts)
    found = components(links)

    # Buckets whose members aren't all connected yet: pairs from different components, the bucket's center apart.
    label = F.coalesce("component", "doc_id").alias("label")
    labelled = members.join(found, "doc_id", "left").select("key", "doc_id", "center", "full", "size", "rank", label)
    mixed = labelled.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key")
    rest = common.materialize(labelled.where("doc_id <> center").join(mixed, "key", "left_semi").select("key", "doc_id", "full", "size", "rank", "label"))
    one, other = rest.alias("one"), rest.alias("other")
    near = _room(F.col("one.size"), F.col("one.rank"), F.col("other.size"), F.col("other.rank"))
    cross = (
        one.join(other, near & (F.col("one.key") == F.col("other.key")) & (F.col("one.doc_id") < F.col("other.doc_id")) & (F.col("one.label") != F.col("other.label")) & ~(F.col("one.full") & F.col("other.full")))
        .select(F.col("one.doc_id").alias("a"), F.col("other.doc_id").alias("b"))
        .distinct()
    )
    more = _confirm(cross, sketches, texts)
    if more.limit(1).count():
        found = components(links.unionByName(more))

    reached = sets.join(found.withColumnRenamed("doc_id", "node"), "node", "left").select("digest", F.coalesce("component", "node").alias("c"))
    return (
        sketched.select("doc_id", "n_shingles", "digest")
        .join(reached, "digest", "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def _members(keyed: DataFrame) -> DataFrame:
    """key, doc_id, the least doc_id of the key and the number of its rows, of keys with more than one document."""
    extra = [c for c in keyed.columns if c not in ("key", "doc_id")]
    least = F.min(F.struct("doc_id", *extra)).alias("least")
    buckets = keyed.groupBy("key").agg(least, F.max("doc_id").alias("last"), F.count("*").alias("n")).where("least.doc_id <> last")
    return keyed.join(buckets.select("key", "n", F.col("least.doc_id").alias("center"), *[F.col(f"least.{c}").alias(f"center_{c}") for c in extra]), "key")


def _room(size: Column, rank: Column, other_size: Column, other_rank: Column) -> Column:
    """Whether two sets whose first common shingle has these ranks can be linked: by what is left from there on, and by their sizes. Without ranks they can."""
    left = F.least(size - rank, other_size - other_rank) + 1
    enough = (100 + PERCENT) * left >= PERCENT * (size + other_size)
    return F.coalesce(enough & (100 * F.least(size, other_size) >= PERCENT * F.greatest(size, other_size)), F.lit(True))


def _flagged(rows: DataFrame, ids: DataFrame, column: str, flag: str) -> DataFrame:
    """rows with whether their column is among ids, which are broadcast if they're few by count."""
    side = ids.select(F.col("doc_id").alias(column), F.lit(True).alias(flag))
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return rows.join(F.broadcast(side) if few else side, column, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def _by_prefix(texts: DataFrame, id_type: str) -> DataFrame:
    """Buckets of the prefix filter: documents by each of their rarest shingles. Any order that all share is exact; one by frequency keeps buckets small."""
    rows = texts.mapInArrow(_shingled, f"doc_id {id_type}, own long, size long, prefix long, key long").distinct()
    rows = common.materialize(rows)
    frequent = rows.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
    # A shingle of one document brings nobody together, but takes its place in the order.
    ordered = rows.join(frequent, "key", "left").withColumn("df", F.coalesce("df", F.lit(1)))
    w = Window.partitionBy("doc_id", "own").orderBy("df", "key")
    first = ordered.withColumn("rank", F.row_number().over(w)).where("rank <= prefix AND df > 1")
    return _members(first.select("key", "doc_id", "size", "rank"))


def keep_one(documents: DataFrame) -> DataFrame:
    """documents without the rows whose near-duplicate group has a lesser doc_id; all columns stay."""
    gone = common.materialize(find_groups(documents).where("NOT kept").select("doc_id").distinct())
    return only(documents, gone, "left_anti")
