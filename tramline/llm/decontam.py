"""Benchmark decontamination with a generalised suffix automaton of the normalised items.

The items' words go into one automaton; every document's words are streamed through it while the
length of the longest match that ends at each word is tracked. A word inside a match of `window`
words (or inside a whole item with fewer) is hit. `remove_spans` cuts the hit spans out of a text
and rejects a document of which they cover too much.

Items are dealt to automata of at most `block_words` words each (a longer item is one by itself), and every
document is streamed through each of them. Between two blocks what was found is written to the shared folder, so
that neither the driver nor a worker holds more than one automaton: some 650 bytes a word.

Defined results: a null or empty text has no words, no hits and isn't contaminated; an item without
words or with a null text matches nothing; a null item_id counts as the empty text; repeated rows
get a row each; an empty table of documents gives an empty result, an empty benchmark no hits. Rows
of the benchmark with one item_id count as one item.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.llm import common

WINDOW = 10
BLOCK_WORDS = 250_000

#: A-Z become a-z, other ASCII characters but digits and letters become spaces.
NORMAL = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256)
)
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

HITS = pa.struct(
    [
        ("n_words", pa.int64()),
        ("starts", pa.list_(pa.int32())),
        ("ends", pa.list_(pa.int32())),
        ("items", pa.list_(pa.string())),
    ]
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


class Automaton:
    """A suffix automaton of many word sequences, and for its states the items they tell of."""

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        items = [(name, words) for name, words in items if words]
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        #: Of each state: the state that stands for the last `window` words, or -1.
        self.window_of = [-1] * len(self.next)
        for v in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            if self.length[v] >= window:
                self.window_of[v] = v if self.length[self.link[v]] < window else self.window_of[self.link[v]]
        #: Items by the state of their windows; short items with their lengths by the state of the whole.
        self.items_at: dict[int, set[str]] = {}
        own: dict[int, set[tuple[int, str]]] = {}
        for name, words in items:
            v = n = 0
            for w in words:
                v, n = self.next[v][w], n + 1
                if n >= window:
                    self.items_at.setdefault(self.window_of[v], set()).add(name)
            if n < window:
                own.setdefault(v, set()).add((n, name))
        self.short_at: dict[int, list[tuple[int, str]]] = {}
        if own:
            for v in range(1, len(self.next)):
                found, at = [], v
                while at > 0:
                    found += own.get(at, ())
                    at = self.link[at]
                if found:
                    self.short_at[v] = found

    def _extend(self, last: int, w: bytes) -> int:
        nxt, link, length = self.next, self.link, self.length
        if (q := nxt[last].get(w)) is not None:
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and w not in nxt[p]:
            nxt[p][w] = new
            p = link[p]
        if p != -1:
            q = nxt[p][w]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return new

    def _clone(self, p: int, w: bytes, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        twin = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = twin
        while p != -1 and nxt[p].get(w) == q:
            nxt[p][w] = twin
            p = link[p]
        return twin

    def stream(self, words: list[bytes]) -> tuple[list[int], list[int], set[str]]:
        """Starts and ends (exclusive) of the merged hit spans in words, and the items with occurring windows."""
        nxt, link, length, window, short_at = self.next, self.link, self.length, self.window, self.short_at
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        v = n = 0
        for i, w in enumerate(words):
            to = nxt[v].get(w)
            if to is not None:
                v = to
                n += 1
            elif not v:
                continue
            else:
                while to is None and v:
                    v = link[v]
                    to = nxt[v].get(w)
                    n = length[v]
                if to is None:
                    n = 0
                    continue
                v = to
                n += 1
            if n >= window:
                spans.append((i + 1 - window, i + 1))
                items |= self.items_at[self.window_of[v]]
            if v in short_at:
                for size, name in short_at[v]:
                    if size <= n:
                        spans.append((i + 1 - size, i + 1))
                        items.add(name)
        starts, ends = merged(spans)
        return starts, ends, items


def merged(spans: Iterable[tuple[int, int]]) -> tuple[list[int], list[int]]:
    starts: list[int] = []
    ends: list[int] = []
    for a, b in sorted(spans):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def _blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    block: list[tuple[str, list[bytes]]] = []
    size = 0
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), "text")
    for row in rows.where("text IS NOT NULL").toLocalIterator():
        words = words_of(row["text"].encode())
        if block and size + len(words) > block_words:
            yield block
            block, size = [], 0
        block.append((row["i"], words))
        size += len(words)
    if block:
        yield block


def _hits_column(spark: SparkSession, automaton: Automaton):
    shared = spark.sparkContext.broadcast(automaton)

    @common.vector_udf(HITS)
    def hits(text: pa.Array) -> pa.Array:
        found = shared.value
        out = []
        for x in common.texts(text):
            words = words_of(x)
            starts, ends, items = found.stream(words)
            out.append({"n_words": len(words), "starts": starts, "ends": ends, "items": sorted(items)})
        return pa.array(out, HITS)

    return hits


@common.vector_udf(HITS)
def _union(one: pa.Array, other: pa.Array) -> pa.Array:
    out = []
    for a, b in zip(one.to_pylist(), other.to_pylist(), strict=True):
        starts, ends = merged([*zip(a["starts"], a["ends"]), *zip(b["starts"], b["ends"])])
        out.append(a | {"starts": starts, "ends": ends, "items": sorted({*a["items"], *b["items"]})})
    return pa.array(out, HITS)


def through_blocks(documents: DataFrame, benchmark: DataFrame, name: str, window: int, block_words: int) -> tuple[DataFrame, Automaton]:
    """documents with what all blocks but the last have found in a column of that name, if there are such, and the last one's automaton."""
    spark, last = documents.sparkSession, Automaton([], window)
    for k, block in enumerate(_blocks(benchmark, block_words)):
        if k:
            one = _hits_column(spark, last)(F.col("text"))
            documents = common.materialize(documents.withColumn(name, one if k == 1 else _union(name, one)))
        last = Automaton(block, window)
    return documents, last


def with_hits(documents: DataFrame, benchmark: DataFrame, name: str, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """documents with a struct of n_words, the merged hit spans in words and the sorted ids of the items that occur in text."""
    found, last = through_blocks(documents, benchmark, name, window, block_words)
    one = _hits_column(documents.sparkSession, last)(F.col("text"))
    return found.withColumn(name, _union(name, one) if name in found.columns else one)


def find_hits(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id and hits (n_words, starts, ends, items) of every row of documents."""
    return with_hits(documents.select("doc_id", "text"), benchmark, "hits", window, block_words).select("doc_id", "hits")


def digest(found: DataFrame) -> DataFrame:
    """The counts and the items' digest of what find_hits found."""
    lengths = F.zip_with("hits.ends", "hits.starts", lambda b, a: (b - a).cast("long"))
    return found.select(
        "doc_id",
        F.col("hits.n_words").alias("n_words"),
        F.aggregate(lengths, F.lit(0).cast("long"), lambda s, x: s + x).alias("n_hit"),
        F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hits.items", ","), 256).alias("items_sha256"),
        (F.size("hits.starts") > 0).alias("contaminated"),
    )


def cut(text: bytes, starts: list[int], ends: list[int]) -> bytes:
    """text without the words of the spans and what stands between them."""
    at = [m.span() for m in WORD.finditer(text.translate(NORMAL))]
    out, done = [], 0
    for a, b in zip(starts, ends, strict=True):
        out.append(text[done : at[a][0]])
        done = at[b - 1][1]
    return b"".join([*out, text[done:]])


def remove_spans(
    documents: DataFrame,
    benchmark: DataFrame,
    max_coverage: float = 0.5,
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """documents with every hit span cut from text; rows of which the spans cover more than max_coverage of the words go."""
    own = "__decontaminated"
    while own in documents.columns:
        own += "_"
    found, last = through_blocks(documents, benchmark, own, window, block_words)
    shared = documents.sparkSession.sparkContext.broadcast(last)

    # The last block is searched where the text is cut, so that a task has one worker.
    @common.vector_udf(pa.struct([("keep", pa.bool_()), ("text", pa.string())]))
    def apply(text: pa.Array, *before: pa.Array) -> pa.Array:
        keep, out = [], []
        for x, earlier in zip(text.to_pylist(), before[0].to_pylist() if before else [None] * len(text), strict=True):
            words = words_of((x or "").encode())
            starts, ends, _ = shared.value.stream(words)
            if earlier:
                starts, ends = merged([*zip(starts, ends, strict=True), *zip(earlier["starts"], earlier["ends"], strict=True)])
            n_hit = sum(ends) - sum(starts)
            keep.append(n_hit <= max_coverage * len(words))
            out.append(cut(x.encode(), starts, ends).decode() if n_hit and keep[-1] else x)
        return pa.StructArray.from_arrays([pa.array(keep, pa.bool_()), pa.array(out, pa.string())], ["keep", "text"])

    given = [F.col("text"), *([F.col(own)] if own in found.columns else [])]
    done = found.withColumn(own, apply.asNondeterministic()(*given)).where(F.col(own)["keep"])
    return done.select(*[F.col(own)["text"].alias("text") if c == "text" else F.col(f"`{c}`") for c in documents.columns])


def sha256_of(items: Iterable[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
