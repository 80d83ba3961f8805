"""SentencePiece encoding and decoding over a relational lattice.

The pieces and scores of a model file are read as a unigram table: a text's encoding is the path of
pieces with the greatest sum of scores; of equal sums the one whose last piece is the longest wins. A
character without a piece costs the least score less 10 and is written as the ids of its UTF-8 bytes.

Between two characters that stand side by side in no piece no piece can lie, so a text is cut there and the
best paths of its segments, one after another, are the best path of the text. Segments, mostly words, are
encoded once each:

1. Documents are packed into chunks of at most `chunk_bytes` of text (a longer text is one by itself): the
   chunk's distinct segments, by falling frequency, and a number for each place. Only these are shuffled.
2. A chunk's distinct segments go, by a hash, into buckets; its list for a bucket is one row. The JVM makes
   them distinct, explodes their substrings of the lengths that pieces with the same first three characters
   have, equi-joins these to the piece table, groups the edges by the segment's number and folds Viterbi by
   `aggregate`.
3. A bucket's encodings go back to the chunks that asked for them, and every chunk puts its texts' ids
   together.

Nothing is broadcast but the piece table and its first characters, whose sizes are checked; a frequent word is
a row a chunk, never a row an occurrence; a group is a chunk or a bucket, neither of which grows with the
corpus if `buckets` follows the cluster's shuffle partitions. The fold keeps its nodes in blocks, so the time
and memory of a segment are linear in its length.

Defined results: a null text has null ids, an empty one no ids; repeated rows get a row each; an empty
table gives an empty result. Decoding gives the text back, but that U+2581, which stands for a space in
pieces, comes back as a space.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.llm import common

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: The broadcast piece table has this many rows at most.
MAX_PIECES = 1_000_000
UNKNOWN_PENALTY = 10.0
CHUNK_BYTES = 8_000_000

Piece = tuple[str, float, int]


def load_pieces(path: str = MODEL) -> tuple[list[Piece], int]:
    """(piece, score, id) of the model's ordinary pieces, with spaces for U+2581, and the id of the byte 0."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    special = lambda i: model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)
    size = model.get_piece_size()
    pieces = [(model.id_to_piece(i).replace(SPACE, " "), model.get_score(i), i) for i in range(size) if not special(i)]
    if len(pieces) > MAX_PIECES:
        raise ValueError(f"{len(pieces)} pieces; at most {MAX_PIECES} are broadcast")
    if any(len(p) > 1 and LINE_END in p for p, _, _ in pieces):
        raise ValueError("a piece crosses lines")
    byte = model.piece_to_id("<0x00>")
    if not model.is_byte(byte):
        raise ValueError("the model has no bytes to fall back on")
    return pieces, byte


#: Words with the spaces before them, spaces at an end of a line or text, and line ends and tabs by themselves.
WORD = re.compile(r" *[^ \n\t]+| +|[\n\t]")
#: What parts a list of segments, so that it can't stand in one; it is a segment by itself.
LINE_END = "\n"


class Cuts:
    """Where texts may be cut: between characters that stand side by side in no piece."""

    #: Characters looked at together.
    WINDOW = 1 << 20

    def __init__(self, pieces: list[Piece]):
        found = sorted({c for p, _, _ in pieces for c in p})
        self.classes = np.zeros(0x110000, dtype=np.uint16 if len(found) < 65_535 else np.uint32)
        self.classes[[ord(c) for c in found]] = np.arange(1, len(found) + 1)
        pairs = {(a, b) for p, _, _ in pieces for a, b in zip(p, p[1:], strict=False)}
        left, right = (sorted({ord(x[k]) for x in pairs}) for k in (0, 1))
        # Rows and columns of the table of pairs; 0 stands for characters that are first or second of none.
        self.row, self.column = (np.zeros(len(found) + 1, dtype=np.int32) for _ in range(2))
        self.row[self.classes[left]], self.column[self.classes[right]] = np.arange(1, len(left) + 1), np.arange(1, len(right) + 1)
        self.width = len(right) + 1
        self.joined = np.zeros((len(left) + 1) * self.width, dtype=bool)
        for a, b in pairs:
            self.joined[self.row[self.classes[ord(a)]] * self.width + self.column[self.classes[ord(b)]]] = True

    def segments(self, text: str) -> pa.Array:
        """The text's segments, as binary."""
        data, starts, at = text.encode(), [], 0
        before = 0
        for begin in range(0, len(text), self.WINDOW):
            code = np.frombuffer(text[begin : begin + self.WINDOW].encode("utf-32-le"), dtype=np.uint32)
            kind = self.classes[code]
            # What the character before the window makes of the first pair.
            left = np.concatenate([np.array([before], dtype=kind.dtype), kind[:-1]])
            cut = ~self.joined[self.row[left] * self.width + self.column[kind]]
            before = kind[-1]
            if len(data) == len(text):
                starts.append((np.flatnonzero(cut) + begin).astype(np.int32))
            else:
                size = 1 + (code > 0x7F).astype(np.int32) + (code > 0x7FF) + (code > 0xFFFF)
                ends = np.cumsum(size, dtype=np.int64)
                starts.append((ends - size)[cut].astype(np.int32) + np.int32(at))
                at += int(ends[-1])
        offsets = np.concatenate([*starts, [len(data)]]).astype(np.int32)
        if len(offsets) > 1:
            offsets[0] = 0
        return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def words_of(text: str) -> list[str]:
    """The words whose pieces make up the text, which starts as if a space stood before it."""
    return WORD.findall(" " + text.replace(SPACE, " ")) if text else []


# ---- the lattice -----------------------------------------------------------------------------------

#: So many characters choose the lengths of the substrings.
HEAD = 3
#: Positions of a segment that are exploded together, and nodes in a block of the fold.
BLOCK = 256


def lattice(words: DataFrame, pieces: list[Piece], byte: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, word and ids of the distinct (keys, word) rows of words."""
    spark = words.sparkSession
    longest = max(len(p) for p, _, _ in pieces)
    unknown = min(s for _, s, _ in pieces) - UNKNOWN_PENALTY
    table = F.broadcast(spark.createDataFrame(pieces, "piece string, score double, id int"))
    lengths: dict[str, set[int]] = {}
    for p, _, _ in pieces:
        lengths.setdefault(p[:HEAD], set()).add(len(p))
    # A head as long as HEAD also stands for the shorter pieces that it begins with.
    rows = [(h, sorted({1}.union(*(lengths.get(h[:k], ()) for k in range(1, len(h) + 1))))) for h in lengths]
    heads = F.broadcast(spark.createDataFrame(rows, "head string, lengths array<int>"))
    short = sorted({len(p) for p, _, _ in pieces if len(p) < HEAD} | {1})

    # A segment's number holds within its task only, and so does the grouping by it.
    numbered = words.select(*keys, "word", F.monotonically_increasing_id().alias("n"), F.length("word").alias("size"))
    blocks = numbered.select(
        *keys, "n", "word", "size", F.explode(F.sequence(F.lit(0), F.col("size") - 1, F.lit(BLOCK))).alias("begin")
    ).select(*keys, "n", F.when(F.col("begin") == 0, F.col("word")).alias("word"), "size", "begin", F.expr(f"substring(word, begin + 1, {BLOCK + longest})").alias("part"))
    starts = blocks.select(
        *keys, "n", "word", "begin", "part", F.explode(F.sequence(F.lit(0), F.least(F.col("size") - F.col("begin"), F.lit(BLOCK)) - 1)).alias("k")
    ).select(*keys, "n", F.when(F.col("k") == 0, F.col("word")).alias("word"), (F.col("begin") + F.col("k")).alias("s"), F.expr(f"substring(part, k + 1, {longest})").alias("rest"))
    edges = (
        starts.withColumn("head", F.substring("rest", 1, HEAD))
        .join(heads, "head", "left")
        .select(*keys, "n", "word", "s", "rest", F.explode(F.coalesce("lengths", F.array(*map(F.lit, short)))).alias("l"))
        .where(F.col("l") <= F.length("rest"))
        .withColumn("piece", F.expr("substring(rest, 1, l)"))
        .join(table, "piece", "left")
        .where("id IS NOT NULL OR l = 1")
        .select(
            *keys,
            "n",
            F.when(F.col("l") == 1, F.col("word")).alias("word"),
            F.struct(
                (F.col("s") + F.col("l")).alias("e"), "s", F.coalesce("score", F.lit(unknown)).alias("score"), F.coalesce("id", -F.ascii("piece") - 1).alias("id")
            ).alias("edge"),
        )
    )
    grouped = edges.groupBy(*keys, "n").agg(F.first("word", ignorenulls=True).alias("word"), F.sort_array(F.collect_list("edge")).alias("edges"))
    return grouped.select(*keys, "word", _path(F.col("edges"), byte).alias("ids"))


def _utf8(code: Column, byte: int) -> Column:
    """Ids of the UTF-8 bytes of a code point."""
    tail = lambda k: F.lit(128 + byte) + F.shiftright(code, 6 * k).bitwiseAND(63)
    lead = lambda k, mark: F.lit(mark + byte) + F.shiftright(code, 6 * k)
    return (
        F.when(code < 0x80, F.array(code + byte))
        .when(code < 0x800, F.array(lead(1, 0xC0), tail(0)))
        .when(code < 0x10000, F.array(lead(2, 0xE0), tail(1), tail(0)))
        .otherwise(F.array(lead(3, 0xF0), tail(2), tail(1), tail(0)))
    )


def _path(edges: Column, byte: int) -> Column:
    """Fold the sorted edges into the best (score, start, id) of every position, then walk back from the end.

    Nodes are held in blocks of BLOCK; the last block has fewer than twice as many, so that a step copies few.
    """
    node = "struct<score: double, s: int, id: int>"
    state = f"struct<done: array<array<{node}>>, cur: array<{node}>>"
    first = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(-1).alias("s"), F.lit(0).alias("id")))
    start = F.struct(F.array().alias("done"), first.alias("cur")).cast(state)

    def better(held: Column, edge: Column) -> Column:
        done, cur = held["done"], held["cur"]
        base = F.size(done) * BLOCK
        score = F.get(cur, edge["s"] - base)["score"] + edge["score"]
        new = F.struct(score.alias("score"), edge["s"].alias("s"), edge["id"].alias("id"))
        # Edges of one end come in the order of their starts, so that of equal sums the first, longest, stays.
        grown = F.when(F.size(cur) == edge["e"] - base, F.array_append(cur, new)).when(
            score > F.element_at(cur, -1)["score"], F.array_append(F.slice(cur, F.lit(1), edge["e"] - base), new)
        ).otherwise(cur)
        return F.when(F.size(cur) < 2 * BLOCK, F.struct(done.alias("done"), grown.alias("cur"))).otherwise(
            F.struct(F.array_append(done, F.slice(cur, 1, BLOCK)).alias("done"), F.slice(grown, BLOCK + 1, 2 * BLOCK).alias("cur"))
        ).cast(state)

    walk = "struct<at: int, ids: array<int>>"
    track = "struct<at: int, found: array<array<int>>>"

    def through(held: Column, b: Column, blocks: Column) -> Column:
        """Walk back through block b: its ids, last first."""
        nodes, base = F.get(blocks, b), b * BLOCK
        begin = F.struct(held["at"].alias("at"), F.array().cast("array<int>").alias("ids")).cast(walk)

        def back(s: Column, _: Column) -> Column:
            here = F.get(nodes, s["at"] - base)
            return F.when((s["at"] >= base) & (s["at"] > 0), F.struct(here["s"].alias("at"), F.array_append(s["ids"], here["id"]).alias("ids")).cast(walk)).otherwise(s)

        return F.element_at(
            F.transform(
                F.array(F.aggregate(nodes, begin, back)),
                lambda x: F.struct(x["at"].alias("at"), F.array_append(held["found"], x["ids"]).alias("found")).cast(track),
            ),
            1,
        )

    def ids_of(blocks: Column) -> Column:
        last = F.size(blocks) - 1
        begin = F.struct((last * BLOCK + F.size(F.element_at(blocks, -1)) - 1).alias("at"), F.array().cast("array<array<int>>").alias("found")).cast(track)
        return F.reverse(F.flatten(F.aggregate(F.sequence(last, F.lit(0), F.lit(-1)), begin, lambda s, b: through(s, b, blocks))["found"]))

    # transform over a single value names a fold's result, so that it is made once.
    blocks = F.transform(F.array(F.aggregate(edges, start, better)), lambda x: F.array_append(x["done"], x["cur"]))
    ids = F.element_at(F.transform(blocks, ids_of), 1)
    return F.element_at(
        F.transform(
            F.array(ids),
            lambda x: F.when(F.exists(x, lambda i: i < 0), F.flatten(F.transform(x, lambda i: F.when(i < 0, _utf8(-i - 1, byte)).otherwise(F.array(i))))).otherwise(x),
        ),
        1,
    )


# ---- chunks ----------------------------------------------------------------------------------------

CODEC = pa.Codec("zstd", 3)


def _squeeze(values: np.ndarray) -> bytes:
    """Numbers from 0 on, each of their three or four bytes zstd-compressed by itself, behind their count."""
    planes = np.ascontiguousarray(values, dtype="<i4").view(np.uint8).reshape(-1, 4)
    out = [len(planes).to_bytes(8, "little")]
    for k in range(4):
        plane = CODEC.compress(np.ascontiguousarray(planes[:, k]).tobytes(), asbytes=True) if len(planes) else b""
        out += [len(plane).to_bytes(8, "little"), plane]
    return b"".join(out)


def _expand(blob: bytes) -> np.ndarray:
    n, at = int.from_bytes(blob[:8], "little"), 8
    planes = np.zeros((n, 4), dtype=np.uint8)
    for k in range(4 if n else 0):
        size = int.from_bytes(blob[at : at + 8], "little")
        planes[:, k] = np.frombuffer(CODEC.decompress(blob[at + 8 : at + 8 + size], n, asbytes=True), dtype=np.uint8)
        at += 8 + size
    return planes.reshape(-1).view("<i4")


def _pack(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=CODEC)) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpack(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


CHUNK = "chunk long, docs binary, words binary, places binary"
CHUNK_SCHEMA = pa.schema([("chunk", pa.int64()), ("docs", pa.binary()), ("words", pa.binary()), ("places", pa.binary())])


class _Chunk:
    """Documents on their way into one chunk."""

    def __init__(self, cuts: Cuts):
        self.cuts, self.ids, self.counts, self.sums, self.segments, self.size = cuts, [], [], [], [], 0

    def add(self, ids: pa.Array, texts: list[str | None]) -> None:
        """Texts are joined for the cutting; as no piece holds a line end and more, they're cut where they meet."""
        given = [" " + x.replace(SPACE, " ") if x else "" for x in texts]
        found = self.cuts.segments(LINE_END.join([*given, ""]))
        breaks = self._breaks(found, given)
        self.segments.append(found.filter(pa.array(~breaks)))
        ends = np.flatnonzero(breaks)
        counts = np.diff(np.concatenate([[-1], ends])) - 1
        self.counts.append(np.where([x is None for x in texts], -1, counts) if texts else counts)
        self.sums.append(np.fromiter((zlib.crc32(x.encode()) for x in given), np.int64, len(given)))
        self.ids.append(ids)

    @staticmethod
    def _breaks(found: pa.Array, given: list[str]) -> np.ndarray:
        """Which segments are the line ends between texts."""
        ends = np.cumsum(np.fromiter((len(x.encode()) + 1 for x in given), np.int64, len(given))) - 1
        offsets = np.frombuffer(found.buffers()[1], dtype=np.int32)[: len(found)]
        out = np.zeros(len(found), dtype=bool)
        out[np.searchsorted(offsets, ends)] = True
        return out

    def packed(self, number: int) -> pa.RecordBatch:
        coded = pa.concat_arrays(self.segments).dictionary_encode()
        places = coded.indices.to_numpy()
        often = np.bincount(places, minlength=len(coded.dictionary))
        order = np.argsort(-often, kind="stable")
        rank = np.empty(len(order), dtype=np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        words = coded.dictionary.take(pa.array(order)).cast(pa.string())
        docs = pa.table({"doc_id": pa.chunked_array(self.ids), "n": pa.array(np.concatenate(self.counts), pa.int32()), "crc": pa.array(np.concatenate(self.sums))})
        row = [pa.array([x], t) for x, t in zip((number, _pack(docs), _pack(pa.table({"word": words})), _squeeze(rank[places])), CHUNK_SCHEMA.types, strict=True)]
        return pa.RecordBatch.from_arrays(row, schema=CHUNK_SCHEMA)


#: Texts cut at a time.
SLICE_BYTES = 1_000_000


def _chunks(batches: Iterator[pa.RecordBatch], cuts: Cuts, most: int) -> Iterator[pa.RecordBatch]:
    common.give_back()
    part, k = TaskContext.get().partitionId(), 0
    held = _Chunk(cuts)
    for batch in batches:
        # A row's id and count take some bytes too.
        sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 8
        begin = 0
        while begin < batch.num_rows:
            room = min(SLICE_BYTES, most - held.size)
            take = int(np.searchsorted(np.cumsum(sizes[begin:]), room, side="right"))
            if not take and held.size and sizes[begin] > most - held.size:
                yield held.packed(part << 32 | k)
                k, held = k + 1, _Chunk(cuts)
                common.give_back()
                continue
            take = max(take, 1)
            held.add(batch.column(0).slice(begin, take), batch.column(1).slice(begin, take).to_pylist())
            held.size += int(sizes[begin : begin + take].sum())
            begin += take
    if held.ids:
        yield held.packed(part << 32 | k)


def by_bucket(words: pa.Array, buckets: int) -> np.ndarray:
    """The bucket of every word by a hash of its bytes; -1 for the line end."""
    if not len(words):
        return np.zeros(0, dtype=np.int32)
    data = np.frombuffer(words.buffers()[2], dtype=np.uint8)
    offsets = np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    size = np.diff(offsets)
    used = data[offsets[0] : offsets[-1]]
    k = np.arange(len(used), dtype=np.int64) - np.repeat(offsets[:-1] - offsets[0], size)
    mixed = (used.astype(np.uint64) + np.uint64(1)) * (k.astype(np.uint64) * np.uint64(2) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    hashed = np.add.reduceat(mixed, offsets[:-1] - offsets[0])
    hashed ^= hashed >> np.uint64(32)
    found = (hashed % np.uint64(buckets)).astype(np.int32)
    found[(size == 1) & (used[offsets[:-1] - offsets[0]] == ord(LINE_END))] = -1
    return found


def _asked(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """A row for each bucket of a chunk: the chunk's number and its words, one a line."""
    for batch in batches:
        for chunk, blob in zip(batch.column(0), batch.column(2), strict=True):
            words = _unpack(blob.as_py()).column(0).combine_chunks()
            at = by_bucket(words, buckets)
            order = np.argsort(at, kind="stable")
            order = order[at[order] >= 0]
            there, begin = np.unique(at[order], return_index=True)
            lists = pa.ListArray.from_arrays(pa.array(np.append(begin, len(order)), pa.int32()), words.take(pa.array(order)))
            parts = pc.binary_join_element_wise(pa.scalar(str(chunk.as_py())), pc.binary_join(lists, LINE_END), LINE_END)
            yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), parts], names=["bucket", "part"])
            del words, at, order, lists, parts
            common.give_back()


ANSWER = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("ids", pa.binary()), ("counts", pa.binary())])


def _answer(asked: pa.Table, known: pa.Table) -> pa.Table:
    """Of one bucket: every chunk's words turned into their ids."""
    common.give_back()
    words = known.column("word").combine_chunks()
    lists = known.column("ids").combine_chunks()
    flat, size = lists.flatten().to_numpy(), lists.value_lengths().to_numpy().astype(np.int64)
    begin = np.cumsum(size) - size
    rows = []
    for bucket, part in zip(asked.column("bucket").to_pylist(), asked.column("part"), strict=True):
        found = pc.split_pattern(part, LINE_END).values
        at = pc.index_in(found.slice(1), value_set=words).to_numpy()
        rows.append({"chunk": int(found[0].as_py()), "bucket": bucket, "ids": _squeeze(gathered(flat, begin, size, at)), "counts": _squeeze(size[at])})
    return pa.Table.from_pylist(rows, schema=ANSWER)


def gathered(flat: np.ndarray, begin: np.ndarray, size: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The lists at the given places, one after another."""
    n = size[at]
    return flat[np.repeat(begin[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]


#: Places whose ids are put together at a time.
GATHERED = 500_000


def _encoded(chunk: pa.Table, answers: pa.Table, buckets: int, line_end: list[int], decoder: Decoder | None = None) -> pa.Table:
    """Of one chunk: doc_id and ids of its rows; with a decoder also whether the ids give back what was read."""
    common.give_back()
    docs = _unpack(chunk.column("docs")[0].as_py())
    words = _unpack(chunk.column("words")[0].as_py()).column(0).combine_chunks()
    places = _expand(chunk.column("places")[0].as_py())
    at = by_bucket(words, buckets)
    del words
    order = np.argsort(at, kind="stable")
    ends = int((at < 0).sum())
    flat, sizes = [np.array(line_end * ends, dtype=np.int32)], [np.full(ends, len(line_end), dtype=np.int64)]
    for _, ids, counts in sorted(zip(*(answers.column(c).to_pylist() for c in ("bucket", "ids", "counts")), strict=True)):
        flat.append(_expand(ids))
        sizes.append(_expand(counts).astype(np.int64))
    flat, size = np.concatenate(flat), np.concatenate(sizes)
    begin = np.cumsum(size) - size
    # Back to the order of the chunk's words.
    begin[order], size[order] = begin.copy(), size.copy()

    counts = docs.column("n").to_numpy()
    null = counts < 0
    after = np.cumsum(np.where(null, 0, counts))
    out, row, done = [], 0, 0
    while row < len(counts):
        end = max(int(np.searchsorted(after, done + GATHERED, side="right")), row + 1)
        own = places[done : after[end - 1]]
        values = gathered(flat, begin, size, own)
        upto = np.concatenate([[0], np.cumsum(size[own])])
        offsets = upto[np.concatenate([[0], after[row:end] - done])].astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()), mask=pa.array(null[row:end]))
        found = {"doc_id": docs.column("doc_id").slice(row, end - row), "ids": lists}
        if decoder:
            data, ends = decoder.joined(values, offsets)
            sums = np.fromiter((zlib.crc32(data[a:b]) for a, b in zip(ends, ends[1:], strict=False)), np.int64, end - row)
            found["round_trip"] = pa.array(sums == docs.column("crc").slice(row, end - row).to_numpy(), mask=null[row:end])
        out.append(pa.table(found))
        row, done = end, int(after[end - 1])
    return pa.concat_tables(out)


def encode(
    documents: DataFrame,
    model: str = MODEL,
    buckets: int | None = None,
    chunk_bytes: int = CHUNK_BYTES,
    table: tuple[list[Piece], int] | None = None,
    round_trip: bool = False,
) -> DataFrame:
    """doc_id and ids of every row of documents. table: pieces with scores, and the id of the byte 0, instead of a model file.

    round_trip: the ids are decoded again, and a column of that name says whether their bytes have the checksum of
    the text as it was read, with spaces for U+2581; null for a null text.
    """
    spark = documents.sparkSession
    pieces, byte = table or load_pieces(model)
    n = buckets or max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    line_end = next(([i] for p, _, i in pieces if p == LINE_END), [byte + ord(LINE_END)])
    cuts = Cuts(pieces)
    id_type = documents.schema["doc_id"].dataType.simpleString()
    decoder, also = (Decoder(pieces, byte), ", round_trip boolean") if round_trip else (None, "")
    chunks = documents.select("doc_id", "text").mapInArrow(lambda b: _chunks(b, cuts, chunk_bytes), CHUNK).repartition("chunk")
    # What is asked is one text a row, and no filter comes before, so that both of its readers take all of it and Spark makes and shuffles it once.
    asked = chunks.mapInArrow(lambda b: _asked(b, n), "bucket int, part string").repartition("bucket")
    words = asked.select("bucket", F.explode_outer(F.slice(F.split("part", "\n", -1), 2, 2**31 - 1)).alias("word")).distinct()
    known = lattice(words, pieces, byte, ("bucket",)).select(F.col("bucket").alias("of"), "word", "ids")
    answers = (
        asked.groupBy("bucket")
        .cogroup(known.groupBy("of"))
        .applyInArrow(lambda a, b: _answer(a, b), "chunk long, bucket int, ids binary, counts binary")
    )
    return (
        chunks.groupBy("chunk")
        .cogroup(answers.groupBy("chunk"))
        .applyInArrow(lambda a, b: _encoded(a, b, n, line_end, decoder), f"doc_id {id_type}, ids array<int>{also}")
    )


class Decoder:
    """The bytes of every id."""

    def __init__(self, pieces: list[Piece], byte: int):
        of = {i: p.encode() for p, _, i in pieces} | {byte + b: bytes([b]) for b in range(256)}
        own = [of.get(i, b"") for i in range(max(of) + 1)]
        self.size = np.array([len(x) for x in own], dtype=np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(own), dtype=np.uint8)

    def joined(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of all lists of ids, which begin and end at the offsets, and where each list's begin and end."""
        upto = np.concatenate([[0], np.cumsum(self.size[ids])])
        return gathered(self.flat, self.begin, self.size, ids).tobytes(), upto[offsets]

    def text(self, ids: list[int]) -> str:
        data, _ = self.joined(np.array(ids, dtype=np.int64), np.array([0, len(ids)]))
        return data.decode("utf-8", errors="replace")[1:]  # the first space stands before every text


def decode_column(spark: SparkSession, model: str = MODEL):
    """An Arrow UDF from ids to the text; null to null."""
    shared = spark.sparkContext.broadcast(Decoder(*load_pieces(model)))

    @common.vector_udf(pa.string())
    def decode(ids: pa.Array) -> pa.Array:
        values, size = ids.flatten().to_numpy(zero_copy_only=False), pc.fill_null(ids.value_lengths(), 0).to_numpy(zero_copy_only=False)
        data, ends = shared.value.joined(values, np.concatenate([[0], np.cumsum(size)]))
        found = [data[a:b].decode("utf-8", errors="replace")[1:] for a, b in zip(ends, ends[1:], strict=False)]
        return pa.array([None if null else x for x, null in zip(found, ids.is_null().to_pylist(), strict=True)], pa.string())

    return decode
