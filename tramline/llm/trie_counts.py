"""Token counts by dynamic programming over a trie of the distinct pre-tokens.

A batch's distinct words are inserted in a trie. Forward scores of the unigram table (the best sum of
piece scores up to a character, and the pieces on that path) depend on the prefix alone, so a walk of
the trie computes them once for every shared prefix; nodes where a word ends store its count of tokens.
A text's count is the sum over its words. Pieces, words and ties are those of `pieces`, so a count is
the number of ids that encoding gives.

Every row and every whole text is counted; the trie of a batch is dropped after it. Defined results: a
null or empty text has no words and no tokens; repeated rows get a row each; an empty table gives an
empty result.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.llm import common, pieces

COUNTS = pa.struct([("n_chars", pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64())])


class Unigram:
    """The pieces by their text, and how long they get by their last character."""

    def __init__(self, table: list[pieces.Piece]):
        self.score = {p: s for p, s, _ in table}
        self.unknown = min(self.score.values()) - pieces.UNKNOWN_PENALTY
        self.lengths: dict[str, tuple[int, ...]] = {}
        by_last: dict[str, set[int]] = {}
        for p in self.score:
            by_last.setdefault(p[-1], set()).add(len(p))
        self.lengths = {c: tuple(sorted(n, reverse=True)) for c, n in by_last.items()}


def build_trie(words: set[str]) -> dict:
    """Nested dicts by character; the key "" marks where a word ends."""
    root: dict = {}
    for w in words:
        at = root
        for c in w:
            at = at.setdefault(c, {})
        at[""] = w
    return root


def terminal_counts(model: Unigram, words: set[str]) -> dict[str, int]:
    """Tokens of every word: a walk of the trie in depth with one stack of forward scores."""
    score, lengths, unknown = model.score, model.lengths, model.unknown
    found: dict[str, int] = {}
    best, tokens, prefix = [0.0], [0], ""
    stack: list[tuple[str, dict]] = [("", build_trie(words))]
    while stack:
        prefix, node = stack.pop()
        n = len(prefix)
        if n:
            # The stack holds forward scores of the path to this node's parent; deeper ones are of another branch.
            del best[n:], tokens[n:]
            top, count = -1e300, 0
            for k in lengths.get(prefix[-1], ()):
                if k <= n and (own := score.get(prefix[n - k :])) is not None and (sum_ := best[n - k] + own) > top:
                    top, count = sum_, tokens[n - k] + 1
            if (prefix[-1] not in score) and (sum_ := best[n - 1] + unknown) > top:
                top, count = sum_, tokens[n - 1] + len(prefix[-1].encode())
            best.append(top)
            tokens.append(count)
        for c, child in node.items():
            if c:
                stack.append((prefix + c, child))
            else:
                found[child] = tokens[n]
    return found


def count_texts(model: Unigram, texts: list[str | None]) -> list[tuple[int, int, int]]:
    split = [pieces.words_of(x) if x else [] for x in texts]
    counts = terminal_counts(model, set().union(*split))
    get = counts.__getitem__
    return [(len(x or ""), len(w), sum(map(get, w))) for x, w in zip(texts, split, strict=True)]


def count_column(spark: SparkSession, model: str = pieces.MODEL):
    shared = spark.sparkContext.broadcast(Unigram(pieces.load_pieces(model)[0]))

    @common.vector_udf(COUNTS)
    def count(text: pa.Array) -> pa.Array:
        out = []
        given = text.to_pylist()
        for at in range(0, len(given), 1000):
            out += count_texts(shared.value, given[at : at + 1000])
        columns = zip(*out, strict=True) if out else ([], [], [])
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], fields=list(COUNTS))

    return count


def count_tokens(documents: DataFrame, model: str = pieces.MODEL) -> DataFrame:
    """doc_id, n_chars, n_words and n_tokens of every row of documents."""
    return documents.select("doc_id", count_column(documents.sparkSession, model)("text").alias("c")).select("doc_id", "c.*")
