"""Quality rules: a decision list, learned by sequential covering, as ordered Spark conditions.

Every rule is a conjunction of thresholds on statistics of a text, and rejects what it covers. A rule
is grown on two thirds of the uncovered labelled rows by information gain (FOIL) and pruned on the
rest; covering ends when a pruned rule rejects more good than bad rows. The list becomes one
`CASE WHEN` expression whose branches are the rules in order.

Learning reads the statistics of a bounded sample of the labelled rows (`max_rows`); the statistics and
the verdict cover every row and every whole text.

Defined results: a null or empty text has no words and fails the base rule (fewer than 20 words);
repeated rows get a row each; an empty table gives an empty result; without labelled rows of both
kinds the list is empty and only the base rule rejects.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.llm import common

SPAN = 8
#: A word is a run of other characters than space, tab, newline, vertical tab, form feed and carriage return.
SPACES = str.maketrans({c: " " for c in "\t\n\x0b\x0c\r"})
NOT_SYMBOL = bytes(c for c in range(256) if c not in b"#*$%&|<>")

STATS = pa.struct(
    [(k, pa.int64()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
)
#: What rules are made of: shares of the counts.
FEATURES = ("mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "bang_share")

Rule = list[tuple[str, str, float]]  # (feature, ">=" or "<=", threshold)


def split_words(text: str) -> list[str]:
    return [w for w in text.translate(SPACES).split(" ") if w]


def repeated_words(words: Sequence[bytes | str], span: int = SPAN) -> int:
    """Words inside windows of `span` words that are found twice or more, the first included."""
    n = len(words) - span + 1
    if n < 2:
        return 0
    number: dict = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.uint64)
    if len(number) == len(words):
        return 0
    with np.errstate(over="ignore"):
        mixed = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        key = np.zeros(n, dtype=np.uint64)
        for k in range(span):
            key = key * np.uint64(0x100000001B3) + mixed[k : k + n]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    # Equal keys only propose: windows next to each other in the order are compared word by word.
    a, b = order[:-1][same], order[1:][same]
    equal = np.ones(len(a), dtype=bool)
    for k in range(span):
        equal &= ids[a + k] == ids[b + k]
    if equal.all():
        starts = np.unique(np.concatenate([a, b]))
    else:  # a collision of keys
        seen: dict = {}
        for i in range(n):
            seen.setdefault(tuple(ids[i : i + span].tolist()), []).append(i)
        starts = np.array(sorted(i for at in seen.values() if len(at) > 1 for i in at), dtype=np.int64)
        if not len(starts):
            return 0
    mark = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(mark, starts, 1)
    np.add.at(mark, starts + span, -1)
    return int((np.cumsum(mark) > 0).sum())


#: Characters of UTF-8 that aren't the first byte of a code point.
CONTINUED = bytes(range(128, 192))
#: bytes.split() divides at just these six characters.
assert b"\x1c\x85\xa0".split() == [b"\x1c\x85\xa0"]


def statistics(text: bytes) -> tuple[int, int, int, int, int]:
    words = text.split()
    chars = sum(map(len, words)) - (len(text) - len(text.translate(None, CONTINUED)))
    symbols = len(text.translate(None, NOT_SYMBOL))
    lines, seen, dup = text.split(b"\n"), set(), 0
    if len(lines) > 1:
        for line in lines:
            if line in seen:
                dup += 1
            elif line and not line.isspace():
                seen.add(line)
    return len(words), chars, symbols, dup, repeated_words(words)


@common.vector_udf(STATS)
def statistics_column(text: pa.Array) -> pa.Array:
    found = np.array([statistics(x) for x in common.texts(text)], dtype=np.int64).reshape(-1, 5)
    return pa.StructArray.from_arrays([pa.array(found[:, k]) for k in range(5)], fields=list(STATS))


def features(stats: Column, text: Column) -> dict[str, Column]:
    """The rules' features as Spark expressions, all of them rounded so that thresholds mean the same everywhere."""
    words = F.greatest(stats["n_words"], F.lit(1))
    chars = F.greatest(stats["word_chars"], F.lit(1))
    lines = F.size(F.split(F.coalesce(text, F.lit("")), "\n", -1))
    upper = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Z]+", ""))
    bangs = F.regexp_count(F.coalesce(text, F.lit("")), F.lit("!!"))
    return {
        "mean_word": F.round(stats["word_chars"] / words, 6),
        "symbol_share": F.round(stats["n_symbols"] / words, 6),
        "dup_line_share": F.round(stats["n_dup_lines"] / lines, 6),
        "repeat_share": F.round(stats["n_repeat_words"] / words, 6),
        "upper_share": F.round(upper / chars, 6),
        "bang_share": F.round(bangs / words, 6),
    }


def covered(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    found = np.ones(n, dtype=bool)
    for name, op, at in rule:
        found &= x[name] >= at if op == ">=" else x[name] <= at
    return found


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, max_conditions: int) -> Rule:
    rule: Rule = []
    n = len(bad)
    inside = np.ones(n, dtype=bool)
    while len(rule) < max_conditions and (inside & ~bad).any():
        p0, n0 = (inside & bad).sum(), inside.sum()
        best: tuple[float, tuple[str, str, float] | None] = (1e-9, None)
        for name, values in x.items():
            for at in np.unique(np.quantile(values[inside], np.linspace(0, 1, 129), method="nearest")):
                for op in (">=", "<="):
                    now = inside & (values >= at if op == ">=" else values <= at)
                    p1, n1 = (now & bad).sum(), now.sum()
                    if p1 and n1 < n0:
                        gain = p1 * (np.log2(p1 / n1) - np.log2(p0 / n0))
                        if gain > best[0]:
                            best = (gain, (name, op, float(at)))
        if best[1] is None:
            break
        rule.append(best[1])
        inside = covered(rule, x, n)
    return rule


def _prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    def worth(r: Rule) -> float:
        inside = covered(r, x, len(bad))
        p = (inside & bad).sum()
        return float((2 * p - inside.sum()) / inside.sum()) if inside.any() else -1.0

    shorter = [rule[:k] for k in range(1, len(rule) + 1)]
    return max(shorter, key=lambda r: (worth(r), len(r))) if shorter else rule


def learn(x: dict[str, np.ndarray], bad: np.ndarray, max_rules: int = 16, max_conditions: int = 4) -> list[Rule]:
    """Sequential covering: each rule is learned on the rows that earlier rules leave."""
    rules: list[Rule] = []
    x, bad = dict(x), np.asarray(bad, dtype=bool)
    while len(rules) < max_rules and bad.sum() >= 3 and (~bad).any():
        test = np.arange(len(bad)) % 3 == 2
        part = lambda m: {k: v[m] for k, v in x.items()}  # noqa: E731, B023
        rule = _grow(part(~test), bad[~test], max_conditions)
        if not rule:
            break
        rule = _prune(rule, part(test), bad[test])
        inside = covered(rule, x, len(bad))
        in_test = inside & test
        if not inside.any() or (inside & bad).sum() <= (inside & ~bad).sum() or (in_test & bad).sum() < (in_test & ~bad).sum():
            break
        rules.append(rule)
        x, bad = {k: v[~inside] for k, v in x.items()}, bad[~inside]
    return rules


def rejects(rules: list[Rule], found: dict[str, Column]) -> Column:
    """The number of the first rule that covers the row, or null: one ordered conditional expression."""
    column = None
    for k, rule in enumerate(rules):
        holds = F.lit(True)
        for name, op, at in rule:
            holds = holds & (found[name] >= at if op == ">=" else found[name] <= at)
        column = F.when(holds, F.lit(k)) if column is None else column.when(holds, F.lit(k))
    return F.lit(None).cast("int") if column is None else column


def fit(documents: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> list[Rule]:
    """Rules from the training folds. The sample's ids are bounded by max_rows, so they're broadcast."""
    sample = common.bounded(common.labelled(documents.sparkSession, labels, "quality"), max_rows)
    rows = documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id").withColumn("s", statistics_column("text"))
    found = rows.select("doc_id", "label", *[v.alias(k) for k, v in features(F.col("s"), F.col("text")).items()]).toArrow()
    found = found.sort_by([("doc_id", "ascending")])
    x = {k: found.column(k).to_numpy() for k in FEATURES}
    return learn(x, found.column("label").to_numpy() == 0)


def judge(documents: DataFrame, labels: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """doc_id, the counts, base_failed, kept, and the number of the rule that rejects the row."""
    rules = fit(documents, labels) if rules is None else rules
    rows = documents.select("doc_id", "text", statistics_column.asNondeterministic()("text").alias("s"))
    s = F.col("s")
    base = (s["n_words"] < 20) | (100 * s["n_repeat_words"] > 30 * s["n_words"])
    rule = rejects(rules, features(s, F.col("text")))
    return rows.select("doc_id", "s.*", base.alias("base_failed"), rule.alias("rule")).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"),
        "rule",
    )
