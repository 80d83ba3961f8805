"""Personal data by a skip-chain conditional random field over the tokens with a digit or an "@".

Base detectors find e-mail addresses, IP addresses, card and phone numbers by pattern and checksum; what
they find always stays. The field labels the tokens around them: a token's potential comes from its
shape, chain potentials tie neighbours, and skip potentials tie distant tokens of a document that repeat
or resemble each other (the same characters, or the same digits without a point, seven at least where a
token has no letters; the same length, shape and first digits). Tokens of one such group share a hub
variable, so a group of n tokens has n skip edges, not n * n. Loopy message passing gives the marginals;
tokens labelled with a kind outside the base spans become further spans: a number that stands elsewhere in
the document as a phone number's part is one here too, with or without its "+".

Weights are fitted by weighted pseudo-likelihood on counts of (shape, labels of the neighbours, label of
the group, own label) gathered over all documents, with the base detectors' labels as the truth, but for one
case: a token without a label whose group mostly has a kind says nothing, as the patterns can't tell there.
The number of distinct counts depends on the shapes, not on the number of documents; the `max_counts` most
frequent ones are fitted.

Offsets are code points, ends exclusive. Defined results: a null or empty text has no spans; repeated
rows get a row each; an empty table gives an empty result. Extra columns are kept by `redact`.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.llm import common

KINDS = ("email", "ip", "card", "phone")
RANK = {k: i for i, k in enumerate(KINDS)}
O = len(KINDS)  # noqa: E741  the label of other tokens
LABELS = len(KINDS) + 1
NONE = LABELS  # no such neighbour or group

Span = tuple[str, int, int]

LOCAL = r"A-Za-z0-9._%+-"
DOMAIN = r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
EMAIL = re.compile(rf"(?<![{LOCAL}])[{LOCAL}]+{DOMAIN}")
EMAIL_HERE = re.compile(rf"[{LOCAL}]+{DOMAIN}")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NODE = re.compile(r"(?<!\S)[^\s0-9@]*[0-9@]\S*")
DIGIT = re.compile(r"[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")
CORE = re.compile(r"[^\W_](?:.*[^\W_])?", re.S)
NUMBER = re.compile(r"\+?[0-9](?:.*[0-9])?", re.S)


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches that don't overlap. Only the start of a run of local characters can begin one, or where the last match ended: so long runs cost no squares."""
    at = 0
    while True:
        m = (EMAIL_HERE.match(text, at) if at else None) or EMAIL.search(text, at)
        if not m:
            return
        yield m.span()
        at = m.end()


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    found: list[Span] = []
    if "@" in text:
        found += [("email", a, b) for a, b in emails(text)]
    if DIGIT.search(text):
        for m in IP.finditer(text):
            # A part of many digits is above 255 without being turned into a number, but for leading zeros.
            if all(len(p) <= 3 and int(p) <= 255 for p in (q.lstrip("0") or "0" for q in m[0].split("."))):
                found.append(("ip", *m.span()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(digits := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                    found.append(("phone", *m.span()))
    return ordered(found)


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], RANK[s[0]], s[2]))


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


@dataclass
class Nodes:
    """Tokens of a document: their places, shapes, group keys, base labels, and whether only one space divides a token from the one before."""

    at: list[tuple[int, int]]
    shape: list[tuple[int, ...]]
    same: list[str]
    alike: list[str]
    label: list[int]
    near: list[bool]


def step(n: int, bounds: tuple[int, ...]) -> int:
    return sum(n >= b for b in bounds)


def nodes_of(text: str, base: list[Span]) -> Nodes:
    out = Nodes([], [], [], [], [], [])
    last = -2
    k = 0
    for m in NODE.finditer(text):
        a, b = m.span()
        token = m[0].strip(".,;:!?\"'")
        digits = NOT_DIGIT.sub("", token)
        letters = step(sum(map(str.isalpha, token)), (1, 3))
        shape = (
            step(len(digits), (1, 2, 3, 4, 5, 7, 10, 14, 16, 17, 20)),
            min(token.count("."), 4),
            min(token.count("-"), 2),
            letters,
            int("@" in token),
            int(token.startswith("+")),
            int(token.startswith("(")),
            int(letters == 0 and 14 <= len(digits) <= 19 and luhn(digits)),
        )
        label = O
        while k < len(base) and base[k][2] <= a:
            k += 1
        for kind, s, e in base[k:]:
            if s >= b:
                break
            if e > a:
                label = RANK[kind]
                break
        out.at.append((a, b))
        out.shape.append(shape)
        # Short numbers repeat by chance; with points they aren't the number that their digits make.
        out.same.append(token.lower() if letters and len(token) >= 5 or token.count(".") == 3 else digits if not letters and len(digits) >= 7 and "." not in token else "")
        out.alike.append(f"{len(digits)}/{shape[1:]}/{digits[:6]}" if letters == 0 and len(digits) >= 8 else "")
        out.label.append(label)
        out.near.append(a == last + 1)
        last = b
    return out


def group_label(labels: list[int], own: int, counts: Counter) -> int:
    """What the others of the group mostly are: the kind with most tokens, O if none has a kind, NONE without others."""
    if sum(counts.values()) < 2:
        return NONE
    best, most = O, 0
    for kind in range(O):
        n = counts[kind] - (own == kind)
        if n > most:
            best, most = kind, n
    return best


def pseudo_rows(nodes: Nodes) -> Iterator[tuple[int, ...]]:
    """For the fit: shape, near and label of both neighbours, labels of both groups, own label; not for tokens without a label whose group has a kind."""
    n = len(nodes.at)
    by: list[dict[str, Counter]] = [{}, {}]
    for which, keys in zip(by, (nodes.same, nodes.alike), strict=True):
        for key, label in zip(keys, nodes.label, strict=True):
            which.setdefault(key, Counter())[label] += 1
    for i in range(n):
        own = nodes.label[i]
        before = (int(nodes.near[i]), nodes.label[i - 1]) if i else (0, NONE)
        after = (int(nodes.near[i + 1]), nodes.label[i + 1]) if i + 1 < n else (0, NONE)
        groups = [group_label(nodes.label, own, w[k]) if k else NONE for w, k in ((by[0], nodes.same[i]), (by[1], nodes.alike[i]))]
        if own == O and any(g < O for g in groups):
            continue
        yield (*nodes.shape[i], *before, *after, *groups, own)


SHAPE = 8


@dataclass(frozen=True)
class SkipChain:
    unary: dict[tuple[int, ...], np.ndarray]
    unseen: np.ndarray
    chain: np.ndarray  # near x label before x label after
    skip: np.ndarray  # same or alike: what equal labels in a group are worth


def fit_weights(rows: list[tuple[int, ...]], counts: list[int], steps: int = 300, rate: float = 0.1) -> SkipChain:
    """Adam on the weighted log pseudo-likelihood of the labels, with the square of the weights held down."""
    unseen = np.where(np.arange(LABELS) == O, 2.0, -2.0)
    if not rows:
        return SkipChain({}, unseen, np.zeros((2, LABELS, LABELS)), np.zeros(2))
    x = np.array(rows, dtype=np.int64)
    weight = np.array(counts, dtype=np.float64) / sum(counts)
    shapes, shape = np.unique(x[:, :SHAPE], axis=0, return_inverse=True)
    shape = shape.ravel()
    near_b, before, near_a, after, same, alike, own = x[:, SHAPE:].T
    truth = np.eye(LABELS)[own]
    labels = np.arange(LABELS)
    agree = [np.where((g[:, None] == labels) & (g[:, None] != NONE), 1.0, 0.0) for g in (same, alike)]
    has_b, has_a = (before != NONE), (after != NONE)
    size = len(shapes) * LABELS
    theta = np.zeros(size + 2 * LABELS * LABELS + 2)
    theta[:size] = np.tile(unseen * 0.1, len(shapes))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        u = theta[:size].reshape(-1, LABELS)
        c = theta[size:-2].reshape(2, LABELS, LABELS)
        s = theta[-2:]
        z = u[shape] + s[0] * agree[0] + s[1] * agree[1]
        z[has_b] += c[near_b[has_b], before[has_b]]
        z[has_a] += c[near_a[has_a], :, after[has_a]]
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        d = (truth - p / p.sum(axis=1, keepdims=True)) * weight[:, None]
        g_u, g_c = np.zeros_like(u), np.zeros_like(c)
        np.add.at(g_u, shape, d)
        np.add.at(g_c, (near_b[has_b], before[has_b]), d[has_b])
        np.add.at(np.swapaxes(g_c, 1, 2), (near_a[has_a], after[has_a]), d[has_a])
        g = np.concatenate([g_u.ravel(), g_c.ravel(), [(d * agree[0]).sum(), (d * agree[1]).sum()]]) - 1e-5 * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g**2
        theta = theta + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-10)
        theta[-2:] = np.clip(theta[-2:], 0, 6)  # groups tie, they never repel
    u = theta[:size].reshape(-1, LABELS)
    return SkipChain({tuple(k): w for k, w in zip(shapes.tolist(), u, strict=True)}, unseen, theta[size:-2].reshape(2, LABELS, LABELS), theta[-2:])


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def marginals(model: SkipChain, docs: list[Nodes], rounds: int = 8, damp: float = 0.3) -> np.ndarray:
    """Loopy sum-product over the tokens of many documents at once; base labels are evidence."""
    unary, doc, near, hubs, hub_of, kind_of, member = [], [], [], {}, [], [], []
    for d, nodes in enumerate(docs):
        for i in range(len(nodes.at)):
            w = model.unary.get(nodes.shape[i], model.unseen)
            unary.append(w + 30.0 * (np.arange(LABELS) == nodes.label[i]) if nodes.label[i] != O else w)
            for which, key in enumerate((nodes.same[i], nodes.alike[i])):
                if key:
                    hub_of.append(hubs.setdefault((d, which, key), len(hubs)))
                    kind_of.append(which)
                    member.append(len(doc))
            doc.append(d)
            near.append(nodes.near[i])
    n = len(doc)
    if not n:
        return np.zeros((0, LABELS))
    u = np.array(unary)
    doc_at = np.array(doc)
    left = np.flatnonzero(doc_at[1:] == doc_at[:-1])
    potential = model.chain[np.array(near, dtype=np.int64)[left + 1]]  # edges x before x after
    hub_of, kind_of, member = (np.array(x, dtype=np.int64) for x in (hub_of, kind_of, member))
    shared = np.bincount(hub_of, minlength=len(hubs))[hub_of] > 1 if len(hub_of) else np.zeros(0, dtype=bool)
    hub_of, kind_of, member = hub_of[shared], kind_of[shared], member[shared]
    tie = model.skip[kind_of][:, None, None] * np.eye(LABELS)
    ahead, back = np.zeros((len(left), LABELS)), np.zeros((len(left), LABELS))
    down = np.zeros((len(member), LABELS))
    belief = u
    for _ in range(rounds if len(left) or len(member) else 0):
        belief = u.copy()
        np.add.at(belief, left + 1, ahead)
        np.add.at(belief, left, back)
        np.add.at(belief, member, down)
        new_ahead = _log_sum((belief[left] - back)[:, :, None] + potential, 1)
        new_back = _log_sum((belief[left + 1] - ahead)[:, None, :] + potential, 2)
        up = _log_sum((belief[member] - down)[:, :, None] + tie, 1)
        up -= up.max(axis=1, keepdims=True)
        hub = np.zeros((len(hubs), LABELS))
        np.add.at(hub, hub_of, up)
        new_down = _log_sum((hub[hub_of] - up)[:, :, None] + tie, 1)
        mix = lambda old, new: damp * old + (1 - damp) * (new - new.max(axis=1, keepdims=True))
        ahead, back, down = mix(ahead, new_ahead), mix(back, new_back), mix(down, new_down)
        belief = u.copy()
        np.add.at(belief, left + 1, ahead)
        np.add.at(belief, left, back)
        np.add.at(belief, member, down)
    p = np.exp(belief - belief.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def added_spans(text: str, base: list[Span], nodes: Nodes, p: np.ndarray, at_least: float = 0.5) -> list[Span]:
    """Tokens that the field gives a kind, outside the base spans; neighbours of one number kind make one span."""
    out: list[Span] = []
    taken = [(a, b) for _, a, b in base]
    last = -1
    for i, (a, b) in enumerate(nodes.at):
        kind = int(p[i].argmax())
        if kind == O or p[i, kind] < at_least or nodes.label[i] != O or any(s < b and a < e for s, e in taken):
            continue
        core = (CORE if KINDS[kind] == "email" else NUMBER).search(text, a, b)
        if not core:
            continue
        whole = nodes.shape[i][-1] or nodes.shape[i - 1][-1]  # a card number by itself
        if out and last == i - 1 and nodes.near[i] and out[-1][0] == KINDS[kind] and KINDS[kind] in ("card", "phone") and not whole:
            out[-1] = (KINDS[kind], out[-1][1], core.end())
        else:
            out.append((KINDS[kind], *core.span()))
        last = i
    return out


def find(model: SkipChain, texts: list[str | None]) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and all spans of every text."""
    base = [base_spans(x or "") for x in texts]
    nodes = [nodes_of(x, b) if x and ("@" in x or DIGIT.search(x)) else Nodes([], [], [], [], [], []) for x, b in zip(texts, base, strict=True)]
    p = marginals(model, nodes)
    out, at = [], 0
    for x, b, own in zip(texts, base, nodes, strict=True):
        n = len(own.at)
        out.append((b, ordered(b + added_spans(x or "", b, own, p[at : at + n]))))
        at += n
    return out


def fit(documents: DataFrame, max_counts: int = 100_000) -> SkipChain:
    """Counts over all documents, added up before and after the shuffle, then the weights; the most frequent counts come to the driver."""
    columns = [f"c{i}" for i in range(SHAPE + 7)]
    schema = ", ".join(f"{c} int" for c in columns) + ", n long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text and ("@" in text or DIGIT.search(text)):
                    found.update(pseudo_rows(nodes_of(text, base_spans(text))))
        if found:
            keys = np.array(list(found), dtype=np.int32)
            arrays = [pa.array(keys[:, i]) for i in range(len(columns))]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(list(found.values()), pa.int64())], names=[*columns, "n"])

    counted = documents.select("text").mapInArrow(count, schema).groupBy(*columns).agg(F.sum("n").alias("n"))
    rows = counted.orderBy(F.desc("n"), *columns).limit(max_counts).collect()
    return fit_weights([tuple(r)[:-1] for r in rows], [r["n"] for r in rows])


FOUND = pa.struct(
    [*[(f"n_{k}", pa.int64()) for k in KINDS], ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())]
)


def found_column(spark: SparkSession, model: SkipChain):
    shared = spark.sparkContext.broadcast(model)

    @common.vector_udf(FOUND)
    def found(text: pa.Array) -> pa.Array:
        out = []
        for base, spans in find(shared.value, text.to_pylist()):
            n = Counter(k for k, _, _ in base)
            row = {f"n_{k}": n[k] for k in KINDS}
            row |= {"base_sha256": hashlib.sha256(written(base).encode()).hexdigest(), "spans": written(spans)}
            out.append(row | {"n_added": len(spans) - len(base)})
        return pa.array(out, FOUND)

    return found


def find_spans(documents: DataFrame, model: SkipChain | None = None) -> DataFrame:
    """doc_id, the base counts and their digest, and all spans of every row of documents."""
    found = found_column(documents.sparkSession, model or fit(documents))
    return documents.select("doc_id", found("text").alias("f")).select("doc_id", "f.*")


def redacted(text: str, spans: list[Span]) -> str:
    """text with every span replaced by its kind in brackets; spans that overlap are replaced together, by the first one's kind."""
    out, done = [], 0
    k = 0
    while k < len(spans):
        kind, a, b = spans[k]
        k += 1
        while k < len(spans) and spans[k][1] < b:
            b = max(b, spans[k][2])
            k += 1
        out += [text[done:a], f"[{kind.upper()}]"]
        done = b
    return "".join([*out, text[done:]])


def redact(documents: DataFrame, model: SkipChain | None = None) -> DataFrame:
    """documents with every span in text replaced; all columns and rows stay."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(model or fit(documents))

    @common.vector_udf(pa.string())
    def clean(text: pa.Array) -> pa.Array:
        given = text.to_pylist()
        return pa.array([x and redacted(x, s) for x, (_, s) in zip(given, find(shared.value, given), strict=True)], pa.string())

    return documents.select(*[clean("text").alias("text") if c == "text" else F.col(f"`{c}`") for c in documents.columns])
