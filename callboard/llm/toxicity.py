"""Toxic spans by a linear-chain conditional random field.

Only documents carry labels, so tokens are labelled first: in a toxic document, a word counts as
toxic when it, or its first letters, occur in enough labelled documents and nearly all of those
are toxic; all other words are not.  The field has two states and one score per hashed feature
(the word, its first and last letters), so it tags words that training never saw.  It is fitted
by gradients of its likelihood (expected counts from forward-backward) on a bounded sample.

Scoring runs forward-backward over chains that are whole lines, however long, and turns the
marginals into a document's score and its offending offsets.  All lines of a batch are one
sequence in which a line's first word forgets what came before; the sequence is cut into stretches
of ``STRETCH`` words whose transfer products are taken first, all stretches at once, so that every
stretch then starts from the exact weights on both of its sides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callboard.llm.arrays import LEAD, LOWER, WORD, Rolling, chained, mixed, owners, pieces, raw, spans

BITS = 19
BUCKETS = 1 << BITS
STRETCH = 64
THRESHOLD = 0.3
#: Labelled documents of each class that the model is fitted on, chosen by hash, and the longest.
SAMPLE_ROWS = 1000
SAMPLE_CHARS = 6000
#: Clean documents for each toxic one in the sample.
CLEAN = 3
#: A word or its beginning counts as toxic from so many toxic documents at least, this share of
#: all toxic ones at least, and this share of toxic ones among all that have it.
SEED_DOCUMENTS = 4
SEED_COVER = 0.02
SEED_SHARE = 0.97
PLAIN = 4
CURVE = np.array([-2.0, 1.0, 0.5])
EPOCHS = 12
RATE = 0.5
DECAY = 1e-6
TRIM = np.zeros(256, bool)
TRIM[list(b".,;:!?\"'()[]{}|*#$%&<>")] = True
TABLES = 6


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """TABLES features of each word as 31-bit hashes: itself, its first 3 to 6 bytes, its last 4.
    A weight's place is a hash's upper ``BITS`` bits."""
    a, b = starts.copy(), ends.copy()
    for _ in range(4):
        b -= (b - a > 1) & TRIM[data[np.maximum(b - 1, 0)]]
        a += (b - a > 1) & TRIM[data[np.minimum(a, max(len(data) - 1, 0))]]
    rolling = Rolling(data)
    cuts = [(a, b), *((a, np.minimum(a + k, b)) for k in (3, 4, 5, 6)), (np.maximum(b - 4, a), b)]
    out = np.empty((TABLES, len(starts)), np.int32)
    for k, (x, y) in enumerate(cuts):
        out[k] = ((rolling(x, y) + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
    return out


def line_heads(data: np.ndarray, starts: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which words begin a chain: the first of a line or of a text."""
    breaks = np.concatenate([[0], np.cumsum(data == 0x0A)])[starts] if len(starts) else np.zeros(0, np.int64)
    head = np.ones(len(starts), bool)
    head[1:] = (doc[1:] != doc[:-1]) | (breaks[1:] != breaks[:-1])
    return head


def forward_backward(score: np.ndarray, head: np.ndarray, moves: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of the toxic state for every word, and on demand the expected moves (2 x 2).

    score: log weight of the toxic state of each word; head: words that begin a chain; moves: log
    weights of moves from, to.
    """
    n = len(score)
    expected = np.zeros((2, 2))
    if not n:
        return np.zeros(0), expected
    count = -(-n // STRETCH)

    def dealt(values: np.ndarray, fill: float) -> np.ndarray:
        out = np.full(count * STRETCH, fill)
        out[:n] = values
        return np.ascontiguousarray(out.reshape(count, STRETCH).T)

    weight = dealt(np.exp(np.clip(score, -30, 30)), 1.0)
    first = dealt(head, 1.0) > 0  # the filling forgets as well
    moved = [np.where(first, 1.0, m) for m in np.exp(np.clip(moves, -20, 20)).ravel()]
    # Transfer products: weights of leaving a stretch clean or toxic, from a clean or toxic word before.
    oo, ot, to, tt = np.ones(count), np.zeros(count), np.zeros(count), np.ones(count)
    for k in range(STRETCH):
        a, b, c, d = (m[k] for m in moved)
        w = weight[k]
        oo, ot, to, tt = oo * a + ot * c, (oo * b + ot * d) * w, to * a + tt * c, (to * b + tt * d) * w
        norm = 1 / (oo + ot + to + tt)
        oo, ot, to, tt = oo * norm, ot * norm, to * norm, tt * norm
    entry, leave = np.empty(count), np.empty(count)
    products = list(zip(oo.tolist(), ot.tolist(), to.tolist(), tt.tolist(), strict=True))
    f = b = 0.5
    for k in range(count):
        entry[k] = f
        o1, t1, o2, t2 = products[k]
        x, y = (1 - f) * o1 + f * o2, (1 - f) * t1 + f * t2
        f = y / (x + y)
    for k in range(count - 1, -1, -1):
        leave[k] = b
        o1, t1, o2, t2 = products[k]
        x, y = o1 * (1 - b) + t1 * b, o2 * (1 - b) + t2 * b
        b = y / (x + y)
    forward = np.empty((STRETCH + 1, count))
    forward[0] = f = entry
    for k in range(STRETCH):
        a, b, c, d = (m[k] for m in moved)
        x, y = (1 - f) * a + f * c, ((1 - f) * b + f * d) * weight[k]
        forward[k + 1] = f = y / (x + y)
    marginal = np.empty((STRETCH, count))
    back = leave  # the toxic share of the backward weights
    for k in range(STRETCH - 1, -1, -1):
        f, w = forward[k + 1], weight[k]
        a, b, c, d = (m[k] for m in moved)
        y = f * back
        marginal[k] = y / (y + (1 - f) * (1 - back))
        if pairs:
            g = forward[k]
            x = np.stack([(1 - g) * a * (1 - back), (1 - g) * b * w * back, g * c * (1 - back), g * d * w * back])
            expected += ((x / x.sum(0)) * ~first[k]).sum(1).reshape(2, 2)
        x, y = a * (1 - back) + b * w * back, c * (1 - back) + d * w * back
        back = y / (x + y)
    return marginal.T.ravel()[:n], expected


class Field:
    """The fitted field and the logistic curve from marginals to a document's score."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray, curve: np.ndarray):
        self.weights, self.moves, self.curve = weights, moves, curve

    def emission(self, hashed: np.ndarray) -> np.ndarray:
        score = np.full(hashed.shape[1], self.weights[0, -1], np.float64)
        for k in range(TABLES):
            score += self.weights[k][hashed[k] >> (31 - BITS)]
        return score

    def document(self, marginal: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """Per text: 1, the logit of the largest marginal, the log of the expected toxic words."""
        top, total = np.full(len(firsts) - 1, 1e-6), np.zeros(len(firsts) - 1)
        full = np.flatnonzero(firsts[1:] > firsts[:-1])
        if len(full):
            top[full] = np.clip(np.maximum.reduceat(marginal, firsts[full]), 1e-6, 1 - 1e-6)
            total[full] = np.add.reduceat(np.where(marginal > 0.1, marginal, 0), firsts[full])
        return np.stack([np.ones(len(top)), np.log(top / (1 - top)) / 5, np.log1p(total)])

    def score(self, marginal: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.curve @ self.document(marginal, firsts), -40, 40)))


def _seeds(hashed: np.ndarray, doc: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Which words to label as toxic.

    A feature needs so many toxic documents that chance would not give as many among all features
    (clean ones hold none of it, or nearly), and at least ``SEED_COVER`` of the toxic ones, so
    that words shared by a few copies of one text do not count.
    """
    out = np.zeros(hashed.shape[1], bool)
    share = np.clip(toxic.mean(), 0.01, 0.9)
    for k in range(TABLES - 1):
        if k == 1:  # three letters say too little
            continue
        seen = np.unique((doc.astype(np.int64) << 31) | hashed[k])
        known, at = np.unique(seen & ((1 << 31) - 1), return_inverse=True)
        bad, every = np.bincount(at, toxic[seen >> 31]), np.bincount(at)
        least = max(SEED_DOCUMENTS, np.log(0.5 / max(len(known), 1)) / np.log(share), SEED_COVER * toxic.sum())
        out |= np.isin(hashed[k], known[(bad >= least) & (bad >= SEED_SHARE * every)])
    return out & toxic[doc]


def _words(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """Features and text of each word, and whether it begins a line, piece by piece; and the count
    of texts before the piece."""
    before = 0
    for part in pieces(iter([pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], ["text"])])):
        data, offsets = raw(part.column(0))
        data = LOWER[data]
        starts, ends, firsts = spans(data, offsets, WORD)
        doc = owners(firsts)
        yield features(data, starts, ends), (doc + before).astype(np.int32), line_heads(data, starts, doc), before
        before += len(offsets) - 1


def distinct(texts: list[str], words: int = 5, mins: int = 3) -> list[int]:
    """The texts that share none of ``mins`` least hashes of word shingles with an earlier one:
    near copies would make words of one text look common."""
    seen: list[set[int]] = [set() for _ in range(mins)]
    out = []
    for k, text in enumerate(texts):
        data, offsets = raw(pa.array([text], pa.large_string()))
        data = LOWER[data]
        starts, ends, _ = spans(data, offsets, WORD)
        hashes = Rolling(data)(starts, ends)
        grams = chained(hashes, min(words, max(len(hashes), 1)))
        least = [int(mixed(grams + np.uint64(m)).min()) if len(grams) else 0 for m in range(mins)]
        if not any(x in s for x, s in zip(least, seen, strict=True)):
            out.append(k)
        for x, s in zip(least, seen, strict=True):
            s.add(x)
    return out


def fit(texts: list[str], toxic: np.ndarray, epochs: int = EPOCHS) -> Field:
    """The field from labelled texts (a bounded sample)."""
    kept = distinct(texts)
    texts, toxic = [texts[k] for k in kept], toxic[kept]
    parts = list(zip(*_words(texts), strict=True))
    hashed = np.concatenate(parts[0], axis=1)
    doc, head = (np.concatenate(p) for p in parts[1:3])
    del parts
    label = _seeds(hashed, doc, toxic)
    field = Field(np.zeros((TABLES, BUCKETS + 1), np.float32), np.zeros((2, 2)), CURVE.copy())
    field.weights[0, -1] = -4.0
    # Lines without a toxic word are many and alike: one in PLAIN is fitted on, weighted up.
    line = np.cumsum(head, dtype=np.int32) - 1
    has = np.zeros(int(head.sum()), bool)
    has[line[label]] = True
    words = np.flatnonzero((has | (np.random.default_rng(0).random(len(has)) < 1 / PLAIN))[line])
    importance = np.where(has, 1.0, float(PLAIN))[line[words]]
    begins, truth = head[words], label[words]
    near = hashed[:, words]
    buckets = near >> (31 - BITS)
    del hashed, doc, line
    moved = np.zeros((2, 2))
    inner = np.flatnonzero(~begins)
    np.add.at(moved, (truth[inner - 1].astype(int), truth[inner].astype(int)), 1)
    squares, move_squares, bias_square = np.zeros((TABLES, BUCKETS), np.float32), np.zeros((2, 2)), 0.0
    for _ in range(epochs):
        p, expected = forward_backward(field.emission(near), begins, field.moves, pairs=True)
        slope = (p - truth) * importance
        for k in range(TABLES):
            g = np.bincount(buckets[k], slope, BUCKETS) + DECAY * field.weights[k, :-1]
            squares[k] += g * g
            field.weights[k, :-1] -= RATE * g / np.sqrt(squares[k] + 1e-8)
        g = slope.sum()
        bias_square += g * g
        field.weights[0, -1] -= RATE * g / np.sqrt(bias_square + 1e-8)
        g = (expected - moved) / max(len(words), 1) * 100
        move_squares += g * g
        field.moves -= 0.1 * g / np.sqrt(move_squares + 1e-8)
    x = []
    for hashed, doc, head, before in _words(texts):
        x.append((forward_backward(field.emission(hashed), head, field.moves)[0], doc - before, before))
    edges = [t for _, _, t in x][1:] + [len(texts)]
    x = np.concatenate([field.document(p, np.searchsorted(doc, np.arange(n - t + 1))) for (p, doc, t), n in zip(x, edges, strict=True)], axis=1)
    curve = CURVE.copy()
    for _ in range(50):  # Newton steps for the logistic curve, lightly held to its start
        q = 1 / (1 + np.exp(-np.clip(curve @ x, -30, 30)))
        step = np.linalg.solve((x * (q * (1 - q))) @ x.T + 0.5 * np.eye(3), x @ (q - toxic) + 0.5 * (curve - CURVE))
        curve = curve - np.clip(step, -1, 1)
    field.curve = curve
    return field


def sample(docs: DataFrame, labels: DataFrame, learn: Column, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> DataFrame:
    """(doc_id, toxic, text): up to ``rows`` toxic documents and CLEAN times as many clean ones with
    at most ``chars`` characters, chosen by hash of the id; only ids where ``learn`` holds.

    Null ids, labels and texts are left out.  An id that several documents have counts once, with
    the least of their texts; an id with both labels counts for both.  So reruns agree.
    """
    known = labels.where(learn & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).select("doc_id", (F.col("toxic") == 1).alias("toxic")).join(docs.select("doc_id"), "doc_id", "left_semi")
    # At most (1 + CLEAN) * rows ids, so broadcasting them is safe.
    known = known.distinct()  # an id may be listed twice, even with both labels
    picked = [known.where(F.col("toxic") == flag).orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(rows * (1 if flag else CLEAN)) for flag in (True, False)]
    found = docs.select("doc_id", "text").where(F.length("text") <= chars).join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id")
    return found.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))  # of one id, one text


def train(docs: DataFrame, labels: DataFrame, learn: Column, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> Field:
    """A field fitted on ``sample``.  Without both classes it scores everything near 0."""
    got = sorted(((r["doc_id"], r["text"], r["toxic"]) for r in sample(docs, labels, learn, rows, chars).collect()), key=lambda r: (r[0], r[2]))
    toxic = np.array([r[2] for r in got], bool)
    if not toxic.any() or toxic.all():
        return Field(np.zeros((TABLES, BUCKETS + 1), np.float32), np.zeros((2, 2)), np.array([-10.0, 0.0, 0.0]))
    return fit([r[1] for r in got], toxic)


def score(docs: DataFrame, field: Field, carry: tuple[str, ...] = ("doc_id",), text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The carried columns, ``score`` (0 to 1), ``predicted`` (1 from ``threshold`` on) and
    ``spans``, the offending places (start, end in code points, mean marginal).

    Null texts are empty, and empty texts get the score of a text without toxic words.  Every row
    is scored by its own text, so repeated rows and ids get one row each; an empty table gives none.
    A long text or line is scored whole.  Columns of ``docs`` with the names of results give way.
    One pass, no shuffle; the broadcast field has a fixed size.
    """
    carry = tuple(c for c in carry if c not in ("score", "predicted", "spans"))
    shared = docs.sparkSession.sparkContext.broadcast(field)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for part in pieces(batches, text):
            data, offsets = raw(part.column(part.schema.get_field_index(text)))
            data = LOWER[data]
            starts, ends, firsts = spans(data, offsets, WORD)
            doc = owners(firsts)
            p, _ = forward_backward(field.emission(features(data, starts, ends)), line_heads(data, starts, doc), field.moves)
            found: list[list[dict]] = [[] for _ in range(len(offsets) - 1)]
            hot = np.flatnonzero(p >= 0.5)
            if len(hot):
                leads = np.concatenate([[0], np.cumsum(LEAD[data])])
                cut = np.flatnonzero((np.diff(hot) > 1) | (np.diff(doc[hot]) > 0)) + 1
                for run in np.split(hot, cut):
                    k = int(doc[run[0]])
                    base = leads[offsets[k]]
                    found[k].append({"start": int(leads[starts[run[0]]] - base), "end": int(leads[ends[run[-1]]] - base), "p": float(p[run].mean())})
            value = field.score(p, firsts)
            columns = {c: part.column(part.schema.get_field_index(c)) for c in carry}
            columns |= {"score": pa.array(value), "predicted": pa.array((value >= threshold).astype(np.int32)), "spans": pa.array(found, kind)}
            yield pa.RecordBatch.from_pydict(columns)

    schema = ", ".join(f"`{c}` {dict(docs.dtypes)[c]}" for c in carry) + ", score double, predicted int, spans array<struct<start:int,end:int,p:double>>"
    return docs.select(*(f"`{c}`" for c in dict.fromkeys([*carry, text]))).mapInArrow(of, schema)


def clean(docs: DataFrame, field: Field, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are not predicted as toxic, with their own columns, whatever their names."""
    bare = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))
    found = score(bare, field, tuple(bare.columns), f"c{docs.columns.index(text)}", threshold)
    return found.where("predicted = 0").select(*bare.columns).toDF(*docs.columns)
