"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts hashed n-grams (one to three characters) of a bounded, hash-chosen sample of
rows per language on the executors; the summed counts become one matrix of log probabilities,
languages by buckets, which is broadcast after a check of its size.  A batch of texts is scored
in numpy: every n-gram picks its bucket's column, and columns are summed per text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callboard.llm.arrays import LEAD, pieces, raw

BUCKETS = 1 << 16
#: Languages that a counting task holds before it tells what it has.
HELD = 64
ORDERS = 3
#: Rows per language, about, that the classifier is fitted on; they are chosen by hash.
SAMPLE_ROWS = 4000
SMOOTHING = 0.5
UNKNOWN = "und"
#: Bytes of the broadcast matrix.
MATRIX_BYTES = 256 << 20

_folded: list[np.ndarray] = []


def _fold() -> np.ndarray:
    """For each code point of the basic plane: the lower-case letter, or a blank."""
    if not _folded:
        table = np.full(1 << 16, 0x20, np.uint32)
        for i in range(1 << 16):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                table[i] = ord(low) if len(low) == 1 else i
        _folded.append(table)
    return _folded[0]


def ngrams(data: np.ndarray, offsets: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For each order, buckets of all n-grams in text order and the first one of each text; and
    whether a text has a letter.  Texts are read as letters and single blanks between them."""
    places = np.concatenate([[0], np.cumsum(LEAD[data])])[offsets]
    codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    letters = _fold()[np.minimum(codes, 0xFFFF)]
    for code in np.unique(codes[codes > 0xFFFF]):
        letters[codes == code] = code if chr(code).isalpha() else 0x20
    solid = letters != 0x20
    # A run of blanks counts once; each text begins with a blank of its own.
    keep = solid.copy()
    keep[1:] |= solid[:-1]
    heads = places[:-1][places[:-1] < places[1:]]
    keep[heads] = True
    kept = np.concatenate([[0], np.cumsum(keep)])
    firsts = kept[places]
    letters = letters[keep]
    has = np.concatenate([[0], np.cumsum(solid)])[places]
    out = []
    h = np.zeros(len(letters), np.uint32)
    for n in range(1, ORDERS + 1):
        m = max(len(letters) - n + 1, 0)
        h = (h[:m] * np.uint32(0x01000193)) ^ (letters[n - 1 : n - 1 + m] * np.uint32(0x9E3779B1))
        bucket = ((h ^ np.uint32(n * 0x3BD1E995)) * np.uint32(0x85EBCA6B)) >> np.uint32(16)
        owner_ok = np.ones(m, bool)
        for k in range(1, n):  # an n-gram may not run into the next text
            cut = firsts[1:-1] - k
            owner_ok[cut[(cut >= 0) & (cut < m)]] = False
        counted = np.concatenate([[0], np.cumsum(owner_ok)])
        out.append((bucket[owner_ok], counted[np.minimum(firsts, m)]))
    return out, has[1:] > has[:-1]


class Model:
    def __init__(self, languages: list[str], log_probability: np.ndarray, prior: np.ndarray):
        self.languages, self.log_probability, self.prior = languages, log_probability, prior

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log posteriors (texts by languages, not normalised), and whether a text has a letter."""
        grams, has = ngrams(data, offsets)
        out = np.tile(self.prior, (len(offsets) - 1, 1))
        for bucket, firsts in grams:
            full = np.flatnonzero(firsts[1:] > firsts[:-1])
            for k in range(len(self.languages)):
                if len(full):
                    out[full, k] += np.add.reduceat(self.log_probability[k][bucket], firsts[full], dtype=np.float64)
        return out, has


def held_out(folds: int, fold: int, key: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves ``fold``; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % folds == fold, F.lit(False))


def train(docs: DataFrame, learn: Column, rows: int = SAMPLE_ROWS, smoothing: float = SMOOTHING) -> Model:
    """Fits on rows where ``learn`` holds and lang and text are not null: about ``rows`` of each
    language, chosen by a hash of id, text and position, so that neither one id nor one repeated row is in or out
    as a whole.  Without such rows every text is ``und``.

    Of more languages than the matrix has room for, those with the most rows are learned, of equal ones the first by name.
    Texts of any length count whole, texts without a letter count for their language's share only; an empty table
    learns nothing.
    """
    usable = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    sizes = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    counted = {r["lang"]: r["n"] for r in sizes.orderBy(F.desc("n"), "lang").limit(MATRIX_BYTES // (4 * BUCKETS)).collect()}
    languages = sorted(counted)
    if not languages:
        return Model([], np.zeros((0, BUCKETS), np.float32), np.zeros(0))
    share = F.create_map(*(F.lit(x) for lang in languages for x in (lang, min(1.0, rows / counted[lang]))))
    chance = F.pmod(F.xxhash64("doc_id", "text", "row", F.lit("lang")), F.lit(1 << 30))
    sample = usable.withColumn("row", F.monotonically_increasing_id()).where(chance < share[F.col("lang")] * float(1 << 30))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for lang, total in totals.items():
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at])], ["lang", "bucket", "n"])
            totals.clear()

        for part in pieces(batches):
            if len(totals) > HELD:  # half a megabyte each
                yield from told()
            names = np.array(part.column(0).to_pylist(), object)
            for lang in set(names):
                data, offsets = raw(part.column(1).filter(pa.array(names == lang)))
                total = totals.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for bucket, _ in ngrams(data, offsets)[0]:
                    total += np.bincount(bucket, minlength=BUCKETS)
        yield from told()

    summed = sample.select("lang", "text").mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts = np.full((len(languages), BUCKETS), smoothing)
    place = F.create_map(*(F.lit(x) for k, lang in enumerate(languages) for x in (lang, k)))[F.col("lang")]
    at = summed.select(place.alias("place"), "bucket", "n").toArrow()
    counts[at.column(0).to_numpy(), at.column(1).to_numpy()] += at.column(2).to_numpy()
    log_probability = np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32)
    weights = np.array([counted[x] for x in languages], float)
    return Model(languages, log_probability, np.log(weights / weights.sum()))


def identify(docs: DataFrame, model: Model, carry: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The carried columns, ``lang_pred`` (``und`` for null and for texts without a letter) and
    ``score``, the posterior probability (0 for ``und``).  Columns of these names give way; other columns are
    ignored.

    Every row is judged by its own text, whole however long, so repeated rows and ids agree; of equally likely
    languages the first by name counts; an empty table gives no rows.
    """
    carry = tuple(c for c in carry if c not in ("lang_pred", "score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for part in pieces(batches, text):
            data, offsets = raw(part.column(part.schema.get_field_index(text)))
            n = len(offsets) - 1
            names, score = np.full(n, UNKNOWN, object), np.zeros(n)
            if model.languages:
                logs, has = model.scores(data, offsets)
                best = logs.argmax(1)
                top = 1 / np.exp(logs - logs.max(1, keepdims=True)).sum(1)
                names[has] = np.array(model.languages, object)[best[has]]
                score[has] = top[has]
            yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in carry), pa.array(names, pa.string()), pa.array(score)], [*carry, "lang_pred", "score"])

    schema = ", ".join(f"`{c}` {dict(docs.dtypes)[c]}" for c in carry) + ", lang_pred string, score double"
    return docs.select(*carry, text).mapInArrow(of, schema)
