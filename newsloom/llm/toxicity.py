"""Op 8. Toxicity by compression distance to dictionaries of toxic and of ordinary text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.llm.common import chunks, folded_words, give_back, mix

GRAM = 6              # bytes; a shorter run of bytes is not told apart
COMMON_SHARE = 0.01   # words in more of the ordinary sample are left out of windows
TOXIC_SHARE = 0.01    # of the toxic sample must have a run of bytes,
TOXIC_RATIO = 4       # this many times the share of the ordinary sample
LEAST_GAIN = 20       # log-likelihood ratio of that difference
# Words in a window, bytes of the dictionaries' common part and of their own parts: tried in turn.
SETTINGS = ((6, 4096, 512), (9, 4096, 512), (6, 4096, 1024), (9, 4096, 1024),
            (12, 16_384, 1024), (12, 16_384, 2048))
LEVEL = 9
OWN_BYTES = 2048
CUT = 0.7             # the score that the calibrated threshold gets


def _spaced(words) -> bytes:
    return b" " + b" ".join(words) + b" "


def _trained(samples: list[bytes], size: int, segment: int) -> bytes:
    """The content of a dictionary trained on samples; of too few samples, the samples."""
    samples = [s for s in samples if len(s) >= 8]
    try:
        raw = zstandard.train_dictionary(size + 1024, samples, k=segment, d=GRAM, f=20, accel=1,
                                         steps=1, level=3).as_bytes()
    except zstandard.ZstdError:
        raw = b"".join(samples)
    return raw[-size:].rjust(size, b" ")


def _grams(text: bytes) -> np.ndarray:
    b = np.frombuffer(text, np.uint8).astype(np.uint64)
    n = max(0, len(b) - GRAM + 1)
    out = np.zeros(n, np.uint64)
    for k in range(GRAM):
        out = out << np.uint64(8) | b[k:k + n]
    return out


def _inner(text: bytes) -> np.ndarray:
    """Which grams lie in one word and the spaces around it."""
    space = np.concatenate(([0], np.cumsum(np.frombuffer(text, np.uint8) == 32)))
    n = max(0, len(text) - GRAM + 1)
    return space[GRAM - 1:GRAM - 1 + n] == space[1:1 + n]


def _document_counts(grams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    each = [np.unique(g) for g in grams]
    return np.unique(np.concatenate(each or [np.empty(0, np.uint64)]), return_counts=True)


def _telling(toxic: np.ndarray, ordinary: np.ndarray, n_toxic: int, n_ordinary: int) -> np.ndarray:
    """Which document counts are far higher among the toxic texts, and not by chance."""
    both = (toxic + ordinary) / (n_toxic + n_ordinary)
    gain = 2 * (toxic * np.log(toxic / (both * n_toxic))
                + ordinary * np.log(np.maximum(ordinary, 1) / (both * n_ordinary)))
    ratio = toxic * n_ordinary / ((ordinary + 0.5) * n_toxic)
    return (gain >= LEAST_GAIN) & (ratio >= TOXIC_RATIO)


def _area(labels: np.ndarray, values: np.ndarray) -> float:
    """Area under the ROC curve; equal values count half."""
    order = np.sort(values[labels == 0])
    mine = values[labels == 1]
    return float((np.searchsorted(order, mine, "left") + np.searchsorted(order, mine, "right")).mean()
                 / (2 * len(order)))


def _runs_of(text: bytes, marked: np.ndarray) -> bytes:
    """The parts of a text whose grams are marked."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], marked, [False])).astype(np.int8)))
    return b" ".join(text[a:b + GRAM - 1] for a, b in zip(edges[::2], edges[1::2]))


def _coder(content: bytes) -> zstandard.ZstdCompressor:
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=False)


@dataclass
class ToxicityModel:
    """Two dictionaries, the words that windows leave out, and the calibrated line of a score."""

    ordinary: bytes = b""
    toxic: bytes = b""
    common: frozenset = frozenset()
    window_words: int = 12
    weights: list[float] = field(default_factory=list)
    bias: float = 0.0
    constant: float | None = None  # without labels of both kinds

    def distances(self, texts: list[str | None]) -> np.ndarray:
        """A row for each text: mean, largest, mean of the three largest and damped sum of its
        windows' bytes saved by the toxic dictionary; zeros for a text without rare words."""
        ordinary, toxic = _coder(self.ordinary).compress, _coder(self.toxic).compress
        common, size, out = self.common, self.window_words, np.zeros((len(texts), 4))
        for row, text in zip(out, texts):
            words = [w for w in folded_words(text) if w not in common]
            if not words:
                continue
            saved = np.empty(-(-len(words) // size))
            for k in range(len(saved)):
                window = _spaced(words[k * size:(k + 1) * size])
                saved[k] = len(ordinary(window)) - len(toxic(window))
            top = np.sort(saved)[::-1][:3]
            row[:] = (saved.mean(), top[0], top.mean(),
                      np.maximum(saved - 1, 0).sum() / len(saved) ** 0.5)
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.distances(texts) @ self.weights + self.bias, -30, 30)))


def _without_near_copies(texts: list[bytes], least: int = 16) -> list[bytes]:
    """Texts that share fewer than half of their ``least`` smallest gram hashes with one before."""
    owners: dict[int, list[int]] = {}
    out = []
    for text in texts:
        marks = np.unique(mix(_grams(text)))[:least].tolist()
        shared: dict[int, int] = {}
        for m in marks:
            for o in owners.get(m, ()):
                shared[o] = shared.get(o, 0) + 1
        if max(shared.values(), default=0) * 2 < max(1, len(marks)):
            for m in marks:
                owners.setdefault(m, []).append(len(out))
            out.append(text)
    return out


def _rising(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights none of which is negative: a feature that would get one is left out."""
    used = list(range(x.shape[1]))
    while used:
        w = _logistic(x[:, used], y)[:-1]
        if w.min() >= 0:
            break
        used.pop(int(w.argmin()))
    out = np.zeros(x.shape[1])
    out[used] = w if used else 0
    return out


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights (the last one the bias) of a logistic regression, by Newton steps."""
    x = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(x.shape[1])
    keep = np.append(np.full(x.shape[1] - 1, ridge), 1e-6)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep),
                               x.T @ (y - p) - keep * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(toxic: list[str], ordinary: list[str], weight: float = 1.0) -> ToxicityModel:
    """Two thirds of the texts train the dictionaries, the rest the score.

    Windows are of rare words: those in at most 1 % of the ordinary texts. Both dictionaries end
    with the same ordinary text. The toxic one begins with a dictionary trained on those parts of
    words (by runs of six bytes) that the toxic texts have far more often than the ordinary ones,
    the ordinary one with as much ordinary text. What a window saves is what those differ in. Of
    the ``SETTINGS`` the one with the largest area under the second part's ROC curve is taken.

    The score is a logistic regression on the windows' savings that never falls as they rise. Its bias is moved so that the
    threshold of the best F1 on the second part gets the score 0.7; there, an ordinary text counts
    ``weight`` times (more than once if the sample has fewer of them than the labels).
    """
    toxic, ordinary = list(dict.fromkeys(toxic)), list(dict.fromkeys(ordinary))
    if len(toxic) < 3 or len(ordinary) < 3:
        total = len(toxic) + len(ordinary)
        return ToxicityModel(constant=len(toxic) / total * CUT if total else 0.0)
    fit = [[folded_words(t) for k, t in enumerate(texts) if k % 3] for texts in (toxic, ordinary)]
    seen: dict[bytes, int] = {}
    for words in fit[1]:
        for w in set(words):
            seen[w] = seen.get(w, 0) + 1
    limit = max(1, COMMON_SHARE * len(fit[1]))
    common = frozenset(w for w, c in seen.items() if c > limit)
    toxic_texts, ordinary_texts = [[_spaced(words) for words in part] for part in fit]
    toxic_texts = _without_near_copies(toxic_texts)
    grams = [_grams(t) for t in toxic_texts]
    inner = [_inner(t) for t in toxic_texts]
    names, counts = _document_counts([g[i] for g, i in zip(grams, inner)])
    frequent = counts >= max(3, TOXIC_SHARE * len(toxic_texts))
    names, counts = names[frequent], counts[frequent]
    others, other_counts = _document_counts([_grams(t) for t in ordinary_texts])
    place = np.minimum(np.searchsorted(others, names), len(others) - 1)
    usual = np.where(others[place] == names, other_counts[place], 0)
    telling = names[_telling(counts, usual, len(toxic_texts), len(ordinary_texts))]
    own = [_runs_of(t, i & np.isin(g, telling)) for t, g, i in zip(toxic_texts, grams, inner)]
    rare = [_spaced(w for w in words if w not in common) for words in fit[1]]
    held = toxic[::3] + ordinary[::3]
    labels = np.array([1.0] * len(toxic[::3]) + [0.0] * len(ordinary[::3]))
    best, model, raw = -1.0, None, None
    for words, shared_size, own_size in SETTINGS:
        shared, plain = _trained(rare, shared_size, 12), _trained(rare[::2], OWN_BYTES, 12)
        tried = ToxicityModel(plain + shared, _trained(own, own_size, 12) + plain[own_size:] + shared,
                              common, words)
        x = tried.distances(held)
        mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
        weights = _rising((x - mean) / spread, labels) / spread
        area = _area(labels, x @ weights)
        if area > best:
            tried.weights = weights.tolist()
            best, model, raw = area, tried, x @ weights
    order = np.argsort(-raw, kind="stable")
    hits = np.cumsum(labels[order])
    last = np.append(raw[order][1:] != raw[order][:-1], True)  # equal values are on one side
    wrong = weight * (np.arange(1, len(hits) + 1) - hits)
    f1 = np.where(last, 2 * hits / (hits + wrong + labels.sum()), 0)
    cut = int(np.argmax(f1))
    line = raw[order[cut]] if cut + 1 == len(order) else raw[order[cut:cut + 2]].mean()
    model.bias = float(np.log(CUT / (1 - CUT)) - line)
    return model


def held_out(doc_id: str) -> Column:
    """Rows whose labels are never learnt: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
        label: str = "toxic", toxic_rows: int = 1500, ordinary_rows: int = 3500,
        longest: int = 50_000) -> ToxicityModel:
    """A model from a bounded sample of the labelled rows that are not held out.

    At most about ``toxic_rows`` and ``ordinary_rows`` rows, chosen by a hash of the id, of texts
    of at most ``longest`` characters: that bounds what the driver gets.
    """
    usable = labels.filter(~held_out(doc_id) & F.col(label).isin(0, 1)).select(doc_id, label)
    counts = {int(r[0]): r[1] for r in usable.groupBy(label).count().collect()}
    wanted = {1: toxic_rows, 0: ordinary_rows}
    share = {k: min(1.0, n / max(1, counts.get(k, 0))) for k, n in wanted.items()}
    place = F.pmod(F.xxhash64(F.col(doc_id).cast("string")), F.lit(1_000_000))
    chosen = usable.filter(place < F.when(F.col(label) == 1, share[1]).otherwise(share[0]) * 1_000_000)
    chosen = chosen.select(F.col(doc_id).alias("__id"), F.col(label).cast("int").alias("__label"))
    rows = (docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text"))
            .filter(F.length("__text").between(1, longest))
            .join(F.broadcast(chosen.limit(2 * (toxic_rows + ordinary_rows))), "__id")
            .select("__label", "__text", "__id").collect())
    rows.sort(key=lambda r: (str(r[2]), r[1]))
    toxic, ordinary = ([r[1] for r in rows if r[0] == k] for k in (1, 0))
    weight = counts.get(0, 0) * len(toxic) / max(1, counts.get(1, 0) * len(ordinary))
    return train(toxic, ordinary, weight or 1.0)


def score(docs: DataFrame, model: ToxicityModel, doc_id: str = "doc_id",
          text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row, over its whole text.

    The model has a fixed size and is broadcast. A null or empty text, or one without rare words,
    gets the score of no savings. A null id counts as not held out. Repeated rows get one score
    each. Other columns are not read. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([
        T.StructField("doc_id", docs.schema[doc_id].dataType),
        T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()),
        T.StructField("predicted", T.IntegerType())])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None

        def typed():
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field("doc_id").type
                yield batch

        for keys, held, texts in chunks(typed(), ["doc_id", "held_out", "text"], "text"):
            values = shared.value.scores(texts)
            yield pa.RecordBatch.from_arrays([
                pa.array(keys, kind), pa.array(held, pa.bool_()), pa.array(values),
                pa.array((values >= CUT).astype(np.int32))], schema.fieldNames())

    return docs.select(F.col(doc_id).alias("doc_id"), held_out(doc_id).alias("held_out"),
                       F.col(text).alias("text")).mapInArrow(scored, schema)


def drop_toxic(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """The rows, all columns, whose text scores under 0.7; null and empty texts as in ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in batches:
            at = batch.schema.get_field_index(text)
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                yield part.filter(pa.array(shared.value.scores(part.column(at).to_pylist()) < CUT))

    return docs.mapInArrow(keep, docs.schema)
