"""Quality classifier by co-training over two views of a document.

View one is the text: shares of capitals, digits and signs, repetition, word length, and the presence of the
words that tell the classes apart best. View two is the page's metadata: source, language, size, lines and the length of
lines, also in steps, and size by whether there is one line only. Each view has a logistic regression. Over ROUNDS rounds
each predicts all unlabelled documents, in Spark's tasks, and hands its confident predictions to the other as
pseudo-labels. Confidence is measured for each class by itself: labelled documents are predicted by regressions that didn't
see them (FOLDS of them), a class's predictions are ranked, and its cut is the lowest score down to which RIGHT of them are
right, by the lower end of Wilson's interval, which few documents don't reach; a class that never gets there isn't handed
over. Finally a small regression on the calibration fold combines both views' log-odds into a
calibrated probability, which scores all documents. A document is good if its quality is 1 and it isn't toxic.

Views are described in tasks and written once; the driver gets descriptions, of bounded size, and never a text. The
regressions are fitted to bounded samples (documented parameters): about LABELLED labelled documents by a hash of
doc_id, and in each round about `pseudo` of each class of all confident predictions of a view (by default ten for each
feature of the larger view). That sample is of different descriptions, by their hash: equal ones are counted first, in
Spark, and weigh 1 + ln(count), so a text that stands a million times is one row of some weight. The hash has 63 bits,
so the sample has its size at any number of rows. `CoTrained.exchanged` tells how many predictions were confident and how
many were handed over. Scoring covers all rows and whole texts. Null texts count as empty, other nulls as values of their
own; labels with nulls are left out, of repeated labels the worst counts. With fewer than two classes in training every
document is kept with probability one. Repeated rows are scored each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, saved, slices

#: Labelled documents that training uses, about.
LABELLED = 6000
WORDS, ROUNDS = 300, 3
#: What must be right of a view's confident predictions of a class, and the folds in which that is measured.
RIGHT, FOLDS = 0.95, 5
SOURCES, LANGS = 32, 8
#: Steps of a logarithm of lengths, and their number.
STEP, STEPS = 0.4, 26
#: Columns of the metadata view.
SECOND = SOURCES + LANGS + 4 + 4 * STEPS
TOGETHER = bytes((c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32) for c in range(256))
CAPITALS = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))
SIGNS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
META = ("lang", "source", "n_chars")


def tokens(data: bytes) -> list[bytes]:
    return data.translate(TOGETHER).split()


NUMBERS = 14  # of a description: ten of the text view, four of the metadata view
DESCRIBED = "numbers array<double>, words array<short>, source short, lang short"


def described(data: bytes, lang: str | None, source: str | None, n_chars: int | None, vocabulary: dict[bytes, int]) -> tuple:
    """Both views of a document in a few hundred bytes: numbers, the vocabulary's words in it, source and language."""
    import zlib

    words = tokens(data)
    known, n, w, lines = set(words), max(len(data), 1), max(len(words), 1), data.split(b"\n")
    less = lambda drop: (len(data) - len(data.translate(None, drop))) / n
    distinct, said = len(known) / w, np.log1p(max(n_chars or 0, 0))
    numbers = [
        less(CAPITALS), less(DIGITS), less(SIGNS), distinct, distinct * np.log1p(w), len(known) / w**0.7,
        np.log1p(w), sum(map(len, words)) / w / 10, len(set(lines)) / len(lines), less(b".") * 10,
        said, np.log1p(len(data)) - said, np.log1p(len(lines)), np.log1p(len(data) / len(lines)),
    ]
    return numbers, sorted(vocabulary[x] for x in known & vocabulary.keys()), zlib.crc32(str(source).encode()) % SOURCES, zlib.crc32(str(lang).encode()) % LANGS


def views(rows: list[tuple], words: int) -> tuple[np.ndarray, np.ndarray]:
    """The matrices of both views of descriptions."""
    one, two = np.zeros((len(rows), 10 + words)), np.zeros((len(rows), SECOND))
    for i, (numbers, known, source, lang) in enumerate(rows):
        one[i, :10], two[i, SOURCES + LANGS : SOURCES + LANGS + 4] = numbers[:10], numbers[10:]
        one[i, [10 + k for k in known]] = 1
        two[i, source] = two[i, SOURCES + lang] = 1
        said, _, lines, line = (min(STEPS - 1, max(0, int(x / STEP))) for x in numbers[10:])
        # lengths in steps: of the text, of its lines, of lines on average, and of a text that is one line
        for k, step in enumerate((said, lines, line, said if numbers[12] < 0.7 else None)):
            if step is not None:
                two[i, SOURCES + LANGS + 4 + k * STEPS + step] = 1
    return one, two


class Logistic:
    """Ridge logistic regression by Newton steps, on standardised columns."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0):
        weight = np.ones(len(y)) if weight is None else weight
        self.mean, self.spread = x.mean(0), np.maximum(x.std(0), 0.02)
        z = self._ready(x)
        self.beta = np.zeros(z.shape[1])
        penalty = np.full(z.shape[1], ridge)
        penalty[-1] = 1e-6
        for _ in range(12):
            p = 1 / (1 + np.exp(-np.clip(z @ self.beta, -30, 30)))
            v = weight * np.maximum(p * (1 - p), 1e-5)
            step = np.linalg.solve((z * v[:, None]).T @ z + np.diag(penalty), z.T @ (weight * (y - p)) - penalty * self.beta)
            self.beta += np.clip(step, -3, 3)
            if np.abs(step).max() < 1e-4:
                break

    def _ready(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([(x - self.mean) / self.spread, np.ones((len(x), 1))])

    def odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self._ready(x) @ self.beta, -30, 30)


def share(p: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-p))


def confident(odds: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """The cuts (bad up to, good from) down to which RIGHT of a class's ranked predictions are right; infinite for a class that never gets so far."""
    cuts = []
    for sign, y in ((-1, ~good.astype(bool)), (1, good.astype(bool))):
        order = np.argsort(-sign * odds, kind="stable")
        n, ranked = np.arange(1, len(order) + 1), odds[order]
        p = np.cumsum(y[order]) / n
        surely = (p + 1 / (2 * n) - np.sqrt(p * (1 - p) / n + 1 / (4 * n * n))) / (1 + 1 / n)  # one standard deviation below
        # equal scores stand or fall together
        ends = np.append(ranked[1:] != ranked[:-1], True)
        far = np.flatnonzero((surely >= RIGHT) & ends & (sign * ranked > 0))
        cuts.append(float(ranked[far[-1]]) if len(far) else sign * np.inf)
    return cuts[0], cuts[1]


class CoTrained:
    """Both views' regressions and their combination."""

    def __init__(self, vocabulary: list[bytes]):
        self.vocabulary = {w: i for i, w in enumerate(vocabulary)}
        self.ready = False
        #: of each round and view: confident predictions in all, and pseudo-labels handed to the other view
        self.exchanged: list[tuple[int, int, int, int]] = []

    def fit(self, labelled: list[tuple], held: np.ndarray, good: np.ndarray, ask: Callable[[CoTrained, int], tuple[int, list[tuple]]]) -> CoTrained:
        """labelled: descriptions; held: those of the calibration fold; ask(model, view): how many unlabelled
        documents a view is sure of, and a sample of their descriptions, each with how often it stands."""
        y = good.astype(float)
        if any(len(set(y[f])) < 2 for f in (held, ~held)):
            return self
        told = views(labelled, len(self.vocabulary))
        pseudo: list[tuple | None] = [None, None]
        for turn in range(ROUNDS):
            self.models = [self._fit(told[v][~held], y[~held], pseudo[v]) for v in (0, 1)]
            self.cuts = [confident(self._unseen(told[v], y, held, pseudo[v]), good) for v in (0, 1)] if turn < ROUNDS - 1 else []
            for v in (0, 1):
                if self.cuts and any(np.isfinite(self.cuts[v])):
                    n, found = ask(self, v)
                    if found:
                        more = views([r[:4] for r in found], len(self.vocabulary))
                        weight = 0.5 * (1 + np.log([r[4] for r in found]))
                        pseudo[1 - v] = more[1 - v], (self.models[v].odds(more[v]) >= self.cuts[v][1]).astype(float), weight
                    self.exchanged.append((turn, v, n, len(found)))
        both = np.stack([m.odds(told[v][held]) for v, m in enumerate(self.models)], 1)
        self.final = Logistic(both, y[held], ridge=0.1)
        self.ready = True
        return self

    @staticmethod
    def _fit(x: np.ndarray, y: np.ndarray, pseudo: tuple | None) -> Logistic:
        if pseudo is None:
            return Logistic(x, y)
        weight = np.concatenate([np.ones(len(y)), pseudo[2]])
        return Logistic(np.concatenate([x, pseudo[0]]), np.concatenate([y, pseudo[1]]), weight)

    def _unseen(self, x: np.ndarray, y: np.ndarray, held: np.ndarray, pseudo: tuple | None) -> np.ndarray:
        """Log-odds of the labelled documents by regressions that didn't see them; the calibration fold is one more fold."""
        out = np.empty(len(y))
        out[held] = self._fit(x[~held], y[~held], pseudo).odds(x[held])
        own = np.flatnonzero(~held)
        for f in range(FOLDS):
            part, rest = own[f::FOLDS], np.delete(own, np.s_[f::FOLDS])
            if len(set(y[rest])) < 2:
                rest = own
            out[part] = self._fit(x[rest], y[rest], pseudo).odds(x[part])
        return out

    def sure(self, rows: list[tuple], v: int) -> np.ndarray:
        """1 and 0 for descriptions that a view is sure to be good or bad, -1 for others."""
        odds = self.models[v].odds(views(rows, len(self.vocabulary))[v])
        low, high = self.cuts[v]
        return np.where(odds >= high, 1, np.where(odds <= low, 0, -1))

    def judged(self, rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities that documents are good, from their descriptions: by text, by metadata, and combined."""
        if not self.ready or not rows:
            return (np.ones(len(rows)),) * 3
        odds = [m.odds(x) for m, x in zip(self.models, views(rows, len(self.vocabulary)))]
        return share(odds[0]), share(odds[1]), share(self.final.odds(np.stack(odds, 1)))

    def predict(self, rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same from (doc_id, text, lang, source, n_chars)."""
        return self.judged([described((r[1] or "").encode("utf-8", "surrogatepass"), *r[2:5], self.vocabulary) for r in rows])


def needed(docs: DataFrame) -> DataFrame:
    have = set(docs.columns)
    typed = {"lang": "string", "source": "string", "n_chars": "long"}
    cols = [(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in typed.items()]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *cols)


def telling_words(texts: DataFrame, most: int) -> list[bytes]:
    """The words whose presence depends most on the class, by the likelihood-ratio statistic; texts: text, good."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for text, good in zip(batch.column(0), batch.column(1).to_pylist()):
                known = list(set(tokens(text.as_py().encode("utf-8", "surrogatepass"))))
                yield pa.RecordBatch.from_arrays([pa.array(known, pa.binary()), pa.array([good] * len(known), pa.int32())], names=["word", "good"])

    n1, n = texts.agg(F.coalesce(F.sum("good"), F.lit(0)), F.count("*")).first()
    found = texts.select("text", "good").mapInArrow(run, "word binary, good int").groupBy("word").agg(F.sum("good").alias("a1"), F.count("*").alias("a")).filter("a >= 5")
    part = lambda x, row, col: F.when(x > 0, x * F.log(x * float(max(n, 1)) / (row * float(max(col, 1))))).otherwise(0.0)
    a, a1 = F.col("a").cast("double"), F.col("a1").cast("double")
    g = 2 * (part(a1, a, n1) + part(a - a1, a, n - n1) + part(n1 - a1, n - a, n1) + part(n - n1 - a + a1, n - a, n - n1))
    best = found.select("word", g.alias("g")).filter("g > 10").orderBy(F.col("g").desc(), "word").limit(most)  # the vocabulary's size
    return [bytes(r[0]) for r in best.select("word").collect()]


def descriptions(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """doc_id and the description of each row."""
    at = {w: i for i, w in enumerate(vocabulary)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [described(t.encode("utf-8", "surrogatepass"), *r, at) for t, *r in zip(*(batch.column(i).to_pylist() for i in range(1, 5)))]
            kinds = (pa.list_(pa.float64()), pa.list_(pa.int16()), pa.int16(), pa.int16())
            cols = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["doc_id", "numbers", "words", "source", "lang"])

    return needed(docs).mapInArrow(run, f"doc_id long, {DESCRIBED}")


def sampled(most: int, of: int, seed: int, *cols) -> Column:
    """Whether a row is in a sample of about `most` of `of` rows, by a hash of 63 bits."""
    return F.shiftrightunsigned(F.xxhash64(*cols, F.lit(seed)), 1) <= min((1 << 63) - 1, (most << 63) // max(of, 1))


def handed(told: DataFrame, pseudo: int, seed: int) -> tuple[int, list[tuple]]:
    """How many rows are confident, and about `pseudo` different descriptions of each label with how often each stands.

    told: numbers, words, source, lang, label.
    """
    kinds = ["numbers", "words", "source", "lang"]
    distinct = saved(told.groupBy("label", *kinds).agg(F.count(F.lit(1)).alias("n")), "sure")
    count = {r.label: r for r in distinct.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("all")).collect()}  # two rows
    picked = [distinct.filter((F.col("label") == y) & sampled(pseudo, r.n, seed, *kinds)).drop("label") for y, r in sorted(count.items())]
    rows = [tuple(r) for p in picked for r in p.collect()]  # about `pseudo` of each label
    discard(distinct)
    return sum(r["all"] for r in count.values()), sorted(rows)


def trained(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, pseudo: int | None = None) -> CoTrained:
    known = labels.filter("doc_id is not null and quality is not null and toxic is not null")
    known = known.filter(sampled(labelled, known.count(), 1, F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = saved(known.agg(F.min((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int").alias("good")), "labelled")
    held = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(10)) >= 8
    few = F.broadcast(known)  # about `labelled` rows, by construction
    vocabulary = telling_words(needed(docs).join(few.filter(~held), "doc_id").select("text", "good"), WORDS)
    each = saved(descriptions(docs, vocabulary), "descriptions")
    some = each.join(few, "doc_id").groupBy("doc_id").agg(F.min(F.struct("numbers", "words", "source", "lang", "good")).alias("x"))
    found = sorted((tuple(r) for r in some.select("doc_id", held.alias("held"), "x.*").collect()), key=lambda r: r[0])
    open_ = each.join(few, "doc_id", "left_anti")
    most = pseudo or 10 * max(10 + len(vocabulary), SECOND)

    def ask(model: CoTrained, v: int) -> tuple[int, list[tuple]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                rows = list(zip(*(batch.column(i).to_pylist() for i in range(4))))
                yield batch.append_column("label", pa.array(model.sure(rows, v), pa.int32()))

        told = open_.select("numbers", "words", "source", "lang").mapInArrow(run, f"{DESCRIBED}, label int").filter("label >= 0")
        return handed(told, most, turn_seed(model, v))

    model = CoTrained(vocabulary)
    return model.fit([r[2:6] for r in found], np.array([r[1] for r in found], bool), np.array([r[6] for r in found]), ask)


def turn_seed(model: CoTrained, v: int) -> int:
    """Another sample in each round and of each view."""
    return 10 + len(model.exchanged) * 2 + v


def scored(docs: DataFrame, model: CoTrained) -> DataFrame:
    """doc_id, text_score, meta_score, score and keep (score at least one half) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            a, b, c = model.predict(list(zip(*(batch.column(i).to_pylist() for i in range(5)))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(a), pa.array(b), pa.array(c), pa.array(c >= 0.5)],
                names=["doc_id", "text_score", "meta_score", "score", "keep"],
            )

    return needed(docs).mapInArrow(run, "doc_id long, text_score double, meta_score double, score double, keep boolean")


def kept(docs: DataFrame, model: CoTrained) -> DataFrame:
    """The rows of docs that the model keeps, unchanged."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            col = {c: batch.column(names.index(c)).to_pylist() if c in names else [None] * batch.num_rows for c in ("doc_id", "text", *META)}
            yield batch.filter(pa.array(model.predict(list(zip(*col.values())))[2] >= 0.5))

    return docs.mapInArrow(run, docs.schema)
