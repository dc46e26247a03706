"""Subject areas of each document (problem 9): subject-specific interpolated n-gram language models.

Every subject has an interpolated bigram model over words (Chinese: characters), trained on labelled documents and
smoothed towards a background model that is counted over all documents. A sentence belongs to the subject whose
cross-entropy lies furthest below the background's, if it does so by ``MARGIN`` nats at least; what is said under any
subject costs all models the same and belongs to none. Hard expectation maximisation on the sentences of the labelled
documents keeps such sentences, and those of a document's other subject, out of a subject's model. A subject's share is
its part of the document's words; which shares are accepted is calibrated on the labelled documents.

Training takes at most ``max_labelled`` labelled documents (by a hash of their id), with every word and bigram they hold;
the driver sees counts, never texts. One in ``FOLDS`` of them is held out: models of the others give its shares, on
which acceptance is calibrated, and the models that classify are then trained on all. Background and classification
cover all documents, whole texts.

Defined results: null, empty and wordless texts are about nothing; labels of unknown subjects or documents are unused;
repeated labels count once; a document gets at most two subjects, of equal shares the first by name; without labels no
document gets any.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.session import materialise, ship

TOKEN = re.compile("[a-z]+|0|[\\u3400-\\u9FFF]|\\n")
NUMBER = re.compile("[0-9]+")
SENTENCE = re.compile("(?<=[.!?;])\\s+|[\\n\\u3002\\uFF01\\uFF1F\\uFF1B]+")
#: Weights of bigram, word and uniform estimates in the background model.
WEIGHTS = (0.6, 0.35, 0.05)
#: Strength, in occurrences, of the prior that smooths a subject's bigrams and words; the word model's part in the former.
PRIOR, WORD_PRIOR, WORD_PART = 20.0, 200.0, 0.3
#: Evidence (G statistic of a word's or bigram's counts by subject) from which it tells subjects apart. Others, such as
#: the set phrases that occur under any subject, have no say: their small differences would add up over long sentences.
TELLING = 16.0
#: How many times as often as expected a telling word or bigram must occur under its subject, besides.
LIFT = 3.0
#: Part of its occurrences that does as well: with few subjects none can occur so much more often than expected.
MOSTLY = 0.7
#: Nats by which a sentence must speak for a subject.
MARGIN = 1.0
MOST = 2


def tokens(text: str) -> list[str]:
    """The tokens of a text, numbers as one, and a line break between sentences."""
    return TOKEN.findall(SENTENCE.sub("\n", NUMBER.sub("0", text.lower())))


@dataclass
class Vocabulary:
    words: dict[str, int]  # from 1 on, and -1 for the break between sentences
    grams: np.ndarray  # codes of bigrams, in order

    @property
    def size(self) -> int:
        return len(self.words)

    def encode(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Word, previous word, bigram (-1: unknown) and sentence of every token, and the document of every sentence."""
        get = self.words.get
        ids = np.array([get(t, 0) for parts in texts for t in parts], np.int64)
        whose = np.repeat(np.arange(len(texts)), [len(parts) for parts in texts])
        said = ids >= 0
        w, key = ids[said], (np.cumsum(~said) + whose)[said]  # grows with every sentence and document
        new = np.ones(len(w), bool)
        new[1:] = key[1:] != key[:-1]
        of, doc = np.cumsum(new) - 1, whose[said][new]
        before = np.concatenate([[0], w[:-1]]).astype(np.int64) if len(w) else w
        before[new] = self.size  # the start of a sentence
        codes = before * self.size + w
        if not len(self.grams):
            return w, before, np.full(len(w), -1), of, doc
        at = np.minimum(np.searchsorted(self.grams, codes), len(self.grams) - 1)
        return w, before, np.where(self.grams[at] == codes, at, -1), of, doc


class Models:
    """Counts of several models over one vocabulary: words, histories and bigrams, one column a model."""

    def __init__(self, vocab: Vocabulary, models: int):
        self.vocab = vocab
        self.word = np.zeros((vocab.size, models), np.float32)
        self.history = np.zeros((vocab.size + 1, models), np.float32)
        self.gram = np.zeros((len(vocab.grams) + 1, models), np.float32)

    def counts(self, model: np.ndarray, word: np.ndarray, before: np.ndarray, gram: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each table, which entries the tokens add to, and how much."""
        k = self.word.shape[1]
        return [np.unique(rows * k + model, return_counts=True) for rows in (word, before, np.where(gram < 0, len(self.gram) - 1, gram))]

    def add(self, counts: list[tuple[np.ndarray, np.ndarray]]) -> None:
        for table, (at, n) in zip((self.word, self.history, self.gram), counts, strict=True):
            table.reshape(-1)[at] += n.astype(np.float32)

    def lean(self, keep: np.ndarray, vocab: Vocabulary) -> Models:
        """The same models without the bigrams that have no say."""
        out = Models.__new__(Models)
        out.vocab, out.word, out.history = vocab, self.word, self.history
        out.gram = np.concatenate([self.gram[:-1][keep], self.gram[-1:]])
        out.telling_word = getattr(self, "telling_word", None)
        out.telling_gram = None if out.telling_word is None else np.concatenate([self.telling_gram[:-1][keep], [False]])
        return out

    def background(self, word: np.ndarray, before: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the first model: probability of each word, and of each word after the one before it."""
        two, one, flat = WEIGHTS
        alone = (self.word[word, 0] + 1) / (self.word[:, 0].sum() + self.vocab.size)
        pair = np.where(gram >= 0, self.gram[gram, 0], 0) / np.maximum(self.history[before, 0], 1)
        return alone, two * pair + one * alone + flat / self.vocab.size

    @staticmethod
    def _telling(table: np.ndarray) -> np.ndarray:
        share = table.sum(axis=0) / max(1.0, table.sum())
        expected = table.sum(axis=1, keepdims=True) * share
        with np.errstate(divide="ignore", invalid="ignore"):
            g = np.where(table > 0, table * np.log(table / expected), 0)
            lift = (table / np.maximum(expected, 1e-9)).max(axis=1)
        most = table.max(axis=1) / np.maximum(table.sum(axis=1), 1)
        return (2 * g.sum(axis=1) > TELLING) & ((lift > LIFT) | (most > MOSTLY))

    def settle(self) -> Models:
        """Marks what tells the subjects apart, once all counts are in."""
        self.telling_word, self.telling_gram = self._telling(self.word), self._telling(self.gram)
        self.telling_word[0] = self.telling_gram[-1] = False  # unknown words and bigrams
        return self

    def gains(self, behind: Models, word: np.ndarray, before: np.ndarray, gram: np.ndarray) -> np.ndarray:
        """Nats by which each model codes each token better than the background does."""
        alone, after = behind.background(word, before, gram)
        single = (self.word[word] + WORD_PRIOR * alone[:, None]) / (self.word.sum(axis=0) + WORD_PRIOR)
        prior = WORD_PART * single + (1 - WORD_PART) * after[:, None]
        flat = WORD_PART * alone + (1 - WORD_PART) * after
        pair = np.where(gram[:, None] >= 0, self.gram[gram], 0)
        seen = self.history[before]
        own = (pair + PRIOR * prior) / (seen + PRIOR)
        # the background is smoothed alike: a token that a subject uses as everybody does gains nothing
        gain = np.log(own) - np.log((seen * after[:, None] + PRIOR * flat[:, None]) / (seen + PRIOR))
        return np.where((self.telling_word[word] | self.telling_gram[gram])[:, None], gain, 0)


def _sums(values: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of each sentence; ``of`` rises, and every sentence has rows."""
    return np.add.reduceat(values, np.searchsorted(of, np.arange(n)), axis=0).astype(np.float64)


@dataclass
class Classifier:
    subjects: list[str]
    vocab: Vocabulary
    models: Models  # one column a subject
    background: Models
    least: tuple[float, float] = (0.25, 0.25)

    def shares(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Of each document, the part of its words, and of its words under any subject, that each subject has."""
        k = len(self.subjects)
        word, before, gram, of, doc = self.vocab.encode(texts)
        mass, length = np.zeros((len(texts), k)), np.zeros(len(texts))
        cuts = np.searchsorted(of, np.arange(0, of[-1] + 1, 20_000)) if len(of) else []
        bounds = [*cuts, len(of)]
        for a, b in zip(bounds, bounds[1:], strict=False):
            if a == b:
                continue
            first, n = of[a], of[b - 1] - of[a] + 1
            local = of[a:b] - first
            scores = _sums(self.models.gains(self.background, word[a:b], before[a:b], gram[a:b]), local, n)
            best = scores.argmax(axis=1)
            size = np.bincount(local, minlength=n)
            docs = doc[first : first + n]
            np.add.at(length, docs, size)
            ok = scores[np.arange(n), best] > MARGIN
            np.add.at(mass, (docs[ok], best[ok]), size[ok])
        some = mass.sum(axis=1)
        return mass / np.maximum(length, 1)[:, None], mass / np.maximum(some, 1)[:, None]

    def accept(self, texts: list[list[str]]) -> list[list[int]]:
        whole, among = self.shares(texts)
        return [self._chosen(w, a, *self.least) for w, a in zip(whole, among, strict=True)]

    @staticmethod
    def _chosen(whole: np.ndarray, among: np.ndarray, least_whole: float, least_among: float) -> list[int]:
        order = sorted(range(len(whole)), key=lambda s: (-whole[s], s))
        return [s for s in order[:MOST] if whole[s] > 0 and whole[s] >= least_whole and among[s] >= least_among]


    def lean(self) -> Classifier:
        """The same classifier with only the bigrams that have a say: those that tell, or whose word does. A bigram that
        is unknown otherwise counts as never seen, as it has no say."""
        grams = self.vocab.grams
        keep = self.models.telling_gram[:-1] | self.models.telling_word[grams % self.vocab.size]
        vocab = Vocabulary(self.vocab.words, grams[keep])
        return Classifier(self.subjects, vocab, self.models.lean(keep, vocab), self.background.lean(keep, vocab), self.least)


#: One in so many labelled documents is held out for calibration.
FOLDS = 5
ENCODED = "doc_id bigint, own array<int>, held boolean, tokens string"


def _texts(lines: list[str]) -> list[list[str]]:
    return [line.split(" ") if line else [] for line in lines]


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lines = [" ".join(tokens(t)) for t in batch.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(lines, pa.string())], names=["doc_id", "own", "held", "tokens"])


def _packed(rows: DataFrame, work) -> list:
    """What ``work`` gives for some hundred labelled documents at a time: small arrays, to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                yield pa.RecordBatch.from_pydict({"data": pa.array([pickle.dumps(work(batch.slice(a, 500)))], pa.binary())})

    return [pickle.loads(r.data) for r in rows.mapInArrow(run, "data binary").toLocalIterator()]


def vocabulary(labelled: DataFrame) -> Vocabulary:
    """All words and bigrams of the labelled documents."""
    spark = labelled.sparkSession
    spoken = _packed(labelled, lambda b: {t for parts in _texts(b.column(3).to_pylist()) for t in parts})
    words = {t: i + 1 for i, t in enumerate(sorted(set().union(*spoken) - {"\n"}))} | {"\n": -1}
    sent = ship(spark, Vocabulary(words, np.zeros(0, np.int64)))

    def codes(batch: pa.RecordBatch) -> np.ndarray:
        vocab = sent()
        w, before, _, _, _ = vocab.encode(_texts(batch.column(3).to_pylist()))
        return np.unique(before * vocab.size + w)

    return Vocabulary(words, np.unique(np.concatenate([*_packed(labelled, codes), np.zeros(0, np.int64)])))


def train(labelled: DataFrame, vocab: Vocabulary, background: Models, subjects: list[str], held_out: bool, rounds: int = 3) -> Classifier:
    """Models from labelled documents, or, with ``held_out``, from those that are not; acceptance is not calibrated yet.

    Every round the tasks assign the sentences by the models so far and count; the driver adds the counts."""
    k, rows = len(subjects), labelled.where("NOT held") if held_out else labelled
    models = None
    for _ in range(rounds + 1):
        sent = ship(labelled.sparkSession, (vocab, background if models else None, models))

        def count(batch: pa.RecordBatch, sent=sent) -> list:
            vocab, behind, now = sent()
            word, before, gram, of, doc = vocab.encode(_texts(batch.column(3).to_pylist()))
            allowed = np.zeros((batch.num_rows, k), bool)
            for d, own in enumerate(batch.column(1).to_pylist()):
                allowed[d, own] = True
            if now is None:
                owner = np.where(allowed.sum(axis=1) == 1, allowed.argmax(axis=1), -1)[doc]
            else:
                n = len(doc)
                scores = np.where(allowed[doc], _sums(now.gains(behind, word, before, gram), of, n) if n else np.zeros((0, k)), -np.inf)
                owner = np.where(scores.max(axis=1) > MARGIN, scores.argmax(axis=1), -1)
            use = owner[of] >= 0
            return (now or Models(vocab, k)).counts(owner[of][use], word[use], before[use], gram[use])

        told = _packed(rows, count)
        models = Models(vocab, k)
        for counts in told:
            models.add(counts)
        models.settle()
    return Classifier(subjects, vocab, models, background)


def calibrate(model: Classifier, labelled: DataFrame) -> float:
    """Sets the shares from which a subject is accepted to those with the best F1 on the held-out labels; returns it."""
    sent, k = ship(labelled.sparkSession, model.lean()), len(model.subjects)

    def shares(batch: pa.RecordBatch) -> tuple:
        own = np.zeros((batch.num_rows, k), bool)
        for d, labels in enumerate(batch.column(1).to_pylist()):
            own[d, labels] = True
        return (*sent().shares(_texts(batch.column(3).to_pylist())), own)

    told = _packed(labelled.where("held"), shares)
    if not told:
        return 0.0
    whole, among, own = (np.concatenate(c) for c in zip(*told, strict=True))
    first = np.argsort(-whole, axis=1, kind="stable")[:, :MOST]
    w, a, hit = (np.take_along_axis(x, first, axis=1) for x in (whole, among, own))
    best = (-1.0, model.least)
    for least_whole in np.arange(0.05, 0.51, 0.025):
        for least_among in np.arange(0.1, 0.51, 0.025):
            chosen = (w > 0) & (w >= least_whole) & (a >= least_among)
            f1 = 2 * int((chosen & hit).sum()) / max(1, int(chosen.sum()) + int(own.sum()))
            best = max(best, (f1, (float(least_whole), float(least_among))))
    model.least = best[1]
    return best[0]


def _background(vocab: Vocabulary):
    """Per task, how often each word, history and bigram of the vocabulary occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Models(vocab, 1)
        for batch in batches:
            texts = [tokens(t) for t in batch.column(0).to_pylist() if t]
            word, before, gram, _, _ = vocab.encode(texts)
            counts.add(counts.counts(np.zeros(len(word), np.int64), word, before, gram))
        for kind, table in enumerate((counts.word, counts.history, counts.gram)):
            ids = np.flatnonzero(table[:, 0])
            yield pa.RecordBatch.from_pydict({"kind": pa.array([kind] * len(ids), pa.int32()), "id": pa.array(ids), "n": pa.array(table[ids, 0].astype(np.int64))})

    return run


def fit(documents: DataFrame, subjects: DataFrame, labels: DataFrame, max_labelled: int = 20_000) -> Classifier:
    spark = documents.sparkSession
    names = sorted(r.subject for r in subjects.where("subject IS NOT NULL").select("subject").distinct().collect())
    at = spark.createDataFrame(list(enumerate(names)), "at int, subject string")
    known = labels.where("doc_id IS NOT NULL").join(F.broadcast(at), "subject").groupBy("doc_id").agg(F.collect_set("at").alias("own"))
    chosen = known.orderBy(F.xxhash64("doc_id")).limit(max_labelled)  # before the texts come to it
    bounded = chosen.join(documents.select("doc_id", "text").where("text IS NOT NULL"), "doc_id")
    held = (F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(FOLDS)) == 0).alias("held")
    spread = bounded.select("doc_id", "own", held, "text").repartition(spark.sparkContext.defaultParallelism, "doc_id")
    labelled = materialise(spread.mapInArrow(_tokens, ENCODED), "labelled")
    vocab = vocabulary(labelled)
    sent = ship(spark, vocab)
    counted = documents.select("text").mapInArrow(lambda b: _background(sent())(b), "kind int, id bigint, n bigint").groupBy("kind", "id").agg(F.sum("n").alias("n"))
    background = Models(vocab, 1)
    counts = counted.toArrow()  # at most one row a word, history and bigram of the labelled documents
    kind, ids, n = (counts.column(i).to_numpy() for i in range(3))
    background.add([(ids[kind == i], n[kind == i]) for i in range(3)])
    trial = train(labelled, vocab, background, names, held_out=True)
    calibrate(trial, labelled)
    model = train(labelled, vocab, background, names, held_out=False)
    model.least = trial.least
    return model.lean()


def classify(documents: DataFrame, model: Classifier) -> DataFrame:
    """(doc_id, subject) of every document that is about a subject."""
    sent = ship(documents.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = sent()
        for batch in batches:
            docs, found = [], []
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a in range(0, len(ids), 500):
                for doc, chosen in zip(ids[a : a + 500], judge.accept([tokens(t) if t else [] for t in texts[a : a + 500]]), strict=True):
                    docs += [doc] * len(chosen)
                    found += [judge.subjects[s] for s in chosen]
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(docs, pa.int64()), "subject": pa.array(found, pa.string())})

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, subject string")


def find(documents: DataFrame, subjects: DataFrame, labels: DataFrame, **options) -> DataFrame:
    return classify(documents, fit(documents, subjects, labels, **options))
