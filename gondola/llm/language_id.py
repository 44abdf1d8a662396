"""Language of whole texts and of spans of mixed text.

A model holds, for each language, log-probabilities of hashed character n-grams of a word
and the share of its letters in each script. For a text, the scripts of a word's letters
narrow the languages down; each word then has a score for each language left, and a
Viterbi pass with a penalty for every switch labels the words. Runs of one label are the
spans; the text's language is the one with the most letters, and its score the share of
the letters labelled so.

The model is counted by Spark over a bounded sample of labelled rows: about
``TRAIN_BYTES`` of text for each language, drawn by hash. It has ``2**GRAM_BITS`` numbers for each language and nothing that grows with the data. All
texts are labelled whole.

A null text, or one without letters, is ``und`` with score 0 and no span. Ties go to the
language first in the alphabet. Repeated rows and repeated or null keys give one row each.
Empty tables give empty results; without a labelled row every text is ``und``. Extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gondola.llm.texts import (
    Shared,
    SpanHash,
    alike,
    gathered,
    id_and_text,
    is_held_out,
    mixed,
    slices,
)

UNKNOWN = "und"
GRAM_BITS = 15
GRAMS = (1, 2, 3, 4)
TRAIN_BYTES = 4_000_000
COUNTING_TASKS = 8
SWITCH = 4.0
CANDIDATE_SHARE = 0.02
SLICE = 2 << 20

#: First code points of ranges, and the script of each.
SCRIPT_STARTS = np.array([
    0x0000, 0x0370, 0x0400, 0x0530, 0x0590, 0x0600, 0x0780, 0x0900, 0x0980, 0x0A00, 0x0A80,
    0x0B00, 0x0B80, 0x0C00, 0x0C80, 0x0D00, 0x0D80, 0x0E00, 0x0E80, 0x0F00, 0x1000, 0x10A0,
    0x1100, 0x1200, 0x1380, 0x13A0, 0x1780, 0x1800, 0x18B0, 0x1E00, 0x1F00, 0x2000, 0x2C00,
    0x2E80, 0x3040, 0x3100, 0x3130, 0x3190, 0x31F0, 0x3200, 0x3400, 0xA000, 0xAC00, 0xD7B0,
    0xF900, 0xFB00, 0xFE00, 0x20000, 0x30000])
SCRIPT_NAMES = (
    "latin greek cyrillic armenian hebrew arabic other devanagari bengali gurmukhi gujarati "
    "oriya tamil telugu kannada malayalam sinhala thai lao tibetan myanmar georgian hangul "
    "ethiopic other cherokee khmer mongolian other latin greek other other han kana han hangul "
    "han kana other han other hangul other han arabic other han other").split()
SCRIPTS = sorted(set(SCRIPT_NAMES))
SCRIPT_OF_RANGE = np.array([SCRIPTS.index(s) for s in SCRIPT_NAMES])


class Words:
    """Words of a column of texts: runs of letters in lower case, with their n-grams."""

    def __init__(self, column: pa.Array):
        texts = column.to_pylist()
        points = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le"), np.uint32)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.text_starts = np.cumsum(sizes) - sizes
        points = LOWER[np.minimum(points, len(LOWER) - 1)]
        letter = LETTER[points]
        edge = np.diff(letter.astype(np.int8), prepend=0, append=0)
        self.starts = np.flatnonzero(edge == 1)
        self.ends = np.flatnonzero(edge == -1)
        self.text = np.searchsorted(self.text_starts, self.starts, side="right") - 1
        self.scripts = SCRIPT_OF_RANGE[np.searchsorted(SCRIPT_STARTS, points, side="right") - 1]
        self.points = points

    @property
    def sizes(self) -> np.ndarray:
        return self.ends - self.starts

    def distinct(self, hashes: SpanHash) -> tuple[np.ndarray, np.ndarray]:
        """A place of each distinct word, and which of them each word is."""
        return alike(hashes(self.points, self.starts, self.ends),
                     hashes(self.points, self.starts, self.ends, 1))

    def grams(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The n-gram buckets of every place of the padded words, and each word's first place."""
        starts, sizes = self.starts[which], self.sizes[which] + 2
        padded = np.full(int(sizes.sum()), 1, np.uint64)
        first = np.cumsum(sizes) - sizes
        inside = np.ones(len(padded), bool)
        inside[first], inside[first + sizes - 1] = False, False
        padded[inside] = gathered(self.points, starts, sizes - 2).astype(np.uint64)
        left = np.repeat(first + sizes, sizes) - np.arange(len(padded))
        columns = np.full((len(padded), len(GRAMS)), NO_GRAM, np.int32)
        code = np.zeros(len(padded), np.uint64)
        for k in range(1, max(GRAMS) + 1):
            shifted = np.zeros(len(padded), np.uint64)
            shifted[:len(padded) - k + 1] = padded[k - 1:]
            code = code * np.uint64(0x100000001B3) + shifted
            if k in GRAMS:
                bucket = (mixed(code) >> np.uint64(64 - GRAM_BITS)).astype(np.int32)
                columns[:, GRAMS.index(k)] = np.where(left >= k, bucket, NO_GRAM)
        return columns, first


#: One more bucket, of no weight, for places where no n-gram begins.
NO_GRAM = 1 << GRAM_BITS
#: Whether a code point is a letter, and its one-character lower case; all that lies above
#: the assigned letters counts as one more, which is none.
LETTER = np.array([chr(p).isalpha() for p in range(0x32000)] + [False])
LOWER = np.array([ord(chr(p).lower()) if len(chr(p).lower()) == 1 else p
                  for p in range(0x32000)] + [0x32000], np.int64)


class Model:
    """Log-probabilities of n-gram buckets and the scripts of each language."""

    def __init__(self, languages: list[str], counts: np.ndarray, scripts: np.ndarray):
        self.languages = languages
        total = counts.sum(1, keepdims=True)
        logs = np.log((counts + 0.1) / (total + 0.1 * counts.shape[1]))
        self.logs = np.zeros((counts.shape[1] + 1, len(languages)), np.float32)
        self.logs[:-1] = (logs / len(GRAMS)).T
        share = scripts / np.maximum(scripts.sum(1, keepdims=True), 1)
        self.uses = share >= CANDIDATE_SHARE
        self.hashes = SpanHash()
        self.uses[:, ~self.uses.any(0)] = True  # a script nobody uses rules nobody out

    def word_scores(self, words: Words) -> np.ndarray:
        place, group = words.distinct(self.hashes)
        grams, first = words.grams(place)
        scores = np.zeros((len(grams), len(self.languages)), np.float32)
        for column in grams.T:
            scores += self.logs[column]
        scores = np.add.reduceat(scores, first, axis=0)
        own = np.zeros((len(first), len(SCRIPTS)), bool)
        sizes = words.sizes[place]
        scripts = gathered(words.scripts, words.starts[place], sizes)
        own[np.repeat(np.arange(len(sizes)), sizes), scripts] = True
        fits = ~(own[:, None, :] & ~self.uses[None]).any(2)
        fits |= ~fits.any(1, keepdims=True)
        return np.where(fits, scores, np.float32(-1e9))[group]

    def label_words(self, words: Words) -> np.ndarray:
        """The Viterbi label of each word; all segments take their n-th word together."""
        scores = self.word_scores(words)
        languages = np.arange(len(self.languages))
        # A word that prefers one language by more than two switches is surely labelled so.
        # It starts a segment of its own; segments do not depend on each other.
        lead = scores.argmax(1)
        rest = scores.copy()
        rest[np.arange(len(scores)), lead] = -np.inf
        sure = scores.max(1) - rest.max(1) > 2 * SWITCH
        opens = np.ones(len(scores), bool)
        opens[1:] = words.text[1:] != words.text[:-1]
        begin = np.flatnonzero(opens | sure)
        counts = np.diff(np.append(begin, len(scores)))
        tied = sure[begin]  # the first label is known
        goal = np.full(len(begin), -1)  # the label that follows, where it is known
        goal[:-1] = np.where(opens[begin[1:]], -1, lead[begin[1:]])
        by_size = np.argsort(-counts, kind="stable")
        begin, counts, tied, goal = begin[by_size], counts[by_size], tied[by_size], goal[by_size]
        best = scores[begin].copy()
        best[tied] = np.where(lead[begin[tied]][:, None] == languages, best[tied], -1e18)
        came = np.zeros(scores.shape, np.int16)
        live = len(begin)
        for step in range(1, int(counts[0])):
            live = int(np.searchsorted(-counts, -step, side="left"))
            at = begin[:live] + step
            top = best[:live].argmax(1)
            switched = best[np.arange(live), top][:, None] - SWITCH
            stay = best[:live] >= switched
            came[at] = np.where(stay, languages, top[:, None])
            best[:live] = np.where(stay, best[:live], switched) + scores[at]
        known = goal >= 0
        best[known] -= SWITCH * (goal[known][:, None] != languages)
        label = np.zeros(len(scores), np.int16)
        state = best.argmax(1)
        for step in range(int(counts[0]) - 1, -1, -1):
            live = int(np.searchsorted(-counts, -step, side="left"))
            at = begin[:live] + step
            label[at] = state[:live]
            state[:live] = came[at, state[:live]]
        return label

    def whole(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Language (-1: none) and share of letters for each text."""
        label = self.label_words(words)
        n, k = len(words.text_starts), len(self.languages)
        letters = np.bincount(words.text * k + label, weights=words.sizes,
                              minlength=n * k).reshape(n, k)
        total = letters.sum(1)
        best = letters.argmax(1)
        return (np.where(total > 0, best, -1),
                np.where(total > 0, letters[np.arange(n), best] / np.maximum(total, 1), 0.0))


def fit(labelled: DataFrame, lang_column: str = "lang", **columns: str) -> Model | None:
    """Count the model over rows whose language is known; None if there is none.

    Of each language the rows whose hash of key and text falls under a share are used, the
    share set so that about ``TRAIN_BYTES`` are expected, but at least the row of the least hash;
    what comes back to the driver is one size and the bucket counts for each language, as
    columns of numbers.
    """
    rows = id_and_text(labelled, F.col(lang_column).cast("string").alias("lang"), **columns).where(
        F.col("lang").isNotNull() & (F.col("text") != ""))
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sizes = rows.groupBy("lang").agg(
        F.sum(F.octet_length("text")).alias("size"), F.min(draw).alias("least")).collect()
    if not sizes:
        return None
    share = F.create_map(*[F.lit(x) for r in sizes for x in (
        r["lang"], max(r["least"], min(1.0, TRAIN_BYTES / r["size"])))])
    chosen = rows.where(draw <= share[F.col("lang")]).repartition(
        COUNTING_TASKS, "doc_id", "text").select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: dict[str, np.ndarray] = {}
        scripts: dict[str, np.ndarray] = {}
        for batch in slices(batches, most=SLICE):
            langs = np.array(batch.column("lang").to_pylist(), object)
            words = Words(batch.column("text"))
            if not len(words.starts):
                continue
            columns, first = words.grams(np.arange(len(words.starts)))
            word = np.repeat(np.arange(len(first)), words.sizes + 2)
            for lang in set(langs):
                mine = (langs == lang)[words.text]
                took = np.bincount(columns[mine[word]].ravel(), minlength=NO_GRAM + 1)[:NO_GRAM]
                grams[lang] = grams.get(lang, 0) + took
                used = gathered(words.scripts, words.starts[mine], words.sizes[mine])
                scripts[lang] = scripts.get(lang, 0) + np.bincount(used, minlength=len(SCRIPTS))
        names = list(grams)
        yield pa.RecordBatch.from_arrays([
            pa.array([n for n in names for _ in (0, 1)], pa.string()),
            pa.array([k for _ in names for k in (0, 1)], pa.int32()),
            pa.array([x.tolist() for n in names for x in (grams[n], scripts[n])],
                     pa.list_(pa.int64()))], names=["lang", "kind", "counts"])

    parts = chosen.mapInArrow(
        run, "lang string, kind int, counts array<bigint>")
    summed = parts.select("lang", "kind", F.posexplode("counts").alias("place", "n")).groupBy(
        "lang", "kind", "place").agg(F.sum("n").alias("n")).where("n > 0").toArrow()
    lang = summed.column("lang").combine_chunks().dictionary_encode()
    languages = sorted(lang.dictionary.to_pylist())
    if not languages:
        return None
    counts = np.zeros((len(languages), NO_GRAM))
    scripts = np.zeros((len(languages), len(SCRIPTS)))
    order = np.array([languages.index(name) for name in lang.dictionary.to_pylist()])
    row = order[lang.indices.to_numpy()]
    kind, place, n = (summed.column(c).to_numpy() for c in ("kind", "place", "n"))
    for table, of in ((counts, kind == 0), (scripts, kind == 1)):
        table[row[of], place[of]] = n[of]
    return Model(languages, counts, scripts)


def training_rows(docs: DataFrame, modulus: int = 4, remainder: int = 2,
                  id_column: str = "doc_id") -> DataFrame:
    return docs.where(~is_held_out(id_column, modulus, remainder))


def _whole(model: Model | None, column: pa.Array) -> tuple[list[str], np.ndarray]:
    n = len(column)
    if model is None:
        return [UNKNOWN] * n, np.zeros(n)
    words = Words(column)
    if not len(words.starts):
        return [UNKNOWN] * n, np.zeros(n)
    best, score = model.whole(words)
    return [model.languages[k] if k >= 0 else UNKNOWN for k in best.tolist()], score


def identify(docs: DataFrame, model: Model | None, **columns: str) -> DataFrame:
    """``doc_id``, ``lang_pred`` and ``score`` of every text."""
    shared = Shared(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=SLICE):
            langs, score = _whole(shared.value, batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(score, pa.float64())],
                names=["doc_id", "lang_pred", "score"])

    return id_and_text(docs, **columns).mapInArrow(
        run, "doc_id long, lang_pred string, score double")


def label_spans(docs: DataFrame, model: Model | None, **columns: str) -> DataFrame:
    """One row per run of words of one language: ``doc_id``, ``start``, ``end`` (code
    points, end exclusive) and ``lang``."""
    shared = Shared(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches, most=SLICE):
            words = Words(batch.column("text"))
            if model is None or not len(words.starts):
                continue
            label = model.label_words(words)
            new = np.ones(len(label), bool)
            new[1:] = (label[1:] != label[:-1]) | (words.text[1:] != words.text[:-1])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(label)) - 1
            at = words.text[first]
            shift = words.text_starts[at]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").take(pa.array(at)),
                pa.array((words.starts[first] - shift).astype(np.int32)),
                pa.array((words.ends[last] - shift).astype(np.int32)),
                pa.array([model.languages[k] for k in label[first].tolist()], pa.string())],
                names=["doc_id", "start", "end", "lang"])

    return id_and_text(docs, **columns).mapInArrow(
        run, "doc_id long, start int, end int, lang string")


def keep_identified(docs: DataFrame, model: Model | None, least_score: float = 0.3,
                    text_column: str = "text") -> DataFrame:
    """The rows whose text has a language with at least this share of the letters."""
    shared = Shared(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_column, SLICE):
            langs, score = _whole(shared.value, batch.column(text_column).fill_null(""))
            keep = (np.array(langs) != UNKNOWN) & (score >= least_score)
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def languages_of(docs: DataFrame, **columns: str) -> DataFrame:
    """Fit on the rows that are not held out, then label every row: ``doc_id``,
    ``held_out``, ``lang_pred``, ``score``."""
    model = fit(training_rows(docs), **columns)
    shared = Shared(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=SLICE):
            langs, score = _whole(shared.value, batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()),
                 pa.array(score, pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"])

    return id_and_text(docs, is_held_out("doc_id", 4, 2).alias("held_out"), **columns).mapInArrow(
        run, "doc_id long, held_out boolean, lang_pred string, score double")
