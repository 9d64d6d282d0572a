"""Toxicity by nearest labelled examples: exact TF-IDF cosine over an inverted index.

Examples are labelled documents, as vectors of all their words, normalised over the
whole text; words that no example has count in the norm too. A term weighs more, by
the logarithm of a G-test, if its presence among the examples depends on the label,
whichever label that is; no word weighs less than its TF-IDF. Beginnings of words,
so that inflections of one stem meet, are terms beside the words: at half weight at
most, and only those of several words that tell the label.

The search is block-max: examples that are alike lie side by side, in blocks, and the
long lists of the most widespread terms have a maximum per block. The short lists are
walked in full; what the long ones can add to a block is bounded by its maxima and by
its largest norm over these terms, and only blocks that can still reach the k-th
cosine have their long lists read. Cosines in question are worked out again in double
precision, so bounds decide the work and never the result. The neighbours' labels are
voted by similarity, and the votes turned into a probability by a fit to the examples'
own leave-one-out votes, which tasks work out.

Examples are a bounded sample (``EXAMPLES``, smallest hashes of the id first), so
that the index can be sent to all tasks; it grows with the examples' texts, not with
the corpus. Every document is scored, on its whole text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, fields
from functools import cached_property
from hashlib import sha256
from math import exp, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from tabularium.llm.registry import contract, read
from tabularium.llm.words import plain, texts_of

# Labelled documents used as examples, at most; about 16 bytes a posting.
EXAMPLES = 20_000
# Word beginnings kept, at most, strongest first. Words are all kept.
TERMS = 4096
# Bytes of the word beginnings that are terms besides the whole word, their weight
# beside that of a word, and of how many different words they are the beginning.
STEMS = (4, 5, 6)
STEM_WEIGHT = 0.5
LEAST_WORDS = 2
# Least G statistic of an informative term (chance below 1e-6).
LEAST_G = 24.0
# Neighbours that vote, and weight of the prior among the votes.
NEIGHBOURS = 15
PRIOR = 0.5
# Texts scored at once, examples of a block, and terms whose lists are read by blocks.
GROUP = 64
BLOCK = 64
COMMON = 256
# Rows scored and handed on at once; what a task holds beside the batch it was given.
HANDED_ON = 1024
# A posting: the example's place and the term's weight in it, which are always read together.
HELD = np.dtype([("place", np.int32), ("weight", np.float32)])
# Blocks read first, for a first k-th cosine, and groups of examples that are alike.
FIRST = 4
KINDS = 64
# More than single precision can be wrong in a sum of ``COMMON`` products below one.
MARGIN = 1e-4


def terms_of(text: bytes) -> Counter:
    """Counts of the words and word beginnings of a text, as bytes; a word's mark is a space before it."""
    found: Counter = Counter()
    for word, n in Counter(plain(text).split()).items():
        found[b" " + word] += n
        for size in STEMS:
            if len(word) >= size:
                found[word[:size]] += n
    return found


def _term_rows(kept: frozenset | None = None):
    """Rows of all terms of the texts; of word beginnings, only those ``kept``, if given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in texts_of(batches, "id"):
            sizes, terms, counts = [], [], []
            for text in texts:
                found = terms_of(text)
                if kept is not None:
                    found = {term: n for term, n in found.items() if term[:1] == b" " or term in kept}
                sizes.append(len(found))
                terms.extend(found.keys())
                counts.extend(found.values())
            ids = np.repeat(np.array(keys, np.int64), sizes)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(terms, pa.binary()), pa.array(counts, pa.int64())], names=["id", "term", "n"])

    return run


@dataclass
class Index:
    """Examples as weighted postings by term; made on the driver from the words of at most ``EXAMPLES`` texts.

    Terms are lines: a few large values are sent to tasks, no dictionary.
    """

    terms: bytes
    gains: np.ndarray
    unseen: float
    starts: np.ndarray
    held: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    base: float
    slope: float = 1.0
    shift: float = 0.0

    def state(self) -> dict:
        """What tasks need, without a class of this package."""
        return {field.name: getattr(self, field.name) for field in fields(self)}

    @cached_property
    def shared(self) -> Broadcast:
        """``state`` as all tasks read it; sent once."""
        return SparkSession.active().sparkContext.broadcast(self.state())

    @property
    def postings(self) -> np.ndarray:
        return self.held["place"]

    @property
    def weights(self) -> np.ndarray:
        return self.held["weight"]

    @cached_property
    def places(self) -> dict[bytes, int]:
        return {term: i for i, term in enumerate(self.terms.split(b"\n"))} if self.terms else {}

    @cached_property
    def blocks(self) -> Blocks:
        return Blocks(self)

    @cached_property
    def stems(self) -> dict[bytes, int]:
        return {term: place for term, place in self.places.items() if term[:1] != b" "}

    @cached_property
    def begun(self) -> set[bytes]:
        return {term[: STEMS[0]] for term in self.stems}

    def counts(self, text: bytes) -> tuple[dict[int, int], float]:
        """Counts of the terms of a text, and the squared weight of its words that no example has."""
        found: dict[int, int] = {}
        other, places, stems, begun = 0.0, self.places, self.stems, self.begun
        for word, n in Counter(plain(text).split()).items():
            place = places.get(b" " + word)
            if place is None:
                other += ((1 + log(n)) * self.unseen) ** 2
            else:
                found[place] = n
            if word[: STEMS[0]] in begun:
                for size in STEMS:
                    if len(word) >= size and (place := stems.get(word[:size])) is not None:
                        found[place] = found.get(place, 0) + n
        return found, other

    def weigh(self, counts: dict[int, int], other: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        at, n = np.fromiter(counts.keys(), np.int64, len(counts)), np.fromiter(counts.values(), np.float64, len(counts))
        order = np.argsort(at)
        at, n = at[order], n[order]
        weights = (1 + np.log(n)) * self.gains[at]
        return at, weights / (sqrt(float((weights**2).sum()) + other) or 1.0)

    def nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int, but: tuple[int, ...] = ()) -> list[tuple[np.ndarray, np.ndarray]]:
        """``neighbours`` of up to ``GROUP`` vectors; of the i-th without the example ``but[i]``, if given and not negative."""
        if not len(self.ids):
            return [(np.zeros(0, np.int64), np.zeros(0))] * len(vectors)
        return self.blocks.nearest(vectors, k, but)

    def neighbours(self, at: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` examples with the largest cosine, without zeros; ties go to the smaller place."""
        return self.nearest([(at, weights)], k)[0]

    def vote(self, found: np.ndarray, cosines: np.ndarray) -> float:
        """Share of toxic neighbours by similarity, drawn to the share of all examples."""
        return float((cosines @ self.labels[found] + PRIOR * self.base) / (cosines.sum() + PRIOR))

    def calibrated(self, vote: float) -> float:
        return 1.0 / (1.0 + exp(-max(-30.0, min(30.0, self.slope * log(vote / (1 - vote)) + self.shift))))

    def votes(self, texts: list[bytes], k: int, but: tuple[int, ...] = ()) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
        for first in range(0, len(texts), GROUP):
            group = slice(first, first + GROUP)
            for found, cosines in self.nearest([self.weigh(*self.counts(text)) for text in texts[group]], k, but[group]):
                yield self.vote(found, cosines), found, cosines

    def scores(self, texts: list[bytes], k: int) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
        for vote, found, cosines in self.votes(texts, k):
            yield self.calibrated(vote), found, cosines


class Blocks:
    """The examples of an index in blocks of ``BLOCK``, those alike side by side.

    ``rows`` has the weights of the most widespread terms, ``tops`` and ``norms``
    their maximum per block and term and the largest norm per block. ``order`` lists
    the examples' places; places that fill the last block are no examples.
    """

    def __init__(self, index: Index):
        self.index, total = index, len(index.ids)
        # A posting as one number: lists are copied whole.
        self.held = index.held.view(np.int64)
        widest = np.argsort(-np.diff(index.starts), kind="stable")[:COMMON]
        self.column = np.full(len(index.gains), -1, np.int32)
        self.column[widest] = np.arange(len(widest))
        rows = np.zeros((total, len(widest)), np.float32)
        for i, term in enumerate(widest.tolist()):
            own = slice(index.starts[term], index.starts[term + 1])
            rows[index.postings[own], i] = index.weights[own]
        self.n_blocks = -(-total // BLOCK)
        self.order = self._side_by_side(rows)
        self.rows = np.zeros((self.n_blocks, BLOCK, len(widest)), np.float32)
        self.rows.reshape(-1, len(widest))[:total] = rows[self.order]
        self.where = np.empty(total, np.int64)
        self.where[self.order] = np.arange(total)
        self.tops = self.rows.max(1)
        self.norms = np.sqrt((self.rows**2).sum(2)).max(1)

    @staticmethod
    def _side_by_side(rows: np.ndarray) -> np.ndarray:
        """Places in an order that puts rows of one direction together; only the work depends on it."""
        lengths = np.sqrt((rows**2).sum(1, keepdims=True))
        centres = rows[np.linspace(0, len(rows) - 1, min(KINDS, len(rows))).astype(int)].copy()
        kind = np.zeros(len(rows), np.int64)
        for _ in range(6):
            centres /= np.maximum(np.sqrt((centres**2).sum(1, keepdims=True)), 1e-9)
            kind = (rows @ centres.T).argmax(1)
            for c in range(len(centres)):
                if len(own := np.flatnonzero(kind == c)):
                    centres[c] = (rows[own] / np.maximum(lengths[own], 1e-9)).mean(0)
        return np.lexsort((np.arange(len(rows)), lengths[:, 0], kind))

    def _short_lists(self, at: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Sums over all postings of the terms that are not read by blocks, by place."""
        index = self.index
        if not len(at):
            return np.zeros(len(index.ids))
        starts, ends = index.starts[at], index.starts[at + 1]
        held = np.concatenate([self.held[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]).view(HELD)
        return np.bincount(held["place"], held["weight"] * np.repeat(weights, ends - starts), minlength=len(index.ids))

    def nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int, but: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
        n, total = len(vectors), len(self.order)
        asked = np.zeros((n, self.rows.shape[2]))
        sums = np.full((n, self.n_blocks, BLOCK), -np.inf)
        for i, (at, weights) in enumerate(vectors):
            column = self.column[at]
            asked[i, column[column >= 0]] = weights[column >= 0]
            own = sums[i].reshape(-1)
            own[:total] = self._short_lists(at[column < 0], weights[column < 0])[self.order]
            if but and but[i] >= 0:
                own[self.where[but[i]]] = -np.inf
        single = asked.astype(np.float32)
        # What the long lists can add to an example of a block, at most.
        more = np.minimum(single @ self.tops.T, np.sqrt((asked**2).sum(1))[:, None] * self.norms)
        reach = sums.max(2) + more
        full = np.full(sums.shape, -np.inf)
        done = np.zeros(reach.shape, bool)
        first = np.argsort(-reach, axis=1, kind="stable")[:, :FIRST]
        np.put_along_axis(done, first, True, 1)
        self._read(done, single, sums, full)
        seen = np.take_along_axis(full, first[:, :, None], 1).reshape(n, -1)
        left = (reach > 0) & (reach >= self._least(seen, k)[:, None] - MARGIN)
        self._read(left & ~done, single, sums, full)
        done |= left
        found = []
        for i in range(n):
            blocks = np.flatnonzero(done[i])
            values = full[i, blocks].reshape(-1)
            near = np.flatnonzero((values > 0) & (values >= self._least(values[None], k)[0] - MARGIN))
            near = blocks[near // BLOCK] * BLOCK + near % BLOCK
            rows = self.rows.reshape(-1, self.rows.shape[2])[near]
            cosines = np.round(sums[i].reshape(-1)[near] + (rows * asked[i]).sum(1), 12)
            near, cosines = near[cosines > 0], cosines[cosines > 0]
            places = self.order[near]
            best = np.lexsort((places, -cosines))[:k]
            found.append((places[best], cosines[best]))
        return found

    def _read(self, asked_for: np.ndarray, asked: np.ndarray, sums: np.ndarray, full: np.ndarray) -> None:
        """Adds the long lists of blocks, each for the texts that ask for it."""
        for block in np.flatnonzero(asked_for.any(0)).tolist():
            own = np.flatnonzero(asked_for[:, block])
            full[own, block] = sums[own, block] + asked[own] @ self.rows[block].T

    @staticmethod
    def _least(values: np.ndarray, k: int) -> np.ndarray:
        """The k-th largest value of each row, at least zero."""
        if values.shape[1] < k:
            return np.zeros(len(values))
        return np.maximum(np.partition(values, values.shape[1] - k, axis=1)[:, values.shape[1] - k], 0.0)


def _logistic(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic fit, slightly drawn to slope 1 and shift 0."""
    slope, shift = 1.0, 0.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(slope * x + shift, -30, 30)))
        gap, spread = weights * (y - p), weights * np.maximum(p * (1 - p), 1e-9)
        gradient = np.array([gap @ x - (slope - 1), gap.sum() - shift])
        hessian = np.array([[(spread * x) @ x + 1, spread @ x], [spread @ x, spread.sum() + 1]])
        step = np.linalg.solve(hessian, gradient)
        slope, shift = slope + step[0], shift + step[1]
        if abs(step).max() < 1e-8:
            break
    return max(0.1, float(slope)), float(shift)


def _informative(seen: Column, marked: Column, good: int, bad: int) -> Column:
    """G statistic of a 2 x 2 table of presence and label; cells of zero add nothing."""
    total = float(good + bad)
    a, b = marked.cast("double"), (seen - marked).cast("double")
    c, d = F.lit(float(bad)) - a, F.lit(float(good)) - b

    def part(cell, row, column):
        return F.when(cell > 0, cell * F.log(cell * total / (row * float(column)))).otherwise(0.0)

    return 2 * (part(a, a + b, bad) + part(b, a + b, good) + part(c, c + d, bad) + part(d, c + d, good))


def build_index(examples: DataFrame, k: int = NEIGHBOURS) -> Index:
    """The index over ``id, text, toxic``, at most ``EXAMPLES`` rows with ids of their own.

    Terms are counted and tested as a distributed job; the driver gets the postings
    of all words and of the kept beginnings. Without any example of either label the
    index is empty.
    """
    spark = examples.sparkSession
    marked = sorted((row["id"], row["toxic"]) for row in examples.select("id", "toxic").collect())
    total, bad = len(marked), sum(label for _, label in marked)
    good = total - bad
    base = (bad + 0.5) / (total + 1)
    empty = Index(b"", np.zeros(0), 1.0, np.zeros(1, np.int64), np.zeros(0, HELD), np.zeros(0, np.int64), np.zeros(0), base)
    if not bad or not good:
        return empty
    numbers = spark.createDataFrame([(i, number, label) for number, (i, label) in enumerate(marked)], "id long, number int, toxic int")

    def rows(kept: frozenset | None = None) -> DataFrame:
        return examples.select("id", "text").mapInArrow(_term_rows(kept), "id long, term binary, n long").join(F.broadcast(numbers), "id")

    is_word = F.substring("term", 1, 1) == F.lit(bytearray(b" "))
    informative = _informative(F.col("df"), F.col("bad"), good, bad)
    # Read twice, made once.
    counts = rows().groupBy("term").agg(F.count("*").alias("df"), F.sum("toxic").alias("bad")).persist()
    sizes = F.explode(F.array(*map(F.lit, STEMS)))
    begun = counts.filter(is_word).select("term", sizes.alias("size")).filter(F.length("term") > F.col("size"))
    begun = begun.groupBy(F.expr("substring(term, 2, size)").alias("term")).agg(F.count("*").alias("words"))
    stems = counts.filter(~is_word).withColumn("g", informative).filter(F.col("g") >= LEAST_G).join(begun.filter(F.col("words") >= LEAST_WORDS), "term")
    stems = {bytes(row["term"]): row["words"] for row in stems.orderBy(F.col("g").desc(), "term").limit(TERMS).select("term", "words").collect()}
    counts.unpersist()
    held = rows(frozenset(stems)).groupBy("term").agg(
        F.count("*").alias("df"), F.sum("toxic").alias("bad"), F.sort_array(F.collect_list(F.struct("number", F.col("n").cast("int").alias("n")))).alias("held")
    )
    # In the order of terms and, within a term, of examples.
    table = held.orderBy("term").select("term", "df", informative.alias("g"), "held").toArrow()
    if not table.num_rows:
        return empty
    terms = table["term"].to_pylist()
    df, told = table["df"].to_numpy(), np.maximum(table["g"].to_numpy() - LEAST_G, 0)
    # What a word that stands once adds to a text, before the norm.
    gains = (np.log((total + 1) / (df + 1)) + 1) * (1 + np.log1p(told))
    gains *= np.array([1.0 if term[:1] == b" " else STEM_WEIGHT * (1 - 1 / stems[term]) for term in terms])
    terms = b"\n".join(terms)
    # A part of the table at a time: the driver holds the postings and little more.
    postings, weights, squares, first = [], [], np.zeros(total), 0
    for part in table["held"].chunks:
        cells, own = part.flatten(), slice(first, first + len(part))
        number, n = (cells.field(i).to_numpy() for i in (0, 1))
        weight = (1 + np.log(n, dtype=np.float32)) * np.repeat(gains[own].astype(np.float32), df[own])
        squares += np.bincount(number, weight.astype(float) ** 2, minlength=total)
        postings.append(number.copy())
        weights.append(weight)
        first = own.stop
    del table, part, cells, number, n, weight
    pa.default_memory_pool().release_unused()
    norms = np.sqrt(squares).astype(np.float32)
    starts = np.concatenate(([0], np.cumsum(df)))
    held, done = np.empty(starts[-1], HELD), 0
    for number, weight in zip(postings, weights, strict=True):
        own = held[done : done + len(number)]
        own["place"], own["weight"] = number, weight / norms[number]
        done += len(number)
    del postings, weights
    ids, labels = np.array([i for i, _ in marked]), np.array([label for _, label in marked], float)
    index = Index(terms, gains, log(total + 1) + 1, starts, held, ids, labels, base)
    # Leave one out: each example is judged by the others.
    told = examples.select("id", "text").mapInArrow(_voter(index, k), "id long, vote double").collect()
    by_id = {row["id"]: row["vote"] for row in told}
    votes, truths = [by_id[i] for i, _ in marked], [label for _, label in marked]
    odds_of = np.log(np.array(votes) / (1 - np.array(votes)))
    index.slope, index.shift = _logistic(odds_of, np.array(truths, float), np.ones(total))
    return index


def _opened(shared: Broadcast) -> Index:
    """The index, one per Python worker and not per task."""
    if "index" not in shared.__dict__:
        shared.index = Index(**shared.value)
    return shared.index


def _voter(index: Index, k: int):
    shared = index.shared

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _opened(shared)
        for ids, texts in texts_of(batches, "id"):
            places = tuple(np.searchsorted(index.ids, ids).tolist())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([vote for vote, *_ in index.votes(texts, k, places)], pa.float64())], names=["id", "vote"]
            )

    return run


def _judged(index: Index, k: int, evidence: int):
    """A function from texts to ``score, evidence``; equal texts are judged once."""
    seen: dict[bytes, tuple[float, list]] = {}

    def judge(texts: pa.Array) -> list[tuple[float, list]]:
        texts = [buffer.to_pybytes() if (buffer := value.as_buffer()) is not None else b"" for value in texts]
        marks = [sha256(text).digest() for text in texts]
        if len(seen) > 50_000:
            seen.clear()
        new = {mark: text for mark, text in zip(marks, texts, strict=True) if mark not in seen}
        for mark, (score, found, cosines) in zip(new, index.scores(list(new.values()), k), strict=True):
            told = [{"id": int(index.ids[f]), "cosine": float(c), "toxic": int(index.labels[f])} for f, c in zip(found[:evidence], cosines[:evidence], strict=True)]
            seen[mark] = (score, told)
        return [seen[mark] for mark in marks]

    return judge


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in parts of ``HANDED_ON`` rows."""
    for batch in batches:
        for first in range(0, batch.num_rows, HANDED_ON):
            yield batch.slice(first, HANDED_ON)


def held_out(id_column: Column) -> Column:
    """Whether a document's label is set apart: the checksum of its id as text is divisible by five. A null id's is not."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_examples(documents: DataFrame, labels: DataFrame, limit: int = EXAMPLES) -> DataFrame:
    """``id, text, toxic`` of at most ``limit`` labelled documents that are not held out.

    Of several labels for one id the largest counts, and of several documents with
    one id the largest text; null ids and labels other than 0 and 1 do not count.
    """
    marked = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    marked = marked.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").cast("int").alias("toxic"))
    drawn = marked.orderBy(F.xxhash64("id"), "id").limit(limit)
    # At most ``limit`` rows of two numbers.
    chosen = documents.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(drawn), "id")
    return chosen.groupBy("id", "toxic").agg(F.max(F.coalesce("text", F.lit(""))).alias("text"))


def _with_fit(index: Index, slope: float, shift: float) -> Index:
    index.slope, index.shift = slope, shift
    return index


def score_toxicity(documents: DataFrame, index: Index, id_column: str = "doc_id", text_column: str = "text", k: int = NEIGHBOURS, evidence: int = 3) -> DataFrame:
    """``id, score, evidence``: every document's probability of label 1 and its nearest examples.

    Only the text counts. Null, empty and other texts without a word of an example
    get the calibrated share of toxic ones among such examples. Equal texts have
    equal scores; repeated rows are scored each.
    """
    rows = documents.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    shared, slope, shift = index.shared, index.slope, index.shift
    near = StructType([StructField("id", LongType()), StructField("cosine", DoubleType()), StructField("toxic", IntegerType())])
    listed = pa.list_(pa.struct([("id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _judged(_with_fit(_opened(shared), slope, shift), k, evidence)
        for part in _parts(batches):
            scores, told = zip(*judge(part.column("text")), strict=True)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(scores, pa.float64()), pa.array(told, listed)], names=["id", "score", "evidence"])

    scored = rows.mapInArrow(run, StructType([rows.schema["id"], StructField("score", DoubleType()), StructField("evidence", ArrayType(near))]))
    return scored.withColumnRenamed("id", id_column)


def without_toxic(documents: DataFrame, index: Index, text_column: str = "text", threshold: float = 0.5, k: int = NEIGHBOURS) -> DataFrame:
    """The documents, all columns as they are, that score below ``threshold``."""
    # Whole rows go through the task, each text once, and only those that stay come back.
    rows = documents.select(F.struct("*").alias("row"))
    place = [name.lower() for name in documents.columns].index(text_column.lower())
    shared, slope, shift = index.shared, index.slope, index.shift

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _judged(_with_fit(_opened(shared), slope, shift), k, 0)
        for part in _parts(batches):
            yield part.filter(pa.array([score < threshold for score, _ in judge(part.column("row").field(place))], pa.bool_()))

    return rows.mapInArrow(run, rows.schema).select("row.*")


def fitted(spark: SparkSession, documents: DataFrame, labels: DataFrame) -> Index:
    examples = labelled_examples(documents, labels).persist()
    try:
        return build_index(examples)
    finally:
        examples.unpersist()


@contract("op10_toxicity")
def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    documents = read(spark, folder, "documents")
    index = fitted(spark, documents, read(spark, folder, "labels"))
    scored = score_toxicity(documents, index)
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
