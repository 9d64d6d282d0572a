"""Near duplicates by BagMinHash: weighted Jaccard of the multisets of word shingles.

Signatures. The weight of a shingle (how often it stands in the text) is cut in
levels [0, 1), [1, 2), [2, 4), [4, 8) and so on. Each shingle and level has a
Poisson process of its own, with a rate as large as the level is wide, made from
the hash of both. A point carries a time, a register and a height within the
level; it counts if its height is below the weight. Each register keeps its
earliest point. Two multisets agree in a register with a chance equal to their
weighted Jaccard similarity, since the earliest point of both together is as
likely under one unit of weight as under any other. Points are made in the order
of time and only until all registers are settled, which takes a number of points
that hardly depends on the length of the text.

Candidates. Signatures are cut in bands. Texts with the same words are one text
from here on. In a bucket, the texts that share a band, every text is paired with
one other only, the bucket's centre, so buckets of any size make as many pairs as
they have texts. Pairs are verified by their exact multiset overlap, and linked
texts become one class. ``STARS`` rounds, each with other centres, which are drawn
from the texts with most links, join what is near in buckets of many; texts of
the centre's class need no pair.

Links missed by the stars lie between texts of a bucket that holds several
classes still. Those texts are searched by exact prefix filtering for pairs across
classes, which are verified too. Texts that were compared with one and the same much
linked text, their home, are searched by what tells them apart from it, not by what
all of them have of it. So every pair that shares a band is verified, in
one class already or by the search, or proved to be apart, and texts that share no
more than a common passage make no pairs.

The chance to miss a pair of similarity s is (1 - s^ROWS)^BANDS: below 1e-6 at 0.8.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabularium.functions.arrays import explode_once
from tabularium.llm.registry import contract, read, row_key
from tabularium.llm.words import mixed, plain, plain_words, rolling, texts_of
from tabularium.session import shared_path

# Words of a shingle; shorter texts are one shingle as a whole.
SHINGLE = 5
SIMILARITY = 0.8
BANDS = 26
ROWS = 4
REGISTERS = BANDS * ROWS
# Rounds of stars before the exact search; they decide the work, not the result.
STARS = 3
# Texts that a text has to be the home of before they are compared by their differences from it; decides the work, not the result.
FAMILY = 16

# Odd multipliers that tell level, point and purpose apart.
_LEVEL, _POINT, _REGISTER, _HEIGHT, _BAND = (np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3))
# A first guess of the time by which all registers have their point.
_HORIZON = float(np.log(REGISTERS) + 3.0)


def shingle_counts(texts: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, hash and count of each distinct shingle of some texts; none for texts without words."""
    words, bounds = plain_words(texts)
    lengths = np.diff(bounds)
    owners, hashes = [], []
    if len(words) >= size:
        starts = np.arange(len(words) - size + 1)
        owner = np.searchsorted(bounds, starts, "right") - 1
        whole = starts + size <= bounds[owner + 1]
        owners.append(owner[whole])
        hashes.append(mixed(rolling(words, size)[whole]))
    for short in np.flatnonzero((lengths > 0) & (lengths < size)):
        own = words[bounds[short] : bounds[short + 1]]
        owners.append(np.array([short]))
        hashes.append(mixed(rolling(own, len(own)) ^ np.uint64(len(own))))
    if not owners:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    owner, hashed = np.concatenate(owners), np.concatenate(hashes)
    order = np.lexsort((hashed, owner))
    owner, hashed = owner[order], hashed[order]
    first = np.append(True, (owner[1:] != owner[:-1]) | (hashed[1:] != hashed[:-1])) if len(owner) else np.zeros(0, bool)
    heads = np.flatnonzero(first)
    return owner[heads], hashed[heads], np.diff(np.append(heads, len(owner)))


def _uniform(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1] from hashes."""
    return ((mixed(x) >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53


def signatures(owner: np.ndarray, hashed: np.ndarray, weight: np.ndarray, n: int, registers: int = REGISTERS) -> np.ndarray:
    """``n`` signatures of ``registers`` times of earliest points; a text without shingles has infinite ones.

    The points within any horizon depend on the shingles and levels alone, so a
    horizon that leaves a register empty is simply doubled for that text.
    """
    times = np.full(n * registers, np.inf)
    total = np.bincount(owner, weight, n)
    horizon = np.divide(registers * (np.log(registers) + 3.0), total, out=np.zeros(n), where=total > 0)
    # Levels of each shingle: width 1, 1, 2, 4, ... from 0 up, as far as the weight reaches.
    top = np.where(weight > 1, np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64), 0) + 1
    which = np.repeat(np.arange(len(owner)), top)
    level = np.arange(len(which)) - np.repeat(np.cumsum(top) - top, top)
    low = np.where(level > 0, 2.0 ** (level - 1), 0.0)
    width = np.where(level > 0, low, 1.0)
    text, heavy = owner[which], weight[which].astype(np.float64)
    seed = mixed(hashed[which] + level.astype(np.uint64) * _LEVEL)
    todo = np.unique(owner)
    while len(todo):
        chosen = np.zeros(n, bool)
        chosen[todo] = True
        active = np.flatnonzero(chosen[text])
        now, made, batch = np.zeros(len(active)), 0, 1
        while len(active):
            # The next points of every process that has not passed its text's horizon.
            place = seed[active][:, None] + np.arange(made + 1, made + batch + 1, dtype=np.uint64)[None, :] * _POINT
            arrival = now[:, None] + np.cumsum(-np.log(_uniform(place)), axis=1) / width[active][:, None]
            counts = arrival <= horizon[text[active]][:, None]
            row, column = np.nonzero(counts)
            source, point = active[row], place[row, column]
            height = low[source] + width[source] * _uniform(point ^ _HEIGHT)
            # Heights lie in (0, width]: a level that the weight covers keeps all its points.
            good = height <= heavy[source]
            register = (mixed(point ^ _REGISTER) % np.uint64(registers)).astype(np.int64)
            np.minimum.at(times, text[source[good]] * registers + register[good], arrival[row[good], column[good]])
            on = counts[:, -1]
            active, now = active[on], arrival[on, -1]
            made += batch
            batch = min(2 * batch, 256)
        unsettled = np.isinf(times.reshape(n, registers)[todo]).any(axis=1)
        todo = todo[unsettled]
        horizon[todo] *= 2
    return times.reshape(n, registers)


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key per text and band."""
    bits = signature.view(np.uint64).reshape(len(signature), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _BAND, bits.shape[:2])
    for i in range(rows):
        key = mixed((key ^ bits[:, :, i]) * _POINT)
    return key.view(np.int64)


def _sketcher(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for keys, texts in texts_of(batches):
        found = band_keys(signatures(*shingle_counts(texts), len(texts)))
        digests, bands = [], []
        for i, text in enumerate(texts):
            words = plain(text).split()
            # Texts without words are the same only if they are equal.
            digests.append(int.from_bytes(hashlib.blake2b(b" ".join(words) if words else b"\0" + text, digest_size=8).digest(), "little", signed=True))
            bands.append(found[i] if words else found[i][:0])
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(digests, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], names=["key", "content", "bands"])


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets, as sorted hashes and counts."""
    place = np.searchsorted(a[0], b[0])
    place[place == len(a[0])] = 0
    both = np.minimum(a[1][place], b[1])[a[0][place] == b[0]].sum() if len(a[0]) and len(b[0]) else 0
    return float(both / (a[1].sum() + b[1].sum() - both))


def _verifier(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Similarities of rows ``a, b, text_a, text_b``; the multiset of a text that comes again at once is kept."""
    kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def bag(key: int, text) -> tuple[np.ndarray, np.ndarray]:
        if key not in kept:
            if len(kept) > 64:
                kept.clear()
            _, hashed, counts = shingle_counts([text.as_buffer().to_pybytes()])
            kept[key] = (hashed, counts)
        return kept[key]

    for batch in batches:
        a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
        found = [overlap(bag(x, s), bag(y, t)) for x, y, s, t in zip(a, b, batch.column("text_a"), batch.column("text_b"), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(found, pa.float64())], names=["a", "b", "similarity"])


def _kept(spark: SparkSession, frame: DataFrame, name: str) -> DataFrame:
    path = shared_path(spark, f"near-{name}")
    frame.write.parquet(path)
    return spark.read.parquet(path)


def _verified(spark: SparkSession, pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``a, b, similarity`` of pairs of contents; ``texts`` is ``content, text``."""
    first = pairs.join(texts.select(F.col("content").alias("b"), F.col("text").alias("text_b")), "b")
    # Both texts of a pair are only together in the rows that are compared.
    whole = first.join(texts.select(F.col("content").alias("a"), F.col("text").alias("text_a")), "a")
    return _kept(spark, whole.select("a", "b", "text_a", "text_b").mapInArrow(_verifier, "a long, b long, similarity double"), "verified")


def components(links: DataFrame) -> DataFrame:
    """``node, class``: the smallest node of each connected component, for all nodes of the links ``a, b``.

    Alternating large and small stars: each round hangs nodes on smaller
    neighbours, in joins and minima that no hot node can overload. Every round is
    written out.
    """
    spark = links.sparkSession
    edges = _kept(spark, links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b")
        # Small star: a node and its smaller neighbours hang on the smallest.
        large = _kept(spark, large.distinct(), "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(least, "a")
        small = hung.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).filter("a > b")
        edges = _kept(spark, small.distinct(), "small")
        # The edges' number and the sum of their hashes: equal only if nothing changed.
        now = edges.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40))).alias("sum")).first()
        if now == before:
            roots = edges.select(F.col("b").alias("node")).distinct().withColumn("class", F.col("node"))
            return edges.select(F.col("a").alias("node"), F.col("b").alias("class")).unionByName(roots)
        before = now


def _merged(spark: SparkSession, classes: DataFrame, links: DataFrame) -> DataFrame:
    """``content, class`` after the classes that ``links(a, b)`` connect have become one."""
    of_a, of_b = (classes.select(F.col("content").alias(x), F.col("class").alias(f"class_{x}")) for x in "ab")
    edges = links.select("a", "b").join(of_a, "a").join(of_b, "b").filter("class_a != class_b")
    edges = _kept(spark, edges.select(F.col("class_a").alias("a"), F.col("class_b").alias("b")).distinct(), "merges")
    if edges.isEmpty():
        return classes
    renamed = components(edges).select(F.col("node").alias("class"), F.col("class").alias("joined"))
    return _kept(spark, classes.join(renamed, "class", "left").select("content", F.coalesce("joined", "class").alias("class")), "classes")


def _homes(opened: DataFrame, verified: DataFrame) -> DataFrame:
    """``content, class, home``: of the texts it was found half alike to, the one with most links, if that is the home of ``FAMILY`` texts; else null."""
    both = verified.select("a", "b", "similarity").unionByName(verified.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
    both = both.filter("similarity >= 0.5")
    drawn = both.groupBy("b").agg(F.struct(F.count_if(F.col("similarity") >= SIMILARITY).alias("links"), F.count("*").alias("met"), "b").alias("rank"))
    seen = both.select("a", "b").unionByName(drawn.select(F.col("b").alias("a"), "b"))
    best = seen.join(drawn, "b").groupBy(F.col("a").alias("content")).agg(F.max("rank").alias("rank")).select("content", F.col("rank.b").alias("home"))
    named = opened.join(best, "content", "left")
    homes = named.groupBy("home").agg(F.count("*").alias("n")).filter(F.col("n") >= FAMILY).select("home", F.lit(True).alias("many"))
    return named.join(homes, "home", "left").select("content", "class", F.when(F.col("many"), F.col("home")).alias("home"))


def _elements(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Owner and element of multisets as sets: the k-th copy of a shingle is an element of its own."""
    owner, hashed, weight = shingle_counts(texts)
    which = np.repeat(np.arange(len(owner)), weight)
    copy = np.arange(len(which)) - np.repeat(np.cumsum(weight) - weight, weight)
    return owner[which], mixed(hashed[which] + copy.astype(np.uint64) * _LEVEL)


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``content, class, home, size, base, missing, elements, apart`` of rows ``content, class, home, text, home_text``.

    ``base`` is how many elements the home has, ``missing`` how many of them the text
    lacks, ``apart`` what only one of both has, hashed with the home.
    """
    kept: dict[int, np.ndarray] = {}
    for batch in batches:
        at = 0
        for keys, texts in texts_of(iter([batch]), "content"):
            part = batch.slice(at, len(keys))
            at += len(keys)
            owner, element = _elements(texts)
            elements = np.split(element, np.searchsorted(owner, np.arange(1, len(keys))))
            base, apart = np.zeros(len(keys), np.int64), [element[:0]] * len(keys)
            for i, home in enumerate(part.column("home").to_pylist()):
                if home is None:
                    continue
                if home not in kept:
                    if len(kept) > 64:
                        kept.clear()
                    kept[home] = _elements([part.column("home_text")[i].as_buffer().to_pybytes()])[1]
                base[i] = len(kept[home])
                apart[i] = mixed(np.setxor1d(elements[i], kept[home], assume_unique=True) ^ mixed(np.array([home]).view(np.uint64)))
            size, differ = (np.array([len(x) for x in lists]) for lists in (elements, apart))
            lists = [pa.array([x.view(np.int64) for x in lists], pa.list_(pa.int64())) for lists in (elements, apart)]
            columns = [part.column("content"), part.column("class"), part.column("home"), pa.array(size), pa.array(base), pa.array((differ + base - size) // 2), *lists]
            yield pa.RecordBatch.from_arrays(columns, names=["content", "class", "home", "size", "base", "missing", "elements", "apart"])


def _across_classes(spark: SparkSession, opened: DataFrame, texts: DataFrame, verified: DataFrame) -> DataFrame:
    """``a, b`` (a > b): the pairs of ``content, class`` of different classes that can be similar and are needed; exact prefix filtering.

    Texts of different homes are compared by their elements, texts of one home by
    what tells them apart from it. Two texts of sizes m and n are similar if they have
    r (m + n) elements in common, r = t / (1 + t). With a home of c elements, of which
    they lack d and e, they have c - d - e of these and as many more as their differences
    from the home have in common, so the differences need r (m + n) - c + d + e in common.
    With u = r (m - c) + d of each text that is the sum of both u less (1 - 2 r) c.
    A text is similar to its home if its u is at most (1 - 2 r) c. Two such texts
    are of one class by the home, all others need something in common. Without a home
    c = d = 0, and a text is apart from nothing by its own elements.

    Elements are ordered by how few of the texts have them. After the first element
    in this order that two texts have in common neither has more than its remaining
    elements in common with the other, so these have to be as many as both need.
    What many texts share comes last, so it brings no pairs, and what many copies have
    of one text is in no difference from it.
    """
    t = SIMILARITY
    r = t / (1 + t)
    homes = _kept(spark, _homes(opened, verified), "homes")
    named = homes.select("home").distinct().join(texts.select(F.col("content").alias("home"), F.col("text").alias("home_text")), "home")
    whole = homes.join(texts, "content").join(named, "home", "left").select("content", "class", "home", "text", "home_text")
    schema = "content long, class long, home long, size long, base long, missing long, elements array<long>, apart array<long>"
    bags = _kept(spark, whole.mapInArrow(_bags, schema), "bags")
    # One set per text for other homes, and one for its own.
    far = bags.select("content", "class", "home", F.lit(False).alias("near"), "size", F.lit(0).alias("base"), F.lit(0).alias("missing"), F.col("size").alias("all"), "elements")
    near = bags.filter("base > 0").withColumn("all", 2 * F.col("missing") + F.col("size") - F.col("base"))
    near = near.select("content", "class", "home", F.lit(True).alias("near"), "size", "base", "missing", "all", F.col("apart").alias("elements"))
    grant = (1 - 2 * r) * F.col("base")
    sets = far.unionByName(near).withColumn("u", r * (F.col("size") - F.col("base")) + F.col("missing")).withColumn("linked", F.col("near") & (F.col("u") <= grant + 1e-9))
    # A partner is of t times the size at least, and not similar to the home if the text is.
    least = F.col("u") - grant + F.greatest(r * (t * F.col("size") - F.col("base")), F.when(F.col("linked"), grant).otherwise(0.0))
    sets = sets.withColumn("half", F.col("u") - grant / 2).withColumn("keep", F.col("all") - F.ceil(least - 1e-9) + 1)
    # Sets of one side need no look at each other: texts of one home by their elements, of one class or similar to the home by what is apart.
    sets = sets.withColumn("side", F.when(F.col("linked"), F.col("home")).when(F.col("near") | F.col("home").isNull(), F.col("class")).otherwise(F.xxhash64("home")))
    rows = explode_once(sets.select("content", "near", "side", "keep", "elements"), F.col("elements"), "element").drop("elements")
    rows = _kept(spark, rows, "elements")
    # The side that most texts with an element are of.
    frequent = rows.groupBy("element", "side").agg(F.count("*").alias("n")).groupBy("element").agg(
        F.sum("n").alias("df"), F.count("*").alias("sides"), F.max_by("side", F.struct("n", "side")).alias("most")
    )
    order = Window.partitionBy("content", "near").orderBy("df", "element")
    ranked = rows.drop("side").join(frequent, "element").withColumn("place", F.row_number().over(order))
    ranked = ranked.filter((F.col("place") <= F.col("keep")) & (F.col("sides") > 1)).select("content", "near", "element", "most", "place")
    ranked = ranked.join(sets.select("content", "near", "class", "side", "half", "all"), ["content", "near"])
    ranked = _kept(spark, ranked.select("content", "class", "side", "half", "element", "most", (F.col("all") - F.col("place") + 1).alias("rest")), "prefixes")
    left = ranked.filter(F.col("side") != F.col("most")).select("element", *[F.col(c).alias(f"{c}_a") for c in ("content", "class", "side", "half", "rest")])
    right = ranked.select("element", *[F.col(c).alias(f"{c}_b") for c in ("content", "class", "side", "half", "rest")])
    able = (F.col("class_a") != F.col("class_b")) & (F.col("side_a") != F.col("side_b")) & (F.least("rest_a", "rest_b") >= F.col("half_a") + F.col("half_b") - 1e-9)
    met = left.join(right, (left["element"] == right["element"]) & able).select(F.col("content_a").alias("a"), F.col("content_b").alias("b"))
    met = met.unionByName(sets.filter("linked and content != home").select(F.col("content").alias("a"), F.col("home").alias("b")))
    return met.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def near_classes(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``key, content`` of all rows of ``key, text``, and ``content, class`` of the contents that share a band with others.

    Contents stand for texts with the same words. Two contents are of one class
    exactly if a chain of links of at least ``SIMILARITY`` connects them, as far
    as bands bring them together.
    """
    spark = texts.sparkSession
    sketches = _kept(spark, texts.select("key", "text").mapInArrow(_sketcher, "key long, content long, bands array<long>"), "sketches")
    members = sketches.select("key", "content")
    distinct = sketches.groupBy("content").agg(F.min("key").alias("key"))
    banded = sketches.join(distinct, ["content", "key"], "left_semi").select("content", "bands")
    banded = explode_once(banded.dropDuplicates(["content"]), F.col("bands"), "band").select("band", "content")
    shared = banded.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1").select("band")
    rows = _kept(spark, banded.join(shared, "band"), "rows")
    classes = _kept(spark, rows.select("content").distinct().withColumn("class", F.col("content")), "classes")
    named = distinct.join(classes.select("content"), "content")
    found = _kept(spark, texts.select("key", "text").join(named, "key").dropDuplicates(["content"]).select("content", "text"), "texts")
    verified = None
    for star in range(STARS):
        told = rows.join(classes, "content").withColumn("level", F.lit(0.0))
        if verified is not None:
            ends = verified.filter(F.col("similarity") >= SIMILARITY).select(F.explode(F.array("a", "b")).alias("content"))
            linked = ends.groupBy("content").agg(F.floor(F.log2(F.count("*") + 1.0)).cast("double").alias("links"))
            told = told.join(linked, "content", "left").withColumn("level", F.coalesce("links", "level"))
        # Among the texts with most links so far: what many copies were made from is near to each of them.
        centre = F.max(F.struct("level", F.xxhash64("content", F.lit(star)).alias("draw"), "content", "class"))
        buckets = told.groupBy("band").agg(centre.alias("first"), F.min("class").alias("lo"), F.max("class").alias("hi"))
        buckets = buckets.filter("lo < hi").select("band", F.col("first.content").alias("first"), F.col("first.class").alias("of"))
        pairs = told.join(buckets, "band").filter("class != of").select(F.greatest("content", "first").alias("a"), F.least("content", "first").alias("b")).distinct()
        if verified is not None:
            pairs = pairs.join(verified.select("a", "b"), ["a", "b"], "left_anti")
        fresh = _verified(spark, pairs, found)
        verified = fresh if verified is None else verified.unionByName(fresh)
        classes = _merged(spark, classes, fresh.filter(F.col("similarity") >= SIMILARITY))
    # The rest: texts of buckets that hold several classes still.
    told = rows.join(classes, "content")
    several = told.groupBy("band").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).filter("lo < hi").select("band")
    opened = _kept(spark, told.join(several, "band").select("content", "class").distinct(), "open")
    pairs = _across_classes(spark, opened, found, verified).join(verified.select("a", "b"), ["a", "b"], "left_anti")
    fresh = _verified(spark, pairs, found)
    return members, _merged(spark, classes, fresh.filter(F.col("similarity") >= SIMILARITY))


def near_duplicates(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id, key, class, class_id, class_size``: the class of near duplicates of every document.

    Two texts are linked if the weighted Jaccard similarity of their multisets of
    shingles (``SHINGLE`` words of letters and digits, A-Z lower-cased) is at least
    ``SIMILARITY``; classes are what links connect. Texts of fewer words are one
    shingle, texts without words are alike only if equal, null is empty. A class
    is a number of its own, ``class_id`` its smallest id (null if it has no other);
    equal rows are in one class, and a document without near duplicates is a class
    of one. An empty table gives no rows.
    """
    documents = documents.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    documents = documents.withColumn("key", row_key(F.col("id"), F.col("text")))
    members, classes = near_classes(documents)
    contents = members.distinct().join(classes, "content", "left").select("key", F.coalesce("class", "content").alias("class"))
    rows = documents.select("id", "key").join(contents, "key")
    named = rows.groupBy("class").agg(F.min("id").alias("class_id"), F.count("*").alias("class_size"))
    return rows.join(named, "class").select(F.col("id").alias(id_column), "key", "class", "class_id", "class_size")


def one_of_each(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents, all columns as they are, of which each class of near duplicates keeps one: that of the smallest id.

    Ties go by a hash of the text; of equal rows one stays.
    """
    key = row_key(F.col(id_column), F.coalesce(F.col(text_column), F.lit("")))
    classes = near_duplicates(documents, id_column, text_column).withColumnRenamed(id_column, "id")
    alone = classes.filter("class_size = 1").select("key")
    first = classes.filter("class_size > 1").groupBy("class").agg(F.min(F.struct("id", "key")).alias("first")).select("first.key")
    rows = documents.select(F.struct("*").alias("row"), key.alias("key"))
    kept = rows.join(alone.unionByName(first), "key", "left_semi")
    return kept.groupBy("key").agg(F.first("row").alias("row")).select("row.*")


@contract("op4_bagminhash")
def op4_bagminhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(read(spark, folder, "documents")).drop("key", "class")
