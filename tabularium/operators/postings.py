"""Stored postings: BM25 searches that prune by bounds and shuffle hits only.

Postings are cut by documents: a *segment* is the whole inverted index of some
thousand documents, one row of the table. Its terms are spread by hash over
``COLUMNS`` columns, so a search reads the columns of its terms and no others. Each
term's postings are cut in blocks with the largest term frequency and the shortest
document of the block, which bound what any document of it can score, whatever
the parameters of a search are.

A task answers all queries from its own segments by MaxScore: a query's terms are
taken by falling bound, and terms that cannot lift a document over the k-th best
score so far by themselves give no candidates; nor do blocks that cannot. Candidates
go as soon as what is left of their bound is too little. What is shuffled are the
best ``k`` per task and query; documents are never paired with queries.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabularium.functions.text import tokens
from tabularium.operators.scan import SCORE_DIGITS, RunningBest, hits_type, no_hits, one_array, scan_blocks
from tabularium.operators.sparse import TERMS_PER_BLOCK, Bm25, Tokenizer, asked_terms, is_stored, sparse_vectors

# Parts of the table's layout: columns of terms, postings in a block.
COLUMNS = 32
BLOCK = 64
# Postings in a segment, about.
SEGMENT_POSTINGS = 1 << 19
# Bytes of a row group: segments are large rows, and a reader holds a whole group of them.
ROW_GROUP_BYTES = 8 << 20

_COLUMN = "struct<terms:array<string>,starts:array<int>,docs:array<int>,tfs:array<int>,top_tf:array<int>,least_length:array<int>>"
_SLACK = 10.0**-SCORE_DIGITS


def _name(column: int) -> str:
    return f"terms_{column:02d}"


def _columns_of(terms: pa.Array) -> np.ndarray:
    """The column of each term."""
    return np.fromiter(map(zlib.crc32, terms.cast(pa.binary()).to_pylist()), np.int64, len(terms)) % COLUMNS


def _cut(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For lists of ``n`` postings on end: the first posting of each block, and each list's first block."""
    starts = np.concatenate(([0], np.cumsum(n)))
    blocks = -(-n // BLOCK)
    first_block = np.concatenate(([0], np.cumsum(blocks)))
    within = np.arange(first_block[-1]) - np.repeat(first_block[:-1], blocks)
    return np.repeat(starts[:-1], blocks) + within * BLOCK, first_block


def _segment(batches: list[pa.RecordBatch], schema: pa.Schema) -> pa.RecordBatch:
    """One row: the index of the batches' documents ``id, terms, tfs, length``, which are numbered by length."""
    table = pa.Table.from_batches(batches)
    bags = one_array(table["terms"])
    sizes = pc.list_value_length(bags).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    lengths = one_array(table["length"]).fill_null(0).to_numpy(zero_copy_only=False)
    order = np.argsort(lengths, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    lengths = lengths[order]
    coded = pc.list_flatten(bags).cast(pa.string()).dictionary_encode()
    column = _columns_of(coded.dictionary)
    # Terms by column, then by name.
    rank = np.empty(len(column), np.int64)
    rank[pc.sort_indices(coded.dictionary).to_numpy()] = np.arange(len(column))
    by_column = np.lexsort((rank, column))
    number = np.empty(len(column), np.int64)
    number[by_column] = np.arange(len(column))
    term = number[coded.indices.to_numpy(zero_copy_only=False)] if len(column) else np.zeros(0, np.int64)
    doc = np.repeat(place, sizes)
    sorted_postings = np.lexsort((doc, term))
    doc = doc[sorted_postings].astype(np.int32)
    tf = pc.list_flatten(one_array(table["tfs"])).to_numpy(zero_copy_only=False)[sorted_postings].astype(np.int32)
    n = np.bincount(term, minlength=len(column))
    starts = np.concatenate(([0], np.cumsum(n)))
    names = coded.dictionary.take(pa.array(by_column))
    edges = np.searchsorted(column[by_column], np.arange(COLUMNS + 1))
    row = {"ids": one_array(table["id"]).take(pa.array(order)), "lengths": pa.array(lengths)}
    for c in range(COLUMNS):
        a, b = edges[c], edges[c + 1]
        if a == b:
            continue
        docs, tfs = doc[starts[a] : starts[b]], tf[starts[a] : starts[b]]
        firsts, _ = _cut(n[a:b])
        row[_name(c)] = {
            "terms": names.slice(a, b - a), "starts": starts[a : b + 1] - starts[a], "docs": docs, "tfs": tfs,
            "top_tf": np.maximum.reduceat(tfs, firsts), "least_length": np.minimum.reduceat(lengths[docs], firsts),
        }
    return pa.RecordBatch.from_arrays([_cell(row.get(field.name), field.type) for field in schema], schema=schema)


def _cell(value: pa.Array | np.ndarray | dict | None, kind: pa.DataType) -> pa.Array:
    """A column of one row, which holds all of ``value``."""
    if value is None:
        return pa.nulls(1, kind)
    if isinstance(value, dict):
        return pa.StructArray.from_arrays([_cell(value[field.name], field.type) for field in kind], fields=list(kind))
    values = value if isinstance(value, pa.Array) else pa.array(value)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values.cast(kind.value_type)).cast(kind)


def _segments(size: int, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            ends = np.cumsum(pc.list_value_length(batch.column("terms")).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            done = 0
            while done < batch.num_rows:
                # As many documents as fill the segment, one at least.
                before = ends[done - 1] if done else 0
                take = max(1, int(np.searchsorted(ends, before + size - n, side="right")) - done)
                held.append(batch.slice(done, take))
                done += len(held[-1])
                n += int(ends[done - 1] - before)
                if n >= size or done < batch.num_rows:
                    yield _segment(held, schema)
                    held, n = [], 0
        if held:
            yield _segment(held, schema)

    return kernel


def write_postings(corpus: DataFrame, path: str, tokenizer: Tokenizer = tokens, segment_postings: int = SEGMENT_POSTINGS) -> None:
    """Write the segments of a corpus, from its stored vectors where it has some. Nothing is shuffled."""
    vectors = corpus.select("id", "terms", "tfs", "length") if is_stored(corpus) else sparse_vectors(corpus, tokenizer=tokenizer)
    columns = ", ".join(f"{_name(c)} {_COLUMN}" for c in range(COLUMNS))
    shape = f"ids array<{vectors.schema['id'].dataType.simpleString()}>, lengths array<int>, {columns}"
    empty = vectors.sparkSession.createDataFrame([], shape).toArrow().schema
    # Sizes are looked at after every row, as one may fill a group.
    groups = {"parquet.block.size": ROW_GROUP_BYTES, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 16}
    vectors.mapInArrow(_segments(segment_postings, empty), shape).write.options(**groups).mode("overwrite").parquet(path)


def max_score(lists: list[tuple], floor: float) -> tuple[np.ndarray, np.ndarray]:
    """Documents that may score ``floor`` or more, with their scores.

    ``lists`` has, by falling bound, ``bound, block_bounds, docs, gains`` per term:
    ``gains`` tells the scores of some of its postings, ``block_bounds`` has an entry
    for each ``BLOCK`` postings. No document is in a list twice.
    """
    left = np.append(np.cumsum([one[0] for one in lists][::-1])[::-1], 0.0)
    candidates = []
    for i, (bound, block_bounds, docs, _) in enumerate(lists):
        # A document that this list is the first to hold gets no more than what is left.
        if left[i] < floor:
            break
        good = block_bounds + (left[0] - bound) >= floor
        candidates.append(docs if good.all() else docs[np.repeat(good, BLOCK)[: len(docs)]])
    found = np.unique(np.concatenate(candidates)) if candidates else np.zeros(0, np.int32)
    scores = np.zeros(len(found))
    for i, (_, _, docs, gains) in enumerate(lists):
        at = np.searchsorted(docs, found)
        held = np.flatnonzero(docs[np.minimum(at, len(docs) - 1)] == found)
        scores[held] += gains(at[held])
        keep = scores + left[i + 1] >= floor
        if not keep.all():
            found, scores = found[keep], scores[keep]
    return found, scores


def postings_top_k(
    postings: DataFrame,
    stats: DataFrame,
    queries: DataFrame,
    k: int,
    params: Bm25 = Bm25(),
    query_weight: str = "distinct",
    tokenizer: Tokenizer = tokens,
    terms_per_block: int = TERMS_PER_BLOCK,
) -> DataFrame:
    """The hits of ``sparse_top_k``, from the segments and the statistics of the same corpus."""
    read, count, weigh, mean_length = asked_terms(queries, stats, query_weight, terms_per_block, tokenizer)
    schema = hits_type(queries.schema["query_id"].dataType, postings.schema["ids"].dataType.elementType)
    k1, b = params.k1, params.b

    def side(table: pa.Table) -> dict:
        query_codes = one_array(table["query_id"]).dictionary_encode()
        term_codes = one_array(table["term"]).cast(pa.string()).dictionary_encode()
        queries_of = query_codes.indices.to_numpy()
        order = np.argsort(queries_of, kind="stable")
        column = _columns_of(term_codes.dictionary)
        return {
            "query_ids": query_codes.dictionary,
            "start": np.searchsorted(queries_of[order], np.arange(len(query_codes.dictionary) + 1)),
            "term": term_codes.indices.to_numpy()[order],
            "weight": weigh(table)[order],
            # The asked terms of each column, and their numbers.
            "columns": {int(c): (term_codes.dictionary.take(pa.array(own)), own) for c in np.unique(column) for own in [np.flatnonzero(column == c)]},
        }

    def corpus(wanted: list[dict]) -> DataFrame:
        return postings.select("ids", "lengths", *[_name(c) for c in sorted({c for one in wanted for c in one})])

    def gain(tf: np.ndarray, length: np.ndarray) -> np.ndarray:
        return tf * (k1 + 1.0) / (tf + k1 * (1.0 - b + b * length / mean_length))

    def score(side: dict, best: RunningBest, batch: pa.RecordBatch) -> None:
        for row in range(batch.num_rows):
            lists = _asked_lists(batch, row, side["columns"], gain)
            ids = batch.column("ids")[row].values
            for query in range(len(side["query_ids"])):
                own = slice(side["start"][query], side["start"][query + 1])
                met = [(lists[t], w) for t, w in zip(side["term"][own].tolist(), side["weight"][own].tolist(), strict=True) if t in lists]
                if not met:
                    continue
                weighted = sorted(
                    ((w * one[0], w * one[1], one[2], lambda at, one=one, w=w: w * one[3](at)) for one, w in met), key=lambda one: -one[0]
                )
                top = best.top.get(query)
                floor = top[0] if top is not None and len(top) == k else 0.0
                docs, scores = max_score(weighted, floor - _SLACK)
                scores = np.round(scores, SCORE_DIGITS)
                keep = (scores > 0) & (scores >= floor)
                docs, scores = docs[keep], scores[keep]
                if len(docs):
                    best.offer(np.full(len(docs), query), scores, ids, docs)
                    best.top[query] = np.sort(scores if top is None else np.concatenate((top, scores)))[-k:]

    found = scan_blocks(corpus, read, count, side, score, k, schema)
    return no_hits(postings, schema) if found is None else found


def _asked_lists(batch: pa.RecordBatch, row: int, columns: dict, gain: Callable) -> dict[int, tuple]:
    """By number of the asked term: its largest gain in a segment, those of its blocks, its documents, and the gains of some of its postings."""
    lengths = batch.column("lengths")[row].values.to_numpy(zero_copy_only=False)
    out = {}
    for c, (terms, numbers) in columns.items():
        cell = batch.column(_name(c)).slice(row, 1)
        if not cell.is_valid()[0].as_py():
            continue
        part = {name: cell.field(name)[0].values for name in ("terms", "starts", "docs", "tfs", "top_tf", "least_length")}
        at = pc.index_in(terms, value_set=part["terms"])
        known = pc.is_valid(at).to_numpy(zero_copy_only=False)
        if not known.any():
            continue
        starts, docs, tfs, top_tf, least = (part[name].to_numpy() for name in ("starts", "docs", "tfs", "top_tf", "least_length"))
        _, first_block = _cut(np.diff(starts))
        for number, place in zip(numbers[known].tolist(), pc.drop_null(at).to_pylist(), strict=True):
            own, blocks = slice(starts[place], starts[place + 1]), slice(first_block[place], first_block[place + 1])
            bounds = gain(top_tf[blocks].astype(float), least[blocks])
            own_docs, own_tfs = docs[own], tfs[own]

            def gains(at: np.ndarray, docs: np.ndarray = own_docs, tfs: np.ndarray = own_tfs) -> np.ndarray:
                return gain(tfs[at].astype(float), lengths[docs[at]])

            out[number] = (float(bounds.max()), bounds, own_docs, gains)
    return out
