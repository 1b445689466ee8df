"""Passages of held-out texts inside a corpus, by a distributed positional inverted index.

The corpus is indexed in segments, each holding the positional postings of a bounded number of words of whole
documents. A segment is built and searched by one task, so neither shuffles the corpus; only the frequencies of terms
are gathered. A search intersects lists shifted by their offsets, from the rarest terms of each stretch of a test
item, and then compares item and document word by word around the diagonals found.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfold.llm import words as _words
from tallyfold.llm.words import words
from tallyfold.session import sent_by_value, settings, stored

sent_by_value(__name__)
sent_by_value(_words.__name__)

#: Words after which a segment is closed. A longer document is cut into pieces that overlap by so many words.
SEGMENT_WORDS, OVERLAP_WORDS = 250_000, 2_000
#: Words of test items that are broadcast at once. More items are searched in blocks, each against all segments.
BLOCK_WORDS = 1_000_000
#: Documents, and segments, that are handed to a Python worker at once: what a task holds must not grow with its share of the input.
BATCH_DOCUMENTS, BATCH_SEGMENTS = 500, 1
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _segment(docs: list, firsts: list[int], texts: list[np.ndarray], vocabulary: list[str]) -> dict:
    """Postings of one segment: the lists of all terms one after the other, each by document and position."""
    lengths = np.array([len(t) for t in texts])
    term, row = np.concatenate(texts), np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    position = (np.arange(len(term)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32)
    order = np.argsort(term, kind="stable")
    return {
        "docs": docs, "firsts": np.array(firsts, np.int64), "lengths": lengths.astype(np.int32), "terms": vocabulary,
        "counts": np.bincount(term, minlength=len(vocabulary)).astype(np.int32), "rows": row[order], "positions": position[order],
    }


def _numbering() -> defaultdict:
    """Numbers of words; a new word takes the next one."""
    ids: defaultdict = defaultdict()
    ids.default_factory = ids.__len__
    return ids


def build_index(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The stored index of all words: one row per segment with ``docs, firsts, lengths, terms, counts, rows, positions``.

    List i belongs to ``terms[i]``, has ``counts[i]`` postings and follows list i - 1 in ``rows`` (which document of the
    segment) and ``positions`` (which word of it, counted from ``firsts``). It knows nothing of what will be searched.
    Rows without id or text are left out, repeated rows are indexed each. Whole texts, however long: one of more than
    ``SEGMENT_WORDS`` words stands in several segments, whose pieces overlap by ``OVERLAP_WORDS``.
    """
    kind, most, overlap = docs.schema[doc_id].dataType, SEGMENT_WORDS, min(OVERLAP_WORDS, SEGMENT_WORDS // 2)

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, held, firsts, texts, size = _numbering(), [], [], [], 0
        for batch in batches:
            for doc, t in zip(batch["doc"], batch["text"], strict=True):
                ws = words(t)
                for first in range(0, max(len(ws) - overlap, 1), most - overlap):
                    piece = ws[first : first + most] if len(ws) > most else ws
                    held.append(doc)
                    firsts.append(first)
                    texts.append(np.fromiter(map(ids.__getitem__, piece), np.int32, len(piece)))
                    size += len(piece)
                    if size >= most:
                        yield pd.DataFrame([_segment(held, firsts, texts, list(ids))])
                        ids, held, firsts, texts, size = _numbering(), [], [], [], 0
                    if len(ws) <= most:
                        break
        if size:
            yield pd.DataFrame([_segment(held, firsts, texts, list(ids))])

    numbers = T.ArrayType(T.IntegerType())
    schema = T.StructType([
        T.StructField("docs", T.ArrayType(kind)), T.StructField("firsts", T.ArrayType(T.LongType())), T.StructField("lengths", numbers), T.StructField("terms", T.ArrayType(T.StringType())),
        T.StructField("counts", numbers), T.StructField("rows", numbers), T.StructField("positions", numbers),
    ])
    rows = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("doc"), F.col(text).alias("text"))
    with settings(docs.sparkSession, {_BATCH: str(BATCH_DOCUMENTS)}):
        # a row group of its own for each segment, so that writers and readers hold one at a time
        return stored(rows.mapInPandas(build, schema), "postings", {"parquet.block.row.count.limit": "1"})


def term_frequencies(index: DataFrame) -> DataFrame:
    """``term, n``: how often each term occurs in the whole corpus; combined on the map side."""
    lists = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("z"))
    return lists.groupBy(F.col("z.terms").alias("term")).agg(F.sum("z.counts").alias("n"))


def _anchors(item: list[str], frequency: dict[str, int], run: int) -> list[tuple[int, int]]:
    """The spots of the rarest and second rarest word of every run of an item that can occur, each pair once."""
    rare = [frequency.get(w, 0) for w in item]
    found = set()
    for start in range(len(item) - run + 1):
        order = sorted(range(start, start + run), key=lambda i: (rare[i], i))
        if rare[order[0]] > 0:
            found.add((order[0], order[min(1, run - 1)]))
    return sorted(found)


def _runs(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each spot the length of the run of equal words that ends there, and of the one that starts there."""
    at = np.arange(1, len(same) + 1)
    ending = at - np.maximum.accumulate(np.where(same, 0, at))
    back = at - np.maximum.accumulate(np.where(same[::-1], 0, at))
    return ending, back[::-1]


def best_stretch(item: np.ndarray, doc: np.ndarray, shift: int, edits: int) -> tuple[int, int]:
    """The longest stretch of item words around a diagonal, with at most ``edits`` (0 or 1) words inside altered, left
    out or added, as (number of words, spot of its last word before the edit)."""
    n = len(item)
    ends, starts = {}, {}
    for d in (shift - 1, shift, shift + 1):
        place = np.arange(n) + d
        inside = (place >= 0) & (place < len(doc))
        ends[d], starts[d] = _runs(inside & (item == doc[np.clip(place, 0, max(len(doc) - 1, 0))]))
    best, spot = int(ends[shift].max()), int(ends[shift].argmax())
    if edits:
        # (diagonal of the first run, of the second, words between them in the item): altered, left out, added
        for a, b, skip in ((shift, shift, 1), (shift, shift - 1, 1), (shift + 1, shift, 1), (shift, shift + 1, 0), (shift - 1, shift, 0)):
            first, second = ends[a][: n - 1 - skip], starts[b][1 + skip :]
            total = np.where((first > 0) & (second > 0), first + skip + second, 0)
            if len(total) and total.max() > best:
                best, spot = int(total.max()), int(total.argmax())
    return best, spot


def _run_around(item: np.ndarray, doc: np.ndarray, spot: int, shift: int, run: int) -> bool:
    """Whether ``run`` words in a row, the one at ``spot`` among them, are equal on a diagonal."""
    lo, hi = max(0, spot - run + 1, -shift), min(len(item), spot + run, len(doc) - shift)
    if hi - lo < run or not lo <= spot < hi:
        return False
    same = (item[lo:hi] == doc[lo + shift : hi + shift]).tobytes()
    left, right = same[: spot - lo + 1], same[spot - lo + 1 :]
    back = len(left) - len(left.rstrip(b"\x01"))
    return back > 0 and back + len(right) - len(right.lstrip(b"\x01")) >= run


def _search(segment: dict, items: list[tuple], plans: dict, length: int, edits: int) -> list[tuple]:
    """Matches of one block of items in one segment: (document row, item number, words, spot, position)."""
    run = -(-(length - edits) // (edits + 1))
    place = {t: i for i, t in enumerate(segment["terms"])}
    counts, rows, positions = (np.asarray(segment[k], np.int32) for k in ("counts", "rows", "positions"))
    ends = np.cumsum(counts, dtype=np.int64)
    wide = np.int64(1) << 32
    starts: dict[int, dict] = {}

    def shifted(word: str, spot: int) -> np.ndarray | None:
        i = place.get(word)
        if i is None:
            return None
        part = slice(ends[i] - counts[i], ends[i])
        return rows[part].astype(np.int64) * wide + positions[part] + ((1 << 20) - spot)

    for (word_a, word_b, gap), users in plans.items():
        a = shifted(word_a, 0)
        b = shifted(word_b, gap) if a is not None else None
        if b is None:
            continue
        for key in np.intersect1d(a, b, assume_unique=True):
            for number, spot in users:
                diagonal = (number, int(key & (wide - 1)) - (1 << 20) - spot)
                starts.setdefault(int(key >> 32), {}).setdefault(diagonal, []).append(spot)
    if not starts:
        return []
    # the documents concerned, written out again from their postings
    chosen = np.zeros(len(segment["docs"]), bool)
    chosen[list(starts)] = True
    kept = chosen[rows]
    term = np.repeat(np.arange(len(counts), dtype=np.int32), counts)[kept]
    row, position = rows[kept], positions[kept]
    order = np.lexsort((position, row))
    term, row, position = term[order], row[order], position[order]
    found, coded = [], {}
    for r, diagonals in starts.items():
        lo, hi = np.searchsorted(row, [r, r + 1])
        doc = np.full(int(segment["lengths"][r]), -1)
        doc[position[lo:hi]] = term[lo:hi]
        for (number, shift), spots in diagonals.items():
            if number not in coded:
                coded[number] = np.array([place.get(w, -2) for w in items[number][1]])
            item = coded[number]
            # the run in which the two words were the rarest must be there
            if not any(_run_around(item, doc, spot, shift, run) for spot in spots):
                continue
            n, spot = best_stretch(item, doc, shift, edits)
            if n >= length:
                found.append((r, number, n, spot, spot + shift))
    return found


def passages(index: DataFrame, items: list[tuple], frequency: dict[str, int], item_type: T.DataType, length: int, edits: int = 1) -> DataFrame:
    """Stretches of at least ``length`` successive words of an item that a document holds, exactly or (``edits=1``) with
    one word inside altered, left out or added: ``doc, item, n_words, spot, position``, the longest of each diagonal.

    Some exact run of half the unaltered words is in every such stretch, so a document is a candidate where the two
    rarest words of such a run stand at the right distance. ``items`` are (id, words) of one block. Every candidate is
    compared, every match returned; a segment is searched by one task and nothing is shuffled. The block and its plan are a
    broadcast variable. Of a document cut into pieces, a stretch longer than their overlap may be told in parts.
    """
    if edits not in (0, 1):
        raise ValueError("edits must be 0 or 1")
    run = -(-(length - edits) // (edits + 1))
    plans: dict[tuple[str, str, int], list[tuple[int, int]]] = {}
    for number, (_, ws) in enumerate(items):
        if len(ws) >= length:
            for a, b in _anchors(ws, frequency, run):
                plans.setdefault((ws[a], ws[b], b - a), []).append((number, a))

    sent = index.sparkSession.sparkContext.broadcast((items, plans))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items, plans = sent.value
        for batch in batches:
            for segment in batch.to_dict("records"):
                found = _search(segment, items, plans, length, edits)
                if found:
                    r, number, n, spot, position = zip(*found, strict=True)
                    yield pd.DataFrame({
                        "doc": [segment["docs"][i] for i in r], "item": [items[i][0] for i in number],
                        "n_words": np.array(n, np.int32), "spot": np.array(spot, np.int32), "position": np.array(position, np.int64) + segment["firsts"][list(r)],
                    })

    kind = index.schema["docs"].dataType.elementType
    schema = T.StructType([T.StructField("doc", kind), T.StructField("item", item_type), *[T.StructField(c, T.IntegerType()) for c in ("n_words", "spot")], T.StructField("position", T.LongType())])
    return index.mapInPandas(search, schema)


def _blocks(rows: Iterator, most: int) -> Iterator[list[tuple]]:
    """Test items as (id, words), in blocks of at most ``most`` words."""
    block, size = [], 0
    for r in rows:
        ws = words(r["text"])
        if block and size + len(ws) > most:
            yield block
            block, size = [], 0
        block.append((r["item"], ws))
        size += len(ws)
    if block:
        yield block


def leaked_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", length: int = 16, edits: int = 1, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents that hold a passage of a test item, and the item: ``doc_id, item_id``, distinct.

    The corpus is indexed once, with all its words; items are read in blocks of ``block_words`` words, and each block is
    searched against every segment; the pairs that a block finds are stored. Items shorter than
    ``length`` words are in no pair, nor are NULL or empty texts and NULL ids; repeated rows change nothing; extra columns are ignored; an empty
    table gives an empty result.
    """
    chosen = items.where(F.col(item_id).isNotNull() & F.col(text).isNotNull()).select(F.col(item_id).alias("item"), F.col(text).alias("text")).distinct()
    item_type = items.schema[item_id].dataType
    index = build_index(docs, doc_id, text)
    frequencies = stored(term_frequencies(index), "frequencies")
    found = None
    for block in _blocks(chosen.toLocalIterator(), block_words):
        mine = sorted({w for _, ws in block for w in ws})
        wanted = frequencies.join(F.broadcast(docs.sparkSession.createDataFrame([(w,) for w in mine], "term string")), "term", "left_semi")
        part = passages(index, block, {r["term"]: r["n"] for r in wanted.toLocalIterator()}, item_type, length, edits)
        with settings(docs.sparkSession, {_BATCH: str(BATCH_SEGMENTS)}):
            part = stored(part.select("doc", "item").distinct(), "leaked")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = passages(index.limit(0), [], {}, item_type, length, edits)
    return found.select(F.col("doc").alias(doc_id), F.col("item").alias(item_id)).distinct()
