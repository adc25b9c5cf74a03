"""Benchmark decontamination over a distributed positional inverted index.

Documents are cut into segments of a bounded number of tokens. Each segment is an index of its own,
stored as rows (segment, term, positions) plus one row of its documents and their first positions.
A phrase's lists are intersected from its rarest term on (by frequency over the whole corpus), each
shifted by the term's offset in the phrase. Phrases are grouped by their rarest term once on the
driver, so that a segment looks only at those whose rarest term it holds. `find_passages` gives
exact phrase matches, `find_near` proximity matches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_BYTES, discarded, fresh, released, rows_of, written

#: Tokens in a segment, but for a longer document, which is a segment alone.
SEGMENT_TOKENS = 1_000_000
#: Characters of phrase items that one pass holds; more items are done in further passes.
PASS_CHARS = 16_000_000
WINDOW = 10

#: A-Z to a-z; 0-9, a-z and all bytes of non-ASCII characters stay; the rest becomes a space.
_WORD_BYTES = bytes(LOWER_BYTES[i] if i >= 128 or chr(i).isalnum() else 32 for i in range(256))


def tokens(text: str | None) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z; null has none."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


def build_index(docs: DataFrame, segment_tokens: int = SEGMENT_TOKENS) -> DataFrame:
    """Rows (segment, term, n, doc_ids, positions): a term's positions in its segment, ascending.

    The row of a null term holds the segment's doc_ids and the position of each one's first word.
    Documents without words have a place there too. Positions run on over the segment, one
    position is left free between documents, so that no phrase crosses them.
    """

    def run(batches):
        released()
        ids: list = []
        words: list[list[bytes]] = []
        held = made = 0

        def flush() -> Iterator[pa.RecordBatch]:
            starts = np.zeros(len(words), np.int64)
            np.cumsum([len(w) + 1 for w in words[:-1]], out=starts[1:])
            code: dict[bytes, int] = {}
            flat = np.fromiter((code.setdefault(w, len(code)) for doc in words for w in doc), np.int32, held)
            at = np.concatenate([s + np.arange(len(w)) for s, w in zip(starts, words, strict=True)]).astype(np.int32)
            order = np.argsort(flat, kind="stable")
            sizes = np.bincount(flat, minlength=len(code))
            segment = (TaskContext.get().partitionId() << 32) + made
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(at[order]))
            terms = pa.array([w.decode("utf-8", "surrogatepass") for w in code], pa.string())
            first = pa.record_batch([pa.array([segment]), pa.nulls(1, pa.string()), pa.array([held]), pa.array([ids], pa.list_(pa.int64())), pa.array([starts.tolist() + [int(starts[-1]) + len(words[-1]) + 1]], pa.list_(pa.int32()))], names=names)
            yield first
            for k in range(0, len(code), 5000):
                part = terms.slice(k, 5000)
                yield pa.record_batch([pa.array(np.full(len(part), segment)), part, pa.array(sizes[k : k + 5000]), pa.nulls(len(part), pa.list_(pa.int64())), lists.slice(k, 5000)], names=names)

        for _, (doc_ids, texts) in rows_of(batches, "doc_id", "text"):
            for i, text in zip(doc_ids, texts, strict=True):
                found = tokens(text)
                if ids and (held + len(found) > segment_tokens or len(ids) >= 100_000):
                    yield from flush()
                    ids, words, held, made = [], [], 0, made + 1
                ids.append(i)
                words.append(found)
                held += len(found)
        if ids:
            yield from flush()

    names = ["segment", "term", "n", "doc_ids", "positions"]
    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "segment long, term string, n long, doc_ids array<long>, positions array<int>")
    return written(rows, "phrase-index")


#: A phrase or a set of terms with the place of each, rarest first, and the items that ask for it.
Asked = tuple[list[tuple[str, int]], int, list[int]]


def rarest_first(phrases: dict[tuple[str, ...], list[int]], frequency: dict[str, int]) -> dict[str, list[Asked]]:
    """By rarest term: (terms with their offsets in order of frequency, length, owners); phrases with a term that no document has are left out."""
    groups: dict[str, list[Asked]] = {}
    for phrase, owners in phrases.items():
        if all(w in frequency for w in phrase):
            order = sorted(range(len(phrase)), key=lambda i: (frequency[phrase[i]], i))
            groups.setdefault(phrase[order[0]], []).append(([(phrase[i], i) for i in order], len(phrase), owners))
    return groups


class Segment:
    """One segment's lists in memory, and the position of each document's first word: exact phrase and proximity matches."""

    def __init__(self, lists: dict[str, np.ndarray], starts: np.ndarray):
        self.lists, self.starts = lists, starts

    def phrase(self, terms: list[tuple[str, int]]) -> np.ndarray:
        """Positions at which a phrase starts, given as its terms and their offsets, rarest first."""
        if any(w not in self.lists for w, _ in terms):
            return np.empty(0, np.int64)
        found = self.lists[terms[0][0]].astype(np.int64) - terms[0][1]
        for w, i in terms[1:]:
            if not len(found):
                break
            there, want = self.lists[w], found + i
            k = np.searchsorted(there, want)
            found = found[(k < len(there)) & (there[np.minimum(k, len(there) - 1)] == want)]
        return found

    def near(self, terms: list[tuple[str, int]], within: int) -> np.ndarray:
        """Positions of the rarest term around which every other term occurs at most `within` words away in the same document."""
        if any(w not in self.lists for w, _ in terms):
            return np.empty(0, np.int64)
        found = self.lists[terms[0][0]].astype(np.int64)
        doc = np.searchsorted(self.starts, found, "right") - 1
        low, high = np.maximum(found - within, self.starts[doc]), np.minimum(found + within, self.starts[doc + 1] - 1)
        for w, _ in terms[1:]:
            there = self.lists[w]
            k = np.searchsorted(there, low)
            keep = (k < len(there)) & (there[np.minimum(k, len(there) - 1)] <= high)
            found, low, high = found[keep], low[keep], high[keep]
        return found


def windows(words: list[bytes], size: int = WINDOW) -> list[tuple[str, ...]]:
    """All runs of `size` words, each once; a shorter item is one window, an item without words has none."""
    words = [w.decode("utf-8", "surrogatepass") for w in words]
    return list(dict.fromkeys(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))) if words else []


def _passes(items: DataFrame, most: int) -> Iterator[list[tuple[int, str]]]:
    """The items (item_id, text) in lists of about `most` characters; they are read part by part."""
    held, size = [], 0
    for r in items.where("item_id IS NOT NULL").select(F.col("item_id").cast("long"), "text").toLocalIterator():
        if held and size + len(r.text or "") > most:
            yield held
            held, size = [], 0
        held.append((r.item_id, r.text))
        size += len(r.text or "")
    yield held


def _asked(index: DataFrame, phrases: dict[tuple[str, ...], list[int]], match: Callable, schema: str) -> tuple[DataFrame, Callable[[], None]]:
    """match(segment, groups, segment's id, doc_ids) over every segment, as rows of the schema, and what frees the pass's broadcast."""
    spark = index.sparkSession
    vocabulary = spark.createDataFrame([(w,) for w in sorted({w for phrase in phrases for w in phrase})] + [(None,)], "asked string")
    # bounded by the characters of one pass; the null term brings the documents' rows
    lists = index.join(F.broadcast(vocabulary), F.col("term").eqNullSafe(F.col("asked")), "left_semi")
    counts = lists.where("term IS NOT NULL").groupBy("term").agg(F.sum("n").alias("n"))
    groups = spark.sparkContext.broadcast(rarest_first(phrases, {r.term: r.n for r in counts.toLocalIterator()}))

    def search(t: pa.Table) -> pa.Table:
        released()
        terms, lists, starts, ids = t.column("term").to_pylist(), {}, None, []
        positions = t.column("positions").combine_chunks()
        for i, term in enumerate(terms):
            if term is None:
                starts, ids = positions[i].values.to_numpy(), t.column("doc_ids")[i].as_py()
            else:
                lists[term] = positions[i].values.to_numpy()
        # the groups that this segment's lists call up, or all of them where these are fewer
        few = [g for w, g in groups.value.items() if w in lists] if len(groups.value) < len(lists) else [groups.value[w] for w in lists if w in groups.value]
        return match(Segment(lists, starts), few, t.column("segment")[0].as_py(), ids)

    return lists.groupBy("segment").applyInArrow(search, schema), groups.unpersist


#: Per document: words inside any window's occurrence as [start, end) pairs, and item ids found.
_FOUND = "segment long, place int, doc_id long, n_words long, hits array<array<int>>, items array<long>"


def _passages(segment: Segment, groups: list[list[Asked]], segment_id: int, ids: list) -> pa.Table:
    starts = segment.starts
    hits, items = [[] for _ in ids], [set() for _ in ids]
    for group in groups:
        for terms, size, owners in group:
            for p in segment.phrase(terms).tolist():
                d = int(np.searchsorted(starts, p, "right")) - 1
                hits[d].append((p - int(starts[d]), p - int(starts[d]) + size))
                items[d].update(owners)
    return pa.table(
        {
            "segment": pa.array([segment_id] * len(ids), pa.int64()),
            "place": pa.array(range(len(ids)), pa.int32()),
            "doc_id": pa.array(ids, pa.int64()),
            "n_words": pa.array(np.diff(starts) - 1, pa.int64()),
            "hits": pa.array([_merged(h) for h in hits], pa.list_(pa.list_(pa.int32()))),
            "items": pa.array([sorted(x) for x in items], pa.list_(pa.int64())),
        }
    )


def _by_pass(index: DataFrame, items: DataFrame, pass_chars: int, phrases_of: Callable, match: Callable, schema: str) -> list[DataFrame]:
    """The passes' rows. A single pass is left to run with what follows; of several each is written before the next is built."""
    parts: list[DataFrame] = []
    passes = _passes(items, pass_chars)
    some = next(passes)
    while some is not None:
        phrases: dict[tuple[str, ...], list[int]] = {}
        for item_id, text in some:
            for phrase in phrases_of(text):
                phrases.setdefault(phrase, []).append(item_id)
        found, free = _asked(index, phrases, match, schema)
        some = next(passes, None)
        if some is not None or parts:
            found = written(found, "phrase-pass")
            free()
        parts.append(found)
    return parts


def _merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def find_passages(docs: DataFrame, items: DataFrame, size: int = WINDOW, segment_tokens: int = SEGMENT_TOKENS, pass_chars: int = PASS_CHARS) -> DataFrame:
    """(doc_id, n_words, hits, items) per row of docs: merged word spans [start, end) that occur in items' windows, and these items' ids.

    Items (item_id, text) without words or with null ids find nothing. All documents have a row,
    those without words too; equal rows stay. Other columns are not looked at.
    """
    index = build_index(docs, segment_tokens)
    parts = _by_pass(index, items, pass_chars, lambda text: windows(tokens(text), size), _passages, _FOUND)
    if len(parts) == 1:
        return parts[0].drop("segment", "place")
    discarded(index)
    both = F.flatten(F.collect_list("hits")).alias("hits"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")
    found = reduce(DataFrame.union, parts).groupBy("segment", "place").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), *both)

    def merge(batches):
        for b in batches:
            yield b.set_column(2, "hits", pa.array([_merged([tuple(x) for x in h]) for h in b.column("hits").to_pylist()], pa.list_(pa.list_(pa.int32()))))

    return found.drop("segment", "place").mapInArrow(merge, "doc_id long, n_words long, hits array<array<int>>, items array<long>")


def find_near(docs: DataFrame, items: DataFrame, within: int = WINDOW, segment_tokens: int = SEGMENT_TOKENS, pass_chars: int = PASS_CHARS) -> DataFrame:
    """(doc_id, item_id, positions): where an item's words, each once, occur close together in a document.

    positions are word places, from 0, of the item's rarest word around which all its other words
    occur at most `within` words away. Items without words or with null ids find nothing; a null
    text has no words; equal rows of docs give equal rows; no match, no row.
    """
    schema = "doc_id long, item_id long, positions array<int>"

    def match(segment: Segment, groups: list[list[Asked]], _: int, ids: list) -> pa.Table:
        rows = []
        for group in groups:
            for terms, _, owners in group:
                found = segment.near(terms, within)
                if len(found):
                    docs_of = np.searchsorted(segment.starts, found, "right") - 1
                    for d in np.unique(docs_of):
                        places = (found[docs_of == d] - segment.starts[d]).tolist()
                        rows += [(ids[d], owner, places) for owner in owners]
        doc_ids, item_ids, places = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.table({"doc_id": pa.array(doc_ids, pa.int64()), "item_id": pa.array(item_ids, pa.int64()), "positions": pa.array(places, pa.list_(pa.int32()))})

    def terms_of(text: str | None) -> list[tuple[str, ...]]:
        words = tuple(sorted({w.decode("utf-8", "surrogatepass") for w in tokens(text)}))
        return [words] if words else []

    return reduce(DataFrame.union, _by_pass(build_index(docs, segment_tokens), items, pass_chars, terms_of, match, schema))


def contamination_digest(docs: DataFrame, items: DataFrame, pass_chars: int = PASS_CHARS) -> DataFrame:
    """The query's rows: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = find_passages(docs, items, pass_chars=pass_chars)
    hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, x: n + (x[1] - x[0]).cast("long"))
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


def clean_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The input's rows and columns without documents in which a window of an item occurs.

    Rows with a null doc_id all stay: they can't be named. Repeated rows share their fate, columns of
    any name stay as they are; no rows give none, no items drop nothing.
    """
    (gone_id,) = fresh(docs, "gone")
    gone = find_passages(docs, items).where(F.size("hits") > 0).select(F.col("doc_id").alias(gone_id)).distinct()
    return docs.join(gone, F.col("doc_id") == F.col(gone_id), "left_anti")
