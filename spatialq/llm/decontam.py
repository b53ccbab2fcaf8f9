"""Benchmark decontamination over a distributed positional inverted index.

``build_index`` cuts the documents into blocks and stores, for each term and block, the
places of the term as offset-coded positions. ``find_phrases`` takes each test phrase's
terms from the rarest on and intersects their lists, shifted by the terms' offsets;
``find_near`` returns places where all terms of a phrase stand within a span.
``contamination`` turns matches into the share of a document's words that they cover.

Every term of the training texts is stored, so one index serves any test set. A term of a
third of all documents has one list in every block, so no task reads a term's whole list.
A block is bounded in bytes (a longer document is a block alone). A search reads only the
lists of its phrases' terms.

Defined results: null or empty texts have no words; a very long text is one block; items
without words match nothing; repeated rows count as documents of their own; terms of equal
counts are taken by name; an empty benchmark leaves every document clean; an empty table
gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, column, pick, scratch, utf8, written

#: Bytes that are not words become blanks, A-Z become lower case; bytes from 0x80 on are word bytes.
FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
INDEX_SCHEMA = "block long, term string, n long, places binary"
DOC_MARK = ""  # the row of a block that lists its documents
NO_KEY = -(1 << 62)  # stands for a null doc_id


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def encode_lists(places: np.ndarray, heads: np.ndarray) -> pa.Array:
    """One binary for each list of ascending places, which begin at heads: a width mark, the first value and gaps."""
    n = np.diff(np.append(heads, len(places)))
    gaps = np.diff(places, prepend=0)
    gaps[heads] = places[heads]
    width = 2 if int(gaps.max(initial=0)) < 1 << 16 else 4 if int(gaps.max(initial=0)) < 1 << 32 else 8
    offsets = np.concatenate([[0], np.cumsum(1 + width * n)])
    flat, value = np.empty(int(offsets[-1]), np.uint8), np.ones(int(offsets[-1]), bool)
    flat[offsets[:-1]], value[offsets[:-1]] = ord(str(width)), False
    flat[value] = gaps.astype(f"<u{width}").view(np.uint8)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(flat)]).cast(pa.binary())


def decode_places(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, f"<u{data[:1].decode()}", offset=1).astype(np.int64))


@dataclass(frozen=True)
class Index:
    """A stored index; each ``rows`` call is a scan of its own, so that rows can be joined with themselves."""

    spark: SparkSession
    path: str

    def rows(self) -> DataFrame:
        return self.spark.read.schema(INDEX_SCHEMA).parquet(self.path)

    def lists(self, wanted: DataFrame) -> DataFrame:
        """The posting lists of the terms of wanted(term)."""
        return self.rows().filter(F.col("term") != DOC_MARK).join(wanted, "term", "left_semi").select(*self.rows().columns)

    def marks(self) -> DataFrame:
        return self.rows().filter(F.col("term") == DOC_MARK)


def build_index(docs: DataFrame, path: str, block_bytes: int = 4 << 20) -> Index:
    """Write the index as a Parquet table, terms in order within a block.

    A place counts words from the block's start; the block's DOC_MARK row has the
    doc_ids and word counts, which tell where each document begins.
    """

    def index(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        serial = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids = column(batch, "doc_id")
            data, offs = utf8(column(batch, "text"))
            for lo, hi in blocks(offs, block_bytes):
                text = data[offs[lo] : offs[hi]].tobytes().translate(FOLD)
                cuts = (offs[lo : hi + 1] - offs[lo]).tolist()
                split = [text[a:b].split() for a, b in zip(cuts, cuts[1:], strict=False)]
                counts = np.array([len(w) for w in split], np.int64)
                terms = sorted(set().union(*split))
                code = {w: i for i, w in enumerate(terms)}
                codes = np.concatenate([np.fromiter(map(code.__getitem__, ws), np.int64, len(ws)) for ws in split])
                order = np.argsort(codes, kind="stable")
                heads = np.flatnonzero(np.diff(codes[order], prepend=-1))
                keys = np.array([NO_KEY if k is None else k for k in ids.slice(lo, hi - lo).to_pylist()], "<i8")
                mark = np.stack([keys, counts.astype("<i8")]).tobytes()
                for names, n, places in (
                    ([DOC_MARK], np.array([hi - lo]), pa.array([mark], pa.binary())),
                    ([w.decode("utf-8", "replace") for w in terms], np.diff(np.append(heads, len(order))), encode_lists(order, heads)),
                ):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(names), serial, np.int64)), pa.array(names, pa.string()), pa.array(n.astype(np.int64)), places], names=["block", "term", "n", "places"])
                serial += 1

    out = pick(docs, "doc_id", "text").mapInArrow(index, INDEX_SCHEMA)
    out.write.option("compression", "zstd").parquet(path)
    return Index(docs.sparkSession, path)


def terms_of(phrases: DataFrame) -> DataFrame:
    return phrases.select(F.explode("terms").alias("term")).distinct()


def phrase_table(benchmark: DataFrame) -> DataFrame:
    """(phrase, terms): the words of each item that has any, under its id as text."""
    raw = pick(benchmark, "item_id", "text").select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("phrase"), "text")
    fold = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = F.filter(F.split(fold, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")
    return raw.select("phrase", terms.alias("terms")).filter(F.size("terms") > 0)


def ranked_phrases(index: Index, phrases: DataFrame, size: int | None) -> DataFrame:
    """phrases with ``counts`` of their terms in the index and ``rare``, the rarest term of each window."""
    counts = index.lists(terms_of(phrases)).groupBy("term").agg(F.sum("n").alias("n"))
    numbered = phrases.withColumn("row", F.monotonically_increasing_id())
    one = numbered.select("row", "phrase", F.posexplode("terms").alias("offset", "term"))
    whole = (
        one.join(counts, "term", "left")
        .groupBy("row", "phrase")
        .agg(F.sort_array(F.collect_list(F.struct("offset", "term", F.coalesce("n", F.lit(0)).alias("n")))).alias("t"))
        .select("phrase", F.col("t.term").alias("terms"), F.col("t.n").alias("counts"))
    )
    pairs = F.arrays_zip(F.col("counts"), F.col("terms"))
    long = F.size("terms") if size is None else F.least(F.lit(size), F.size("terms"))
    starts = F.sequence(F.lit(1), F.size("terms") - long + 1)
    rare = F.array_distinct(F.transform(starts, lambda k: F.array_min(F.slice(pairs, k, long))["terms"]))
    return whole.withColumn("rare", rare)


MATCH_SCHEMA = "block long, phrase string, start long, length long"


def search(index: Index, phrases: DataFrame, size: int | None, within: int | None) -> DataFrame:
    """Matches (block, phrase, start, length) in all blocks.

    A phrase visits the blocks that hold the rarest term of one of its windows. With
    within=None a match is an occurrence of any window of ``size`` words (None: of the
    whole phrase); else, for each occurrence of the rarest term, the least span that
    holds all terms in any order, if that is at most ``within`` words.
    """
    ranked = ranked_phrases(index, phrases, size)
    where = index.lists(terms_of(phrases)).select("block", "term")
    visits = (
        ranked.select("phrase", "terms", "counts", F.explode("rare").alias("term"))
        .join(where, "term").select("block", "phrase", "terms", "counts").distinct()
    )

    def match(key: tuple, lists: pa.Table, wanted: pa.Table) -> pa.Table:
        coded = dict(zip(lists.column("term").to_pylist(), lists.column("places").to_pylist(), strict=True))
        docs = np.frombuffer(coded.pop(DOC_MARK), "<i8").reshape(2, -1)
        edges = np.concatenate([[0], np.cumsum(docs[1])])
        ready: dict[str, np.ndarray] = {}

        def places(term: str) -> np.ndarray | None:
            if term not in ready and term in coded:
                ready[term] = decode_places(coded[term])
            return ready.get(term)

        out: list[tuple[str, int, int]] = []
        for phrase, terms, counts in zip(*(wanted.column(c).to_pylist() for c in ("phrase", "terms", "counts")), strict=True):
            if within is None:
                n = len(terms) if size is None else min(size, len(terms))
                for k in range(len(terms) - n + 1):
                    starts = exact_starts(terms[k : k + n], counts[k : k + n], places)
                    if len(starts):
                        doc = np.searchsorted(edges, starts, "right")
                        out += [(phrase, x, n) for x in starts[starts + n <= edges[doc]].tolist()]
            else:
                out += [(phrase, *span) for span in near_spans(terms, counts, places, edges, within)]
        cols = list(zip(*out, strict=True)) if out else [[], [], []]
        return pa.table(
            [pa.array([key[0].as_py()] * len(out), pa.int64()), pa.array(cols[0], pa.string()), *(pa.array(c, pa.int64()) for c in cols[1:])],
            names=["block", "phrase", "start", "length"],
        )

    lists = index.lists(terms_of(phrases)).unionByName(index.marks())
    return lists.groupBy("block").cogroup(visits.groupBy("block")).applyInArrow(skip_empty(match), MATCH_SCHEMA)


def exact_starts(terms: list[str], counts: list[int], places) -> np.ndarray:
    """Where the terms follow each other: lists shifted by offset and intersected, rarest first."""
    none = np.empty(0, np.int64)
    starts = None
    for o in sorted(range(len(terms)), key=counts.__getitem__):
        own = places(terms[o])
        if own is None:
            return none
        if starts is None:
            starts = own[own >= o] - o
        else:
            at = np.minimum(np.searchsorted(own, starts + o), len(own) - 1)
            starts = starts[own[at] == starts + o]
        if not len(starts):
            return none
    return none if starts is None else starts


def near_spans(terms: list[str], counts: list[int], places, edges: np.ndarray, within: int) -> list[tuple[int, int]]:
    ranks = dict(sorted(zip(terms, counts, strict=True), key=lambda x: x[1]))
    lists = [places(t) for t in ranks]
    if any(x is None for x in lists):
        return []
    found = []
    for x in lists[0].tolist():
        doc = int(np.searchsorted(edges, x, "right"))
        lo, hi = max(int(edges[doc - 1]), x - within + 1), min(int(edges[doc]), x + within)
        own = [p[np.searchsorted(p, lo) : np.searchsorted(p, hi)] for p in lists[1:]]
        if all(len(p) for p in own):
            span = least_span([np.array([x]), *own])
            if span and span[1] <= within:
                found.append(span)
    return found


def skip_empty(match):
    """No search in blocks that no phrase visits."""

    def run(key: tuple, lists: pa.Table, wanted: pa.Table) -> pa.Table:
        if not wanted.num_rows or not lists.num_rows:
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64()]
            return pa.table([pa.array([], k) for k in kinds], names=["block", "phrase", "start", "length"])
        return match(key, lists, wanted)

    return run


def least_span(lists: list[np.ndarray]) -> tuple[int, int] | None:
    """(start, length) of the least span that has a place of each list."""
    best, at = None, sorted((int(p), i) for i, ps in enumerate(lists) for p in ps)
    seen: dict[int, int] = {}
    for p, i in at:
        seen[i] = p
        if len(seen) == len(lists):
            lo = min(seen.values())
            if best is None or p - lo + 1 < best[1]:
                best = (lo, p - lo + 1)
    return best


def find_phrases(index: Index, phrases: DataFrame, size: int | None = None) -> DataFrame:
    return search(index, phrases, size, None)


def find_near(index: Index, phrases: DataFrame, within: int) -> DataFrame:
    return search(index, phrases, None, within)


HIT_SCHEMA = "doc_id long, n_words long, n_hit long, items array<string>"


def per_document(index: Index, matches: DataFrame) -> DataFrame:
    """Words and hit words of every indexed document, with the phrases that hit it.

    matches(block, phrase, start, length). Covered words are counted as a union of spans.
    """

    def tally(key: tuple, marks: pa.Table, found: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if marks.num_rows:
            docs = np.frombuffer(marks.column("places")[0].as_py(), "<i8").reshape(2, -1)
            edges = np.concatenate([[0], np.cumsum(docs[1])])
            steps = np.zeros(int(edges[-1]) + 1, np.int64)
            owners: dict[int, set[str]] = {}
            if found.num_rows:
                start, length = found.column("start").to_numpy(), found.column("length").to_numpy()
                np.add.at(steps, start, 1)
                np.add.at(steps, start + length, -1)
                doc = np.searchsorted(edges, start, "right") - 1
                for d, p in zip(doc.tolist(), found.column("phrase").to_pylist(), strict=True):
                    owners.setdefault(d, set()).add(p)
            covered = np.concatenate([[0], np.cumsum(np.cumsum(steps)[:-1] > 0)])
            hits = covered[edges[1:]] - covered[edges[:-1]]
            rows = [
                (None if k == NO_KEY else k, n, h, sorted(owners.get(d, ())))
                for d, (k, n, h) in enumerate(zip(docs[0].tolist(), docs[1].tolist(), hits.tolist(), strict=True))
            ]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
        return pa.table(
            [pa.array(c, pa.int64()) for c in cols[:3]] + [pa.array(cols[3], pa.list_(pa.string()))],
            names=["doc_id", "n_words", "n_hit", "items"],
        )

    return index.marks().groupBy("block").cogroup(matches.groupBy("block")).applyInArrow(tally, HIT_SCHEMA)


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 13) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the item_ids that hit."""
    phrases = phrase_table(benchmark)
    index = build_index(docs, scratch(docs.sparkSession, "index"))
    hits = per_document(index, find_phrases(index, phrases, size))
    return hits.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        "items",
    )


def uncontaminated(docs: DataFrame, benchmark: DataFrame, size: int = 13) -> DataFrame:
    """The rows that are not contaminated, with all their columns.

    Rows are told apart by doc_id where that is unique, else by their place in a written
    copy, so a clean row stays whatever other rows share its id or its text.
    """
    inner = [f"c{i}" for i in range(len(docs.columns))]
    at, key = inner[docs.columns.index("text")], inner[docs.columns.index("doc_id")]
    flat = docs.toDF(*inner)
    n, ids, some = flat.agg(F.count("*"), F.countDistinct(key), F.count(key)).first()
    if n == ids == some:
        flat = flat.withColumn("row", F.col(key))
    else:
        flat = written(flat.withColumn("row", F.monotonically_increasing_id()), "documents")
    own = flat.select(F.col("row").alias("doc_id"), F.col(at).alias("text"))
    bad = contamination(own, benchmark, size).filter("contaminated").select(F.col("doc_id").alias("row"))
    return flat.join(bad, "row", "left_anti").select(*inner).toDF(*docs.columns)
