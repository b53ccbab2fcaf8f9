"""Stupid-backoff language-model scores (Brants et al., 2007) from count tables of the whole corpus.

S(w | context) is c(context w) / c(context) where the n-gram was seen at least
``min_count`` times, else ``alpha`` times the score with a shorter context; at the end
c(w) / N. Shorter contexts stand at a document's first words; n-grams do not cross
documents. A document's score is the sum of log10 S over its words.

Relations: documents become blocks (word dictionary and word numbers), a Parquet table
bucketed by block. Each block explodes into its distinct n-grams with their counts, which
are dealt by hash into buckets; a bucket sums them, which makes it a part of the count
table, and answers each block that asked. The answers meet the blocks in a join that
moves only the answers, and the scores are summed by document. Blocks and buckets pass
packed arrays: of one row an n-gram the shuffle alone would be over five times the input.
A frequent n-gram costs one entry a block, buckets and blocks are bounded in entries, and
a block sends one row to each bucket that it has n-grams for, so the rows are at most the
n-grams and nothing grows with one key.

N-grams compare by 64 bits of hash: of n distinct ones, a share of about n / 2**64 meets
another's count (5e-10 of 1e10, the n-grams of 30 GB). A document's sum depends on its
own words and the counts only, not on how documents are dealt.

Defined results: a null or empty text has no words, score 0 and null mean; a very long
text is one block of its own; repeated rows are scored alike and counted each; ties do
not arise; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, column, pick, scratch, utf8
from .words import FOLD, MULT, mix

U = np.uint64
NO_KEY = -(1 << 62)
BLOCK_SCHEMA = "block long, docs binary, words binary, hashes binary, n_words long"


def planes(a: np.ndarray) -> bytes:
    """Bytes of an array, first bytes first, so that a general compressor finds the zeros."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes()


def from_planes(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def packed(a: np.ndarray) -> bytes:
    """planes(a), compressed: skewed numbers have planes that shrink well."""
    data = planes(a)
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unpacked(data: bytes, kind: str) -> np.ndarray:
    return from_planes(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True), kind)


def corpus_blocks(docs: DataFrame, block_bytes: int = 8 << 20, bucket_bytes: int = 32 << 20) -> DataFrame:
    """(block, docs, words, hashes, n_words): doc_ids and word counts, packed word numbers, the words' hashes.

    The table is bucketed by block, so that joins on block do not move it.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        serial = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids = column(batch, "doc_id")
            data, offs = utf8(column(batch, "text"))
            for lo, hi in blocks(offs, block_bytes):
                text = data[offs[lo] : offs[hi]].tobytes().translate(FOLD)
                cuts = (offs[lo : hi + 1] - offs[lo]).tolist()
                local: dict[bytes, int] = {}
                words, counts = [], []
                for a, b in zip(cuts, cuts[1:], strict=False):
                    w = text[a:b].split()
                    for x in w:
                        if x not in local:
                            local[x] = len(local)
                    words.append(np.fromiter(map(local.__getitem__, w), np.uint32, len(w)))
                    counts.append(len(w))
                keys = np.array([NO_KEY if k is None else k for k in ids.slice(lo, hi - lo).to_pylist()], np.int64)
                heads = b"".join(hashlib.blake2b(x, digest_size=8).digest() for x in local)
                parts = [np.concatenate([keys, np.array(counts, np.int64)]).tobytes(), packed(np.concatenate(words)), heads]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([serial], pa.int64()), *(pa.array([x], pa.binary()) for x in parts), pa.array([sum(counts)], pa.int64())],
                    names=["block", "docs", "words", "hashes", "n_words"],
                )
                serial += 1

    spark, own = docs.sparkSession, pick(docs, "doc_id", "text")
    n_bytes = own.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    name = f"lm_blocks_{uuid.uuid4().hex}"
    out = own.mapInArrow(run, BLOCK_SCHEMA).write.bucketBy(min(10_000, max(1, -(-n_bytes // bucket_bytes))), "block")
    out.option("path", scratch(spark, "blocks")).option("compression", "zstd").saveAsTable(name)
    return spark.table(name)


def block_grams(docs: bytes, words: bytes, hashes: bytes, order: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For n = 1..order, the hashes of the n-grams that end at each word and whether there is one."""
    counts = np.frombuffer(docs, np.int64).reshape(2, -1)[1]
    h = np.frombuffer(hashes, "<u8")[unpacked(words, "<u4")]
    place = np.arange(len(h)) - np.repeat(np.cumsum(counts) - counts, counts)
    grams, there = [mix(h + MULT[20])], [np.ones(len(h), bool)]
    for n in range(2, order + 1):
        g = np.zeros(len(h), np.uint64)
        g[1:] = mix(grams[-1][:-1] * MULT[20 + n] + h[1:])
        grams.append(g)
        there.append(place >= n - 1)
    return grams, there


def distinct_grams(grams: list[np.ndarray], there: list[np.ndarray], inverse: bool):
    flat = np.concatenate([g[t] for g, t in zip(grams, there, strict=True)])
    return np.unique(flat, return_counts=not inverse, return_inverse=inverse)


def ranges(grams: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets, equal ranges of the hash, that ascending hashes fall into, and where each one's begin."""
    own = (grams >> U(32)) * U(buckets) >> U(32)
    heads = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.empty(0, np.int64)
    return own[heads].astype(np.int32), np.append(heads, len(own))


ENTRY_SCHEMA = "bucket int, block long, grams binary, counts binary"


def narrow(counts: np.ndarray) -> bytes:
    top = int(counts.max(initial=0))
    kind = "<u1" if top < 1 << 8 else "<u4" if top < 1 << 32 else "<u8"
    return kind[-1].encode() + packed(counts.astype(kind))


def wide(data: bytes) -> np.ndarray:
    return unpacked(data[1:], f"<u{data[:1].decode()}").astype(np.int64)


def grams_of(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data, "<u8"), dtype=np.uint64)


def block_counts(table: DataFrame, order: int, buckets: int) -> DataFrame:
    """Each block's distinct n-grams and their counts, one row for each bucket that they fall into."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                block, docs, words, hashes = (batch.column(i)[r].as_py() for i in range(4))
                grams, counts = distinct_grams(*block_grams(docs, words, hashes, order), inverse=False)
                own, ends = ranges(grams, buckets)
                for i in range(0, len(own), 256):
                    cuts = ends[i : i + 257].tolist()
                    spans = list(zip(cuts, cuts[1:], strict=False))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(own[i : i + len(spans)]),
                            pa.array([block] * len(spans), pa.int64()),
                            pa.array([packed(np.diff(grams[a:b], prepend=U(0))) for a, b in spans], pa.binary()),
                            pa.array([narrow(counts[a:b]) for a, b in spans], pa.binary()),
                        ],
                        names=["bucket", "block", "grams", "counts"],
                    )

    return table.select("block", "docs", "words", "hashes").mapInArrow(run, ENTRY_SCHEMA)


def summed(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """A bucket's n-grams and their counts; each entry's place among them; the entries' sizes."""
    parts = [grams_of(x.as_py()) for x in rows.column("grams")]
    grams, at = np.unique(np.concatenate(parts), return_inverse=True)
    total = np.zeros(len(grams), np.int64)
    np.add.at(total, at, np.concatenate([wide(x.as_py()) for x in rows.column("counts")]))
    return grams, total, at, [len(x) for x in parts]


def answers(key: tuple, rows: pa.Table) -> pa.Table:
    """The counts of a bucket, for each block in the order of its n-grams."""
    _, total, at, sizes = summed(rows)
    found, ends = total[at], np.cumsum([0, *sizes])
    back = [narrow(found[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
    return pa.table(
        [pa.array([key[0].as_py()] * len(back), pa.int32()), rows.column("block"), pa.array(back, pa.binary())],
        names=["bucket", "block", "counts"],
    )


def count_table(docs: DataFrame, order: int = 3, buckets: int = 64) -> DataFrame:
    """(gram, n): the hash and the corpus count of every n-gram up to the order."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        grams, total, _, _ = summed(rows)
        return pa.table([pa.array(grams.view(np.int64)), pa.array(total)], names=["gram", "n"])

    return block_counts(corpus_blocks(docs), order, buckets).groupBy("bucket").applyInArrow(run, "gram long, n long")


SCORE_SCHEMA = "doc_id long, n_words long, n_full long, log_score double, mean_log_score double"


def scores(docs: DataFrame, order: int = 3, alpha: float = 0.4, min_count: int = 2, bucket_entries: int = 3_000_000) -> DataFrame:
    """doc_id, n_words, n_full (words scored with the longest context), log_score and its mean a word."""
    table = corpus_blocks(docs)
    total = table.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    buckets = max(1, -(-total * order // bucket_entries))
    counts = block_counts(table, order, buckets).groupBy("bucket").applyInArrow(answers, "bucket int, block long, counts binary")

    def run(key: tuple, blocks_: pa.Table, found: pa.Table) -> pa.Table:
        parts = [blocks_.column(c)[0].as_py() for c in ("docs", "words", "hashes")]
        ids, n = np.frombuffer(parts[0], np.int64).reshape(2, -1)
        grams, there = block_grams(*parts, order)
        per = [np.zeros(len(g), np.int64) for g in grams]
        if found.num_rows:
            by = np.argsort(found.column("bucket").to_numpy()).tolist()
            counts_ = np.concatenate([wide(found.column("counts")[i].as_py()) for i in by])
            _, at = distinct_grams(grams, there, inverse=True)
            each, start = counts_[at], 0
            for c, t in zip(per, there, strict=True):
                k = int(t.sum())
                c[t] = each[start : start + k]
                start += k
        score = np.log10(np.maximum(per[0], 1) / max(total, 1))
        full = np.zeros(len(score), bool)
        for k in range(1, order):
            seen = there[k] & (per[k] >= min_count)
            before = np.concatenate([[1], per[k - 1][:-1]]) if len(score) else per[k - 1]
            backed = np.where(there[k], score + np.log10(alpha), score)
            score = np.where(seen, np.log10(np.maximum(per[k], 1) / np.maximum(before, 1)), backed)
            full = seen
        doc_sum, doc_full = np.zeros(len(n)), np.zeros(len(n), np.int64)
        some = np.flatnonzero(n)
        if len(some):
            heads = (np.cumsum(n) - n)[some]
            doc_sum[some] = np.add.reduceat(score, heads)
            doc_full[some] = np.add.reduceat(full.astype(np.int64), heads)
        return pa.table(
            [
                pa.array(ids, mask=ids == NO_KEY),
                pa.array(n),
                pa.array(doc_full),
                pa.array(doc_sum),
                pa.array(doc_sum / np.maximum(n, 1), mask=n == 0),
            ],
            names=["doc_id", "n_words", "n_full", "log_score", "mean_log_score"],
        )

    return table.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(run, SCORE_SCHEMA)
