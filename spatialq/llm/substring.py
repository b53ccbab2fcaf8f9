"""Exact substring dedup: remove each byte covered by a k-byte string that starts anywhere else too.

1. *Anchors.* Every k-byte string names the least-hashed 32-gram inside it, so equal
   strings name equal grams at equal offsets. The starts that share an anchor form one
   row; only hashes are shuffled, about one row for every 85 bytes.
2. *Candidates.* Rows whose anchor occurs once cannot match anything. Equal rows (same
   bytes around the anchor) are collapsed to one with its multiplicity; their starts all
   repeat. What remains are distinct rows around a common anchor.
3. *Suffix arrays.* Those rows, dealt by anchor into bounded batches, are laid out in
   8-byte blocks aligned to their anchors; each batch's suffix array (linear grouping
   construction, see ``suffixes``) brings equal runs of blocks together, and the bytes
   before and after a run settle each start exactly.
4. *Hot anchors.* An anchor with more distinct rows than a batch takes is dealt over
   several batches; its starts are also counted across batches by hash, with partial
   aggregates.

Anchor rows and candidates compare by pairs of 64-bit hashes; batches compare bytes.

Defined results: a null text is empty; texts shorter than k keep all bytes; a document
given twice is two documents, so all of it is covered if it has k bytes; an empty table
gives an empty result; kept bytes need not be valid UTF-8 and are thus binary. Columns
other than the id and the text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, column, pick, utf8, written
from .suffixes import suffix_array

GRAM = 32
BLOCK = 8
BATCH_ROWS = 20_000
POSITION_BITS = 24
U = np.uint64
_random = np.random.Generator(np.random.PCG64(20240229))
BYTE_HASH = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
MULTIPLIERS = _random.integers(1, 1 << 62, 16, dtype=np.uint64) * U(2) + U(1)
ROW_SCHEMA = "uid long, lo long, span int, rel int, ah long, rh long"


def rolling(data: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all 32-grams and of all k-byte strings (64 <= k <= 2 * 128), by doubling."""
    h, width, grams = BYTE_HASH[data], 1, None
    step = 0
    while 2 * width <= k and width < 128:
        m = len(h) - width
        a = h[:m] * MULTIPLIERS[step]
        a ^= a >> U(29)
        a += h[width:]
        h, width, step = a, 2 * width, step + 1
        if width == GRAM:
            grams = h
    m = len(data) - k + 1
    a = h[:m] * MULTIPLIERS[14]
    a ^= a >> U(31)
    a += h[k - width : k - width + m]
    a *= MULTIPLIERS[15]
    a ^= a >> U(32)
    return grams, a


def anchor_rows(data: np.ndarray, edges: np.ndarray, k: int) -> dict[str, np.ndarray]:
    """Runs of starts with a common anchor: first start, further starts, anchor and hashes.

    edges are the document borders in data. A start's anchor is the leftmost least
    32-gram of its k bytes, whatever stands around them.
    """
    n = len(data)
    steps = np.zeros(n + 1, np.int64)
    a, b = edges[:-1], edges[1:]
    long = b - a >= k
    steps[a[long]] += 1
    steps[b[long] - k + 1] -= 1
    valid = np.flatnonzero(np.cumsum(steps[: max(n - k + 1, 0)]) > 0)
    if not len(valid):
        z = np.empty(0, np.int64)
        return {"lo": z, "hi": z, "at": z, "ah": z, "rh": z}
    grams, strings = rolling(data, k)
    low = U((1 << POSITION_BITS) - 1)
    key = grams * MULTIPLIERS[13]
    key ^= key >> U(30)
    key = (key & ~low) | np.arange(len(key), dtype=np.uint64)
    width, want = 1, k - GRAM + 1
    while 2 * width <= want:
        key = np.minimum(key[: len(key) - width], key[width:])
        width *= 2
    m = n - k + 1
    key = np.minimum(key[:m], key[want - width : want - width + m])
    own = (key[valid] & low).astype(np.int64)
    first = np.flatnonzero(np.diff(own, prepend=-1))
    last = np.append(first[1:], len(own)) - 1
    lo, hi, at = valid[first], valid[last], own[first]
    rh = strings[lo] * MULTIPLIERS[12] + strings[hi] * MULTIPLIERS[11] + (hi - lo).astype(np.uint64) * MULTIPLIERS[10] + (at - lo).astype(np.uint64)
    rh ^= rh >> U(31)
    return {"lo": lo, "hi": hi, "at": at, "ah": grams[at].view(np.int64), "rh": rh.view(np.int64)}


def anchored(rows: DataFrame, k: int, block_bytes: int = 1 << 19, piece: int = 4 << 20) -> DataFrame:
    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uids = column(batch, "uid").to_numpy(zero_copy_only=False)
            data, offs = utf8(column(batch, "text"))
            for i, j in blocks(offs, block_bytes):
                # a text beyond `piece` bytes goes in pieces that overlap by k - 1 bytes: starts stay apart
                whole = offs[j] - offs[i]
                cuts = range(0, int(whole), piece) if j == i + 1 and whole > piece else [0]
                for c in cuts:
                    a = int(offs[i]) + c
                    b = int(min(offs[j], a + piece + k - 1)) if len(cuts) > 1 else int(offs[j])
                    edges = np.array([0, b - a]) if len(cuts) > 1 else offs[i : j + 1] - offs[i]
                    r = anchor_rows(data[a:b], edges, k)
                    if not len(r["lo"]):
                        continue
                    doc = np.searchsorted(edges, r["lo"], "right") - 1
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(uids[i + doc]),
                            pa.array(r["lo"] - edges[doc] + c),
                            pa.array((r["hi"] - r["lo"]).astype(np.int32)),
                            pa.array((r["at"] - r["lo"]).astype(np.int32)),
                            pa.array(r["ah"]),
                            pa.array(r["rh"]),
                        ],
                        names=["uid", "lo", "span", "rel", "ah", "rh"],
                    )

    return rows.mapInArrow(find, ROW_SCHEMA)


def run_classes(words: np.ndarray, border: np.ndarray, run: int) -> np.ndarray:
    """For each block the class of the ``run`` blocks from it on, equal for equal runs; -1 for runs that occur once.

    Blocks at a border belong to no run. Runs of equal blocks consist of blocks, and of
    pairs of blocks, that occur twice at least, so only stretches of such blocks that
    are long enough reach the suffix array, each behind a sign of its own.
    """
    out = np.full(len(words), -1, np.int64)
    _, symbols, often = np.unique(words, return_inverse=True, return_counts=True)
    held = (often[symbols] > 1) & ~border
    for _ in range(3):
        pair = np.flatnonzero(held[:-1] & held[1:])
        _, which, often = np.unique(symbols[pair] * (int(symbols.max()) + 1) + symbols[pair + 1], return_inverse=True, return_counts=True)
        both = np.zeros(len(held), bool)  # the pair from here on occurs twice
        both[pair] = often[which] > 1
        edge = np.diff(np.concatenate([[0], both.astype(np.int8), [0]]))
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)  # blocks first..last
        long = last - first + 1 >= run
        first, last = first[long], last[long]
        now = np.zeros(len(held) + 1, np.int64)
        np.add.at(now, first, 1)
        np.add.at(now, last + 1, -1)
        before = int(held.sum())
        held = np.cumsum(now[:-1]) > 0
        if int(held.sum()) == before:
            break
    if not len(first):
        return out
    # stretches, each behind a sign of its own: signs are above all symbols and differ
    size = last - first + 2
    heads = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(heads, size)
    where = np.repeat(first, size) + place - 1
    dense, text = np.unique(symbols[where], return_inverse=True)
    text = text.astype(np.int64)
    text[heads] = len(dense) + np.arange(len(heads))
    order = np.array(suffix_array(text.tolist()), np.int64)
    left = np.repeat(size, size) - place  # blocks up to the stretch's end, from each
    a, b = order[:-1], order[1:]
    same = (left[a] >= run) & (left[b] >= run)
    at = np.flatnonzero(same)
    for t in range(run):
        at = at[text[a[at] + t] == text[b[at] + t]]
    same[:] = False
    same[at] = True
    near = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    classes = np.concatenate([[0], np.cumsum(~same)])
    out[where[order[near]]] = classes[near]
    return out


def repeated_starts(texts: np.ndarray, offs: np.ndarray, rel: np.ndarray, span: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, repeats) for every start of a batch of rows, by a suffix array over blocks.

    Row i's bytes are texts[offs[i]:offs[i + 1]], its anchor stands at rel[i], its starts
    are 0..span[i], and it stands for weight[i] equal rows.
    """
    n, lens = len(rel), np.diff(offs)
    run = k // BLOCK - 1
    pad = -rel % BLOCK
    held = 1 + -(-(pad + lens) // BLOCK) + 1
    base = np.concatenate([[0], np.cumsum(held)])
    flat = np.zeros(int(base[-1]) * BLOCK, np.uint8)
    flat[np.arange(int(lens.sum())) + np.repeat(base[:-1] * BLOCK + BLOCK + pad - (offs[:-1] - offs[0]), lens)] = texts[offs[0] : offs[-1]]
    words = flat.view("<u8")
    border = np.zeros(len(words), bool)
    border[base[:-1]] = True
    alike = run_classes(words, border, run)

    row = np.repeat(np.arange(n), span + 1)
    start = np.arange(len(row)) - np.repeat(np.cumsum(span + 1) - (span + 1), span + 1)
    x = BLOCK + pad[row] + start
    j = -(-x // BLOCK)
    e = BLOCK * j - x
    g = base[row] + j
    right = np.array([(1 << 8 * (BLOCK - i)) - 1 for i in range(BLOCK)], np.uint64)
    around = (words[g - 1] & ~right[e]) | (words[g + run] & right[e])
    repeats = np.zeros(len(row), bool)
    shared = np.flatnonzero(alike[g] >= 0)
    key, around = alike[g[shared]] * BLOCK + e[shared], around[shared]
    by = np.lexsort((around, key))
    new = np.ones(len(by), bool)
    new[1:] = (key[by][1:] != key[by][:-1]) | (around[by][1:] != around[by][:-1])
    heads = np.flatnonzero(new)
    total = np.add.reduceat(weight[row[shared]][by], heads) if len(heads) else heads
    repeats[shared[by]] = np.repeat(total > 1, np.diff(np.append(heads, len(by))))
    return row, start, repeats


SPAN_SCHEMA = "uid long, lo long, hi long, ah long, sh long, n long"


def batch_spans(k: int):
    """Spans of repeated starts of a batch; starts of hot anchors come back one by one with a hash."""

    def find(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        num = {c: rows.column(c).to_numpy() for c in ("uid", "lo", "span", "rel", "ah", "m", "hot")}
        one = rows.column("bytes")
        data, offs = utf8(one.chunk(0) if isinstance(one, pa.ChunkedArray) else one)
        row, start, repeats = repeated_starts(data, offs, num["rel"].astype(np.int64), num["span"].astype(np.int64), num["m"], k)
        hot = num["hot"][row]
        mine = np.flatnonzero(repeats & (num["m"][row] == 1))
        cut = np.ones(len(mine), bool)
        cut[1:] = (row[mine][1:] != row[mine][:-1]) | (start[mine][1:] != start[mine][:-1] + 1)
        first = np.flatnonzero(cut)
        last = np.append(first[1:], len(mine)) - 1 if len(first) else first
        r = row[mine][first]
        uid, lo, hi = num["uid"][r], num["lo"][r] + start[mine][first], num["lo"][r] + start[mine][last] + k
        some = np.flatnonzero(hot)
        _, strings = rolling(data, k) if len(some) else (None, None)
        hr = row[some]
        sh = strings[offs[hr] + start[some]].view(np.int64) if len(some) else np.empty(0, np.int64)
        none = len(uid)
        return pa.table(
            [
                pa.array(np.concatenate([uid, num["uid"][hr]])),
                pa.array(np.concatenate([lo, num["lo"][hr] + start[some]])),
                pa.array(np.concatenate([hi, num["lo"][hr] + start[some] + k])),
                pa.array(np.concatenate([np.zeros(none, np.int64), num["ah"][hr]])),
                pa.array(np.concatenate([np.zeros(none, np.int64), sh]), mask=np.arange(none + len(some)) < none),
                pa.array(np.concatenate([np.zeros(none, np.int64), num["m"][hr]])),
            ],
            names=["uid", "lo", "hi", "ah", "sh", "n"],
        )

    return find


def repeated_spans(rows: DataFrame, k: int = 200, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """(uid, lo, hi): byte spans of rows(uid, text) that k-byte strings cover which start elsewhere too.

    Spans of a document may overlap. uid must be distinct.
    """
    if k < 64 or k > 256 or k % BLOCK:
        raise ValueError("k must be a multiple of 8 from 64 to 256")
    found = written(anchored(rows, k), "anchors")
    # written, so that the join below has plain shuffles on both sides and a hot anchor can be split
    common = written(found.groupBy("ah").agg(F.count("*").alias("n")).filter("n > 1").select("ah"), "common")
    likely = written(found.join(common, "ah").select(*found.columns), "candidates")
    distinct = written(
        likely.groupBy("ah", "rh").agg(F.count("*").alias("m"), F.min(F.struct("uid", "lo", "span", "rel")).alias("rep")), "distinct"
    )
    whole = likely.join(distinct.filter("m > 1").select("ah", "rh"), ["ah", "rh"]).select(
        "uid", "lo", (F.col("lo") + F.col("span") + k).alias("hi")
    )
    several = written(
        distinct.groupBy("ah").agg(F.count("*").alias("rows"), F.min("m").alias("least"))
        .filter("rows > 1 AND least = 1").select("ah", "rows"),
        "several",
    )
    edges = written(distinct.join(several, "ah").select("ah", "rh", "m", "rep.*", "rows"), "edges")
    batches = max(1, -(-edges.count() // batch_rows))
    hot = F.col("rows") > batch_rows
    salt = F.when(hot, F.pmod("rh", F.ceil(F.col("rows") / batch_rows))).otherwise(0)
    listed = edges.groupBy("uid").agg(
        F.collect_list(
            F.struct(F.pmod(F.xxhash64("ah", salt), F.lit(batches)).alias("batch"), "ah", "m", "lo", "span", "rel", hot.cast("int").alias("hot"))
        ).alias("e")
    )
    texts = rows.join(listed, "uid").select("uid", F.col("text").cast("binary").alias("raw"), "e")
    cut = texts.select(
        "uid",
        F.explode(F.transform("e", lambda x: F.struct(x.alias("x"), F.substring(F.col("raw"), (x["lo"] + 1).cast("int"), (x["span"] + k).cast("int")).alias("bytes")))).alias("y"),
    ).select("uid", "y.x.*", "y.bytes")
    spans = written(cut.groupBy("batch").applyInArrow(batch_spans(k), SPAN_SCHEMA), "spans")
    single = spans.filter("sh IS NULL").select("uid", "lo", "hi")
    out = whole.unionByName(single)
    if edges.filter(hot).limit(1).count():
        starts = spans.filter("sh IS NOT NULL")
        twice = starts.groupBy("ah", "sh").agg(F.sum("n").alias("t")).filter("t > 1").select("ah", "sh")
        out = out.unionByName(starts.join(twice, ["ah", "sh"]).select("uid", "lo", "hi"))
    return out


def numbered(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) with a distinct uid: doc_id itself where it is one, else a row number of a written copy."""
    docs = pick(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    n, ids, some = docs.agg(F.count("*"), F.countDistinct("doc_id"), F.count("doc_id")).first()
    if n == ids == some:
        return docs.withColumn("uid", F.col("doc_id"))
    return written(docs.withColumn("uid", F.monotonically_increasing_id()), "documents")


RESULT_SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<lo:long,hi:long>>"


def dedup(docs: DataFrame, k: int = 200, keep_bytes: bool = False) -> DataFrame:
    """Per document what is removed and the hash of what stays (and the bytes that stay, as ``kept``)."""
    rows = numbered(docs)
    spans = repeated_spans(rows, k)
    listed = spans.groupBy("uid").agg(F.collect_list(F.struct("lo", "hi")).alias("s"))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = utf8(column(batch, "text"))
            out: list[tuple] = []
            kept_bytes: list[bytes] = []
            for i, s in enumerate(column(batch, "s").to_pylist()):
                text = data[offs[i] : offs[i + 1]]
                merged: list[list[int]] = []
                for x in sorted((x["lo"], x["hi"]) for x in s or ()):
                    if merged and x[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], x[1])
                    else:
                        merged.append(list(x))
                kept, at = [], 0
                for a, b in merged:
                    kept.append(text[at:a].tobytes())
                    at = b
                kept.append(text[at:].tobytes())
                left = b"".join(kept)
                out.append((len(text), len(text) - len(left), len(merged), hashlib.sha256(left).hexdigest(), [{"lo": a, "hi": b} for a, b in merged]))
                if keep_bytes:
                    kept_bytes.append(left)
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            arrays = [column(batch, "doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
            if keep_bytes:
                arrays.append(pa.array(kept_bytes, pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    joined = rows.join(listed, "uid", "left").select("doc_id", "text", "s")
    return joined.mapInArrow(cut, RESULT_SCHEMA + (", kept binary" if keep_bytes else ""))
