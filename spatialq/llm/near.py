"""Near-duplicate documents by Order MinHash, verified by banded alignment.

Order MinHash (Marcais et al., 2019): each hash function picks the two least
occurrence-labelled 5-word shingles of a text and keeps their order in the text; two
functions make a band. Texts that share a band are candidates. A pair is linked if the
best alignment of their shingle sequences matches M shingles with
M / (n1 + n2 - M) >= 0.8, an order-aware Jaccard similarity; the alignment runs in a
band wide enough for every alignment that could reach the threshold, so the decision is
exact. Classes are the connected components of the links.

Skew. Texts with equal words collapse to one before anything else. A bucket is not
expanded into pairs: first each member is verified against the bucket's hub, the member
whose buckets are largest overall. That runs over the FIRST bands alone and then over
the buckets of all bands in which components still meet, so a group of near copies is
not tried once more in each of its bands. Members that stay outside the hub's component
are then compared across components: in small buckets each with each, in large ones by an
exact prefix filter. A pair that reaches the threshold overlaps in need = 0.8 (n1 + n2) / 1.8
labelled shingles; in any one order of all shingles, its first common shingle is at places
i and j with n1 - i and n2 - j of at least need. The order puts common shingles last, so
texts that share only a passage have no such place in common. No pair of a bucket is left
out: each is in one component, or verified, or too far apart. At similarity 0.8 a pair
shares a band with probability 0.9998.

Defined results: null counts as empty; texts without words are linked only if they are
equal; texts of one to four words are one shingle; very long texts are sketched and compared
whole; repeated rows fall into one class;
the class id is that of the least doc_id in it (a null one only if there is no other); an empty table gives an empty result. Columns other
than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import blocks, column, utf8, written
from .substring import numbered
from .words import MULT, labelled, mix, sequence_hashes, shingles, word_hashes

BANDS, FUNCTIONS = 16, 2
FIRST = 4
SMALL = 12
SLOTS = 1 << 18
U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20190704))
SEEDS = _rng.integers(1, 1 << 62, BANDS * FUNCTIONS, dtype=np.uint64) * U(2) + U(1)


def sketch(lab: np.ndarray) -> np.ndarray:
    """Band keys of a text's occurrence-labelled shingles."""
    n = len(lab)
    if n == 1:
        first = last = np.zeros(len(SEEDS), np.int64)
    else:
        first = np.empty(len(SEEDS), np.int64)
        last = np.empty(len(SEEDS), np.int64)
        step = max(1, (1 << 18) // n)
        for f in range(0, len(SEEDS), step):
            v = SEEDS[f : f + step, None] * lab[None, :]
            k = np.arange(len(v))
            a = v.argmin(axis=1)
            v[k, a] = ~U(0)
            b = v.argmin(axis=1)
            first[f : f + step], last[f : f + step] = np.minimum(a, b), np.maximum(a, b)
    keys = mix(lab[first] * MULT[61] + (lab[last] ^ (lab[last] >> U(13))) * MULT[62])
    keys = keys.reshape(BANDS, FUNCTIONS)
    out = np.arange(BANDS, dtype=np.uint64)
    for f in range(FUNCTIONS):
        out = mix(out * MULT[59] + keys[:, f])
    return out.view(np.int64)


SKETCH_SCHEMA = "uid long, k1 long, k2 long, bands array<long>"


def sketches(rows: DataFrame, block_bytes: int = 1 << 20) -> DataFrame:
    """Hash of the words and band keys of every text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uids = column(batch, "uid")
            data, offs = utf8(column(batch, "text"))
            for i, j in blocks(offs, block_bytes):
                part, edges = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                h, cuts = word_hashes(part, edges)
                k1, k2 = sequence_hashes(h, cuts)
                bands: list[np.ndarray] = []
                for d in range(j - i):
                    own = h[cuts[d] : cuts[d + 1]]
                    if len(own):
                        bands.append(sketch(labelled(shingles(own))))
                    else:
                        bands.append(np.empty(0, np.int64))
                        k1[d], k2[d] = raw_hashes(part[edges[d] : edges[d + 1]])
                ends = np.cumsum([0, *map(len, bands)])
                flat = np.concatenate(bands) if bands else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [uids.slice(i, j - i), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))],
                    names=["uid", "k1", "k2", "bands"],
                )

    return rows.mapInArrow(run, SKETCH_SCHEMA)


def raw_hashes(data: np.ndarray) -> tuple[int, int]:
    """Hashes of a text without words, apart from those of texts with words by a fixed first hash."""
    import hashlib

    return 0, int.from_bytes(hashlib.blake2b(data.tobytes(), digest_size=8).digest(), "little")


def aligned(a: np.ndarray, b: np.ndarray, need: int) -> int:
    """Most shingles matched in order, or less than ``need`` if that cannot be reached.

    Common ends are cut off; the middle runs bit-parallel (Hyyro, 2004) in a window of
    columns that moves with the row. With at most len(a) - need shingles of a unmatched,
    and likewise for b, no alignment that reaches ``need`` leaves the window.
    """
    if min(len(a), len(b)) < need:
        return 0
    m = min(len(a), len(b))
    differ = np.flatnonzero(a[:m] != b[:m])
    head = int(differ[0]) if len(differ) else m
    a, b = a[head:], b[head:]
    m = min(len(a), len(b))
    differ = np.flatnonzero(a[::-1][:m] != b[::-1][:m])
    tail = int(differ[0]) if len(differ) else m
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    done = head + tail
    if not len(a) or not len(b):
        return done
    left, right = len(b) - max(need - done, 0), len(a) - max(need - done, 0)
    if left < 0 or right < 0:
        return done
    width = left + right + 1
    full = (1 << width) - 1
    where: dict[int, list[int]] = {}
    for i, s in enumerate(a.tolist()):
        where.setdefault(s, []).append(i)
    row, gone = full, 0
    for j, s in enumerate(b.tolist()):
        if j:
            gone += not row & 1
            row = row >> 1 | 1 << (width - 1)
        match = 0
        for i in where.get(s, ()):
            t = i - j + left
            if 0 <= t < width:
                match |= 1 << t
        if match:
            u = row & match
            row = (row + u | row - u) & full
    return done + gone + width - row.bit_count()


def similar(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    """Whether two shingle sequences reach the threshold; the multiset overlap bounds the match first."""
    both = len(a) + len(b)
    need = int(np.ceil(threshold * both / (1 + threshold) - 1e-9))
    if min(len(a), len(b)) < need:
        return False
    if len(np.intersect1d(labelled(a), labelled(b), assume_unique=True)) < need:
        return False
    return aligned(a, b, need) >= need


def verify(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose texts are similar."""
    # merge joins at every size: a hot hub is split by AQE, and small inputs run as large ones do
    one = pairs.join(texts.select(F.col("uid").alias("a"), F.col("text").alias("ta")).hint("merge"), "a")
    two = one.hint("merge").join(texts.select(F.col("uid").alias("b"), F.col("text").alias("tb")).hint("merge"), "b").select("a", "b", "ta", "tb")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seqs = []
            for c in ("ta", "tb"):
                data, offs = utf8(column(batch, c))
                own: list[np.ndarray] = []
                for i, j in blocks(offs, 1 << 20):
                    h, cuts = word_hashes(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                    own += [shingles(h[x:y]) for x, y in zip(cuts, cuts[1:], strict=False)]
                seqs.append(own)
            keep = pa.array([similar(x, y, threshold) for x, y in zip(*seqs, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([column(batch, "a"), column(batch, "b")], names=["a", "b"]).filter(keep)

    return two.mapInArrow(run, "a long, b long")


def star(members: DataFrame) -> DataFrame:
    """Pairs (hub, member) of each bucket of members(key, rep, pop); the hub is its most popular member."""
    hubs = members.groupBy("key").agg(F.max(F.struct("pop", (-F.col("rep")).alias("r"))).alias("hub"))
    pairs = members.join(hubs.select("key", (-F.col("hub.r")).alias("hub")), "key").filter("rep <> hub")
    return pairs.select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b"))


def star_across(members: DataFrame) -> DataFrame:
    """As star, for members(key, rep, pop, comp), but only members outside the hub's component."""
    hubs = members.groupBy("key").agg(F.max(F.struct("pop", (-F.col("rep")).alias("r"), "comp")).alias("hub"))
    pairs = members.join(hubs.select("key", (-F.col("hub.r")).alias("hub"), F.col("hub.comp").alias("hc")), "key").filter("comp <> hc")
    return pairs.select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b"))


def crossing(members: DataFrame) -> DataFrame:
    """members(key, rep, pop, comp) of the buckets that more than one component meets in, with the bucket's size."""
    mixed = members.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size")).filter("lo < hi")
    return members.join(mixed.select("key", "size"), "key")


def each_with_each(members: DataFrame) -> DataFrame:
    """All pairs across components in buckets of at most SMALL members."""
    a = members.filter(F.col("size") <= SMALL)
    b = a.select("key", F.col("rep").alias("b"), F.col("comp").alias("cb"))
    return a.join(b, "key").filter("rep < b AND comp <> cb").select(F.col("rep").alias("a"), "b")


def text_shingles(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """Occurrence-labelled shingles of each text of a batch."""
    data, offs = utf8(column(batch, "text"))
    for i, j in blocks(offs, 1 << 20):
        h, cuts = word_hashes(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        for x, y in zip(cuts, cuts[1:], strict=False):
            yield labelled(shingles(h[x:y]))


def crowding(texts: DataFrame) -> np.ndarray:
    """About how common the shingles of each hash slot are, on a log scale. It only orders shingles: slots that meet cost time, not pairs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for lab in text_shingles(batch):
                slots, n = np.unique(lab & U(SLOTS - 1), return_counts=True)
                total[slots.astype(np.int64)] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["slot", "n"])

    found = texts.mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SLOTS, np.uint8)
    out[found["slot"].to_numpy()] = np.minimum(np.log2(found["n"].to_numpy()) * 6 + 1, 255).astype(np.uint8)
    return out


def prefixes(texts: DataFrame, order: np.ndarray, threshold: float) -> DataFrame:
    """(key, rep, i, n): the first shingles of each text, rare ones first, as many as any similar text can miss, and one."""

    def chosen(lab: np.ndarray) -> np.ndarray:
        m = len(lab) - int(np.ceil(threshold * len(lab) - 1e-9)) + 1
        return lab[np.lexsort((lab, order[(lab & U(SLOTS - 1)).astype(np.int64)]))[:m]]

    def rows(uids: list[int], sizes: list[int], firsts: list[np.ndarray]) -> pa.RecordBatch:
        m = np.array([len(f) for f in firsts])
        i = np.concatenate([np.arange(k, dtype=np.int32) for k in m])
        cols = [np.concatenate(firsts).view(np.int64), np.repeat(np.array(uids, np.int64), m), i, np.repeat(np.array(sizes, np.int32), m)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["key", "rep", "i", "n"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uids, sizes, firsts, held = [], [], [], 0
            for uid, lab in zip(column(batch, "uid").to_pylist(), text_shingles(batch), strict=True):
                uids.append(uid)
                sizes.append(len(lab))
                firsts.append(chosen(lab))
                held += len(firsts[-1])
                if held > 1 << 18:
                    yield rows(uids, sizes, firsts)
                    uids, sizes, firsts, held = [], [], [], 0
            if uids:
                yield rows(uids, sizes, firsts)

    return texts.mapInArrow(run, "key long, rep long, i int, n int")


def overlapping(crowd: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """All pairs across components of crowd(rep, comp) that can reach the threshold, by common shingles of their prefixes.

    Of a pair the shorter text needs a shorter prefix. Most pairs of a shingle are within its
    largest component; its members meet only the others.
    """
    own = written(texts.join(crowd.select(F.col("rep").alias("uid")), "uid", "left_semi"), "crowd")
    rows = written(prefixes(own, crowding(own), threshold).join(crowd, "rep"), "prefixes")
    parts = rows.groupBy("key", "comp").agg(F.count("*").alias("m"))
    mixed = parts.groupBy("key").agg(F.count("*").alias("parts"), F.max(F.struct("m", "comp")).alias("top")).filter("parts > 1")
    rows = written(rows.join(mixed.select("key", F.col("top.comp").alias("top")), "key").withColumn("most", F.col("comp") == F.col("top")).drop("top"), "mixed")
    share = threshold / (1 + threshold)
    short = rows.filter(F.col("n") - F.col("i") >= 2 * share * F.col("n") - 1e-9)
    long_ = rows.select("key", *(F.col(c).alias(f"{c}_") for c in ("rep", "i", "n", "comp", "most")))
    fits = F.least(F.col("n") - F.col("i"), F.col("n_") - F.col("i_")) >= share * (F.col("n") + F.col("n_")) - 1e-9
    ordered = (F.col("n") < F.col("n_")) | ((F.col("n") == F.col("n_")) & (F.col("rep") < F.col("rep_")))
    both = [short.filter("NOT most").join(long_, "key"), short.filter("most").join(long_.filter("NOT most_"), "key")]
    pairs = [p.filter((F.col("comp") != F.col("comp_")) & ordered & fits).select(F.least("rep", "rep_").alias("a"), F.greatest("rep", "rep_").alias("b")) for p in both]
    return pairs[0].unionByName(pairs[1])


def links(rows: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(uid, rep): each text's representative of equal words; and (v, c): components of representatives."""
    n = rows.count()
    sig = written(sketches(rows), "sketches")
    same = written(sig.groupBy("k1", "k2").agg(F.min("uid").alias("rep")), "equal", n)
    member_of = sig.select("uid", "k1", "k2").join(same, ["k1", "k2"]).select("uid", "rep")
    firsts = sig.join(same.select(F.col("rep").alias("uid")), "uid", "left_semi")
    banded = firsts.select(F.col("uid").alias("rep"), F.posexplode("bands").alias("band", "key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    members = written(banded.join(shared, "key"), "buckets", 4 * n)
    popular = members.groupBy("rep").agg(F.sum(F.log2("n")).alias("pop"))
    members = written(members.join(popular, "rep").select("band", "key", "rep", "pop"), "members", 4 * n)
    wanted = members.select(F.col("rep").alias("uid")).distinct()
    texts = written(rows.hint("merge").join(wanted.hint("merge"), "uid", "left_semi").select("uid", "text"), "texts")
    tried = written(star(members.filter(F.col("band") < FIRST)).distinct(), "pairs", n)
    good = written(verify(tried, texts, threshold), "links")

    def meeting(comp: DataFrame) -> DataFrame:
        known = F.coalesce("c", "rep").alias("comp")
        return written(crossing(members.join(comp.withColumnRenamed("v", "rep"), "rep", "left").select("key", "rep", "pop", known)), "open", n)

    more = star_across(meeting(components(good))).distinct().join(tried, ["a", "b"], "left_anti")
    more = written(more, "pairs", n)
    tried = tried.unionByName(more)
    good = good.unionByName(written(verify(more, texts, threshold), "links"))

    comp = components(good)
    open_ = meeting(comp)
    crowd = written(open_.filter(F.col("size") > SMALL).select("rep", "comp").distinct(), "crowd", n)
    second = each_with_each(open_).unionByName(overlapping(crowd, texts, threshold))
    second = written(second.distinct().join(tried, ["a", "b"], "left_anti"), "pairs", n)
    more = written(verify(second, texts, threshold), "links")
    if not more.isEmpty():
        comp = components(good.unionByName(more))
    return member_of, comp


def classes(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """uid, doc_id, class_uid and class_id for every row; class_uid = uid for the one to keep."""
    rows = numbered(docs)
    member_of, comp = links(rows, threshold)
    found = member_of.join(comp.withColumnRenamed("v", "rep"), "rep", "left").select("uid", F.coalesce("c", "rep").alias("class_uid"))
    ids = rows.select("uid", "doc_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id"))).alias("first")
    if ids.filter("uid IS DISTINCT FROM doc_id").limit(1).count() == 0:
        return found.select("uid", F.col("uid").alias("doc_id"), "class_uid", F.col("class_uid").alias("class_id"))
    named = written(found.join(ids, "uid"), "classes")
    return named.join(named.groupBy("class_uid").agg(first), "class_uid").select("uid", "doc_id", "class_uid", F.col("first.doc_id").alias("class_id"))


def deduplicated(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """docs with one row of each class, that of the least doc_id; the columns stay as they are.

    Rows are told apart by doc_id where that is unique, else by their place in a written copy.
    """
    inner = [f"c{i}" for i in range(len(docs.columns))]
    at, key = inner[docs.columns.index("text")], inner[docs.columns.index("doc_id")]
    flat = docs.toDF(*inner)
    n, ids, some = flat.agg(F.count("*"), F.countDistinct(key), F.count(key)).first()
    if n == ids == some:
        flat = flat.withColumn("uid", F.col(key))
    else:
        flat = written(flat.withColumn("uid", F.monotonically_increasing_id()), "documents")
    rows = flat.select("uid", F.coalesce(at, F.lit("")).alias("text"))
    member_of, comp = links(rows, threshold)
    found = member_of.join(comp.withColumnRenamed("v", "rep"), "rep", "left").select("uid", F.coalesce("c", "rep").alias("class_uid"))
    gone = found.filter("uid <> class_uid").select("uid")
    return flat.join(gone, "uid", "left_anti").select(*inner).toDF(*docs.columns)
