"""Token ids in Simple-8b words: encode, write in document order, read back.

Format of a file (little-endian): magic ``SQT1``, u32 count of blocks, u64 count of
ids, then for each block u64 first word and u32 ids held, then the 64-bit words.
A word has its selector in the top four bits and 60 bits of data. Selectors 1 to 14
pack a fixed count of ids of equal width; selector 15 is an escape: the following
word is one literal 64-bit value. Each block starts on a word of its own, so blocks
decode independently, and within a block all words of one selector decode at once.

Defined results: a null text is empty and still has its end id; a very long text is one
row of one file, which may then be longer than ``file_ids``; equal doc_ids follow each
other in the order of their texts' hashes; a null doc_id comes first; an empty table
gives an empty result and no file. Other columns are not read.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, pick, scratch, written
from .warc import open_fs, put

MAGIC = b"SQT1"
#: Selector -> (ids a word, bits an id); 60 data bits.
PACKING = {1: (60, 1), 2: (30, 2), 3: (20, 3), 4: (15, 4), 5: (12, 5), 6: (10, 6), 7: (8, 7), 8: (7, 8), 9: (6, 10), 10: (5, 12), 11: (4, 15), 12: (3, 20), 13: (2, 30), 14: (1, 60)}
ESCAPE = 15
BLOCK_IDS = 1 << 16
PARTS_A_GROUP = 2000


#: Bits of the numbers below 2**16, at least 1.
WIDTHS = np.maximum(np.frexp(np.arange(1 << 16, dtype=np.float64))[1], 1).astype(np.uint8)


def widths(ids: np.ndarray) -> np.ndarray:
    """Bits of each id, at least 1. Below 2**53 they are the exponent of the id as a double."""
    top = int(ids.max())
    if top < 1 << 16:
        return WIDTHS[ids.astype(np.uint16)]
    if top < 1 << 53:
        return np.maximum(np.frexp(ids.astype(np.float64))[1], 1).astype(np.uint8)
    return np.array([max(1, x.bit_length()) for x in ids.tolist()], np.uint8)


def pack(ids: np.ndarray) -> np.ndarray:
    """Simple-8b words of one block of ids (uint64).

    How many ids fit from each place is found for all places at once by a running
    maximum of widths; only the walk from word to word is a loop.
    """
    ids = np.ascontiguousarray(ids, np.uint64)
    n = len(ids)
    if not n:
        return np.empty(0, np.uint64)
    bits = widths(ids)
    best = np.where(bits > 60, ESCAPE, 14).astype(np.uint8)
    top, span = bits.copy(), 1
    for sel in range(13, 0, -1):
        count, width = PACKING[sel]
        if count > n:
            break
        while span < count:  # the maximum over `count` ids from two overlapping runs
            step = min(span, count - span)
            m = n - span - step + 1
            top = np.maximum(top[:m], top[step : step + m])
            span += step
        fits = top <= width
        if fits.any():
            np.copyto(best[: len(top)], sel, where=fits)
    fit = bytes([0] + [PACKING[s][0] for s in range(1, 15)] + [1])
    step = best.tobytes().translate(fit.ljust(256, b"\0"))
    starts, i = [], 0
    while i < n:
        starts.append(i)
        i += step[i]
    at = np.array(starts, np.int64)
    sel = best[at]
    place = np.arange(len(at)) + np.concatenate([[0], np.cumsum(sel == ESCAPE)[:-1]])
    out = np.zeros(len(at) + int((sel == ESCAPE).sum()), np.uint64)
    for s, (count, width) in PACKING.items():
        rows = np.flatnonzero(sel == s)
        if len(rows):
            first, word = at[rows], np.full(len(rows), s << 60, np.uint64)
            for k in range(count):
                word |= ids[first + k] << np.uint64(k * width)
            out[place[rows]] = word
    rows = np.flatnonzero(sel == ESCAPE)
    out[place[rows]] = np.uint64(ESCAPE << 60)
    out[place[rows] + 1] = ids[at[rows]]
    return out


def unpack(words: np.ndarray, n: int) -> np.ndarray:
    """The n ids of a block: one vectorised pass for each selector that occurs."""
    words = np.ascontiguousarray(words, np.uint64)
    sel = (words >> np.uint64(60)).astype(np.int64)
    if (sel == ESCAPE).any():  # literals follow escapes and can look like any selector
        keep, i, listed = [], 0, sel.tolist()
        while i < len(listed):
            keep.append(i)
            i += 2 if listed[i] == ESCAPE else 1
        heads = np.array(keep, np.int64)
    else:
        heads = np.arange(len(words))
    kinds = sel[heads]
    fit = np.array([0] + [PACKING[s][0] for s in range(1, 15)] + [1], np.int64)
    base = np.concatenate([[0], np.cumsum(fit[kinds])])
    out = np.zeros(int(base[-1]), np.uint64)
    for s, (count, width) in PACKING.items():
        rows = np.flatnonzero(kinds == s)
        if len(rows):
            shifts = (np.arange(count) * width).astype(np.uint64)
            vals = (words[heads[rows]][:, None] >> shifts) & np.uint64((1 << width) - 1)
            out[base[rows][:, None] + np.arange(count)] = vals
    rows = np.flatnonzero(kinds == ESCAPE)
    out[base[rows]] = words[heads[rows] + 1] if len(rows) else 0
    return out[:n]


def file_bytes(ids: np.ndarray, block_ids: int = BLOCK_IDS) -> bytes:
    packed = [pack(ids[i : i + block_ids]) for i in range(0, len(ids), block_ids)]
    held = [min(block_ids, len(ids) - i) for i in range(0, len(ids), block_ids)]
    heads, at = [], 0
    for words, n in zip(packed, held, strict=True):
        heads.append(struct.pack("<QI", at, n))
        at += len(words)
    return b"".join([MAGIC, struct.pack("<IQ", len(packed), len(ids)), *heads, *(w.astype("<u8").tobytes() for w in packed)])


def read_ids(data: bytes) -> np.ndarray:
    """All ids of a file."""
    if data[:4] != MAGIC:
        raise ValueError("not a token file")
    n_blocks, n = struct.unpack_from("<IQ", data, 4)
    heads = [struct.unpack_from("<QI", data, 16 + 12 * i) for i in range(n_blocks)]
    words = np.frombuffer(data, "<u8", offset=16 + 12 * n_blocks)
    ends = [*(h[0] for h in heads[1:]), len(words)][: len(heads)]
    parts = [unpack(words[a:b], held) for (a, held), b in zip(heads, ends, strict=True)]
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


#: Signs that may end a piece and are then a token run of their own; no letter, digit, blank, quote or bracket of a special token.
TAIL = ".,!*$#%&;:?"
#: The normalizer and pre-tokenizer that the shortcuts of ``WordEncoder`` hold for.
WORD_RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}


def packed_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Memo(dict):
    """A dictionary that makes missing values, in two generations.

    When the young one is full it becomes the old one; what is used again moves back.
    """

    def __init__(self, make, limit: int) -> None:
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value

    def trim(self) -> None:
        if len(self) > self.limit:
            self.old = dict(self)
            self.clear()


class PlainEncoder:
    """Any tokenizer: whole texts go to it as they are."""

    def __init__(self, tokenizer) -> None:
        self.tokenizer = tokenizer

    def encode(self, texts: list[str]) -> list[bytes]:
        return [packed_ids(self.tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]


class WordEncoder(PlainEncoder):
    """A tokenizer of WORD_RULES, with bounded memos of pieces between blanks and of words.

    Blanks and newlines are dropped by the tokenizer and no token crosses one, so a
    text's ids are those of its pieces joined; likewise a letter and the signs after it
    never share a token. A piece is thus its word in lower case and its tail, where
    that changes nothing (see ``word_of``). A word of Latin letters is one pre-token
    that no normalizer changes: its bytes go to the BPE model itself. Other words go
    through the whole tokenizer. Ids are kept as packed uint32.
    """

    def __init__(self, tokenizer, pieces: int = 300_000, words: int = 500_000) -> None:
        from tokenizers.pre_tokenizers import ByteLevel

        super().__init__(tokenizer)
        self.model = tokenizer.model
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {ord(c): level.pre_tokenize_str(c)[0][0] for c in map(chr, range(0x80, 0x250)) if c.isalpha()}
        self.words = Memo(self.word_ids, words)
        self.pieces = Memo(self.piece_ids, pieces)

    @staticmethod
    def word_of(piece: str) -> tuple[str, str]:
        """The piece's word, in lower case if that is safe, and its tail of signs."""
        if "<|" in piece:
            return piece, ""
        word = piece.rstrip(TAIL)
        tail = piece[len(word) :]
        end = word[-1:]
        if not end.isalpha() or end >= "\u0250" or end == "\u0130":  # lower case may end in a mark
            word, tail = piece, ""
        if word.isascii() or (max(word) < "\u0250" and "\u0130" not in word):
            word = word.lower()  # Latin letters: one for one, nothing to compose
        return word, tail

    def piece_ids(self, piece: str) -> bytes:
        word, tail = self.word_of(piece)
        return self.words[word] + self.words[tail] if tail else self.words[word]

    def word_ids(self, word: str) -> bytes:
        if word.isalpha() and word.islower():
            if not word.isascii():
                if max(word) >= "\u0250":
                    return self.whole_ids(word)
                word = word.translate(self.letters)
            return packed_ids([t.id for t in self.model.tokenize(word)])
        return self.whole_ids(word)

    def whole_ids(self, text: str) -> bytes:
        return packed_ids(self.tokenizer.encode(text, add_special_tokens=False).ids) if text else b""

    def encode(self, texts: list[str]) -> list[bytes]:
        self.pieces.trim()
        self.words.trim()
        found = self.pieces.__getitem__
        return [b"".join(map(found, t.replace("\n", " ").split(" "))) for t in texts]


def make_encoder(path: str) -> PlainEncoder:
    """The encoder whose shortcuts the tokenizer's own description allows."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    said = json.loads(tokenizer.to_str())
    model = said["model"]
    plain_model = model["type"] == "BPE" and model["end_of_word_suffix"] == "</w>" and not any(model[k] for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback"))
    plain_added = all(t["special"] and not t["normalized"] and t["content"].startswith("<|") for t in said["added_tokens"])
    if plain_model and plain_added and all(said[k] == v for k, v in WORD_RULES.items()):
        return WordEncoder(tokenizer)
    return PlainEncoder(tokenizer)


ENCODERS: dict[str, PlainEncoder] = {}


def encoder(path: str) -> PlainEncoder:
    """One encoder for each tokenizer file and Python worker."""
    if path not in ENCODERS:
        ENCODERS[path] = make_encoder(path)
    return ENCODERS[path]


def write_tokens(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 1, part_bytes: int = 16 << 20, file_ids: int = 4 << 20) -> DataFrame:
    """Encode the texts and write files in ascending order of doc_id.

    part_bytes: about how much text a task encodes.

    Returns one row a document: file, its number in order (part, seq), the place of
    the document's ids in the file, and the number of ids there.
    """
    rows = pick(docs, "doc_id", "text").withColumn("tie", F.xxhash64("text"))
    order = (F.col("doc_id").asc_nulls_first(), F.col("tie"))
    n_bytes = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    n_parts = max(1, -(-n_bytes // part_bytes))
    spread = rows.repartitionByRange(n_parts, *order).sortWithinPartitions(*order)

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(tokenizer_path)
        tail = np.array([end_id], "<u4").tobytes()
        part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0
        out: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal seq, held, size, out
            if not out:
                return
            name = f"part-{part:06d}-{seq:05d}.sqt"
            put(f"{folder}/{name}", file_bytes(np.frombuffer(b"".join(held), "<u4").astype(np.uint64)))
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(out)), pa.array([part] * len(out), pa.int32()), pa.array([seq] * len(out), pa.int32()), *(pa.array(c, pa.int64()) for c in cols)],
                names=["file", "part", "seq", "doc_id", "at", "n_tokens"],
            )
            seq, held, size, out = seq + 1, [], 0, []

        for batch in batches:
            texts = column(batch, "text")
            keys = column(batch, "doc_id").to_pylist()
            for lo in range(0, len(keys), 1024):
                hi = min(lo + 1024, len(keys))
                coded = enc.encode([t or "" for t in texts.slice(lo, hi - lo).to_pylist()])
                for k, c in zip(keys[lo:hi], coded, strict=True):
                    if size >= file_ids:
                        yield from flush()
                    n = len(c) // 4 + 1
                    held += [c, tail]
                    out.append((k, size, n))
                    size += n
        yield from flush()

    return written(spread.mapInArrow(write, "file string, part int, seq int, doc_id long, at long, n_tokens long"), "tokens")


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """Documents read back from the files: start, n_tokens and ids_crc32, with their ids.

    Each file is decoded once by the task that has its rows. Starts are running sums over
    files: within groups of parts, and over the groups, of which there are few.
    """
    files = manifest.groupBy("part", "seq", "file").agg(F.sum("n_tokens").alias("n")).withColumn("group", F.floor(F.col("part") / PARTS_A_GROUP))
    groups = files.groupBy("group").agg(F.sum("n").alias("all"))
    groups = groups.select("group", (F.sum("all").over(Window.orderBy("group")) - F.col("all")).alias("before"))
    within = F.sum("n").over(Window.partitionBy("group").orderBy("part", "seq"))
    files = files.withColumn("within", within - F.col("n")).join(groups, "group").withColumn("base", F.col("before") + F.col("within"))
    rows = manifest.join(files.select("file", "base"), "file").repartition("file").sortWithinPartitions("file", "at")

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[str | None, np.ndarray] = (None, np.empty(0, "<u4"))
        for batch in batches:
            files_, at, n = (column(batch, c).to_pylist() for c in ("file", "at", "n_tokens"))
            crcs, ids = [], []
            for f, a, k in zip(files_, at, n, strict=True):
                if f != held[0]:
                    fs, path = open_fs(f"{folder}/{f}")
                    with fs.open_input_stream(path, compression=None) as src:
                        held = (f, read_ids(src.read()).astype("<u4"))
                own = held[1][a : a + k]
                if len(own) != k:
                    raise ValueError(f"{f} ends within a document")
                ids.append(own.tobytes())
                crcs.append(zlib.crc32(ids[-1]))
            base = np.array(column(batch, "base").to_pylist(), np.int64) + np.array(at, np.int64)
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), pa.array(base), pa.array(n, pa.int64()), pa.array(crcs, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    return rows.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_table(docs: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    folder = scratch(docs.sparkSession, "token-files")
    return read_tokens(write_tokens(docs, tokenizer_path, folder, end_id), folder)
