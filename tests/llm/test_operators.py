"""Operators on small tables: defined edge cases and brute force."""

import base64
import collections
import hashlib
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from spatialq.llm import common, decontam, lm_score, mixing, nbsvm, near, quality_rules, sharding, substring, tokens, warc
from spatialq.llm.words import FOLD
from spatialq.operators import graph

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, ids=None, extra=False):
    ids = list(range(len(texts))) if ids is None else ids
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in zip(ids, texts)], DOCS)
    return df.withColumn("shard", F.lit("x")).withColumn("TEXT ", F.lit(1)).withColumn("uid", F.lit(2)).withColumn("key", F.lit(3)) if extra else df


ODD = [None, "", " \n", "one", "a b c d e f", "a b c d e f", "Word " * 3000, "x" * 5000, "äöü ß 12 %%%", "a b c d e f"]


def test_pick_tells_case_apart(spark):
    df = spark.createDataFrame([(1, "a", "b")], "doc_id long, text string, TEXT string")
    assert common.pick(df, "doc_id", "text").collect() == [(1, "a")]


# sharding


def jump_reference(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash_equals_the_published_loop(spark):
    keys = [0, 1, 2, 12345, 2**59 + 7, 2**60 - 1] + [random.Random(1).getrandbits(60) for _ in range(200)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 16, 17):
        assert [r[0] for r in df.select(sharding.jump_hash(F.col("k"), n)).collect()] == [jump_reference(k, n) for k in keys]


def test_shard_table(spark):
    ids = [None, 7, 7, *range(10, 400)]
    texts = ["t%s" % i for i in ids]
    texts[0] = None
    got = sharding.shard_table(docs_of(spark, texts, ids, extra=True), 4, rows_per_group=10).collect()
    assert len(got) == len(ids)
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        key = int(hashlib.md5(str("null" if r.doc_id is None else r.doc_id).encode()).hexdigest()[:15], 16)
        assert r.shard == jump_reference(key, 4) and r.grown_shard in (r.shard, 4)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    by = {r.doc_id: r for r in got if r.doc_id not in (7, None)}
    assert by[10].size == 4 and by[10].text_crc32 == zlib.crc32(b"t10")
    assert sharding.shard_table(docs_of(spark, []), 4).count() == 0


# quality rules


def base_reference(text):
    import re

    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    c = collections.Counter(grams)
    hit = {p for i, g in enumerate(grams) if c[g] > 1 for p in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in text), len(lines) - len(set(lines)), len(hit)


def test_base_measures(spark):
    random.seed(4)
    texts = ODD + [" ".join(random.choice("abcd") for _ in range(random.randint(0, 60))) for _ in range(60)] + ["l\nl\n\n \nl x|# y"]
    got = {r.doc_id: r for r in quality_rules.cascade(docs_of(spark, texts, extra=True)).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        want = base_reference(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
    assert quality_rules.cascade(docs_of(spark, [])).count() == 0


def test_rule_order_does_not_change_the_verdict(spark):
    clean = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(40))
    texts = [clean, clean.upper(), clean.replace(" ", "!! "), clean.replace(" ", " | "), None]
    df = docs_of(spark, texts)
    rules = quality_rules.default_rules()
    a = sorted(map(tuple, quality_rules.cascade(df, rules).select("doc_id", "kept").collect()))
    b = sorted(map(tuple, quality_rules.cascade(df, rules[::-1]).select("doc_id", "kept").collect()))
    assert a == b == [(0, True), (1, False), (2, False), (3, False), (4, False)]
    order = quality_rules.ordered_rules(df, rules)
    gains = [rate / cost if cost else 0 for _, cost, rate in order]
    assert gains == sorted(gains, reverse=True)


# WARC


def test_warc_round_trip(spark, tmp_path):
    pages = [(1, "http://a", "<p>ä"), (2, None, "<p>ä"), (3, "http://c", None), (4, "http://d", ""), (5, "http://e", "x" * 300_000), (None, "u", "<p>ä"), (6, "http://f", "WARC/1.0\r\n\r\n")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("payload", F.lit(1)).repartition(2)
    got = {r.page_id: r for r in warc.round_trip(df, roll_bytes=1000).collect()}
    assert len(got) == len(pages)
    for page, _, html in pages:
        data = (html or "").encode()
        r = got[page]
        assert r.payload_bytes == len(data)
        assert r.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert r.record_type == ("revisit" if page in (2, 4, None) else "response")
        assert r.payload is None or bytes(r.payload) == data
    assert got[2].refers_to == 1 and got[None].refers_to == 1 and got[4].refers_to == 3
    assert warc.round_trip(df.limit(0)).count() == 0


def test_warc_keeps_all_rows_of_many_partitions(spark):
    """Each partition has archives of its own, also where a task holds several."""
    df = spark.range(0, 9000, 1, 9).selectExpr("id AS page_id", "'u' AS url", "cast(id DIV 2 AS string) AS html")
    got = warc.round_trip(df).select("page_id", "record_type", "refers_to", "payload").collect()
    assert sorted(r.page_id for r in got) == list(range(9000))
    assert all((r.record_type, r.refers_to) == (("revisit", r.page_id - 1) if r.page_id % 2 else ("response", None)) for r in got)
    assert all(bytes(r.payload) == str(r.page_id // 2).encode() for r in got if r.payload is not None)


def test_repeated_rows_have_one_response(spark):
    pages = [(1, "u", "x"), (1, "u", "x"), (1, "a", "x"), (2, "u", "x"), (None, None, "y"), (None, None, "y"), (None, None, None), (7, "long", "z" * 2_000_000), (7, "long", "z" * 2_000_000), (8, "b", "w"), (9, "a", "w")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("record", F.lit(1)).withColumn("HTML ", F.lit(2)).repartition(3)
    got = warc.round_trip(df, roll_bytes=1000).collect()
    assert len(got) == len(pages)
    by = collections.defaultdict(list)
    for r in got:
        by[r.payload_digest].append(r)
    for rows in by.values():
        (first,) = (r for r in rows if r.record_type == "response")
        assert first.refers_to is None and all(r.refers_to == first.page_id for r in rows if r.record_type == "revisit")
        assert first.page_id == min((r.page_id for r in rows if r.page_id is not None), default=None)
    x = by[base64.b32encode(hashlib.sha1(b"x").digest()).decode()]
    assert [r.target_uri for r in x if r.record_type == "response"] == ["a"] and len(x) == 4
    assert [r.record_type for r in warc.round_trip(df, dedup_min_bytes=2).collect()].count("revisit") == 1


def test_payloads_are_not_shuffled(spark, tmp_path):
    df = spark.createDataFrame([(i, "u", "p%d" % (i % 3)) for i in range(20)], "page_id long, url string, html string")
    records = warc.write_archives(df, f"file://{tmp_path}/whole")
    assert "payload" not in {c for c in records.columns if c != "payload_bytes"}
    plan = warc.archive_plan(records)
    assert plan.selectExpr("sum(size(revisits))").first()[0] == 17 and plan.selectExpr("sum(records)").first()[0] == 20


def test_normalised_archives_have_members_and_sidecars(spark, tmp_path):
    import gzip

    df = spark.createDataFrame([(i, "u", "p%d" % i) for i in range(20)], "page_id long, url string, html string").coalesce(1)
    base = f"file://{tmp_path}"
    files = warc.archive_plan(warc.write_archives(df, f"{base}/whole"))
    done = warc.normalise(files, f"{base}/whole", f"{base}/members")
    assert sorted(map(tuple, done.collect())) == sorted((r.file, r.records) for r in files.collect())
    rows = {(r.file, r.member): (r.offset, r.length) for r in warc.sidecar_rows(done, f"{base}/members").collect()}
    for r in files.collect():
        whole = gzip.decompress((tmp_path / "whole" / r.file).read_bytes())
        data = (tmp_path / "members" / r.file).read_bytes()
        index = warc.read_index(f"{base}/members/{r.file}.idx")
        assert len(index) == r.records and index == [rows[r.file, k] for k in range(r.records)]
        assert b"".join(gzip.decompress(data[a : a + n]) for a, n in index) == whole
        assert list(warc.split_members(f"{base}/members/{r.file}", piece=7)) == list(warc.split_members(f"{base}/whole/{r.file}"))


# tokens


def test_token_table(spark):
    public = pytest.importorskip("public_tokenizers")
    import numpy as np
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    ids = [5, 3, None, 9, 9, *range(20, 15 + len(ODD))]
    df = docs_of(spark, ODD, ids, extra=True).repartition(3)
    got = tokens.token_table(df, path).collect()
    want = {}
    for i, t in zip(ids, ODD):
        e = whole.encode(t or "", add_special_tokens=False).ids + [1]
        want.setdefault(i, []).append((len(e), zlib.crc32(np.array(e, "<u4").tobytes())))
    rows = sorted(got, key=lambda r: r.start)
    keys = [r.doc_id for r in rows]
    assert keys == sorted(ids, key=lambda x: (x is not None, x))
    at = 0
    for r in rows:
        assert r.start == at and (r.n_tokens, r.ids_crc32) in want[r.doc_id]
        at += r.n_tokens
    assert tokens.token_table(docs_of(spark, []), path).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoders_agree_with_their_tokenizers(name):
    public = pytest.importorskip("public_tokenizers")
    import numpy as np
    from tokenizers import Tokenizer

    rng = random.Random(5)
    signs = list("abcXYZéÉßäÄñÑçİıſKﬁǅǰẖẗ ÅåΣσς0129٣.,!*$#%&;:?'\"<>|-_()[]{}—“”\n\t\r\x1c\x85\u0331\u0301\u0307\u0308\u030c中文日本語кириллицаЖ🙂 ")
    signs += ["'s", "'t", "'re", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", " ", " ", "\n", "don't", "The"]
    whole, fast = Tokenizer.from_file(public.path(name)), tokens.make_encoder(public.path(name))
    assert isinstance(fast, tokens.WordEncoder) == name.startswith("word")
    for _ in range(40):
        texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(60)]
        want = [np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
        assert fast.encode(texts) == want


def test_starts_run_over_groups_of_parts(spark, monkeypatch):
    public = pytest.importorskip("public_tokenizers")
    monkeypatch.setattr(tokens, "PARTS_A_GROUP", 2)
    folder = common.scratch(spark, "t")
    texts = ["long " * 3000, *("w%d" % i for i in range(60))]
    manifest = tokens.write_tokens(docs_of(spark, texts, list(range(len(texts)))), public.path("word_bpe_49k.json"), folder, part_bytes=200, file_ids=8)
    assert manifest.select("part").distinct().count() > 6
    rows = sorted(tokens.read_tokens(manifest, folder).collect(), key=lambda r: r.doc_id)
    assert [r.start for r in rows] == [sum(r.n_tokens for r in rows[:i]) for i in range(len(rows))]


# decontamination


def contaminated_reference(docs, items, size=13):
    words = lambda t: (t or "").encode().translate(FOLD).split()
    wins = collections.defaultdict(set)
    for k, t in items:
        w = words(t)
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            wins[tuple(w[i : i + n])].add(str(k))
    out = {}
    for d, t in docs:
        w, hit, own = words(t), set(), set()
        for n in {len(x) for x in wins}:
            for i in range(len(w) - n + 1):
                found = wins.get(tuple(w[i : i + n]))
                if found:
                    own |= found
                    hit |= set(range(i, i + n))
        out[d] = (len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


def test_contamination(spark):
    random.seed(6)
    vocab = ["The", "of", "Ciónja", "x1", "and", "is", "ä"]
    text = lambda n: " ".join(random.choice(vocab) for _ in range(n))
    items = [(0, text(30)), (1, text(5)), (2, None), (3, "!!"), (10, text(20)), (10, text(14)), (4, "never seen words here")]
    docs = [(i, t) for i, t in enumerate([None, "", "%%"])]
    for i in range(3, 80):
        k, t = random.choice([x for x in items if x[1]])
        w = t.split()
        a = random.randint(0, max(0, len(w) - 14))
        docs.append((i, text(random.randint(0, 200)) + "; " + ", ".join(w[a : a + random.randint(3, 20)]).upper() + " " + text(random.randint(0, 30))))
    got = decontam.contamination(docs_of(spark, [t for _, t in docs], extra=True).repartition(3), spark.createDataFrame(items, "item_id long, text string"))
    want = contaminated_reference(docs, items)
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got.collect()} == want
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contamination(docs_of(spark, ["a b"]), empty).select("n_hit", "contaminated").collect() == [(0, False)]
    assert decontam.contamination(docs_of(spark, []), empty).count() == 0


def test_proximity(spark):
    df = docs_of(spark, ["the red fox saw a lazy dog", "dog fox", "fox " + "x " * 20 + "dog"]).coalesce(1)
    index = decontam.build_index(df, common.scratch(spark, "t"))
    phrases = spark.createDataFrame([("p", ["fox", "dog"])], "phrase string, terms array<string>")
    got = sorted((r.start, r.length) for r in decontam.find_near(index, phrases, 6).collect())
    assert got == [(2, 5), (7, 2)]
    exact = spark.createDataFrame([("q", ["red", "fox"])], "phrase string, terms array<string>")
    assert [(r.start, r.length) for r in decontam.find_phrases(index, exact).collect()] == [(1, 2)]


# language model


def test_stupid_backoff(spark):
    random.seed(8)
    texts = [None, "", *(" ".join(random.choice("abcde") for _ in range(random.randint(0, 30))) for _ in range(40))]
    got = {r.doc_id: r for r in lm_score.scores(docs_of(spark, texts, extra=True).repartition(3), 3, bucket_entries=50).collect()}
    grams, total = collections.Counter(), 0
    split = [(t or "").split() for t in texts]
    for w in split:
        total += len(w)
        for n in (1, 2, 3):
            grams.update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    for i, w in enumerate(split):
        score = 0.0
        for j in range(len(w)):
            n = min(3, j + 1)
            while n > 1 and grams[tuple(w[j - n + 1 : j + 1])] < 2:
                score += math.log10(0.4)
                n -= 1
            g = tuple(w[j - n + 1 : j + 1])
            score += math.log10(grams[g] / (total if n == 1 else grams[g[:-1]]))
        assert abs(got[i].log_score - score) < 1e-9 and got[i].n_words == len(w)
        assert (got[i].mean_log_score is None) == (not w)
    assert lm_score.scores(docs_of(spark, [])).count() == 0
    again = {r.doc_id: r.log_score for r in lm_score.scores(docs_of(spark, texts).repartition(7), 3, bucket_entries=500).collect()}
    assert all(again[i] == got[i].log_score for i in again)  # to the last digit, however documents are dealt
    assert got[0].log_score == 0 and got[0].mean_log_score is None
    table = lm_score.count_table(docs_of(spark, texts), 2, 3)
    assert table.agg(F.sum("n")).first()[0] == sum(n for g, n in grams.items() if len(g) < 3)


# substring dedup


def removed_reference(texts, k):
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i : i + k] for b in raw for i in range(len(b) - k + 1))
    out = []
    for b in raw:
        m = bytearray(len(b))
        for i in range(len(b) - k + 1):
            if seen[b[i : i + k]] > 1:
                m[i : i + k] = b"\1" * k
        kept = bytes(c for c, f in zip(b, m) if not f)
        out.append((len(b), sum(m), sum(1 for i, f in enumerate(m) if f and not (i and m[i - 1])), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("batch_rows", [20_000, 5])
def test_substring_dedup(spark, monkeypatch, batch_rows):
    random.seed(9)
    vocab = ["the ", "of", "be ", "aa", "ciónja\n", "x"]
    text = lambda n: "".join(random.choice(vocab) for _ in range(n))
    base = [text(120) for _ in range(3)]
    texts = [None, "", "ab" * 300, "short"]
    for i in range(50):
        b = random.choice(base)
        a = random.randint(0, len(b) // 2)
        texts.append(text(random.randint(0, 80)) + b[a : a + random.randint(100, 400)] + text(20) + "be " * random.choice([0, 90]))
    texts += texts[6:8]
    whole = substring.repeated_spans
    monkeypatch.setattr(substring, "repeated_spans", lambda rows, k: whole(rows, k, batch_rows))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substring.dedup(docs_of(spark, texts, extra=True).repartition(3), 200).collect()}
    want = removed_reference(texts, 200)
    assert [got[i] for i in range(len(texts))] == want


def test_substring_dedup_of_long_texts_and_odd_ids(spark):
    random.seed(10)
    long = "".join(random.choice("abcdefgh ") for _ in range(3000))
    texts = [long, long[500:900] + "q", None, long]
    got = substring.dedup(docs_of(spark, texts, [None, 4, 4, 7]), 200, keep_bytes=True).collect()
    assert sorted((r.n_bytes, r.n_removed) for r in got) == [(0, 0), (401, 400), (3000, 3000), (3000, 3000)]
    assert {bytes(r.kept) for r in got} == {b"", b"q"}
    assert substring.dedup(docs_of(spark, []), 200).count() == 0


def test_pieces_of_long_texts_keep_every_start():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(1)
    data = rng.integers(97, 105, 5000).astype(np.uint8)
    whole = substring.anchor_rows(data, np.array([0, len(data)]), 200)
    starts = sum((whole["hi"] - whole["lo"] + 1).tolist())
    assert starts == 5000 - 199


# near duplicates


def test_near_duplicates(spark):
    random.seed(11)
    word = lambda: "".join(random.choice("abcdefghij") for _ in range(4))
    base = [word() for _ in range(120)]
    texts = [" ".join(base)]
    for _ in range(40):
        w = list(base)
        w[random.randrange(120)] = word()
        texts.append(" ".join(w))
    texts += [" ".join(word() for _ in range(120)) for _ in range(30)]
    texts += [texts[50].upper() + "!", "", None, "%", "%", "one two", "One, two."]
    got = {r.doc_id: r.class_id for r in near.classes(docs_of(spark, texts, extra=True)).collect()}
    assert all(got[i] == 0 for i in range(41))
    assert [got[i] for i in range(41, 71)] == list(range(41, 71))
    assert got[71] == 50 and got[72] == got[73] == 72 and got[74] == got[75] == 74 and got[76] == got[77] == 76
    assert near.classes(docs_of(spark, [])).count() == 0


def test_near_duplicates_with_odd_ids(spark):
    text = " ".join(f"w{i}" for i in range(30))
    df = docs_of(spark, [text, text + " x", text, "other words"], [None, 5, 5, 6], extra=True)
    assert sorted((r.doc_id or 0, r.class_id) for r in near.classes(df).collect()) == [(0, 5), (5, 5), (5, 5), (6, 6)]
    kept = near.deduplicated(df)
    assert kept.columns == df.columns and kept.count() == 2


def test_large_buckets_stay_exact(spark, monkeypatch):
    monkeypatch.setattr(near, "SMALL", 2)
    random.seed(12)
    word = lambda: "".join(random.choice("abcdefghij") for _ in range(4))
    shared = [word() for _ in range(200)]
    texts, want = [], []
    for g in range(6):  # groups that share most shingles with each other, though fewer than the threshold asks
        own = shared + [word() for _ in range(60)]
        for c in range(4):
            w = list(own)
            w[random.randrange(len(w))] = word()
            texts.append(" ".join(w))
            want.append(4 * g)
    got = {r.doc_id: r.class_id for r in near.classes(docs_of(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_common_passage_hides_no_pair(spark):
    """Hundreds of texts share most of a passage, each with one near copy: classes of all pairs by brute force."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    passage = [word() for _ in range(170)]
    texts = []
    for _ in range(150):
        own = [word() for _ in range(rng.randrange(28, 36))]
        texts.append(" ".join(passage + own))
        texts.append(" ".join(passage + own[: rng.randrange(8, 14)] + [word() for _ in range(18)]))
    import numpy as np

    blob = np.frombuffer(" ".join(texts).encode(), np.uint8)
    lens = [len(t) for t in texts]
    offs = np.concatenate([[0], np.cumsum(np.array(lens) + 1)])
    offs[-1] -= 1
    h, cuts = near.word_hashes(blob, offs)
    seqs = [near.shingles(h[x:y]) for x, y in zip(cuts, cuts[1:], strict=False)]
    want = list(range(len(texts)))
    linked = 0
    for i in range(len(texts)):
        for j in range(i):
            if near.similar(seqs[i], seqs[j], 0.8):
                linked += 1
                a, b = want[i], want[j]
                want = [min(a, b) if w in (a, b) else w for w in want]
    assert 100 < linked < 300
    got = {r.doc_id: r.class_id for r in near.classes(docs_of(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 102), (101, 102), (7, 7)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert all(got[i] == 0 for i in range(31)) and got[100] == got[101] == got[102] == 100
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# quality classifier


def test_classifier(spark):
    random.seed(13)
    word = lambda: "".join(random.choice("abcdefghij") for _ in range(random.randint(2, 8)))
    texts, y = [], []
    for i in range(300):
        w = [word() for _ in range(60)]
        good = i % 3 > 0
        texts.append(" ".join(w) if good else " ".join(x + "!!" for x in w).upper())
        y.append(int(good))
    docs = docs_of(spark, [*texts, None, "", "x" * 200_000], extra=True)
    labels = spark.createDataFrame([*enumerate(y), (5, None), (None, 1), (10**6, 0)], "doc_id long, quality int")
    got = {r.doc_id: r for r in nbsvm.quality_table(docs, labels, max_train=50).collect()}
    assert len(got) == 303 and all(0 <= r.score <= 1 for r in got.values())
    out = [(got[i].predicted == y[i]) for i in range(300) if got[i].held_out]
    assert len(out) > 50 and sum(out) / len(out) > 0.97
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(303))
    assert got[300].score == got[301].score
    none = nbsvm.quality_table(docs, labels.limit(0)).select("score").distinct().collect()
    assert none == [(0.5,)]
    assert nbsvm.quality_table(docs.limit(0), labels).count() == 0
    model = nbsvm.fit(*nbsvm.training_rows(docs, labels, "quality", 50))
    kept = nbsvm.accepted(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {i for i, r in got.items() if r.score >= 0.5}


def test_classifier_reaches_the_optimum():
    """The fit against projected gradient ascent on the dense dual of the same problem."""
    import numpy as np

    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 30, 12)) + (i % 2) * rng.integers(0, 3) for i in range(40)]
    labels = np.arange(40) % 2
    y = np.where(labels > 0, 1.0, -1.0)
    p, q = np.ones(nbsvm.SIZE), np.ones(nbsvm.SIZE)
    for r, label in zip(rows, labels):
        (p if label else q)[r] += 1
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    x = np.zeros((40, 41))
    for i, r in enumerate(rows):
        x[i, r] = ratio[r] / np.sqrt((ratio[r] ** 2).sum())
    x[:, 40] = 1.0  # the bias
    gram = (x @ x.T) * np.outer(y, y)
    top, alpha = np.ones(40), np.zeros(40)
    for _ in range(60_000):
        alpha = np.clip(alpha + 0.02 * (1 - gram @ alpha), 0, top)
    w = x.T @ (alpha * y)
    model = nbsvm.fit(rows, labels, epochs=4000, beta=1.0)
    for i, r in enumerate(rows):
        seen = np.zeros(nbsvm.SIZE, np.float32)
        seen[r] = 1
        assert model.margins(seen) + model.bias == pytest.approx(float(x[i] @ w), abs=2e-3)


def test_long_texts_have_the_same_features():
    import numpy as np

    text = "".join(random.Random(3).choice("abcdefgh ") for _ in range(150_000))
    data = np.frombuffer(text.encode(), np.uint8)
    whole = np.unique(np.concatenate([nbsvm.char_features(data), nbsvm.shape_features(text, nbsvm.Shapes())]))
    assert nbsvm.features(data, text, nbsvm.Shapes()).tolist() == whole.tolist()


# mixing


def posterior_reference(texts, labelled, domains, text):
    """The classifier, word by word: labelled is a list of (text, domain)."""
    counts = {d: collections.Counter() for d in domains}
    for t, d in labelled:
        counts[d].update(hashed(w) for w in (t or "").split())
    logs = []
    words = (text or "").split()
    scale = min(1.0, mixing.EVIDENCE / max(1, len(words)))
    for d in domains:
        whole = sum(counts[d].values()) + mixing.BUCKETS
        prior = math.log(sum(x == d for _, x in labelled) / len(labelled))
        logs.append(prior + scale * sum(math.log((counts[d][hashed(w)] + 1) / whole) for w in words))
    e = [math.exp(x - max(logs)) for x in logs]
    return [x / sum(e) for x in e]


HASHES = {}


def hashed(word):
    return HASHES[word]


def test_mixing_posteriors_and_rates_by_brute_force(spark):
    """Posteriors word by word, in other scripts too; rates against least squares over explicit documents."""
    import numpy as np

    rng = random.Random(15)
    vocab = {"el": ["και", "το", "είναι", "που"], "ru": ["и", "в", "не", "что"], "zh": list("的一是不了人我在有他")}
    rows = []
    for i in range(150):
        d = ["el", "ru", "zh"][i % 3]
        w = [rng.choice(vocab[d] if rng.random() < 0.9 else vocab["el"]) for _ in range(rng.randrange(1, 30))]
        rows.append((i, "".join(w) if d == "zh" and rng.random() < 0.7 and all(len(x) == 1 for x in w) else " ".join(w), d))
    rows += [(150, None, "el"), (151, "και " * 20_000, None), (152, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i,) for i in range(90)], "doc_id long")
    spaced = {i: " ".join(x if x.isascii() else "".join(f" {c} " if c in vocab["zh"] else c for c in x) for x in (t or "").split()) for i, t, _ in rows}
    words = sorted({w for t in spaced.values() for w in t.split()})
    for w, h in spark.createDataFrame([(w,) for w in words], "w string").select("w", F.pmod(F.hash("w"), F.lit(mixing.BUCKETS))).collect():
        HASHES[w] = h
    for low, weights in ((0.0, {"el": 1, "ru": 1, "zh": 3}), (1.0, {"el": 1, "ru": 6, "zh": 1})):
        got = {r.doc_id: r for r in mixing.mix_table(docs, labels, weights, budget=3000.0, low=low).collect()}
        labelled = [(spaced[i], d) for i, t, d in rows[:90]]
        for i in range(0, 153, 7):
            assert got[i].posteriors == pytest.approx(posterior_reference(None, labelled, ["el", "ru", "zh"], spaced[i]), abs=2e-3)
        assert got[150].n_tokens == 0 and got[151].n_tokens == 20_000
        t = np.array([got[i].n_tokens for i in range(153)], float)
        p = np.array([got[i].posteriors for i in range(153)])
        target = np.array([weights[d] for d in ("el", "ru", "zh")], float)
        target *= 3000.0 / target.sum()
        metric = np.linalg.inv((p * t[:, None]).T @ p)
        r = np.maximum(low, np.ones(len(t)))
        for _ in range(4000):  # plain projected gradient on the same objective, one rate a document
            gap = target - (r * t) @ p
            r = np.maximum(low, r + 0.5 * (p @ (metric @ gap)))
        gap = target - (r * t) @ p
        own = target - np.array([got[i].rate for i in range(153)]) * t @ p
        assert min(got[i].rate for i in range(153)) >= low
        assert own @ metric @ own <= gap @ metric @ gap + 1e-3 * (target @ metric @ target)


def test_mixing_meets_its_targets(spark):
    random.seed(14)
    rows = []
    for i in range(400):
        a = i % 4 > 0
        rows.append((i, " ".join("".join(random.choice("aeiou" if a else "xyzkw") for _ in range(4)) for _ in range(20)), "vowel" if a else "cons"))
    rows += [(400, None, None), (401, "", "vowel")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("rate", F.lit("r")).withColumn("t", F.lit(1))
    labels = spark.createDataFrame([(i,) for i in range(100)], "doc_id long").withColumn("quality", F.lit(1))
    got = mixing.mix_table(docs, labels, {"vowel": 1, "cons": 1, "unknown": 5}).collect()
    assert len(got) == 402 and all(r.rate >= 0 for r in got)
    totals = [sum(r.rate * r.n_tokens * r.posteriors[k] for r in got) for k in (0, 1)]
    assert abs(totals[0] - 4000) < 40 and abs(totals[1] - 4000) < 40
    out = mixing.mixed(docs, labels, {"vowel": 1, "cons": 1}, low=1.0)
    assert out.columns == docs.columns
    assert out.select("doc_id").distinct().count() == 402 and out.count() > 500
    flat = {r.doc_id: r.copies for r in mixing.mix_table(docs, labels, {"vowel": 1, "cons": 1}, low=1.0).collect()}
    assert {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()} == flat
    assert all(r.rate == 1 for r in mixing.mix_table(docs, labels.limit(0), {"vowel": 1}).collect())
    assert mixing.mix_table(docs.limit(0), labels, {"vowel": 1}).count() == 0


def test_training_keeps_no_second_copy_of_its_rows():
    """Fitting allocates less than a double for each indicator of the sample."""
    import tracemalloc

    import numpy as np

    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, nbsvm.SIZE, 3000)).astype(np.int32) for _ in range(400)]
    labels = np.arange(400) % 2
    tracemalloc.start()
    model = nbsvm.fit(rows, labels, epochs=1)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 8 * sum(map(len, rows)) / 2 and np.abs(model.weights).max() > 0
