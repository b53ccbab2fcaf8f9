"""The pipeline and its filters against stage-by-stage brute force on a small corpus."""

import collections
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spatialq.llm import decontam, mixing, nbsvm, near
from test_operators import contaminated_reference

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(31)
    vocab = {lang: ["".join(rng.choice(letters) for _ in range(rng.randint(3, 8))) for _ in range(150)] for lang, letters in (("en", "etaoinshr"), ("de", "enisratduü"), ("fr", "esaitnrulé"), ("es", "eaosrnidlñ"))}
    sentence = lambda lang, n: " ".join(rng.choice(vocab[lang]) for _ in range(n))
    items = [(i, sentence("en", 30)) for i in range(4)]
    docs = []
    for i in range(120):
        lang = ["en", "en", "de", "fr", "es"][i % 5]
        docs.append((sentence(lang, rng.randint(40, 90)), lang, 1))
    for i in range(12):  # copies, exact and near
        t, lang, _ = docs[i]
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        docs.append((t if i % 3 == 0 else " ".join(w), lang, 1))
    for i in range(6):  # contaminated
        docs.append((sentence("en", 20) + " " + " ".join(items[i % 4][1].split()[5:25]) + " " + sentence("en", 20), "en", 1))
    for _ in range(40):  # junk
        docs.append((" ".join("#%$"[rng.randrange(3)] * rng.randint(3, 9) + str(rng.randrange(1000)) for _ in range(50)), "en", 0))
    docs += [(None, None, None), ("", "en", None), ("word " * 30_000, "en", None)]
    rng.shuffle(docs)
    return docs, items


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    docs, items = corpus()
    base = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, t, g, "s", None if t is None else len(t)) for i, (t, g, _) in enumerate(docs)], DOCS).repartition(3).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, (_, _, q) in enumerate(docs) if q is not None], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return base


def test_pipeline_by_stages(spark, sf_dir):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    import corpus_pipeline as P

    assert [n for n, _ in P.STAGES] == ["quality classifier", "minhash near-dedup", "benchmark decontamination", "mixing to target weights", "token output"]
    docs, items = corpus()
    texts = {i: t for i, (t, _, _) in enumerate(docs)}
    data, seen = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for i, (_, stage) in enumerate(P.STAGES):
        data = stage(spark, data, sf_dir)
        if i < 4:
            assert data.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            data = data.persist()
            assert all(r.text == texts[r.doc_id] for r in data.collect())
            seen.append(sorted(r.doc_id for r in data.collect()))
    # 1: junk goes, prose stays
    rows, y = nbsvm.training_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality", 2000)
    assert len(y) == sum(q is not None and zlib.crc32(str(i).encode()) % 3 != 1 for i, (_, _, q) in enumerate(docs))
    kept = set(seen[0])
    right = [(i in kept) == bool(q) for i, (_, _, q) in enumerate(docs) if q is not None]
    assert sum(right) / len(right) > 0.97
    # 2: one of each class of the links between all pairs
    blob = {i: near.shingles(near.word_hashes(np.frombuffer((texts[i] or "").encode(), np.uint8), np.array([0, len((texts[i] or "").encode())]))[0]) for i in seen[0]}
    root = {i: i for i in seen[0]}
    for a in seen[0]:
        for b in seen[0]:
            if a < b and ((texts[a] or "") == (texts[b] or "") or len(blob[a]) and len(blob[b]) and near.similar(blob[a], blob[b], 0.8)):
                lo, hi = sorted((root[a], root[b]))
                root = {k: lo if v == hi else v for k, v in root.items()}
    assert seen[1] == sorted(set(root.values()))
    # 3: contaminated documents go, and only they
    bad = contaminated_reference([(i, texts[i]) for i in seen[1]], items)
    assert seen[2] == [i for i in seen[1] if not bad[i][4]] and len(seen[2]) < len(seen[1])
    # 4: nothing is dropped; copies are those of the rates
    assert set(seen[3]) == set(seen[2])
    base = spark.read.parquet(f"{sf_dir}/documents.parquet").filter(F.col("doc_id").isin(seen[2]))
    flat = {r.doc_id: r.copies for r in mixing.mix_table(base, spark.read.parquet(f"{sf_dir}/labels.parquet"), P.MIX_WEIGHTS, low=1.0).collect()}
    assert collections.Counter(seen[3]) == flat
    # 5: token files in order, read back
    whole, at = Tokenizer.from_file(public.path("word_bpe_49k.json")), 0
    out = sorted(data.collect(), key=lambda r: r.start)
    assert [r.doc_id for r in out] == seen[3]
    for r in out:
        ids = [*whole.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert P.run(spark, sf_dir).count() == len(out)


def test_uncontaminated_keeps_rows_apart(spark):
    item = " ".join(f"w{i}" for i in range(20))
    rows = [(1, item), (1, "a clean text"), (None, "another clean text"), (None, item + " and more"), (2, None), (3, ""), (3, "x " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit(1)).withColumn("mark", F.lit(2)).withColumn("c0", F.lit(3))
    got = decontam.uncontaminated(df, spark.createDataFrame([(0, item)], "item_id long, text string"))
    assert got.columns == df.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in got.collect()) == sorted((i or 0, t or "") for i, t in rows if item not in (t or ""))
    assert decontam.uncontaminated(df.limit(0), spark.createDataFrame([(0, item)], "item_id long, text string")).count() == 0
