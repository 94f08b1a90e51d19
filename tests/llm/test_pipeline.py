"""The stages of the pipeline against brute force on a small corpus, and the registered queries' edges."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
from tokenizers import Tokenizer

import corpus_pipeline
from stratalith.llm import simhash_dedup, toxicity


def corpus(folder):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice(["ka", "lo", "mi", "ter", "an", "os"]) for _ in range(rnd.randint(1, 4)))
    texts, toxic = [], {}
    items = [" ".join(word() for _ in range(rnd.randint(20, 40))) for _ in range(20)]
    for i in range(900):
        words = [word() for _ in range(rnd.randint(60, 250))]
        toxic[i] = i % 6 == 0
        if toxic[i]:
            for _ in range(6):
                words[rnd.randrange(len(words))] = rnd.choice(["grobian", "schuft", "lump"])
        if i % 10 == 1:
            words[5:5] = items[i % 20].split()
        texts.append(" ".join(words))
    for i in range(900, 960):
        texts.append(texts[i - 890].upper() if i % 2 else texts[i - 890])
        toxic[i] = toxic[i - 890]
    texts += [None, ""]
    n = len(texts)
    docs = pa.table({"doc_id": pa.array(range(n), pa.int64()), "text": pa.array(texts, pa.string()), "lang": ["x"] * n, "source": [rnd.choice(["a"] * 6 + ["b", "b", "c"]) for _ in range(n)], "n_chars": pa.array([len(t or "") for t in texts], pa.int64())})
    pq.write_table(docs, f"{folder}/documents.parquet")
    some = [i for i in range(900) if i % 5]
    pq.write_table(pa.table({"doc_id": pa.array(some, pa.int64()), "quality": pa.array([1] * len(some), pa.int32()), "toxic": pa.array([int(toxic[i]) for i in some], pa.int32())}), f"{folder}/labels.parquet")
    pq.write_table(pa.table({"item_id": pa.array(range(20), pa.int64()), "text": items}), f"{folder}/benchmark.parquet")
    return texts, toxic, items


def test_stages(spark, tmp_path):
    texts, toxic, items = corpus(tmp_path)
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "token_files":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = [r.doc_id for r in docs.select("doc_id").collect()]
    kept = set(seen["toxicity"])
    wrong = [i for i in range(960) if (i in kept) == toxic[i]]
    assert len(wrong) <= 5
    # one of each component, by brute force over fingerprints
    fps = {i: simhash_dedup.fingerprint((texts[i] or "").encode()) for i in kept}
    ids, least = sorted(kept), {i: i for i in kept}
    for a in ids:
        for b in ids:
            if b < a and (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = least[a], least[b]
                least = {k: min(x, y) if v in (x, y) else v for k, v in least.items()}
    assert sorted(seen["simhash_dedup"]) == [i for i in ids if least[i] == i]
    one = set(seen["simhash_dedup"])
    clean = {i for i in one if not any(t in (texts[i] or "").lower() for t in items)}
    assert set(seen["decontamination"]) == clean
    mixed = Counter(seen["source_mixing"])
    assert set(mixed) == clean and max(mixed.values()) <= 2 and len(seen["source_mixing"]) > len(clean)
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    crc = {i: zlib.crc32(np.array(lib.encode(texts[i] or "", add_special_tokens=False).ids + [0], "<u4").tobytes()) for i in mixed}
    got = docs.collect()
    assert Counter(r.doc_id for r in got) == mixed and all(r.ids_crc32 == crc[r.doc_id] for r in got)
    assert sum(r.n_tokens for r in got) == max(r.start + r.n_tokens for r in got)


def test_filters_take_nulls_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, None, "x"), (None, "", "x"), (None, "schuft", None)], "doc_id long, text string, _text string")
    assert toxicity.drop_toxic(docs, toxicity.train([], np.zeros(0, bool))).count() == 3
    assert simhash_dedup.keep_one(docs).count() == 2
