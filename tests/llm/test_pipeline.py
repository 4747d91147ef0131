"""The whole pipeline against its stages done by hand, and the tables it leaves behind."""

from __future__ import annotations

import os
import random
import zlib
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from bidloom.llm import mixing, near_dup, quality
from bidloom.llm.catalog import vocabulary
from bidloom.llm.common import recorded
from bidloom.session import ensure_checkpoint_dir

from test_operators import components_of


def texts():
    rng = random.Random(21)
    words = [f"{a}{b}" for a in ("stone", "river", "glass", "paper", "window", "garden", "market", "letter") for b in ("", "s", "ing", "ed", "er", "ly", "ful", "ness")]
    sentence = lambda n: " ".join(rng.choice(words) for _ in range(n)) + "."
    rows = [(i, "\n".join(sentence(rng.randrange(12, 30)) for _ in range(5)), rng.choice(("a", "b", None))) for i in range(40)]
    for i in range(40, 52):  # copies and near copies
        base = rows[i % 3][1].split(" ")
        if i % 2:
            base[10] = "changed"
        rows.append((i, " ".join(base), "a"))
    item = sentence(25)
    rows += [(60, rows[9][1] + "\n" + item, "b"), (61, "too short", "b"), (62, None, "b"), (63, "", None), (64, "#$% | " * 60, "a")]
    return rows, [(1, item), (2, None)]


def test_run(spark, tmp_path):
    rows, items = texts()
    sf = str(tmp_path / "sf")
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    ensure_checkpoint_dir(spark)
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    got = corpus_pipeline.run(spark, sf).collect()
    left_over = Counter(name.rsplit("-", 1)[0] for name in set(os.listdir(folder)) - before)

    good = {r["doc_id"] for r in quality.judge(docs).filter("kept").select("doc.doc_id").collect()}
    assert good and not good & {61, 62, 63, 64}
    kept = [r for r in rows if r[0] in good]
    lead = components_of(kept, 5)
    kept = [r for r in kept if lead[r[0]][1] == r[0] and r[0] != 60]
    assert len(kept) < len(good) and 60 in good
    left = docs.filter(docs["doc_id"].isin([r[0] for r in kept]))
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix_rates(left).select("doc.doc_id", "copies").collect()}
    tokenizer = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    start, want = 0, []
    for i, t, _ in sorted(kept):
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 2]
        for _ in range(copies[i]):
            want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
    assert sorted(map(tuple, got)) == want

    # What the stages wrote on the way is gone, but for what the last one and the result read.
    assert set(left_over) == {"corpus-tokens", "token-output"}, left_over


def test_stages_keep_the_columns(spark):
    rows, items = texts()
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "near duplicates", "benchmark decontamination", "source mixing", "token output"]
    for _, stage in (corpus_pipeline.STAGES[0], corpus_pipeline.STAGES[3]):
        assert stage(spark, docs, "").columns == docs.columns


def test_files_follow_the_documents_not_the_shuffle(spark):
    rows, _ = texts()
    rows += [(1000 + i, f"{t} {i}", s) for i, t, s in rows[:52]]
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    most = 2 * spark.sparkContext.defaultParallelism
    held = {"spark.sql.shuffle.partitions": "97", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        with recorded() as paths:
            got = near_dup.near_groups(docs).collect()
        files = {path.rsplit("/", 1)[-1]: len([f for f in os.listdir(path.removeprefix("file:")) if f.endswith(".parquet")]) for path in paths}
        stages = dict(corpus_pipeline.STAGES)
        parts = {name: stages[name](spark, docs, "").rdd.getNumPartitions() for name in ("near duplicates", "source mixing")}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(files) > 15 and max(files.values()) <= most, files
    assert max(parts.values()) <= most, parts
    lead = components_of(rows, 5)
    assert {r["doc_id"]: r["component_id"] for r in got if r["n_shingles"]} == {i: lead[i][1] for i, t, _ in rows if lead[i][0]}
