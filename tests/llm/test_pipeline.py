"""The stages of the pipeline against plain Python on a small folder of tables."""

import hashlib
from types import SimpleNamespace

import numpy as np
import pandas as pd
import sentencepiece

import corpus_pipeline
from postlens.llm import decontaminate, jaccard
from postlens.llm import sentencepiece as sp


def tables(spark, folder):
    text = lambda k: " ".join(f"{k}word{i}" for i in range(40))
    docs = [(0, text("a"), "en", "s", 0), (1, text("a"), "en", "s", 0), (2, text("a") + " tail", "en", "s", 0), (3, text("b") + " mail x@y.zz", "en", None, 0),
            (4, text("c") + " " + text("q"), "en", "s", 0), (5, None, None, None, None), (6, "", "en", "s", 0),
            (7, " ".join(f"long{i % 7919}é" for i in range(25_000)), "en", "s", 0)]
    docs += [(10 + i, text(f"k{i}x") + (" nasty awful" if i % 4 == 0 else ""), "en", "s", 0) for i in range(80)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(10 + i, 0, int(i % 4 == 0)) for i in range(80)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, text("q"))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs


def test_run(spark, tmp_path):
    docs = tables(spark, str(tmp_path))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    kept = {i: t for i, t, *_ in docs if i not in (1, 2, 4) and not (i >= 10 and i % 4 == 2)}
    assert set(got) == set(kept)
    kept[3] = kept[3].replace("x@y.zz", "[EMAIL]")
    lib = sentencepiece.SentencePieceProcessor(model_file=sp.model_path())
    for i, t in kept.items():
        ids = lib.encode(t or "", add_bos=True, add_eos=True)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), i


def test_stages_keep_columns(spark, tmp_path):
    tables(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.dtypes == docs.dtypes
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), str(tmp_path)).count() == 0


def test_workers_keep_little_between_stages(monkeypatch):
    """Tasks give back their tables of powers, and the encoder's tables take less than 30 MB in all."""
    rows = pd.DataFrame({"uid": [1], "doc_id": ["1"], "text": ["one two three four five six"]})
    assert len(list(jaccard._profiles(5)(iter([rows])))) == 2 and jaccard.powers.cache_info().currsize == 0
    task = SimpleNamespace(partitionId=lambda: 0)
    monkeypatch.setattr(decontaminate, "TaskContext", SimpleNamespace(get=lambda: task))
    assert len(list(decontaminate._segments(None, 20)(iter([rows])))) == 2 and jaccard.powers.cache_info().currsize == 0
    table = sp.Table(sp.load_model(sp.model_path()))
    held = [x for o in (table, table.together) for x in vars(o).values() if isinstance(x, np.ndarray)]
    assert 1_000_000 < sum(x.nbytes for x in held) < 30_000_000
