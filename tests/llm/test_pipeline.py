"""The pipeline's rows against a plain version of its stages."""

import random
import re
from pathlib import Path

import pytest

from test_minhash import brute as brute_classes
from test_quality import corpus


def test_pipeline(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline

    rng = random.Random(11)
    rows, truth = corpus(400)
    bench = [" ".join("".join(rng.choice("klmnopqrst") for _ in range(6)) for _ in range(25)) for _ in range(5)]
    docs = [(k, t, lang, source, n) for k, t, lang, source, n in rows]
    good = [k for k in truth if truth[k]]
    extra = []
    for j, k in enumerate(good[:40]):
        text = docs[k][1]
        if j % 4 == 0:
            extra.append((1000 + j, text, "en", "s1", len(text)))
            truth[1000 + j] = True
        elif j % 4 == 1:
            docs[k] = (k, text + " " + bench[j % 5], "en", "s1", 0)
        elif j % 4 == 2:
            docs[k] = (k, text + " password=44e56fabd5f7c371cd of it", "en", "s1", 0)
    docs += extra
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(v), 0) for k, v in truth.items() if k % 3 == 0], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    kept = [(i, t) for i, t, *_ in docs if truth[i]]
    kept = [i for i, _, _, first in brute_classes(kept, 5) if first]
    texts = {i: t for i, t, *_ in docs}
    kept = [i for i in kept if not any(b in texts[i] for b in bench)]
    from tokenizers import Tokenizer

    import public_tokenizers

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: len(library.encode(re.sub(r"password=\w+", "[SECRET]", texts[i]), add_special_tokens=False).ids) for i in kept}
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(shared.glob("*/*"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id: r.n_tokens for r in out.collect()} == want
    assert [p.parent.name for p in set(shared.glob("*/*")) - before] == ["pipeline_bpe"]  # the stages' own tables are gone


def test_stages_keep_columns(spark, tmp_path):
    import corpus_pipeline

    df = spark.createDataFrame([(1, None, None, None, None), (2, "a b", "en", "s", 3), (2, "a b", "en", "s", 3), (None, "c d e", "fr", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, str(tmp_path))
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(r.doc_id or 0 for r in df.collect()) == [0, 1, 2]
    assert corpus_pipeline.STAGES[-1][1](spark, df, str(tmp_path)).count() == 3
