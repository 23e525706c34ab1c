"""Every stage of the pipeline on a small corpus, against a plain version of what it must keep."""

import hashlib

import corpus_pipeline as C
import numpy as np
import public_tokenizers as P
import sentencepiece

from assaylake.llm import mixing, simhash, toxicity


def test_stages(spark, tmp_path):
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("aeioutnrsl"), 6))
    rows, labels = [], []
    for i in range(240):
        words = [word() for _ in range(80)]
        toxic = i % 5 == 0
        if toxic:
            words[::20] = ["zorgblat"] * 4
        rows.append((i, " ".join(words), "en", f"s{i % 3}", 0))
        labels.append((i, 1, int(toxic)))
    rows += [(1000 + i, rows[i][1].upper() if i % 2 else rows[i][1], "en", "s0", 0) for i in range(1, 20)]
    rows += [(2000 + i, rows[i][1] + " x", "en", "s1", 0) for i in range(1, 20)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    sf, docs = str(tmp_path), spark.read.parquet(f"{tmp_path}/documents.parquet")

    clean = C.drop_toxic(spark, docs, sf)
    kept = {r.doc_id: r for r in clean.collect()}
    assert clean.columns == C.COLUMNS
    assert all("zorgblat" not in r.text.lower() for r in kept.values()) and len(kept) == sum("zorgblat" not in r[1].lower() for r in rows)

    single = {r.doc_id for r in C.drop_copies(spark, clean, sf).collect()}
    best: dict = {}
    for i, r in kept.items():
        best[r.text.lower()] = max(i, best.get(r.text.lower(), i))
    assert single == set(best.values())

    one = clean.where(clean.doc_id.isin(sorted(single)))
    left = {r.doc_id for r in C.drop_near_copies(spark, one, sf).collect()}
    comp = simhash.simhash_components(one).collect()
    assert left == {r.component_id for r in comp} and len(left) < len(single)

    mixed = C.mix(spark, one, sf)
    assert mixed.columns == C.COLUMNS and mixed.count() == mixing.mix_sources(one).count()

    out = C.run(spark, sf).collect()
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    want = {r.doc_id: hashlib.sha256(np.array(sp.encode(r.text, add_bos=True, add_eos=True), "<u4").tobytes()).hexdigest() for r in kept.values()}
    assert out and all(want[r.doc_id] == r.ids_sha256 for r in out)
    assert {r.doc_id for r in out} <= left
    assert toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet")).score("zorgblat zorgblat") > 0.5
