import random

import corpus_pipeline

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def tables(spark, folder):
    draw = random.Random(12)
    words = ["river", "stone", "market", "window", "garden", "letter", "winter", "music", "paper", "silver"] + [f"word{c}" for c in "abcdefghij"]
    clean = [" ".join(draw.choices(words, k=60)) + "." for _ in range(300)]
    texts = clean + [clean[0], clean[1] + " paper"] + ["#$%&" * 80] * 2 + [" ".join(draw.choices(words, k=9000)) + ' token = "abcdef0123456789abcdef01" end']
    rows = [(k, t, "en", f"src{k % 3}", len(t)) for k, t in enumerate(texts)] + [(900, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows


def test_stages_in_order(spark, tmp_path):
    folder = str(tmp_path)
    rows = tables(spark, folder)
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{folder}/stage{k}")
        docs = spark.read.parquet(f"{folder}/stage{k}")
        if k < 3:
            assert docs.columns == COLUMNS
            seen.append({r["doc_id"]: r["text"] for r in docs.collect()})
    ids = {r[0] for r in rows}
    assert set(seen[0]) == ids - {302, 303}  # junk goes, all else stays
    assert set(seen[1]) == ids - {300, 301, 302, 303}  # copies and near copies go
    assert seen[2] == {k: v and v.replace('token = "abcdef0123456789abcdef01', "[SECRET]") for k, v in seen[1].items()}
    pieces = docs.collect()
    assert {r["doc_id"] for r in pieces} == set(seen[2])
    assert sum(r["length"] for r in pieces) == sum({r["doc_id"]: r["doc_tokens"] for r in pieces}.values())
    assert corpus_pipeline.run(spark, folder).count() == len(pieces)


def test_repeated_rows_clashing_columns_and_empty_tables(spark, tmp_path):
    folder = str(tmp_path)
    rows = tables(spark, folder)
    names = ["bad_id", "kept_id", "rows", "body", "strong", "text_hash", "key", "part", "ids"]
    docs = spark.createDataFrame([(*r, *names) for r in [*rows, rows[0], rows[-1], (None, rows[5][1], "en", None, None)]], ", ".join(f"{c} {'long' if c in ('doc_id', 'n_chars') else 'string'}" for c in [*COLUMNS, *names]))
    for empty in (False, True):
        at = docs.limit(0) if empty else docs
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            at = stage(spark, at, folder)
            at.write.parquet(f"{folder}/{empty}{k}")
            at = spark.read.parquet(f"{folder}/{empty}{k}")
            if k < 3:
                assert at.columns == [*COLUMNS, *names]
                ids = [r["doc_id"] for r in at.collect()]
                # the repeated row is one document for the second stage; a null id and the empty text stay
                assert ids == [] if empty else (ids.count(0) == (2 if k == 0 else 1) and ids.count(None) == 1 and ids.count(900) == (2 if k == 0 else 1))
        assert (at.count() == 0) == empty
