"""The stages of the pipeline on a few documents whose fate is plain."""

import random

from tokenizers import Tokenizer

import corpus_pipeline as cp

SCHEMA = "doc_id long, text string, n_chars long, source string"


def prose(seed, n=60):
    rnd = random.Random(seed)
    return ["".join(rnd.choices("abcdefghijklmnop", k=6)) for _ in range(n)]


def table(spark, texts):
    return spark.createDataFrame([(i, t, len(t) if t is not None else None, "s") for i, t in texts], SCHEMA)


def test_one_document_of_each_group_stays(spark):
    a, b = prose(1), prose(2)
    docs = table(spark, [(1, " ".join(a)), (2, " ".join(a)), (3, " ".join([*a[:-1], "other"])), (4, " ".join(b)), (5, None), (6, ""), (None, " ".join(a))])
    out = cp.near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    assert {r["doc_id"] for r in out.collect()} == {1, 4, 5, 6, None}


def test_leaked_documents_go_and_secrets_are_masked(spark, tmp_path, vocabulary):
    leak, rest = prose(3, 20), prose(4, 60)
    spark.createDataFrame([("t1", " ".join(leak))], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = table(spark, [(1, " ".join(rest[:30] + leak + rest[30:])), (2, " ".join(rest)), (3, "the password = hunter2hunter2 here"), (4, None)])
    kept = cp.decontamination(spark, docs, str(tmp_path))
    assert {r["doc_id"] for r in kept.collect()} == {2, 3, 4} and kept.columns == docs.columns
    clean = {r["doc_id"]: r for r in cp.secrets(spark, kept, "").collect()}
    assert "hunter2" not in clean[3]["text"] and clean[3]["n_chars"] == len(clean[3]["text"])
    assert clean[2]["text"] == " ".join(rest) and clean[4]["text"] is None
    coded = {r["doc_id"]: r for r in cp.encoding(spark, table(spark, [(2, " ".join(rest)), (4, None)]), "").collect()}
    library = Tokenizer.from_file(str(vocabulary))
    ids = library.encode(" ".join(rest), add_special_tokens=False).ids
    assert list(coded[2]["ids"]) == ids and coded[2]["decoded"] == library.decode(ids, skip_special_tokens=False)
    assert coded[2]["n_tokens"] == len(ids) and coded[4]["n_tokens"] == 0


def test_run_on_a_small_table_with_odd_rows(spark, tmp_path, vocabulary):
    """Nulls, repeated ids, an empty and a long text, columns that are named like the operators' own."""
    leak = prose(9, 30)
    texts = {i: " ".join(prose(100 + i)) for i in range(1, 13)}
    rows = [*texts.items(), (20, texts[1]), (21, None), (22, ""), (None, "no id here"), (2, texts[2]), (23, " ".join(leak)), (24, "my token = abcdefgh12345678 ok"), (25, "long " * 40_000)]
    docs = [(i, t, "en", "s", len(t) if t is not None else None, 1, "x") for i, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, _gone int, ids string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([("b", " ".join(leak))], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(1, 13)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = cp.run(spark, str(tmp_path)).collect()
    # of the group {1, 20} the smallest id stays, the leaked document goes, rows without id and text stay
    assert sorted(r["doc_id"] for r in out if r["doc_id"] is not None) == [1, 2, 2, *range(3, 13), 21, 22, 24, 25]
    library = Tokenizer.from_file(str(vocabulary))
    for r in out:
        text = "no id here" if r["doc_id"] is None else dict(rows[:14]).get(r["doc_id"], {25: "long " * 40_000}.get(r["doc_id"]))
        if r["doc_id"] != 24:
            assert list(r["ids"]) == library.encode(text or "", add_special_tokens=False).ids, r["doc_id"]
    assert all("abcdefgh" not in r["decoded"] for r in out)
