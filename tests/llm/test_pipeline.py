"""The pipeline's stages on a small corpus whose answer is known."""

from __future__ import annotations

import random


def prose(seed: int, words: int) -> str:
    draw = random.Random(seed)
    return " ".join("".join(draw.choice("abcdefghijklmnop") for _ in range(draw.randint(2, 8))) for _ in range(words))


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    item = prose(900, 30)
    texts = [prose(k, 120) for k in range(30)]
    texts += [texts[0], texts[1].replace(" ", "  "), " ".join([*texts[2].split()[:60], "changed", *texts[2].split()[61:]]), None, "", "12 34", prose(50, 60) + " " + item + " " + prose(51, 60), "my password = abcdefgh1234 " + prose(52, 100)]
    rows = [(k, t, "xx" if k % 2 else "yy", "s", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path)).collect()
        seen.append({r.doc_id: r for r in out})
        if name != "encoding":
            docs = spark.createDataFrame(out, docs.schema)
    gone = {30, 31, 32} | {33, 34, 35}
    assert set(seen[0]) == set(range(len(texts))) - {33, 34, 35}
    assert set(seen[1]) == set(range(len(texts))) - gone
    assert set(seen[2]) == set(seen[3]) == set(seen[4]) == set(seen[1]) - {36}
    assert "abcdefgh1234" not in seen[3][37].text and seen[3][37].n_chars == len(seen[3][37].text) and seen[3][5].text == texts[5]
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(seen[4])


def test_rows_without_an_id_of_their_own(spark, tmp_path):
    """Rows with no id, or with one that other rows have too, are each judged by their own text."""
    import corpus_pipeline

    item = prose(900, 30)
    leak, clean, copied, a, b = prose(60, 60) + " " + item + " " + prose(61, 60), prose(62, 120), prose(63, 120), prose(64, 120), prose(65, 120)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(None, leak), (None, clean), (None, copied), (None, copied), (7, a), (7, b), (9, clean), (3, b), (None, ""), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    near = sorted((r.doc_id or 0, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect())
    assert near == sorted([(0, leak), (0, copied), (7, a), (9, clean), (3, b), (0, ""), (0, "")])
    left = sorted((r.doc_id or 0, r.text) for r in corpus_pipeline.benchmark_leaks(spark, docs, str(tmp_path)).collect())
    assert left == sorted((k or 0, t) for k, t in rows if t != leak)


def test_extra_columns_repeated_rows_and_an_empty_table(spark, tmp_path):
    """Columns named like those that the stages use within, the same row twice, and no row at all."""
    import corpus_pipeline

    item = prose(900, 30)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    extra = ["score", "lang_pred", "leak", "row", "__text", "__row", "before", "component_id", "c0", "c1", "key", "paths"]
    schema = ", ".join(["doc_id long, text string, lang string, source string, n_chars int", *(f"`{c}` string" for c in extra)])
    texts = [prose(k, 120) for k in range(12)]
    texts += [texts[0], texts[0], prose(50, 60) + " " + item + " " + prose(51, 60), "password = abcdefgh1234 " + prose(52, 90), None, ""]
    rows = [(0 if k in (12, 13) else k, t, "xx" if k % 2 else "yy", "s", len(t or ""), *(f"{c}{k}" for c in extra)) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), docs.schema)
    left = docs.collect()
    assert sorted(r.doc_id for r in left) == [*range(12), 15]
    assert all(r.lang_pred == r.score.replace("score", "lang_pred") for r in left)
    assert [r.n_chars == len(r.text) and "abcdefgh1234" not in r.text for r in left if r.doc_id == 15] == [True]
    empty = spark.createDataFrame([], schema)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0, name


def test_more_languages_than_the_tables_have(spark, tmp_path):
    """With twelve alphabets no document of a language goes, whatever an even guess would be."""
    import random

    import corpus_pipeline

    alphabets = [[chr(0x100 + 40 * a + k) for k in range(12)] for a in range(12)]
    draw = random.Random(1)
    texts = [" ".join("".join(draw.choice(alphabets[k % 12]) for _ in range(draw.randint(2, 8))) for _ in range(60)) for k in range(600)]
    docs = spark.createDataFrame([(k, t, f"l{k % 12}", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.language(spark, docs, str(tmp_path)).count() >= 594
