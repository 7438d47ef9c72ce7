"""The pipeline's stages against plain versions of each, every stage on its own input."""

import random
from collections import Counter

import pytest
from test_copies_and_leaks import edited, plain_join
from test_rules_mix_lines import WORDS, plain_measures
from test_tokens import expected_store

import corpus_pipeline
from chainloom.llm import mixing


def corpus(words):
    r = random.Random(2)
    rows = []
    for k in range(60):
        base = words(r.randint(60, 120), 1000 + k)
        for _ in range(r.choice([1, 1, 1, 2, 4])):
            rows.append((len(rows), " ".join(edited(base, r.randint(0, 2), r)), f"s{r.randrange(4)}"))
    rows += [(len(rows) + k, t, "s0") for k, t in enumerate([None, "", "too short", "again and again " * 40])]
    item = " ".join(words(25, 77))
    rows += [(len(rows) + k, " ".join(words(50, 2000 + k)) + " " + item + " " + " ".join(words(50, 3000 + k)), "s1") for k in range(3)]
    return rows, item


def test_stages_against_plain_versions(spark, words, tmp_path):
    rows, item = corpus(words)
    folder = str(tmp_path)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item), (2, "a b")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/stage{k}")
        before, docs = docs, spark.read.parquet(f"{folder}/stage{k}")
        kept.append((before.collect(), docs.collect()))
        if k < 4:
            assert docs.columns == before.columns, name

    ids = lambda rs: sorted(r.doc_id for r in rs)
    before, after = kept[0]
    good = [r for r in before if (m := plain_measures(r.text))[0] >= 50 and 100 * m[4] <= 50 * m[0]]
    assert ids(after) == ids(good) and len(before) - len(after) == 4

    before, after = kept[1]
    assert ids(after) == sorted({int(c) for _, c, _ in plain_join([(r.doc_id, r.text) for r in before])}) and len(after) < len(before)

    before, after = kept[2]
    assert ids(after) == ids(r for r in before if item not in r.text) and len(before) - len(after) == 3

    before, after = kept[3]
    size = Counter()
    for r in before:
        size[r.source] += len(WORDS(r.text))
    sources = sorted(size)
    want = mixing.targets([size[s] for s in sources], [(5.0, 2.0, 1.0)[k % 3] for k in range(len(sources))], sum(size.values()))
    got, times = Counter(), Counter()
    texts = {r.doc_id: r.text for r in before}
    for r in after:
        assert texts[r.doc_id] == r.text
        got[r.source] += len(WORDS(r.text))
        times[r.doc_id] += 1
    longest = max(len(WORDS(t)) for t in texts.values())  # the document on the border comes or doesn't
    assert all(abs(got[s] - t) <= longest / 2 + 1 for s, t in zip(sources, want)) and max(times.values()) <= 3

    before, after = kept[4]
    found = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in after), key=lambda r: r[1])
    assert found == expected_store([(r.doc_id, r.text) for r in before])

    again = corpus_pipeline.run(spark, folder).collect()
    assert sorted(map(str, again)) == sorted(map(str, after))


@pytest.mark.parametrize("stage", range(5))
def test_stages_of_empty_tables(spark, tmp_path, stage):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.STAGES[stage][1](spark, spark.createDataFrame([], schema), str(tmp_path)).count() == 0


def test_stages_take_nulls_long_texts_repeated_rows_and_clashing_columns(spark, words, tmp_path):
    """Rows without an id, a source or a text, a very long text, repeated rows, and columns named like the stages' own."""
    text = lambda k: " ".join(words(70, 9000 + k))
    rows = [(None, text(1), "s0"), (None, text(2), None), (None, text(2), None), (None, None, "s1"), (1, text(3), "s0"), (1, text(3), "s0"), (1, text(4), None), (2, " ".join(words(60_000, 9999)), "s1")]
    rows += [(10 + k, text(10 + k), f"s{k % 2}") for k in range(30)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, taken long, size long, host string, start long, hash long, key string, class_id long, times int, own string"
    full = [(i, t, "en", s, len(t or ""), 1, 2, "h", 3, 4, "k", 5, 6, "o") for i, t, s in rows]
    spark.createDataFrame(full, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, None), (1, "a b c")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/stage{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/stage{k}")
        if k < 4:
            assert docs.columns == before.columns, name
        if k == 2:
            kept = sorted((str(r.doc_id), r.text) for r in docs.collect())
            assert kept == sorted({(str(i), t) for i, t, s in rows if t})  # every different text once, whatever its id
    assert docs.filter("doc_id IS NULL").count() > 0 and docs.filter("n_tokens > 60000").count() > 0
