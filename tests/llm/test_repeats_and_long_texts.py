"""Repeated rows and very long texts of the operators on lines, rules and leaks."""

from chainloom.llm import decontaminate, line_dedup, quality_rules


def test_repeated_rows_of_lines_are_pages_of_their_own(docs_of):
    """A line on five copies of one row, of eight pages in all, is boilerplate; a very long text keeps its other lines."""
    long = "\n".join(f"line {k}" for k in range(60_000))
    rows = [(1, "bar\nown one", "h")] * 5 + [(2, "own two", "h"), (3, "bar\n" + long, "h"), (4, None, "h")]
    got = line_dedup.deduplicated(docs_of(rows)).collect()
    assert len(got) == 8
    texts = {r.doc_id: r.text for r in got}
    assert texts[3] == long and texts[2] == "own two" and texts[4] is None
    assert sorted(r.n_dropped for r in got if r.doc_id == 1) == [2] * 5  # "own one" stands on five pages as well


def test_repeated_rows_of_rules_are_measured_and_counted_each(docs_of, words):
    good = " ".join(words(80, 1))
    rows = [(1, good, "a")] * 3 + [(2, "short", "a")] * 2 + [(3, "word " * 400_000, "b"), (4, " ".join(words(60, 2)) + " \n" * 200_000, "b")]
    got = quality_rules.op10_quality_rules(docs_of(rows)).collect()
    assert len(got) == 7 and sum(r.kept for r in got if r.doc_id == 1) == 3
    by_id = {r.doc_id: r for r in got}
    assert by_id[3].n_words == 400_000 and by_id[3].n_repeat_words == 400_000 and by_id[3].base_failed
    assert by_id[4].n_words == 60 and not by_id[4].base_failed
    assert len(quality_rules.passing(docs_of(rows)).collect()) == sum(r.kept for r in got)


def test_leaks_in_very_long_and_repeated_rows_are_found(spark, docs_of, words):
    item = "Which of the three rivers that cross the old town flows into the lake below the northern hills of the valley?"
    filler = " ".join(words(3000, 5))
    long = f"{filler} " * 60 + item + f" {filler}" * 20
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(1, long), (1, long), (2, filler), (3, item), (3, item)]
    got = decontaminate.op6_decontaminate(docs_of(rows), bench).collect()
    assert {r.doc_id for r in got} == {1, 3}
    assert sorted(r.doc_id for r in decontaminate.clean(docs_of(rows), bench).collect()) == [2]
