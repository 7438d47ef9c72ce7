"""N-gram join, decontamination and the classifier."""

import random
import re

import numpy as np
import pytest

from chainloom.llm import decontaminate, ngram_join, quality_model
from chainloom.llm.components import components


def edited(words, n, r):
    out = list(words)
    for _ in range(n):
        out[r.randrange(len(out))] = f"edit{r.randrange(10**6)}"
    return out


def plain_join(rows):
    sets = [frozenset(ngram_join.grams(t or "").tolist()) for _, t in rows]
    n = len(rows)
    links, root = [0] * n, list(range(n))
    for i in range(n):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b or (a and b and 5 * len(a & b) >= 4 * len(a | b)):
                links[i] += 1
                links[j] += 1
                x, y = root[i], root[j]
                if x != y:
                    root = [y if z == x else z for z in root]
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root[k]] = min(i, least.get(root[k], i))
    return sorted((str(i), str(least.get(root[k])), links[k]) for k, (i, _) in enumerate(rows))


@pytest.fixture(scope="module")
def near_rows(words):
    r, rows = random.Random(8), []
    for group in range(12):
        base = words(r.choice([6, 60, 150, 400]), group)
        for _ in range(r.choice([1, 2, 5, 30])):
            rows.append((len(rows), " ".join(edited(base, r.randint(0, 3), r))))
    rows += [(900, None), (901, ""), (902, "one two"), (903, "One  two"), (None, rows[0][1]), (5, rows[5][1]), (904, "w " * 30000)]
    return rows


def test_join_equals_brute_force(docs_of, near_rows):
    got = ngram_join.op1_ngram_join(docs_of(near_rows)).collect()
    assert sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in got) == plain_join(near_rows)


def test_groups_cut_into_blocks_lose_no_link(docs_of, near_rows, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 7)
    got = ngram_join.op1_ngram_join(docs_of(near_rows)).collect()
    assert sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in got) == plain_join(near_rows)


def test_chained_group_of_growing_texts(docs_of, words, monkeypatch):
    """Versions that grow: each links to those of like size, far ones only through them. A set goes to few cells, no link is lost."""
    base = words(2500, 90)
    rows = [(k, " ".join(base[: 44 + int(60 * 1.06**k)])) for k in range(60)]
    rows += [(100 + k, " ".join(base[:n])) for k, n in enumerate((44, 54, 104, 129))]  # 40 and 50, 100 and 125 n-grams: exactly 4/5
    rows += [(200, rows[30][1]), (201, rows[30][1] + " other end")]
    sent, real = [], ngram_join.verified
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    monkeypatch.setattr(ngram_join, "verified", lambda c: sent.append(c.selectExpr("sum(last_near - first_near + 1) a", "sum(n_blocks) b").first()) or real(c))
    got = ngram_join.op1_ngram_join(docs_of(rows)).collect()
    assert sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in got) == plain_join(rows)
    assert len({r.class_id for r in got}) < 10 and 0 < 2 * sent[0].a < sent[0].b


def test_many_rows_without_an_id_are_one_row_for_each_text(docs_of, words, monkeypatch):
    """No cell gets more than a row for each of two near texts and task, whatever their number of rows."""
    a = words(80, 71)
    b = a[:-1] + ["other"]
    rows = [(None, " ".join(a if k % 2 else b)) for k in range(4000)] + [(3, " ".join(words(40, 72)))]
    docs, most = docs_of(rows).repartition(5), []
    real = ngram_join.verified
    monkeypatch.setattr(ngram_join, "verified", lambda c: most.append(c.count()) or real(c))
    got = ngram_join.op1_ngram_join(docs).collect()
    assert most[0] <= 2 * 5
    assert [r.n_links for r in got if r.doc_id is None] == [3999] * 4000 and [(r.doc_id, r.n_links) for r in got if r.doc_id] == [(3, 0)]


def test_candidates_beyond_the_bit_map_are_joined_by_a_shuffle(docs_of, near_rows, monkeypatch):
    monkeypatch.setattr(ngram_join, "MOST_MAPPED", 3)
    monkeypatch.setattr(ngram_join, "SMALL_BLOCK", 4)
    got = ngram_join.op1_ngram_join(docs_of(near_rows)).collect()
    assert sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in got) == plain_join(near_rows)


def test_one_document_of_each_class_stays(docs_of, near_rows):
    docs = docs_of(near_rows)
    kept = ngram_join.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({int(c) for _, c, _ in plain_join(near_rows)})


def test_classes_of_one_id_or_none_each_keep_a_row(docs_of, words):
    a, b, c, d = (" ".join(words(40, 500 + k)) for k in range(4))
    rows = [(1, a), (1, b), (2, a), (None, c), (None, d), (None, d), (0, b), (5, None), (5, "")]
    kept = [(r.doc_id, r.text or "") for r in ngram_join.representatives(docs_of(rows)).collect()]
    assert sorted(kept, key=str) == sorted([(1, a), (0, b), (None, c), (None, d), (5, "")], key=str)


def test_join_of_an_empty_table(docs_of):
    assert ngram_join.op1_ngram_join(docs_of([])).count() == 0
    assert ngram_join.representatives(docs_of([])).count() == 0


def test_bands_find_nearly_all_pairs_at_the_threshold():
    p = 1 - (1 - 0.8**ngram_join.ROWS) ** ngram_join.BANDS
    assert p > 0.997
    r, found = np.random.default_rng(1), 0
    for _ in range(300):
        common = r.integers(1, 1 << 63, 160, dtype=np.uint64)
        a, b = (np.unique(np.r_[common, r.integers(1, 1 << 63, 20, dtype=np.uint64)]) for _ in range(2))
        found += bool(set(ngram_join.band_hashes(a).tolist()) & set(ngram_join.band_hashes(b).tolist()))
    assert found >= 295


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(k, k + 1) for k in range(60)], [(0, k) for k in range(1, 50)], [(5, 3), (3, 9), (8, 7), (2, 2)]])
def test_components(spark, edges):
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {n: n for e in edges for n in e}
    for _ in edges:
        for u, v in edges:
            root[u] = root[v] = min(root[u], root[v])
    assert got == root


ITEM = "On Monday morning Anna bought 12 red apples and 7 green pears at the old market for 30 euros in total."


@pytest.fixture(scope="module")
def leak_tables(spark, docs_of, words):
    filler = lambda k: " ".join(words(40, 100 + k)) + "."
    rows = [
        (1, f"{filler(1)} {ITEM} {filler(2)}"),
        (2, f"{filler(3)} {ITEM.replace('12', '15').replace('7', '9').replace('30', '44').replace('Anna', 'Peter')} {filler(4)}"),
        (3, f"{filler(5)} {ITEM.upper()} {filler(6)}"),
        (4, filler(7)), (5, None), (6, ""), (None, ITEM), (7, filler(8) * 50), (7, ITEM), (8, "On Monday morning Anna bought 12 red cars."),
    ]
    twice = "Take 5 of them and then add 5 of them to the same 5 of them on the table."
    rows += [(20, f"{filler(9)} {twice.replace('5', '8')} {filler(10)}"), (21, f"{filler(11)} Take 1 of them and then add 2 of them to the same 3 of them on the table. {filler(12)}")]
    bench = spark.createDataFrame([(1, ITEM), (2, "too short"), (3, None), (4, twice), (4, twice)], "item_id long, text string")
    return docs_of(rows), bench


def test_leaks_are_found_also_with_other_parameters(leak_tables):
    docs, bench = leak_tables
    got = {r.doc_id: r for r in decontaminate.op6_decontaminate(docs, bench).collect()}
    assert set(got) == {1, 2, 3, 7, None, 20}  # 21 fills the slots of one number with three
    assert got[1].same_slots and not got[2].same_slots and got[1].item_ids == [1]
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["21", "4", "5", "6", "7", "8"]


def test_copies_in_other_case_or_punctuation_are_leaks(spark, docs_of, words):
    item = "Where did Anna go? Then Peter, her brother, followed. He saw Maria: She was at home. Did Otto come too? Nobody knows, said Eva."
    bare = "".join(c for c in item if c not in ".,!?:;")
    numbers = "2 3 5 7 11 13 17 19 23 29 31 37"
    title = " ".join(w.capitalize() for w in item.split())
    filler = lambda k: " ".join(words(30, 300 + k))
    texts = [item, bare, item.upper(), item.lower(), title, numbers, filler(9), "1 2 3 4 5 6 7 8 9 10 11 12"]
    docs = docs_of([(k, f"{filler(k)} {t} {filler(50 + k)}") for k, t in enumerate(texts)])
    bench = spark.createDataFrame([(1, item), (2, numbers)], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.op6_decontaminate(docs, bench).collect()}
    assert {i: r.item_ids for i, r in got.items()} == {0: [1], 1: [1], 2: [1], 3: [1], 4: [1], 5: [2]}
    assert all(r.same_slots and r.cover == 1 for r in got.values())
    assert [r.doc_id for r in decontaminate.clean(docs, bench).orderBy("doc_id").collect()] == [6, 7]


def plain_matches(docs, items):
    """All windows of all items against all windows of all documents, by lists of words."""
    found = {}

    def shape(text):
        h, slots, words, bare = decontaminate.canonical(text or "")
        bare_words = [w.strip(decontaminate.SIGNS).lower().translate(decontaminate._NO_SIGNS) for w in words]
        template = [f"<{int(x)}>" if s else w for x, s, w in zip(h, slots, bare_words)]
        return template, bare_words, [w.strip(decontaminate.SIGNS).lower() for w in words], slots.tolist()

    shapes = {i: shape(t) for i, t in docs}
    for item, text in items:
        template, bare, values, slots = shape(text)
        size = min(8, len(bare))
        if size < 5:
            continue
        windows = range(len(bare) - size + 1)
        full = lambda n: {w for w in range(len(bare) - n + 1) if n - sum(slots[w : w + n]) >= 4}
        longer = next((n for n in range(size, min(len(bare), 24) + 1) if full(n)), size)
        filled = full(longer)
        for doc, (d_template, d_bare, d_values, d_slots) in shapes.items():
            good, run, same = set(), 0, False
            for shift in range(-len(bare), len(d_bare)):
                inside = [w for w in windows if 0 <= w + shift <= len(d_bare) - size]
                literal = [w for w in inside if bare[w : w + size] == d_bare[w + shift : w + shift + size]]
                alike = [w for w in filled if 0 <= w + shift <= len(d_bare) - longer and template[w : w + longer] == d_template[w + shift : w + shift + longer]]
                pairs = {(values[k], d_values[k + shift]) for w in alike for k in range(w, w + longer) if slots[k]}
                if len({a for a, _ in pairs}) < len(pairs):
                    alike = []
                good |= set(literal) | set(alike)
                run, same = max(run, len(literal)), same or bool(literal) or bool(alike) and all(a == b for a, b in pairs)
            cover = max(len(good) / len(windows), len(good & filled) / len(filled) if filled else 0)
            if good and (cover >= 0.5 or run >= 6):
                found.setdefault(doc, {})[item] = (round(cover, 6), same)
    return found


QUESTIONS = [
    "Compute 12 km plus 7 km minus 3 kg over 5 m and 9 s.",
    "A train leaves Berlin at 9 and reaches Hamburg after 3 hours with 210 passengers on board, how fast was it on average?",
    "Mary has 3 apples and John has 5 pears, how many pieces of fruit do Mary and John have together?",
    "What is 5 % of 80 euros if 5 % of 40 euros is 2 euros?",
    "the quick brown fox jumps over the lazy dog while seven small birds sing in the green garden behind our house",
    "Sum 1 2 3 4 5 6 7 8 9.",
]


def changed(question, r):
    """Other numbers and names, each value the same way throughout."""
    given = {}
    def other(m):  # noqa: E306
        return given.setdefault(m[0], str(r.randint(1, 99)) if m[0][0].isdigit() else r.choice(["Otto", "Eva", "Paris", "Rome"]))

    return re.sub(r"(?<=\S )(?:\d+|[A-Z][a-z]+)", other, question)


def test_decontamination_equals_brute_force(spark, docs_of, words):
    r, rows = random.Random(4), []
    filler = lambda n: " ".join(words(n, r.randrange(10**6)))
    for q in QUESTIONS:
        w = q.split()
        half = [" ".join(w[a : a + n]) for n in (8, 10, 13, len(w) // 2 + 5) for a in (0, 3)]
        mixed = re.sub(r"\d+", lambda m: str(r.randint(1, 99)), q)  # a value may become several
        for t in [q, q.upper(), changed(q, r), changed(q, r), mixed, q.replace("12", "5").replace("7", "5"), q.replace(".", "").replace(",", ""), *half]:
            rows.append((len(rows), f"{filler(12)} {t} {filler(9)}"))
    rows += [(900 + k, filler(60)) for k in range(10)]
    items = list(enumerate(QUESTIONS))
    want = plain_matches(rows, items)
    got = decontaminate.matches(docs_of(rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    found = {}
    for m in got:
        found.setdefault(m.doc_id, {})[m.item_id] = (round(m.cover, 6), m.same_slots)
    assert found == want
    assert len(want) > 40 and not set(want) & set(range(900, 910))
    first = 15  # documents of a question; each question is found verbatim, in capitals, changed, and with equal new values
    assert all(q * first + k in want for q in range(len(QUESTIONS)) for k in ((0, 1, 2, 3, 5, 6) if q < 5 else (0, 1, 6)))


def test_short_items_are_counted(spark):
    bench = spark.createDataFrame([(1, "too short"), (2, None), (3, "a b c d e"), (4, "one two three four .")], "item_id long, text string")
    assert sorted(x.item_id for x in decontaminate.short_items(bench).collect()) == [1, 2, 4]


def test_decontamination_of_empty_tables(leak_tables):
    docs, bench = leak_tables
    assert decontaminate.op6_decontaminate(docs.limit(0), bench).count() == 0
    assert decontaminate.op6_decontaminate(docs, bench.limit(0)).count() == 0
    assert decontaminate.clean(docs, bench.limit(0)).count() == docs.count()


def test_exact_passages_against_brute_force(spark):
    from chainloom.llm.common import table

    docs, bench = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "benchmark")
    bare = lambda t: " ".join(w.strip(decontaminate.SIGNS).lower() for w in t.split())
    items = [bare(r.text) for r in bench.collect()]
    want = {r.doc_id for r in docs.collect() if any(i in bare(r.text) for i in items)}
    assert want <= {r.doc_id for r in decontaminate.op6_decontaminate(docs, bench).collect()}


def test_classifier_learns_and_holds_out(spark):
    import zlib

    from chainloom.llm.common import table

    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    got = {r.doc_id: r for r in quality_model.op4_quality_model(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    known = [(r.quality, got[r.doc_id]) for r in labels.collect()]
    held = [(q, r) for q, r in known if r.held_out]
    assert sum(q == r.predicted for q, r in held) >= 0.93 * len(held)
    shown = labels.withColumn("quality", labels.quality * 0)  # held-out labels aren't learnt from
    changed = labels.join(docs.select("doc_id"), "doc_id").filter("crc32(cast(doc_id AS string)) % 4 <> 2").unionByName(shown.filter("crc32(cast(doc_id AS string)) % 4 = 2"))
    again = {r.doc_id: r.score for r in quality_model.op4_quality_model(docs, changed).collect()}
    assert all(again[i] == pytest.approx(r.score) for i, r in got.items())


def test_classifier_of_odd_tables(spark, docs_of):
    docs = docs_of([(1, None), (2, ""), (3, "some text"), (3, "some text"), (None, "!!! " * 3000)])
    labels = spark.createDataFrame([(3, 1), (99, 0), (None, 1), (1, None)], "doc_id long, quality int")
    got = quality_model.op4_quality_model(docs, labels).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert quality_model.op4_quality_model(docs.limit(0), labels).count() == 0
