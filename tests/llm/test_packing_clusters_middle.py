"""Packing, centroid clustering and fill-in-middle against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from chainloom.llm import centroids, fill_in_middle, packing
from chainloom.llm.queries import tokenizer_path

BYTES = tokenizer_path("byte_bpe_50k.json")
SIZE = 2048


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BYTES)


def some_texts(words, n=60, seed=3):
    r, names = random.Random(seed), words(300)
    texts = [None, "", "one", "no stop " * 9000, "x" * 30000, "Ends. " * 3000]
    for _ in range(n):
        texts.append(" ".join(r.choice(names) + r.choice(["", "", ",", ".", ".\n", "?"]) for _ in range(r.choice([3, 40, 700]))))
    return texts


# packing


def check_pieces(rows, texts_of, library, size=SIZE):
    """Every id in one piece, sequences without gaps, digests of the library's ids."""
    wanted = defaultdict(list)
    for doc_id, text in texts_of:
        wanted[doc_id].append(library.encode(text or "", add_special_tokens=False).ids + [1])
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= size
    assert pieces.keys() == wanted.keys()
    for doc_id, lists in wanted.items():
        want = sorted((len(ids), s) for ids in lists for s in range(len(ids)))
        got = sorted((r.doc_tokens, s) for r in pieces[doc_id] for s in range(r.start, r.start + r.length))
        assert got == want
        if len(lists) == 1:
            for r in pieces[doc_id]:
                assert r.ids_crc32 == zlib.crc32(np.array(lists[0][r.start : r.start + r.length], "<u4").tobytes())
    return sum(packing.padding(sum(n for _, n in parts), size) for parts in sequences.values())


def test_pieces_hold_every_id_once_with_little_padding(docs_of, words, library):
    texts = list(enumerate(some_texts(words))) + [(7, "again and again"), (7, "again and again"), (None, "no id. None.")]
    rows = packing.op11_packing(docs_of(texts).coalesce(2), BYTES).collect()
    total = sum(r.length for r in rows)
    assert check_pieces(rows, texts, library) < 0.03 * total


def test_packing_of_an_empty_table(docs_of):
    assert packing.op11_packing(docs_of([]), BYTES).count() == 0


def test_order_is_kept(docs_of, words):
    texts = [(k, t) for k, t in enumerate(some_texts(words, 20))]
    rows = packing.packed(docs_of(texts[::-1]), BYTES, order_by=["doc_id"]).collect()
    order = [(r.doc_id, r.start) for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset))]
    assert order == sorted(order)


def brute_cost(places, penalties, size):
    """Least cost by looking at all pairs of cut points."""
    cost = {0: 0.0}
    for p, extra in list(zip(places, penalties))[1:]:
        cost[p] = min(cost[q] + (0 if (p - q) & (p - q - 1) == 0 and (p - q >= packing.LEAST_POWER or p - q == size) else size - (p - q)) + extra + packing.SEQUENCE for q in cost if p - size <= q < p)
    return cost[places[-1]]


@pytest.mark.parametrize("size", [128, 200, 256])
def test_paths_are_shortest(size, monkeypatch):
    monkeypatch.setattr(packing, "LEAST_POWER", 32)
    r = np.random.default_rng(size)
    for _ in range(40):
        places = np.r_[0, np.cumsum(r.integers(1, size // r.integers(1, 6) + 1, 60))]
        penalties = np.r_[0, r.integers(0, 3, len(places) - 1) * 8.0]
        f, parent = packing.shortest_paths(places, penalties, size)
        assert f[-1] == pytest.approx(brute_cost(places.tolist(), penalties.tolist(), size))
        path = packing.path_to(len(places) - 1, parent)
        assert path[0] == 0 and all(0 < places[b] - places[a] <= size for a, b in zip(path, path[1:]))


def test_blocks_don_t_change_the_path(monkeypatch):
    """Cuts given out block by block are those of one program over the whole stream."""

    class Ends:
        def after(self, ids):
            return np.flatnonzero(ids[:-1] % 13 == 0) + 1

    r, size = np.random.default_rng(5), 256
    docs = [(k, r.integers(2, 1000, int(n)).astype("<u4").tobytes()) for k, n in enumerate(r.choice([1, 30, 200, 900], 300))]

    def cuts_with(block):
        monkeypatch.setattr(packing, "BLOCK", block)
        packer, batches = packing.Packer(size, Ends(), 0), []
        for doc_id, ids in docs:
            packer.add(doc_id, ids)
            batches += packer.given()
        batches += packer.given(last=True)
        rows = [x for b in batches for x in b.to_pylist()]
        assert b"".join(x["ids"] for x in rows) == b"".join(ids for _, ids in docs)
        assert [x["sequence_id"] for x in rows] == sorted(x["sequence_id"] for x in rows)
        return len(batches), [(x["doc_id"], x["start"], x["sequence_id"], x["offset"]) for x in rows]

    n, whole = cuts_with(1 << 30)
    m, parts = cuts_with(2000)
    assert n == 1 and m > 10 and parts == whole


def test_cuts_are_at_sentence_ends(words, library):
    ends = packing.sentence_ends(BYTES)
    text = 'He left. She said "no." Then 3.5 of them came!\nIt was 他走了。好 done'
    ids = np.array(library.encode(text).ids, "<u4")
    cut = [library.decode(ids[:k].tolist()) for k in ends.after(ids).tolist()]
    assert "He left." in cut and 'He left. She said "no."' in cut and not any(c.endswith("3.") for c in cut)
    assert any(c.endswith("他走了。") for c in cut)


# centroid clustering


def brute_clusters(rows, k=40, rounds=5, scale=256, size=64):
    kept = [(i, [int(np.floor(scale * float(np.float32(c)))) for c in x]) for i, x in rows if x is not None and len(x) == size and all(c is not None and np.isfinite(c) for c in x)]
    kept.sort(key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    now = [list(v) for _, v in kept[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(now))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in kept:
            own[near(v)[1]].append(v)
        for j, vs in own.items():
            now[j] = [sum(c) // len(vs) for c in zip(*vs)]
    found = [(i, *near(v)) for i, v in kept]
    inertia = defaultdict(int)
    for _, d, j in found:
        inertia[j] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now]
    return sorted((str(i), j, d, inertia[j], sum(inertia.values()), digest[j]) for i, d, j in found)


VECTORS = "vec_id long, embedding array<float>, label int, cluster string, v string, distance string"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, x, 1, "a", "b", "c") for i, x in rows], VECTORS)


def clusters(spark, rows):
    got = centroids.op12_centroid_clusters(vectors_of(spark, rows)).collect()
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got)


def test_clusters_with_ties_nulls_and_repeated_rows(spark):
    r = random.Random(4)
    rows = [(k, [r.choice([-0.5, 0.0, 0.0, 0.25]) * r.choice([1, 1, 4]) for _ in range(64)]) for k in range(150)]
    rows += [(k, list(rows[k][1])) for k in range(20)] + [(1000 + k, list(rows[3][1])) for k in range(20)]
    rows += [(5, None), (6, [0.0] * 63), (7, [None] + [0.0] * 63), (8, [float("nan")] + [0.0] * 63), (9, [float("inf")] + [0.0] * 63), (None, [0.1] * 64), (10, [0.0] * 64)]
    assert clusters(spark, rows) == brute_clusters(rows)


def test_few_and_no_vectors(spark):
    rows = [(k, [k / 10] * 64) for k in range(3)]
    assert clusters(spark, rows) == brute_clusters(rows)
    assert clusters(spark, []) == [] == clusters(spark, [(1, None)])


def test_a_component_that_is_too_large_fails(spark):
    with pytest.raises(Exception, match="too large"):
        clusters(spark, [(1, [1e30] * 64)])


def test_the_annulus_finds_the_nearest_and_compares_fewer():
    r = np.random.default_rng(2)
    c = r.integers(-9, 9, (300, 4)) * r.choice([1, 30, 900], (300, 1))
    c[7] = c[2]
    v = np.concatenate([r.integers(-9, 9, (2000, 4)) * r.choice([1, 30, 900], (2000, 1)), c])
    search = centroids.Annulus(c)
    number, best = search.nearest(v)
    d = ((v[:, None] - c[None]) ** 2).sum(axis=2)
    assert (best == d.min(axis=1)).all() and (number == d.argmin(axis=1)).all()
    assert search.compared < 0.5 * d.size


def test_norms_of_any_size_lose_no_tie():
    big = (1 << 27) - 1
    c = np.array([[big, 0], [0, big], [-big, 0], [0, -big], [big - 1, 0]], np.int64)
    number, best = centroids.Annulus(c).nearest(np.array([[0, 0], [big, big], [-big, -big]], np.int64))
    assert number.tolist() == [4, 0, 2] and best.tolist() == [(big - 1) ** 2, big**2, big**2]


# fill in middle


def brute_middle(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n, digits = len(units), hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digits[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    before, middle, after = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")):
        return str(doc_id), n, "plain", None, None, sha(text), sha(text)
    form = "spm" if h4 % 100 < 50 else "psm"
    out = f"<S>{after}<P>{before}<M>{middle}" if form == "spm" else f"<P>{before}<S>{after}<M>{middle}"
    return str(doc_id), n, form, len(before), len(middle), sha(out), sha(text)


def test_middles(docs_of):
    r = random.Random(6)
    texts = [None, "", "\n", "\n\n", "a", "a\n", "\na", "x<P>y\nz", "<S", "P>\n<", "é\n世界\n🎉\r\n b\n" * 50, "line\n" * 40000, "no end " * 30000]
    texts += ["".join(r.choice("a\n\r<>PSM é🎉") for _ in range(r.randint(0, 60))) for _ in range(400)]
    rows = list(enumerate(texts)) + [(3, "a\nb"), (3, "a\nb"), (None, "p\nq\nr")]
    got = fill_in_middle.op13_fill_in_middle(docs_of(rows)).collect()
    want = sorted((brute_middle(*r) for r in rows), key=str)
    assert sorted(((str(g.doc_id), *g[1:]) for g in got), key=str) == want


def test_middles_of_an_empty_table(docs_of):
    assert fill_in_middle.op13_fill_in_middle(docs_of([])).count() == 0


@pytest.mark.parametrize("unit", ["line", "word", "character"])
def test_chunks_of_any_size_give_the_same_cuts(unit):
    border = fill_in_middle.BORDERS[unit]
    r = random.Random(8)
    for _ in range(200):
        text = "".join(r.choice("ab \n") for _ in range(r.randint(0, 40)))
        inner = [k + 1 for k in range(len(text) - 1) if border(np.array([ord(text[k])]), np.array([ord(text[k + 1])]))[0]]
        places = [0, *inner, len(text)] if text else [0]
        h = r.randrange(1 << 32), r.randrange(1 << 32)
        a, b = sorted(x % len(places) for x in h)
        for size in (1, 2, 7, 1000):
            assert fill_in_middle.cuts(text, h, border, size) == (len(places) - 1, places[a], places[b])


def test_a_share_stays_plain_and_texts_come_back(docs_of):
    from pyspark.sql import functions as F

    rows = [(k, f"line {k}\nnext\nlast {k}") for k in range(400)]
    made = fill_in_middle.fill_in_middle(docs_of(rows), percent=50, sentinels=("[P|", "[S|", "[M|"))
    back = made.select("doc_id", "form", fill_in_middle.restored(F.col("output"), F.col("form"), ("[P|", "[S|", "[M|")).alias("text")).collect()
    assert {(r.doc_id, r.text) for r in back} == set(rows)
    assert 120 < sum(r.form == "plain" for r in back) < 280
