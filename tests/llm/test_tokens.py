"""Token counts and the token store against the libraries."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from chainloom.llm import token_counts, token_store
from chainloom.llm.common import new_folder
from chainloom.llm.queries import tokenizer_path

ROWS = [(1, None), (2, ""), (3, "Hello  world\n\tnow <s> ▁ é 世界 🎉"), (3, "Hello  world\n\tnow <s> ▁ é 世界 🎉"), (4, "x" * 9000), (None, "one two three"), (5, "a<|endoftext|>b  c \n d"), (-7, "ends in space ")]


def random_texts(n, seed):
    r = random.Random(seed)
    letters = list("ab  \n\té▁世s<s>'12²<|>.,\xa0\x85\x1c're 🎉the in")
    return ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(n)]


@pytest.fixture(scope="module")
def piece_library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))


def test_every_prefix_counts_as_the_library_counts_it(piece_library):
    counter = token_counts.counter(tokenizer_path("piece_bpe_32k.model"))
    import zstandard

    for text in random_texts(300, 1):
        found = token_counts.counts(zstandard.compress(counter.prefix_steps(text)))
        assert found.tolist() == [len(piece_library.encode(text[:i])) for i in range(len(text) + 1)], text


def test_token_counts_of_documents(docs_of, piece_library):
    got = token_counts.op9_token_counts(docs_of(ROWS), tokenizer_path("piece_bpe_32k.model")).collect()
    want = sorted((str(i), len((t or "").encode()), len(piece_library.encode(t or ""))) for i, t in ROWS)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
    assert {r.doc_id for r in got if r.over_limit} == {i for i, t in ROWS if len(piece_library.encode(t or "")) > 4096}


def test_token_counts_of_an_empty_table(docs_of):
    assert token_counts.op9_token_counts(docs_of([]), tokenizer_path("piece_bpe_32k.model")).count() == 0


def test_budgets_are_answered_from_the_stored_counts(docs_of, piece_library):
    text = "the quick brown fox jumps over it, and then some more of that"
    stored = token_counts.prefix_counts(docs_of([(1, text), (2, "")]), tokenizer_path("piece_bpe_32k.model"))
    n = dict((r.doc_id, r.n_chars) for r in token_counts.longest_within(stored, 5).collect())
    fits = [i for i in range(len(text) + 1) if len(piece_library.encode(text[:i])) <= 5]
    assert n == {1: fits[-1], 2: 0}
    at = dict((r.doc_id, r.n_tokens_at) for r in token_counts.count_at(stored, 10).collect())
    assert at == {1: len(piece_library.encode(text[:10])), 2: 0}


def test_ids_are_those_of_the_library():
    e = token_store.encoder(tokenizer_path("byte_bpe_50k.json"))
    texts = random_texts(2000, 2) + ["", " ", " a", "a ", "long " * 300_000, "w" * 60 + " " + "w" * 60] + [" ".join(t.split()) for t in random_texts(2000, 4)]
    for e.memory.SIZE in (5, 200_000):
        for text, ids in zip(texts, e.encoded(pa.array(texts), b"")):
            assert ids == np.array(e.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text[:100])
        assert len(e.memory.young) <= e.memory.SIZE


def test_frequent_words_stay_in_a_full_memory():
    g = token_store.Generations()
    g.SIZE, asked = 10, []
    encode = lambda words: asked.extend(words) or [w.encode() for w in words]
    for k in range(100):
        assert g.found(["the", f"rare{k}"], encode) == [b"the", f"rare{k}".encode()]
    assert asked.count("the") == 1 and len(g.young) + len(g.old) <= 20


def expected_store(rows):
    library = token_store.encoder(tokenizer_path("byte_bpe_50k.json")).library
    start, out = 0, []
    for i, t in sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = library.encode(t, add_special_tokens=False).ids + [0]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_store_round_trip(docs_of):
    rows = [(r[0], r[1]) for r in ROWS] + [(100 + k, t) for k, t in enumerate(random_texts(300, 3))]
    got = token_store.op5_token_store(docs_of(rows), tokenizer_path("byte_bpe_50k.json")).collect()
    found = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got), key=lambda r: r[1])
    assert found == expected_store(rows)


def test_store_of_an_empty_table(docs_of):
    assert token_store.op5_token_store(docs_of([]), tokenizer_path("byte_bpe_50k.json")).count() == 0


def test_single_documents_are_read_from_their_frames(spark, docs_of):
    rows = [(k, f"text number {k}") for k in range(50)]
    folder = token_store.write_store(docs_of(rows), new_folder(spark, "one"), tokenizer_path("byte_bpe_50k.json"))
    shard = spark.read.parquet(f"{folder}/shards").orderBy("part", "seq").first()
    library = token_store.encoder(tokenizer_path("byte_bpe_50k.json")).library
    assert token_store.read_document(folder, shard.path, 2).tolist() == library.encode("text number 2").ids + [0]
    assert [x.tolist() for x in token_store.find_document(spark, folder, 31)] == [library.encode("text number 31").ids + [0]]
    assert token_store.find_document(spark, folder, 50) == []
    with pytest.raises(IndexError):
        token_store.read_document(folder, shard.path, shard.n_docs)


def test_a_store_with_another_dictionary_is_refused(spark, docs_of):
    folder = token_store.write_store(docs_of([(1, "a b c")]), new_folder(spark, "two"), tokenizer_path("byte_bpe_50k.json"))
    with open(folder.removeprefix("file://") + "/dictionary.zdict", "wb") as f:
        f.write(b"other")
    with pytest.raises(Exception, match="dictionary"):
        token_store.read_store(spark, folder).collect()


def test_columns_named_like_results_don_t_matter(spark):
    from chainloom.llm import quality_model

    rows = [(k, f"text number {k}" * (k + 1), 1, 2, 3.0, "x", "y", b"z") for k in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start long, n_tokens long, score double, id string, label string, bands binary")
    plain, labels = docs.select("doc_id", "text"), spark.createDataFrame([(k, k % 2) for k in range(8)], "doc_id long, quality int")
    for query in (
        lambda d: token_store.op5_token_store(d, tokenizer_path("byte_bpe_50k.json")).drop("frame_bytes"),
        lambda d: token_counts.op9_token_counts(d, tokenizer_path("piece_bpe_32k.model")),
        lambda d: quality_model.op4_quality_model(d, labels),
    ):
        assert sorted(map(str, query(docs).collect())) == sorted(map(str, query(plain).collect()))


def test_a_task_that_is_tried_twice_leaves_its_first_shard_alone(spark, docs_of):
    """Both attempts' files stand; the table of shards decides which one is read."""
    from chainloom.llm.token_store import ShardWriter, compressor

    folder = token_store.write_store(docs_of([(k, f"text {k}") for k in range(9)]), new_folder(spark, "twice"), tokenizer_path("byte_bpe_50k.json"))
    before = sorted(map(str, token_store.read_store(spark, folder).collect()))
    with open(folder.removeprefix("file://") + "/dictionary.zdict", "rb") as f:
        dictionary = f.read()
    for r in spark.read.parquet(f"{folder}/shards").select("part", "seq", "path").collect():
        late = ShardWriter(folder, r.part, r.seq, dictionary)
        late.add(1, compressor(dictionary).compress(b"\7\0\0\0"), 1)
        assert late.close()[2] != r.path
    assert sorted(map(str, token_store.read_store(spark, folder).collect())) == before
