import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm.packing import closest_multiset, pack, plan, token_pieces
from tidemark.llm.queries import tokenizer
from tidemark.llm.token_files import checksums, read_tokens, token_index, write_tokens
from tidemark.llm.tokens import Encoder


@pytest.fixture(scope="session")
def whole():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer())
    return lambda text: np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], np.uint32)


ODD = ["", " ", "  a  b", "a\n b", "a \n b\t c", "don't  I'll 's", "é è  ü", "a　b 　c", "  x  y", "x  ", "12 34 5.6 <|endoftext|> z", "日本語 テキスト a", "a \U0001f600 b", "tab\t x", "\x1c y \x85 z", "a" * 5000]


def test_chunks_give_the_same_ids_as_whole_texts(corpus, whole):
    rng, letters = random.Random(3), "ab Z9 ,.'\n\t \u00a0\u3000 é…ß'sdn't(-)\r\x1c\x00日本 re ll"
    mixed = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    texts = ODD + mixed + [t or "" for _, t in corpus]
    e = Encoder(tokenizer())
    assert e.cuts
    for _ in range(2):
        ids, counts = e.encode(pa.array(texts))
        parts = np.split(ids, np.cumsum(counts)[:-1])
        assert all((p == whole(t)).all() and len(p) == len(whole(t)) for p, t in zip(parts, texts, strict=True))
    e.cuts = False
    other, n = e.encode(pa.array(texts))
    assert (other == ids).all() and (n == counts).all()


def test_files_read_back(spark, corpus, whole, tmp_path):
    rows = [*corpus, (None, "no id"), (100, "repeated id")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, ids int")
    path = str(tmp_path / "tokens")
    write_tokens(docs, path, tokenizer())
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in checksums(read_tokens(spark, path)).collect())
    assert [g[1] for g in got] == sorted((i for i, _ in rows if i is not None)) + [None]
    at, want = 0, {}
    for start, _, n, _ in got:
        assert start == at
        at += n
    for i, t in rows:
        want.setdefault(i, set()).add((len(whole(t)), zlib.crc32(whole(t).tobytes())))
    assert all((n, crc) in want[i] for _, i, n, crc in got)
    assert at == sum(len(whole(t)) for _, t in rows) == token_index(spark, path).agg({"n_tokens": "sum"}).first()[0]
    some = read_tokens(spark, path, 103, 112).collect()
    assert sorted(r.doc_id for r in some) == [i for i in sorted(i for i, _ in corpus) if 103 <= i <= 112]
    assert all(np.array_equal(r.ids, whole(dict(corpus)[r.doc_id])) for r in some)


def test_no_documents(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string")
    write_tokens(empty, str(tmp_path / "none"), tokenizer())
    assert read_tokens(spark, str(tmp_path / "none")).count() == 0
    assert pack(token_pieces(empty, tokenizer())).count() == 0


def test_packing_places_each_id_once(spark, corpus, whole):
    docs = spark.createDataFrame([(i, t, 1) for i, t in corpus], "doc_id long, text string, offset int")
    rows = pack(token_pieces(docs, tokenizer(), capacity=64, ids=True), capacity=64).collect()
    texts, by_doc, by_sequence = dict(corpus), {}, {}
    for r in rows:
        assert list(whole(texts[r.doc_id])[r.start : r.start + r.length]) == r.ids
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and r.doc_tokens == len(whole(texts[r.doc_id]))
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length))
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for doc, parts in by_doc.items():
        assert [s for s, _ in sorted(parts)] == list(np.cumsum([0, *(n for _, n in sorted(parts))])[:-1])
        assert sum(n for _, n in parts) == len(whole(texts[doc]))
    for parts in by_sequence.values():
        assert [s for s, _ in sorted(parts)] == list(np.cumsum([0, *(n for _, n in sorted(parts))])[:-1]) and sum(n for _, n in parts) <= 64
    assert set(by_doc) == set(texts) and sorted(by_sequence) == list(range(len(by_sequence)))
    assert len(by_sequence) <= 1.05 * sum(r.length for r in rows) / 64 + 2


def test_lengths_out_of_range_raise_and_names_may_clash(spark):
    parts = spark.createDataFrame([(5, 1, "r"), (3, 2, "s"), (5, 3, "t")], "length long, rank int, row string")
    got = pack(parts, capacity=8).collect()
    assert sorted((r.length, r.rank, r.row) for r in got) == [(3, 2, "s"), (5, 1, "r"), (5, 3, "t")] and len({r.sequence_id for r in got}) == 2
    with pytest.raises(Exception, match="length"):
        pack(spark.createDataFrame([(9,)], "length long"), capacity=8).collect()
    with pytest.raises(Exception, match="length"):
        pack(spark.createDataFrame([(None,)], "length long"), capacity=8).collect()


def test_closest_multiset_against_all_choices():
    import itertools
    import random

    rng = random.Random(4)
    for _ in range(200):
        counts = {rng.randint(1, 12): rng.randint(1, 4) for _ in range(4)}
        room = rng.randint(0, 30)
        got = closest_multiset(dict(counts), room)
        best = max(s for s in (sum(n * k for n, k in zip(counts, ks, strict=True)) for ks in itertools.product(*(range(v + 1) for v in counts.values()))) if s <= room)
        assert sum(k * v for k, v in got.items()) == best and all(v <= counts[k] for k, v in got.items())
        whole = plan(dict(counts), 30)
        assert {k: sum(p.get(k, 0) * t for p, t in whole) for k in counts} == counts


def test_added_tokens_as_the_unmodified_library_has_them(spark, tmp_path):
    from tokenizers import Tokenizer

    from tidemark.llm.tokens import encoded

    t, end = Tokenizer.from_file(tokenizer()), "<|endoftext|>"
    texts = [*ODD, None, f"a {end} b", end, end * 3, f"x{end}\n y", f"\n{end}", "<|endof text|>", f"<|{end}|> don't", f"a  {end}  b" * 50]
    want = [[*t.encode(x or "", add_special_tokens=False).ids, 0] for x in texts]
    assert want[texts.index(f"a {end} b")] == [64, 220, 50256, 275, 0]
    for some in (pa.array(texts), pa.array(texts)[3:]):
        ids, n = encoded(some, tokenizer())
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == want[-len(some) :]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    write_tokens(docs, str(tmp_path / "added"), tokenizer())
    assert {r.doc_id: list(r.ids) for r in read_tokens(spark, str(tmp_path / "added")).collect()} == dict(enumerate(want))


def test_joined_chunks_never_make_an_added_token(tmp_path):
    from tokenizers import AddedToken, Tokenizer

    path = str(tmp_path / "more.json")
    t = Tokenizer.from_file(tokenizer())
    t.add_tokens([AddedToken("one two", normalized=False), AddedToken("left\nright", normalized=False)])
    t.save(path)
    texts = ["x one", "y two", "x one two", "left", "right", "left\nright"]
    e = Encoder(path)
    ids, n = e.encode(pa.array(texts))
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [[*t.encode(x, add_special_tokens=False).ids, 0] for x in texts]


def test_chunks_whose_hashes_meet_get_their_own_ids(monkeypatch, whole):
    from tidemark.llm import tokens

    monkeypatch.setattr(tokens, "byte_hashes", lambda data, starts, ends: (ends - starts).astype(np.uint64))
    texts = ["one two three", "two one", "", "six ten", None, "eleven"]
    ids, n = Encoder(tokenizer()).encode(pa.array(texts))
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [whole(x).tolist() for x in texts]


def test_letters_in_a_pattern(whole):
    """Two words of a well-known sequence that linear hashes can't tell apart."""
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    texts = [a, a.translate(str.maketrans("ab", "ba"))]
    ids, n = Encoder(tokenizer()).encode(pa.array(texts))
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [whole(x).tolist() for x in texts]


def test_ids_are_not_shuffled_to_be_read(spark, tmp_path):
    from tidemark.llm import token_files

    spark.createDataFrame([(1, 0, 0, 2, [5, 0]), (2, 1, 0, 1, [0])], "doc_id long, part int, part_start long, n_tokens long, ids array<int>").write.parquet(str(tmp_path / "t"))
    found = token_files.read_tokens(spark, str(tmp_path / "t"))
    assert "strategy=broadcast" in found._jdf.queryExecution().toString()
    assert sorted(tuple(r)[:3] for r in found.collect()) == [(1, 0, 2), (2, 2, 1)]


def test_frequent_chunks_are_remembered(whole, monkeypatch):
    """Chunks that came once make room for others; those that come in every run are encoded once."""
    from tidemark.llm import tokens

    monkeypatch.setattr(tokens, "_MOST", 90)
    e, learned = Encoder(tokenizer()), []
    learn = e._learn
    monkeypatch.setattr(e, "_learn", lambda hashes, *rest: (learned.append(len(hashes)), learn(hashes, *rest)))
    common = " ".join(f"often{chr(97 + i)}" for i in range(10))
    for i in range(12):
        text = f"{common} {' '.join(f'once{chr(97 + i)}{chr(97 + j)}é' for j in range(20))} \u3000. \u00a0x\u00a0 ! é"
        ids, _ = e.encode(pa.array([text]))
        assert ids.tolist() == whole(text).tolist()
    assert len(e.hashes) <= 90 and max(learned[2:]) < 25
