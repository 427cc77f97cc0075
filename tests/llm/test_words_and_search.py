"""Spelling variants, ranked search and the token store against brute force."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nightjar.llm import id_coder, lexical, packing, queries, spelling, token_store

LOWERED = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---- spelling variants

def brute_words(rows, drop_every=199):
    out = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWERED)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % drop_every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            out[run] += 1
    return out


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    f = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[f + (len(a) >= len(b)):] == b[f + (len(b) >= len(a)):]


def brute_variants(counts, min_length=6, min_count=5, ratio=5):
    known = {w: n for w, n in counts.items() if len(w) >= min_length and n >= min_count}
    around = {w: [v for v in known if near(w, v)] for w in known}
    form = {}
    for w, vs in around.items():
        best = min(vs, key=lambda v: (-known[v], v), default=None)
        form[w] = best if best is not None and known[best] >= ratio * known[w] else None
    out = set()
    for w in known:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, known[w], form[w], form[w] and known[form[w]], len(around[w]), root))
    return out


def word_table(seed=1, letters="abé", sizes=(6, 7, 8, 9), many=250):
    rng = random.Random(seed)
    counts = Counter()
    for _ in range(many):
        w = "".join(rng.choice(letters) for _ in range(rng.choice(sizes)))
        counts[w] += rng.choice([1, 5, 5, 9, 30, 200, 5000])
    counts.update({"x" * 2000: 50, "x" * 2001: 7, "x" * 1999: 8, "aa": 90, "": 40})
    return counts


def variants(spark, counts, **opts):
    df = spark.createDataFrame([(w, n) for w, n in counts.items()], "word string, n long")
    got = [tuple(r) for r in spelling.group_variants(df, **opts).select("word", "n", "form", "form_n", "n_near", "root").collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("crowded", [spelling.CROWDED, 40, 0])
def test_variants_match_brute_force(spark, crowded):
    counts = word_table()
    assert variants(spark, counts, crowded=crowded) == brute_variants(counts)


def test_variants_of_short_words_and_chains(spark):
    counts = word_table(2, "ab", (2, 3, 4, 5), 60)
    assert variants(spark, counts, min_length=2, min_count=1, ratio=2) == brute_variants(counts, 2, 1, 2)
    chain = Counter({"a" * (6 + i): 5 ** (i + 1) for i in range(12)})
    assert {r[5] for r in variants(spark, chain)} == {"a" * 17}


def test_variants_of_a_crowded_chunk(spark):
    """All words share their first half, and most their second."""
    rng = random.Random(4)
    counts = Counter({"prefix" + "".join(rng.choice("abcdefgh") for _ in range(6)): rng.choice([5, 6, 40]) for _ in range(3000)})
    assert variants(spark, counts, crowded=1000) == brute_variants(counts)


def test_variants_repeats_nulls_and_empty(spark):
    df = spark.createDataFrame([("abcdef", 3, "x"), ("abcdef", 3, "y"), (None, 9, "z"), ("abcdeg", None, "z"), ("abcdeh", 30, None)],
                               "word string, n long, chunk string")
    got = {tuple(r) for r in spelling.group_variants(df).select("word", "n", "form", "form_n", "n_near", "root").collect()}
    assert got == {("abcdef", 6, "abcdeh", 30, 1, "abcdeh"), ("abcdeh", 30, None, None, 1, "abcdeh")}
    assert spelling.group_variants(df.limit(0)).count() == 0


def test_corpus_words(spark, docs, rows, none):
    odd = [(7, "Ünïted ÜNÏTED naïveté × Ÿ a1b ŁÓDŹ ÀÿÁ"), (None, "United words 漢字 words")]
    given = [(r[0], r[1]) for r in rows] + odd
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    for every in (199, 3):
        got = {r["word"]: r["n"] for r in queries.corpus_words(df, every).collect()}
        assert got == brute_words(given, every)
    assert queries.corpus_words(none).count() == 0


def test_variants_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = queries.QUERIES["op11_spelling_variants"](spark, sf)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    found = {tuple(r) for r in got.select("word", "n", "form", "form_n", "n_near", "root").collect()}
    assert found == brute_variants(brute_words([tuple(r) for r in docs]))


# ---- ranked search

def brute_rank(rows, items, k):
    split = lambda t: re.findall(lexical.TERM, (t or "").translate(LOWERED))
    docs = [(d, Counter(split(t))) for d, t in rows]
    docs = [(d, c, c.total()) for d, c in docs if c]
    n_docs, n_terms = len(docs), sum(n for _, _, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(split(text))
    out = []
    for item, ts in asked.items():
        found = []
        for d, c, n in docs:
            m = 100 - 90 + 90 * n * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 8 * m))
                        for t in ts if t in c)
            if score > 0:
                found.append((-score, d is not None, d or 0))
        out += [(item, i + 1, d if known else None, -s) for i, (s, known, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


ITEMS = [("q1", "licensed under x"), ("q2", "one two words A\x0bB straße Ωmega"), ("q2", "one more row"), ("q3", None), ("q4", "  ,;"),
         (None, "É changed1 changed2"), ("q5", "nowhere-found"), ("q6", "a b c d e f g h i j ab ba cd dc"), ("q6", "a b c d e f g h i j ab ba cd dc")]


@pytest.mark.parametrize("k,block_bytes,shard", [(10, 1 << 20, 2_000_000), (3, 40, 50), (1, 1 << 20, 300), (1000, 1 << 20, 1)])
def test_ranks_match_brute_force(spark, docs, rows, k, block_bytes, shard):
    items = spark.createDataFrame([(i, t, "own") for i, t in ITEMS], "item_id string, text string, score string")
    got = lexical.rank(docs.withColumnRenamed("n_chars", "rank"), items, k, block_bytes, shard)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_rank([r[:2] for r in rows], ITEMS, k)


def test_ranking_of_empty_tables(spark, docs, none):
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    assert lexical.rank(none, items).count() == 0
    assert lexical.rank(docs, items.limit(0)).count() == 0


def test_accumulators_are_limited_and_exact():
    """Common terms create no accumulators once they cannot matter."""
    rng = np.random.default_rng(0)
    n_docs = 5000
    term = np.concatenate([np.full(30, 0), np.full(n_docs, 1), np.full(n_docs, 2)])
    doc = np.concatenate([np.sort(rng.choice(n_docs, 30, replace=False)), np.arange(n_docs), np.arange(n_docs)])
    adds = np.concatenate([rng.integers(900, 1000, 30), rng.integers(1, 40, n_docs), rng.integers(1, 40, n_docs)])
    shard = lexical.Shard(doc, term, adds, np.arange(n_docs), 3)
    made = []
    kth = shard.kth
    shard.kth = lambda k: made.append(int((shard.total > 0).sum())) or kth(k)
    score, ids = shard.best(np.array([0, 1, 2]), 10, 0)
    assert max(made) == 30      # only the rare term's documents
    total = np.bincount(doc, adds, n_docs).astype(int)
    want = sorted(range(n_docs), key=lambda d: (-total[d], d))[:10]
    assert ids.tolist() == want and score.tolist() == [total[d] for d in want]


def test_long_corpora_do_not_overflow():
    got = lexical.damping(np.array([5, 10 ** 9]), 10 ** 11, 10 ** 14)
    assert got.tolist() == [10, 10 + 90 * 10 ** 9 * 10 ** 11 // 10 ** 14]


# ---- token store

def coded_and_back(blocks):
    coded = id_coder.encode(blocks)
    back = id_coder.decode([(len(b), known, words) for b, (known, words) in zip(blocks, coded)])
    assert all(a.dtype == b.dtype and (a == b).all() for a, b in zip(blocks, back))
    return coded


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 2 ** 32 - 1)), min_size=1, max_size=200), max_size=6))
def test_blocks_decode_to_what_was_encoded(blocks):
    coded_and_back([np.array(b, dtype="<u4") for b in blocks])


def test_coder_on_odd_blocks():
    rng = np.random.default_rng(1)
    odd = [np.array([7]), np.full(5000, 9), np.tile(np.arange(70), 60), np.arange(id_coder.MAX_IDS), rng.zipf(1.2, 9000) % 50_000,
           rng.integers(0, 2 ** 32, 3000), np.tile(rng.integers(0, 40, 50), 80)]
    coded = coded_and_back([b.astype("<u4") for b in odd])
    assert len(coded[1][1]) < 40 and len(coded[2][1]) < 200      # what repeats costs next to nothing
    alone = id_coder.encode([odd[4].astype("<u4")])[0]           # a block doesn't depend on its neighbours
    assert (alone[1] == coded[4][1]).all()
    with pytest.raises(ValueError):
        id_coder.encode([np.zeros(0, dtype="<u4")])


def test_joined_checksums():
    rng = random.Random(2)
    pairs = [(b"", b""), (b"x", b""), (b"", b"y")] + [(rng.randbytes(rng.randrange(90)), rng.randbytes(rng.randrange(9000))) for _ in range(80)]
    got = token_store.join_crc32(np.array([zlib.crc32(a) for a, _ in pairs]), np.array([zlib.crc32(b) for _, b in pairs]),
                                 np.array([len(b) for _, b in pairs]))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in pairs]


WORDS = ["don't", "naïve", "NAÏVE,", "e\u0301,", "é.", "ÿ", "ß", "ÜBER-", "÷", "×2", "µm", "a1.,b", "word...", "(in)", "x<|y", "<|endoftext|>", "\x01",
         "ŁÓDŹ", "漢字", "e\u0301", "A\u030a", "İ", "ﬁ", "it's", "'s", "ª", "a\u00ad", "\u2028", "tab\u00a0nbsp", "é" * 40, "q" * 3000]


@pytest.mark.parametrize("name", ["word_bpe_49k.json"])
def test_words_encode_as_the_library_does(name):
    enc = packing.WordEncoder(queries.vocabulary(name))
    assert enc.bare is not None
    rng = random.Random(3)
    alphabet = "abcxyzABCéÉüßÿ.,!?-;:'\"1290<|>_@#漢\u0301ł"
    texts = [" ".join(WORDS), "".join(WORDS), ""] + ["".join(rng.choice(alphabet + "   \n\t") for _ in range(rng.randrange(60))) for _ in range(3000)]
    got = enc.ids([t.encode() for t in texts])
    for text, raw in zip(texts, got):
        assert raw == enc.encode(text.encode()).tobytes(), text


def test_words_of_letters_signs_and_digits_are_cut_before_they_are_learned(monkeypatch):
    enc = packing.WordEncoder(queries.vocabulary("word_bpe_49k.json"))
    whole, learn = [], enc.learn_whole
    monkeypatch.setattr(enc, "learn_whole", lambda new: learn(whole.extend(new) or new))
    texts = [f"Été{i},ab{i}-cd.{i}! (Xy/{i})".encode() for i in range(200)]
    assert enc.ids(texts) == [enc.encode(t).tobytes() for t in texts]
    # Signs and digits alone, however many words are made of them.
    assert len(whole) <= 20 and max(map(len, whole)) <= 2


def test_words_are_the_librarys_in_small_blocks_with_a_small_cache(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 40)
    monkeypatch.setattr(packing, "BLOCK_BYTES", 200)
    enc = packing.WordEncoder(queries.vocabulary("word_bpe_49k.json"))
    rng = random.Random(4)
    alphabet = "abcxyzABCéÉÈüßÿ×÷.,!?-;:'\"1290<|>_@#漢\u0301łµª\x01\x1c\x85   \n\t"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.choice([0, 3, 60, 900]))).encode() for _ in range(1500)]
    # And with damaged UTF-8.
    texts += [bytes(b if rng.random() > 0.05 else rng.choice(b"\xc3\x80\xbf\xe9\x97\xff") for b in t) for t in texts]
    for text, raw in zip(texts, enc.ids(texts)):
        assert raw == enc.encode(text).tobytes(), text
    assert len(enc.words) == len(set(enc.words.to_pylist())) <= 40


def test_blocks_are_coded_without_sorting_and_decoded_without_searching(monkeypatch):
    rng = np.random.default_rng(2)
    blocks = [rng.zipf(1.3, n) % 50_000 for n in (1, 17, 700, 4096, 4096)] + [np.arange(40_000), np.full(3000, 7), np.array([0, 65_535] * 40)]
    blocks = [b.astype("<u4") for b in blocks]
    large = np.array([2 ** 32 - 1, 5, 2 ** 31] * 30, dtype="<u4")      # too large for a table

    def decoded(coded, blocks):
        return id_coder.decode([(len(b), known, words) for b, (known, words) in zip(blocks, coded)])

    assert (decoded(id_coder.encode([large]), [large])[0] == large).all()
    monkeypatch.setattr(id_coder.np, "unique", None)

    class Unsearched(np.ndarray):
        def searchsorted(self, *args, **kwargs):
            raise AssertionError("all lanes searched as one")

    renew = id_coder.Mixer.renew

    def renewed(self, *args):
        renew(self, *args)
        self.searched = self.searched.view(Unsearched)

    monkeypatch.setattr(id_coder.Mixer, "renew", renewed)
    coded = id_coder.encode(blocks)
    for block, (known, _), back in zip(blocks, coded, decoded(coded, blocks)):
        assert known.dtype == block.dtype and known.tolist() == sorted(set(block.tolist()))
        assert (back == block).all()


def brute_tokens(rows, end_id=1):
    enc = packing.WordEncoder(queries.vocabulary("word_bpe_49k.json"))
    out, at = [], 0
    for doc_id, text in sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = enc.encode((text or "").encode()).tobytes() + np.array([end_id], dtype="<u4").tobytes()
        out.append((doc_id, at, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    return out


def stored(got):
    return sorted((tuple(r) for r in got.collect()), key=lambda r: r[1])


@pytest.mark.parametrize("block,lanes", [(token_store.BLOCK, token_store.LANES), (16, 3), (1024, 1)])
def test_store_reads_back_what_was_written(spark, clashing, rows, tmp_path, monkeypatch, block, lanes):
    folder = str(tmp_path / "ids")
    token_store.write_tokens(clashing.withColumns({c: F.lit("own") for c in ("row", "part", "payload")}),
                             queries.vocabulary("word_bpe_49k.json"), folder, 1, block, lanes)
    got = stored(token_store.read_documents(spark, folder))
    want = brute_tokens(rows)
    places = lambda x: sorted(x, key=repr)
    # Rows that share a doc_id may come in any order among each other.
    assert places((d, n, c) for d, _, n, c in got) == places((d, n, c) for d, _, n, c in want)
    assert [d for d, *_ in got] == [d for d, *_ in want]
    assert [s for _, s, *_ in got] == [sum(n for _, _, n, _ in got[:i]) for i in range(len(got))]
    ids = token_store.read_pieces(spark, folder, with_ids=True).collect()
    assert all(zlib.crc32(r["ids"]) == r["crc32"] and len(r["ids"]) == 4 * r["n"] for r in ids)
    assert len(ids) > len(got)      # a document is cut


def test_store_of_an_empty_table_and_damaged_blocks(spark, docs, none, tmp_path):
    empty = str(tmp_path / "empty")
    token_store.write_tokens(none, queries.vocabulary("word_bpe_49k.json"), empty)
    assert token_store.read_documents(spark, empty).count() == 0
    ids = np.arange(500, dtype="<u4") % 7
    known, words = id_coder.encode([ids])[0]
    raw = token_store.pack_block(ids, known, words, [-(2 ** 63), None, 2 ** 63 - 1], [100, 399, 1], 5, 2)
    back = next(token_store.open_blocks([raw]))
    assert (back[0] == ids).all() and back[1] == [-(2 ** 63), None, 2 ** 63 - 1] and back[2].tolist() == [100, 399, 1] and back[3:] == (5, 2)
    for at in (0, 60, len(raw) - 1):
        with pytest.raises(ValueError):
            list(token_store.open_blocks([raw[:at] + bytes([raw[at] ^ 1]) + raw[at + 1:]]))
    with pytest.raises(ValueError):
        list(token_store.open_blocks([raw[:30]]))


def test_store_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = queries.QUERIES["op13_token_store"](spark, sf)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert stored(got) == brute_tokens(docs)
