"""Chat formatting, secret scans, packing, embeddings, LM scoring and the
quality classifier against brute force, round trips or held-out accuracy."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nightjar.llm import chat_format as chat
from nightjar.llm import embedding_dedup, ngram_lm, packing, quality, queries, secret_scan

# ---- chat

CONTROLS = st.lists(st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "\\", "<", "[", "s>", "INST]", "a", "\n", "é"]),
                    max_size=12).map("".join)


@settings(max_examples=200, deadline=None)
@given(CONTROLS)
def test_escape_is_reversible_and_hides_controls(text):
    hidden = chat.escape(text)
    assert chat.unescape(hidden) == text
    assert not re.search(r"</?s>|\[/?INST\]", hidden)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(CONTROLS, CONTROLS), max_size=5))
def test_windows_parse_back(turns):
    assert chat.parse("".join(chat.render(r, t)[0] for r, t in turns)) == turns


def conversation_rows():
    rows = [(1, 0, "system", "be <s> brief"), (1, 1, "user", "hi </s>"), (1, 2, "assistant", "[INST] hello [/INST]")]
    rows += [(2, t, "user" if t % 2 else "assistant", f"turn {t} " + "word " * (t % 7)) for t in range(600)]
    rows += [(2, -1, "system", "long rules " * 3)]
    rows += [(3, 0, None, None), (3, 1, "assistant", None), (3, 1, "assistant", None), (3, None, "user", "no turn"),
             (None, 5, "assistant", "lost"), (4, 0, "user", "x " * 900), (4, 1, "assistant", "short")]
    return rows


@pytest.fixture(scope="module")
def conversations(spark):
    return spark.createDataFrame(conversation_rows(), "conv_id long, turn long, role string, text string")


@pytest.mark.parametrize("budget,history", [(100, 30), (2048, 512), (60, 0), (5, 5)])
def test_chat_covers_every_turn_and_target_once(conversations, budget, history):
    out = chat.format_conversations(conversations.withColumn("block", F.lit("own")), queries.vocabulary("byte_bpe_50k.json"),
                                    budget, history, 3).collect()
    by = {}
    for w in sorted(out, key=lambda w: (w["conv_id"] is not None, w["conv_id"] or 0, w["block"], w["window"])):
        turns = chat.parse(w["text"])
        assert len(turns) == w["n_context"] + w["n_turns"]
        assert w["n_tokens"] <= budget or w["n_turns"] == 1
        said, targets, repeats = by.setdefault(w["conv_id"], ([], [], []))
        said += turns[w["n_context"]:]
        repeats.append(turns[:w["n_context"]])
        targets += [chat.unescape(w["text"][s["start"]:s["end"]]) for s in w["loss"]]
    rows = conversation_rows()
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == conv),
                      key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or ""))
        assert by[conv][0] == [(r[2] or "", r[3] or "") for r in mine]
        assert by[conv][1] == [r[3] or "" for r in mine if r[2] == "assistant"]
    later = by[2][2][1:]
    assert all(r and r[0] == ("system", "long rules " * 3) for r in later)
    assert any(len(r) > 1 for r in later) == (history > 5 and budget > 20)


def test_chat_query_and_empty_table(spark, sf, none):
    got = {r["conv_id"]: r for r in queries.op1_chat_formatting(spark, sf).collect()}
    assert got[-1]["n_turns"] == 2 and got[-1]["loss_chars"] == len("</s>[INST] ok [/INST]")
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_conversations(empty, queries.vocabulary("byte_bpe_50k.json")).count() == 0


# ---- secrets

def brute_secrets(text):
    out = [("assign", *m.span()) for m in secret_scan.ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    out += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    out += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 24]
    return sorted(out, key=lambda f: (f[1], ["assign", "access", "hex"].index(f[0])))


SECRETS = ["é token = \"" + "0af3" * 10 + "\" x", "PassWord:hunter22 api_key='abcdefgh'", "secret=token: abcdefgh",
           "secret=a token=abcdefgh", "AKIA" + "Z9" * 9 + " AKIAshort", "f" * 24 + " " + "f" * 23 + "g", "", None,
           "ſecret=longlong password", "token==abc token= 'abc.def-ghi=='", "x" * 50_000 + " secret: 1234567"]


def test_base_findings_match_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(SECRETS)] + [(0, SECRETS[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kind", F.lit("own"))
    for model in (None, secret_scan.train(docs)):
        got = secret_scan.scan(docs, model)
        assert set(got.columns) == {"doc_id", "text", "kind", "findings"}
        for r in got.collect():
            base = [(f["kind"], f["start"], f["end"]) for f in r["findings"] if f["kind"] != "model"]
            assert base == brute_secrets(r["text"] or "")
    assert secret_scan.scan(docs.limit(0), None).count() == 0
    assert secret_scan.train(docs.limit(0)) is None


def test_network_finds_held_out_secrets():
    """Trained on some secrets, it must find others without their keyword and leave prose and numbers alone."""
    rng = np.random.default_rng(4)
    pick = lambda chars, n: "".join(rng.choice(list(chars), n))
    prose = lambda: " ".join(pick("abcdefghijklmnopqrstuvwxyz", rng.integers(2, 9)) for _ in range(30))
    made = {True: [], False: []}
    for i in range(600):
        held = i % 3 == 0
        left, right = prose(), prose()
        token = pick("0123456789abcdef", 32)
        made[held].append((1, f"{left} " + ("" if held else "token = ") + f"{token} {right}", token))
        number = "4" + pick("0123456789", 15)
        made[held].append((0, f"{left} {number} {right}", number))
    x = {h: np.stack([secret_scan.view(t, t.index(s)) for _, t, s in rows]) for h, rows in made.items()}
    y = {h: np.array([a for a, _, _ in rows], float) for h, rows in made.items()}
    model = secret_scan.fit_on(x[False][y[False] == 1], x[False][y[False] == 0])
    found = model.scores(x[True]) >= model.threshold
    assert found[y[True] == 1].mean() > 0.9 and found[y[True] == 0].mean() < 0.05


def test_network_reads_candidates_to_their_end(spark):
    """A secret behind a long path is the same candidate's tail; numbers there are none."""
    rng = np.random.default_rng(5)
    pick = lambda chars, n: "".join(rng.choice(list(chars), n))
    path = lambda n: "/".join(pick("ghijklmnopqrstuvwxyz", 6) for _ in range(n)) + "/1/"
    rows = [f"see token = {pick('0123456789abcdef', 32)} and go on" for _ in range(400)]
    rows += [f"see {path(rng.integers(3, 40))} and go on" for _ in range(800)]
    model = secret_scan.train(spark.createDataFrame([(t,) for t in rows], "text string"))
    # 33 and more characters of a run that is no base finding, behind 70 to 280 others.
    odd = lambda: pick("0123456789abcdef", 22) + "-" + pick("0123456789abcdef", 22)
    made = [(i, f"see {path(10 + i)}{odd() if i < 30 else path(6)} and go on") for i in [*range(30), *range(30, 60)]]
    got = secret_scan.scan(spark.createDataFrame(made, "doc_id long, text string"), model).collect()
    hit = {r["doc_id"] for r in got if any(f["kind"] == "model" for f in r["findings"])}
    assert len(hit & set(range(30))) >= 27 and len(hit - set(range(30))) <= 3
    for s, e in ((0, 1), (7, 31), (3, 99), (0, 9_000)):
        starts = secret_scan.view_starts(s, e)
        assert starts[0] == s and starts[-1] + secret_scan.WIDTH - secret_scan.LEFT >= e + secret_scan.LEFT


def test_threshold_keeps_the_recall_even_below_one_half():
    """Positives like negatives score low; the threshold follows them."""
    rng = np.random.default_rng(6)
    x = rng.integers(0, secret_scan.N_CLASSES, (1000, secret_scan.WIDTH))
    y = (np.arange(1000) % 10 == 0).astype(float)
    model = secret_scan.CharCNN().calibrate(x, y)
    assert (model.scores(x)[y == 1] >= model.threshold).mean() >= secret_scan.RECALL
    assert model.threshold < 0.5 and model.recall >= secret_scan.RECALL and 0 < model.precision < 0.5


def test_training_takes_the_findings_of_all_documents(spark):
    """A sample of documents would miss the few findings of a large table."""
    texts = F.concat(F.lit("number "), F.col("id").cast("string"), F.lit(" and some words that are no secret at all"))
    few = F.when(F.col("id") % 40_000 == 7, F.concat(F.lit("token = "), F.sha1(F.col("id").cast("string"))))
    model = secret_scan.train(spark.range(0, 130_000, 1, 4).select(F.coalesce(few, texts).alias("text")))
    assert model is not None and model.recall >= secret_scan.RECALL


def test_training_sees_every_candidate(spark):
    """More findings and other candidates than a sample of some thousands holds; each is learned or held out."""
    texts = F.translate(F.sha2(F.col("id").cast("string"), 256), "0123456789abcdef", "zaZ A.hg(, B'gG?")
    secret = F.concat(F.lit("token = "), F.sha1(F.col("id").cast("string")), F.lit(" and on"))
    docs = spark.range(0, 9_000, 1, 5).select(F.when(F.col("id") < 2_500, secret).otherwise(texts).alias("text"))
    want = {row for r in docs.collect() for row in secret_scan.labelled_views(r["text"].encode())}
    model = secret_scan.train(docs.union(docs))
    assert model.seen == (2_500, len(want) - 2_500) and model.seen[1] > 6_000
    assert model.recall >= secret_scan.RECALL and model.precision > 0.95


def test_training_does_not_depend_on_partitions_or_learners(spark, monkeypatch):
    texts = F.concat(F.lit("see "), F.sha1(F.col("id").cast("string")), F.lit(" or number "), F.col("id").cast("string"), F.lit(" here"))
    docs = spark.range(0, 3_000, 1, 3).select(F.when(F.col("id") % 3 == 0, texts).otherwise(F.substring(texts, 48, 99)).alias("text"))
    first, again = secret_scan.train(docs), secret_scan.train(docs.repartition(7))
    assert (first.state() == again.state()).all() and first.threshold == again.threshold
    monkeypatch.setattr(secret_scan, "LEARNER", 500)
    many = secret_scan.train(docs)
    assert many.seen == first.seen and many.recall >= secret_scan.RECALL and abs(many.precision - first.precision) < 0.05


# ---- packing

@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_best_fit_is_best_fit_decreasing(sizes):
    bin_of, offset, fill = packing.best_fit(sizes, 64)
    left, want = [], 0
    for s in sorted(sizes, reverse=True):
        fits = [r for r in left if r >= s]
        if fits:
            left[left.index(min(fits))] -= s
        else:
            left.append(64 - s)
    assert len(fill) == len(left) and sorted(fill) == sorted(64 - r for r in left)
    for b in range(len(fill)):
        places = sorted((offset[i], sizes[i]) for i in range(len(sizes)) if bin_of[i] == b)
        assert [p[0] for p in places] == list(np.cumsum([0] + [p[1] for p in places])[:-1])


@pytest.mark.parametrize("capacity,parts,open_bins", [(2048, 3, 1024), (64, 20, 1024), (64, 20, 2)])
def test_packing_holds_every_token_once(docs, rows, capacity, parts, open_bins, monkeypatch):
    monkeypatch.setattr(packing, "OPEN_BINS", open_bins)
    path = queries.vocabulary("word_bpe_49k.json")
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(path)
    out = packing.pack(docs.repartition(parts).withColumn("node", F.lit("own")), path, capacity, with_ids=True)
    packed = out.collect()
    want = Counter()
    for doc_id, text, *_ in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), capacity)):
            want[doc_id, k, at, tuple(ids[at:at + capacity])] += 1
    got = Counter()
    sequences = {}
    for r in packed:
        ids = np.frombuffer(bytes(r["ids"]), "<u4")
        assert len(ids) == r["length"] and zlib.crc32(ids.tobytes()) == r["ids_crc32"]
        got[r["doc_id"], r["piece"], r["start"], tuple(ids.tolist())] += 1
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert got == want
    for places in sequences.values():
        places.sort()
        assert [p[0] for p in places] == list(np.cumsum([0] + [p[1] for p in places])[:-1])
        assert places[-1][0] + places[-1][1] <= capacity
    total = sum(r["length"] for r in packed)
    if open_bins > 2:
        assert len(sequences) <= 1.02 * math.ceil(total / capacity) + 1
    whole = {r["sequence_id"]: bytes(r["ids"]) for r in packing.sequences(out).collect()}
    assert sum(map(len, whole.values())) == 4 * total and set(whole) == set(sequences)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_best_fit_of_counts_equals_best_fit(sizes):
    ranges, made = packing.best_fit_counts(dict(Counter(sizes)), 64)
    assert made == len(packing.best_fit(sizes, 64)[2])
    ranks, bins = Counter(), {}
    for size, rank, n, first, each, offset in sorted(ranges):
        assert rank == ranks[size]
        ranks[size] += n
        for i in range(n):
            bins.setdefault(first + i // each, []).append((offset + i % each * size, size))
    assert ranks == Counter(sizes) and sorted(bins) == list(range(made))
    for places in bins.values():
        places.sort()
        assert [p[0] for p in places] == list(np.cumsum([0] + [p[1] for p in places])[:-1])
        assert places[-1][0] + places[-1][1] <= 64


@pytest.mark.parametrize("parts,open_bins", [(1, 1024), (1, 1), (3, 1)])
def test_packing_merges_every_chunk(spark, parts, open_bins, monkeypatch):
    """Chunks of one partition meet, too: 39 words and the end id with 23 and the end id."""
    monkeypatch.setattr(packing, "OPEN_BINS", open_bins)
    monkeypatch.setattr(packing, "CHUNK", 1)
    monkeypatch.setattr(packing, "slices", lambda b, c: (b.slice(i, 1) for i in range(b.num_rows)))
    docs = spark.createDataFrame([(i, "the " * (39 if i < 60 else 23)) for i in range(120)], "doc_id long, text string")
    out = packing.pack(docs.coalesce(1).repartition(parts), queries.vocabulary("word_bpe_49k.json"), 64).collect()
    assert {r["length"] for r in out} == {40, 24} and len(out) == 120
    assert len({r["sequence_id"] for r in out}) == 60


def test_packing_an_empty_table(none):
    assert packing.pack(none, queries.vocabulary("word_bpe_49k.json")).count() == 0


def test_word_encoder_equals_the_tokenizer():
    enc = packing.WordEncoder(queries.vocabulary("word_bpe_49k.json"))
    texts = ["don't DON'T 12a3 ###", "a \x01 b", "x\x01y", "<|endoftext|> A <|ENDOFTEXT|>", "É É \x1c z", "", " \n", "foo, foo. foo…, x’s."]
    for _ in range(2):
        for t, ids in zip(texts, enc.ids([t.encode() for t in texts])):
            assert np.frombuffer(ids, "<u4").tolist() == enc.tokenizer.encode(t, add_special_tokens=False).ids


# ---- embeddings

def embedding_rows(kind=float):
    rng = np.random.default_rng(0)
    vecs = rng.normal(size=(60, 16))
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(vecs)]
    rows += [(100 + i, (vecs[i % 5] + rng.normal(size=16) * 0.2).astype(np.float32).tolist()) for i in range(40)]
    rows += [(200 + i, rows[3][1]) for i in range(5)] + [(300, [2 * x for x in rows[3][1]]), (301, [-x for x in rows[3][1]])]
    rows += [(400, None), (401, [0.0] * 16), (402, [float("nan")] + [1.0] * 15), (403, [float("inf")] + [1.0] * 15),
             (404, [None] + [1.0] * 15), (405, []), (406, [1.0] * 8), (407, [1.0] * 8), (None, rows[0][1]), (3, rows[3][1])]
    return rows


@pytest.mark.parametrize("kind,block", [("float", 4096), ("double", 16), ("float", 7)])
def test_embeddings_match_brute_force(spark, kind, block):
    rows = embedding_rows()
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").withColumn("node", F.lit("own"))
    got = Counter(tuple(r) for r in embedding_dedup.near_duplicates(df, 0.9, block).collect())

    def usable(v):
        return bool(v) and None not in v and np.isfinite(v).all() and np.any(v)

    def cos(a, b):
        a, b = np.array(a, np.float64), np.array(b, np.float64)
        return a @ b / math.sqrt(a @ a) / math.sqrt(b @ b)

    n = len(rows)
    links = [[j for j in range(n) if j != i and usable(rows[i][1]) and usable(rows[j][1])
              and len(rows[i][1]) == len(rows[j][1]) and cos(rows[i][1], rows[j][1]) >= 0.9] for i in range(n)]
    want = Counter()
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        comp = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        want[rows[i][0], len(links[i]), comp, rows[i][0] == comp] += 1
    assert got == want


def test_quantisation_bounds_hold():
    rng = np.random.default_rng(3)
    a = embedding_dedup.Tile(rng.normal(size=(200, 24)))
    unit = a.x / a.norm[:, None]
    exact = unit @ unit.T
    near = (a.q.astype(np.float64) @ a.q.T) * np.outer(a.scale, a.scale)
    bound = np.outer(a.length, a.error) + np.outer(a.error, a.length) + np.outer(a.error, a.error)
    assert (np.abs(exact - near) <= bound + 1e-9).all()


def test_embeddings_empty_table(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embedding_dedup.near_duplicates(empty).count() == 0


# ---- language model

@pytest.mark.parametrize("chunk,bucket", [(2_000_000, 1_000_000), (300, 500)])
def test_lm_scores_match_brute_force(docs, rows, chunk, bucket, monkeypatch):
    """Counts, base score and the interpolated score with the learned weights."""
    monkeypatch.setattr(ngram_lm, "CHUNK_TOKENS", chunk)
    monkeypatch.setattr(ngram_lm, "BUCKET_ENTRIES", bucket)
    seen = {}
    learn = ngram_lm.learn_weights
    monkeypatch.setattr(ngram_lm, "learn_weights", lambda cells: seen.setdefault("w", learn(cells)))
    got = ngram_lm.score_texts(docs, F.col("doc_id") % 3 != 1).collect()
    tokens = lambda t: (t or "").encode().lower().split() + [None]
    words, pairs, starts = Counter(), Counter(), 0
    for r in rows:
        if r[0] is not None and r[0] % 3 != 1:
            w = tokens(r[1])
            words.update(w)
            pairs.update(zip(["start", *w[:-1]], w))
            starts += 1
    n, v = sum(words.values()), len(words)
    context = Counter(words)
    context["start"] = starts
    want = Counter()
    for r in rows:
        w = tokens(r[1])
        base = sum(math.log10((words[x] + 1) / (n + v + 1)) for x in w)
        score = 0.0
        for before, x in zip(["start", *w[:-1]], w):
            c = context[before]
            l0, l1, l2 = seen["w"][c.bit_length()]
            score += math.log10(l0 / (v + 1) + l1 * words[x] / n + (l2 * pairs[before, x] / c if c else 0))
        want[r[0], r[0] is not None and r[0] % 3 != 1, len(w), sum(words[x] > 0 for x in w), round(base, 6), round(score, 6)] += 1
    assert Counter((r["doc_id"], r["training"], r["n_tokens"], r["n_known"], round(r["base_score"], 6), round(r["score"], 6))
                   for r in got) == want
    assert {r["train_tokens"] for r in got} == {n}


def test_lm_weights_are_a_distribution_and_follow_the_data():
    cells = np.array([[5, 2040, 2140, 90], [5, 2040, -1, 10], [0, 2040, -1, 50]])
    w = ngram_lm.learn_weights(cells)
    assert np.allclose(w.sum(1), 1) and w[0, 2] == 0 and w[5, 2] > 0.8


def test_lm_beats_the_base_and_takes_empty_input(spark, sf, none, clashing):
    got = queries.op9_lm_scoring(spark, sf).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]
    assert ngram_lm.score_texts(none, F.lit(True)).count() == 0
    assert ngram_lm.score_texts(clashing, F.lit(False)).where("score IS NULL").count() == 0


# ---- quality

def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    scored = queries.op10_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    held = scored.where("held_out").select("predicted", "quality").collect()
    good = [r["predicted"] for r in held if r["quality"] == 1]
    bad = [r["predicted"] for r in held if r["quality"] == 0]
    assert np.mean(good) >= 0.97 and np.mean(bad) <= 0.1


def test_quality_edge_cases(spark, docs, clashing, rows, none):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(None, 1, 0), (3, None, 0)],
                                   "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels, F.coalesce(F.col("doc_id") % 5 != 0, F.lit(False)))
    got = quality.score(clashing, model)
    assert set(got.columns) == set(clashing.columns) and got.count() == len(rows)
    assert all(0 <= r["score"] <= 1 for r in got.collect())
    assert quality.score(none, model).count() == 0
    assert quality.train(docs, labels.where("quality = 0"), F.lit(True)) is None
    assert {r["score"] for r in quality.score(docs, None).collect()} == {0.5}


def test_non_negative_risk_learns_from_positives_and_unlabelled():
    rng = np.random.default_rng(6)
    x = np.zeros((1200, quality.N_FEATURES), dtype=np.float32)
    x[:, :8] = rng.normal(0, 0.1, (1200, 8))
    y = rng.random(1200) < 0.6
    x[y, 3] += 0.5
    pos, unl = x[:500][y[:500]], x[500:1000]
    model = quality.fit_nnpu(pos, unl, 0.6, epochs=30)
    assert ((quality.predict(x[1000:], model) >= 0.5) == y[1000:]).mean() > 0.95
