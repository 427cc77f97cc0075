"""Line dedup, decontamination, substring dedup and SimHash against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from nightjar.llm import decontaminate, line_dedup, simhash, substring_dedup

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWERED = str.maketrans(UPPER, UPPER.lower())


def as_bag(df, *cols):
    return Counter(tuple(r[c] for c in cols) for r in df.collect())


# ---- lines

def brute_lines(rows, min_docs, min_chars=1, keep="none"):
    def key(line):
        return re.sub(r"\A[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\Z", "", line).translate(LOWERED)

    seen, first = Counter(), {}
    for doc_id, text, *_ in rows:
        for i, line in enumerate((text or "").split("\n")):
            k, me = key(line), (doc_id is not None, doc_id or 0, i)
            first[k] = min(first.get(k, me), me)
        seen.update({key(line) for line in (text or "").split("\n")})
    out = Counter()
    for doc_id, text, *_ in rows:
        lines = (text or "").split("\n")
        gone = [len(key(x)) >= max(1, min_chars) and seen[key(x)] >= min_docs
                and not (keep == "first" and first[key(x)] == (doc_id is not None, doc_id or 0, i))
                for i, x in enumerate(lines)]
        out[doc_id, "\n".join(x for x, g in zip(lines, gone) if not g), len(lines), sum(gone)] += 1
    return out


@pytest.mark.parametrize("min_docs,min_chars,keep,broadcast", [
    (10, 1, "none", 500_000), (2, 1, "none", 500_000), (2, 8, "first", 500_000), (2, 1, "none", 0), (3, 1, "first", 0)])
def test_lines_match_brute_force(docs, rows, min_docs, min_chars, keep, broadcast):
    got = line_dedup.dedup_lines(docs, min_docs, min_chars, keep, max_broadcast_keys=broadcast)
    assert as_bag(got, "doc_id", "text", "n_lines", "n_dropped") == brute_lines(rows, min_docs, min_chars, keep)


def test_lines_keep_other_columns_and_empty_tables(clashing, docs, rows, none):
    got = line_dedup.dedup_lines(clashing, 10)
    assert set(clashing.columns) == set(got.columns)
    assert {r["component"] for r in got.select("component").distinct().collect()} == {"own"}
    assert as_bag(got, "doc_id", "text", "n_lines", "n_dropped") == brute_lines(rows, 10)
    assert line_dedup.dedup_lines(none, 10).count() == 0


def test_line_filters_miss_no_repeat():
    """Tiny filters suspect more, never less."""
    from nightjar.llm import repeat_filter as rf
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 63, (4000, 2)).astype(np.uint64)
    parts = [keys[:1500], keys[1000:3000], np.concatenate([keys[3000:], keys[3000:3100]])]
    bits = rf.MIN_BITS
    rows = sorted((r for p in parts for r in rf.mark(p, bits).to_pylist()), key=lambda r: r["segment"])
    import pyarrow as pa
    batch = pa.RecordBatch.from_pylist(rows, schema=pa.schema([("segment", pa.int32()), ("once", pa.binary()),
                                                               ("twice", pa.binary())]))
    packed = np.zeros(bits // 8, np.uint8)
    for out in rf.merge(iter([batch])):
        for r in out.to_pylist():
            at = r["segment"] * rf.SEGMENT_BITS // 8
            packed[at:at + rf.SEGMENT_BITS // 8] = np.frombuffer(r["bits"], np.uint8)
    hit = rf.suspected(packed.tobytes(), keys, bits)
    assert hit[1000:1500].all() and hit[3000:3100].all()
    assert not hit.all()


# ---- benchmark

def brute_benchmark(rows, items, window):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: pattern.findall((t or "").translate(LOWERED))
    windows = defaultdict(set)
    for item_id, text in items:
        w = split(text)
        m = min(window, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            windows[tuple(w[i:i + m])].add("" if item_id is None else str(item_id))
    sizes = {len(k) for k in windows}
    out = Counter()
    for doc_id, text, *_ in rows:
        w, hit, found = split(text), set(), set()
        for m in sizes:
            for i in range(len(w) - m + 1):
                if own := windows.get(tuple(w[i:i + m])):
                    found |= own
                    hit |= set(range(i, i + m))
        out[doc_id, len(w), len(hit), ",".join(sorted(found))] += 1
    return out


def benchmark_items(rows):
    long = rows[-5][1].split()
    return [(1, " ".join(long[100:130])), (2, " ".join(long[120:131]).upper() + "!!"), (2, "one"), (10, "Two, words"),
            (3, None), (4, ""), (None, "straße Ωmega"), (5, rows[0][1]), (6, "no such words anywhere here at all I think so")]


@pytest.mark.parametrize("window,block_bytes", [(10, 1 << 24), (4, 1 << 24), (10, 300), (1, 200)])
def test_benchmark_matches_brute_force(spark, docs, rows, window, block_bytes):
    items = benchmark_items(rows)
    table = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.search_benchmark(docs, table, window, block_bytes)
    bag = Counter((r["doc_id"], r["n_words"], r["n_hit"], ",".join(r["item_ids"])) for r in got.collect())
    assert bag == brute_benchmark(rows, items, window)


def test_benchmark_empty_tables_and_clashes(spark, docs, clashing, rows, none):
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.search_benchmark(docs, items).where("n_hit > 0").count() == 0
    assert decontaminate.search_benchmark(none, items).count() == 0
    got = decontaminate.search_benchmark(clashing, items)
    assert set(got.columns) == set(clashing.columns)
    assert {r[0] for r in got.select("anchor").distinct().collect()} == {"own"}


def test_wu_manber_finds_what_scanning_finds():
    rng = np.random.default_rng(8)
    stream = rng.integers(0, 4, 5000).astype(np.int32)
    for m in (1, 2, 3, 7):
        patterns = np.unique(rng.integers(1, 4, (12, m)).astype(np.int32), axis=0)
        start, which = decontaminate.WuManber(patterns).search(stream)
        want = {(i, p) for i in range(len(stream) - m + 1) for p in range(len(patterns))
                if (stream[i:i + m] == patterns[p]).all()}
        assert set(zip(start.tolist(), which.tolist())) == want


# ---- substrings

def brute_substrings(rows, window):
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    count = Counter()
    for _, text, *_ in rows:
        w = split(text)
        count.update(tuple(w[i:i + window]) for i in range(len(w) - window + 1))
    out = Counter()
    for doc_id, text, *_ in rows:
        w, gone = split(text), set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i:i + window])] > 1:
                gone |= set(range(i, i + window))
        out[doc_id, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)] += 1
    return out


@pytest.mark.parametrize("window,hot,shard", [(35, 20_000, 700_000), (12, 20_000, 400), (5, 3, 50), (2, 2, 100)])
def test_substrings_match_brute_force(docs, rows, window, hot, shard, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", shard)
    got = substring_dedup.dedup_substrings(docs, window, hot_pieces=hot)
    assert as_bag(got, "doc_id", "n_words", "n_removed", "text") == brute_substrings(rows, window)


def test_substrings_within_one_document(spark):
    text = " ".join([f"w{i}" for i in range(40)] * 2 + ["end"])
    rows = [(1, text), (2, " ".join(f"v{i}" for i in range(50)))]
    got = substring_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"), 35)
    assert as_bag(got, "doc_id", "n_words", "n_removed", "text") == brute_substrings(rows, 35)


def test_substrings_empty_and_clashes(clashing, rows, none):
    assert substring_dedup.dedup_substrings(none).count() == 0
    got = substring_dedup.dedup_substrings(clashing)
    assert set(got.columns) == set(clashing.columns)
    assert as_bag(got, "doc_id", "n_words", "n_removed", "text") == brute_substrings(rows, 35)


# ---- SimHash

def brute_point(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWERED))
    shingles = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(rows, k, distance):
    points = [brute_point(r[1], k) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (points[i] ^ points[j]).bit_count() <= distance and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    ids = defaultdict(list)
    for r, g in zip(rows, group):
        ids[g].append(r[0])
    low = {g: min((x for x in v if x is not None), default=None) for g, v in ids.items()}
    return Counter((r[0], p, low[g]) for r, p, g in zip(rows, points, group)), len(set(group))


@pytest.mark.parametrize("distance", [0, 1, 2])
def test_simhash_matches_brute_force(docs, rows, distance):
    got = simhash.near_duplicates(docs, 3, distance).collect()
    bag = Counter((r["doc_id"], r["point"] % (1 << 64), r["component_id"]) for r in got)
    want, groups = brute_components(rows, 3, distance)
    assert bag == want
    kept = simhash.keep_one_each(docs, 3, distance).collect()
    assert len(kept) == groups


def test_every_close_pair_meets_at_a_home():
    rng = np.random.default_rng(2)
    points = rng.integers(0, 1 << 63, 300, dtype=np.int64).astype(np.uint64) * np.uint64(2) + rng.integers(0, 2, 300).astype(np.uint64)
    flips = [[], [3], [60], [0, 22], [5, 30], [45, 46], [63, 62], [23, 24]]
    for f in flips:
        other = points ^ np.uint64(sum(1 << b for b in f))
        homes = simhash.home_anchors(points)
        own = simhash.home_anchors(other)
        row, anchor = simhash.replica_anchors(other, 2)
        reach = [set() for _ in points]
        for r, a in zip(row.tolist(), anchor.tolist()):
            reach[r].add(a)
        assert all(h == o or h in s for h, o, s in zip(homes.tolist(), own.tolist(), reach))


@pytest.mark.parametrize("homes", [4, 2_048])
def test_crowded_anchors_are_split_without_loss(spark, homes, monkeypatch):
    """A dense cloud around one point: all in one component, whatever the split."""
    monkeypatch.setattr(simhash, "MAX_HOMES", homes)
    base = 0x0123456789ABCDEF
    cloud = [base ^ (1 << i) for i in range(46, 64)] + [base ^ (1 << i) ^ (1 << j) for i in range(46, 52) for j in range(52, 64)]
    far = [base ^ ((1 << 40) - 1), 0]
    df = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in cloud + far], "point long")
    from nightjar.functions.components import connected_components
    links = simhash.links_between(df, 2)
    got = connected_components(links).collect()
    assert len(got) == len(cloud) and len({r["component"] for r in got}) == 1


def test_simhash_empty_and_clashes(clashing, docs, none):
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.keep_one_each(none).count() == 0
    got = simhash.keep_one_each(clashing, 3, 2)
    assert set(got.columns) == set(clashing.columns)
    assert got.count() == simhash.keep_one_each(docs, 3, 2).count()


def test_fingerprint_counts_beyond_a_byte():
    text = ("x y z " * 400 + "a b c d").encode()
    assert int(simhash.fingerprints([text], 3)[0]) == brute_point(text.decode(), 3)
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


def test_one_id_on_unlike_texts_keeps_one_row_per_group(spark):
    """Groups are told apart by their fingerprints, not by the smallest id."""
    rng = random.Random(8)
    a, b, c = ([rng.choice(["ab", "cd", "ef", "gh", "ij"]) + str(rng.randrange(99)) for _ in range(4000)] for _ in range(3))

    def near(words, other):
        """Another text with a fingerprint one or two bits away."""
        point = int(simhash.fingerprints([" ".join(words).encode()], 3)[0])
        for i in range(len(words)):
            text = " ".join([*words[:i], other, *words[i + 1:]])
            if 0 < (point ^ int(simhash.fingerprints([text.encode()], 3)[0])).bit_count() <= 2:
                return text
        raise AssertionError("no near text")

    a, b1, c1, b2, c2 = " ".join(a), " ".join(b), " ".join(c), near(b, "x"), near(c, "y")
    rows = [(5, a), (5, b1), (9, b2), (None, c1), (None, c2), (None, c2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    kept = [tuple(r) for r in simhash.keep_one_each(docs, 3, 2).collect()]
    assert len(kept) == 3 and {(5, a), (5, b1)} < set(kept) and {t for i, t in kept if i is None} <= {c1, c2}
