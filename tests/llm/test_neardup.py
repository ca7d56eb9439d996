import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from presswell.llm.components import connected_components
from presswell.llm.hashforest import BITS, DEPTH, HashForest, batch_duplicates, batch_links, recall, signature_nodes, similar_classes
from presswell.llm.neardup import TIERS, _buckets, _postings, frequent_tokens, near_duplicate_groups, near_duplicate_links, parity_bitmaps, prefix_keys, profiles
from presswell.llm.shingles import WORD, shingle_batch, similarity


def shingles(text, width):
    w = WORD.findall((text or "").lower())
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def alike(a, b, width):
    x, y = shingles(a, width), shingles(b, width)
    return len(x & y) / len(x | y) if x and y else 0.0


def corpus(seed, families, size, edits):
    """(id, text): families of variants with words changed, dropped and moved, sharing many common phrases."""
    rng = random.Random(seed)
    common = [f"c{i}" for i in range(12)]
    out = []
    for f in range(families):
        base = [rng.choice(common) if rng.random() < 0.4 else f"w{rng.randrange(400)}" for _ in range(rng.choice((8, 30, 90, 260)))]
        for _ in range(rng.randint(1, size)):
            words = list(base)
            for _ in range(int(len(words) * edits * rng.random())):
                k = rng.randrange(len(words))
                if rng.random() < 0.5:
                    words[k] = f"e{rng.randrange(50)}"
                else:
                    words.insert(k, words.pop(rng.randrange(len(words))))
            out.append((len(out) + 1, " ".join(words)))
    return out


def groups_by_force(docs, threshold, width):
    parent = {d: d for d, _ in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(docs):
        for b, t in docs[i + 1 :]:
            if alike(s, t, width) >= threshold:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    roots = {d: find(d) for d, _ in docs}
    return {(r, d) for d, r in roots.items() if r != d}


@pytest.mark.parametrize("threshold,width,small,most", [(0.6, 3, 16, 1 << 20), (0.6, 3, 2, 64), (0.8, 5, 16, 1 << 20), (0.5, 2, 3, 1 << 20)])
def test_groups_equal_all_pairs(spark, threshold, width, small, most):
    docs = corpus(11, 40, 7, 0.25) + [(900, "a b c d e"), (901, "a b c d e"), (902, "A, b; c d E")]
    df = spark.createDataFrame(docs, "doc long, text string")
    got = {(r.group_id, r.doc) for r in near_duplicate_groups(df, threshold, width, small=small, most=most).collect() if r.group_id != r.doc}
    assert got == groups_by_force(docs, threshold, width)


def test_a_third_of_all_texts_in_one_family(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    docs = []
    for i in range(240):
        words = list(base) if i % 3 == 0 else [f"o{rng.randrange(3000)}" for _ in range(60)]
        words[rng.randrange(60)] = f"z{i}"
        docs.append((i, " ".join(words)))
    got = near_duplicate_groups(spark.createDataFrame(docs, "doc long, text string"), 0.6, 3, small=4).collect()
    assert {r.doc for r in got} == set(range(0, 240, 3)) and {r.group_id for r in got} == {0}


def test_a_bucket_hot_in_one_chunk_meets_the_other_chunks(spark):
    docs = [(i, " ".join([f"w{k}" for k in range(20)] + [f"o{i}x{k}" for k in range(13)])) for i in range(60)]
    whole = profiles(spark.createDataFrame(docs, "doc long, text string"), 1).withColumn("part", F.expr("doc >= 50")).repartitionByRange(2, "part")
    listed = spark.sparkContext.broadcast(frequent_tokens(whole, 1, 1 << 20, 64))
    postings = _postings(whole, 1, 0.6, 4, 16, 64, listed)
    texts = defaultdict(set)
    for r in postings.collect():
        texts[r.key].add(r.doc)
    links, members = set(), defaultdict(set)
    for r in _buckets(postings, 0.6, 16, 4).collect():
        members[r.key].add(r.b) if r.kind else links.add(frozenset((r.a, r.b)))
    assert {r.doc for r in postings.collect() if r.leader >= 0} == set(range(1, 50))
    for key, found in texts.items():
        for a in found:
            for b in found:
                assert a == b or {a, b} <= members[key] or frozenset((a, b)) in links


def test_odd_texts_repeats_and_clashing_columns(spark, nasty):
    rows = [(i, t, 1, "x") for i, t in enumerate(nasty)] + [(100 + i, t, 2, None) for i, t in enumerate(nasty)] + [(None, "two words", 1, "")]
    df = spark.createDataFrame(rows, "doc long, text string, key int, component string")
    got = {(r.group_id, r.doc) for r in near_duplicate_groups(df, 0.8, 2).collect()}
    want = {(i, d) for i, t in enumerate(nasty) if len(shingles(t, 2)) for d in (i, 100 + i)}
    assert got == want
    assert near_duplicate_groups(df.limit(0), 0.8, 2).count() == 0
    links, copies, _ = near_duplicate_links(df.where("doc = 1"))
    assert links.count() == 0 and copies.count() == 0


def test_prefixes_share_a_key():
    rng = np.random.default_rng(1)
    for n in (2, 5, 9, 20, 40, 100, 200, 700):
        for _ in range(10):
            x = np.unique(rng.integers(0, 1 << 60, n, dtype=np.uint64))
            keep = int(np.ceil(len(x) * 0.8))
            y = np.unique(np.concatenate((x[:keep], rng.integers(0, 1 << 60, (len(x) - keep) // 2, dtype=np.uint64))))
            if similarity(x, y) < 0.6:
                continue
            tokens = np.concatenate((x, y))
            level = np.where(tokens % np.uint64(3) == 0, 3, 9).astype(np.uint8)
            owner, key = prefix_keys(np.array([0, len(x), len(x) + len(y)]), tokens, level, True, 0.6, 4)
            assert set(key[owner == 0]) & set(key[owner == 1])
    assert all(least > larger for (least, _), (larger, _) in zip(TIERS, TIERS[1:]))


def test_a_partly_listed_vocabulary_loses_no_contained_text():
    rng = np.random.default_rng(4)
    for n, inner in ((200, 121), (1000, 605), (40, 25), (9, 6)):
        for share in (0.0, 0.03, 0.3, 1.0):
            for _ in range(10):
                x = np.unique(rng.integers(0, 1 << 60, n, dtype=np.uint64))
                y = np.sort(rng.choice(x, inner, replace=False))
                shared = {int(t): 0 if rng.random() < share else 4 for t in y}  # texts that share them: two, not all of it listed
                level = np.array([shared.get(int(t), 0) for t in np.concatenate((x, y))], np.uint8)
                owner, key = prefix_keys(np.array([0, n, n + inner]), np.concatenate((x, y)), level, False, 0.6, 4)
                assert similarity(x, y) >= 0.6 and set(key[owner == 0]) & set(key[owner == 1])


def test_keys_grow_with_the_text():
    x = np.unique(np.random.default_rng(2).integers(0, 1 << 60, 200_000, dtype=np.uint64))
    owner, _ = prefix_keys(np.array([0, len(x)]), x, np.full(len(x), 9, np.uint8), True, 0.6, 4)
    assert len(owner) < 6 * len(x)


def test_bitmaps_bound_the_difference():
    texts = [t for _, t in corpus(3, 20, 3, 0.3)]
    offsets, tokens = shingle_batch(texts, 3)
    bits = np.array(parity_bitmaps(offsets, tokens)).T
    for i in range(len(texts)):
        for j in range(i):
            a, b = set(tokens[offsets[i] : offsets[i + 1]]), set(tokens[offsets[j] : offsets[j + 1]])
            assert sum(int(x).bit_count() for x in bits[i] ^ bits[j]) <= len(a ^ b)


def test_shingles_equal_plain_code(nasty):
    texts = [t for t in nasty if t is None or len(t) < 1000] + ["A b a b A b c", "Ä-b_c ½x"]
    offsets, tokens = shingle_batch(texts, 3)
    assert [int(x) for x in np.diff(offsets)] == [len(shingles(t, 3)) for t in texts]
    one, two = shingle_batch(["x y z q"], 3)[1], shingle_batch(["Z y x", "x Y z Q"], 3)
    assert set(one) == set(two[1][two[0][1] :])


def test_components(spark):
    rng = random.Random(8)
    links = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 140)] + [(5, 5), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_batches_against_all_before(spark):
    docs = corpus(21, 30, 5, 0.2)
    rng = random.Random(1)
    rng.shuffle(docs)
    docs = [(i + 1, t) for i, (_, t) in enumerate(docs)]
    cut = len(docs) // 2
    history = spark.createDataFrame(docs[:cut], "doc long, text string")
    incoming = [(1 + k % 3, d, t) for k, (d, t) in enumerate(docs[cut:])]
    incoming += [incoming[0], (3, *incoming[0][1:]), (None, 7000, docs[0][1]), (1, None, docs[0][1]), (2, 7001, None), (2, 7002, "")]
    got = {(r.id_a, r.id_b) for r in batch_duplicates(history, spark.createDataFrame(incoming, "batch_no int, doc long, text string"), 0.6, 3).collect()}
    new = {(d, t) for _, d, t in incoming if d is not None}
    every = set(docs[:cut]) | new
    want = {(a, b) for b, t in new for a, s in every if a < b and alike(s, t, 3) >= 0.6}
    assert got == want and want


def test_links_and_classes(spark):
    history = spark.createDataFrame([(1, "a b c d e f g h"), (2, "a b c d e f g h i"), (3, "q r s t u v")], "doc long, text string")
    batch = spark.createDataFrame([(1, 10, "A b c d e f g h"), (1, 11, "a b c d e f g h i j"), (2, 12, "z y x w v u")], "batch_no int, doc long, text string")
    got = {r.doc: (r.class_id, r.links) for r in batch_links(history, batch, 0.6, 3).collect()}
    assert {d: n for d, (_, n) in got.items()} == {10: 2, 11: 2, 12: 0} and len({c for c, _ in got.values()}) == 3


def few_words(n, first=0):
    return [(i, " ".join(f"w{(i * 7 + k) % 90}" for k in range(40))) for i in range(first, first + n)]


def test_forest_runs_merge_and_widen(spark, tmp_path):
    docs = few_words(30)
    forest = HashForest(spark, f"file://{tmp_path}/f", trees=20, threshold=0.6, width=3, fanout=2, file_rows=50)
    frame = lambda rows: spark.createDataFrame(rows, "doc long, text string")
    for k in range(4):
        forest.add(frame([d for d in docs if d[0] % 4 == k]), batch=k, find=False)
    assert forest.add(frame(docs[:0])).found.count() == 0
    runs = forest.log.latest()[1]["nodes"]
    assert sum(n for _, n in runs) == 30 * 20 and len(runs) <= 4
    assert recall(DEPTH - forest.shift // BITS, 20, 0.6) >= 0.9999 or forest.shift == BITS * (DEPTH - 1)
    taken = forest.add(frame(docs), batch=3)  # a number that is taken: looked up, not written
    assert forest.log.latest()[1]["nodes"] == runs
    found = {(r.a, r.b) for r in taken.found.collect()}
    hashes = {r.doc: r.set_hash for r in taken.members.collect()}
    for i, s in docs:
        for j, t in docs:
            if i < j and alike(s, t, 3) >= 0.6:
                assert tuple(sorted((hashes[i], hashes[j]))) in found
    offsets, tokens = shingle_batch([docs[0][1]], 3)
    nodes = signature_nodes(offsets, tokens, 3)
    assert nodes.shape == (3, 1) and (nodes[:, 0] >> np.uint64(56)).tolist() == [0, 1, 2]
    with pytest.raises(ValueError):
        HashForest(spark, f"{tmp_path}/g", trees=128)


def test_what_is_opened_grows_with_the_batch(spark, tmp_path):
    rng = random.Random(5)
    docs = [(i, " ".join(str(rng.random()) for _ in range(12))) for i in range(400)]
    frame = lambda rows: spark.createDataFrame(rows, "doc long, text string")
    forest = HashForest(spark, str(tmp_path / "f"), trees=10, file_rows=40)
    forest.add(frame(docs), find=False)
    opened = []
    for rows in (docs[:1], docs[:40]):
        before = forest.rows_opened
        assert forest.add(frame([(1000 + d, t) for d, t in rows])).found.count() == 0
        opened.append(forest.rows_opened - before)
    assert opened[0] <= 0.25 * 10 * 400 and opened[1] > 2 * opened[0]


def test_a_second_process_opens_the_forest(spark, tmp_path):
    import subprocess
    import sys

    docs = few_words(12)
    forest = HashForest(spark, str(tmp_path / "f"), trees=30, threshold=0.6, width=3)
    forest.add(spark.createDataFrame(docs, "doc long, text string"), batch=1, find=False)
    code = f"""
from presswell.llm.hashforest import HashForest, batch_duplicates
from presswell.session import build_session
spark = build_session("local[2]", 2, "1g")
assert HashForest(spark, {str(tmp_path / "f")!r}).options["trees"] == 30
new = spark.createDataFrame([(1, 100, {docs[3][1]!r} + " more"), (1, 101, "nothing like it at all")], "batch_no int, doc long, text string")
none = spark.createDataFrame([], "doc long, text string")
print("PAIRS", sorted(tuple(r) for r in batch_duplicates(none, new, path={str(tmp_path / "f")!r}).collect()))
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    want = [(d, 100) for d, t in docs if alike(t, docs[3][1] + " more", 3) >= 0.6]
    assert f"PAIRS {want}" in out.stdout, out.stderr[-2000:]
    assert [n for _, n in HashForest(spark, str(tmp_path / "f")).log.latest()[1]["members"]] == [12, 2]


def test_a_writer_that_dies_leaves_the_forest_as_it_was(spark, tmp_path, monkeypatch):
    forest = HashForest(spark, str(tmp_path / "f"), trees=5)
    forest.add(spark.createDataFrame(few_words(3), "doc long, text string"), find=False)
    before = forest.log.latest()
    monkeypatch.setattr(forest.log, "publish", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        forest.add(spark.createDataFrame(few_words(3, 50), "doc long, text string"))
    assert HashForest(spark, str(tmp_path / "f")).log.latest() == before
    classes = similar_classes(HashForest(spark, str(tmp_path / "f")), spark.createDataFrame([(1, 2)], "a long, b long"))
    assert classes.count() == 0


def test_batches_of_nothing(spark):
    none = spark.createDataFrame([], "doc long, text string")
    empty = spark.createDataFrame([], "batch_no int, doc long, text string")
    one = spark.createDataFrame([(1, 5, "a b c d e f")], "batch_no int, doc long, text string")
    assert batch_duplicates(none, empty).count() == 0
    assert batch_duplicates(none, one).count() == 0
    assert [tuple(r) for r in batch_duplicates(spark.createDataFrame([(2, "A b c, d e f")], "doc long, text string"), one).collect()] == [(2, 5)]
