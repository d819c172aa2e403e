"""Each operator against brute force, round trips or held-out rows, with nulls, empty and long texts, repeats and odd columns."""

import hashlib
import re
import struct
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from hyperloom.llm import chat, decontam, langid, lm, media, mixing, nearcopies, pii, simhash, tokencount, toxicity, webp

BASE = " ".join(f"word{i} and then" for i in range(40))
ROWS = [
    (1, BASE, "en", "b"), (2, BASE, "en", "b"), (3, BASE + " tail", "en", None), (4, None, None, "a"), (5, "", "de", "a"), (6, "short", "de", "c"),
    (7, "Ünder " * 3000 + "end", "de", "a"), (8, "x" * 5000, None, "b"), (8, "x" * 5000, None, "b"), (None, "no id at all here", "fr", "b"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    # columns that clash with names the operators make
    return spark.createDataFrame(ROWS, SCHEMA).withColumn("fp", F.lit("mine")).withColumn("size", F.lit(0)).withColumn("key", F.lit("k"))


def brute_fingerprint(text, k=4):
    w = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash_fingerprints_and_components(spark, docs):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(ROWS)
    want = {(i, f"{brute_fingerprint(t):016x}") for i, t, *_ in ROWS}
    assert {(r.doc_id, r.fingerprint) for r in got} == want
    of = {r.doc_id: r.component_id for r in got}
    assert of[1] == of[2] == 1 and of[4] == of[5] == 4


@pytest.mark.parametrize("most, share", [(1 << 18, 1024), (20, 1 << 40), (20, 1)])  # in memory; found to be too large; known to be too large
def test_simhash_links_equal_brute_force(spark, most, share):
    rng = np.random.default_rng(1)
    seeds = rng.integers(0, 1 << 63, 60)
    fps = []
    for s in seeds:
        for _ in range(40 if s == seeds[0] else 3):  # one crowded group
            fps.append(int(s) ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 5), replace=False)))
    fps = sorted(set(fps))
    found = simhash.link(spark.createDataFrame([(f,) for f in fps], "fp long"), 4, most_per_key=8, most_direct=most, share=share)
    got = {r.node: r.component for r in simhash.components(found).collect()}
    assert all(got.get(f, f) == fps[c] for f, c in zip(fps, grouped(len(fps), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)))


def grouped(n, linked):
    """Smallest member of the component of each of n things."""
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("most_flips", [2, 6, 30])
def test_forest_joins_what_lies_within_tau(most_flips):
    rng = np.random.default_rng(most_flips)
    fp = np.unique([0x123456789ABCDEF ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, most_flips + 1), replace=False)) for _ in range(300)]).astype(np.uint64)
    a, b = simhash.forest(fp, 4, most_cells=2000)
    assert (np.bitwise_count(a ^ b) <= 4).all()
    links = set(zip(a.tolist(), b.tolist()))
    want = grouped(len(fp), lambda i, j: int(fp[i] ^ fp[j]).bit_count() <= 4)
    got = grouped(len(fp), lambda i, j: (int(fp[i]), int(fp[j])) in links or (int(fp[j]), int(fp[i])) in links)
    assert got == want and len(a) == len(fp) - len(set(want))


def test_simhash_large_group_of_near_copies(spark):
    rng = np.random.default_rng(7)
    fps = {0x0F0F0F0F12345678 ^ sum(1 << int(b) for b in rng.choice(62, rng.integers(1, 5), replace=False)) for _ in range(5000)}
    links = simhash.link(spark.createDataFrame([(f,) for f in fps], "fp long"))
    assert links.count() < 30 * len(fps) and {r.component for r in simhash.components(links).collect()} == {min(fps)}


def test_simhash_links_through_rows_without_id(spark):
    words = [f"w{i}" for i in range(400)]
    rows, fps = [], []
    for n in range(0, 60):
        t = " ".join(words[:200] + [f"z{i}" for i in range(n)] + words[200 + n :])
        rows.append(t)
        fps.append(brute_fingerprint(t))
    docs = [(None if i % 3 else i, t) for i, t in enumerate(rows)] + [(0, "another text of this id")]
    got = simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    of = {}
    for i, c in enumerate(grouped(len(fps), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)):
        of.setdefault(c, []).append(i)
    want = {}
    for members in of.values():
        low = min((i for i in members if i % 3 == 0), default=None)
        want |= {(None if i % 3 else i, f"{fps[i]:016x}"): low for i in members}
    want[0, f"{brute_fingerprint('another text of this id'):016x}"] = 0
    assert {(r.doc_id, r.fingerprint): r.component_id for r in got} == want and len(got) == len(docs)
    assert simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").limit(0)).count() == 0


def test_thresholds_meet_the_pigeonhole_bound():
    both = np.full((64, 64), 250.0)
    np.fill_diagonal(both, 500)
    for m in range(1, 6):
        groups = simhash.group_bits(both, 1000, m)
        assert sorted(b for g in groups for b in g) == list(range(64))
        cost, ts = simhash.allocate(groups, both, 1000, 4)
        assert not ts or sum(t + 1 for t in ts) == 5


def _near(rng, words, n_changed):
    """A text with n_changed words far apart replaced."""
    words = list(words)
    for i in range(n_changed):
        words[10 + 20 * i] = f"new{rng.integers(1 << 40)}"
    return words


@pytest.mark.parametrize("block", [4096, 3])  # 3: the large group is compared by blocks
def test_near_copies_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(nearcopies, "BLOCK", block)
    rng = np.random.default_rng(4)
    rows = []
    for g in range(8):
        base = [f"w{x}" for x in rng.integers(0, 5000, 200)]
        rows += [" ".join(_near(rng, base, int(c))) for c in rng.integers(0, 7, 12 if g == 0 else 4)]
        rows.append(" ".join(base[: int(rng.integers(150, 200))]))
    rows += ["one two", "one two", "", None, "one two three"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    sets = [frozenset(simhash.shingle_hashes(t, 5).tolist()) for t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    between = 0
    for i in range(len(rows)):
        for j in range(i):
            both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if 5 * both >= 4 * either:
                between += either > 0 and both < 0.95 * either
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    assert between > 10
    got = {r.doc_id for r in nearcopies.deduplicate(docs).collect()}
    assert got == {i for i in range(len(rows)) if find(i) == i}


def test_near_copies_are_found_by_simhash(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = []
    for _ in range(12):
        base = [f"w{x}" for x in rng.integers(0, 5000, 400)]
        rows += [" ".join(base), " ".join(base[:-1]), " ".join([*base, "more"]), " ".join(base[:330])]
    rows += ["", None, "one two"]
    sets = [nearcopies.shingle_set(t, 5) for t in rows]
    fps = simhash.fingerprints_of(sets)
    assert [int(x) for x in fps] == [sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in s) > len(s)) for s in sets]
    alike = lambda i, j: 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))
    by_simhash = grouped(len(rows), lambda i, j: int(fps[i] ^ fps[j]).bit_count() <= nearcopies.TAU and alike(i, j))
    every = grouped(len(rows), alike)
    assert len(set(every)) < len(set(by_simhash)) < len(rows) - 15  # the fingerprints find many pairs, and not all
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in nearcopies.deduplicate(docs).collect()} == set(every)
    monkeypatch.setattr(nearcopies, "_prefixes", lambda *_: lambda batches: (pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 3, names=["key", "node", "n"]) for _ in batches))
    assert {r.doc_id for r in nearcopies.deduplicate(docs).collect()} == set(by_simhash)
    assert nearcopies.deduplicate(docs.limit(0)).count() == 0


def _tasks(spark, name, run):
    """What run() returns, and how many tasks its jobs took."""
    context = spark.sparkContext
    context.setJobGroup(name, name)
    held = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.coalescePartitions.enabled",)}
    try:
        for c in held:
            spark.conf.set(c, "false")
        out = run()
    finally:
        for c, v in held.items():
            spark.conf.set(c, v)
        for c in ("spark.jobGroup.id", "spark.job.description"):
            context.setLocalProperty(c, None)
    told = context.statusTracker()
    stages = {s for j in told.getJobIdsForGroup(name) for s in told.getJobInfo(j).stageIds}
    return out, sum(i.numCompletedTasks for i in map(told.getStageInfo, stages) if i)


def test_near_copies_take_few_tasks_for_few_links(spark):
    """Each task leaves files and log lines: with many partitions the rounds of a few links took more disk than the documents."""
    rng = np.random.default_rng(8)
    rows = []
    for _ in range(6):
        base = [f"w{x}" for x in rng.integers(0, 5000, 200)]
        rows += [" ".join(_near(rng, base, c)) for c in (0, 1, 2, 5, 6, 7)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    got, tasks = _tasks(spark, "near copies", lambda: {r.doc_id for r in nearcopies.deduplicate(docs).collect()})
    sets = [nearcopies.shingle_set(t, 5) for t in rows]
    assert got == set(grouped(len(rows), lambda i, j: 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))))
    assert tasks < 1500  # 1,808 in rounds, 1,219 in one task each


@pytest.mark.parametrize("form", ["random", "path", "star", "none"])
def test_components_in_one_task_and_in_rounds(spark, form):
    rng = np.random.default_rng(9)
    deal = {"random": lambda: rng.integers(-200, 200, (170, 2)), "path": lambda: np.stack([x := rng.permutation(40) - 7, np.roll(x, 1)], 1)[1:], "star": lambda: np.stack([np.full(50, 99), np.arange(50)], 1), "none": lambda: np.zeros((1, 2), int)}
    links = deal[form]().tolist()
    links += [x[::-1] for x in links[::3]] + [[5, 5]]
    parent = {x: x for link in links for x in link}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    table = spark.createDataFrame(links, "a long, b long").repartition(3)
    want = {(x, find(x)) for x in parent if find(x) != x}
    n = len({(min(x), max(x)) for x in links if x[0] != x[1]})
    for most in (max(n, 1), max(n - 1, 0)):  # as many as one task takes, and one more
        found = simhash.components(table, most_direct=most).collect()
        assert len(found) == len(want) and {(r.node, r.component) for r in found} == want


def test_shortened_sets_have_no_less_in_common():
    rng = np.random.default_rng(6)
    for _ in range(200):
        pool = (rng.integers(0, 40, 60).astype(np.uint64) << np.uint64(48)) + rng.integers(0, 1000, 60).astype(np.uint64)
        x, y = (np.unique(rng.choice(pool, 30)) for _ in "ab")
        short = [nearcopies._shortened(v, 2) for v in (x, y)]
        assert all(len(np.unique(v)) == len(w) for v, w in zip(short, (x, y)))
        count = lambda v, c: (v >> np.uint64(48) == c).sum()
        assert len(np.intersect1d(*short)) == sum(min(count(x, c), count(y, c)) for c in range(40)) >= len(np.intersect1d(x, y))
        assert nearcopies._most_common(*(np.frombuffer(nearcopies.histogram(v), np.uint8) for v in (x, y))) >= len(np.intersect1d(x, y))


def test_stars_of_long_keys(monkeypatch):
    monkeypatch.setattr(nearcopies, "BLOCK", 5)
    rng = np.random.default_rng(2)
    rows = sorted({(int(k), int(x), 10 + int(x) % 2) for k in range(6) for x in rng.choice(500, 40 if k in (2, 5) else 3, replace=False)})
    rows = [r for r in rows for _ in range(1 + r[1] % 2)]  # equal sets of several tasks
    for size in (1, 3, 7, 1000):
        batches = [pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*rows[i : i + size])], names=["key", "node", "n"]) for i in range(0, len(rows), size)]
        out = [r for b in nearcopies._stars()(iter(batches)) for r in b.to_pylist()]
        by = {}
        for k, x, _ in sorted(set(rows)):
            by.setdefault(k, []).append(x)
        want = {(max(x, c), min(x, c)) for xs in by.values() for c in xs[: nearcopies.CENTERS] for x in xs if x != c}
        assert {(r["a"], r["b"]) for r in out if r["b"] is not None} == want
        assert sorted((r["key"], r["a"]) for r in out if r["b"] is None) == sorted((k, x) for k, xs in by.items() if len(xs) > nearcopies.CENTERS + 1 for x in xs)


def test_deduplicate_keeps_rows_not_ids(spark):
    own = [f"text {i} of its own under one id" for i in range(20)]
    rows = [(1, BASE, "x")] + [(7, t, "x") for t in own] + [(7, BASE, "x"), (7, BASE, "y"), (9, own[3], "x"), (8, "once more", "x"), (8, "once more", "x")]
    rows += [(10, "two rows of one id", "p"), (10, "two rows of one id", "q"), (None, BASE, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, note string")
    got = sorted([(r.doc_id, r.text) for r in nearcopies.deduplicate(docs).collect()], key=str)
    assert got == sorted([(1, BASE), *[(7, t) for t in own], (8, "once more"), (10, "two rows of one id"), (None, BASE)], key=str)
    again = [[r.note for r in nearcopies.deduplicate(docs.repartition(n)).filter("doc_id = 10").collect()] for n in (1, 5)]
    assert again[0] == again[1]


def test_mixing(spark, docs):
    got = mixing.mix(docs).collect()
    assert len(got) == len(ROWS) and all(0 <= r.taken <= 2 * r["size"] for r in got)
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
    for rows in by.values():
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= 1 and rows[0].source_size == sum(r["size"] for r in rows)
        assert rows[0].target <= 2 * rows[0].source_size
    total = sum(r["size"] for r in got)
    assert abs(sum(rows[0].target for rows in by.values()) - min(1.5 * total, 2 * total)) < 1e-6
    order = mixing.training_order(docs).select("position").collect()
    assert [r.position for r in order] == sorted(r.position for r in order)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixing_odd_weights_null_ids_and_more_buckets(spark, monkeypatch):
    rows = [(None, "w " * (i % 7 + 1) + str(i), ["a", "b"][i % 2]) for i in range(300)] + [(5, "v " * (i % 3) + str(i), "a") for i in range(100)] + [(6, None, None), (6, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for weights in ((3, 10), (1,), (3, 1, 2), (7, 2, 2, 9)):
        got = mixing.mix(docs, weights=weights).collect()
        assert len(got) == len(rows) and all(r.taken == 0 or 0 <= r.position <= 1 for r in got)
        for s in ("a", "b"):
            mine = [r for r in got if r.source == s]
            assert abs(sum(r.taken for r in mine) - mine[0].target) <= 1
    want = sorted(map(str, mixing.mix(docs).collect()))
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 1)
    monkeypatch.setattr(mixing, "BUCKET_DIGITS", 1)
    assert sorted(map(str, mixing.mix(docs).collect())) == want
    keys = docs.select(F.substring(mixing._digest(), 1, 3).alias("b")).groupBy("b").count().agg(F.max("count")).first()[0]
    assert keys < 10  # rows without an id, or of one id, are dealt apart


def test_training_order_has_a_row_for_each_epoch(spark):
    sizes = {"a": [5, 9, 1, 7, 4, 6] * 2, "b": [300, 250, 150], "c": [8, 3]}  # a and c are taken twice
    rows = [(100 * i + j, "w " * n, s) for i, (s, ns) in enumerate(sizes.items()) for j, n in enumerate(ns)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = {r.doc_id: r for r in mixing.mix(docs).collect()}
    out = mixing.training_order(docs).collect()
    assert [r.position for r in out] == sorted(r.position for r in out) and all(0 < r.taken <= r["size"] for r in out)
    of = {}
    for r in out:
        of.setdefault(r.doc_id, []).append(r)
    assert {i: sum(r.taken for r in rs) for i, rs in of.items()} == {i: r.taken for i, r in mixed.items() if r.taken}
    for s, ns in sizes.items():
        assert abs(sum(r.taken for r in out if r.source == s) - next(r.target for r in out if r.source == s)) < 1
    twice = [rs for rs in of.values() if len(rs) == 2]
    assert len(twice) >= 12
    for first, second in twice:
        assert (first.epoch, second.epoch) == (0, 1) and first.position == mixed[first.doc_id].position
        target, slope = first.target, {"a": 0.5, "b": -0.5, "c": 0.0}[first.source]
        reached = [target * (r.position + slope * (r.position**2 - r.position)) for r in (first, second)]
        assert abs(reached[1] - reached[0] - first.source_size) < 1e-6


def plain_payload(text):
    raw = (text or "").encode()
    return raw + b" " * (-len(raw) % 192 or (192 if not raw else 0))


def plain_feature(payload):
    """Which of 64 even stretches are brighter than all, the mean and the deviation."""
    n, mean = len(payload), sum(payload) / len(payload)
    edges = [int(i * n / 64) for i in range(65)]
    bits = "".join("1" if sum(payload[a:b]) * n > sum(payload) * (b - a) else "0" for a, b in zip(edges, edges[1:]))
    deviation = max(0.0, sum(x * x for x in payload) / n - mean * mean) ** 0.5
    return f"{int(bits, 2):016x}:{mean:.3f}:{deviation:.3f}"


def test_webp_tiles_round_trip(spark, docs):
    got = media.with_media(docs).collect()
    assert len(got) == len(ROWS) and media.with_media(docs.limit(0)).count() == 0
    rows = {r.doc_id: r for r in got}
    for i, t, *_ in ROWS:
        payload, r = plain_payload(t), rows[i]
        assert (r.n_bytes, r.payload_bytes, bytes(r.pixels)) == (len((t or "").encode()), len(payload), payload)
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-16:])
        assert r.media_bytes == len(r.media) and r.media_sha256 == hashlib.sha256(r.media).hexdigest() and r.feature == plain_feature(payload)
        tiles = [webp.decode(f) for f in webp.split_files(bytes(r.media))]  # the general decoder agrees
        assert b"".join(x[..., c].tobytes() for x in tiles for c in range(1)) == payload and all((x[..., :3] == x[..., :1]).all() and (x[..., 3] == 255).all() for x in tiles)
    assert len({r.media_sha256 for r in got if r.doc_id == 8}) == 1


def test_webp_tiles_of_any_bytes():
    rng = np.random.default_rng(9)
    kinds = [
        rng.integers(0, 256, 192 * 70), np.zeros(192 * 130), np.tile(rng.integers(0, 256, 3000), 8), np.repeat(rng.integers(0, 4, 300), 192), rng.choice([32, 101, 200], 192 * 5, p=[0.98, 0.01, 0.01]),
        np.full(192, 255), np.r_[np.zeros(191), 7], 2.0 ** np.minimum(7, rng.geometric(0.5, 192 * 40)) - 1, *[rng.integers(0, int(k), 192 * int(n)) for k, n in rng.integers(1, 40, (60, 2))],
    ]
    payloads = [x.astype(np.uint8).tobytes()[: len(x) // 192 * 192] for x in kinds]
    stored = media.store(payloads)
    assert [x.tobytes() for x in media.load(stored)] == payloads
    for p, s in zip(payloads[:12], stored):
        assert b"".join(webp.decode(f)[..., 0].tobytes() for f in webp.split_files(s)) == p
    assert len(stored[1]) < 400  # copies that overlap themselves
    broken = stored[4][: len(stored[4]) * 2 // 3]  # one file, cut short
    with pytest.raises((ValueError, IndexError, struct.error)):
        webp.decode_tiles([broken])


def _transforms(file):
    """Kinds of the transforms of a file, and the bits of its colour cache; None: not read as far as that."""
    bits, kinds = webp.Bits(webp.payload(file)), []
    bits.at = 40
    while bits.read(1):
        kinds.append(bits.read(2))
        if kinds[-1] == webp.PREDICTOR:
            size = 2 + bits.read(3)
            webp.read_pixels(bits, -(-webp.WIDTH >> size), 1, False)
        elif kinds[-1] == webp.PALETTE:
            return kinds, None
    return kinds, bits.read(4) if bits.read(1) else 0


def test_webp_tiles_take_the_form_that_is_smaller(monkeypatch):
    rng = np.random.default_rng(7)
    slot = webp.slots(1, 255)
    pair = [np.flatnonzero(slot == k) for k in (0, 1)]
    kinds = {
        "predictor": (np.add.outer(3 * np.arange(64), 2 * np.arange(192)) + rng.integers(0, 3, (64, 192))) & 255, "palette": rng.choice([65, 66], (64, 192), p=[0.93, 0.07]),
        "cache": np.concatenate([rng.choice([pair[0][i], pair[1][i]], 768) for i in range(1, 17)]), "text": np.frombuffer(media.padded(BASE * 9)[1], np.uint8),
    }
    payloads = [v.astype(np.uint8).tobytes() for v in kinds.values()]
    stored = media.store(payloads)
    assert [x.tobytes() for x in media.load(stored)] == payloads and media.store(payloads[::-1]) == stored[::-1]
    forms = [_transforms(s) for s in stored]
    assert [k for k, _ in forms] == [[webp.SUBTRACT_GREEN, webp.PREDICTOR], [webp.SUBTRACT_GREEN, webp.PALETTE], [webp.SUBTRACT_GREEN], [webp.SUBTRACT_GREEN]]
    assert forms[2][1] and not forms[3][1]
    for colours in range(1, 17):  # every width of a packed palette, every predictor and cache
        data = rng.choice(rng.choice(256, colours, replace=False), 192 * 5).astype(np.uint8)
        for mode, cache in [*((m, 0) for m in webp.MODES), *((0, c) for c in webp.CACHES)]:
            assert all(webp.decode(f)[..., 0].tobytes() == data.tobytes() for f in webp.smaller_form(data, mode, cache))
    monkeypatch.setattr(webp, "promising", lambda *_: [])
    plain = media.store(payloads)
    assert plain[3] == stored[3] and all(len(s) < len(p) for s, p in zip(stored[:3], plain))


def test_webp_compresses_text_about_as_well_as_deflate():
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("etaoinshrdlu"), n)) for n in rng.integers(2, 9, 400)]
    texts = [" ".join(rng.choice(words, 1500)) for _ in range(20)]
    payloads = [media.padded(t)[1] for t in texts]
    assert sum(map(len, media.store(payloads))) < 1.1 * sum(len(zlib.compress(p)) for p in payloads)


@pytest.mark.parametrize("top", [1, 5, 280])
def test_code_lengths_are_complete(top):
    rng = np.random.default_rng(top)
    counts = rng.integers(0, 5, (50, 280)) * (rng.random((50, 280)) < top / 280) * 3 ** rng.integers(0, 15, (50, 280))
    counts[:, :2] += 1
    n = webp.code_lengths(counts)
    assert ((n > 0) == (counts > 0)).all() and n.max() <= webp.LONGEST
    assert (np.where(n > 0, 1 << np.maximum(webp.LONGEST - n, 0), 0).sum(1) == 1 << webp.LONGEST).all()


class Writer:
    """Bits of a lossless image, written by hand."""

    def __init__(self, width, height):
        self.bits = []
        self.put(0x2F, 8), self.put(width - 1, 14), self.put(height - 1, 14), self.put(1, 1), self.put(0, 3)

    def put(self, value, n):
        self.bits += [value >> i & 1 for i in range(n)]

    def flat_code(self, symbols, alphabet):
        """All of 2^k symbols with length k, or one symbol."""
        if len(symbols) == 1 and symbols[0] < 256:
            self.put(1, 1), self.put(0, 1), self.put(1, 1), self.put(symbols[0], 8)
            return {symbols[0]: (0, 0)}
        k = len(symbols).bit_length() - 1
        assert 1 << k == len(symbols)
        self.put(0, 1), self.put(15, 4)
        for s in webp.CODE_LENGTH_ORDER:
            self.put(1 if s in (0, k) else 0, 3)
        self.put(0, 1)
        low, high = sorted((0, k))
        for s in range(alphabet):
            self.put(int((k if s in symbols else 0) == high), 1)
        return {s: (int(format(i, f"0{k}b")[::-1], 2), k) for i, s in enumerate(sorted(symbols))}

    def literals(self, argb, cache=0, outer=True, copy=None, cached=()):
        """Pixels as literals, those at ``cached`` through the colour cache; ``copy``: from there on one back-reference to the pixel before."""
        self.put(int(cache > 0), 1)
        if cache:
            self.put(cache, 4)
        if outer:
            self.put(0, 1)
        size = 256 + 24 + (1 << cache if cache else 0)
        green = self.flat_code(sorted([*range(256), *range(256, 280), *range(280, 280 + 512 - 280)])[:512] if size >= 512 else list(range(256)), size) if copy is None else None
        if copy is not None:
            green = self.flat_code(sorted({*range(0, 120), *range(256, 264)}), size)
        others = [self.flat_code(list(range(256)), 256) for _ in range(3)]
        far = self.flat_code([1], 40)
        for i, v in enumerate(argb):
            if copy is not None and i == copy:
                self.put(*green[256 + len(argb) - copy - 1])
                self.put(*far[1])
                break
            if i in cached:
                self.put(*green[280 + ((webp.HASH * v & 0xFFFFFFFF) >> (32 - cache))])
                continue
            parts = v >> 24, v >> 16 & 255, v >> 8 & 255, v & 255
            self.put(*green[parts[2]])
            for code, x in zip(others, (parts[1], parts[3], parts[0])):
                self.put(*code[x])

    def file(self):
        data = bytes(sum(b << i for i, b in enumerate(self.bits[a : a + 8])) for a in range(0, len(self.bits), 8))
        pad = b"\0" * (len(data) & 1)
        return b"RIFF" + (12 + len(data) + len(pad)).to_bytes(4, "little") + b"WEBPVP8L" + len(data).to_bytes(4, "little") + data + pad


def _argb(rng, n):
    return [int(x) for x in rng.integers(0, 1 << 32, n, dtype=np.uint64)]


def _rgba(argb, h, w):
    v = np.array(argb, np.uint32).reshape(h, w)
    return np.stack([v >> s & 255 for s in (16, 8, 0, 24)], -1).astype(np.uint8)


@pytest.mark.parametrize("mode", range(14))
def test_webp_predictors(mode):
    rng = np.random.default_rng(mode)
    h, w, pixels = 5, 6, _argb(rng, 30)
    rows = [[webp._channels(v) for v in pixels[y * w : y * w + w]] for y in range(h)]
    rest = [sum(((a - b) & 255) << s for a, b, s in zip(rows[y][x], webp.predicted(rows, x, y, mode), (24, 16, 8, 0))) for y in range(h) for x in range(w)]
    f = Writer(w, h)
    f.put(1, 1), f.put(webp.PREDICTOR, 2), f.put(1, 3)
    f.literals([mode << 8], outer=False)
    f.put(0, 1)
    f.literals(rest)
    assert (webp.decode(f.file()) == _rgba(pixels, h, w)).all()


def test_webp_green_cross_colour_palette_and_copies():
    rng = np.random.default_rng(5)
    pixels = _argb(rng, 12)
    f = Writer(4, 3)
    f.put(1, 1), f.put(webp.SUBTRACT_GREEN, 2), f.put(0, 1)
    f.literals([v & 0xFF00FF00 | ((v >> 16) - (v >> 8) & 255) << 16 | (v - (v >> 8) & 255) for v in pixels])
    assert (webp.decode(f.file()) == _rgba(pixels, 3, 4)).all()

    signed = lambda x: (x & 255) - 256 * ((x & 255) > 127)
    gr, gb, rb = 17, -30, 90
    f, coded = Writer(4, 3), []
    for v in pixels:
        r, g, b = v >> 16 & 255, v >> 8 & 255, v & 255
        b = b - (signed(gb) * signed(g) >> 5) - (signed(rb) * signed(r) >> 5) & 255
        r = r - (signed(gr) * signed(g) >> 5) & 255
        coded.append(v & 0xFF00FF00 | r << 16 | b)
    f.put(1, 1), f.put(webp.CROSS_COLOUR, 2), f.put(0, 3)
    f.literals([255 << 24 | (rb & 255) << 16 | (gb & 255) << 8 | (gr & 255)], outer=False)
    f.put(0, 1)
    f.literals(coded)
    assert (webp.decode(f.file()) == _rgba(pixels, 3, 4)).all()

    colours, at = pixels[:3], [0, 2, 1, 1, 2, 0, 2, 2, 0, 1]
    f = Writer(5, 2)
    f.put(1, 1), f.put(webp.PALETTE, 2), f.put(2, 8)
    f.literals([colours[0], *[sum((((b >> s) - (a >> s)) & 255) << s for s in (0, 8, 16, 24)) for a, b in zip(colours, colours[1:])]], outer=False)
    f.put(0, 1)
    packed = [sum(v << 2 * i for i, v in enumerate(at[y + x : y + min(x + 4, 5)])) << 8 for y in (0, 5) for x in (0, 4)]
    f.literals(packed)
    assert (webp.decode(f.file()) == _rgba([colours[i] for i in at], 2, 5)).all()

    f = Writer(5, 1)
    same = [5 << 24 | 100 << 8 | 7] * 5
    f.put(0, 1)
    f.literals(same, copy=1)
    assert (webp.decode(f.file()) == _rgba(same, 1, 5)).all()


def test_webp_colour_cache():
    rng = np.random.default_rng(11)
    own = [v for v in _argb(rng, 60) if (webp.HASH * v & 0xFFFFFFFF) >> 24 < 512 - 280]
    slots = {(webp.HASH * v & 0xFFFFFFFF) >> 24: v for v in own}  # one colour a slot, so that none pushes another out
    own = list(slots.values())[:20]
    pixels = own + [own[int(i)] for i in rng.integers(0, 20, 30)]
    f = Writer(10, 5)
    f.put(0, 1)
    f.literals(pixels, cache=8, cached=range(20, 50))
    assert (webp.decode(f.file()) == _rgba(pixels, 5, 10)).all()


def test_pii(spark, docs):
    cases = {
        "mail a.b@c.de now": ("email", "a.b@c.de"), "john (at) example (dot) com": ("email", "john (at) example (dot) com"), "see 10.0.0.255.": ("ip", "10.0.0.255"),
        "card 4111 1111 1111 1111": ("card", "4111 1111 1111 1111"), "tel +1 (017) 555-7713": ("phone", "+1 (017) 555-7713"),
        "jоhn@еxample.com": ("email", "jоhn@еxample.com"), "ring plus four nine one two three four five six seven": ("phone", "plus four nine one two three four five six seven"),
        "mail jane (dot) van (dot) doe [at] example [dot] com": ("email", "jane (dot) van (dot) doe [at] example [dot] com"),
    }
    for t, (kind, part) in cases.items():
        assert (t.index(part), t.index(part) + len(part), kind) in pii.find(t)[1], t
        assert part not in pii.redact(t)
    for t in ("meet me at the point of no return", "it is at example", "one two three", BASE, "Änderung – naïve «texte»"):
        assert pii.find(t) == ([], [])
    assert pii.find("x" * 300_000 + " @ [at] dot") == ([], [])  # long runs are read once
    assert pii.scan(docs).count() == len(ROWS) and pii.redacted(docs).columns == docs.columns


def base_pii(text):
    """The contract's patterns, matched plainly."""
    out = []
    for kind, pattern in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), ["email", "ip", "card", "phone"].index(kind), m.end(), kind))
    return [(a, b, k) for a, _, b, k in sorted(out)]


def test_pii_base_equals_brute_force(spark):
    rng = np.random.default_rng(8)
    parts = ["a", "b.c", "@", ".", "x-y", "1", "23", "255", "256", "4111 1111 1111 1111", "+", "(", ")", " ", "-", "é", "1.2.3.4", "+49 30 1234567", "a@b.de", "％", "00", "9", " at ", " dot "]
    texts = ["".join(rng.choice(parts, rng.integers(1, 25))) for _ in range(3000)] + ["", None]
    for t in texts:
        base, every = pii.find(t)
        assert base == base_pii(t or "") and set(base) <= set(every), t
    got = pii.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in got:
        b = base_pii(texts[r.doc_id] or "")
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for *_, x in b) for k in ("email", "ip", "card", "phone")]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in b).encode()).hexdigest()
    assert len(got) == len(texts) and pii.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pii_long_texts_are_linear():
    for t in ("mail a.b@c.de and j (at) x (dot) org, " * 20_000, "a.b at " * 100_000, "one " * 100_000, "1.2 at 3.4 " * 50_000, "+1" * 200_000):
        began = time.monotonic()
        pii.find(t)
        assert time.monotonic() - began < 5


@pytest.mark.parametrize("text, part", [("write bob at example dot ca today", "bob at example dot ca"), ("x at firma dot pl", "x at firma dot pl"), ("to john.smith at example.com", "john.smith at example.com")])
def test_pii_bare_words(text, part):
    assert (text.index(part), text.index(part) + len(part), "email") in pii.find(text)[1]
    for t in ("meet us at example.com", "look at that dot now", "look at the dot of it", "see room 12 at hotel.com", "it ended at 5.30 at noon"):
        assert pii.find(t) == ([], [])


def test_toxicity(spark):
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 1
        t = [str(x) for x in rng.choice(words, 30)]
        if bad:
            t[3:3] = [str(x) for x in rng.choice(["idiot", "moron", "zzgrak"], 3)]
        rows.append((i, " ".join(t)))
        labels.append((i, int(bad)))
    d = spark.createDataFrame([*rows, (1000, None), (1001, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.classify(d, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out for i in held) and len(got) == 602
    assert np.mean([got[i].predicted == dict(labels)[i] for i in held]) > 0.95 and got[1000].predicted == got[1001].predicted == 0
    assert toxicity.classify(d, spark.createDataFrame([], "doc_id long, toxic int")).filter("score > 0").count() == 0


def test_votes_overrule_wrong_labels():
    rng = np.random.default_rng(3)
    y = rng.random(2000) < 0.2
    votes = (rng.random((2000, 12)) < np.where(y[:, None], 0.6, 0.02)).astype(float)
    votes[:, 10] = votes[:, 9]  # two voters that say the same thing
    votes[:, 11] = rng.random(2000) < np.where(y, 0.01, 0.5)  # one that votes against the class
    labels = y.astype(float)
    wrong = rng.random(2000) < 0.05
    labels[wrong] = 1 - labels[wrong]
    labels[1000:] = np.nan
    model = toxicity.LabelModel()
    q = model.fit(votes, labels)
    flipped = wrong & (np.arange(2000) < 1000)
    assert flipped.sum() > 20 and ((q > 0.5) == y)[flipped].mean() > 0.9 and ((q > 0.5) == y).mean() > 0.97
    assert model.on[0] > 0.5 > 0.1 > model.off[0] and model.on[11] < model.off[11]
    assert model.correlation[9, 10] > 0.9 and model.share[9] < 0.6 < model.share[0]


def test_toxicity_edge_cases(spark):
    texts = ["you idiot moron " * 5, "a calm text", None, "", "WORD " * 50_000, "a calm text"]
    d = spark.createDataFrame([(i % 5, t) for i, t in enumerate(texts)] + [(None, "x")], "doc_id long, text string").withColumn("score", F.lit("s")).withColumn("toxic", F.lit("t"))
    labels = spark.createDataFrame([(i, int(i == 0)) for i in range(4)] + [(1, 1), (None, 1), (77, 0)], "doc_id long, toxic int").withColumn("text", F.lit("other"))
    got = toxicity.classify(d, labels).collect()
    assert len(got) == 7 and all(0 <= r.score <= 1 for r in got) and toxicity.classify(d.limit(0), labels).count() == 0
    assert toxicity.classify(d, labels.filter("toxic = 1")).filter("score > 0").count() == 0


def test_decontam(spark, docs):
    bench = spark.createDataFrame([(1, " ".join(BASE.split()[5:20])), (2, "short"), (3, None), (4, ""), (5, "never seen at all")], "item_id long, text string")
    got = [r for r in decontam.contamination(docs, bench).collect()]
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    items = {i: word.findall((t or "").lower()) for i, t in ((1, " ".join(BASE.split()[5:20])), (2, "short"), (5, "never seen at all"))}
    want = []
    for i, t, *_ in ROWS:
        ws, hit, its = word.findall((t or "").lower()), set(), set()
        for k, iw in items.items():
            n = min(10, len(iw))
            for s in range(len(iw) - n + 1):
                for p in range(len(ws) - n + 1):
                    if ws[p : p + n] == iw[s : s + n]:
                        hit |= set(range(p, p + n))
                        its.add(str(k))
        want.append((i, len(ws), len(hit), hashlib.sha256(",".join(sorted(its)).encode()).hexdigest()))
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted([(r.doc_id, r.n_words, r.n_hit, r.items_sha256) for r in got], key=key) == sorted(want, key=key)
    assert {r.doc_id for r in decontam.decontaminate(docs, bench).collect()} == {4, 5, 7, 8, None}
    assert decontam.contamination(docs, bench.limit(0)).filter("contaminated").count() == 0


def test_decontam_null_items_and_the_way_without_broadcasts(spark, docs, monkeypatch):
    leak = " ".join(f"item{i}" for i in range(25))
    bench = spark.createDataFrame([(None, leak), (7, leak), (8, "tiny"), (9, "w1 w2")], "item_id long, text string")
    rows = [(1, f"a {leak} b"), (2, "Tiny. w1 w2"), (2, f"a {leak} b"), (3, None), (None, "tiny"), *[(100 + i, f"a {leak} b") for i in range(40)]]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("salt", F.lit("s")).withColumn("key", F.lit("k"))
    key = lambda r: str(r)
    plain = sorted(decontam.contamination(d, bench).collect(), key=key)
    first = next(r for r in plain if r.doc_id == 1)
    assert (first.n_words, first.n_hit, first.n_items, first.item_ids) == (27, 25, 2, ["7"]) and len(plain) == len(rows)
    monkeypatch.setattr(decontam, "MOST_BROADCAST", 0)
    assert sorted(decontam.contamination(d, bench).collect(), key=key) == plain
    assert sorted(r.doc_id or 0 for r in decontam.decontaminate(d, bench).collect()) == [3]
    assert decontam.contamination(d.limit(0), bench).count() == 0


def test_decontaminate_judges_each_row_by_its_text(spark):
    leak = " ".join(f"item{i}" for i in range(12))
    rows = [(None, leak), (None, "clean without an id"), (3, f"before {leak} after"), (3, "clean under the same id"), (4, None), (5, leak.upper())]
    got = decontam.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([("b", leak)], "item_id string, text string"))
    assert sorted(got.collect(), key=str) == sorted([(None, "clean without an id"), (3, "clean under the same id"), (4, None)], key=str)
    assert got.columns == ["doc_id", "text"]


def test_language_model(spark, docs):
    got = {r.doc_id: r for r in lm.language_model(docs).collect()}
    train = [t for i, t, *_ in ROWS if zlib.crc32(str("" if i is None else i).encode()) % 10]
    counts: dict = {}
    for t in train:
        for w in [*lm.tokens(t), lm.END]:
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for i, t, *_ in ROWS:
        toks = [*lm.tokens(t), lm.END]
        base = sum(np.log10((counts.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in toks)
        assert got[i].n_tokens == len(toks) and got[i].n_known == sum(w in counts for w in toks) and got[i].train_tokens == n
        assert abs(got[i].base_score - base) < 1e-6 * max(1, abs(base)) and got[i].score < 0


def test_language_model_learns_from_all_training_documents(spark):
    docs = spark.range(1000).select(F.when(F.col("id") % 7 > 0, F.col("id")).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    for n in (1000, 40 * lm.TOKENS_PER_COPY):
        parts = [lm.dealt(docs, n, p) for p in range(lm.ROUNDS)]
        assert all(p.rdd.getNumPartitions() == lm.copies(n) for p in parts)
        assert sorted(r.text for p in parts for r in p.collect()) == sorted(f"text {i}" for i in range(1000))
    same = docs.select(F.lit(None).cast("long").alias("doc_id"), F.lit("one text").alias("text"))  # copies without ids are no hot key
    sizes = [n for p in range(lm.ROUNDS) for n in lm.dealt(same, 40 * lm.TOKENS_PER_COPY, p).rdd.glom().map(len).collect()]
    assert sum(sizes) == 1000 and max(sizes) < 400


@pytest.mark.parametrize("most", [1, 100, 65_536, 70_000, 80_000])
def test_vocabulary_of_tied_words(spark, most):
    counts = spark.range(70_000).select(F.concat(F.lit("w"), "id").cast("binary").alias("word"), F.when(F.col("id") < 50, 9).when(F.col("id") < 90, 1000 - F.col("id")).otherwise(1).cast("long").alias("c"))
    want = [(9 if i < 50 else 1000 - i if i < 90 else 1, f"w{i}".encode()) for i in range(70_000)]
    want = sorted(((-c, xxhash.xxh64_intdigest(w, 42), w) for c, w in want))[:most]
    assert lm.most_frequent(counts, most) == [(w, -c) for c, _, w in want]
    assert lm.most_frequent(counts.limit(0), most) == []


def test_language_model_gradient():
    rng = np.random.default_rng(1)
    voc = lm.Vocabulary([(f"w{i}".encode(), max(1, 300 - i)) for i in range(lm.HEAD + 40)], 2_000_000, 9000, 100)
    w = lm.initial_weights(voc)
    stream = np.concatenate([np.append(rng.choice([0, 1, 70, 200, lm.HEAD + 5, voc.rest], 6), voc.end) for _ in range(3)])
    trainer, found = lm.Trainer(w, voc, 100), {}
    trainer._step = lambda grad, rate: found.update({n: g.copy() for n, g in grad.items()})
    trainer.feed(stream)
    ends = np.flatnonzero(stream == voc.end) + 1
    docs = np.split(stream, ends[:-1])

    def loss(weights):
        within = sum(voc.within[d].sum() for d in docs)
        return -(lm.score_documents(lm.scoring_weights(weights), voc, docs).sum() - within) * np.log(10) / len(stream)

    for name, g in found.items():
        for at in [np.unravel_index(i, g.shape) for i in np.argsort(-np.abs(g).ravel())[:3]]:
            moved = [{k: v.astype(np.float64) for k, v in w.items()} for _ in range(2)]
            moved[0][name][at] += 1e-3
            moved[1][name][at] -= 1e-3
            assert abs((loss(moved[0]) - loss(moved[1])) / 2e-3 - g[at]) < 2e-2 * abs(g[at]) + 1e-4, (name, at)


def test_softmax_and_gates_of_any_size():
    rng = np.random.default_rng(4)
    for scale, shift in ((1, 0), (40, 0), (1, 500), (1, -500), (300, -200)):
        y = (rng.normal(0, scale, (50, 35)) + shift).astype(np.float32)
        exact = np.exp(y.astype(np.float64) - y.max(1, keepdims=True))
        assert np.allclose(lm._softmax(y.copy()), exact / exact.sum(1, keepdims=True), atol=1e-5)
        with np.errstate(over="ignore"):
            exact = 1 / (1 + np.exp(-y.astype(np.float64)))
        assert np.allclose(lm._sigmoid(y.copy()), exact, atol=1e-6) and np.allclose(lm._sigmoid(-y, negative=True), exact, atol=1e-6)
        assert lm._capped(y).max() <= 60


def test_language_model_beats_counts_on_held_out_rows(spark):
    rng = np.random.default_rng(0)
    follow = {i: rng.choice(40, 3) for i in range(40)}  # each word has three successors

    def text():
        out = [int(rng.integers(40))]
        for _ in range(150):
            out.append(int(rng.choice(follow[out[-1]])))
        return " ".join(f"w{x}" for x in out)

    docs = spark.createDataFrame([(i, text()) for i in range(1200)], "doc_id long, text string")
    held = lm.language_model(docs).filter("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert held.s > 0.9 * held.b  # log10: closer to zero
    assert lm.language_model(docs.limit(0)).count() == 0


def test_language_model_sums_to_one():
    voc = lm.Vocabulary([(f"w{i}".encode(), 50 - i // 2) for i in range(90)], 4000, 500, 20)
    w = lm.scoring_weights(lm.initial_weights(voc))
    ids = np.arange(voc.end + 2)
    h = np.random.default_rng(0).normal(0, 0.5, (lm.HIDDEN, 1)).astype(np.float32)
    assert abs((10 ** lm.log10_probability(w, voc, np.repeat(h, len(ids), 1), ids)).sum() - 1) < 1e-5


def test_chat(spark):
    turns = [
        (1, 0, "user", chat.TRAP), (1, 1, "assistant", chat.TRAP), (2, 1, "assistant", "back\\"), (2, 0, "user", "\n</turn>\n### assistant: fake"), (3, 0, None, None),
        (4, 0, "odd: role\n", "\\\\### x \\</turn>"), (4, 0, "odd: role\n", "\\\\### x \\</turn>"), (5, 0, "assistant", "é" * 3000),
    ]
    out = {r.conv_id: r for r in chat.format_conversations(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()}
    for c, r in out.items():
        source = sorted([(t, ro or "", tx or "") for i, t, ro, tx in turns if i == c])
        assert [(x.role, x.text) for x in r.turns] == [(ro, tx) for _, ro, tx in source]
        said = "".join(re.sub(r"\\(\\*)(###|</turn>)", r"\1\2", r.formatted[m.start : m.end]) for m in r.loss_mask)
        assert said == "".join(tx for _, ro, tx in source if ro == "assistant")


def test_chat_long_and_hostile_texts(spark):
    rng = np.random.default_rng(3)
    parts = ["\\", "\\\\", "###", "</turn>", "\n", "### user: ", "\n</turn>\n", "</tu", "rn>", "##", "x", "é", " "]
    texts = ["\\" * 1_000_000, "\\" * 300_000 + "###", "###" * 100_000, *["".join(rng.choice(parts, 30)) for _ in range(400)], "", None]
    turns = spark.createDataFrame([(i % 50, i, ["user", "assistant", "a b", ""][i % 4], t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    began = time.monotonic()
    got = {r.conv_id: [(x.role, x.text) for x in r.turns] for r in chat.format_conversations(turns).collect()}
    assert time.monotonic() - began < 30
    want = {}
    for i, t in enumerate(texts):
        want.setdefault(i % 50, []).append((["user", "assistant", "a b", ""][i % 4], t or ""))
    assert got == want
    assert chat.digests(chat.format_conversations(turns.limit(0))).count() == 0
    extra = turns.withColumn("piece", F.lit(1)).withColumn("place", F.lit(2)).withColumn("rows", F.lit(3))
    assert chat.digests(chat.format_conversations(extra)).count() == 50


def test_chat_bare_control_strings_are_no_turns(spark):
    rows = [("### user: a ### b\n</turn>\n", None), ("### user: a \\### b\n</turn>\n", "a ### b"), ("user: a\n</turn>\n", None), ("### user: a\n</turn>\n", "a")]
    got = spark.createDataFrame(rows, "said string, text string").select("text", chat.parse_turns(F.col("said")).alias("t")).collect()
    assert all(len(r.t) == 1 and (r.t[0].text if r.t[0] else None) == r.text for r in got)


def test_language_id(spark):
    a, b = "the quick brown fox and the dog ", "der schnelle braune fuchs und das größte "
    rows = [(i, (a if i % 2 else b) * (1 + i % 5), "en" if i % 2 else "de") for i in range(60)] + [(100, None, "en"), (101, "12 34 !", "de"), (102, "", None)]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i].lang_pred == ("en" if i % 2 else "de") and 0 <= got[i].score <= 1 for i in range(60))
    assert all(got[i].lang_pred == "und" for i in (100, 101, 102))


def test_language_network_carries_state_through_whole_documents():
    rng = np.random.default_rng(5)
    net = langid.ByteNetwork(["a", "b", "c"])
    texts = [bytes(rng.integers(0, 256, n).astype(np.uint8)) for n in (0, 1, 63, 64, 65, 130, 1000, 129)]
    slow = langid.ByteNetwork(["a", "b", "c"])
    for k in ("table_f", "table_b"):  # gates that hardly open: states last for hundreds of bytes
        slow.w[k] = slow.w[k].copy()
        slow.w[k][:, : langid.HIDDEN] = 0.01
    slow.w["u_f"], slow.w["u_b"] = slow.w["u_f"] * 0, slow.w["u_b"] * 0
    for n in (net, slow):
        got = n.pooled(texts)
        for t, p in zip(texts, got):
            x = np.frombuffer(t, np.uint8)[:, None]
            if not len(x):
                assert (p == 0).all()
                continue
            y = sum(langid._states(x, n.w[f"table_{d}"], n.w[f"u_{d}"], d == "b")[:, :, 0] @ n.w[f"o_{d}"] for d in "fb") + n.w["bias"]
            y = np.exp(y - y.max(1, keepdims=True))
            assert np.abs((y / y.sum(1, keepdims=True)).mean(0) - p).max() < 2e-3


def test_language_id_of_many_languages(spark):
    words = {f"l{i}": [f"{chr(97 + i % 26)}{chr(97 + i // 26)}{c}" for c in "xyz"] for i in range(70)}
    rng = np.random.default_rng(2)
    rows = [(100 * i + j, " ".join(rng.choice(ws, 40)), name) for i, (name, ws) in enumerate(words.items()) for j in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("lang_pred", F.lit("x")).withColumn("digest", F.lit("d"))
    net = langid.train(docs, steps=3)
    assert net.languages == sorted(words)
    with pytest.raises(ValueError):
        langid.train(docs, most_rows=60)
    assert langid.identify(docs.limit(0)).count() == 0 and langid.accept(docs).columns == docs.columns


def test_token_counts(spark, docs):
    with open(tokencount.VOCABULARY, "rb") as f:
        enc = tokencount.encoder(f.read())
    lens = [len(enc.encode_ordinary(t or "")) for _, t, *_ in ROWS]
    h = tokencount.suffix_sums(tokencount.histogram(tokencount.with_token_count(docs)))
    for r in h.collect():
        assert r.n_docs == lens.count(r.n_tokens) and r.docs_at_least == sum(x >= r.n_tokens for x in lens)
        assert r.tokens_at_least == sum(x for x in lens if x >= r.n_tokens) and r.truncated_total == sum(min(x, r.n_tokens) for x in lens)
    for r in tokencount.at_limits(h, [1, 8, 512]).collect():
        assert r.tokens_kept == sum(min(x, r.context_limit) for x in lens) and r.n_cut == sum(x > r.context_limit for x in lens)
    assert tokencount.quantiles(h, [0.5, 1.0]).collect()[1].n_tokens == max(lens)


def test_pipeline_small(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(3)
    words = ["the", "and", "lorem", "ipsum", "dolor", "amet", "sit", "elit", "magna", "aliqua", "tempor", "labore"]
    texts = [" ".join(str(x) for x in rng.choice(words, 60)) for _ in range(30)]
    item = "zeta eta theta iota kappa lambda mu nu xi omikron pi"
    texts += [texts[0], texts[1] + " " + item, texts[2] + " write to a.b@c.org", "123 456"]
    rows = [(i, t, "en" if i % 2 else "la", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in out}
    assert 30 not in ids and 31 not in ids and 33 not in ids and all("@" not in r.text for r in out)
    assert [r.position for r in out] == sorted(r.position for r in out)


def brute_mix(rows, weights=(3, 1, 2)):
    """(doc_id, text, source, epoch, taken, position) of rows (doc_id, text, source) in training order, source by source and word by word."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sources = sorted({r[2] for r in rows}, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(sources)}
    total = {s: sum(size(r[1]) for r in rows if r[2] == s) for s in sources}
    target, open_ = {}, set(sources)
    while open_:  # the excess of those that stop is shared again
        level = (1.5 * sum(total.values()) - sum(target.values())) / sum(weight[s] for s in open_)
        stop = [s for s in open_ if weight[s] * level > 2 * total[s]]
        if not stop:
            target |= {s: weight[s] * level for s in open_}
            break
        target |= {s: 2.0 * total[s] for s in stop}
        open_ -= set(stop)
    out = []
    for s in sources:
        slope = (weight[s] - 2) / 2
        mine = sorted((r for r in rows if r[2] == s), key=lambda r: hashlib.md5("|".join(str(x) for x in r[:2] if x is not None).encode()).hexdigest())
        at = 0
        for epoch in (0, 1):
            for r in mine:
                n = size(r[1])
                taken = max(0, min(n, int(target[s]) - at))
                if taken:
                    low, high = 0.0, 1.0
                    for _ in range(60):  # the time at which the demand reaches the first word
                        t = (low + high) / 2
                        low, high = (t, high) if target[s] * (t + slope * (t * t - t)) < at else (low, t)
                    out.append((*r, epoch, taken, round(low, 9)))
                at += n
    return out


def test_pipeline_equals_brute_force(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(8)
    words = ["the", "and", "lorem", "ipsum", "dolor", "amet", "sit", "elit", "magna", "aliqua", "tempor", "labore", "uno", "dos"]
    item = "zeta eta theta iota kappa lambda mu nu xi omikron pi rho".split()
    texts = [" ".join(str(x) for x in rng.choice(words, int(rng.integers(30, 90)))) for _ in range(60)]
    for i in (3, 4, 5):  # near copies at different similarities, copies, a chain
        w = texts[i].split()
        texts += [" ".join([*w[:-1], f"end{i}"]), " ".join([*w[:4], f"mid{i}", *w[5:]]), texts[i], " ".join([*w, "and", "more", "of", "it"])]
    texts += [texts[0] + " " + " ".join(item[:11]), " ".join(item[1:]), " ".join(item[:5]), "Tiny", "tiny words here", texts[1] + " write to a.b@c.org or +49 30 1234567", "bob at example dot com said so"]
    texts += ["123 456", "", None, "é", "x" * 30_000, ("long text " + " ".join(str(x) for x in rng.choice(words, 6000)))]
    rows = [(None if i % 17 == 16 else i if i % 13 else 7, t, [None, "en", "la"][i % 3], ["a", "b", None, "c"][int(rng.integers(4))], None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[2], rows[2], rows[16]]  # repeated rows
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, " ".join(item)), (1, "tiny"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    kept = [r for r in rows if r[1] and re.search(r"[^\W\d_]", r[1])]
    sets = [frozenset(simhash.shingle_hashes(r[1], 5).tolist()) for r in kept]
    of = grouped(len(kept), lambda i, j: 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]))
    chosen = {}
    for i, c in enumerate(of):
        if kept[i][0] is not None and (c not in chosen or kept[i][0] < kept[chosen[c]][0]):
            chosen[c] = i
    # of one group's rows of one doc_id the operator keeps the row of smallest digest: here such rows are equal, or the group has one
    assert all(len({kept[j] for j, c in enumerate(of) if c == k and kept[j][0] == kept[i][0]}) == 1 for k, i in chosen.items())
    kept = [kept[i] for i in chosen.values()] + [r for r in kept if r[0] is None]
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
    windows = [item[i : i + 10] for i in range(3)] + [["tiny"]]
    kept = [r for r in kept if not any(word(r[1])[p : p + len(w)] == w for w in windows for p in range(len(word(r[1]))))]
    want = brute_mix([(r[0], pii.redact(r[1]), r[3]) for r in kept])
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted([(r.doc_id, r.text, r.source, r.epoch, r.taken, round(r.position, 9)) for r in got], key=key) == sorted(want, key=key)
    assert all(r.n_chars == len(r.text) for r in got) and sum("@" in r.text for r in got) == 0
    assert [r.position for r in got] == sorted(r.position for r in got)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "near-dedup", "decontamination", "PII", "mixing"] and corpus_pipeline.ORACLE_SQL is None


def test_pipeline_of_empty_tables(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_token_counts_edge_cases(spark):
    docs = spark.createDataFrame([(1, None), (1, ""), (2, "word " * 30_000), (None, "x")], "doc_id long, text string").withColumn("n_tokens", F.lit("mine"))
    h = tokencount.suffix_sums(tokencount.histogram(tokencount.with_token_count(docs)))
    rows = sorted(h.collect(), key=lambda r: r.n_tokens)
    assert sum(r.n_docs for r in rows) == 4 and rows[0].n_tokens == 0 and rows[0].n_docs == 2 and rows[0].docs_at_least == 4
    assert tokencount.suffix_sums(tokencount.histogram(tokencount.with_token_count(docs.limit(0)))).count() == 0


def test_stages_take_extra_columns_and_nulls(spark, tmp_path):
    import corpus_pipeline

    names = ["row", "node", "key", "size", "position", "epoch", "taken", "lang_pred", "score", "n", "text_a", "component", "salt", "held_out"]
    docs = spark.createDataFrame([(1, "a text of some words here", "en", "s", 25), (None, "another text of words", None, None, None), (2, None, "en", "s", None), (2, "", None, "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.select("*", *[F.lit(f"my {n}").alias(n) for n in names])
    spark.createDataFrame([(1, "no such thing in them")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, str(tmp_path))
        assert set(docs.columns) <= set(got.columns) and {r.text for r in got.collect()} >= {"a text of some words here", "another text of words"}, name
        if name != "mixing":
            assert got.columns == docs.columns and {r.key for r in got.collect()} == {"my key"}
