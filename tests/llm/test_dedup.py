"""SimHash links, near-duplicate groups and repeated byte strings against brute force."""

import hashlib
from collections import Counter

import edge
import numpy as np
import xxhash

from cellgrid.functions.graph import components
from cellgrid.llm import simhash, suffix_dedup


def plain_fingerprint(text, k=3):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes, linked):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_chains_and_cycles(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 103), (103, 101), (101, 100), (200, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 103: 100}


def test_fingerprints_and_components(docs):
    got = simhash.simhash_components(docs).collect()
    want = {(r[0], r[1]): plain_fingerprint(r[1]) for r in edge.rows()}
    assert len(got) == len(edge.rows())
    fps = sorted(want.values())
    links = [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3]
    root = roots(fps, links)
    least = {}
    for (i, _), fp in want.items():
        if i is not None:
            least[root[fp]] = min(i, least.get(root[fp], i))
    expected = Counter()
    for r in edge.rows():
        fp = want[r[0], r[1]]
        expected[r[0], fp if fp < 1 << 63 else fp - (1 << 64), least[root[fp]]] += 1
    assert Counter((r.id, r.fingerprint, r.component_id) for r in got) == expected


def test_links_within_three_bits_are_all_found(spark, monkeypatch):
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 1 << 63, 12)
    fps = set()
    for c in centres.tolist():
        for _ in range(40):
            x = c
            for b in rng.choice(64, rng.integers(0, 5), replace=False).tolist():
                x ^= 1 << b
            fps.add(x - (1 << 64) if x >= 1 << 63 else x)
    fps = sorted(fps)
    frame = spark.createDataFrame([(f,) for f in fps], "id long").selectExpr(
        "id", "array(id) AS grid", "unhex(lpad(hex(id), 16, '0')) AS check"
    )
    mask = (1 << 64) - 1
    want = roots(fps, [(a, b) for a in fps for b in fps if a < b and ((a ^ b) & mask).bit_count() <= 3])
    for cell in (1024, 5):
        monkeypatch.setattr(simhash, "CELL", cell)
        got = {r.node: r.root for r in components(simhash.links(frame, 3, 1)).collect()}
        assert {f: got.get(f, f) for f in fps} == want


def test_no_documents(no_docs):
    assert simhash.simhash_components(no_docs).count() == 0
    assert simhash.keep_one(no_docs).count() == 0
    assert suffix_dedup.remove_repeats(no_docs).count() == 0
    assert suffix_dedup.strip(no_docs).columns == no_docs.columns


def test_one_of_each_group_stays(docs):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    # 5, 6 and 7 are alike, 13 and the row without an id are equal; texts without words are equal
    assert 5 in ids and 6 not in ids and 7 not in ids
    assert sum(i in (None, 13) for i in ids) == 1
    assert sum(i in (1, 2, 3) for i in ids) == 1
    assert ids.count(14) == 2 and {4, 8, 9, 10, 11, 12} <= set(ids)


def test_no_table_of_the_links_is_broadcast(docs, monkeypatch):
    """Small on disk, the exploded points of a few hundred thousand fingerprints are beyond the driver."""
    plans = []
    stored = simhash.durable

    def watched(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df)

    monkeypatch.setattr(simhash, "durable", watched)
    watched(simhash.keep_one(docs))
    joined = [p for p in plans if "Join" in p]
    assert len(joined) == 3 and not any("Broadcast" in p for p in joined)


def shingle_set(text, k=5):
    words = text.lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def edited_copies():
    """Texts with copies that are appended to, truncated or changed in one passage, on both sides of 0.8."""
    texts, passage = [], edge.prose(40, 999)
    for b in range(12):
        words = edge.prose(200 + 37 * b, 500 + b, 4000).split()
        n, other = len(words), edge.prose(2 * len(words), 700 + b, 4000).split()
        texts.append(" ".join(words))
        for part in (0.05, 0.1, 0.15, 0.19, 0.22, 0.24, 0.26, 0.3):
            m = int(part * n)
            texts.append(" ".join(words + other[:m]))
            texts.append(" ".join(words[: n - int(part * 0.82 * n)]))
            m = int(part * 0.45 * n)
            texts.append(" ".join(words[: n // 3] + other[-m:] + words[n // 3 + m :]))
        # one passage in many texts that are not alike
        texts.append(" ".join(other[:60]) + " " + passage)
    rng = np.random.default_rng(3)
    words = edge.prose(150, 800, 4000).split()
    for _ in range(60):
        copy = list(words)
        for at in rng.choice(150, 3, replace=False).tolist():
            copy[at] = f"new{rng.integers(1000)}"
        texts.append(" ".join(copy))
    return texts


def test_groups_equal_brute_force_jaccard(spark, monkeypatch):
    texts = edited_copies()
    sets = [shingle_set(t) for t in texts]
    linked = [
        (i, j)
        for j in range(len(texts))
        for i in range(j)
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])
    ]
    want = roots(range(len(texts)), linked)
    assert 12 < len(set(want.values())) < len(texts)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for cell, hot in ((1024, 1 << 17), (5, 0)):
        monkeypatch.setattr(simhash, "CELL", cell)
        monkeypatch.setattr(simhash, "HOT", hot)
        got = {r.id: r.component for r in simhash.near_duplicate_groups(frame).collect()}
        assert {i: (got[i], want[i]) for i in want if got[i] != want[i]} == {}


def test_the_stage_keeps_one_row_of_each_simhash_component(spark):
    texts = edited_copies()
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    prints = simhash.simhash([simhash.shingle_hashes(t, 3) for t in texts])[:, 0]
    apart = np.bitwise_count(prints[:, None] ^ prints[None, :])
    root = np.arange(len(texts))
    while True:
        least = np.where(apart <= 3, root[None, :], len(texts)).min(axis=1)
        if (least == root).all():
            break
        root = least
    kept = sorted(r.doc_id for r in simhash.keep_one(frame).collect())
    assert kept == np.unique(root).tolist() and len(kept) < len(texts)


def test_pairs_next_to_the_limit(spark):
    rows, want = [], {}
    for pair in range(60):
        # 80 of 100 shingles in common, or 79 of 101
        changed = 10 + pair % 2
        words = [f"w{pair}x{i}" for i in range(94)]
        rows.append((2 * pair, " ".join(words)))
        rows.append((2 * pair + 1, " ".join(words[:-changed] + [f"n{pair}x{i}" for i in range(changed)])))
        want |= {2 * pair: 2 * pair, 2 * pair + 1: 2 * pair + pair % 2}
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.id: r.component for r in simhash.near_duplicate_groups(frame).collect()} == want


def plain_removal(texts, length=200):
    data = [(t or "").encode() for t in texts]
    times = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        hit = np.zeros(len(d) + 1, np.int32)
        for i in range(len(d) - length + 1):
            if times[d[i : i + length]] > 1:
                hit[i] += 1
                hit[i + length] -= 1 if i + length <= len(d) else 0
        cover = np.cumsum(hit)[: len(d)] > 0
        kept = bytes(np.frombuffer(d, np.uint8)[~cover])
        spans = int((np.diff(np.concatenate(([0], cover.astype(int)))) == 1).sum())
        out.append((len(d), int(cover.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_repeats_against_brute_force(docs, monkeypatch):
    # counts of the long window dictionary stay small without the longest text
    rows = [r for r in edge.rows() if r[0] != 12]
    want = Counter((r[0], *w) for r, w in zip(rows, plain_removal([r[1] for r in rows])))
    for group, bucket, block in ((2048, 1 << 19, 1 << 17), (2, 300, 512)):
        monkeypatch.setattr(suffix_dedup, "GROUP", group)
        monkeypatch.setattr(suffix_dedup, "BUCKET", bucket)
        monkeypatch.setattr(suffix_dedup, "BLOCK", block)
        some = docs.where("doc_id IS NULL OR doc_id <> 12")
        got = suffix_dedup.digest(suffix_dedup.remove_repeats(some)).collect()
        assert Counter(tuple(r) for r in got) == want


def test_strip_keeps_columns_and_valid_text(docs):
    out = {r.doc_id: r for r in suffix_dedup.strip(docs).collect()}
    assert suffix_dedup.strip(docs).columns == docs.columns
    assert out[1].text is None and out[2].text == "" and out[6].text == "" and out[12].rest == "rest"
    assert out[9].kept == "kept" and "😀" not in out[9].text


def test_runs_of_large_grams_are_not_stored(docs, monkeypatch):
    """A job that stored them would move the texts once more than the last step does."""
    stored = []
    monkeypatch.setattr(suffix_dedup, "GROUP", 2)
    monkeypatch.setattr(suffix_dedup, "durable", lambda df, keep=suffix_dedup.durable: stored.append(df.columns) or keep(df))
    removed = suffix_dedup.remove_repeats(docs)
    plan = removed._jdf.queryExecution().executedPlan().toString()
    assert "large" in {c for columns in stored for c in columns} and "chunk" in plan
    assert "runs" not in {c for columns in stored for c in columns}
