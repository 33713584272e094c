import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from millrace.llm import common, exact_dedup, simhash, substring_dedup
from millrace.llm.common import components


def normal(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_exact_marks(odd_docs):
    rows = exact_dedup.mark_duplicates(odd_docs).collect()
    texts = [(r["doc_id"], normal(r["text"])) for r in odd_docs.collect()]
    assert len(rows) == len(texts)
    for h in {r["text_sha256"] for r in rows}:
        same = [r for r in rows if r["text_sha256"] == h]
        ids = [i for i, t in texts if hashlib.sha256(t.encode()).hexdigest() == h]
        known = [i for i in ids if i is not None]
        assert sum(r["kept"] for r in same) == 1
        assert {r["group_size"] for r in same} == {len(ids)}
        assert {r["keep_id"] for r in same} == {min(known) if known else None}
        assert next(r for r in same if r["kept"])["doc_id"] == same[0]["keep_id"]


def test_exact_index_remembers(make_docs, tmp_path):
    spark = make_docs([]).sparkSession
    index = exact_dedup.DigestIndex(spark, f"file://{tmp_path}/index", 3)
    assert {r["doc_id"] for r in exact_dedup.drop_duplicates(make_docs([(5, "one"), (6, "two"), (7, "two")]), index).collect()} == {5, 6}
    again = exact_dedup.DigestIndex(spark, f"file://{tmp_path}/index", 3)
    rows = {r["doc_id"]: r for r in exact_dedup.mark_duplicates(make_docs([(1, "two"), (2, "three"), (3, "three")]), again).collect()}
    assert {i: (r["keep_id"], r["kept"]) for i, r in rows.items()} == {1: (6, False), 2: (2, True), 3: (2, False)}
    assert again.read().count() == 3


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_exact_batches_and_compaction(make_docs, tmp_path, monkeypatch, batches):
    """However many batches a call is dealt to, and however often the index is compacted, the result is the same."""
    monkeypatch.setattr(exact_dedup, "BATCHES", batches)
    monkeypatch.setattr(exact_dedup, "group_digests", lambda d, i, b, f=exact_dedup.group_digests: f(d, i, b, batches))
    monkeypatch.setattr(exact_dedup, "COMPACT_AT", 1)
    rng = random.Random(4)
    rows = [(rng.randrange(60), f"text {rng.randrange(25)}") for _ in range(90)] + [(None, "text 3"), (None, "alone"), (70, None), (71, "")]
    index = exact_dedup.DigestIndex(make_docs([]).sparkSession, f"file://{tmp_path}/index", 2)
    got = sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in exact_dedup.mark_duplicates(make_docs(rows), index).collect())
    ids = {}
    for i, t in rows:
        ids.setdefault(t or "", []).append(i)
    assert got == sorted((str(i), str(min((x for x in ids[t or ""] if x is not None), default=None)), len(ids[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    assert index.read().count() == len(ids) == exact_dedup.DigestIndex(index.spark, index.path, 2).read().count()
    assert exact_dedup.mark_duplicates(make_docs([(900, "text 3"), (901, "new")]), index).where("kept").count() == 1
    assert index.read().count() == len(ids) + 1 and index.generation > 0


def test_exact_call_again_after_a_failure(make_docs, tmp_path):
    """The same batch again gives the same rows, and adds nothing twice."""
    index = exact_dedup.DigestIndex(make_docs([]).sparkSession, f"file://{tmp_path}/index", 2)
    docs = make_docs([(1, "a"), (2, "a"), (3, "b"), (4, "c")])
    cut = exact_dedup.group_digests(docs.selectExpr("doc_id", "sha2(text, 256) AS digest", "doc_id AS tag").where("doc_id < 3"), index, "night")  # as far as it came
    assert cut.count() == 1
    first, second = (sorted(map(tuple, exact_dedup.mark_duplicates(docs, index, "night").collect())) for _ in range(2))
    assert first == second and [r[3] for r in first] == [True, False, True, True] and index.read().count() == 3
    assert not exact_dedup.mark_duplicates(docs, index, "next").where("kept").count()


def test_exact_drop_keeps_columns_and_empties(odd_docs, make_docs):
    kept = exact_dedup.drop_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    marks = exact_dedup.mark_duplicates(odd_docs)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in marks.where("kept").collect())
    assert exact_dedup.mark_duplicates(make_docs([])).count() == 0
    assert exact_dedup.drop_duplicates(make_docs([])).count() == 0


def fingerprint(text, words=4):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[k:k + words]), 42) for k in range(max(1, len(w) - words + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_against_brute_force(make_docs, odd_docs):
    rng = random.Random(3)
    base = [" ".join(rng.choice(["ab", "cd", "ef", "gh", "ij"]) for _ in range(40)) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(12, 70):
        w = rng.choice(base).split()
        w[rng.randrange(40)] = rng.choice(["zz", "ab"])
        rows.append((i, " ".join(w)))
    docs = make_docs(rows).unionByName(odd_docs)
    got = simhash.near_groups(docs).collect()
    source = docs.collect()
    fps = [fingerprint(r["text"]) for r in source]
    group = list(range(len(fps)))
    for _ in range(len(fps)):
        group = [min(g for g, f in zip(group, fps) if (f ^ own).bit_count() <= 4) for own in fps]
    ids = [r["doc_id"] for r in source]
    smallest = {g: min((i for i, x in zip(ids, group) if x == g and i is not None), default=None) for g in group}
    expected = sorted((str(i), f"{f:016x}", smallest[g]) for i, f, g in zip(ids, fps, group))
    assert sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in got) == expected
    assert simhash.near_groups(make_docs([])).count() == 0


def test_link_splits_hot_cells(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CELL", 8)
    rng = np.random.default_rng(1)
    centre = int(rng.integers(0, 2**62))
    fps = {centre} | {centre ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 63, (60, 2))} | {int(x) for x in rng.integers(0, 2**62, 40)}
    edges = simhash.link(spark.createDataFrame([(f,) for f in fps], "fp bigint"), 4)
    label = {r["node"]: r["label"] for r in components(edges).collect()}
    group = {f: f for f in fps}
    for _ in range(6):
        group = {f: min(group[g] for g in fps if (f ^ g).bit_count() <= 4) for f in fps}
    assert all(label.get(f, f) == group[f] for f in fps)


@pytest.mark.parametrize("block", [1 << 17, 20])
def test_components_of_a_chain_and_a_hub(spark, monkeypatch, block):
    monkeypatch.setattr(common, "BLOCK_EDGES", block)
    chain = [(k, k + 1) for k in range(50)]
    hub = [(1000, 1000 + k) for k in range(1, 60)]
    label = {r["node"]: r["label"] for r in components(spark.createDataFrame(chain + hub, "a bigint, b bigint")).collect()}
    assert label == {k: 0 for k in range(51)} | {1000 + k: 1000 for k in range(60)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_near_duplicates_by_similarity(make_docs, odd_docs):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(3000)]
    rows, groups = [], []
    for g in range(25):
        base = [rng.choice(words) for _ in range(300)]
        ids = []
        for c in range(3):
            w = list(base)
            for p in rng.sample(range(300), c):  # up to two words changed: similarity over 0.9
                w[p] = "changed"
            ids.append(len(rows))
            rows.append((len(rows), " ".join(w)))
        far = list(base)
        for p in range(0, 300, 8):  # every shingle but few changed
            far[p] = rng.choice(words)
        groups.append((ids, len(rows)))
        rows.append((len(rows), " ".join(far)))
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(make_docs(rows)).collect()}
    assert kept == {i for ids, far in groups for i in (ids[0], far)}
    out = simhash.drop_near_duplicates(odd_docs)
    assert out.columns == odd_docs.columns and out.where("doc_id = 4").count() <= 1
    assert simhash.drop_near_duplicates(make_docs([])).count() == 0


def brute_removal(rows):
    seen, out = {}, []
    for i, t in rows:
        b = (t or "").encode()
        for s in range(len(b) - 49):
            w = b[s:s + 50]
            key = (i is None, i or 0)
            seen[w] = min(seen.get(w, key), key)
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 49):
            if seen[b[s:s + 50]] < (i is None, i or 0):
                gone[s:s + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((str(i), len(b), sum(gone), sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("block,buckets,every", [(1 << 20, 4, 256), (600, 4, 1), (300, 40, 1)])
def test_repeated_passages_against_brute_force(make_docs, monkeypatch, block, buckets, every):
    """Also where splitters fall inside of runs that agree in all they need."""
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", block)
    monkeypatch.setattr(substring_dedup, "SAMPLE_EVERY", every)
    rng = random.Random(11)
    letters = "abcdefgh é"
    passage = ["".join(rng.choice(letters) for _ in range(n)) for n in (49, 50, 51, 80, 200, 33)]
    rows = []
    for i in range(60):
        parts = ["".join(rng.choice(letters) for _ in range(rng.randrange(40)))]
        for _ in range(rng.randrange(4)):
            p = rng.choice(passage)
            parts += [p[rng.randrange(3):], "".join(rng.choice(letters) for _ in range(rng.randrange(20)))]
        rows.append((i, "".join(parts)))
    rows += [(100, None), (101, ""), (None, passage[4]), (None, passage[4] + "x"), (102, "ab" * 90), (103, "z" + "ab" * 60), (104, "\0" * 120), (105, "\0" * 70), (50, passage[3]), (106, passage[4] * 3)]
    common = passage[3][:28]  # many texts go on from it in their own way, some in the same
    rows += [(200 + i, rng.choice("pqrs") * 5 + common + "".join(rng.choice("xy") for _ in range(7)) + "t" * 30) for i in range(60)]
    rng.shuffle(rows)
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substring_dedup.remove_repeats(make_docs(rows), buckets=buckets).collect())
    assert got == brute_removal(rows)


def test_repeated_passages_have_small_rows(spark, monkeypatch):
    """A block's documents are no one row of megabytes, and come back in order from many."""
    rng = random.Random(5)
    passage = rng.randbytes(400).hex()
    rows = [(i, rng.randbytes(30_000).hex() + chr(33 + i) + passage + chr(33 + i) + rng.randbytes(20).hex()) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    sizes = [len(r["payload"]) for r in substring_dedup._build(docs.coalesce(1), 4).where("kind = 'docs'").select("payload").collect()]
    assert max(sizes) <= 1 << 18 and sum(sizes) > 1 << 20
    monkeypatch.setattr(substring_dedup, "PIECE", 1000)
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substring_dedup.remove_repeats(docs.coalesce(1), buckets=4).collect())
    assert [(r[0], r[2], r[4]) for r in got] == sorted((str(i), 800 * (i > 0), hashlib.sha256((t.replace(passage, "") if i else t).encode()).hexdigest()) for i, t in rows)


def test_repeated_passages_of_odd_tables(odd_docs, make_docs):
    rows = substring_dedup.remove_repeats(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert substring_dedup.remove_repeats(make_docs([])).count() == 0


@pytest.mark.parametrize("n,width,letters", [(500, 19, 2), (3000, 50, 2), (2000, 76, 1), (1500, 8, 256), (0, 16, 2), (1, 16, 2)])
def test_suffix_order_is_the_order_of_bytes(n, width, letters):
    rng = np.random.default_rng(2)
    rows = (rng.integers(0, letters, (n, width)) * (255 // max(letters - 1, 1))).astype(np.uint8)
    rows[: n // 2, : width // 2] = 7
    assert [bytes(r) for r in rows[substring_dedup.suffix_order(rows)]] == sorted(bytes(r) for r in rows)


def test_link_cell_bounds_by_segments():
    """The Manhattan distance of the embeddings is the sum of differences of popcounts, and never more than the bits that differ."""
    fps = np.random.default_rng(3).integers(0, 1 << 63, 200, np.uint64)
    counts = np.stack([np.bitwise_count(fps >> np.uint64(2 * k) & np.uint64(3)) for k in range(32)], 1).astype(int)
    e = simhash.embed(fps)
    between = np.bitwise_count(e[:, None] ^ e[None])
    assert (between == np.abs(counts[:, None] - counts[None]).sum(2)).all() and (between <= np.bitwise_count(fps[:, None] ^ fps[None])).all()
