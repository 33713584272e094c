import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from millrace.llm import binary_rows, mixing, packing
from millrace.llm.tokens import WordTokenizer, word_bpe_path


def water_fill(sizes, weights=(5, 2, 1), ceiling=3):
    """Targets by sharing again and again what is above the ceiling."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(ceiling * sizes[s] for s in full)
        open_ = [s for s in names if s not in full]
        share = {s: rest * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > ceiling * sizes[s] + 1e-9}
        if not over:
            return share | {s: ceiling * sizes[s] for s in full}
        full |= over


def test_mix(make_docs, odd_docs):
    rng = np.random.default_rng(4)
    rows = [(i, "w " * int(rng.integers(1, 60)), f"s{'abcdefg'[min(int(rng.exponential(1.5)), 6)]}") for i in range(100, 1100)]
    docs = make_docs(rows).unionByName(odd_docs)
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count()
    size = {(r["doc_id"], r["text"], r["source"]): len((r["text"] or "").split()) for r in docs.collect()}
    by_source = Counter()
    for r in docs.collect():
        by_source[r["source"]] += len((r["text"] or "").split())
    assert sorted(size.values())[-1] == max(r["size"] for r in got)
    target, taken, largest = {}, Counter(), Counter()
    for r in got:
        assert r["source_size"] == by_source[r["source"]] and 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        target[r["source"]] = r["target"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    expected = water_fill(by_source)
    for s, t in target.items():
        assert t == pytest.approx(expected[s])
        assert abs(taken[s] - t) <= largest[s] / 2 + 1e-6
    again = mixing.mix(docs.repartition(7)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_apply_mix(make_docs, odd_docs):
    marks = Counter()
    for r in mixing.mix(odd_docs).collect():
        marks[r["doc_id"], r["size"]] += r["copies"]
    out = mixing.apply_mix(odd_docs)
    assert out.columns == odd_docs.columns
    found = Counter((r["doc_id"], len((r["text"] or "").split())) for r in out.collect())
    assert found == Counter({k: v for k, v in marks.items() if v})
    assert mixing.mix(make_docs([])).count() == 0
    assert mixing.apply_mix(make_docs([])).count() == 0
    assert mixing.mix(make_docs([(1, None), (2, "")])).where("taken = 0").count() == 2


def test_mix_of_repeated_rows(make_docs):
    """A source made of one row many times misses its target by half of one row at most, and numbers are whole."""
    rows = [(1, "w " * 7, "a")] * 101 + [(2, "w " * 3, "a")] * 40 + [(3, "w " * 11, "b")] * 60 + [(4, "w " * 500, "c"), (None, "w " * 4, "b"), (None, "w " * 4, "b")]
    docs = make_docs(rows).repartition(5)
    taken, target = Counter(), {}
    for r in mixing.mix(docs).collect():
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert 0 <= r["copies"] <= 3
    for s, largest in (("a", 7), ("b", 11), ("c", 500)):
        assert abs(taken[s] - target[s]) <= largest / 2 + 1e-6
    found = Counter(r["source"] for r in mixing.apply_mix(docs).collect())
    assert found == +Counter({s: sum(r["copies"] for r in mixing.mix(docs).where(f"source = '{s}'").collect()) for s in "abc"})


def test_pivotal_rounding_keeps_the_mean(spark):
    """Over 400 sources of the same make-up each unit is taken as often as its probability says, and the words that a
    source takes vary by hardly more than a document, where independent rounding would spread over dozens."""
    p, mass = [0.1, 0.5, 0.5, 0.25, 0.9, 0.7, 0.35, 0.6], [3.0, 5.0, 8.0, 2.0, 4.0, 6.0, 7.0, 3.0]
    rows = [(f"s{s}", (100 * s + i, 1), mass[i], p[i]) for s in range(400) for i in range(8)]
    got = mixing.round_copies(spark.createDataFrame(rows, "source string, key struct<doc_id:bigint,size:bigint>, mass double, p double"), 8).collect()
    up, taken = Counter(), Counter()
    assert len(got) == len(rows)
    for r in got:
        s, i = divmod(r["key"]["doc_id"], 100)
        assert r["p"] in (0.0, 1.0)
        up[i] += r["p"]
        taken[s] += r["p"] * mass[i]
    for i in range(8):
        assert abs(up[i] / 400 - p[i]) <= 4 * (p[i] * (1 - p[i]) / 400) ** 0.5 + 0.04
    goal = sum(a * b for a, b in zip(p, mass))
    assert all(abs(t - goal) <= 4.001 for t in taken.values())


def plain_ids(texts):
    t = WordTokenizer(word_bpe_path()).tokenizer
    return [[*t.encode(x or "", add_special_tokens=False).ids, 1] for x in texts]


def test_word_tokenizer_equals_the_tokenizer():
    texts = ["Hello, world!! It's 3.14 -- don't", "ÉCOLÉ ﬁne ª² x y z \x1c a\x85b", "a." * 50, "", " \t\n", "İstanbul ΣΑΣ ǅ", "$$$ %%% &&& ab*** (c).", "x" * 5000, "日本語 テキスト。", "<|endoftext|> q", "I'll we're ''s 'S"]
    got = WordTokenizer(word_bpe_path()).encode_all([t.encode() for t in texts])
    assert [np.frombuffer(g, "<u4").tolist() + [1] for g in got] == plain_ids(texts)


def test_pack(make_docs, odd_docs):
    rng = np.random.default_rng(5)
    docs = make_docs([(i, "word " * int(rng.integers(0, 900))) for i in range(100, 400)]).unionByName(odd_docs)
    rows = packing.pack(docs).collect()
    ids = defaultdict(list)
    for r, i in zip(docs.collect(), plain_ids([r["text"] for r in docs.collect()])):
        ids[r["doc_id"]].append(i)
    pieces = Counter()
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        fits = [i for i in ids[r["doc_id"]] if len(i) == r["doc_tokens"] and zlib.crc32(np.array(i[r["start"]:r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"]]
        assert fits
        pieces[r["doc_id"]] += r["length"]
    assert pieces == Counter({d: sum(map(len, i)) for d, i in ids.items()})
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert sum(pieces.values()) / (2048 * len(by_sequence)) > 0.97
    assert packing.pack(make_docs([])).count() == 0


def test_pack_is_as_tight_as_a_plain_packer(make_docs):
    """Brute force beside it: best fit over all pieces, one after the other, needs hardly fewer sequences."""
    rng = np.random.default_rng(9)
    docs = make_docs([(i, "word " * int(min(rng.exponential(300), 1800))) for i in range(600)])
    rows = packing.pack(docs).collect()
    row, _ = binary_rows.best_fit(np.array([r["length"] for r in rows]), 2048)
    assert len({r["sequence_id"] for r in rows}) <= 1.02 * len(set(row.tolist())) + 1


def test_plan_places_everything():
    rng = np.random.default_rng(6)
    for n in (0, 1, 5, 400, 100_000):
        counts = np.bincount(rng.integers(1, 65, n), minlength=65)
        used = np.zeros(65, np.int64)
        windows = 0
        for steps, times in packing.plan(counts):
            assert sum(steps) <= 64 and times > 0
            np.add.at(used, steps, times)
            windows += times
        assert (used == counts).all()
        if n == 100_000:
            assert (counts * np.arange(65)).sum() / (64 * windows) > 0.995


def test_nnls_against_exact_solutions():
    rng = np.random.default_rng(7)
    for _ in range(20):
        a, x = rng.random((12, 6)), np.maximum(rng.standard_normal(6), 0)
        assert np.allclose(packing.nnls(a, a @ x), x, atol=1e-6)
    a, b = rng.standard_normal((15, 8)), rng.standard_normal(15)
    x = packing.nnls(a, b)
    slope = a.T @ (b - a @ x)
    assert (x >= 0).all() and (slope <= 1e-6).all() and np.allclose(slope[x > 0], 0, atol=1e-6)


def test_best_fit_takes_the_fullest_row_that_fits():
    rng = np.random.default_rng(8)
    lengths = rng.integers(1, 101, 300)
    row, offset = binary_rows.best_fit(lengths, 100)
    rooms, plain = [], np.zeros(300, int)
    for k in np.argsort(-lengths, kind="stable"):
        fits = [(room, r) for r, room in enumerate(rooms) if room >= lengths[k]]
        if fits:
            least = min(fits)[0]
            rooms[next(r for room, r in fits if room == least)] -= lengths[k]
        else:
            rooms.append(100 - lengths[k])
    assert sorted(Counter(row.tolist()).values()) and len(set(row.tolist())) == len(rooms)
    for r in set(row.tolist()):
        own = sorted((offset[k], lengths[k]) for k in np.flatnonzero(row == r))
        assert all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and own[0][0] == 0 and sum(own[-1]) <= 100


def test_packed_rows_round_trip(make_docs, odd_docs, tmp_path):
    rows = binary_rows.packed_rows(odd_docs, width=256, shard_tokens=2000)
    back = defaultdict(list)
    for r in rows.collect():
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == 256 and r["cu_seqlens"][:-1] == r["resets"] and r["cu_seqlens"][-1] == r["n_tokens"] and (ids[r["n_tokens"]:] == 0).all()
        for d, s, a, b in zip(r["doc_ids"], r["doc_starts"], r["cu_seqlens"], r["cu_seqlens"][1:]):
            back[d].append((s, ids[a:b].tolist()))
    source = odd_docs.collect()
    expected = defaultdict(list)
    for r, i in zip(source, plain_ids([r["text"] for r in source])):
        expected[r["doc_id"]] += [(s, i[s:s + 256]) for s in range(0, len(i), 256)]
    assert {d: sorted(p) for d, p in back.items()} == {d: sorted(p) for d, p in expected.items()}
    binary_rows.write_rows(rows, f"file://{tmp_path}/rows")
    assert odd_docs.sparkSession.read.parquet(f"file://{tmp_path}/rows").count() == rows.count()
    assert binary_rows.packed_rows(make_docs([])).count() == 0
