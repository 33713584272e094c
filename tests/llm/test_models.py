import heapq
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
from millrace.llm import ann, chat, lm_score, quality
from pyspark.sql import functions as F


def held(i, folds, value):
    return zlib.crc32(("" if i is None else str(i)).encode()) % folds == value


def plain_ppm(train, text, order):
    """Prediction by partial matching, one byte after the other."""
    counts = defaultdict(Counter)
    pad = lm_score.END * order
    for t in train:
        s = pad + t + lm_score.END
        for p in range(order, len(s)):
            for k in range(order + 1):
                counts[s[p - k:p]][s[p]] += 1
    total, s = 0.0, pad + text + lm_score.END
    for p in range(order, len(s)):
        out = set()
        for k in range(order, -1, -1):
            c = {b: n for b, n in counts.get(s[p - k:p], {}).items() if b not in out}
            if not c:
                continue
            t = sum(c.values())
            if s[p] in c:
                total += math.log10((c[s[p]] - lm_score.DISCOUNT) / t)
                break
            total += math.log10(lm_score.DISCOUNT * len(c) / t)
            out |= set(c)
        else:
            total -= math.log10(256 - len(out))
    return total


@pytest.mark.parametrize("order,block,asks", [(5, 1 << 20, 128), (2, 40, 128), (3, 40, 2)])
def test_lm_scores_against_brute_force(make_docs, monkeypatch, order, block, asks):
    monkeypatch.setattr(lm_score, "BLOCK_BYTES", block)
    monkeypatch.setattr(lm_score, "ASKS", asks)
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(["The", "the", "of", "tion", "é", "a|b"]) for _ in range(rng.randrange(12)))) for i in range(40)]
    rows += [(90, None), (91, ""), (None, "The end"), (92, "Zebra quux \x00 of"), (92, "Zebra quux \x00 of"), (93, "あい the\tthe\n")]
    docs = [(i, (t or "").encode().lower().split()) for i, t in rows]
    train = [w for i, w in docs if not held(i, 7, 2)]
    c = Counter(x for w in train for x in w) + Counter({None: len(train)})
    n, v = sum(c.values()), len(c)
    expected = sorted(
        (str(i), held(i, 7, 2), len(w) + 1, sum(c[x] > 0 for x in [*w, None]), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in [*w, None]), 4),
         round(plain_ppm([b" ".join(x) for x in train], b" ".join(w), order), 6)) for i, w in docs)
    got = sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4), round(r["score"], 6)) for r in lm_score.score(make_docs(rows), order=order).collect())
    for g, e in zip(got, expected, strict=True):
        assert g[:5] == e[:5] and g[5] == pytest.approx(e[5], abs=2e-4) and g[6] == pytest.approx(e[6], abs=2e-6)


def test_lm_of_odd_tables(odd_docs, make_docs):
    rows = lm_score.score(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(r["score"] < 0 and math.isfinite(r["score"]) for r in rows)
    assert lm_score.score(make_docs([])).count() == 0
    nothing = next(i for i in range(100) if held(i, 7, 2))
    r = lm_score.score(make_docs([(nothing, "ab")])).first()
    assert r["train_tokens"] == 0 and r["n_known"] == 0 and r["score"] == pytest.approx(-3 * math.log10(256))


def test_gram_scores_are_a_distribution():
    rng = np.random.default_rng(3)
    raw = rng.integers(97, 101, 400, dtype=np.uint8).tobytes()
    gram, _ = lm_score._grams([raw], 3)
    known, count = np.unique(gram, return_counts=True)
    pairs = np.zeros((256, 256), np.int64)
    np.add.at(pairs.reshape(-1), known & 0xFFFF, count)
    context = int.from_bytes(b"abc")
    every = (context << 8) + np.arange(256)
    code = np.union1d(known, every)
    n = np.zeros(len(code), np.int64)
    n[np.searchsorted(code, known)] = count
    p = 10 ** lm_score.gram_scores(code, n, 3, pairs)[np.searchsorted(code, every)]
    assert p.sum() == pytest.approx(1)


def test_quality(spark, make_docs, odd_docs):
    rng = random.Random(12)
    good = lambda: " ".join(rng.choice(["the", "river", "house", "green", "walked", "often"]) for _ in range(60)) + "."
    bad = lambda: rng.choice([lambda: good().upper().replace(" ", "!! "), lambda: "word " * 60, lambda: " | ".join(good().split())])()
    rows = [(i, bad() if i % 4 == 0 else good()) for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(600)], "doc_id bigint, quality int, toxic int")
    docs = make_docs(rows)
    model = quality.fit(docs, labels)
    got = quality.score(docs.unionByName(odd_docs), model).collect()
    assert len(got) == 600 + odd_docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    test = [r for r in got if r["doc_id"] is not None and r["doc_id"] >= 20 and held(r["doc_id"], 5, 0)]
    assert all(r["held_out"] for r in test) and np.mean([r["predicted"] == int(r["doc_id"] % 4 != 0) for r in test]) > 0.97
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in quality.score(docs, model).where("predicted = 1").collect()}
    assert quality.fit(docs, labels) == model
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality.fit(docs, flipped) == model  # held-out labels are not looked at


def plain_statistics(t):
    words, lines = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w], t.split("\n")
    n, chars, c = max(len(words), 1), max(len(t), 1), lambda p: len(regex.findall(p, t))
    return [math.log1p(len(t)), math.log1p(len(words)), len(t) / n, c(r"\p{Lu}") / chars, c("[0-9]") / chars, c(r"[^\p{L}\p{N}\x20\x09-\x0D.,;:'!|]") / chars, c("!") / n, c(r"\|") / n, c("[.?!]") / n,
            len(set(words)) / n, sum(a == b for a, b in zip(words, words[1:])) / n, len(set(lines)) / len(lines), len(t) / len(lines)]


def test_quality_against_plain_python(spark, make_docs, odd_docs):
    """Statistics one by one, the rules of a model as conditions, and their weights added up."""
    texts = ["", "A b  B b\tb\n\n12.5% | || ǅ é!", "x\x1cy \u00a0z", "İΣ #$ 日本 日本\n日本 日本.", "no no No? ...\r\nend\n"]
    docs = make_docs(list(enumerate(texts))).unionByName(odd_docs)
    rows = quality.with_statistics(docs, "text", "stats").select("text", "stats.*").collect()
    for r in rows:
        assert [r[n] for n in quality.STATISTICS] == pytest.approx(plain_statistics(r["text"] or "")), r["text"]
    rng = np.random.default_rng(2)
    x = np.array([[r[n] for n in quality.STATISTICS] for r in rows])
    x = np.vstack([x + 0.01 * rng.standard_normal(x.shape) for _ in range(20)])
    model = quality.fit_rules(x, (x[:, 2] + x[:, 9] > np.median(x[:, 2] + x[:, 9])).astype(float), list(quality.STATISTICS))
    assert 0 < len(model.weights) < 200
    scores = {(r["doc_id"], r["score"]) for r in quality.score(docs, model).collect()}
    for r in docs.collect():
        s = dict(zip(quality.STATISTICS, plain_statistics(r["text"] or "")))
        margin = model.intercept + sum(w for rule, w in model.weights if all((s[n] > v) == above for n, above, v in rule.terms))
        assert any(i == r["doc_id"] and v == pytest.approx(1 / (1 + math.exp(-margin))) for i, v in scores)


def test_quality_of_conflicting_labels_and_repeated_ids(spark, make_docs):
    """Each pair of a document and a label counts once, so equal numbers of both labels pull to the middle."""
    docs = make_docs([(1, "a b"), (1, "a b"), (2, "c d"), (3, "e f")])
    labels = spark.createDataFrame([(i, q) for i in (1, 2, 3) for q in (0, 1)], "doc_id bigint, quality int")
    got = quality.score(docs, quality.fit(docs, labels)).collect()
    assert len(got) == 4 and all(r["score"] == pytest.approx(0.5, abs=1e-6) for r in got)


def test_quality_sample_is_bounded_and_stable(spark, make_docs):
    docs = make_docs([(i, ("good text " if i % 2 else "BAD!! ") * 20) for i in range(400)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id bigint, quality int")
    a, b = (quality.fit(docs.repartition(k), labels.repartition(k), sample=100) for k in (1, 5))
    assert a == b and a != quality.fit(docs, labels, sample=399)


def test_quality_without_labels(spark, make_docs):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    model = quality.fit(make_docs([(1, "a")]), none)
    assert {r["score"] for r in quality.score(make_docs([(1, "a"), (2, None)]), model).collect()} == {0.5}
    assert quality.score(make_docs([]), model).count() == 0


def test_lasso_conditions():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2, (400, 12)).astype(float)
    y = (x[:, 0] + x[:, 1] + rng.random(400) > 1.3).astype(float)
    b, w = quality.lasso_logistic(x, y, 0.01, 20_000)
    slope = x.T @ (1 / (1 + np.exp(-(x @ w + b))) - y) / 400
    assert np.all(np.abs(slope) <= 0.01 + 1e-4) and np.allclose(slope[w != 0], -0.01 * np.sign(w[w != 0]), atol=1e-3) and (w == 0).any()


@pytest.mark.parametrize("sample,part_rows,fan", [(8192, 10_000, 8), (600, 40, 8), (300, 40, 2)])
def test_neighbours_against_brute_force(spark, monkeypatch, sample, part_rows, fan):
    monkeypatch.setattr(ann, "FAN_BITS", fan)
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((16, 12))
    x = (centres[rng.integers(0, 16, 800)] + 0.4 * rng.standard_normal((800, 12))).astype(np.float32)
    x[100:160] = x[100]
    rows = [(i, v.tolist(), 1, "k") for i, v in enumerate(x)]
    odd = [(900, None), (901, [0.0] * 12), (902, [float("nan")] + [1.0] * 11), (903, [None] + [1.0] * 11), (904, [float("inf")] * 12), (905, [1.0, 2.0]), (920, []), (None, x[3].tolist()), (40, x[40].tolist())]
    table = spark.createDataFrame(rows + [(i, v, 1, "k") for i, v in odd], "vec_id bigint, embedding array<float>, rank int, key string")
    got = defaultdict(dict)
    for r in ann.search(table, part_rows=part_rows, sample=sample).collect():
        got[r["query_id"]][r["rank"]] = (r["vec_id"], r["score"])
    a = x.astype(np.float64)
    hits = total = 0
    assert set(got) == set(range(0, 800, 20))
    for q, own in got.items():
        s = a @ a[q]
        order = [int(i) for i in np.lexsort((np.arange(800), -np.round(s, 9))) if i != q][:20]
        assert sorted(own) == list(range(1, 21)) and all(abs(s[i] - v) < 1e-9 for i, v in own.values())
        if part_rows == 10_000:
            assert [own[k][0] for k in range(1, 21)] == order
        hits += len(set(order) & {i for i, _ in own.values()})
        total += 20
    assert hits / total >= 0.9


def test_neighbours_of_few(spark):
    ddl = "vec_id bigint, embedding array<float>"
    assert ann.search(spark.createDataFrame([], ddl)).count() == 0
    assert ann.search(spark.createDataFrame([(20, [1.0, 0.0])], ddl)).count() == 0
    got = ann.search(spark.createDataFrame([(20, [1.0, 0.0]), (1, [0.5, 0.0]), (2, [0.5, 0.0])], ddl)).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"])] == [(20, 1, 1, 0.5), (20, 2, 2, 0.5)]


def test_repeated_vectors_in_many_parts_and_large_numbers(spark):
    rng = np.random.default_rng(5)
    x = (1e15 * rng.standard_normal((400, 6))).astype(np.float32)
    x[200:] = x[:200]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += rows[:50]
    got = defaultdict(list)
    for r in ann.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), part_rows=20, recall=1.0, k=5).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    a = x.astype(np.float64)
    for q, own in got.items():
        s = np.einsum("ij,j->i", a, a[q])
        s[q] = -np.inf
        best = sorted(range(400), key=lambda i: (-s[i], i))[:5]
        own = sorted(own)
        assert [r for r, *_ in own] == [1, 2, 3, 4, 5]
        assert np.allclose([v for *_, v in own], s[best], rtol=1e-12)


def test_levels_of_parts():
    assert ann.part_bits(1000, 1024) == [0] and ann.part_bits(60_000, 1024) == [6]
    assert sum(ann.part_bits(10**9, 1024)) == 20 and max(ann.part_bits(10**9, 1024)) <= ann.FAN_BITS


def test_parts_are_balanced():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((500, 8))
    part = ann.balanced_parts(500, *ann.neighbour_graph(x), 3)
    assert len(np.bincount(part)) == 8 and np.ptp(np.bincount(part)) <= 3


def plain_repair_cost(roles):
    """The cheapest repair, from the rules as they are told: a conversation is an optional system turn, then user and
    assistant in turn, ending with the assistant; merging costs 1, an empty turn 2, another role 3.  Dijkstra
    over (turns used, role of the last turn), with no table of the code's."""
    follows = {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
    heap, done = [(0, 0, "")], set()
    while heap:
        cost, used, last = heapq.heappop(heap)
        if (used, last) in done:
            continue
        done.add((used, last))
        if used == len(roles) and last in ("assistant", ""):
            return cost
        for nxt in follows[last]:
            heapq.heappush(heap, (cost + 2, used, nxt))  # an empty turn
            if used < len(roles):
                heapq.heappush(heap, (cost + 3 * (nxt != roles[used]), used + 1, nxt))
        if last and used < len(roles):
            heapq.heappush(heap, (cost + 1 + 3 * (last != roles[used]), used + 1, last))
    raise AssertionError


def cost_of(actions):
    return sum({"insert": 2, "keep": 0}.get(a, ("relabel" in a) * 3 + ("merge" in a)) for a in actions)


KNOWN = {"system": "system", "user": "user", "assistant": "assistant", "human": "user"}


@pytest.mark.parametrize("parts", [1, 5])
def test_chat_repair(spark, parts):
    rng = random.Random(6)
    names = ["system", "user", "assistant", "tool", None, "Human"]
    rows = []
    for c in range(40):
        rows += [(c, t, rng.choice(names), f"m{c}-{t}") for t in range(rng.randrange(1, 7))]
    rows += [(502, 1, "user", "long " * 100_000), (502, 2, "assistant", ""), (502, 3, "", "")]
    rows += [(500, t % 50, rng.choice(names), "hot") for t in range(300)] + [(None, 1, "user", None), (None, None, "assistant", ""), (501, 1, "user", "x"), (501, 1, "user", "x")]
    turns = spark.createDataFrame([(*r, 1, "d") for r in rows], "conv_id bigint, turn bigint, role string, text string, part int, position string")
    got = defaultdict(list)
    for r in chat.repair(turns, parts=parts).collect():
        got[r["conv_id"]].append(r)
    source = defaultdict(list)
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")
    for r in sorted(rows, key=key):
        source[r[0]].append(r)
    for c, own in source.items():
        out = sorted(got[c], key=lambda r: (r["position"], r["piece"]))
        assert [r["position"] for r in out if r["action"] != "insert"] == list(range(len(own)))
        assert cost_of([r["action"] for r in out]) == plain_repair_cost([KNOWN.get((r[2] or "").lower()) for r in own])
        text = ""
        shown = []
        for r in out:
            merged = "merge" in r["action"]
            if not merged:
                shown.append(r["role"])
            text += r["rendered"]
        rest = shown[1:] if shown[0] == "system" else shown
        assert rest == ["user", "assistant"] * (len(rest) // 2) and rest
        assert text.endswith("<|end|>\n") and text.count("<|end|>") == len(shown)
        bare = [re.sub(r"<\|[a-z]+\|>\n", "", r["rendered"]).removeprefix("\n\n" if "merge" in r["action"] else "") for r in out]
        assert [t for t, r in zip(bare, out) if r["action"] != "insert"] == [r[3] or "" for r in own]


def test_chat_repair_does_not_depend_on_parts(spark):
    rng = random.Random(8)
    rows = [(rng.randrange(6), rng.randrange(40), rng.choice(["user", "assistant", "system", "x"]), str(rng.randrange(3))) for _ in range(400)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    one, many = (sorted(map(tuple, chat.repair(turns, parts=p).collect())) for p in (1, 9))
    assert one == many
    assert chat.repair(turns.limit(0)).count() == 0
