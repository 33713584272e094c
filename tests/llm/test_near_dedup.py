import random

import pytest
from millrace.llm import simhash


def shingles(text, words=5):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[k:k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()


def survivors(rows):
    """The ids that stay, by the similarity of all pairs."""
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if group[a] != group[b] and 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = [new if g == old else g for g in group]
    return {min(i for (i, _), g in zip(rows, group) if g == x) for x in set(group)}


def texts(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def test_copies_in_a_family_of_templates(make_docs):
    rng = random.Random(11)
    template = texts(rng, 300)
    rows = []
    for _ in range(120):  # similarities of about 0.6 to 0.78 to each other
        own = template + texts(rng, rng.choice([42, 60, 75]))
        rows.append((len(rows), " ".join(own)))
    for k in rng.sample(range(120), 40):  # and copies of some, at 0.9
        own = rows[k][1].split()
        for p in rng.sample(range(0, 300, 12), 4):
            own[p] = "changed"
        rows.append((len(rows), " ".join(own)))
    rng.shuffle(rows)
    expected = survivors(rows)
    assert 60 < len(expected) < 140
    assert {r["doc_id"] for r in simhash.drop_near_duplicates(make_docs(rows)).collect()} == expected


def test_a_repeated_line_counts_once(make_docs):
    rng = random.Random(12)
    line = "this very line is in all of these texts again and again "
    rows = [(k, line * 60 + " ".join(texts(rng, 60))) for k in range(10)]  # alike with repeats, sets are not
    own = " ".join(texts(rng, 100))
    passage = " ".join(own.split()[20:40])
    rows += [(20, own), (21, own + f" {passage}" * 30)]  # the other way around
    assert {r["doc_id"] for r in simhash.drop_near_duplicates(make_docs(rows)).collect()} == survivors(rows) == {*range(10), 20}


def test_short_texts_and_exactly_four_fifths(make_docs):
    rng = random.Random(13)
    rows = []
    for n in [8, 9, 10, 12, 20, 40] * 15:
        own = texts(rng, n)
        rows += [(len(rows), " ".join(own)), (len(rows) + 1, " ".join([*own, "more"]))]
    for _ in range(60):
        own = texts(rng, 404)  # 400 shingles; 100 at the end make it 4 of 5, 101 less than that
        for more in (100, 101):
            own_too = texts(rng, 404)
            rows += [(len(rows), " ".join(own_too)), (len(rows) + 1, " ".join(own_too + texts(rng, more)))]
    assert {r["doc_id"] for r in simhash.drop_near_duplicates(make_docs(rows)).collect()} == survivors(rows)


@pytest.mark.parametrize("bound", ["BLOCK", "BLOCK_SHINGLES"])
def test_a_chain_of_copies_across_blocks(make_docs, monkeypatch, bound):
    monkeypatch.setattr(simhash, bound, {"BLOCK": 4, "BLOCK_SHINGLES": 500}[bound])
    rng = random.Random(14)
    own = texts(rng, 200)
    rows = []
    for k in range(60):  # each like the next; the first and the last have nothing in common
        own = own[10:] + texts(rng, 10)
        rows.append((k, " ".join(own)))
    rng.shuffle(rows)
    assert survivors(rows) == {0}
    assert {r["doc_id"] for r in simhash.drop_near_duplicates(make_docs(rows)).collect()} == {0}
