import hashlib
import random
import re

import numpy as np
import pytest

from farewise.llm import exact_dedup, near_dedup
from farewise.llm.common import mixed, times_step
from tests.llm.conftest import passage


def test_largest_id_stays(make):
    docs = make(["x", "y", "x", None, "", "x "], ids=[5, 2, 9, 1, 7, 3])
    index = exact_dedup.fresh_index(docs)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.deduplicate(docs, index).collect()}
    assert got == {5: (9, 2, False), 9: (9, 2, True), 2: (2, 1, True), 1: (7, 2, False), 7: (7, 2, True), 3: (3, 1, True)}
    row = exact_dedup.deduplicate(make(["é"]), exact_dedup.fresh_index(docs)).first()
    assert row.text_sha256 == hashlib.sha256("é".encode()).hexdigest()


def test_later_batches_meet_the_index(make):
    first = make(["x", "y"], ids=[1, 2])
    index = exact_dedup.fresh_index(first)
    exact_dedup.deduplicate(first, index).collect()
    second = make(["x", "z", "z"], ids=[8, 9, 10])
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.deduplicate(second, index).collect()}
    assert got == {8: (1, 2, False), 9: (10, 2, False), 10: (10, 2, True)}
    third = make(["x", "x", "z"], ids=[20, 21, 22])
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.deduplicate(third, index).collect()}
    assert got == {20: (1, 4, False), 21: (1, 4, False), 22: (10, 3, False)}
    assert index.totals().count() == 3
    plan = index.unseen(index.table().select("digest"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange hashpartitioning" not in plan


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_batches_of_one_table_equal_one_batch(make, odd, empty, batches):
    for docs in (make(["x", "y", "x", None, "", "x ", "y", "x"], ids=[5, 2, 9, 1, 7, None, 3, 4]), odd, empty):
        want = sorted(map(str, exact_dedup.deduplicate(docs, exact_dedup.fresh_index(docs)).collect()))
        index = exact_dedup.fresh_index(docs)
        assert sorted(map(str, exact_dedup.deduplicate_in_batches(docs, index, batches).collect())) == want


def test_exact_tables(odd, odd_texts, empty):
    index = exact_dedup.fresh_index(odd)
    rows = exact_dedup.deduplicate(odd, index).collect()
    assert len(rows) == len(odd_texts) and sum(r.kept for r in rows) == len({t or "" for t in odd_texts})
    kept = exact_dedup.keep_first_copies(odd, exact_dedup.fresh_index(odd))
    assert kept.columns == odd.columns and kept.count() == len({t or "" for t in odd_texts})
    assert exact_dedup.keep_first_copies(empty, exact_dedup.fresh_index(empty)).count() == 0


def test_a_hot_group_of_copies(make):
    texts = ["same"] * 1500 + [passage(k, 5) for k in range(1500)]
    docs = make(texts)
    rows = exact_dedup.deduplicate(docs, exact_dedup.fresh_index(docs)).collect()
    hot = [r for r in rows if r.group_size == 1500]
    assert len(hot) == 1500 and {r.keep_id for r in hot} == {1499} and sum(r.kept for r in hot) == 1


def test_signatures_equal_the_plain_algorithm():
    values = mixed(np.arange(1, 60, dtype=np.uint64))
    borders = np.array([0, 1, 4, 4, 59])
    got = near_dedup.super_minhash(values, borders, 24)
    for k, (a, b) in enumerate(zip(borders, borders[1:], strict=False)):
        best = [2**64 - 1] * 24
        for value in values[a:b]:
            places, value = list(range(24)), mixed(np.array([value]))
            for rank in range(24):
                stream = int(mixed(value + times_step(rank + 1))[0])
                pick = rank + (((stream & 0xFFFFFFFF) * (24 - rank)) >> 32)
                places[rank], places[pick] = places[pick], places[rank]
                best[places[rank]] = min(best[places[rank]], rank << 32 | stream >> 32)
        assert got[k].tolist() == best


def brute_components(texts, percent):
    def shingles(text):
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) if w]
        return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())

    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))
    changed = True
    links = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    while changed:
        changed = False
        for i, j in links:
            low = min(root[i], root[j])
            changed |= root[i] != low or root[j] != low
            root[i] = root[j] = low
    return [(len(s), r) for s, r in zip(sets, root, strict=True)]


def family(seed, n, edits, draw):
    base = passage(seed, 120).split()
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(draw.randrange(edits + 1)):
            words[draw.randrange(len(words))] = f"new{draw.randrange(10**6)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("percent", [80, 85])
def test_groups_equal_brute_force(make, percent, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_CLASSES", 8)
    draw = random.Random(11)
    texts = family(1, 60, 6, draw) + family(2, 30, 3, draw) + [passage(k, 50) for k in range(3, 20)]
    texts += ["", None, " \n", "One Two", "one two", "three", passage(1, 120), passage(1, 120).upper()]
    # A chain: each differs from the one before by a few words, the ends by many.
    words = passage(40, 150).split()
    for k in range(12):
        words[k * 12] = f"step{k}"
        texts.append(" ".join(words))
    draw.shuffle(texts)
    got = near_dedup.link_documents(make(texts), percent).orderBy("doc_id").collect()
    assert [(r.n_shingles, r.component_id) for r in got] == brute_components(texts, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_components_of_long_chains(spark):
    chain = [(i, i - 1) for i in range(1, 400)] + [(1000 + i, 1000) for i in range(1, 300)] + [(5000, 4000)]
    random.Random(2).shuffle(chain)
    links = spark.createDataFrame(chain, "a bigint, b bigint").repartition(16)
    got = dict(near_dedup.components(links).collect())
    assert got == {**{i: 0 for i in range(1, 400)}, **{1000 + i: 1000 for i in range(1, 300)}, 5000: 4000}


def test_near_tables(odd, odd_texts, empty, make):
    rows = near_dedup.link_documents(odd, 80)
    assert rows.count() == len(odd_texts)
    kept = near_dedup.keep_one_of_each(odd, 80)
    assert kept.columns == odd.columns
    assert near_dedup.keep_one_of_each(empty).count() == 0
    assert near_dedup.keep_one_of_each(make(["a b", "A  B", "c"])).count() == 2


def test_repeated_rows_are_compared_once(make):
    base = passage(3, 300)
    near = base.replace("the", "a", 1)
    docs = make([base] * 300 + [near] * 300, ids=[1] * 300 + [2] * 300)
    rows = near_dedup.link_documents(docs, percent=80).collect()
    assert len(rows) == 600 and {r.component_id for r in rows} == {1}
