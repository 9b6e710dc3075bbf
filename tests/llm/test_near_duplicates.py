import random
import re

import pytest

from docloom.llm import near_duplicates as N

TEXT = "id string, scope bigint, text string, kind string, similarity double, uid string"


def bare(t, k):
    lines = ["".join(re.findall(r"[^\W_]+", x.lower())) for x in t.split("\n")]
    return "\n".join(sorted(x for x in lines if x)) if k == "table" else "".join(lines)


def runs(t, run):
    w = re.findall(r"[^\W_]+", t.lower())
    return {tuple(w[j : j + run]) for j in range(len(w) - run + 1)}


def brute(rows, threshold, run):
    """All pairs of one scope, copies of each other aside."""
    all_ = {(i, s, t, k) for i, s, t, k, *_ in rows if i is not None and t is not None}
    sets = [(i, s, bare(t, k), runs(t, run)) for i, s, t, k in sorted(all_, key=str)]
    out = set()
    for a, s, x, p in sets:
        for b, r, y, q in sets:
            if s == r and a < b and x != y and p and q and len(p & q) / len(p | q) >= threshold:
                out.add((a, b))
    return out


def corpus(seed, n, scopes, words=40):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    rows, texts = [], []
    for i in range(n):
        if texts and rng.random() < 0.6:
            w = rng.choice(texts).split()
            for _ in range(rng.randint(0, 6)):
                at = rng.randrange(len(w) + 1)
                w[at : at + rng.randint(0, 2)] = [rng.choice(vocabulary) for _ in range(rng.randint(0, 2))]
            if rng.random() < 0.3:
                cut = rng.randrange(len(w) + 1)
                w = w[cut:] + w[:cut]
        else:
            w = [rng.choice(vocabulary) for _ in range(rng.randint(1, words))]
        text = " ".join(w)
        texts.append(text)
        rows.append((f"i{i:04d}", rng.choice(scopes), text.upper() if rng.random() < 0.2 else text, rng.choice(["content", "table"]), 0.0, "u"))
    return rows


@pytest.mark.parametrize("scopes", [[None], [1, 2, 3, 4, 5, 6, 7, 8, 9, 10], [7], [None, 1, 2]])
@pytest.mark.parametrize("threshold,run", [(0.6, 3), (0.8, 5)])
def test_all_pairs_agree_with_brute_force(spark, scopes, threshold, run):
    rows = corpus(len(scopes) + run, 200, scopes)
    rows += rows[:5] + [("n1", None, None, "content", 0.0, ""), (None, None, "w1 w2 w3", "content", 0.0, ""), ("n2", 1, "", None, 0.0, ""), ("n3", 1, "- !", "table", 0.0, "")]
    got = {(r.first_id, r.second_id) for r in N.similar_pairs(spark.createDataFrame(rows, TEXT), threshold, run).collect()}
    assert got == brute(rows, threshold, run)


def test_one_hot_family_is_not_lost(spark):
    base = " ".join(f"b{i}" for i in range(60))
    rows = [(f"h{i:03d}", None, base + f" tail{i}", "content", 0.0, "") for i in range(90)] + [(f"c{i:03d}", None, base, "content", 0.0, "") for i in range(50)]
    got = {(r.first_id, r.second_id) for r in N.similar_pairs(spark.createDataFrame(rows, TEXT), 0.6, 3).collect()}
    assert len(got) == 90 * 89 // 2 + 90 * 50 and not any(a[0] == b[0] == "c" for a, b in got)


def test_very_long_text_and_empty_table(spark):
    long = " ".join(f"x{i % 5000}" for i in range(60_000))
    rows = [("a", None, long, "content", 0.0, ""), ("b", None, long + " end", "content", 0.0, "")]
    assert N.similar_pairs(spark.createDataFrame(rows, TEXT), 0.6, 3).count() == 1
    assert N.similar_pairs(spark.createDataFrame([], TEXT)).count() == 0


def test_copies_keep_their_links(spark):
    base = " ".join(f"b{i}" for i in range(30))
    table = [f"row{i} one two three four five" for i in range(8)]
    rows = [("a", 1, base, "content", 0.0, ""), ("b", 1, base.upper() + "!", "content", 0.0, ""), ("c", 1, base + " more", "content", 0.0, ""), ("d", 2, base + " more", "content", 0.0, "")]
    # copies of a table whose lines stand in another order: only the second shares most runs with the third record
    rows += [("t1", None, "\n".join(table), "table", 0.0, ""), ("t2", None, "\n".join(table[::-1]), "table", 0.0, ""), ("t3", None, " ".join(table[::-1]) + " end", "content", 0.0, "")]
    got = {(r.first_id, r.second_id) for r in N.similar_pairs(spark.createDataFrame(rows, TEXT), 0.9, 3).collect()}
    assert got == brute(rows, 0.9, 3) == {("a", "c"), ("b", "c"), ("t2", "t3")}


def components(rows, threshold, run):
    ids = {(i, s): (i, s) for i, s, t, *_ in rows if i is not None and t is not None}

    def root(x):
        while ids[x] != x:
            x = ids[x]
        return x

    keys = {}
    edges = []
    for i, s, t, k, *_ in rows:
        if (i, s) in ids and bare(t, k):
            edges.append(((i, s), keys.setdefault((s, bare(t, k)), (i, s))))
    scope = {i: s for i, s in ids}
    edges += [((a, scope[a]), (b, scope[b])) for a, b in brute(rows, threshold, run)]
    for a, b in edges:
        a, b = sorted((root(a), root(b)), key=str)
        ids[b] = a
    return {x: root(x)[0] for x in ids}


def test_groups_hold_every_record_once(spark):
    rows = corpus(5, 150, [None]) + [("n1", None, None, "content", 0.0, ""), ("n2", None, "", None, 0.0, ""), ("n3", None, "- !", "table", 0.0, ""), ("n4", None, "two words", None, 0.0, ""), ("n5", None, "Two, words", None, 0.0, "")]
    got = N.duplicate_groups(spark.createDataFrame(rows + rows[:3], TEXT), 0.6, 3).collect()
    assert len(got) == len({r.id for r in got}) == 154
    assert {(r.id, r.scope): r.group_id for r in got} == components(rows, 0.6, 3)
    assert {r.id: r.class_id for r in got}["n5"] == "n4" and all(r.class_id <= r.id for r in got)


def test_smallest_reachable_node(spark):
    rng = random.Random(7)
    nodes = rng.sample(range(-1000, 1000), 400)
    edges = [(a, b) for a, b in zip(nodes, nodes[1:]) if a % 7] + [(5, 5)]
    label = {n: n for e in edges[:-1] for n in e}
    for _ in range(400):
        for a, b in edges[:-1]:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.label for r in N.smallest_reachable(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == label
    assert N.smallest_reachable(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_scoped_records_go_through_the_matrix(spark, monkeypatch):
    scopes = []
    through = N.class_pairs
    monkeypatch.setattr(N, "class_pairs", lambda texts, *rest: (scopes.extend(r.scope for r in texts.select("scope").distinct().collect()), through(texts, *rest))[1])
    rows = corpus(3, 30, [1, 2, None])
    got = {(r.first_id, r.second_id) for r in N.similar_pairs(spark.createDataFrame(rows, TEXT), 0.6, 3).collect()}
    assert set(scopes) == {1, 2, None} and got == brute(rows, 0.6, 3)
