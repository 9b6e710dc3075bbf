import random

from docloom.llm import leakage as L

DOC = "doc_id bigint, text string, item_id string, edits string"
ITEM = "item_id bigint, suite string, text string"


def edits(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row)


def test_bit_parallel_distance():
    rng = random.Random(5)
    for _ in range(2000):
        p, t = [rng.randint(0, 3) for _ in range(rng.randint(1, 20))], [rng.randint(0, 3) for _ in range(rng.randint(0, 25))]
        assert L.myers_search(p, t) == edits(p, t)


def test_matcher_agrees_with_brute_force():
    rng = random.Random(6)
    v = [f"w{i}" for i in range(30)]
    items = [(k, " ".join(rng.choice(v) for _ in range(rng.randint(5, 30)))) for k in range(12)]
    texts = []
    for _ in range(80):
        w = [rng.choice(v) for _ in range(20)]
        source = rng.choice(items)[1].split()
        cut = source[rng.randrange(len(source)) :][: rng.randint(4, 20)]
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(cut) + 1)
            cut[at : at + rng.randint(0, 1)] = [rng.choice(v)]
        texts.append(" ".join(w[:10] + cut + w[10:]))
    for budget in (0, 1, 2):
        got = {(d, i): e for d, i, e in L.Matcher(items, 8, budget).match(texts)}
        want = {}
        for d, text in enumerate(texts):
            for i, item in items:
                w = item.split()
                best = min((edits(w[s : s + 8], text.split()) for s in range(len(w) - 7)), default=99)
                if best <= budget:
                    want[d, i] = best
        assert got == want


def test_found(spark):
    passage = "one two three four five six seven eight nine ten eleven twelve thirteen"
    items = spark.createDataFrame([(1, "s", "Zero " + passage + " fourteen"), (2, "s", "too short"), (3, "s", None), (4, "s", passage.upper()), (1, "s", "Zero " + passage + " fourteen")], ITEM)
    docs = spark.createDataFrame([(1, "x " + passage.replace(" ", ", ") + " y", "c", "c"), (2, passage.replace("seven", "7"), "c", "c"), (3, None, "c", "c"), (4, "", "c", "c"), (5, "pad " * 100_000 + passage.replace(" ", "\n--\n"), "c", "c"), (1, "x", "c", "c"), (None, passage, "c", "c")], DOC)
    assert sorted(map(tuple, L.found(docs, items).collect())) == [(1, 1), (1, 4), (5, 1), (5, 4)]
    near = {(r.doc_id, r.item_id): r.edits for r in L.leaks(docs, items).collect()}
    assert near == {(1, 1): 0, (1, 4): 0, (5, 1): 0, (5, 4): 0, (2, 1): 1, (2, 4): 1}
    assert L.found(docs.limit(0), items).count() == 0 and L.found(docs, items.limit(0)).count() == 0


def test_blocks_cover_all_items(spark):
    items = spark.createDataFrame([(i, "s", f"item {i} " + "w " * 50) for i in range(40)], ITEM)
    blocks = L.blocks_of(items, "item_id", "text", max_chars=1000)
    assert len(blocks) > 1 and sum(b.count() for b in blocks) == 40
