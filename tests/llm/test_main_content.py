import random

import pytest

from docloom.llm import main_content as M

CHUNK = "document_id string, vector_id string, heading string, content string, line_no int, source_type string, chunk_metadata map<string,string>"
DOC = "document_id string, source_type string, content string"

#: A language that no given table has: what surrounds a page, and what its body is made of.
AROUND = ["Ga naar de inhoud", "Start | Producten | Prijzen | Hulp", "Wij gebruiken cookies om deze site te verbeteren.", "Populaire berichten", "© 12 {} Groep. Alle rechten voorbehouden.", "Was dit artikel over {} nuttig? Deel het met collega's!", "Voorwaarden | Privacy | Colofon", "Schrijf u in voor de nieuwsbrief van {}", "Inloggen", "{} is niet aansprakelijk voor de voorbeelden in deze handleiding."]
THINGS = "rekeningen kamers sleutels boeken treinen metingen vragen wetten spelers servers lijsten foto's monsters prijzen".split()
PLACES = "Zando Merit Palova Suder Kinola Ferat Dobin Lasure Vemo Tirak".split()


def body(rng):
    a, b, p = rng.choice(THINGS), rng.choice(THINGS), rng.choice(PLACES)
    return rng.choice(
        [
            f"Wie de {a} van {p} wil bekijken, heeft ook de {b} nodig die eerder zijn opgeslagen en daarna pas werden verplaatst.",
            f"De {a} worden vergeleken met de {b} in {p}, zodat iedereen weet welke daarvan het laatst is gewijzigd.",
            f"Zonder {a} zijn er geen {b}: daarom vroeg men {p} om alles nog een keer te tellen voor het einde van de week.",
        ]
    )


def corpus(seed=1, pages=80, others=120):
    """Chunks of pages with their surroundings, and of texts with a line of them between paragraphs; the true lines."""
    rng, rows, true = random.Random(seed), [], set()

    def add(i, heading, lines, tag):
        rows.append((f"d{i // 2}", f"v{i:03d}", heading, "\n".join(x for x, _ in lines), 1, "x", {"html_tag": tag}))
        true.update((f"v{i:03d}", j) for j, (_, out) in enumerate(lines) if out)

    for i in range(pages + others):
        p = rng.choice(PLACES)
        around = [(x.format(p), True) for x in rng.sample(AROUND, 6)]
        texts = [(body(rng), False) for _ in range(rng.randint(3, 5))]
        if i < pages:
            title = f"{rng.choice(THINGS).capitalize()} in {p}"
            add(i, title, [*around[:3], (title, False), *texts, *around[3:]], "body")
        else:
            texts.insert(rng.randrange(len(texts)), around[0])
            add(i, f"{rng.choice(THINGS).capitalize()} in {p}", texts, "p")
    return rows, true


def result(spark, rows):
    docs = spark.createDataFrame([(d, "html", "x") for d in {r[0] for r in rows}], DOC)
    return {(r.vector_id, r.line_no) for r in M.found(spark.createDataFrame(rows, CHUNK), docs).collect()}


def test_surroundings_of_an_unknown_language_are_recognized(spark):
    rows, true = corpus()
    got = result(spark, rows)
    assert len(got & true) >= 0.97 * len(true) and len(got & true) >= 0.97 * len(got)


def test_the_scores_decide(spark, monkeypatch):
    rows, true = corpus()
    assert len(result(spark, rows) & true) >= 0.97 * len(true)
    monkeypatch.setattr(M, "SIBLING", -1.0)
    monkeypatch.setattr(M, "FLOOR", -1.0)
    assert not result(spark, rows)  # without comparing blocks


def test_without_link_density_little_is_found():
    rows, true = corpus()
    pages = [M.Page(r[2], r[3], r[6]["html_tag"]) for r in rows]
    model, features = M.fitted([(r[2], r[3], r[6]["html_tag"]) for r in rows]), M.Features()
    with_it = {(r[1], at) for r, p in zip(rows, pages) for at in M.furniture_of(p, model.of(p.lines, features))}
    without = {(r[1], at) for r, p in zip(rows, pages) for at in M.furniture_of(p, M.np.zeros(len(p.lines)))}
    assert len(with_it & true) >= 0.97 * len(true) and len(without & true) < 0.2 * len(true)


def test_length_and_commas_keep_a_line_of_doubtful_wording():
    short, long = "A short line of the kind.", "A line of the same kind, but one that goes on, says more, and doesn't end before it has told its reader what it is about, " * 3 + "at last."
    page = M.Page(None, f"{long}\n{short}\n{long}", "p")
    density = M.np.array([0.0, 0.9, 0.0])
    assert M.furniture_of(page, density) == [1]
    assert M.furniture_of(M.Page(None, f"{long}\n{long}\n{long}", "p"), M.np.array([0.0, 0.85, 0.0])) == []


def test_rows_of_tables_follow_the_metadata():
    assert M.Page(None, "Owner | Sagoren", "table").rows == [True] and M.Page(None, "Owner | Sagoren", "p").rows == [False]
    assert M.Page(None, "Owner | Sagoren\nField | Value\nText.", None).rows == [True, True, False]
    assert M.Page(None, "A | B | C\nD | E | F", "table").rows == [False, False]


def test_texts_without_furniture_stay_whole():
    for text in ("A sentence that says something, and another one.\nOne more of the kind follows here.", "word, " * 200_000):
        page = M.Page(None, text, None)
        assert M.furniture_of(page, M.np.zeros(len(page.lines))) == []
    assert M.Page(None, None, None).lines == [] and M.Page("x", " \n\t\n", None).lines == []
    assert M.fitted([("x", "no title here", None), (None, "y", "p")]).of(["y"], M.Features()).tolist() == [0.0]


def test_only_html_documents_count(spark):
    rows, true = corpus(pages=40, others=0)
    extra = [("pdf", "p1", *rows[0][2:]), ("gone", "p2", *rows[0][2:]), (rows[0][0], "null", None, None, 1, "x", None), (None,) * 7, rows[0]]
    chunks = spark.createDataFrame(rows + extra, CHUNK)
    docs = spark.createDataFrame([(d, "HTML", "x") for d in sorted({r[0] for r in rows})] * 2 + [("pdf", "pdf", "x"), (None, None, None)], DOC)
    got = {(r.vector_id, r.line_no) for r in M.found(chunks, docs).collect()}
    assert len(got & true) >= 0.95 * len(true) and not {v for v, _ in got} & {"p1", "p2", "null"}
    out = [r for r in M.main_content(chunks, docs).collect() if r.vector_id == "v000"]
    assert len(out) == 2 and out[0].removed_lines == 6 and "|" not in out[0].content and out[0].source_type == "x"
    assert M.main_content(chunks, docs).count() == len(rows) + 5
    assert M.found(chunks.limit(0), docs.limit(0)).count() == 0


def test_blocks_are_compared_over_the_chunks_of_a_document(spark):
    rich = "The printers of the second floor, the noise, the heat, and the paper need space, " + "and so do all the people who work there every day " * 5 + "now."
    poor = "..."
    chunks = spark.createDataFrame([("a", "v1", None, rich, 1, "x", {}), ("a", "v2", None, poor, 1, "x", {}), ("b", "v3", None, poor, 1, "x", {})], CHUNK)
    docs = spark.createDataFrame([("a", "html", "x"), ("b", "html", "x")], DOC)
    assert [(r.vector_id, r.line_no) for r in M.found(chunks, docs).collect()] == [("v2", 0)]


@pytest.mark.parametrize("seed", [2, 3])
def test_the_sample_is_no_cut(spark, monkeypatch, seed):
    rows, true = corpus(seed, 120, 60)
    monkeypatch.setattr(M, "SAMPLE", 60)
    got = result(spark, rows)
    assert len(got & true) >= 0.93 * len(true) and len(got & true) >= 0.93 * len(got)
