from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from veduta.operators import page_structure
from veduta.operators.page_structure import CLASSES, classify_programme, ruled_lines
from veduta.plans import programmes

TEXTS = (
    "Orquesta Nacional", "Marta Gil, director", "Gustav Mahler", "Titan", "I. Langsam", "Johannes Brahms", "Obertura trágica", "Anna Roe", "piano", "violín", "Ludwig van Beethoven",
    "Sonata op. 5", "Allegro", "Leonora – Maria Pia", "PAUSA", "Programa:", "BACH Suite francesa", "W. A. Mozart: Concierto 21", "Obras de varios autores", "II", "una tarde",
    "Concierto aplazado", "J. S. Bach variaciones", "Tradicional de Galicia/Juan Pérez (1950)", "Clara Schumann (1819-1896)", "Arreglo de Juan", "andante", "Lili Boulanger Nocturne", "una velada larga sin nombre propio de nadie en absoluto hoy",
)


def pages(spark, n, length, seed=5):
    r = random.Random(seed)
    rows = []
    for page in range(n):
        some = r.sample(TEXTS, r.randint(2, len(TEXTS)))
        count = r.randint(1, length)
        cut = r.choice([count, r.randint(0, count)])
        rows += [(page, r.choice(["Gala", "Recital", "Red Bull Symphonic"]) if page % 5 else "Ciclo", int(k >= cut), k, r.choice([*some, " ", None]) if k % 9 == 0 else r.choice(some)) for k in range(count)]
    return spark.createDataFrame(rows, "page int, title string, block int, line int, text string")


def walked(rows):
    """The rules' codes along each page's lines by a plain loop."""
    out, page, state = {}, None, 0
    for r in sorted(rows, key=lambda r: (r["page"], r["index"])):
        state = 0 if r["page"] != page else state
        page = r["page"]
        code = next(c for c in r["_codes"] if state & c & 31 == c & 31 and state & (c >> 5) & 31 == 0)
        state = state & ~(c := code >> 15 & 31) | code >> 10 & 31
        out[page, r["line"]] = ("annotation", False) if r["_annotation"] else (CLASSES[code >> 20 & 15], bool(code >> 24))
    return out


@pytest.mark.parametrize("n,length,piece", [(40, 30, 256), (3, 400, 16), (12, 40, 7)])
def test_folded_pages_equal_a_plain_walk(spark, n, length, piece):
    lines = pages(spark, n, length).repartition(3)
    kept = lines.where(F.trim(F.coalesce("text", F.lit(""))) != "")
    want = walked(ruled_lines(kept, "page", ["block", "line"], "text", "title", "block").collect())
    got = {(r["page"], r["line"]): (r["class"], r["inline"]) for r in classify_programme(lines, "page", "block", "line", "text", "title", piece).collect()}
    assert got == want and len({k for k, _ in got.values()}) > 6


def test_no_python_worker_walks_the_pages(spark):
    plan = classify_programme(pages(spark, 5, 9), "page", "block", "line", "text", "title")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_lines_are_shuffled_once_and_in_tasks_of_bounded_size(spark, sf_dir, monkeypatch):
    """one exchange by page, no second pass for the share of the whole, no text behind the features."""
    monkeypatch.setattr(page_structure, "TASK_LINES", 100)
    plan = programmes.structure_summary(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    by_page = [part for part in plan.splitlines() if "Exchange hashpartitioning(page#" in part]
    parts = -(-programmes._lines(spark, sf_dir).count() // 100)
    assert len(by_page) == 1 and f", {parts}), REPARTITION_BY_NUM" in by_page[0]


def test_features_joined_by_shuffle_give_the_same(spark, monkeypatch):
    lines = pages(spark, 20, 30)
    found = lambda: sorted(map(tuple, classify_programme(lines, "page", "block", "line", "text", "title", keep=["line"], features=["risk"]).collect()))
    want = found()
    monkeypatch.setattr(page_structure, "SHARED_TEXTS", 0)
    assert found() == want and len(want[0]) == 7


def test_structures_read_no_texts_behind_the_fold(spark, sf_dir):
    """F8: spans come as a feature with the classes, and pages are not shuffled again."""
    plan = programmes.programme_structures(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert len([part for part in plan.splitlines() if "Exchange hashpartitioning(page#" in part]) == 1
    assert "text" not in next(part for part in plan.splitlines() if "collect_list" in part)


def test_line_classes_carry_no_texts(spark, sf_dir):
    """of a line only its number goes through the fold."""
    plan = programmes.programme_line_classes(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in next(part for part in plan.splitlines() if "collect_list" in part) for word in ("text", "title", "block"))
