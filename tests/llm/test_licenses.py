"""Licence notices: scores against a plain version, held-back templates, wrapped notices of several families."""

import math
import textwrap

import pytest

from panelwise.llm import licenses

CLEAN = ["The license of the story was read under the bridge.", "free software for all", "a later version of the story", "All of it.", "x = 1;"]


@pytest.fixture(scope="module")
def model(spark, sf):
    return licenses.Model(spark.read.parquet(f"{sf}/documents.parquet"))


def grams(text):
    w = [x for x in "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()]
    return {*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))}


def wrap(family, places, width):
    return textwrap.wrap(" ".join(licenses.TEMPLATES[family][i] for i in places), width)


NOTICES = {
    "gpl": wrap("gpl", (1, 3, 4), 70),
    "apache": wrap("apache", (1, 2, 4), 60),
    "lgpl": wrap("lgpl", (1,), 50),
    "bsd": wrap("bsd", (0,), 50),
}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, "\n".join(["int main;", *lines, "return 0;", *CLEAN])) for i, lines in enumerate(NOTICES.values())]
    rows += [(10, "Released under the MIT License."), (11, "\n".join(CLEAN * 5)), (12, None), (13, "")]
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def test_wrapped_notices_are_confirmed_line_by_line(model, docs):
    found = {}
    for r in licenses.scan(docs, model).where("confirmed").collect():
        found.setdefault(r.doc_id, {})[r.paragraph] = r.family
    for i, (family, lines) in enumerate(NOTICES.items()):
        inside = [p for p, f in found[i].items() if 1 <= p <= len(lines) and f == family]
        assert len(inside) >= 0.8 * len(lines), (family, found[i])
        assert all(1 <= p <= len(lines) for p in found[i])
    assert found[10] == {0: "mit"} and 11 not in found


def test_scores_equal_plain_version(model, docs):
    """Probability and similarity of every line, worked out from the model's weights one line after the other."""
    weight = dict(zip(model.vocabulary, model.matrix))
    rows = {(r.doc_id, r.paragraph): r for r in licenses.scan(docs, model).collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for doc, text in texts.items():
        lines = text.split("\n")
        own = [grams(line) for line in lines]
        for place, mine in enumerate(own):
            known = [g for g in mine if g in model.lexicon]
            raw = [b + sum(weight.get(g, [0.0] * len(model.bias))[c] for g in known) for c, b in enumerate(model.bias)]
            best = max(raw[1:])
            probability = 1 / (1 + math.exp(-(model.scale * (best - raw[0]) + model.shift)))
            family = licenses.FAMILIES[1 + raw[1:].index(best)]
            similarity, wrapped = 0.0, None
            for t, (f, gs) in model.template_grams.items():
                size = len(gs & model.lexicon)
                shared = len(mine & gs & model.lexicon)
                if f == family:
                    similarity = max(similarity, shared / max(min(size, len(mine)), 1))
                near = sum(len(own[p] & gs & model.lexicon) for p in range(max(0, place - licenses.AROUND), min(len(own), place + licenses.AROUND + 1)))
                if size and shared >= licenses.WRAPPED_SHARE * len(mine) and near >= licenses.CONFIRMED * size and near > shared:
                    wrapped = max(wrapped or (0.0, ""), (near / size, f))
            row = rows.pop((doc, place), None)
            alone = best >= raw[0] and probability >= 0.5
            if not known or not alone and not wrapped:
                assert row is None
                continue
            if wrapped and not (alone and similarity >= licenses.CONFIRMED):
                similarity, family = wrapped
            assert (row.family, row.confirmed) == (family, similarity >= licenses.CONFIRMED)
            assert row.probability == pytest.approx(probability, abs=1e-5) and row.similarity == pytest.approx(min(similarity, 1.0), abs=1e-5)
    assert not rows


def test_calibration_rests_on_templates_the_model_has_not_seen(model):
    folds = {}
    for family, piece, fold in licenses._pieces():
        folds.setdefault(family, set()).add(fold)
    assert all(f == {0, 1} for f in folds.values()) and set(folds) == set(licenses.TEMPLATES)
    assert model.held_back["others"] > 0.98 and model.held_back["notices"] > 0.15 and model.scale > 0


def test_main_path_runs_no_python(model, docs):
    plan = licenses.scan(docs, model)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))
