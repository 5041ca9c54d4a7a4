import math
import random
import zlib
from collections import Counter

import pytest

from presswork.llm import queries, toxicity

SUBJECTS = ("women", "men", "muslims", "christians", "immigrants", "natives")


def labelled():
    """Abuse that mostly names one group, and neutral texts that mostly name others."""
    bad, fine = [], []
    for i in range(200):
        group = SUBJECTS[0] if i % 4 else SUBJECTS[i // 4 % 6]
        bad.append(f"the {group} in town{i} are stupid idiots. they said so{i}")
        group = SUBJECTS[1 + i % 5] if i % 9 else SUBJECTS[0]
        fine.append(f"the {group} in town{i} are at work. they said so{i}")
    return [(text, 1) for text in bad] + [(text, 0) for text in fine]


def examples(rows):
    return [(toxicity.words_of(t), y, toxicity.swaps(t)) for t, y in rows]


def test_swaps_change_only_group_names():
    assert toxicity.swaps("The Women sang. Nothing here! Old men") == [
        ({"women"}, {"men"}), ({"men", "old"}, {"women", "young"})]
    assert toxicity.swaps("") == []


def test_swapped_names_hardly_change_the_score():
    fair = toxicity.fit(examples(labelled()), 0.5, fairness=10.0)
    unfair = toxicity.fit(examples(labelled()), 0.5, fairness=0.0)

    def gap(model):
        scores = [model.word(w) for w in SUBJECTS[:2]]
        return max(scores) - min(scores)

    assert gap(unfair) > 0.5 and gap(fair) < 0.1 * gap(unfair)
    assert fair.score("the women are here") < 0.7 <= fair.score("you are stupid idiots")


def plain_fit(rows, share, fairness, evidence=4.0, decay=1e-6, steps=60, rate=0.3):
    """The fit in loops over texts, words and grams: weights by gram and the bias."""
    ones = sum(y for _, y, _ in rows)
    weight = [share / ones if y else (1 - share) / (len(rows) - ones) for _, y, _ in rows]
    counts = [Counter(g for w in words for g in toxicity.grams(w)) for words, _, _ in rows]
    pairs = [p for _, _, found in rows for p in found]
    moved = []
    for gone, come in pairs:
        change = Counter(g for w in come for g in toxicity.grams(w))
        change.subtract(Counter(g for w in gone for g in toxicity.grams(w)))
        moved.append(change)
    named = {g for gone, come in pairs for w in gone | come for g in toxicity.grams(w)}

    def telling(gram):
        cells = [[0, 0], [0, 0]]
        for (_, y, _), count in zip(rows, counts):
            cells[y][gram in count] += 1
        total, result = len(rows), 0.0
        for y in (0, 1):
            for has in (0, 1):
                seen, side = cells[y][has], cells[0][has] + cells[1][has]
                if seen:
                    result += 2 * seen * math.log(seen * total / (sum(cells[y]) * side))
        return gram in named or result >= evidence ** 2

    grams = sorted(g for g in {g for c in counts for g in c} | named if telling(g))
    w, bias = dict.fromkeys(grams, 0.0), math.log(share / (1 - share))
    squares, bias_squares = dict.fromkeys(grams, 1e-8), 1e-8
    for _ in range(steps):
        slope, bias_slope = {g: decay * w[g] for g in grams}, 0.0
        for k, ((_, y, _), count) in enumerate(zip(rows, counts)):
            score = bias + sum(n * w.get(g, 0.0) for g, n in count.items())
            off = weight[k] * (1 / (1 + math.exp(-max(-30, min(30, score)))) - y)
            bias_slope += off
            for g, n in count.items():
                if g in slope:
                    slope[g] += n * off
        for change in moved:
            difference = sum(n * w.get(g, 0.0) for g, n in change.items())
            for g, n in change.items():
                slope[g] += 2 * fairness / len(moved) * difference * n
        for g in grams:
            squares[g] += slope[g] ** 2
            w[g] -= rate / math.sqrt(squares[g]) * slope[g]
        bias_squares += bias_slope ** 2
        bias -= rate / math.sqrt(bias_squares) * bias_slope
    return w, bias


@pytest.mark.parametrize("fairness", [0.0, 1.0, 10.0])
def test_fit_against_plain_loops(fairness):
    rng = random.Random(7)
    rows = examples(rng.sample(labelled(), 90) + [("", 0), ("", 1), ("a", 0)])
    model = toxicity.fit(rows, 0.3, fairness=fairness, steps=60)
    weights, bias = plain_fit(rows, 0.3, fairness)
    assert model.bias == pytest.approx(bias, rel=1e-6)
    assert set(model.weights) <= set(weights) and len(weights) > 50
    for gram, value in weights.items():
        assert model.weights.get(gram, 0.0) == pytest.approx(value, rel=1e-5, abs=1e-7)
    scores = [1 / (1 + math.exp(-bias - sum(weights.get(g, 0.0) for w in words for g in toxicity.grams(w))))
              for words, _, _ in rows]
    texts = [t for t, _ in rng.sample(labelled(), 20)]
    assert max(scores) > 0.5 and all(0 <= model.score(t) <= 1 for t in texts)


@pytest.mark.parametrize("rows, score", [([], 0.5), ([("a", 1)], 2 / 3), ([("a", 0), ("b", 0)], 0.25)])
def test_one_label_only(rows, score):
    assert toxicity.fit(examples(rows), 0.5).score("anything") == pytest.approx(score)


def test_long_words_are_cut_into_blocks(monkeypatch):
    word = "".join(chr(97 + i * i % 7) for i in range(500))
    weights = {g: 1.0 + i for i, g in enumerate(toxicity.grams(word)) if i % 3}
    whole = sum(weights.get(g, 0.0) for g in toxicity.grams(word))
    for block in (1, 3, 5, 64, 500):
        monkeypatch.setattr(toxicity, "BLOCK", block)
        assert toxicity.weight_of(word, weights) == pytest.approx(whole)
        assert toxicity.weight_of("a", {"<a>": 2.0}) == toxicity.weight_of("abcdef", {"<abcdef>": 2.0}) == 2.0


def test_hard_rows(spark, docs):
    rows = [(i, t) for i, (t, _) in enumerate(labelled())] + [(None, "stupid idiots"), (900, None),
                                                               (900, ""), (901, "stupid idiots " * 20_000)]
    labels = spark.createDataFrame(
        [(i, y, "x") for i, (_, y) in enumerate(labelled())]
        + [(None, 1, "x"), (5000, 1, "x"), (3, None, "x"), (4, 7, "x"), (0, 0, "x"), (0, 1, "x")],
        "doc_id long, toxic int, text string")
    df = docs(*rows, (0, labelled()[0][0]))
    model = toxicity.train(df, labels)
    got = toxicity.score_documents(df, model).collect()
    assert len(got) == len(rows) + 1
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    by_id = {r.doc_id: r for r in got}
    assert by_id[901].predicted == 1 and by_id[900].predicted == 0 and not by_id[None].held_out
    for r in got:
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    kept = toxicity.drop_toxic(df, model)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if not r.predicted}
    empty = toxicity.train(df.limit(0), labels.limit(0))
    assert toxicity.score_documents(df.limit(0), empty).collect() == []


def test_fit_never_sees_held_out_labels(spark, docs):
    df = docs(*[(i, t) for i, (t, _) in enumerate(labelled())])
    rows = [(i, y) for i, (_, y) in enumerate(labelled())]
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, y in rows]
    made = [toxicity.train(df, spark.createDataFrame(r, "doc_id long, toxic int"))
            for r in (rows, turned)]
    assert made[0] == made[1]


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = queries.QUERIES["op7_toxicity"](spark, folder).collect()
    known = [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    toxic = [p for p, y in known if y]
    assert len(toxic) > 50 and sum(toxic) / len(toxic) > 0.85
    clean = [p for p, y in known if not y]
    assert sum(clean) / len(clean) < 0.01
