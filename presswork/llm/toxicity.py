"""A classifier of toxic texts that learns not to mind which group a text is about.

A logistic model over words and character grams is fitted to labelled texts. In
each labelled sentence that names a group, the name is swapped for another of
its kind, and the model pays for the square of the change of the sentence's
score. So group names, and grams that only they have, carry no weight, and a
neutral mention of a group is not taken for abuse of it.
"""

import re
import uuid
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import per_process, plain

#: Names of groups of one kind that are swapped for each other.
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("girl", "boy"), ("female", "male"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual"), ("transgender", "cisgender"),
    ("immigrants", "natives", "refugees", "citizens"), ("old", "young"), ("deaf", "hearing"),
    ("frauen", "männer"), ("muslime", "christen", "juden"),
    ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"),
)
#: Labelled rows of each label that the model is fitted to, at most.
SAMPLE = 2048
#: Longer labelled texts are not used for the fit; all are scored.
SAMPLE_CHARS = 200_000
#: Scores from here on are toxic.
CUT = 0.7
REMEMBERED = 100_000
#: Longer words, in characters, are not remembered.
LONGEST = 48
#: Characters of a word whose grams are made at once.
BLOCK = 1 << 16

_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"[.!?\n]+")


def grams(word: str) -> list[str]:
    """The word between brackets, and its grams of 4 and 5 characters, each once."""
    padded = f"<{word}>"
    return sorted({padded, *(padded[i:i + n] for n in (4, 5) for i in range(len(padded) - n + 1))})


def weight_of(word: str, weights: dict[str, float]) -> float:
    """The summed weight of a word's grams, each once; a long word is cut into overlapping blocks."""
    if len(word) <= BLOCK:
        return sum(weights.get(g, 0.0) for g in grams(word))
    padded, found = f"<{word}>", set()
    for at in range(0, len(padded), BLOCK):
        part = padded[at:at + BLOCK + 4]
        found.update(g for n in (4, 5) for i in range(min(BLOCK, len(part) - n + 1))
                     if (g := part[i:i + n]) in weights)
    return sum(weights[g] for g in sorted(found)) + weights.get(padded, 0.0)


def words_of(text: str) -> set[str]:
    """The distinct words of a text, in lower case."""
    return set(_WORD.findall(text.lower()))


def swaps(text: str) -> list[tuple[set[str], set[str]]]:
    """Words that go and words that come as each sentence's group names change to the next of their kind."""
    following = {t: kind[(i + 1) % len(kind)] for kind in IDENTITY_TERMS for i, t in enumerate(kind)}
    found = []
    for sentence in _SENTENCE.split(text.lower()):
        words = set(_WORD.findall(sentence))
        if named := words & following.keys():
            other = (words - named) | {following[w] for w in named}
            found.append((words - other, other - words))
    return [(gone, come) for gone, come in found if gone or come]


@dataclass(frozen=True)
class Model:
    """``weights`` of grams and a ``bias``; the score of a text adds those of its distinct words."""

    weights: dict[str, float]
    bias: float

    def word(self, word: str) -> float:
        return weight_of(word, self.weights)

    def score(self, text: str) -> float:
        return _logistic(self.bias + sum(map(self.word, words_of(text))))


def _logistic(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))


def _presence(doc: np.ndarray, word: np.ndarray, grams_of: np.ndarray, first: np.ndarray,
              weight: np.ndarray, grams_in_all: int, step: int = 1 << 17) -> np.ndarray:
    """For each gram the summed weight of the documents that have it; some words at a time."""
    total = np.zeros(grams_in_all)
    cuts = [0]
    while cuts[-1] < len(doc):  # a document's words stay together
        to = min(len(doc), cuts[-1] + step)
        cuts.append(int(np.searchsorted(doc, doc[to - 1], "right")))
    for lo, hi in zip(cuts, cuts[1:]):
        count = first[word[lo:hi] + 1] - first[word[lo:hi]]
        at = np.repeat(first[word[lo:hi]] - np.cumsum(count) + count, count) + np.arange(count.sum())
        both = np.unique(np.repeat(doc[lo:hi], count) * grams_in_all + grams_of[at])
        total += np.bincount(both % grams_in_all, weight[both // grams_in_all], grams_in_all)
    return total


def _likelihood_ratio(a: np.ndarray, b: np.ndarray, total_a: float, total_b: float) -> np.ndarray:
    """The G statistic of each pair of counts, ``a`` among ``total_a`` and ``b`` among ``total_b``."""
    total, result = total_a + total_b, 0.0
    for seen, size in ((a, total_a), (b, total_b), (total_a - a, total_a), (total_b - b, total_b)):
        both = a + b if seen is a or seen is b else total - a - b
        with np.errstate(divide="ignore", invalid="ignore"):
            result = result + np.where(seen > 0, 2 * seen * np.log(seen * total / (size * both)), 0)
    return result


def fit(examples: list[tuple[set[str], int, list]], share: float, fairness: float = 1.0,
        evidence: float = 4.0, decay: float = 1e-6, steps: int = 400, rate: float = 0.3) -> Model:
    """A model of (words, label, swaps) examples; ``share`` is that of label 1 among all labelled rows.

    Grams whose counts in both labels differ by less than ``evidence`` standard
    errors get no weight, so that a long neutral text adds up to nothing. The others, and those of group names, are fitted by full-gradient
    steps with a rate for each weight. With one label only, or none, the score
    is the smoothed share of label 1 for every text.
    """
    labels = np.array([label for _, label, _ in examples], dtype=np.float64)
    ones = labels.sum()
    if not 0 < ones < len(labels):
        share = (ones + 1) / (len(labels) + 2)
        return Model({}, float(np.log(share / (1 - share))))
    weight = np.where(labels == 1, share / ones, (1 - share) / (len(labels) - ones))

    pairs = [pair for _, _, found in examples for pair in found]
    named = {w for gone, come in pairs for w in gone | come}
    vocabulary = sorted({w for words, _, _ in examples for w in words} | named)
    at = {w: i for i, w in enumerate(vocabulary)}
    number: dict[str, int] = {}
    grams_of, first = array("q"), array("q", [0])
    for w in vocabulary:
        grams_of.extend([number.setdefault(g, len(number)) for g in grams(w)])
        first.append(len(grams_of))
    grams_of, first = np.array(grams_of), np.array(first)
    doc = np.repeat(np.arange(len(examples)), [len(words) for words, _, _ in examples])
    word = np.array([at[w] for words, _, _ in examples for w in words], np.int64)

    toxic = _presence(doc, word, grams_of, first, labels, len(number))
    clean = _presence(doc, word, grams_of, first, 1 - labels, len(number))
    telling = _likelihood_ratio(toxic, clean, ones, len(labels) - ones) >= evidence ** 2
    for w in named:
        telling[grams_of[first[at[w]]:first[at[w] + 1]]] = True
    index = np.cumsum(telling) - 1
    gram_word = np.repeat(np.arange(len(vocabulary)), np.diff(first))[telling[grams_of]]
    gram = index[grams_of[telling[grams_of]]]
    has = np.zeros(len(vocabulary), bool)
    has[gram_word] = True
    doc, word = doc[has[word]], word[has[word]]
    changed = np.array([at[w] for gone, come in pairs for w in (*gone, *come)], np.int64)
    sign = np.array([s for gone, come in pairs for s in [-1.0] * len(gone) + [1.0] * len(come)])
    pair = np.repeat(np.arange(len(pairs)), [len(gone) + len(come) for gone, come in pairs])

    w, bias = np.zeros(int(telling.sum())), float(np.log(share / (1 - share)))
    squares, bias_squares = np.full(len(w), 1e-8), 1e-8
    for _ in range(steps):
        by_word = np.bincount(gram_word, w[gram], len(vocabulary))
        score = bias + np.bincount(doc, by_word[word], len(examples))
        off = weight * (1 / (1 + np.exp(-np.clip(score, -30, 30))) - labels)
        slope_word = np.bincount(word, off[doc], len(vocabulary))
        if len(pairs):
            change = np.bincount(pair, sign * by_word[changed], len(pairs))
            slope_word += np.bincount(changed, 2 * fairness / len(pairs) * sign * change[pair],
                                      len(vocabulary))
        slope = np.bincount(gram, slope_word[gram_word], len(w)) + decay * w
        squares += slope ** 2
        bias_squares += off.sum() ** 2
        w = w - rate / np.sqrt(squares) * slope
        bias -= rate / np.sqrt(bias_squares) * off.sum()
    kept = np.flatnonzero(telling)
    names = sorted(number, key=number.get)
    return Model({names[g]: float(w[i]) for i, g in enumerate(kept) if w[i]}, float(bias))


def held_out(doc_id: Column) -> Column:
    """Whether a document's label is kept from the fit: crc32 of the id as text is 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", sample: int = SAMPLE, fairness: float = 1.0) -> Model:
    """Fits a model to at most ``sample`` labelled texts of each label that are not held out.

    They are those with the least hash of the id. Labels other than 0 and 1,
    labels without a document and rows with a null id are not used; a document
    with both labels counts as 1. Only distinct words and swapped group names of
    the sample come to the driver.
    """
    known = (labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
             .where(~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("_id"))
             .agg(F.max(label_col).cast("int").alias("_label")))
    counts = {r["_label"]: r["count"] for r in known.groupBy("_label").count().collect()}
    chosen = None
    for label in (0, 1):
        part = known.where(F.col("_label") == label).orderBy(F.xxhash64("_id"), "_id").limit(sample)
        chosen = part if chosen is None else chosen.unionByName(part)

    @F.arrow_udf("words array<string>, gone array<array<string>>, come array<array<string>>")
    def digest(texts: pa.Array) -> pa.Array:
        rows = []
        for text in texts.to_pylist():
            pairs = swaps(text)
            rows.append({"words": sorted(words_of(text)), "gone": [sorted(g) for g, _ in pairs],
                         "come": [sorted(c) for _, c in pairs]})
        strings = pa.list_(pa.string())
        return pa.array(rows, pa.struct([("words", strings), ("gone", pa.list_(strings)),
                                         ("come", pa.list_(strings))]))

    texts = (docs.select(F.col(id_col).alias("_id"), plain(F.col(text_col)).alias("_text"))
             .where(F.length("_text") <= SAMPLE_CHARS).join(F.broadcast(chosen), "_id")
             .dropDuplicates(["_id"]).select("_label", digest("_text").alias("_digest")))
    table = texts.select("_label", "_digest.*").toArrow()
    examples = sorted(
        ((frozenset(row["words"]), row["_label"],
          [(set(g), set(c)) for g, c in zip(row["gone"], row["come"])]) for row in table.to_pylist()),
        key=lambda e: (e[1], sorted(e[0])))
    total = sum(counts.values())
    return fit(examples, counts.get(1, 0) / total if total else 0.5, fairness)


def toxicity(text: Column, model: Model) -> Column:
    """The score from 0 to 1 of each whole text; null and empty texts have that of no word."""
    weights, bias, name = model.weights, model.bias, uuid.uuid4().hex

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        known = per_process(f"toxicity {name}", dict)
        scores = []
        for item in texts:
            words, total = words_of(item.as_py()), bias
            for word in words:
                value = known.get(word)
                if value is None:
                    value = weight_of(word, weights)
                    if len(word) <= LONGEST:
                        if len(known) > REMEMBERED:
                            known.clear()
                        known[word] = value
                total += value
            scores.append(total)
        return pa.array(1 / (1 + np.exp(-np.clip(np.array(scores, dtype=float), -30, 30))))

    return score(plain(text))


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id",
                    text_col: str = "text", cut: float = CUT) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted (1 from ``cut`` on).

    Null and empty texts score as no word does. Null ids are not held out;
    repeated rows stay. Whole texts are scored, words of any length block by
    block. Only the two named columns are read. An empty table stays empty.
    """
    return (docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"),
                        toxicity(F.col(text_col), model).alias("score"))
            .withColumn("predicted", (F.col("score") >= cut).cast("int")))


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", cut: float = CUT) -> DataFrame:
    """``docs`` without those that score ``cut`` or more; all columns stay, of any name.

    Rows are judged by their text alone: null ids and repeated rows go or stay
    with it, a null text is an empty one. An empty table stays empty.
    """
    return docs.where(toxicity(F.col(text_col), model) < cut)
