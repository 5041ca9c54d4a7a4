import hashlib
import random
import re

import numpy as np
import pytest

from presswork.llm import queries, recompression, shared, substrings


def plain_repeats(rows, window=13):
    """(doc_id, text) rows -> per row (doc_id, n_words, n_removed, kept), by a dictionary of all windows."""
    words = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    first = {}
    for d, w in words:
        for i in range(len(w) - window + 1):
            if d is not None:
                key = tuple(w[i:i + window])
                first[key] = min(first.get(key, d), d)
    result = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if d is not None and first[tuple(w[i:i + window])] < d:
                gone.update(range(i, i + window))
        result.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return result


def found(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, bytes(r.kept).decode()) for r in
                   substrings.remove_repeats(df).collect()), key=str)


def texts_with_repeats(rng, count, vocabulary=12):
    """Texts of few words, so that windows and runs repeat by chance too, with copied passages."""
    words, made = [f"w{i}" for i in range(vocabulary)] + ["é", "the"], []
    for _ in range(count):
        text = [rng.choice(words) for _ in range(rng.randrange(0, 60))]
        for _ in range(rng.randrange(3)):
            if made and (source := rng.choice(made)):
                a = rng.randrange(len(source))
                at = rng.randrange(len(text) + 1)
                text[at:at] = source[a:a + rng.choice([5, 13, 14, 30])]
        if rng.random() < 0.3:
            at = rng.randrange(len(text) + 1)
            text[at:at] = [rng.choice(words)] * rng.choice([2, 13, 20, 40])
        if rng.random() < 0.2:
            at = rng.randrange(len(text) + 1)
            text[at:at] = [rng.choice(words), rng.choice(words)] * rng.choice([7, 12])
        made.append(text)
    return [rng.choice([" ", "\n", " \t"]).join(t) for t in made]


@pytest.mark.parametrize("seed, vocabulary", [(1, 2), (2, 6), (3, 40)])
def test_against_all_windows(spark, docs, monkeypatch, seed, vocabulary):
    rng = random.Random(seed)
    rows = list(enumerate(texts_with_repeats(rng, 120, vocabulary)))
    rng.shuffle(rows)
    assert found(docs(*rows)) == sorted(plain_repeats(rows), key=str)
    monkeypatch.setattr(substrings, "SLICE", 40)
    assert found(docs(*rows)) == sorted(plain_repeats(rows), key=str)


def test_anchor_depends_on_the_window_only():
    rng = random.Random(9)
    for letters in (2, 3, 10, 1000):
        for _ in range(100):
            inner = [rng.randrange(letters) for _ in range(13)]
            seen = set()
            for _ in range(6):
                around = [[rng.randrange(letters) for _ in range(rng.randrange(30))] for _ in "ab"]
                names = recompression.mixed(np.array(around[0] + inner + around[1], np.uint64))
                sizes = names.astype(np.int64) % 9
                anchor, place = recompression.parse(names, sizes, np.zeros(len(names), int), 13)
                at = len(around[0])
                seen.add((int(anchor[at]), int(place[at]) - at))
            assert len(seen) == 1


def test_word_names_tell_words_apart():
    words = [b"a", b"b", b"ab", b"ba", b"aa", b"a\x00", b"\x00a", "é".encode(), b"x" * 5000, b"x" * 5001]
    names, sizes, begin = recompression.words(b" \n".join(words * 2) + b"\t")
    assert begin[1] == 3
    assert len(set(names.tolist())) == len(words) and names[:10].tolist() == names[10:].tolist()
    assert sizes.tolist() == [len(w) for w in words * 2]


def thue_morse(steps):
    word = "a"
    for _ in range(steps):
        word += word.translate(str.maketrans("ab", "ba"))
    return word


@pytest.mark.parametrize("place", [0, 6, 12])
def test_words_that_sums_of_powers_confuse_are_told_apart(docs, place):
    one = thue_morse(11)
    other = one.translate(str.maketrans("ab", "ba"))
    passage = lambda word: " ".join(["w"] * place + [word] + ["w"] * (12 - place))
    rows = [(1, passage(one)), (2, passage(other)), (3, passage(one))]
    assert [r[2] for r in found(docs(*rows))] == [0, 0, 13]


def test_names_only_lead_to_places(docs, monkeypatch):
    """If all words had one name, the words themselves would still be compared."""
    real = recompression.words
    monkeypatch.setattr(substrings.recompression, "words",
                        lambda data: (np.ones_like((r := real(data))[0]), *r[1:]))
    rows = [(1, " ".join(map(str, range(30)))), (2, " ".join(map(str, range(10, 40)))),
            (3, " ".join(map(str, range(100, 130))))]
    texts = [t.encode() for _, t in rows]
    import pyarrow as pa
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3], "uid": [1, 2, 3], "text": texts})
    found_ = pa.Table.from_batches(substrings._spans(batch, 13)).to_pylist()
    windows = {tuple(t.split()[i:i + 13]) for _, t in rows for i in range(18)}
    assert len({r["anchor"] for r in found_}) == 1
    assert len({(r["alike"], r["alike2"]) for r in found_}) == len(windows) < len(found_)


def test_digests_are_of_the_words_alone():
    data = b"  a b\n\nc \td" + b" a b c d"
    (names, sizes, owner, number, text), = substrings._slices([data], 2)
    first, end = substrings._places(sizes)
    assert [text[a:b] for a, b in zip(first, end)] == [b"a", b"b", b"c", b"d"] * 2
    got = recompression.digests(text, first[:5:4], end[3::4])
    assert (got[0] == got[1]).all() and len(set(got[0])) == 2


def test_hard_rows(docs):
    long = " ".join(f"word{i}" for i in range(40))
    rows = [(0, None), (1, ""), (2, " \n "), (3, long), (3, long), (3, "other " + long), (4, long + " tail"),
            (None, long), (5, "x " * 30), (6, "x " * 14), (7, "y " * 12 + long[:20]), (8, "  " + long)]
    assert found(docs(*rows)) == sorted(plain_repeats(rows), key=str)
    assert substrings.remove_repeats(docs("x").limit(0)).collect() == []


def test_extra_columns_stay(docs):
    df = docs((1, "a " * 20), (2, "a " * 20)).withColumnRenamed("ids", "kept").withColumnRenamed("n", "windows")
    got = substrings.remove_repeats(df)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "windows", "n_words", "n_removed", "kept"]
    assert sorted((r.doc_id, r.n_removed, r.windows) for r in got.collect()) == [(1, 0, 1), (2, 20, 1)]
    left = substrings.without_repeats(df)
    assert left.columns == df.columns
    assert sorted((r.doc_id, r.text, r.n_chars) for r in left.collect()) == [(1, "a " * 20, 7), (2, "", 0)]


def test_query_against_all_windows(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    want = {(d, n, g, hashlib.sha256(k.encode()).hexdigest()) for d, n, g, k in plain_repeats(rows)}
    got = queries.QUERIES["op8_substring_dedup"](spark, "/root/testdata/sf0.001").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(rows)
    assert any(n for _, _, n, _ in want)


def test_words_of_long_texts_come_in_blocks():
    text = b"ab cd  ef\n" * 50
    assert [w for part in shared.word_blocks(text, 7) for w in part] == text.split()
