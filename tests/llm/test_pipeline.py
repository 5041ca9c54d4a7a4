import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from presswork.llm import queries, toxicity

from .test_packing import check
from .test_shared import written
from .test_similar import plain_kept
from .test_substrings import plain_repeats

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """The documents before the first and after each stage."""
    from presswork.llm.shared import stored
    docs, found = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        found.append(docs)
        docs = stored(stage(spark, docs, SMALL), "test")
    return [*found, docs]


def ids(df):
    return sorted(r.doc_id for r in df.collect())


def test_stages_keep_the_columns(steps):
    for step in steps[:5]:
        assert step.dtypes == steps[0].dtypes


def test_toxic_documents_go(spark, steps):
    model = toxicity.train(steps[0], spark.read.parquet(f"{SMALL}/labels.parquet"))
    assert ids(steps[1]) == sorted(r.doc_id for r in steps[0].collect() if model.score(r.text) < 0.7)


def test_equal_texts_go(steps):
    first = {}
    for r in sorted(steps[1].collect(), key=lambda r: r.doc_id):
        first.setdefault(" ".join(r.text.replace("\t", " ").split(" ")), r.doc_id)
    assert ids(steps[2]) == sorted(first.values())


def test_near_duplicates_go(steps):
    want = plain_kept([(r.doc_id, r.text) for r in steps[2].collect()])
    got = ids(steps[3])
    assert set(want) <= set(got) and len(got) - len(want) <= max(1, (steps[2].count() - len(want)) // 10)


HARD = [(1, "same text here"), (1, "same text here"), (None, "same text here"), (None, None), (None, None), (2, None),
        (3, ""), (4, "long words " * 4000), (5, "long words " * 4000 + "end"), (None, "long words " * 4000), (6, "x" * 50_000)]
NAMES = ("_key", "_id", "_uid", "_windows", "_split", "_group", "_text", "_row", "uid", "key", "id", "row", "split",
         "kept", "n_removed", "n_words", "windows", "found", "stays", "count", "body", "prefix", "n", "score", "prints")


@pytest.mark.parametrize("number", range(4))
def test_stages_keep_columns_of_any_name_and_take_hard_rows(spark, number):
    spec = ", ".join(["doc_id long", "text string", "lang string", "source string", "n_chars long",
                      *(f"`{n}` string" for n in NAMES)])
    rows = [(i, t, "en", "s", len(t or ""), *(f"{n} {k}" for n in NAMES)) for k, (i, t) in enumerate(HARD)]
    df = spark.createDataFrame(rows, spec)
    name, stage = corpus_pipeline.STAGES[number]
    done = stage(spark, df, SMALL)
    assert done.dtypes == df.dtypes
    left = done.collect()
    for r in left:
        k = int(r["_key"].split()[1])
        assert [r[n] for n in NAMES] == [f"{n} {k}" for n in NAMES] and r.doc_id == HARD[k][0]
    if name == "toxicity":
        assert len(left) == len(HARD)
    elif name == "exact dedup":
        assert sorted(str(r.doc_id) for r in left) == ["1", "2", "4", "5", "6"]
    elif name == "near dedup":
        # 4 and 5 have two of three shingles in common
        assert sorted(str(r.doc_id) for r in left) == ["1", "2", "3", "4", "5", "6", "None"]
    else:
        assert len(left) == len(HARD)
    assert stage(spark, df.limit(0), SMALL).collect() == []


def test_packing_takes_hard_rows(spark):
    df = spark.createDataFrame([(i, t, "g") for i, t in HARD], "doc_id long, text string, _group string")
    got = corpus_pipeline.pack(spark, df, SMALL).collect()
    assert sum(r.start == 0 for r in got) == len(HARD)
    assert corpus_pipeline.pack(spark, df.limit(0), SMALL).collect() == []


def test_passages_go(steps):
    rows = {r.doc_id: r.text for r in steps[3].collect()}
    want = {d: rows[d] if not gone else kept for d, _, gone, kept in plain_repeats(list(rows.items()))}
    got = steps[4].collect()
    assert {r.doc_id: r.text for r in got} == want
    assert all(r.n_chars == len(r.text) for r in got if r.text != rows[r.doc_id])


def test_all_that_is_left_is_packed(steps):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {r.doc_id: tokenizer.encode(r.text, add_special_tokens=False).ids + [1] for r in steps[4].collect()}
    assert check(steps[5].collect(), want) < 0.05


def test_run_gives_the_last_stage(spark, steps):
    key = ["doc_id", "start"]
    got = corpus_pipeline.run(spark, SMALL).orderBy(key).collect()
    assert [(r.doc_id, r.start, r.ids_crc32) for r in got] == [
        (r.doc_id, r.start, r.ids_crc32) for r in steps[5].orderBy(key).collect()]
    assert "pipeline" not in queries.QUERIES


def test_sequences_hold_the_ids_of_the_texts(steps):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    found = {}
    for r in sorted(steps[5].collect(), key=lambda r: (r.doc_id, r.start)):
        assert len(r.ids) == 4 * r.length
        found[r.doc_id] = found.get(r.doc_id, b"") + r.ids
    assert {d: np.frombuffer(ids, "<u4").tolist() for d, ids in found.items()} == {
        r.doc_id: tokenizer.encode(r.text, add_special_tokens=False).ids + [1] for r in steps[4].collect()}


@pytest.mark.parametrize("number", [2, 3])
def test_dedup_leaves_only_what_its_result_reads(spark, documents, number):
    """What a stage wrote on its way is no load on the disk of the next one."""
    before = written(spark)
    left = corpus_pipeline.STAGES[number][1](spark, documents, SMALL)
    rows = left.count()
    held = {path for file in left.inputFiles() for path in written(spark) if path.name in file}
    size = sum(f.stat().st_size for p in written(spark) - before for f in p.rglob("*.parquet"))
    read = sum(f.stat().st_size for p in held for f in p.rglob("*.parquet"))
    names = {p.name.rpartition("-")[0] for p in written(spark) - before}
    assert not names & {"all-prints", "shingles", "meeting-texts", "candidate-texts", "settled-runs",
                        "open-windows", "shared-anchors", "links"}, names
    assert 0 < read <= size < 200 * documents.count() and rows
