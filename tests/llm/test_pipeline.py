"""The pipeline's stages against brute force on the smallest tables."""

import collections
import re

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from rasterloom.llm import common

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = common.table(spark, SF, "documents")
    columns, before = docs.columns, docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, SF), name)
        after = docs.collect()
        if name != "packing":
            assert docs.columns == columns
        if name in ("toxicity", "language"):
            assert set(after) <= set(before)
        if name == "near_duplicates":
            sets = {}
            for r in before:
                w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
                sets[r.doc_id] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
            up = {i: i for i in sets}

            def root(i, up=up):
                while up[i] != i:
                    i = up[i]
                return i

            for i in sets:
                for j in sets:
                    if i < j and sets[i] and sets[j] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                        x, y = root(i), root(j)
                        up[max(x, y)] = min(x, y)
            assert {r.doc_id for r in after} == {i for i in sets if root(i) == i}
        if name == "repeated_text":
            texts = {r.doc_id: (r.text or "").encode() for r in before}
            count = collections.Counter(t[i : i + 200] for t in texts.values() for i in range(len(t) - 199))
            for r in after:
                t = texts[r.doc_id]
                cover = np.zeros(len(t), bool)
                for i in range(len(t) - 199):
                    if count[t[i : i + 200]] > 1:
                        cover[i : i + 200] = True
                assert (r.text or "") == np.frombuffer(t, np.uint8)[~cover].tobytes().decode("utf-8", "replace")
        if name == "packing":
            assert {r.doc_id for r in after} == {r.doc_id for r in before}
        before = after


def test_odd_and_empty_tables(spark):
    """Null in every column, empty and very long texts, repeated rows, and columns named like the stages' own."""
    names = ["row", "toxic_score", "lang_pred", "lang_score", "was_null", "__gone", "text_hash", "kept", "component_id", "piece", "body", "was"]
    long = "some words of a long story " * 20_000
    texts = ["", None, " ", "plain words that say little of anything at all", long, "x" * 4000, "same text twice in a row", "same text twice in a row"]
    rows = [(i, t, "en", "s", 1, *range(len(names))) for i, t in enumerate(texts)]
    rows += [rows[3], tuple([None] * (5 + len(names))), (3, "another text with the same id", None, None, None, *[None] * len(names))]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{n}` int" for n in names)
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        many = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            out = common.written(stage(spark, docs, SF), name)
            if name == "packing":
                assert (out.count() == 0) == (many == 0)
                continue
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
            got = collections.Counter(r.text for r in out.collect())
            if many and name == "near_duplicates":
                assert got == collections.Counter({"": 1, None: 2, " ": 1, **{t: 1 for t in texts if t and t.strip()}, "another text with the same id": 1})
            if many and name == "repeated_text":
                assert got["x" * 4000] == got[long] == 0 and got[""] == 3 and got[None] == 2
            if many and name == "language":
                assert not {"", None, " "} & got.keys()


def test_one_row_of_every_class_stays(spark):
    x, y, z = (" ".join(f"{w}{i}" for i in range(60)) for w in "xyz")
    near = z.replace("z30", "other")
    rows = [(1, z, "a"), (1, z, "a"), (5, x, "a"), (5, y, "a"), (3, x, "a"), (None, near + " a", "b"), (None, near + " a", "b"), (None, "alone " * 9, "c"), (7, None, "d"), (7, None, "d")]
    docs = common.written(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), "test").repartition(3)
    docs = docs.withColumn("n_chars", F.length("text").cast("bigint"))
    left = corpus_pipeline.near_duplicate_stage(spark, docs, SF)
    assert left.columns == docs.columns
    own = collections.Counter((r.doc_id, r.text) for r in left.collect())
    assert own == collections.Counter([(1, z), (5, y), (3, x), (None, "alone " * 9), (7, None), (7, None)])
    # Rows without an id erase neither each other nor their class.
    nameless = spark.createDataFrame([(None, x, "a"), (None, x, "a"), (None, x + " end", "b")], "doc_id bigint, text string, source string").withColumn("n_chars", F.length("text").cast("bigint"))
    left = corpus_pipeline.near_duplicate_stage(spark, nameless, SF)
    after = corpus_pipeline.repeated_text_stage(spark, left, SF).collect()
    assert len(after) == 1 and after[0].text in (x, x + " end")


def test_near_duplicate_stage_compares_few_pairs_under_one_line(spark, monkeypatch):
    """A line that all documents share makes no pairs of all of them; copies still go."""
    line = "one line that every one of these many short documents holds in common"
    texts = [f"{line} a{i} b{i} c{i} d{i}" for i in range(300)]
    texts += [f"{t}  " for t in texts[:10]]  # the same words
    df = spark.createDataFrame([*enumerate(texts)], "doc_id bigint, text string")
    compared, confirm = [], corpus_pipeline.neardup.confirm

    def counted(docs, edges, k):
        compared.append(edges.count())
        return confirm(docs, edges, k)

    monkeypatch.setattr(corpus_pipeline.neardup, "confirm", counted)
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, df, "").collect()) == [*range(300)]
    assert sum(compared) < 3 * len(texts)


def test_near_duplicate_stage_settles_pairs_by_their_hub(spark, monkeypatch):
    """Buckets of two texts that don't link are settled by the one comparison; their whole sets aren't joined again."""
    rng = np.random.default_rng(17)
    texts = []
    for _ in range(60):
        w = [f"w{x}" for x in rng.integers(0, 10**6, 200)]
        texts.append(" ".join(w))
        for j in rng.choice(200, 10, replace=False):
            w[j] = "other"
        texts.append(" ".join(w))
    df = spark.createDataFrame([*enumerate(texts)], "doc_id bigint, text string")
    again, compared, tokens, confirm = [], [], corpus_pipeline.neardup.tokens, corpus_pipeline.neardup.confirm

    def counted(docs, wanted, k):
        again.append(wanted.count())
        return tokens(docs, wanted, k)

    def noted(docs, edges, k):
        compared.append(edges.count())
        return confirm(docs, edges, k)

    monkeypatch.setattr(corpus_pipeline.neardup, "tokens", counted)
    monkeypatch.setattr(corpus_pipeline.neardup, "confirm", noted)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    want = {i for i, s in enumerate(sets) if not (i % 2 and 10 * len(s & sets[i - 1]) >= 8 * len(s | sets[i - 1]))}
    assert {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, df, "").collect()} == want
    assert compared[0] > 40 and sum(again) == 0
