"""Problems on text: exact ids, exact cover by containers, languages against labels that are right by construction."""

import base64

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SF
from tapewright.llm import bpe, languages, packing, queries
from tapewright.runtime import table


@pytest.fixture(scope="module")
def reference_encoder():
    P = pytest.importorskip("public_tokenizers")
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_equal_a_library_on_every_document(spark, reference_encoder):
    docs = table(spark, SF, "documents").select("doc_id", "text").toPandas()
    got = dict(queries.p8_ids(spark, SF).toPandas().itertuples(index=False, name=None))
    assert len(got) == len(docs)
    for i, t in docs.itertuples(index=False, name=None):
        assert list(got[i]) == (reference_encoder.encode_ordinary(t) if isinstance(t, str) else [])


def test_ids_of_odd_texts(spark, reference_encoder):
    texts = ["", None, " ", "\n\n  x", "a" * 30_000, " " * 20_000, "ab" * 9_000 + "é", "<|endoftext|>", "😀‍😀 é", "x\x00y", "1234567890" * 500]
    rng = np.random.default_rng(3)
    texts += ["".join(rng.choice(list("aeinrst TH\n'.,019éжß中の"), rng.integers(1, 60))) for _ in range(300)]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    got = {r.doc_id: r.ids for r in bpe.encode(df).collect()}
    assert all(got[i] == (reference_encoder.encode_ordinary(t) if t else []) for i, t in enumerate(texts))


def test_ids_of_an_empty_table_and_repeated_ids(spark):
    assert bpe.encode(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    twice = spark.createDataFrame([(1, "one"), (1, "one")], "doc_id long, text string")
    assert bpe.encode(twice).count() == 2


def test_containers_cover_every_token_once(spark):
    sizes = bpe.token_counts(table(spark, SF, "documents"))
    out = packing.assign_containers(sizes).toPandas()
    want = sizes.toPandas().set_index("doc_id").n_tokens
    assert out.groupby("doc_id").n_tokens.sum().to_dict() == want.to_dict()
    assert out.groupby("container").n_tokens.sum().max() <= packing.CAPACITY
    pieces = out.groupby("doc_id").piece.count()
    assert ((pieces == 1) | (want > packing.CAPACITY)).all()
    for _, x in out.sort_values("piece").groupby("doc_id"):
        assert (x.start_token.to_numpy() == np.r_[0, x.n_tokens.cumsum()[:-1]]).all()


def test_packing_is_tight_in_many_groups(spark):
    rng = np.random.default_rng(5)
    n = np.clip(rng.lognormal(5, 1, 6_000).astype(int), 0, 9_000)
    df = spark.createDataFrame(pd.DataFrame({"doc_id": np.arange(len(n)), "n_tokens": n, "piece": 7}))
    out = packing.assign_containers(df, group_tokens=200_000).toPandas()
    full = out.groupby("container").n_tokens.sum()
    assert full.max() <= packing.CAPACITY and out.n_tokens.sum() == n.sum()
    assert n.sum() / (len(full) * packing.CAPACITY) > 0.985


def test_packing_edges(spark):
    df = spark.createDataFrame([(1, 0), (2, None), (3, 2048), (4, 2049), (5, 10_000), (6, 1)], "doc_id long, n_tokens long")
    out = packing.assign_containers(df).toPandas()
    assert out.groupby("doc_id").n_tokens.sum().to_dict() == {1: 0, 2: 0, 3: 2048, 4: 2049, 5: 10_000, 6: 1}
    assert packing.assign_containers(df.limit(0)).count() == 0
    assert packing.pack(np.array([5, 5, 5]), 10).tolist() == [0, 1, 0]


@pytest.fixture(scope="module")
def model(spark):
    return languages.fit_model(table(spark, "/root/testdata/sf0.01", "documents"))


def test_single_language_texts_agree_with_most_labels(spark, model):
    found = languages.identify(table(spark, "/root/testdata/sf0.01", "documents"), model)
    mono = found.where("proportion = 1 and label is not null").toPandas()
    assert (mono.label == mono.lang).mean() > 0.92  # the rest are wrong labels
    held_out = mono.sample(frac=1, random_state=1)
    assert set(held_out.lang) == set(languages.LANGUAGES)


def test_mixed_and_odd_texts(model):
    en = "The risk committee kept every rejected row. Nothing in the log explains why the rows came in after midnight."
    de = "Der Risikoausschuss behielt jede verworfene Zeile. Nichts im Protokoll erklärt, warum die Zeilen nach Mitternacht kamen."
    ja = "夜勤の担当者は損失上限を退けた。検証の報告書は以前の値幅をならした。"
    texts = [en, de.upper(), f"{en}\n\n{de}", f"{en} {ja}", en + " Our vendor lost the weekly average (Handelstag).", "", None, "  \n ", "US500 XAUUSD 3.2e-01\n{'A': [1, 2]}", (en + " ") * 3_000]
    share, segments, conf = languages.infer(model, texts)
    held = [{languages.LANGUAGES[k] for k in np.flatnonzero(s)} for s in share]
    assert held == [{"en"}, {"de"}, {"en", "de"}, {"en", "ja"}, {"en"}, set(), set(), set(), set(), {"en"}]
    assert [languages.LANGUAGES[k] for _, _, k, _ in segments[2]] == ["en", "de"]
    a, b, _, c = segments[2][1]
    assert texts[2][a:b] == de and 0.99 < c <= 1


def test_one_foreign_sentence_in_a_long_text(model):
    en = "Nothing in the log explains why the rows came in after midnight. "
    de = "Nichts im Protokoll erklärt, warum die Zeilen nach Mitternacht kamen. "
    for n in (300, 3_000, 30_000):
        text = en * (n // 2) + de + en * (n - n // 2 - 1)
        share, segments, _ = languages.infer(model, [text, en * n])
        assert [{languages.LANGUAGES[k] for k in np.flatnonzero(s)} for s in share] == [{"en", "de"}, {"en"}]
        assert [(languages.LANGUAGES[k], text[a:b]) for a, b, k, _ in segments[0]][1] == ("de", de.strip()) and len(segments[0]) == 3
        assert np.isclose(share[0, languages.LANGUAGES.index("de")] * n, 1, atol=0.1)


def test_labels(spark):
    cases = {"en": "en", "EN": "en", "en_US": "en", "en-GB": "en", "eng": "en", "English": "en", " german ": "de", "xx": None, "und": None, "": None, None: None, "unknown": None, "zh-Hans-CN": "zh", "pt-BR": "pt"}
    df = spark.createDataFrame([(k,) for k in cases], "lang string")
    got = {r[0]: r[1] for r in df.select("lang", languages.label_code(F.col("lang"))).collect()}
    assert got == cases


def test_found_rows_are_unique_and_empty_tables_work(spark):
    found = queries.p10_found(spark, SF)
    assert found.count() == found.distinct().count() > 0
    empty = table(spark, SF, "documents").limit(0)
    assert languages.wrong_labels(languages.identify(empty)).count() == 0


def test_texts_without_a_whole_sentence_still_get_a_language(spark, model):
    df = spark.createDataFrame([(1, "Nichts", None), (2, "2024-05-01 17", "en"), (3, "", None), (4, None, "de")], "doc_id long, text string, lang string")
    found = languages.identify(df, model)
    got = {r.doc_id: (r.lang, r.proportion) for r in found.collect()}
    assert got == {1: ("de", None), 2: (None, None), 3: (None, None), 4: (None, None)}
    assert languages.wrong_labels(found).count() == 0


def test_scores_of_held_tokens_equal_those_of_fresh_ones(model, monkeypatch):
    texts = ["Nichts im Protokoll erklärt die Zeilen. The log explains nothing at all.", "夜勤の担当者は損失上限を退けた。", "x" * 50] * 40
    once = languages.infer(languages.Scores(model), texts)[0]
    monkeypatch.setattr(languages, "_HELD_TOKENS", 3)
    again = languages.Scores(model)
    assert all((languages.infer(again, [t])[0][0] == once[i]).all() for i, t in enumerate(texts))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, duck, name):
    from conftest import rows

    got, want = queries.QUERIES[name](spark, SF).toPandas(), duck.sql(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
