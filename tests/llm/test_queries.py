"""The registered queries on the smallest test data: columns, distinct rows, and brute force where there is one."""

import pandas as pd
import pytest

from patchwright.llm import queries as Q
from patchwright.llm.forms import to_consistent, words_of

COLUMNS = {
    "p1_found": ["tbl", "rec_id", "lang"],
    "p1_stretches": ["tbl", "rec_id", "stretch", "first_word", "n_words", "lang", "confidence"],
    "p2_found": ["tbl", "rec_id", "field"],
    "p2_consistent": ["tbl", "rec_id", "field", "text"],
    "p3_found": ["pair_id", "item_id"],
    "p3_spans": ["pair_id", "field", "first_word", "n_words", "coverage", "item_id"],
    "p3_cleaned": ["pair_id", "source", "target", "cut_words"],
    "p4_found": ["id_a", "id_b"],
    "p4_groups": ["id", "group_id", "links"],
    "p5_found": ["first_id", "copy_id"],
    "p5_collapsed": ["first_id", "copies"],
    "p6_percentiles": ["run_name", "shard_day", "measure", "percentile", "value", "n", "rank_error", "error"],
    "p7_ids": ["doc_id", "ids"],
    "p5_collisions": ["key", "forms"],
    "p7_ids_multi": ["doc_id", "ids"],
    "p8_overlap": ["mix_name", "source", "target_share", "target_tokens", "max_repeats", "tokens", "documents", "most_repeats", "share"],
    "p8_mix": ["mix_name", "source", "doc_id", "repeats", "tokens"],
    "p8_shares": ["mix_name", "source", "target_share", "target_tokens", "max_repeats", "tokens", "documents", "most_repeats", "share"],
    "p9_found": ["doc_id", "kind", "found_text"],
    "p9_redacted": ["doc_id", "text"],
}


@pytest.fixture(scope="module")
def results(spark, sf):
    return {name: f(spark, sf).toPandas() for name, f in Q.queries().items()}


@pytest.fixture(scope="module")
def pairs(sf):
    return pd.read_parquet(f"{sf}/parallel_examples.parquet")


def rows(df):
    return set(map(tuple, df.values.tolist()))


def test_columns(results):
    assert {name: list(df.columns) for name, df in results.items()} == COLUMNS
    for name, df in results.items():
        if name == "p5_collisions":
            assert df.empty
        if name.endswith("_found"):
            assert len(df) == len(df.drop_duplicates()) > 0


def test_consistent_form(results, pairs):
    want = {("parallel_examples", i, f) for f in ("source", "target") for i, t in zip(pairs.pair_id, pairs[f]) if t and to_consistent(t) != t}
    assert {r for r in rows(results["p2_found"]) if r[0] == "parallel_examples"} == want


def test_leaks(results, pairs, sf):
    items = pd.read_parquet(f"{sf}/eval_nway.parquet")
    eights = lambda t: {tuple(w[k : k + 8]) for w in [words_of(t)] for k in range(len(w) - 7)}
    held = [(r.item_id, eights(r.eng_latn) | eights(r.mar_deva) | eights(r.hin_deva)) for r in items.itertuples()]
    want = {(r.pair_id, i) for r in pairs.itertuples() for own in [eights(r.source) | eights(r.target)] if own for i, h in held if own & h}
    assert rows(results["p3_found"]) == want


def test_duplicates(results, pairs):
    sets = [(r.pair_id, set(words_of(r.source)) | set(words_of(r.target)), tuple(sorted([tuple(words_of(r.source)), tuple(words_of(r.target))]))) for r in pairs.itertuples()]
    first: dict = {}
    for i, _, key in sorted(sets, key=lambda x: x[0]):
        first.setdefault(key, i)
    assert rows(results["p5_found"]) == {(first[k], i) for i, _, k in sets if first[k] != i}
    near = {(min(i, j), max(i, j)) for x, (i, a, p) in enumerate(sets) for j, b, q in sets[:x] if p != q and 5 * len(a & b) >= 4 * len(a | b)}
    assert rows(results["p4_found"]) == near
    group = dict(zip(results["p4_groups"].id, results["p4_groups"].group_id))
    assert set(group) == set(pairs.pair_id) and all(group[a] == group[b] for a, b in near)


def test_ids_and_mix(results, sf):
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    ids = dict(zip(results["p7_ids"].doc_id, results["p7_ids"].ids))
    assert set(ids) == set(docs.doc_id) and all((len(ids[i]) == 0) == (not t) for i, t in zip(docs.doc_id, docs.text))
    mix = results["p8_mix"]
    assert all(len(ids[i]) == n for i, n in zip(mix.doc_id, mix.tokens))
    cap = results["p8_shares"].set_index(["mix_name", "source"]).max_repeats
    assert all(pd.isna(cap[r.mix_name, r.source]) or r.repeats <= cap[r.mix_name, r.source] for r in mix.itertuples())


def test_redaction_keeps_the_rest(results, sf):
    docs = pd.read_parquet(f"{sf}/documents.parquet").set_index("doc_id").text
    found = results["p9_found"].groupby("doc_id").found_text.apply(list)
    for r in results["p9_redacted"].itertuples():
        if r.doc_id not in found.index:
            assert r.text == docs[r.doc_id]
        else:
            assert all(x not in r.text or len(x) < 8 for x in found[r.doc_id])
