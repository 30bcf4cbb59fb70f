import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__ as contract
import corpus_pipeline
from farewise.llm import queries
from tests.llm.conftest import passage
from tests.llm.test_dedup import brute_components
from tests.llm.test_rules import brute_measures


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def texts_of(table):
    return {r.doc_id: r.text for r in table.collect()}


def test_stages_equal_brute_force(spark, make, tmp_path):
    base = passage(7, 100)
    texts = [passage(k, 60) for k in range(30)] + [base, base, base.replace("the", "a", 1), "too short", ("a b c d e f g h " * 9), None, base + " mail me at x.y@z.org now"]
    docs = make(texts)
    path = str(tmp_path)
    docs.write.parquet(f"{path}/documents.parquet")
    before = dict(enumerate(texts))

    kept = stage("quality rules")(spark, docs, path)
    measures = {k: brute_measures(t or "") for k, t in before.items()}
    before = {k: t for k, t in before.items() if measures[k][0] >= 20 and 100 * measures[k][4] <= 30 * measures[k][0]}
    assert texts_of(kept) == before and kept.columns == docs.columns

    kept = stage("exact dedup")(spark, kept, path)
    before = {max(k for k, u in before.items() if u == t): t for t in before.values()}
    assert texts_of(kept) == before and kept.columns == docs.columns

    kept = stage("near dedup")(spark, kept, path)
    order = sorted(before)
    roots = [r for _, r in brute_components([before[k] for k in order], corpus_pipeline.NEAR_PERCENT)]
    before = {order[i]: before[order[i]] for i, r in enumerate(roots) if i == r}
    assert texts_of(kept) == before and kept.columns == docs.columns

    kept = stage("personal data")(spark, kept, path)
    before = {k: t.replace("x.y@z.org", "<EMAIL>") for k, t in before.items()}
    assert texts_of(kept) == before and kept.columns == docs.columns

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sizes = {k: len(own.encode(t, add_special_tokens=False).ids) + 1 for k, t in before.items()}
    rows = corpus_pipeline.run(spark, path).collect()
    assert {r.doc_id: r.doc_tokens for r in rows} == sizes and sum(r.length for r in rows) == sum(sizes.values())


def test_stages_take_odd_and_empty_tables(spark, odd, empty):
    for docs in (odd, empty):
        for name, function in corpus_pipeline.STAGES[:-1]:
            got = function(spark, docs, "")
            assert got.columns == docs.columns, name
            got.count()
        corpus_pipeline.STAGES[-1][1](spark, docs, "").count()


def test_all_are_registered():
    names = contract.queries()
    assert "pipeline" in names and [n for n in names if n.startswith("op")] == sorted((n for n in queries.QUERIES if n.startswith("op")), key=list(names).index)
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 14))
