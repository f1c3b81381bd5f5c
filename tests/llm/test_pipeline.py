import corpus_pipeline
import pytest
from odd_rows import ROWS, SMALL

from townhall.llm import decontaminate


@pytest.fixture(scope="module")
def stages(spark, small):
    """What each stage makes of what its predecessor kept."""
    from townhall.llm.common import settle

    docs, out = small, []
    for _, stage in corpus_pipeline.STAGES:
        docs = settle(stage(spark, docs, SMALL))
        out.append(docs)
    return out


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_stages_keep_the_columns_of_documents(small, stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near duplicates", "decontamination", "mixture", "shards"]
    assert all(s.columns == small.columns for s in stages[:-1])


def test_language_keeps_clean_documents(small, stages):
    assert ids(stages[0]) == ids(small)


def test_one_document_of_each_group_stays(stages):
    """Groups by comparing the five-word shingles of all pairs of documents."""

    def shingles(text):
        w = text.lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets = {r["doc_id"]: shingles(r["text"]) for r in stages[0].collect()}
    group = {d: d for d in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and group[a] != group[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                low, high = sorted((group[a], group[b]))
                group = {d: low if g == high else g for d, g in group.items()}
    assert ids(stages[1]) == sorted(set(group.values())) and len(set(group.values())) < len(group)


def test_documents_with_items_go(spark, stages):
    items = [decontaminate.words(r["text"].encode()) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]

    def holds(text):
        w = decontaminate.words(text.encode())
        return any(w[k : k + len(i)] == i for i in items for k in range(len(w) - len(i) + 1))

    before = {r["doc_id"]: r["text"] for r in stages[1].collect()}
    assert ids(stages[2]) == sorted(d for d, t in before.items() if not holds(t))


def test_mixture_repeats_whole_documents_and_shards_hold_all(stages):
    before = {tuple(r) for r in stages[2].collect()}
    mixed = stages[3].collect()
    assert {tuple(r) for r in mixed} <= before
    assert max(ids(stages[3]).count(d) for d in set(ids(stages[3]))) <= 2
    assert ids(stages[4]) == ids(stages[3])
    assert {r["shard"] for r in stages[4].collect()} == set(range(corpus_pipeline.SHARDS))


def test_stages_take_odd_and_empty_tables(spark, odd, empty):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, SMALL).count() <= 2 * len(ROWS)
        assert stage(spark, empty, SMALL).count() == 0
