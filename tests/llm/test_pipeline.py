"""The pipeline's stages, one on the other's output, on real tables, on awkward rows and on nothing."""

from pyspark.sql import functions as F

from tests.llm import cases
from tests.llm.test_text_operators import brute_groups, lowered


def test_stages(spark, sf):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{sf}/documents.parquet").cache()
    columns, before = docs.columns, docs
    kept = []
    for name, stage in C.STAGES[:-1]:
        after = stage(spark, before, sf).cache()
        assert after.columns == columns
        assert {tuple(r) for r in after.collect()} <= {tuple(r) for r in before.collect()}
        kept.append((name, {r.doc_id: r.text for r in before.collect()}, {r.doc_id for r in after.collect()}))
        before = after
    names = [name for name, _, _ in kept]
    assert names == ["language", "quality", "exact_copies", "near_copies"]
    _, given, stayed = kept[2]
    owner = {}
    for i, t in given.items():
        owner[lowered(t)] = max(i, owner.get(lowered(t), i))
    assert stayed == set(owner.values())
    _, given, stayed = kept[3]
    assert stayed == {c for _, _, c in brute_groups(sorted(given.items()), 5, 80)}
    packed = C.run(spark, sf).collect()
    assert {r.doc_id for r in packed} == stayed
    assert len(kept[0][2]) >= 0.95 * docs.count()


def tables(spark, folder, rows, labels):
    documents = cases.docs(spark, rows).withColumn("n_chars", F.length("text").cast("long"))
    documents.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return documents


def test_awkward_rows(spark, tmp_path):
    import corpus_pipeline as C

    good = "the quick brown fox jumps over the lazy dog and runs away from number {} in the wood"
    rows = [*cases.DOCS, *[(100 + k, good.format(k) + f" with k{k} l{k} m{k} n{k} o{k}", "en", "a") for k in range(60)]]
    rows += [(None, good.format(3), "en", "a"), (None, good.format(3).upper(), None, None), (100, "another text under a repeated id, quite unlike the first", "en", "b")] * 2
    docs = tables(spark, tmp_path, rows, [(2, 1, 0), (None, 1, 1), (101, None, None), (102, 1, 0), (103, 1, 0)])
    before, kept = docs, []
    for _, stage in C.STAGES[:-1]:
        after = stage(spark, before, str(tmp_path)).cache()
        assert after.columns == docs.columns
        kept.append([(r.doc_id, r.text) for r in after.collect()])
        before = after
    language, quality, exact, near = kept
    assert {(0, None), (1, ""), (4, "12345 !!! ...")}.isdisjoint(language) and set(quality) <= set(language)
    texts = [lowered(t) for _, t in exact]
    assert len(texts) == len(set(texts)) and set(texts) == {lowered(t) for _, t in quality}
    assert sorted(lowered(t) for i, t in exact if i is None) == sorted({lowered(t) for i, t in quality if i is None} - {lowered(t) for i, t in quality if i is not None})
    groups = brute_groups(list(enumerate(t for _, t in exact)), 5, 80)
    assert len(near) == len({c for _, _, c in groups}) and set(near) <= set(exact)
    pieces = C.run(spark, str(tmp_path)).collect()
    assert sorted({r.doc_id for r in pieces}, key=repr) == sorted({i for i, _ in near}, key=repr)


def test_empty_tables(spark, tmp_path):
    import corpus_pipeline as C

    tables(spark, tmp_path, [], [])
    assert C.run(spark, str(tmp_path)).count() == 0


def test_everything_is_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op") and n[2].isdigit()} == {f"op{k}" for k in range(1, 11)}
