"""Near-duplicates without a written or shuffled row per shingle."""

import time

import pytest

import __spark_entry__ as entry
from lexispark.operators import linking as L

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["near_dup_pairs", "dup_components", "canonical_docs", "heldout_anti", "leakage_split"])
def test_no_shingle_is_written(spark, monkeypatch, name):
    real, seen = L.materialize, []

    def spy(df, label="t"):
        seen.extend(t for _, t in df.dtypes)
        return real(df, label)

    monkeypatch.setattr(L, "materialize", spy)
    assert entry.queries()[name](spark, SF).count() >= 0
    assert seen and "array<string>" not in seen


@pytest.mark.parametrize("name", ["dup_components", "heldout_anti", "canonical_docs", "leakage_split"])
def test_steps_leave_no_shuffle_files(spark, name):
    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f for k in range(found.size()) if (f := found.apply(k).getName()).startswith("shuffle_")}

    before = files()
    df = entry.queries()[name](spark, SF)
    until = time.time() + 15
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before
    assert df.count() >= 0


@pytest.mark.parametrize("name", ["canonical_docs", "leakage_split"])
def test_only_candidates_texts_are_written(spark, monkeypatch, name):
    real, texts = L.materialize, []

    def spy(df, label="t"):
        out = real(df, label)
        texts.extend([out.count()] if "text" in df.columns else [])
        return out

    monkeypatch.setattr(L, "materialize", spy)
    assert entry.queries()[name](spark, SF).count() > 0
    assert texts and max(texts) < spark.read.parquet(f"{SF}/documents.parquet").count() / 2


@pytest.mark.parametrize("few", [0, 30, 10_000])
def test_heads_by_broadcast_or_shuffle(spark, monkeypatch, few):
    monkeypatch.setattr(L, "FEW", few)
    words = [f"w{i}" for i in range(60)]
    rows = [(k, " ".join(f"{x}g{k // 4}" for x in words[: 60 - k % 2])) for k in range(160)]  # two texts, each twice, in each of 40 groups
    rows += [(5, "another text of a key that is there twice"), (7, None), (None, "a b c d e f"), (900, "")]
    ids, classes, pairs = L.similar_classes(spark.createDataFrame(rows, "id int, t string"), "id", "t")
    assert sorted((r.a, r.b) for r in pairs.collect()) == [(4 * g, 4 * g + 1) for g in range(40)]
    assert {r.class_key for r in classes.filter("substring(fp, 1, 1) = X'01'").collect()} == {None, 5, *[4 * g + d for g in range(40) for d in (0, 1)]}
    assert ids.count() == len(rows)


def test_leakage_split_shuffles_no_hash_of_one_prefix(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(L, "BUCKETS", 1 << 6)  # as with many texts, no counter is at 1
    write, postings, seen, rows = L.materialize, L._postings, {}, []

    def keep(df, label="t"):
        seen[label] = write(df, label)
        return seen[label]

    def spy(*args):
        run = postings(*args)
        rows.extend(seen["heads"].mapInArrow(run, "class_key bigint, n int, at int, g bigint").collect())
        return run

    monkeypatch.setattr(L, "materialize", keep)
    monkeypatch.setattr(L, "_postings", spy)
    words = [f"w{i}" for i in range(60)]
    docs = [(k, " ".join(f"{x}g{k // 2 if k < 40 else k}" for x in words[: 60 - k % 2])) for k in range(80)]  # 20 pairs, then 40 that share nothing
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = entry.queries()["leakage_split"](spark, str(tmp_path))
    assert {r.doc_id: r.class_id for r in got.collect()} == {k: k // 2 * 2 if k < 40 else k for k in range(80)}
    assert rows and {r.class_key for r in rows} == set(range(40))
    assert "fp" not in seen["own"].columns


def test_repeated_hashes_are_kept(spark):
    texts = [(k, bytes([k, 1, 1, 1, 1]) + bytes([k // 2, 2, 2, 2, 2]) + bytes(5)) for k in range(1, 101)]
    heads = spark.createDataFrame([(k, 3, bytearray(h)) for k, h in texts], "class_key int, n int, head binary").repartition(7)
    repeated = L._repeated(heads)
    rows = [r for k in range(L.ROUNDS) for r in heads.mapInArrow(L._postings(k, repeated[k]), "class_key int, n int, at int, g bigint").collect()]
    # the second hash of each is held by two keys, but those of the first and the last by one
    assert sorted((r.class_key, r.at) for r in rows) == [(k, 2) for k in range(2, 100)]
