"""The pipeline's stages against their operators, and on odd input."""

import shutil

import corpus_pipeline as P
from llm_fixtures import SF, no_docs, odd_docs  # noqa: F401
from pyspark.sql import functions as F
from unhold.llm import mixing, neardup, packing, pii, quality
from unhold.llm.base import stored, table


def test_each_stage_takes_effect(spark):
    docs = table(spark, SF, "documents")
    first = stored(P.quality_stage(spark, docs, SF), "t")
    model = quality.learn(quality.labelled(spark, SF, docs))
    good = quality.score(docs, model).where("predicted = 1").select("doc_id")
    assert first.columns == docs.columns and first.select("doc_id").exceptAll(good).count() == 0 and first.count() == good.count()
    second = stored(P.near_duplicate_stage(spark, first, SF), "t")
    kept = neardup.digest(neardup.groups(first, threshold=P.NEAR_DUPLICATE_PERCENT)).where("kept").select("doc_id")
    assert second.columns == docs.columns and second.select("doc_id").exceptAll(kept).count() == 0 and second.count() == kept.count()
    third = stored(P.personal_data_stage(spark, second, SF), "t")
    assert third.columns == docs.columns and third.count() == second.count()
    assert pii.digest(pii.find(third)).agg(F.sum(F.col("n_email") + F.col("n_ip") + F.col("n_card") + F.col("n_phone"))).first()[0] == 0
    fourth = stored(P.mixing_stage(spark, third, SF), "t")
    assert fourth.columns == docs.columns and fourth.exceptAll(third).count() == 0 and fourth.count() == third.count()
    order = [r.doc_id for r in fourth.select("doc_id", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("n")).orderBy("f", "n").collect()]
    assert order == [r.doc_id for r in mixing.schedule(third).orderBy("slot", "hash", "doc_id").collect()]
    last = P.packing_stage(spark, fourth, SF)
    assert {r.doc_id for r in last.select("doc_id").collect()} == set(order)


def test_a_pair_of_082_loses_one(spark):
    """1,000 shingles each, 901 shared: 901 / 1,099 is 0.8198."""
    base = [f"w{i}" for i in range(1004)]
    other = base[:905] + [f"x{i}" for i in range(99)]
    far = base[:880] + [f"y{i}" for i in range(124)]  # 876 / 1,124 is 0.78
    rows = [(1, " ".join(base)), (2, " ".join(other)), (3, " ".join(f"z{i}" for i in range(500))), (4, " ".join(far))]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in P.near_duplicate_stage(spark, df, SF).collect()) == [1, 3, 4]
    assert sorted(r.doc_id for r in neardup.keep_one(df).collect()) == [1, 2, 3, 4]
    assert neardup.bands_for(80) == 29 and neardup.bands_for(85) == 20


def test_the_mix_survives_packing(spark, tmp):
    """Windows and sequences follow the schedule, although Spark reads the largest file first."""
    docs = spark.range(4000).selectExpr("id AS doc_id", "repeat('word ', CASE WHEN id % 5 = 0 THEN 900 ELSE 30 + id % 60 END) AS text",
                                        "concat('s', CASE WHEN id % 3 = 0 THEN 0 ELSE id % 7 END) AS source")
    mixed = mixing.ordered(docs, block_chars=4000, period=100)
    for n, part in enumerate(mixed.randomSplit([1.0, 2.0, 6.0], 1)):  # files that grow, and one order for each
        mixing.ordered(part, block_chars=4000, period=100).coalesce(1).write.mode("append").parquet(f"{tmp}/mixed/part={n}")
    back = spark.read.parquet(f"{tmp}/mixed")
    want = [r.doc_id for r in back.select("doc_id", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("n")).orderBy("f", "n").collect()]
    cut = stored(packing.pieces(back).withColumn("uid", F.monotonically_increasing_id()), "t")
    rows = packing._windows(cut.select("uid", "length", "file", "split"), 200).join(cut.select("uid", "doc_id"), "uid").orderBy("at").collect()
    assert [r["at"] for r in rows] == list(range(4000)) and [r.doc_id for r in rows] == want
    assert [r.doc_id for r in rows] != [r.doc_id for r in cut.orderBy("uid").collect()]  # the tasks' order is another
    at = {r.doc_id: (r["at"], r.shard) for r in rows}
    placed = packing.place(cut.select("uid", "length", "file", "split"), shard_pieces=200).join(cut.select("uid", "doc_id"), "uid").collect()
    inside = {}
    for r in placed:
        inside.setdefault(r.sequence_id, []).append(at[r.doc_id])
    assert all(min(a for a, _ in v) == s for s, v in inside.items())
    mixed_windows = sum(len({w for _, w in v}) > 1 for v in inside.values())
    assert mixed_windows < 0.1 * len(inside)  # only badly filled sequences are packed anew


def test_odd_and_empty_documents(spark, tmp, odd_docs, no_docs):
    for name, df in (("odd", odd_docs), ("none", no_docs)):
        df.write.parquet(f"{tmp}/{name}/documents.parquet")
        shutil.copytree(f"{SF}/labels.parquet", f"{tmp}/{name}/labels.parquet") if __import__("os").path.isdir(f"{SF}/labels.parquet") \
            else shutil.copy(f"{SF}/labels.parquet", f"{tmp}/{name}/labels.parquet")
        out = P.run(spark, f"{tmp}/{name}")
        assert (out.count() == 0) == (name == "none")
    assert [n for n, _ in P.STAGES] == ["quality", "near_duplicates", "personal_data", "mixing", "packing"]
