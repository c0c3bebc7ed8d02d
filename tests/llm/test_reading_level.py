import random

from inkwell.llm import reading_level as L

DATA = "/root/testdata/sf0.01"


def labelled(spark):
    rows = spark.read.parquet(f"{DATA}/graded_samples.parquet").orderBy("sample_id").collect()
    return [(r["lang"], r["text"], r["grade"]) for r in rows if r["text"]]


def test_held_out_accuracy(spark):
    rows = labelled(spark)
    random.Random(0).shuffle(rows)
    right = near = 0
    for k in range(10):
        models = L.LevelModels([r for i, r in enumerate(rows) if i % 10 != k])
        for lang, text, grade in rows[k::10]:
            level = models.level(text, lang)[0]
            right += level == grade
            near += abs(level - grade) <= 1
    assert right / len(rows) >= 0.78 and near / len(rows) >= 0.97


def test_edges(spark):
    samples = spark.read.parquet(f"{DATA}/graded_samples.parquet")
    ddl = "doc_id long, text string, source string, level string, lang int"
    rows = [(1, None, "a", "x", 1), (2, "", "a", "x", 1), (3, " \n", None, "x", 1), (4, "小猫看见苹果。", "a", "x", 1), (5, "The cat sees a red ball.", None, "x", 1), (5, "The cat sees a red ball.", None, "x", 1), (6, "的" * 200_000, "b", "x", 1)]
    df = spark.createDataFrame(rows, ddl)
    got = [(r["id"], r["level"], r["lang"]) for r in L.levels(df, samples).collect()]
    by = dict((i, (lv, lang)) for i, lv, lang in got)
    assert len(got) == 7 and by[1] == by[2] == by[3] == (None, None)
    assert by[4] == (1, "zh") and by[5] == (1, "en") and by[6][1] == "zh"
    profile = {(r["source"], r["level"]): r["documents"] for r in L.profile(L.levels(df, samples)).collect()}
    assert profile[None, 1] == 2
    assert L.levels(df.limit(0), samples).count() == 0
