import os

from inkwell import session


def test_cut_and_sweep(spark):
    session.sweep(spark)
    df = session.cut(spark.range(10).withColumnRenamed("id", "x"))
    path = session._CUTS[-1]
    assert df.count() == 10 and df.columns == ["x"] and os.path.isdir(path)
    assert session.sweep(spark) == 1 and not os.path.isdir(path)
    assert session.cut(spark.range(0)).count() == 0
