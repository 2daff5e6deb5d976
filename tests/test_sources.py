from fixtures import CARDNUM, frame, rows

from keyloom import Schema, fold
from keyloom.plans.nodes import Attribute, Cardinality
from keyloom.types import BaseType


def test_files_and_tables(spark, tmp_path):
    df = frame(spark, "val_id long, cardnum long", CARDNUM)
    for kind, options in (("parquet", {}), ("json", {}), ("orc", {}), ("csv", {"header": True, "inferSchema": True})):
        df.write.format(kind).options(**{k: v for k, v in options.items() if k == "header"}).save(f"{tmp_path}/{kind}")
        s = Schema(spark)
        d = s.register_path(f"{tmp_path}/{kind}", "val_id", kind, **options)
        assert rows(s.get(v=d["val_id"]).infer(["v"], d["cardnum"]).to_df()) == sorted(CARDNUM)
    df.createOrReplaceTempView("cards_view")
    s = Schema(spark)
    assert s.register_table("cards_view", "val_id")["cardnum"].type == BaseType.FLOAT


def test_pandas_frames(spark):
    frame_ = frame(spark, "val_id long, cardnum long", CARDNUM).toPandas()
    s = Schema(spark)
    d = s.insert_dataframe(frame_.set_index("val_id"), "val_id")
    assert rows(s.get(v=d["val_id"]).infer(["v"], d["cardnum"]).to_df()) == sorted(CARDNUM)


def test_nulls_are_no_values(spark):
    s = Schema(spark)
    d = s.register(frame(spark, "k long, a string, b string", [(1, "x", None), (2, None, None), (None, "y", "y"), (3, None, "z")]), "k")
    t = s.get(k=d["k"]).infer(["k"], d["a"]).infer(["k"], d["b"])
    assert rows(t.to_df()) == [(1, "x", None), (3, None, "z")]
    assert t.hidden_count() == 1


def test_a_dependency_with_its_own_data(spark):
    s = Schema(spark)
    d = s.register(frame(spark, "k long, a string", [(1, "x"), (2, "y")]), "k")
    n = s.add_node(Attribute("colour", BaseType.STRING))
    s.add_edge(d["a"], n, Cardinality.MANY_TO_ONE, frame(spark, "a string, colour string", [("x", "red")]), ["a"], ["colour"])
    t = s.get(k=d["k"]).infer(["k"], n)
    assert rows(t.to_df()) == [(1, "red")] and t.hidden_count() == 1


def test_own_aggregates_masks_and_display(spark):
    from pyspark.sql import functions as F

    s = Schema(spark)
    d = s.register(frame(spark, "val_id long, cardnum long", CARDNUM), "val_id")
    t = s.get(c=d["cardnum"]).infer(["c"], d["val_id"])
    t = t.mutate(spread=fold(lambda v: F.max(v) - F.min(v), t["val_id"], BaseType.FLOAT))
    t = t.mask("val_id", t["val_id"] > 2, "late")
    assert (2354, (2, 5), 3, (5,)) in rows(t.to_df())
    assert t.displayed(["c", "spread"], 1).header == "[c || spread]"
