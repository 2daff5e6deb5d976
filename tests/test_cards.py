from fixtures import cards, rows


def test_reverse_inference_gives_lists(spark):
    s, c, _ = cards(spark)
    t = s.get(cardnum=c["cardnum"]).infer(["cardnum"], c["val_id"])
    assert t.header == "[cardnum || val_id]"
    assert t["val_id"].get_hidden_keys() == ["val_id_1"]
    assert rows(t.to_df()) == [(1111, (4,)), (1410, (3,)), (2354, (2, 5)), (4412, (8,)), (5172, (1,))]


def test_lists_of_one_hidden_key_pair_up(spark):
    s, c, _ = cards(spark)
    t = s.get(cardnum=c["cardnum"]).infer(["cardnum"], c["val_id"])
    t = t.deduce(t["cardnum"] + t["val_id"], "plus")
    assert rows(t.to_df())[2] == (2354, (2, 5), (2356.0, 2359.0))
    t = t.invert(["cardnum"], ["plus"])
    assert t.header == "[plus || val_id cardnum]"
    assert rows(t.to_df()) == [(1115.0, (4,), (1111,)), (1413.0, (3,), (1410,)), (2356.0, (2,), (2354,)), (2359.0, (5,), (2354,)), (4420.0, (8,), (4412,)), (5173.0, (1,), (5172,))]


def test_no_value_shows_nothing(spark):
    s, c, _ = cards(spark)
    t = s.get(val_id=c["val_id"])
    assert rows(t.to_df()) == [] and t.hidden_count() == 6


def _chain(spark):
    s, c, p = cards(spark)
    t = s.get(val_id=c["val_id"]).infer(["val_id"], c["cardnum"])
    t = t.infer(["cardnum"], p["cardnum"], with_name="person.cardnum")
    return t.infer(["person.cardnum"], p["person"])


def test_chain_through_a_class(spark):
    t = _chain(spark)
    assert rows(t.to_df()) == [(1, 5172, 5172, None), (2, 2354, 2354, "Steve"), (3, 1410, 1410, "Tom"), (4, 1111, 1111, "Steve"), (5, 2354, 2354, "Steve"), (8, 4412, 4412, None)]


def test_hidden_values_leave_their_rows(spark):
    t = _chain(spark).hide("person.cardnum").hide("cardnum")
    assert rows(t.to_df()) == [(2, "Steve"), (3, "Tom"), (4, "Steve"), (5, "Steve")]
    assert t.hidden_count() == 2


def test_extend_of_a_string(spark):
    t = _chain(spark)
    t = t.mutate(filled=t["person"].extend("Bob"))
    assert [r[-1] for r in rows(t.to_df())] == ["Bob", "Steve", "Tom", "Steve", "Steve", "Bob"]


def test_compose_then_invert(spark):
    s, c, p = cards(spark)
    t = s.get(cardnum=p["cardnum"]).infer(["cardnum"], p["person"]).compose([c["val_id"]], "cardnum")
    assert t.header == "[val_id || person]"
    assert rows(t.to_df()) == [(2, "Steve"), (3, "Tom"), (4, "Steve"), (5, "Steve")]
    t = t.invert(["val_id"], ["person"])
    assert rows(t.to_df()) == [("Steve", (2, 4, 5)), ("Tom", (3,))]
    assert t.hidden_count() == 2


def test_whole_domain_as_a_list(spark):
    s, c, p = cards(spark)
    t = s.get(val_id=c["val_id"]).infer([], p["person"])
    assert {r[1] for r in rows(t.to_df())} == {("Dick", "Harry", "Steve", "Tom")}
    assert len(rows(t.to_df())) == 6
