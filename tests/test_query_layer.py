import pytest

from ledgerloom.plans.query import Compiler, Query, Relation, shown, similar_to_regex, stream_page


@pytest.fixture(scope="module")
def layer(spark):
    a = spark.createDataFrame([(1, "x", bytearray(b"\x01")), (2, None, bytearray(b"\xff")), (3, "Yz", None)], "id long, name string, raw binary")
    b = spark.createDataFrame([(1, 10, 1), (1, 20, 2), (2, 5, 3), (9, 1, 4)], "a long, v long, n long")
    tables = {"a": a, "b": b}
    return Compiler(tables.__getitem__, {"a": {"bs": Relation("b", ("id",), ("a",))}, "b": {"owner": Relation("a", ("a",), ("id",), False)}})


def ids(layer, tree, table="a", column="id"):
    return sorted(r[0] for r in layer.compile(Query(table, (column,), tree)).collect())


@pytest.mark.parametrize(
    ("tree", "want"),
    [
        ({"name": {"_eq": "x"}}, [1]),
        ({"name": {"_neq": "x"}}, [3]),
        ({"name": {"_is_null": True}}, [2]),
        ({"name": {"_nin": ["x"]}}, [3]),
        ({"id": {"_in": []}}, []),
        ({"name": {"_ilike": "y%"}}, [3]),
        ({"name": {"_like": "y%"}}, []),
        ({"name": {"_similar": "(x|Y_)"}}, [1, 3]),
        ({"raw": {"_eq": "\\xff"}}, [2]),
        ({"_or": [{"id": {"_eq": 1}}, {"id": {"_eq": 3}}]}, [1, 3]),
        ({"_or": []}, []),
        ({"_and": []}, [1, 2, 3]),
        ({"_not": {"id": {"_gt": 1}}}, [1]),
        ({"bs": {"v": {"_gt": 8}}}, [1]),
        ({"_not": {"bs": {}}}, [3]),
        ({"_or": [{"bs": {"v": {"_lt": 6}}}, {"name": {"_eq": "x"}}]}, [1, 2]),
        ({"_not": {"_or": [{"bs": {"v": {"_lt": 6}}}, {"id": {"_eq": 1}}]}}, [3]),
    ],
)
def test_filters(layer, tree, want):
    assert ids(layer, tree) == want


def test_order_and_pages(layer):
    def run(q):
        return [r.id for r in layer.compile(q.select("id")).collect()]

    q = Query("a")
    assert run(q.order_by({"name": "asc"})) == [3, 1, 2] and run(q.order_by({"name": "desc"})) == [2, 1, 3]
    assert run(q.order_by({"name": "asc_nulls_first"})) == [2, 3, 1]
    assert run(q.order_by({"id": "desc"}).offset(1).limit(1)) == [2]
    assert run(q.order_by({"bs_aggregate": {"count": "desc"}}, {"id": "asc"})) == [1, 2, 3]
    assert run(q.order_by({"bs_aggregate": {"sum": {"v": "asc"}}})) == [2, 1, 3]
    b = Query("b", ("n",)).order_by({"owner": {"name": "asc"}}, {"v": "desc"})
    got = [r.n for r in layer.compile(b).collect()]
    assert got[:2] == [2, 1] and set(got[2:]) == {3, 4}  # null names come last


def test_nested(layer):
    q = Query("a", ("id",)).with_nested(bs=Query("b", ("v",)).order_by({"v": "desc"}).limit(1)).order_by({"id": "asc"})
    assert [(r.id, [x.v for x in r.bs]) for r in layer.compile(q).collect()] == [(1, [20]), (2, [5]), (3, [])]
    q = Query("b", ("n",)).with_nested(owner=Query("a", ("name",))).order_by({"n": "asc"})
    assert [(r.n, r.owner and r.owner.name) for r in layer.compile(q).collect()] == [(1, "x"), (2, "x"), (3, None), (4, None)]
    d = Query("b", ("a", "v")).distinct_on("a").order_by({"a": "asc"}, {"v": "desc"})
    assert [tuple(r) for r in layer.compile(d).collect()] == [(1, 20), (2, 5), (9, 1)]


def test_nested_in_a_page(layer):
    """Parents that are cut first give the same lists as those that aren't."""
    sub = Query("b", ("v", "n")).order_by({"v": "desc"})
    for inner in (sub, sub.limit(1), sub.offset(1), sub.distinct_on("a"), sub.where({"v": {"_gt": 6}})):
        q = Query("a", ("id",)).order_by({"name": "desc"}, {"id": "asc"}).with_nested(bs=inner)
        every = [(r.id, [tuple(x) for x in r.bs]) for r in layer.compile(q).collect()]
        for skip, n in ((0, 9), (0, 2), (1, 1), (2, 5)):
            assert [(r.id, [tuple(x) for x in r.bs]) for r in layer.compile(q.offset(skip).limit(n)).collect()] == every[skip : skip + n]
    q = Query("b", ("n",)).order_by({"n": "desc"}).limit(3).with_nested(owner=Query("a", ("id",)))
    assert [(r.n, r.owner and r.owner.id) for r in layer.compile(q).collect()] == [(4, None), (3, 2), (2, 1)]


def test_computed_fields_on_demand(layer):
    made = []
    add = lambda df: (made.append(1), df.withColumn("twice", df["id"] * 2))[1]
    c = Compiler(layer.tables, layer.relations, computed={"a": {"twice": add}})
    assert [r.id for r in c.compile(Query("a", ("id",))).collect()] and not made
    assert sorted(r.twice for r in c.compile(Query("a", ("twice",))).collect()) == [2, 4, 6]
    assert [r.n for r in c.compile(Query("b", ("n",), {"owner": {"_not": {"twice": {"_gt": 2}}}}).order_by({"n": "asc"})).collect()] == [1, 2]
    assert [r.id for r in c.compile(Query("a", ("id",)).order_by({"twice": "desc"})).collect()] == [3, 2, 1]


def test_cursor_and_text(layer, spark):
    b = layer.tables("b")
    assert [r.n for r in stream_page(b, {"n": (None, "asc")}, 2).collect()] == [1, 2]
    assert [r.n for r in stream_page(b, {"n": (2, "asc")}, 5).collect()] == [3, 4]
    assert [r.n for r in stream_page(b, {"n": (3, "desc")}, 5).collect()] == [2, 1]
    assert [r.raw for r in shown(layer.tables("a")).orderBy("id").collect()] == ["\\x01", "\\xff", None]
    assert similar_to_regex("a%_.b") == r"(?s)^(?:a.*.\.b)$"
    with pytest.raises(ValueError, match="no column"):
        layer.compile(Query("a", None, {"nope": {"_eq": 1}}))
