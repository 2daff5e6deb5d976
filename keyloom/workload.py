"""Registered queries over the star schema: one for each operation, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .operators.table import Table
from .sources.schema import Dataset, Schema

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


class Star:
    """The star schema's tables, registered as they are asked for; nation and region columns are of one class each.

    Keys are checked by a test; the queries register without the check, which would scan each table once more.
    """

    KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "labels": "doc_id", "documents": "doc_id", "events": "event_id"}
    SAME = {"Region": ("r_regionkey", "n_regionkey"), "Nation": ("n_nationkey", "c_nationkey", "s_nationkey", "ship_nation", "bill_nation", "from_nation", "to_nation"), "Customer": ("c_custkey", "o_custkey")}

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.schema = Schema(spark)
        self.classes = {c: self.schema.create_class(c) for c in self.SAME}
        self.nodes: dict = {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def add(self, df: DataFrame, keys: str | list[str]) -> Dataset:
        data = self.schema.register(df, keys, check=False)
        for name, node in data.items():
            self.nodes[name] = node
            for c, members in self.SAME.items():
                if name in members:
                    self.schema.blend(node, self.classes[c], self.classes[c])
        return data

    def __getattr__(self, name: str):
        if name in self.KEYS:
            data = self.add(self.table(name), self.KEYS[name])
            setattr(self, name, data)
            return data
        raise AttributeError(name)

    def get(self, **keys) -> Table:
        return self.schema.get(**keys)

    def flows(self) -> Dataset:
        """Observed trade between nations: summed before it is registered, as a key has one value."""
        line, orders = self.table("lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice", "l_discount"), self.table("orders").select("o_orderkey", "o_custkey")
        supplier, customer = self.table("supplier").select("s_suppkey", "s_nationkey"), self.table("customer").select("c_custkey", "c_nationkey")
        joined = line.join(orders, line.l_orderkey == orders.o_orderkey).join(supplier, line.l_suppkey == supplier.s_suppkey).join(customer, orders.o_custkey == customer.c_custkey)
        summed = joined.groupBy(F.col("s_nationkey").alias("from_nation"), F.col("c_nationkey").alias("to_nation")).agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("volume"))
        return self.add(summed, ["from_nation", "to_nation"])

    def counts(self) -> Dataset:
        orders, customer = self.table("orders").select("o_custkey", "o_orderstatus", "o_orderpriority"), self.table("customer").select("c_custkey", "c_mktsegment")
        joined = orders.join(customer, orders.o_custkey == customer.c_custkey)
        return self.add(joined.groupBy(F.col("c_mktsegment").alias("seg"), F.col("o_orderstatus").alias("st"), F.col("o_orderpriority").alias("pr")).agg(F.count("*").cast("double").alias("n")), ["seg", "st", "pr"])


def text(name: str) -> F.Column:
    return F.concat_ws(",", F.transform(name, lambda x: x.cast("string"))).alias(name)


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.select(*[F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in df.columns])


def _orders_of(star: Star, *values: str) -> Table:
    """[c || values]: lists over each customer's orders, all with one hidden key."""
    t = star.get(c=star.nodes["c_custkey"] if "c_custkey" in star.nodes else star.customer["c_custkey"])
    t = t.infer(["c"], star.orders["o_orderkey"])
    for v in values:
        t = t.infer(["o_orderkey"], star.orders[v])
    return t


@query("SELECT n_nationkey AS nation, n_name FROM nation")
def q_get_infer(spark, sf_dir):
    s = Star(spark, sf_dir)
    return s.get(nation=s.nation["n_nationkey"]).infer(["nation"], s.nation["n_name"]).to_df()


@query("SELECT n_nationkey AS nation, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def q_class_hop(spark, sf_dir):
    s = Star(spark, sf_dir)
    return s.get(nation=s.nation["n_nationkey"]).infer(["nation"], s.region["r_name"]).to_df()


@query("SELECT c_custkey AS c, c_nationkey, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def q_chain(spark, sf_dir):
    s = Star(spark, sf_dir)
    t = s.get(c=s.customer["c_custkey"]).infer(["c"], s.customer["c_nationkey"])
    s.nation
    return t.infer(["c_nationkey"], s.region["r_name"]).to_df()


_TRADES = "SELECT l_orderkey AS t_order, min(s_nationkey) AS ship_nation, min(c_nationkey) AS bill_nation FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1"


@query(f"SELECT t_order AS o, n_name AS ship_name FROM ({_TRADES}) t JOIN nation ON ship_nation = n_nationkey")
def q_via(spark, sf_dir):
    s = Star(spark, sf_dir)
    line, orders, supplier, customer = (s.table(t) for t in ("lineitem", "orders", "supplier", "customer"))
    joined = line.select("l_orderkey", "l_suppkey").join(supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    joined = joined.join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    trades = s.add(joined.groupBy(F.col("l_orderkey").alias("t_order")).agg(F.min("s_nationkey").alias("ship_nation"), F.min("c_nationkey").alias("bill_nation")), "t_order")
    t = s.get(o=trades["t_order"])
    return t.infer(["o"], s.nation["n_name"], via=[trades["ship_nation"]], with_name="ship_name").to_df()


@query("SELECT r_regionkey AS region, seg, r_name FROM region CROSS JOIN (SELECT DISTINCT c_mktsegment AS seg FROM customer) c")
def q_cross_weak(spark, sf_dir):
    s = Star(spark, sf_dir)
    return s.get(region=s.region["r_regionkey"], seg=s.customer["c_mktsegment"]).infer(["region"], s.region["r_name"]).to_df()


@query("SELECT o_custkey AS c, array_to_string(list(o_orderkey ORDER BY o_orderkey), ',') AS o_orderkey FROM orders GROUP BY o_custkey")
def q_reverse_list(spark, sf_dir):
    t = _orders_of(Star(spark, sf_dir))
    return t.to_df().select("c", text("o_orderkey"))


def _aggregate(name: str, sql: str, make, digits: int | None = None):
    def run(spark, sf_dir):
        t = _orders_of(Star(spark, sf_dir), "o_totalprice")
        df = t.mutate(x=make(t["o_totalprice"]))["x"].to_df()
        return rounded(df, x=digits) if digits is not None else df

    run.__name__ = name
    query(f"SELECT o_custkey AS c, {sql} AS x FROM orders GROUP BY o_custkey")(run)


_aggregate("q_sum", "round(sum(o_totalprice), 2)", lambda x: x.sum(), 2)
_aggregate("q_min", "min(o_totalprice)", lambda x: x.min())
_aggregate("q_max", "max(o_totalprice)", lambda x: x.max())
_aggregate("q_count", "CAST(count(o_totalprice) AS DOUBLE)", lambda x: x.count())
_aggregate("q_any", "bool_or(o_totalprice > 200000)", lambda x: (x > 200000).any())
_aggregate("q_all", "bool_and(o_totalprice > 200000)", lambda x: (x > 200000).all())
_aggregate("q_pop", "min_by(o_totalprice, o_orderkey)", lambda x: x.pop())
_aggregate("q_avg_idiom", "round(sum(o_totalprice) / count(o_totalprice), 5)", lambda x: x.sum() / x.count(), 5)
_aggregate("q_avg", "round(avg(o_totalprice), 5)", lambda x: x.avg(), 5)


@query("SELECT c_custkey AS c, c_name, n AS n_orders FROM customer LEFT JOIN (SELECT o_custkey, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY 1) o ON c_custkey = o_custkey")
def q_count_null(spark, sf_dir):
    s = Star(spark, sf_dir)
    t = s.get(c=s.customer["c_custkey"]).infer(["c"], s.customer["c_name"]).infer(["c"], s.orders["o_orderkey"])
    return t.mutate(n_orders=t["o_orderkey"].count()).hide("o_orderkey").to_df()


_COUNTS = "(SELECT c_mktsegment AS seg, o_orderstatus AS st, o_orderpriority AS pr, CAST(count(*) AS DOUBLE) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3)"


@query(f"SELECT seg, st, sum(n) AS total FROM {_COUNTS} t GROUP BY 1, 2")
def q_hide_sum(spark, sf_dir):
    s = Star(spark, sf_dir)
    d = s.counts()
    t = s.get(seg=d["seg"], st=d["st"], pr=d["pr"]).infer(["seg", "st", "pr"], d["n"]).hide("pr")
    return t.mutate(total=t["n"].sum()).hide("n").to_df()


@query("SELECT o_custkey AS c, o_orderkey AS o_orderkey_1, o_orderkey, o_totalprice FROM orders")
def q_show(spark, sf_dir):
    return _orders_of(Star(spark, sf_dir), "o_totalprice").show("o_orderkey_1").to_df()


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def q_compose(spark, sf_dir):
    s = Star(spark, sf_dir)
    t = s.get(nation=s.nation["n_nationkey"]).infer(["nation"], s.nation["n_name"])
    return t.compose([s.customer["c_custkey"]], "nation").to_df()


_FLOWS = (
    "(SELECT s_nationkey AS f, c_nationkey AS t, sum(l_extendedprice * (1 - l_discount)) AS v FROM lineitem JOIN supplier ON l_suppkey = s_suppkey"
    " JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"
)


def _flow_table(s: Star, d: Dataset | None = None) -> Table:
    d = d or s.flows()
    nation = s.classes["Nation"]
    return s.get(src=nation, dst=nation).infer(["src", "dst"], d["volume"])


@query(f"SELECT f AS src, round(v, 2) AS volume FROM {_FLOWS} x WHERE f = t")
def q_equate(spark, sf_dir):
    return rounded(_flow_table(Star(spark, sf_dir)).equate("src", "dst").to_df(), volume=2)


@query("SELECT c_custkey AS c, c_mktsegment, c_acctbal FROM customer")
def q_shift_right(spark, sf_dir):
    s = Star(spark, sf_dir)
    return s.get(c=s.customer["c_custkey"]).infer(["c"], s.customer["c_mktsegment"]).infer(["c"], s.customer["c_acctbal"]).shift_right().to_df()


@query(f"SELECT f AS src, d.l AS dst, array_to_string(list(CAST(round(v, 0) AS BIGINT) ORDER BY t), ',') AS volume FROM {_FLOWS} x CROSS JOIN (SELECT array_to_string(list(k ORDER BY k), ',') AS l FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) u) d GROUP BY 1, 2")
def q_shift_left(spark, sf_dir):
    t = _flow_table(Star(spark, sf_dir)).shift_left().to_df()
    return t.select("src", text("dst"), F.concat_ws(",", F.transform("volume", lambda x: F.round(x, 0).cast("long").cast("string"))).alias("volume"))


@query(f"SELECT t AS dst, f AS src, round(v, 2) AS volume FROM {_FLOWS} x")
def q_swap(spark, sf_dir):
    return rounded(_flow_table(Star(spark, sf_dir)).swap("src", "dst").to_df(), volume=2)


@query("SELECT p_partkey AS part, p_name AS title FROM part")
def q_rename(spark, sf_dir):
    s = Star(spark, sf_dir)
    return s.get(p=s.part["p_partkey"]).infer(["p"], s.part["p_name"]).rename("p_name", "title").rename("p", "part").to_df()


@query("SELECT n_name, array_to_string(list(c_custkey ORDER BY c_custkey), ',') AS c FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def q_invert(spark, sf_dir):
    s = Star(spark, sf_dir)
    t = s.get(c=s.customer["c_custkey"])
    return t.infer(["c"], s.nation["n_name"]).invert(["c"], ["n_name"]).to_df().select("n_name", text("c"))


@query("SELECT c_mktsegment, c_nationkey, CAST(count(*) AS DOUBLE) AS n, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY 1, 2")
def q_group_by(spark, sf_dir):
    s = Star(spark, sf_dir)
    t = s.get(c=s.customer["c_custkey"])
    for v in ("c_mktsegment", "c_nationkey", "c_acctbal"):
        t = t.infer(["c"], s.customer[v])
    t = t.group_by(["c_mktsegment", "c_nationkey"])
    t = t.mutate(n=t["c"].count(), balance=t["c_acctbal"].sum()).hide("c").hide("c_acctbal")
    return rounded(t.to_df(), balance=2)


def _parts(spark, sf_dir) -> tuple[Star, Table]:
    s = Star(spark, sf_dir)
    return s, s.get(p=s.part["p_partkey"]).infer(["p"], s.part["p_size"]).infer(["p"], s.part["p_retailprice"])


@query("SELECT p_partkey AS p, round(p_retailprice * 2 - p_size, 4) AS a, round(-p_retailprice / p_size, 4) AS b, round(p_retailprice / (p_size - p_size + 4), 4) AS d FROM part")
def q_arith(spark, sf_dir):
    _, t = _parts(spark, sf_dir)
    price, size = t["p_retailprice"], t["p_size"]
    t = t.mutate(a=price * 2 - size, b=-price / size, d=price / (size - size + 4)).hide("p_size").hide("p_retailprice")
    return rounded(t.to_df(), a=4, b=4, d=4)


@query("SELECT p_partkey AS p, p_size < 10 AS lt, p_size >= 25 AS ge, p_size = 7 AS eq, p_size <> 7 AS ne, p_brand = 'Brand#11' AS brand FROM part")
def q_compare(spark, sf_dir):
    s, t = _parts(spark, sf_dir)
    t = t.infer(["p"], s.part["p_brand"])
    size = t["p_size"]
    t = t.mutate(lt=size < 10, ge=size >= 25, eq=size == 7, ne=size != 7, brand=t["p_brand"] == "Brand#11")
    return t.hide("p_size").hide("p_retailprice").hide("p_brand").to_df()


@query("SELECT p_partkey AS p, (p_size < 10 AND p_retailprice > 1000) OR NOT (p_size < 40) AS x FROM part")
def q_bool(spark, sf_dir):
    _, t = _parts(spark, sf_dir)
    t = t.mutate(x=(t["p_size"] < 10) & (t["p_retailprice"] > 1000) | ~(t["p_size"] < 40))
    return t.hide("p_size").hide("p_retailprice").to_df()


@query("SELECT p_partkey AS p, p_size = 7 AS missing, p_size <> 7 AS there FROM part")
def q_isnull(spark, sf_dir):
    _, t = _parts(spark, sf_dir)
    ratio = (t["p_size"] - 7) * 0 / (t["p_size"] - 7)  # nothing by nothing is null
    t = t.mutate(missing=ratio.isnull(), there=ratio.isnotnull())
    return t.hide("p_size").hide("p_retailprice").to_df()


@query("SELECT p_partkey AS p, p_size, p_retailprice, p_retailprice AS dear FROM part WHERE p_retailprice > 950")
def q_mask_filter(spark, sf_dir):
    _, t = _parts(spark, sf_dir)
    return t.mutate(dear=t["p_retailprice"].mask(t["p_retailprice"] > 950)).filter("dear").to_df()


@query("SELECT o_custkey AS c, array_to_string(list(o_orderkey ORDER BY o_orderkey), ',') AS o_orderkey, array_to_string(list(CAST(floor(o_totalprice) AS BIGINT) ORDER BY o_orderkey), ',') AS o_totalprice FROM orders WHERE o_totalprice > 300000 GROUP BY 1")
def q_filter_list(spark, sf_dir):
    t = _orders_of(Star(spark, sf_dir), "o_totalprice")
    df = t.filter(t["o_totalprice"] > 300000).to_df()
    return df.select("c", text("o_orderkey"), F.concat_ws(",", F.transform("o_totalprice", lambda x: F.floor(x).cast("string"))).alias("o_totalprice"))


@query(f"WITH k AS (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) SELECT a.k AS src, b.k AS dst, round(coalesce(v, 0), 2) AS filled FROM k a CROSS JOIN k b LEFT JOIN {_FLOWS} x ON f = a.k AND t = b.k")
def q_extend(spark, sf_dir):
    t = _flow_table(Star(spark, sf_dir))
    return rounded(t.mutate(filled=t["volume"].extend(0)).hide("volume").to_df(), filled=2)


@query("SELECT o_custkey AS c, o_orderkey AS o_orderkey_1, round(o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey), 9) AS share FROM orders")
def q_ratio(spark, sf_dir):
    t = _orders_of(Star(spark, sf_dir), "o_totalprice")
    t = t.mutate(share=t["o_totalprice"] / t["o_totalprice"].sum()).hide("o_orderkey").hide("o_totalprice").show("o_orderkey_1")
    return rounded(t.to_df(), share=9)


@query("SELECT p_partkey AS p, p_size, p_retailprice FROM part ORDER BY p_size, p_partkey")
def q_sort(spark, sf_dir):
    _, t = _parts(spark, sf_dir)
    return t.sort(["p_size", "p"]).to_df()


@query(f"WITH o AS (SELECT f AS k, sum(v) AS ov FROM {_FLOWS} x GROUP BY 1), i AS (SELECT t AS k, sum(v) AS iv FROM {_FLOWS} y GROUP BY 1) SELECT k, round(ov, 2) AS outflow, round(iv, 2) AS inflow, round(ov - iv, 2) AS net FROM o FULL JOIN i USING (k)")
def q_netflow(spark, sf_dir):
    s = Star(spark, sf_dir)
    t = _flow_table(s)
    out, into = t.hide("dst"), t.hide("src")
    out, into = out.mutate(outflow=out["volume"].sum()), into.mutate(inflow=into["volume"].sum())
    j = s.get(k=s.classes["Nation"]).infer(["k"], out["outflow"]).infer(["k"], into["inflow"])
    return rounded(j.mutate(net=j["outflow"] - j["inflow"]).to_df(), outflow=2, inflow=2, net=2)


@query(
    f"WITH obs AS {_COUNTS}, h AS (SELECT seg, st, sum(n) AS hs FROM obs GROUP BY 1, 2), l AS (SELECT seg, pr, sum(n) AS ls FROM obs GROUP BY 1, 2), t AS (SELECT seg, sum(n) AS ts FROM obs GROUP BY 1),"
    " e AS (SELECT seg, n, hs * ls / ts AS ex FROM obs JOIN h USING (seg, st) JOIN l USING (seg, pr) JOIN t USING (seg)) SELECT seg, round(sum((n - ex) * (n - ex) / ex), 6) AS score FROM e GROUP BY seg"
)
def q_chisq(spark, sf_dir):
    s = Star(spark, sf_dir)
    d = s.counts()
    t = s.get(seg=d["seg"], st=d["st"], pr=d["pr"]).infer(["seg", "st", "pr"], d["n"])
    h, l, a = t.hide("pr"), t.hide("st"), t.hide("pr").hide("st")
    h, l, a = h.mutate(hs=h["n"].sum()), l.mutate(ls=l["n"].sum()), a.mutate(ts=a["n"].sum())
    j = t.infer(["seg", "st"], h["hs"]).infer(["seg", "pr"], l["ls"]).infer(["seg"], a["ts"])
    j = j.mutate(ex=j["hs"] * j["ls"] / j["ts"])
    j = j.mutate(stat=(j["n"] - j["ex"]) * (j["n"] - j["ex"]) / j["ex"]).hide("st").hide("pr")
    return rounded(j.mutate(score=j["stat"].sum())["score"].to_df(), score=6)


@query("SELECT c_custkey AS c, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def q_semi(spark, sf_dir):
    s = Star(spark, sf_dir)
    large = s.table("orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c"))
    return s.get(c=s.customer["c_custkey"]).infer(["c"], s.customer["c_name"]).semi_join(large, ["c"])


@query("SELECT c_custkey AS c, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def q_anti(spark, sf_dir):
    s = Star(spark, sf_dir)
    return s.get(c=s.customer["c_custkey"]).infer(["c"], s.customer["c_name"]).semi_join(s.table("orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c")), ["c"], anti=True)


@query("SELECT round(sum(o_totalprice), 2) AS total FROM orders")
def q_global_agg(spark, sf_dir):
    s = Star(spark, sf_dir)
    t = s.get(o=s.orders["o_orderkey"]).infer(["o"], s.orders["o_totalprice"]).hide("o")
    return rounded(t.mutate(total=t["o_totalprice"].sum())["total"].to_df(), total=2)


@query("SELECT o_orderkey AS o, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 10")
def q_limit(spark, sf_dir):
    s = Star(spark, sf_dir)
    return s.get(o=s.orders["o_orderkey"]).infer(["o"], s.orders["o_totalprice"]).sort(["o_totalprice", "o"]).limit(10)


@query("SELECT conv_id AS conv, CAST(count(text) AS DOUBLE) AS turns, min(role) FILTER (turn = first) AS opener FROM (SELECT *, min(turn) OVER (PARTITION BY conv_id) AS first FROM conversations) c GROUP BY conv_id")
def q_composite_key(spark, sf_dir):
    s = Star(spark, sf_dir)
    d = s.add(s.table("conversations"), ["conv_id", "turn"])
    t = s.get(conv=d["conv_id"], turn=d["turn"]).infer(["conv", "turn"], d["text"]).infer(["conv", "turn"], d["role"]).hide("turn")
    return t.mutate(turns=t["text"].count(), opener=t["role"].pop()).hide("text").hide("role").to_df()


@query("SELECT d.doc_id AS doc, lang, CAST(coalesce(quality, -1) AS DOUBLE) AS filled FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def q_extend_missing(spark, sf_dir):
    s = Star(spark, sf_dir)
    docs, labels = s.schema.register(s.table("documents"), "doc_id", check=False), s.schema.register(s.table("labels").withColumnRenamed("doc_id", "label_id"), "label_id", check=False)
    s.schema.blend(docs["doc_id"], labels["label_id"], s.schema.create_class("Doc"))
    t = s.get(doc=docs["doc_id"]).infer(["doc"], docs["lang"]).infer(["doc"], labels["quality"])
    t = t.mutate(filled=t["quality"].extend(-1)).hide("quality")
    return t.to_df()


@query("SELECT s_suppkey AS sup, (SELECT array_to_string(list(r_name ORDER BY r_name), ',') FROM region) AS regions FROM supplier WHERE s_name IS NOT NULL")
def q_whole_domain(spark, sf_dir):
    s = Star(spark, sf_dir)
    t = s.get(sup=s.supplier["s_suppkey"]).infer(["sup"], s.supplier["s_name"]).infer([], s.region["r_name"], with_name="regions")
    return t.hide("s_name").to_df().select("sup", text("regions"))


@query("SELECT event_type AS kind, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY 1")
def q_group_events(spark, sf_dir):
    s = Star(spark, sf_dir)
    t = s.get(e=s.events["event_id"]).infer(["e"], s.events["event_type"], with_name="kind").group_by(["kind"])
    return t.mutate(n=t["e"].count())["n"].to_df()


def _clients(s: Star) -> tuple[Dataset, Dataset]:
    """Two datasets over customers of one class: neither has all."""
    poor = s.add(s.table("customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("poor_key"), F.col("c_acctbal").alias("debt")), "poor_key")
    rich = s.add(s.table("customer").filter("c_acctbal > 8000 OR c_acctbal < -500").select(F.col("c_custkey").alias("rich_key"), F.col("c_name").alias("name")), "rich_key")
    s.schema.blend(poor["poor_key"], rich["rich_key"], s.schema.create_class("Client"))
    return poor, rich


@query("SELECT c_custkey AS k, CASE WHEN c_acctbal < 0 THEN c_acctbal ELSE 0.0 END AS owed FROM customer WHERE c_acctbal < 0 OR c_acctbal > 8000")
def q_class_union(spark, sf_dir):
    """The class's domain is the union of its members': keys of either dataset have a row."""
    s = Star(spark, sf_dir)
    poor, _ = _clients(s)
    t = s.get(k=s.schema.graph.concept_of(poor["poor_key"])).infer(["k"], poor["debt"])
    return t.mutate(owed=t["debt"].extend(0.0)).hide("debt").to_df()


@query("SELECT c_custkey AS k, c_name AS name FROM customer WHERE c_acctbal < -500")
def q_member_domain(spark, sf_dir):
    """A member's own domain, and values that another member's dataset has for it."""
    s = Star(spark, sf_dir)
    poor, rich = _clients(s)
    return s.get(k=poor["poor_key"]).infer(["k"], rich["name"]).to_df()


def _lines(spark, sf_dir) -> tuple[Star, Dataset, Table]:
    """lineitem itself: no columns are its key, its rows are distinct, so a hash of all of them is one."""
    s = Star(spark, sf_dir)
    line = s.table("lineitem")
    data = s.add(line.select(F.xxhash64(*line.columns).alias("l_id"), "l_orderkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount"), "l_id")
    return s, data, s.get(l=data["l_id"])


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY 1, 2")
def q_pricing(spark, sf_dir):
    _, d, t = _lines(spark, sf_dir)
    for v in ("l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount"):
        t = t.infer(["l"], d[v])
    t = t.mutate(net=t["l_extendedprice"] * (1 - t["l_discount"])).hide("l_extendedprice").hide("l_discount")
    t = t.group_by(["l_returnflag", "l_linestatus"])
    t = t.mutate(qty=t["l_quantity"].sum(), revenue=t["net"].sum(), n=t["l"].count())
    return rounded(t.hide("l_quantity").hide("net").hide("l").to_df(), revenue=2)


@query("SELECT n_name AS nation, round(sum(l_extendedprice), 2) AS total FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def q_supplier_nations(spark, sf_dir):
    """The engine finds the way from a line by its supplier to the nation's name, and joins lineitem along it."""
    s, d, t = _lines(spark, sf_dir)
    s.schema.blend(d["l_suppkey"], s.supplier["s_suppkey"], s.schema.create_class("Supplier"))
    t = t.infer(["l"], d["l_extendedprice"]).infer(["l"], s.nation["n_name"], via=[s.supplier["s_nationkey"]], with_name="nation")
    t = t.group_by(["nation"])
    return rounded(t.mutate(total=t["l_extendedprice"].sum()).hide("l_extendedprice").hide("l").to_df(), total=2)


@query("SELECT o_orderstatus AS status, CAST(count(*) AS DOUBLE) AS lines, round(sum(l_extendedprice), 2) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def q_order_lines(spark, sf_dir):
    s, d, t = _lines(spark, sf_dir)
    s.schema.blend(d["l_orderkey"], s.orders["o_orderkey"], s.schema.create_class("Order"))
    t = t.infer(["l"], d["l_extendedprice"]).infer(["l"], s.orders["o_orderstatus"], with_name="status").group_by(["status"])
    t = t.mutate(total=t["l_extendedprice"].sum(), lines=t["l"].count())
    return rounded(t.hide("l_extendedprice").hide("l").to_df(), total=2)


@query("SELECT p_partkey AS p, p_size, p_retailprice, p_size AS small FROM part WHERE p_size < 10 AND p_retailprice > 950")
def q_filter_not_null(spark, sf_dir):
    """Of two masked columns, rows where both have a value."""
    _, t = _parts(spark, sf_dir)
    t = t.mutate(small=t["p_size"].mask(t["p_size"] < 10), dear=t["p_retailprice"].mask(t["p_retailprice"] > 950))
    return t.filter("small").filter("dear").hide("dear").to_df()


@query("SELECT p_partkey AS p, p_size, p_retailprice FROM part")
def q_show_value(spark, sf_dir):
    """A value that was taken out of the display comes back, left of the marker."""
    _, t = _parts(spark, sf_dir)
    return t.hide("p_size").show("p_size").to_df()


@query("SELECT p_partkey AS p, p_retailprice FROM part")
def q_displayed(spark, sf_dir):
    _, t = _parts(spark, sf_dir)
    return t.displayed(["p", "p_retailprice"], 1).to_df()


@query("SELECT * FROM (VALUES ('n_nationkey', 'r_name', 'MANY_TO_ONE'), ('n_nationkey', 'n_name', 'MANY_TO_ONE'), ('r_name', 'n_name', 'MANY_TO_MANY'), ('r_regionkey', 'n_nationkey', 'ONE_TO_MANY')) x(source, target, cardinality)")
def q_cardinality(spark, sf_dir):
    """The cardinality of the shortest path between nodes, along keys and classes, forwards and back."""
    s = Star(spark, sf_dir)
    s.nation, s.region
    pairs = [("n_nationkey", "r_name"), ("n_nationkey", "n_name"), ("r_name", "n_name"), ("r_regionkey", "n_nationkey")]
    graph = s.schema.graph
    return spark.createDataFrame([(a, b, graph.cardinality(graph.path(s.nodes[a], s.nodes[b])).name) for a, b in pairs], "source string, target string, cardinality string")
