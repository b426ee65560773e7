"""Declared names, their blocks, and the types of receivers."""

import pytest
from pyspark.sql import functions as F

from graphloom.operators import resolution as N
from graphloom.sources import types as T

JAVA = """package shop;
/* OrderGateway gateway; {
   PaymentClient old = 1; */
public class OrderService extends BaseService {
    private final OrderRepository orders; // InvoiceService x;
    private Map<String, List<Item>> byName = new HashMap<>();

    public Receipt place(Order order, PaymentClient client) {
        String quoted = "Fake fake = {";
        if (order.isNew()) {
            AuditLog orders = new AuditLog();
            orders.write(order);
        }
        orders.save(order);
        return client.charge(order.total());
    }

    void late() { helper.run(); client.none(); }
    private Helper helper;
}
"""
TS = """import { Gateway } from "./gateway";
export class Checkout {
  private gateway: PaymentGateway;
  constructor(private readonly log: Logger) {}
  run(cart: Cart, n?: number): Receipt {
    const stock = new Inventory();
    for (const line of cart.lines) {
      const gateway: Other<string> = make(`x`);
      gateway.send(line);
    }
    stock.take(n);
    return this.gateway.pay(cart);
  }
}
"""


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([("A.java", JAVA), ("none.java", None)], "file string, text string"), spark.createDataFrame([("c.ts", TS)], "file string, text string")


def test_code_lines_keep_numbers(files):
    got = {r.line: r.code for r in T.code_lines(files[0]).filter("file = 'A.java'").collect()}
    assert len(got) == len(JAVA.split("\n")) and "Gateway" not in got[2] and "Payment" not in got[3] and "Invoice" not in got[5] and "Fake" not in got[9]
    assert got[4].startswith("public class") and got[14].strip() == "orders.save(order);"


def test_blocks_are_matched(files):
    assert rows(T.blocks(T.code_lines(files[0])), "level", "begin", "end") == [(1, 4, 20), (2, 8, 16), (2, 18, 18), (3, 10, 13)]
    assert rows(T.blocks(T.code_lines(files[1])), "level", "begin", "end") == [(1, 1, 1), (1, 2, 14), (2, 4, 4), (2, 5, 13), (3, 7, 10)]


def test_java_receivers(files):
    names = T.typed_names(files[0], "java")
    got = rows(names, "line", "name", "type", "begin", "end")
    assert (5, "orders", "OrderRepository", 4, 20) in got and (6, "byName", "Map<String, List<Item>>", 4, 20) in got and (8, "order", "Order", 8, 16) in got and (8, "client", "PaymentClient", 8, 16) in got
    assert (11, "orders", "AuditLog", 10, 13) in got and not any(n in ("x", "old", "gateway", "fake") for _, n, *_ in got)
    uses = files[0].sparkSession.createDataFrame([(12, "orders"), (14, "orders"), (15, "client"), (18, "client"), (18, "helper"), (14, "unknown")], "line int, receiver string").withColumn("file", F.lit("A.java"))
    got = rows(T.receiver_types(uses, names).withColumn("type", F.coalesce("type", F.lit("-"))), "line", "receiver", "type")
    assert got == [(12, "orders", "AuditLog"), (14, "orders", "OrderRepository"), (14, "unknown", "-"), (15, "client", "PaymentClient"), (18, "client", "-"), (18, "helper", "Helper")]


def test_typescript_receivers(files):
    names = T.typed_names(files[1], "typescript")
    uses = files[1].sparkSession.createDataFrame([(9, "gateway"), (12, "gateway"), (11, "stock"), (7, "cart"), (3, "stock")], "line int, receiver string").withColumn("file", F.lit("c.ts"))
    got = rows(T.receiver_types(uses, names).withColumn("type", F.coalesce(T.simple_type(F.col("type")), F.lit("-"))), "line", "receiver", "type")
    assert got == [(3, "stock", "-"), (7, "cart", "Cart"), (9, "gateway", "Other"), (11, "stock", "Inventory"), (12, "gateway", "PaymentGateway")]
    assert {r.name: r.type for r in names.collect()}["log"] == "Logger"


def test_types_feed_receiver_resolution(spark, files):
    """Fields found in sources resolve calls by their receivers."""
    names = T.typed_names(files[0], "java").filter("level = 1").select(F.lit("OrderService").alias("owner"), F.col("name").alias("field"), T.simple_type(F.col("type")).alias("type"))
    calls = spark.createDataFrame([("OrderService.place", "orders.save"), ("OrderService.late", "helper.run")], "caller string, callee string")
    methods = spark.createDataFrame([("OrderRepository", "save")], "owner string, method string")
    pairs = spark.createDataFrame([("OrderService", "BaseService")], "child string, parent string")
    assert rows(N.resolved_owners(calls, methods, names, pairs, pairs.limit(0)), "callee" if "callee" in calls.columns else "resolved", "resolved", "how") == [("helper.run", "Helper.run", "receiver-field"), ("orders.save", "OrderRepository.save", "receiver-field")]


def test_typed_names_do_not_join_lines_again(spark):
    """Declarations know from their own line whether they are parameters: of the joins, none takes whole lines."""
    files = spark.createDataFrame([("A", "class A {\n  B b;\n  void m(C c) {\n    D d;\n  }\n}")], "file string, text string")
    found = T.typed_names(files, "java")
    assert found._jdf.queryExecution().analyzed().toString().count("Join ") == 3
    assert {(r.name, r.type, r.begin, r.end) for r in found.collect()} == {("b", "B", 1, 6), ("c", "C", 3, 5), ("d", "D", 3, 5)}
