"""Search, resolution, selection, review, snapshots and the gate on small literal tables: the cases that their definitions name."""

from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import filters as V
from graphloom.operators import gate as H
from graphloom.operators import graph as G
from graphloom.operators import packs as P
from graphloom.operators import ranking as K
from graphloom.operators import relational as R
from graphloom.operators import resolution as N
from graphloom.operators import selection as C
from graphloom.operators import snapshots as S
from graphloom.sources import code
from graphloom.streaming import logs


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_words_of_a_stem(spark):
    def same(a, b):
        return spark.createDataFrame([(a,)], "w string").select(T.shares_stem(F.col("w"), b).alias("s")).first().s

    for a, b in (("indexing", "index"), ("indexer", "indexing"), ("scoring", "score"), ("extraction", "extract")):
        assert same(a, b) and same(b, a)
    for a, b in (("call", "callback"), ("test", "testament")):
        assert not same(a, b) and not same(b, a)
    assert T.query_tokens("PaymentService refund") == ["payment", "refund"] and T.query_tokens("*") == [] and T.query_tokens("SQLite") == ["sq", "lite", "sqlite"]


SYMBOL = "fq_name string, name string, kind string, file string, package string, role string, framework_role string, signature string, annotations array<string>, db_name string, synthetic boolean, in_degree long"


def symbols(spark, *data):
    return spark.createDataFrame([(fq, fq.rsplit(".", 1)[-1], kind, f"{fq}.java", "a", role, None, "", marks, db, syn, n) for fq, kind, role, marks, db, syn, n in data], SYMBOL)


def test_symbol_search(spark):
    s = symbols(
        spark, ("a.Note.title", "field", "main_source", [], "", False, 0), ("a.NoteTitle", "class", "main_source", [], "", False, 0), ("a.Answer", "class", "main_source", [], "quiz_answer", False, 0),
        ("a.Cfg.title", "field", "resource_config", [], "", False, 0), ("a.Get", "method", "main_source", [], "", True, 3), ("a.Tx", "class", "main_source", ["Transactional"], "", False, 0), ("a.Empty", "class", "main_source", None, None, None, None),
    )
    top = lambda q: [r.fq_name for r in K.search_symbols(s, q).collect()]
    assert top("Note.title")[:2] == ["a.Note.title", "a.NoteTitle"]  # a qualified member before a class that only reads alike
    assert top("where is the quiz_answer table used")[0] == "a.Answer"
    assert top("rollback of the transaction") == ["a.Tx"]
    assert top("title")[-1] == "a.Cfg.title" and len(top("*")) == 7 and top("zzz qqq") == []
    score = {r.fq_name: r.score for r in K.ranked_symbols(s, K.asked("Get")).collect()}
    assert score["a.Get"] == 120 + 10 + 10 - 60 + 8


def test_file_search(spark):
    files = spark.createDataFrame([(p, "java", "main_source", 0, None) for p in ("src/PaymentService.java", "src/service.java", "src/Other.java", "src/indexer.java")], "path string, language string, role string, degree long, bm25 long")
    s = symbols(spark, ("a.x", "field", "main_source", [], "", False, 0)).withColumn("file", F.lit("src/Other.java"))
    e = spark.createDataFrame([], "file string, method string, path string")
    top = lambda q: [r.path for r in K.search_files(files, s, e, q).collect()]
    assert top("payment service")[0] == "src/PaymentService.java"
    assert top("indexing pipeline")[0] == "src/indexer.java"
    assert top("open src/Other.java") == ["src/Other.java"]
    assert top("how does src/Other.java index")[0] == "src/Other.java" and len(top("how does src/Other.java index")) > 1


def test_visibility(spark):
    s = spark.createDataFrame([("a", "test_source", False), ("b", "generated", False), ("c", "mock_source", False), ("d", None, None), ("e", "main_source", True)], "name string, role string, synthetic boolean").withColumn("file", F.lit("x.java")).withColumn("framework_role", F.lit(None).cast("string")).withColumn("annotations", F.array().cast("array<string>"))
    names = lambda q, **kw: [r[0] for r in rows(V.visible_symbols(s, q, **kw), "name")]
    assert names("pay") == ["d"] and names("payTests") == ["a", "c", "d"] and names("latest pay") == ["d"]
    assert names("pay", generated=True, synthetic=True) == ["b", "d", "e"] and names("generated getter") == ["b", "d", "e"]
    assert names("pay", language="python") == []


def test_roles(spark):
    want = {
        "proto2-generated/A.java": "generated", "x/A.g.java": "generated", "gen/A.java": "main_source", "a/vendor/b.js": "vendored", "e2e_test/pages/A.ts": "test_source", "specs/a.py": "test_source", "latest/a.py": "main_source",
        "a/settings.gradle": "build_config", "a/.m2/x.java": "vendored", "run.sh": "resource_config", "a/__mocks__/b.ts": "mock_source", "src/AppTests.java": "test_source",
    }
    df = spark.createDataFrame([(p,) for p in want], "path string")
    assert {r.path: r.r for r in df.select("path", code.role_of(F.col("path")).alias("r")).collect()} == want


JAVA = """package com.a;
import com.a.Gateway;
import static java.util.List.of;
/* class Not { } */
@Service
public class OrderService extends Base<Order, Long> implements Api, Other {
    private final Gateway gateway = new Gateway("x; {");
    @Inject private Map<String, List<Order>> byId;
    public OrderService(Gateway g) { this.gateway = g; }
    @Override
    public Order place(Order o, int n) throws Failed, Broken {
        if (check(o)) { gateway.process(o); }
        items.forEach(i -> { audit.log(i); });
        for (int i = 0; i < n; i++) { total(); }
        return new Order(of(o));
    }
    enum State { A, B; int code() { return 1; } }
    interface Api { void go(); }
}
"""
SCRIPT = """import { x } from './a.js';
import type { Y } from "./b";
export class Cart extends Base implements Shop {
  private items: Item[] = [];
  constructor(private repo: Repo) { super(); }
  async add(item: Item): Promise<void> {
    await this.repo.save(item);
    const s = `not(${item}) {`;
  }
}
export function total(a: number) { return sum(a); }
const go = async (n: number): Promise<number> => {
  return total(n);
};
"""


def test_facts_of_brace_languages():
    java = {r[1:6] for r in code.brace_facts("a.java", JAVA, "java")}
    assert {
        ("import", "com.a.Gateway", None, 2, 2), ("import", "java.util.List.of", None, 3, 3), ("class", "OrderService", None, 5, 19), ("extends", "Base", "OrderService", 5, 5), ("implements", "Api", "OrderService", 5, 5), ("implements", "Other", "OrderService", 5, 5),
        ("field", "gateway", "OrderService", 7, 7), ("field", "byId", "OrderService", 8, 8), ("method", "place", "OrderService", 10, 16), ("method", "OrderService", "OrderService", 9, 9), ("call", "check", "OrderService.place", 12, 12),
        ("call", "gateway.process", "OrderService.place", 12, 12), ("call", "audit.log", "OrderService.place", 13, 13), ("call", "items.forEach", "OrderService.place", 13, 13), ("call", "total", "OrderService.place", 14, 14), ("call", "Order.new", "OrderService.place", 15, 15),
        ("call", "of", "OrderService.place", 15, 15), ("enum", "State", "OrderService", 17, 17), ("method", "code", "OrderService.State", 17, 17), ("interface", "Api", "OrderService", 18, 18),
    } <= java and not any(r[1] == "Not" for r in java)
    script = {r[1:6] for r in code.brace_facts("a.ts", SCRIPT, "typescript")}
    assert {
        ("import", "./a.js", None, 1, 1), ("import", "./b", None, 2, 2), ("class", "Cart", None, 3, 10), ("extends", "Base", "Cart", 3, 3), ("field", "items", "Cart", 4, 4), ("method", "constructor", "Cart", 5, 5), ("method", "add", "Cart", 6, 9),
        ("call", "this.repo.save", "Cart.add", 7, 7), ("function", "total", None, 11, 11), ("call", "sum", "total", 11, 11), ("function", "go", None, 12, 14), ("call", "total", "go", 13, 13),
    } <= script
    broken = code.brace_facts("a.ts", "export class A {\n  go() {\n", "typescript")
    assert broken and all(r[6] == 0.35 for r in broken)


def test_deep_python_files():
    deep = "x = " + "(" * 150 + "f()" + ")" * 150 + "\n" + "class A:\n" + "".join("    " * k + f"    def m{k}(self):\n" for k in range(60)) + "    " * 61 + "pass\n"
    got = code.python_facts("a.py", deep)
    assert ("a.py", "call", "f") in {r[:3] for r in got} and ("a.py", "method", "m0") in {r[:3] for r in got}
    assert code.python_facts("a.py", "(" * 5000)[0][1] == "parse_error"


def test_lookup_terms_and_exact_first(spark):
    assert N.lookup_terms("com.a.PaymentGateway.processPayment(int)") == ["com.a.PaymentGateway.processPayment", "PaymentGateway.processPayment", "com.a.PaymentGateway.processPayment(int)"]
    assert "AiNoteService" in N.lookup_terms("AiNoteService.new")
    c = spark.createDataFrame([("A.x", "OtherPaymentGateway.processPaymentExtra", "f", 1, 0.9, "primary"), ("B.y", "PaymentGateway.processPayment", "f", 2, 0.5, "primary")], "caller string, callee string, file string, line int, confidence double, tier string")
    assert [r.caller for r in G.named_calls(c, "PaymentGateway.processPayment", "callee", 10).collect()] == ["B.y", "A.x"]


def test_receivers(spark):
    c = spark.createDataFrame([("In.m", "go"), ("In.m", "super.go"), ("Sub.m", "super.go"), ("Sub.m", "repo.save"), ("Sub.m", "Other.run"), ("Sub.m", "x.run"), ("Loop.m", "no")], "caller string, callee string")
    extends = spark.createDataFrame([("Sub", "Base"), ("Loop", "Pool"), ("Pool", "Loop")], "child string, parent string")
    outer = spark.createDataFrame([("In", "Sub")], "child string, parent string")
    m = spark.createDataFrame([("Base", "go")], "owner string, method string")
    f = spark.createDataFrame([("Base", "repo", "Repo")], "owner string, field string, type string")
    got = {(r.caller, r.callee): (r.resolved, r.how, r.sure) for r in N.resolved_owners(c, m, f, extends, outer).collect()}
    assert got == {
        ("In.m", "go"): ("Base.go", "enclosing-method", 0.82), ("In.m", "super.go"): (None, None, None), ("Sub.m", "super.go"): ("Base.go", "super-method", 0.82), ("Sub.m", "repo.save"): ("Repo.save", "receiver-field", 0.8),
        ("Sub.m", "Other.run"): ("Other.run", "static-or-type-receiver", 0.8), ("Sub.m", "x.run"): (None, None, None), ("Loop.m", "no"): (None, None, None),
    }


def test_long_chains_are_closed(spark):
    up = spark.createDataFrame([(f"c{k}", f"c{k + 1}") for k in range(14)], "child string, parent string")
    assert G.ancestors(up).filter("child = 'c0'").count() == 14


def test_ci_selection(spark):
    files = spark.createDataFrame([("a.ts", "main_source"), ("a.test.ts", "test_source"), ("b.test.ts", "test_source"), ("c.yml", "resource_config")], "path string, role string")
    edges = spark.createDataFrame([("a.test.ts", "a.ts")], "a string, b string")
    change = lambda *x: spark.createDataFrame(list(x), "path string, status string")
    tests = lambda c: rows(C.selected_tests(c, files, edges), "path", "distance")
    assert tests(change(("a.ts", "M"), ("README.md", "M"))) == [("a.test.ts", 1)]
    assert tests(change(("b.test.ts", "M"))) == [("b.test.ts", 0)]
    verdict = lambda c: C.selection_verdict(c, files, C.selected_tests(c, files, edges)).first()
    assert not verdict(change(("a.ts", "M"), ("README.md", "M"))).run_all
    for bad in (("a.ts", "D"), ("c.yml", "M"), ("unknown.ts", "M"), ("Dockerfile", "M")):
        assert verdict(change(bad)).run_all


def test_containing_in_large_files(spark):
    spans = spark.createDataFrame([("f", f"m{k}", "method", 10 * k, 10 * k + 4) for k in range(40)] + [("f", "C", "class", 0, 200), ("g", "x", "field", 500, None)], "file string, fq_name string, kind string, line long, end_line long")
    pts = spark.createDataFrame([("f", k) for k in range(0, 420, 3)] + [("g", 1), ("h", 1)], "file string, at long")
    got = {(r.file, r.at): (r.fq_name, r.how) for r in R.containing(pts, spans).collect()}
    for (f, at), (name, how) in got.items():
        if f == "g":
            assert (name, how) == ("x", "nearest")
        elif at % 10 <= 4 and at < 395:
            assert (name, how) == (f"m{at // 10}", "containing")
        elif at <= 200:
            assert (name, how) == ("C", "containing")
        else:
            near = min([*((abs(10 * k - at), 10 * k, f"m{k}") for k in range(40)), (at, 0, "C")])
            assert (name, how) == (near[2], "nearest")
    assert ("h", 1) not in got and len(got) == 141


def test_shared_lines_by_rare_lines(spark):
    import random

    rng = random.Random(4)
    common = [f"a very common line {k}" for k in range(6)]
    texts = [(k, "\n".join(rng.sample(common, rng.randint(0, 6)) + rng.sample([f"line number {j}" for j in range(25)], rng.randint(0, 9)))) for k in range(120)]
    df = spark.createDataFrame(texts, "id long, text string")
    sets = {}
    for k, t in texts:
        sets.setdefault(frozenset(x.strip(" ") for x in t.split("\n") if len(x.strip(" ")) >= 8), k)
    want = {(min(a, b), max(a, b)) for x, a in sets.items() for y, b in sets.items() if a < b and len(x & y) >= 4 and len(x & y) / min(len(x), len(y)) >= 0.6}
    assert want and {(r.a, r.b) for r in R.shared_lines(df, "id", "text").collect()} == want


def test_snapshots(spark, tmp_path):
    base = str(tmp_path / "store")
    assert S.current(spark, base) is None
    for snap, n in (("s1", 3), ("s2", 5)):
        S.write_facts({"files": spark.range(n).toDF("id")}, base, snap)
        S.commit(spark, base, snap)
        assert S.current(spark, base) == snap and S.read_facts(spark, base, "files").count() == n
    assert S.read_facts(spark, base, "files", "s1").count() == 3
    (tmp_path / "x.tsv").write_text("a\\tb\\\\n\t\\N\t3\nplain\t1.5\t\\N\n")
    assert rows(S.copy_text(spark, str(tmp_path / "x.tsv"), "name string, v double, n long"), "name", "v", "n") == [("a\tb\\n", None, 3), ("plain", 1.5, None)]
    S.append_events(spark.createDataFrame([("q", 1)], "event string, ms int"), str(tmp_path / "log"))
    S.append_events(spark.createDataFrame([("q", 2)], "event string, ms int"), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    page = S.graph_page(spark.createDataFrame([("a</script>", "calls", "b", 2)], "source string, type string, target string, edge_count int"), "g")
    assert "a<\\/script>" in page and page.count("</script>") == 1


def test_gate(spark):
    assert H.gate_tokens("fix src/main/PaymentService.java now") == ["fix", "payment", "service", "paymentservice", "now"]
    texts = [
        "trace GET /api/orders/{id} in OrderService.find, see src\\main\\A.java.", "Find The Implementation in D:/work/app and /home/me/x/y", "the route /orders beats /src/main/java/a.java; POST /users wins", "open src/x.ts", None, "/v1/a or /v1/b (endpoint)",
    ]
    got = {r.id: r for r in H.explicit_names(spark.createDataFrame(list(enumerate(texts)), "id int, text string")).collect()}
    assert got[0].endpoint == "/api/orders/{id}" and got[0].members == ["OrderService.find"] and got[0].classes == ["OrderService"] and "src/main/A.java" in got[0].files and "OrderService.ts" in got[0].files
    assert (got[1].endpoint, got[1].members, got[1].classes) == (None, [], [])  # words that name nothing, a drive, a home folder
    assert got[2].endpoint == "/users" and got[3].endpoint is None and got[3].files == ["src/x.ts"] and got[4].endpoint is None and got[4].files == []
    assert got[5].endpoint == "/v1/a"  # of equal ones the first
    s = P.section(spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"), "x", "k", "v", [F.desc("v")], 5)
    assert rows(s, "section", "place", "key") == [("x", 1, "b"), ("x", 2, "a")] and P.within(s, 2).count() == 1


def test_stream_ledger(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "session string, snapshot string, key string"
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # timeouts would keep batches coming
    for batch in ([("a", "s1", "k"), ("a", "s1", "k"), ("b", "s1", "k")], [("a", "s1", "k"), ("a", "s2", "k2")], [("a", "s2", "k")]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(src)
        q = logs.ledger(spark.readStream.schema(schema).parquet(src)).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(60)
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    assert rows(spark.read.parquet(out), "session", "key", "reused") == [("a", "k", False), ("a", "k", False), ("a", "k", True), ("a", "k", True), ("a", "k2", False), ("b", "k", False)]
