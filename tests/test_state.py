"""Paths, versioned logs, folds in order, sessions, streams: state that goes from one step to the next."""

import random
import threading
from collections import OrderedDict, defaultdict
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from graphloom.operators import architecture as A
from graphloom.operators import certificate as C
from graphloom.operators import dataflow as D
from graphloom.operators import failures as X
from graphloom.operators import gate as H
from graphloom.operators import graph as G
from graphloom.operators import packets as K
from graphloom.operators import relational as R
from graphloom.operators import resolution as N
from graphloom.operators import search as S
from graphloom.operators import versions
from graphloom.operators import versions as V
from graphloom.sources import code as CO
from graphloom.sources import frameworks as FW
from graphloom.sources import nested as J
from graphloom.streaming import folds, refresh


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_affected_tests(spark):
    edges = spark.createDataFrame([("t/a", "a"), ("b", "a"), ("t/b", "b"), ("t/iso", "iso")], "a string, b string")
    roles = spark.createDataFrame([("t/a", "test_source"), ("t/b", "test_source"), ("t/iso", "mock_source")], "node string, role string")
    changed = spark.createDataFrame([("a",), ("no such file",)], "node string")
    assert rows(G.affected_tests(edges, roles, changed), "node", "distance", "via") == [("t/a", 1, "a"), ("t/b", 2, "b")]
    assert rows(G.affected_tests(edges, roles, changed, 1), "node") == [("t/a",)]
    # a changed test counts only where it imports what is changed; tests are passed through; mocks count; the least way is named
    more = edges.union(spark.createDataFrame([("t/b", "t/a"), ("t/iso", "t/b"), ("t/iso", "t/c"), ("t/c", "t/c")], "a string, b string"))
    both = spark.createDataFrame([("a",), ("t/a",), ("t/c",)], "node string")
    got = rows(G.affected_tests(more, roles.union(spark.createDataFrame([("t/c", "test_source")], roles.schema)), both), "node", "distance", "via")
    assert got == [("t/a", 1, "a"), ("t/b", 1, "t/a"), ("t/iso", 1, "t/c")]


def test_flow_paths(spark):
    edges = spark.createDataFrame([("s", "b"), ("s", "a"), ("a", "x"), ("b", "x"), ("x", "y"), ("y", "s"), ("y", "z"), ("q", "z"), ("x", "x")], "a string, b string")
    seeds, targets = (spark.createDataFrame([(v,) for v in x], "node string") for x in (["s"], ["y", "x", "s", "z", "q", "z"]))
    got = rows(G.flow_paths(edges, seeds, targets, 3), "target", "depth", "path")
    assert got == [("s", 0, ["s"]), ("x", 2, ["s", "a", "x"]), ("y", 3, ["s", "a", "x", "y"])]
    assert rows(G.flow_paths(edges, seeds.union(spark.createDataFrame([("q",)], "node string")), targets, 9), "target", "path")[-1] == ("z", ["q", "z"])
    assert G.flow_paths(edges, seeds.limit(0), targets).count() == 0


def test_compare_and_set(spark, tmp_path):
    """Of writers who saw the same version exactly one wins; a reader always sees some version."""
    log = str(tmp_path / "log")
    assert V.read_version(spark, log) == (0, None)
    assert V.append(spark, log, {"who": 0}, 0) == 1
    for wrong in (0, 2, -1):
        with pytest.raises(V.Conflict):
            V.append(spark, log, {"who": 9}, wrong)
    seen, stop = [], threading.Event()

    def read():
        while not stop.is_set():
            seen.append(V.read_version(spark, log))

    def write(k):
        try:
            return V.append(spark, log, {"who": k}, at)
        except V.Conflict:
            return None

    reader = threading.Thread(target=read)
    reader.start()
    with ThreadPoolExecutor(6) as pool:
        for at in range(1, 8):
            won = list(pool.map(write, range(6)))
            assert sorted(x is None for x in won) == [False] + [True] * 5 and V.read_version(spark, log) == (at + 1, {"who": won.index(at + 1)})
        # conflicts are replayed: no increment is lost
        counter = str(tmp_path / "counter")
        list(pool.map(lambda _: [V.update(spark, counter, lambda b: {"n": (b or {"n": 0})["n"] + 1}) for _ in range(3)], range(6)))
    stop.set()
    reader.join()
    assert V.read_version(spark, counter) == (18, {"n": 18})
    assert all(b is not None for _, b in seen) and [n for n, _ in seen] == sorted(n for n, _ in seen)
    assert not [f for f in (tmp_path / "log").iterdir() if ".draft" in f.name and not f.name.endswith(".crc")]


def test_checkpoints(spark, tmp_path):
    base = str(tmp_path / "tasks")
    assert V.tasks(spark, base).count() == 0
    with pytest.raises(V.Conflict):
        V.save(spark, base, "t", "do it", "discovery", {}, expected=3)
    assert V.save(spark, base, "t", " do it ", "discovery", {"claims": [{"claim": "c", "file": "a.py"}]}, repo={"head": "1"}) == 1
    with pytest.raises(ValueError, match="expected version"):
        V.save(spark, base, "t", "do it", "impact", {})
    with pytest.raises(ValueError, match="not followed"):
        V.save(spark, base, "t", "do it", "review", {}, 1)
    with pytest.raises(ValueError, match="phase"):
        V.save(spark, base, "t", "do it", "dreaming", {}, 1)
    with pytest.raises(ValueError, match="task id"):
        V.save(spark, base, "../t", "do it", "impact", {})
    assert V.save(spark, base, "t", "other words", "implementation", {}, 1) == 2 and V.save(spark, base, "t", "do it", "verification", {}, 2) == 3
    assert V.save(spark, base, "t", "do it", "implementation", {}, 3) == 4  # back again
    with pytest.raises(KeyError):
        V.complete(spark, base, "unknown", 0, {})
    V.save(spark, base, "u", "second", "verification", {})
    assert V.complete(spark, base, "u", 1, {}) == 2
    with pytest.raises(ValueError, match="complete"):
        V.save(spark, base, "u", "second", "review", {}, 2)
    assert rows(V.tasks(spark, base), "task_id", "version", "task", "status", "phase") == [("t", 4, "do it", "active", "implementation"), ("u", 2, "second", "complete", "complete")]
    assert V.history(spark, base).count() == 6
    first = V.load(spark, base, "t", 1, {"head": "1"})
    assert first["resume_ready"] and first["state"]["claims"][0]["id"] == "claim-1" and first["phase"] == "discovery"
    stale = spark.createDataFrame([("claim-1", "stale"), ("claim-2", "missing")], "id string, status string")
    again = V.load(spark, base, "t", 1, {"head": "2"}, stale)
    assert not again["resume_ready"] and again["claims"] == {"claim-1": "stale"} and [a["tool"] for a in again["next_actions"]] == ["context", "slice"]
    with pytest.raises(KeyError):
        V.load(spark, base, "t", 9)


def test_replayed_saves(spark):
    s = spark.createDataFrame([("t", 1, "a", 0), ("t", 2, "b", 0), ("t", 3, "a", 1), ("t", 3, "b", 1), ("t", 4, "c", 7), ("u", 1, "a", 1), (None, 1, "a", 0), ("t", 5, "b", None)], "task string, at long, writer string, expected long").repartition(3)
    assert rows(V.replayed(s), "task", "at", "writer", "version", "accepted") == [("t", 1, "a", 0, True), ("t", 2, "b", 1, False), ("t", 3, "a", 1, True), ("t", 3, "b", 2, False), ("t", 4, "c", 2, False), ("t", 5, "b", 2, False), ("u", 1, "a", 0, False)]
    assert V.conflicts(s.limit(0)).count() == 0


# --- folds in order


def events_of(seed, n=300):
    rng = random.Random(seed)
    return [(f"w{rng.randint(0, 2)}", 1000 * rng.randint(0, 400), k, f"s{rng.randint(0, 6)}", rng.choice(["a", "a", "a", "b"]), f"e{rng.randint(0, 3)}") for k in range(n)]


EVENTS = "server string, ms long, id long, session string, snapshot string, evidence string"


def brute_sessions(events, most):
    kept, out = defaultdict(OrderedDict), []
    for server, _, i, session, snapshot, evidence in sorted(events, key=lambda e: (e[0], e[1], e[2])):
        own = kept[server]
        if session not in own or own[session][0] != snapshot:
            own[session] = (snapshot, set())
            if len(own) > most:
                own.popitem(last=False)
        out.append((server, i, evidence in own[session][1]))
        own[session][1].add(evidence)
    return sorted(out)


def test_sessions_are_kept_by_recency(spark):
    for most in (1, 3, 64):
        e = events_of(most)
        df = spark.createDataFrame(e + e[:50], EVENTS).repartition(5)  # rows that come again count once
        assert rows(folds.folded(df, folds.sessions(most)), "server", "id", "reused") == brute_sessions(e, most)
    assert folds.folded(spark.createDataFrame([(None, 1, 1, "s", "a", "e"), ("w", None, 1, "s", "a", "e")], EVENTS), folds.sessions()).count() == 0


def streamed(spark, tmp_path, batches, schema, fold, delay):
    """What a fold emits over files that come one after another, and again after a restart."""
    src, out, at = (str(tmp_path / x) for x in ("in", "out", "cp"))
    for k, v in folds.ROCKSDB.items():
        spark.conf.set(k, v)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "true")
    try:
        for batch in batches:
            spark.createDataFrame(batch, schema).selectExpr("timestamp_millis(ms) AS at", "* except (ms)").coalesce(1).write.mode("append").parquet(src)
            kind = spark.read.parquet(src).schema
            stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(src)
            q = folds.stream_folded(stream, fold, "at", delay).writeStream.format("parquet").option("path", out).option("checkpointLocation", at).outputMode("append").trigger(availableNow=True).start()
            assert q.awaitTermination(180) and q.exception() is None
    finally:
        for k in folds.ROCKSDB:
            spark.conf.unset(k)
    return spark.read.parquet(out)


def test_stream_of_sessions_agrees_with_the_table(spark, tmp_path):
    """Out of order within the delay, repeated, restarted between batches: the same rows as over the table."""
    e = sorted(events_of(8, 120), key=lambda x: x[1])
    rng = random.Random(1)
    late = sorted(e, key=lambda x: x[1] + rng.randint(0, 15_000))
    batches = [late[:50] + late[:10], late[40:90], late[90:] + [("w9", 10_000_000, 999, "end", "a", "x")]]
    got = streamed(spark, tmp_path, batches, EVENTS, folds.sessions(2), "60 seconds")
    assert rows(got, "server", "id", "reused") == brute_sessions(e, 2)


REVIEW = "review string, ms long, id long, event string, path string, status string, hunks int, resolved boolean, complete boolean, failed boolean"


def review_events():
    opened = [("r", 0, 1, "open", "a", "modified", 2), ("r", 0, 2, "open", "b", "deleted", 1), ("r", 10, 3, "open", "c", "added", 0), ("r", 20, 4, "open", None, "modified", -3), ("r", 30, 5, "open", "a", "modified", 1), ("r", 35, 6, "open", "slow", "modified", 4)]
    done = [("r", 40, 7, "batch", "a", True, True, False), ("r", 41, 8, "batch", "b", False, False, False), ("r", 42, 9, "batch", "c", True, False, False), ("r", 43, 10, "batch", None, False, True, True), ("r", 44, 11, "batch", "unknown", True, True, False), ("r", 60, 12, "batch", None, False, True, False)]
    return [(*x, None, None, None) for x in opened] + [(*x[:5], None, None, *x[5:]) for x in done]


def test_review_manifest(spark):
    df = spark.createDataFrame([*review_events(), *review_events()[:3], ("q", 5, 1, "batch", "x", None, None, True, True, False)], REVIEW).repartition(4)
    got = folds.folded(df, folds.review(timeout_ms=100), end=1000)
    mine = sorted((r for r in got.filter("review = 'r'").collect()), key=lambda r: r.n)
    assert [r.n for r in mine] == list(range(1, len(mine) + 1))
    # a file that nobody answers for is asked for once more, then it has failed
    assert [(r.ms, r.retry, r.settled) for r in mine if r.id is None] == [(135, "slow", False), (235, None, True)]
    assert [r.id for r in mine if r.id is not None] == list(range(1, 13))
    last = {r.review: r for r in folds.last_coverage(got).collect()}
    r = last["r"]
    # a: complete (3 hunks); b: deleted, omitted as it has a hunk; c: resolved without hunks; the unparsed one failed, then was reviewed
    assert (r.complete, r.settled, r.eligible, r.resolved, r.hunks, r.reviewed_hunks, r.omitted) == (False, True, 4, 2, 8, 3, 2)
    assert last["q"].complete and last["q"].settled and last["q"].eligible == 0
    at10 = next(x for x in mine if x.id == 10)
    assert (at10.omitted, at10.settled) == (3, False)


def test_stream_of_reviews_agrees_with_the_table(spark, tmp_path):
    scaled = [(r, 1_000_000 + ms * 1000, *rest) for r, ms, *rest in review_events()]  # a stream's watermark begins at 0
    rng = random.Random(2)
    mixed = sorted(scaled, key=lambda x: x[1] + rng.randint(0, 9_000))
    end = ("z", 9_000_000, 999, "open", "x", "added", 1, None, None, None)
    got = streamed(spark, tmp_path, [mixed[:5], mixed[3:9], [*mixed[9:], mixed[0]], [end]], REVIEW, folds.review(timeout_ms=100_000), "30 seconds")
    want = folds.folded(spark.createDataFrame(scaled, REVIEW), folds.review(timeout_ms=100_000), end=8_000_000)
    cols = [c for c in want.columns]
    assert rows(got.filter("review = 'r'"), *cols) == rows(want, *cols) and len(rows(want, "n")) == 14


# --- incremental refresh

SCHEMAS = {"symbols": "path string, name string", "lines": "path string, n long"}
CHANGES = "path string, deleted boolean, seq long, text string"


def derive(files):
    words = files.select("path", F.explode(F.split("text", " ")).alias("name"))
    return {"symbols": words, "lines": files.select("path", F.size(F.split("text", " ")).cast("long").alias("n"))}


def store(spark, base):
    return rows(refresh.facts(spark, base, "symbols", SCHEMAS["symbols"]), "path", "name"), rows(refresh.facts(spark, base, "lines", SCHEMAS["lines"]), "path", "n")


def want_of(changes):
    last = {}
    for path, deleted, seq, text in changes:
        if path not in last or seq > last[path][0]:
            last[path] = seq, deleted, text
    live = {p: t for p, (_, d, t) in last.items() if not d}
    return sorted((p, w) for p, t in live.items() for w in t.split(" ")), sorted((p, len(t.split(" "))) for p, t in live.items())


def test_refresh_is_idempotent(spark, tmp_path, monkeypatch):
    base = str(tmp_path / "facts")
    assert store(spark, base) == ([], [])
    batches = [[(f"f{k}", False, k, f"a b{k}") for k in range(9)], [("f1", True, 20, None), ("f2", False, 21, "x"), ("f2", False, 22, "y z"), ("new", None, 23, "n")], [("f2", True, 30, None), ("gone", True, 31, None)]]
    for n, b in enumerate(batches):
        df = spark.createDataFrame(b, CHANGES)
        if n == 1:  # a crash between the facts and the pointer leaves the old state, and the batch is done anew
            before = store(spark, base)
            with monkeypatch.context() as m:
                m.setattr(versions, "append", lambda *a: (_ for _ in ()).throw(OSError("lost")))
                with pytest.raises(OSError):
                    refresh.refresh(spark, base, n, df, derive, SCHEMAS, buckets=4)
            assert store(spark, base) == before
        assert refresh.refresh(spark, base, n, df, derive, SCHEMAS, buckets=4)
        now = store(spark, base)
        assert now == want_of([x for y in batches[: n + 1] for x in y])
        assert not refresh.refresh(spark, base, n, df, derive, SCHEMAS, buckets=4) and store(spark, base) == now
    # a batch reads and writes only its own buckets
    _, body = refresh.pointer(spark, base)
    assert len({f.split("/")[1] for f in body["buckets"]["symbols"].values()}) > 1
    assert refresh.refresh(spark, base, 9, spark.createDataFrame([], CHANGES), derive, SCHEMAS) and store(spark, base) == now


def test_refresh_stream_survives_a_crash(spark, tmp_path):
    src, base, at = (str(tmp_path / x) for x in ("in", "facts", "cp"))
    every = []
    crashed = []

    def derive_or_crash(files):
        if len(every) == 6 and not crashed:
            crashed.append(1)
            raise RuntimeError("killed")
        return derive(files)

    for n in range(3):
        batch = [(f"f{k}", k == n, 10 * n + k, f"t{n} u{k}") for k in range(3)]
        every += batch
        spark.createDataFrame(batch, CHANGES).coalesce(1).write.mode("append").parquet(src)
        for attempt in range(2):
            q = refresh.refresh_stream(spark.readStream.schema(CHANGES).parquet(src), base, derive_or_crash, SCHEMAS, at, buckets=3)
            try:
                q.awaitTermination(120)
                break
            except Exception:
                assert n == 1 and attempt == 0
        assert store(spark, base) == want_of(every)
    assert crashed


# --- folds over arrays, nested documents


def test_sequential_budget(spark):
    rng = random.Random(4)
    data = [(g, k, rng.choice([0, 100, 450, 900, 1500, 4000])) for g in range(6) for k in range(rng.randint(0, 12))]
    got = rows(R.spent_budget(spark.createDataFrame(data, "g int, k int, n long"), ["g"], [F.col("k")], "n", 3000, each=1200), "g", "k", "place", "taken", "truncated", "used")
    want = []
    for g in range(6):
        used = place = 0
        for _, k, n in [x for x in data if x[0] == g]:
            left = 3000 - used
            if left < 500 or place >= 5:
                break
            if n == 0:
                continue
            take = min(n, 1200, left)
            used, place = used + take, place + 1
            want.append((g, k, place, take, take < n, used))
    assert got == want and any(t for *_, t, _ in want)


def test_json_paths(spark):
    texts = ['{"a": {"b": [1, {"c": null}, [true, "x"]], "d": {}}, "e": "s"}', "[]", "7", '"text"', "null", "{broken", None, "", '{"deep":' * 5 + "1" + "}" * 5]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = rows(J.json_paths(df, "id", "t"), "id", "path", "kind", "value", "left_out")
    assert [x for x in got if x[0] == 0] == [(0, "$.a.b", "array", "3", 0), (0, "$.a.b[0]", "bigint", "1", 0), (0, "$.a.b[1].c", "null", "null", 0), (0, "$.a.b[2]", "array", "2", 0), (0, "$.a.b[2][0]", "boolean", "true", 0), (0, "$.a.b[2][1]", "string", "x", 0), (0, "$.e", "string", "s", 0)]
    assert [x[1:4] for x in got if 0 < x[0] < 8] == [("$", "array", "0"), ("$", "bigint", "7"), ("$", "string", "text"), ("$", "null", "null"), ("$", "invalid", None), ("$", "invalid", None)]
    some = rows(J.json_paths(df, "id", "t", items=1, depth=3), "id", "path", "kind", "left_out")
    assert (0, "$.a.b", "array", 2) in some and not any("[1]" in x[1] for x in some) and (8, "$.deep.deep.deep", "deeper", 0) in some
    d = {r.id: r for r in J.json_digest(df, "id", "t", fields=2, items=2).collect()}
    assert d[0].lines == "$.a.b.length=3\n$.a.b[0]=1" and d[0].n_fields == 4 and d[0].left_out == 2 + 1
    one = J.json_digest(spark.createDataFrame([(1, '{"x": 1, "status": "ok", "error": null}')], "id int, t string"), "id", "t").first()
    assert one.lines == "$.error=null\n$.status=ok" and one.left_out == 0
    assert J.json_paths(df.limit(0), "id", "t").count() == 0


def test_ordered_distinct(spark):
    rng = random.Random(6)
    data = [(f"k{rng.randint(0, 80)}", rng.randint(0, 300)) for _ in range(500)]
    first = {}
    for k, p in data:
        first[k] = min(p, first.get(k, p))
    got = rows(A.ordered_distinct(spark.createDataFrame(data, "key string, place long").repartition(4), "key", "place"), "rank", "key", "place")
    assert got == [(n + 1, k, p) for n, (p, k) in enumerate(sorted((p, k) for k, p in first.items()))]


def test_bare_names(spark):
    s = spark.createDataFrame([("a.f", "f", "method", "a", "main_source"), ("a.f2", "f", "method", "a", "main_source"), ("b.f", "f", "function", "b", "generated"), ("b.g", "g", "function", "b", "main_source"), ("b.g", "g", "class", "c", "main_source"), ("t.h", "h", "method", "t", "test_source"), ("b.h", "h", "method", "b", "main_source"), ("c.F", "k", "class", "c", "main_source")], "fq_name string, name string, kind string, file string, role string")
    c = spark.createDataFrame([("a", "f", "primary", "name-only", 0.4), ("c", "f", "primary", "name-only", 0.4), ("a", "g", "primary", "name-only", 0.4), ("a", "h", "primary", "name-only", 0.4), ("a", "k", "primary", "name-only", 0.4), ("a", "g", "low_signal", "name-only", 0.2), ("a", "g", "primary", "import", 0.9), ("a", "x.g", "primary", "name-only", 0.4)], "file string, callee string, tier string, resolution string, confidence double")
    got = rows(N.bare_names(c, s), "file", "callee", "resolution", "confidence")
    assert got == sorted([("a", "a.f", "name-local", 0.8), ("c", "f", "name-only", 0.4), ("a", "b.g", "name-unique", 0.75), ("a", "b.h", "name-unique", 0.75), ("a", "k", "name-only", 0.4), ("a", "g", "name-only", 0.2), ("a", "g", "import", 0.9), ("a", "x.g", "name-only", 0.4)])


def test_not_called(spark):
    f = spark.createDataFrame([("mailClient", None), ("store", "OrderRepository<Order>"), ("other", "x.y.TaxService"), ("odd", "Tax-Service"), ("plain", "String")], "name string, type string")
    left = lambda *texts: [r.name for r in N.not_called(f, spark.createDataFrame([(t,) for t in texts], "text string")).orderBy("name").collect()]
    assert left("unrelated.call") == ["mailClient", "odd", "other", "store"]
    assert left("this.mailClient.send", "a.orderrepositoryImpl.find", None) == ["odd", "other"]
    assert left("my tax-service.run", "oTHERs") == ["mailClient", "store"]
    assert N.not_called(f.filter("name = 'plain'"), spark.createDataFrame([("a",)], "text string")).count() == 0


def test_edges_left_out(spark):
    c = spark.createDataFrame([("a", "b"), ("", "b"), (None, "b"), ("a", "x" * 3000), ("a", "b\nc")], "caller string, callee string").selectExpr("*", "0.5D AS confidence", "'import' AS resolution")
    assert rows(N.left_out(c), "fault", "n") == [("line break", 1), ("no name", 2), ("too long", 1)]
    assert N.classified(c).count() == 1 and N.classified(c, None).count() == 2


def test_framework_roles(spark):
    df = spark.createDataFrame([(1, "class", ["Value", "Data"], []), (2, "field", ["Value"], []), (3, "class", ["Controller", "Path"], []), (4, "class", ["Component", "RestController"], []), (5, "class", ["Own"], []), (6, "method", ["Transactional"], ["jakarta.transaction.Transactional"]), (7, "method", ["Transactional"], ["org.springframework.Transactional"]), (8, "class", ["Repository"], ["javax.data.repository.Repository"]), (9, "class", None, [])], "id int, kind string, annotations array<string>, imports array<string>")
    a, k, i = F.col("annotations"), F.col("kind"), F.col("imports")
    got = {r.id: (r.one, r.all) for r in df.select("id", FW.framework_role(a, k, i).alias("one"), FW.framework_roles(a, k, i, {"Own": "own:role"}).alias("all")).collect()}
    assert got[1] == ("lombok:value", ["lombok:value", "lombok:data"]) and got[2][0] == "spring:config-value" and got[3][0] == "mvc:controller" and got[4] == ("spring:rest-controller", ["spring:component", "spring:rest-controller"])
    assert got[5] == (None, ["own:role"]) and got[6][0] == "jakarta:transactional" and got[7][0] == "spring:transactional" and got[8][0] == "jakarta:data" and got[9][0] is None
    c = spark.createDataFrame([("f", "User", 3, ["Data", "With", "Slf4j"]), ("f", "Plain", 9, ["Entity"])], "file string, class string, line long, annotations array<string>")
    fields = spark.createDataFrame([("f", "User", "name", 4, False), ("f", "User", "COUNT", 5, True), ("f", "Plain", "x", 10, False)], "file string, class string, field string, line long, is_static boolean")
    made = rows(FW.lombok_members(c, fields), "class", "name", "kind", "line", "is_static")
    assert made == sorted(("User", n, k, l, s) for n, k, l, s in [("log", "field", 3, True), ("equals", "method", 3, False), ("hashCode", "method", 3, False), ("toString", "method", 3, False), ("User", "method", 3, False), ("getName", "method", 4, False), ("setName", "method", 4, False), ("withName", "method", 4, False), ("getCOUNT", "method", 5, False), ("withCOUNT", "method", 5, False)])


def test_what_limits_leave_out_is_counted(spark, tmp_path):
    docs = spark.createDataFrame([(1, "aaa bbb bbb ccc"), (2, "aaa"), (3, None)], "id int, text string")
    assert rows(S.terms_left_out(docs, "id", "text", 2), "id", "n", "left_out") == [(1, 3, 1), (2, 1, 0)]
    assert S.term_artifact(docs, "id", "text", None).count() == 4
    lines = spark.createDataFrame([("f", k, "class Foo {" if k % 2 else "use Foo") for k in range(9)], "file string, line int, text string")
    assert rows(H.text_impact_left_out(lines, ["Foo"], 3, None), "kind", "n", "left_out") == [("definition", 4, 1), ("usage", 5, 0)]
    assert H.text_impact(lines, ["Foo"], 3, None).count() == 8
    log = spark.createDataFrame([(1, "\n".join(f"[ERROR] e{k}" for k in range(30)))], "id int, text string")
    assert rows(X.build_left_out(log, most=10), "section", "n", "left_out") == [("first", 30, 18), ("kept", 30, 20), ("last", 30, 10)]
    assert X.build_digest(log, most=None).filter("section = 'kept'").count() == 30
    assert rows(X.error_left_out(log, most=10), "section", "left_out") == [("last", 10), ("summary", 20)]
    (tmp_path / "node_modules").mkdir()
    for name, n in (("a.py", 10), ("big.py", 5000), ("node_modules/x.js", 5)):
        (tmp_path / name).write_text("x" * n)
    assert rows(CO.not_read(spark, str(tmp_path), 1000), "path", "size", "why") == [("big.py", 5000, "too large"), ("node_modules/x.js", 5, "folder")]
    assert CO.manifest(spark, str(tmp_path), 1000).count() == 1 and CO.manifest(spark, str(tmp_path), None).count() == 2


def test_packets(spark):
    s = spark.createDataFrame([("n.M", "find", "select"), ("n.M", "lost", "update")], "namespace string, id string, kind string")
    m = spark.createDataFrame([("n.M.find", "n.M", "find"), ("n.M.bare", "n.M", "bare"), ("n.Other.x", "n.Other", "x")], "fq_name string, owner string, name string")
    c = spark.createDataFrame([("a.Service.run", "M.find", "f", 3), ("b.Job.go", "n.M.find", "g", 4), ("x", "Q.find", "h", 5), ("web.Api.get", "Service.run", "w", 1)], "caller string, callee string, file string, line int")
    flow = K.mapper_flow(s, m, c)
    assert sorted((r.id, r.method or "", r.caller or "") for r in flow.collect()) == [("find", "n.M.find", "a.Service.run"), ("find", "n.M.find", "b.Job.go"), ("lost", "", "")]
    gaps = K.mapper_gaps(s, m)
    assert rows(gaps, "gap", "id") == [("method without statement", "bare"), ("statement without method", "lost")]
    got = rows(K.context_packet(flow, gaps, c), "section", "key", "value")
    assert ("entry", "web.Api.get", "Service.run") in got and ("callers", "b.Job.go", "n.M.find") in got and ("gaps", "n.M.lost", "statement without method") in got
    plan = spark.createDataFrame([("t", "src/", "allowed"), ("t", "docs/a.md", "allowed"), ("t", "src/must.py", "required"), ("t", "src/old.py", "frozen")], "task string, path string, part string")
    ch = spark.createDataFrame([("t", "src/x/a.py"), ("t", "srcs/b.py"), ("t", "docs/a.md"), ("t", "src/old.py"), ("t", "test/t.py"), ("u", "any.py")], "task string, path string")
    e = spark.createDataFrame([("test/t.py", "src/x/a.py"), ("src/x/a.py", "srcs/b.py")], "a string, b string")
    breaks = K.scope_breaks(plan, ch, e, spark.createDataFrame([("test/t.py",)], "path string"))
    assert rows(breaks, "task", "invariant", "path") == [
        ("t", "frozen but changed", "src/old.py"), ("t", "no test imports it", "docs/a.md"), ("t", "no test imports it", "src/old.py"), ("t", "no test imports it", "srcs/b.py"),
        ("t", "out of scope", "srcs/b.py"), ("t", "out of scope", "test/t.py"), ("t", "required but unchanged", "src/must.py"), ("u", "no test imports it", "any.py")]
    packet = K.change_packet(breaks, spark.createDataFrame([("p", 1)], "path string, distance int"), "u")
    assert rows(packet, "section", "key", "value") == [("impact", "p", "1"), ("invariants", "any.py", "no test imports it")]


def test_calculations(spark):
    lines = spark.createDataFrame([
        ("src/a.java", 1, "double base = price * 2; // rate = x"), ("src/a.java", 2, "  base += fee.amount + round(extra)"), ("src/a.java", 3, "final Map<String, Double> orderTotal = base + \"tax = 3\";"), ("src/a.java", 4, "if (base == 3) return x;"), ("src/a.java", 5, "misc = other"),
        ("src/a.java", 6, "result = price"), ("src/test/b.java", 1, "result = price"), ("src/a.java", 7, None)], "file string, line int, text string")
    a = D.assignments(lines)
    assert sorted((r.line, r.target, sorted(r.uses)) for r in a.filter("file = 'src/a.java'").collect()) == [(1, "base", ["price"]), (2, "base", ["base", "extra", "fee"]), (3, "orderTotal", ["base"]), (5, "misc", ["other"]), (6, "result", ["price"])]
    assert rows(D.outputs(a), "file", "name") == [("src/a.java", "misc"), ("src/a.java", "orderTotal"), ("src/a.java", "result"), ("src/test/b.java", "result")]
    cut = D.backward_slices(D.def_use(a), D.outputs(a).filter("name = 'orderTotal'"), 8)
    assert rows(cut, "name", "depth") == [("base", 1), ("extra", 2), ("fee", 2), ("orderTotal", 0), ("price", 2)]
    changed = spark.createDataFrame([("src/a.java", "price"), ("src/test/b.java", "price")], "file string, name string")
    got = rows(D.calculation_impact(a, changed), "group", "risk", "n", "names", "obligations")
    assert got == [("amount_or_total", "critical", 1, "orderTotal", "boundary values, zero/null/negative values, precision and rounding"), ("unknown_runtime_calculation_sink", "unknown", 1, "result", "boundary values, zero/null/negative values")]


def test_certificates(spark):
    s = spark.createDataFrame([("p", "symbols", "OrderService.run"), ("p", "evidence", "the FLOW of orders"), ("q", "files", None)], "packet string, section string, text string")
    r = spark.createDataFrame([(p, k) for p in "pqz" for k in ("handler", "tests", "order_flow", "order_zzz", "a_b", "risks", "evidence")], "packet string, key string")
    got = {(x.packet, x.key): (x.status, x.found, x.missing) for x in C.coverage(r, s).collect()}
    assert got["p", "handler"][0] == "covered" and got["p", "order_flow"] == ("covered", "flow order", "") and got["p", "order_zzz"] == ("partial", "order", "zzz") and got["p", "a_b"][0] == "covered" and got["p", "risks"][0] == "partial"
    assert got["q", "handler"][0] == "missing" and got["q", "a_b"][0] == "missing" and got["z", "order_flow"] == ("missing", "", "flow order") and got["q", "evidence"][0] == "missing"
    c = {x.packet: x for x in C.certificate(C.coverage(r, s)).collect()}
    assert not c["p"].answerable and c["p"].follow_up == "tests" and c["z"].n_missing == 6 and c["z"].n_partial == 1
