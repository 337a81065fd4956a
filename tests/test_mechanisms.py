"""Plans at scale, keyword automaton, ROUGE, robots, the paged source, state across runs, progress rows, sketches."""

import json
import random
import re
import threading
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from textquarry.functions import scores as S
from textquarry.operators import chunking as C
from textquarry.operators import dedup as D
from textquarry.operators import labeling as L
from textquarry.operators import robots as B
from textquarry.operators import sketches as K
from textquarry.operators import storage
from textquarry.sources import paged
from textquarry.streaming import progress, seen

# --- plans ---------------------------------------------------------------------------------------


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcasts(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_rare_places_against_a_plain_count(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(1 << 60), f"w{int(rng.paretovariate(0.8))}") for _ in range(3000)]
    rows += [(rows[0][0], "twice"), (rows[0][0], "twice"), (5, "thrice"), (5, "thrice"), (9, "thrice"), (7, "same"), (7, "same"), (7, "same")]
    df = spark.createDataFrame(rows, "__k long, word string").repartition(5)
    n = Counter(w for _, w in rows)
    for rare in (1, 2, 3):
        got = sorted((r["__k"], r.word) for r in C.rare_places(df, rare).collect())
        assert got == sorted(r for r in rows if n[r[1]] <= rare)
    with pytest.raises(ValueError):
        C.rare_places(df, 4)


def test_no_exchange_carries_all_words(spark, no_broadcasts):
    """With broadcasts off, words meet as one row per word and task, and no row is joined to words."""
    docs = spark.createDataFrame([(k, f"The {'the ' * 150} end{k}. Another sentence here {k}.") for k in range(40)], "id long, text string").repartition(4)
    df = C.complexity(C.chunk_documents(docs, ["id"]), ["id", "chunk_id"])
    text = plan_of(df)
    assert not re.search(r"Generate explode\(__w[^\n]*\n[^\n]*Join", text) and "LeftSemi" not in text
    below = text.split("Exchange hashpartitioning(word")[1:]
    assert below and all(re.search(r"HashAggregate\(keys=\[word", part[:300]) for part in below)
    assert "ReadSchema: struct<__w:array<string>,__k:bigint>" in text or "ReadSchema: struct<__w:array<string>" in text
    assert df.count() == 40


def test_dedup_moves_keys_and_not_texts(spark, no_broadcasts):
    rows = [(k, f"text {k % 7}" if k % 3 else None, k % 2) for k in range(60)]
    df = spark.createDataFrame(rows, "id long, text string, x int").repartition(4)
    got = D.exact(df, ["text"], ["id"])
    assert "SortAggregate" not in plan_of(got)
    first = {}
    for i, t, x in rows:
        first.setdefault(t, (i, t, x))
    assert sorted(map(tuple, got.collect())) == sorted(first.values())


def test_dedup_of_ties_and_hot_keys(spark):
    rows = [(1, "a", 5)] * 50 + [(1, "b", 5), (2, "a", 5), (None, "c", 1), (3, "c", 1), (3, "c", 1), (4, "d", None)]
    df = spark.createDataFrame(rows, "id long, text string, x int").repartition(5)
    assert sorted(map(tuple, D.exact(df, ["text"], ["id"]).collect()), key=repr) == sorted([(1, "a", 5), (1, "b", 5), (None, "c", 1), (4, "d", None)], key=repr)
    assert sorted(map(tuple, D.exact(df, ["text"], ["x"]).select("text", "x").collect())) == [("a", 5), ("b", 5), ("c", 1), ("d", None)]
    assert D.exact(df.limit(0), ["text"], ["id"]).count() == 0


def test_durable_tables_are_pruned_and_released(spark):
    t = storage.durable(spark.range(10).selectExpr("id", "repeat('x', 100) AS text"), "probe")
    assert "ReadSchema: struct<id:bigint>" in plan_of(t.select("id")) and t.count() == 10
    path = t._durable
    storage.release(t)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    assert not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


# --- keywords ------------------------------------------------------------------------------------


def test_keywords_are_counted_as_replacing_would():
    rng = random.Random(4)
    lexicon = {"x": ["aa", "ab", "b "], "y": ["aba", "b", "AA"]}
    machine = L.automaton(tuple((d, tuple(ws)) for d, ws in lexicon.items()))
    for _ in range(500):
        text = "".join(rng.choice("ab ") for _ in range(rng.randrange(25)))
        assert L.hits(text, machine, 2) == [sum(text.count(w.lower()) for w in ws) for ws in lexicon.values()]


def test_all_keywords(spark):
    words = [(d, w) for d, ws in L.KEYWORDS.items() for w in ws]
    df = spark.createDataFrame([(d, w, f"... {w.upper()} ...") for d, w in words], "d string, w string, text string")
    got = df.select("d", "w", L.by_keywords(F.lit(""), F.col("text")).alias("g")).collect()
    plain = {w: {d: sum(f"... {w} ...".lower().count(x.lower()) for x in ws) for d, ws in L.KEYWORDS.items()} for _, w in words}
    assert all(r.g == max(plain[r.w], key=plain[r.w].get) for r in got)
    assert spark.range(1).select(L.by_keywords(F.lit(None).cast("string"), F.lit("")).alias("g")).first()["g"] == "other"


# --- ROUGE ---------------------------------------------------------------------------------------


def test_walk_through_a_long_pair_is_the_grid_walk():
    rng = random.Random(5)
    for _ in range(300):
        k = rng.choice([2, 4, 20])
        a, b = ([str(rng.randrange(k)) for _ in range(rng.randrange(40))] for _ in range(2))
        grid = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) - 1, -1, -1):
            for j in range(len(b) - 1, -1, -1):
                grid[i][j] = grid[i + 1][j + 1] + 1 if a[i] == b[j] else max(grid[i + 1][j], grid[i][j + 1])
        want, i, j = [], 0, 0
        while i < len(a) and j < len(b):
            if a[i] == b[j]:
                want.append((i, j))
                i, j = i + 1, j + 1
            elif grid[i + 1][j] >= grid[i][j + 1]:
                i += 1
            else:
                j += 1
        assert S._matches(a, b) == want and S._common(a, b) == grid[0][0]


def test_subsequences_of_long_pairs_take_little_memory():
    import tracemalloc

    rng = random.Random(6)
    a, b = ([str(rng.randrange(3000)) for _ in range(30_000)] for _ in range(2))
    tracemalloc.start()
    found = S._matches(a, b)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == S._common(a, b) and most < 100_000_000  # a grid has 900 million cells


# --- robots --------------------------------------------------------------------------------------

ROBOTS = """User-agent: other
Disallow: /

# all of us
User-agent: *
Disallow: /private   # but
Allow: /private/open
Disallow: /*.pdf$
Disallow: /a*/b*c
Disallow:
Crawl-delay: 5
"""


@pytest.mark.parametrize(
    ("path", "allowed"),
    [("/", True), ("/private", False), ("/private/x", False), ("/private/open/y", True), ("/x.pdf", False), ("/x.pdf?y", True), ("/x/y.pdf", False), ("/aq/bqc/", False), ("/a/bcd", False), ("/a/b", True), ("", True), ("?q=/private", True), ("/PRIVATE", True)],
)
def test_robots_rules(spark, path, allowed):
    urls = spark.createDataFrame([(f"https://Host.example{path}", 1)], "url string, rule int")
    files = spark.createDataFrame([("host.example", ROBOTS), ("else.example", None)], "host string, body string")
    row = B.gate(urls.drop("rule"), files, "me").first()
    assert row.allowed == allowed


def test_robots_groups(spark):
    body = "User-agent: a\nUser-agent: Bot\nDisallow: /x\nAllow: /x/y\n\nUser-agent: *\nDisallow: /"
    assert [r[:2] for r in B.rules_of(body, "Bot")] == [(False, "/x"), (True, "/x/y")]
    assert [r[:2] for r in B.rules_of(body, "Another")] == [(False, "/")] and B.rules_of(None, "Bot") == []
    urls = spark.createDataFrame([("https://u:p@h.example:80/x/z#f",), ("nonsense",), (None,), ("http://none.example/x",)], "url string")
    got = B.gate(urls, spark.createDataFrame([("h.example:80", body)], "host string, body string"), "Bot").collect()
    assert {(r.url, r.allowed, r.rule) for r in got} == {("https://u:p@h.example:80/x/z#f", False, "/x"), ("nonsense", True, None), (None, True, None), ("http://none.example/x", True, None)}


def test_patterns_with_many_stars_end():
    regex = B.as_regex("/" + "*a" * 12 + "$")
    assert regex and "(?>" in regex


# --- paged source --------------------------------------------------------------------------------


def land(folder, key, n, open_end=False):
    for k in range(n):
        body = {"query": {"categorymembers": [{"ns": 0, "title": f"{key}{k}"}]}}
        if k + 1 < n or open_end:
            body["continue"] = {"cmcontinue": f"m{k + 1}"}
        (folder / f"{key}-m{k}.json").write_text(json.dumps(body))


def options(folder, keys, **more):
    return {"url": f"file://{folder}/" + "{key}-{mark}.json", "keys": json.dumps(keys), "first": "m0", "wait": "0"} | more


def test_pages_in_a_batch(spark, tmp_path):
    paged.register(spark)
    land(tmp_path, "A", 3)
    land(tmp_path, "B", 1)
    (tmp_path / "D-m0.json").write_text("no json")
    got = spark.read.format("paged").options(**options(tmp_path, ["A", "B", "C", "D"])).load()
    assert sorted((r.key, r.page, r.mark) for r in got.collect()) == [("A", 0, "m0"), ("A", 1, "m1"), ("A", 2, "m2"), ("B", 0, "m0"), ("D", 0, "m0")]
    assert got.rdd.getNumPartitions() == 4
    assert spark.read.format("paged").options(**options(tmp_path, ["A"], most="2")).load().count() == 2


def test_pages_as_a_stream_that_starts_again(spark, tmp_path):
    paged.register(spark)
    land(tmp_path, "A", 3)
    land(tmp_path, "B", 1, open_end=True)

    def run(pages):
        stream = spark.readStream.format("paged").options(**options(tmp_path, ["A", "B", "C"], pages=str(pages))).load()
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start().awaitTermination()
        return sorted((r.key, r.page) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    assert run(1) == [("A", 0), ("B", 0)]
    assert run(1) == [("A", 0), ("A", 1), ("B", 0)]
    land(tmp_path, "B", 4)
    assert run(2) == [("A", 0), ("A", 1), ("A", 2), ("B", 0), ("B", 1), ("B", 2)]
    assert run(9) == [("A", 0), ("A", 1), ("A", 2), ("B", 0), ("B", 1), ("B", 2), ("B", 3)]
    assert len(run(9)) == 7


def test_a_server_that_blocks_and_fails(spark):
    paged.register(spark)
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            asked.append((time.monotonic(), self.path))
            times = sum(p == self.path for _, p in asked)
            status = 404 if "/C/" in self.path else 429 if times == 1 else 500 if times == 2 and "/A/" in self.path else 200
            self.send_response(status)
            self.end_headers()
            self.wfile.write(b'{"continue": {"cmcontinue": "1"}}' if self.path.endswith("/0") and status == 200 else b"{}")

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    o = {"url": f"http://127.0.0.1:{server.server_port}/{{key}}/{{mark}}", "keys": '["A", "C"]', "first": "0", "wait": "0.01", "blocked": "0.02", "pause": "0.05"}
    got = spark.read.format("paged").options(**o).load().collect()
    assert sorted((r.key, r.mark) for r in got) == [("A", "0"), ("A", "1")]
    times = [t for t, p in asked if p.startswith("/A/")]
    assert len(times) == 6 and times[-1] - times[0] > 0.2  # paced: five pauses, less the first connection
    with pytest.raises(Exception, match="127.0.0.1"):
        spark.read.format("paged").options(**o | {"keys": '["E"]', "attempts": "1"}).load().collect()
    server.shutdown()


# --- state, progress -----------------------------------------------------------------------------


def test_keys_are_emitted_once_in_two_runs(spark, tmp_path):
    listener = progress.publish(spark, f"file://{tmp_path}/events")

    def land_rows(rows):
        spark.createDataFrame(rows, "url string, at int, x string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run():
        stream = spark.readStream.schema("url string, at int, x string").parquet(f"{tmp_path}/in")
        query = seen.first_seen(stream, ["url"], ["at"]).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").queryName("seen").trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    first = [("a", 2, "late"), ("a", 1, "first"), ("b", 5, "b"), (None, 1, "no key")]
    land_rows(first)
    assert run() == [("a", 1, "first"), ("b", 5, "b")]
    land_rows([("a", 0, "again"), ("c", 1, "c"), ("c", 1, "c2")])
    assert [r[0] for r in run()] == ["a", "b", "c"]
    assert [r[0] for r in run()] == ["a", "b", "c"]
    got = sorted(tuple(r) for r in seen.deduplicated(spark.createDataFrame(first, "url string, at int, x string"), ["url"], ["at"]).collect())
    assert got == [("a", 1, "first"), ("b", 5, "b")]

    deadline = time.time() + 30
    while time.time() < deadline and progress.events(spark, f"file://{tmp_path}/events").where("event = 'terminated'").count() < 3:
        time.sleep(0.5)
    progress.withdraw(spark, listener)
    rows = progress.events(spark, f"file://{tmp_path}/events").collect()
    assert sorted(r.n_rows for r in rows if r.event == "progress" and r.n_rows) == [3, 4]
    assert {r.name for r in rows if r.event == "progress"} == {"seen"} and sum(r.event == "started" for r in rows) == 3
    assert not [r for r in rows if r.problem]
    told = progress.subscribe(spark, f"file://{tmp_path}/events").groupBy("event").count()
    told.writeStream.format("memory").queryName("told").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert {r.event: r["count"] for r in spark.table("told").collect()}["started"] == 3


# --- sketches ------------------------------------------------------------------------------------


@pytest.mark.parametrize("size", [5, 20, 1000])
def test_sketches_of_runs_keep_their_bounds(spark, size):
    rng = random.Random(size)
    rows = [(rng.choice("ab"), f"v{int(rng.paretovariate(1))}") for _ in range(8000)] + [("c", "only"), ("c", None), (None, "x")]
    df = spark.createDataFrame(rows, "g string, v string")
    runs = [K.sketch(part, "g", "v", size=size) for part in df.randomSplit([0.5, 0.3, 0.2], 3)]
    true = Counter((g, v) for g, v in rows if v is not None)
    for row in K.report(K.merge(runs, "g", size), "g", size).collect():
        own = {v: n for (g, v), n in true.items() if g == row.g}
        assert row.n_rows == sum(own.values()) and abs(row.n_values - len(own)) <= 0.05 * len(own) + 1
        assert row.error <= row.n_rows / (size + 1)
        heavy = {h["value"]: h["n"] for h in row.heavy}
        assert all(own[v] - row.error <= n <= own[v] for v, n in heavy.items())
        assert all(v in heavy for v, n in own.items() if n > row.n_rows / (size + 1))
