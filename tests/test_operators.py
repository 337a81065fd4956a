"""Chunker, dedup, labels, pairs, graphs, files and streams; catalogue against SQL."""

import json
import random
import re
import time
from datetime import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from textquarry.functions import text as X
from textquarry.operators import chunking as C
from textquarry.operators import dedup as D
from textquarry.operators import graph as G
from textquarry.operators import labeling as L
from textquarry.operators import merge as R
from textquarry.operators import pairs as P
from textquarry.plans import catalogue
from textquarry.sources import readers as IO
from textquarry.sources import writers as W
from textquarry.streaming import incremental as I

SF = "/root/testdata/sf0.001"


def plain_chunks(text):
    """An independent chunker."""
    sentences = [s for s in (x.strip() for x in re.split(r"(?<=[.!?])\s+(?=[A-ZʻʼЎЁЀ-Я])", text)) if s]
    groups, now = [], []
    for s in sentences:
        now.append(s)
        if sum(len(x.split()) for x in now) >= 100:
            groups, now = [*groups, now], []
    n = sum(len(x.split()) for x in now)
    if now and n >= 15:
        groups.append(now)
    elif now and groups:
        groups[-1] = groups[-1] + now
    return [" ".join(g) for g in groups]


def test_chunker(spark):
    rng = random.Random(2)
    texts = ["", "a b", "W " * 14 + "w.", "w " * 100 + "x.", ("Gap " + "w " * 49 + "x. ") * 2 + "T " + "w " * 12 + "x.", "W " * 500]
    for _ in range(60):
        texts.append(" ".join(("S" + "w" * rng.randint(1, 4) + " ") * rng.randint(1, 60) + rng.choice([".", "!", "?", "x."]) for _ in range(rng.randint(1, 12))))
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {}
    for r in C.chunk_documents(df, ["id"], least_length=0).orderBy("id", "chunk_id").collect():
        assert r.word_count == len(r.text.split()) and r.length == len(r.text)
        got.setdefault(r.id, []).append(r.text)
    for i, t in enumerate(texts):
        assert got.get(i, []) == plain_chunks(" ".join(t.split())), i


def plain_cuts(counts, close_at=100, least=15):
    out, held, begin = [], 0, 0
    for i, n in enumerate(counts, 1):
        held += n
        if held >= close_at:
            out.append((begin, i))
            held, begin = 0, i
    if held >= least:
        out.append((begin, len(counts)))
    elif held and out:
        out[-1] = (out[-1][0], len(counts))
    return out


def test_chunk_cuts_against_a_plain_walk(spark):
    rng = random.Random(1)
    cases = [[rng.choice([1, 3, 20, 60, 120]) for _ in range(n)] for n in (0, 1, 1, 2, 3, 5, 127, 128, 129, 255, 256, 300, 1000)]
    rows = [(i, [" ".join("w" * n) for n in c]) for i, c in enumerate(cases)]
    got = spark.createDataFrame(rows, "i int, s array<string>").select("i", C.chunk_cuts(F.col("s")).alias("c")).collect()
    assert all([(c.a, c.b) for c in r.c] == plain_cuts(cases[r.i]) for r in got)


def test_chunk_cuts_take_linear_time(spark):
    took = []
    for n in (5000, 40_000):
        df = spark.createDataFrame([([" ".join("w" * 100)] * n,)], "s array<string>").select(F.size(C.chunk_cuts(F.col("s"))).alias("n"))
        times = []
        for _ in range(2):
            began = time.time()
            assert df.first()["n"] == n
            times.append(time.time() - began)
        took.append(min(times))
    assert took[1] < 12 * took[0] + 2


def test_rare_words(spark):
    chunks = spark.createDataFrame([(k, "Tez tez tez tez. Bir!" if k == 0 else "bir bir") for k in range(2)] + [(2, "12 !")], "id long, text string")
    got = {r.id: r for r in C.complexity(chunks, ["id"]).collect()}
    assert got[0].rare_word_ratio == 0.2 and got[1].rare_word_ratio == 1 and got[2].complexity_score == 0 and got[0].avg_sentence_len == 2.5


def test_dedup_priorities(spark):
    rows = [("a [1] <b>", "u", 1, "x"), ("a", "u", 1, "y"), ("b", "u", 2, "x"), ("b", "u", 2, "dataset")]
    df = spark.createDataFrame(rows, "text string, url string, chunk_id int, file string")
    assert {r.text for r in D.fewest_artefacts(df, ["url", "chunk_id"], "text", ["file"]).collect()} == {"a", "b"}
    kept = D.by_priority(df, ["text"], F.when(F.col("file") == "dataset", 0).otherwise(1), ["file"]).collect()
    assert {r.file for r in kept if r.text == "b"} == {"dataset"} and len(kept) == 3
    same = spark.createDataFrame([(1, "A  b"), (2, " a B ")], "id long, text string")
    assert [r.id for r in D.normalised(same, "text", ["id"]).collect()] == [1]


def test_labels(spark):
    df = spark.createDataFrame([("Sud", "futbol final"), ("", "hech narsa"), ("sud sud", "futbol futbol")], "title string, text string")
    got = [r.d for r in df.select(L.by_keywords(F.col("title"), F.col("text")).alias("d")).collect()]
    assert got == ["sport", "other", "law"]  # a tie goes to the first of the lexicon
    chunks = spark.createDataFrame([("u", "sud", "bank bank"), ("u", "sud", "bank"), ("v", "", "")], "url string, title string, text string")
    assert {r.url: r.domain for r in L.article_domains(chunks, "url", "title", "text").collect()} == {"u": "law", "v": "other"}
    assert L.spread_domains(chunks, L.article_domains(chunks, "url", "title", "text"), "url").count() == 3


def test_walks(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "a"), ("a", "x"), ("x", "y")], "src string, dst string")
    seeds = spark.createDataFrame([("a",)], "node string")
    nodes = spark.createDataFrame([(n,) for n in "abcy"], "node string")
    got = {r.node: r.hop for r in G.breadth_first(edges, seeds, nodes).collect()}
    assert got == {"a": 0, "b": 1, "c": 2}  # x cannot be parsed and leads nowhere
    assert G.breadth_first(edges, seeds, max_docs=2).count() == 2
    tree = spark.createDataFrame([("r", "t2", 2, False), ("r", "s", 1, True), ("r", "t1", 3, False), ("s", "u", 1, False), ("s", "r", 2, True)], "category string, member string, position int, is_subcat boolean")
    assert [r.member for r in G.category_members(tree, "r", 2).orderBy("path").collect()] == ["t2", "t1", "u"]


def test_settings(spark):
    raw = spark.createDataFrame([("wild", "0.2", "9", "yes"), ("aggressive", "0.5", "4", "TRUE"), (None, "x", "2.5", None)], "aggressiveness string, max_length_ratio string, num_beams string, drop_dates string")
    got = [(r.aggressiveness, r.max_length_ratio, r.num_beams, r.drop_dates) for r in P.valid_settings(raw).collect()]
    assert got == [("balanced", 0.75, 8, False), ("aggressive", 0.5, 4, True), ("balanced", 0.75, 8, False)]


def test_splits_and_samples(spark):
    df = spark.range(2000).select(F.col("id").alias("doc_id"), (F.col("id") % 3).alias("g"), F.col("id").cast("string").alias("text"))
    parts = {r["g"]: r["n"] for r in P.stratified_split(df, ["doc_id"], "g").where("split = 'validation'").groupBy("g").agg(F.count("*").alias("n")).collect()}
    assert all(abs(n - 33) <= 2 for n in parts.values())
    assert 60 < P.random_split(df, ["doc_id"]).where("split = 'validation'").count() < 140
    mixed = P.mix_in(df.where("doc_id < 100"), df.where("doc_id >= 50"), ["doc_id"], "text").collect()
    assert 100 <= len(mixed) <= 130 and {r.doc_id for r in mixed} >= set(range(100))
    pairs = spark.createDataFrame([("a", " "), (None, "x"), ("y" * 3001, "b"), ("ok", "ok")], "text string, simplified string")
    both = ["text", "simplified_text"]
    assert [r.text for r in P.at_most(P.present(P.aligned(pairs), both, both), both).collect()] == ["ok"]


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("a\n\"b\", c", 1, "x"), ("d", None, "y")], "text string, n int, extra string")
    out = str(tmp_path / "out.csv")
    W.csv(df, out, ["text", "n"], check=True)
    back = IO.csv(spark, out, "text string, n int")
    assert sorted(r.text for r in back.collect()) == sorted(["a\n\"b\", c", "d"]) and back.columns == ["text", "n"]
    marked = str(tmp_path / "marked.csv")
    W.csv(df, marked, ["text", "n"], check=True, mark=True)
    assert all(f.read_bytes().startswith("\ufeff\"text\"".encode()) for f in (tmp_path / "marked.csv").glob("part-*") if f.stat().st_size)
    assert sorted((r.text, r.n) for r in IO.csv(spark, marked, "text string, n int").collect()) == sorted([("a\n\"b\", c", 1), ("d", None)], key=lambda x: x[0])
    for rows in (df, df.limit(0)):
        W.json_array(rows.select("text", "n"), str(tmp_path / "array"))
        with pytest.raises(ValueError, match="JSON lines"):
            W.json_array(spark.range(3), str(tmp_path / "refused"), most=2)
        got = json.loads("".join(f.read_text() for f in (tmp_path / "array").glob("part-*")))
        assert sorted(x["text"] for x in got) == sorted(r.text for r in rows.collect())
    W.csv(df.limit(0), str(tmp_path / "none"), ["text"])
    assert not (tmp_path / "none").exists()
    (tmp_path / "bom.csv").write_bytes("﻿url,x\nhttps://a,1\nhttps://a,2\n,3\n".encode())
    assert [r.url for r in IO.existing_keys(spark, [str(tmp_path / "bom.csv"), str(tmp_path / "missing.csv")]).collect()] == ["https://a"]
    store = str(tmp_path / "store")
    acts = spark.createDataFrame([("1", "t"), ("2", "u")], "id string, text string")
    assert W.append_new(acts, store, "id").count() == 2
    assert [r.id for r in W.append_new(acts.union(spark.createDataFrame([("3", "v")], acts.schema)), store, "id").collect()] == ["3"]
    assert spark.read.json(store).count() == 3
    with pytest.raises(ValueError):
        IO.simplify_input(spark.range(1))
    assert W.run_name("lex", datetime(2024, 5, 6, 7, 8)) == "lex_20240506_0708.csv"


def test_reports(spark):
    df = spark.createDataFrame([("a b", "x"), ("a b", None), ("", "y")], "text string, k string")
    r = R.quality_audit(df, "text", F.size(F.split("text", " "))).first()
    assert (r.n_rows, r.n_empty, r.n_duplicates, r.n_nulls) == (3, 1, 1, 1)
    files = spark.createDataFrame([("x",), ("z",)], "k string")
    assert {r.k: r.n for r in R.survivors(files, df, "k").collect()} == {"x": 1, "z": 0}


def test_files_of_earlier_runs(spark, tmp_path):
    (tmp_path / "in.csv").write_text("text\na\nb\n")
    source, output = str(tmp_path / "in.csv"), str(tmp_path / "out.csv")
    assert IO.resumed(spark, source, output).where("simplified_text is null").count() == 2
    (tmp_path / "out.csv").write_text("text,simplified_text\na,x\nb,\n")
    assert [r.text for r in P.pending_rows(IO.resumed(spark, source, output), None, "text", "simplified_text").collect()] == ["b"]
    items = "".join(f"<item><title>t{k}</title><link>{'' if k == 1 else f'https://a/{k}'}</link><pubDate>d{k}</pubDate></item>" for k in range(4))
    (tmp_path / "feed.xml").write_text(f"<rss><channel>{items}</channel></rss>")
    assert [(r.title, r.published) for r in IO.feed_entries(spark, str(tmp_path / "feed.xml"), most=3).orderBy("title").collect()] == [("t0", "d0"), ("t2", "d2")]
    W.markdown_files(spark.createDataFrame([("a", "# A\n\nx")], "name string, text string"), str(tmp_path / "md"), "name", "text")
    assert next((tmp_path / "md" / "name=a").glob("part-*")).read_text().strip() == "# A\n\nx"
    W.json(spark.createDataFrame([("1", "u", "t", "x", ["2"])], "id string, url string, title string, text string, linked_ids array<string>"), str(tmp_path / "acts"))
    assert IO.jsonl(spark, str(tmp_path / "acts")).first().linked_ids == ["2"]


def test_small_reports(spark):
    df = spark.createDataFrame([("a " * 100, "a " * 90, 100), ("a " * 100, "a " * 50, 100), ("b", "b", 1)], "text string, out string, n int")
    assert P.accepted(df, "text", "out", F.col("n"), 1).count() == 1 and P.accepted(df, "text", "out", F.col("n"), 2).count() == 2
    assert P.under_all_prefixes(spark.range(3), spark.createDataFrame([("p",), ("q",), ("p",)], "prefix string")).count() == 6
    seen = []
    observed = R.progress(df, "run", F.col("n") > 1)
    observed.collect()
    seen.append(observed.count())
    assert seen == [3]
    values = spark.createDataFrame([(float(v),) for v in [1, 1, 1, 5, 1e9, 2, float("nan")]] + [(None,)], "v double")
    r = R.latency_summary(values, "v").first()
    assert (r.median, r.least, r.most) == (1.5, 1, 1e9) and R.latency_summary(values.limit(0), "v").first().median is None
    few = [r.doc_id for r in P.smallest_draws(spark.range(500).withColumnRenamed("id", "doc_id"), ["doc_id"], 40, cells=8).collect()]
    assert sorted(few) == sorted(r.doc_id for r in P.sample_rows(spark.range(500).withColumnRenamed("id", "doc_id"), ["doc_id"], 40).collect())
    groups = spark.createDataFrame([(None if k % 3 == 0 else "g", k) for k in range(90)], "g string, k int")
    got = C.batches(groups, ["k"], 7, ["g"]).collect()
    assert all(r.batch == sum((x.g, ) == (r.g, ) and x.k < r.k for x in got) // 7 for r in got)


def test_stream_of_word_counts(spark, tmp_path):
    rows = [(datetime(2024, 1, 1, 10, m), "a b" if m < 30 else "b") for m in (0, 20, 40)] + [(datetime(2024, 1, 1, 13, 0), "c"), (datetime(2024, 1, 1, 16, 0), "d")]
    spark.createDataFrame(rows, "at timestamp, text string").write.parquet(str(tmp_path / "in"))
    stream = I.word_counts(I.landed(spark, str(tmp_path / "in"), "at timestamp, text string"), "at", F.split("text", " "))
    q = stream.writeStream.format("memory").queryName("counts").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.word, r.n) for r in spark.table("counts").collect()} >= {("a", 2), ("b", 3)}


def test_stream_resumes(spark, tmp_path):
    src, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs.where("doc_id < 100").write.mode("append").parquet(src)
    for _ in range(2):  # the second run finds nothing new
        I.run(I.landed(spark, src, "doc_id long, text string"), lambda b: C.chunk_documents(b, ["doc_id"]), out, mark).awaitTermination()
    first = spark.read.parquet(out).count()
    docs.where("doc_id >= 100").write.mode("append").parquet(src)
    I.run(I.landed(spark, src, "doc_id long, text string"), lambda b: C.chunk_documents(b, ["doc_id"]), out, mark).awaitTermination()
    assert 0 < first < spark.read.parquet(out).count() == C.chunk_documents(docs, ["doc_id"]).count()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def cells(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(repr([round(v, 9) if isinstance(v, float) else v for v in row]) for row in frame.where(frame.notna(), None).values.tolist())


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_catalogue_against_sql(spark, duck, name):
    assert cells(catalogue.QUERIES[name](spark, SF).toPandas()) == cells(duck.sql(catalogue.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_catalogue_rows(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def odd_documents(words, n, most):
    """A DuckDB connection with a table of composed texts, and the texts."""
    rng = random.Random(n)
    texts = {k: "".join(rng.choice(words) for _ in range(rng.randint(0, most))) for k in range(n)} | {n: None, n + 1: "", n + 2: " ", n + 3: "\n\n"}
    con = duckdb.connect()
    con.sql("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", [[k, t] for k, t in texts.items()])
    return con, texts


@pytest.mark.parametrize("limit", [5, 12, 40])
def test_sql_of_budget_splits(limit):
    con, texts = odd_documents(["a", "bc", "ü", ". ", ".", " ", "\n", "\n\n", "dddddddd"], 400, 40)
    ctes = catalogue.split_ctes("SELECT doc_id, coalesce(text, '') AS t FROM documents", limit)
    got = con.sql(f"WITH {ctes} SELECT doc_id, pos, part FROM parts").fetchall()
    assert sorted(got) == [(k, i, p) for k, t in texts.items() for i, p in enumerate(X.fit_budget(t or "", limit))]


def test_sql_of_collapsed_repeats():
    con, texts = odd_documents(["a ", "b ", "a b ", "c c c ", " ", "a b c a b ", "d\n"], 400, 25)
    got = con.sql(catalogue.ORACLE_SQL["repeat_collapse"]).fetchall()
    assert sorted(got) == [(k, t if t is None else X.collapse(t)) for k, t in texts.items()]


def test_entry(spark):
    assert entry.entry(spark).count() == 751  # chunks at this size, as an independent count gave
    assert set(entry.oracle_sql()) <= set(entry.queries())
