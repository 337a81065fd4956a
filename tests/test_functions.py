"""Text functions, Markdown, scores and policies against small vectors."""

import json
import random
import re
import time
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

from textquarry.functions import markdown as M
from textquarry.functions import pages as G
from textquarry.functions import scores as S
from textquarry.functions import text as X
from textquarry.operators import pairs as P
from textquarry.plans import catalogue
from textquarry.sources import readers as IO
from textquarry.sources import writers as W


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("function", "text", "expected"),
    [
        (X.squeeze, " a\xa0 b\t\nc ", "a b c"),
        (X.squeeze, None, ""),
        (X.strip_law_noise, "Modda Ҳужжатга таклиф юборишАудиони тинглашҲужжат элементидан ҳавола олиш 1. Oldingi tahrirga qarang. Matn", "Modda 1. Matn"),
        (X.strip_wiki, "Matn {{shablon}} https://a.b www.c.d Wayback machine == Tarix == davom == Manbalar == oxiri", "Matn davom"),
        (X.strip_wiki, "a === Havolalar === b", "a ="),
        (X.clean_corpus, "x [12] <b>y</b> z​ [a]", "x y z [a]"),
        (X.clean_for_model, "‎Bir\n Audioni TINGLASH \n\n\n\nIkki", "Bir\n\nIkki"),
        (X.strip_thinking, "<think>a\nb</think> c", "c"),
        (X.sentences, "Bir. Ikki!? \n.", ["Bir", "Ikki"]),
        (X.chunk_sentences, "Bir 3.5 gap. ikki. Uch. Ўзбек! Да", ["Bir 3.5 gap. ikki.", "Uch.", "Ўзбек!", "Да"]),
        (X.words, "Oʻzbek 12 tili'ni ЎҚИ", ["oʻzbek", "tili'ni", "ўқи"]),
        (X.word_count, "  a  b\xa0c ", 3),
        (X.word_count, " ", 0),
        (X.title_url, "Ona tili", "https://uz.wikipedia.org/wiki/Ona_tili"),
        (X.without_prefix, "Turkum:Fizika", "Fizika"),
        (X.needs_work, None, True),
        (X.needs_work, " \t", True),
        (X.needs_work, "NaN", True),
        (X.needs_work, "x", False),
        (X.collapse_repeats, "a b a b a b c c d", "a b c d"),
        (X.collapse_repeats, "yolg'iz", "yolg'iz"),
        (X.unescape, "women&#039;s &amp; men", "women's & men"),
        (X.article_links, '<a href="/news/view/a&amp;b"><a href="/news/view/a&b">', ["a&b"]),
        (X.collapse_repeats, "x a b c d a b c d a b c d x x y", "x a b c d x y"),
        (X.collapse_repeats, "a a a b a a a b", "a b"),
        (X.collapse_repeats, "", ""),
        (X.main_text, "<body><nav>no</nav><main><h1>Bir &amp; ikki</h1><p>Uch <b>to'rt</b><br>besh<script>x</script></main></body>", "Bir & ikki\nUch to'rt\nbesh"),
        (X.block_markers, "<h1>JUST A MOMENT</h1> CAPTCHA", ["Just a moment", "captcha"]),
        (X.article_links, '<a href="/news/view/a-1"><a href="https://sports.uz/news/view/b"><a href="/news/view/a-1">', ["a-1", "b"]),
    ],
)
def test_text_functions(spark, function, text, expected):
    assert one(spark, function(F.col("t")), text) == expected


def test_urls_guards_and_prefixes(spark):
    assert one(spark, X.url_slug(F.col("t"), "sports.uz"), "https://sports.uz/news/view/abc//") == "abc"
    assert one(spark, X.url_slug(F.col("t"), "sports.uz"), "https://other.uz/x") is None
    guard = lambda out: X.guard_output(F.lit("source text"), F.lit(out), F.lit("simplify: "))
    assert one(spark, guard("simplify:  short"), "") == "short" and one(spark, guard("longer than the source text"), "") == "source text"
    flag = lambda *v: X.flag_prefix(*[F.lit(x) for x in v])
    assert one(spark, flag("balanced", 0.75, False, False, False), "") == "simplify: "
    assert one(spark, flag("aggressive", 0.5, True, True, True), "") == "simplify [aggressiveness=aggressive, max_length=0.5, drop_dates=true, drop_law_refs=true, drop_stats=true]: "
    assert one(spark, X.max_new_tokens(F.lit(5), F.lit(0.5)), "") == 8 and one(spark, X.max_new_tokens(F.lit(25), F.lit(0.5)), "") == 12
    assert [one(spark, X.duration(F.lit(n)), "") for n in (-4, 5, 65, 3661)] == ["0s", "5s", "1m05s", "1h01m01s"]
    assert X.context_budget() == {"usable": 7842, "input": 5601, "predict": 2801, "max_chars": 16803}


def test_repeats_against_a_plain_walk():
    def plain(tokens, n):
        """Take a block, skip its copies; else take one word."""
        if not tokens:
            return []
        k = 1
        while len(tokens) >= n * (k + 1) and tokens[n * k : n * (k + 1)] == tokens[:n]:
            k += 1
        return tokens[:n] + plain(tokens[n * k :], n) if k > 1 else tokens[:1] + plain(tokens[1:], n)

    rng = random.Random(4)
    for _ in range(500):
        tokens = [rng.choice("abc"[: rng.randint(1, 3)]) for _ in range(rng.randint(1, 30))]
        expected = tokens
        for n in (4, 3, 2, 1):
            expected = plain(expected, n)
        assert X.collapse(" ".join(tokens)) == " ".join(expected)


def test_budget_parts():
    assert X.fit_budget("\n\nab\n\n\ncd\n", 5) == ["ab\n\n", "cd\n"] and X.fit_budget("a. b. c", 2) == ["a.", "b", ".", "c"]
    assert X.fit_budget("short", 10) == ["short"] and X.fit_budget(" \n " * 5, 3) == []
    assert X.fit_budget("aaaa\nbbbb\ncccc", 9) == ["aaaa\nbbbb", "cccc"]
    assert X.fit_budget("One two. Three four. Five", 12) == ["One two.", "Three four.", "Five"]
    assert X.fit_budget("x" * 25, 10) == ["x" * 10, "x" * 10, "x" * 5]
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice("ab. \n") for _ in range(rng.randint(0, 80)))
        parts = X.fit_budget(text, 10)
        assert all(len(p) <= 10 for p in parts) and re.sub(r"\s", "", "".join(parts)) == re.sub(r"\s", "", text)


def test_budget_parts_of_several_slices(spark):
    texts = [None, "", "ab cd", *("x" * (n % 90) for n in range(2 * X.SLICE + 1))]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string").coalesce(1).select("id", X.budget_split(F.col("t"), 20).alias("p"))
    assert {r.id: r.p for r in rows.collect()} == {i: X.fit_budget(t or "", 20) for i, t in enumerate(texts)}
    assert rows.where("id < 0").count() == 0


def test_common_subsequences():
    rng = random.Random(7)
    for _ in range(100):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 12))] for _ in range(2))
        grid = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                grid[i + 1][j + 1] = grid[i][j] + 1 if x == y else max(grid[i][j + 1], grid[i + 1][j])
        found = S._matches(a, b)
        assert S._common(a, b) == grid[-1][-1] == len(found) and all(a[i] == b[j] for i, j in found)


def test_scores(spark):
    df = spark.createDataFrame([("the cat sat", "the cat sat"), ("a b c", "a x c"), ("", "z"), (None, "q")], "g string, t string")
    got = [r.r for r in df.select(S.rouge("g", "t").alias("r")).collect()]
    assert got[0].rouge1 == got[0].rougeL == got[0].rougeLsum == 1 and got[1].rougeL == pytest.approx(2 / 3) and got[1].rouge2 == 0 and got[3].rouge1 == 0
    assert S.chrf(df.limit(1), "g", "t").first().chrf == pytest.approx(100)
    assert 0 < S.chrf(df, "g", "t").first().chrf < 100 and S.chrf(df.limit(0), "g", "t").first().chrf == 0


def test_model_calls(spark):
    waits, calls = [], []

    def flaky(part):
        calls.append(part)
        if len(calls) < 3:
            raise OSError
        return "ok"

    assert P.with_retries(flaky, sleep=waits.append)("x") == "ok" and waits == [2.0, 4.0]
    assert P.with_retries(lambda p: "", sleep=waits.append)("x") is None
    df = spark.createDataFrame([(1, "bir ikki uch to'rt besh"), (2, None), (3, "\n".join(["bad"] * 3))], "id long, text string")
    fail = lambda: lambda part: "" if "bad" in part else "yes"
    import textquarry.operators.pairs as module

    got = {r.id: r.simplified_text for r in module.simplify(df.where("id < 3"), "id", "text", fail).collect()}
    assert got == {1: "yes", 2: ""}


def test_model_calls_in_slices_by_one_worker(spark):
    """Splitting and calling in two chained workers held all rows of a batch twice as Python strings."""
    texts = [None, "", " \n ", "bir ikki\nuch"] + [" ".join(f"w{k}" for k in range(n % 50)) for n in range(3 * X.SLICE)]
    rows = spark.createDataFrame([(f"k{i}", t) for i, t in enumerate(texts)], "id string, text string").coalesce(1)
    got = P.simplify(rows, "id", "text", limit=40)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "EvalPython" not in plan and "MapInPandas" not in plan
    expected = {f"k{i}": "\n\n".join(P.echo_model(p) for p in X.fit_budget((t or "").strip(), 40) if p) for i, t in enumerate(texts)}
    assert {r.id: r.simplified_text for r in got.collect()} == expected
    half = P.simplify(rows.where("id = 'k3'"), "id", "text", lambda: lambda part: "" if "uch" in part else "yes", limit=9)  # waits 2 and 4 s
    assert half.collect() == [("k3", None)]


def test_model_server_and_batches(spark):
    assert P.ensure_ready(lambda: ["q:4b"], "q") and not P.ensure_ready(lambda: [], "q")

    def down():
        raise OSError

    with pytest.raises(RuntimeError):
        P.ensure_ready(down, "q")
    ticks = iter([1.0, 1.25])
    assert P.timed(str.upper, lambda: next(ticks))("a") == ("A", 250.0)
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "id long, text string").coalesce(1)
    got = P.generate(df, "text", "out", lambda: lambda xs: [f"{x}{len(xs)}" for x in xs], batch=2).collect()
    assert [r.out for r in got] == ["a2", "2", "c1"]

    def translator(lang):
        def call(t):
            if t == "c":
                raise KeyError(t)
            return f" {t}-{lang} "

        return call if lang == "ru" else None

    got = P.translate(df, "text", translator).collect()
    assert [r.text_ru for r in got] == ["a-ru", "-ru", ""] and {r.text_en for r in got} == {"[no key, not translated]"}


def test_listings_and_extracts(spark):
    pages = {None: {"query": {"categorymembers": [{"title": "A"}, {"title": "Turkum:B"}]}, "continue": {"cmcontinue": "x"}}, "x": {"query": {"categorymembers": [{"title": "C"}]}}}
    found = list(IO.follow(pages.get))
    assert len(found) == 2 and len(list(IO.follow(pages.get, most=2))) == 1 and list(IO.follow(lambda m: None)) == []
    landed = spark.createDataFrame([("r", k, json.dumps(x)) for k, x in enumerate(found)] + [("r", 2, "no json"), ("r", 3, None)], "category string, page int, response string")
    got = [(r.member, r.position, r.is_subcat) for r in IO.category_listing(landed).orderBy("position").collect()]
    assert got == [("A", 0, False), ("B", 1, True), ("C", 1000, False)]
    batch = json.dumps({"query": {"pages": {"7": {"title": "Ona tili", "extract": "matn " * 50 + "== Havolalar == x"}, "-1": {"title": "Yoq"}}}})
    got = IO.extracts(spark.createDataFrame([(batch,), ("[]",)], "response string")).collect()
    assert len(got) == 1 and got[0].url.endswith("/Ona_tili") and got[0].length == len(got[0].text) == 249


def test_fetch_policy():
    waits = []
    odd = iter([(500, None), (200, "x")])
    assert IO.fetch(lambda: next(odd), sleep=waits.append) == "x" and waits == [2]
    waits.clear()
    answers = iter([(429, None), (403, None), (200, "page")])
    assert IO.fetch(lambda: next(answers), sleep=waits.append) == "page" and waits == [5, 10]

    def broken():
        raise OSError

    assert IO.fetch(broken, sleep=waits.append) is None and waits[2:] == [2, 4]


def test_pages_and_files(spark, tmp_path):
    page = '<html><title> A &amp; B\n</title><div id="divCont"><p>Bir</p><div>Ikki <b>uch</b></div><script>x</script></div><p>no</p><a href="/uz/docs/-12"></a><a href="/uz/docs/-12"></a></html>'
    assert IO.body_of(page) == "Bir\nIkki\nuch" and IO.body_of("<p>x</p>") is None
    rows = spark.createDataFrame([("https://lex.uz/uz/docs/-5", page), ("https://lex.uz/docs/7", "<p></p>")], "url string, html string")
    act = IO.acts(rows).collect()
    assert len(act) == 1 and (act[0].id, act[0].title, act[0].linked_ids) == ("-5", "A & B", ["-12"])
    assert one(spark, IO.page_title(F.col("t")), '<meta property="og:title" content="O&#39;g"><title>x</title>') == "O'g"
    (tmp_path / "a.txt").write_bytes(b"ok \xff")
    with zipfile.ZipFile(tmp_path / "b.docx", "w") as z:
        z.writestr("word/document.xml", "<w:document><w:p><w:r><w:t>Bir</w:t></w:r></w:p><w:p ><w:t xml:space='preserve'>A &amp; B</w:t></w:p></w:document>")
    (tmp_path / "c.pdf").write_bytes(b"x")
    (tmp_path / "d.TXT").write_bytes(b"upper")
    got = sorted(r.text for r in IO.texts(spark, str(tmp_path)).collect())
    assert got == ["Bir\nA & B", "ok �", "upper"]
    word = spark.createDataFrame([("a < b\n\nЎ  c",), (None,)], "t string").select(W.docx("t").alias("d")).collect()
    assert [IO.document_text("x.docx", bytes(r.d)) for r in word] == ["a < b\n\nЎ  c", ""]
    assert [one(spark, IO.seed_ids(F.col("t")), u) for u in ("https://lex.uz/uz/docs/-12", "https://lex.uz/docs/7", "https://x")] == ["-12", "7", None]


@pytest.mark.parametrize(
    ("text", "parts"),
    [
        ("Sarlavha matni\nQolgan gap shu.", ["# Sarlavha matni"]),
        ("Глава 2 Общие\n\nМатн", ["## Глава 2. Общие"]),
        ("1-bob. Umumiy\n\n2-bob. Maxsus", ["## 1-Bob. Umumiy", "---", "## 2-Bob. Maxsus"]),
        ("5-modda. Tushuncha beriladi", ["### Статья 5\n\nTushuncha beriladi"]),
        ("Muhim: hujjat kerak", ["> ⚠️ **hujjat** kerak"]),
        ("Shaxs deb tushuniladi kimdir", ["> **Shaxs** deb tushuniladi kimdir"]),
        ("Kerak: 1) bir; 2) ikki: a) alfa; b) beta", ["Kerak:\n1. bir\n2. ikki\n    а) alfa\n    б) beta"]),
        ("Yoki olma, yoki anor", ["- Yoki olma\n- yoki anor"]),
        ("Meva: olma, anor, uzum.", ["Meva:\n- olma\n- anor\n- uzum"]),
        ("Jarima 15% yoki 12.05.2024 da 3 статья 4", ["`15%`", "`12.05.2024`", "`статья 4`"]),
        ("ЖК va ЖК", ["**ЖК** (Жиноят кодекси) va ЖК"]),
        ("Qonunga ko'ra qonunga", ["**Qonunga** ko'ra qonunga"]),
        ("A — bir\n\nB — ikki\n\nC — uch", ["| Нарушение | Санкция |\n| --- | --- |\n| A | bir |\n| B | ikki |\n| C | uch |"]),
    ],
)
def test_markdown_rules(text, parts):
    got = M.structure(text)
    assert all(p in got for p in parts), got
    assert got == M.structure(text)


def test_markdown_edges(spark):
    assert [M.structure(t) for t in (None, "", " \n")] == ["", "", ""]
    done = "# A\n\n- b\n- c"
    assert M.structure(done) == done
    long = ", ".join(["so'z so'z"] * 40) + ", " + "x" * 70
    assert M.structure(long)  # no backtracking
    lines = {"# a": "h1", "## a": "h2", "### a": "h3", "> q": "quote", "| a |": "table", "---": "rule", "1. x": "list", "    а) x": "sub-list", "oddiy": "para", "": "blank"}
    for line, kind in lines.items():
        assert one(spark, M.line_kind(F.col("t")), line) == kind
    assert one(spark, M.inline_spans(F.col("t")), "a **b** `c`") == ["**b**", "`c`"]


# --- pages of any kind, and texts made to stall ----------------------------------------------------

PROSE = ["Bu birinchi xatboshi boʻlib, unda yetarlicha koʻp soʻz bor va u maqolaga tegishli.", "Ikkinchi xatboshi ham uzun, unda <a href='/x'>bitta havola</a> bor, qolgani oddiy matn.", "Qisqa gap.", "Oxirgi uzun xatboshi maqolani tugatadi va undan keyin hech narsa kelmaydi, faqat pastki qism."]
TEXT = [re.sub("<[^>]*>", "", p) for p in PROSE]
PARAGRAPHS = "".join(f"<p>{p}</p>" for p in PROSE)
MENU = "<ul><li><a href='/'>Bosh sahifa</a></li><li><a href='/b'>Yangiliklar</a></li><li><a href='/c'>Aloqa</a></li></ul>"


@pytest.mark.parametrize(
    "page",
    [
        f"<body><div id=top>{MENU}</div><div class=x7><h1>Sarlavha</h1>{PARAGRAPHS}</div><div class='footer'>Barcha huquqlar himoyalangan va bu yerda uzun matn turadi, lekin u maqola emas.</div></body>",
        f"<body>{MENU}<h1>Sarlavha</h1>{PARAGRAPHS}<p>© 2020 Sayt</p><p><a href='/p'>Oldingi</a> | <a href='/n'>Keyingi</a></p></body>",
        f"<body><table><tr><td>{MENU}</td><td><h1>Sarlavha</h1>{PARAGRAPHS}</td></tr></table></body>",
        f"<body><header>{MENU}</header><main><article><header><h1>Sarlavha</h1></header>{PARAGRAPHS}<aside>Reklama matni shu yerda turadi va u ham uzun boʻlishi mumkin, albatta.</aside></article></main></body>",
        f"{MENU}<div><div><section><h2>Sarlavha</h2>{PARAGRAPHS.replace('</p>', '')}</section></div></div><form><p>Izoh qoldiring va ismingizni yozing, keyin yuborish tugmasini bosing.</p></form>",
        f"<article><h1>Sarlavha</h1>{PARAGRAPHS}</article><article class='related'><p><a href='/1'>Boshqa maqola sarlavhasi</a></p></article>",
        f"<body><script>var a='<p>no</p>'</script><!-- <p>no</p> --><div data-x='a > b'><h1>Sarlavha</h1>{PARAGRAPHS}</div></body>",
    ],
)
def test_main_text_of_pages_without_a_mark(page):
    assert G.page_text(page).split("\n") == ["Sarlavha", *TEXT]


def test_main_text_of_odd_pages(spark):
    assert [one(spark, X.main_text(F.col("t")), p) for p in (None, "", "<p>", "plain &lt;text", "<script>x", "a<b")] == ["", "", "", "plain <text", "", "a"]
    assert G.page_text("<p>x < y and z</p>") == "x < y and z"
    assert G.page_text("<div title=\"it's\"><p>a</p></div><p q='>b</p>") == "a\nb"


def against_sql(spark, tmp_path, name, pages):
    """The rows of a query over these pages, which have to be those of its SQL."""
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    got = sorted(map(tuple, catalogue.QUERIES[name](spark, str(tmp_path)).collect()))
    assert got == sorted(con.sql(catalogue.ORACLE_SQL[name]).fetchall())
    return [text for _, text in got]


#: Titles cut within a reference, as those of long pages are, and what is no reference.
CUT = ["a &amp; b&amp", "a&quot", "a&lt", "&amp&amp;", "x&ampy; z", "&amp;lt; &amp;amp;", "R&D &am", "a&#39"]
READ = ["a & b&amp", "a&quot", "a&lt", "&amp&", "x&ampy; z", "&lt; &amp;", "R&D &am", "a&#39"]


def test_main_text_decodes_closed_references_as_its_sql(spark, tmp_path):
    pages = [f"<html><body><nav>x</nav><article><h1>{c}</h1><p>The text of the page stands here and is long enough {c}</p></article></body></html>" for c in CUT]
    assert [t.split("\n")[0] for t in against_sql(spark, tmp_path, "page_main_text", pages)] == READ
    assert G.page_text(f"<p>{CUT[0]}</p>") == "a & b&" and G.decode_closed("&#x41;&#66;&eacute;&copy &nosuch;") == "ABé&copy &nosuch;"


def test_titles_decode_closed_references_as_their_sql(spark, tmp_path):
    assert against_sql(spark, tmp_path, "page_titles", [f"<head><title>{c}</title></head>" for c in CUT[:-1]]) == READ[:-1]
    assert one(spark, IO.page_title(F.col("t")), f"<title>{CUT[0]}</title>") == "a & b&"


def seconds(f):
    began = time.process_time()
    f()
    return time.process_time() - began


@pytest.mark.parametrize("piece", ["<script ", "<!-- ", "<script>", "<p class='", '<a b="', "<", "<p ", "<div>", "</div>", "<p>x", "<b>", "<li>", "<svg>", "<textarea>", "<div class ", "<a href=x>l</a> "])
def test_pages_are_read_in_linear_time(piece):
    few, many = (min(seconds(lambda: G.page_text(piece * n)) for _ in range(2)) for n in (20_000, 80_000))
    assert many < 10 * few + 0.2


STALLS = {
    "braces": (X.clean_corpus, "{\\displaystyle ", "{a}b"),
    "formulas": (X.clean_corpus, "", "{\\displaystyle {a}"),
    "tags": (X.clean_corpus, "", "<a"),
    "headings": (X.strip_wiki, "", "=="),
    "open heading": (X.strip_wiki, "==", " "),
    "templates": (X.strip_wiki, "", "{{a"),
    "spaces": (X.strip, "a", " "),
    "thoughts": (X.strip_thinking, "", "<think>"),
    "sentences": (lambda c: F.array_join(X.sentences_after_mark(c), "|"), "a.", " "),
    "stops": (lambda c: F.array_join(X.chunk_sentences(c), "|"), "", ". "),
}


@pytest.mark.parametrize("name", sorted(STALLS))
def test_no_text_stalls_a_task(spark, name):
    """A megabyte takes no longer than a few times what a sixteenth does, and no stack overflows."""
    f, head, piece = STALLS[name]
    took = []
    for n in (62_500, 1_000_000):
        df = spark.createDataFrame([(head + piece * (n // len(piece)) + "b",)], "t string").select(F.length(f(F.col("t"))).alias("n"))
        times = []
        for _ in range(2):
            began = time.time()
            assert df.first()["n"] is not None
            times.append(time.time() - began)
        took.append(min(times))
    assert took[1] < 25 * took[0] + 3


def test_patterns_find_what_backtracking_finds(spark):
    rng = random.Random(7)
    old = [(X.WIKI_ARTEFACTS[-1], r"==+\s*[^=]{1,120}?\s*==+"), (X.MARKUP_REMAINS[0], r"(?s)\{\\(?:displaystyle|textstyle)[^{}]*(?:\{[^{}]*\}[^{}]*)*\}")]
    texts = ["".join(rng.choice(["=", "==", " ", "a", "\n"]) for _ in range(rng.randrange(30))) for _ in range(400)]
    texts += ["== " + "x" * k + " " * j + "y" * m + " == z" for k in (0, 1, 118, 119, 120, 121) for j in (0, 3) for m in (0, 1, 2)]
    texts += ["".join(rng.choice(["{", "}", "a", "{\\displaystyle ", "{b}"]) for _ in range(rng.randrange(12))) for _ in range(400)]
    for new, plain in old:
        got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.regexp_replace("t", new, "#").alias("x")).collect()
        assert all(r.x == re.sub(plain, "#", r.t) for r in got)
    thoughts = ["".join(rng.choice(["<think>", "</think>", "a", "\n"]) for _ in range(rng.randrange(12))) for _ in range(300)]
    got = spark.createDataFrame([(t,) for t in thoughts], "t string").select("t", X.strip_thinking(F.col("t")).alias("x")).collect()
    assert all(r.x == re.sub("(?s)<think>.*?</think>", "", r.t).strip() for r in got)
