"""Secret scan: fixed patterns plus character Markov models, JVM-side only.

Three patterns give the base spans.  The method adds spans: every run of 20 or
more token characters is scored by two first-order character models, one of
random strings and one of ordinary identifiers, and a run whose mean
log-likelihood ratio per transition is over a threshold is a secret as well.
Both models are counted with DataFrame operations from labelled samples
(``train``); their size is fixed by the alphabet (65 x 65 transitions), not by
the data.

Defined results: a null text is an empty one, which has no spans (``redact``
leaves it null); texts of any length, and with any number of spans, are scanned
whole; spans that start together stand in the order of their kinds; equal rows,
and rows without a doc_id, are kept; an empty table gives an empty result; in
``redact`` all other columns pass through, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import with_new_text

#: Patterns that the contract fixes: kind, regular expression, group whose length counts, least length.
BASE = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)
#: The method's own kind, its candidates, and the log-likelihood ratio per transition from which one is a secret.
MARKOV, CANDIDATE, THRESHOLD = "markov", r"[A-Za-z0-9+/_=-]{20,}", 0.35
#: Values that grow an array one by one, and characters of a page of text (see ``_running`` and ``_cut``).
RUN, PAGE = 64, 4096
#: Rulers and runs of few characters are neither random nor names.
LEAST_DISTINCT = 8

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: Running text of several languages, and words of programs, from which the sample of ordinary strings is composed.
PROSE = """
when the first settlers reached the broad valley they found quiet rivers full of fish and forests that stretched beyond the northern
hills every spring the water rose over the meadows and left behind a dark layer of earth in which almost anything would grow people
built wooden houses on higher ground exchanged knowledge about weather and farming and wrote down what had happened during the year
journalists management development information technology environment government international understanding responsibility throughout
die ersten siedler fanden ruhige fluesse voller fische und waelder die sich bis hinter die noerdlichen berge erstreckten jedes
fruehjahr stieg das wasser ueber die wiesen und liess eine dunkle schicht erde zurueck auf der fast alles wuchs gesellschaft schiff
fahrt dampf wirtschaft geschwindigkeit verkehrsmittel versicherung wissenschaft zusammenarbeit rechtsprechung krankenhaus strasse
les premiers habitants trouvent des rivieres tranquilles pleines de poissons et des forets qui continuent derriere les collines du
nord chaque printemps eau monte sur les prairies et laisse une couche de terre sombre ou presque tout pousse gouvernement entreprise
los primeros habitantes encontraron rios tranquilos llenos de peces y bosques que seguian detras de las colinas del norte cada
primavera subia el agua sobre los prados y dejaba una capa de tierra oscura donde crecia casi todo desarrollo conocimiento trabajo
birinchi odamlar keng vodiyga yetib kelganda tinch daryolar va qalin ormonlarni topdilar har bahor suv otloqlarni bosib qora tuproq
qoldirar edi xalqaro munosabatlar iqtisodiyot qonunchilik tashkilot ozbekiston respublikasi
""".split()
PARTS = (
    "get set user name value index count list item data file path read write open close table column row key map string number total price order "
    "date time start end first last next page link text token parse format print build test error result return update delete insert select join "
    "group filter sort hash node tree left right width height color image button click handle event request response server client message config "
    "default main java src org com net http https www html json xml util common core api service factory bean proxy abstract singleton controller "
    "repository manager provider adapter interface exception template context session transaction security authentication version module package "
    "resources static public private class lib bin usr local share assets images scripts styles index readme docs example project www2 v1 v2"
).split()


def labelled_sample(spark: SparkSession, n: int = 8000) -> DataFrame:
    """``n`` labelled strings of each class: (text, label), label 1 for random ones.

    The strings follow from their number alone (hashes of it), so the sample
    and the models are the same everywhere.
    """
    i = F.col("id")

    def pick(parts: list[str], k: Column, salt: int) -> Column:
        at = F.pmod(F.xxhash64(i, k, F.lit(salt)), F.lit(len(parts))) + 1
        return F.element_at(F.split(F.lit(" ".join(parts)), " "), at.cast("int"))

    style = F.pmod(i, F.lit(7))
    words = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: F.when(F.pmod(F.xxhash64(i, k), F.lit(3)) == 0, pick(PARTS, k, 1)).otherwise(pick(PROSE, k, 2)))
    plain = (
        F.when(style == 0, F.array_join(words, "_"))
        .when(style == 1, F.array_join(F.transform(words, F.initcap), ""))
        .when(style == 2, F.array_join(words, ""))
        .when(style == 3, F.array_join(words, "/"))
        .when(style == 4, F.upper(F.array_join(words, "_")))
        .when(style == 5, F.concat(F.element_at(words, 1), F.array_join(F.transform(F.slice(words, 2, 5), F.initcap), "")))
        .otherwise(F.concat(F.array_join(words, "-"), F.lit("-"), F.pmod(i, F.lit(3000)).cast("string")))
    )
    raw = F.unhex(F.sha2(F.concat(F.lit("sample "), i.cast("string")), 256))
    b64 = F.regexp_replace(F.base64(raw), "=", "")
    kind = F.pmod(i, F.lit(3))
    rand = F.when(kind == 0, b64).when(kind == 1, F.regexp_replace(b64, "[+/]", "")).otherwise(F.lower(F.regexp_replace(b64, "[+/]", "")))
    ids = spark.range(n)
    return ids.select(plain.alias("text"), F.lit(0).alias("label")).unionByName(ids.select(rand.alias("text"), F.lit(1).alias("label")))


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios of all transitions, at [class of a] * n + [class of b].

    ``samples`` has columns text and label (1: random).  Counts start at one
    half.  The last class stands for any character outside the alphabet.
    """
    n = len(ALPHABET) + 1
    pairs = samples.where(F.length("text") > 1).select("label", F.explode(F.transform(F.sequence(F.lit(1), F.length("text") - 1), lambda k: F.substring(F.col("text"), k, F.lit(2)))).alias("p"))
    counts = {(r["label"], r["p"]): r["n"] for r in pairs.groupBy("label", "p").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most 2 * n * n rows
    at = {c: k for k, c in enumerate(ALPHABET)}
    grid = [[[0.5] * n for _ in range(n)] for _ in range(2)]
    for (label, p), m in counts.items():
        grid[label][at.get(p[0], n - 1)][at.get(p[1], n - 1)] += m
    out = []
    for a in range(n):
        total = [sum(grid[y][a]) for y in range(2)]
        out += [round(math.log(grid[1][a][b] / total[1]) - math.log(grid[0][a][b] / total[0]), 4) for b in range(n)]
    return out


def _constants(values: list, kind: str) -> Column:
    """An array that the optimizer folds into one literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def _codes(s: Column) -> Column:
    """Class of each character as an index from 0; a table over ASCII does it."""
    n = len(ALPHABET)
    table = [ALPHABET.index(chr(c)) if chr(c) in ALPHABET else n for c in range(128)]
    lookup = _constants(table, "int")
    return F.transform(F.split(s, "(?!^)"), lambda c: F.coalesce(F.get(lookup, F.ascii(c)), F.lit(n)))


def likelihood_ratio(s: Column, model: list[float]) -> Column:
    """Mean log-likelihood ratio per transition of a string of two or more characters."""
    n = len(ALPHABET) + 1
    weights = _constants(model, "double")
    start = F.struct(F.lit(-1).alias("p"), F.lit(0.0).alias("s"))
    step = lambda acc, c: F.struct(c.alias("p"), F.when(acc["p"] < 0, acc["s"]).otherwise(acc["s"] + F.get(weights, acc["p"] * n + c)).alias("s"))
    total = F.aggregate(_codes(s), start, step, lambda acc: acc["s"])
    return total / F.greatest(F.length(s) - 1, F.lit(1))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body (or a function in it) names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(values: Column, least: int, join: Callable[[Column, Column], Column]) -> Column:
    """For each value of an array what ``join`` makes of all values before it, from ``least`` on.

    Arrays that grow by one are copied each time, so they grow within runs of
    ``RUN`` values only, and once over the runs.
    """

    def fold(xs: Column, value: Callable[[Column], Column]) -> Column:
        start = F.struct(F.lit(least).alias("all"), F.expr("cast(array() as array<int>)").alias("before"))
        return F.aggregate(xs, start, lambda acc, x: F.struct(join(acc["all"], value(x)).alias("all"), F.concat(acc["before"], F.array(acc["all"])).alias("before")))

    def folded(vs: Column) -> Column:
        count = F.ceil(F.size(vs) / F.lit(RUN)).cast("int")
        return F.transform(F.sequence(F.lit(0), count - 1), lambda k: fold(F.slice(vs, k * RUN + 1, F.lit(RUN)), lambda x: x))

    def spread(runs: Column) -> Column:
        return F.flatten(F.zip_with(runs, fold(runs, lambda r: r["all"])["before"], lambda r, o: F.transform(r["before"], lambda x: join(x, o))))

    return _let(_let(values, folded), spread)


def _matches(text: Column, pattern: str, group: int) -> Column:
    """All matches as structs (start, end, len of the group, match), in code points.

    The text between the matches (``split``) and the matches themselves
    alternate, so their lengths add up to the places.
    """
    empty = F.expr("cast(array() as array<struct<start:int,end:int,len:int,match:string>>)")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sizes = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found, F.length)
    sized = F.zip_with(found, sizes, lambda m, n: F.struct(m.alias("match"), n.alias("len")))
    between = F.transform(F.split(text, pattern), F.length)
    items = F.zip_with(F.slice(between, F.lit(1), F.size(found)), sized, lambda r, m: F.struct(r.alias("gap"), m["match"].alias("match"), m["len"].alias("len")))

    def placed(xs: Column) -> Column:
        ends = F.transform(xs, lambda x: x["gap"] + F.length(x["match"]))
        return F.zip_with(_running(ends, 0, lambda a, b: a + b), xs, lambda a, x: F.struct((a + x["gap"]).alias("start"), (a + x["gap"] + F.length(x["match"])).alias("end"), x["len"].alias("len"), x["match"].alias("match")))

    return F.when(F.size(found) == 0, empty).otherwise(_let(items, placed))


def _long_enough(matches: Column, least: int) -> Column:
    return F.filter(matches, lambda m: m["len"] >= least)


def _spans(matches: Column, rank: int, kind: str) -> Column:
    return F.transform(matches, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind")))


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, model: list[float] | None = None, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Add ``__spans`` (array of start, rank, end, kind) with all spans of the text."""
    model = train(labelled_sample(docs.sparkSession)) if model is None else model
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs
    for rank, (kind, pattern, group, least) in enumerate(BASE):
        out = out.withColumn(f"__{kind}", _spans(_long_enough(_matches(text, pattern, group), least), rank, kind))
    varied = lambda m: F.size(F.array_distinct(F.split(m["match"], "(?!^)"))) >= LEAST_DISTINCT
    found = F.filter(_matches(text, CANDIDATE, 0), lambda m: varied(m) & (likelihood_ratio(m["match"], model) > threshold))
    out = out.withColumn("__markov", _spans(found, len(BASE), MARKOV))
    return out.withColumn("__spans", F.concat("__assign", "__access", "__hex", "__markov"))


def secret_report(docs: DataFrame, model: list[float] | None = None) -> DataFrame:
    """Columns doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov."""
    got = scan(docs.select("doc_id", "text"), model)
    n = lambda kind: F.size(f"__{kind}").cast("long").alias(f"n_{kind}")
    base = _written(F.concat("__assign", "__access", "__hex"))
    return got.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(base, 256).alias("base_sha256"), _written(F.col("__spans")).alias("spans"), n("markov"))


def redact(docs: DataFrame, mark: str = "[SECRET]", model: list[float] | None = None) -> DataFrame:
    """Replace every span in ``text`` by ``mark``; overlapping spans become one.

    Columns stay as they are; ``n_chars``, if there, follows the new text.
    Rows without a span keep their text unchanged.
    """
    got = scan(docs.select(F.struct(*docs.columns).alias("row"), "text"), model)
    clean = F.size("__spans") == 0
    got = got.select("row", clean.alias("clean"), F.when(clean, F.col("text")).otherwise(_cut(F.col("text"), F.array_sort("__spans"), mark)).alias("new"))
    return got.select(*with_new_text(docs, "row", F.col("new"), F.col("clean")))


def _cut(text: Column, spans: Column, mark: str) -> Column:
    """The text with ``mark`` for each of the merged spans, which come sorted.

    Places in a long string are slow to find, so the text is cut into pages of
    ``PAGE`` characters, and what stands between two spans is taken from those.
    """

    def between(pages: Column, a: Column, b: Column) -> Column:
        def part(k: Column) -> Column:
            low = F.greatest(a - k * PAGE, F.lit(0))
            return F.substring(F.get(pages, k), low + 1, F.least(b - k * PAGE, F.lit(PAGE)) - low)

        own = F.transform(F.sequence(F.floor(a / PAGE).cast("int"), F.floor((b - 1) / PAGE).cast("int")), part)
        return F.when(a >= b, F.lit("")).otherwise(F.array_join(own, ""))

    def cut(x: Column) -> Column:
        covered = _running(F.transform(x["spans"], lambda s: s["end"]), 0, F.greatest)
        pieces = F.zip_with(x["spans"], covered, lambda s, c: F.when(s["start"] >= c, F.concat(between(x["pages"], c, s["start"]), F.lit(mark))).otherwise(F.lit("")))
        end = F.array_max(F.transform(x["spans"], lambda s: s["end"]))
        return F.concat(F.array_join(pieces, ""), between(x["pages"], end, F.length(text)))

    pages = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PAGE}}}"), F.lit(0))
    return _let(F.struct(spans.alias("spans"), pages.alias("pages")), cut)
