"""Domain labels from keyword counts, per article or per group of chunks."""

from __future__ import annotations

from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Lexicon = dict[str, list[str]]

# --- fixed values: keywords of each domain in the order that decides ties ------------------------
KEYWORDS: Lexicon = {
    "law": "қонун qonun суд sud жиноят jinoyat жавобгарлик javobgarlik фармон farmon қарор qaror кодекс kodeks модда modda ҳуқуқ huquq прокуратура prokuratura жазо jazo қонунчилик qonunchilik".split(),
    "science": "физика fizika кимё kimyo биология biologiya олим olim тадқиқот tadqiqot илмий ilmiy математика matematika геология geologiya астроном astronom kashfiyot eksperiment".split(),
    "economy": [*"иқтисод iqtisod бюджет budjet банк bank валюта valyuta инвестиция investitsiya экспорт eksport импорт import нарх narx савдо savdo корхона korxona солиқ soliq биржа birja".split(), "qishloq xoʻjaligi", "fermer", "hosildorlik"],
    "culture": "маданият madaniyat санъат sanʼat кино kino музей muzey адабиёт adabiyot театр teatr концерт konsert қўшиқ qoʻshiq фестиваль festival ёзувчи yozuvchi рассом rassom musiqa".split(),
    "sport": [*"футбол futbol чемпионат chempionat спортчи sportchi олимпиада olimpiada мураббий murabbiy финал final".split(), "терма жамоа", "terma jamoa"],
    "politics": [*"президент prezident ҳукумат hukumat".split(), "вазир ", "vazir ", *"парламент parlament сенат senat сиёсат siyosat сайлов saylov депутат deputat harbiy armiya qoʻshin".split()],
    "education": "таълим taʼlim мактаб maktab университет universitet талаба talaba ўқувчи oʻquvchi профессор professor лицей litsey коллеж kollej".split(),
    "health": "тиббиёт tibbiyot касаллик kasallik шифокор shifokor соғлиқ sogʻliq врач vrach касалхона kasalxona даволаш davolash вакцина vaksina".split(),
    "technology": ["технология", "texnologiya", "дастур", "dastur", "сунъий интеллект", "sunʼiy intellekt", "sun'iy intellekt", *"компьютер kompyuter интернет internet робот robot рақамли raqamli".split()],
}
#: Tie order of the article-level rule, and the domain of the law site.
ARTICLE_PRIORITY = ["law", "health", "science", "education", "economy", "politics", "sport", "technology", "culture"]
CATEGORY_DOMAIN = {
    "Oʻzbekiston tarixi": "culture", "Fizika": "science", "Iqtisodiyot": "economy", "Tibbiyot": "health", "Geografiya": "science", "Kimyo": "science",
    "Biologiya": "science", "Huquq": "law", "Taʼlim": "education", "Adabiyot": "culture", "Sanʼat": "culture", "Siyosat": "politics", "Ekologiya": "science",
    "Din": "other", "Sport": "sport", "Informatika": "technology",
}
OTHER = "other"
# ---------------------------------------------------------------------------------------------


@lru_cache(maxsize=8)
def automaton(lexicon: tuple[tuple[str, tuple[str, ...]], ...]) -> ahocorasick.Automaton:
    """An Aho-Corasick automaton of all keywords; a keyword leads to its number, its domains and its length."""
    found: dict[str, list[int]] = {}
    for d, (_, words) in enumerate(lexicon):
        for w in words:
            found.setdefault(w.lower(), []).append(d)
    out = ahocorasick.Automaton()
    for k, (w, domains) in enumerate(found.items()):
        out.add_word(w, (k, tuple(domains), len(w)))
    out.make_automaton()
    return out


def hits(text: str, machine: ahocorasick.Automaton, n_domains: int) -> list[int]:
    """Occurrences of the keywords of each domain in one pass; those of one keyword do not overlap."""
    out, free = [0] * n_domains, {}
    for end, (k, domains, size) in machine.iter(text):
        if end - size + 1 >= free.get(k, 0):
            free[k] = end + 1
            for d in domains:
                out[d] += 1
    return out


def keyword_counts(text: Column, lexicon: Lexicon) -> Column:
    """Array of the keyword occurrences of each domain of the lexicon, in its order; case does not matter."""
    plain = tuple((d, tuple(ws)) for d, ws in lexicon.items())

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def count(texts: pd.Series) -> pd.Series:
        machine = automaton(plain)
        return texts.map(lambda t: hits(t, machine, len(plain)))

    return count(F.lower(F.coalesce(text, F.lit(""))))


def _best(scores: dict[str, Column], fallback: str = OTHER) -> Column:
    """The first name with the greatest score, if that is over 0."""
    most = F.greatest(*scores.values(), F.lit(0.0))
    choice = F.when(most <= 0, F.lit(fallback))
    for name, score in scores.items():
        choice = choice.when(score == most, F.lit(name))
    return choice


def by_keywords(title: Column, text: Column, lexicon: Lexicon | None = None) -> Column:
    """Domain with the most keyword occurrences in title and text; ties in lexicon order."""
    lexicon = lexicon or KEYWORDS
    both = F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(text, F.lit("")))
    return best_domain(keyword_counts(both, lexicon), list(lexicon))


def best_domain(counts: Column, domains: list[str], fallback: str = OTHER) -> Column:
    """The first domain with the greatest count, if that is over 0."""
    most = F.array_max(counts)
    return F.when(most > 0, F.element_at(F.array(*map(F.lit, domains)), F.array_position(counts, most).cast("int"))).otherwise(F.lit(fallback))


def domain_of(value: Column, default: Column, table: dict[str, str] | None = None) -> Column:
    """Lookup of a category, a map literal as dimension table."""
    entries = [F.lit(x) for kv in (table or CATEGORY_DOMAIN).items() for x in kv]
    return F.coalesce(F.create_map(*entries)[value], default)


def article_domains(chunks: DataFrame, article: str, title: str, text: str, lexicon: Lexicon | None = None, priority: list[str] | None = None) -> DataFrame:
    """One domain per article: over its chunks 3 for a title with a keyword, 1 for a text with one."""
    lexicon = lexicon or KEYWORDS
    order = [d for d in (priority or ARTICLE_PRIORITY) if d in lexicon] + [d for d in lexicon if d not in (priority or ARTICLE_PRIORITY)]
    ordered = {d: lexicon[d] for d in order}
    found = chunks.select(article, keyword_counts(F.col(title), ordered).alias("__t"), keyword_counts(F.col(text), ordered).alias("__x"))
    score = lambda k: 3 * (F.col("__t")[k] > 0).cast("int") + (F.col("__x")[k] > 0).cast("int")
    sums = found.groupBy(article).agg(*[F.sum(score(k)).cast("double").alias(f"__{d}") for k, d in enumerate(order)])
    return sums.select(article, _best({d: F.col(f"__{d}") for d in order}).alias("domain"))


def spread_domains(chunks: DataFrame, domains: DataFrame, article: str) -> DataFrame:
    return chunks.join(domains, article, "left").withColumn("domain", F.coalesce("domain", F.lit(OTHER)))
