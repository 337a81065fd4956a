"""Readers of files and landed pages."""

from __future__ import annotations

import html
import io
import re
import time
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X

DOC_LINK = r"/uz/docs/(-?\d+)"
DOC_ID = r"/docs/(-?\d+)"
OG_TITLE = r'(?i)<meta[^>]+property="og:title"[^>]+content="([^"]*)"'
TITLE = r"(?is)<title>(.*?)</title>"
CHUNK_SCHEMA = T.StructType([T.StructField(n, t) for n, t in [("source", T.StringType()), ("title", T.StringType()), ("url", T.StringType()), ("chunk_id", T.IntegerType()), ("text", T.StringType()), ("word_count", T.IntegerType()), ("length", T.IntegerType()), ("avg_sentence_len", T.DoubleType()), ("avg_word_len", T.DoubleType()), ("rare_word_ratio", T.DoubleType()), ("complexity_score", T.DoubleType())]])


def csv(spark: SparkSession, paths: str | list[str], schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header; quotes, commas and line ends inside fields are kept, a BOM is dropped."""
    reader = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("encoding", "UTF-8")
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(paths)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def existing_keys(spark: SparkSession, paths: list[str], column: str = "url") -> DataFrame:
    """Distinct non-null values of one column; missing files are skipped."""
    found = [p for p in paths if exists(spark, p)]
    if not found:
        return spark.createDataFrame([], f"{column} string")
    return csv(spark, found).select(F.col(column).cast("string")).where(F.col(column).isNotNull()).distinct()


def simplify_input(df: DataFrame) -> DataFrame:
    """Fails without a text column; adds an empty output column if there is none."""
    if "text" not in df.columns:
        raise ValueError("a text column is needed")
    return df if "simplified_text" in df.columns else df.withColumn("simplified_text", F.lit(None).cast("string"))


def resumed(spark: SparkSession, source: str, output: str, read: Callable[[SparkSession, str], DataFrame] = csv) -> DataFrame:
    """The output of an earlier run if there is one, else the input."""
    return simplify_input(read(spark, output if exists(spark, output) else source))


def jsonl(spark: SparkSession, path: str, schema: str = "id string, url string, title string, text string, linked_ids array<string>") -> DataFrame:
    return spark.read.schema(schema).json(path)


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of .txt and .docx files; others are rejected by their names."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{[tT][xX][tT],[dD][oO][cC][xX]}").load(path)

    @F.pandas_udf(T.StringType())
    def read(paths: pd.Series, contents: pd.Series) -> pd.Series:
        return pd.Series([document_text(p, c) for p, c in zip(paths, contents, strict=True)])

    return files.select("path", read("path", "content").alias("text"))


def document_text(path: str, content: bytes) -> str:
    if path.lower().endswith(".docx"):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            xml = z.read("word/document.xml").decode("utf-8")
        return "\n".join(html.unescape("".join(re.findall(r"<w:t(?: [^>]*)?>([^<]*)</w:t>", p))) for p in re.findall(r"<w:p[ >].*?</w:p>", xml, re.S))
    return content.decode("utf-8", errors="replace")


def seed_ids(url: Column) -> Column:
    """Document id of an address, null without one."""
    found = F.regexp_extract(url, DOC_ID, 1)
    return F.when(found != "", found)


def linked_ids(page: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(page, F.lit(DOC_LINK), F.lit(1)))


def page_title(page: Column, decode: Callable[[Column], Column] = X.unescape) -> Column:
    """og:title, else the title tag, decoded and squeezed."""
    og, plain = F.regexp_extract(page, OG_TITLE, 1), F.regexp_extract(page, TITLE, 1)
    return X.squeeze(decode(F.when(page.rlike(OG_TITLE), og).otherwise(plain)))


class _Body(HTMLParser):
    """Text lines inside the first div with a given id."""

    def __init__(self, div_id: str):
        super().__init__(convert_charrefs=True)
        self.div_id, self.depth, self.found, self.lines, self.raw = div_id, 0, False, [], 0

    def handle_starttag(self, tag, attrs):
        self.raw += tag in ("script", "style")
        if tag == "div":
            if self.depth:
                self.depth += 1
            elif not self.found and dict(attrs).get("id") == self.div_id:
                self.depth, self.found = 1, True

    def handle_endtag(self, tag):
        self.raw -= tag in ("script", "style") and self.raw > 0
        if tag == "div" and self.depth:
            self.depth -= 1

    def handle_data(self, data):
        if self.depth and not self.raw and data.strip():
            self.lines.append(data.strip())


def body_of(page: str | None, div_id: str = "divCont") -> str | None:
    if not page:
        return None
    parser = _Body(div_id)
    parser.feed(page)
    return "\n".join(parser.lines) or None


@F.pandas_udf(T.StringType())
def act_body(pages: pd.Series) -> pd.Series:
    return pages.map(body_of, na_action="ignore")


def acts(pages: DataFrame, page: str = "html") -> DataFrame:
    """Pages that hold a document: id, title, text, linked_ids."""
    got = pages.select("*", act_body(page).alias("text")).where("text is not null")
    return got.select(seed_ids(F.col("url")).alias("id"), "url", page_title(F.col(page)).alias("title"), "text", linked_ids(F.col(page)).alias("linked_ids"))


def feed_entries(spark: SparkSession, path: str, most: int = 150) -> DataFrame:
    """Landed RSS files: the first entries of each source that have a link."""
    from pyspark.sql.window import Window

    raw = spark.read.format("xml").option("rowTag", "item").schema("title string, link string, pubDate string, updated string").load(path)
    rows = raw.withColumn("source", F.input_file_name()).withColumn("at", F.monotonically_increasing_id())
    first = Window.partitionBy("source").orderBy("at")
    return rows.withColumn("__r", F.row_number().over(first)).where((F.col("__r") <= most) & (F.col("link") != "")).select("source", "title", F.col("link").alias("url"), F.coalesce("pubDate", "updated").alias("published"))


def follow(get: Callable[[str | None], dict | None], most: int | None = None, key: str = "cmcontinue") -> Iterator[dict]:
    """Responses of a paged listing, one after the other, until there is no mark to go on with or ``most`` members were seen."""
    mark, seen = None, 0
    while True:
        response = get(mark)
        if response is None:
            return
        yield response
        seen += len(response.get("query", {}).get("categorymembers", []))
        mark = response.get("continue", {}).get(key)
        if not mark or (most is not None and seen >= most):
            return


LISTING = "struct<query:struct<categorymembers:array<struct<ns:int,title:string>>>>"
EXTRACTS = "struct<query:struct<pages:map<string,struct<title:string,extract:string>>>>"


def category_listing(landed: DataFrame, prefix: str = "Turkum:", per_page: int = 1000) -> DataFrame:
    """Members of categories from landed responses: category, member, position, is_subcat.

    ``landed`` has category, page (from 0, in the order of the marks) and
    response, the JSON as it came; what is no such JSON has no members.
    """
    members = F.from_json("response", LISTING)["query"]["categorymembers"]
    rows = landed.select("category", "page", F.posexplode(members).alias("k", "m"))
    title = F.col("m.title")
    return rows.select("category", X.without_prefix(title, prefix).alias("member"), (F.col("page") * per_page + F.col("k")).alias("position"), F.startswith(title, F.lit(prefix)).alias("is_subcat"))


def extracts(landed: DataFrame, response: str = "response", least_length: int = 200) -> DataFrame:
    """Articles of landed batch responses: title, url, text, length."""
    pages = F.map_values(F.from_json(response, EXTRACTS)["query"]["pages"])
    rows = landed.select(F.explode(pages).alias("p")).select(F.coalesce("p.title", F.lit("")).alias("title"), X.strip_wiki(F.coalesce("p.extract", F.lit(""))).alias("text"))
    return rows.where(F.length("text") >= least_length).select("title", X.title_url(F.col("title")).alias("url"), "text", F.length("text").alias("length"))


def fetch(get: Callable[[], tuple[int, str | None]], attempts: int = 3, sleep: Callable[[float], None] = time.sleep) -> str | None:
    """Call ``get`` (status, body): a block (429, 403) waits 5 s times the attempt, any other failure 2 s times it."""
    for n in range(1, attempts + 1):
        try:
            status, body = get()
            if status == 200:
                return body
            wait = 5 * n if status in (403, 429) else 2 * n
        except OSError:
            wait = 2 * n
        if wait and n < attempts:
            sleep(wait)
    return None
