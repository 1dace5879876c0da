"""Web pages and text files as knowledge sources, and the page cache."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import ship

# Elements that are dropped, preferred roots, and elements whose leaves are lines.
DROPPED = frozenset("script style noscript nav header footer aside iframe form svg".split())
LINES = frozenset("h1 h2 h3 h4 h5 h6 p li pre blockquote dd dt td th".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


_BARS = ("ul", "ol", "table", "div", "article", "main", "section")
_ENDED = {"li": ("p", "li"), "dd": ("p", "dd", "dt"), "dt": ("p", "dd", "dt"), "td": ("p", "td", "th"), "th": ("p", "td", "th")}


class _Page(HTMLParser):
    """Elements and texts of a page in document order; a line element ends an open p, and li, dd, dt, td or th their like.

    An element is [name, role, parent, first text, next element, next text]: what it holds lies between these numbers, so nothing
    is walked through twice, however deep it nests.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.elements: list[list] = [["", None, 0, 0, 0, 0]]
        self.texts: list[str] = []
        self.open = [0]
        self.places: dict[str, list[int]] = {}
        self.skip = 0

    def _last(self, name: str) -> int:
        return self.places[name][-1] if self.places.get(name) else 0

    def _close(self, upto: int) -> None:
        while len(self.open) > upto:
            e = self.elements[self.open.pop()]
            e[4:] = [len(self.elements), len(self.texts)]
            if self.open:
                self.places[e[0]].pop()

    def handle_starttag(self, tag, attrs):
        if tag in DROPPED:
            self.skip += tag not in VOID
        if self.skip:
            return
        if tag in LINES or tag in _BARS:
            at = max(map(self._last, _ENDED.get(tag, ("p",))))
            if at > max(map(self._last, _BARS)):
                self._close(at)
        if tag == "br":
            self.texts.append(" ")
        n = len(self.texts)
        self.elements.append([tag, dict(attrs).get("role"), self.open[-1], n, len(self.elements) + 1, n])
        if tag not in VOID:
            self.places.setdefault(tag, []).append(len(self.open))
            self.open.append(len(self.elements) - 1)

    def handle_endtag(self, tag):
        if self.skip:
            self.skip -= tag in DROPPED
        elif at := self._last(tag):
            self._close(at)

    def handle_data(self, data):
        if not self.skip:
            self.texts.append(data)

    def text(self, element: int) -> str:
        return " ".join("".join(self.texts[self.elements[element][3] : self.elements[element][5]]).split())


def clean_html(html: str | None) -> str:
    """The page's lines: leaf blocks of the first article, main, role=main or body; without any, the root's text."""
    page = _Page()
    page.feed(html or "")
    page.close()
    page._close(0)
    elements = page.elements
    first = lambda ok: next((i for i, e in enumerate(elements) if ok(e)), 0)
    root = first(lambda e: e[0] == "article") or first(lambda e: e[0] == "main") or first(lambda e: e[1] == "main") or first(lambda e: e[0] == "body")
    above = [False] * len(elements)  # holds a line element
    for i in range(len(elements) - 1, 0, -1):
        if above[i] or elements[i][0] in LINES:
            above[elements[i][2]] = True
    lines = [t for i in range(root, elements[root][4]) if elements[i][0] in LINES and not above[i] and (t := page.text(i))]
    return "\n".join(lines) or page.text(root)


def clean_pages(df: DataFrame, html_col: str = "html") -> DataFrame:
    """df with text instead of html."""
    rest = [c for c in df.columns if c != html_col]

    def run(batches):
        for batch in batches:
            text = pa.array([clean_html(x) for x in batch.column(html_col).to_pylist()], pa.string())
            yield pa.record_batch([*[batch.column(c) for c in rest], text], names=[*rest, "text"])

    ship(df.sparkSession)
    source = df.select(*rest, html_col)
    return source.mapInArrow(run, df.select(*rest).schema.add("text", "string"))


def load_pages(df: DataFrame, url: str = "url", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(loaded, failed): rows without a URL are passed over, rows without text failed."""
    asked = df.where(~T.blank(F.col(url)))
    return asked.where(~T.blank(F.col(text))), asked.where(T.blank(F.col(text))).select(url)


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """UTF-8 files as (source_key, source_value, text); a file that can't be read is an error."""
    return spark.read.text(path, wholetext=True).select(F.lit("file_name").alias("source_key"), F.url_decode(F.replace(T.short_name(F.col("_metadata.file_path")), F.lit("+"), F.lit("%2B"))).alias("source_value"), F.col("value").alias("text"))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One UTF-8 file, on whatever file system the path names."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def cached_pages(pages: DataFrame) -> DataFrame:
    """(file_name, content) to be stored for pages (url, text)."""
    return pages.select(T.cache_file_name(F.col("url")).alias("file_name"), T.build_cache(F.col("url"), F.col("text")).alias("content"))


def read_cached(cached: DataFrame, requested: str = "url") -> DataFrame:
    source, body = T.parse_cache(F.col("content"), F.col(requested))
    return cached.withColumns({"source": source, "body": body})


def eval_set(spark: SparkSession, path: str, fallback: str | None = None) -> DataFrame:
    """Evaluation cases of a JSON file {version, cases: [...]}; unknown fields are ignored."""
    schema = "version int, cases array<struct<id:string,enabled:boolean,query:string,expectedSources:array<string>,tags:array<string>,note:string>>"
    for p in filter(None, (path, fallback)):
        try:
            found = spark.read.schema(schema).json(p, multiLine=True).select(F.explode("cases").alias("c"))
            return found.select(F.col("c.id").alias("case_id"), F.coalesce("c.enabled", F.lit(True)).alias("enabled"), F.col("c.query").alias("query"), F.col("c.expectedSources").alias("expected"), "c.tags", "c.note")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    raise FileNotFoundError(f"no evaluation set at {path}" + (f" or {fallback}" if fallback else ""))


def latest_run(reports: DataFrame, before: str | None = None) -> DataFrame:
    """The rows of the largest run id, in lexicographic order, below `before` if given."""
    past = reports if before is None else reports.where(F.col("run_id") < before)
    return past.join(past.agg(F.max("run_id").alias("run_id")), "run_id", "left_semi")
