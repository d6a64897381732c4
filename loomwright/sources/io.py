"""Tables in and out."""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator, Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.operators.dedup import exact_dedup
from loomwright.plans.lineage import shared_folder


def from_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, encoding: str = "UTF-8", null_value: str = "") -> DataFrame:
    """A CSV with a header, quoted newlines included. For Latin-1 files pass ``encoding="ISO-8859-1"``.

    ``null_value`` stands for null; where it is empty, empty texts are null too.
    """
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", encoding).option("nullValue", null_value)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def from_jsonl(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def from_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def from_pandas(spark: SparkSession, frame: pd.DataFrame) -> DataFrame:
    return spark.createDataFrame(frame)


def save(df: DataFrame, path: str, overwrite: bool = False, null_value: str = "") -> None:
    """A directory of CSV, JSON lines or Parquet by the extension of ``path``; nested columns of a CSV are JSON strings."""
    kind = path.rsplit(".", 1)[-1].lower() if "." in path else ""
    if kind not in ("csv", "jsonl", "parquet"):
        raise ValueError("the path must end in .csv, .jsonl or .parquet")
    writer_mode = "overwrite" if overwrite else "error"
    if kind == "csv":
        nested = (T.ArrayType, T.StructType, T.MapType)
        flat = df.select(*[F.to_json(f"`{f.name}`").alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`") for f in df.schema])
        flat.write.mode(writer_mode).option("header", True).option("escape", '"').option("nullValue", null_value).csv(path)
    elif kind == "jsonl":
        df.write.mode(writer_mode).option("ignoreNullFields", False).json(path)
    else:
        df.write.mode(writer_mode).parquet(path)


def ingest(df: DataFrame, order_col: str, filters: Sequence[Column] = (), dedup_fields: Sequence[str] = (), max_samples: int | None = 200_000) -> DataFrame:
    """Filtered, then first occurrences, then the first ``max_samples`` rows in order (None: all)."""
    for condition in filters:
        df = df.where(condition)
    if dedup_fields:
        df = exact_dedup(df, dedup_fields, order_col)
    return df if max_samples is None else df.orderBy(order_col).limit(max_samples)


def http_get(timeout: float = 5.0) -> Callable[[str], str | None]:
    """For :func:`fetched`: the text of a page by a plain GET; None for any status but 200."""

    def get(url: str) -> str | None:
        import urllib.request

        with urllib.request.urlopen(url, timeout=timeout) as reply:
            return reply.read().decode(reply.headers.get_content_charset() or "utf-8", "replace") if reply.status == 200 else None

    return get


def http_head(timeout: float = 5.0) -> Callable[[str], tuple[int, str | None]]:
    """For :func:`redirected`: status and location of a HEAD request, not followed."""

    def head(url: str) -> tuple[int, str | None]:
        import http.client
        import urllib.parse

        parts = urllib.parse.urlsplit(url)
        kind = http.client.HTTPSConnection if parts.scheme == "https" else http.client.HTTPConnection
        connection = kind(parts.netloc, timeout=timeout)
        try:
            connection.request("HEAD", (parts.path or "/") + (f"?{parts.query}" if parts.query else ""))
            reply = connection.getresponse()
            return reply.status, reply.headers.get("Location")
        finally:
            connection.close()

    return head


def fetched(df: DataFrame, url_col: str, output: str, fetch: Callable[[str], str | None], failed: str | None = None) -> DataFrame:
    """``output``: what ``fetch`` returns for each url; ``failed`` if it raises or returns nothing, null for a null url."""
    schema = df.withColumn(output, F.lit(None).cast("string")).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for url in batch[url_col]:
                try:
                    text = fetch(url) if isinstance(url, str) else None
                except Exception:
                    text = None
                out.append(failed if text is None and isinstance(url, str) else text)
            yield batch.assign(**{output: out})

    return df.mapInPandas(run, schema)


def redirected(df: DataFrame, url_col: str, output: str, head: Callable[[str], tuple[int, str | None]]) -> DataFrame:
    """``output``: where a url leads: the location that ``head`` (url to status and location) gives for 308, the url itself for 200, else null."""

    def follow(url: str) -> str | None:
        status, location = head(url)
        return location if status == 308 else url if status == 200 else None

    return fetched(df, url_col, output, follow)


def from_hub(spark: SparkSession, path: str, split: str = "train", load: Callable[..., Iterator[dict]] | None = None, schema: T.StructType | str | None = None, max_rows: int | None = None, **options) -> DataFrame:
    """A data set of a hub.

    ``load(path, split, **options)`` gives its rows as dicts; without it the
    ``datasets`` package is used where it is installed.  Rows are streamed to
    Parquet in the shared folder first, in parts of bounded size.
    """
    import itertools
    import uuid

    if load is None:
        try:
            from datasets import load_dataset
        except ImportError as e:
            raise ImportError("from_hub needs the datasets package or a load function") from e
        load = lambda p, s, **o: iter(load_dataset(p, split=s, streaming=True, **o))
    rows = iter(load(path, split, **options))
    rows = itertools.islice(rows, max_rows) if max_rows is not None else rows
    target = f"{shared_folder(spark)}/hub-{uuid.uuid4().hex}"
    while part := list(itertools.islice(rows, 50_000)):
        spark.createDataFrame(part, schema).write.mode("append").parquet(target)
        schema = schema or spark.read.parquet(target).schema
    if schema is None:
        raise ValueError("the data set is empty; pass a schema")
    try:
        return spark.read.schema(schema).parquet(target)
    except Exception:
        return spark.createDataFrame([], schema)


def extracted(spark: SparkSession, path: str, extract: Callable[[bytes], str | None]) -> DataFrame:
    """``(path, text)`` of binary files, by a pluggable extractor; words hyphenated at line ends are joined."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "text": [(extract(c) or "").replace("-\n", "") for c in batch["content"]]})

    return files.mapInPandas(run, "path string, text string")


class _Text(HTMLParser):
    _SKIP = frozenset("script style nav header footer aside noscript template svg form".split())
    _BLOCK = frozenset("p div br li h1 h2 h3 h4 h5 h6 tr section article blockquote pre title".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.title = ""
        self._skip = 0
        self._in_title = False

    def handle_starttag(self, tag, attrs):
        self._skip += tag in self._SKIP
        self._in_title = tag == "title"
        if tag in self._BLOCK:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        self._skip = max(0, self._skip - (tag in self._SKIP))
        self._in_title = False
        if tag in self._BLOCK:
            self.parts.append("\n")

    def handle_data(self, data):
        if self._in_title:
            self.title = data.strip()
        elif not self._skip:
            self.parts.append(data)


def html_text(page: str | None) -> str | None:
    """Readable text of a page, its title first; null for null, empty or textless pages."""
    if not page:
        return None
    parser = _Text()
    parser.feed(page)
    body = re.sub(r"[ \t]+", " ", "".join(parser.parts))
    body = re.sub(r" *\n\s*", "\n", body).strip()
    head = f"Title: {html.unescape(parser.title)}\n" if parser.title else ""
    return (head + body) or None


def with_html_text(df: DataFrame, column: str, output: str) -> DataFrame:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(html_text, na_action="ignore")

    return df.withColumn(output, run(F.col(column)))
