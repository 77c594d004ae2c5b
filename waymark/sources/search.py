"""Search results: payloads to hits, batch files, and a Spark data source over an injected search function."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators import ordered
from .ledger import Ledger, Limits

HIT = "title string, url string, snippet string, source string"
PAYLOAD = "results array<struct<title string, url string, pretty_url string, content string, snippet string, engine string, engines array<string>>>"
BATCH = "query string, limit int, family string, city string, state string, country string"


def parse_payloads(payloads: DataFrame, json_col: str = "payload", order: str = "seq") -> DataFrame:
    """Hits of payloads (seq, query, payload): title, url, snippet, source; what isn't a payload gives none, and hits without title and url fall away."""

    def filled(*names: str):
        return F.coalesce(*[F.nullif(F.btrim(F.col(n)), F.lit("")) for n in names], F.lit(""))

    rows = payloads.select(order, "query", F.posexplode(F.from_json(json_col, f"struct<{_struct(PAYLOAD)}>")["results"]).alias("ord", "r"))
    engines = F.when(F.size("r.engines") > 0, F.array_join("r.engines", ", "))
    hits = rows.select(order, "query", "ord", filled("r.title").alias("title"), filled("r.url", "r.pretty_url").alias("url"), filled("r.content", "r.snippet").alias("snippet"), F.coalesce(F.nullif(F.col("r.engine"), F.lit("")), engines, F.lit("search")).alias("source"))
    return hits.where("title <> '' OR url <> ''")


def _struct(ddl: str) -> str:
    """A column list as the fields of a struct type."""
    name, kind = ddl.split(" ", 1)
    return f"{name}:{kind.replace('struct<', 'struct<')}"


def numbered(hits: DataFrame, order: str = "seq") -> DataFrame:
    """hits with one running number over payloads and their hits, by a range sort."""
    return ordered.numbered(hits, [order, "ord"], "hit_seq").withColumn("hit_seq", F.col("hit_seq") - 1)


def first_pages(hits: DataFrame, limit: int, order: str = "seq") -> DataFrame:
    """The first hit of each URL, up to limit for each query."""
    once = Window.partitionBy("query", "url").orderBy(order, "ord")
    kept = hits.withColumn("rn", F.row_number().over(once)).where("rn = 1").drop("rn")
    taken = Window.partitionBy("query").orderBy(order, "ord")
    return kept.withColumn("rank", F.row_number().over(taken)).where(F.col("rank") <= limit)


def read_batch(spark: SparkSession, path: str) -> DataFrame:
    """Query specifications of a JSON array file: limit 20 unless given; entries without a query are an error."""
    specs = spark.read.schema(BATCH).json(path, multiLine=True).withColumn("limit", F.coalesce("limit", F.lit(20)))
    bad = specs.where("query IS NULL OR trim(query) = '' OR limit < 1").count()
    if bad:
        raise ValueError(f"{bad} entries of {path} have no query or a limit under 1")
    return specs


class SearchSource(DataSource):
    """``format("waymark_search")``: one partition for each query; options: queries (newline-separated), limit, client (module:function).

    With the option ledger (a shared folder; see ledger.py) calls are reserved there
    before partitions are planned, under provider, daily and monthly; calls says
    how many a query takes. Queries beyond the limit are rows with the error "budget".
    """

    @classmethod
    def name(cls) -> str:
        return "waymark_search"

    def schema(self) -> str:
        return f"query string, ord int, {HIT}, error string"

    def reader(self, schema) -> DataSourceReader:
        return _SearchReader(self.options)


class _SearchReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.queries = [q for q in options.get("queries", "").split("\n") if q.strip()]
        self.limit = int(options.get("limit", "20"))
        self.client = options["client"]
        self.ledger = Ledger(options["ledger"]) if "ledger" in options else None
        self.provider = options.get("provider", self.client)
        if self.ledger:
            self.limits = Limits(int(options["daily"]), int(options["monthly"]), float(options.get("cost", "0")))
            self.calls = int(options.get("calls", "1"))

    def partitions(self) -> list[InputPartition]:
        fits = self.ledger.reserve(self.provider, [self.calls] * len(self.queries), self.limits) if self.ledger else [True] * len(self.queries)
        run = uuid.uuid4().hex
        return [InputPartition((run, i, q, ok)) for i, (q, ok) in enumerate(zip(self.queries, fits))] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is None:
            return
        from importlib import import_module

        run, i, query, admitted = partition.value
        refused = "budget" if not admitted else "called before" if self.ledger and not self.ledger.claim(run, i) else None
        if refused:
            yield query, 0, None, None, None, None, refused
            return
        module, name = self.client.split(":")
        try:
            hits = list(getattr(import_module(module), name)(query, self.limit))
        except Exception as e:  # a failed search is a row with its error; others go on
            yield query, 0, None, None, None, None, str(e)[:500]
            return
        for ord_, h in enumerate(hits[: self.limit]):
            yield query, ord_, h.get("title", ""), h.get("url", ""), h.get("snippet", ""), h.get("source", ""), None
