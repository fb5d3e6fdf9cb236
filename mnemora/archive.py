"""The archive as one object: add pages, search, record clicks, keep rules. Also ``python -m mnemora.archive``."""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora import schemas, sources, storage
from mnemora.operators import documents as D
from mnemora.operators import history as H
from mnemora.operators import index as I
from mnemora.operators import search as S
from mnemora.rules import Rules
from mnemora.runtime import cut, lookup_join, ship

#: Steps that bring a stored archive to the present layout, in order; each takes the folder. Empty so far.
MIGRATIONS: list[Callable[[str], None]] = []


class Archive:
    """Tables in one folder of any storage. Captures are appended batch by batch; ``refresh`` stores the postings of all
    documents with their statistics, and what was added since is searched beside them, so that a search is always up to
    date. One process writes at a time."""

    def __init__(self, spark: SparkSession, folder: str, config: sources.Config | None = None):
        self.spark, self.folder, self.config = spark, folder, config or sources.Config().checked()
        storage.make_folder(spark, folder)
        migrate(spark, folder)
        self.rules = Rules.load(spark, f"{folder}/rules.json")

    def _pointer(self, name: str) -> dict:
        """Which stored version of a table counts."""
        return json.loads(storage.read_text(self.spark, f"{self.folder}/{name}.json") or "{}")

    def _point(self, name: str, **to) -> None:
        storage.write_text(self.spark, f"{self.folder}/{name}.json", json.dumps(to))

    def _documents_folder(self) -> str:
        return f"{self.folder}/{self._pointer('documents').get('folder', 'documents')}"

    def _batches(self) -> list[int]:
        return sorted(int(n.partition("=")[2]) for n in storage.names(self.spark, self._documents_folder()) if n.startswith("batch="))

    def versions(self) -> DataFrame:
        """All stored versions of documents."""
        return storage.stored(self.spark, self._documents_folder(), schemas.STORED)

    def documents(self, html: bool = True) -> DataFrame:
        """The last version of every document, if asked without its HTML. A filter on url reaches the scan."""
        rows = self.versions() if html else self.versions().drop("html")
        return D.latest(rows, "url", F.col("batch"), F.col("added")).drop("added", "batch")

    def add(self, captures: DataFrame) -> int:
        """Adds documents that are accepted, as the next batch; returns how many."""
        empty = {c: F.lit("") for c in ("url", "title", "text", "html", "favicon")} | {"score": F.lit(None).cast("double")}
        cols = [F.col(c).cast("double").alias(c) if c == "score" and c in captures.columns else F.col(c) if c in captures.columns else x.alias(c) for c, x in empty.items()]
        docs = D.accepted(D.from_capture(captures.select(*cols)), self.rules, self.config.base_url)
        path = f"{self._documents_folder()}/batch={max(self._batches(), default=0) + 1}"
        docs.withColumn("added", F.current_timestamp()).write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path).count()

    def compact(self) -> None:
        """Keeps the last version of every document only. They are written to a new folder, the pointer is moved there,
        and only then the old folder goes."""
        old, at = self._documents_folder(), self._pointer("documents").get("version", 0) + 1
        batches = self._batches()
        if not batches:
            return
        new = f"documents-{at}"
        D.latest(self.versions(), "url", F.col("batch"), F.col("added")).drop("batch").write.mode("overwrite").parquet(f"{self.folder}/{new}/batch={batches[-1]}")
        self._point("documents", folder=new, version=at)
        storage.delete(self.spark, old)

    def for_each(self, act: Callable) -> None:
        """Calls ``act`` with every document, on the executors."""
        ship(self.spark)
        self.documents().foreach(act)

    def refresh(self) -> None:
        """Stores sorted postings of all documents, document frequencies and the number of documents as a new version."""
        at, upto = self._pointer("index").get("version", 0) + 1, max(self._batches(), default=0)
        docs, path = self.documents(html=False), f"{self.folder}/index-{at}"
        I.write(I.postings(docs), f"{path}/postings")
        posts = self.spark.read.schema(schemas.POSTING).parquet(f"{path}/postings")
        I.any_doc_freq(posts).select("field", "term", "df").repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/doc_freq")
        self._point("index", version=at, upto=upto, documents=docs.select("url").count())
        if at > 1:
            storage.delete(self.spark, f"{self.folder}/index-{at - 1}")

    def postings(self) -> DataFrame:
        """Postings of the present documents: the stored ones, with those of documents added since in place of theirs."""
        index = self._pointer("index")
        if not index:
            return I.postings(self.documents(html=False))
        stored = I.open_or_create(self.spark, f"{self.folder}/index-{index['version']}/postings")
        if max(self._batches(), default=0) <= index["upto"]:
            return stored
        since = self.versions().drop("html").where(F.col("batch") > index["upto"])
        return I.current(stored, D.latest(since, "url", F.col("batch"), F.col("added")))

    def statistics(self, text: str, options: S.Options) -> S.Statistics | None:
        """Stored statistics for a query's terms, where nothing was added since they were stored."""
        index = self._pointer("index")
        terms = sorted({t for c in S.compile_query(text, options) for t in c.terms})
        if not index or max(self._batches(), default=0) > index["upto"]:
            return None
        df = self.spark.read.schema(schemas.DOC_FREQ).parquet(f"{self.folder}/index-{index['version']}/doc_freq")
        rows = df.where(F.col("term").isin(terms)).collect() if terms else []  # a few rows per term of the query
        return S.Statistics(index["documents"], {(r.field, r.term): r.df for r in rows})

    def search(self, text: str, fields: tuple[str, ...] = S.DEFAULT_FIELDS, highlight: bool = True, limit: int = S.TOP) -> DataFrame:
        options = S.Options(fields=fields or S.DEFAULT_FIELDS, rules=self.rules, limit=limit)
        return S.results(self.postings(), self.documents(html=False), text, options, highlight, self.statistics(text, options))

    def search_all(self, queries: DataFrame, limit: int = S.TOP) -> DataFrame:
        """(query_id, rank, url, relevance) of a table (query_id, text) of queries."""
        return S.batch_ranked(self.postings(), self.documents(html=False), queries, S.Options(rules=self.rules, limit=limit))

    def total(self, text: str) -> int:
        return S.total(self.postings(), self.documents(html=False), text, S.Options(rules=self.rules)).first()[0]

    def answer(self, message: str) -> str | None:
        """The answer to one query message {"text", "highlight", "fields"} as JSON: total, query, documents and the
        history of the resolved query. A query with a broken pattern finds no documents, and its ``error`` says why. None
        for a message that is not such an object."""
        try:
            q = json.loads(message)
        except ValueError:
            return None
        if not isinstance(q, dict):
            return None
        text = q["text"] if isinstance(q.get("text"), str) else ""
        fields = tuple(f for f in q["fields"] if isinstance(f, str)) if isinstance(q.get("fields"), list) else ()
        highlight = q["highlight"] if isinstance(q.get("highlight"), str) else ""
        options = S.Options(fields=fields or S.DEFAULT_FIELDS, rules=self.rules)
        docs = self.search(text, options.fields, highlight == "HTML").orderBy("rank").collect()
        out = {
            "total": self.total(text),
            "query": {"text": self.rules.resolve(text), "highlight": highlight, "fields": list(options.fields)},
            "documents": [{"url": r.url, "html": "", "title": r.title, "text": r.text, "favicon": r.favicon, "score": r.score} for r in docs],
            "history": [{"url": r.url, "title": r.title, "count": r["count"]} for r in self.history_for(text).collect()],
        }
        if wrong := S.wrong_with(text, options):
            out["error"] = wrong
        return json.dumps(out)

    def answer_typed(self, steps: Iterable[str], **message) -> Iterator[str]:
        """Answers to the states of a text that is being typed, one after another; a state equal to the one before is not
        asked again."""
        before = None
        for text in steps:
            if text != before:
                yield self.answer(json.dumps({"text": text, **message}))
            before = text

    def record_clicks(self, clicks: DataFrame) -> None:
        """Adds (url, title, query) events; queries are kept with their aliases resolved. Events that carry a click_id (and
        their time ts) keep it, and one that is sent again counts once; others get a new one."""
        rows = clicks.where("url is not null and query is not null").withColumn("query", self.rules.resolve_column(F.col("query")))
        given = lambda c, new: F.coalesce(F.col(c), new) if c in clicks.columns else new
        cols = ["query", "url", "title", given("ts", F.current_timestamp()).cast("timestamp").alias("ts"), given("click_id", F.uuid()).cast("string").alias("click_id")]
        rows.select(*cols).write.mode("append").parquet(f"{self.folder}/clicks")

    def clicks(self) -> DataFrame:
        """Every click once."""
        rows = storage.stored(self.spark, f"{self.folder}/clicks", schemas.CLICK_EVENT)
        return rows.groupBy("click_id").agg(F.min(F.struct("ts", "query", "url", "title")).alias("c")).select("click_id", "c.*")

    def history_for(self, text: str, limit: int = H.TOP) -> DataFrame:
        """(url, title, count) of a query's most clicked links; only clicks on these links are read for their titles."""
        clicks = self.clicks()
        own = cut(H.counts(clicks.where(F.col("query") == self.rules.resolve(text))).orderBy(F.desc("count"), "url").limit(limit).select("url", "count"))
        titles = H.links(lookup_join(clicks, own.select("url"), ["url"], "left_semi"))
        return own.join(titles, "url").select("url", "title", "count").orderBy(F.desc("count"), "url")

    def list_urls(self) -> DataFrame:
        return self.documents().select("url")

    def set_patterns(self, skip: str, priority: str) -> None:
        self._keep(self.rules.with_patterns(skip, priority))

    def add_alias(self, keyword: str, value: str) -> None:
        self._keep(self.rules.with_alias(keyword, value))

    def delete_alias(self, keyword: str) -> None:
        self._keep(self.rules.without_alias(keyword))

    def _keep(self, rules: Rules) -> None:
        rules.save(self.spark, f"{self.folder}/rules.json")
        self.rules = rules


def migrate(spark: SparkSession, folder: str) -> int:
    """Runs the steps that are not yet recorded and records each once it is done; returns the version."""
    done = int(storage.read_text(spark, f"{folder}/version") or 0)
    for number, step in enumerate(MIGRATIONS[done:], done + 1):
        step(folder)
        storage.write_text(spark, f"{folder}/version", str(number))
        done = number
    return done


def main() -> None:
    p = argparse.ArgumentParser()
    p.add_argument("command", choices=["list-urls", "search", "create-config", "refresh"])
    p.add_argument("argument", nargs="?", default="")
    p.add_argument("--config")
    p.add_argument("--folder")
    a = p.parse_args()
    if a.command == "create-config":
        sources.Config().write(a.argument)
        return
    config = sources.Config.load(a.config)
    spark = SparkSession.builder.appName("mnemora").getOrCreate()
    archive = Archive(spark, a.folder or config.full_path("archive"), config)
    if a.command == "refresh":
        archive.refresh()
    elif a.command == "search":
        archive.search(a.argument).show(truncate=False)
    else:
        for r in archive.list_urls().toLocalIterator():
            print(r.url)


if __name__ == "__main__":
    main()
