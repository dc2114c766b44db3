"""The engine: ingest, query, list, delete and chat over one store."""

from __future__ import annotations

import json
import logging
import uuid
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructField, StructType

from chunkwell.functions.text import citations, is_blank
from chunkwell.operators import chat, chunking, retrieval
from chunkwell.operators.retrieval import Embedder, HashedEmbedder
from chunkwell.plans import prompt as prompts
from chunkwell.schema import SESSION, TURN
from chunkwell.settings import Settings
from chunkwell.sources.files import read_directory
from chunkwell.sources.store import Store, embedded, with_ids

_LOG = logging.getLogger(__name__)
#: Fixed value: characters of a question that are logged.
LOGGED = 100


class Generator(Protocol):
    """Answers prompts; `structured` gives a JSON text or None."""

    def generate(self, prompt: str) -> str: ...
    def structured(self, prompt: str) -> str | None: ...


class ExtractiveGenerator:
    """A deterministic stand-in for a language model: cites the excerpts of the prompt, asks nothing."""

    def generate(self, prompt: str) -> str:
        out, path = [], None
        for line in prompt.split("\n"):
            if line.startswith("File: "):
                path = line[6:]
            elif line.startswith("Lines: ") and path is not None:
                out.append(f"See [FILE: {path}, LINES: {line[7:]}].")
                path = None
        return "\n".join(out)

    def structured(self, prompt: str) -> str | None:
        return None


EMPTY_ANSWER = "The generator gave no answer to this question."
FAILED_ANSWER = "The generator failed on this question."


def safe_answer(generator: Generator, prompt: str) -> str:
    """An answer; a blank one or a failure gives an apology and never raises."""
    try:
        text = generator.generate(prompt) or ""
    except Exception:  # noqa: BLE001
        return FAILED_ANSWER
    return text if text.strip() else EMPTY_ANSWER


def subquestions(generator: Generator, prompt: str) -> list[str]:
    """Sub-questions of a reply; none if it fails or is no such JSON."""
    try:
        found = json.loads(generator.structured(prompt) or "{}").get("subquestions", [])
        return [x for x in found if isinstance(x, str)] if isinstance(found, list) else []
    except Exception:  # noqa: BLE001
        return []


def _replies(prompts_: DataFrame, key: str, load: Callable[[], Generator], reply: Callable[[Generator, str], object], kind: DataType) -> DataFrame:
    """key and `reply`, of type `kind`, to each prompt (key, prompt), by a generator on the executors over Arrow batches."""
    rows, arrow = prompts_.select(key, "prompt"), pa.list_(pa.string()) if isinstance(kind, ArrayType) else pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        generator = load()
        for batch in batches:
            found = [reply(generator, p) for p in batch.column("prompt").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(found, arrow)], names=[key, "reply"])

    return rows.mapInArrow(run, StructType([rows.schema[key], StructField("reply", kind)]))


def answered(prompts_: DataFrame, key: str, load: Callable[[], Generator] = ExtractiveGenerator) -> DataFrame:
    """key, answer, sources and status (ok, or not_found where the answer says so) of many prompts (key, prompt)."""
    rows = _replies(prompts_, key, load, safe_answer, StringType()).withColumnRenamed("reply", "answer")
    return rows.select(key, "answer", citations("answer").alias("sources"), F.when(prompts.is_not_found("answer"), "not_found").otherwise("ok").alias("status"))


def asked_further(questions: DataFrame, prompts_: DataFrame, key: str, load: Callable[[], Generator] = ExtractiveGenerator) -> DataFrame:
    """Every search of many questions (key, query): key, query_no (0 is the question itself, then its sub-questions), text."""
    further = _replies(prompts_, key, load, subquestions, ArrayType(StringType()))
    own = questions.select(key, F.lit(0).alias("query_no"), F.col("query").alias("text"))
    return own.unionByName(further.select(key, F.posexplode("reply").alias("n", "text")).select(key, (F.col("n") + 1).alias("query_no"), "text"))


class NotFound(LookupError):
    """No such repository, or nothing relevant in it."""


def search_many(records: DataFrame, searches: DataFrame, key: str, embedder: Embedder, top_k: int) -> DataFrame:
    """Hits of many searches (key, query_no, text) among records (id, embedding, chunk columns), first wins within each key."""
    numbered = searches.withColumn("_search", F.xxhash64(key, "query_no"))
    best = retrieval.sparse_top_k(records.select("id", "embedding"), "id", embedder.add(numbered, "text"), "_search", top_k)
    hits = best.join(numbered.select("_search", key, "query_no"), "_search").join(records.drop("embedding"), "id")
    return retrieval.first_wins(hits, by=[key])


def answer_many(
    records: DataFrame, questions: DataFrame, key: str, embedder: Embedder, top_k: int = 3, two_pass: bool = False,
    load: Callable[[], Generator] = ExtractiveGenerator, limit: int = prompts.MAX_TOKENS,
) -> DataFrame:
    """key, chunks, answer, sources, status for each of many questions (key, query) from records; those without a hit are not_found."""
    rows = questions.select(key, "query", F.lit("").alias("history"))
    searches = rows.select(key, F.lit(0).alias("query_no"), F.col("query").alias("text"))
    hits = search_many(records, searches, key, embedder, top_k)
    if two_pass:
        searches = asked_further(rows, prompts.subquestion_prompts(hits, rows, key), key, load)
        hits = search_many(records, searches, key, embedder, top_k)
    made = prompts.rag_prompts(hits, rows, key, limit=limit)
    none = F.col("chunks") == 0
    told = made.select(key, "chunks").join(answered(made, key, load), key)
    return told.select(
        key, "chunks", F.when(none, prompts.NOT_FOUND).otherwise(F.col("answer")).alias("answer"),
        F.when(none, F.array().cast(told.schema["sources"].dataType)).otherwise(F.col("sources")).alias("sources"), F.when(none, "not_found").otherwise(F.col("status")).alias("status"),
    )


class Engine:
    """One session of the engine; conversations are tables that live as long as it does."""

    def __init__(self, spark: SparkSession, settings: Settings | None = None, embedder: Embedder | None = None, generator: Generator | None = None) -> None:
        self.spark, self.settings = spark, settings or Settings()
        self.store = Store(spark, self.settings.store_path, self.settings.max_records)
        self.embedder, self.generator = embedder or HashedEmbedder(), generator or ExtractiveGenerator()
        self._turns: DataFrame = spark.createDataFrame([], TURN)
        self._sessions: DataFrame = spark.createDataFrame([], SESSION)

    def ingest(self, files: DataFrame | str, repo_name: str, mode: str = "upsert") -> list[dict]:
        """Chunk files, or those of a directory, embed the chunks and write them; the files that gave no chunk, by path."""
        rows = read_directory(self.spark, files, repo_name) if isinstance(files, str) else files
        chunks = with_ids(chunking.chunk_files(rows, errors=True))
        self.store.write(repo_name, embedded(chunks, self.embedder), mode, failed=F.col("chunk_type") == chunking.PARSE_ERROR)
        return [r.asDict() for r in self.unchunked(rows, repo_name).collect()]

    def unchunked(self, files: DataFrame, repo_name: str) -> DataFrame:
        """(file_path, error) of files of which the collection holds nothing, so that none is lost unseen."""
        there = self.store.read(repo_name).select("file_path").distinct()
        reason = F.when(F.col("content").isNull(), "no content").when(is_blank("content"), "blank").otherwise("no chunk")
        return files.select("file_path", reason.alias("error")).join(there, "file_path", "left_anti")

    def retrieve(self, repo_name: str, queries: list[str], top_k: int) -> DataFrame:
        """Hits of every query, in order: query_no, rank and chunk columns, as a local table of at most queries * top_k rows."""
        asked = self.spark.createDataFrame(list(enumerate(queries)), "query_no long, text string")
        best = self._best(repo_name, asked, top_k).select("query_no", "rank", "id")
        hits = self.spark.createDataFrame(best.collect(), best.schema)
        found = hits.join(self.store.fetch(repo_name, [r["id"] for r in hits.select("id").distinct().collect()]).drop("embedding", "vector", "cell"), "id")
        return self.spark.createDataFrame(found.collect(), found.schema)

    def _best(self, repo_name: str, asked: DataFrame, top_k: int) -> DataFrame:
        """query_no, rank, id of the records nearest to each of some queries (query_no, text): dense ones in the collection's cells where it has them."""
        made = self.embedder.add(asked, "text")
        if self.embedder.kind == "sparse":
            return retrieval.sparse_top_k(self.store.read(repo_name).select("id", "embedding"), "id", made, "query_no", top_k)
        return self.store.nearest(repo_name, {r["query_no"]: r["vector"] for r in made.collect()}, top_k, self.settings.probes or None)

    def query_many(self, repo_name: str, questions: DataFrame, key: str, top_k: int | None = None, two_pass: bool | None = None, load: Callable[[], Generator] = ExtractiveGenerator) -> DataFrame:
        """key, chunks, answer, sources, status for each of many questions (key, query), in one plan and without a history.

        Searches, budgets and prompts are keyed by the question, and the generator that `load` makes runs on the executors.
        """
        if not self.store.exists(repo_name):
            raise NotFound(repo_name)
        if self.embedder.kind != "sparse":
            raise ValueError("many questions need sparse embeddings")
        records = self.store.read(repo_name)
        return answer_many(records, questions, key, self.embedder, top_k or self.settings.top_k, self.settings.two_pass if two_pass is None else two_pass, load)

    def query(self, repo_name: str, question: str, conversation_id: str | None = None, top_k: int | None = None, two_pass: bool | None = None) -> dict:
        """{query, answer, sources, conversation_id, status}; NotFound for a missing repository, no hit, or an answer that says so."""
        if top_k is not None and top_k < 3:
            raise ValueError("top_k must be at least 3")
        _LOG.info("query of %s: %s...", repo_name, question[:LOGGED])
        if not self.store.exists(repo_name):
            raise NotFound(repo_name)
        k = top_k or self.settings.top_k
        past = self._history(conversation_id)
        base = {"query": question, "sources": [], "conversation_id": conversation_id}
        try:
            hits = self.retrieve(repo_name, [question], k)
            if self.settings.two_pass if two_pass is None else two_pass:
                first = retrieval.first_wins(hits)
                asked = subquestions(self.generator, prompts.subquestion_prompt(first, question, past).collect()[0]["prompt"])
                if asked:
                    hits = self.retrieve(repo_name, [question, *asked], k)
            hits = retrieval.expand_context(retrieval.first_wins(hits), self.settings.context_expansion)
            row = prompts.rag_prompt(hits, question, past).collect()[0]
            found = bool(hits.take(1))
        except Exception as error:  # noqa: BLE001
            return base | {"answer": f"The search failed: {error}", "status": "error"}
        if not found:
            raise NotFound(prompts.NOT_FOUND)
        answer = safe_answer(self.generator, row["prompt"])
        literal = F.lit(answer)
        told = self.spark.range(1).select(citations(literal).alias("c"), prompts.is_not_found(literal).alias("none")).collect()[0]
        if told["none"]:
            raise NotFound(answer)
        if conversation_id is not None:
            new = self.spark.createDataFrame([(conversation_id, 1, question, answer)], "conversation_id string, at int, query string, response string")
            self._turns = self._local(chat.add_messages(self._turns, new))
            self._know(conversation_id)
        return base | {"answer": answer, "sources": [c.asDict() for c in told["c"]], "status": "ok"}

    def _local(self, rows: DataFrame) -> DataFrame:
        """The rows as a table without lineage: a session's turns are few."""
        return self.spark.createDataFrame(rows.collect(), rows.schema)

    def _know(self, conversation_id: str) -> None:
        if conversation_id not in self.sessions():
            at = len(self.sessions())
            self._sessions = self._local(self._sessions.union(self.spark.createDataFrame([(conversation_id, at)], SESSION)))

    def _history(self, conversation_id: str | None) -> Column:
        own = chat.history(self._turns.where(F.col("conversation_id").eqNullSafe(F.lit(conversation_id)))).collect()
        if not own:
            return F.lit("")
        pairs = [F.struct(F.lit(t["query"]).alias("query"), F.lit(t["response"]).alias("response")) for t in own[0]["turns"]]
        return prompts.history_text(F.array(*pairs))

    @property
    def chats(self) -> dict[str, list[tuple[str, str]]]:
        """The turns of every known conversation, in order."""
        found = {r["conversation_id"]: [(t["query"], t["response"]) for t in r["turns"]] for r in chat.history(self._turns).collect()}
        return {name: found.get(name, []) for name in self.sessions()}

    def repos(self) -> list[str]:
        return self.store.list()

    def delete(self, repo_name: str) -> None:
        if not self.store.exists(repo_name):
            raise NotFound(repo_name)
        self.store.delete(repo_name)

    def new_session(self) -> str:
        name = str(uuid.uuid4())
        self._know(name)
        return name

    def clear(self, conversation_id: str) -> None:
        """Forget a conversation; an unknown one changes nothing."""
        gone = self.spark.createDataFrame([(conversation_id,)], "conversation_id string")
        self._turns, self._sessions = (self._local(chat.clear(rows, gone)) for rows in (self._turns, self._sessions))

    def sessions(self) -> list[str]:
        return [r["conversation_id"] for r in self._sessions.orderBy("at").collect()]
