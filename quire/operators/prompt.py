"""Prompts from retrieved passages and edges, generators, and the parser of answers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import tables as T
from ..functions.scalar import strip

# Fixed value: how an answer has to be laid out, which parse() reads.
FORMAT = "[Required Format]\nRespond ONLY using the three-section format:\n## Answer\n## Evidence\n## Graph Reasoning"
RULES = """Answer a question about a research paper from the passages below and from nothing else.
Say so where they do not hold the answer. Cite passages as [P1], [P2], and use the graph relationships
to say how things are connected. Write three sections, headed ## Answer, ## Evidence and ## Graph Reasoning.
"""


def passages(ranked: DataFrame, most: int = T.PASSAGES, chars: int = T.PASSAGE_CHARS) -> DataFrame:
    """(query_id, passage_no, ..., passage): the best usable rows, labelled, long ones cut and marked."""
    use = ranked.where((strip(F.col("text")) != "") & ~F.col("region_class").isin(*T.NOISE_CLASSES) & (F.col("role") != "N/A"))
    priority = F.coalesce(F.array_position(F.array(*map(F.lit, T.ROLE_PRIORITY)), F.col("role")), F.lit(0))
    priority = F.when(priority == 0, len(T.ROLE_PRIORITY) + 1).otherwise(priority)
    order = W.partitionBy("query_id").orderBy(F.col("final_score").desc(), priority, "final_rank")
    use = use.withColumn("passage_no", F.row_number().over(order)).where(F.col("passage_no") <= most)
    body = F.concat(strip(F.substring("text", 1, chars)), F.when(F.length("text") > chars, " …").otherwise(""))
    label = F.concat(F.lit("[P"), "passage_no", F.lit(" | Role: "), "role", F.lit(" | Page: "), "page", F.lit(" | Node: "), F.substring(F.col("node_id").cast("string"), 1, 8), F.lit(" | Score: "), F.format_string("%.3f", F.floor(F.col("final_score") * 1e3 + 0.5) / 1e3), F.lit("]"))
    return use.withColumn("evidence", body).withColumn("passage", F.concat(label, F.lit("\n"), body)).select("query_id", "passage_no", "node_id", "role", "page", "final_score", "origin", "evidence", "passage")


def prompt_edges(subgraph: DataFrame, nodes: DataFrame, most: int = T.PROMPT_EDGES) -> DataFrame:
    """(query_id, edge_no, line): relations that matter first, then by weight."""
    kind = nodes.select("node_id", F.initcap("region_class").alias("kind"))
    s, t = kind.toDF("src", "src_kind"), kind.toDF("tgt", "tgt_kind")
    late = (~F.col("relation").isin(*T.PRIORITY_RELATIONS)).cast("int")
    order = W.partitionBy("query_id").orderBy(late, F.col("weight").desc(), "doc", "edge_seq")
    out = subgraph.withColumn("edge_no", F.row_number().over(order)).where(F.col("edge_no") <= most).join(s, "src").join(t, "tgt")
    name = lambda x: F.concat(F.col(f"{x}_kind"), F.lit("["), F.substring(F.col(x).cast("string"), 1, 8), F.lit("]"))
    return out.select("query_id", "edge_no", F.concat(name("src"), F.lit(" --"), "relation", F.lit("--> "), name("tgt")).alias("line"))


def assemble(queries: DataFrame, passage_rows: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """(query_id, prompt): one text per query; edges are left out where there are none."""
    p = passage_rows.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("passage_no", "passage"))), lambda x: x["passage"]).alias("ps"))
    e = edge_rows.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("edge_no", "line"))), lambda x: F.concat(F.lit("  "), x["line"])).alias("es"))
    out = queries.select("query_id", "query").join(p, "query_id", "left").join(e, "query_id", "left")
    text = F.concat(F.lit("[Context Passages]\n"), F.coalesce(F.array_join("ps", "\n\n"), F.lit("No relevant passages found.")))
    graph = F.concat(F.lit("[Graph Relationships]\n"), F.array_join("es", "\n"))
    return out.select("query_id", F.concat_ws("\n\n", text, graph, F.concat(F.lit("[Question]\n"), "query"), F.lit(FORMAT)).alias("prompt"))


def extractive(rules: str, prompt: str) -> str:
    """A generator without a model: it answers with the first passages it is given."""
    parts = prompt.split("\n\n")
    cited = [p for p in parts if p.startswith("[Context Passages]") or p.startswith("[P")]
    cited = [p.removeprefix("[Context Passages]\n") for p in cited]
    labels = [p.split(" | ")[0] + "]" for p in cited if p.startswith("[P")]
    edges = [p for p in parts if p.startswith("[Graph Relationships]\n")]
    answer = f"The passages {', '.join(labels[:2])} bear on this." if labels else "The context does not hold enough information."
    return f"## Answer\n{answer}\n\n## Evidence\n" + "\n".join(f"{k}. {x}" for k, x in enumerate(labels, 1)) + "\n\n## Graph Reasoning\n" + "\n".join(edges).removeprefix("[Graph Relationships]\n")


def generate(prompts: DataFrame, generator: Callable[..., str] = extractive, attempts: int = 2, temperature: float | None = None) -> DataFrame:
    """(query_id, response, error): prompts through any function of (rules, prompt), tried again on errors.

    A temperature is handed to the generator with each call, so its own setting stays as it is.
    """
    more = {} if temperature is None else {"temperature": temperature}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said, failed = [], []
            for prompt in batch.column(1).to_pylist():
                out, error = None, None
                for _ in range(attempts):
                    try:
                        out, error = generator(RULES, prompt, **more), None
                        break
                    except Exception as e:  # a generator can be any service
                        error = str(e)
                said.append(out)
                failed.append(error)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(said, pa.string()), pa.array(failed, pa.string())], names=["query_id", "response", "error"])

    return prompts.select("query_id", "prompt").mapInArrow(run, "query_id long, response string, error string")


def stream(prompts: DataFrame, generator: Callable[..., Iterator[str]], temperature: float | None = None) -> DataFrame:
    """(query_id, seq, piece, error): answers as their generator gives them, piece by piece; an error is the last piece."""
    more = {} if temperature is None else {"temperature": temperature}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for query, prompt in zip(*(c.to_pylist() for c in batch.columns)):
                k = -1
                try:
                    for k, piece in enumerate(generator(RULES, prompt, **more)):
                        yield _piece(query, k, piece, None)
                except Exception as e:  # a generator can be any service
                    yield _piece(query, k + 1, "", str(e))

    return prompts.select("query_id", "prompt").mapInArrow(run, "query_id long, seq int, piece string, error string")


def _piece(query: int, k: int, piece: str, error: str | None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([query], pa.int64()), pa.array([k], pa.int32()), pa.array([piece], pa.string()), pa.array([error], pa.string())], names=["query_id", "seq", "piece", "error"])


def parse(responses: DataFrame, column: str = "response") -> DataFrame:
    """Adds answer, evidence and reasoning; of repeated headings the last holds, and a text without any is the answer."""
    text = F.coalesce(F.col(column), F.lit(""))
    marked = F.regexp_replace(text, r"(?i)##\s*(Answer|Evidence|Graph Reasoning)\s*\n", "\u0001$1\u0002")
    parts = F.slice(F.split(marked, "\u0001", -1), 2, F.greatest(F.size(F.split(marked, "\u0001", -1)) - 1, F.lit(0)))

    def section(name: str):
        own = F.filter("_parts", lambda p: F.lower(F.substring_index(p, "\u0002", 1)) == name)
        return F.when(F.size(own) > 0, strip(F.substring_index(F.element_at(own, -1), "\u0002", -1))).otherwise("")

    out = responses.withColumn("_parts", parts)
    out = out.withColumn("answer", section("answer")).withColumn("evidence", section("evidence")).withColumn("reasoning", section("graph reasoning")).drop("_parts")
    return out.withColumn("answer", F.when((F.col("answer") == "") & (F.col("evidence") == ""), strip(text)).otherwise(F.col("answer")))
