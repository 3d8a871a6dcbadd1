"""Graph extraction as a pluggable, resumable job.

An extractor is `make() -> fn(texts, task) -> graphs`: make runs once in each Python worker (models load
there), fn gets a bounded batch of texts of one task and returns a graph for each. What is done is appended
to a checkpoint table; a later run takes up only the samples that are not in it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import cache

import pandas as pd
from groundwork.constants import ENTITY_LABELS, RELATION_THRESHOLDS, RELATIONS
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwork import schemas
from groundwork.sources import readers, sinks

Graph = dict
Extractor = Callable[[Sequence[str], str], list[Graph]]

_EMPTY: Graph = {"entities": [], "relations": []}


@cache
def _loaded(make: Callable[[], Extractor]) -> Extractor:
    return make()


def with_halving(run: Extractor, texts: Sequence[str], task: str, too_large: Callable[[BaseException], bool]) -> list[Graph]:
    """run on all texts, or on halves of them where the batch proves too large; a single text's error stands."""
    try:
        got = run(texts, task)
    except Exception as error:
        if len(texts) < 2 or not too_large(error):
            raise
        middle = len(texts) // 2
        return with_halving(run, texts[:middle], task, too_large) + with_halving(run, texts[middle:], task, too_large)
    if len(got) != len(texts):
        raise ValueError(f"{len(got)} graphs for {len(texts)} texts")
    return got


def or_empty(run: Extractor) -> Extractor:
    """run, with empty graphs for a batch that fails."""

    def safe(texts: Sequence[str], task: str) -> list[Graph]:
        try:
            return run(texts, task)
        except Exception:
            return [_EMPTY] * len(texts)

    return safe


def extract(samples: DataFrame, make: Callable[[], Extractor], batch: int = 8, sides: Sequence[str] = ("context", "response"), too_large: Callable[[BaseException], bool] = lambda e: isinstance(e, MemoryError)) -> DataFrame:
    """Graphs of each sample's sides, for columns sample_id, task_type and one text column for each side;
    blank texts have an empty graph without asking the extractor."""
    names = [f"{s}_graph" for s in sides]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for task, rows in pdf.groupby("task_type", sort=True):
                for at in range(0, len(rows), batch):
                    part = rows.iloc[at : at + batch]
                    out = {"sample_id": part["sample_id"].to_numpy(), "task_type": [task] * len(part)}
                    for side, name in zip(sides, names):
                        texts = [t or "" for t in part[side]]
                        full = [i for i, t in enumerate(texts) if t.strip()]
                        got = with_halving(_loaded(make), [texts[i] for i in full], task, too_large) if full else []
                        graphs = [_EMPTY] * len(texts)
                        for i, g in zip(full, got):
                            graphs[i] = g
                        out[name] = graphs
                    yield pd.DataFrame(out)

    schema = "sample_id string, task_type string, " + ", ".join(f"{n} {schemas.GRAPH}" for n in names)
    return samples.select("sample_id", "task_type", *sides).mapInPandas(run, schema)


def by_task(make: Callable[[Sequence[str], Sequence[str], float], Extractor], labels: Sequence[str] = ENTITY_LABELS, thresholds: dict[str, float] = RELATION_THRESHOLDS) -> Callable[[], Extractor]:
    """Extractors set up as the corpora are: entity labels for all, relation labels and least score by task.
    make gets (entity labels, relation labels, least relation score) and is called once for a task and worker."""

    def made() -> Extractor:
        of: dict[str, Extractor] = {}

        def run(texts: Sequence[str], task: str) -> list[Graph]:
            if task not in of:
                of[task] = make(labels, [text for _, text in RELATIONS[task]], thresholds[task])
            return of[task](texts, task)

        return run

    return made


def remaining(samples: DataFrame, done: DataFrame) -> DataFrame:
    """Samples that are not done yet."""
    return samples.join(done.select("sample_id").distinct(), "sample_id", "left_anti")


def extract_resumable(spark: SparkSession, samples: DataFrame, make: Callable[[], Extractor], path: str, slices: int = 1, **options) -> DataFrame:
    """Extract what the checkpoint at path lacks, slice by slice (each is committed as a whole), and return all
    graphs of samples. Slices are by hash of the id."""
    for s in range(slices):
        part = samples.filter(F.pmod(F.xxhash64("sample_id"), F.lit(slices)) == s)
        todo = remaining(part, spark.read.schema(schemas.GRAPH_PAIR).json(path)) if sinks.exists(spark, path) else part
        if not todo.isEmpty():
            sinks.write_graphs(extract(todo, make, **options), path, append=True)
    return readers.graphs(spark, path, samples)


def extract_stream(spark: SparkSession, source: str, schema: str, make: Callable[[], Extractor], path: str, checkpoint: str, **options):
    """A file-source stream of samples whose graphs are appended to path; a batch that is run again leaves no
    second copy, as samples already there are left out."""

    def each(batch: DataFrame, number: int) -> None:
        todo = remaining(batch, spark.read.schema(schemas.GRAPH_PAIR).json(path)) if sinks.exists(spark, path) else batch
        sinks.write_graphs(extract(todo.dropDuplicates(["sample_id"]), make, **options), path, append=True)

    return spark.readStream.schema(schema).json(source).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def get_graphs(spark: SparkSession, samples: DataFrame, path: str, make: Callable[[], Extractor] | None = None, **options) -> DataFrame:
    """The graphs at path for these samples; extracted first where an extractor is given. A sample without a
    graph is an error."""
    from groundwork import contracts

    got = extract_resumable(spark, samples, make, path, **options) if make else readers.graphs(spark, path, samples)
    contracts.covered(samples, got, "sample_id")
    return got


def capitalised_words() -> Extractor:
    """A rule-based extractor: capitalised words are entities, neighbours are related."""
    import re

    word = re.compile(r"\b[A-Z]\w{2,}")

    def run(texts: Sequence[str], task: str) -> list[Graph]:
        out = []
        for text in texts:
            ents = [{"start": m.start(), "end": m.end(), "text": m[0], "label": "other named entity", "score": 1.0} for m in word.finditer(text)]
            rel = [{"head_start": a["start"], "head_end": a["end"], "head_text": a["text"], "tail_start": b["start"], "tail_end": b["end"], "tail_text": b["text"], "relation_id": "part_of", "score": 1.0} for a, b in zip(ents, ents[1:])]
            out.append({"entities": ents, "relations": rel})
        return out

    return run
