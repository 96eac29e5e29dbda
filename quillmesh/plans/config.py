"""Validated settings and parallelism presets."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields
from pathlib import Path

from pyspark.sql import SparkSession



@dataclass(frozen=True)
class Preset:
    """Most workers of each stage on one machine (None: all but two cores; 0: no limit), and documents handed to a worker at a time."""

    ingest_threads: int | None
    ingest_processes: int | None
    split_workers: int | None
    tokenize_workers: int | None
    batch: int
    #: Whether the numbers are kept on machines of fewer cores.
    fixed: bool = False

    def on(self, cores: int) -> dict[str, int]:
        """The five knobs on a machine of so many cores; 0 stands for no limit."""
        free = max(cores - 2, 1)
        most = {"ingest_threads": self.ingest_threads, "ingest_processes": self.ingest_processes, "split_max_parallel_workers": self.split_workers, "tokenize_max_parallel_workers": self.tokenize_workers}
        return {k: free if n is None else n if self.fixed or n == 0 else min(free, n) for k, n in most.items()} | {"split_worker_batch_size": self.batch}


# The presets' knobs.
PRESETS = {
    "minimal": Preset(1, 1, 1, 1, 5000, fixed=True),
    "low": Preset(4, 2, 2, 2, 3000, fixed=True),
    "normal": Preset(8, 4, 4, 4, 2000),
    "high": Preset(16, 8, 8, 8, 2000),
    "maximum": Preset(None, None, 0, 0, 1000),
}
DOCUMENT_TYPES = ("", "document", "image", "audio")


@dataclass(frozen=True)
class QueryConfig:
    """Settings of building and asking; a value out of range raises ValueError."""

    chunk_size: int = 700
    chunk_overlap: int = 250
    contexts: int = 5
    similarity: float = 0.7
    search_term: str = ""
    document_types: str = ""
    pipeline_preset: str = "normal"

    def __post_init__(self) -> None:
        object.__setattr__(self, "contexts", int(self.contexts))
        if not 0 < self.chunk_size <= 100_000:
            raise ValueError("chunk_size must be in 1..100000")
        if not 0 <= self.chunk_overlap <= 100_000 or self.chunk_overlap >= self.chunk_size:
            raise ValueError("chunk_overlap must be at least 0 and below chunk_size")
        if not 0 < self.contexts <= 1000:
            raise ValueError("contexts must be in 1..1000")
        if not 0 <= self.similarity <= 1:
            raise ValueError("similarity must be in 0..1")
        if self.document_types not in DOCUMENT_TYPES:
            raise ValueError(f"document_types must be one of {DOCUMENT_TYPES}")
        if self.pipeline_preset not in PRESETS:
            raise ValueError(f"pipeline_preset must be one of {tuple(PRESETS)}")

    def save(self, file: str | Path) -> None:
        Path(file).write_text(json.dumps(asdict(self), indent=2))


def _read(file: str | Path) -> dict:
    """Settings of a JSON or YAML file; of nested ones the section ``database`` counts, and names on top."""
    text = Path(file).read_text()
    if Path(file).suffix.lower() in (".yaml", ".yml"):
        import yaml

        try:
            raw = yaml.safe_load(text)
        except yaml.YAMLError as problem:
            raise ValueError(str(problem)) from problem
    else:
        raw = json.loads(text)
    if not isinstance(raw, dict):
        raise ValueError("settings are names and values")
    section = raw.get("database")
    return {k: v for k, v in raw.items() if k != "database"} | (section if isinstance(section, dict) else {})


def load_config(file: str | Path) -> tuple[QueryConfig, list[str]]:
    """Settings of a JSON or YAML file and the names of those that were invalid and fell back to their defaults; ``*`` if the file can't be read."""
    try:
        raw = _read(file)
    except (OSError, ValueError):
        return QueryConfig(), ["*"]
    kept: dict = {}
    bad: list[str] = []
    for f in fields(QueryConfig):
        if f.name in raw:
            try:
                QueryConfig(**{**kept, f.name: raw[f.name]})
                kept[f.name] = raw[f.name]
            except (TypeError, ValueError):
                bad.append(f.name)
    return QueryConfig(**kept), bad


def apply_preset(spark: SparkSession, preset: str, cores: int | None = None) -> int:
    """Give the session a preset's share of every machine; returns the shuffle partitions.

    ``cores`` are those of one machine (executor); a cluster gets the splitting
    workers of one machine times the machines. Without a limit all cores are used. The
    batch size becomes that of Arrow batches.
    """
    if preset not in PRESETS:
        raise ValueError(f"unknown preset {preset!r}")
    every = spark.sparkContext.defaultParallelism
    own = min(cores or int(spark.conf.get("spark.executor.cores", str(every))), every)
    knobs = PRESETS[preset].on(own)
    workers = knobs["split_max_parallel_workers"] or own
    partitions = max(1, every // own * min(workers, own))
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(knobs["split_worker_batch_size"]))
    return partitions


def valid_database_name(name: str | None) -> bool:
    """At least three characters and not a word for nothing."""
    return bool(name) and len(name) >= 3 and name.lower() not in ("null", "none")


def preflight(checks: list[tuple[bool, str]]) -> str | None:
    """The message of the first check that failed."""
    return next((message for passed, message in checks if not passed), None)


# What is said when a check before a build fails.
MESSAGES = {
    "name": "Name must be at least 3 characters long and not be 'null' or 'none.'",
    "taken": "A vector database called '{name}' already exists—choose a different name or delete the old one first.",
    "model": "You must first download an embedding model, select it, and choose documents before proceeding.",
    "documents": "No documents are yet added to be processed.",
    "pages": "{n} documents have pages without text.",
}


def database_checks(name: str | None, exists: bool, model: str | None, files: int, needing_ocr: int = 0) -> list[tuple[bool, str]]:
    """What must hold before a database is built, in order: a name, a free one, a model, documents, and no page without text."""
    passed = {"name": valid_database_name(name), "taken": not exists, "model": bool(model), "documents": files > 0, "pages": needing_ocr == 0}
    return [(ok, MESSAGES[check].format(name=name, n=needing_ocr)) for check, ok in passed.items()]
