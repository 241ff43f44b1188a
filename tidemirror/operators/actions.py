"""From routed changes to actions: passthrough, user transforms in batches, embeddings, checks."""

from __future__ import annotations

import atexit
import json
import subprocess
import tempfile
import threading
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemirror.functions.scalars import action_problem, known_metric, parse_id

ACTION_SCHEMA = "config string, namespace string, lsn long, seq long, batch_id long, action string, id string, document string, vector array<float>, distance_metric string, attr_schema string, error string"
ACTION_COLUMNS = [c.split()[0] for c in ACTION_SCHEMA.split(", ")]
Transform = Callable[[pd.DataFrame], pd.DataFrame]


def reindex(cols: Column | str, places: Column | str) -> Column:
    """Values picked by 0-based place; a place out of range gives null."""
    c, p = (F.col(x) if isinstance(x, str) else x for x in (cols, places))
    return F.transform(p, lambda i: F.try_element_at(c, i.cast("int") + 1))


def row_to_event(df: DataFrame, id_column: str, id_type: str, schema: str, table: str) -> DataFrame:
    """Snapshot rows (all text) as insert changes with their id; problem tells rows with a null or bad id."""
    if id_column not in df.columns:
        raise ValueError(f"no column {id_column}")
    image = F.map_from_arrays(F.array(*[F.lit(c) for c in df.columns]), F.array(*[F.col(c).cast("string") for c in df.columns]))
    parsed = parse_id(F.col(id_column).cast("string"), id_type)
    return df.select(
        F.lit(schema).alias("src_schema"), F.lit(table).alias("src_table"), F.lit("insert").alias("op"), image.alias("new"), F.lit(None).cast("map<string,string>").alias("old"),
        F.array().cast("array<string>").alias("unchanged"), parsed.alias("id"), F.lit(id_type).alias("id_type"),
        F.when(F.col(id_column).isNull(), "id is null").when(parsed.isNull(), "id can't be parsed").alias("problem"),
    )


def filled(changes: DataFrame, columns: list[str] | None = None, fill_unchanged: bool = False) -> Column:
    """The values a document is made of: new ones, chosen columns; unchanged ones as null, or from the old values."""
    new = F.col("new")
    if fill_unchanged:
        new = F.map_concat(F.map_filter(F.coalesce("old", F.create_map().cast("map<string,string>")), lambda k, v: F.array_contains("unchanged", k)), F.map_filter(new, lambda k, v: ~F.array_contains("unchanged", k)))
    if columns is not None:
        return F.map_from_arrays(F.array(*[F.lit(c) for c in columns]), F.array(*[F.try_element_at(new, F.lit(c)) for c in columns]))
    return new


def passthrough(changes: DataFrame, columns: list[str] | None = None, fill_unchanged: bool = False) -> DataFrame:
    """Actions without user code: a document of texts for inserts and updates, a delete for deletes. No Python runs."""
    document = F.to_json(filled(changes, columns, fill_unchanged), {"ignoreNullFields": "false"})
    gone = F.col("op") == "delete"
    return changes.select(
        "config", "namespace", "lsn", "seq", F.col("ack_lsn").alias("batch_id"), F.when(gone, "delete").otherwise("upsert").alias("action"), "id", F.when(~gone, document).alias("document"),
        F.lit(None).cast("array<float>").alias("vector"), F.lit(None).cast("string").alias("distance_metric"), F.lit(None).cast("string").alias("attr_schema"), F.lit(None).cast("string").alias("error"),
    )


def transform(changes: DataFrame, functions: dict[str, Transform]) -> DataFrame:
    """User transforms in batches on the executors, one config at a time.

    A function gets a frame (op, id, columns: dict of texts, with lsn and seq) and returns one with action, id, document
    (dict, text or None), and maybe vector, distance_metric, attr_schema, in the same order of rows; fewer or more rows are
    an error. An error marks the rows of that batch and config; other configs go on.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for config, part in batch.groupby("config", sort=False):
                part = part.reset_index(drop=True)
                out = pd.DataFrame({c: part[c] for c in ("config", "namespace", "lsn", "seq", "batch_id")})
                frame = part[["op", "id", "lsn", "seq"]].assign(columns=[dict(n if n is not None else o or {}) for n, o in zip(part["new"], part["old"], strict=True)])
                try:
                    got = functions[config](frame).reset_index(drop=True)
                    if len(got) != len(part):
                        raise ValueError(f"{len(got)} actions for {len(part)} events")
                    for c in ("action", "id", "document", "vector", "distance_metric", "attr_schema"):
                        values = got[c] if c in got else [None] * len(got)
                        out[c] = pd.Series([None if isinstance(x, float) and x != x else x for x in values], dtype=object)
                    for c in ("document", "attr_schema"):
                        out[c] = [json.dumps(x) if isinstance(x, dict | list) else x for x in out[c]]
                    out["error"] = None
                except Exception as e:  # noqa: BLE001  the error goes to the dead-letter table
                    out = out.assign(action="skip", id=part["id"], document=None, vector=None, distance_metric=None, attr_schema=None, error=f"{type(e).__name__}: {e}")
                yield out[ACTION_COLUMNS]

    cols = changes.select("config", "namespace", "lsn", "seq", F.col("ack_lsn").alias("batch_id"), "op", "id", "new", "old")
    return cols.mapInPandas(run, ACTION_SCHEMA)


class _Process:
    """A running process that answers each line with a line."""

    def __init__(self, argv: list[str]):
        self.errors = tempfile.TemporaryFile()
        self.running = subprocess.Popen(argv, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=self.errors)

    def ask(self, line: bytes, timeout_s: float) -> bytes:
        """The answer; EOFError if the process has ended, TimeoutError (and it is killed) if it takes too long."""
        done: list[bytes] = []

        def talk() -> None:
            try:
                self.running.stdin.write(line)
                self.running.stdin.flush()
                done.append(self.running.stdout.readline())
            except (BrokenPipeError, ValueError):
                done.append(b"")

        thread = threading.Thread(target=talk, daemon=True)
        thread.start()
        thread.join(timeout_s)
        if thread.is_alive():
            self.close()
            raise TimeoutError(f"no answer in {timeout_s} s")
        if not done[0]:
            raise EOFError
        return done[0]

    def close(self) -> str:
        self.running.kill()
        code = self.running.wait()
        self.errors.seek(0)
        told = self.errors.read()[-300:].decode("utf-8", "replace")
        self.errors.close()
        return f"exit {code}: {told}"

    def ended(self) -> str:
        """How it ended; it has closed its output, so it ends or is made to."""
        try:
            self.running.wait(1)
        except subprocess.TimeoutExpired:
            pass
        return self.close()


#: One process for each command in a Python worker; it lives as long as the worker.
_processes: dict[tuple[str, ...], _Process] = {}


def _stop_all() -> None:
    for p in _processes.values():
        p.running.kill()


def command(argv: list[str], timeout_s: float = 30) -> Transform:
    """A transform by an external process: a JSON line of events in, a JSON line of actions out, for each batch. A worker keeps
    its process; one that has ended is started anew, and the batch tried once more; one that doesn't answer in time is killed
    and the batch fails."""
    key = tuple(argv)

    def ask(line: bytes) -> bytes:
        why = ""
        for _ in range(2):
            if key not in _processes:
                if not _processes:
                    atexit.register(_stop_all)
                _processes[key] = _Process(argv)
            try:
                return _processes[key].ask(line, timeout_s)
            except TimeoutError:
                del _processes[key]
                raise
            except EOFError:
                why = _processes.pop(key).ended()
        raise RuntimeError(why)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        events = [{"operation": op, "id": i, "columns": c} for op, i, c in zip(frame["op"], frame["id"], frame["columns"], strict=True)]
        return pd.DataFrame(json.loads(ask((json.dumps(events) + "\n").encode())), columns=["action", "id", "document", "vector", "distance_metric", "attr_schema"])

    return run


def failed(actions: DataFrame) -> DataFrame:
    return actions.where(F.col("error").isNotNull())


def fine(actions: DataFrame) -> DataFrame:
    return actions.where(F.col("error").isNull())


def not_skipped(actions: DataFrame) -> DataFrame:
    return actions.where(F.col("action") != "skip")


def checked(actions: DataFrame) -> DataFrame:
    """Actions with error filled for those that can't be written."""
    return actions.withColumn("error", F.coalesce("error", action_problem("action", "document", "vector", "distance_metric")))


def mixed_batches(actions: DataFrame) -> DataFrame:
    """Batches of a namespace that hold more than one known metric, or more than one attribute schema."""
    ups = actions.where(F.col("action") == "upsert")
    counts = ups.groupBy("namespace", "batch_id").agg(F.count_distinct(known_metric("distance_metric")).alias("metrics"), F.count_distinct("attr_schema").alias("schemas"))
    return counts.where((F.col("metrics") > 1) | (F.col("schemas") > 1)).withColumn("problem", F.when(F.col("metrics") > 1, "mixed distance metrics in batch").otherwise("mixed schemas in batch"))


def has_mixed(actions: DataFrame) -> bool:
    """Whether any batch is mixed; one aggregation of a least and a greatest value."""
    m, s = known_metric("distance_metric"), F.col("attr_schema")
    differ = F.coalesce(F.min(m) != F.max(m), F.lit(False)) | F.coalesce(F.min(s) != F.max(s), F.lit(False))
    return not actions.where(F.col("action") == "upsert").groupBy("namespace", "batch_id").agg(differ.alias("mixed")).where("mixed").isEmpty()


def uniform(actions: DataFrame) -> DataFrame:
    """The actions of batches that aren't mixed."""
    return actions.join(mixed_batches(actions).select("namespace", "batch_id"), ["namespace", "batch_id"], "left_anti")


def refuse_mixed(actions: DataFrame) -> DataFrame:
    """All actions; those of mixed batches with the problem as their error."""
    mixed = mixed_batches(fine(actions)).select("namespace", "batch_id", "problem")
    return actions.join(mixed, ["namespace", "batch_id"], "left").withColumn("error", F.coalesce("error", "problem")).select(*ACTION_COLUMNS)


def by_distinct_text(df: DataFrame, text: str, out: str, out_type: str, function: Callable[[list[str]], list]) -> DataFrame:
    """Apply a batch function once to each distinct text and hand the results back to all rows. Null texts count as ''."""
    keyed = df.withColumn("_text", F.coalesce(F.col(text), F.lit("")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"_text": batch["_text"], out: function(batch["_text"].tolist())})

    results = keyed.select("_text").distinct().mapInPandas(run, f"_text string, {out} {out_type}")
    return keyed.join(results, "_text").drop("_text")


def embed_distinct(df: DataFrame, text: str, embedder: Callable[[list[str]], list[list[float]]], out: str = "vector") -> DataFrame:
    return by_distinct_text(df, text, out, "array<float>", embedder)


def truncate_tokens(df: DataFrame, text: str, most: int, out: str = "truncated", tokenizer: Callable[[list[str]], list[list[str]]] | None = None) -> DataFrame:
    """The first ``most`` tokens of each text, joined by a space. Without a tokenizer words are tokens, and no Python runs."""
    if tokenizer is None:
        words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), lambda w: w != "")
        return df.withColumn(out, F.array_join(F.slice(words, 1, most), " "))
    return by_distinct_text(df, text, out, "string", lambda texts: [" ".join(t[:most]) for t in tokenizer(texts)])


def embed_and_upsert(changes: DataFrame, text_column: str, embedder: Callable[[list[str]], list[list[float]]], metric: str = "cosine_distance", attr_schema: str | None = None) -> DataFrame:
    """Deletes pass; other changes become upserts with the embedding of one text column (null as '')."""
    base = passthrough(changes)
    text = changes.select("config", "lsn", "seq", "id", F.try_element_at("new", F.lit(text_column)).alias("_body"), "op")
    vectors = embed_distinct(text.where("op <> 'delete'"), "_body", embedder, "_vector").select("config", "lsn", "seq", "id", "_vector")
    joined = base.join(vectors, ["config", "lsn", "seq", "id"], "left")
    up = F.col("action") == "upsert"
    return joined.withColumns({"vector": F.when(up, F.col("_vector")), "distance_metric": F.when(up, F.lit(metric)), "attr_schema": F.when(up, F.lit(attr_schema).cast("string"))}).select(*ACTION_COLUMNS)
