"""The checkpoint to resume from, out of a listing of files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARKER = "run.json"
#: Files that a complete checkpoint has, none of them empty.
REQUIRED = (MARKER, "trainer_state.json", "optimizer.pt", "scheduler.pt", "rng_state.pth", "adapter_config.json", "adapter_model.safetensors")


def complete_checkpoints(files: DataFrame, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """(run, step) of the directories ``checkpoint-<step>`` that hold every required file, from a listing of
    (run, directory, name, length)."""
    ours = files.where(F.col("directory").rlike(r"^checkpoint-[0-9]+\z") & F.col("name").isin(*required) & (F.col("length") > 0))
    whole = ours.groupBy("run", "directory").agg(F.count_distinct("name").alias("n")).where(F.col("n") == len(required))
    return whole.select("run", F.regexp_extract("directory", "([0-9]+)", 1).cast("long").alias("step"))


def latest_checkpoints(files: DataFrame, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """(run, step): the highest complete step of each run; runs without one have no row."""
    return complete_checkpoints(files, required).groupBy("run").agg(F.max("step").alias("step"))


def check_resumable(previous: dict, config: dict, train_sha256: str, train_rows: int | None = None) -> None:
    """``ValueError`` unless a checkpoint's run marker names the same data, configuration and rows."""
    if previous.get("train_sha256") != train_sha256 or previous.get("config") != config:
        raise ValueError("Resume dataset or training config differs from checkpoint")
    if train_rows is not None and previous.get("train_rows") != train_rows:
        raise ValueError("Resume training subset differs from checkpoint")


#: Settings of which outputs depend, so a run may not change them for weights that exist.
BOUND_SETTINGS = ("model_id", "model_revision", "narrative_tokens", "max_seq_length")


def settings_for(saved: dict | None, requested: dict | None) -> dict:
    """The settings to run saved weights with: the requested ones, if they agree with the saved ones in what outputs
    depend on, else those that were saved. ``ValueError`` where neither is there or they disagree."""
    if saved is None:
        if requested is None:
            raise ValueError("No saved configuration; name one")
        return requested
    if requested is None:
        return saved
    for key in BOUND_SETTINGS:
        if requested.get(key) != saved.get(key):
            raise ValueError(f"Configuration differs from the saved one: {key}")
    return requested
