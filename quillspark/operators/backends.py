"""Interfaces for models that live elsewhere, and deterministic stand-ins."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Generator(Protocol):
    def generate(self, prompts: list[str]) -> list[str]: ...


class Encoder(Protocol):
    def encode(self, texts: list[str]) -> list[list[float]]: ...


def dry_run(text: Column, iteration: Column) -> Column:
    """What the stand-in answers: the text, marked from the second iteration on."""
    return F.when(iteration > 0, F.concat(text, F.lit(" [revision "), iteration.cast("string"), F.lit("]"))).otherwise(text)


def generate(df: DataFrame, prompt_col: str, make: type[Generator], out: str = "response") -> DataFrame:
    """Answers of a generator that each task makes for itself."""
    names = df.columns

    def run(batches: Iterator) -> Iterator:
        backend = make()
        for b in batches:
            yield b.assign(**{out: backend.generate([x or "" for x in b[prompt_col]])})

    return df.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in names) + f", `{out}` string")


def encode(df: DataFrame, text_col: str, make: type[Encoder], out: str = "embedding") -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        backend = make()
        for b in batches:
            yield b.assign(**{out: backend.encode([x or "" for x in b[text_col]])})

    return df.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", `{out}` array<double>")
