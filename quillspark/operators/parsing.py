"""Parses of texts: any parser behind a table function, and a deterministic one by rules to stand in for a trained one."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L

#: sent and token count from 1 in each text and sentence; a root is its own head.
SCHEMA = "sent int, token int, word string, head int, pos string, dep string"


class Parser(Protocol):
    def parse(self, text: str) -> Iterable[tuple[int, int, str, int, str, str]]: ...


class RuleParser:
    """Sentences end at an end mark before white space. Verbs are told by their endings, articles and subordinators by lists, the rest are nouns.

    The first verb is the root and each later verb hangs on the one before: as adverbial clause or complement after a subordinator, else
    coordinate. Nouns, and what ends a sentence, hang on the verb before them, or on the first verb; articles and subordinators on the next word. Without a verb the first word is the root.
    """

    cut = re.compile(r"(?<=[.!?…])[ \t\n\r\f\v]+")
    word = re.compile(r"\w+")
    verb = re.compile(L.VERB_ENDING)

    def parse(self, text: str) -> Iterator[tuple[int, int, str, int, str, str]]:
        sent = 0
        for sentence in self.cut.split(text):
            words = self.word.findall(sentence)
            if words:
                sent += 1
                yield from self._sentence(sent, words)

    def _sentence(self, sent: int, words: list[str]) -> Iterator[tuple[int, int, str, int, str, str]]:
        low = [w.lower() for w in words]
        pos = ["DET" if w in L.DETERMINERS else "SCONJ" if w in L.SUBORDINATORS else "VERB" if len(w) > 3 and self.verb.search(w) else "NOUN" for w in low]
        root = pos.index("VERB") + 1 if "VERB" in pos else 1
        before, clause = 0, None
        for i, (w, p) in enumerate(zip(words, pos, strict=True), 1):
            if i == root:
                head, dep = i, "ROOT"
            elif p == "VERB":
                head, dep = before, clause or "conj"
            elif p in ("DET", "SCONJ"):
                head, dep = (i + 1 if i < len(words) else before or root), "det" if p == "DET" else "mark"
            else:
                head, dep = before or root, "obj" if before else "nsubj"
            if p == "SCONJ":
                clause = L.SUBORDINATORS[low[i - 1]]
            if p == "VERB":
                before, clause = i, None
            yield sent, i, w, head, p, dep


def table_function(make: Callable[[], Parser]) -> Callable[..., DataFrame]:
    """A table function of a text: its parse. ``make`` is called once in each task, so a parser with a large model is loaded there and not sent."""

    @F.udtf(returnType=SCHEMA, useArrow=True)
    class Parse:
        def __init__(self) -> None:
            self.parser = make()

        def eval(self, text: str) -> Iterator[tuple[int, int, str, int, str, str]]:
            if text:
                yield from self.parser.parse(text)

    return Parse


def parse(df: DataFrame, text: Column | str, *, make: Callable[[], Parser] = RuleParser, keep: list[str] | None = None) -> DataFrame:
    """keep (all columns by default) with SCHEMA, a row a token; a text that is null or has no word has none. A narrow lateral join."""
    some = df.select(*(keep or df.columns), (F.col(text) if isinstance(text, str) else text).alias("__text"))
    return some.lateralJoin(table_function(make)(F.col("__text").outer())).drop("__text")
