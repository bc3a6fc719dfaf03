"""Queries given as text of the dialect."""

from __future__ import annotations

import re

from ..database import TABLES, Database


class Texts:
    """A set of named texts. `run` is what this engine gets; `oracle` defaults to the same text."""

    def __init__(self):
        self.run: dict[str, str] = {}
        self.oracle: dict[str, str] = {}

    def add(self, name: str, text: str, oracle: str | None = None) -> None:
        self.run[name] = text
        self.oracle[name] = text if oracle is None else oracle

    def queries(self) -> dict:
        def make(text):
            used = sorted(set(re.findall(r"\w+", text.lower())) & set(TABLES))
            return lambda spark, sf_dir: Database.over(spark, sf_dir, used).query(text)

        return {k: make(v) for k, v in self.run.items()}
